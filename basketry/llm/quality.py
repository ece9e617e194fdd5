"""Quality scores from a logistic regression over hashed n-grams of words.

A text is a sparse vector: how often each n-gram of its words (lower case, up to
``WORD_GRAMS``) and of their shapes (up to ``SHAPE_GRAMS``) occurs, hashed into
2**BITS places, as square roots scaled to length one, and one place for the
order of magnitude of its word count. The shape of a word keeps its classes of
characters and every sign (``Abc!!`` is ``Aa!``); a word equal to the one before
has the shape ``=``. Follow-the-regularised-leader updates fit the weights, one
labelled document at a time; a score is the logistic of a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64, pinned, remove, rolled, span_hashes, text_batches, utf8_chunks, word_spans

#: Labelled documents that the weights are fitted on, chosen by hash of their key.
TRAIN_DOCS = 20_000
EPOCHS = 4
BITS, WORD_GRAMS, SHAPE_GRAMS = 20, 2, 3
#: Step size, its damping, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
FOLDS, HELD_OUT = 5, 0
#: Places: n-grams, orders of magnitude, constant.
_SIZES = 40
PLACES = (1 << BITS) + _SIZES + 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    classes = _SHAPE[data]
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = classes[1:] != classes[:-1]
    kept[starts] = True
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kept, out=before[1:])
    out = span_hashes(classes[kept], before[starts], before[ends])
    out[1:][(hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])] = np.uint64(1)
    return out


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Per view and n-gram length: the text and the place of every n-gram."""
    starts, ends, counts = word_spans(data, offsets)
    texts = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return
    hashes = span_hashes(_LOWER[data], starts, ends)
    views = ((hashes, WORD_GRAMS), (_shapes(data, starts, ends, hashes, texts), SHAPE_GRAMS))
    for tag, (values, longest) in enumerate(views):
        for n in range(1, longest + 1):
            inside = texts[: len(texts) - n + 1] == texts[n - 1 :]
            places = mix64(rolled(values, n) + np.uint64(16 * tag + n)) >> np.uint64(64 - BITS)
            yield texts[: len(inside)][inside], places[inside].astype(np.int64)


def vectors(data: np.ndarray, offsets: np.ndarray):
    """``bounds, places, values``: the sparse vectors of the texts in ``data``, text i from bounds[i] to bounds[i + 1].

    A text without words has its order of magnitude and the constant only.
    """
    n = len(offsets) - 1
    if n == 1:  # one text may be very long: its counts are dense
        dense = np.zeros(1 << BITS, dtype=np.int64)
        for _, at in _grams(data, offsets):
            dense += np.bincount(at, minlength=1 << BITS)
        places = np.flatnonzero(dense)
        texts, counts = np.zeros(len(places), np.int64), dense[places]
    else:
        joint = [(of << BITS) + at for of, at in _grams(data, offsets)]
        joint, counts = np.unique(np.concatenate(joint) if joint else np.zeros(0, np.int64), return_counts=True)
        texts, places = joint >> BITS, joint & ((1 << BITS) - 1)
    values = np.sqrt(counts)
    norm = np.sqrt(np.bincount(texts, weights=values * values, minlength=n))
    values = values / norm[texts]
    words = word_spans(data, offsets)[2]
    size = (1 << BITS) + np.minimum(np.log2(words + 1).astype(np.int64), _SIZES - 1)
    ends = np.searchsorted(texts, np.arange(n), side="right")
    places = np.insert(places, np.repeat(ends, 2), np.stack([size, np.full(n, PLACES - 1)], axis=1).ravel())
    values = np.insert(values, np.repeat(ends, 2), 1.0)
    return np.append(0, ends + 2 * np.arange(1, n + 1)), places, values


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that follow from the sums of adjusted gradients and of squared gradients."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` runs over ``(label, places, values)`` in the given order."""
    z, n = np.zeros(PLACES), np.zeros(PLACES)
    for _ in range(epochs):
        for label, at, x in rows:
            sums, squares = z[at], n[at]
            weights = _leader(sums, squares)
            slope = (_logistic(weights @ x) - label) * x
            after = squares + slope * slope
            z[at] = sums + slope - (np.sqrt(after) - np.sqrt(squares)) / ALPHA * weights
            n[at] = after
    return _leader(z, n)


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, at most ``PLACES``."""

    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(PLACES)
        out[self.places] = self.weights
        return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS
) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold (crc32 of the key as text, modulo 5, is 0).

    Labels other than 0 and 1, null keys and labels without a document are left
    out; of several labels of a key the largest holds, of several texts of a key
    the greatest. Without labels all weights are 0 and every score is 0.5. The
    vectors are made in parallel and kept; one task runs the updates, in the
    order of the keys' hashes, so reruns agree.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("key is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Bounded: ``most`` ids.
    sample = rows.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.max("text").alias("text"))
    sample = sample.select(F.xxhash64("key").alias("at"), F.col("key").cast("string").alias("key"), "label", "text")

    def spread(batches):
        for batch in batches:
            for first, data, offsets in utf8_chunks(batch.column("text")):
                bounds, places, values = vectors(data, offsets)
                part = batch.slice(first, len(offsets) - 1)
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(v))
                    for v in (places.astype(np.int32), values.astype(np.float32))
                ]
                columns = [part.column("at"), part.column("key"), part.column("label"), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "key", "label", "places", "values"])

    schema = "at long, key string, label int, places array<int>, values array<float>"
    kept, path = pinned(sample.mapInArrow(spread, schema), "quality-vectors")

    def update(batches):
        seen = []
        for batch in batches:
            for i, y in enumerate(batch.column("label").to_pylist()):
                at, x = (batch.column(c)[i].values.to_numpy() for c in ("places", "values"))
                seen.append((y, at.copy(), x.copy()))
        weights = fit(seen)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], names=["place", "weight"])

    # Bounded: ``most`` sparse vectors in one task.
    ordered = kept.coalesce(1).sortWithinPartitions("at", "key").select("label", "places", "values")
    found = ordered.mapInArrow(update, "place long, weight double").toArrow()
    remove(spark, path)
    return Model(found["place"].to_numpy(), found["weight"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", as_name: str = "score") -> DataFrame:
    """``docs`` without ``text``, with a score from 0 to 1 for each row (null and empty texts included).

    A column of ``docs`` named like the score is replaced.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c not in (text, as_name)], text)
    others = [c for c in kept.columns if c != text]

    def run(batches):
        weights = sent.value.dense()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, data, offsets in utf8_chunks(batch.column(text)):
                bounds, places, values = vectors(data, offsets)
                sums = np.add.reduceat(weights[places] * values, bounds[:-1])
                scores[first : first + len(sums)] = _logistic(sums)
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*others, as_name])

    return kept.mapInArrow(run, kept.drop(text).schema.add(as_name, "double"))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` per row of ``docs``; a null key is not held out.

    Repeated rows each get their row, equal texts equal scores. An empty table gives no rows.
    """
    out = score(docs.select(F.col(key), F.col(text)), train(docs, labels, key, text), text)
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
