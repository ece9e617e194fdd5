"""Near-duplicates by min-max hashing, banding and exact confirmation.

Each permutation of the shingle set gives two values of the signature, its
minimum and its maximum, so 120 values cost 60 hash evaluations. Bands of four
values make 30 buckets per set; two sets of similarity 0.8 share none of them
with probability 1.4e-7. Equal sets meet once, through their set hash.

Pairs of a bucket are never all emitted. Every bucket tests its members against
two pivots, those of least and of greatest set hash. What is then still apart is
searched in blocks: open buckets of one least component make a family, and the
stragglers outside a family's largest component are run against all its members,
some hundreds of either in a task. Links are confirmed on whole shingle sets, so
only the buckets are a matter of chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .minmax import band_hashes, min_max, overlap, set_hashes, shingle_sets
from .shared import fresh, pinned, remove, text_batches, utf8_chunks

PERMUTATIONS, BAND_ROWS, SEED = 60, 4, 20011
#: Stragglers and members of a family that meet in one task.
STRAGGLERS, MEMBERS = 256, 512


@dataclass(frozen=True)
class NearDuplicates:
    shingle: int = 5
    percent: int = 80
    key: str = "doc_id"
    text: str = "text"


def _signed(rows: DataFrame, k: int) -> DataFrame:
    """``key, n, sid, check, signature`` per row of ``key, text``."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, data, offsets in utf8_chunks(batch.column("text")):
                h, bounds = shingle_sets(data, offsets, k)
                signature = min_max(h, bounds, PERMUTATIONS, SEED)
                parts.append((np.diff(bounds), *set_hashes(h, bounds), signature))
            if not parts:
                continue
            n, sid, check = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
            width = 8 * PERMUTATIONS
            raw = b"".join(p[3].tobytes() for p in parts)
            signature = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(n), [None, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n), pa.array(sid), pa.array(check), signature.cast(pa.binary())],
                names=["key", "n", "sid", "check", "signature"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n long, sid long, check long, signature binary")


def _bands(rows: DataFrame) -> DataFrame:
    """``band, sid``, each once."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw = b"".join(x.as_py() for x in batch.column("signature"))
            hashes = band_hashes(np.frombuffer(raw, np.uint32).reshape(len(batch), -1), BAND_ROWS)
            sid = np.repeat(np.asarray(batch.column("sid")), hashes.shape[1])
            pairs = np.unique(np.stack([hashes.ravel().view(np.int64), sid], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["band", "sid"])

    return rows.select("sid", "signature").mapInArrow(run, "band long, sid long").distinct()


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``sid, shingles`` of the rows of ``sid, text`` whose text has that set, each once."""

    def run(batches):
        for batch in batches:
            sids = np.asarray(batch.column("sid"))
            for at, data, offsets in utf8_chunks(batch.column("text")):
                h, bounds = shingle_sets(data, offsets, k)
                own = set_hashes(h, bounds)[0].view(np.int64)
                hit = np.flatnonzero(own == sids[at : at + len(own)])
                sets = [h[bounds[i] : bounds[i + 1]].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[hit]), pa.array(sets, pa.binary())], names=["sid", "shingles"]
                )

    return texts.mapInArrow(run, "sid long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column("left"), batch.column("right"))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = overlap(a, b)
                    keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = sets.select(F.col("sid").alias("u"), F.col("shingles").alias("left"))
    right = sets.select(F.col("sid").alias("v"), F.col("shingles").alias("right"))
    return pairs.join(left, "u").join(right, "v").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``key, n_shingles, component_id, kept, repeats``, one row per row of ``df``.

    Texts are lower-cased (A-Z) and cut into words at blanks; a text's set are
    its distinct runs of ``spec.shingle`` words, or its whole sequence if it is
    shorter. Documents are linked at ``100 * common >= percent * union``.
    ``component_id`` is the least key reachable, ``kept`` is whether it is the
    row's own, ``repeats`` how many rows have the key. Texts without words and
    null texts are linked with nothing. Rows that share a key are one document
    with several texts. Null keys: component null, kept. An empty table gives an
    empty result; other columns don't matter.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(F.col(spec.key).alias("key"), F.col(spec.text).alias("text"))
    signed, _ = pinned(_signed(rows, spec.shingle), "signed")
    worded = signed.filter("n > 0 and key is not null")

    same = F.min("check") == F.max("check")
    first = F.when(same, F.min("key")).otherwise(F.raise_error(F.lit("two sets share a hash: take another seed")))
    reps, _ = pinned(worded.groupBy("sid").agg(first.alias("rep")), "sets")

    # Buckets with more than one set.
    bands, bands_path = pinned(_bands(worded), "bands")
    several = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    several, several_path = pinned(several, "buckets")
    live, _ = pinned(bands.join(several, "band"), "live")
    remove(spark, bands_path)
    remove(spark, several_path)

    # Whole sets of the documents in them.
    wanted = live.select("sid").distinct().join(reps, "sid")
    texts = rows.join(wanted, rows["key"] == wanted["rep"]).select("sid", "text")
    sets, _ = pinned(_sets(texts, spec.shingle).dropDuplicates(["sid"]), "shingles")

    # Rows that share a key tie their sets together.
    shared_keys = worded.groupBy("key").agg(F.min("sid").alias("u"), F.max("sid").alias("most")).filter("u <> most")
    edges, _ = pinned(worded.join(shared_keys, "key").select("u", F.col("sid").alias("v")).distinct(), "links")

    new, _ = pinned(_linked(_pivot_pairs(live), sets, spec.percent), "links")
    edges = edges.unionByName(new)
    labels, labels_path = components(edges)
    # In buckets of up to three sets every pair has met.
    marked, marked_path = pinned(_marked(live.filter("size > 3"), labels), "marked")
    new, _ = pinned(_searched(marked, sets, spec.percent), "links")
    remove(spark, marked_path)
    remove(spark, labels_path)
    labels, _ = components(edges.unionByName(new))
    least = labels.join(reps, labels["node"] == reps["sid"]).groupBy("component").agg(F.min("rep").alias("least"))
    named = labels.join(least, "component").select(F.col("node").alias("sid"), "least")
    every = reps.join(named, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"))
    every, _ = pinned(every, "components")
    many, _ = pinned(signed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "repeats")

    kind = F.when(F.col("n") > 0, F.col("sid"))
    out = signed.select("key", "n", kind.alias("sid")).join(every, "sid", "left").join(many, "key", "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(spec.key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
        F.coalesce("m", F.lit(1)).cast("long").alias("repeats"),
    )


def _pivot_pairs(live: DataFrame) -> DataFrame:
    """Members of buckets with the two pivots of their bucket, each pair once, ``u < v``."""
    ends = live.groupBy("band").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    ends, _ = pinned(ends, "pivots")
    met = live.select("band", "sid").join(ends, "band")
    low = met.filter("sid <> low").select(F.col("low").alias("u"), F.col("sid").alias("v"))
    high = met.filter("sid <> high").select(F.col("sid").alias("u"), F.col("high").alias("v"))
    return low.unionByName(high).distinct()


def _marked(live: DataFrame, labels: DataFrame) -> DataFrame:
    """``band, sid, component`` of the bucket rows; sets without a link are their own component."""
    found = labels.withColumnRenamed("node", "sid")
    return live.join(found, "sid", "left").select("band", "sid", F.coalesce("component", "sid").alias("component"))


def _searched(marked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between the components of every family, at least one for any two components that have one."""
    spans = marked.groupBy("band").agg(F.min("component").alias("family"), F.max("component").alias("high"))
    spans, _ = pinned(spans.filter("family <> high").select("band", "family"), "open")
    members = marked.join(spans, "band").select("family", "sid", "component").distinct()
    members, _ = pinned(members, "members")
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = main.select(
        "family", "main",
        F.ceil((F.col("all") - F.col("most")) / STRAGGLERS).cast("int").alias("outer"),
        F.ceil(F.col("all") / MEMBERS).cast("int").alias("inner"),
    )
    blocks, _ = pinned(blocks, "families")
    held = members.join(blocks, "family")
    outer_block = F.pmod(F.xxhash64("sid"), F.col("outer")).cast("int")
    inner_block = F.pmod(F.xxhash64("sid"), F.col("inner")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = held.filter("component <> main").select("family", "sid", "component", outer_block.alias("i"), every("inner").alias("j"))
    known = held.select("family", "sid", "component", inner_block.alias("j"), every("outer").alias("i"))

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        links = {}
        if len(known) and len(asked):
            lists = [np.frombuffer(x, np.uint64) for x in known["shingles"]]
            sizes = np.array([len(x) for x in lists])
            tokens, places = np.unique(np.concatenate(lists), return_inverse=True)
            first = np.cumsum(sizes) - sizes
            labels, sids = known["component"].to_numpy(), known["sid"].to_numpy()
            for sid, label, shingles in zip(asked["a_sid"], asked["a_component"], asked["a_shingles"]):
                own = np.frombuffer(shingles, np.uint64)
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                mark = np.zeros(len(tokens), dtype=np.int64)
                mark[at[tokens[at] == own]] = 1
                both = np.add.reduceat(mark[places], first)
                near = (100 * both >= percent * (sizes + len(own) - both)) & (labels != label)
                for i in np.flatnonzero(near).tolist():
                    links.setdefault((label, labels[i]), (sid, sids[i]))
        return pd.DataFrame(list(links.values()), columns=["u", "v"], dtype="int64")

    keys = ("family", "i", "j")
    asked = asked.join(sets, "sid").select(*[F.col(c).alias(f"a_{c}") for c in (*keys, "sid", "component", "shingles")])
    known = known.join(sets, "sid").groupBy(*keys)
    return known.cogroup(asked.groupBy(*[f"a_{c}" for c in keys])).applyInPandas(run, "u long, v long")


def without_near_duplicates(docs: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One document of each group: of the rows linked by their texts the one of least key stays.

    A document here is a key with a text, so rows of one key and unlike texts
    are judged apart and none is lost; of rows that repeat both one stays. Rows
    without a key stay.
    """
    one, key, repeats = fresh(docs, "one", "kept_one", "repeats")
    text = F.col(spec.text)
    identity = F.struct(F.col(spec.key).alias("key"), F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    marked = docs.withColumn(one, F.when(F.col(spec.key).isNotNull(), identity))
    judged = near_duplicates(marked, NearDuplicates(spec.shingle, spec.percent, one, spec.text))
    kept = judged.filter(F.col("kept") & F.col(one).isNotNull()).select(F.col(one).alias(key), F.col("repeats").alias(repeats)).distinct()
    joined = marked.join(kept, F.col(one) == F.col(key))
    alone = joined.filter(F.col(repeats) == 1).select(*docs.columns)
    several = joined.filter(F.col(repeats) > 1).dropDuplicates([one]).select(*docs.columns)
    return alone.unionByName(several).unionByName(docs.filter(F.col(spec.key).isNull()))
