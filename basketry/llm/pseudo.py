"""Documents scored by masked pseudo-likelihood.

A small network sees ``SIDE`` words on either side of a word and predicts it;
a document's score is the sum of the conditional log-probabilities of all its
words, each predicted from both sides. The vocabulary grows with the corpus
(``room``). The most frequent words are symbols of the network's softmax; the
others are filed by their last letters, and inside each ending a Huffman tree
over the counts, whose forks are decided from the same hidden layer, tells the
words of the vocabulary apart: the work a word grows with the logarithm of the
vocabulary. A word below the vocabulary is its ending's rest times its own share
in the rest's corpus count; words of fewer than ``RARE`` uses share theirs equally.
The next ``HELD`` counts for each word of the vocabulary go to the tasks, the
others are joined by hash. So the probabilities over all words of the corpus sum to
one. Word counts come from all documents. The network is trained in numpy, in
every task on all documents of its part: every word is predicted once, in one of
the ``ROUNDS``, and the tasks' weights are averaged after each round, by a tree of
averages. Which documents share a task follows from the files and splits of the
table, and the weights with it.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pinned, remove, span_hashes, text_batches, utf8_chunks, word_spans

FREQUENT, ENDINGS = 31, 32
#: Symbol 0 stands outside the document; then the frequent words; then the endings.
SYMBOLS = 1 + FREQUENT + ENDINGS
#: Uses from which a word's count is its own, and words of text per vector of a task, so that the weights sent follow the text.
RARE, TEXT = 5, 512
#: Counts held by every task for each word of the vocabulary, 16 bytes each.
HELD = 32
SIDE, HIDDEN, SEED = 2, 32, 5
ROUNDS, BATCH, RATE = 2, 2048, 0.3
#: Tasks' weights that one task of the tree averages.
FAN = 16
OFFSETS = tuple(o for o in range(-SIDE, SIDE + 1) if o)


def room(total: int) -> int:
    """Words with a vector: the root of the corpus size, from some 5 million words on 13 times the cube root.

    A vector, its place in the tree and the counts held beside it take some 1200 bytes: 390 MB for 1.6e13 words (100 TB).
    """
    return max(FREQUENT, min(math.isqrt(total), int(13 * total ** (1 / 3))))


def word_codes(data: np.ndarray, offsets: np.ndarray):
    """Hash and ending of every word, and words per text."""
    starts, ends, counts = word_spans(data, offsets)
    mark = np.zeros(len(starts), dtype=np.int64)
    for back in (1, 2, 3):
        at = ends - back
        mark = mark * 257 + np.where(at >= starts, data[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return span_hashes(data, starts, ends).view(np.int64), (mark * 2654435761 >> 7) % ENDINGS, counts


def without_vector(frequent: list[int], least: int) -> Column:
    return (F.col("n") < least) & ~F.col("hash").isin(frequent)


def huffman(counts: list[int]) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Per leaf its ``(fork, side)`` from the root down, and per fork the log-odds of side 1 in the counts."""
    heap = [(n, i, (i,)) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children, odds = {}, []
    while len(heap) > 1:
        (a, i, _), (b, j, _) = heapq.heappop(heap), heapq.heappop(heap)
        children[len(counts) + len(odds)] = (i, j)
        heapq.heappush(heap, (a + b, len(counts) + len(odds), ()))
        odds.append(math.log(b / a))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(len(counts) + len(odds))]
    for at in reversed(range(len(counts), len(paths))):
        for side, child in enumerate(children[at]):
            paths[child] = [*paths[at], (at - len(counts), side)]
    return paths[: len(counts)], odds


class Vocabulary:
    """Numbers of the words by hash: symbols first, then the words of each ending in turn.

    ``known`` holds ``hash, ending, n`` of the words beyond the frequent that have
    a vector; ``rest`` the ``ending: (uses, uses of rare words, rare words)`` of
    all others. ``within`` is the log-probability of a rare word in its ending's
    rest, ``least`` the count from which words have a vector. ``held`` has hash,
    ending and count of the words below it whose counts the tasks hold, ``rarest``
    the least of these counts. The leaves of an
    ending's tree are its rest, if it has one, and its words; ``forks`` and
    ``sides`` from ``path[number]`` on lead to a number's leaf.
    """

    def __init__(self, frequent: list[int], known: list[tuple[int, int, int]], rest: dict[int, tuple[int, int, int]], least: int, total: int,
                 held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3, rarest: int | None = None):
        known = sorted(known, key=lambda w: (w[1], w[0]))
        endings = np.array([w[1] for w in known], dtype=np.int64)
        hashes = np.array([*frequent, *[w[0] for w in known]], dtype=np.int64)
        numbers = np.r_[1 + np.arange(len(frequent)), SYMBOLS + np.arange(len(known))]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], numbers[order]
        self.frequent, self.least, self.total, self.size = frequent, least, total, SYMBOLS + len(known)
        self.symbol = np.r_[np.arange(SYMBOLS), 1 + FREQUENT + endings]
        self.middle = np.zeros(ENDINGS)
        self.within = np.zeros(SYMBOLS)
        for ending, (uses, rare_uses, rare) in rest.items():
            self.middle[ending] = -np.log(uses)
            if rare:
                self.within[1 + FREQUENT + ending] = np.log(rare_uses / uses / rare)
        order = np.argsort(held[0], kind="stable")
        hash_, ending, n = (h[order] for h in held)
        self.rarest = least if rarest is None else rarest
        self.held, self.share = hash_, np.log(n) + (self.middle - self.within[1 + FREQUENT :])[ending]
        cuts = np.searchsorted(endings, np.arange(ENDINGS + 1))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]
        start: list[float] = []
        for ending in range(ENDINGS):
            own = range(cuts[ending], cuts[ending + 1])
            leaves = [(1 + FREQUENT + ending, rest[ending][0])] if ending in rest else []
            leaves += [(SYMBOLS + i, known[i][2]) for i in own]
            found, odds = huffman([n for _, n in leaves])
            for (number, _), path in zip(leaves, found):
                paths[number] = [(len(start) + fork, side) for fork, side in path]
            start += odds
        self.path = np.r_[0, np.cumsum([len(p) for p in paths])]
        self.forks = np.array([f for p in paths for f, _ in p], dtype=np.int64)
        self.sides = np.array([2 * s - 1 for p in paths for _, s in p], dtype=np.float32)
        #: The forks start at the shares of the counts.
        self.start = np.array(start, dtype=np.float32)

    def ways(self, numbers: np.ndarray):
        """Level by level down the trees: places in ``numbers`` that decide a fork there, the forks and the sides."""
        at, end = self.path[numbers], self.path[numbers + 1]
        some = np.flatnonzero(at < end)
        at, end = at[some], end[some]
        while len(some):
            yield some, self.forks[at], self.sides[at]
            at = at + 1
            more = at < end
            some, at, end = some[more], at[more], end[more]

    def encode(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + FREQUENT + endings
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.numbers[at[known]]
        return out

    def shares(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words have a count held here, and what their share adds to that of a rare word, else 0."""
        if not len(self.held):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        found = self.held[at] == hashes
        return found, np.where(found, self.share[at], 0.0)

    def above_rare(self, words: DataFrame) -> DataFrame:
        """``_hash, _more`` of the words of ``RARE`` uses or more without a vector: what their own share adds to that of a rare word."""
        base = F.array(*[F.lit(float(v)) for v in self.middle - self.within[1 + FREQUENT :]])
        more = F.log(F.col("n")) + F.element_at(base, F.col("ending") + 1)
        held = words.filter((F.col("n") >= RARE) & without_vector(self.frequent, self.least))
        return held.select(F.col("hash").alias("_hash"), more.cast("decimal(18,9)").alias("_more"))


def neighbours(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Symbols at ``OFFSETS`` from each word, 0 beyond its text."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(symbols)) - np.repeat(first, counts)
    length = np.repeat(counts, counts)
    out = np.zeros((len(symbols), len(OFFSETS)), dtype=np.int64)
    padded = np.pad(symbols, SIDE)
    for j, o in enumerate(OFFSETS):
        inside = (place + o >= 0) & (place + o < length)
        out[:, j] = np.where(inside, padded[SIDE + o : SIDE + o + len(symbols)], 0)
    return out


class Network:
    """Position-wise embeddings summed into one hidden layer, then a softmax over all symbols and the forks of each ending."""

    def __init__(self, words: Vocabulary):
        rng = np.random.default_rng(SEED)
        self.words = words
        self.embed = (rng.standard_normal((len(OFFSETS), words.size, HIDDEN)) * 0.3).astype(np.float32)
        self.bias = np.zeros(HIDDEN, dtype=np.float32)
        self.out = (rng.standard_normal((SYMBOLS, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.out_bias = np.zeros(SYMBOLS, dtype=np.float32)
        self.fork = np.zeros((len(words.start), HIDDEN), dtype=np.float32)
        self.fork_bias = words.start.copy()

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.embed[0][around[:, 0]]
        for j in range(1, around.shape[1]):
            h += self.embed[j][around[:, j]]
        h += self.bias
        return np.tanh(h, out=h)

    def log_probabilities(self, around: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Of each word's number given its neighbours."""
        out = np.empty(len(numbers))
        for at in range(0, len(numbers), BATCH):
            rows = slice(at, at + BATCH)
            own, h = numbers[rows], self.hidden(around[rows])
            value = _log_softmax(self.out @ h.T + self.out_bias[:, None], self.words.symbol[own])
            for some, forks, sides in self.words.ways(own):
                z = sides * (np.einsum("ij,ij->i", h[some], self.fork[forks]) + self.fork_bias[forks])
                value[some] -= np.logaddexp(np.float32(0), -z)
            out[rows] = value
        return out

    def step(self, around: np.ndarray, numbers: np.ndarray, rate: float, memory: list[np.ndarray]) -> None:
        """One step of adaptive gradient descent; only the vectors met move."""
        n = np.float32(len(numbers))
        h = self.hidden(around)
        p = _slope(self.out @ h.T + self.out_bias[:, None], self.words.symbol[numbers])
        dh = p.T @ self.out
        embed, bias, out, out_bias, fork, fork_bias = memory
        met = []
        for some, forks, sides in self.words.ways(numbers):
            near, own = h[some], self.fork[forks]
            z = sides * (np.einsum("ij,ij->i", near, own) + self.fork_bias[forks])
            slope = -sides / (1 + np.exp(np.minimum(z, np.float32(80)))) / n
            dh[some] += slope[:, None] * own
            met.append((forks, slope, slope[:, None] * near))
        if met:
            forks, slope, near = (np.concatenate(m) for m in zip(*met))
            order, kinds, begin = _grouped(forks)
            _move(self.fork, kinds, np.add.reduceat(near[order], begin, axis=0), rate, fork)
            _move(self.fork_bias, kinds, np.add.reduceat(slope[order], begin), rate, fork_bias)
        dh *= 1 - h * h
        _move(self.out, ..., p @ h, rate, out)
        _move(self.out_bias, ..., p.sum(axis=1), rate, out_bias)
        _move(self.bias, ..., dh.sum(axis=0), rate, bias)
        for j in range(around.shape[1]):
            order, kinds, begin = _grouped(around[:, j])
            _move(self.embed[j], kinds, np.add.reduceat(dh[order], begin, axis=0), rate, embed[j])

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.out, self.out_bias, self.fork, self.fork_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self


def _grouped(keys: np.ndarray):
    """Order of fewer than 2^24 keys that brings equal ones together, the kinds, and where each begins."""
    packed = np.sort(keys << 24 | np.arange(len(keys)))
    kinds = packed >> 24
    begin = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    return packed & (1 << 24) - 1, kinds[begin], begin


def _log_softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of ``own`` in each column."""
    z -= z.max(axis=0)
    value = z[own, np.arange(z.shape[1])].astype(np.float64)
    return value - np.log(np.exp(z, out=z).sum(axis=0, dtype=np.float64))


def _slope(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss by ``z``, in its place."""
    n = np.float32(z.shape[1])
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z *= 1 / (z.sum(axis=0) * n)
    z[own, np.arange(z.shape[1])] -= 1 / n
    return z


def _move(value: np.ndarray, at, grad: np.ndarray, rate: float, held: np.ndarray) -> None:
    own = held[at] + grad * grad
    held[at] = own
    value[at] -= rate * grad / (np.sqrt(own) + np.float32(1e-6))


def _counted(texts: DataFrame) -> DataFrame:
    """``hash, ending, n`` of every word of all texts."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in utf8_chunks(batch.column("text")):
                hashes, endings, _ = word_codes(data, offsets)
                kinds, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), pa.array(endings[first].astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["hash", "ending", "n"],
                )

    each = texts.select("text").mapInArrow(run, "hash long, ending int, n long")
    return each.groupBy("hash", "ending").agg(F.sum("n").alias("n"))


def _reached(sizes: list[tuple[int, int]], most: int) -> int:
    """The least count, of ``RARE`` or more, that at most ``most`` words reach; ``sizes``: counts, descending, and words of each."""
    least = sizes[0][0] + 1 if sizes else 1
    for n, m in sizes:
        most -= m
        if most < 0 or n < RARE:
            break
        least = n
    return least


def vocabulary(words: DataFrame) -> Vocabulary:
    """From ``hash, ending, n`` of all words: the frequent, and those of at least the count that ``room`` words reach."""
    sizes = sorted(((r.n, r.m) for r in words.groupBy("n").agg(F.count("*").alias("m")).collect()), reverse=True)
    total = sum(n * m for n, m in sizes)
    least, rarest = (_reached(sizes, r) for r in (room(total), (1 + HELD) * room(total)))
    top = [r.hash for r in words.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()]
    near = words.filter(F.col("n") >= rarest).select("hash", "ending", "n").toArrow()
    hashes, endings, n = (near[c].to_numpy() for c in ("hash", "ending", "n"))
    bare = ~np.isin(hashes, top)
    known = bare & (n >= least)
    held = bare & (n < least)
    known = list(zip(*[c[known].tolist() for c in (hashes, endings, n)]))
    rare = F.col("n") < RARE
    others = words.filter(without_vector(top, least)).groupBy("ending")
    rest = others.agg(F.sum("n").alias("uses"), F.sum(F.when(rare, F.col("n"))).alias("rare_uses"), F.count_if(rare).alias("rare"))
    rest = {r.ending: (r.uses, r.rare_uses, r.rare) for r in rest.collect()}
    return Vocabulary(top, known, rest, least, total, (hashes[held], endings[held], n[held]), rarest)


def _averaged(rows: DataFrame) -> DataFrame:
    """One row of weighted means per partition."""

    def run(frames):
        total, n = None, 0
        for pdf in frames:
            for weights, words in zip(pdf["weights"], pdf["n"]):
                part = np.frombuffer(weights, np.float32) * np.float64(words)
                total = part if total is None else total + part
                n += words
        if total is not None:
            yield pd.DataFrame({"weights": [(total / n).astype(np.float32).tobytes()], "n": [n]})

    return rows.mapInPandas(run, "weights binary, n long")


def train(texts: DataFrame, words: Vocabulary) -> Network:
    """Network averaged over the tasks' own, weighted by the words they have seen.

    A word of each batch is a target in one of the rounds, and a neighbour in all.
    """
    spark, network = texts.sparkSession, Network(words)
    texts = texts.coalesce(max(1, words.total // (TEXT * words.size)))
    codes = pickle.dumps(words)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((codes, network.flat()))
        rate = RATE / (1 + turn)

        def learn(batches, sent=sent, rate=rate, turn=turn):
            held, flat = sent.value
            held, seen = pickle.loads(held), 0
            own = Network(held).load(flat)
            memory = [np.zeros_like(p) + 1e-6 for p in own.parts()]
            for batch in batches:
                for _, data, offsets in utf8_chunks(batch.column("text")):
                    hashes, endings, counts = word_codes(data, offsets)
                    symbols = held.encode(hashes, endings)
                    around = neighbours(symbols, counts)
                    order = np.random.default_rng(len(symbols)).permutation(len(symbols))[turn::ROUNDS]
                    for at in range(0, len(order), BATCH):
                        rows = order[at : at + BATCH]
                        own.step(around[rows], symbols[rows], rate, memory)
                    seen += len(symbols)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([own.flat().tobytes()], pa.binary()), pa.array([seen])], names=["weights", "n"])

        each, path = pinned(texts.select("text").mapInArrow(learn, "weights binary, n long"), "weights")
        tasks = each.count()
        while tasks > 1:
            tasks = -(-tasks // FAN)
            (each, path), lower = pinned(_averaged(each.repartition(tasks)), "weights"), path
            remove(spark, lower)
        both = each.collect()
        remove(spark, path)
        if not both:
            break
        network.load(np.frombuffer(both[0].weights, np.float32))
    return network


def pseudo_likelihood(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, log_likelihood, per_word``: sums over all words of each text, a row per row.

    Null and empty texts have no words, log-likelihood 0 and no value per word.
    All words of all documents train the network. Repeated rows get equal scores; other columns don't matter.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted, _ = pinned(_counted(rows), "words")
    words = vocabulary(counted)
    network = train(rows, words)
    sent = spark.sparkContext.broadcast((pickle.dumps(words), network.flat()))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        held, flat = sent.value
        held, row = pickle.loads(held), TaskContext.get().partitionId() << 40
        own = Network(held).load(flat)
        for batch in batches:
            sums, sizes, rest, ends = [], [], [], [np.zeros(1, np.int64)]
            for _, data, offsets in utf8_chunks(batch.column("text")):
                hashes, endings, counts = word_codes(data, offsets)
                numbers = held.encode(hashes, endings)
                value = own.log_probabilities(neighbours(numbers, counts), numbers)
                bare = (numbers > FREQUENT) & (numbers < SYMBOLS)
                found, more = held.shares(hashes[bare])
                value[bare] += held.within[numbers[bare]] + more
                bare[bare] = ~found
                at = np.concatenate([[0], np.cumsum(counts)])
                total = np.concatenate([[0.0], np.cumsum(value)])
                sums.append(total[at[1:]] - total[at[:-1]])
                sizes.append(counts)
                rest.append(hashes[bare])
                ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(bare)])[at[1:]])
            if sums:
                rows = pa.array(row + np.arange(len(batch)))
                row += len(batch)
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(rest)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums)), rows, rest],
                    names=[key, "n_words", "log_likelihood", "_row", "_rest"],
                )

    schema = f"`{key}` {kind}, n_words long, log_likelihood double, _row long, _rest array<long>"
    scored, _ = pinned(rows.mapInArrow(run, schema), "scored")
    # Own shares are added as decimals, so that repeated rows get equal sums.
    shares = scored.select("_row", F.explode("_rest").alias("_hash")).join(words.above_rare(counted.filter(F.col("n") < words.rarest)), "_hash")
    shares = shares.groupBy("_row").agg(F.sum("_more").cast("double").alias("_more"))
    both = scored.join(shares, "_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0)))
    per_word = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return both.select(key, "n_words", "log_likelihood", per_word.alias("per_word"))
