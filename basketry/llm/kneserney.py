"""Class-conditional Kneser-Ney models over the characters of words.

A word is its characters between two boundary marks. Each class has its own
counts for characters after a full history (``ORDER - 1`` characters, or all back
to the start of the word); both back off to one shared distribution, built from
the continuation counts of all classes together. So a rare expression that one
class has seen is judged by that class, and where neither class has seen it the
shared estimate cancels and only the two back-off weights differ.
"""

from __future__ import annotations

import math
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64

ORDER, DISCOUNT = 6, 0.75
START, END = "\x02", "\x03"
#: Characters assumed beside those seen, for the uniform end of the chain.
ALPHABET = 256


def grams(word: str, order: int = ORDER) -> list[str]:
    """Each character of the marked word after its full history."""
    marked = START + word + END
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


class Contrast:
    """Log-likelihood ratio (positive over negative class) of a word, in nats."""

    def __init__(self, ratio: dict[str, float], weight: dict[str, float], order: int = ORDER):
        self.ratio, self.weight, self.order = ratio, weight, order

    def word(self, word: str) -> float:
        total, ratio, weight, order = 0.0, self.ratio, self.weight, self.order
        marked = START + word + END
        for i in range(2, len(marked) + 1):
            gram = marked[max(0, i - order) : i]
            found = ratio.get(gram)
            if found is None:
                found = weight.get(gram[:-1])
                if found is None:
                    continue
            total += found
        return total


def fit(counts: dict[str, tuple[int, int]], order: int = ORDER, discount: float = DISCOUNT) -> Contrast:
    """From ``gram: (positive count, negative count)`` of full-history grams."""
    shared = _shared(counts, order, discount)
    totals = defaultdict(lambda: [0, 0, 0, 0])
    for gram, (p, n) in counts.items():
        t = totals[gram[:-1]]
        t[0] += p
        t[1] += n
        t[2] += p > 0
        t[3] += n > 0
    ratio, weight = {}, {}
    for h, (p, n, kinds_p, kinds_n) in totals.items():
        back_p = discount * kinds_p / p if p else 1.0
        back_n = discount * kinds_n / n if n else 1.0
        weight[h] = math.log(back_p) - math.log(back_n)
    for gram, (p, n) in counts.items():
        h = gram[:-1]
        all_p, all_n, kinds_p, kinds_n = totals[h]
        base = shared(gram[-1], h[1:])
        prob_p = (max(p - discount, 0) + discount * kinds_p * base) / all_p if all_p else base
        prob_n = (max(n - discount, 0) + discount * kinds_n * base) / all_n if all_n else base
        ratio[gram] = math.log(prob_p) - math.log(prob_n)
    return Contrast(ratio, weight, order)


def _shared(counts, order: int, discount: float):
    """Interpolated probability of a character after a shortened history, from pooled continuation counts."""
    level = set(counts)
    seen: Counter = Counter()
    for _ in range(order - 1):
        below = Counter(g[1:] for g in level if len(g) > 1)
        seen.update(below)
        level = {g for g in below if len(g) > 1}
    sums: Counter = Counter()
    kinds: Counter = Counter()
    for g, n in seen.items():
        sums[g[:-1]] += n
        kinds[g[:-1]] += 1
    memo: dict[str, float] = {}

    def prob(x: str, h: str) -> float:
        found = memo.get(h + x)
        if found is None:
            lower = prob(x, h[1:]) if h else 1.0 / ALPHABET
            total = sums[h] if h in sums else 0
            if total:
                found = (max(seen.get(h + x, 0) - discount, 0) + discount * kinds[h] * lower) / total
            else:
                found = lower
            memo[h + x] = found
        return found

    return prob


# The same over a table of grams ----------------------------------------------

#: Entries of a piece of a table, 16 bytes each. A table has as many pieces as its entries need, every text an entry of its own.
SLOTS = 1 << 21


_STEP = 0xD1342543DE82EF95


def _windows(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the last ``order`` characters up to each character of some words, of the same without it, and its place in its word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = mix64((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    whole, before, power = codes.copy(), np.zeros(len(codes), np.uint64), 1
    for back in range(1, min(order, len(codes))):
        earlier = np.where(place[back:] >= back, codes[:-back], np.uint64(0))
        before[back:] += earlier * np.uint64(power)
        power = power * _STEP % 2**64
        whole[back:] += earlier * np.uint64(power)
    keys = (mix64(sums + np.minimum(n, most).astype(np.uint64) * np.uint64(_STEP)) for sums, n, most in ((whole, place + 1, order), (before, place, order - 1)))
    return *(k.view(np.int64) for k in keys), place


def keys_of(texts: list[str]) -> np.ndarray:
    """64 bits of each text of 1 to ``ORDER`` characters."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return _windows(texts)[0][ends - 1]


class Piece:
    """Sorted keys, their values, and for the leading bits of a key the first entry that has them.

    It is sent as bytes and lies in a nameless file of the task's machine from then
    on, mapped, so that a task's own memory does not grow with the table.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, starts: np.ndarray | None = None):
        self.keys, self.values = keys, values
        self.low, span = int(keys[0]), int(keys[-1]) - int(keys[0])
        self.shift = max(0, span.bit_length() - max(1, len(keys) - 1).bit_length())
        if starts is None:
            starts = np.searchsorted(self._bits(keys), np.arange((span >> self.shift) + 2)).astype(np.int32)
        self.starts = starts

    def __reduce__(self):
        return _mapped, (self.keys.tobytes(), self.values.tobytes(), self.starts.tobytes())

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) - np.uint64(self.low % 2**64)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, value = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        left = np.flatnonzero((keys >= self.keys[0]) & (keys <= self.keys[-1]))
        bits = self._bits(keys[left])
        at, end = self.starts[bits], self.starts[bits + 1]
        while len(left):
            some = at < end
            left, at, end = left[some], at[some], end[some]
            same = self.keys[at] == keys[left]
            found[left[same]], value[left[same]] = True, self.values[at[same]]
            left, at, end = left[~same], at[~same] + 1, end[~same]
        return found, value


def _mapped(*parts: bytes) -> Piece:
    arrays = []
    for part, kind in zip(parts, (np.int64, np.float32, np.int32)):
        with tempfile.TemporaryFile() as f:
            f.write(part)
            f.flush()
            arrays.append(np.memmap(f, kind, "r").view(np.ndarray))
    return Piece(*arrays)


class Slots:
    """Values by key: broadcast pieces in the order of the keys, and the last key of each."""

    #: No two texts share an entry.
    modulus = 0

    def __init__(self, pieces: list[Broadcast], lasts: list[int]):
        self.pieces, self.lasts = pieces, np.array(lasts, dtype=np.int64)

    @property
    def keys(self) -> np.ndarray:
        """Of the first piece."""
        return self.pieces[0].value.keys if self.pieces else np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) == 1:
            return self.pieces[0].value.find(keys)
        found, value = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        where = np.searchsorted(self.lasts, keys)
        for i, piece in enumerate(self.pieces):
            some = np.flatnonzero(where == i)
            found[some], value[some] = piece.value.find(keys[some])
        return found, value

    def remove(self) -> None:
        for piece in self.pieces:
            piece.destroy()


class Tables:
    """A ``Contrast`` by keys: log-likelihood ratios of many words at once."""

    def __init__(self, ratio: Slots, weight: Slots, order: int = ORDER):
        self.ratio, self.weight, self.order = ratio, weight, order

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        whole, before, place = _windows([START + w + END for w in words], self.order)
        first = np.flatnonzero(place == 0)
        found, value = self.ratio.find(whole)
        seen, weight = self.weight.find(before)
        value = np.where(found, value, np.where(seen, weight, 0)).astype(np.float64)
        value[first] = 0
        return np.add.reduceat(value, first)

    def word(self, word: str) -> float:
        return float(self.words([word])[0])

    def remove(self) -> None:
        """Once no task needs it any more."""
        self.ratio.remove()
        self.weight.remove()


def fitted(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """As ``fit``, over ``gram, p, n``: ``text, value, uses`` of the grams and of the histories."""
    gram, least = F.col("gram"), F.lit(1.0 / ALPHABET)
    start, tail = F.expr("left(gram, length(gram) - 1)"), F.expr("substring(gram, 2)")
    totals = counts.groupBy(start.alias("start")).agg(
        F.sum("p").alias("all_p"), F.sum("n").alias("all_n"),
        F.count_if(F.col("p") > 0).alias("kinds_p"), F.count_if(F.col("n") > 0).alias("kinds_n"),
    )
    # Distinct strings a character or more shorter, of how many of the strings one longer each is the end.
    cut = F.sequence(F.lit(0), F.lit(order - 2))
    longer = counts.select(F.explode(cut).alias("cut"), gram).select("cut", F.expr("substring(gram, cut + 1)").alias("gram"))
    seen = longer.where(F.length(gram) > 1).distinct().groupBy(tail.alias("end")).agg(F.count(F.lit(1)).alias("seen"))
    begin = F.expr("left(end, length(end) - 1)")
    sums = seen.groupBy(begin.alias("begin")).agg(F.sum("seen").alias("sum"), F.count(F.lit(1)).alias("kinds"))
    parts = seen.withColumn("begin", begin).join(sums, "begin").select(
        "end", (F.greatest(F.col("seen") - discount, F.lit(0.0)) / F.col("sum")).alias("own"), (discount * F.col("kinds") / F.col("sum")).alias("back")
    )
    # The chain of a string: its ends, of which there are fewer than ``order``, from the shortest on.
    tails = counts.select(tail.alias("tail")).distinct()
    ends = tails.select("tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("size")).withColumn("end", F.expr("right(tail, size)"))
    chain = ends.join(parts, "end").groupBy("tail").agg(F.sort_array(F.collect_list(F.struct("size", "own", "back"))).alias("chain"))
    base = chain.select("tail", F.aggregate("chain", least, lambda lower, x: x["own"] + x["back"] * lower).alias("base"))
    full = counts.withColumns({"start": start, "tail": tail}).join(totals, "start").join(base, "tail")

    def share(side: str) -> Column:
        own = F.greatest(F.col(side) - discount, F.lit(0.0)) + discount * F.col(f"kinds_{side}") * F.col("base")
        return F.when(F.col(f"all_{side}") > 0, own / F.col(f"all_{side}")).otherwise(F.col("base"))

    def back(side: str) -> Column:
        return F.when(F.col(f"all_{side}") > 0, discount * F.col(f"kinds_{side}") / F.col(f"all_{side}")).otherwise(F.lit(1.0))

    ratio = full.select(gram.alias("text"), (F.log(share("p")) - F.log(share("n"))).alias("value"), (F.col("p") + F.col("n")).alias("uses"))
    weight = totals.select(F.col("start").alias("text"), (F.log(back("p")) - F.log(back("n"))).alias("value"), (F.col("all_p") + F.col("all_n")).alias("uses"))
    return ratio, weight


def slots(values: DataFrame, many: bool, most: int = SLOTS) -> Slots:
    """From ``text, value, uses``, in pieces of ``most``; ``many``: more rows than that, of which the driver holds a piece at a time."""

    def run(batches):
        for batch in batches:
            if len(batch):
                keys = keys_of(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("value"), batch.column("uses")], names=["key", "value", "uses"])

    def packed(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pydict({c: [batch.column(c).to_numpy().tobytes()] for c in ("keys", "values")})

    rows = values.select("text", "value", F.col("uses").cast("double").alias("uses")).mapInArrow(run, "key long, value double, uses double")
    # Texts whose 64 bits agree would share an entry: one pair in 10^5 tables of 20 million.
    mean = (F.sum(F.col("value") * F.col("uses")) / F.sum("uses")).cast("float")
    table = rows.groupBy(F.col("key").alias("keys")).agg(mean.alias("values"))

    def runs():
        if many:
            ordered = table.repartitionByRange("keys").sortWithinPartitions("keys").mapInArrow(packed, "keys binary, values binary")
            for r in ordered.toLocalIterator():
                yield np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], np.float32)
        else:
            few = table.toArrow().sort_by("keys")
            yield few["keys"].to_numpy(), few["values"].to_numpy()

    context, pieces, lasts = values.sparkSession.sparkContext, [], []

    def send(keys: np.ndarray, found: np.ndarray) -> None:
        pieces.append(context.broadcast(Piece(keys, found)))
        lasts.append(int(keys[-1]))

    keys, found = np.zeros(0, np.int64), np.zeros(0, np.float32)
    for more, own in runs():
        keys, found = np.concatenate([keys, more]), np.concatenate([found, own])
        while len(keys) >= most:
            send(keys[:most], found[:most])
            keys, found = keys[most:], found[most:]
    if len(keys):
        send(keys, found)
    return Slots(pieces, lasts)


def fit_table(counts: DataFrame, most: int = SLOTS) -> Tables:
    """From ``gram, p, n`` of all grams, which stay in Spark."""
    many = counts.count() > most
    ratio, weight = fitted(counts)
    return Tables(slots(ratio, many, most), slots(weight, many, most))
