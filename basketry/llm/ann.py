"""Approximate nearest neighbours through learned partitions.

On a bounded sample the neighbour graph is cut into equal parts with few edges
between them, and a small network learns to tell, from a vector, in which parts
its neighbours lie. The network then deals every vector of the table to its most
probable part, and every query to as many of its most probable parts as the
sample needed for the target recall. Candidates are reranked exactly, in double
precision.

Parts are dealt in blocks of bounded size, and so are the queries: a task holds
one block of either. Of equal vectors only as many as can be asked for are kept
in a block; the others could never be among the nearest.

With fewer than ``PART_ROWS`` vectors there is one part: nothing is learned, and
every query is compared with all vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pinned

#: Vectors the partitions and the network are fitted on.
SAMPLE = 8192
#: Least rows aimed at per part; parts are a power of two, at most ``SAMPLE / 64``.
PART_ROWS = 128
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
TARGET = 0.93
GRAPH_NEIGHBOURS, HIDDEN, EPOCHS, SEED = 16, 96, 40, 11


# Fitting, on the sample ----------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row, nearest first."""
    norms, out = (x * x).sum(axis=1), np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        rows = slice(at, min(at + 1024, len(x)))
        d = norms[rows, None] + norms[None, :] - 2 * x[rows] @ x.T
        d[np.arange(d.shape[0]), np.arange(rows.start, rows.stop)] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[rows] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node: equal halves again and again, each cut made short by swaps."""
    label = np.zeros(len(graph), dtype=np.int64)
    sources = np.repeat(np.arange(len(graph)), graph.shape[1])
    edges = np.stack([sources, graph.ravel()])
    while parts > 1:
        new = label * 2
        for value in np.unique(label):
            nodes = np.flatnonzero(label == value)
            place = np.full(len(graph), -1)
            place[nodes] = np.arange(len(nodes))
            u, v = place[edges[0]], place[edges[1]]
            inside = (u >= 0) & (v >= 0)
            new[nodes] += _halves(u[inside], v[inside], len(nodes), rng)
        label, parts = new, parts // 2
    return label


def _halves(u: np.ndarray, v: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n) + 1e-9
    y = rng.standard_normal(n)
    for _ in range(60):  # slowest mode of a walk on the graph
        y = 0.5 * y + 0.5 * (np.bincount(u, y[v], n) + np.bincount(v, y[u], n)) / degree
        y -= (y * degree).sum() / degree.sum()
        y /= np.linalg.norm(y) + 1e-12
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(y, kind="stable")[n // 2 :]] = 1
    for _ in range(30):
        cross = side[u] != side[v]
        sign = np.where(cross, 1.0, -1.0)
        gain = np.bincount(u, sign, n) + np.bincount(v, sign, n)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum())
        if not good:
            break
        move = max(1, good // 4)
        side[left[:move]], side[right[:move]] = 1, 0
    return side


class Router:
    """A network with one hidden layer: probabilities of the parts for each vector."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.mean, self.scale = np.zeros(dim), 1.0
        self.w1 = rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim)
        self.b1 = np.zeros(HIDDEN)
        self.w2 = rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN)
        self.b2 = np.zeros(parts)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return h, p / p.sum(axis=1, keepdims=True)

    def learn(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        self.mean = x.mean(axis=0)
        self.scale = float(np.sqrt(((x - self.mean) ** 2).mean())) + 1e-12
        names = ("w1", "b1", "w2", "b2")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h, p = self.forward(x[rows])
                dz = (p - target[rows]) / len(rows)
                dh = dz @ self.w2.T * (1 - h * h)
                grads = {
                    "w2": h.T @ dz + 1e-5 * self.w2, "b2": dz.sum(axis=0),
                    "w1": ((x[rows] - self.mean) / self.scale).T @ dh + 1e-5 * self.w1, "b1": dh.sum(axis=0),
                }
                step += 1
                rate = 3e-3 * (1 - 0.9 * epoch / EPOCHS)
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, getattr(self, n) - rate * move)


def learn_router(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> tuple[Router, int]:
    """A router over ``parts`` parts and the number of parts a query must visit for ``target`` recall on the sample.

    A fifth of the sample is kept from the network and plays the queries.
    """
    rng = np.random.default_rng(SEED)
    graph = neighbour_graph(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    label = balanced_parts(graph, parts, rng)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0 / graph.shape[1])
    soft = 0.5 * share + 0.5 * np.eye(parts)[label]
    asked = rng.permutation(len(x))[: max(1, len(x) // 5)]
    known = np.setdiff1d(np.arange(len(x)), asked)
    router = Router(x.shape[1], parts, rng)
    router.learn(x[known], soft[known], rng)
    home = router.forward(x)[1].argmax(axis=1)
    ranked = np.argsort(-router.forward(x[asked])[1], axis=1, kind="stable")
    rank_of = np.argsort(ranked, axis=1)
    needed = np.take_along_axis(rank_of, home[graph[asked][:, :k]], axis=1).ravel()
    recall = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return router, int(np.searchsorted(recall, target) + 1)


# The table ------------------------------------------------------------------------


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: id given, all components finite, not all zero, of the commonest length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & good)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n")
    top = lengths.first()
    return rows.filter(F.size("v") == F.lit(top.n if top else 0))


def nearest_in_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``x`` for each row of ``q``, its own id left out; ties to the smaller id."""
    out, xx = [], (x * x).sum(axis=1)
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        qq = (part * part).sum(axis=1)
        rough = qq[:, None] + xx[None, :] - 2 * part @ x.T
        slack = 1e-9 * (qq + xx.max())
        for j in range(len(part)):
            row = np.where(x_ids == q_ids[i + j], np.inf, rough[j])
            m = min(k, len(row))
            bar = np.partition(row, m - 1)[m - 1]
            near = np.flatnonzero((row <= bar + slack[j]) & np.isfinite(row))
            score = np.sqrt(((part[j] - x[near]) ** 2).sum(axis=1))
            best = np.lexsort((x_ids[near], score))[:k]
            out.append(pd.DataFrame({"query_id": q_ids[i + j], "vec_id": x_ids[near][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(
    df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", target: float = TARGET,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query row, by Euclidean distance.

    ``is_query``: condition on the key. Rows with the query's own key are never
    candidates. Of rows that share a key, the first in the order of vectors is
    the query; as a candidate a key counts once, at its nearest row. Queries that
    found fewer than ``k`` are searched in all parts, so they get all candidates
    there are.
    """
    spark = df.sparkSession
    rows, _ = pinned(usable(df.select(key, vector), key, vector), "vectors")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "v").limit(SAMPLE).collect()
    parts = 1
    while parts * 2 <= len(sample) // 64 and total / (parts * 2) >= PART_ROWS / 2:
        parts *= 2
    if parts > 1:
        router, probes = learn_router(np.array([r.v for r in sample]), parts, min(k, GRAPH_NEIGHBOURS), target)
    else:
        router, probes = None, 1
    sent = spark.sparkContext.broadcast(pickle.dumps(router))

    # Of equal vectors the k + 1 smallest ids are all that any query can ask for.
    equal = Window.partitionBy("v").orderBy("id")
    once = rows.distinct().withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= k + 1).drop("_n")
    homes, _ = pinned(_routed(once, sent, 1).withColumn("part", F.element_at("parts", 1)).drop("parts"), "homes")
    counts = {r.part: r.n for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    own = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    asked = rows.filter(is_query).distinct().withColumn("_n", own).filter("_n = 1").drop("_n")
    queries, _ = pinned(_routed(asked, sent, probes), "queries")
    n_queries = queries.count()
    found, _ = pinned(_visit(homes, queries, counts, n_queries, k), "found")
    short = queries.select("id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), F.col("id") == F.col("query_id"), "left")
    short = short.filter(F.coalesce("n", F.lit(0)) < k).select("id")
    if probes < parts and short.limit(1).count():
        every = F.array(*[F.lit(p) for p in sorted(counts)])
        again = queries.join(short, "id").withColumn("parts", every)
        more = _visit(homes, again, counts, n_queries, k)
        found = found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(more)
    nearest = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return nearest.select("query_id", "rank", "vec_id", "score")


def _routed(rows: DataFrame, sent, probes: int) -> DataFrame:
    """``rows`` with ``parts``, the most probable first."""

    def run(frames):
        router = pickle.loads(sent.value)
        for pdf in frames:
            if router is None or not len(pdf):
                yield pdf.assign(parts=[[0]] * len(pdf))
                continue
            p = router.forward(np.array(pdf["v"].tolist(), dtype=np.float64))[1]
            yield pdf.assign(parts=np.argsort(-p, axis=1, kind="stable")[:, :probes].tolist())

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").mapInPandas(run, f"id {kind}, v array<double>, parts array<int>")


def _visit(homes: DataFrame, queries: DataFrame, counts: dict, n_queries: int, k: int) -> DataFrame:
    """Each query against the blocks of its parts; its ``k`` nearest of all of them."""
    blocks = {p: max(1, -(-n // BLOCK_ROWS)) for p, n in counts.items()}
    query_blocks = max(1, -(-n_queries // QUERY_ROWS))
    per_part = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    block = F.pmod(F.xxhash64("id", "v"), per_part[F.col("part")])
    index = homes.withColumn("block", block).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    ask = queries.withColumn("part", F.explode("parts")).drop("parts")
    ask = ask.filter(F.col("part").isin(list(blocks)) if blocks else F.lit(False))
    ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), (per_part[F.col("part")] - 1).cast("int"))))
    ask = ask.withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    index = index.withColumn("block", F.col("block").cast("int"))
    kind = homes.schema["id"].dataType.simpleString()

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return nearest_in_block(
            np.array(q["v"].tolist()), q["id"].to_numpy(), np.array(x["v"].tolist()), x["id"].to_numpy(), k
        )

    keys = ("part", "block", "q_block")
    near = index.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
