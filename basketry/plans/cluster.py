"""K-Means segmentation: features, fits, quality, choice of k and profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators.cells import TILE, Tile, build_cells, tiles
from basketry.operators.ranking import exact_quantiles
from basketry.operators.silhouette import silhouettes
from basketry.plans.rfm import SEGMENT_NAMES
from basketry.schema import require_columns
from basketry.session import pin

# Fixed values.
FEATURES = ["recency_days", "frequency_orders", "monetary_value_gbp"]
K_VALUES = tuple(range(2, 11))
SEEDS = (42, 7, 21, 84, 123)
N_INIT = 20
MAX_ITER = 500
MIN_SHARE_PCT = 2.0
MIN_MEAN_ARI = 0.80
OPERATIONAL_K = 4
LABELS = {
    1: "High-Value Champions",
    2: "Recent Growth Customers",
    3: "Lapsed Established Customers",
    4: "Dormant Low-Value Customers",
}
ACTIONS_BY_RECENCY = {
    1: "Protect current value with recognition, priority service, and relevant loyalty offers.",
    2: "Nurture the next purchase with timely cross-sell and replenishment prompts.",
    3: "Prioritise profile-based reactivation using known categories before broad discounting.",
    4: "Use low-cost re-engagement tests and suppress outreach if inactivity persists.",
}

SCALED = [f"z_{f}" for f in FEATURES]
TOLERANCE = 1e-4
# Candidates for first centres: rounds of drawing, rows a round (for many clusters twice their number), and groups of rows they settle on.
ROUNDS, DRAWN, NODES = 5, 24, 16384


def input_contract(rfm: DataFrame) -> DataFrame:
    """(rule, failures) of the clustering input."""
    needed = [
        "customer_id", "primary_country", "average_order_value_gbp", "active_span_days",
        "units_purchased", "distinct_products", "segment", *FEATURES,
    ]
    require_columns(rfm, needed, "Clustering input")
    counted = rfm.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in needed],
        *[F.count_if(F.col(f) < 0).alias(f"{f}_negative") for f in FEATURES],
    )
    surplus = rfm.groupBy("customer_id").agg((F.count(F.lit(1)) - 1).alias("s"))
    copies = surplus.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("failures")).select(
        F.lit("customer_id_unique").alias("rule"), "failures"
    )
    return counted.unpivot([], counted.columns, "rule", "failures").unionByName(copies)


def check_input(rfm: DataFrame) -> None:
    broken = input_contract(rfm).where("failures > 0").collect()
    if broken:
        raise ValueError(f"Clustering input breaks its contract: {broken}")


def scaled_features(rfm: DataFrame) -> DataFrame:
    """log1p, then z-scores with the population standard deviation."""
    logged = rfm.select("*", *[F.log1p(F.col(f).cast("double")).alias(f"_l_{f}") for f in FEATURES])
    moments = logged.agg(
        F.struct(
            *[F.avg(f"_l_{f}").alias(f"m_{f}") for f in FEATURES],
            *[F.stddev_pop(f"_l_{f}").alias(f"s_{f}") for f in FEATURES],
        ).alias("s")
    ).scalar()
    return logged.withColumns(
        {
            f"z_{f}": (F.col(f"_l_{f}") - moments[f"m_{f}"])
            / F.when(moments[f"s_{f}"] == 0, 1.0).otherwise(moments[f"s_{f}"])
            for f in FEATURES
        }
    ).drop(*[f"_l_{f}" for f in FEATURES])


def vectors(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("features", array_to_vector(F.array(*SCALED)))


def training_table(rfm: DataFrame, partitions: int | None = None) -> DataFrame:
    """Pinned rows with their scaled features, in ``partitions`` parts if the caller says so."""
    data = vectors(scaled_features(rfm))
    return pin(data if partitions is None else data.repartition(partitions, "customer_id"))


@dataclass(frozen=True)
class Fit:
    centres: np.ndarray
    inertia: float
    iterations: int


def _uniform(x: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) from the coordinates of each row, so that draws do not depend on the layout."""
    mixed = np.zeros(len(x), dtype=np.uint64)
    for value in (*salt, *np.ascontiguousarray(x.T + 0.0).view(np.uint64)):
        mixed = mixed ^ np.asarray(value, dtype=np.uint64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(33)
    return (mixed >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _squares_to(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.maximum(d, 0)


def _drawn(cells: DataFrame, held: dict[int, np.ndarray], round_: int, most: int) -> dict[int, np.ndarray]:
    """For each seed ``most`` further rows, drawn by squared distance to those held already, in one scan of all rows.

    The rows of smallest -log(u) / mass are a sample by mass without
    replacement, and taking the smallest ones can be done piece by piece.
    """
    width = len(SCALED)
    sent = cells.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        kept = {seed: np.zeros((0, width + 1)) for seed in sent.value}
        for t in tiles(batches, width):
            for seed, points in sent.value.items():
                mass = t.w * (_squares_to(t.x, points).min(axis=1) if len(points) else 1.0)
                far = np.flatnonzero(mass > 1e-24)
                key = -np.log(_uniform(t.x[far], seed + 1, round_ + 1)) / mass[far]
                both = np.concatenate([kept[seed], np.column_stack([key, t.x[far]])])
                kept[seed] = both[np.lexsort(both.T[::-1])[:most]]
        for seed, rows in kept.items():
            columns = [pa.array(np.full(len(rows), seed)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "key", *SCALED])

    fields = "seed long, key double, " + ", ".join(f"{c} double" for c in SCALED)
    first = Window.partitionBy("seed").orderBy("key", *SCALED)
    found = cells.mapInArrow(run, fields).withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    out = {seed: [] for seed in held}
    # Bounded: ``most`` rows a seed.
    for r in found.orderBy("seed", "place").collect():
        out[r["seed"]].append([r[c] for c in SCALED])
    sent.unpersist()
    return {seed: np.array(rows).reshape(-1, width) for seed, rows in out.items()}


def _weights(cells: DataFrame, held: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rows nearest to each candidate of each seed, in one scan."""
    width = len(SCALED)
    sent = cells.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        counts = {seed: np.zeros(len(points)) for seed, points in sent.value.items()}
        for t in tiles(batches, width):
            for seed, points in sent.value.items():
                counts[seed] += np.bincount(_squares_to(t.x, points).argmin(axis=1), t.w, len(points))
        for seed, n in counts.items():
            yield pa.RecordBatch.from_pydict({"seed": np.full(len(n), seed), "place": np.arange(len(n)), "n": n})

    found = cells.mapInArrow(run, "seed long, place long, n double").groupBy("seed", "place").agg(F.sum("n").alias("n"))
    out = {seed: np.zeros(len(points)) for seed, points in held.items()}
    for r in found.collect():
        out[r["seed"]][r["place"]] = r["n"]
    sent.unpersist()
    return out


def _coarse(cells: DataFrame, most: int) -> np.ndarray:
    """Groups of neighbouring rows: count, coordinate sums, sum of squares; ``most`` of them, and one more a sorted partition."""
    width = len(SCALED)
    rows = cells.agg(F.sum(F.size("w"))).first()[0] or 0
    group = max(1, -(-rows // most))

    def run(batches):
        for t in tiles(batches, width):
            node = (t.at * TILE + np.arange(len(t.x))) // group
            first = np.flatnonzero(np.diff(node, prepend=-1))
            weighted = [t.w, *(t.x * t.w[:, None]).T, (t.x * t.x).sum(axis=1) * t.w]
            columns = [pa.array(np.add.reduceat(c, first)) for c in weighted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), t.part)), pa.array(node[first]), *columns], names=["part", "node", "n", *SCALED, "q"]
            )

    fields = "part long, node long, n double, " + ", ".join(f"{c} double" for c in (*SCALED, "q"))
    sums = cells.mapInArrow(run, fields).groupBy("part", "node").agg(*[F.sum(c).alias(c) for c in ("n", *SCALED, "q")])
    # Bounded: ``most`` rows and one for each sorted partition.
    found = sums.orderBy("part", "node").select("n", *SCALED, "q").collect()
    return np.array([tuple(r) for r in found]).reshape(-1, width + 2)


def _spread_out(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted points, drawn by weight and squared distance to those before; of a few draws the one that helps most."""
    picked, near = [], None
    tries = 2 + int(np.log(k))
    for _ in range(k):
        mass = weights if near is None else weights * near
        share = mass / mass.sum() if mass.sum() > 0 else None
        drawn = rng.choice(len(points), size=1 if near is None else tries, p=share)
        d = _squares_to(points[drawn], points)
        left = d if near is None else np.minimum(near, d)
        best = int(np.argmin(left @ weights))
        near = left[best]
        picked.append(points[drawn[best]])
    return np.array(picked)


def _settle(nodes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lloyd steps over groups of rows, each taken at its mean, until no group changes its centre."""
    n, sums = nodes[:, 0].copy(), np.ascontiguousarray(nodes[:, 1:-1].T)
    means, before = sums / n, None
    for _ in range(MAX_ITER):
        # Centre by centre: a few long rows are quicker than many short ones.
        d = (centres * centres).sum(axis=1)[:, None] - 2 * (centres @ means)
        own, least = np.zeros(len(n), dtype=np.int64), d[0].copy()
        for c in range(1, len(centres)):
            own[d[c] < least] = c
            np.minimum(least, d[c], out=least)
        if before is not None and (own == before).all():
            break
        before = own
        count = np.bincount(own, n, len(centres))
        total = np.stack([np.bincount(own, s, len(centres)) for s in sums], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def starts(cells: DataFrame, jobs: list[tuple[int, int]], n_init: int) -> tuple[list[np.ndarray], float]:
    """First centres of every model, and the mean variance of the features.

    Candidates come from all rows, by a few joint rounds of drawing far rows for
    every seed, and are weighed by the rows they stand for. Each model draws its
    centres from the weighted candidates of its seed and settles them on groups
    of neighbouring rows; models are spread over the tasks.
    """
    spark, seeds = cells.sparkSession, sorted({seed for _, seed in jobs})
    held = {seed: np.zeros((0, len(SCALED))) for seed in seeds}
    most = max(DRAWN, *(2 * k for k, _ in jobs))
    for i in range(ROUNDS + 1):
        new = _drawn(cells, held, i, most if i else 1)
        held = {seed: np.concatenate([held[seed], new[seed]]) for seed in seeds}
    weights, nodes = _weights(cells, held), _coarse(cells, NODES)
    total = nodes[:, 0].sum()
    variance = float(np.mean(nodes[:, -1].sum() / total - ((nodes[:, 1:-1].sum(axis=0) / total) ** 2).sum())) / len(SCALED)
    tasks = [(k, seed, i) for k, seed in jobs for i in range(n_init)]
    sent = spark.sparkContext.broadcast((held, weights, nodes, tasks))

    def run(batches):
        held, weights, nodes, tasks = sent.value
        for batch in batches:
            found = []
            for number in batch.column("id").to_pylist():
                k, seed, i = tasks[number]
                first = _spread_out(held[seed], weights[seed], k, np.random.default_rng([seed, k, i]))
                found.append((number, _settle(nodes, first).ravel().tolist()))
            yield pa.RecordBatch.from_pydict({"id": [f[0] for f in found], "centres": [f[1] for f in found]})

    parts = min(len(tasks), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(tasks), 1, parts).mapInArrow(run, "id long, centres array<double>").collect()
    sent.unpersist()
    return [np.array(r["centres"]).reshape(-1, len(SCALED)) for r in sorted(rows, key=lambda r: r["id"])], variance


def _leaf_sums(t: Tile, centres: np.ndarray):
    """For models of equal k: counts, coordinate sums and cost of every centre, leaf by leaf where one centre owns the leaf."""
    m, k, width = centres.shape
    low, high = t.low, t.high
    middle = (low + high) / 2
    flat = centres.reshape(m * k, width)
    own = _squares_to(middle, flat).reshape(len(middle), m, k).argmin(axis=2)
    best = np.take_along_axis(np.broadcast_to(centres, (len(middle), m, k, width)), own[:, :, None, None], 2)
    # A centre z owns no row of the box if its corner farthest towards z lies nearer to the best centre.
    gap = np.zeros((len(middle), m, k))
    for a in range(width):
        z, c = centres[None, :, :, a], best[:, :, :, a]
        u = z - c
        corner = np.where(u > 0, high[:, a, None, None], low[:, a, None, None])
        gap += u * (z + c - 2 * corner)
    np.put_along_axis(gap, own[:, :, None], np.inf, 2)
    settled = (gap > 1e-12).all(axis=2)

    place = own + np.arange(m) * k
    n, sums, cost = np.zeros(m * k), np.zeros((width, m * k)), np.zeros(m)
    leaf, model = np.nonzero(settled)
    at = place[leaf, model]
    n += np.bincount(at, t.n[leaf], m * k)
    for a in range(width):
        sums[a] += np.bincount(at, t.sums[leaf, a], m * k)
    owner = flat[at]
    within = t.squares[leaf] - 2 * (owner * t.sums[leaf]).sum(axis=1) + t.n[leaf] * (owner * owner).sum(axis=1)
    cost += np.bincount(model, np.maximum(within, 0), m)

    x, w = t.padded
    leaf, model = np.nonzero(~settled)
    for i in range(0, len(leaf), 512):
        rows, near = x[leaf[i : i + 512]], centres[model[i : i + 512]]
        weight = w[leaf[i : i + 512]]
        d = (rows * rows).sum(axis=2)[:, :, None] + (near * near).sum(axis=2)[:, None, :] - 2 * rows @ near.transpose(0, 2, 1)
        mine = d.argmin(axis=2)
        cost += np.bincount(model[i : i + 512], (np.maximum(np.take_along_axis(d, mine[:, :, None], 2)[:, :, 0], 0) * weight).sum(axis=1), m)
        at = (mine + (model[i : i + 512] * k)[:, None]).ravel()
        n += np.bincount(at, weight.ravel(), m * k)
        for a in range(width):
            sums[a] += np.bincount(at, (rows[:, :, a] * weight).ravel(), m * k)
    return n, sums, cost


def _step(cells: DataFrame, models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every centre of every model: rows and coordinate sums; of every model: cost.

    One scan for all models. A leaf that lies on one side of all borders of a
    model counts as a whole; rows are looked at only where a border crosses
    their leaf, so the sums are those of all rows. A task returns one row per
    centre that has rows.
    """
    spark, width = cells.sparkSession, len(SCALED)
    by_k: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        by_k.setdefault(len(m), []).append(i)
    first = np.cumsum([0, *map(len, models)])
    blocks = [(np.array(ids), np.stack([models[i] for i in ids]), first[ids]) for ids in by_k.values()]
    sent = spark.sparkContext.broadcast(blocks)
    size, count = int(first[-1]), len(models)

    def run(batches):
        n, sums, cost = np.zeros(size), np.zeros((width, size)), np.zeros(count)
        for t in tiles(batches, width):
            for ids, centres, offsets in sent.value:
                k = centres.shape[1]
                some, parts, costs = _leaf_sums(t, centres)
                to = (offsets[:, None] + np.arange(k)).ravel()
                n[to] += some
                sums[:, to] += parts
                cost[ids] += costs
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[used, size + np.arange(count)]), pa.array(np.r_[n[used], cost])]
            + [pa.array(np.r_[sums[a][used], np.zeros(count)]) for a in range(width)],
            names=["place", "n", *[f"s{a}" for a in range(width)]],
        )

    columns = ["n", *[f"s{a}" for a in range(width)]]
    parts = cells.mapInArrow(run, "place long, " + ", ".join(f"{c} double" for c in columns))
    out = np.zeros((size + count, width + 1))
    # Bounded: one row per centre and per model.
    for r in parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        out[r["place"]] = [r[c] for c in columns]
    sent.unpersist()
    return out[:size], out[size:, 0]


def fit_all(data: DataFrame, jobs: list[tuple[int, int]], n_init: int = N_INIT) -> dict[tuple[int, int], Fit]:
    """For each (k, seed) the cheapest of ``n_init`` starts.

    All models move together: an iteration is one scan of the cells, whatever the
    number of models, and models that have settled leave the scan.
    """
    cells = build_cells(data, SCALED)
    models, spread = starts(cells, jobs, n_init)
    moving, iterations = list(range(len(models))), [0] * len(models)
    cost = np.zeros(len(models))
    for _ in range(MAX_ITER):
        sums, costs = _step(cells, [models[i] for i in moving])
        at, still = 0, []
        for i, c in zip(moving, costs):
            k = len(models[i])
            n, total = sums[at : at + k, 0], sums[at : at + k, 1:]
            at += k
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], models[i])
            shift = float(((new - models[i]) ** 2).sum())
            models[i], cost[i], iterations[i] = new, c, iterations[i] + 1
            if shift > TOLERANCE * spread:
                still.append(i)
        moving = still
        if not moving:
            break
    _, cost = _step(cells, models)
    out = {}
    for j, job in enumerate(jobs):
        best = min(range(j * n_init, (j + 1) * n_init), key=lambda i: cost[i])
        out[job] = Fit(models[best], float(cost[best]), iterations[best])
    return out


def fit(data: DataFrame, k: int, seed: int, n_init: int = N_INIT) -> Fit:
    return fit_all(data, [(k, seed)], n_init)[k, seed]


def business_order(model: Fit) -> dict[int, int]:
    """Raw label -> 1..k by falling -R + F + M of the centre."""
    value = [-c[0] + c[1] + c[2] for c in model.centres]
    ranked = sorted(range(len(value)), key=lambda i: (-value[i], i))
    return {raw: place + 1 for place, raw in enumerate(ranked)}


def nearest(model: Fit):
    """Number of the nearest centre, the first on ties, as an expression over the scaled features."""
    def distance(centre):
        return reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(SCALED, centre)])

    return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(model.centres)]))["i"]


def assign(data: DataFrame, model: Fit) -> DataFrame:
    """``cluster_id`` 1..k in business order."""
    places = business_order(model)
    order = F.array(*[F.lit(places[i]) for i in range(len(places))])
    return data.withColumn("cluster_id", F.element_at(order, nearest(model) + 1))


# Quality of a labelling -----------------------------------------------------


def _centres(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row per label: size and centre. Bounded by the number of clusters."""
    return df.groupBy(F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in columns]
    )


def _squared(columns: list[str], other: str):
    return reduce(
        lambda a, b: a + b,
        [(F.col(c) - F.col(f"{other}{c}")) * (F.col(c) - F.col(f"{other}{c}")) for c in columns],
    )


def _to_centre(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    # No hint: by the size of the centres Spark decides.
    centres = _centres(df, label, columns)
    return df.join(centres, F.col(label) == F.col("_label")).withColumn(
        "_d2", _squared(columns, "_c_")
    )


def calinski_harabasz(df: DataFrame, label: str, columns: list[str] = SCALED) -> DataFrame:
    """Between over within dispersion, and the inertia, in one row."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    per_cluster = (
        _to_centre(df, label, columns)
        .groupBy("_label", "_n", *[f"_c_{c}" for c in columns])
        .agg(F.sum("_d2").alias("_within"))
    )
    off_centre = reduce(
        lambda a, b: a + b,
        [(F.col(f"_c_{c}") - means[c]) * (F.col(f"_c_{c}") - means[c]) for c in columns],
    )
    sums = per_cluster.agg(
        F.sum(off_centre * F.col("_n")).alias("b"),
        F.sum("_within").alias("w"),
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.min("_n").alias("smallest"),
    )
    n, k = F.col("n"), F.col("k")
    return sums.select(
        k.cast("int").alias("k"),
        F.col("w").alias("inertia"),
        F.try_divide(F.col("b") * (n - k), F.col("w") * (k - 1)).alias("calinski_harabasz_score"),
        F.col("smallest").alias("minimum_cluster_count"),
        (100.0 * F.col("smallest") / n).alias("minimum_cluster_share_pct"),
    )


def davies_bouldin(df: DataFrame, label: str, columns: list[str] = SCALED) -> DataFrame:
    """Mean over clusters of the worst spread-to-distance ratio."""
    clusters = (
        _to_centre(df, label, columns)
        .groupBy("_label", *[f"_c_{c}" for c in columns])
        .agg(F.avg(F.sqrt("_d2")).alias("s"))
    )
    # Bounded: one array element per cluster.
    packed = clusters.agg(
        F.collect_list(
            F.struct(
                F.col("_label").alias("l"), "s", F.array(*[f"_c_{c}" for c in columns]).alias("c")
            )
        ).alias("k")
    )

    def distance(a, b):
        return F.sqrt(
            F.aggregate(
                F.zip_with(a["c"], b["c"], lambda x, y: (x - y) * (x - y)),
                F.lit(0.0),
                lambda total, x: total + x,
            )
        )

    worst = F.transform(
        "k",
        lambda a: F.array_max(
            F.transform(
                F.filter("k", lambda b: b["l"] != a["l"]),
                lambda b: F.try_divide(a["s"] + b["s"], distance(a, b)),
            )
        ),
    )
    total = F.aggregate(worst, F.lit(0.0), lambda t, x: t + x)
    return packed.select((total / F.size("k")).alias("davies_bouldin_score"))


def silhouette_squared(data: DataFrame, label: str) -> float:
    """Silhouette on squared distances: linear cost, for any number of rows."""
    return ClusteringEvaluator(
        featuresCol="features", predictionCol=label, distanceMeasure="squaredEuclidean"
    ).evaluate(data.withColumn(label, F.col(label).cast("double")))


def silhouette_euclidean(df: DataFrame, label: str, columns: list[str] = SCALED) -> DataFrame:
    """Mean Euclidean silhouette over all rows, with the bound of what the tree leaves out, in one row."""
    return silhouettes(df, [label], columns).drop("labelling")


def adjusted_rand(df: DataFrame, labels: list[str]) -> DataFrame:
    """(left, right, adjusted_rand) for every pair of label columns, in one pass."""
    cells = df.groupBy(*labels).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("left"), F.lit(b).alias("right"),
                    F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y"),
                )
                for a, b in combinations(labels, 2)
            ]
        )
    )
    table = (
        cells.select("_n", pairs.alias("p"))
        .groupBy("p.left", "p.right", "p.x", "p.y")
        .agg(F.sum("_n").alias("n"))
    )

    def choose_two(c):
        return F.sum(c * (c - 1) / 2)

    n = F.col("n")
    by = ["left", "right"]
    joint = table.groupBy(*by).agg(choose_two(n).alias("ij"), F.sum("n").alias("total"))
    rows = table.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(choose_two(n).alias("a"))
    cols = table.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(choose_two(n).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2)
    ceiling = (F.col("a") + F.col("b")) / 2
    index = F.try_divide(F.col("ij") - expected, ceiling - expected)
    # Two identical trivial partitions agree by definition.
    return joint.join(rows, by).join(cols, by).select(*by, F.coalesce(index, F.lit(1.0)).alias("adjusted_rand"))


def label_quality(data: DataFrame, label: str, silhouette: float | None = None) -> dict:
    """Inertia, silhouette, Calinski-Harabasz, Davies-Bouldin and smallest cluster.

    A silhouette that is known already may be handed in; else it is the linear one on squared distances.
    """
    found = calinski_harabasz(data, label).first().asDict()
    found["davies_bouldin_score"] = davies_bouldin(data, label).first()[0]
    found["silhouette_score"] = silhouette_squared(data, label) if silhouette is None else silhouette
    return found


EVALUATION_SCHEMA = (
    "k int, inertia double, inertia_reduction_from_previous_k_pct double, silhouette_score double, "
    "calinski_harabasz_score double, davies_bouldin_score double, minimum_cluster_count long, "
    "minimum_cluster_share_pct double, mean_pairwise_ari double, minimum_pairwise_ari double, "
    "stability_seed_count int, stability_pair_count int, silhouette_distance string, seed int"
)


def _with_labels(data: DataFrame, models: dict[tuple[int, int], Fit]) -> DataFrame:
    """Scaled features, their vector, and the nearest centre in each model as ``label_<k>_<seed>``; pinned."""
    centres = {f"label_{k}_{seed}": fit.centres for (k, seed), fit in models.items()}
    sent = data.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SCALED], axis=1)
            labels = [pa.array(((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1), pa.int32()) for c in sent.value.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *labels], names=[*batch.schema.names, *sent.value])

    fields = ", ".join([*[f"{c} double" for c in SCALED], *[f"{name} int" for name in centres]])
    return vectors(pin(data.select(*SCALED).mapInArrow(run, fields), wide=True))


def judge(
    data: DataFrame, models: dict[tuple[int, int], Fit], k_values=K_VALUES, seeds=SEEDS, squared: bool = False, workers: int = 8
) -> DataFrame:
    """One row per k: quality of the first seed's model, agreement of all seeds' labels."""
    labelled = _with_labels(data, models)
    first = {k: f"label_{k}_{seeds[0]}" for k in k_values}
    scores = {}
    if not squared:
        scores = {r["labelling"]: r["silhouette_score"] for r in silhouettes(labelled, list(first.values()), SCALED).collect()}

    def one(k: int):
        names = [f"label_{k}_{s}" for s in seeds]
        agreement = adjusted_rand(labelled, names).agg(
            F.avg("adjusted_rand"), F.min("adjusted_rand"), F.count(F.lit(1))
        ).first()
        return label_quality(labelled, first[k], scores.get(first[k])), agreement

    with ThreadPoolExecutor(workers) as pool:
        judged = list(pool.map(one, k_values))
    result, previous = [], None
    for k, (q, agreement) in zip(k_values, judged):
        drop = None if previous is None else 100 * (previous - q["inertia"]) / previous
        previous = q["inertia"]
        result.append(
            (
                k, q["inertia"], drop, q["silhouette_score"], q["calinski_harabasz_score"],
                q["davies_bouldin_score"], q["minimum_cluster_count"],
                q["minimum_cluster_share_pct"], agreement[0], agreement[1], len(seeds), agreement[2],
                "squared_euclidean" if squared else "euclidean", seeds[0],
            )
        )
    return data.sparkSession.createDataFrame(result, EVALUATION_SCHEMA)


@dataclass(frozen=True)
class Evaluation:
    """The rows that were fitted, one row per k, and the models behind these rows."""

    data: DataFrame
    frame: DataFrame
    models: dict[tuple[int, int], Fit]
    seeds: tuple[int, ...]


def evaluate(data: DataFrame, k_values=K_VALUES, seeds=SEEDS, n_init: int = N_INIT, squared: bool = False) -> Evaluation:
    """Fit and judge every k over a ``training_table``. All fits share their scans.

    The silhouette is the Euclidean one, or the linear one on squared distances;
    the column silhouette_distance tells which.
    """
    if len(seeds) < 5:
        raise ValueError("Label stability needs at least five seeds.")
    rows = data.count()
    for k in k_values:
        if k < 2 or k >= rows:
            raise ValueError(f"k={k} does not fit {rows} rows.")
    models = fit_all(data, [(k, s) for k in k_values for s in seeds], n_init)
    return Evaluation(data, judge(data, models, k_values, seeds, squared), models, tuple(seeds))


def evaluate_k(data: DataFrame, k_values=K_VALUES, seeds=SEEDS, n_init: int = N_INIT, squared: bool = False) -> DataFrame:
    return evaluate(data, k_values, seeds, n_init, squared).frame


# Metric behind each rank, and whether less is better.
_RANKINGS = {
    "rank_silhouette": ("silhouette_score", False),
    "rank_calinski_harabasz": ("calinski_harabasz_score", False),
    "rank_davies_bouldin": ("davies_bouldin_score", True),
    "rank_stability": ("mean_pairwise_ari", False),
}


def select_k(
    evaluation: DataFrame, min_share_pct: float = MIN_SHARE_PCT, min_mean_ari: float = MIN_MEAN_ARI
) -> DataFrame:
    """Eligibility, metric ranks and the best k by rank sum.

    Windows here run over one row per candidate k.
    """
    require_columns(
        evaluation,
        ["k", "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score",
         "minimum_cluster_share_pct", "mean_pairwise_ari"],
        "K evaluation",
    )
    eligible = (F.col("minimum_cluster_share_pct") >= min_share_pct) & (
        F.col("mean_pairwise_ari") >= min_mean_ari
    )
    marked = evaluation.withColumn("eligible", F.coalesce(eligible, F.lit(False)))

    def place(metric: str, less_is_better: bool):
        order = F.asc(metric) if less_is_better else F.desc(metric)
        return F.when(
            F.col("eligible"), F.rank().over(Window.partitionBy("eligible").orderBy(order))
        )

    ranked = marked.withColumns(
        {name: place(*rule) for name, rule in _RANKINGS.items()}
    ).withColumn("selection_rank_sum", reduce(lambda a, b: a + b, [F.col(r) for r in _RANKINGS]))
    best = Window.partitionBy("eligible").orderBy(
        "selection_rank_sum", F.desc("silhouette_score"), "davies_bouldin_score", "k"
    )
    return ranked.withColumn("metric_optimal", F.col("eligible") & (F.row_number().over(best) == 1))


def metric_optimal_k(ranked: DataFrame) -> int:
    best = ranked.where("metric_optimal").select("k").first()
    if best is None:
        raise RuntimeError("No candidate k passes the cluster-share and stability gates.")
    return best[0]


def choose_k(ranked: DataFrame, k: int = OPERATIONAL_K) -> DataFrame:
    """Mark a stated k, which must have been evaluated and be eligible."""
    row = ranked.where(F.col("k") == k).select("eligible").first()
    if row is None:
        raise ValueError(f"k={k} was not evaluated.")
    if not row[0]:
        raise RuntimeError(f"k={k} fails the cluster-share or stability gate.")
    return ranked.withColumns(
        {"operational_chosen": F.col("k") == k, "selected": F.col("k") == k}
    )


# Profiles -------------------------------------------------------------------

_MEDIANS = {
    "median_recency_days": "recency_days",
    "median_frequency_orders": "frequency_orders",
    "median_monetary_value_gbp": "monetary_value_gbp",
    "median_active_span_days": "active_span_days",
    "median_distinct_products": "distinct_products",
}


def dominant_segment(clusters: DataFrame) -> DataFrame:
    """Most frequent segment per cluster, first by name on ties, with its share."""
    counts = clusters.groupBy("cluster_id", "segment").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy("cluster_id").orderBy(F.desc("_n"), "segment")
    # Bounded: a cluster has at most one row per segment here.
    return (
        counts.withColumns(
            {
                "_place": F.row_number().over(first),
                "_size": F.sum("_n").over(Window.partitionBy("cluster_id")),
            }
        )
        .where("_place = 1")
        .select(
            "cluster_id",
            F.col("segment").alias("dominant_rfm_segment"),
            C.ratio("_n", "_size", 100).alias("dominant_rfm_segment_share_pct"),
        )
    )


def cluster_profiles(clusters: DataFrame, home: str) -> DataFrame:
    """One row per cluster in original units."""
    value = F.col("monetary_value_gbp").cast("decimal(28,4)")
    stats = clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(value).alias("_value"),
        F.sum("recency_days").alias("_recency"),
        F.sum("frequency_orders").alias("_orders"),
        F.avg("average_order_value_gbp").alias("average_order_value_gbp"),
        F.sum("units_purchased").alias("total_units_purchased"),
        F.count_if(F.col("frequency_orders") >= 2).alias("_repeat"),
        F.count_if(F.col("primary_country") == home).alias("_home"),
    )
    medians = exact_quantiles(
        clusters, ["cluster_id"], {o: (c, 0.5) for o, c in _MEDIANS.items()}
    )
    totals = clusters.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).alias("s")
    ).scalar()
    n = F.col("customer_count")
    return (
        stats.join(medians, "cluster_id")
        .join(dominant_segment(clusters), "cluster_id")
        .select(
            "cluster_id",
            "customer_count",
            C.ratio(n, totals["n"], 100).alias("customer_share_pct"),
            C.money("_value").alias("total_monetary_value_gbp"),
            C.ratio("_value", totals["v"], 100).alias("revenue_share_pct"),
            "median_recency_days",
            C.ratio("_recency", n).alias("average_recency_days"),
            "median_frequency_orders",
            C.ratio("_orders", n).alias("average_frequency_orders"),
            "median_monetary_value_gbp",
            C.ratio("_value", n).alias("average_monetary_value_gbp"),
            "average_order_value_gbp",
            "median_active_span_days",
            "total_units_purchased",
            "median_distinct_products",
            C.ratio("_repeat", n, 100).alias("repeat_customer_rate_pct"),
            C.ratio("_home", n, 100).alias("home_customer_share_pct"),
            "dominant_rfm_segment",
            "dominant_rfm_segment_share_pct",
        )
    )


def cluster_labels(profiles: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """Name, basis text and action per cluster; windows over one row per cluster."""
    labels = LABELS if labels is None else labels

    def place(order):
        return F.row_number().over(Window.orderBy(order, "cluster_id"))

    ranked = profiles.withColumns(
        {
            "recency_rank": place(F.asc("median_recency_days")),
            "frequency_rank": place(F.desc("median_frequency_orders")),
            "monetary_rank": place(F.desc("median_monetary_value_gbp")),
        }
    )
    k = len(labels)
    # Fixed value: the text of the basis.
    basis = F.format_string(
        f"Median recency=%.1f days (rank %d/{k}); frequency=%.1f orders (rank %d/{k}); "
        f"monetary value=GBP %,.2f (rank %d/{k}).",
        "median_recency_days", "recency_rank", "median_frequency_orders", "frequency_rank",
        "median_monetary_value_gbp", "monetary_rank",
    )

    def named(values: dict, index):
        pairs = [F.lit(x) for kv in values.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), index)

    return ranked.select(
        "cluster_id",
        named(labels, F.col("cluster_id")).alias("cluster_label"),
        basis.alias("label_basis"),
        named(ACTIONS_BY_RECENCY, F.col("recency_rank")).alias("recommended_action"),
    )


def check_labels(labels: DataFrame, k: int = OPERATIONAL_K) -> None:
    rows, names = labels.agg(F.count(F.lit(1)), F.count_distinct("cluster_label")).first()
    if rows != k:
        raise ValueError(f"Business labels need the {k}-cluster solution, got {rows} clusters.")
    if names != rows:
        raise RuntimeError("Cluster labels must be unique.")


def segment_cluster_crosstab(clusters: DataFrame) -> DataFrame:
    """Every segment x every cluster, with row and column shares."""
    counts = clusters.groupBy("segment", "cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    spine = (
        counts.select("cluster_id")
        .distinct()
        .select("cluster_id", F.explode(F.array(*[F.lit(s) for s in SEGMENT_NAMES])).alias("segment"))
    )
    n = F.col("customer_count")
    by_segment = F.sum("customer_count").over(Window.partitionBy("rfm_segment"))
    by_cluster = F.sum("customer_count").over(Window.partitionBy("cluster_id"))
    return (
        spine.join(counts, ["segment", "cluster_id"], "left")
        .select(
            F.col("segment").alias("rfm_segment"),
            "cluster_id",
            F.coalesce("_n", F.lit(0)).alias("customer_count"),
        )
        .select(
            "rfm_segment",
            "cluster_id",
            "customer_count",
            C.ratio(n, by_segment, 100).alias("share_of_rfm_segment_pct"),
            C.ratio(n, by_cluster, 100).alias("share_of_cluster_pct"),
        )
    )


def pca_projection(data: DataFrame, k: int = 2) -> DataFrame:
    """Customers on the first components, with the variance each explains."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(data)
    share = [float(x) for x in model.explainedVariance]
    placed = model.transform(data).withColumn("_pc", vector_to_array("_pc"))
    return placed.select(
        "customer_id",
        *[F.col("_pc")[i].alias(f"component_{i + 1}") for i in range(k)],
        *[F.lit(100 * share[i]).alias(f"explained_pct_{i + 1}") for i in range(k)],
    )


def clustering_summary(evaluation: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: both choices of k with their metrics, and the cluster sizes.

    Both inputs have one row per k or per cluster.
    """
    metrics = [
        "k", "inertia", "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score",
        "minimum_cluster_count", "minimum_cluster_share_pct", "mean_pairwise_ari",
        "minimum_pairwise_ari", "selection_rank_sum",
    ]
    candidate = F.struct(*metrics)
    size = F.struct("cluster_id", "cluster_label", "customer_count", "customer_share_pct",
                    "revenue_share_pct", "recommended_action")
    sizes = profiles.agg(F.sort_array(F.collect_list(size)).alias("s")).scalar()
    return evaluation.agg(
        F.count(F.lit(1)).alias("evaluated_candidates"),
        F.count_if("eligible").alias("eligible_candidates"),
        F.max(F.when(F.col("metric_optimal"), candidate)).alias("metric_optimal"),
        F.max(F.when(F.col("operational_chosen"), candidate)).alias("operational_chosen"),
    ).withColumn("clusters", sizes)


def build_clusters(
    rfm: DataFrame,
    home: str,
    k: int = OPERATIONAL_K,
    k_values=K_VALUES,
    seeds=SEEDS,
    n_init: int = N_INIT,
    squared: bool = False,
    evaluated: Evaluation | None = None,
) -> dict[str, DataFrame]:
    """Assignments, evaluation, profiles, labels and crosstab of one run.

    The assignment is the model that was evaluated for ``k``. An evaluation of
    the same rows may be handed in; nothing is fitted then.
    """
    if evaluated is None:
        check_input(rfm)
        evaluated = evaluate(training_table(rfm), k_values, seeds, n_init, squared)
    evaluation = select_k(evaluated.frame)
    metric_optimal_k(evaluation)
    evaluation = choose_k(evaluation, k)
    model = evaluated.models[k, evaluated.seeds[0]]
    clusters = pin(assign(evaluated.data, model).drop("features", *SCALED))
    profiles = pin(cluster_profiles(clusters, home))
    labels = pin(cluster_labels(profiles))
    check_labels(labels, k)
    # Bounded: k rows.
    named = clusters.join(F.broadcast(labels.select("cluster_id", "cluster_label")), "cluster_id")
    return {
        "customer_clusters": named,
        "k_evaluation": evaluation,
        "cluster_profiles": profiles.join(labels, "cluster_id"),
        "rfm_cluster_comparison": segment_cluster_crosstab(clusters),
    }
