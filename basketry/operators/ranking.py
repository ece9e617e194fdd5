"""Global ranks, running totals and exact quantiles without a global window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task, and
``partitionBy(value)`` does the same to the rows of a hot value. The operators
below sort with a range exchange instead, pin the sorted rows, and add to each
partition the total of the partitions before it. Sort keys end in a unique
column (or run over distinct values), so a value held by a third of all rows is
spread over many partitions like any other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.schema import require_columns
from basketry.session import pin

_PARTITION_BITS = 33


def _place(df: DataFrame, order_by: list, wide: bool = False) -> DataFrame:
    """Sorted rows with ``_part`` (sorted partition) and ``_row`` (row in it)."""
    # The sample that picks range bounds may differ between two runs of the
    # same plan, so positions are only usable once they are pinned.
    placed = pin(df.orderBy(*order_by).withColumn("_pos", F.monotonically_increasing_id()), wide)
    return placed.select(
        *df.columns,
        F.shiftright("_pos", _PARTITION_BITS).cast("int").alias("_part"),
        F.col("_pos").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)).alias("_row"),
    )


def _before_partition(per_partition: DataFrame, total: str) -> DataFrame:
    """Total of all earlier partitions; one row per sorted partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_partition.select(
        "_part", F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("_before")
    )


def global_row_number(
    df: DataFrame, order_by: list, out: str = "row_number", wide: bool = False
) -> DataFrame:
    """Dense 1..n numbering in the order of ``order_by``, which must be unique."""
    placed = _place(df, order_by, wide)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # Bounded: one row per shuffle partition.
    return placed.join(F.broadcast(_before_partition(sizes, "_size")), "_part").select(
        (F.col("_before") + F.col("_row") + 1).alias(out), *df.columns
    )


def running_total(df: DataFrame, order_by: list, value: str, out: str = "before") -> DataFrame:
    """Sum of ``value`` over all rows sorted before this one."""
    placed = _place(df, order_by)
    local = (
        Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return (
        placed.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(F.broadcast(_before_partition(sums, "_sum")), "_part")
        .select(*df.columns, (F.col("_before") + F.col("_local")).alias(out))
    )


def quantile_bin(rank: Column, n: Column, q: int) -> Column:
    """Bin 1..q of rank i of n by equal-width quantile edges over the ranks.

    Not NTILE: edges lie at 1 + (n-1)j/q and a rank on an edge belongs below.
    """
    steps = (rank - 1) * q
    bins = F.ceil(F.try_divide(steps.cast("decimal(20,0)"), (n - 1).cast("decimal(20,0)")))
    return F.greatest(F.lit(1), F.coalesce(bins, F.lit(1))).cast("int")


def score_bin(rank: Column, n: Column, q: int = 5) -> Column:
    """``quantile_bin``, or the scaled percent rank when fewer than q rows exist."""
    few = F.ceil(F.try_divide((rank * q).cast("decimal(20,0)"), n.cast("decimal(20,0)")))
    return F.when(n >= q, quantile_bin(rank, n, q)).otherwise(
        F.least(F.lit(q), F.greatest(F.lit(1), few)).cast("int")
    )


def decile_bin(rank: Column, n: Column, q: int = 10) -> Column:
    """Quantile bin over min(q, n) bins; a single row is bin 1."""
    bins = F.least(F.lit(q).cast("long"), n)
    exact = F.ceil(
        F.try_divide(((rank - 1) * bins).cast("decimal(20,0)"), (n - 1).cast("decimal(20,0)"))
    )
    return F.greatest(F.lit(1), F.coalesce(exact, F.lit(1))).cast("int")


def ntile_bin(rank: Column, n: Column, q: int) -> Column:
    """NTILE(q) from a unique rank: the first n mod q tiles get one row more."""
    small = F.floor(n / q)
    extra = n - small * q
    head = extra * (small + 1)
    return (
        F.when(rank <= head, F.floor((rank - 1) / (small + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide((rank - head - 1).cast("double"), small)) + 1)
        .cast("int")
    )


def metric_ranks(df: DataFrame, key: str, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Unique rank 1..n of every row under several metrics, in one sort.

    ``metrics`` maps an output column to (column, ascending). Ties go by
    ``key``, which must be unique. Returns key, the ranks, and ``n``.
    """
    columns = {out: f"_m{i}" for i, out in enumerate(metrics)}
    signed = df.select(
        key,
        *[
            (F.col(c).cast("double") * (1.0 if ascending else -1.0)).alias(columns[out])
            for out, (c, ascending) in metrics.items()
        ],
    )
    long = signed.unpivot([key], list(columns.values()), "_metric", "_value")
    # Every metric owns the same number of consecutive positions, so a rank
    # inside its metric is the global position minus whole blocks.
    numbered = global_row_number(long, ["_metric", "_value", key], "_position")
    wide = numbered.groupBy(key).agg(
        *[
            F.max(F.when(F.col("_metric") == m, F.col("_position"))).alias(out)
            for out, m in columns.items()
        ]
    )
    rows = numbered.agg(F.count(F.lit(1)).alias("n"))
    n = F.floor(rows.scalar() / len(metrics)).cast("long")
    return wide.select(
        key,
        *[(F.col(out) - n * i).alias(out) for i, out in enumerate(metrics)],
        n.alias("n"),
    )


def average_ranks(
    df: DataFrame, key: str, features: list[str], prefix: str = "rank_"
) -> DataFrame:
    """Tie-shared ranks of several features: rows before the value + (its rows + 1) / 2.

    One sort of all features. A sorted partition knows the runs of equal values
    inside it; only its first and its last run may go on next door, so their
    lengths are handed over first, two numbers a partition. A value that many
    rows hold fills whole partitions, and its rows pass without being gathered.
    """
    kind = df.schema[key].dataType
    values = F.array(*[F.col(c).cast("double") for c in features])
    long = df.select(F.col(key).alias("_key"), F.posexplode(values).alias("_feature", "_value")).where(
        F.col("_value").isNotNull()
    )
    rows = pin(long.select("_key", "_feature", (F.col("_value") + F.lit(0.0)).alias("_value")).orderBy("_feature", "_value", "_key"))
    edges = rows.select("_feature", "_value").mapInArrow(
        _partition_edges, "part int, feature int, n long, first double, n_first long, last double, n_last long"
    )
    # Bounded: a row for each sorted partition, and one more for each feature.
    starts, borders = _borders(edges.collect())
    sent = df.sparkSession.sparkContext.broadcast((starts, borders))

    def run(batches):
        yield from _ranked(batches, *sent.value)

    schema = T.StructType([T.StructField("_key", kind), T.StructField("_feature", T.IntegerType()), T.StructField("_rank", T.DoubleType())])
    return (
        rows.mapInArrow(run, schema)
        .groupBy(F.col("_key").alias(key))
        .agg(*[F.max(F.when(F.col("_feature") == i, F.col("_rank"))).alias(prefix + f) for i, f in enumerate(features)])
    )


def _runs(feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First position of every run of equal values of a feature."""
    new = np.ones(len(value), dtype=bool)
    new[1:] = (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])
    return np.flatnonzero(new)


def _partition_edges(batches):
    """Per feature of a sorted partition: its rows, and its first and last value with their rows."""
    part, found = TaskContext.get().partitionId(), {}
    for batch in batches:
        feature, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_feature", "_value"))
        first = _runs(feature, value)
        for at, size in zip(first.tolist(), np.diff(np.append(first, len(value))).tolist()):
            f, v = int(feature[at]), float(value[at])
            e = found.setdefault(f, [0, v, 0, v, 0])
            e[0] += size
            e[2] += size if v == e[1] else 0
            e[3], e[4] = v, size + (e[4] if v == e[3] else 0)
    names = ("part", "feature", "n", "first", "n_first", "last", "n_last")
    types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
    table = [(part, f, *e) for f, e in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], t) for i, t in enumerate(types)], names=names)


def _borders(edges) -> tuple[dict, dict]:
    """Rows of a feature before each partition; and of each value at a border, the rows before it and its rows."""
    starts, borders, before = {}, {}, {}
    for e in sorted(edges, key=lambda e: (e["feature"], e["part"])):
        f = e["feature"]
        at = before.get(f, 0)
        starts[e["part"], f] = at
        ends = [(e["first"], at, e["n_first"])]
        if e["last"] != e["first"]:
            ends.append((e["last"], at + e["n"] - e["n_last"], e["n_last"]))
        for v, start, n in ends:
            known = borders.setdefault((f, v), (start, 0))
            borders[f, v] = (known[0], known[1] + n)
        before[f] = at + e["n"]
    return starts, borders


def _ranked(batches, starts: dict, borders: dict):
    """``_key, _feature, _rank`` of a sorted partition; holds the rows of one run that lies within it, and no more."""
    part, seen, held = TaskContext.get().partitionId(), {}, None

    def ranks(feature, value, last: bool):
        first = _runs(feature, value)
        sizes = np.diff(np.append(first, len(value)))
        rank = np.empty(len(value))
        for at, size in zip(first.tolist(), sizes.tolist()):
            f, v = int(feature[at]), float(value[at])
            border = borders.get((f, v))
            if border is None and not last and at + size == len(value):
                return rank[:at], at
            start, n = border or (starts[part, f] + seen.get(f, 0), size)
            rank[at : at + size] = start + (n + 1) / 2
            seen[f] = seen.get(f, 0) + size
        return rank, len(value)

    def told(table, last):
        feature, value = (table.column(c).to_numpy() for c in ("_feature", "_value"))
        rank, done = ranks(feature, value, last)
        keys = pa.concat_arrays([pa.array([], table.schema.field("_key").type), *table.slice(0, done).column("_key").chunks])
        out = pa.RecordBatch.from_arrays([keys, pa.array(feature[:done], pa.int32()), pa.array(rank)], names=["_key", "_feature", "_rank"])
        return out, table.slice(done)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        out, held = told(pa.concat_tables([held, table]) if held is not None and held.num_rows else table, False)
        yield out
    if held is not None and held.num_rows:
        yield told(held, True)[0]


#: Places a sketch may be off by, as a share of the rows, and the margin taken on either side.
SKETCH_ACCURACY, MARGIN = 10_000, 3


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    wanted: dict[str, tuple[str, float]],
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, as one row per group.

    ``wanted`` maps an output column to (measure, probability). A mergeable
    sketch gives two values that a quantile lies between; one pass counts the
    rows below them and the rows of each value inside, and the value at the wanted
    place is read off these counts. Both passes combine on the map side, nothing
    is sorted as a whole, and only a few rows in ten thousand become counts of
    their own. Should a place lie outside the sketch's values the run stops.
    Missing values are left out; a group without any value is absent, and with
    no groups one row comes back.
    """
    require_columns(df, [*groups, *{m for m, _ in wanted.values()}], "Quantile input")
    places = list(dict.fromkeys(wanted.values()))
    margin = MARGIN / SKETCH_ACCURACY

    # One sketch of a measure serves all its places.
    ends = {m: [e for n, p in places if n == m for e in (max(0.0, p - margin), min(1.0, p + margin))] for m, _ in places}

    def bracket(measure: str, p: float) -> str:
        asked = ", ".join(f"{e!r}D" for e in ends[measure])
        at = 2 * [place for place in places if place[0] == measure].index((measure, p)) + 1
        return f"slice(percentile_approx(CAST(`{measure}` AS DOUBLE), array({asked}), {SKETCH_ACCURACY}), {at}, 2)"

    brackets = [F.expr(bracket(m, p)).alias(f"_b{j}") for j, (m, p) in enumerate(places)]
    if groups:
        # One row per group; Spark decides by their size, and splits hot groups.
        sketched = df.groupBy(*groups).agg(*brackets)
        renamed = sketched.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *[f"_b{j}" for j in range(len(places))])
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
        measures = {m: f"_v{i}" for i, m in enumerate(dict.fromkeys(m for m, _ in places))}
        narrow = df.select(*groups, *[F.col(m).cast("double").alias(v) for m, v in measures.items()])
        met, between = narrow.join(renamed, same), [F.col(f"_b{j}") for j in range(len(places))]
    else:
        measures = {m: m for m, _ in places}
        both = df.agg(F.struct(*brackets).alias("s")).scalar()
        met, between = df, [both[f"_b{j}"] for j in range(len(places))]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(j).alias("j"), F.col(measures[m]).cast("double").alias("v"), between[j].alias("b"))
                for j, (m, _) in enumerate(places)
            ]
        )
    )
    side = F.expr("CASE WHEN _r.v < _r.b[0] THEN -1 WHEN _r.v <= _r.b[1] THEN 0 ELSE 1 END")
    counted = (
        met.select(*groups, rows.alias("_r"))
        .where("_r.v IS NOT NULL")
        .select(*groups, F.col("_r.j").alias("_j"), F.col("_r.v").alias("_v"), side.alias("_side"))
        .groupBy(*groups, "_j", "_side", F.expr("CASE WHEN _side = 0 THEN _v END").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    # Bounded: the values of one group between its two ends.
    own = Window.partitionBy(*groups, "_j")
    upto = own.orderBy("_side", "_value")
    chance = "element_at(array(" + ", ".join(f"{float(p)!r}D" for _, p in places) + "), _j + 1)"
    placed = counted.withColumns(
        {
            "_first": F.coalesce(F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_h": (F.sum("_n").over(own) - 1) * F.expr(chance),
        }
    )

    def value_at(place: str) -> Column:
        """The value at a place, where this row holds it."""
        return F.expr(
            f"""CASE WHEN _first <= {place} AND {place} < _first + _n THEN
            CASE WHEN _side = 0 THEN _value WHEN _side < 0 AND {place} = _n - 1 THEN _most WHEN _side > 0 AND {place} = _first THEN _least
            ELSE CAST(raise_error('a quantile lies outside the values of its sketch') AS DOUBLE) END END"""
        )

    ends = placed.select(*groups, "_j", "_h", value_at("floor(_h)").alias("_lo"), value_at("ceil(_h)").alias("_hi"))
    parts, results = [], []
    for out, place in wanted.items():
        j = places.index(place)
        parts += [F.expr(f"max(CASE WHEN _j = {j} THEN {e} END) AS `{out}{e}`") for e in ("_lo", "_hi", "_h")]
        results.append(F.expr(f"`{out}_lo` + (`{out}_hi` - `{out}_lo`) * (`{out}_h` - floor(`{out}_h`))").alias(out))
    found = ends.groupBy(*groups).agg(*parts) if groups else ends.agg(*parts)
    return found.select(*groups, *results)


def holm(df: DataFrame, family: str, p: str, test: str, out: str = "adjusted_p_value") -> DataFrame:
    """Step-down adjusted p-values inside each family of tests.

    A family is a list of hypothesis tests, so a window per family is small. A
    test without a p-value (null or NaN) keeps none and does not count.
    """
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    order = Window.partitionBy(family, "_known").orderBy(p, test)
    size = F.count(F.lit(1)).over(Window.partitionBy(family, "_known"))
    step = F.least(F.col(p) * (size - F.row_number().over(order) + 1), F.lit(1.0))
    climbing = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = df.withColumn("_known", known).withColumn("_step", F.when(F.col("_known"), step))
    return adjusted.withColumn(out, F.max("_step").over(climbing)).drop("_step", "_known")
