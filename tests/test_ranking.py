import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import dedup, ranking


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value, as the hot key of a real table would."""
    rng = np.random.default_rng(5)
    n = 3000
    value = np.where(rng.random(n) < 0.34, 1.0, np.round(rng.gamma(2, 50, n), 1))
    return pd.DataFrame(
        {"id": [f"c{i:05d}" for i in rng.permutation(n)], "v": value, "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])}
    )


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_global_row_number_is_dense_and_independent_of_partitions(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.global_row_number(spark.createDataFrame(skewed), [F.desc("v"), "id"], "i").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    want = skewed.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("i")["id"].tolist() == want
    assert sorted(got["i"]) == list(range(1, len(skewed) + 1))


def test_hot_value_is_spread_over_partitions(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking._place(spark.createDataFrame(skewed), ["v", "id"])
        hot = placed.where("v = 1.0").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot > 1


def test_running_total(spark, skewed):
    df = spark.createDataFrame(skewed).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    got = ranking.running_total(df, ["v"], "c").toPandas().sort_values("v")
    assert got["before"].tolist() == (got["c"].cumsum() - got["c"]).tolist()


@pytest.mark.parametrize("n,q", [(5878, 5), (5878, 10), (11, 5), (10, 10), (1, 5)])
def test_quantile_bin_equals_binned_ranks(spark, n, q):
    df = spark.range(1, n + 1).select("id", ranking.quantile_bin(F.col("id"), F.lit(n).cast("long"), q).alias("b"))
    got = df.toPandas().sort_values("id")["b"].tolist()
    want = [1] if n == 1 else pd.qcut(pd.Series(range(1, n + 1)), q, labels=range(1, q + 1)).astype(int).tolist()
    assert got == want


def test_score_bin_of_few_rows(spark):
    df = spark.range(1, 4).select("id", ranking.score_bin(F.col("id"), F.lit(3).cast("long")).alias("b"))
    assert [r["b"] for r in df.orderBy("id").collect()] == [2, 4, 5]


def test_decile_bin_of_few_rows(spark):
    one = spark.range(1, 2).select(ranking.decile_bin(F.col("id"), F.lit(1).cast("long")).alias("b"))
    assert one.first()["b"] == 1
    four = spark.range(1, 5).select(ranking.decile_bin(F.col("id"), F.lit(4).cast("long")).alias("b"))
    assert sorted(r["b"] for r in four.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("n", [3, 10, 23, 5878])
def test_ntile_bin_equals_ntile(spark, n):
    df = spark.range(1, n + 1).select("id", ranking.ntile_bin(F.col("id"), F.lit(n).cast("long"), 10).alias("b"))
    df = df.selectExpr("*", "ntile(10) over (order by id) as t")
    assert df.where("b <> t").count() == 0


def test_metric_ranks_break_ties_by_key(spark, skewed):
    got = ranking.metric_ranks(spark.createDataFrame(skewed), "id", {"up": ("v", True), "down": ("v", False)}).toPandas()
    up = skewed.sort_values(["v", "id"])["id"].tolist()
    down = skewed.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("up")["id"].tolist() == up and got.sort_values("down")["id"].tolist() == down
    assert set(got["n"]) == {len(skewed)}


def test_average_ranks_share_ties(spark, skewed):
    data = skewed.assign(w=np.round(skewed["v"] / 25))
    got = ranking.average_ranks(spark.createDataFrame(data), "id", ["v", "w"]).toPandas().set_index("id")
    want = data.set_index("id")[["v", "w"]].rank()
    pd.testing.assert_series_equal(got["rank_v"].sort_index(), want["v"].sort_index(), check_names=False)
    pd.testing.assert_series_equal(got["rank_w"].sort_index(), want["w"].sort_index(), check_names=False)


def test_exact_quantiles_interpolate_per_group(spark, skewed):
    wanted = {"q10": ("v", 0.1), "mid": ("v", 0.5), "q99": ("v", 0.99)}
    got = ranking.exact_quantiles(spark.createDataFrame(skewed), ["g"], wanted).toPandas().set_index("g").sort_index()
    for out, (_, p) in wanted.items():
        np.testing.assert_allclose(got[out], skewed.groupby("g")["v"].quantile(p).sort_index(), rtol=1e-12)
    whole = ranking.exact_quantiles(spark.createDataFrame(skewed), [], wanted).first()
    assert whole["q99"] == pytest.approx(skewed["v"].quantile(0.99), rel=1e-12)


def test_exact_quantiles_skip_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert ranking.exact_quantiles(df, [], {"m": ("v", 0.5)}).first()["m"] == 2.0
    assert ranking.exact_quantiles(df.limit(0), [], {"m": ("v", 0.5)}).first()["m"] is None


def test_quantiles_of_hot_values_nulls_and_gaps(spark):
    """A value held by a third of all rows, groups of one and two rows, a null group, and places at the very ends."""
    rng = np.random.default_rng(6)
    v = np.where(rng.random(30_000) < 0.34, 7.0, rng.normal(0, 100, 30_000).round(4))
    g = rng.choice(["a", "b", None], 30_000, p=[0.8, 0.1, 0.1])
    data = pd.DataFrame({"g": g, "v": v, "w": -v})
    extra = pd.DataFrame({"g": ["one", "two", "two", "none"], "v": [3.0, 1.0, 2.0, np.nan], "w": [1.0, 2.0, np.nan, np.nan]})
    data = pd.concat([data, extra], ignore_index=True)
    df = spark.createDataFrame(data).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "w")}).repartition(7)
    wanted = {f"{c}_{i}": (c, p) for c in ("v", "w") for i, p in enumerate((0.0, 0.001, 0.25, 0.5, 0.66, 0.75, 0.9999, 1.0))}
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], wanted).collect()}
    assert set(got) == {"a", "b", "one", "two", None}
    for name, rows in data.groupby("g", dropna=False):
        name = None if pd.isna(name) else name
        for out, (c, p) in wanted.items():
            if name != "none":
                assert got[name][out] == pytest.approx(rows[c].quantile(p), rel=1e-12, abs=1e-12)
    whole = ranking.exact_quantiles(df, [], wanted).first()
    for out, (c, p) in wanted.items():
        assert whole[out] == pytest.approx(data[c].quantile(p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", range(1, 9))
def test_quantiles_of_few_rows(spark, n):
    values = [float(i * i) for i in range(n)]
    wanted = {f"q{i}": ("v", i / 40) for i in range(41)}
    got = ranking.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], wanted).first()
    for out, (_, p) in wanted.items():
        assert got[out] == pytest.approx(pd.Series(values).quantile(p), abs=1e-12)


def test_quantiles_sort_nothing_as_a_whole(spark, skewed):
    df = ranking.exact_quantiles(spark.createDataFrame(skewed), ["g"], {"q": ("v", 0.5)})
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_many_partitions(spark):
    """Runs of equal values that lie in one partition, end at its border, or fill several."""
    rng = np.random.default_rng(11)
    n = 6000
    data = pd.DataFrame(
        {"id": rng.permutation(n), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 40, n)), "rare": rng.normal(0, 1, n),
         "two": rng.integers(0, 2, n).astype(float), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n))}
    )
    features = ["hot", "rare", "two", "gaps"]
    df = spark.createDataFrame(data).withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("13", "false", "100")):
            spark.conf.set(k, v)
        got = ranking.average_ranks(df, "id", features).toPandas().set_index("id").sort_index()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = data.set_index("id")[features].rank().sort_index()
    for f in features:
        pd.testing.assert_series_equal(got[f"rank_{f}"], want[f], check_names=False, check_index_type=False)


def test_ranks_of_no_rows(spark):
    none = spark.createDataFrame([], "id string, v double")
    assert ranking.average_ranks(none, "id", ["v"]).count() == 0
    some = spark.createDataFrame([("a", None), ("b", 2.0)], "id string, v double")
    assert {r["id"]: r["rank_v"] for r in ranking.average_ranks(some, "id", ["v"]).collect()} == {"b": 1.0}


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.04), ("f", "b", 0.001), ("f", "c", 0.03), ("g", "d", 0.9)], "f string, t string, p double")
    got = {r["t"]: r["adjusted_p_value"] for r in ranking.holm(df, "f", "p", "t").collect()}
    assert got == pytest.approx({"a": 0.06, "b": 0.003, "c": 0.06, "d": 0.9})


def test_latest_text_and_most_common(spark):
    rows = [("p", "old", "2020-01-01"), ("p", "new", "2020-02-01"), ("p", None, "2020-02-01"), ("q", "x", "2020-01-01"), ("q", None, "2020-03-01")]
    df = spark.createDataFrame(rows, "k string, d string, t string")
    latest = {r["k"]: r["d"] for r in dedup.latest_text(df, ["k"], "d", "t", "Unknown product").collect()}
    assert latest == {"p": "new", "q": "Unknown product"}
    common = spark.createDataFrame([("a", "X"), ("a", "W"), ("b", None), ("c", None), ("c", "Z")], "k string, v string")
    got = {r["k"]: r["m"] for r in dedup.most_common(common, "k", "v", "m", "Unknown").collect()}
    assert got == {"a": "W", "b": "Unknown", "c": "Z"}


def test_holm_leaves_undefined_tests_out(spark):
    rows = [("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", float("nan")), ("f", "d", None)]
    got = {r["t"]: r["adjusted_p_value"] for r in ranking.holm(spark.createDataFrame(rows, "f string, t string, p double"), "f", "p", "t").collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (0.02, 0.02, None, None)


def test_ranks_of_a_value_that_most_rows_hold(spark):
    values = [1.0] * 5000 + [float(i) for i in range(2, 40)]
    df = pd.DataFrame({"id": [f"r{i}" for i in range(len(values))], "v": values})
    got = ranking.average_ranks(spark.createDataFrame(df), "id", ["v"]).toPandas().set_index("id")["rank_v"]
    want = df.set_index("id")["v"].rank()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_a_measure_is_sketched_once(spark, skewed):
    """All quantiles of a measure come from one sketch of it."""
    df = ranking.exact_quantiles(spark.createDataFrame(skewed), ["g"], {"a": ("v", 0.25), "b": ("v", 0.75)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.split("\n") if "partial_percentile_approx" in line]
    assert [line.count("partial_percentile_approx") for line in sketches] == [1]
