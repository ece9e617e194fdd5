import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import cells, silhouette
from basketry.plans import cluster


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clouds of 64 customers around (days, orders, value), by lognormal factors."""
    rng = np.random.default_rng(77)
    middles, n = [(8, 60, 20000), (90, 9, 900), (700, 2, 45)], 64
    near = [np.array(m) * np.exp(rng.normal(0, 0.08, (n, 3))) for m in middles]
    rows = np.concatenate(near)
    data = pd.DataFrame({
        "customer_id": [f"k{i}" for i in range(3 * n)],
        "recency_days": rows[:, 0].round().astype(int), "frequency_orders": rows[:, 1].round().astype(int),
        "monetary_value_gbp": rows[:, 2].round(2), "primary_country": "Utopia", "average_order_value_gbp": 1.5,
        "active_span_days": 11, "units_purchased": 4, "distinct_products": 2,
        "segment": np.repeat(["Champions", "At Risk", "Hibernating"], n), "truth": np.repeat([1, 2, 3], n),
    })
    return spark.createDataFrame(data)


@pytest.fixture(scope="module")
def data(blobs):
    return cluster.training_table(blobs)


def test_scaling_uses_the_population_deviation(blobs):
    z = cluster.scaled_features(blobs).select(*cluster.SCALED).toPandas()
    np.testing.assert_allclose(z.mean(), 0, atol=1e-9)
    np.testing.assert_allclose(z.std(ddof=0), 1, atol=1e-9)


def test_input_contract(blobs):
    cluster.check_input(blobs)
    with pytest.raises(ValueError, match="recency_days_negative"):
        cluster.check_input(blobs.withColumn("recency_days", F.lit(-1)))
    with pytest.raises(ValueError, match="customer_id_unique"):
        cluster.check_input(blobs.unionByName(blobs.limit(1)))
    with pytest.raises(ValueError, match="segment"):
        cluster.check_input(blobs.drop("segment"))


def test_k_evaluation_on_three_clouds(data):
    evaluation = cluster.evaluate_k(data, (2, 3, 4), n_init=4)
    rows = {r["k"]: r for r in evaluation.collect()}
    assert rows[3]["mean_pairwise_ari"] == pytest.approx(1.0) and rows[3]["minimum_cluster_count"] == 64
    assert all(-1 <= r["minimum_pairwise_ari"] <= 1 and r["stability_pair_count"] == 10 for r in rows.values())
    assert rows[4]["inertia"] < rows[3]["inertia"] < rows[2]["inertia"]
    assert rows[2]["inertia_reduction_from_previous_k_pct"] is None and rows[3]["seed"] == 42
    assert cluster.metric_optimal_k(cluster.select_k(evaluation)) == 3
    with pytest.raises(ValueError, match="five seeds"):
        cluster.evaluate_k(data, (2,), seeds=(1, 2))
    with pytest.raises(ValueError, match="does not fit"):
        cluster.evaluate_k(data, (1,))


def test_fits_share_their_scans(data):
    """Each model of a joint fit is the one a fit of its own gives, and no row lies nearer to another centre."""
    both = cluster.fit_all(data, [(3, 5), (4, 9)], n_init=3)
    x = data.select(*cluster.SCALED).toPandas().to_numpy()
    for (k, seed), model in both.items():
        alone = cluster.fit(data, k, seed, 3)
        np.testing.assert_allclose(model.centres, alone.centres, atol=1e-9)
        d = ((x[:, None] - model.centres[None]) ** 2).sum(-1)
        assert model.inertia == pytest.approx(d.min(1).sum())
        own = d.argmin(1)
        means = np.array([x[own == c].mean(0) for c in range(k)])
        assert np.abs(means - model.centres).max() < 0.05


def test_assignment_is_in_business_order(data):
    got = cluster.assign(data, cluster.fit(data, 3, 42, 4)).groupBy("cluster_id").agg(
        F.min("truth").alias("low"), F.max("truth").alias("high"))
    assert sorted((r["cluster_id"], r["low"], r["high"]) for r in got.collect()) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.fixture(scope="module")
def clouds(spark):
    """Rows in uneven clouds, a few equal ones and a far group; their coordinates, and four labellings."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(2.5, 0.5, (700, 3)), np.full((30, 3), 1.0), rng.normal(40, 0.1, (20, 3))])
    labels = {
        "side": (x[:, 0] > 1).astype(int), "turn": np.arange(len(x)) % 3, "one": np.zeros(len(x), dtype=int),
        "apart": np.where(x[:, 0] > 20, 9, np.where(np.arange(len(x)) == 5, 4, 2)),
    }
    columns = {**{f"z{i}": x[:, i] for i in range(3)}, **labels}
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(4), x, labels


@pytest.mark.parametrize("near, fan_bits, tile", [(0.0, 6, 1024), (0.25, 1, 64), (0.25, 2, 128), (0.25, 6, 1024)])
def test_silhouettes_by_the_tree(clouds, monkeypatch, near, fan_bits, tile):
    df, x, labels = clouds
    monkeypatch.setattr(cells, "TILE", tile)
    got = {r[0]: r for r in silhouette.silhouettes(df, list(labels), ["z0", "z1", "z2"], near, fan_bits).collect()}
    for name, own in labels.items():
        want = 0.0 if name == "one" else brute_silhouette(x, own)
        off = abs(got[name]["silhouette_score"] - want)
        assert off < 1e-7 and off <= got[name]["error_bound"] + 1e-12
        assert got[name]["error_bound"] < 1e-4
    if near == 0:
        assert all(r["error_bound"] == 0 for r in got.values())


def test_tiles_are_dealt_to_the_cores_and_walked_in_blocks(spark, clouds, monkeypatch):
    many = spark.range(0, 30_000, 1, 4).select(*[F.rand(i).alias(f"z{i}") for i in range(3)])
    parts = cells.build_cells(many, ["z0", "z1", "z2"])
    assert parts.select("part").distinct().count() >= 4
    df, _, labels = clouds
    monkeypatch.setattr(cells, "TILE", 64)
    alone = {r[0]: r[1] for r in silhouette.silhouettes(df, list(labels), ["z0", "z1", "z2"]).collect()}
    monkeypatch.setattr(silhouette, "BLOCKS_A_CORE", 0)
    blocks = {r[0]: r[1] for r in silhouette.silhouettes(df, list(labels), ["z0", "z1", "z2"]).collect()}
    assert blocks == pytest.approx(alone, abs=1e-6)


def test_moments_stand_for_far_rows():
    rng = np.random.default_rng(8)
    y, w, x = rng.normal(0, 0.2, (40, 3)), rng.integers(1, 5, 40).astype(float), rng.normal(0, 1, (25, 3)) + 4
    sums = silhouette.moments(y, w)
    want = (np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) * w).sum(1)
    d, radius = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)).max()
    bound = 2 / 9 * sums[-1] / d**4 / (1 - radius / d)
    off = np.abs(silhouette.expansion(x) @ sums[:-1] - want)
    assert (off <= bound).all() and off.max() < 1e-3


def test_silhouettes_of_no_rows(clouds):
    df, _, labels = clouds
    assert silhouette.silhouettes(df.limit(0), ["side"], ["z0", "z1", "z2"]).count() == 0
    few = df.limit(0).unionByName(df.limit(1))
    assert silhouette.silhouettes(few, ["side"], ["z0", "z1", "z2"]).first()["silhouette_score"] == 0


# Cells, starts and steps


@pytest.fixture(scope="module")
def grouped(spark):
    """A third of the rows share one vector, the others lie in two wide clouds."""
    rng = np.random.default_rng(12)
    x = np.concatenate([np.zeros((1000, 3)), rng.normal(1, 1, (1200, 3)), rng.normal(-2, 0.7, (800, 3))])
    return spark.createDataFrame(pd.DataFrame(x, columns=cluster.SCALED)).repartition(5), x


def test_cells_hold_every_row(grouped, monkeypatch):
    df, x = grouped
    monkeypatch.setattr(cells, "TILE", 128)
    table = cells.build_cells(df, cluster.SCALED)
    assert table.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, b: a + b))).first()[0] == len(x)
    assert table.agg(F.sum(F.size("w"))).first()[0] == 2001
    found = list(cells.tiles(table.select("*").toArrow().to_batches(), 3))
    assert all(t.sizes.max() <= cells.LEAF and len(t.x) <= 128 for t in found)
    want = {tuple(r) for r in x}
    assert {tuple(r) for t in found for r in t.x} == want
    spread = [np.prod(np.maximum(t.x.max(0) - t.x.min(0), 1e-9)) for t in found]
    assert np.median(spread) < 0.2 * np.prod(x.max(0) - x.min(0))


def test_steps_over_cells_are_those_over_rows(grouped, monkeypatch):
    df, x = grouped
    rng = np.random.default_rng(1)
    models = [x[rng.choice(len(x), k)] + rng.normal(0, 0.01, (k, 3)) for k in (2, 3, 3, 5, 8) for _ in range(3)]
    table = cells.build_cells(df, cluster.SCALED)
    sums, costs = cluster._step(table, models)
    at = 0
    for model, cost in zip(models, costs):
        d = ((x[:, None] - model[None]) ** 2).sum(-1)
        own = d.argmin(1)
        assert cost == pytest.approx(d.min(1).sum(), rel=1e-9)
        for c in range(len(model)):
            assert sums[at + c, 0] == (own == c).sum()
            np.testing.assert_allclose(sums[at + c, 1:], x[own == c].sum(0), atol=1e-9)
        at += len(model)


def test_most_leaves_are_settled_as_a_whole():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (1024, 3))
    order, first = cells.split_leaves(x)
    tile = cells.Tile(0, 0, x[order], np.ones(len(x)), first)
    model = np.array([[[-3.0, 0, 0], [3.0, 0, 0]]])
    n, _, _ = cluster._leaf_sums(tile, model)
    assert n.tolist() == [(x[:, 0] <= 0).sum(), (x[:, 0] > 0).sum()]
    crossed = ((tile.low[:, 0] <= 0) & (tile.high[:, 0] >= 0)).sum()
    assert crossed < 0.6 * len(first)


def test_a_far_group_gets_a_centre(spark):
    """One row in 50 000 lies far away: starts that see all rows put a centre there."""
    rows = spark.range(0, 50_000, 1, 8)
    near = [((F.col("id") * f) % 1009 / 1009.0).alias(c) for f, c in zip((17, 31, 47), cluster.SCALED)]
    df = rows.select(*near).unionByName(spark.createDataFrame([(60.0, 60.0, 60.0)], cluster.SCALED))
    for model in cluster.fit_all(df, [(3, 1), (3, 2)], n_init=6).values():
        assert np.abs(model.centres - 60.0).max(axis=1).min() < 1e-6


def test_starts_do_not_depend_on_the_layout(grouped):
    df, _ = grouped
    one, other = (cluster.fit(df.repartition(p), 4, 9, 2) for p in (1, 7))
    np.testing.assert_allclose(one.centres, other.centres, atol=1e-9)


def test_an_evaluation_is_used_again(blobs, monkeypatch):
    rfm = blobs
    done = cluster.evaluate(cluster.training_table(rfm), (2, 3, 4), n_init=2)

    def never(*args, **kwargs):
        raise AssertionError("fitted twice")

    monkeypatch.setattr(cluster, "fit_all", never)
    monkeypatch.setattr(cluster, "check_labels", lambda *a: None)
    built = cluster.build_clusters(rfm, "Utopia", 3, evaluated=done)
    assert built["customer_clusters"].groupBy("cluster_id").count().where("count = 64").count() == 3
    distances = {r["silhouette_distance"] for r in built["k_evaluation"].collect()}
    assert distances == {"euclidean"}
    x = done.data.select(*cluster.SCALED).toPandas().to_numpy()
    for row in done.frame.collect():
        own = ((x[:, None] - done.models[row["k"], 42].centres[None]) ** 2).sum(-1).argmin(1)
        assert row["silhouette_score"] == pytest.approx(brute_silhouette(x, own), abs=1e-6)


def test_calinski_harabasz_and_davies_bouldin(data):
    frame = data.select("truth", *cluster.SCALED).toPandas()
    x, labels = frame[cluster.SCALED].to_numpy(), frame["truth"].to_numpy()
    centres = {k: x[labels == k].mean(0) for k in (1, 2, 3)}
    within = sum(((x[labels == k] - centres[k]) ** 2).sum() for k in (1, 2, 3))
    between = sum((labels == k).sum() * ((centres[k] - x.mean(0)) ** 2).sum() for k in (1, 2, 3))
    row = cluster.calinski_harabasz(data, "truth").first()
    assert row["inertia"] == pytest.approx(within)
    assert row["calinski_harabasz_score"] == pytest.approx((between / 2) / (within / (len(x) - 3)))
    spread = {k: np.sqrt(((x[labels == k] - centres[k]) ** 2).sum(1)).mean() for k in (1, 2, 3)}
    ratio = {(a, b): (spread[a] + spread[b]) / np.sqrt(((centres[a] - centres[b]) ** 2).sum()) for a in spread for b in spread if a != b}
    want = np.mean([max(v for (a, _), v in ratio.items() if a == k) for k in spread])
    assert cluster.davies_bouldin(data, "truth").first()[0] == pytest.approx(want)


def test_adjusted_rand(spark):
    rows = [(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 2, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int").withColumn("same", F.col("a"))
    got = {(r["left"], r["right"]): r["adjusted_rand"] for r in cluster.adjusted_rand(df, ["a", "b", "c", "same"]).collect()}
    assert got[("a", "same")] == 1.0
    assert got[("a", "c")] < 0.01 and -1 <= got[("b", "c")] <= 1


EVALUATION = "k int, silhouette_score double, calinski_harabasz_score double, davies_bouldin_score double, minimum_cluster_share_pct double, mean_pairwise_ari double"


def candidates(spark, *changes):
    """Candidates for k = 5, 6, 7: all metrics fall with k; each change is (k, column, value)."""
    rows = {k: dict(k=k, sil=0.9 - k / 100, ch=1000.0 - k, db=0.1 * k, share=11.0, ari=0.99 - k / 1000) for k in (5, 6, 7)}
    for k, column, value in changes:
        rows[k][column] = value
    return spark.createDataFrame([tuple(r.values()) for r in rows.values()], EVALUATION)


@pytest.mark.parametrize("column, value", [("share", 1.99), ("ari", 0.79)])
def test_select_k_leaves_out_unusable_solutions(spark, column, value):
    assert cluster.metric_optimal_k(cluster.select_k(candidates(spark))) == 5
    ranked = cluster.select_k(candidates(spark, (5, column, value)))
    assert cluster.metric_optimal_k(ranked) == 6
    out = ranked.where("k = 5").first()
    assert not out["eligible"] and out["rank_silhouette"] is None and out["selection_rank_sum"] is None
    with pytest.raises(RuntimeError):
        cluster.metric_optimal_k(cluster.select_k(candidates(spark), min_share_pct=50))


def test_a_stated_k_overrides_the_metric_choice(spark):
    ranked = cluster.select_k(candidates(spark, (6, "share", 0.5)))
    chosen = cluster.choose_k(ranked, 7)
    assert cluster.metric_optimal_k(chosen) == 5
    assert [r["k"] for r in chosen.where("selected").collect()] == [7]
    with pytest.raises(ValueError):
        cluster.choose_k(ranked, 8)
    with pytest.raises(RuntimeError):
        cluster.choose_k(ranked, 6)


def test_cluster_labels(spark):
    rows = [(4, 10.0, 2.5, 80.0), (3, 20.0, 7.0, 1234.5), (2, 30.0, 1.0, 40.0), (1, 40.0, 9.0, 60.0)]
    df = spark.createDataFrame(rows, "cluster_id int, median_recency_days double, median_frequency_orders double, median_monetary_value_gbp double")
    labels = cluster.cluster_labels(df)
    cluster.check_labels(labels)
    third = labels.where("cluster_id = 3").first()
    for part in ("20.0 days (rank 2/4)", "7.0 orders (rank 2/4)", "GBP 1,234.50 (rank 1/4)"):
        assert part in third["label_basis"]
    assert third["cluster_label"] == cluster.LABELS[3] and third["recommended_action"] == cluster.ACTIONS_BY_RECENCY[2]
    with pytest.raises(ValueError):
        cluster.check_labels(labels.limit(3))
