"""Registered queries: each reads the given Parquet folder through the library."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import dedup, ranking
from basketry.plans import clean, cluster, cohort, eda, gates, marts, measures, rfm, star, stats
from basketry.schema import IDENTITY, LINE, LOAD_SEQ, QUANTITY, pick_column
from basketry.session import pin, remove, shared_folder, stage_of
from basketry.sources import named_sql, sample_tables, scan, sinks

HOME = sample_tables.HOME
BATCHES = sample_tables.BATCHES


class Tables:
    """The pipeline's hand-off tables for one input folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _staged(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        return stage_of(self.spark).table((self.folder, name), build, partition_by)

    def source(self, name: str) -> DataFrame:
        return sample_tables.table(self.spark, self.folder, name)

    def lines(self) -> DataFrame:
        return sample_tables.transaction_lines(self.spark, self.folder)

    def raw(self) -> dict[str, DataFrame]:
        return sample_tables.raw_batches(self.spark, self.folder)

    def scanned(self) -> DataFrame:
        return scan.union_batches(self.raw(), "line_no")

    def canonical(self) -> DataFrame:
        by_order = [sample_tables.ORDER_KEY]
        lines = sample_tables.transaction_lines(self.spark, self.folder, by_order)
        return self._staged("canonical", lambda: clean.canonical_table(lines, BATCHES, by_order), "transaction_type")

    def dataset(self, name: str) -> DataFrame:
        return sinks.datasets(self.canonical())[name]

    def sales(self) -> DataFrame:
        return self.dataset("completed_sales")

    def returns(self) -> DataFrame:
        return self.dataset("returns")

    def identified(self) -> DataFrame:
        return rfm.identified_sales(self.canonical())

    def orders(self) -> DataFrame:
        return self._staged("orders", lambda: eda.order_summary(self.sales()))

    def customers(self) -> DataFrame:
        return self._staged("customers", lambda: eda.customer_summary(self.sales()))

    def rfm(self) -> DataFrame:
        return self._staged("rfm", lambda: rfm.rfm_table(self.identified()))

    def cohorts(self) -> DataFrame:
        return self._staged("cohorts", lambda: cohort.cohort_long(self.identified()))

    def dims(self, names: set[str] | None = None) -> dict[str, DataFrame]:
        builders = {
            "dim_date": star.dim_date,
            "dim_product": star.dim_product,
            "dim_customer": star.dim_customer,
            "dim_country": star.dim_country,
        }
        return {n: self._staged(n, lambda b=b: b(self.canonical())) for n, b in builders.items() if names is None or n in names}

    def star(self, names: set[str] | None = None) -> dict[str, DataFrame]:
        """The star tables, or those of ``names`` and the dimensions that their keys come from."""
        keyed = {"dim_product", "dim_customer", "dim_country"} if names and names & {"fact_sales", "fact_returns"} else set()
        dims = self.dims(None if names is None else names | keyed)
        facts = {
            "fact_sales": lambda: star.fact_sales(self.canonical(), dims),
            "fact_returns": lambda: star.fact_returns(self.canonical(), dims),
            "audit_exclusions": lambda: star.audit_exclusions(self.canonical()),
        }
        return {**dims, **{n: self._staged(n, b) for n, b in facts.items() if names is None or n in names}}

    def named(self, names: set[str] | None = None) -> dict[str, DataFrame]:
        needed = None if names is None else named_sql.words(named_sql.FILES, names)
        if needed and "ranked_customers" in needed:
            needed |= {"fact_sales"}
        tables = self.star(needed)
        star.register(tables)
        if names is None or "customer_revenue_deciles" in names:
            ranked = self._staged(
                "ranked_customers", lambda: star.ranked_customers(tables["fact_sales"])
            )
            star.register({"ranked_customers": ranked})
        return named_sql.run_named(self.spark, named_sql.FILES, names)

    def fixed_clusters(self) -> DataFrame:
        """RFM rows with stand-in labels: quartiles by value, units and recency."""

        def build():
            ranks = ranking.metric_ranks(
                self.rfm(),
                "customer_id",
                {
                    "_v": ("monetary_value_gbp", False),
                    "_u": ("units_purchased", False),
                    "_f": ("frequency_orders", False),
                },
            )
            labels = {
                f"{name}_{k}": ranking.quantile_bin(F.col(rank), F.col("n"), k)
                for k in (2, 3, 4)
                for name, rank in (("by_value", "_v"), ("by_units", "_u"), ("by_orders", "_f"))
            }
            labelled = self.rfm().join(ranks, "customer_id").withColumns(labels)
            return cluster.scaled_features(labelled.drop("_v", "_u", "_f", "n"))

        return self._staged("fixed_clusters", build).withColumn("cluster_id", F.col("by_value_4"))

    def value_bins(self) -> DataFrame:
        """Scaled RFM rows with value bins for every candidate k.

        ``all_k`` bins all customers by value into k quantile bins; ``most_k`` and
        ``many_k`` use ranks that ties in value break the other way, or by orders.
        """

        def build():
            ranks = ranking.metric_ranks(
                self.rfm(), "customer_id", {"_v": ("monetary_value_gbp", False), "_w": ("monetary_value_gbp", True)}
            )
            n = F.col("n")
            near = F.greatest(F.lit(1), F.least(n, F.col("_v") + F.when(F.col("_v") % 2 == 0, 1).otherwise(-1)))
            labels = {}
            for k in cluster.K_VALUES:
                labels[f"all_{k}"] = ranking.quantile_bin(F.col("_v"), n, k)
                labels[f"most_{k}"] = ranking.quantile_bin(n + 1 - F.col("_w"), n, k)
                labels[f"many_{k}"] = ranking.quantile_bin(near, n, k)
            labelled = self.rfm().join(ranks, "customer_id").withColumns(labels)
            return cluster.scaled_features(labelled.drop("_v", "_w", "n"))

        return self._staged("value_bins", build)

    def labelled_clusters(self) -> DataFrame:
        labels = cluster.cluster_labels(self.cluster_profiles())
        return self.fixed_clusters().join(
            F.broadcast(labels.select("cluster_id", "cluster_label")), "cluster_id"
        )

    def cluster_profiles(self) -> DataFrame:
        return self._staged(
            "cluster_profiles", lambda: cluster.cluster_profiles(self.fixed_clusters(), HOME)
        )

    def vectors(self) -> DataFrame:
        return cluster.training_table(self.rfm())

    def summary(self) -> DataFrame:
        return eda.eda_summary(self.sales(), self.returns(), self.orders(), self.customers())

    def marts(self) -> dict[str, DataFrame]:
        profiles = self.cluster_profiles()
        return marts.build_marts(
            self.sales(),
            self.returns(),
            self.orders(),
            self.rfm(),
            self.labelled_clusters(),
            self.cohorts(),
            profiles.join(cluster.cluster_labels(profiles), "cluster_id"),
            self.summary(),
        )

    def scratch(self, name: str) -> str:
        return f"{stage_of(self.spark).root}/out-{name}-{abs(hash(self.folder))}"


def doubles(df: DataFrame) -> DataFrame:
    """Decimals leave as doubles, and units (whole in these tables) as longs."""

    def edge(f):
        if f.dataType.typeName() != "decimal":
            return F.col(f.name)
        kind = "long" if f.dataType.scale == QUANTITY.scale else "double"
        return F.col(f.name).cast(kind).alias(f.name)

    return df.select(*[edge(f) for f in df.schema.fields])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles whose last bits depend on the order of summation, rounded."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Scans and sinks ------------------------------------------------------------


def scan_union_batches(t: Tables) -> DataFrame:
    lines = t.scanned().withColumn("source_batch", C.batch_name(BATCHES))
    return doubles(
        lines.groupBy("source_batch", "country").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("quantity").alias("quantities"),
            F.sum("unit_price").alias("price_total"),
        )
    )


def alias_columns(t: Tables) -> DataFrame:
    both = [scan.rename_to_canonical(raw).select(*IDENTITY) for raw in t.raw().values()]
    return both[0].unionByName(both[1])


def picked_columns(t: Tables) -> DataFrame:
    """The column of each table that a reader with other names for it would pick: its values and the largest."""
    wanted = {
        "orders": ["Revenue", "O_TotalPrice", "o_custkey"],
        "customer": ["balance", "C_ACCTBAL"],
        "lineitem": ["Units", "L_QUANTITY", "L_TAX"],
        "part": ["p_retailprice"],
    }
    parts = []
    for table, names in wanted.items():
        df = t.spark.read.parquet(f"{t.folder}/{table}.parquet")
        column = pick_column(df, names)
        parts.append(
            df.select(F.col(column).cast("double").alias("v")).agg(F.count("v").alias("known"), F.max("v").alias("greatest"))
            .select(F.lit(table).alias("table_name"), F.lit(column).alias("picked"), "known", "greatest")
        )
    return reduce(DataFrame.unionByName, parts)


def scan_files(t: Tables) -> DataFrame:
    """Raw batches written as CSV files and scanned: rows and positions per batch, which are dense from 0."""
    paths = {}
    for name, raw in t.raw().items():
        paths[name] = t.scratch(f"raw-{name}")
        sinks.write_csv(raw.drop("line_no").repartition(3, "Invoice"), paths[name])
    lines = scan.scan_batches(t.spark, paths)
    position = C.place_in_batch()
    return lines.groupBy(C.batch_name(BATCHES).alias("source_batch")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(position).alias("positions"),
        F.min(position).alias("first"),
        F.max(position).alias("last"),
        C.money(F.sum("quantity")).alias("quantity_total"),
        C.money(F.sum("unit_price")).alias("price_total"),
    )


def json_roundtrip(t: Tables) -> DataFrame:
    """A summary per country through JSON files."""
    path = t.scratch("json")
    summary = t.canonical().groupBy("country").agg(
        F.count(F.lit(1)).alias("row_count"), C.money(F.sum("line_revenue")).alias("value")
    )
    sinks.write_json_summary(summary, path)
    return scan.read_json_summary(t.spark, path, summary.schema)


def export_sizes(t: Tables) -> DataFrame:
    """What holds of the size report of written exports, with a limit none can meet and without one."""
    folder = t.scratch("exports")
    paths = sinks.write_bundle({"orders": order_fact(t), "calendar": marts.calendar(t.sales())}, folder)
    free, tight = sinks.size_report(t.spark, paths), sinks.size_report(t.spark, paths, limit=1)
    files = F.col("file").isNotNull()
    total = F.sum(F.when(files, F.col("bytes"))) == F.max(F.when(~files, F.col("bytes")))

    def facts(report: DataFrame, name: str) -> DataFrame:
        return report.agg(
            F.lit(name).alias("report"),
            F.count_distinct(F.when(files, F.col("table"))).alias("tables"),
            F.count_if(~files).alias("totals"),
            total.alias("adds_up"),
            F.every(F.when(files, F.col("passed"))).alias("all_passed"),
        )

    return facts(free, "without_limit").unionByName(facts(tight, "limit_of_one_byte"))


def small_n_scores(t: Tables) -> DataFrame:
    """Scores of the regions' value, fewer than the five bins; and of the nations', more than that."""
    nations = t.source("nation").join(t.source("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = t.canonical().groupBy("country").agg(F.sum("line_revenue").alias("value"))
    by_nation = sums.join(nations, F.col("country") == F.col("n_name"))
    by_region = by_nation.where("r_regionkey < 3").groupBy("r_name").agg(F.sum("value").alias("value"))
    both = by_region.select(F.lit("region").alias("scope"), F.col("r_name").alias("name"), "value").unionByName(
        by_nation.select(F.lit("nation").alias("scope"), "country", "value").withColumnRenamed("country", "name")
    )
    by_scope = Window.partitionBy("scope")
    place = F.row_number().over(by_scope.orderBy("value", "name"))
    return both.select("scope", "name", ranking.score_bin(place, F.count(F.lit(1)).over(by_scope)).alias("score"))


def csv_roundtrip(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    columns = [f.name for f in LINE if f.name != "load_seq"]
    sinks.write_csv(t.canonical().select("transaction_line_id", *columns), path)
    schema = "transaction_line_id long, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in LINE if f.name != "load_seq"
    )
    back = scan.read_csv(t.spark, path, schema)
    return doubles(back.select("transaction_line_id", "invoice_no", "invoice_date", "unit_price"))


def parquet_roundtrip(t: Tables) -> DataFrame:
    path = t.scratch("parquet")
    sinks.write_parquet(t.canonical(), path, "transaction_type")
    back = t.spark.read.parquet(path)
    return back.groupBy("transaction_type", "year").agg(
        F.count(F.lit(1)).alias("row_count"), C.money(F.sum("line_revenue")).alias("value")
    )


def partition_datasets(t: Tables) -> DataFrame:
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"), C.money(F.sum("line_revenue")).alias("value")
        ).select(F.lit(name).alias("dataset"), "row_count", "value")
        for name, df in sinks.datasets(t.canonical()).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def named_query_batch(t: Tables) -> DataFrame:
    """All statements of the files: rows, and the sum of every numeric column, as one report."""
    reports = []
    for name, df in t.named().items():
        numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "decimal", "float")]
        sums = df.agg(
            F.count(F.lit(1)).cast("double").alias("rows"),
            *[F.round(F.sum(F.col(c).cast("double")), 4).alias(c) for c in numeric],
        )
        reports.append(
            sums.unpivot([], sums.columns, "measure", "value").select(F.lit(name).alias("query"), "measure", "value")
        )
    return reduce(DataFrame.unionByName, reports)


def query_manifest(t: Tables) -> DataFrame:
    return named_sql.manifest(t.spark, t.named())


def named(name: str):
    return lambda t: t.named({name})[name]


# Scalars --------------------------------------------------------------------


def standardize(t: Tables) -> DataFrame:
    lines = t.scanned()
    return doubles(
        lines.select(
            *IDENTITY, C.line_revenue().alias("line_revenue"),
            C.batch_name(BATCHES).alias("source_batch"),
        )
    )


def coerce_types(t: Tables) -> DataFrame:
    bad = t.scanned().agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("quantity").alias("quantities"),
        F.count("invoice_date").alias("dates"),
        F.count("unit_price").alias("prices"),
        F.sum("quantity").alias("quantity_total"),
        C.money(F.sum("unit_price")).alias("price_total"),
        F.max("invoice_date").alias("last_date"),
    )
    return bad


def clean_id(t: Tables) -> DataFrame:
    raw = t.source("orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 == 0, F.lit("  "))
        .when(F.col("o_custkey") % 7 == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0 ")))
        .alias("raw_id"),
    )
    return raw.select(
        "o_orderkey", C.id_or_null("raw_id").alias("mart_id"), C.id_text("raw_id").alias("scan_id")
    )


def clean_numeric(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderkey") % 11 == 0, "unknown")
        .when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("GBP "), F.format_number("o_totalprice", 2)))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("£"), F.format_number("o_totalprice", 2)))
        .otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    )
    priced = t.source("orders").select("o_orderkey", text.alias("price_text"))
    return priced.select("o_orderkey", C.amount_text("price_text").alias("price"))


def classify_lines(t: Tables) -> DataFrame:
    full = clean.enrich(clean.classify(t.lines()))
    return full.groupBy(
        "transaction_type", "is_cancelled", "is_return", "is_completed_sale", "has_customer_id"
    ).agg(F.count(F.lit(1)).alias("row_count"), C.money(F.sum("line_revenue")).alias("value"))


def exclusion_reasons(t: Tables) -> DataFrame:
    """Reasons on lines with gaps made from the given ones, so that all occur."""
    day = F.dayofmonth("invoice_date")
    holed = t.lines().withColumns(
        {
            "invoice_no": F.when(day % 9 != 0, F.col("invoice_no")),
            "quantity": F.when(day % 7 == 0, F.lit(0)).otherwise(F.col("quantity")),
            "unit_price": F.when(day % 5 != 0, F.col("unit_price")),
        }
    )
    full = clean.enrich(clean.classify(holed))
    return full.groupBy("transaction_type", "exclusion_reason").agg(
        F.count(F.lit(1)).alias("row_count")
    )


def date_features(t: Tables) -> DataFrame:
    events = t.source("events")
    parts = C.date_parts("ts")
    return events.select("event_id", *[e.alias(n) for n, e in parts.items()])


def month_marts(t: Tables) -> DataFrame:
    return t.source("orders").groupBy(C.month_start("o_orderdate").alias("month_start")).agg(
        F.count(F.lit(1)).alias("orders"),
        C.money(F.sum(F.col("o_totalprice").cast("decimal(18,4)"))).alias("value"),
    )


def scalar_math(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.source("events").select(
        "event_id",
        F.round(F.abs(v), 6).alias("absolute"),
        F.round(F.log1p(F.abs(v)), 6).alias("log_value"),
        F.least(v, F.lit(100.0)).alias("clipped"),
        v.between(10, 20).alias("in_band"),
        F.substring("event_type", 1, 4).alias("short_type"),
    )


def effect_magnitude(t: Tables) -> DataFrame:
    """Net sale share of each customer's units, as a sized effect."""
    per_customer = t.canonical().where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum("quantity").alias("net"), F.sum(F.abs("quantity")).alias("gross")
    )
    effect = C.ratio("net", "gross")
    return per_customer.select(
        "customer_id", effect.alias("effect"), C.effect_magnitude(effect).alias("magnitude")
    )


# Filters, duplicates, ranks -------------------------------------------------


def identified_sales(t: Tables) -> DataFrame:
    return t.identified().groupBy("country").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("customer_id").alias("customers"),
        C.money(F.sum("line_revenue")).alias("value"),
    )


def dedup_exact(t: Tables) -> DataFrame:
    names = [*BATCHES, "batch_3"]
    unique = dedup.drop_exact_copies(sample_tables.overlapping_batches(t.spark, t.folder))
    return unique.groupBy(C.batch_name(names).alias("source_batch"), "country").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("quantity")
    )


def raw_profile(t: Tables) -> DataFrame:
    lines = sample_tables.overlapping_batches(t.spark, t.folder)
    return clean.raw_profile(lines, [*BATCHES, "batch_3"])


def missing_values(t: Tables) -> DataFrame:
    return clean.missing_values(t.scanned())


def line_ids(t: Tables) -> DataFrame:
    return doubles(
        t.canonical().select(
            "transaction_line_id", *IDENTITY, "source_batch", "transaction_type"
        )
    )


def global_row_number(t: Tables) -> DataFrame:
    events = t.source("events").select("event_id", "event_type", "value")
    return ranking.global_row_number(events, ["event_type", F.desc("value"), "event_id"], "place")


def avg_rank(t: Tables) -> DataFrame:
    features = ["recency_days", "frequency_orders", "distinct_products"]
    return ranking.average_ranks(t.rfm(), "customer_id", features)


def holm_adjust(t: Tables) -> DataFrame:
    """Return-flag mix of each nation against the whole, adjusted per region."""
    lines = t.canonical().select("country", "transaction_type")
    counts = lines.groupBy("country").agg(
        *[
            F.count_if(F.col("transaction_type") == k).cast("double").alias(f"o{i}")
            for i, k in enumerate((C.SALE, C.RETURN, C.EXCLUDED))
        ]
    )
    whole = counts.agg(
        F.struct(*[F.sum(f"o{i}").alias(f"o{i}") for i in range(3)]).alias("s")
    ).scalar()
    n = F.col("o0") + F.col("o1") + F.col("o2")
    total = whole["o0"] + whole["o1"] + whole["o2"]
    x = None
    for i in range(3):
        expected = n * whole[f"o{i}"] / total
        term = (F.col(f"o{i}") - expected) * (F.col(f"o{i}") - expected) / expected
        x = term if x is None else x + term
    # Two degrees of freedom, where the tail is a plain exponential.
    tests = counts.select("country", F.exp(-x / 2).alias("p_value"))
    nations = t.source("nation").join(
        t.source("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    families = tests.join(nations, F.col("country") == F.col("n_name")).select(
        F.col("r_name").alias("family"), "country", "p_value"
    )
    return rounded(ranking.holm(families, "family", "p_value", "country"), 9)


def k_selection(t: Tables) -> DataFrame:
    """Evidence ranks over stand-in labellings for k = 2 to 10, with the real gates.

    A labelling bins the customers' value; its two neighbours, with which its
    stability is measured, bin the same value after leaving out some customers.
    """
    data = cluster.vectors(t.value_bins())
    rows = []
    for k in cluster.K_VALUES:
        names = [f"all_{k}", f"most_{k}", f"many_{k}"]
        q = cluster.label_quality(data, names[0])
        agreement = cluster.adjusted_rand(data, names).agg(F.avg("adjusted_rand")).first()[0]
        rows.append(
            (
                k, q["silhouette_score"], q["calinski_harabasz_score"], q["davies_bouldin_score"],
                q["minimum_cluster_share_pct"], agreement,
            )
        )
    evaluation = t.spark.createDataFrame(
        rows,
        "k int, silhouette_score double, calinski_harabasz_score double, "
        "davies_bouldin_score double, minimum_cluster_share_pct double, mean_pairwise_ari double",
    )
    return rounded(cluster.select_k(evaluation), 5)


def top_n_by(t: Tables) -> DataFrame:
    priced = t.sales().where(F.col("description").isNotNull())
    return eda.top_n(priced, "description", "line_revenue", 10, 42).select(
        "label", "description", C.money("line_revenue").alias("line_revenue")
    )


def strongest_correlations(t: Tables) -> DataFrame:
    pairs = stats.spearman_pairs(t.rfm(), "customer_id", rfm.MEASURES)
    effects = rounded(
        pairs.select(
            F.concat("feature_1", F.lit(" versus "), "feature_2").alias("comparison"),
            F.col("rho").alias("effect_size"),
        )
    )
    return stats.strongest(effects).withColumn(
        "effect_magnitude", C.effect_magnitude(F.col("effect_size"))
    )


# Descriptive tables ---------------------------------------------------------


def monthly_performance(t: Tables) -> DataFrame:
    monthly = eda.monthly_performance(t.sales(), t.orders())
    return monthly.withColumn("median_order_value_gbp", F.round("median_order_value_gbp", 6))


def complete_months(t: Tables) -> DataFrame:
    return eda.complete_months(monthly_performance(t)).select("year_month", "revenue_gbp", "orders")


def hourly_performance(t: Tables) -> DataFrame:
    return eda.hourly_performance(sample_tables.event_sales(t.spark, t.folder))


def _event_groups(t: Tables) -> DataFrame:
    return sample_tables.event_sales(t.spark, t.folder)


def outlier_thresholds(t: Tables) -> DataFrame:
    lines = clean.upper_fences(t.canonical(), clean.FENCED, F.col("is_completed_sale"))
    events = clean.upper_fences(_event_groups(t), ["line_revenue"]).select(
        F.struct("*").alias("s")
    )
    return rounded(
        lines.withColumn("event_value_upper", events.scalar()["line_revenue_upper"]), 6
    )


def outlier_flags(t: Tables) -> DataFrame:
    events = _event_groups(t)
    fences = clean.upper_fences(events, ["line_revenue"])
    flagged = clean.flag_above(events, fences, ["line_revenue"])
    return flagged.groupBy("event_type", "is_line_revenue_outlier").agg(
        F.count(F.lit(1)).alias("row_count"), C.money(F.sum("line_revenue")).alias("value")
    )


def cleaning_summary(t: Tables) -> DataFrame:
    return rounded(clean.cleaning_summary(t.lines(), t.canonical()))


def order_value_percentiles(t: Tables) -> DataFrame:
    return rounded(eda.value_percentiles(t.orders(), "order_value"))


def rfm_describe(t: Tables) -> DataFrame:
    return rounded(eda.describe(t.rfm(), cluster.FEATURES), 5)


def order_value_histogram(t: Tables) -> DataFrame:
    return rounded(eda.histogram(t.orders(), "order_value", 60, cap=0.99))


def rfm_histograms(t: Tables) -> DataFrame:
    recency = eda.histogram(t.rfm(), "recency_days", 45, cap=0.99, clip=True)
    orders = eda.histogram(t.rfm(), "frequency_orders", 35, cap=0.99, clip=True)
    return rounded(
        recency.withColumn("metric", F.lit("recency_days")).unionByName(
            orders.withColumn("metric", F.lit("frequency_orders"))
        )
    )


def customer_value_histogram(t: Tables) -> DataFrame:
    return rounded(eda.histogram(t.customers(), "customer_revenue_gbp", 60, log=True), 6)


def box_summary(t: Tables) -> DataFrame:
    placed = stats.with_groups(t.orders(), "country", HOME)
    return rounded(eda.box_summary(placed, "geography", "order_value_gbp"))


# Customers ------------------------------------------------------------------


def rfm_scores(t: Tables) -> DataFrame:
    return t.rfm().select("customer_id", "r_score", "f_score", "m_score", "rfm_score", "rfm_code")


def rfm_segments(t: Tables) -> DataFrame:
    return t.rfm().select("customer_id", "segment", "frequency_orders", "monetary_value_gbp")


def cohort_wide(value: str):
    return lambda t: cohort.widen(t.cohorts(), value)


# Statistics and clusters ----------------------------------------------------


def spearman_pairs(t: Tables) -> DataFrame:
    customers = stats.spearman_pairs(t.rfm(), "customer_id", rfm.MEASURES)
    orders = stats.spearman_pairs(t.orders(), "invoice_no", stats.ORDER_FEATURES)
    return rounded(
        customers.withColumn("scope", F.lit("customers")).unionByName(
            orders.withColumn("scope", F.lit("orders"))
        )
    )


def correlation_matrix(t: Tables) -> DataFrame:
    pairs = stats.spearman_pairs(t.orders(), "invoice_no", stats.ORDER_FEATURES)
    return rounded(stats.correlation_matrix(pairs, stats.ORDER_FEATURES))


def mann_whitney(t: Tables) -> DataFrame:
    people = stats.with_groups(t.rfm(), "primary_country", HOME)
    orders = stats.with_groups(t.orders(), "country", HOME)
    value = stats.mann_whitney(people, "monetary_value_gbp", F.col("is_repeat_customer"))
    size = stats.mann_whitney(orders, "order_value_gbp", F.col("geography") == HOME)
    return rounded(
        value.withColumn("test", F.lit("repeat_value")).unionByName(
            size.withColumn("test", F.lit("home_order_value"))
        ),
        9,
    )


def contingency(t: Tables) -> DataFrame:
    return stats.contingency(t.rfm(), HOME)


def chi_square(t: Tables) -> DataFrame:
    return rounded(stats.chi_square(stats.contingency(t.rfm(), HOME)), 9)


def hypothesis_tests(t: Tables) -> DataFrame:
    stats.check_inputs(t.rfm(), t.orders())
    tests = stats.hypothesis_tests(t.rfm(), t.orders(), HOME)
    numbers = tests.select(
        "test_id", "family", "sample_size_total", "sample_size_group_1", "sample_size_group_2",
        F.round("statistic", 6).alias("statistic"), F.round("effect_size", 6).alias("effect_size"),
        "raw_p_value", "adjusted_p_value", "effect_magnitude", "reject_null",
    )
    return numbers.withColumns({c: F.round(c, 9) for c in ("raw_p_value", "adjusted_p_value")})


def correlation_tests(t: Tables) -> DataFrame:
    return hypothesis_tests(t).where(F.col("family") == stats.CORRELATIONS)


def statistical_summary(t: Tables) -> DataFrame:
    tests = stats.hypothesis_tests(t.rfm(), t.orders(), HOME)
    summary = stats.statistical_summary(tests)
    return summary.select(
        "tests", "correlations", "confirmatory_group_tests", "holm_adjusted_significant", "customers", "orders",
        F.round("least_correlation", 6).alias("least_correlation"),
        F.round("greatest_correlation", 6).alias("greatest_correlation"),
        F.array_join(F.transform("strongest_correlations", lambda r: r["test_id"]), ",").alias("strongest"),
        F.array_join(F.transform("group_tests", lambda r: r["test_id"]), ",").alias("group_tests"),
    )


def group_summaries(t: Tables) -> DataFrame:
    return rounded(stats.group_summaries(t.rfm(), t.orders(), HOME))


def scaled_features(t: Tables) -> DataFrame:
    return rounded(cluster.scaled_features(t.rfm()).select("customer_id", *cluster.SCALED), 6)


def kmeans_assign(t: Tables) -> DataFrame:
    """What must hold of any assignment: all customers, k clusters, each at its nearest centre, in business order."""
    data = t.vectors()
    model = cluster.fit(data, cluster.OPERATIONAL_K, cluster.SEEDS[0])
    labelled = pin(cluster.assign(data, model).drop("features"))
    places = {place: raw for raw, place in cluster.business_order(model).items()}
    squares = {
        place: sum((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cluster.SCALED, model.centres[raw]))
        for place, raw in places.items()
    }
    least = F.least(*squares.values())
    own = F.element_at(F.array(*[squares[p] for p in sorted(squares)]), F.col("cluster_id"))
    z = dict(zip(cluster.FEATURES, cluster.SCALED))
    value = F.avg(F.col(z["frequency_orders"]) + F.col(z["monetary_value_gbp"]) - F.col(z["recency_days"]))
    falling = labelled.groupBy("cluster_id").agg(value.alias("v")).agg(
        F.sort_array(F.collect_list(F.struct("cluster_id", "v"))).alias("c")
    )
    rises = F.size(F.filter(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.col("c")[i]["v"] > F.col("c")[i - 1]["v"]))
    return labelled.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(own > least + 1e-9).alias("not_nearest"),
    ).withColumn("order_violations", falling.select(rises).scalar())


def _clusters(t: Tables) -> dict[str, DataFrame]:
    """The whole clustering run, once per input folder, from the shared evaluation."""
    key = ("clusters", t.spark.sparkContext.applicationId, t.folder)
    if key not in _BUILT:
        _BUILT[key] = cluster.build_clusters(t.rfm(), HOME, k=_operational_k(t), evaluated=_evaluated(t))
    return _BUILT[key]


_BUILT: dict[tuple, object] = {}


def _evaluated(t: Tables) -> cluster.Evaluation:
    key = ("evaluation", t.spark.sparkContext.applicationId, t.folder)
    if key not in _BUILT:
        cluster.check_input(t.rfm())
        _BUILT[key] = cluster.evaluate(t.vectors())
    return _BUILT[key]


def _operational_k(t: Tables) -> int:
    """The stated k where it is eligible on these tables, else the metric choice."""
    ranked = cluster.select_k(_evaluated(t).frame)
    eligible = [r.k for r in ranked.where("eligible").select("k").collect()]
    return cluster.OPERATIONAL_K if cluster.OPERATIONAL_K in eligible else cluster.metric_optimal_k(ranked)


def _stated_models() -> dict[tuple[int, int], cluster.Fit]:
    """Centres in equal steps along the direction of customer value, shifted a little for each seed."""
    def centres(k: int, i: int):
        steps = [-1.5 + 3 * (j + 0.5) / k + 0.02 * i for j in range(k)]
        return np.array([(-v, v, v) for v in steps])

    return {(k, s): cluster.Fit(centres(k, i), 0.0, 0) for k in cluster.K_VALUES for i, s in enumerate(cluster.SEEDS)}


def k_scores(t: Tables, data: DataFrame | None = None) -> DataFrame:
    """All numbers of an evaluation, and the choice they lead to, under stated centres; ``data`` as ``vectors``, where it is at hand."""
    return rounded(cluster.select_k(cluster.judge(t.vectors() if data is None else data, _stated_models())), 5)


def k_evaluation(t: Tables) -> DataFrame:
    """All candidates with the real gates: what must hold of any evaluation, with the numbers under stated centres beside it."""
    evaluated = _evaluated(t)
    ranked = cluster.select_k(evaluated.frame)
    rows = t.rfm().count()
    usable = (F.col("minimum_cluster_share_pct") >= cluster.MIN_SHARE_PCT) & (F.col("mean_pairwise_ari") >= cluster.MIN_MEAN_ARI)
    falls = F.coalesce(F.col("inertia_reduction_from_previous_k_pct") > 0, F.lit(True))
    stated = k_scores(t, evaluated.data).select(
        "k", *[F.col(c).alias(f"stated_{c}") for c in ("inertia", "silhouette_score", "mean_pairwise_ari", "minimum_cluster_count")]
    )
    # A fit that has settled costs no more than centres that nobody fitted.
    return ranked.join(stated, "k").select(
        "k", "stability_seed_count", "stability_pair_count", "silhouette_distance", "seed",
        falls.alias("inertia_falls"),
        (
            F.col("silhouette_score").between(-1, 1) & F.col("mean_pairwise_ari").between(-1, 1)
            & (F.col("minimum_pairwise_ari") <= F.col("mean_pairwise_ari") + 1e-12)
            & (F.col("davies_bouldin_score") > 0) & (F.col("calinski_harabasz_score") > 0)
        ).alias("scores_in_range"),
        (F.abs(F.col("minimum_cluster_share_pct") - 100.0 * F.col("minimum_cluster_count") / rows) < 1e-9).alias("share_agrees"),
        (F.col("eligible") == usable).alias("gates_agree"),
        (F.col("selection_rank_sum").isNotNull() == F.col("eligible")).alias("only_eligible_ranked"),
        (F.col("inertia") < F.col("stated_inertia")).alias("cheaper_than_stated"),
        *[f"stated_{c}" for c in ("inertia", "silhouette_score", "mean_pairwise_ari", "minimum_cluster_count")],
    )


def k_metrics(t: Tables) -> DataFrame:
    """Calinski-Harabasz, sizes and Rand index of a real labelling against their definitions, as differences."""
    data = t.vectors()
    models = cluster.fit_all(data, [(4, s) for s in cluster.SEEDS[:2]])
    (first, second) = models.values()
    labelled = pin(
        data.withColumns({"a": cluster.nearest(first), "b": cluster.nearest(second)}).select("customer_id", "a", "b", *cluster.SCALED)
    )
    got = cluster.calinski_harabasz(labelled, "a").first()
    ari = cluster.adjusted_rand(labelled, ["a", "b"]).first()["adjusted_rand"]
    # A row per cluster and one per pair of labels come to the driver.
    sums = [f for c in cluster.SCALED for f in (F.sum(c).alias(c), F.sum(F.col(c) * F.col(c)).alias(f"{c}_2"))]
    parts = labelled.groupBy("a").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    k, n = len(parts), sum(r["n"] for r in parts)
    within = sum(r[f"{c}_2"] - r[c] ** 2 / r["n"] for r in parts for c in cluster.SCALED)
    overall = {c: sum(r[c] for r in parts) / n for c in cluster.SCALED}
    between = sum(r["n"] * (r[c] / r["n"] - overall[c]) ** 2 for r in parts for c in cluster.SCALED)
    want = between * (n - k) / (within * (k - 1))
    cells = labelled.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    rights = [sum(r["n"] for r in cells if r["b"] == label) for label in {r["b"] for r in cells}]
    both, left, right = (sum(c * (c - 1) / 2 for c in v) for v in ([r["n"] for r in cells], [r["n"] for r in parts], rights))
    expected = left * right / (n * (n - 1) / 2)
    rand = (both - expected) / ((left + right) / 2 - expected)
    return t.spark.createDataFrame(
        [(n, k, bool(abs(got["calinski_harabasz_score"] / want - 1) < 1e-9), bool(abs(got["inertia"] / within - 1) < 1e-9),
          bool(got["minimum_cluster_count"] == min(r["n"] for r in parts)), bool(abs(ari - rand) < 1e-9))],
        "customers long, clusters int, calinski_harabasz boolean, inertia boolean, smallest boolean, adjusted_rand boolean",
    )


def cluster_gates(t: Tables) -> DataFrame:
    built, k = _clusters(t), _operational_k(t)
    rows = gates.cluster_gates(
        built["customer_clusters"], built["k_evaluation"], built["cluster_profiles"], k, t.rfm().count()
    )
    known = ["customer_count", "missing_clustering_features", "one_assignment_per_customer", "cluster_counts_reconcile",
             "recorded_seed", "monetary_value_reconciliation"]
    # What the other gates measure depends on the fit.
    return rows.select("gate", F.when(F.col("gate").isin(known), F.col("actual").cast("double")).alias("actual"), "passed")


def build_clusters(t: Tables) -> DataFrame:
    """The whole path, with the chosen k: rows of each table it returns, and how they tie up."""
    built, k = _clusters(t), _operational_k(t)
    people, profiles = built["customer_clusters"], built["cluster_profiles"]
    crosstab, evaluation = built["rfm_cluster_comparison"], built["k_evaluation"]
    chosen = evaluation.where("selected").agg(F.count(F.lit(1))).scalar()
    return people.agg(F.count(F.lit(1)).alias("customers"), C.money(F.sum(F.col("monetary_value_gbp").cast("decimal(28,4)"))).alias("value")).withColumns(
        {
            "profiled_customers": profiles.agg(F.sum("customer_count")).scalar(),
            "profiles_are_k": profiles.agg(F.count(F.lit(1))).scalar() == k,
            "crossed_customers": crosstab.agg(F.sum("customer_count")).scalar(),
            "crosstab_is_full": crosstab.agg(F.count(F.lit(1))).scalar() == 8 * k,
            "candidates": evaluation.agg(F.count(F.lit(1))).scalar(),
            "chosen": chosen,
        }
    )


def silhouette(t: Tables) -> DataFrame:
    return rounded(cluster.silhouette_euclidean(t.fixed_clusters(), "cluster_id").drop("error_bound"), 6)


def silhouette_squared(t: Tables) -> DataFrame:
    value = cluster.silhouette_squared(cluster.vectors(t.fixed_clusters()), "cluster_id")
    return rounded(t.spark.createDataFrame([(value,)], "silhouette_score double"), 6)


def calinski_harabasz(t: Tables) -> DataFrame:
    return rounded(cluster.calinski_harabasz(t.fixed_clusters(), "cluster_id"), 5)


def davies_bouldin(t: Tables) -> DataFrame:
    return rounded(cluster.davies_bouldin(t.fixed_clusters(), "cluster_id"), 6)


def adjusted_rand(t: Tables) -> DataFrame:
    return rounded(
        cluster.adjusted_rand(t.fixed_clusters(), ["by_value_4", "by_units_4", "by_orders_4"]), 9
    )


def cluster_profiles(t: Tables) -> DataFrame:
    return rounded(t.cluster_profiles())


def pca_projection(t: Tables) -> DataFrame:
    """Components are defined up to their sign."""
    placed = cluster.pca_projection(t.vectors())
    return rounded(placed.withColumns({f"component_{i}": F.abs(f"component_{i}") for i in (1, 2)}), 5)


# Marts and gates ------------------------------------------------------------


def order_fact(t: Tables) -> DataFrame:
    return marts.order_fact(t.orders())


def dim_customer_mart(t: Tables) -> DataFrame:
    return marts.customer_dimension(t.rfm(), t.labelled_clusters())


def previous_month_revenue(t: Tables) -> DataFrame:
    return measures.time_measures(order_fact(t), marts.returns_month(t.returns()))


def measures_by_slice(t: Tables) -> DataFrame:
    customers = marts.customer_dimension(t.rfm(), t.labelled_clusters(), check=False)
    return measures.measures_by_customer_slice(
        order_fact(t), customers, ["rfm_segment", "is_repeat_customer"]
    )


def measures_by_place(t: Tables) -> DataFrame:
    orders = order_fact(t).withColumn("year", F.year("order_date"))
    return measures.sales_measures(orders, ["year", "country"])


def published_star(t: Tables) -> DataFrame:
    """What was counted while the star tables were written, and their UNIQUE rules."""
    folder = f"{shared_folder(t.spark)}/basketry-published-{uuid.uuid4().hex}"
    found = star.publish_observed(t.canonical(), folder)
    rows = found.row_counts().select("table_name", F.lit("rows").alias("rule"), F.col("row_count").alias("failures"))
    told = pin(rows.unionByName(found.constraint_report()))
    remove(t.spark, folder)
    return told


def measures_any_slice(t: Tables) -> DataFrame:
    """Year x country x segment with all totals, from bitmaps of the finest slices."""
    orders = order_fact(t).withColumn("year", F.year("order_date"))
    customers = t.rfm().select("customer_id", (F.col("frequency_orders") >= 2).alias("is_repeat_customer"), F.col("segment").alias("rfm_segment"))
    slices = t._staged("slices", lambda: measures.slice_table(orders, customers, ["year", "country"], ["rfm_segment"]))
    return measures.measures_from_slices(slices, ["year", "country", "rfm_segment"], totals=True)


def filtered_measures(t: Tables) -> DataFrame:
    """Measures under slicer filters: two nations, the years 1996 to 1998."""
    orders = order_fact(t).withColumn("year", F.year("order_date"))
    chosen = measures.slice_by(orders, {"country": ["NATION_1", "NATION_7"], "year": [1996, 1997, 1998]})
    return measures.sales_measures(chosen, ["country", "year"])


def product_trend(t: Tables) -> DataFrame:
    """Drill-through of two products."""
    trend = measures.monthly_trend(
        marts.product_month(t.sales()), "stock_code", {"stock_code": ["P1", "P7"]}
    )
    return trend.select("stock_code", "month_start", "revenue_gbp", "units_sold")


def country_trend(t: Tables) -> DataFrame:
    """Drill-through of all countries."""
    trend = measures.monthly_trend(marts.country_month(t.sales()), "country")
    return trend.select("country", "month_start", "revenue_gbp", "units_sold")


def customer_detail(t: Tables) -> DataFrame:
    customers = marts.customer_dimension(t.rfm(), t.labelled_clusters(), check=False)
    return measures.customer_detail(order_fact(t), customers)


def product_month_matrix(t: Tables) -> DataFrame:
    return measures.product_month_matrix(marts.product_month(t.sales()))


def minimum_contract(t: Tables) -> DataFrame:
    """Failures of all lines, and of the returns alone as if they were one batch."""
    first = clean.contract_failures(clean.classify(t.lines()))
    lone = clean.classify(t.lines().where(F.col("invoice_no").startswith("C")))
    second = clean.contract_failures(lone.withColumn("load_seq", F.lit(0).cast(LOAD_SEQ)))
    return first.withColumn("scope", F.lit("all_lines")).unionByName(
        second.withColumn("scope", F.lit("returns_as_one_batch"))
    )


def customer_gates(t: Tables) -> DataFrame:
    return rounded(
        gates.customer_gates(t.rfm(), rfm.segment_summary(t.rfm()), t.cohorts()), 4
    )


def stat_gates(t: Tables) -> DataFrame:
    return rounded(gates.stat_gates(t.rfm(), t.orders()), 4)


def mart_gates(t: Tables) -> DataFrame:
    tables = t.marts()
    return rounded(gates.mart_gates(tables), 4)


QUERIES = {
    "scan_union_batches": scan_union_batches,
    "alias_columns": alias_columns,
    "picked_columns": picked_columns,
    "scan_files": scan_files,
    "json_roundtrip": json_roundtrip,
    "export_sizes": export_sizes,
    "small_n_scores": small_n_scores,
    "filtered_measures": filtered_measures,
    "product_trend": product_trend,
    "country_trend": country_trend,
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "partition_datasets": partition_datasets,
    "named_query_batch": named_query_batch,
    "query_manifest": query_manifest,
    "star_row_counts": lambda t: star.row_counts(t.star()),
    "standardize": standardize,
    "coerce_types": coerce_types,
    "clean_id": clean_id,
    "clean_numeric": clean_numeric,
    "classify_lines": classify_lines,
    "exclusion_reasons": exclusion_reasons,
    "date_features": date_features,
    "month_marts": month_marts,
    "scalar_math": scalar_math,
    "effect_magnitude": effect_magnitude,
    "identified_sales": identified_sales,
    "dedup_exact": dedup_exact,
    "raw_profile": raw_profile,
    "missing_values": missing_values,
    "line_ids": line_ids,
    "latest_description": lambda t: eda.latest_descriptions(t.canonical()),
    "global_row_number": global_row_number,
    "avg_rank": avg_rank,
    "holm_adjust": holm_adjust,
    "k_selection": k_selection,
    "top_n_by": top_n_by,
    "executive_kpis": named("executive_kpis"),
    "monthly_revenue_growth": named("monthly_revenue_growth"),
    "country_performance": named("country_performance"),
    "top_products": named("top_products"),
    "top_customers": named("top_customers"),
    "repeat_customer_rate": named("repeat_customer_rate"),
    "product_returns": named("product_returns"),
    "customer_revenue_deciles": named("customer_revenue_deciles"),
    "outlier_profile": named("outlier_profile"),
    "foreign_key_resolution": named("foreign_key_resolution"),
    "partition_reconciliation": named("partition_reconciliation"),
    "sales_value_reconciliation": named("sales_value_reconciliation"),
    "returns_value_reconciliation": named("returns_value_reconciliation"),
    "order_summary": lambda t: eda.order_summary(t.sales()).drop("order_value"),
    "customer_summary": lambda t: eda.customer_summary(t.sales()).drop("revenue"),
    "monthly_performance": monthly_performance,
    "complete_months": complete_months,
    "country_share": lambda t: eda.country_share(t.sales()),
    "product_performance": lambda t: eda.product_performance(t.sales()),
    "return_product_performance": lambda t: eda.return_product_performance(t.returns()),
    "weekday_performance": lambda t: eda.weekday_performance(t.sales()),
    "hourly_performance": hourly_performance,
    "revenue_deciles_qcut": lambda t: eda.revenue_deciles_qcut(t.customers()),
    "eda_summary": lambda t: t.summary(),
    "outlier_thresholds": outlier_thresholds,
    "outlier_flags": outlier_flags,
    "cleaning_summary": cleaning_summary,
    "order_value_percentiles": order_value_percentiles,
    "rfm_describe": rfm_describe,
    "order_value_histogram": order_value_histogram,
    "rfm_histograms": rfm_histograms,
    "customer_value_histogram": customer_value_histogram,
    "box_summary": box_summary,
    "revenue_splits": lambda t: eda.revenue_splits(t.sales()),
    "dim_date": lambda t: star.dim_date(t.canonical()),
    "dim_product": lambda t: star.dim_product(t.canonical()),
    "dim_customer": lambda t: star.dim_customer(t.canonical()),
    "dim_country": lambda t: star.dim_country(t.canonical()),
    "fact_keys": lambda t: star.with_keys(t.canonical(), t.dims()).select(
        "transaction_line_id", "date_key", "product_key", "customer_key", "country_key"
    ),
    "fact_sales": lambda t: doubles(star.fact_sales(t.canonical(), t.dims())),
    "fact_returns": lambda t: doubles(star.fact_returns(t.canonical(), t.dims())),
    "audit_exclusions": lambda t: doubles(star.audit_exclusions(t.canonical())),
    "published_star": published_star,
    "constraint_report": lambda t: star.constraint_report(t.star()),
    "rfm_features": lambda t: rfm.rfm_features(t.identified()),
    "rfm_scores": rfm_scores,
    "rfm_segments": rfm_segments,
    "segment_summary": lambda t: rounded(rfm.segment_summary(t.rfm())),
    "segment_action_plan": lambda t: rfm.segment_action_plan(t.rfm()),
    "customer_summary_stats": lambda t: rfm.customer_summary_stats(t.identified(), t.rfm()),
    "cohort_long": lambda t: cohort.cohort_long(t.identified()),
    "cohort_counts_wide": cohort_wide("active_customers"),
    "cohort_retention_wide": cohort_wide("retention_pct"),
    "cohort_metadata": lambda t: cohort.cohort_metadata(t.cohorts()),
    "customer_flow": lambda t: cohort.customer_flow(t.identified()),
    "retention_curve": lambda t: cohort.retention_curve(t.cohorts()),
    "geo_repeat_rate": lambda t: rounded(stats.geo_repeat_rate(t.rfm(), HOME)),
    "spearman_pairs": spearman_pairs,
    "correlation_matrix": correlation_matrix,
    "correlation_tests": correlation_tests,
    "strongest_correlations": strongest_correlations,
    "mann_whitney": mann_whitney,
    "contingency": contingency,
    "chi_square": chi_square,
    "hypothesis_tests": hypothesis_tests,
    "group_summaries": group_summaries,
    "input_contract": lambda t: cluster.input_contract(t.rfm()),
    "scaled_features": scaled_features,
    "kmeans_assign": kmeans_assign,
    "k_evaluation": k_evaluation,
    "k_metrics": k_metrics,
    "k_scores": k_scores,
    "build_clusters": build_clusters,
    "statistical_summary": statistical_summary,
    "silhouette": silhouette,
    "silhouette_squared": silhouette_squared,
    "calinski_harabasz": calinski_harabasz,
    "davies_bouldin": davies_bouldin,
    "adjusted_rand": adjusted_rand,
    "dominant_segment": lambda t: cluster.dominant_segment(t.fixed_clusters()),
    "cluster_profiles": cluster_profiles,
    "cluster_labels": lambda t: cluster.cluster_labels(t.cluster_profiles()),
    "segment_cluster_crosstab": lambda t: cluster.segment_cluster_crosstab(t.fixed_clusters()),
    "pca_projection": pca_projection,
    "calendar": lambda t: marts.calendar(t.sales()),
    "order_fact": order_fact,
    "dim_customer_mart": dim_customer_mart,
    "product_month": lambda t: marts.product_month(t.sales()),
    "country_month": lambda t: marts.country_month(t.sales()),
    "returns_month": lambda t: marts.returns_month(t.returns()),
    "segment_mart": lambda t: rounded(marts.segment_mart(t.rfm())),
    "cluster_mart": lambda t: rounded(t.marts()["cluster_summary"]),
    "kpi_snapshot": lambda t: marts.kpi_snapshot(t.summary()),
    "previous_month_revenue": previous_month_revenue,
    "measures_by_slice": measures_by_slice,
    "measures_by_place": measures_by_place,
    "measures_any_slice": measures_any_slice,
    "customer_detail": customer_detail,
    "product_month_matrix": product_month_matrix,
    "minimum_contract": minimum_contract,
    "customer_gates": customer_gates,
    "stat_gates": stat_gates,
    "cluster_gates": cluster_gates,
    "mart_gates": mart_gates,
}


def registered():
    def bind(build):
        return lambda spark, folder: doubles(build(Tables(spark, folder.rstrip("/"))))

    return {name: bind(build) for name, build in QUERIES.items()}
