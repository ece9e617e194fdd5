"""Publishing sets of tables, and what readers see of it."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry import run
from basketry.plans import clean, gates, star
from basketry.sources import scan, sinks, versions


def put(spark, root, n, tables=("a", "b")):
    version = versions.begin(spark, root)
    for t in tables:
        sinks.write_parquet(spark.range(n), version.path(t))
    return versions.publish(spark, version, {t: {"rows": n} for t in tables})


def folders(root):
    return sorted(p.name for p in root.iterdir() if p.name[0] == "v")


def test_a_reader_finishes_on_the_version_it_opened(spark, tmp_path):
    root = str(tmp_path)
    assert versions.latest(spark, root) is None
    put(spark, root, 10)
    opened = versions.latest(spark, root).read(spark, "a")
    put(spark, root, 20)
    assert opened.count() == 10
    newest = versions.latest(spark, root)
    assert newest.number == 2 and newest.read(spark, "b").count() == 20
    assert newest.tables["a"]["rows"] == 20 and newest.tables["a"]["files"] > 0 and newest.tables["a"]["bytes"] > 0


def test_old_versions_go(spark, tmp_path):
    for n in range(1, 6):
        put(spark, str(tmp_path), n)
    assert len(folders(tmp_path)) == versions.KEEP
    assert versions.latest(spark, str(tmp_path)).read(spark, "a").count() == 5
    versions.expire(spark, str(tmp_path), keep=0)
    assert len(folders(tmp_path)) == 1 and versions.latest(spark, str(tmp_path)).number == 5


@pytest.mark.parametrize("step", ["write", "manifest", "rename", "expire"])
def test_a_failure_leaves_one_whole_version(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    for n in (1, 2):
        put(spark, root, n)

    def fail(*args, **kwargs):
        raise OSError(step)

    if step == "rename":
        # The manifest has been written aside but not put in place.
        whole = versions._write_text

        def half(spark, path, text):
            aside = path.rsplit("/", 1)
            whole(spark, f"{aside[0]}/_{aside[1]}", text[: len(text) // 2])
            raise OSError(step)

        monkeypatch.setattr(versions, "_write_text", half)
    else:
        where = {"write": (sinks, "write_parquet"), "manifest": (versions, "_write_text"), "expire": (versions, "expire")}[step]
        monkeypatch.setattr(*where, fail)
    with pytest.raises(OSError):
        put(spark, root, 3)
    monkeypatch.undo()
    seen = versions.latest(spark, root)
    n = 3 if step == "expire" else 2
    assert [seen.read(spark, t).count() for t in ("a", "b")] == [n, n]
    put(spark, root, 4)
    assert versions.latest(spark, root).read(spark, "a").count() == 4


def test_a_version_without_all_its_tables_is_not_published(spark, tmp_path):
    put(spark, str(tmp_path), 1)
    version = versions.begin(spark, str(tmp_path))
    sinks.write_parquet(spark.range(2), version.path("a"))
    with pytest.raises(Exception):
        versions.publish(spark, version, {"a": {}, "b": {}})
    versions.discard(spark, version)
    assert versions.latest(spark, str(tmp_path)).number == 1 and len(folders(tmp_path)) == 1


def test_two_publishers_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    one, other = versions.begin(spark, root), versions.begin(spark, root)
    for version, n in ((one, 5), (other, 6)):
        sinks.write_parquet(spark.range(n), version.path("a"))
        versions.publish(spark, version, {"a": {"rows": n}})
    seen = versions.latest(spark, root)
    assert seen.read(spark, "a").count() == seen.tables["a"]["rows"]
    assert put(spark, root, 7).number == 2


def test_counts_are_taken_while_writing(spark, raw, tmp_path):
    lines = clean.canonical_table(scan.union_batches({"s1": raw}), ["s1"])
    found = star.publish_observed(lines, str(tmp_path / "star"))
    again = {(r["table_name"], r["rule"]): r["failures"] for r in star.constraint_report(found.tables).collect()}
    assert {(r["table_name"], r["rule"]): r["failures"] for r in found.constraint_report().collect()} == again
    assert {r["table_name"]: r["row_count"] for r in star.row_counts(found.tables).collect()} == found.rows
    # Rows and rules need no second read: only the columns of UNIQUE rules are scanned.
    plan = found.constraint_report()._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("," not in columns for columns in read)


def test_broken_rules_keep_the_version_before(spark, raw, tmp_path, monkeypatch):
    lines = clean.canonical_table(scan.union_batches({"s1": raw}), ["s1"])
    out = str(tmp_path)
    before = run.star_stage(spark, lines, out)
    assert before["fact_sales"].count() == 2
    monkeypatch.setitem(star._CHECKS["fact_sales"], "quantity_positive", "quantity > 1000")
    with pytest.raises(RuntimeError, match="quantity_positive"):
        run.star_stage(spark, lines, out)
    assert versions.latest(spark, f"{out}/star").number == 1 and len(folders(tmp_path / "star")) == 1
    assert before["fact_sales"].count() == 2


def test_totals_from_the_write_give_the_same_gates(spark, tables, tmp_path):
    built = {n: df for n, df in tables.marts().items()}
    observed = {}
    for name, metrics in gates.mart_totals().items():
        observed[name] = star.write_observed(built[name], metrics, lambda d: sinks.write_parquet(d, str(tmp_path / name)))
    read, taken = gates.mart_gates(built), gates.mart_gates(built, None, observed)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, taken.collect()))
    wrong = {**observed, "fact_product_month": {**observed["fact_product_month"], "units": Decimal(0)}}
    failed = gates.mart_gates(built, None, wrong).where(~F.col("passed"))
    assert [r["gate"] for r in failed.collect()] == ["product_units_reconcile"]
