import pytest
from pyspark.sql import functions as F

from basketry.operators.dedup import drop_exact_copies
from basketry.plans import clean
from basketry.schema import BATCH_STEP, header_map, pick_column
from basketry.sources import named_sql, scan, sinks


def test_header_spellings_map_to_canonical_names():
    found = header_map(["Invoice No", "Stock_Code", "DESCRIPTION", "quantity", "InvoiceDate", "Unit Price", "Customer ID", "Country", "x"])
    assert found["Unit Price"] == "unit_price" and found["Customer ID"] == "customer_id" and "x" not in found
    with pytest.raises(ValueError, match="country"):
        header_map(["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID"])


def test_pick_column_ignores_case(raw):
    assert pick_column(raw, ["revenue", "price"]) == "Price"
    assert pick_column(raw, ["revenue"]) is None


def test_lines_are_standardised_and_classified(raw):
    lines = clean.enrich(clean.classify(scan.union_batches({"s1": raw})))
    rows = {r["invoice_no"]: r for r in lines.collect()}
    first = rows["100001"]
    assert first["description"] == "Blue Mug" and first["customer_id"] == "12345"
    assert float(first["line_revenue"]) == 10.0 and first["hour"] == 10
    order = ["100001", "C100002", "100003", "100004"]
    assert [rows[i]["is_completed_sale"] for i in order] == [True, False, False, True]
    assert [rows[i]["is_return"] for i in order] == [False, True, False, False]
    assert rows["100003"]["exclusion_reason"] == "non_positive_price"
    assert rows["100003"]["has_customer_id"] is False


def test_bad_values_become_null(spark, raw):
    bad = raw.limit(1).withColumn("Quantity", F.lit("many")).withColumn("Price", F.lit("free")).withColumn("InvoiceDate", F.lit("soon"))
    row = clean.classify(scan.union_batches({"b": bad})).first()
    assert (row["quantity"], row["unit_price"], row["invoice_date"]) == (None, None, None)
    assert row["is_return"] is False and row["is_completed_sale"] is False


def test_exclusion_precedence(spark):
    rows = [(None, 0, 0.0), ("1", 0, 0.0), ("1", 5, 0.0), ("1", 5, None), ("1", 5, 2.0), ("C1", 5, 2.0)]
    df = spark.createDataFrame(rows, "invoice_no string, quantity int, unit_price double").selectExpr(
        "*", "cast(null as string) customer_id", "timestamp '2010-01-01' invoice_date")
    got = [r["exclusion_reason"] for r in clean.enrich(clean.classify(df)).collect()]
    assert got == ["missing_invoice", "non_positive_quantity", "non_positive_price", "other_invalid_non_sale", None, None]


def test_two_copies_of_a_batch_deduplicate_to_the_first(raw):
    both = scan.union_batches({"one": raw, "two": raw})
    profile = clean.raw_profile(both, ["one", "two"]).first()
    assert (profile["total"], profile["duplicates_within_batch"], profile["duplicates_across_batches"]) == (8, 0, 4)
    assert profile["source_batches"] == "one,two" and profile["invoices"] == 4 and profile["customers"] == 1
    table = clean.canonical_table(both, ["one", "two"])
    assert {r["source_batch"] for r in table.collect()} == {"one"}
    assert sorted(r["transaction_line_id"] for r in table.collect()) == [1, 2, 3, 4]
    sizes = {n: df.count() for n, df in sinks.datasets(table).items()}
    assert sizes == {"completed_sales": 2, "returns": 1, "excluded_records": 1, "customer_sales": 2, "anonymous_sales": 0}
    summary = clean.cleaning_summary(both, table).first()
    assert summary["exact_duplicates_removed"] == 4 and summary["matches_unique_rows"]
    assert clean.contract_failures(clean.classify(both)).count() == 0


def test_a_bad_batch_fails_with_its_name(raw):
    with pytest.raises(ValueError, match="second"):
        scan.union_batches({"first": raw, "second": raw.drop("Country")})
    with pytest.raises(ValueError):
        scan.union_batches({})


def test_contract_names_every_failure(raw):
    lines = clean.classify(scan.union_batches({"s": raw}))
    assert [r[0] for r in clean.contract_failures(lines).collect()] == ["too_few_batches"]
    empty = {r[0] for r in clean.contract_failures(lines.limit(0)).collect()}
    assert {"no_rows", "no_completed_sales", "no_invoice_numbers"} <= empty


def test_csv_batches_round_trip(spark, raw, tmp_path):
    sinks.write_csv(raw, str(tmp_path / "a"))
    lines = scan.scan_batches(spark, {"a": str(tmp_path / "a")})
    assert lines.count() == 4 and lines.agg(F.sum("quantity")).first()[0] == 5


def test_json_summary_and_size_gate(spark, raw, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_json_summary(raw.agg(F.count(F.lit(1)).alias("n")), path)
    assert scan.read_json_summary(spark, path).first()["n"] == 4
    rows = sinks.size_report(spark, {"s": path, "t": path}).collect()
    total = [r for r in rows if r["table"] == "total"][0]["bytes"]
    assert all(r["passed"] for r in rows) and total == sum(r["bytes"] for r in rows if r["file"]) > 0
    limited = sinks.size_report(spark, {"s": path}, limit=1).where("file is not null")
    assert limited.where("passed").count() == 0 and limited.count() >= 1


def test_a_folder_is_swapped_in_and_the_old_one_survives_a_failure(spark, raw, tmp_path):
    fresh, final = str(tmp_path / "fresh"), str(tmp_path / "final")
    for n in (1, 2):
        sinks.write_json_summary(raw.limit(n), fresh)
        sinks.swap_in(spark, fresh, final)
        assert spark.read.json(final).count() == n
    with pytest.raises(Exception):
        sinks.swap_in(spark, str(tmp_path / "missing"), final)
    assert spark.read.json(final).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["final"]


def test_fractions_large_numbers_and_many_digits_survive(raw):
    rows = raw.where("Quantity = '1'").withColumn("Quantity", F.explode(F.array(*map(F.lit, ["1.5", "3000000000", "2e3"]))))
    rows = rows.withColumn("Price", F.explode(F.array(*map(F.lit, ["1.234561", "1.234562"]))))
    lines = scan.union_batches({"b": rows})
    got = sorted((float(r["quantity"]), float(r["unit_price"])) for r in lines.collect())
    assert got == [(q, p) for q in (1.5, 2000.0, 3e9) for p in (1.234561, 1.234562)]
    unique = clean.classify(drop_exact_copies(lines))
    assert unique.count() == 6
    revenue = {str(r["line_revenue"]) for r in unique.collect()}
    assert {"1.8518415", "1.8518430"} <= revenue


def test_dates_in_stated_formats(raw):
    dated = raw.withColumn("InvoiceDate", F.lit("12/1/2009 7:45"))
    assert scan.union_batches({"b": dated}).where("invoice_date is not null").count() == 0
    read = scan.union_batches({"b": dated}, date_formats={"b": ["M/d/yyyy H:mm"]})
    assert {str(r["invoice_date"]) for r in read.collect()} == {"2009-12-01 07:45:00"}


def test_line_ids_do_not_depend_on_the_splits(spark, tmp_path):
    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    folder = tmp_path / "b"
    folder.mkdir()
    for name, first, n in (("part-b.csv", 5000, 3000), ("part-a.csv", 100, 200)):
        lines = "".join(f"{first + i},S{i},text {i},1,2010-01-01 10:00,2.5,7,X\n" for i in range(n))
        (folder / name).write_text(header + lines)
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = scan.scan_batches(spark, {"one": str(folder), "two": str(folder)})
            seen.append({(int(r["load_seq"]) // BATCH_STEP, int(r["load_seq"]) % BATCH_STEP): r["invoice_no"] for r in lines.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
    # File names decide, then the place in the file.
    assert [seen[0][0, i] for i in (0, 199, 200, 3199)] == ["100", "299", "5000", "7999"]
    assert len(seen[0]) == 6400 and seen[0][1, 0] == "100"


def test_named_statements(spark, tmp_path):
    file = tmp_path / "q.sql"
    file.write_text("-- about\n-- name: first_query\nSELECT 1 AS a;\n\n-- name: second_query\nSELECT 2 AS b\n")
    assert [n for n, _ in named_sql.named_statements(file)] == ["first_query", "second_query"]
    results = named_sql.run_named(spark, [file])
    assert results["second_query"].first()["b"] == 2
    listed = {r["query"]: (r["row_count"], r["column_list"]) for r in named_sql.manifest(spark, results).collect()}
    assert listed["first_query"] == (1, "a")
    with pytest.raises(ValueError, match="Duplicate"):
        named_sql.run_named(spark, [file, file])
    file.write_text("-- name: empty\n\n-- name: other\nSELECT 1")
    with pytest.raises(ValueError, match="empty"):
        named_sql.named_statements(file)
    file.write_text("SELECT 1")
    with pytest.raises(ValueError, match="markers"):
        named_sql.named_statements(file)
