"""Registered text queries against their SQL, and the pipeline stage by stage against plain restatements."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from basketry.llm.queries import QUERIES
from basketry.llm.sql import ORACLE
from checks.compare import difference
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "labels", "benchmark", "conversations")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, df.collect(), con.execute(ORACLE[name])) is None


def test_result_columns(spark):
    """Columns and rows that the queries without SQL return."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    toxic = QUERIES["op2_toxicity"](spark, FOLDER)
    assert toxic.columns == ["doc_id", "held_out", "score", "predicted"] and toxic.count() == docs
    mixed = QUERIES["op8_source_mixing"](spark, FOLDER)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"] and mixed.count() == docs
    scored = QUERIES["op10_pseudo_likelihood"](spark, FOLDER)
    assert scored.count() == docs and scored.filter("n_words > 0 and not per_word < 0").count() == 0
    near = QUERIES["op4_learned_partitions"](spark, FOLDER)
    assert near.columns == ["query_id", "rank", "vec_id", "score"]
    packed = QUERIES["op1_best_fit_packing"](spark, FOLDER).collect()
    assert len({r.doc_id for r in packed}) == docs


def test_stages(spark):
    """Each stage on all that its predecessor kept."""
    start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "source_mixing", "packing"]

    clean = stages["toxicity"](spark, start, FOLDER).cache()
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == start.columns and kept <= {r.doc_id for r in start.collect()}
    ordinary = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in ordinary) >= 0.95 * len(ordinary)

    single = stages["near_duplicates"](spark, clean, FOLDER).cache()
    groups = brute.components([(r.doc_id, r.text) for r in clean.collect()], 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    assert single.columns == start.columns

    cut = stages["substring_dedup"](spark, single, FOLDER).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {i: (n, sha) for i, _, n, sha in brute.repeats(rows)}
    before = dict(rows)
    for r in cut.collect():
        removed, sha = want[r.doc_id]
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (removed == 0) or not before[r.doc_id]
        assert sha == brute.hashlib.sha256(" ".join(brute.words(r.text)).encode()).hexdigest()
    assert cut.columns == start.columns and cut.count() == single.count()

    mixed = stages["source_mixing"](spark, cut, FOLDER).cache()
    sizes, words = defaultdict(int), defaultdict(int)
    for r in cut.collect():
        sizes[r.source] += len(brute.words(r.text))
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in mixed.collect():
        words[r.source] += len(brute.words(r.text))
    goal = brute.targets(sizes, brute.cycle_weights(sizes), sum(sizes.values()))
    longest = max(len(brute.words(r.text)) for r in cut.collect())
    assert max(copies.values()) <= 3 and all(abs(words[s] - goal[s]) <= longest for s in sizes)
    assert mixed.columns == start.columns

    bins = stages["packing"](spark, mixed, FOLDER).collect()
    total = Counter()
    for r in bins:
        total[r.doc_id] += r.n_words
    texts = {r.doc_id: len(brute.words(r.text)) for r in mixed.collect()}
    assert set(total) == set(copies) and all(total[i] == texts[i] * n for i, n in copies.items())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "bin_id", "bin_offset"} <= set(out.columns) and out.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_stages_on_awkward_rows(spark, clashing):
    """Nulls, empty and long texts, repeated rows and columns named like the stages' own."""
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.count() > 0
        assert name == "packing" or docs.columns == clashing.columns
