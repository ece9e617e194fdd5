"""Conversation repair, quality scores and spelling variants against plain restatements."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import quality, spelling, turns
from basketry.llm.shared import utf8_chunks
from tests.llm import brute
from tests.llm.conftest import prose, rows_of

TURNS = "conv_id long, turn long, role string, text string"


# Conversations --------------------------------------------------------------------


def _fault_codes(said):
    return [{"b": turns.BLANK, "d": turns.DUPLICATE, "t": turns.TRUNCATED, "": 0}[f] for f in brute.row_faults(said)]


def test_repairs_are_the_least_of_all():
    rng = random.Random(1)
    for _ in range(150):
        said = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "cut", " "])) for _ in range(rng.randint(0, 3))]
        rows = [(*s, f) for s, f in zip(said, _fault_codes(said))]
        cost, audit = turns.whole(rows)
        want = min(brute.all_repairs(said))
        assert (cost, audit) == want[:2]
        assert [f"{t['role']}:{t['text']}" for t in turns.apply(rows, audit)] == want[2]
        assert brute.repair(said) == want


def test_reductions_leave_four_stacks():
    for text, end in (("", 0), ("s", 1), ("u", 2), ("su", 2), ("ua", 3), ("sua", 3), ("uau", 2), ("suaua", 3)):
        node = turns.EMPTY
        for symbol in text:
            node = turns.push(node, symbol)
        assert node == turns.STACKS[end]
    assert turns.push(turns.EMPTY, "a") is None and turns.push(turns.STACKS[3], "s") is None


@pytest.fixture(scope="module")
def talks():
    """Short conversations with nulls and equal turns, and one that is longer than a segment and a partition."""
    rng = random.Random(4)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((conv or None, rng.choice([turn, turn, None, max(0, turn - 1)]), role, rng.choice(["Hi.", "ok", "yes!", "  ", "", None, "a. \n"])))
    roles = ["user", "assistant", "user", "assistant", "system", "x"]
    rows += [(-7, t, rng.choice(roles), rng.choice(["a.", "b?", f"{t}!", f"{t}", ""])) for t in range(900)]
    rows += [(500, 5, "user", "same.")] * 40  # repeated rows of one turn
    rows.append((501, 0, "user", "long. " * 20_000))
    return rows


@pytest.mark.parametrize("segment", [3, 64, 4096])
def test_conversations(spark, talks, segment, monkeypatch):
    monkeypatch.setattr(turns.Repair.__init__, "__defaults__", (*turns.Repair.__init__.__defaults__[:-1], segment))
    df = spark.createDataFrame(talks, TURNS).repartition(5)
    got = rows_of(turns.repaired_conversations(df, turns.damaged(df)))
    assert got == sorted(brute.conversations(talks), key=repr)


def test_conversations_with_clashing_columns(spark, talks):
    names = ("conv", "row", "fault", "said", "place", "part", "segment", "cost", "audit", "col", "first")
    df = spark.createDataFrame(talks[:400], TURNS).withColumns({n: F.lit("x") for n in names})
    got = rows_of(turns.repaired_conversations(df, turns.damaged(df)))
    assert got == sorted(brute.conversations(talks[:400]), key=repr)


def test_pieces_hold_the_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "cut")]
    pieces = turns.Repair(spark.createDataFrame(rows, TURNS)).pieces().orderBy("conv", "part", "segment").collect()
    by_conv = {}
    for p in pieces:
        by_conv.setdefault(p.conv, []).extend(tuple(t) for t in p.turns)
    assert by_conv == {"=1": [("K", "user", "a."), ("R", "assistant", "b.")], "=2": []}


def test_no_conversations(spark):
    df = spark.createDataFrame([], TURNS)
    assert turns.repaired_conversations(df, turns.damaged(df)).count() == 0
    one = spark.createDataFrame([(3, 1, "user", "a.")], TURNS)
    assert rows_of(turns.repaired_conversations(one, df)) == [(3, 0, 0, 0, 0, 0, 0, "", brute.hashlib.sha256().hexdigest())]


# Quality --------------------------------------------------------------------------


def _arrays(texts):
    (_, data, offsets), *rest = utf8_chunks(pa.array(texts, pa.string()))
    assert not rest
    return quality.vectors(data, offsets)


def _shape(word):
    out = ""
    for c in word:
        kind = "a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else c
        out += "" if out.endswith(kind) else kind
    return out


def _gram_counts(text):
    words = brute.words(text)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    shapes = [("=",) if i and low[i] == low[i - 1] else _shape(w) for i, w in enumerate(words)]
    count = Counter()
    for tag, (row, longest) in enumerate(((low, quality.WORD_GRAMS), (shapes, quality.SHAPE_GRAMS))):
        for n in range(1, longest + 1):
            count.update((tag, tuple(row[i : i + n])) for i in range(len(row) - n + 1))
    return count


def test_vectors_count_the_grams():
    texts = [prose(3, 80), "WAS!! was!! in%% | x1 | Ünd the the the", "", "oak", " \n"]
    bounds, places, values = _arrays(texts)
    for i, text in enumerate(texts):
        count = _gram_counts(text)
        own = np.sort(values[bounds[i] : bounds[i + 1] - 2])
        want = np.sort(np.sqrt(np.array(list(count.values()), dtype=float)))
        assert np.allclose(own, want / (np.linalg.norm(want) or 1))  # no two grams of these texts share a place
        assert list(values[bounds[i + 1] - 2 : bounds[i + 1]]) == [1, 1]
        alone = _arrays([text])  # counted densely
        assert np.allclose(alone[2], values[bounds[i] : bounds[i + 1]])
        assert (alone[1] == places[bounds[i] : bounds[i + 1]]).all()


def test_updates_follow_the_leader():
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(2)), np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    z, n, w = [0.0] * 30, [0.0] * 30, [0.0] * 30

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for y, at, x in rows:
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip(at, x))))
            for i, v in zip(at, x):
                g, w[i] = (p - y) * v, weight(i)
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(quality.fit(rows, epochs=2)[:30], [weight(i) for i in range(30)])


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    told = quality.judged(docs, labels).join(labels, "doc_id").filter("held_out")
    right = {r.quality: (r.kept, r.n) for r in told.groupBy("quality").agg(F.sum("predicted").alias("kept"), F.count("*").alias("n")).collect()}
    assert right[1][0] >= 0.99 * right[1][1] and right[0][0] <= 0.05 * right[0][1]


def test_quality_of_awkward_rows(spark, docs, clashing, none, cases):
    labels = spark.createDataFrame(
        [(c[0], int(n % 3 > 0), 0) for n, c in enumerate(cases)] + [(1, None, 0), (2, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int"
    )
    for df in (docs, clashing):
        got = quality.judged(df, labels).collect()
        assert len(got) == len(cases) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert all(not r.held_out for r in got if r.doc_id is None)
        by_text = {}
        for r in quality.score(df.withColumn("copy", F.col("text")), quality.train(df, labels)).select("copy", "score").collect():
            assert by_text.setdefault(r["copy"] or "", r["score"]) == r["score"]
    assert quality.judged(none, labels).count() == 0
    assert {r.score for r in quality.judged(docs, labels.limit(0)).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert all(r.score > 0.5 for r in quality.judged(docs, ones).collect())


def test_training_is_bounded_and_repeatable(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality").dropDuplicates()
    few, again = (quality.train(docs, labels, most=5) for _ in range(2))
    assert (few.places == again.places).all() and (few.weights == again.weights).all()
    assert len(few.places) < len(quality.train(docs, labels).places)


# Spelling -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spelled():
    """Words of few letters in many variants, anagrams, accents, long runs, nulls and repeated rows."""
    rng = random.Random(9)
    rows = [(None, "Spelling spelling speling spellinq"), (1, None), (2, ""), (3, " \t1234 -"), (4, "x" * 3000), (5, "x" * 2999), (5, "x" * 2999)]
    stems = ["spelling", "spruce", "larchwood", "élèvement", "abcabc", "maples"]
    for i in range(6, 260):
        words = []
        for _ in range(12):
            w = list(rng.choice(stems))
            edit, at = rng.randrange(8), rng.randrange(len(w))
            if edit == 0:
                del w[at]
            elif edit == 1:
                w[at] = rng.choice("abeé")
            elif edit == 2:
                w.insert(at, rng.choice("abe"))
            elif edit == 3:
                rng.shuffle(w)
            words.append("".join(w))
        rows.append((i, "".join(w + rng.choice([" ", ", ", "\n", "1", "œ"]) for w in words)))
    return rows + [(6, rows[-1][1])] * 5 + [(1000 + i, "x" * 3000 + " " + "x" * 3001) for i in range(6)]


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_variants(spark, spelled, bucket, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (bucket,))
    df = spark.createDataFrame(spelled, "doc_id long, text string")
    want = sorted(brute.variants(spelled), key=repr)
    assert rows_of(spelling.spelling_variants(df)) == want
    assert sum(w[1] is not None for w in want) > 20


def test_longer_chains(spark):
    counts = {"aaaaaa": 1, "aaaaab": 7, "aaaabb": 40, "aaabbb": 300, "aabbbb": 2000, "zzzzzz": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(words).collect()}
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    assert got == {a: (b, "aabbbb") for a, b in zip(chain, chain[1:])} | {"aabbbb": (None, "aabbbb"), "zzzzzz": (None, "zzzzzz")}


def test_variants_of_the_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(spelling.spelling_variants(docs)) == sorted(brute.variants(rows), key=repr)


def test_near_words_share_a_signature():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 14)))
        at, letter = rng.randrange(len(word)), rng.choice("abcdefg")
        for other in (word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]):
            if other != word and other:
                a, b = spelling.signatures([word, other])
                assert set(a) & set(b)


def test_no_words(spark, none, docs, clashing):
    assert spelling.spelling_variants(none).count() == 0
    assert rows_of(spelling.spelling_variants(docs)) == rows_of(spelling.spelling_variants(clashing))
    assert re.fullmatch(f"{spelling.LETTERS}+".replace("\\u00C0-\\u00FF", "À-ÿ"), "Azé")
