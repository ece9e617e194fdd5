"""Quality rules, substring removal, near-duplicates, packing and mixing on awkward rows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from basketry.llm import fmindex, graph, mixing, neardup, packing, rules, substrings
from basketry.llm.minmax import band_hashes, min_max
from tests.llm import brute
from tests.llm.conftest import prose, rows_of


# Quality rules --------------------------------------------------------------------


def test_ledger_measures(docs, clashing, cases):
    want = sorted(((c[0], *brute.measures(c[1])) for c in cases), key=repr)
    assert rows_of(rules.ledger(docs).select("doc_id", *rules.MEASURES)) == want
    assert rows_of(rules.ledger(clashing).select("doc_id", *rules.MEASURES)) == want


def test_failure_bits_follow_the_rules(docs):
    book = rules.ledger(docs)
    for i, rule in enumerate(rules.RULES):
        assert book.filter(f"(failures & {1 << i}) != 0").count() == book.filter(rule.fails).count()


def test_ablations_against_the_ledger(docs, none):
    book = rules.ledger(docs)
    policy = rules.POLICIES["v2"]
    kept = lambda names: book.filter(~rules.failed(book["failures"], names)).count()
    for r in rules.ablations(book, policy).collect():
        rest = [n for n in policy if n != r.rule]
        assert r.kept_without == kept(rest)
        assert r.alone == kept(rest) - kept(policy)
        assert r.failed == book.count() - kept([r.rule])
    assert {r.failed for r in rules.ablations(rules.ledger(none), policy).collect()} == {0}
    assert rules.ablations(book, []).count() == 0


def test_rows_of_one_key_with_unlike_texts_are_judged_apart(spark):
    """A copies nothing and stays, though its key also holds B; of the copies of B the least key stays, once."""
    a, b = prose(41, 60), prose(42, 60)
    rows = [(1, a), (1, b), (1, b), (2, b), (3, None), (3, ""), (None, a), (None, a)]
    for order in (rows, rows[::-1]):
        got = rows_of(neardup.without_near_duplicates(spark.createDataFrame(order, "doc_id long, text string")))
        assert got == sorted([(1, a), (1, b), (3, None), (3, ""), (None, a), (None, a)], key=repr)


# Substrings -----------------------------------------------------------------------


@pytest.mark.parametrize("stretches", [1, 1000])
def test_repeats_against_brute_force(docs, clashing, cases, monkeypatch, stretches):
    monkeypatch.setattr(substrings, "STRETCHES", stretches)
    plain = [(c[0], c[1]) for c in cases if c[0] not in (16, None)]
    want = sorted(brute.repeats(plain), key=repr)
    for df in (docs, clashing):
        df = df.filter("doc_id is not null and doc_id <> 16")
        assert rows_of(substrings.remove_repeats(df)) == want


def test_repeats_of_null_and_shared_keys(docs, cases):
    got = rows_of(substrings.remove_repeats(docs))
    assert len(got) == len(cases)
    assert [r[2] for r in got if r[0] is None] == [0, 120]  # the copy without a key comes last


def test_short_windows_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substrings.remove_repeats(df, window=5, seed=2)) == sorted(brute.repeats(rows, 5), key=repr)


def test_texts_without_repeats(docs, clashing, none):
    out = substrings.without_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    texts = {r.doc_id: r.text for r in out.filter("doc_id is not null").collect()}
    assert texts[2] == "" and texts[5] is None and texts[14] == docs.filter("doc_id = 14").first().text
    assert substrings.remove_repeats(none).count() == 0


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([np.append(rng.integers(1, 5, 30), 0) for _ in range(20)])
    index = fmindex.FMIndex(symbols)
    starts = np.array([31 * i + j for i in range(20) for j in range(26)])
    lo, hi = index.search(starts, 5)
    text = symbols.tolist()
    for s, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist()):
        at = [i for i in range(len(text) - 4) if text[i : i + 5] == text[s : s + 5]]
        assert b - a == 1 if len(at) == 1 else sorted(index.order[a:b].tolist()) == at


def test_range_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1000, 300)
    lo = rng.integers(0, 299, 200)
    hi = lo + rng.integers(1, 300 - lo)
    assert fmindex.range_minima(values, lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi)]


# Near-duplicates ------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(docs, clashing, cases, k):
    want = brute.components([(c[0], c[1]) for c in cases], k)
    df = clashing if k == 2 else docs
    got = neardup.near_duplicates(df, neardup.NearDuplicates(shingle=k)).collect()
    assert len(got) == len(cases)
    sizes = sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id)
    assert sizes == sorted((c[0], len(brute.shingles(c[1], k))) for c in cases if c[0])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
            assert r.repeats == sum(c[0] == r.doc_id for c in cases)


@pytest.mark.parametrize("pivots", [True, False])
def test_chains_of_near_copies(spark, monkeypatch, pivots):
    """A family whose members are mostly linked through others; after the pivots, and by blocks alone."""
    if not pivots:
        found = neardup._pivot_pairs
        monkeypatch.setattr(neardup, "_pivot_pairs", lambda live: found(live).limit(0))
    monkeypatch.setattr(neardup, "STRAGGLERS", 7)
    monkeypatch.setattr(neardup, "MEMBERS", 11)
    rng, rows = random.Random(8), []
    text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(40):
        rows.append((i, " ".join(text)))
        for _ in range(rng.choice([1, 2, 2, 6])):
            text[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows, 2)
    assert 3 < len(set(want.values())) < 20
    got = neardup.near_duplicates(df, neardup.NearDuplicates(shingle=2)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_document_of_each_group_stays(docs, clashing, none, cases):
    out = neardup.without_near_duplicates(clashing)
    assert out.columns == clashing.columns
    groups = brute.components([((c[0], c[1] or ""), c[1]) for c in cases if c[0] is not None], 5)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == sorted(key for key, _ in set(groups.values()))
    assert out.filter("doc_id is null").count() == 2
    assert neardup.without_near_duplicates(none).count() == 0


def test_minima_and_maxima_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2500]), np.sort(pool[500:])
    h, bounds = np.concatenate([a, b, a]), np.array([0, 2500, 5000, 7500])
    s = min_max(h, bounds, 400, 7)
    assert abs((s[0] == s[1]).mean() - 2000 / 3000) < 0.06
    assert (s[0] == s[2]).all() and (band_hashes(s, 4)[0] == band_hashes(s, 4)[2]).all()


# Packing --------------------------------------------------------------------------


def tightest(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        open_bins = [
            (b["room"], n) for n, b in enumerate(bins)
            if b["room"] >= size and b["room"] > 0
            and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])
        ]
        if open_bins:
            n = min(open_bins)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((n, capacity - bins[n]["room"]))
        bins[n]["room"] -= size
        bins[n]["s"].add(source)
        bins[n]["c"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(0, 101) for _ in range(300)), reverse=True)
    sources = [rng.choice([None, "a", "a", "a", "b", "c", "d"]) for _ in sizes]
    clusters = [rng.choice([None, *range(100)]) for _ in sizes]
    assert list(zip(*packing.best_fit(sizes, sources, clusters, 100))) == tightest(sizes, sources, clusters, 100)


def test_packed_bins(docs, clashing, none, cases):
    for df in (docs, clashing):
        got = packing.pack(df, capacity=256, shard_rows=8).collect()
        bins, words = defaultdict(list), defaultdict(int)
        for r in got:
            bins[r.bin_id].append(r)
            words[r.doc_id] += r.n_words
        for held in bins.values():
            held.sort(key=lambda r: (r.bin_offset, r.n_words))
            assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(held, held[1:]))
            assert held[-1].bin_offset + held[-1].n_words <= 256
            for column in ("source", "cluster"):
                values = [r[column] for r in held if r[column] is not None]
                assert len(values) == len(set(values))
        want = defaultdict(int)
        for c in cases:
            want[c[0]] += len(brute.words(c[1]))
        assert words == want
    assert packing.pack(none).count() == 0


# Mixing ---------------------------------------------------------------------------


def test_targets_of_many_sources(spark, monkeypatch):
    """Levels found by sums over sources equal those found source by source, whatever the number of sources."""
    rng = random.Random(6)
    rows = [(rng.choice([None, "", f"s{i % 3000}", f"é{i % 7}"]), rng.choice([0, 1, 5, 40, 9000])) for i in range(20000)]
    df = spark.createDataFrame([*rows, *[("hot", 30)] * 9000], "source string, size long")
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += r.size
    for cycle, share in (((5, 2, 1), 1.0), ((1, 0, 0), 2.0), ((3, 1), 0.25)):
        want = brute.targets(sizes, brute.cycle_weights(sizes, cycle), share * sum(sizes.values()))
        got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(df, cycle=cycle, share=share).collect()}
        assert set(got) == set(want)
        assert all(got[s][0] == sizes[s] and got[s][1] == pytest.approx(want[s], rel=1e-9) for s in want)
    assert mixing.source_targets(df.limit(0)).count() == 0
    assert [r.target for r in mixing.source_targets(spark.createDataFrame([("a", 0)], df.schema)).collect()] == [0.0]


def test_targets_by_water_filling():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 100}
    goal = brute.targets(sizes, brute.cycle_weights(sizes), 2110)
    assert brute.cycle_weights(sizes) == {"a": 5, "b": 2, "c": 1, None: 5}
    assert goal["a"] == 30 and goal[None] == 300
    assert goal["b"] == pytest.approx(1780 * 2 / 3) and goal["c"] == pytest.approx(1780 / 3)
    assert brute.targets({}, {}, 0) == {}
    assert brute.targets({"a": 0}, {"a": 5}, 0) == {"a": 0}


def test_pairing_keeps_words_and_expectations():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 400)
    share = np.full(400, 0.3)
    total = np.zeros(400)
    for seed in range(300):
        out, left = mixing.pair_off(size, share, np.random.default_rng(seed))
        fractional = [i for i in range(400) if 0 < out[i] < 1]
        assert fractional == ([] if left is None else [left])
        assert (out * size).sum() == pytest.approx((share * size).sum())
        total += out
    assert abs(total.mean() / 300 - 0.3) < 0.01 and np.abs(total / 300 - 0.3).max() < 0.15


def test_mix(docs, clashing, none, cases, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    got = mixing.mix(docs).collect()
    assert rows_of(mixing.mix(clashing)) == rows_of(mixing.mix(docs))
    by_source, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for c in cases:
        n = len(brute.words(c[1]))
        by_source[c[3]] += n
        largest[c[3]] = max(largest[c[3]], n)
    goal = brute.targets(by_source, brute.cycle_weights(by_source), sum(by_source.values()))
    assert len(got) == len(cases)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= largest[s] / 2 + 1
    assert mixing.mix(none).count() == 0


def test_mixed_documents_repeat_rows(clashing, none):
    plan = mixing.mix(clashing)
    want = sum(r.copies for r in plan.collect())
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    # The mix keys here hold the text too, so single choices may differ; the words don't.
    words = sum(len(brute.words(r.text)) for r in out.collect())
    assert abs(words - sum(r.taken for r in plan.collect())) <= 6000 and abs(out.count() - want) <= 12
    assert mixing.mixed_documents(none).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got, _ = graph.components(spark.createDataFrame(edges, "u long, v long"))
    want = {x: root(x) for x in {n for e in edges if e[0] != e[1] for n in e}}
    assert {r.node: r.component for r in got.collect()} == want
    empty, _ = graph.components(spark.createDataFrame([], "u long, v long"))
    assert empty.count() == 0
