"""Toxicity, archives, URL filters, nearest neighbours and pseudo-likelihood."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import ann, kneserney, pseudo, shared, toxicity, urls, warc
from basketry.llm.queries import URL_RULES
from basketry.llm.shared import scratch
from tests.llm.conftest import prose, rows_of


# Toxicity -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(700):
        words, bad = prose(1000 + i, rng.randrange(20, 200)).split(), i % 4 == 0
        if bad:
            for _ in range(2 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["nastyish", "nastyen", "vile.", "Vile", "nastywood"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(None, "vile vile vile"), (9001, None), (9002, "")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([*labels, (None, 1), (3, None), (777777, 1)], "doc_id long, toxic int"),
    )


def test_toxic_words_are_found_in_held_out_documents(labelled):
    docs, labels = labelled
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in [*range(700), 9001, 9002] if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [r for r in held if r.doc_id < 700]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_expressions_of_one_document_are_counted(spark):
    texts = spark.createDataFrame([(1, "qqzvx oak"), (0, "oak elm"), (0, "oak elm")], "toxic int, text string")
    counts = toxicity._counts(texts)
    want = {}
    for toxic, word in [(1, "qqzvx"), (1, "oak"), (0, "oak"), (0, "elm")]:
        for g in kneserney.grams(word):
            p, n = want.get(g, (0, 0))
            want[g] = (p + toxic, n + 1 - toxic)
    assert counts == want
    assert kneserney.fit(counts).word("qqzvx") > 1


def test_labels_of_one_class_or_none(labelled, none, spark):
    docs, labels = labelled
    few = docs.filter("doc_id > 695")
    assert {r.score for r in toxicity.judged(few, labels.filter("toxic = 7")).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judged(few, ones).collect()} == {1.0}
    assert toxicity.judged(none, labels).count() == 0
    clean = toxicity.without_toxic(docs.withColumns({"score": F.lit(1), "toxic_score": F.lit(2)}), labels)
    assert clean.columns == ["doc_id", "text", "score", "toxic_score"]
    assert {r.doc_id for r in clean.collect()} >= {9001, 9002}


def test_class_models_are_distributions():
    """Probabilities of each class, rebuilt from the ratio's parts, sum to one over all characters."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    counts: dict = {}
    for n, w in enumerate(words):
        for g in kneserney.grams(w, 3):
            counts.setdefault(g, [0, 0])[n % 2] += 1
    model = kneserney.fit({g: tuple(v) for g, v in counts.items()}, 3)
    shared = kneserney._shared(counts, 3, kneserney.DISCOUNT)
    histories = {g[:-1] for g in counts}
    letters = "abc" + kneserney.END
    for h in histories:
        known = sum(shared(x, h[1:]) for x in letters)
        assert known <= 1 + 1e-9
        sides = []
        for side in (0, 1):
            total = sum(v[side] for g, v in counts.items() if g[:-1] == h)
            if not total:
                continue
            kinds = sum(v[side] > 0 for g, v in counts.items() if g[:-1] == h)
            p = [
                (max(counts.get(h + x, (0, 0))[side] - 0.75, 0) + 0.75 * kinds * shared(x, h[1:])) / total for x in letters
            ]
            assert sum(p) == pytest.approx(1 - 0.75 * kinds * (1 - known) / total)
            sides.append(p)
        if len(sides) == 2:
            for x, a, b in zip(letters, *sides):
                if h + x in counts:
                    assert model.ratio[h + x] == pytest.approx(math.log(a / b))


# Archives -------------------------------------------------------------------------

LONG = "<p>" + "page " * 40 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a.org/1", LONG), (2, "http://a.org/2", LONG), (9, None, LONG), (None, "http://b.org", LONG),
        (3, "http://c.org/é\r\nX: y", "short"), (4, "", "short"), (6, "http://d.org", None), (7, "http://d.org", ""),
        (8, "http://e.org", "é" * 60), (8, "http://e.org", "é" * 60), (10, "http://f.org", "x\r\n\r\ny" * 30000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, pages):
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    got = {(r.page_id, r.record_type): r for r in warc.read_archive(spark, path, verify=True).collect()}
    for r in pages.collect():
        body = (r.html or "").encode()
        copies = [p.page_id for p in pages.collect() if p.html == r.html and p.page_id is not None]
        revisit = len(body) >= 100 and r.page_id != min(copies)
        back = got[r.page_id, "revisit" if revisit else "response"]
        assert back.refers_to == (min(copies) if revisit else None)
        assert back.payload_bytes == len(body) and back.payload_digest == hashlib.sha256(body).hexdigest()
        assert (back.payload is None) == revisit and (revisit or bytes(back.payload) == body)
    assert warc.read_archive(spark, path).count() == pages.count()


def test_filters_reach_the_headers(spark, pages, monkeypatch):
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    some = warc.read_archive(spark, path).filter("record_type = 'response' and page_id > 3 and page_id in (4, 5, 8, 10)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan and "BatchScan warc" in plan
    assert sorted(r.page_id for r in some.collect()) == [4, 8, 8, 10]
    reader = warc.WarcReader(some.schema, {"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    decoded = []
    monkeypatch.setattr(warc._Members, "take", lambda self, n: decoded.append(n) or b"")
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 3
    assert decoded == []


def test_uncommitted_files_and_plain_members(spark, pages, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages.limit(3), path)
    record = warc.record("response", 77, "http://x", b"y" * 500, 500, hashlib.sha256(b"y" * 500).hexdigest(), None, "d")
    (tmp_path / "archive" / "stray.warc.gz").write_bytes(gzip.compress(record))
    assert warc.read_archive(spark, path).count() == 3
    other = tmp_path / "foreign"
    other.mkdir()
    (other / "one.warc.gz").write_bytes(gzip.compress(record) + warc.member(record) + gzip.compress(record))
    back = warc.read_archive(spark, f"file://{other}", verify=True).collect()
    assert [(r.page_id, r.payload_bytes, r.url) for r in back] == [(77, 500, "http://x")] * 3
    headers = warc.read_archive(spark, f"file://{other}", "page_id long, record_type string").collect()
    assert [tuple(r) for r in headers] == [(77, "response")] * 3


def test_urls_come_back_as_written(spark):
    """Blanks, breaks, letters beyond ASCII and escapes that the page itself has; filters see the url itself."""
    given = ["http://c.org/é x", "http://c.org/%C3%A9%20x", "http://c.org/a\r\nb: c", "http://c.org/", "", " ", None, '"q"', "100%"]
    pages = spark.createDataFrame([(i, u, "z" * (i + 100)) for i, u in enumerate(given)], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path, verify=True)
    assert {r.page_id: r.url for r in back.collect()} == dict(enumerate(given))
    assert [r.page_id for r in back.filter(F.col("url") == given[0]).collect()] == [0]


def test_the_archive_goes_at_exit(spark, pages):
    before = set(shared._PINNED)
    warc.archived(pages).count()
    (path,) = [p for p in shared._PINNED - before if "warc" in p]
    shared.remove(spark, path)


def test_empty_archive(spark, pages):
    assert warc.archived(pages.limit(0)).count() == 0


# URL filters ----------------------------------------------------------------------


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for action, name, start in [
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ]:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best is None or len(name + start) > len(best[1]):
                best = (action, name + start)
    return host, path, best[1] if best else None, best[0] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/en/12", "https://a.example.org/en/2", "x://example.org/es/?q",
    "http://example.org", "http://example.org?/es/", "http://badexample.org/es/", "http://com/de/x#y", "http://a.com/fr/1",
    "http://a.com/FR/1", "http://a.b.com/de", "http://a://b.org/", "http://é.org/é", "http://x.net/de/", "http://org/", "http://a.\norg/",
    "http://x.org/" + "a/" * 5000,
]


def test_url_verdicts_against_plain_rules(spark):
    rows = [(n % 18, u, "r") for n, u in enumerate([*URLS, *URLS])] + [(None, "http://a.org/", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, URL_RULES).collect()), key=repr)
    assert got == sorted(((u, *plain_verdict(u)) for _, u, _ in rows), key=repr)
    blocked = urls.judge_urls(spark.createDataFrame([("http://a.net/best-casino/",), ("http://casinos.net/",)], "url string"), URL_RULES)
    assert [r.verdict for r in blocked.collect()] == ["block", "allow"]
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_more_rules_than_are_sent_at_once(spark, monkeypatch):
    """Sets judged some rules at a time give the verdicts of the whole set, ties included."""
    rules = [*URL_RULES, urls.word_rule("allow", "casino"), *[urls.host_rule("block", f"h{i}.net", "/") for i in range(40)]]
    rows = [(i, f"http://w.h{i % 50}.net/casino/{i}") for i in range(100)] + [(None, None), *enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(urls.judge_urls(df, rules).collect(), key=repr)
    monkeypatch.setattr(urls, "SENT_RULES", 7)
    assert sorted(urls.judge_urls(df, rules).collect(), key=repr) == want
    assert {r.rule for r in want} >= {"casino", "h7.net/", "org/"}


def test_rules_lie_under_their_rarest_token():
    rules = URL_RULES[:5]
    assert [r.tokens for r in rules] == [("org",), ("example", "org", "es"), ("example", "org", "en"), ("com", "fr"), ("com", "de")]
    filed = urls.file_rules(rules, {"org": 9, "example": 9, "es": 2, "en": 10, "com": 5, "fr": 5, "de": 1})
    assert {t: [r.name for r in held] for t, held in filed.items()} == {
        "org": ["org/"], "es": ["example.org/es/"], "example": ["example.org/en/1"], "com": ["com/fr/"], "de": ["com/de/"],
    }


# Nearest neighbours ---------------------------------------------------------------


def brute_nearest(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    other = np.flatnonzero(ids != ids[query])
    order = other[np.lexsort((ids[other], d[other]))][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_on_the_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id % 100 = 0 or vec_id < 2000")
    ann_rows = ann.search(df, F.col("id") % 100 == 0)
    got = {}
    for r in ann_rows.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    table = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float64)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = brute_nearest(ids, x, q, 10)
        own = sorted(got[int(ids[q])])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hit += len({i for i, _ in want} & {i for _, i, _ in own})
        total += 10
    assert hit / total >= 0.9


def test_learned_parts(spark, monkeypatch):
    """Clustered vectors, many parts: few are visited, nearly all neighbours found."""
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 8)) * 4
    x = np.concatenate([c + rng.standard_normal((80, 8)) * 0.5 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen = {}
    learn = ann.learn_router
    monkeypatch.setattr(ann, "learn_router", lambda *a, **b: seen.setdefault("router", learn(*a, **b)))
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    router, probes = seen["router"]
    parts = router.w2.shape[1]
    assert parts >= 8 and probes <= parts // 2
    sizes = np.bincount(router.forward(x)[1].argmax(axis=1), minlength=parts)
    assert sizes.max() <= 3 * len(x) / parts
    want = {(q, i) for q in range(0, len(x), 20) for i, _ in brute_nearest(np.arange(len(x)), x, q, 10)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want)


def test_recall_on_the_sample_table_over_parts(spark, monkeypatch):
    """The sample table with parts small enough that it has several, and not all of them are visited."""
    monkeypatch.setattr(ann, "PART_ROWS", 128)
    seen, learn = {}, ann.learn_router
    monkeypatch.setattr(ann, "learn_router", lambda *a, **b: seen.setdefault("router", learn(*a, **b)))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("id") % 100 == 0).collect()}
    router, probes = seen["router"]
    assert router.w2.shape[1] > 1 and probes < router.w2.shape[1]
    table = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float64)
    want = {(int(ids[q]), i) for q in np.flatnonzero(ids % 100 == 0) for i, _ in brute_nearest(ids, x, q, 10)}
    assert len(want & got) >= 0.9 * len(want)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (100, [5.0, 5.0]), (200, [1.0, 0.0]), (200, [1.0, 0.0]),
        *[(1000 + i, [3.0, 3.0]) for i in range(1, 30)],
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "part": F.lit(2)})
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0, k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert sorted(got) == [0, 100, 200]
    assert got[0][:4] == [(200, 0.0), (100, 0.5), (1, round(math.sqrt(2), 6)), (2, round(math.sqrt(2), 6))]
    assert [i for i, _ in got[0][4:]] == list(range(1001, 1009))
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = ann.search(df.filter("vec_id < 100"), F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1), (0, 2, 2)]


# Pseudo-likelihood ----------------------------------------------------------------


def conditional(words, network, around, number):
    """Log-probability of one number: its symbol in the softmax, then every fork on the way to its leaf."""
    h = np.tanh(network.bias + sum(network.embed[j][s].astype(np.float64) for j, s in enumerate(around)))
    z = network.out @ h + network.out_bias
    value = z[words.symbol[number]] - z.max() - np.log(np.exp(z - z.max()).sum())
    for at in range(words.path[number], words.path[number + 1]):
        f = words.forks[at]
        value -= np.log1p(np.exp(-words.sides[at] * (network.fork[f] @ h + network.fork_bias[f])))
    return value


def test_scores_against_a_word_by_word_loop(spark, docs, clashing, none, cases, monkeypatch):
    kept = {}
    vocabulary, train = pseudo.vocabulary, pseudo.train
    monkeypatch.setattr(pseudo, "vocabulary", lambda t: kept.setdefault("words", vocabulary(t)))
    monkeypatch.setattr(pseudo, "train", lambda t, w: kept.setdefault("network", train(t, w)))
    got = rows_of(pseudo.pseudo_likelihood(docs))
    assert len(got) == len(cases)
    words, network = kept["words"], kept["network"]
    want = []
    for c in cases:
        text = (c[1] or "").encode().split()
        symbols = []
        for w in text:
            data = np.frombuffer(w, np.uint8)
            h, e, _ = pseudo.word_codes(data, np.array([0, len(data)]))
            symbols.append(int(words.encode(h, e)[0]))
        total = 0.0
        for i, s in enumerate(symbols):
            near = [symbols[i + o] if 0 <= i + o < len(symbols) else 0 for o in pseudo.OFFSETS]
            total += conditional(words, network, near, s) + (words.within[s] if s < pseudo.SYMBOLS else 0.0)
        want.append((c[0], len(text), total))
    lookup = sorted((r[0] or -1, r[1], r[2]) for r in got)
    for a, b in zip(lookup, sorted((r[0] or -1, *r[1:]) for r in want)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-3)
    assert pseudo.pseudo_likelihood(none).count() == 0
    assert pseudo.pseudo_likelihood(clashing).count() == len(cases)


def test_word_order_counts(spark):
    """After training, texts in their order are likelier than the same words shuffled."""
    rng, rows = random.Random(3), []
    for i in range(400):
        words = []
        for _ in range(30):
            words += rng.choice([["red", "fox"], ["blue", "bird"], ["old", "grey", "wolf"]])
        rows.append((i, " ".join(words)))
    shuffled = []
    for i, t in rows[:50]:
        words = t.split()
        rng.shuffle(words)
        shuffled.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame([*rows, *shuffled], "doc_id long, text string")
    got = {r.doc_id: r.per_word for r in pseudo.pseudo_likelihood(df).collect()}
    assert sum(got[i] > got[1000 + i] + 0.3 for i in range(50)) >= 48


def test_every_word_is_predicted_by_its_own_count(spark):
    """Words beyond the frequent: those of the vocabulary have outputs, the others their own count, and all sum to one."""
    rng, names = random.Random(4), [f"{a}{b}ix" for a in "bcdfghjklm" for b in range(40)]
    rows = [(i, " ".join(rng.choices(names, [1 / (r + 1) for r in range(400)], k=80))) for i in range(300)]
    table = spark.createDataFrame([*rows, (1000, "oncewix")], "doc_id long, text string")
    counted = pseudo._counted(table).cache()
    words = pseudo.vocabulary(counted)
    n = {r.hash: r.n for r in counted.collect()}
    assert pseudo.FREQUENT < len(words.hashes) <= math.isqrt(words.total) and words.total == sum(n.values()) == 24001
    assert {int(h) for h in words.hashes} >= {h for h, k in n.items() if k >= words.least}

    def code(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return pseudo.word_codes(data, np.array([0, len(data)]))[:2]

    codes = {w: code(w) for w in [*names, "oncewix"]}
    codes = {w: c for w, c in codes.items() if int(c[0][0]) in n}
    more = {r._hash: float(r._more) for r in words.above_rare(counted).collect()}
    assert more
    network = pseudo.Network(words)
    around, total, got = np.array([[1, 2, 130, 0]]), 0.0, {}
    for w, (h, e) in codes.items():
        number = words.encode(h, e)
        value = network.log_probabilities(around, number)[0] + more.get(int(h[0]), 0.0)
        value += words.within[number[0]] if number[0] < pseudo.SYMBOLS else 0.0
        got[w] = value
        total += np.exp(value)
    # Symbols without a word of the corpus take the rest of the mass.
    used = {int(words.symbol[words.encode(h, e)[0]]) for h, e in codes.values()}
    z = network.hidden(around) @ network.out.T + network.out_bias
    mass = np.exp(z - z.max())[0]
    assert total == pytest.approx(mass[sorted(used)].sum() / mass.sum(), rel=2e-2)
    by_ending = {}
    for w, (h, e) in codes.items():
        if words.encode(h, e)[0] > pseudo.FREQUENT:
            by_ending.setdefault(int(e[0]), []).append((n[int(h[0])], got[w]))
    for found in by_ending.values():
        for a, x in found:
            for b, y in found:
                if min(a, b) >= pseudo.RARE:
                    assert x - y == pytest.approx(math.log(a / b), abs=1e-3)
    scores = {r.doc_id: r.n_words for r in pseudo.pseudo_likelihood(table).collect()}
    assert scores == {**{i: 80 for i in range(300)}, 1000: 1}


@pytest.mark.parametrize("held", [0, 1, 32])
def test_forks_and_shares_against_a_loop(spark, monkeypatch, held):
    """Words with a vector, words whose count a task holds and words whose count is joined: sums of single conditionals."""
    monkeypatch.setattr(pseudo, "HELD", held)
    rng, names = random.Random(9), [f"{a}{b}ix" for a in "bcdfghjklm" for b in range(60)]
    rows = [(i, " ".join(rng.choices(names, [1 / (r + 1) for r in range(600)], k=70))) for i in range(300)]
    table = spark.createDataFrame([*rows, (1000, "oncewix"), (1000, "oncewix"), (1001, None)], "doc_id long, text string")
    kept, vocabulary, train = {}, pseudo.vocabulary, pseudo.train
    monkeypatch.setattr(pseudo, "vocabulary", lambda t: kept.setdefault("words", vocabulary(t)))
    monkeypatch.setattr(pseudo, "train", lambda t, w: kept.setdefault("network", train(t, w)))
    got = {r.doc_id: r.log_likelihood for r in pseudo.pseudo_likelihood(table).collect()}
    words, network = kept["words"], kept["network"]
    counts = Counter(w for r in table.collect() for w in (r.text or "").split())
    codes = {}
    for w in counts:
        data = np.frombuffer(w.encode(), np.uint8)
        h, e, _ = pseudo.word_codes(data, np.array([0, len(data)]))
        codes[w] = (int(words.encode(h, e)[0]), int(e[0]))
    rest = {w for w, (s, _) in codes.items() if pseudo.FREQUENT < s < pseudo.SYMBOLS}
    middle = {w for w in rest if counts[w] >= pseudo.RARE}
    assert max(s for s, _ in codes.values()) >= pseudo.SYMBOLS and middle and rest - middle
    assert bool(len(words.held)) == (held > 0) and (len(words.held) == len(middle)) == (held == 32)

    def value_of(around, w):
        number, ending = codes[w]
        value = conditional(words, network, around, number)
        if w in rest:
            uses = [counts[v] for v in rest if codes[v][1] == ending]
            few = [u for u in uses if u < pseudo.RARE]
            value += math.log((counts[w] if w in middle else sum(few) / len(few)) / sum(uses))
        return value

    for i in [*range(0, 300, 12), 1000]:
        text = dict(rows).get(i, "oncewix").split()
        total = 0.0
        for at, w in enumerate(text):
            near = [at + o for o in pseudo.OFFSETS]
            total += value_of([codes[text[j]][0] if 0 <= j < len(text) else 0 for j in near], w)
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)
    assert got[1001] == 0.0


def test_a_wider_tree_of_averages(spark, monkeypatch):
    """Weights of many tasks meet level by level in the mean by words."""
    monkeypatch.setattr(pseudo, "FAN", 3)
    rows = [(np.full(4, i, np.float32).tobytes(), i + 1) for i in range(20)]
    each, levels = spark.createDataFrame(rows, "weights binary, n long"), 0
    tasks = 20
    while tasks > 1:
        tasks, levels = -(-tasks // pseudo.FAN), levels + 1
        each = spark.createDataFrame(pseudo._averaged(each.repartition(tasks)).collect(), "weights binary, n long")
        assert each.count() <= tasks
    (last,) = each.collect()
    want = np.average(np.arange(20), weights=np.arange(1, 21))
    assert levels == 3 and last.n == 210 and np.frombuffer(last.weights, np.float32) == pytest.approx([want] * 4, rel=1e-5)


def test_all_documents_train(spark, monkeypatch):
    """Every document reaches the network, as few as there are: order is learned where no key and text hash to a multiple of 16."""
    rows = [(i, " ".join(["old", "grey", "wolf"] * 200)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) != 0)
    given, train = {}, pseudo.train
    monkeypatch.setattr(pseudo, "train", lambda t, w: given.setdefault("network", train(given.setdefault("texts", t), w)))
    got = [r.per_word for r in pseudo.pseudo_likelihood(df).collect()]
    assert given["texts"].count() == df.count() == len(got) > 0
    assert min(got) > -0.2


def test_models_of_a_table_are_those_of_memory(spark):
    texts = spark.createDataFrame(
        [(i % 2, " ".join(f"{a}{b}{'x' * (i % 3)}" for a in ("oak", "elm", "é", "vile") for b in ("", "s", "ish", str(i)))) for i in range(40)],
        "toxic int, text string",
    )
    counts = toxicity._counts(texts)
    table = toxicity._gram_counts(texts)
    plain, found = kneserney.fit(counts), kneserney.fit_table(table)
    words = ["oak", "oaks", "vilexx", "villain", "é", "", "unseen", "elm7"]
    assert np.allclose(found.words(words), [plain.word(w) for w in words], atol=1e-5)
    assert found.words([]).tolist() == [] and not found.ratio.modulus
    # More grams than entries: all of them are in the shared ones.
    few = kneserney.fit_table(table, 64)
    assert len(few.ratio.keys) == 64 and np.isfinite(few.words(words)).all()


def test_all_labelled_documents_are_learned_from(spark):
    """No document outside the held-out fold is left out, and equal texts of a class count once."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.when(F.col("id") < 100, 0).otherwise(F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = toxicity._labelled(docs, labels, "doc_id", "text", "toxic")
    want = docs.filter("pmod(crc32(cast(doc_id as string)), 5) <> 0")
    assert found.count() == want.count()
    assert found.filter("first").count() == want.filter("doc_id >= 100").count() + 2
