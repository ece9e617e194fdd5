from __future__ import annotations

import pickle

import numpy as np

from basketry.llm import kneserney, toxicity


def test_every_gram_keeps_its_own_ratio_beyond_a_piece(spark):
    """More grams than a piece holds: the model is that of memory, and no entry is shared."""
    names = [f"{a}{b}{c}" for a in ("oak", "elm", "é", "vile") for b in ("", "s", "ish") for c in range(30)]
    rows = [(i % 2, " ".join(names[i % 7 :: 1 + i % 5])) for i in range(12)]
    texts = spark.createDataFrame(rows, "toxic int, text string")
    counts = toxicity._counts(texts.dropDuplicates())
    plain, found = kneserney.fit(counts), kneserney.fit_table(toxicity._gram_counts(texts.dropDuplicates()), 64)
    words = [*names, "", "unseen", "vil", "x" * 300]
    assert len(found.ratio.pieces) > 3 and sum(len(p.value.keys) for p in found.ratio.pieces) == len(plain.ratio)
    assert np.allclose(found.words(words), [plain.word(w) for w in words], atol=1e-5)
    # Tasks get the pieces, and find the same.
    told = toxicity._feature_rows(texts, found).collect()
    memo = toxicity.Memo(found)
    assert [r.x for r in told] == [toxicity.features(r[1], memo) for r in rows]
    found.remove()


def test_a_piece_finds_what_it_has(spark):
    rng = np.random.default_rng(1)
    for keys in ([7], [-(2**63), 2**63 - 1], [5, 6, 7, 9], [-(2**63), -1, 0, 1], rng.integers(-(2**63), 2**63 - 1, 5000)):
        keys = np.unique(np.array(keys, dtype=np.int64))
        piece = pickle.loads(pickle.dumps(kneserney.Piece(keys, np.arange(len(keys), dtype=np.float32))))
        asked = np.concatenate([keys, keys[1:] - 1, keys[:-1] + 1, np.array([0, 8, -(2**63), 2**63 - 1])])
        found, value = piece.find(asked)
        want = np.isin(asked, keys)
        assert (found == want).all() and (value[want] == np.searchsorted(keys, asked[want])).all()
    assert piece.find(np.zeros(0, np.int64))[0].tolist() == []


def test_words_met_once_are_not_looked_up_again(monkeypatch):
    """Also where a batch holds more words than the memo, or long ones."""

    class Model:
        def words(self, words):
            return np.array([float(len(w)) for w in words])

        def word(self, word):
            raise AssertionError("looked up alone")

    monkeypatch.setattr(toxicity, "_MEMO", 5)
    memo = toxicity.Memo(Model())
    for start in (0, 3, 8, 0):
        texts = [f"{'w' * (i + 1)} {'long' * 40}{i} {'w' * (i % 3 + 1)}" for i in range(start, start + 9)]
        memo.meet(texts)
        for t in texts:
            assert toxicity.features(t, memo)[4] == max(map(len, t.split()))
