from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ash birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew alder beech".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en", "ish", "wood"]) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """Rows with nulls, empty and long texts, ties, repeated rows, near copies and a shared passage."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \t\n"), (8, "oak"), (9, "oak"),
        (10, prose(3, 40) + " " + passage + " " + prose(4, 40)), (11, prose(5, 10) + "\n" + passage),
        (12, "ha " * 90), (13, prose(6, 6000)), (14, prose(7, 30) + " x\x1cy"), (15, prose(8, 25)), (15, prose(8, 25)),
        (16, prose(9, 25)), (16, prose(10, 25)), (None, base), (None, None), (17, "x" * 5000), (18, prose(11, 19)), (19, prose(11, 20)),
        (20, prose(11, 20)),
    ]
    return [(i, t, "en", ("src0", "src1", None)[n % 3], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, cases):
    """The same rows with further columns, named like those the operators use inside."""
    names = ("key", "rid", "seed", "sid", "n", "size", "shard", "_block", "copies", "component", "text_hash", "piece", "score")
    rows = [(*r, *range(len(names))) for r in cases]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
