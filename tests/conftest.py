from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{shared}/warehouse",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, folder):
    from checks.queries import Tables

    return Tables(spark, folder)


RAW = [
    ("100001", "A1", " Blue  Mug ", "2", "2010-01-01 10:00", "5.0", "12345.0", "United Kingdom"),
    ("C100002", "B2", "Red Mug", "-1", "2010-01-02 11:00", "5.0", "12345.0", "United Kingdom"),
    ("100003", "C3", None, "1", "2010-01-03 12:00", "0.0", None, "United Kingdom"),
    ("100004", "A1", "Blue Mug", "3", "2010-01-04 13:00", "5.0", "12345.0", "United Kingdom"),
]
HEADERS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, ", ".join(f"`{h}` string" for h in HEADERS))
