"""Text files with several named SQL statements, run over temporary views."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = Path(__file__).resolve().parents[1] / "sql"
FILES = [_FOLDER / "quality_checks.sql", _FOLDER / "business_questions.sql"]

# Fixed value: the line prefix that starts a statement.
MARKER = "-- name: "


def _name_of(line: str) -> str | None:
    if not line.startswith(MARKER):
        return None
    name = line[len(MARKER):].strip()
    valid = name and name[0].islower() and all(
        ch == "_" or ch.isdigit() or (ch.isascii() and ch.islower()) for ch in name
    )
    return name if valid else None


def named_statements(path: str | Path) -> list[tuple[str, str]]:
    """(name, statement) in file order; text before the first marker is ignored."""
    found: list[tuple[str, list[str]]] = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name = _name_of(line)
        if name:
            found.append((name, []))
        elif found:
            found[-1][1].append(line)
    if not found:
        raise ValueError(f"No '-- name:' markers in {path}.")
    statements = [(name, "\n".join(body).strip()) for name, body in found]
    for name, text in statements:
        if not text:
            raise ValueError(f"Named query '{name}' is empty in {path}.")
    return statements


def run_named(
    spark: SparkSession, paths: list[str | Path], only: set[str] | None = None
) -> dict[str, DataFrame]:
    """A lazy DataFrame per statement; a name may occur once over all files."""
    statements: dict[str, str] = {}
    for path in paths:
        for name, text in named_statements(path):
            if name in statements:
                raise ValueError(f"Duplicate named query: {name}")
            statements[name] = text.rstrip().rstrip(";")
    return {n: spark.sql(s) for n, s in statements.items() if only is None or n in only}


def words(paths: list[str | Path], only: set[str]) -> set[str]:
    """All identifiers in the statements of these names; tables that are not among them need not be there."""
    texts = [text for path in paths for name, text in named_statements(path) if name in only]
    return {word for text in texts for word in re.findall(r"\w+", text)}


def manifest(
    spark: SparkSession, results: dict[str, DataFrame], folder: str | None = None
) -> DataFrame:
    """Row count and column list per named result, and where it was written."""
    rows = [(n, df.count(), ",".join(df.columns)) for n, df in results.items()]
    listing = spark.createDataFrame(rows, "query string, row_count long, column_list string")
    if folder is None:
        return listing
    return listing.withColumn("output", F.concat(F.lit(f"{folder}/"), "query"))
