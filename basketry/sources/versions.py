"""Publishing a set of tables as one snapshot.

Every version has a folder of its own, and a manifest that names its tables.
Data are written first, the manifest last and in one step, under a name that no
other publisher uses; nothing is renamed over anything. A reader follows the
newest manifest to a folder that never changes, so it finishes on the version it
began with, and a publisher that fails at any step leaves the version before it.
This holds on object stores too, where a folder cannot be moved in one step.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from basketry.sources.sinks import written_files

_MANIFESTS = "_versions"
#: Versions that stay for readers who opened them.
KEEP = 2


@dataclass(frozen=True)
class Version:
    number: int
    root: str
    folder: str
    tables: dict[str, dict] = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.root}/{self.folder}/{table}"

    def read(self, spark: SparkSession, table: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema is not None else reader).format(fmt).load(self.path(table))


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the finished manifests, oldest first."""
    fs, folder = _hadoop(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n for n in names if n.endswith(".json") and n[0] not in "_.")


def _load(spark: SparkSession, root: str, name: str) -> Version:
    text = spark.read.text(f"{root}/{_MANIFESTS}/{name}", wholetext=True).first()[0]
    return Version(root=root, **json.loads(text))


def latest(spark: SparkSession, root: str) -> Version | None:
    """The newest published version, or None."""
    names = _manifests(spark, root)
    return _load(spark, root, names[-1]) if names else None


def begin(spark: SparkSession, root: str) -> Version:
    """A version to write tables to; nobody sees it before ``publish``."""
    names = _manifests(spark, root)
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    return Version(number, root, f"v{number:08d}-{uuid.uuid4().hex}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written aside, then renamed to a name nobody else uses."""
    fs, final = _hadoop(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(final.getParent(), f"_{final.getName()}")
    fs.mkdirs(final.getParent())
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(aside, final):
        raise RuntimeError(f"Could not write {path}.")


def publish(spark: SparkSession, version: Version, tables: dict[str, dict], keep: int = KEEP) -> Version:
    """Make ``version`` the newest one. ``tables``: what its manifest says of each table, such as its rows.

    Every table must have been written. Of the versions before, the newest stay,
    ``keep`` with this one; older ones go.
    """
    described = {}
    for name, facts in tables.items():
        files = written_files(spark, version.path(name))
        if not files:
            raise RuntimeError(f"Table {name} of version {version.number} has no files.")
        described[name] = {**facts, "files": len(files), "bytes": sum(size for _, size in files)}
    done = Version(version.number, version.root, version.folder, described)
    body = {"number": done.number, "folder": done.folder, "tables": described}
    _write_text(spark, f"{done.root}/{_MANIFESTS}/{done.number:08d}-{done.folder[-32:]}.json", json.dumps(body, default=str))
    expire(spark, version.root, keep)
    return done


def discard(spark: SparkSession, version: Version) -> None:
    """Remove what was written of a version that will not be published."""
    fs, folder = _hadoop(spark, f"{version.root}/{version.folder}")
    fs.delete(folder, True)


def expire(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Delete all but the newest ``keep`` versions: first the manifest, so that no reader is led to half a folder."""
    for name in _manifests(spark, root)[: -max(keep, 1)]:
        old = _load(spark, root, name)
        fs, manifest = _hadoop(spark, f"{root}/{_MANIFESTS}/{name}")
        fs.delete(manifest, False)
        discard(spark, old)
