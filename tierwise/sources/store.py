"""Versioned model store.

``<path>/<name>/data/<random>/<table>`` holds a version's tables, written once
and never changed.  ``<path>/<name>/commits/<number>.json`` names that folder
and its files with their lengths; it is made last, under a temporary name and
then renamed.  Where renaming never overwrites (HDFS), of two savers at once one
takes the next number; elsewhere save from one place at a time.
A save that dies before leaves folders nobody refers to.  ``load`` takes the
newest commit whose files are all there and falls back to the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none where there is no folder."""
    return sorted(lengths(spark, path))


def lengths(spark: SparkSession, path: str) -> dict[str, int]:
    fs, place = _fs(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(place)} if fs.exists(place) else {}


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


class NoVersion(LookupError):
    """No whole version is stored."""


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, tables: dict[str, DataFrame]) -> str:
        """The tables in a folder of their own, not yet a version."""
        folder = f"{self.path}/{name}/data/{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{table}")
        return folder

    def commit(self, name: str, folder: str) -> int:
        """Makes a written folder the next version; gives its number."""
        files = {t: lengths(self.spark, f"{folder}/{t}") for t in names(self.spark, folder)}
        text = json.dumps({"folder": folder, "files": files}, sort_keys=True)
        commits = f"{self.path}/{name}/commits"
        fs, temporary = _fs(self.spark, f"{commits}/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        number = max(self.versions(name), default=0) + 1
        while True:
            _, target = _fs(self.spark, f"{commits}/{number:08d}.json")
            if not fs.exists(target) and fs.rename(temporary, target):
                return number
            number += 1

    def save(self, name: str, tables: dict[str, DataFrame]) -> int:
        return self.commit(name, self.write(name, tables))

    def versions(self, name: str) -> list[int]:
        """Numbers of all commits, whole or not."""
        return [int(n[:-5]) for n in names(self.spark, f"{self.path}/{name}/commits") if n.endswith(".json") and n[0] != "_"]

    def _whole(self, name: str, number: int) -> tuple[str, list[str]] | None:
        try:
            found = json.loads(_read_text(self.spark, f"{self.path}/{name}/commits/{number:08d}.json"))
        except ValueError:
            return None
        folder, files = found["folder"], found["files"]
        there = all(lengths(self.spark, f"{folder}/{t}").items() >= want.items() for t, want in files.items())
        return (folder, list(files)) if there else None

    def load(self, name: str, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, by default the newest whole one."""
        for number in sorted(self.versions(name), reverse=True):
            if version is not None and number != version:
                continue
            got = self._whole(name, number)
            if got:
                return {t: self.spark.read.parquet(f"{got[0]}/{t}") for t in got[1]}
        raise NoVersion(f"no whole version of {name}" + ("" if version is None else f" with number {version}"))
