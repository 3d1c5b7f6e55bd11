"""Stages that are kept: a run that was interrupted starts behind the last finished stage.

Each finished stage has a record, a file named by the stage and a key. The key is a digest of the input's fingerprint, the
settings and the stages before, so that other input or other settings never meet what an earlier run kept. A
record is created once its table is complete; whatever a killed run left without a record is not looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.stats import fingerprint
from ..sources.commits import StoredTable, files_of


def input_of(df: DataFrame) -> str:
    """A table's fingerprint: names, types, and its rows in any order (one pass)."""
    row = fingerprint(df).first()
    return json.dumps([df.schema.simpleString(), *row])


def stored_input(table: StoredTable) -> str:
    """The fingerprint of a stored table's newest version, without reading it."""
    return json.dumps([table.path, table.version().number])


class Stages:
    """The stages of one run below ``path``; ``about`` is whatever the results depend on beside the stages before."""

    def __init__(self, spark: SparkSession, path: str, about: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.key = files_of(spark, self.path), _digest(about)
        self.kept: list[str] = []
        self.made: list[str] = []

    def _record(self, name: str, settings: str) -> str:
        self.key = _digest(self.key, name, settings)
        record = f"{name}-{self.key}.json"
        self.kept.append(record)
        return record

    def _note(self, record: str, content: dict) -> dict:
        """Creates the record; if another run was first, its record counts."""
        if self.files.create(f"stages/{record}", json.dumps(content)):
            return content
        return json.loads(self.files.read(f"stages/{record}"))

    def table(self, name: str, make: Callable[[], DataFrame], settings: str = "") -> DataFrame:
        """The stage's table: read if a run has finished it, else computed and kept."""
        record = self._record(name, settings)
        if record in self.files.names("stages"):
            found = json.loads(self.files.read(f"stages/{record}"))
        else:
            rows, folder = make(), f"tables/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            self.made.append(name)
            found = self._note(record, {"folder": folder, "schema": rows.schema.jsonValue()})
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['folder']}")

    def once(self, name: str, make: Callable[[], dict], settings: str = "") -> dict:
        """A stage whose result is a small record, such as the files it has written."""
        record = self._record(name, settings)
        if record in self.files.names("stages"):
            return json.loads(self.files.read(f"stages/{record}"))["value"]
        value = make()
        self.made.append(name)
        return self._note(record, {"value": value})["value"]

    def forget_others(self) -> list[str]:
        """Drops the records and tables of all other runs; not while another run is under way there."""
        mine = set(self.kept)
        names = self.files.names("stages")
        folders = {json.loads(self.files.read(f"stages/{r}")).get("folder") for r in names if r in mine}
        gone = [f"stages/{r}" for r in names if r not in mine]
        gone += [f"tables/{t}" for t in self.files.names("tables") if f"tables/{t}" not in folders]
        for name in gone:
            self.files.delete(name)
        return gone


def _digest(*texts: str) -> str:
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()[:24]
