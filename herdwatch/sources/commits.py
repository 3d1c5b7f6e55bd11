"""Stored tables with versions: a folder of numbered manifests beside immutable data folders.

    path/log/00000000000000000007.json   version 7: its parts by key, written once and never changed
    path/data/<name>/part=<key>/         rows of one part as one save wrote them

A save writes its parts to a new data folder, then creates the next manifest, which fails if another writer was
first. Nobody reads a folder that no manifest names, so a save is there as a whole or not at all, whatever is
interrupted, and a reader that has taken a version keeps its rows while others save. Readers write nothing.

Manifests list parts (days, buckets), not single files: their size is bounded by the calendar or the number of buckets.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import or_
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part"
ATTEMPTS = 50


class Conflict(Exception):
    """Another writer has changed the same parts again and again."""


class LocalFiles:
    """A folder of a file system that the driver sees; a hard link creates a complete file or fails."""

    def __init__(self, folder: str):
        self.folder = urlparse(folder).path if folder.startswith("file:") else folder

    def names(self, below: str) -> list[str]:
        try:
            return os.listdir(f"{self.folder}/{below}")
        except FileNotFoundError:
            return []

    def read(self, name: str) -> str:
        with open(f"{self.folder}/{name}", encoding="utf-8") as file:
            return file.read()

    def create(self, name: str, text: str) -> bool:
        target = f"{self.folder}/{name}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def delete(self, name: str) -> None:
        target = f"{self.folder}/{name}"
        shutil.rmtree(target) if os.path.isdir(target) else os.unlink(target)


class HadoopFiles:
    """A folder of any other file system; a rename that refuses to replace creates a complete file or fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway, self.folder = spark._jvm, spark.sparkContext._gateway, folder
        self.fs = self.jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(conf)
        self.context = self.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def _path(self, name: str):
        return self.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str) -> list[str]:
        folder = self._path(below)
        return [e.getPath().getName() for e in self.files.listStatus(folder)] if self.files.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        target = self._path(name)
        draft = self.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(text.encode("utf-8"))
        stream.close()
        kinds = getattr(self.fs, "Options$Rename")
        never_replace = self.gateway.new_array(kinds, 1)
        never_replace[0] = kinds.NONE
        try:
            self.context.rename(draft, target, never_replace)
        except Exception as error:  # noqa: BLE001
            self.files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self._path(name), True)


def files_of(spark: SparkSession, path: str) -> LocalFiles | HadoopFiles:
    scheme = urlparse(path).scheme
    if not scheme:
        scheme = urlparse(spark._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    return LocalFiles(path) if scheme == "file" else HadoopFiles(spark, path)


@dataclass(frozen=True)
class Version:
    """What a manifest says: the folder of each part, the parts this version changed, batches written so far."""

    number: int
    schema: dict
    parts: dict[str, str]
    changed: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    info: dict = field(default_factory=dict)


class StoredTable:
    """A table at a path, with versions from 0 on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = files_of(spark, self.path)

    # Versions
    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("log") if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the newest; None if there is none."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return None
            number = numbers[-1]
        elif number not in self.numbers():
            raise ValueError(f"no version {number} of {self.path}")
        return Version(**json.loads(self.files.read(self._name(number))))

    def _name(self, number: int) -> str:
        return f"log/{number:020d}.json"

    def _known(self, number: int | None = None) -> Version:
        found = self.version(number)
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return found

    # Reading
    def read(self, version: int | Version | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of one version, or of some of its parts; other saves do not change them."""
        taken = version if isinstance(version, Version) else self._known(version)
        schema = StructType.fromJson(taken.schema)
        folders = [f for key, f in taken.parts.items() if parts is None or key in set(parts)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows of the parts that differ between two versions: ``sign`` -1 as they were, 1 as they are.

        Rows that a save rewrote unchanged occur with both signs, so that sums over ``sign`` are right.
        ``since`` = -1 stands for the empty table.
        """
        new = self._known(until)
        old = self._known(since) if since >= 0 else Version(-1, new.schema, {})
        gone = [k for k, f in old.parts.items() if new.parts.get(k) != f]
        come = [k for k, f in new.parts.items() if old.parts.get(k) != f]
        before = self.read(old, gone).withColumn("sign", F.lit(-1))
        return before.unionByName(self.read(new, come).withColumn("sign", F.lit(1)), allowMissingColumns=True)

    # Writing
    def write(self, rows: DataFrame, part: Column) -> dict[str, str]:
        """Writes rows as new parts, which no version names yet: their folders by key."""
        name = f"data/{uuid.uuid4().hex}"
        keyed = rows.withColumn(PART, part)
        # Few files per part, large parts in several.
        keyed.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{name}")
        found = [n for n in self.files.names(name) if n.startswith(f"{PART}=")]
        return {unquote(n.removeprefix(f"{PART}=")): f"{name}/{n}" for n in found}

    def create(self, rows: DataFrame, part: Column, info: dict | None = None) -> Version:
        """Version 0; raises if there is a table already."""
        if self.numbers():
            raise FileExistsError(f"there is a table at {self.path}")
        parts = self.write(rows, part)
        made = Version(0, rows.schema.jsonValue(), parts, sorted(parts), {}, info or {})
        if not self._commit(made):
            raise FileExistsError(f"there is a table at {self.path}")
        return made

    def _commit(self, version: Version) -> bool:
        return self.files.create(self._name(version.number), json.dumps(asdict(version)))

    def change(
        self, concerned: Iterable[str], make: Callable[[DataFrame], DataFrame], part: Column, batch: tuple[str, int] | None = None,
        schema: StructType | None = None,
    ) -> Version:
        """Replaces the ``concerned`` parts by what ``make`` gives for their rows, as one new version.

        ``make`` runs again if another writer has changed one of these parts meanwhile; after a save of
        other parts only the manifest is made anew. ``batch`` (writer, number) is noted in the version: a batch
        number that this writer has reached before changes nothing. ``schema`` is that of the new version, by default
        the old one; columns that older parts lack are null there.
        """
        concerned = set(concerned)
        base, parts = self._known(), None
        for _ in range(ATTEMPTS):
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            if parts is None:
                # Files have the table's types, whatever types the merge has widened.
                fields = (schema or StructType.fromJson(base.schema)).fields
                made_rows = make(self.read(base, concerned))
                parts = self.write(made_rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]), part)
                if not set(parts) <= concerned:
                    raise ValueError(f"rows left their parts: {sorted(set(parts) - concerned)[:5]}")
            kept = {k: f for k, f in base.parts.items() if k not in concerned}
            batches = {**base.batches, **({batch[0]: batch[1]} if batch else {})}
            columns = schema.jsonValue() if schema else base.schema
            made = Version(base.number + 1, columns, {**kept, **parts}, sorted(concerned), batches, base.info)
            if self._commit(made):
                return made
            newest = self._known()
            if any(newest.parts.get(k) != base.parts.get(k) for k in concerned):
                parts = None
            base = newest
        raise Conflict(f"{ATTEMPTS} attempts to save to {self.path}")

    def attach(self, parts: dict[str, str]) -> Version:
        """Adds parts with new keys, which ``write`` has written, as one new version; no other save is in the way."""
        for _ in range(ATTEMPTS):
            base = self._known()
            if set(parts) & set(base.parts):
                raise ValueError("there are parts of this key")
            made = Version(base.number + 1, base.schema, {**base.parts, **parts}, sorted(parts), base.batches, base.info)
            if not parts or self._commit(made):
                return made if parts else base
        raise Conflict(f"{ATTEMPTS} attempts to save to {self.path}")

    def forget(self, before: int) -> list[str]:
        """Drops versions below ``before`` and the data folders that only they name; the names of what is gone.

        Folders that no version has named, such as those of a save in progress, stay.
        """
        numbers = self.numbers()
        old = [n for n in numbers if n < min(before, numbers[-1])] if numbers else []
        kept = reduce(or_, (set(self.version(n).parts.values()) for n in numbers if n not in old), set())
        dropped = sorted(reduce(or_, (set(self.version(n).parts.values()) for n in old), set()) - kept)
        # Manifests first: nobody can take a version whose rows are half gone.
        for name in [*map(self._name, old), *dropped]:
            self.files.delete(name)
        return dropped


def parts_of(rows: DataFrame, part: Column) -> list[str]:
    """Keys that occur; bounded by the calendar or the number of buckets."""
    return [r[PART] for r in rows.select(part.alias(PART)).distinct().collect()]
