"""Text search over stored rows by an inverted index of trigrams.

Rows are stored in blocks, neighbours in time together. The index says for every run of three characters which blocks
hold it. A search reads the postings of its keyword's trigrams, keeps the blocks that hold all of them, reads only
these, and applies the exact filter there: the rows are those of a scan. A keyword of fewer than three
characters has no trigram; then every block is read.

Both tables have versions (see ``sources.commits``). New rows get blocks and postings of their own, so that adding
rewrites nothing; ``compact`` puts the postings of many additions together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import PART, StoredTable
from . import alerts as al
from . import logs as lg

GRAM, BUCKETS, ROWS_PER_BLOCK = 3, 64, 100_000


def grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.when(F.length(text) >= GRAM, runs).otherwise(F.array().cast("array<string>")))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("string")


class SearchIndex:
    """Rows and postings below ``path``; ``text`` is what a keyword may stand in, in lower case."""

    def __init__(self, spark: SparkSession, path: str, text: Column, order: Sequence[str] = ()):
        self.spark, self.text, self.order = spark, text, list(order)
        self.rows, self.postings = StoredTable(spark, f"{path}/rows"), StoredTable(spark, f"{path}/grams")

    def add(self, rows: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> int:
        """Stores rows, in blocks of about ``rows_per_block`` in the order given, with their postings; the number of blocks."""
        n = rows.count()
        name = uuid.uuid4().hex[:12]
        blocks = -(-n // rows_per_block)
        if blocks > 1:
            # A tie-break, so that rows of one time need not be one block.
            rows = rows.repartitionByRange(blocks, *self.order, F.xxhash64(*rows.columns))
        elif blocks:
            rows = rows.coalesce(1)
        block = F.concat(F.lit(f"{name}-"), F.spark_partition_id().cast("string"))
        if self.rows.version() is None:
            self._first(rows.schema)
        written = self.rows.write(rows, block)
        if not written:
            return 0
        self._post(written, name)
        # Postings first: a block that is read has them, and postings of a block that is not do no harm.
        self.rows.attach(written)
        return len(written)

    def _first(self, schema: T.StructType) -> None:
        for table, shape in ((self.postings, "gram string, blocks array<string>"), (self.rows, schema)):
            if table.version() is None:
                empty = self.spark.createDataFrame([], shape)
                try:
                    table.create(empty, F.lit("none"))
                except FileExistsError:
                    # Another writer was first.
                    pass

    def _post(self, written: dict[str, str], name: str) -> None:
        """Writes and commits the postings of new blocks, as parts of their own."""
        folder = next(iter(written.values())).rsplit("/", 1)[0]
        schema = T.StructType([*T.StructType.fromJson(self.rows.version().schema).fields, T.StructField(PART, T.StringType())])
        stored = self.spark.read.schema(schema).parquet(f"{self.rows.path}/{folder}")
        # The text as a column of its own, or it would be made anew for every run of a row.
        texts = stored.select(PART, self.text.alias("_text"))
        found = texts.select(PART, F.explode(grams(F.col("_text"))).alias("gram")).distinct()
        # At most as many entries per trigram as this addition has blocks.
        posted = found.groupBy("gram").agg(F.sort_array(F.collect_list(PART)).alias("blocks"))
        self.postings.attach(self.postings.write(posted, F.concat(F.lit(f"{name}."), bucket(F.col("gram")))))

    def candidates(self, keyword: str) -> list[str] | None:
        """Blocks that hold all trigrams of the keyword; None if it has none."""
        text = keyword.lower()
        wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
        buckets = {r["b"] for r in asked.select(bucket(F.col("gram")).alias("b")).distinct().collect()}
        version = self.postings.version()
        parts = [p for p in version.parts if p.split(".")[1] in buckets] if version else []
        held = self.postings.read(version, parts) if version else asked.select("gram", F.array().cast("array<string>").alias("blocks"))
        found = held.where(F.col("gram").isin(wanted)).select("gram", F.explode("blocks").alias("block"))
        all_of_them = found.groupBy("block").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        return sorted(r["block"] for r in all_of_them.select("block").collect())

    def search(self, keyword: str, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``exact`` finds among all rows, read from candidate blocks only."""
        version = self.rows.version()
        if version is None:
            raise ValueError(f"no rows at {self.rows.path}")
        blocks = self.candidates(keyword)
        known = None if blocks is None else set(blocks) & set(version.parts)
        return exact(self.rows.read(version, known))

    def compact(self) -> None:
        """Puts the postings of all additions together, one part per bucket."""
        version = self.postings.version()
        if version is None or not version.parts:
            return

        def merged(rows: DataFrame) -> DataFrame:
            each = rows.select("gram", F.explode("blocks").alias("b")).distinct()
            return each.groupBy("gram").agg(F.sort_array(F.collect_list("b")).alias("blocks"))

        name = uuid.uuid4().hex[:12]
        new = [f"{name}.{b}" for b in range(BUCKETS)]
        self.postings.change([*version.parts, *new], merged, F.concat(F.lit(f"{name}."), bucket(F.col("gram"))))


ALERT_TEXTS = ("message", "description")


def alert_index(spark: SparkSession, path: str, columns: Sequence[str], date: str = "created_at") -> SearchIndex:
    """An index over alerts with these columns."""
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ALERT_TEXTS if c in columns]
    return SearchIndex(spark, path, F.concat_ws("\n", *texts), [date])


def search_alerts(index: SearchIndex, keyword: str, **options) -> DataFrame:
    """``alerts.search`` by way of the index."""
    return index.search(keyword, lambda rows: al.search(rows, keyword, **options))


def log_index(spark: SparkSession, path: str, columns: Sequence[str], date: str = "timestamp") -> SearchIndex:
    """An index over log records with these columns; a record's text is its JSON form."""
    return SearchIndex(spark, path, F.lower(F.to_json(F.struct(*columns))), [date])


def search_logs(index: SearchIndex, text: str, **options) -> DataFrame:
    """``logs.search_logs`` by way of the index."""
    return index.search(text, lambda rows: lg.search_logs(rows, text, **options))
