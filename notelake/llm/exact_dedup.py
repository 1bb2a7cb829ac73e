"""Exact dedup with a persistent digest index.

The index is a set of tables, each bucketed and sorted by the SHA-256 of the
normalised text: (digest, points, doc_id), points being the code points of the text
that the row stands for, with one row a digest and one file a bucket. A batch is
digested once, pre-aggregated to its best row per digest, dealt and sorted once, and
taken through sort-merge anti-joins with the tables, which are read in their buckets
and in their order: the index side has neither an exchange nor a sort. What is new
becomes the newest table: texts that the index doesn't hold, and a row that beats
what it holds of a text (more code points, then the smaller id). Tables are merged
once there are more than ``LEVELS``, the newest first and older ones only when they
are not much larger, so a row is rewritten a logarithmic number of times and files
don't pile up. The keeper of a text is the best of its rows in the tables, taken on
reading; so it doesn't depend on how or in what order rows were dealt into batches,
and a merge that was cut off leaves rows twice, which changes nothing. A digest
shared by a third of all rows is one row after the partial aggregation, and AQE
splits it in the join back. Tables stand in the shared folder.

Defined results: null text counts as empty; all empty texts are equal; ties in
length go to the smallest id, a null id coming last; rows that repeat an id are
counted each; an empty batch adds nothing and yields no rows; very long texts
need no more than a row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import forget, id_and_text, keep, new_path, one_row_each

#: Characters that do not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"
#: Batches in which :func:`dedup` brings a table to the index.
BATCHES = 3
#: Tables of an index before some are merged.
LEVELS = 4


def text_digest(text: Column) -> Column:
    """SHA-256 of a text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, points) of every row: SHA-256 without white space, code points of the original."""
    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        text_digest(F.col("text")).alias("digest"),
        F.char_length("text").alias("points"),
    )


def _rank(prefix: str = "") -> Column:
    """What orders rows of equal texts; the least stays."""
    points, own = F.col(f"{prefix}points"), F.col(f"{prefix}doc_id")
    return F.struct((-points).alias("less"), own.isNull().alias("none"), own.alias("id"))


class DigestIndex:
    """A digest index under a name, to which batches are added; tables ``name_0``, ``name_1`` ... make it up."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, folder: str | None = None):
        """``buckets`` counts for an index that is yet to be made; one that exists has its own number. ``folder`` is where tables go: the shared folder unless it is named."""
        self.spark, self.name, self.folder = spark, name, folder
        own = None
        if tables := self.tables():
            own = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {tables[0]}").collect()}.get("Num Buckets")
        self.buckets = int(own or buckets or spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[str]:
        """Names of the tables, oldest first."""
        found = (t.name.rpartition("_") for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name.lower()}_"))
        return [f"{self.name}_{n}" for n in sorted(int(n) for head, _, n in found if head == self.name.lower() and n.isdigit())]

    def _levels(self) -> list[DataFrame]:
        return [self.spark.table(t) for t in self.tables()]

    def _add(self, rows: DataFrame) -> None:
        """A new table of rows that are dealt by digest into the buckets, a task a bucket."""
        tables = self.tables()
        name = f"{self.name}_{int(tables[-1].rpartition('_')[2]) + 1 if tables else 0}"
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}" if self.folder else new_path(self.spark, name)
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)
        if not self.spark.table(name).inputFiles():  # nothing was new
            self._drop(name, path)

    def read(self) -> DataFrame:
        """(digest, points, doc_id) of all rows."""
        levels = self._levels()
        return reduce(DataFrame.unionByName, levels) if levels else self.spark.createDataFrame([], "digest binary, points int, doc_id long")

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Of digested rows what the index needs to learn: per digest the best row, if no index row is as good."""
        groups = rows.groupBy("digest").agg(F.min(_rank()).alias("best"))
        # dealt as the tables are bucketed, so that only the batch is shuffled; the second grouping shuffles nothing, but keeps the anti-join above the exchange
        groups = groups.repartition(self.buckets, "digest").groupBy("digest").agg(F.min("best").alias("best"))
        groups = groups.select("digest", (-F.col("best.less")).alias("points"), F.col("best.id").alias("doc_id"))
        for level in reversed(self._levels()):
            known = level.select(F.col("digest").alias("__digest"), F.col("points").alias("__points"), F.col("doc_id").alias("__doc_id"))
            groups = groups.join(known.hint("merge"), (F.col("digest") == F.col("__digest")) & (_rank("__") <= _rank()), "left_anti")
        return groups

    def append(self, rows: DataFrame) -> None:
        """Add the digested rows of a batch."""
        with ordered_buckets(self.spark):
            self._add(self.fresh(rows))
            self._compact()

    def _compact(self) -> None:
        """Merge the newest tables once there are too many: as far back as a table is at most twice as large as all newer ones together."""
        tables = self.tables()
        if len(tables) <= LEVELS:
            return
        sizes = [self.spark.table(t).count() for t in tables]
        first = len(tables) - 2
        while first > 0 and sizes[first - 1] <= 2 * sum(sizes[first:]):
            first -= 1
        old = tables[first:]
        with setting(self.spark, "spark.sql.sources.bucketing.enabled", False):  # as plain files: a union of bucketed scans would be written in as many files a bucket
            rows = reduce(DataFrame.unionByName, [self.spark.table(t) for t in old])
            best = rows.groupBy("digest").agg(F.min(_rank()).alias("best")).repartition(self.buckets, "digest")
            self._add(best.select("digest", (-F.col("best.less")).alias("points"), F.col("best.id").alias("doc_id")))
        for t in old:
            self._drop(t)

    def keepers(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id) and the other columns of rows with distinct digests that the index holds; only they are shuffled."""
        found, ranks = digests.repartition(self.buckets, "digest"), []
        for k, level in enumerate(self._levels()):
            known = level.select(F.col("digest").alias(f"__digest_{k}"), _rank().alias(f"__rank_{k}")).hint("merge")
            found, ranks = found.join(known, F.col("digest") == F.col(f"__digest_{k}"), "left"), [*ranks, F.col(f"__rank_{k}")]
        best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
        return found.select(*digests.columns, best["id"].alias("keep_id"))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """Of digested rows that were appended: doc_id, keep_id, group_size (among ``rows``), kept, text_sha256."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        if not self.tables():
            sizes = sizes.filter("false").withColumn("keep_id", F.lit(None).cast("long"))
        else:
            with ordered_buckets(self.spark):
                sizes = keep(self.keepers(sizes), "digest-verdicts")  # so that the next join has two exchanges of its own, which AQE may split
        return rows.join(sizes, "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def _drop(self, table: str, path: str | None = None) -> None:
        """The table and its files: it isn't a managed one."""
        path = path or next(iter(self.spark.table(table).inputFiles())).rpartition("/")[0]
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        forget(self.spark, path)

    def drop(self) -> None:
        for table in self.tables():
            self._drop(table)


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """Within, a setting of the session has another value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ordered_buckets(spark: SparkSession):
    """Within, a bucket of one file counts as sorted."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Verdicts on every row of a table that comes to a new index in batches, as it would over days; the index is dropped in the end."""
    spark = docs.sparkSession
    index = DigestIndex(spark, new_path(spark, "digests").rpartition("/")[2].replace("-", "_"))
    rows = keep(digests(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id", "points"), F.lit(batches))), "digests")
    try:
        for k in range(batches):
            index.append(rows.filter(F.col("batch") == k))
        return index.verdicts(rows)
    finally:
        index.drop()


def drop_copies(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts one row, whether or not ids repeat or are null."""
    kept = verdicts.filter("kept").groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return one_row_each(docs, keep(kept, "exact-verdicts"), text_digest(F.coalesce(F.col(text_col), F.lit(""))), id_col, text_col)
