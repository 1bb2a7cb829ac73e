"""Files as tables: listings, archive members, manifests and logs.

Listings come from Spark's binary file source (no content is read unless asked
for), so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema

from notelake.sources.packs import opened

#: Note files, by suffix.
NOTE_FILE = r"\.midi?$"
#: Bytes of an archive that one task reads, bytes and rows that it hands on at a time.
RANGE, BATCH_BYTES, INDEX_ROWS = 128_000_000, 16_000_000, 10_000
OFFSETS = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("offset", pa.int64())])
MANIFEST = "piece_id string, path string, source string, composer string, length int, tokens int, md5 string, npz_path string, index long, _bad string"


def listing(spark: SparkSession, root: str, pattern: str = NOTE_FILE, any_case: bool = True) -> DataFrame:
    """(path, length) of the files below a folder whose path ends in the pattern, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(F.col("path").rlike(("(?i)" if any_case else "") + pattern)).distinct()


def indexed(files: DataFrame, any_case: bool = True) -> DataFrame:
    """A listing with its place in path order, per folder first (so that no task sorts a whole listing) and then over folders."""
    key = F.lower("path") if any_case else F.col("path")
    rows = files.withColumn("folder", F.regexp_replace(key, "/[^/]*$", "")).withColumn("key", key)
    counts = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("folder", F.coalesce(F.sum("n").over(W.orderBy("folder").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("folder").orderBy("key", "path")) - 1
    return rows.join(before, "folder").select((F.col("before") + own).alias("index"), "path", "length")


def _seekable(path: str):
    """A file that can be read from any place on."""
    files, place = opened(path)
    return files.open_input_file(place)


def archive_offsets(spark: SparkSession, root: str) -> DataFrame:
    """(archive, place, name, size, offset) of the members of the plain tar archives below a folder, in archive order.

    Only headers are read, hopping over what is between them, so an archive may be of any size.
    """

    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), OFFSETS, strict=True)], schema=OFFSETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, place = [], 0
                with _seekable(path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((path, place, m.name, m.size, m.offset_data))
                            place += 1
                        tar.members.clear()  # a header that was seen is let go
                        if len(rows) >= INDEX_ROWS:
                            yield table(rows)
                            rows.clear()
                if rows:
                    yield table(rows)

    return _tars(spark, root).select("path").repartition("path").mapInArrow(run, "archive string, place long, name string, size long, offset long")


def _tars(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tar,txt}").load(root)


def ranged(members: DataFrame) -> DataFrame:
    """``members`` (archive, offset, size, ...) with ``content``: only their own bytes are read, by as many tasks as they are ranges of ``RANGE`` bytes; a member may have 2 GB, as a cell may."""
    names = members.columns
    at = [names.index(c) for c in ("archive", "offset", "size")]
    types = to_arrow_schema(members.schema).append(pa.field("content", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, raw = None, None
        try:
            for batch in batches:
                held, size, begin = [], 0, 0
                for k, (archive, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in at), strict=True)):
                    if archive != path:
                        if raw is not None:
                            raw.close()
                        path, raw = archive, _seekable(archive)
                    raw.seek(offset)
                    held.append(raw.read(length))
                    size += length
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], schema=types)
                        held, size, begin = [], 0, k + 1
                if held:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], schema=types)
        finally:
            if raw is not None:
                raw.close()

    dealt = members.repartition("archive", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, members.schema.add("content", "binary"))


def packed_members(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(archive, place, name, size, content) of the members of compressed tar archives. They can't be read from the middle: each reaches its task as one cell, of 2 GB at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for place, m in enumerate(m for m in tar if m.isfile()):
                        data = tar.extractfile(m).read() if with_content else None
                        yield pd.DataFrame([(path, place, m.name, m.size, data)], columns=["archive", "place", "name", "size", "content"])

    tars = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tar.*,tgz}").load(root)
    return tars.select("path", "content").mapInPandas(run, "archive string, place long, name string, size long, content binary")


def archive_members(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(archive, place, name, size, content) of the members of the tar archives below a folder, in archive order: plain ones by byte ranges, compressed ones as a whole."""
    index = archive_offsets(spark, root)
    rows = ranged(index) if with_content else index.withColumn("content", F.lit(None).cast("binary"))
    return rows.select("archive", "place", "name", "size", "content").unionByName(packed_members(spark, root, with_content))


def write_archives(members: DataFrame, folder: str, most_bytes: int = 64_000_000) -> None:
    """(name, content) rows as tar archives of bounded size, each a file of its own.

    Spark's text writer ends a row with a line separator; a tar ends with zero bytes,
    of which the last is left to it.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, tar = None, None
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                if tar is None:
                    out = io.BytesIO()
                    tar = tarfile.open(fileobj=out, mode="w")
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                if out.tell() >= most_bytes:
                    tar.close()
                    yield pd.DataFrame({"archive": [out.getvalue()[:-1]]})
                    tar = None
        if tar is not None:
            tar.close()
            yield pd.DataFrame({"archive": [out.getvalue()[:-1]]})

    packed = members.select("name", "content").mapInPandas(pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=1).text(folder)


def archive_index(spark: SparkSession, root: str, cache: str) -> DataFrame:
    """(archive, place, name, size) of all members, read once: the index written at ``cache`` is used again as long as it lists the same archives with the same lengths and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string").alias("state"), F.count(F.lit(1)).alias("n"))
    key = "-".join(map(str, state.first()))
    path = f"{cache}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no index of this state yet
        archive_members(spark, root).drop("content").write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def read_members(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(name, content) for every name wanted, null where no archive has it; of several members of one name the first in path order counts. Of plain archives no other member's bytes are read."""
    names, found = wanted.select("name").distinct(), F.struct("archive", "place")
    index = archive_offsets(spark, root).join(names, "name", "left_semi")
    first = index.groupBy("name").agg(F.min_by(F.struct("archive", "place", "offset", "size"), found).alias("m")).select("name", "m.*")
    plain = ranged(first).select("name", "archive", "place", "content")
    packed = packed_members(spark, root, True).join(names, "name", "left_semi").select("name", "archive", "place", "content")
    either = plain.unionByName(packed).groupBy("name").agg(F.min_by("content", found).alias("content"))
    return wanted.select("name").join(either, "name", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as JSON arrays or as JSON lines (which Spark splits over tasks), each file by itself; rows that don't parse are dropped, the length falls back to the tokens.

    A file is an array if a line of it starts with "[": such files are read as a whole.
    The driver gets the files' names.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("v"))
    kinds = lines.groupBy("file").agg(F.max(F.startswith("v", F.lit("["))).alias("array")).collect()
    read = lambda files, whole: spark.read.schema(MANIFEST).option("multiLine", whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(files)
    parts = [read(files, whole) for whole in (True, False) if (files := sorted(r.file for r in kinds if r.array == whole))]
    rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else spark.createDataFrame([], MANIFEST)
    return rows.filter("_bad IS NULL").drop("_bad").withColumn("length", F.coalesce("length", "tokens")).withColumn("npz_path", F.coalesce("npz_path", F.concat("md5", F.lit(".npz"))))


def metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, and ``at``, which orders them as they stand: file, start of the split, row in the split (a CSV row has no number).

    Rows of a split reach one task in order, so an id that grows within a task orders
    them. Quotes within a field are doubled; a field holds no line end.
    """
    rows = spark.read.schema(schema).options(header=True, escape='"', mode="PERMISSIVE").csv(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", at.alias("at"))


def metadata_lookups(rows: DataFrame, path_col: str, at: str = "at") -> tuple[DataFrame, DataFrame]:
    """By relative path (the last row counts) and by file name (the first row counts): (key, row)."""
    given = rows.filter(F.trim(path_col) != "")
    path = F.regexp_replace(F.trim(path_col), r"\\", "/")
    key = lambda c: given.withColumn("key", c).groupBy("key")
    whole = F.struct(*[c for c in rows.columns if c != at])
    return key(path).agg(F.max_by(whole, at).alias("row")), key(F.element_at(F.split(path, "/"), -1)).agg(F.min_by(whole, at).alias("row"))


def file_list(spark: SparkSession, path: str, files: DataFrame | None = None, pattern: str = NOTE_FILE) -> DataFrame:
    """(path) of a JSON-lines list, each once: lines that are blank, broken or name no such file go; with a listing (path) also what isn't there.

    The listing is as large as the store; where it is much larger than the list Spark
    puts a Bloom filter of the list's paths before its exchange.
    """
    listed = spark.read.schema("path string").json(path).select(F.trim("path").alias("path")).filter(F.col("path").rlike("(?i)" + pattern)).distinct()
    return listed if files is None else listed.join(files.select("path").distinct(), "path", "left_semi")


def first_root(spark: SparkSession, roots: list[str], pattern: str) -> str | None:
    """The first of a few folders that has a file by the pattern; a folder that isn't there has none."""
    for root in roots:
        try:
            if not listing(spark, root, pattern).isEmpty():
                return root
        except AnalysisException:  # no such folder
            continue
    return None


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest for readers that take JSON arrays only: each task writes its rows as an array of its own, a row a line."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(mark + line)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    json = rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
    json.mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def log_state(spark: SparkSession, path: str) -> DataFrame:
    """One row (rows, done) of a JSON-lines log: rows that are not blank, and the valid indexes among them."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    index = F.get_json_object("value", "$.index").try_cast("long")
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(index >= 0, index)).alias("done"))


def folder_bytes(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root, ".").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of a training history document, a row each."""
    doc = spark.read.schema("sessions array<struct<start_time:string,end_time:string,epochs_completed:int,end_epoch:int,final_val_loss:double>>").option("multiLine", True).json(path)
    return doc.select(F.inline("sessions"))


def hours(start: Column, end: Column) -> Column:
    """Hours between two ISO times; null where one does not parse."""
    return (F.try_to_timestamp(end).cast("double") - F.try_to_timestamp(start).cast("double")) / 3600
