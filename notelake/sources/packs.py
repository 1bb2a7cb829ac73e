"""Token packs: a NumPy archive a piece, written and read as a Spark data source.

``df.write.format("packs")`` takes rows (md5, tokens, and any other array columns)
and writes ``part-<job>-<task>-<attempt>/<md5>.npz``, with the task's manifest lines
beside them. A task tells the driver no more than its folder and its counts; the
commit is one file that names the folders which count. What a failed attempt or an
aborted job has written is removed, and would not be read in any case. So a lost
executor leaves nothing behind, and nothing has to be moved.

``spark.read.format("packs")`` gives (md5, tokens) of the committed packs, a task a
folder; a pack that can't be read or has no tokens is passed over. The manifest
(:func:`manifest`) is read without opening packs.

Files go through Arrow's file systems (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "md5 string, tokens array<int>"
MANIFEST = "md5 string, length int, path string"
#: Packs that a reader hands on at a time.
BATCH = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the place in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def listed(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return files.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def committed(path: str) -> list[str]:
    """Folders that count, of all commits."""
    files, place = opened(path)
    out: list[str] = []
    for info in listed(files, place):
        if info.base_name.startswith("_commit-"):
            with files.open_input_stream(info.path) as stream:
                out += json.loads(stream.read())["parts"]
    return sorted(out)


@dataclass
class Part(WriterCommitMessage, InputPartition):
    """A task's folder: what it tells when it has written it, and what a task reads."""

    folder: str
    packs: int = 0
    tokens: int = 0


class PackSource(DataSource):
    """Options: path; for writing also least (pieces with fewer tokens are left out, 1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], int(self.options.get("least", 1)), overwrite)


class PackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(folder) for folder in committed(self.path)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, place = opened(self.path)
        ids, rows = [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.list_(pa.int32()))], ["md5", "tokens"])
            ids.clear(), rows.clear()
            return made

        for info in listed(files, f"{place}/{partition.folder}") if partition.folder else ():
            if not info.base_name.endswith(".npz"):
                continue
            with files.open_input_stream(info.path) as stream:
                tokens = tokens_of(stream.read())
            if tokens is not None:
                ids.append(info.base_name.removesuffix(".npz"))
                rows.append(tokens)
            if len(ids) >= BATCH:
                yield batch()
        if ids:
            yield batch()


def tokens_of(content: bytes) -> np.ndarray | None:
    """A pack's tokens; nothing if it can't be read or has none."""
    try:
        with np.load(io.BytesIO(content)) as arrays:
            return arrays["tokens"].astype(np.int32).ravel() if "tokens" in arrays else None
    except (OSError, ValueError, EOFError, zipfile.BadZipFile):
        return None


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, least: int, overwrite: bool):
        self.path, self.least, self.overwrite, self.job = path, least, overwrite, uuid.uuid4().hex[:12]
        self.before = committed(path) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, place = opened(self.path)
        context = TaskContext.get()
        part = Part(f"part-{self.job}-{context.partitionId():05d}-{context.attemptNumber()}")
        folder, lines = f"{place}/{part.folder}", []
        files.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                names = batch.schema.names
                for row in zip(*batch.columns, strict=True):
                    arrays = {n: v.as_py() for n, v in zip(names, row, strict=True)}
                    name = arrays.pop("md5")
                    tokens = np.asarray(arrays.pop("tokens") or [], np.int32)
                    if name is None or len(tokens) < self.least:
                        continue
                    pack = io.BytesIO()
                    np.savez_compressed(pack, tokens=tokens, **{n: np.asarray(v) for n, v in arrays.items() if v is not None})
                    with files.open_output_stream(f"{folder}/{name}.npz") as out:
                        out.write(pack.getvalue())
                    lines.append(json.dumps({"md5": name, "length": len(tokens), "path": f"{part.folder}/{name}.npz"}))
                    part.packs, part.tokens = part.packs + 1, part.tokens + len(tokens)
            with files.open_output_stream(f"{folder}/manifest.jsonl") as out:
                out.write("".join(f"{line}\n" for line in lines).encode())
        except BaseException:
            files.delete_dir(folder)
            raise
        return part

    def _remove(self, keep: set[str]) -> None:
        """This job's folders but for those to keep: what lost attempts have left."""
        files, place = opened(self.path)
        for info in listed(files, place):
            if info.base_name.startswith(f"part-{self.job}-") and info.base_name not in keep:
                files.delete_dir(info.path)

    def commit(self, messages: list[Part | None]) -> None:
        files, place = opened(self.path)
        parts = sorted(m.folder for m in messages if m is not None and m.packs)
        self._remove(set(parts))
        old = [i.path for i in listed(files, place) if i.base_name.startswith("_commit-")] if self.overwrite else []
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/_commit-{self.job}.json") as out:
            out.write(json.dumps({"parts": parts, "packs": sum(m.packs for m in messages if m), "tokens": sum(m.tokens for m in messages if m)}).encode())
        for path in old:
            files.delete_file(path)
        for folder in self.before:
            files.delete_dir(f"{place}/{folder}")

    def abort(self, messages: list[Part | None]) -> None:
        self._remove(set())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)


def write(packs: DataFrame, path: str, least: int = 1, mode: str = "append") -> None:
    """(md5, tokens, ...) rows as packs with a manifest; pieces of fewer than ``least`` tokens are left out."""
    register(packs.sparkSession)
    packs.write.format("packs").option("path", path).option("least", least).mode(mode).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(md5, tokens) of the packs that can be read."""
    register(spark)
    return spark.read.format("packs").option("path", path).load()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(md5, length, path) of the committed packs, as their writers listed them."""
    parts = [f"{path}/{folder}/manifest.jsonl" for folder in committed(path)]
    return spark.read.schema(MANIFEST).json(parts) if parts else spark.createDataFrame([], MANIFEST)


def rebuilt_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(md5, length, path) of the packs below any folder, from the packs themselves, whoever wrote them; unreadable ones are passed over."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p.as_py(), tokens_of(c.as_py())) for p, c in zip(batch.column(0), batch.column(1), strict=True)]
            rows = [(p.rpartition("/")[2].removesuffix(".npz"), len(t), p) for p, t in found if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.string(), pa.int32(), pa.string()), strict=True)], ["md5", "length", "path"])

    packs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)
    return packs.select("path", "content").mapInArrow(lengths, MANIFEST)
