"""Packs, CSV metadata, manifests file by file, lists and strata."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import manifest
from notelake.sources import files, packs

PACKS = "md5 string, tokens array<int>, onsets array<double>"


def some(spark, n, start=0):
    return spark.createDataFrame([(f"p{i}", list(range(i)), [0.5] * i) for i in range(start, start + n)], PACKS)


def test_packs_written_read_and_listed(spark, tmp_path):
    path = str(tmp_path / "packs")
    packs.write(some(spark, 9).repartition(3), path, least=2)
    packs.write(some(spark, 3, 20), path)  # a second job adds to the first
    want = {f"p{i}": i for i in (*range(2, 9), 20, 21, 22)}
    assert {r.md5: len(r.tokens) for r in packs.read(spark, path).collect()} == want
    assert {r.md5: r.length for r in packs.manifest(spark, path).collect()} == want
    assert all(os.path.exists(f"{path}/{r.path}") for r in packs.manifest(spark, path).collect())
    with np.load(f"{path}/{packs.manifest(spark, path).filter('md5 = ' + repr('p4')).first().path}") as pack:
        assert pack["tokens"].tolist() == [0, 1, 2, 3] and pack["onsets"].tolist() == [0.5] * 4
    assert {r.md5: r.length for r in packs.rebuilt_manifest(spark, path).collect()} == want
    packs.write(some(spark, 2, 50), path, mode="overwrite")
    assert {r.md5 for r in packs.read(spark, path).collect()} == {"p50", "p51"} and len(packs.committed(path)) == len([d for d in os.listdir(path) if d.startswith("part-")])


def test_a_failed_write_leaves_nothing_and_uncommitted_folders_do_not_count(spark, tmp_path):
    path = str(tmp_path / "packs")
    packs.write(some(spark, 3, 1), path)
    before = sorted(os.listdir(path))
    bad = some(spark, 6, 10).repartition(2).withColumn("md5", F.when(F.size("tokens") == 13, F.raise_error(F.lit("no such piece"))).otherwise(F.col("md5")))
    with pytest.raises(Exception, match="no such piece"):
        packs.write(bad, path)
    assert sorted(os.listdir(path)) == before
    os.makedirs(f"{path}/part-lost-00000-0")  # of a driver that died before the commit
    with open(f"{path}/part-lost-00000-0/x.npz", "wb") as f:
        np.savez(f, tokens=np.arange(3))
    assert {r.md5 for r in packs.read(spark, path).collect()} == {"p1", "p2", "p3"}


def test_unreadable_packs_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "packs")
    packs.write(some(spark, 2, 1).coalesce(1), path)
    part = f"{path}/{packs.committed(path)[0]}"
    open(f"{part}/broken.npz", "wb").write(b"PK\x03\x04 no pack")
    open(f"{part}/empty.npz", "wb").close()
    np.savez(f"{part}/other.npz", notes=np.arange(3))
    for got in (packs.read(spark, path), packs.rebuilt_manifest(spark, path)):
        assert {r.md5 for r in got.collect()} == {"p1", "p2"}
    assert packs.read(spark, str(tmp_path / "none")).count() == 0 and packs.manifest(spark, str(tmp_path / "none")).count() == 0


def test_csv_rows_keep_their_order_over_splits(spark, tmp_path):
    lines = [f'dir/{i % 7}.mid,"say ""{i}"", twice",{i}' for i in range(4000)]
    os.makedirs(tmp_path / "csv")
    (tmp_path / "csv" / "a.csv").write_text("path,title,n\n" + "\n".join(lines[:3000]) + "\n,no path,9\n")
    (tmp_path / "csv" / "b.csv").write_text("path,title,n\n" + "\n".join(lines[3000:]) + "\n")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        rows = files.metadata_csv(spark, str(tmp_path / "csv"), "path string, title string, n int")
        assert rows.rdd.getNumPartitions() > 4
        by_path, by_name = files.metadata_lookups(rows, "path")
        last = {r.key: (r.row.n, r.row.title) for r in by_path.collect()}
        first = {r.key: r.row.n for r in by_name.collect()}
    finally:
        spark.conf.set(size, before)
    assert last == {f"dir/{k}.mid": (n, f'say "{n}", twice') for k in range(7) for n in [max(i for i in range(4000) if i % 7 == k)]}
    assert first == {f"{k}.mid": k for k in range(7)}


def test_manifests_are_read_file_by_file(spark, tmp_path):
    folder = tmp_path / "m"
    os.makedirs(folder)
    entry = lambda i: {"piece_id": str(i), "length": i, "md5": f"m{i}"}
    (folder / "a.json").write_text("\n  " + json.dumps([entry(1), entry(2)], indent=1))
    (folder / "b.json").write_text("\n".join(json.dumps(entry(i)) for i in (3, 4, 5)) + "\n{broken\n")
    (folder / "c.json").write_text(json.dumps([entry(6)]))
    (folder / "d.json").write_text("")
    assert sorted(r.length for r in files.read_manifest(spark, str(folder)).collect()) == [1, 2, 3, 4, 5, 6]
    rows = spark.createDataFrame([(i, str(i), i * 10) for i in range(50)], "index long, piece_id string, length int").repartition(4)
    files.write_manifest(rows, str(tmp_path / "array"))
    for name in os.listdir(tmp_path / "array"):
        if name.startswith("part-"):
            assert isinstance(json.loads((tmp_path / "array" / name).read_text()), list)
    assert sorted(r.length for r in files.read_manifest(spark, str(tmp_path / "array")).collect()) == [i * 10 for i in range(50)]


def test_first_root_and_ordered_cap(spark, tmp_path):
    os.makedirs(tmp_path / "one")
    os.makedirs(tmp_path / "two")
    (tmp_path / "one" / "x.txt").write_text("x")
    (tmp_path / "two" / "y.MID").write_text("y")
    roots = [str(tmp_path / n) for n in ("none", "one", "two")]
    assert files.first_root(spark, roots, files.NOTE_FILE) == roots[2] and files.first_root(spark, roots[:2], files.NOTE_FILE) is None
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "a int, b int")
    assert [(r.a, r.b) for r in manifest.capped(df, 4, "a", "b").collect()] == [(0, 0), (0, 3), (0, 6), (0, 9)]


def test_rows_without_a_stratum_are_one(spark):
    rows = spark.createDataFrame([(i, "xy"[i % 2] if i % 6 else None) for i in range(60)], "id long, kind string")
    got = manifest.stratified(rows, "kind", "id", 30, 7).collect()
    assert len(got) == 30 and sum(r.kind is None for r in got) == 5


def test_a_tar_beyond_a_cell_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """One member of 2.2 GB (a hole on disk) between small ones: named members cost their own bytes."""
    import io
    import tarfile

    path = tmp_path / "big.tar"
    small = {f"notes/{i}.mid": os.urandom(2000 + i) for i in range(40)}
    long = "deep/" * 40 + "name.mid"
    with open(path, "wb") as raw:

        def add(name, data=None, size=0):
            info = tarfile.TarInfo(name)
            info.size = size or len(data)
            raw.write(info.tobuf(tarfile.GNU_FORMAT))
            raw.write(data) if data is not None else raw.seek(size, 1)
            raw.write(bytes(-info.size % 512))

        for k, (name, data) in enumerate(small.items()):
            add(name, data)
            if k == 19:
                add("huge.bin", size=2_200_000_000)
        add(long, b"x" * 10)
        raw.write(bytes(1024))
    monkeypatch.setattr(files, "RANGE", 20_000)
    index = files.archive_offsets(spark, str(tmp_path))
    found = {r.name: r for r in index.collect()}
    assert set(found) == {*small, "huge.bin", long} and found["huge.bin"].size == 2_200_000_000 and [r.place for r in sorted(found.values(), key=lambda r: r.offset)] == list(range(42))
    got = files.ranged(index.filter("size < 1000000")).withColumn("task", F.spark_partition_id())
    monkeypatch.setattr(files, "BATCH_BYTES", 5_000)
    assert {r.name: bytes(r.content) for r in got.collect()} == {**small, long: b"x" * 10}
    wanted = spark.createDataFrame([(n,) for n in ("notes/3.mid", "notes/33.mid", long, "none")], "name string")
    back = {r.name: r.content and bytes(r.content) for r in files.read_members(spark, str(tmp_path), wanted).collect()}
    assert back == {"notes/3.mid": small["notes/3.mid"], "notes/33.mid": small["notes/33.mid"], long: b"x" * 10, "none": None}
    assert io.BytesIO(bytes(back[long])).read(1) == b"x"
