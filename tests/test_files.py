import io
import json
import tarfile

from pyspark.sql import functions as F

from notelake.sources import files


def test_listing_index_and_bytes(spark, tmp_path):
    for name in ("b/x.MID", "b/a.midi", "a/z.mid", "a/notes.txt", "C/q.mid"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12345")
    rows = files.indexed(files.listing(spark, str(tmp_path))).orderBy("index").collect()
    assert [(r["index"], r.path.rsplit("/", 2)[1:]) for r in rows] == [(0, ["a", "z.mid"]), (1, ["b", "a.midi"]), (2, ["b", "x.MID"]), (3, ["C", "q.mid"])]
    assert files.listing(spark, str(tmp_path), any_case=False).count() == 3
    assert tuple(files.folder_bytes(spark, str(tmp_path)).first()) == (5, 25)


def test_archive_members_keep_their_order(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name, data in (("z.mid", b"1"), ("a.mid", b"22")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = files.archive_members(spark, str(tmp_path), True).orderBy("place").collect()
    assert [(r.name, r.size, bytes(r.content)) for r in rows] == [("z.mid", 1, b"1"), ("a.mid", 2, b"22")]
    assert files.archive_members(spark, str(tmp_path)).first().content is None
    wanted = spark.createDataFrame([("a.mid",), ("none.mid",)], "name string")
    assert {r.name: r.content and bytes(r.content) for r in files.read_members(spark, str(tmp_path), wanted).collect()} == {"a.mid": b"22", "none.mid": None}


def test_archives_are_written_in_parts_and_their_index_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", bytes([i % 7]) * (i * 100)) for i in range(40)], "name string, content binary").coalesce(1)
    files.write_archives(rows, str(tmp_path / "tars"), 20_000)
    assert len(list((tmp_path / "tars").glob("part-*"))) > 3
    first = files.archive_index(spark, str(tmp_path / "tars"), str(tmp_path / "cache"))
    assert {(r.name, r.size) for r in first.collect()} == {(f"m{i}", i * 100) for i in range(40)}
    again = files.archive_index(spark, str(tmp_path / "tars"), str(tmp_path / "cache"))
    assert again.inputFiles() == first.inputFiles() and len(list((tmp_path / "cache").iterdir())) == 1


def test_ingest_writes_an_index_once_and_stops_early(spark, tmp_path):
    from notelake.streaming import ingest

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda ids, name: spark.createDataFrame([(i, "", "en", "s", 100 + i * 10) for i in ids], schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    make([1, 2, 2, 30], "a.parquet")
    files_in = str(tmp_path / "in" / "*")
    run = lambda: ingest.ingest(spark, files_in, "*.parquet", spark.read.schema(schema).parquet(files_in).schema, *(str(tmp_path / n) for n in ("manifest", "ledger", "check")), 1)
    run()
    make([2, 30, 4, 5], "b.parquet")
    run()
    got = sorted(r["index"] for r in spark.read.parquet(str(tmp_path / "manifest")).collect())
    assert got == [1, 2, 4, 5, 30]
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(50)], "index long, accepted boolean").repartition(4)
    for most in (1, 5, 17, 99):
        want, n = [], 0
        for i in range(50):
            if n < most:
                want.append(i)
                n += i % 3 == 0
        assert sorted(r["index"] for r in ingest.first_accepted(rows, most, 7).collect()) == want


def test_manifests_logs_and_histories(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"piece_id": "a", "length": 5, "md5": "x"}, {"piece_id": "b", "tokens": 7, "npz_path": "p.npz"}]))
    rows = {r.piece_id: (r.length, r.npz_path) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert rows == {"a": (5, "x.npz"), "b": (7, "p.npz")}
    (tmp_path / "log.jsonl").write_text('{"index": 1}\n\n{"index": 1}\nbroken\n{"index": -4}\n{"index": 9}\n')
    assert tuple(files.log_state(spark, str(tmp_path / "log.jsonl")).first()) == (5, 2)
    (tmp_path / "h.json").write_text(json.dumps({"sessions": [{"start_time": "2024-01-01T00:00:00", "end_time": "2024-01-01T01:30:00", "final_val_loss": 2.5}, {"start_time": "x", "final_val_loss": None}]}))
    h = files.history(spark, str(tmp_path / "h.json"))
    total = h.agg(F.min("final_val_loss").alias("best"), F.sum(files.hours(F.col("start_time"), F.col("end_time"))).alias("hours")).first()
    assert (total.best, total.hours) == (2.5, 1.5)
