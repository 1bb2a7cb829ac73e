import base64
import glob
import gzip
import hashlib
import io
import os
import zlib

from notelake.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, file int"


def brute(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h, *_ in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(digest(h), i)
    return sorted((i, len((h or "").encode()), digest(h), "response" if first[digest(h)] == i else "revisit", None if first[digest(h)] == i else first[digest(h)]) for i, _, h, *_ in rows)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def records(folder):
    return [h for f in sorted(glob.glob(f"{folder}/part-*")) for h, _ in warc.parse(warc.opened(open(f, "rb").read()))]


def read(spark, folder):
    return sorted(map(tuple, warc.read_archives(spark, str(folder)).select(*COLUMNS).collect()), key=repr)


def test_round_trip_and_revisits(spark, tmp_path):
    html = ["<p>é🎹</p>", None, "", "a\r\n\r\nWARC/1.1\r\nb", "x" * 100_000, "\r\n", "a\r\n\r\nWARC/1.1\r\nb", "\x00\x01", "<p>é🎹</p>", "<p>é🎹</p>"]
    rows = [(i * 7 % 11 + 1, f"http://h/{i}\r\nX: y" if i else None, h, "z", 3) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    raw, clean, again = (str(tmp_path / n) for n in ("raw", "clean", "again"))
    warc.write_responses(pages, raw)
    assert {r.page_id: r.payload.decode() for r in warc.read_archives(spark, raw, True).collect()} == {r[0]: r[2] or "" for r in rows}
    warc.deduplicate(spark, raw, clean)
    assert read(spark, clean) == sorted(brute(rows), key=repr)
    back = warc.read_archives(spark, clean, True).collect()
    assert all(r.intact for r in back) and {r.payload for r in back if r.record_type == "revisit"} == {b""}
    for folder in (raw, clean):
        ids = [h["warc-record-id"] for h in records(folder)]
        assert len(ids) == len(set(ids))
    assert not {h["warc-record-id"] for h in records(raw)} & {h["warc-record-id"] for h in records(clean)}
    known = {h.get("x-page-id"): h for h in records(clean)}
    for h in records(clean):
        if h["warc-type"] == "revisit":
            first = known[h["x-refers-to-page-id"]]
            assert h["warc-refers-to"] == first["warc-record-id"] and h["warc-refers-to-target-uri"] == first["warc-target-uri"] and h["warc-profile"] == warc.PROFILE
    # once more: nothing but the ids changes, and no payload is lost
    warc.deduplicate(spark, clean, again)
    assert read(spark, again) == read(spark, clean)
    assert sorted(r.payload for r in warc.read_archives(spark, again, True).collect()) == sorted(r.payload for r in back)
    bare = str(tmp_path / "bare")
    warc.deduplicate(spark, raw, bare, least_bytes=1_000_000)
    assert warc.read_archives(spark, bare).filter("record_type = 'revisit'").count() == 0


def test_one_gzip_member_a_record_and_files_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", base64.b64encode(hashlib.sha512(b"%d" % i).digest() * 40).decode(), "", 0) for i in range(30)]
    warc.write_responses(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "r"), 1000)
    files = glob.glob(f"{tmp_path}/r/part-*")
    assert len(files) > 3 and max(map(os.path.getsize, files)) < 6000
    warc.write_responses(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "s"))
    for f in glob.glob(f"{tmp_path}/s/part-*"):
        data, starts = open(f, "rb").read(), 0
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n") and one.eof
            data, starts = one.unused_data, starts + 1
        assert starts == sum(1 for _ in warc.parse(warc.opened(open(f, "rb").read())))
    assert {r.page_id for r in warc.read_archives(spark, str(tmp_path / "r")).collect()} == set(range(30))
    large = bytes(40_000_000)
    assert warc.members(large).endswith(b"\0") and gzip.decompress(warc.members(large)) == large


def foreign(kind, url, payload=None, digest=None, **more):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + (payload or b"")
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{url}>", "WARC-Date": "2020-02-02T00:00:00Z", "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response"} | more
    if digest:
        headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    return ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"], block


def test_archives_of_other_tools_with_revisits_and_missing_headers(spark, tmp_path):
    a, b = warc.digest32(b"payload a"), warc.digest32(b"payload b")
    made = [
        foreign("revisit", "r1", digest=a, **{"X-Page-Id": "1"}),  # smaller than its original
        foreign("response", "o1", b"payload a", a, **{"X-Page-Id": "7"}),
        foreign("response", "o2", b"payload a"),  # no digest, no page
        foreign("request", "q"),
        foreign("revisit", "lost", digest=b, **{"WARC-Refers-To": "<urn:x:elsewhere>"}),
        foreign("response", "o3", b"\xff\xfe not utf-8"),
    ]
    os.makedirs(tmp_path / "in")
    data = b"".join("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n" for lines, block in made)
    (tmp_path / "in" / "plain.warc").write_bytes(data)
    for source, target in (("in", "out"), ("out", "again")):
        warc.deduplicate(spark, str(tmp_path / source), str(tmp_path / target))
        back = {r.url: r for r in warc.read_archives(spark, str(tmp_path / target), True).collect()}
        assert {u: r.record_type for u, r in back.items()} == {"r1": "revisit", "o1": "response", "o2": "revisit", "lost": "revisit", "o3": "response"}
        assert back["o1"].payload == b"payload a" and back["o3"].payload == b"\xff\xfe not utf-8" and all(r.intact for r in back.values())
        assert (back["r1"].refers_to, back["o2"].refers_to, back["r1"].payload_bytes, back["o2"].payload_bytes) == (7, 7, 9, 9)
        heads = {h["warc-target-uri"]: h for h in records(tmp_path / target) if "warc-target-uri" in h}
        assert heads["lost"]["warc-refers-to"] == "<urn:x:elsewhere>" and heads["q"]["warc-type"] == "request" and heads["o2"]["warc-refers-to"] == heads["o1"]["warc-record-id"]


def archive(made):
    return [b"\r\n".join([*(line.encode() for line in lines)]) + b"\r\n\r\n" + block + b"\r\n\r\n" for lines, block in made]


def labelled(kind, url, payload, digest, **more):
    return foreign(kind, url, payload, **{"WARC-Payload-Digest": digest} | more)


def test_no_payload_is_lost_whatever_digests_are_declared(spark, tmp_path):
    a, b = warc.digest32(b"payload a"), hashlib.sha256(b"payload b").hexdigest()
    made = [
        labelled("response", "true", b"payload a", f"sha1:{a}", **{"X-Page-Id": "1"}),
        labelled("response", "lies", b"something else", f"sha1:{a}", **{"X-Page-Id": "2"}),  # declares the digest of another payload
        labelled("response", "lies too", b"payload a", f"sha1:{warc.digest32(b'x')}", **{"X-Page-Id": "3"}),
        labelled("response", "lower", b"payload a", f"sha1:{a.lower()}", **{"X-Page-Id": "4"}),
        labelled("response", "hex", b"payload a", f"SHA-1:{hashlib.sha1(b'payload a').hexdigest().upper()}", **{"X-Page-Id": "5"}),
        labelled("revisit", "old", None, f"sha1:{a.lower()}", **{"X-Page-Id": "6"}),
        labelled("response", "sha256", b"payload b", f"sha256:{b}", **{"X-Page-Id": "7"}),
        labelled("response", "again", b"payload b", f"sha1:{warc.digest32(b'payload b')}", **{"X-Page-Id": "8"}),
        labelled("revisit", "old256", None, f"sha256:{b.upper()}", **{"X-Page-Id": "9"}),
        labelled("revisit", "elsewhere", None, "sha256:" + "0" * 64, **{"X-Page-Id": "10"}),
        labelled("response", "unknown", b"payload c", "crc9:xyz", **{"X-Page-Id": "11"}),
    ]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "x.warc").write_bytes(b"".join(archive(made)))
    for source, target in (("in", "out"), ("out", "again")):
        warc.deduplicate(spark, str(tmp_path / source), str(tmp_path / target))
        back = {r.url: r for r in warc.read_archives(spark, str(tmp_path / target), True).collect()}
        assert {u: r.payload for u, r in back.items() if r.record_type == "response"} == {"true": b"payload a", "lies": b"something else", "lies too": b"payload a", "sha256": b"payload b", "unknown": b"payload c"}
        assert {u: r.refers_to for u, r in back.items() if r.record_type == "revisit"} == {"lower": 1, "hex": 1, "old": 1, "again": 7, "old256": 7, "elsewhere": None}
        assert {u for u, r in back.items() if not r.intact} == {"lies", "lies too"}
        assert back["hex"].payload_digest == back["old"].payload_digest == a and back["old256"].payload_digest == warc.digest32(b"payload b")
        heads = {h["warc-target-uri"]: h for h in records(tmp_path / target) if "warc-target-uri" in h}
        assert heads["elsewhere"]["warc-payload-digest"] == "sha256:" + "0" * 64


def test_broken_archives_give_their_good_records_and_an_error_each(spark, tmp_path):
    one = archive([labelled("response", f"u{i}", b"payload %d" % i, f"sha1:{warc.digest32(b'payload %d' % i)}", **{"X-Page-Id": str(i)}) for i in range(6)])
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "cut.warc").write_bytes(one[0] + one[1][:-20])
    (tmp_path / "in" / "stray.warc").write_bytes(one[2] + b"stray bytes\nand more\n" + one[3])
    (tmp_path / "in" / "cut.warc.gz").write_bytes(gzip.compress(one[4]) + gzip.compress(one[5])[:-30])
    (tmp_path / "in" / "noise.warc").write_bytes(b"\x00\x01 no archive at all")
    got = warc.read_archives(spark, str(tmp_path / "in")).collect()
    assert {r.url for r in got if r.record_type == "response"} == {"u0", "u2", "u3", "u4"}
    errors = {os.path.basename(r.file) for r in got if r.record_type == "error" and r.error}
    assert errors == {"cut.warc", "stray.warc", "cut.warc.gz", "noise.warc"}
    warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {(r.url, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "out")).collect()} == {(u, "response") for u in ("u0", "u2", "u3", "u4")}


def test_slices_are_the_records_whatever_the_packing():
    one = archive([labelled("response", f"u{i}", b"p" * (i * 50), "sha1:x") for i in range(5)])
    own, whole, plain = b"".join(warc.members(r) for r in one), gzip.compress(b"".join(one)), b"".join(one)
    mixed = warc.members(one[0]) + gzip.compress(one[1] + one[2]) + warc.members(one[3]) + warc.members(one[4])
    parts = b"".join(gzip.compress(r[:30]) + gzip.compress(r[30:]) for r in one)
    want = [block for _, block in warc.parse(warc.opened(plain))]
    for content in (own, whole, plain, mixed, parts):
        got = list(warc.slices(content))
        assert [n for n, _ in got] == list(range(5)) and [next(warc.parse(warc.opened(d)))[1] for _, d in got] == want
    assert [d for _, d in warc.slices(own)] == [warc.members(r) for r in one]
    assert warc.normal_digest("sha1:zzz") is None and warc.normal_digest("md5:" + "0" * 32) == "md5:" + "0" * 32


def test_repeated_and_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "same", "", 0), (1, "u", "same", "", 0), (None, "u", "same", "", 0), (None, None, "own", "", 0)]
    warc.write_responses(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "r"))
    warc.deduplicate(spark, str(tmp_path / "r"), str(tmp_path / "c"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "c")).collect())
    assert got == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]
    warc.write_responses(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    warc.deduplicate(spark, str(tmp_path / "e"), str(tmp_path / "f"))
    assert warc.read_archives(spark, str(tmp_path / "f")).count() == 0
