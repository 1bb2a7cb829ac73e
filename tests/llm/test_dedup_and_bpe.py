import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from notelake.llm import byte_bpe, exact_dedup, simhash
from notelake.llm.components import components

SCHEMA = "doc_id long, text string, digest string, fp int"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Éa", "ßx", "ABC"]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 40, 90])))
        rows.append((i, text, "x", 1))
        if i % 3 == 0:
            cut = text.split(" ")
            if len(cut) > 30:
                cut[rnd.randrange(len(cut))] = "zz"
            rows.append((1000 + i, "  ".join(cut), "y", 2))
    return [*rows, (5000, None, None, None), (5001, "", None, None), (5002, " \t\x0b", "", 0), (0, rows[0][1], "x", 1)]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {k: r.fp % 2**64 for k, r in got.items()} == fps
    linked = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert {k: r.component_id for k, r in got.items()} == brute_classes(fps, linked)


def test_long_text_fingerprint_is_the_same_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    hashes = [xxhash.xxh64_intdigest(f"w{i % 977} w{(i + 1) % 977} w{(i + 2) % 977}".encode(), 42) for i in range(69_998)]
    bits = np.array([[h >> b & 1 for b in range(64)] for h in hashes[:1]])
    assert bits.shape == (1, 64)
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_large_buckets_are_dealt_again_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {0, *(base ^ sum(1 << b for b in rnd.sample(range(40), rnd.randrange(5))) for _ in range(120)), *(rnd.getrandbits(64) for _ in range(40))}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    found = components(simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))).collect()
    roots = {r.node: r.root for r in found}
    linked = [(signed[a], signed[b]) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3]
    assert {s: roots.get(s, s) for s in signed.values()} == brute_classes(list(signed.values()), linked)


def test_pivots_discard_most_pairs_and_no_link(spark):
    rnd = random.Random(9)
    fps = sorted({rnd.getrandbits(64) for _ in range(300)})
    fps += [f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for f in fps[:100]]
    table = simhash.pivot_table(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    for r in table.limit(20).collect():
        assert list((r.near % 2**64).to_bytes(8, "little") + (r.far % 2**64).to_bytes(8, "little")) == [bin(r.fp % 2**64 ^ int(p)).count("1") for p in simhash.PIVOTS]
    x, y = (table.select(*[F.col(c).alias(f"{n}_{c}") for c in simhash.TABLE], F.struct(*simhash.TABLE).alias(n)) for n in "xy")
    pairs = x.join(y, F.col("x_fp") < F.col("y_fp"))  # a test's own table of pairs
    pairs = pairs.select(simhash.apart(F.col("x"), F.col("y")).alias("apart"), F.bit_count(F.col("x_fp").bitwiseXOR(F.col("y_fp"))).alias("bits"))
    assert pairs.filter("apart > bits").count() == 0
    assert pairs.filter("bits <= 3").count() >= 100 and pairs.filter("bits <= 3 and apart > 3").count() == 0
    assert pairs.filter("bits > 3 and apart <= 3").count() < 0.001 * pairs.count()


def test_masks_cover_every_choice():
    masks = simhash.refine(0)
    assert len(masks) == 10 and all(bin(m).count("1") in (25, 26) for m in masks)
    deep = [0]
    for _ in range(4):
        deep = [simhash.refine(m)[0] for m in deep]
    assert 64 - bin(deep[0]).count("1") < 10


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_copies_leave_one_of_each_group(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    groups = simhash.near_groups(docs)
    left = simhash.drop_near_copies(docs, groups)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.component_id for r in groups.collect()}
    empty = docs.limit(0)
    assert simhash.near_groups(empty).count() == 0


def brute_exact(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted((i, min(g := groups[norm(t)])[1], len(g), i == min(g)[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)


def test_exact_dedup_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect())) == brute_exact(rows)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("digests_")]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_keepers_do_not_depend_on_the_order_of_batches(spark, order):
    rows = [*corpus(), (None, "null id", "q", 0), (7000, "null  id", "q", 0), (6999, "null  id", "q", 0), (9000, " " + corpus()[0][1] + "  ", "q", 0)]
    rows = exact_dedup.digests(spark.createDataFrame(rows, SCHEMA)).withColumn("part", F.abs(F.hash("doc_id", "points")) % 3)
    index = exact_dedup.DigestIndex(spark, f"t_order_{order[0]}_{order[1]}")
    for k in order:
        index.append(rows.filter(F.col("part") == k))
    got = sorted(map(tuple, index.verdicts(rows).collect()), key=repr)
    index.drop()
    want = brute_exact([*corpus(), (9000, " " + corpus()[0][1] + "  ")])
    assert [r for r in got if r[1] != 6999] == sorted(want, key=repr)
    assert [(r[0], r[2], r[3]) for r in got if r[1] == 6999] == [(6999, 3, True), (7000, 3, False), (None, 3, False)]


def test_index_is_reopened_and_only_the_batch_is_shuffled(spark):
    docs = exact_dedup.digests(spark.createDataFrame(corpus(), SCHEMA))
    index = exact_dedup.DigestIndex(spark, "t_reopened", buckets=3)
    index.append(docs)
    held = index.read().count()
    again = exact_dedup.DigestIndex(spark, "t_reopened")  # the session has four shuffle partitions
    assert again.buckets == 3
    assert again.fresh(docs).count() == 0
    again.append(docs)
    more = exact_dedup.digests(spark.createDataFrame([(1, "quite new", "q", 0), (2, "quite  new", "q", 0)], SCHEMA))
    again.append(more)
    assert again.read().count() == held + 1
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.verdicts(more).collect()} == {(1, 2, False), (2, 2, True)}
    again.drop()
    assert not again.tables()


def test_ten_appends_leave_few_sorted_tables(spark, tmp_path):
    """The index side of the anti-joins has neither an exchange nor a sort, and a merge loses nothing."""
    index, everything = exact_dedup.DigestIndex(spark, "t_levels", buckets=3, folder=f"file://{tmp_path}"), None
    for k in range(10):
        batch = spark.createDataFrame([(100 * k + i, f"text {(7 * i + k) % 90}" + " " * (i % 3), "q", 0) for i in range(60 if k else 300)], SCHEMA)
        rows = exact_dedup.digests(batch)
        everything = rows if everything is None else everything.unionByName(rows)
        index.append(rows)
        assert len(index.tables()) <= exact_dedup.LEVELS
    again = exact_dedup.DigestIndex(spark, "t_levels")
    with exact_dedup.ordered_buckets(spark):
        new = again.fresh(everything)
        plan = new._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("FileScan parquet spark_catalog")
    assert len(scans) == len(again.tables()) + 1
    assert all("Bucketed: true" in scan for scan in scans[1:])
    # the index's columns are named with two lines before: only the batch is shuffled and sorted
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(__" not in plan and "Sort [__" not in plan
    assert new.count() == 0
    for table in again.tables():
        files = [f.rsplit("/", 1)[1] for f in spark.table(table).inputFiles()]
        assert len(files) == len({f.split("_")[1].split(".")[0] for f in files}) <= 3 and all(str(tmp_path) in f for f in spark.table(table).inputFiles())
    got = sorted(map(tuple, again.verdicts(everything).collect()))
    texts = [(r[0], r[1]) for k in range(10) for r in [(100 * k + i, f"text {(7 * i + k) % 90}" + " " * (i % 3)) for i in range(60 if k else 300)]]
    assert [r[1:] for r in got] == [r[1:] for r in sorted(brute_exact(texts))]
    again.drop()
    assert not again.tables()


def test_exact_drop_keeps_columns_and_one_of_repeats(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, "ab", "y", 2), (3, "c", None, None), (None, "d", "n", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = exact_dedup.drop_copies(docs, exact_dedup.dedup(docs))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_the_rank_file_library(spark, name):
    path = public_tokenizers.path(name)
    ranks = byte_bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    texts = ["", None, "Hello, world's  end\n\n x", "naïve Übergröße 日本語のテキスト 🎹🎹", " " * 300, "a" * 5000, "ab" * 3000, "\x00\x01 ▁ <unk> <gap3>", "<|endoftext|>", "12345 678", "x" * 41 + " " + "y" * 45]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 600), rnd.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(rnd.randrange(200))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "q", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
    rows = {r.doc_id: r for r in byte_bpe.digests(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)).collect()}
    assert rows[2].ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ordinary(texts[2]))).encode()).hexdigest()
    same = spark.createDataFrame([(1, "a b", "q", 0), (1, "a b", "q", 0), (None, "a b", "q", 0)], docs.schema)
    assert byte_bpe.encode_documents(same, path, public_tokenizers.PATTERN).count() == 3 and byte_bpe.encode_documents(same.limit(0), path, public_tokenizers.PATTERN).count() == 0
    assert rows[0].n_tokens == 0 and rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_one_row_of_equal_texts_stays_when_ids_repeat_or_are_null(spark, tmp_path):
    rows = [(5, "A a"), (3, "B"), (5, "B"), (None, "C"), (None, "C"), (4, "D"), (None, "D"), (None, "E"), (7, "F"), (7, " F "), (7, "G"), (8, None), (8, ""), (None, "")]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    left = exact_dedup.drop_copies(docs, exact_dedup.dedup(docs))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr)
    assert got == sorted([(5, "A a"), (3, "B"), (None, "C"), (4, "D"), (None, "E"), (7, " F "), (7, "G"), (8, "")], key=repr)


def test_one_row_of_a_component_stays_when_ids_repeat_or_are_null(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    a, b, c, d = (" ".join(rnd.choices(words, k=60)) for _ in range(4))
    rows = [(5, a), (3, b), (5, b), (None, c), (None, c + " "), (None, d), (9, a), (3, b.upper()), (None, None)]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    left = simhash.drop_near_copies(docs, simhash.near_groups(docs))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, " ".join((r.text or "").lower().split())) for r in left.collect()), key=repr)
    assert got == sorted([(5, a), (3, b), (None, c), (None, d), (None, "")], key=repr)
