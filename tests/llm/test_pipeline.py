import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from notelake.llm import byte_bpe

from .test_decontaminate_and_toxicity import brute as brute_windows
from .test_dedup_and_bpe import brute_classes, brute_exact, brute_fingerprint


def tables(spark, folder):
    rnd = random.Random(11)
    plain, bad = [f"p{i}" for i in range(200)], ["vile", "scorn"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = rnd.choices(plain, k=rnd.randrange(40, 90)) + (bad if toxic else [])
        rnd.shuffle(text)
        docs.append([i, " ".join(text), "en", f"s{i % 3}", 0])
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    items = [(k, " ".join(rnd.choices(plain, k=15))) for k in range(5)]
    for i in range(1, 600, 37):
        docs[i][1] += " " + items[i % 5][1]
    for i in range(2, 600, 29):
        docs.append([2000 + i, "  " + docs[i][1], "de", "copy", None])
    for i in range(3, 600, 31):
        words = docs[i][1].split()
        docs.append([3000 + i, " ".join(words) + ".", "fr", "near", 1])
    docs += [[5000, None, None, None, None], [5001, "", "x", "y", 0], [5002, "p1", "x", "y", 2]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d) for d in docs], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_match_brute_force(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    text = {d[0]: d[1] for d in docs}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = frame.columns, {d[0] for d in docs}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        path = f"{tmp_path}/{name}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        kept.append([r.doc_id for r in frame.collect()])
        assert len(kept[-1]) == len(set(kept[-1]))
    toxic = {i for i, t in text.items() if t and "vile" in t.split()}
    assert len(toxic & set(kept[0])) <= 0.05 * len(toxic) and len(ids - toxic - set(kept[0])) <= 0.05 * len(ids)
    exact = {r[0] for r in brute_exact([(i, text[i]) for i in kept[0]]) if r[3]}
    assert set(kept[1]) == exact
    fps = {i: brute_fingerprint(text[i]) for i in kept[1]}
    classes = brute_classes(list(fps), [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert set(kept[2]) == set(classes.values())
    dirty = brute_windows([(i, text[i]) for i in kept[2]], items)
    assert set(kept[3]) == {i for i in kept[2] if not dirty[i][4]} and len(kept[3]) < len(kept[2])
    ranks = byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(kept[3])
    for i, r in got.items():
        token_ids = own.encode_ordinary(text[i] or "")
        assert r.n_tokens == len(token_ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, token_ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest()


def test_stages_on_empty_tables_and_on_repeated_and_null_ids(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    rnd = random.Random(5)
    clean, other = (" ".join(f"q{rnd.randrange(500)}" for _ in range(60)) for _ in range(2))
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    rows = [(1, clean), (1, clean), (1, other), (None, other), (None, item), (1, item), (1, "vile scorn vile scorn"), (None, "vile scorn"), (None, None), (None, "")]
    small = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], docs.schema)
    left = {name: sorted(((r.doc_id, r.text or "") for r in stage(spark, small, str(tmp_path)).collect()), key=repr) for name, stage in corpus_pipeline.STAGES[:-1]}
    plain = [(i, t or "") for i, t in rows]
    assert left["toxicity"] == sorted(plain, key=repr)  # no label speaks of these rows
    both = corpus_pipeline.toxicity_stage(spark, docs.unionByName(small.filter("text is not null and text <> ''")), str(tmp_path))
    texts = [r.text for r in both.collect() if r.text in (clean, other, item) or r.text and r.text.startswith("vile")]
    assert sorted(texts) == sorted(t for _, t in plain if t and "vile" not in t)
    once = [(1, clean), (1, other), (1, item), (1, "vile scorn vile scorn"), (None, "vile scorn"), (None, "")]
    assert left["exact_dedup"] == sorted(once, key=repr)
    assert len(left["simhash_near_dedup"]) == len({brute_fingerprint(t) for _, t in rows})
    assert left["benchmark_decontamination"] == sorted([r for r in plain if r[1] != item], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, small, str(tmp_path)).count() == len(rows)


def test_every_stage_passes_columns_of_any_name(spark, tmp_path):
    tables(spark, str(tmp_path))
    names = ["a.b", "__digest", "__id", "__key", "__n", "__toxicity_score", "row", "digest", "id", "n", "own", "key", "score", "a`b", "fp", "root", "component_id", "keep_id", "kept", "text.x", "doc_id2"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for k, c in enumerate(names)]
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    more = [(1, item, "x", "y", 0), (1, item, "x", "y", 0), (None, None, "x", "y", 0), (None, "", "x", "y", 0), (7, "vile scorn " * 20, "x", "y", 0), (9, "once more and again", "x", "y", 0), (9, "once more and again", "x", "y", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    wide = docs.select(*docs.columns[:2], *extra, *docs.columns[2:])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert got.columns == wide.columns and got.dtypes == wide.dtypes, name
        rows = [tuple(r) for r in got.collect()]
        assert sorted(((*r[:2], *r[2 + len(names) :]) for r in rows), key=repr) == sorted(map(tuple, plain.collect()), key=repr), name
        assert all(v == f"{k}:{'none' if r[0] is None else r[0]}" for r in rows for k, v in enumerate(r[2 : 2 + len(names)])), name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, wide, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, last(spark, docs, str(tmp_path)).collect()), key=repr)
