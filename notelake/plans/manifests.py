"""Queries of unions, merges, checks and retention of manifests and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators import manifest, scan, tokens
from notelake.plans import sql as S
from notelake.plans.pieces import _MANIFEST, _r
from notelake.plans.registry import query
from notelake.plans.sequences import _SEQ
from notelake.sources import bind, files
from notelake.sources.interim import keep


@query()
def file_scan(spark, sf_dir):
    """The files of a folder of tables, in path order (a listing, no content)."""
    return files.indexed(files.listing(spark, sf_dir, r"\.parquet$")).select("index", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@query(f"WITH {_MANIFEST} SELECT piece_id, 'a' AS dataset FROM man WHERE source <> 'maestro' UNION ALL SELECT piece_id, 'b' FROM man WHERE length >= 200")
def union_datasets(spark, sf_dir):
    """Two datasets put together, duplicates kept."""
    m = manifest.manifest(bind.notes(spark, sf_dir))
    a = m.filter("source <> 'maestro'").select("piece_id", F.lit("a").alias("dataset"))
    return a.unionByName(m.filter("length >= 200").select("piece_id", F.lit("b").alias("dataset")))


@query(f"WITH {S.TOKENS} SELECT DISTINCT tok FROM tokens")
def vocabulary_union(spark, sf_dir):
    return tokens.body(bind.notes(spark, sf_dir)).select("tok").distinct()


@query(f"WITH {_SEQ} SELECT piece_id, CAST(len(seq) AS INTEGER) AS n, array_to_string(seq[33:len(seq)], ' ') AS generated, md5(array_to_string(list_concat(seq[1:32], seq[33:len(seq)]), ' ')) AS joined FROM seqs WHERE len(seq) > 32")
def generated_suffix(spark, sf_dir):
    """A sequence without its 32 seed tokens, and the two parts put together again."""
    s = tokens.sequences(tokens.body(bind.notes(spark, sf_dir))).filter(F.size("seq") > 32)
    suffix = F.slice("seq", F.lit(33), F.size("seq") - 32)
    text = lambda a: F.array_join(a.cast("array<string>"), " ")
    return s.select("piece_id", F.size("seq").alias("n"), text(suffix).alias("generated"), F.md5(text(F.concat(F.slice("seq", 1, 32), suffix))).alias("joined"))


@query("WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS a FROM embeddings) SELECT label, round(max(a), 6) AS most, round(min(a), 6) AS least, round(avg(a), 6) AS mean, count(*) FILTER (a > 0) AS positive FROM d GROUP BY label")
def generation_stats(spark, sf_dir):
    """Largest, least and mean of all diagnostics."""
    s = bind.scores(spark, sf_dir).select(F.col("target").alias("label"), F.explode("logits").alias("a"))
    return s.groupBy("label").agg(_r(F.max("a")).alias("most"), _r(F.min("a")).alias("least"), _r(F.avg("a")).alias("mean"), F.count_if(F.col("a") > 0).alias("positive"))


@query("WITH m AS (SELECT doc_id, 'chunk_' || (doc_id // 300) || '/manifest.json' AS file, 'packs/' || doc_id || '.npz' AS rel FROM documents UNION ALL SELECT doc_id, 'chunk_' || (doc_id // 300) || '/manifest.json', 'packs/' || doc_id || '.npz' FROM documents WHERE doc_id < 300), f AS (SELECT DISTINCT file FROM m) SELECT DISTINCT m.doc_id, regexp_replace(file, '/[^/]*$', '') || '/' || rel AS path FROM m JOIN f USING (file)")
def chunk_manifest_merge(spark, sf_dir):
    """Manifest files named twice are taken once; their rows' relative paths are put below the chunk's folder."""
    d = bind.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("chunk_"), F.floor(F.col("doc_id") / 300).cast("string"), F.lit("/manifest.json")).alias("file"), F.concat(F.lit("packs/"), F.col("doc_id").cast("string"), F.lit(".npz")).alias("rel"))
    twice = d.unionByName(d.filter("doc_id < 300"))
    once = twice.dropDuplicates(["file", "doc_id", "rel"])
    return once.select("doc_id", F.concat_ws("/", F.regexp_replace("file", "/[^/]*$", ""), "rel").alias("path"))


@query("WITH first AS (SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'PASS' ELSE 'WARN' END AS resolves, CASE WHEN text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL THEN 'PASS' ELSE 'WARN' END AS complete FROM first")
def manifest_checks(spark, sf_dir):
    """The first five rows: does each resolve, and does it have its columns? (a report of stated size)"""
    first = bind.table(spark, sf_dir, "documents").orderBy("doc_id").limit(5)
    there = bind.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    complete = F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("n_chars").isNotNull()
    verdict = lambda c: F.when(c, "PASS").otherwise("WARN")
    return first.join(there, "doc_id", "left").select("doc_id", verdict(F.coalesce("there", F.lit(False))).alias("resolves"), verdict(complete).alias("complete"))


@query("WITH b AS (SELECT p_partkey, p_brand, (CASE WHEN p_type LIKE '%STEEL%' THEN 3 ELSE 0 END) + (CASE WHEN p_size >= 25 THEN 2 ELSE 0 END) + (CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS score FROM part) SELECT p_brand, p_partkey, CAST(score AS INTEGER) AS score FROM b QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1")
def bundle_score(spark, sf_dir):
    """The best bundle of each brand by additive score."""
    p = bind.table(spark, sf_dir, "part")
    score = F.when(F.col("p_type").contains("STEEL"), 3).otherwise(0) + F.when(F.col("p_size") >= 25, 2).otherwise(0) + F.when(F.col("p_retailprice") > 1000, 1).otherwise(0)
    best = F.max_by("p_partkey", F.struct(score, -F.col("p_partkey"))).alias("p_partkey")
    return p.groupBy("p_brand").agg(best, F.max(score).alias("score"))


@query(f"WITH {S.QUADS}, g AS (SELECT piece_id, note_ix, delta_tok, sum(CASE WHEN delta_tok <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS grp FROM quads) SELECT piece_id, note_ix, count(*) FILTER (delta_tok = 0) OVER (PARTITION BY piece_id, grp ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS streak, count(*) FILTER (delta_tok = 0) OVER (PARTITION BY piece_id, grp ORDER BY note_ix ROWS UNBOUNDED PRECEDING) >= 3 AS barred FROM g")
def zero_delta_streak(spark, sf_dir):
    """Consecutive zero steps up to each note; three bar a fourth."""
    q = keep(tokens.quads(bind.notes(spark, sf_dir)).select("piece_id", "note_ix", "delta_tok"), "steps")
    # all notes since the last step that isn't zero are zero steps: their number is the distance to it
    step = F.when(F.col("delta_tok") != 0, F.col("note_ix"))
    g = scan.running(q, "piece_id", F.floor(F.col("note_ix") / 4096), ["note_ix"], last=("max", step))
    streak = (F.col("note_ix") - F.coalesce("last", F.lit(-1))).cast("long")
    return g.select("piece_id", "note_ix", streak.alias("streak"), (streak >= 3).alias("barred"))


@query(f"WITH {_MANIFEST}, w(source, weight) AS (VALUES ('maestro', 2.0::DOUBLE), ('giant_midi', 0.5::DOUBLE)) SELECT piece_id, source, coalesce(weight, 1.0) AS weight FROM man LEFT JOIN w USING (source)")
def piece_weights(spark, sf_dir):
    """Weights by source, 1 by default; a weight that is not positive is an error."""
    w = spark.createDataFrame([("maestro", 2.0), ("giant_midi", 0.5)], "source string, weight double")
    m = manifest.manifest(bind.notes(spark, sf_dir)).join(F.broadcast(w), "source", "left")
    weight = F.coalesce("weight", F.lit(1.0))
    checked = F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("a source weight must be positive")).cast("double"))
    return m.select("piece_id", "source", checked.alias("weight"))


@query(f"WITH {S.TOKENS} SELECT CAST((pos + 1) % 4 AS INTEGER) AS slot, min(tok) AS least, max(tok) AS most, count(*) AS n FROM tokens GROUP BY 1")
def slot_mask_ranges(spark, sf_dir):
    """What the slot mask must allow: the token ranges met at each next-token slot."""
    b: DataFrame = tokens.body(bind.notes(spark, sf_dir))
    return b.groupBy(((F.col("pos") + 1) % 4).cast("int").alias("slot")).agg(F.min("tok").alias("least"), F.max("tok").alias("most"), F.count(F.lit(1)).alias("n"))
