"""Queries that write a source from given tables and read it back: packs, CSV metadata, file lists, manifests, folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import manifest, tokens
from notelake.plans import sql as S
from notelake.plans.pieces import _MANIFEST, _r
from notelake.plans.registry import query
from notelake.sources import bind, files, packs
from notelake.sources.interim import new_path

#: Tokens that a pack needs; entries of the cap.
LEAST, CAP = 200, 500


@query(
    f"""WITH {S.TOKENS}, p AS (SELECT md5('piece-' || piece_id) AS md5, CAST(count(*) AS INTEGER) AS length, sum(tok) AS total, CAST(arg_min(tok, pos) AS INTEGER) AS first, CAST(arg_max(tok, pos) AS INTEGER) AS last FROM tokens GROUP BY piece_id)
    SELECT * FROM p WHERE length >= {LEAST}"""
)
def token_packs(spark, sf_dir):
    """Pieces written as token packs, short ones left out; the manifest that their writers listed, joined with what the packs hold."""
    pieces = tokens.sequences(tokens.body(bind.notes(spark, sf_dir))).select(F.md5(F.concat(F.lit("piece-"), F.col("piece_id").cast("string"))).alias("md5"), F.col("seq").alias("tokens"))
    path = new_path(spark, "packs")
    packs.write(pieces, path, LEAST)
    held = packs.read(spark, path).select("md5", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t).alias("total"), F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last"))
    return packs.manifest(spark, path).select("md5", "length").join(held, "md5")


@query(f"WITH {S.TOKENS} SELECT md5('piece-' || piece_id) AS md5, CAST(count(*) AS INTEGER) AS length FROM tokens GROUP BY piece_id")
def pack_manifest(spark, sf_dir):
    """A manifest built from the packs below a folder: the name's stem, and the number of tokens."""
    pieces = tokens.sequences(tokens.body(bind.notes(spark, sf_dir))).select(F.md5(F.concat(F.lit("piece-"), F.col("piece_id").cast("string"))).alias("md5"), F.col("seq").alias("tokens"))
    path = new_path(spark, "packs")
    packs.write(pieces, path)
    return packs.rebuilt_manifest(spark, path).select("md5", "length")


_TITLE = "'\"' || doc_id || '\", ' || source"


@query(
    f"""WITH r AS (SELECT doc_id, source || '/' || lang || '/' || (doc_id % 40) || '.mid' AS path, (doc_id % 40) || '.mid' AS name, {_TITLE} AS title FROM documents)
    SELECT path, arg_max(title, doc_id) AS title, arg_max(n, doc_id) AS by_name FROM (SELECT r.*, first_value(title) OVER (PARTITION BY name ORDER BY doc_id) AS n FROM r) GROUP BY path"""
)
def metadata_csv(spark, sf_dir):
    """Metadata of quoted CSV files: of several rows of a path the last counts, of several of a file name the first."""
    d, folder = bind.table(spark, sf_dir, "documents"), new_path(spark, "metadata")
    path = F.concat_ws("/", "source", "lang", F.concat((F.col("doc_id") % 40).cast("string"), F.lit(".mid")))
    title = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('", '), F.col("source"))
    rows = d.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(path.alias("midi_filename"), title.alias("title"))
    rows.write.options(header=True, escape='"', quoteAll=True).csv(folder)
    found = files.metadata_csv(spark, folder, "midi_filename string, title string")
    by_path, by_name = files.metadata_lookups(found, "midi_filename")
    first = by_name.select(F.col("key").alias("name"), F.col("row.title").alias("by_name"))
    last = by_path.select(F.col("key").alias("path"), F.col("row.title").alias("title"), F.element_at(F.split("key", "/"), -1).alias("name"))
    return last.join(first, "name").select("path", "title", "by_name")


@query("SELECT DISTINCT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.mid' AS path, n_chars >= 200 AS there FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 3")
def file_list(spark, sf_dir):
    """A JSON-lines list of files, trusted, and which of them a listing has; blank and broken lines and other files are passed over."""
    m, folder = bind.members(spark, sf_dir), new_path(spark, "file-list")
    row = F.to_json(F.struct(F.concat(F.lit(" "), F.when(F.col("index") % 7 == 3, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))).alias("path")))
    broken = F.when(F.col("index") % 10 == 0, F.lit("")).otherwise(F.lit('{"path": '))
    lines = m.select(F.when(F.col("index") % 5 == 0, broken).otherwise(row).alias("value"))
    lines.unionByName(lines.filter(F.length("value") % 2 == 0)).write.text(folder)
    there = files.file_list(spark, folder, m.filter("length >= 200").select("path")).withColumn("there", F.lit(True))
    return files.file_list(spark, folder).join(there, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("there"))


@query("SELECT CAST(doc_id AS VARCHAR) AS piece_id, CAST(n_chars AS INTEGER) AS length FROM documents WHERE n_chars >= 200")
def manifest_array(spark, sf_dir):
    """A log of JSON lines in files, rebuilt into JSON arrays, and read again as a manifest: broken lines and what wasn't accepted are gone."""
    d, log, array = bind.table(spark, sf_dir, "documents"), new_path(spark, "log"), new_path(spark, "manifest-array")
    status = F.when(F.col("n_chars") >= 200, "accepted").otherwise("short")
    line = F.to_json(F.struct(F.col("doc_id").alias("index"), F.col("doc_id").cast("string").alias("piece_id"), F.col("n_chars").cast("int").alias("length"), status.alias("status")))
    d.select(line.alias("value")).unionByName(d.filter("doc_id % 50 = 0").select(F.lit('{"index": ').alias("value"))).write.text(log)
    rows = spark.read.schema("index long, piece_id string, length int, status string").json(log).filter("status = 'accepted'")
    files.write_manifest(rows.select("piece_id", "length"), array)
    return files.read_manifest(spark, array).select("piece_id", "length")


@query(f"WITH {_MANIFEST} SELECT piece_id, source, length FROM man ORDER BY source, piece_id LIMIT {CAP}")
def ordered_cap(spark, sf_dir):
    """The first entries of a manifest, in its order."""
    return manifest.capped(manifest.manifest(bind.notes(spark, sf_dir)).select("piece_id", "source", "length"), CAP, "source", "piece_id")


@query("SELECT lang, CAST(sum(strlen(coalesce(source, '')) + 1) AS BIGINT) AS bytes FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def folder_sizes(spark, sf_dir):
    """Bytes of the files below each folder of a tree."""
    root = new_path(spark, "tree")
    d = bind.table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    d.select("lang", F.coalesce("source", F.lit("")).alias("value")).write.partitionBy("lang").option("compression", "none").text(root)
    found = files.listing(spark, root, ".").withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    return found.groupBy("lang").agg(F.sum("length").alias("bytes"))


@query("WITH s AS (SELECT user_id AS piece_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id) SELECT piece_id, CASE WHEN piece_id % 9 <> 0 THEN round((epoch(date_trunc('second', b)) - epoch(date_trunc('second', a))) / 3600.0, 6) END AS hours FROM s")
def iso_hours(spark, sf_dir):
    """Hours between two times in ISO form; a time that doesn't parse gives none."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    s = bind.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("piece_id")).agg(iso(F.min("ts")).alias("a"), iso(F.max("ts")).alias("b"))
    start = F.when(F.col("piece_id") % 9 == 0, "not yet").otherwise(F.col("a"))
    return s.select("piece_id", _r(files.hours(start, F.col("b"))).alias("hours"))
