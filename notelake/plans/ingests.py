"""Queries of archives, manifests in files, resumed ingest, shards of batches and masks of generation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelake.operators import manifest
from notelake.plans import sql as S
from notelake.plans.pieces import _MANIFEST, _r
from notelake.plans.registry import query
from notelake.sources import bind, files
from notelake.sources.interim import new_path
from notelake.streaming import ingest

_NAME = "'docs/' || lang || '/' || doc_id || '.txt'"


def _archives(spark, sf_dir) -> str:
    """A folder of tar archives, a member per document."""
    folder, name = new_path(spark, "archives"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    d = bind.table(spark, sf_dir, "documents").select(name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files.write_archives(d, folder, 4_000_000)
    return folder


@query(f"SELECT {_NAME} AS name, strlen(coalesce(text, '')) AS size FROM documents")
def archive_listing(spark, sf_dir):
    """Names and sizes of all members, from the index of the archives."""
    return files.archive_index(spark, _archives(spark, sf_dir), new_path(spark, "archive-index")).select("name", "size")


@query(f"SELECT {_NAME} AS name, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'docs/none/' || doc_id || '.txt', NULL FROM documents WHERE doc_id % 3 = 1")
def members_by_name(spark, sf_dir):
    """Members read by name (a third of all, and as many names that no archive has: null)."""
    d = bind.table(spark, sf_dir, "documents").select("doc_id", "lang")
    lang = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("none")
    wanted = d.filter("doc_id % 3 < 2").select(F.concat(F.lit("docs/"), lang, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return files.read_members(spark, _archives(spark, sf_dir), wanted).select("name", F.md5("content").alias("digest"))


@query(f"WITH {_MANIFEST} SELECT CAST(piece_id AS VARCHAR) AS piece_id, CAST(length AS INTEGER) AS length, md5(CAST(piece_id AS VARCHAR)) || '.npz' AS npz_path FROM man WHERE piece_id % 7 <> 0")
def manifest_lines(spark, sf_dir):
    """A manifest written and read as JSON lines; some rows have their length as tokens, lines that don't parse are dropped."""
    m = manifest.manifest(bind.notes(spark, sf_dir)).select("piece_id", "length")
    odd = F.col("piece_id") % 2 == 1
    row = F.to_json(F.struct(F.col("piece_id").cast("string").alias("piece_id"), F.when(odd, F.col("length")).alias("length"), F.when(~odd, F.col("length")).alias("tokens"), F.md5(F.col("piece_id").cast("string")).alias("md5")))
    path = new_path(spark, "manifest-lines")
    m.select(F.when(F.col("piece_id") % 7 == 0, "{broken").otherwise(row).alias("value")).write.text(path)
    return files.read_manifest(spark, path).select("piece_id", "length", "npz_path")


_STATE = "SELECT doc_id AS index, n_chars >= 200 AS accepted FROM documents"


@query(f"WITH r AS ({_STATE}), c AS (SELECT *, coalesce(sum(CAST(accepted AS INTEGER)) OVER (ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT index, accepted FROM c WHERE before < (SELECT count(*) // 2 FROM documents)")
def resumed_ingest(spark, sf_dir):
    """Ingest that stopped and goes on: what is done isn't done again, though it is delivered again; it ends when enough rows are accepted."""
    d = bind.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), (F.col("n_chars") >= 200).alias("accepted"))
    done = d.filter("index % 5 < 2")
    again = d.unionByName(d.filter("index % 4 = 0"))
    return ingest.first_accepted(done.unionByName(ingest.pending(again, done)), d.count() // 2, 500)


@query("WITH l AS (SELECT doc_id AS index, 0 AS line, 'skip' AS status FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, CASE WHEN n_chars >= 200 THEN 'accepted' ELSE 'short' END FROM documents) SELECT index, max_by(status, line) AS status FROM l GROUP BY index HAVING max_by(status, line) = 'accepted'")
def manifest_from_log(spark, sf_dir):
    """A manifest rebuilt from a log of JSON lines: of each index the last line counts, and what was accepted stays; broken lines are passed over."""
    d = bind.table(spark, sf_dir, "documents")
    line = lambda n, status: F.to_json(F.struct(F.col("doc_id").alias("index"), F.lit(n).alias("line"), status.alias("status")))
    status = F.when(F.col("n_chars") >= 200, "accepted").otherwise("short")
    log = d.filter("doc_id % 3 = 0").select(line(0, F.lit("skip")).alias("value")).unionByName(d.select(line(1, status).alias("value"))).unionByName(d.filter("doc_id % 50 = 0").select(F.lit("{\"index\": ").alias("value")))
    rows = log.select(F.from_json("value", "index long, line int, status string").alias("r")).select("r.*").filter("index >= 0")
    return rows.groupBy("index").agg(F.max_by("status", "line").alias("status")).filter("status = 'accepted'")


@query(f"""WITH {_MANIFEST}, e AS (SELECT piece_id, row_number() OVER (ORDER BY md5('7:3:' || piece_id), piece_id) - 1 AS ix, count(*) OVER () AS n FROM man), p AS (SELECT *, CAST(ceil(n / 32.0) * 32 AS BIGINT) AS total FROM e),
    a AS (SELECT piece_id, ix, false AS padding FROM p UNION ALL SELECT piece_id, n + ix, true FROM p WHERE ix < total - n UNION ALL SELECT piece_id, n + ix + k * n, true FROM p, range(1, 33) r(k) WHERE ix + k * n < total - n)
    SELECT piece_id, CAST(ix % 4 AS BIGINT) AS worker, CAST(ix // 4 // 8 AS BIGINT) AS batch, padding FROM a WHERE ix // 4 // 8 >= 2""")
def sharded_batches(spark, sf_dir):
    """Rows in the hash order of seed and epoch (7, 3), padded from the start to an even share of four workers and batches of eight, resumed after two batches."""
    m = manifest.manifest(bind.notes(spark, sf_dir)).select("piece_id").withColumn("h", F.md5(F.concat(F.lit("7:3:"), F.col("piece_id").cast("string"))))
    r = manifest.global_rank(m, "h", "piece_id").withColumn("at", F.col("rank") - 1).withColumn("total", F.ceil(F.col("n") / F.lit(32.0)) * 32)
    turns = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1 - F.col("at")) / F.col("n")))
    a = r.select("piece_id", "n", "at", F.explode(turns).alias("turn"))
    a = a.select("piece_id", (F.col("at") + F.col("turn") * F.col("n")).alias("at"), (F.col("turn") > 0).alias("padding"))
    return a.select("piece_id", (F.col("at") % 4).alias("worker"), F.floor(F.floor(F.col("at") / 4) / 8).alias("batch"), "padding").filter("batch >= 2")


@query(f"WITH {S.NOTES}, c AS (SELECT piece_id, max(onset) / 2 AS cut FROM notes GROUP BY 1) SELECT n.piece_id, round(n.onset, 6) AS time, n.velocity AS value FROM notes_all n JOIN c USING (piece_id) WHERE n.is_drum AND n.onset <= c.cut")
def controls_before_cut(spark, sf_dir):
    """Control events (here: drum hits) up to a piece's cut, which is half its length."""
    n = bind.notes_all(spark, sf_dir)
    cut = bind.notes(spark, sf_dir).groupBy("piece_id").agg((F.max("onset") / 2).alias("cut"))
    return n.filter("is_drum").join(cut, "piece_id").filter("onset <= cut").select("piece_id", _r("onset").alias("time"), F.col("velocity").alias("value"))


@query("WITH s AS (SELECT doc_id, doc_id % 40 AS epoch, n_chars * 0.5::DOUBLE AS took FROM documents), r AS (SELECT *, greatest(0, 30 - epoch) AS remaining, greatest(1, CAST(floor(1500 / greatest(took, 1e-6)) AS BIGINT)) AS each FROM s) SELECT doc_id, CAST(remaining AS BIGINT) AS remaining, CAST(ceil(remaining / each) AS BIGINT) AS sessions, round(remaining * took / 3600, 6) AS hours FROM r")
def sessions_left(spark, sf_dir):
    """Sessions of 25 minutes and hours to a target epoch, at the pace so far."""
    d = bind.table(spark, sf_dir, "documents")
    took, remaining = F.col("n_chars") * 0.5, F.greatest(F.lit(0).cast("long"), 30 - F.col("doc_id") % 40)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(1500.0) / F.greatest(took, F.lit(1e-6))))
    return d.select("doc_id", remaining.alias("remaining"), F.ceil(remaining / each).cast("long").alias("sessions"), _r(remaining * took / 3600).alias("hours"))


@query(r"WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'held for ' || CAST(l_quantity AS INTEGER) || ' ticks' ELSE '' END AS note, l_linenumber || '.' || CAST(l_quantity AS INTEGER) || CASE WHEN l_linenumber % 3 = 0 THEN '.x' ELSE '' END AS code FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN contains(note, 'ticks') THEN regexp_extract(note, '(?:^|\s)([0-9]+)(?:\s|$)', 1) ELSE regexp_extract(code, '(?:^|.*\.)([0-9]+)(?:$|\.[^0-9]*$)', 1) END AS INTEGER) AS ticks FROM v")
def duration_ticks(spark, sf_dir):
    """Ticks from a description ("... ticks"), else the last number of a dotted code."""
    li, n = bind.table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int").cast("string")
    note = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("held for "), n, F.lit(" ticks"))).otherwise("")
    code = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), n, F.when(F.col("l_linenumber") % 3 == 0, ".x").otherwise(""))
    numbers = lambda parts: F.filter(parts, lambda p: p.rlike("^[0-9]+$"))
    first, last = F.get(numbers(F.split(note, r"\s+")), F.lit(0)), F.element_at(numbers(F.split(code, r"\.")), -1)
    return li.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.contains(note, F.lit("ticks")), first), last, F.lit("0")).cast("int").alias("ticks"))


_NAMES = {0: "PAD", 1: "BOS", 2: "EOS", 3: "BAR"}


@query("SELECT vec_id, label, CASE label WHEN 0 THEN 'PAD' WHEN 1 THEN 'BOS' WHEN 2 THEN 'EOS' WHEN 3 THEN 'BAR' ELSE 'UNK_' || label END AS name FROM embeddings")
def token_names(spark, sf_dir):
    """Names by a map lookup; an id that it lacks is named after itself."""
    names = F.create_map(*[x for i, n in _NAMES.items() for x in (F.lit(i).cast("long"), F.lit(n))])
    label = F.col("label")
    return bind.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.coalesce(names[label.cast("long")], F.concat(F.lit("UNK_"), label.cast("string"))).alias("name"))


#: Stand-in ranges of the four slots over 64 classes; class 0 is the zero step, barred after this many in a row.
_SLOTS, _BAR = ((0, 15), (16, 31), (32, 47), (48, 63)), 3


@query(f"""WITH e AS (SELECT vec_id, embedding, vec_id % 4 AS slot, label % 2 = 0 AS zero, vec_id // 64 AS batch FROM embeddings), s AS (SELECT *, vec_id - coalesce(max(CASE WHEN NOT zero THEN vec_id END) OVER (PARTITION BY batch ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(vec_id) OVER (PARTITION BY batch) - 1) - 1 AS streak FROM e),
    c AS (SELECT vec_id, slot, streak, unnest(range(64)) AS cls, unnest(embedding)::DOUBLE AS logit FROM s), k AS (SELECT * FROM c WHERE cls BETWEEN slot * 16 AND slot * 16 + 15 AND NOT (cls = 0 AND streak >= {_BAR}))
    SELECT vec_id, count(*) AS allowed, bool_or(cls = 0) AS zero_allowed, CAST(arg_min(cls, {{'l': -logit, 'c': cls}}) AS INTEGER) AS best FROM k GROUP BY vec_id""")
def generation_mask(spark, sf_dir):
    """Logits masked to their slot's range, with the zero step barred after three in a row; how many stay, and the best of them (the lowest class of equals)."""
    s = bind.scores(spark, sf_dir).withColumn("slot", F.col("vec_id") % 4)
    w = W.partitionBy("batch").orderBy("vec_id")
    last = F.max(F.when(F.col("target") % 2 != 0, F.col("vec_id"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("streak", F.col("vec_id") - F.coalesce(last, F.min("vec_id").over(W.partitionBy("batch")) - 1) - 1)
    classes = F.transform("logits", lambda x, i: F.struct((-x).alias("l"), i.alias("c")))
    low = F.col("slot") * 16
    kept = F.filter(classes, lambda c: c["c"].between(low, low + 15) & ~((c["c"] == 0) & (F.col("streak") >= _BAR)))
    s = s.select("vec_id", kept.alias("k"))
    return s.select("vec_id", F.size("k").cast("long").alias("allowed"), F.exists("k", lambda c: c["c"] == 0).alias("zero_allowed"), F.array_min("k")["c"].alias("best"))
