"""Queries of schedules, tolerant cleaning, ledgers, sessions and retention."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import clean
from notelake.functions import quantize as Q
from notelake.operators import manifest
from notelake.plans import sql as S
from notelake.plans.pieces import _MANIFEST, _r
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.streaming import ingest


_STEPS = "t AS (SELECT count(*) AS n FROM events), s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS step, n FROM events, t)"


def _steps(spark, sf_dir):
    """Events as the steps of a run: (step, n), n being how many there are; ids are ranked in blocks, so that no task sorts them all."""
    e = bind.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 4096).alias("block"))
    counts = e.groupBy("block").agg(F.count(F.lit(1)).alias("own"))
    before = counts.select("block", F.coalesce(F.sum("own").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("own").over(W.partitionBy(F.lit(1))).alias("n"))
    rank = F.row_number().over(W.partitionBy("block").orderBy("event_id")) - 1
    return e.withColumn("rank", rank).join(before, "block").select((F.col("before") + F.col("rank")).alias("step"), "n")


@query(f"WITH {_STEPS}, w AS (SELECT step, n, greatest(1, n // 20) AS warm FROM s) SELECT step, round(CASE WHEN step < warm THEN step / warm::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step - warm) / greatest(1, n - warm)::DOUBLE))) END, 6) AS factor FROM w")
def warmup_cosine(spark, sf_dir):
    """Learning-rate factor of each step of a run: linear warm-up over its first twentieth, cosine to a tenth at its end."""
    s = _steps(spark, sf_dir).withColumn("warm", F.greatest(F.lit(1), F.floor(F.col("n") / 20)))
    p = F.least(F.lit(1.0), (F.col("step") - F.col("warm")) / F.greatest(F.lit(1), F.col("n") - F.col("warm")))
    return s.select("step", _r(F.when(F.col("step") < F.col("warm"), F.col("step") / F.col("warm")).otherwise(0.1 + 0.9 * 0.5 * (1 + F.cos(F.lit(math.pi) * p)))).alias("factor"))


@query(f"WITH {_STEPS} SELECT step, round(CASE WHEN step >= n // 5 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE + (0.1::DOUBLE - 0.02::DOUBLE) * step / (n // 5) END, 6) AS smoothing FROM s")
def label_ramp(spark, sf_dir):
    """Label smoothing of each step of a run, rising over its first fifth."""
    end = F.floor(F.col("n") / 5)
    return _steps(spark, sf_dir).select("step", _r(F.when(F.col("step") >= end, 0.1).otherwise(0.02 + (0.1 - 0.02) * F.col("step") / end)).alias("smoothing"))


_SCALES = [0.01 * 2.0**k for k in range(14)]


@query(f"WITH {S.NOTES} SELECT piece_id, note_ix, CAST(k - 1 AS INTEGER) AS scale, round(sin(least(onset, 40.0::DOUBLE) / list_extract({S.doubles(_SCALES)}, k)), 5) AS s, round(cos(least(onset, 40.0::DOUBLE) / list_extract({S.doubles(_SCALES)}, k)), 5) AS c FROM notes, range(1, 15) r(k)")
def time_features(spark, sf_dir):
    """Sine and cosine of clamped onsets at 14 time scales."""
    n = bind.notes(spark, sf_dir).select("piece_id", "note_ix", F.least("onset", F.lit(40.0)).alias("t"))
    rows = n.select("piece_id", "note_ix", "t", F.posexplode(F.array(*[F.lit(s) for s in _SCALES])).alias("scale", "x"))
    return rows.select("piece_id", "note_ix", "scale", _r(F.sin(F.col("t") / F.col("x")), 5).alias("s"), _r(F.cos(F.col("t") / F.col("x")), 5).alias("c"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 6 AS bpm FROM lineitem), b AS (SELECT *, CAST(round_even((greatest(30.0, least(240.0, bpm)) - 30.0) / 210.0 * 63, 0) AS INTEGER) AS bin FROM t) SELECT l_orderkey, l_linenumber, bin, round(30.0 + bin / 63.0 * 210.0, 6) AS tempo FROM b")
def tempo_bins(spark, sf_dir):
    """Quantities as tempi, binned and back."""
    t = bind.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.tempo_bin(F.col("l_quantity") * 6).alias("bin"))
    return t.select("*", _r(Q.tempo_of(F.col("bin"))).alias("tempo"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(round_even(l_extendedprice, 0) / 55, 0) * 55 AS BIGINT) AS tick, CAST(least(greatest(round_even(l_quantity / 3, 0), 1), 16) AS INTEGER) AS units FROM lineitem")
def grid_snap(spark, sf_dir):
    li = bind.table(spark, sf_dir, "lineitem")
    units = F.least(F.greatest(F.bround(F.col("l_quantity") / 3, 0), F.lit(1)), F.lit(16)).cast("int")
    return li.select("l_orderkey", "l_linenumber", Q.snap(F.bround("l_extendedprice", 0), F.lit(55)).alias("tick"), units.alias("units"))


_DIRTY = """d AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events),
v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' ' || k || ' ' WHEN 1 THEN k || '.9' WHEN 2 THEN '-' || k WHEN 3 THEN CASE WHEN length(k) = 1 THEN ' Yes' ELSE 'off' END WHEN 4 THEN '' WHEN 5 THEN event_type END AS a,
  CASE event_id % 6 WHEN 0 THEN k || '.5' WHEN 1 THEN k || 'E-1' WHEN 2 THEN 'nan' WHEN 3 THEN '.' || k WHEN 4 THEN k || '.1.2' END AS b FROM d)"""


@query(f"WITH {_DIRTY} SELECT event_id, CASE WHEN regexp_matches(trim(a), '^[+-]?[0-9]+$') THEN CAST(trim(a) AS INTEGER) ELSE -1 END AS whole, round(CASE WHEN regexp_matches(lower(trim(b)), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$') THEN CAST(trim(b) AS DOUBLE) ELSE 0.5 END, 6) AS number, CASE WHEN lower(trim(a)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(a)) IN ('0', 'false', 'no', 'off') THEN false ELSE false END AS flag FROM v")
def tolerant_casts(spark, sf_dir):
    """Fields of events, as dirty as settings are, to numbers and flags with fallbacks; what does not parse takes the fallback, never an error."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    some = lambda n, *forms: F.coalesce(*[F.when(i % n == at, form) for at, form in enumerate(forms)])
    a = some(7, F.concat(F.lit(" "), k, F.lit(" ")), F.concat(k, F.lit(".9")), F.concat(F.lit("-"), k), F.when(F.length(k) == 1, " Yes").otherwise("off"), F.lit(""), F.col("event_type"))
    b = some(6, F.concat(k, F.lit(".5")), F.concat(k, F.lit("E-1")), F.lit("nan"), F.concat(F.lit("."), k), F.concat(k, F.lit(".1.2")))
    v = bind.table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return v.select("event_id", clean.to_int("a", -1).alias("whole"), _r(clean.to_double("b", 0.5)).alias("number"), F.coalesce(clean.to_bool("a"), F.lit(False)).alias("flag"))


@query("SELECT doc_id AS index, printf('data/%05d/%07d_', doc_id // 250, doc_id) || md5(source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.mid') || '.npz' AS pack FROM documents")
def shard_paths(spark, sf_dir):
    m = bind.members(spark, sf_dir)
    return m.select("index", clean.shard_path(F.col("index"), F.col("path"), 250).alias("pack"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE printf('%02d:%02d:%02d', CAST(floor(o_totalprice) AS BIGINT) // 3600, CAST(floor(o_totalprice) AS BIGINT) % 3600 // 60, CAST(floor(o_totalprice) AS BIGINT) % 60) END AS eta FROM orders")
def format_eta(spark, sf_dir):
    o = bind.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", clean.eta(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).alias("eta"))


@query(f"WITH names AS (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN ' Aria' WHEN 1 THEN 'GIANT' WHEN 2 THEN 'adl ' WHEN 3 THEN 'maestro_v3' WHEN 4 THEN source ELSE '' END AS name FROM documents), alias(a, c) AS (VALUES {', '.join(f'''('{a}', '{c}')''' for a, c in __import__('notelake.spec', fromlist=['ALIASES']).ALIASES.items())}) SELECT name, coalesce(nullif(coalesce(c, lower(trim(name))), ''), 'maestro') AS source FROM names LEFT JOIN alias ON a = lower(trim(name))")
def alias_map(spark, sf_dir):
    d = bind.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    name = F.when(k == 0, " Aria").when(k == 1, "GIANT").when(k == 2, "adl ").when(k == 3, "maestro_v3").when(k == 4, F.col("source")).otherwise("")
    return d.select(name.alias("name")).distinct().select("name", F.coalesce(F.nullif(manifest.canonical(F.col("name")), F.lit("")), F.lit("maestro")).alias("source"))


@query("WITH c AS (SELECT doc_id, 'run_epoch_' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') || '_step_' || (doc_id * 17) || '.pt' AS name, n_chars FROM documents) SELECT CAST(regexp_extract(name, 'epoch_(\\d+)', 1) AS INTEGER) AS epoch, count(*) AS n, max_by(name, CAST(regexp_extract(name, 'step_(\\d+)', 1) AS BIGINT)) AS latest FROM c GROUP BY 1")
def latest_step(spark, sf_dir):
    """Epoch and step parsed from names; the latest step of each epoch."""
    d = bind.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("run_epoch_"), F.lpad((F.col("doc_id") % 50).cast("string"), 3, "0"), F.lit("_step_"), (F.col("doc_id") * 17).cast("string"), F.lit(".pt"))
    c = d.select(name.alias("name")).select("name", F.regexp_extract("name", r"epoch_(\d+)", 1).cast("int").alias("epoch"), F.regexp_extract("name", r"step_(\d+)", 1).cast("long").alias("step"))
    return c.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", "step").alias("latest"))


@query("WITH c AS (SELECT doc_id, lang, n_chars, doc_id % 10 = 0 AS protected FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, protected ORDER BY doc_id DESC) AS recent, sum(n_chars) OVER (PARTITION BY lang, protected ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM c) SELECT doc_id, protected OR (recent <= 20 AND bytes <= 60000) AS kept FROM r")
def checkpoint_rotation(spark, sf_dir):
    """Retention by group: protected rows stay; of the rest the newest, within a count and a byte budget."""
    c = bind.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 10 == 0).alias("protected"))
    # the newest 20 of a group are among the newest 20 of its parts, so no task sorts a group; only those are summed
    newest = lambda rows, *by: rows.withColumn("recent", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("doc_id")))).filter("recent <= 20")
    few = newest(newest(c.filter("NOT protected").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1024))), "lang", "part"), "lang")
    spent = F.sum("n_chars").over(W.partitionBy("lang").orderBy(F.desc("doc_id")).rowsBetween(W.unboundedPreceding, 0))
    found = few.select("doc_id", "lang", spent.alias("bytes")).filter("bytes <= 60000").select("doc_id", F.lit(True).alias("found"))
    return c.join(found, "doc_id", "left").select("doc_id", (F.col("protected") | F.coalesce("found", F.lit(False))).alias("kept"))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 ORDER BY abs(p_retailprice - 1000), p_partkey LIMIT 1")
def nearest_profile(spark, sf_dir):
    """The entry nearest to a target, flagged ones skipped."""
    p = bind.table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    return p.orderBy(F.abs(F.col("p_retailprice") - 1000), "p_partkey").select("p_partkey", "p_size").limit(1)


_SES = "ses AS (SELECT conv_id, turn, length(text) / 100.0::DOUBLE AS val FROM conversations WHERE text IS NOT NULL)"


@query(f"WITH {_SES} SELECT conv_id, count(*) AS sessions, round(min(val), 6) AS best, max(turn) AS last_epoch, round(sum(val), 6) AS hours FROM ses GROUP BY conv_id")
def session_totals(spark, sf_dir):
    s = bind.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", (F.char_length("text") / F.lit(100.0)).alias("val"))
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sessions"), _r(F.min("val")).alias("best"), F.max("turn").alias("last_epoch"), _r(F.sum("val")).alias("hours"))


@query(f"WITH {_SES}, b AS (SELECT conv_id, turn, coalesce(val + 1e-8 < min(val) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM ses), g AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, grp ORDER BY turn) - 1 AS waited FROM g) SELECT conv_id, turn, better, waited FROM w")
def early_stopping(spark, sf_dir):
    """Whether a turn is better than all before it, and how many turns have passed since one was."""
    s = bind.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", (F.char_length("text") / F.lit(100.0)).alias("val"))
    w = W.partitionBy("conv_id").orderBy("turn")
    b = s.withColumn("better", F.coalesce(F.col("val") + 1e-8 < F.min("val").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)))
    g = b.withColumn("grp", F.sum(F.col("better").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.select("conv_id", "turn", "better", (F.row_number().over(W.partitionBy("conv_id", "grp").orderBy("turn")) - 1).cast("long").alias("waited"))


@query("SELECT CAST(doc_id // 100 AS BIGINT) AS block, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def running_metric_blocks(spark, sf_dir):
    """A metric emitted and reset every 100 steps."""
    d = bind.table(spark, sf_dir, "documents")
    return d.groupBy(F.floor(F.col("doc_id") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT CAST(doc_id // 300 AS BIGINT) AS chunk, min(doc_id) AS start_index, max(doc_id) + 1 AS end_index, count(*) FILTER (n_chars >= 200) AS accepted, count(*) FILTER (n_chars < 200) AS skipped FROM documents GROUP BY 1")
def chunk_ledger(spark, sf_dir):
    """Chunks of 300 indexes with what was accepted and skipped."""
    d = bind.table(spark, sf_dir, "documents")
    return d.groupBy(F.floor(F.col("doc_id") / 300).alias("chunk")).agg(
        F.min("doc_id").alias("start_index"), (F.max("doc_id") + 1).alias("end_index"), F.count_if(F.col("n_chars") >= 200).alias("accepted"), F.count_if(F.col("n_chars") < 200).alias("skipped")
    )


@query("SELECT doc_id AS index, CASE WHEN n_chars = 0 THEN 'skip' WHEN text LIKE '%|%' THEN 'skip' WHEN n_chars < 200 THEN 'skip' ELSE 'accepted' END AS status, CASE WHEN n_chars = 0 THEN 'empty-midi-bytes' WHEN text LIKE '%|%' THEN 'parse-or-filter' WHEN n_chars < 200 THEN 'short' ELSE '' END AS error FROM documents")
def ingest_results(spark, sf_dir):
    """A status and reason for every member; none is dropped."""
    d = bind.table(spark, sf_dir, "documents")
    error = F.when(F.col("n_chars") == 0, "empty-midi-bytes").when(F.contains("text", F.lit("|")), "parse-or-filter").when(F.col("n_chars") < 200, "short").otherwise("")
    return d.select(F.col("doc_id").alias("index"), F.when(error == "", "accepted").otherwise("skip").alias("status"), error.alias("error"))


@query("WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text END AS a, text AS b FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CAST(coalesce(length(a), length(b), 0) AS BIGINT) AS length FROM t WHERE coalesce(length(a), length(b), 0) >= 60")
def pretokenized_manifest(spark, sf_dir):
    """Length from the first field that is there, and a least length."""
    t = bind.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).alias("a"), F.col("text").alias("b"))
    n = F.coalesce(F.char_length("a"), F.char_length("b"), F.lit(0)).cast("long")
    return t.select("conv_id", "turn", n.alias("length")).filter("length >= 60")


@query("WITH s AS (SELECT json_extract_string(props, '$.k') AS k, event_type FROM events) SELECT event_type, count(*) AS n, count(DISTINCT k) AS kinds FROM s WHERE k IS NOT NULL AND CAST(k AS INTEGER) >= 0 GROUP BY 1")
def manifest_state(spark, sf_dir):
    """Rows and distinct valid numbers of a JSON log."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = bind.table(spark, sf_dir, "events").select("event_type", k.alias("k")).filter("k >= 0")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("kinds"))


@query(f"WITH {_MANIFEST} SELECT source, CAST(sum(length) AS BIGINT) AS tokens, CAST(ceil(sum(length) / 512.0) AS BIGINT) AS steps, CAST(ceil(ceil(sum(length) / 512.0) / 8.0) AS BIGINT) AS updates FROM man GROUP BY source")
def steps_per_epoch(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir)).groupBy("source").agg(F.sum("length").alias("tokens"))
    steps = F.ceil(F.col("tokens") / 512.0)
    return m.select("source", "tokens", steps.cast("long").alias("steps"), F.ceil(steps / 8.0).cast("long").alias("updates"))


@query("""WITH f AS (SELECT user_id AS piece_id, json_object('k', json_extract_string(arg_min(props, event_id), '$.k'), 'kind', arg_min(event_type, event_id), 'version', CASE WHEN user_id % 3 = 0 THEN '1' END, 'events', CAST(count(*) AS VARCHAR)) AS old,
    json_object('k', json_extract_string(arg_max(props, event_id), '$.k'), 'kind', arg_max(event_type, event_id), 'version', '2') AS new FROM events GROUP BY user_id),
    p AS (SELECT piece_id, unnest(['k', 'kind', 'version', 'events']) AS field, old, new FROM f)
    SELECT piece_id, field, json_extract_string(old, '$.' || field) AS old, json_extract_string(new, '$.' || field) AS new FROM p WHERE json_extract_string(old, '$.' || field) <> json_extract_string(new, '$.' || field)""")
def signature_compare(spark, sf_dir):
    """Fields of two signatures (JSON) that are in both and differ: of each piece the one of its first event and the one of its last."""
    e = bind.table(spark, sf_dir, "events")
    side = lambda pick, *more: F.to_json(F.struct(F.get_json_object(pick("props", "event_id"), "$.k").alias("k"), pick("event_type", "event_id").alias("kind"), *more))
    old = side(F.min_by, F.when(F.col("user_id") % 3 == 0, "1").alias("version"), F.count(F.lit(1)).cast("string").alias("events"))
    sides = e.groupBy(F.col("user_id").alias("piece_id"), "user_id").agg(old.alias("old"), side(F.max_by, F.lit("2").alias("version")).alias("new"))
    maps = sides.select("piece_id", F.from_json("old", "map<string,string>").alias("o"), F.from_json("new", "map<string,string>").alias("n"))
    rows = maps.select("piece_id", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))).alias("field"), "o", "n")
    return rows.select("piece_id", "field", F.try_element_at("o", F.col("field")).alias("old"), F.try_element_at("n", F.col("field")).alias("new")).filter("old <> new")


@query("SELECT doc_id AS index, CASE WHEN n_chars >= 200 THEN 'accepted' ELSE 'short' END AS status, printf('data/%05d/%07d_', doc_id // 250, doc_id) || md5(source || '/' || lang) || '.npz' AS pack, n_chars AS length FROM documents")
def stream_manifest(spark, sf_dir):
    """The manifest written by the resumable stream."""
    return ingest.stream_manifest(spark, sf_dir)
