"""Queries over token sequences: decoding, windows, targets, padding, audits, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake import spec
from notelake.functions import quantize as Q
from notelake.operators import manifest, scan, tokens
from notelake.plans import sql as S
from notelake.plans.pieces import _MANIFEST, _r
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.sources.interim import keep

_SEQ = S.TOKENS + ", seqs AS (SELECT piece_id, list(tok ORDER BY pos) AS seq FROM tokens GROUP BY piece_id)"
_DC, _UC = S.doubles(spec.DELTA_CENTRES), S.doubles(spec.DURATION_CENTRES)


def _body(spark, sf_dir) -> DataFrame:
    return tokens.body(bind.notes(spark, sf_dir))


def _seqs(spark, sf_dir) -> DataFrame:
    return tokens.sequences(_body(spark, sf_dir))


_DECODED = f"""{S.QUADS},
decoded AS (SELECT piece_id, note_ix, sum(list_extract({_DC}, delta_tok + 1)) OVER (PARTITION BY piece_id ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS onset,
 list_extract({_UC}, dur_tok - 215) AS duration, pitch_tok - 107 AS pitch, CAST(floor((vel_tok - 344 + 0.5) * 8) AS INTEGER) AS velocity FROM quads)"""


@query(f"WITH {_DECODED} SELECT piece_id, note_ix, round(onset, 5) AS onset, round(duration, 6) AS duration, CAST(pitch AS INTEGER) AS pitch, velocity FROM decoded")
def quad_decode(spark, sf_dir):
    return tokens.decode(_body(spark, sf_dir)).select("piece_id", "note_ix", _r("onset", 5).alias("onset"), _r("duration").alias("duration"), "pitch", "velocity")


@query(f"WITH {_DECODED}, o AS (SELECT piece_id, count(*) AS n, max(onset + duration) AS e FROM notes GROUP BY 1), d AS (SELECT piece_id, count(*) AS m, max(onset + duration) AS f FROM decoded GROUP BY 1) SELECT piece_id, n, m, abs(n - m) <= 0.05 * n AS count_ok, abs(e - f) / greatest(e, 1e-8::DOUBLE) <= 0.05 AS duration_ok FROM o JOIN d USING (piece_id)")
def roundtrip_check(spark, sf_dir):
    """Note counts and durations of a piece and of what its tokens decode to, within 5 %."""
    n = bind.notes(spark, sf_dir)
    end = F.max(F.col("onset") + F.col("duration"))
    o = n.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), end.alias("e"))
    d = tokens.decode(tokens.body(n)).groupBy("piece_id").agg(F.count(F.lit(1)).alias("m"), end.alias("f"))
    return o.join(d, "piece_id").select("piece_id", "n", "m", (F.abs(F.col("n") - F.col("m")) <= 0.05 * F.col("n")).alias("count_ok"), (F.abs(F.col("e") - F.col("f")) / F.greatest("e", F.lit(1e-8)) <= 0.05).alias("duration_ok"))


@query()
def quad_decode_dirty(spark, sf_dir):
    """Streams with every 7th token dropped and a special put in now and then; quads found by the resynchronising fold."""
    seq = _seqs(spark, sf_dir)
    dirty = F.filter("seq", lambda t, i: i % 31 != 7)
    with_stops = F.flatten(F.transform(dirty, lambda t, i: F.when(i % 50 == 3, F.array(F.lit(spec.BOS), t)).otherwise(F.array(t))))
    out = seq.select("piece_id", with_stops.alias("seq"))
    return out.select("piece_id", F.posexplode(tokens.decode_dirty(F.col("seq"))).alias("note_ix", "q")).select("piece_id", "note_ix", "q.d", "q.p", "q.u", "q.v")


@query(f"WITH {_SEQ}, st AS (SELECT piece_id, seq, CAST(unnest(range(0, len(seq) - 48 + 1, 16)) AS INTEGER) AS start FROM seqs WHERE len(seq) >= 48) SELECT piece_id, start, array_to_string(seq[start + 1:start + 32], ' ') AS seed, array_to_string(seq[start + 33:start + 48], ' ') AS continuation FROM st")
def seed_pairs(spark, sf_dir):
    w = tokens.windows(_seqs(spark, sf_dir), 32, 16, 16)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return w.select("piece_id", "start", text("seed"), text("continuation"))


_START = "CAST(('0x' || substr(md5('7:' || piece_id), 1, 7))::BIGINT % (len(seq) - 48 + 1) AS INTEGER)"


@query(f"WITH {_SEQ}, h AS (SELECT piece_id, seq, {_START} AS raw, len(seq) - 48 AS most FROM seqs WHERE len(seq) >= 48), s AS (SELECT *, CASE WHEN (CASE WHEN raw % 4 * 2 > 4 THEN raw - raw % 4 + 4 ELSE raw - raw % 4 END) > most THEN most - most % 4 ELSE (CASE WHEN raw % 4 * 2 > 4 THEN raw - raw % 4 + 4 ELSE raw - raw % 4 END) END AS start FROM h) SELECT piece_id, raw AS drawn, CAST(start AS INTEGER) AS start, array_to_string(seq[start + 1:start + 48], ' ') AS window_tokens FROM s")
def hash_window(spark, sf_dir):
    """One window a piece at a hashed start, snapped to an event boundary."""
    s = _seqs(spark, sf_dir).filter(F.size("seq") >= 48)
    number = F.conv(F.substring(manifest.hash_order("piece_id", 7), 1, 7), 16, 10).cast("long")
    s = s.select("piece_id", "seq", (number % (F.size("seq") - 47)).cast("int").alias("drawn"), (F.size("seq") - 48).alias("most"))
    s = s.withColumn("start", tokens.snap_start(F.col("drawn"), F.col("most")))
    return s.select("piece_id", "drawn", "start", F.array_join(F.slice("seq", F.col("start") + 1, F.lit(48)).cast("array<string>"), " ").alias("window_tokens"))


@query(f"WITH {S.TOKENS} SELECT piece_id, pos, CASE WHEN pos < 31 THEN -100 ELSE coalesce(lead(tok) OVER (PARTITION BY piece_id ORDER BY pos), -100) END AS target FROM tokens")
def targets_shift(spark, sf_dir):
    """Next-token targets: -100 at the end and before the last of 32 seed positions."""
    nxt = F.coalesce(F.lead("tok").over(W.partitionBy("piece_id").orderBy("pos")), F.lit(-100))
    return _body(spark, sf_dir).select("piece_id", "pos", F.when(F.col("pos") < 31, -100).otherwise(nxt).alias("target"))


@query(f"WITH {_MANIFEST}, b AS (SELECT piece_id, piece_id // 16 AS batch, piece_id % 3 = 0 AS new_piece, CAST(length - 5 AS INTEGER) AS n FROM man) SELECT piece_id, batch, CAST(CASE WHEN lead(new_piece) OVER (PARTITION BY batch ORDER BY piece_id) THEN n - 1 ELSE -1 END AS INTEGER) AS masked_pos FROM b")
def boundary_mask(spark, sf_dir):
    """The last position of a batch row whose successor begins a new piece (-1 where nothing is masked)."""
    m = manifest.manifest(bind.notes(spark, sf_dir)).select("piece_id", F.floor(F.col("piece_id") / 16).alias("batch"), (F.col("piece_id") % 3 == 0).alias("new_piece"), (F.col("length") - 5).cast("int").alias("n"))
    nxt = F.lead("new_piece").over(W.partitionBy("batch").orderBy("piece_id"))
    return m.select("piece_id", "batch", F.when(nxt, F.col("n") - 1).otherwise(-1).alias("masked_pos"))


@query(f"WITH {_SEQ}, b AS (SELECT piece_id, piece_id // 16 AS batch, seq FROM seqs), m AS (SELECT batch, max(len(seq)) AS n FROM b GROUP BY batch) SELECT piece_id, batch, CAST(n AS INTEGER) AS width, md5(array_to_string(list_concat(seq, list_transform(range(0, n - len(seq)), lambda i: 0)), ' ')) AS padded_md5 FROM b JOIN m USING (batch)")
def batch_padding(spark, sf_dir):
    p = tokens.pad(_seqs(spark, sf_dir).withColumn("batch", F.floor(F.col("piece_id") / 16)), "batch", 0)
    return p.select("piece_id", "batch", F.size("seq").alias("width"), F.md5(F.array_join(F.col("seq").cast("array<string>"), " ")).alias("padded_md5"))


_STREAMED = f"""{S.TOKENS}, {S.TAGS.removeprefix(S.NOTES + ",")}, full_stream AS (
 SELECT piece_id, unnest([0, 1, 2, 3]) AS pos, unnest([density_tok, voices_tok, register_tok, 361]) AS tok FROM tags UNION ALL SELECT piece_id, pos + 4, tok FROM tokens UNION ALL SELECT piece_id, CAST(count(*) * 4 + 4 AS INTEGER), 362 FROM notes GROUP BY piece_id)"""


def _stream(spark, sf_dir) -> DataFrame:
    from notelake.operators import features

    n = keep(bind.notes(spark, sf_dir), "notes")
    return tokens.stream(n, features.tags(n))


@query(
    f"""WITH {_STREAMED} SELECT min(tok) AS least, max(tok) AS most, count(*) FILTER (tok NOT BETWEEN 0 AND 373) AS outside, round(count(*) FILTER (tok <= 359) / count(*), 6) AS note_ratio, round(count(*) FILTER (tok >= 363) / count(*), 6) AS meta_ratio,
    count(*) FILTER (tok <= 359 AND NOT (CASE pos % 4 WHEN 0 THEN tok BETWEEN 0 AND 127 WHEN 1 THEN tok BETWEEN 128 AND 215 WHEN 2 THEN tok BETWEEN 216 AND 343 ELSE tok BETWEEN 344 AND 359 END)) AS slot_mismatches FROM full_stream"""
)
def slot_audit(spark, sf_dir):
    """Ids out of range, shares of note and meta tokens, tokens whose class is not that of pos % 4."""
    t, n = F.col("tok"), F.count(F.lit(1))
    slots = F.when(F.col("pos") % 4 == 0, t.between(0, 127)).when(F.col("pos") % 4 == 1, t.between(128, 215)).when(F.col("pos") % 4 == 2, t.between(216, 343)).otherwise(t.between(344, 359))
    return _stream(spark, sf_dir).agg(
        F.min(t).alias("least"), F.max(t).alias("most"), F.count_if(~t.between(0, 373)).alias("outside"), _r(F.count_if(t <= 359) / n).alias("note_ratio"), _r(F.count_if(t >= 363) / n).alias("meta_ratio"),
        F.count_if((t <= 359) & ~slots).alias("slot_mismatches"),
    )


@query(f"WITH {S.TOKENS} SELECT piece_id, count(*) FILTER (NOT (CASE pos % 3 WHEN 0 THEN tok BETWEEN 0 AND 31 WHEN 1 THEN tok BETWEEN 32 AND 119 ELSE tok BETWEEN 120 AND 151 END)) AS violations FROM tokens GROUP BY piece_id")
def triplet_violations(spark, sf_dir):
    """The check of the older three-slot vocabulary."""
    t = F.col("tok")
    good = F.when(F.col("pos") % 3 == 0, t.between(0, 31)).when(F.col("pos") % 3 == 1, t.between(32, 119)).otherwise(t.between(120, 151))
    return _body(spark, sf_dir).groupBy("piece_id").agg(F.count_if(~good).alias("violations"))


@query(f"WITH {S.QUADS}, g AS (SELECT piece_id, note_ix, delta_tok, sum(CASE WHEN delta_tok > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS grp FROM quads) SELECT piece_id, note_ix, CAST(CASE WHEN delta_tok > 100 THEN 0 ELSE count(*) FILTER (delta_tok <= 100) OVER (PARTITION BY piece_id, grp ORDER BY note_ix ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS streak FROM g")
def short_delta_streak(spark, sf_dir):
    """Consecutive short steps before each note (the zero-step rule with a limit that these data reach), reset by a long one."""
    q = tokens.quads(bind.notes(spark, sf_dir))
    run = W.partitionBy("piece_id").orderBy("note_ix").rowsBetween(W.unboundedPreceding, 0)
    g = q.select("piece_id", "note_ix", "delta_tok", F.sum((F.col("delta_tok") > 100).cast("int")).over(run).alias("grp"))
    own = W.partitionBy("piece_id", "grp").orderBy("note_ix").rowsBetween(W.unboundedPreceding, 0)
    return g.select("piece_id", "note_ix", F.when(F.col("delta_tok") > 100, 0).otherwise(F.sum((F.col("delta_tok") <= 100).cast("long")).over(own)).cast("long").alias("streak"))


@query(f"WITH {S.TOKENS}, c AS (SELECT piece_id, tok, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT piece_id, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.6 AS warned FROM c GROUP BY piece_id")
def repetition_share(spark, sf_dir):
    c = _body(spark, sf_dir).groupBy("piece_id", "tok").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return c.groupBy("piece_id").agg(_r(share).alias("share"), (share > 0.6).alias("warned"))


@query(f"WITH {S.TOKENS}, p AS (SELECT *, lag(onset) OVER (PARTITION BY piece_id ORDER BY pos) AS before FROM tokens) SELECT piece_id, pos FROM p WHERE onset < before OR duration <= 0 OR tok NOT BETWEEN 0 AND 359 OR (pos % 4 <> 0 AND onset <> before)")
def invariant_violations(spark, sf_dir):
    """Rows that break an invariant of a body (there must be none): onsets in order, durations positive, ids in range, a quad shares its onset."""
    before = F.lag("onset").over(W.partitionBy("piece_id").orderBy("pos"))
    p = _body(spark, sf_dir).withColumn("before", before)
    bad = (F.col("onset") < F.col("before")) | (F.col("duration") <= 0) | ~F.col("tok").between(0, 359) | ((F.col("pos") % 4 != 0) & (F.col("onset") != F.col("before")))
    return p.filter(bad).select("piece_id", "pos")


@query(f"WITH {S.TOKENS} SELECT piece_id, CAST(pos // 16 AS INTEGER) AS block, array_to_string(list_concat(list(tok ORDER BY pos), list_transform(range(0, 16 - count(*)), lambda i: 0)), ' ') AS block_tokens FROM tokens GROUP BY 1, 2")
def phrase_blocks(spark, sf_dir):
    """Tumbling windows of 16 tokens, the last padded by zeros."""
    b = _body(spark, sf_dir).groupBy("piece_id", F.floor(F.col("pos") / 16).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]).alias("seq"))
    padded = F.concat("seq", F.array_repeat(F.lit(0), 16 - F.size("seq")))
    return b.select("piece_id", "block", F.array_join(padded.cast("array<string>"), " ").alias("block_tokens"))


@query(f"WITH {_SEQ} SELECT piece_id, array_to_string(seq[-12:], ' ') AS recent FROM seqs")
def recent_window(spark, sf_dir):
    return _seqs(spark, sf_dir).select("piece_id", F.array_join(F.slice("seq", -12, 12).cast("array<string>"), " ").alias("recent"))


_ON = S.NOTES + ", arr AS (SELECT piece_id, list(onset ORDER BY note_ix) AS a FROM notes GROUP BY piece_id)"


def _onsets(spark, sf_dir) -> DataFrame:
    return bind.notes(spark, sf_dir).groupBy("piece_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_ix", "onset"))), lambda s: s["onset"]).alias("a"))


@query(f"WITH {_ON}, i AS (SELECT piece_id, a, unnest(range(16)) AS i, (len(a) - 1) / 15.0::DOUBLE AS step FROM arr), f AS (SELECT *, CAST(floor(i * step) AS INTEGER) AS lo FROM i) SELECT piece_id, CAST(i AS INTEGER) AS i, round(a[lo + 1] + (i * step - lo) * (a[least(lo + 2, len(a))] - a[lo + 1]), 6) AS value FROM f")
def resample_features(spark, sf_dir):
    """Linear interpolation of a piece's onsets to 16 values."""
    a = _onsets(spark, sf_dir).select("piece_id", "a", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    at = F.col("i") * ((F.size("a") - 1) / F.lit(15.0))
    lo = F.floor(at).cast("int")
    low, high = F.element_at("a", lo + 1), F.element_at("a", F.least(lo + 2, F.size("a")))
    return a.select("piece_id", "i", _r(low + (at - lo) * (high - low)).alias("value"))


@query(f"WITH {_ON}, e AS (SELECT piece_id, flatten(list_transform(a, lambda v, j: list_transform(range(0, t // len(a) + CASE WHEN j - 1 < t % len(a) THEN 1 ELSE 0 END), lambda k: v))) AS b FROM (SELECT *, 3 * len(a) + 2 AS t FROM arr)) SELECT piece_id, CAST(len(b) AS INTEGER) AS n, round(list_sum(b), 6) AS total FROM e")
def expand_features(spark, sf_dir):
    """All values of a piece spread over three places each and two more: each t // n times, the first t % n once more."""
    a = _onsets(spark, sf_dir).withColumn("n", F.size("a")).withColumn("t", 3 * F.col("n") + 2)
    times = lambda j: F.floor(F.col("t") / F.col("n")).cast("int") + (j < F.col("t") % F.col("n")).cast("int")
    return a.select("piece_id", F.flatten(F.transform("a", lambda v, j: F.array_repeat(v, times(j)))).alias("b")).select("piece_id", F.size("b").alias("n"), _r(F.aggregate("b", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(f"WITH {_ON}, g AS (SELECT piece_id, note_ix, onset, CAST(note_ix // 3 AS INTEGER) AS grp FROM notes) SELECT piece_id, grp, round(min_by(onset, note_ix), 6) AS onset FROM g GROUP BY 1, 2")
def compress_features(spark, sf_dir):
    """The first value of each group of three notes."""
    g = bind.notes(spark, sf_dir).groupBy("piece_id", F.floor(F.col("note_ix") / 3).cast("int").alias("grp"))
    return g.agg(_r(F.min_by("onset", "note_ix")).alias("onset"))


@query(f"WITH {S.NOTES} SELECT piece_id, note_ix, round(max(onset - (note_ix % 4) * 0.1::DOUBLE) OVER (PARTITION BY piece_id ORDER BY note_ix ROWS UNBOUNDED PRECEDING), 6) AS fixed FROM notes")
def monotone_fix(spark, sf_dir):
    """Running maximum over onsets that were shaken out of order, in two levels."""
    rows = keep(bind.notes(spark, sf_dir).select("piece_id", "note_ix", (F.col("onset") - (F.col("note_ix") % 4) * F.lit(0.1)).alias("shaken")), "shaken")
    fixed = scan.running(rows, "piece_id", F.floor(F.col("note_ix") / 4096), ["note_ix"], fixed=("max", F.col("shaken")))
    return fixed.select("piece_id", "note_ix", _r("fixed").alias("fixed"))


@query(f"WITH {_ON} SELECT piece_id, CAST(len(f) AS INTEGER) AS n, round(list_sum(f), 6) AS total FROM (SELECT piece_id, CASE WHEN piece_id % 2 = 0 THEN a ELSE list_transform(range(0, len(a)), lambda i: i * 0.05::DOUBLE) END AS f FROM arr)")
def time_feature_fallback(spark, sf_dir):
    """Stored times where there are as many as tokens, else even steps of 0.05 s (odd pieces are made to lack theirs)."""
    a = _onsets(spark, sf_dir)
    stored = F.when(F.col("piece_id") % 2 == 0, F.col("a"))
    steps = F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: i * F.lit(0.05))
    f = a.select("piece_id", F.when(F.size(stored) == F.size("a"), stored).otherwise(steps).alias("f"))
    return f.select("piece_id", F.size("f").alias("n"), _r(F.aggregate("f", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(f"WITH {S.NOTES}, r AS (SELECT piece_id, pitch, CAST(unnest(range(CAST(floor(onset * 2) AS BIGINT), CAST(floor((onset + duration) * 2) AS BIGINT) + 1)) AS BIGINT) AS frame, velocity FROM notes) SELECT piece_id, pitch, frame, round(ln(1 + max(velocity)), 6) AS level FROM r GROUP BY 1, 2, 3")
def piano_roll(spark, sf_dir):
    """All notes as a (pitch, frame) raster at two frames a second."""
    n = bind.notes(spark, sf_dir)
    frames = F.explode(F.sequence(F.floor(F.col("onset") * 2), F.floor((F.col("onset") + F.col("duration")) * 2)))
    return n.select("piece_id", "pitch", "velocity", frames.alias("frame")).groupBy("piece_id", "pitch", "frame").agg(_r(F.log1p(F.max("velocity"))).alias("level"))


@query(f"WITH {S.NOTES}, p AS (SELECT piece_id, note_ix, onset, least(onset + duration, 60.0) - onset AS clipped FROM notes WHERE onset < 60), k AS (SELECT piece_id, note_ix, clipped FROM p WHERE clipped > 1e-4), has AS (SELECT DISTINCT piece_id FROM k) SELECT piece_id, note_ix, round(clipped, 6) AS duration FROM k UNION ALL SELECT piece_id, note_ix, round(duration, 6) FROM notes WHERE piece_id NOT IN (SELECT piece_id FROM has)")
def trim_to_target(spark, sf_dir):
    """Notes cut at 60 s; a piece of which nothing is left stays as it is."""
    n = bind.notes(spark, sf_dir)
    clipped = F.when(F.col("onset") < 60, F.least(F.col("onset") + F.col("duration"), F.lit(60.0)) - F.col("onset"))
    n = n.withColumn("c", F.when(clipped > 1e-4, clipped)).withColumn("left", F.count("c").over(W.partitionBy("piece_id")))
    return n.filter((F.col("left") == 0) | F.col("c").isNotNull()).select("piece_id", "note_ix", _r(F.when(F.col("left") == 0, F.col("duration")).otherwise(F.col("c"))).alias("duration"))


_HASHED = f"{_MANIFEST}, hashed AS (SELECT *, md5('42:' || piece_id) AS h FROM man), rk AS (SELECT *, row_number() OVER (ORDER BY h, piece_id) AS rank, count(*) OVER () AS n FROM hashed)"


def _ranked(spark, sf_dir) -> DataFrame:
    m = manifest.manifest(bind.notes(spark, sf_dir))
    return manifest.global_rank(m.withColumn("h", manifest.hash_order("piece_id", 42)), "h", "piece_id")


@query(f"WITH {_HASHED}, q AS (SELECT *, greatest(1, floor(0.90 * n)) AS tr, greatest(1, floor(0.05 * n)) AS va FROM rk) SELECT piece_id, CASE WHEN rank <= tr - CASE WHEN n - tr - va <= 0 AND tr > va THEN 1 ELSE 0 END THEN 'train' WHEN rank <= tr + va - CASE WHEN n - tr - va <= 0 THEN 1 ELSE 0 END THEN 'val' ELSE 'test' END AS part FROM q")
def split_90_5_5(spark, sf_dir):
    return manifest.split_90_5_5(_ranked(spark, sf_dir)).select("piece_id", "part")


@query(f"WITH {_HASHED} SELECT piece_id, CASE WHEN rank <= least(greatest(1, round_even(n * 0.1, 0)), n - 1) THEN 'val' ELSE 'train' END AS part FROM rk")
def train_val_split(spark, sf_dir):
    n_val = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0)), F.col("n") - 1)
    return _ranked(spark, sf_dir).select("piece_id", F.when(F.col("rank") <= n_val, "val").otherwise("train").alias("part"))


@query(f"WITH {_HASHED} SELECT piece_id, rank <= greatest(1, floor(0.1 * n)) AS validation FROM rk")
def order_split(spark, sf_dir):
    """A tenth is flagged for validation; both sides keep the manifest's order (the key)."""
    return _ranked(spark, sf_dir).select("piece_id", (F.col("rank") <= F.greatest(F.lit(1), F.floor(0.1 * F.col("n")))).alias("validation"))


@query(
    f"""WITH {_MANIFEST}, e AS (SELECT *, coalesce(nullif(trim(composer), ''), 'unknown') AS c, md5('42:' || piece_id) AS h FROM man),
    s AS (SELECT c, count(*) AS size, least(greatest(1, round_even(count(*) / (SELECT count(*) FROM man) * 60, 0)), count(*)) AS quota FROM e GROUP BY c),
    r AS (SELECT e.*, quota, row_number() OVER (PARTITION BY e.c ORDER BY h, piece_id) AS rank FROM e JOIN s ON s.c = e.c) SELECT piece_id, c AS stratum FROM r ORDER BY CASE WHEN rank > quota THEN 1 ELSE 0 END, h, piece_id LIMIT 60"""
)
def stratified_subset(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir)).withColumn("stratum", F.coalesce(F.nullif(F.trim("composer"), F.lit("")), F.lit("unknown")))
    return manifest.stratified(m, "stratum", "piece_id", 60, 42).select("piece_id", "stratum")


_DRAW = "('0x' || substr(md5('9:' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query(f"WITH {_MANIFEST}, w AS (SELECT source, count(*) * CASE source WHEN 'maestro' THEN 3 WHEN 'giant_midi' THEN 2 ELSE 1 END AS w FROM man GROUP BY source), c AS (SELECT source, CAST(coalesce(sum(w) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lo, CAST(sum(w) OVER (ORDER BY source) AS DOUBLE) AS hi, CAST(sum(w) OVER () AS DOUBLE) AS total FROM w), d AS (SELECT i, {_DRAW} AS u FROM range(200) r(i)) SELECT i AS draw, source FROM d JOIN c ON u * total >= lo AND u * total < hi")
def weighted_draw(spark, sf_dir):
    """200 draws with replacement in proportion to weight: hashed uniforms against cumulative weights (a row per source, broadcast)."""
    m = manifest.manifest(bind.notes(spark, sf_dir)).groupBy("source").agg((F.count(F.lit(1)) * F.when(F.col("source") == "maestro", 3).when(F.col("source") == "giant_midi", 2).otherwise(1)).alias("w"))
    order = W.orderBy("source")
    c = m.select("source", F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("lo"), F.sum("w").over(order).cast("double").alias("hi"), F.sum("w").over(W.partitionBy(F.lit(0))).cast("double").alias("total"))
    u = F.conv(F.substring(manifest.hash_order("draw", 9), 1, 12), 16, 10).cast("long") / F.lit(281474976710656.0)
    d = spark.range(200).select(F.col("id").alias("draw")).withColumn("u", u)
    return d.join(F.broadcast(c), (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi"))).select("draw", "source")


@query("SELECT doc_id AS index, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.mid' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_members(spark, sf_dir):
    """Members that no earlier run has done (an anti-join on their index)."""
    done = bind.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"))
    return bind.members(spark, sf_dir).join(done, "index", "left_anti").select("index", "path")


@query(f"WITH {_HASHED} SELECT piece_id, (rank - 1) % 4 AS worker, (rank - 1) // 4 // 8 AS batch FROM rk")
def batch_assign(spark, sf_dir):
    """Rows in hash order dealt to four workers in turn, eight to a batch."""
    at = F.col("rank") - 1
    return _ranked(spark, sf_dir).select("piece_id", (at % 4).alias("worker"), F.floor(F.floor(at / 4) / 8).alias("batch"))


@query(f"WITH {S.TOKENS} SELECT piece_id, pos, CASE WHEN tok <= 127 THEN 'Delta_' || tok WHEN tok <= 215 THEN 'Pitch_' || (tok - 107) WHEN tok <= 343 THEN 'Duration_' || (tok - 216) ELSE 'Velocity_' || (tok - 344) END AS label, CASE WHEN tok <= 127 THEN tok WHEN tok <= 215 THEN tok - 107 WHEN tok <= 343 THEN tok - 216 ELSE tok - 344 END AS parsed FROM tokens")
def token_labels(spark, sf_dir):
    """Readable labels of tokens, and the number parsed back out of each."""
    t = F.col("tok")
    kind = F.initcap(Q.kind_of(t))
    number = F.when(t <= 127, t).when(t <= 215, t - 107).when(t <= 343, t - 216).otherwise(t - 344)
    rows = _body(spark, sf_dir).select("piece_id", "pos", F.concat_ws("_", kind, number.cast("string")).alias("label"))
    return rows.select("piece_id", "pos", "label", F.regexp_extract("label", r"_(\d+)$", 1).cast("int").alias("parsed"))
