"""Queries over pieces: tokens, features, music statistics, quality, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake import spec
from notelake.functions import quantize as Q
from notelake.operators import features, manifest, tokens
from notelake.plans import sql as S
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.sources.interim import keep


def _r(c, n=6):
    return F.round(c, n)


@query(f"WITH {S.TOKENS} SELECT piece_id, pos, tok, round(onset, 6) AS onset, round(duration, 6) AS duration FROM tokens")
def tokens_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.body(bind.notes(spark, sf_dir)).select("piece_id", "pos", "tok", _r("onset").alias("onset"), _r("duration").alias("duration"))


@query(
    f"""WITH {S.TOKENS}, {S.TAGS.removeprefix(S.NOTES + ",")},
    pre AS (SELECT piece_id, unnest([0, 1, 2, 3]) AS pos, unnest([density_tok, voices_tok, register_tok, 361]) AS tok, 0.0::DOUBLE AS onset, 1e-4::DOUBLE AS duration FROM tags),
    fin AS (SELECT piece_id, CAST(count(*) * 4 + 4 AS INTEGER) AS pos, 362 AS tok, max_by(onset, note_ix) AS onset, 1e-4::DOUBLE AS duration FROM notes GROUP BY piece_id)
    SELECT piece_id, pos, tok, round(onset, 6) AS onset, round(duration, 6) AS duration FROM (FROM pre UNION ALL SELECT piece_id, pos + 4, tok, onset, duration FROM tokens UNION ALL FROM fin)"""
)
def tokens_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = keep(bind.notes(spark, sf_dir), "notes")  # for the tags and for the quads
    return tokens.stream(n, features.tags(n)).select("piece_id", "pos", "tok", _r("onset").alias("onset"), _r("duration").alias("duration"))


@query(f"WITH {S.NOTES}, {S.DENSITY} SELECT piece_id, round(density, 6) AS density FROM dens")
def piece_density(spark, sf_dir):
    return features.density(bind.notes(spark, sf_dir)).select("piece_id", _r("density").alias("density"))


@query(f"WITH {S.SWEEP} SELECT piece_id, round(mean_voices, 6) AS mean_voices, peak_voices FROM poly")
def piece_polyphony(spark, sf_dir):
    return features.polyphony(bind.notes(spark, sf_dir)).select("piece_id", _r("mean_voices").alias("mean_voices"), "peak_voices")


@query(f"WITH {S.NOTES}, {S.DENSITY} SELECT piece_id, median_pitch, CAST(CASE WHEN median_pitch < 48 THEN 371 WHEN median_pitch <= 72 THEN 372 ELSE 373 END AS INTEGER) AS register_tok FROM dens")
def piece_register(spark, sf_dir):
    r = F.when(F.col("median_pitch") < 48, 371).when(F.col("median_pitch") <= 72, 372).otherwise(373)
    return features.density(bind.notes(spark, sf_dir)).select("piece_id", "median_pitch", r.alias("register_tok"))


@query(f"WITH {S.NOTES}, {S.DENSITY}, {S.QUARTILES} SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM quart")
def density_quartiles(spark, sf_dir):
    return features.quartiles(features.density(bind.notes(spark, sf_dir))).select(*[_r(q).alias(q) for q in ("q1", "q2", "q3")])


@query(f"WITH {S.TAGS} SELECT * FROM tags")
def structural_tags(spark, sf_dir):
    return features.tags(bind.notes(spark, sf_dir)).select("piece_id", "density_tok", "voices_tok", "register_tok")


_CLASSES = "cls AS (SELECT piece_id, c AS pitch_class, (SELECT count(*) FROM notes_m m WHERE m.piece_id = p.piece_id AND m.pitch % 12 = c)::DOUBLE / p.n AS share FROM (SELECT piece_id, count(*) AS n FROM notes_m GROUP BY piece_id) p, range(12) r(c))"
_MELODIC = S.RAW + ", notes_m AS (SELECT * FROM notes_all WHERE NOT is_drum)"
_STATS = f"""{_MELODIC}, {_CLASSES},
ent AS (SELECT piece_id, sum(CASE WHEN share > 0 THEN -share * log2(share) ELSE 0 END) AS entropy, list(share ORDER BY pitch_class) AS classes FROM cls GROUP BY piece_id),
gap AS (SELECT piece_id, onset - lag(onset) OVER (PARTITION BY piece_id ORDER BY onset, note_ix) AS gap FROM notes_m),
reg AS (SELECT piece_id, CASE WHEN count(*) >= 3 AND avg(gap) FILTER (gap > 1e-4) > 1e-8 THEN stddev_pop(gap) FILTER (gap > 1e-4) / avg(gap) FILTER (gap > 1e-4) ELSE 0 END AS regularity FROM gap GROUP BY piece_id),
bas AS (SELECT piece_id, count(*) AS n_notes, CASE WHEN max(onset + duration) > 0 THEN count(*) / max(onset + duration) ELSE 0 END AS note_density, avg(velocity) AS mean_velocity FROM notes_m GROUP BY piece_id),
stats AS (SELECT * FROM bas JOIN reg USING (piece_id) JOIN ent USING (piece_id))"""


def _melodic(spark, sf_dir):
    return bind.notes_all(spark, sf_dir).filter(~F.col("is_drum"))


@query(f"WITH {_MELODIC}, {_CLASSES} SELECT piece_id, CAST(pitch_class AS INTEGER) AS pitch_class, round(share, 6) AS share FROM cls")
def pitch_class_hist(spark, sf_dir):
    return features.pitch_classes(_melodic(spark, sf_dir)).select("piece_id", "pitch_class", _r("share").alias("share"))


@query(f"WITH {_STATS} SELECT piece_id, round(entropy, 6) AS entropy FROM ent")
def pitch_entropy(spark, sf_dir):
    return features.entropy(features.pitch_classes(_melodic(spark, sf_dir))).select("piece_id", _r("entropy").alias("entropy"))


@query(f"WITH {_STATS} SELECT piece_id, round(note_density, 6) AS note_density, round(mean_velocity, 6) AS mean_velocity FROM bas")
def note_density(spark, sf_dir):
    g = _melodic(spark, sf_dir).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("onset") + F.col("duration")).alias("end"), F.avg("velocity").alias("v"))
    return g.select("piece_id", _r(F.when(F.col("end") > 0, F.col("n") / F.col("end")).otherwise(0.0)).alias("note_density"), _r("v").alias("mean_velocity"))


@query(f"WITH {_STATS} SELECT piece_id, round(regularity, 6) AS regularity FROM reg")
def rhythmic_regularity(spark, sf_dir):
    return features.regularity(_melodic(spark, sf_dir)).select("piece_id", _r("regularity").alias("regularity"))


_MEASURES = ("pitch_class_cosine", "seed_entropy", "continuation_entropy", "seed_note_density", "continuation_note_density", "note_density_ratio", "seed_mean_velocity", "continuation_mean_velocity", "velocity_ratio", "seed_regularity", "continuation_regularity")


def _compare(spark, sf_dir) -> DataFrame:
    """A piece (seed) against the next piece (continuation), eleven measures."""
    s = features.statistics(_melodic(spark, sf_dir))
    a = s.select("piece_id", *[F.col(c).alias(f"a_{c}") for c in s.columns if c != "piece_id"])
    b = s.select((F.col("piece_id") - 1).alias("piece_id"), *[F.col(c).alias(f"b_{c}") for c in s.columns if c != "piece_id"])
    ratio = lambda c: F.col(f"b_{c}") / F.greatest(F.col(f"a_{c}"), F.lit(1e-8))
    return a.join(b, "piece_id").select(
        "piece_id", features.cosine(F.col("a_classes"), F.col("b_classes")).alias("pitch_class_cosine"), F.col("a_entropy").alias("seed_entropy"), F.col("b_entropy").alias("continuation_entropy"),
        F.col("a_note_density").alias("seed_note_density"), F.col("b_note_density").alias("continuation_note_density"), ratio("note_density").alias("note_density_ratio"),
        F.col("a_mean_velocity").alias("seed_mean_velocity"), F.col("b_mean_velocity").alias("continuation_mean_velocity"), ratio("mean_velocity").alias("velocity_ratio"),
        F.col("a_regularity").alias("seed_regularity"), F.col("b_regularity").alias("continuation_regularity"),
    )


_COMPARE = f"""{_STATS},
cmp AS (SELECT a.piece_id, list_dot_product(a.classes, b.classes) / (sqrt(list_dot_product(a.classes, a.classes)) * sqrt(list_dot_product(b.classes, b.classes))) AS pitch_class_cosine, a.entropy AS seed_entropy, b.entropy AS continuation_entropy,
 a.note_density AS seed_note_density, b.note_density AS continuation_note_density, b.note_density / greatest(a.note_density, 1e-8::DOUBLE) AS note_density_ratio, a.mean_velocity AS seed_mean_velocity, b.mean_velocity AS continuation_mean_velocity,
 b.mean_velocity / greatest(a.mean_velocity, 1e-8::DOUBLE) AS velocity_ratio, a.regularity AS seed_regularity, b.regularity AS continuation_regularity FROM stats a JOIN stats b ON b.piece_id = a.piece_id + 1)"""


@query(f"WITH {_COMPARE} SELECT piece_id, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM cmp")
def seed_vs_continuation(spark, sf_dir):
    return _compare(spark, sf_dir).select("piece_id", *[_r(m).alias(m) for m in _MEASURES])


def _unpivot(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.unpivot(ids, list(_MEASURES), "measure", "value")


@query(f"WITH {_COMPARE} SELECT measure, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM (UNPIVOT (SELECT * EXCLUDE piece_id FROM cmp) ON * INTO NAME measure VALUE value) GROUP BY measure")
def metric_summary(spark, sf_dir):
    return _unpivot(_compare(spark, sf_dir), ["piece_id"]).groupBy("measure").agg(_r(F.avg("value"), 5).alias("mean"), _r(F.stddev_pop("value"), 5).alias("std"))


@query(f"WITH {_COMPARE} SELECT model, measure, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM (UNPIVOT (SELECT {S.SOURCE} AS model, * EXCLUDE piece_id FROM cmp) ON * EXCLUDE model INTO NAME measure VALUE value) GROUP BY model, measure")
def metric_by_model(spark, sf_dir):
    rows = _unpivot(_compare(spark, sf_dir).withColumn("model", bind.source_of("piece_id")), ["model"])
    return rows.groupBy("model", "measure").agg(_r(F.avg("value"), 5).alias("mean"), _r(F.stddev_pop("value"), 5).alias("std"))


_PROFILE_ROWS = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}, {v[4]}, {v[5]}, {v[6]}::DOUBLE)" for k, v in spec.PROFILES.items())
_PROFILES = f"prof(source, sample_weight, raw_share, min_seconds, filter_velocity, min_notes, min_pitches, dominance) AS (VALUES {_PROFILE_ROWS})"
#: Seconds are onsets in minutes times 60; programs 0 and 1 are piano; every tenth piece has one velocity.
_QUALITY = f"""{S.RAW}, {_PROFILES},
trk AS (SELECT *, {S.SOURCE} AS source, CASE WHEN piece_id % 10 = 0 THEN 64 ELSE velocity END AS vel FROM notes_all),
grp AS (SELECT piece_id, source, max(onset + duration) AS seconds, count(*) FILTER (NOT is_drum) AS n_notes, count(DISTINCT pitch) FILTER (NOT is_drum) AS n_pitches,
 coalesce(stddev_pop(vel) FILTER (NOT is_drum), 0) AS velocity_std, count(*) FILTER (NOT is_drum AND program IN (0, 1)) AS n_piano FROM trk GROUP BY piece_id, source),
qual AS (SELECT piece_id, source, seconds, velocity_std, CASE WHEN seconds < min_seconds THEN 'too_short_seconds' WHEN (CASE WHEN n_notes > 0 THEN n_piano / n_notes ELSE 0 END) < dominance - 0.25::DOUBLE THEN 'not_piano_dominant'
 WHEN n_notes < min_notes THEN 'too_few_notes' WHEN n_pitches < min_pitches THEN 'too_few_distinct_pitches' WHEN filter_velocity AND velocity_std < 5 THEN 'uniform_velocity' ELSE 'ok' END AS reason FROM grp JOIN prof USING (source))"""


def _quality(spark, sf_dir) -> DataFrame:
    t = bind.notes_all(spark, sf_dir).withColumn("source", bind.source_of("piece_id")).withColumn("velocity", F.when(F.col("piece_id") % 10 == 0, 64).otherwise(F.col("velocity")))
    return features.quality(t, bind.profiles(spark).withColumn("dominance", F.col("dominance") - 0.25))


@query(f"WITH {_QUALITY} SELECT piece_id, source, reason = 'ok' AS keep, reason, round(seconds, 6) AS seconds, round(velocity_std, 6) AS velocity_std FROM qual")
def quality_check(spark, sf_dir):
    return _quality(spark, sf_dir).select("piece_id", "source", "keep", "reason", _r("seconds").alias("seconds"), _r("velocity_std").alias("velocity_std"))


@query(f"WITH {_QUALITY} SELECT reason, count(*) AS n, min(piece_id) AS first_piece FROM qual GROUP BY reason")
def reject_histogram(spark, sf_dir):
    return _quality(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("piece_id").alias("first_piece"))


@query(f"WITH {S.RAW} SELECT piece_id, count(*) FILTER (NOT is_drum) AS n, coalesce(CASE WHEN count(DISTINCT program) FILTER (NOT is_drum) = 0 THEN false WHEN count(DISTINCT program) FILTER (NOT is_drum) = 1 THEN true ELSE bool_and(program IN (0, 1)) FILTER (NOT is_drum) END, false) AS piano_only, bool_or(is_drum OR program NOT BETWEEN 0 AND 7) AS rejected FROM notes_all GROUP BY piece_id")
def piano_rules(spark, sf_dir):
    """Two rules kept apart: programs 0 and 1 of melodic tracks (one track passes whatever it is), and the strict one that any drum or program over 7 breaks."""
    m = ~F.col("is_drum")
    programs = F.countDistinct(F.when(m, F.col("program")))
    only = F.when(programs == 0, False).when(programs == 1, True).otherwise(F.coalesce(F.every(F.when(m, F.col("program").isin(0, 1))), F.lit(False)))
    return bind.notes_all(spark, sf_dir).groupBy("piece_id").agg(F.count(F.when(m, 1)).alias("n"), only.alias("piano_only"), F.bool_or(F.col("is_drum") | ~F.col("program").between(0, 7)).alias("rejected"))


_MANIFEST = f"""{S.NOTES},
man AS (SELECT piece_id, {S.SOURCE} AS source, {S.COMPOSER} AS composer, count(*) * 4 + 5 AS length, max(onset) AS total, max_by(onset + greatest(1e-4::DOUBLE, duration), note_ix) AS tail FROM notes GROUP BY piece_id)"""


@query(f"WITH {_MANIFEST} SELECT piece_id, source, composer, length, round(tail, 6) AS tail_duration, substr(sha1('midi/' || source || '/' || piece_id || '.mid'), 1, 16) AS entry_id FROM man")
def manifest_entries(spark, sf_dir):
    return manifest.manifest(bind.notes(spark, sf_dir)).select("piece_id", "source", "composer", "length", _r("tail_duration").alias("tail_duration"), "entry_id")


@query(f"WITH {_MANIFEST} SELECT coalesce(source, 'TOTAL') AS source, count(*) AS pieces, CAST(sum(length) AS BIGINT) AS tokens FROM man GROUP BY ROLLUP (source)")
def source_rollup(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir)).rollup("source").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("tokens"))
    return m.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "pieces", "tokens")


@query(f"WITH {_MANIFEST}, {_PROFILES}, s AS (SELECT source, count(*) AS pieces, any_value(sample_weight) AS w FROM man JOIN prof USING (source) GROUP BY source) SELECT source, pieces, round(pieces * w / sum(pieces * w) OVER (), 6) AS probability FROM s")
def sampling_probs(spark, sf_dir):
    return manifest.sampling_probabilities(manifest.manifest(bind.notes(spark, sf_dir)), bind.profiles(spark)).select("source", "pieces", _r("probability").alias("probability"))


@query(f"WITH {_MANIFEST}, {_PROFILES}, m AS (SELECT source, sum(length) AS tokens FROM man GROUP BY source) SELECT source, round(tokens / sum(tokens) OVER (), 6) AS raw, round(tokens * sample_weight / sum(tokens * sample_weight) OVER (), 6) AS share, round(sample_weight / sum(sample_weight) OVER (), 6) AS fallback FROM m JOIN prof USING (source)")
def weight_distribution(spark, sf_dir):
    """Of each source: its share of all tokens, that share by weight, and what holds where no share is known."""
    tokens_of = manifest.manifest(bind.notes(spark, sf_dir)).groupBy("source").agg(F.sum("length").alias("tokens"))
    p = tokens_of.join(F.broadcast(bind.profiles(spark)), "source")
    total = p.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("sample_weight")).alias("weighted"), F.sum("sample_weight").alias("weights"))
    part = lambda x, whole, name: _r(x / F.col(whole)).alias(name)
    return p.crossJoin(F.broadcast(total)).select("source", part(F.col("tokens"), "all", "raw"), part(F.col("tokens") * F.col("sample_weight"), "weighted", "share"), part(F.col("sample_weight"), "weights", "fallback"))


@query(f"WITH {_MANIFEST}, {S.TOKENS.removeprefix(S.NOTES + ',')} SELECT round(avg(length), 6) AS mean_length, min(length) AS min_length, max(length) AS max_length, (SELECT count(DISTINCT tok) FROM tokens) AS used, round((SELECT count(DISTINCT tok) FROM tokens) / 374, 6) AS coverage FROM man")
def vocab_coverage(spark, sf_dir):
    n = bind.notes(spark, sf_dir)
    m = manifest.manifest(n).agg(_r(F.avg("length")).alias("mean_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    used = tokens.body(n).agg(F.countDistinct("tok").alias("used"))
    return m.crossJoin(used).select("*", _r(F.col("used") / spec.VOCABULARY).alias("coverage"))


@query(f"WITH {_MANIFEST} SELECT round(avg(length), 6) AS mean, min(length) AS least, max(length) AS most, round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.9), 6) AS p90, round(quantile_cont(length, 0.99), 6) AS p99 FROM man")
def length_percentiles(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir))
    g = m.agg(_r(F.avg("length")).alias("mean"), F.min("length").alias("least"), F.max("length").alias("most"), F.percentile("length", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"))
    return g.select("mean", "least", "most", *[_r(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query(f"WITH {S.TOKENS} SELECT CAST(i AS INTEGER) AS tok, (SELECT count(*) FROM tokens t WHERE t.tok = i) AS n FROM range(374) r(i)")
def token_frequency(spark, sf_dir):
    counts = tokens.body(bind.notes(spark, sf_dir)).groupBy("tok").count()
    every = spark.range(spec.VOCABULARY).select(F.col("id").cast("int").alias("tok"))
    return every.join(counts, "tok", "left").select("tok", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"WITH {_MANIFEST}, b AS (SELECT min(length) AS lo, max(length) AS hi FROM man) SELECT CAST(least(39, floor((length - lo) * 40.0::DOUBLE / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM man, b GROUP BY 1")
def length_histogram(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir)).select("length")
    b = F.broadcast(m.agg(F.min("length").alias("lo"), F.max("length").alias("hi")))
    return m.crossJoin(b).groupBy(F.least(F.lit(39), F.floor((F.col("length") - F.col("lo")) * F.lit(40.0) / (F.col("hi") - F.col("lo")))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MANIFEST} SELECT coalesce(nullif(trim(composer), ''), 'unknown') AS composer, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM man), 6) AS percent FROM man GROUP BY 1 ORDER BY n DESC, composer LIMIT 10")
def composer_topk(spark, sf_dir):
    m = manifest.manifest(bind.notes(spark, sf_dir))
    total = F.broadcast(m.agg(F.count(F.lit(1)).alias("total")))
    g = m.groupBy(F.coalesce(F.nullif(F.trim("composer"), F.lit("")), F.lit("unknown")).alias("composer")).agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(total).select("composer", "n", _r(100.0 * F.col("n") / F.col("total")).alias("percent")).orderBy(F.desc("n"), "composer").limit(10)


@query(f"WITH {_MANIFEST} SELECT piece_id, length FROM man WHERE length >= 250")
def eligible_pieces(spark, sf_dir):
    return manifest.manifest(bind.notes(spark, sf_dir)).filter("length >= 250").select("piece_id", "length")


_META = f"""{_MANIFEST}, paths AS (SELECT piece_id, '..\\Maestro/' || source || '/P' || piece_id || '.MIDI' AS path FROM man),
meta AS (SELECT row_number() OVER (ORDER BY piece_id) AS row, CASE WHEN piece_id % 3 = 0 THEN 'maestro/' || {S.SOURCE} || '/p' || piece_id || '.midi' ELSE 'other/p' || piece_id || '.midi' END AS rel, 'c' || piece_id AS composer FROM man WHERE piece_id % 5 <> 0
  UNION ALL SELECT 100000 + piece_id, 'other/p' || piece_id || '.midi', 'again' || piece_id FROM man WHERE piece_id % 4 = 0),
byrel AS (SELECT rel, max_by(composer, row) AS composer FROM meta GROUP BY rel), bybase AS (SELECT split_part(rel, '/', -1) AS base, min_by(composer, row) AS composer FROM meta GROUP BY 1),
keyed AS (SELECT piece_id, regexp_replace(replace(lower(path), '\\', '/'), '^[./]+', '') AS rel FROM paths)"""


@query(f"WITH {_META} SELECT k.piece_id, k.rel, coalesce(r.composer, b.composer, 'unknown') AS composer FROM keyed k LEFT JOIN byrel r USING (rel) LEFT JOIN bybase b ON b.base = split_part(k.rel, '/', -1)")
def metadata_fallback_join(spark, sf_dir):
    """Metadata by relative path (the last row of a path wins), else by file name (the first row wins)."""
    m = manifest.manifest(bind.notes(spark, sf_dir))
    name = F.concat(F.lit("/p"), F.col("piece_id").cast("string"), F.lit(".midi"))
    first = m.filter("piece_id % 5 <> 0").select(
        (F.col("piece_id")).alias("row"), F.when(F.col("piece_id") % 3 == 0, F.concat(F.lit("maestro/"), "source", name)).otherwise(F.concat(F.lit("other"), name)).alias("rel"), F.concat(F.lit("c"), F.col("piece_id").cast("string")).alias("composer")
    )
    second = m.filter("piece_id % 4 = 0").select((F.col("piece_id") + 100000).alias("row"), F.concat(F.lit("other"), name).alias("rel"), F.concat(F.lit("again"), F.col("piece_id").cast("string")).alias("composer"))
    paths = m.select("piece_id", F.concat(F.lit("..\\Maestro/"), "source", F.lit("/P"), F.col("piece_id").cast("string"), F.lit(".MIDI")).alias("path"))
    return manifest.with_metadata(paths, first.unionByName(second))


@query(
    f"""WITH {_PROFILES}, asked AS (SELECT piece_id, list_extract(['ARIA ', 'maestro', ' Giant', 'adl_piano', 'nowhere'], CAST(piece_id % 5 + 1 AS INTEGER)) AS name, CASE WHEN piece_id % 3 = 0 THEN CAST(n AS INTEGER) END AS own_notes FROM (SELECT user_id AS piece_id, count(*) AS n FROM events GROUP BY user_id)),
    alias(a, c) AS (VALUES {", ".join(f"('{a}', '{c}')" for a, c in spec.ALIASES.items())})
    SELECT piece_id, name, coalesce(c, lower(trim(name))) AS source, CAST(coalesce(own_notes, min_notes, 100) AS INTEGER) AS min_notes, coalesce(sample_weight, 1.0) AS sample_weight FROM asked LEFT JOIN alias ON a = lower(trim(name)) LEFT JOIN prof ON prof.source = coalesce(c, lower(trim(name)))"""
)
def profile_layering(spark, sf_dir):
    """Each piece's own setting under the raw name of its source, then the default of the canonical name, then the configuration."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("ARIA ", "maestro", " Giant", "adl_piano", "nowhere")]), (F.col("piece_id") % 5 + 1).cast("int"))
    pieces = bind.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("piece_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    asked = pieces.select("piece_id", names.alias("name"), F.when(F.col("piece_id") % 3 == 0, F.col("n")).alias("own_notes")).withColumn("source", manifest.canonical(F.col("name")))
    joined = asked.join(F.broadcast(bind.profiles(spark)), "source", "left")
    return joined.select("piece_id", "name", "source", F.coalesce("own_notes", "min_notes", F.lit(100)).alias("min_notes"), F.coalesce("sample_weight", F.lit(1.0)).alias("sample_weight"))
