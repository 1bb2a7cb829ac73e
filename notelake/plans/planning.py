"""Queries of the cut planner, pair mining, bar tokens, ranges and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.operators import cut, pairs, remi, tokens
from notelake.plans import sql as S
from notelake.plans.pieces import _r
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.sources.interim import keep

_TOL, _TARGET, _GAP = 0.6, 40, 0.3
_CHORDS = f"""RECURSIVE {S.NOTES.replace("raw0 AS", "raw0 AS", 1)}, nm AS MATERIALIZED (SELECT piece_id, note_ix, onset, duration FROM notes),
chord AS (SELECT piece_id, note_ix, onset, duration, onset AS anchor, 0 AS grp FROM nm WHERE note_ix = 0 UNION ALL
 SELECT n.piece_id, n.note_ix, n.onset, n.duration, CASE WHEN abs(n.onset - c.anchor) <= {_TOL} THEN c.anchor ELSE n.onset END, CASE WHEN abs(n.onset - c.anchor) <= {_TOL} THEN c.grp ELSE c.grp + 1 END FROM chord c JOIN nm n ON n.piece_id = c.piece_id AND n.note_ix = c.note_ix + 1),
grps AS (SELECT piece_id, grp, min(onset) AS onset, max(onset + duration) AS fin, count(*) AS n FROM chord GROUP BY 1, 2),
beats AS (SELECT piece_id, onset AS t, row_number() OVER (PARTITION BY piece_id ORDER BY onset, note_ix) - 1 AS beat FROM notes_all WHERE is_drum),
cand0 AS (SELECT piece_id, grp, CAST(sum(n) OVER w AS BIGINT) AS kept, fin AS t, lead(onset) OVER w - fin AS gap FROM grps WINDOW w AS (PARTITION BY piece_id ORDER BY grp ROWS UNBOUNDED PRECEDING)),
dist AS (SELECT c.piece_id, c.grp, min(abs(c.t - b.t)) AS beat, min(abs(c.t - b.t)) FILTER (b.beat % 4 = 0) AS downbeat FROM cand0 c LEFT JOIN beats b ON b.piece_id = c.piece_id GROUP BY 1, 2),
cand AS (SELECT c.*, beat, downbeat, (CASE WHEN kept <= {_TARGET} THEN ({_TARGET} - kept) * 2.0::DOUBLE ELSE (kept - {_TARGET}) * 3.0::DOUBLE END) + (CASE WHEN gap IS NULL THEN -0.5::DOUBLE WHEN gap >= {_GAP} THEN 0 WHEN gap >= 0 THEN ({_GAP} - gap) * 80.0::DOUBLE ELSE ({_GAP} + abs(gap)) * 160.0::DOUBLE END) + coalesce(downbeat, 0) * 8.0::DOUBLE + coalesce(beat, 0) * 1.5::DOUBLE AS score FROM cand0 c JOIN dist USING (piece_id, grp)),
best AS (SELECT * FROM (SELECT *, max(CASE WHEN kept <= {_TARGET} THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id) AS fits FROM cand) WHERE fits = 0 OR kept <= {_TARGET} QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY score, abs(kept - {_TARGET}), kept DESC) = 1)"""


def _chords(spark, sf_dir) -> DataFrame:
    return cut.chords(bind.notes(spark, sf_dir), _TOL)


def _beats(spark, sf_dir) -> DataFrame:
    """Drum hits stand for beats; every fourth is a downbeat."""
    d = bind.notes_all(spark, sf_dir).filter("is_drum")
    return d.select("piece_id", F.col("onset").alias("t"), (F.row_number().over(W.partitionBy("piece_id").orderBy("onset", "note_ix")) - 1).alias("beat"))


def _candidates(spark, sf_dir) -> DataFrame:
    return cut.candidates(cut.groups(_chords(spark, sf_dir)), _beats(spark, sf_dir), _TARGET, _GAP)


@query(f"WITH {_CHORDS} SELECT piece_id, grp, round(onset, 6) AS onset, round(fin, 6) AS fin, n FROM grps")
def chord_groups(spark, sf_dir):
    return cut.groups(_chords(spark, sf_dir)).select("piece_id", "grp", _r("onset").alias("onset"), _r("end").alias("fin"), "n")


@query(f"WITH {_CHORDS} SELECT piece_id, grp, kept, round(coalesce(gap, -999), 6) AS gap, round(score, 5) AS score FROM cand")
def cut_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("piece_id", "grp", "kept", _r(F.coalesce("gap", F.lit(-999.0))).alias("gap"), _r("score", 5).alias("score"))


@query(f"WITH {_CHORDS} SELECT piece_id, grp, round(coalesce(beat, -1), 6) AS beat, round(coalesce(downbeat, -1), 6) AS downbeat FROM dist")
def nearest_beat(spark, sf_dir):
    return _candidates(spark, sf_dir).select("piece_id", "grp", _r(F.coalesce("beat", F.lit(-1.0))).alias("beat"), _r(F.coalesce("downbeat", F.lit(-1.0))).alias("downbeat"))


@query(f"WITH {_CHORDS} SELECT piece_id, grp, kept, round(score, 5) AS score FROM best")
def best_cut(spark, sf_dir):
    return cut.best(_candidates(spark, sf_dir), _TARGET).select("piece_id", "grp", "kept", _r("score", 5).alias("score"))


@query(f"WITH {_CHORDS} SELECT c.piece_id, c.note_ix FROM chord c JOIN best b ON b.piece_id = c.piece_id AND c.grp <= b.grp")
def kept_notes(spark, sf_dir):
    """The notes before the best cut (a semi-join on piece and note)."""
    chorded = keep(_chords(spark, sf_dir), "chords")
    chosen = cut.best(cut.candidates(cut.groups(chorded), _beats(spark, sf_dir), _TARGET, _GAP), _TARGET).select("piece_id", F.col("grp").alias("last"))
    kept = chorded.join(chosen, "piece_id").filter("grp <= last").select("piece_id", "note_ix")
    return bind.notes(spark, sf_dir).join(kept, ["piece_id", "note_ix"], "left_semi").select("piece_id", "note_ix")


_RANGES = [(0, 99, "a"), (50, 149, "b"), (150, 399, "c"), (400, 699, "d"), (650, 650, "e"), (800, 100000000, "f")]


@query(f"WITH r(lo, hi, chunk) AS (VALUES {', '.join(map(str, _RANGES))}), m AS (SELECT doc_id - 3 AS index FROM documents) SELECT m.index, coalesce(arg_min(r.chunk, struct_pack(a := lo, b := hi)), 'none') AS chunk FROM m LEFT JOIN r ON m.index BETWEEN lo AND hi AND m.index >= 0 GROUP BY m.index")
def chunk_of_index(spark, sf_dir):
    """Each member's chunk by inclusive ranges, the lowest range winning (a broadcast range join over a table of fixed size)."""
    r = spark.createDataFrame(_RANGES, "lo long, hi long, chunk string")
    m = bind.members(spark, sf_dir).select((F.col("index") - 3).alias("index"))
    j = m.join(F.broadcast(r), F.col("index").between(F.col("lo"), F.col("hi")) & (F.col("index") >= 0), "left")
    return j.groupBy("index").agg(F.coalesce(F.min_by("chunk", F.struct("lo", "hi")), F.lit("none")).alias("chunk"))


@query("WITH c AS (SELECT doc_id, unnest(['a/' || doc_id, 'b/' || doc_id, 'c/' || doc_id]) AS path, unnest([0, 1, 2]) AS place FROM documents), f AS (SELECT (CASE WHEN page_id % 2 = 0 THEN 'b/' ELSE 'c/' END) || page_id AS path FROM pages UNION ALL SELECT 'a/' || doc_id FROM labels WHERE doc_id % 5 = 0) SELECT doc_id, arg_min(c.path, place) AS path FROM c WHERE path IN (SELECT path FROM f) GROUP BY doc_id")
def first_existing_path(spark, sf_dir):
    """The first of a row's candidate paths that the listing holds."""
    d = bind.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*[F.concat(F.lit(p), F.col("doc_id").cast("string")) for p in ("a/", "b/", "c/")])).alias("place", "path"))
    listing = bind.table(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "b/").otherwise("c/"), F.col("page_id").cast("string")).alias("path"))
    listing = listing.unionByName(bind.table(spark, sf_dir, "labels").filter("doc_id % 5 = 0").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path")))
    return d.join(listing, "path", "left_semi").groupBy("doc_id").agg(F.min_by("path", "place").alias("path"))


#: Ids of the base tokens, merges of one-pass mining (up to the usual vocabulary of 30,000), merges of iterative training.
_BASE, _FAST, _SLOW = 374, 30_000 - 374, 2_000
_PAIRS = S.TOKENS + ", pr AS (SELECT tok AS lhs, lead(tok) OVER (PARTITION BY piece_id ORDER BY pos) AS rhs, {'p': piece_id, 'q': pos} AS place FROM tokens), cn AS (SELECT lhs, rhs, count(*) AS freq, min(place) AS first FROM pr WHERE rhs IS NOT NULL GROUP BY 1, 2)"
_MERGES = f"{_PAIRS}, mg AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY freq DESC, first) - 1 AS INTEGER) AS rank, lhs, rhs, freq FROM cn WHERE freq >= 2 QUALIFY row_number() OVER (ORDER BY freq DESC, first) <= {_FAST})"
_PASSED = f"""{_MERGES}, nx AS (SELECT piece_id, pos, tok, onset, onset + duration AS fin, lead(tok) OVER w AS rhs, lead(onset + duration) OVER w AS next_fin FROM tokens WINDOW w AS (PARTITION BY piece_id ORDER BY pos)),
hm AS (SELECT nx.*, {_BASE} + mg.rank AS new_id FROM nx LEFT JOIN mg ON mg.lhs = nx.tok AND mg.rhs = nx.rhs),
st AS (SELECT *, pos - 1 - coalesce(max(CASE WHEN new_id IS NULL THEN pos END) OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM hm),
ps AS (SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY pos) - 1 AS INTEGER) AS place, CAST(coalesce(new_id, tok) AS INTEGER) AS new, onset, CASE WHEN new_id IS NULL THEN fin ELSE next_fin END AS fin FROM st WHERE before % 2 = 0)"""


def _body(spark, sf_dir) -> DataFrame:
    return tokens.body(bind.notes(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT lhs, rhs, freq, first.p AS first_piece, first.q AS first_pos FROM cn")
def pair_counts(spark, sf_dir):
    return pairs.counts(_body(spark, sf_dir)).select("lhs", "rhs", "freq", F.col("first.piece_id").alias("first_piece"), F.col("first.pos").alias("first_pos"))


@query(f"WITH {_MERGES} SELECT rank, lhs, rhs, freq, rank + {_BASE} AS new_id FROM mg")
def bpe_fast_merges(spark, sf_dir):
    """All merges up to the usual vocabulary, mined in one pass."""
    return pairs.top(_body(spark, sf_dir), _FAST, _BASE)


def _fast(spark, sf_dir) -> DataFrame:
    """(piece_id, pos, tok, first, last) of the sequences after one greedy pass with the merges of one pass of mining."""
    body = _body(spark, sf_dir)
    return pairs.merge_pass(body, keep(pairs.top(body, _FAST, _BASE), "merges"))


@query(f"WITH {_PASSED} SELECT piece_id, place AS pos, new AS tok FROM ps")
def bpe_apply_fast(spark, sf_dir):
    return _fast(spark, sf_dir).select("piece_id", "pos", "tok")


@query(f"WITH {_PASSED} SELECT piece_id, place AS pos, new AS tok, round(onset, 6) AS onset, round(greatest(1e-4::DOUBLE, fin - onset), 6) AS duration FROM ps")
def bpe_group_times(spark, sf_dir):
    """Onset of a merged token's first part; duration to the end of its last."""
    body = _body(spark, sf_dir)
    end = F.col("onset") + F.col("duration")
    times = body.select("piece_id", F.col("pos").alias("first"), F.col("onset").alias("start"), end.alias("fin"), F.lead(end).over(W.partitionBy("piece_id").orderBy("pos")).alias("next_fin"))
    j = _fast(spark, sf_dir).join(times, ["piece_id", "first"])
    fin = F.when(F.col("last") > F.col("first"), F.col("next_fin")).otherwise(F.col("fin"))
    return j.select("piece_id", "pos", "tok", _r("start").alias("onset"), _r(F.greatest(F.lit(1e-4), fin - F.col("start"))).alias("duration"))


@query()
def bpe_iterative(spark, sf_dir):
    """Counting and merging in turn, up to a stated number of merges."""
    merges, _ = pairs.train_iterative(_body(spark, sf_dir), _SLOW, _BASE)
    return spark.createDataFrame(merges, "rank int, lhs int, rhs int, freq long")


@query()
def bpe_apply_ranked(spark, sf_dir):
    """Those merges applied by rank, leftmost first."""
    body = _body(spark, sf_dir)
    merges, _ = pairs.train_iterative(body, _SLOW, _BASE)
    return pairs.apply_ranked(body, [(a, b, _BASE + r) for r, a, b, _ in merges])


_REMI = f"""{S.NOTES},
rn AS (SELECT *, CAST(round_even(round_even(greatest(0.0, onset) * 440, 0) / 55, 0) * 55 AS BIGINT) AS tick FROM notes),
ev AS (SELECT piece_id, tick, 20 AS ord, pitch AS a, CAST(velocity // 4 AS INTEGER) AS b, CAST(least(greatest(round_even(greatest(1e-4::DOUBLE, duration) * 440 / 55, 0), 1), 64) AS INTEGER) AS c FROM rn WHERE NOT is_drum
  UNION ALL SELECT piece_id, tick, 30, CASE WHEN velocity >= 64 THEN 1 ELSE 0 END, 0, 0 FROM rn WHERE is_drum UNION ALL SELECT DISTINCT piece_id, 0, 10, 27, 0, 0 FROM rn),
en AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY tick, ord, a, b, c) AS n, tick // 880 AS bar FROM ev),
el AS (SELECT *, bar - coalesce(lag(bar) OVER w, -1) AS bars, (tick - coalesce(lag(tick) OVER w, 0)) // 55 AS gap FROM en WINDOW w AS (PARTITION BY piece_id ORDER BY n)),
eg AS (SELECT *, CAST(greatest(0, ceil((gap - 64) / 64)) AS BIGINT) AS lng FROM el),
tk AS (SELECT piece_id, n, list_concat(list_concat(list_transform(range(bars), lambda i: 3), list_transform(range(lng), lambda i: 307)), list_concat(CASE WHEN gap - lng * 64 > 0 THEN [243 + gap - lng * 64] ELSE [] END,
 list_concat([4 + (tick - bar * 880) // 55], CASE ord WHEN 10 THEN [308 + a] WHEN 30 THEN [CASE WHEN a = 1 THEN 372 ELSE 373 END] ELSE [20 + a, 148 + b, 179 + c] END))) AS parts FROM eg),
rows_ AS (SELECT piece_id, n, unnest(parts) AS tok, generate_subscripts(parts, 1) AS k FROM tk UNION ALL SELECT DISTINCT piece_id, 0, 1, 0 FROM ev UNION ALL SELECT piece_id, count(*) + 1, 2, 0 FROM ev GROUP BY piece_id),
remi AS (SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY n, k) - 1 AS INTEGER) AS pos, CAST(tok AS INTEGER) AS tok FROM rows_)"""


def _remi(spark, sf_dir) -> DataFrame:
    return remi.encode(remi.events(bind.notes(spark, sf_dir)))


@query(
    f"""WITH {_REMI}, f(ord, name, n, base) AS (VALUES (0, 'PAD', 0, 0), (1, 'BOS', 0, 0), (2, 'EOS', 0, 0), (3, 'BAR', 0, 0), (4, 'POSITION_', 16, 0), (20, 'NOTE_ON_', 128, 0), (148, 'VELOCITY_', 32, 0), (180, 'DURATION_', 64, 1), (244, 'TIME_SHIFT_', 64, 1), (308, 'TEMPO_', 64, 0), (372, 'PEDAL_ON', 0, 0), (373, 'PEDAL_OFF', 0, 0)),
    b AS (SELECT CAST(ord + i AS INTEGER) AS id, CASE WHEN n = 0 THEN name ELSE name || (i + base) END AS name FROM f, range(64 * 2) r(i) WHERE i < greatest(n, 1)), u AS (SELECT tok AS id, count(*) AS n FROM remi GROUP BY tok)
    SELECT id, name, coalesce(n, 0) AS uses FROM b LEFT JOIN u USING (id)"""
)
def remi_vocabulary(spark, sf_dir):
    """The 374 base names, and how often the encoded pieces use each."""
    families = [("PAD", 0, 0, 0), ("BOS", 1, 0, 0), ("EOS", 2, 0, 0), ("BAR", 3, 0, 0), ("POSITION_", 4, 16, 0), ("NOTE_ON_", 20, 128, 0), ("VELOCITY_", 148, 32, 0), ("DURATION_", 180, 64, 1), ("TIME_SHIFT_", 244, 64, 1), ("TEMPO_", 308, 64, 0), ("PEDAL_ON", 372, 0, 0), ("PEDAL_OFF", 373, 0, 0)]
    f = spark.createDataFrame(families, "name string, first int, n int, base int")
    rows = f.select("name", "first", "n", "base", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("i"))
    names = rows.select((F.col("first") + F.col("i")).alias("id"), F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", (F.col("i") + F.col("base")).cast("string"))).alias("name"))
    uses = _remi(spark, sf_dir).groupBy(F.col("tok").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    return names.join(uses, "id", "left").select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(f"WITH {_REMI} SELECT piece_id, pos, tok FROM remi")
def remi_encode(spark, sf_dir):
    return _remi(spark, sf_dir)


@query(
    f"""WITH {_REMI}, d AS (SELECT *, sum(CASE WHEN tok = 3 THEN 1 ELSE 0 END) OVER w - 1 AS bar, last_value(CASE WHEN tok BETWEEN 4 AND 19 THEN tok - 4 END IGNORE NULLS) OVER w AS position, last_value(CASE WHEN tok BETWEEN 20 AND 147 THEN tok - 20 END IGNORE NULLS) OVER w AS pitch, last_value(CASE WHEN tok BETWEEN 148 AND 179 THEN tok - 148 END IGNORE NULLS) OVER w AS bin FROM remi WINDOW w AS (PARTITION BY piece_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT piece_id, pos, CAST(greatest(0, bar) * 2.0 + position * 0.125 AS DOUBLE) AS onset, CAST(pitch AS INTEGER) AS pitch, CAST(bin * 4 + 2 AS INTEGER) AS velocity, CAST((tok - 179) * 0.125 AS DOUBLE) AS duration FROM d WHERE tok BETWEEN 180 AND 243"""
)
def remi_decode(spark, sf_dir):
    return remi.decode(_remi(spark, sf_dir)).select("piece_id", "pos", "onset", "pitch", "velocity", "duration")
