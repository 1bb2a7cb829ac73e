"""Queries over logits: losses, accuracies, sampling filters, similarity and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.operators import features, manifest
from notelake.operators import scoring as X
from notelake.plans.pieces import _r
from notelake.plans.registry import query
from notelake.sources import bind

_LG = """lg AS (SELECT vec_id, vec_id // 64 AS batch, vec_id % 64 AS pos, label AS target, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS cls FROM embeddings)"""
_MK = (
    _LG
    + """, ok AS (SELECT *, cls BETWEEN (pos + 1) % 4 * 16 AND (pos + 1) % 4 * 16 + 15 AS allowed FROM lg),
mk AS (SELECT * FROM ok WHERE allowed OR cls = target),
ls AS (SELECT vec_id, any_value(batch) AS batch, any_value(pos) AS pos, any_value(target) AS target, ln(sum(exp(x))) AS z, max(x) FILTER (cls = target) AS xt, avg(x) AS mean_x, bool_or(NOT allowed) AS rescued, arg_min(cls, struct_pack(a := -x, b := cls)) AS best FROM mk GROUP BY vec_id)"""
)


def _masked(spark, sf_dir) -> DataFrame:
    s = bind.scores(spark, sf_dir)
    return s.withColumn("m", X.masked(F.col("logits"), F.col("pos"), F.col("target")))


@query(f"WITH {_MK} SELECT vec_id, round(z - xt, 6) AS nll, rescued FROM ls")
def masked_ce(spark, sf_dir):
    """Cross entropy under the slot mask; the target's logit is kept (and counted) where the mask bars it."""
    m = _masked(spark, sf_dir)
    return m.select("vec_id", _r(X.nll(F.col("m"), F.col("target"))).alias("nll"), (~X.allowed(F.col("pos"), F.col("target"))).alias("rescued"))


@query(f"WITH {_MK} SELECT round(avg(z - xt) FILTER (pos < 63), 6) AS loss, count(*) FILTER (pos < 63) AS valid, count(*) FILTER (pos < 63 AND rescued) AS rescued, round(exp(least(20, avg(z - xt) FILTER (pos < 63))), 5) AS perplexity FROM ls")
def masked_ce_mean(spark, sf_dir):
    """Token-weighted loss over valid targets (the last position of a batch is masked), and its perplexity."""
    m = _masked(spark, sf_dir).withColumn("valid", F.col("pos") < 63)
    rows = m.select("valid", X.nll(F.col("m"), F.col("target")).alias("nll"), (~X.allowed(F.col("pos"), F.col("target"))).alias("rescued"))
    g = rows.agg(F.avg(F.when(F.col("valid"), F.col("nll"))).alias("loss"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("rescued")).alias("rescued"))
    return g.select(_r("loss").alias("loss"), "valid", "rescued", _r(F.exp(F.least(F.lit(20.0), F.col("loss"))), 5).alias("perplexity"))


@query(f"WITH {_MK} SELECT vec_id, round(0.9 * (z - xt) + 0.1 * (z - mean_x), 6) AS loss FROM ls")
def smoothed_ce(spark, sf_dir):
    return _masked(spark, sf_dir).select("vec_id", _r(X.smoothed(F.col("m"), F.col("target"), 0.1)).alias("loss"))


@query(f"WITH {_MK} SELECT batch, round(avg(CASE WHEN best = target THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM ls GROUP BY batch")
def token_accuracy(spark, sf_dir):
    m = _masked(spark, sf_dir)
    hit = (X.argmax(F.col("m")) == F.col("target")).cast("double")
    return m.groupBy(F.col("batch").cast("long").alias("batch")).agg(_r(F.avg(hit)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MK}, b AS (SELECT batch, avg(CASE WHEN best = target THEN 1.0 ELSE 0 END) AS a FROM ls GROUP BY batch) SELECT round(avg(a), 6) AS mean_of_batches, (SELECT round(avg(CASE WHEN best = target THEN 1.0 ELSE 0 END), 6) FROM ls) AS over_tokens FROM b")
def accuracy_means(spark, sf_dir):
    """The two averages that are easily confused: of batch means, and over tokens."""
    m = _masked(spark, sf_dir).select("batch", (X.argmax(F.col("m")) == F.col("target")).cast("double").alias("hit"))
    b = m.groupBy("batch").agg(F.avg("hit").alias("a"), F.sum("hit").alias("s"), F.count(F.lit(1)).alias("n"))
    return b.agg(_r(F.avg("a")).alias("mean_of_batches"), _r(F.sum("s") / F.sum("n")).alias("over_tokens"))


@query(f"WITH {_MK} SELECT (pos + 1) % 4 AS slot, round(avg(CASE WHEN best = target THEN 1.0 ELSE 0 END), 6) AS accuracy FROM ls GROUP BY 1")
def slot_accuracy(spark, sf_dir):
    m = _masked(spark, sf_dir)
    return m.groupBy(((F.col("pos") + 1) % 4).cast("long").alias("slot")).agg(_r(F.avg((X.argmax(F.col("m")) == F.col("target")).cast("double"))).alias("accuracy"))


_PEN = _LG + ", pen AS (SELECT *, CASE WHEN cls IN (vec_id * 7 % 64, vec_id * 13 % 64, target) THEN CASE WHEN x < 0 THEN x * 1.3::DOUBLE ELSE x / 1.3::DOUBLE END ELSE x END AS y FROM lg)"


def _penalised(spark, sf_dir) -> DataFrame:
    s = bind.scores(spark, sf_dir)
    recent = F.array((F.col("vec_id") * 7 % 64).cast("int"), (F.col("vec_id") * 13 % 64).cast("int"), F.col("target").cast("int"))
    return s.withColumn("y", X.let(recent, lambda r: X.penalised(F.col("logits"), r, 1.3)))


@query(f"WITH {_PEN} SELECT vec_id, round(sum(y), 6) AS total, round(max(y), 6) AS largest FROM pen GROUP BY vec_id")
def repetition_penalty(spark, sf_dir):
    return _penalised(spark, sf_dir).select("vec_id", _r(X.total(F.col("y"))).alias("total"), _r(F.array_max("y")).alias("largest"))


def _filtered(source: str, column: str) -> str:
    """CTEs of the filter at temperature 0.1, k = 20, p = 0.9, three at least."""
    return f"""tz AS (SELECT vec_id, cls, {column} / 0.1::DOUBLE AS x FROM {source}), zz AS (SELECT vec_id, max(x) + ln(sum(exp(x - m))) AS z FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM tz) GROUP BY vec_id),
    rk AS (SELECT vec_id, cls, x, exp(x - z) AS p, row_number() OVER w - 1 AS rank, sum(exp(x - z)) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM tz JOIN zz USING (vec_id) WINDOW w AS (PARTITION BY vec_id ORDER BY x DESC, cls)),
    cand AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS q, count(*) OVER (PARTITION BY vec_id) AS n, max(p) OVER (PARTITION BY vec_id) AS raw_top FROM rk WHERE rank < 20 AND (cum <= 0.9 OR rank < 3))"""


_TEMPERATURE, _K, _P, _LEAST, _CAP = 0.1, 20, 0.9, 3, 0.5


def _candidates(df: DataFrame, column: str) -> DataFrame:
    rows = df.select("vec_id", F.transform(column, lambda x: x / F.lit(_TEMPERATURE)).alias("t"))
    rows = rows.select("vec_id", X.candidates(F.col("t"), _K, _P, _LEAST).alias("c"))
    return rows.select("vec_id", "c", X.renormalised(F.col("c")).alias("q"))


@query(f"WITH {_LG}, {_filtered('lg', 'x')} SELECT vec_id, count(*) AS candidates, round(max(q), 6) AS top1 FROM cand GROUP BY vec_id")
def nucleus_filter(spark, sf_dir):
    c = _candidates(bind.scores(spark, sf_dir), "logits")
    return c.select("vec_id", F.size("c").cast("long").alias("candidates"), _r(F.get("q", F.lit(0))["p"]).alias("top1"))


_CAPPED = """tops AS (SELECT *, max(q) OVER (PARTITION BY vec_id) AS top FROM cand),
al AS (SELECT *, CASE WHEN top > 0.5 AND n > 1 AND top > 1.0 / n + 1e-12 THEN least(1.0, greatest(0.0, (top - 0.5::DOUBLE) / greatest(top - 1.0::DOUBLE / n, 1e-12))) ELSE 0 END AS a FROM tops),
mixed AS (SELECT *, (1 - a) * q + a / n AS mq FROM al), capp AS (SELECT *, CASE WHEN a > 0 AND max(mq) OVER (PARTITION BY vec_id) > 0.5 + 1e-6 THEN 1.0::DOUBLE / n ELSE mq END AS f FROM mixed)"""


@query(f"WITH {_LG}, {_filtered('lg', 'x')}, {_CAPPED} SELECT vec_id, round(max(q), 6) AS before, round(max(f), 6) AS after FROM capp GROUP BY vec_id")
def cap_top1(spark, sf_dir):
    c = _candidates(bind.scores(spark, sf_dir), "logits").select("vec_id", "q", X.capped(F.col("q"), _CAP).alias("f"))
    top = lambda a: _r(F.array_max(F.transform(a, lambda r: r["p"])))
    return c.select("vec_id", top("q").alias("before"), top("f").alias("after"))


@query(f"WITH {_PEN}, {_filtered('pen', 'y')}, {_CAPPED} SELECT vec_id, round(max(raw_top), 6) AS raw_top1, round(max(f), 6) AS final_top1, count(*) AS candidates FROM capp GROUP BY vec_id")
def sampling_distribution(spark, sf_dir):
    """Penalty, temperature, top-k and nucleus, cap: the distribution's diagnostics."""
    c = _candidates(_penalised(spark, sf_dir), "y").select("vec_id", "c", X.capped(F.col("q"), _CAP).alias("f"))
    top = lambda a: _r(F.array_max(F.transform(a, lambda r: r["p"])))
    return c.select("vec_id", top("c").alias("raw_top1"), top("f").alias("final_top1"), F.size("c").cast("long").alias("candidates"))


_U = "('0x' || substr(md5('5:' || vec_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query(f"WITH {_LG}, {_filtered('lg', 'x')}, cu AS (SELECT vec_id, cls, sum(q) OVER (PARTITION BY vec_id ORDER BY cls ROWS UNBOUNDED PRECEDING) AS cum FROM cand) SELECT vec_id, CAST(coalesce(min(cls) FILTER (cum > {_U}), max(cls)) AS INTEGER) AS drawn FROM cu GROUP BY vec_id")
def multinomial_draw(spark, sf_dir):
    """One class a row, drawn with a hashed uniform number."""
    c = _candidates(bind.scores(spark, sf_dir), "logits")
    u = F.conv(F.substring(manifest.hash_order("vec_id", 5), 1, 12), 16, 10).cast("long") / F.lit(281474976710656.0)
    return c.select("vec_id", X.let(u, lambda v: X.draw(F.col("q"), v)).alias("drawn"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    s = bind.scores(spark, sf_dir)
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logits").alias("other"))
    return s.join(b, "vec_id").select("vec_id", _r(features.cosine(F.col("logits"), F.col("other"))).alias("cosine"))


@query("WITH s AS (SELECT vec_id // 64 AS batch, vec_id % 64 AS pos, CASE WHEN vec_id % 5 = 0 THEN 0.5::DOUBLE ELSE round(list_max(embedding)::DOUBLE, 9) END AS score FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, pos) AS rank FROM s) SELECT batch, pos, row_number() OVER (PARTITION BY batch ORDER BY pos) AS place FROM t WHERE rank <= 8")
def memory_topk(spark, sf_dir):
    """The eight best candidates of a batch, by their largest value (those held already score 0.5), put back in order of position."""
    s = bind.scores(spark, sf_dir).select(F.col("batch").cast("long").alias("batch"), F.col("pos").cast("long").alias("pos"), F.when(F.col("vec_id") % 5 == 0, 0.5).otherwise(F.round(F.array_max("logits"), 9)).alias("score"))
    t = s.withColumn("rank", F.row_number().over(W.partitionBy("batch").orderBy(F.desc("score"), "pos"))).filter("rank <= 8")
    return t.select("batch", "pos", F.row_number().over(W.partitionBy("batch").orderBy("pos")).cast("long").alias("place"))


@query("SELECT vec_id // 64 AS batch, count(*) FILTER (vec_id % 64 < 63 AND label <> 3) AS valid FROM embeddings GROUP BY 1")
def valid_targets(spark, sf_dir):
    """Targets that count: neither ignored (label 3 here) nor at a boundary."""
    s = bind.scores(spark, sf_dir)
    return s.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count_if((F.col("pos") < 63) & (F.col("target") != 3)).alias("valid"))
