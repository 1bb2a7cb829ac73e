"""Masked losses, accuracies and sampling filters over arrays of logits, within the row: nothing is exploded or shuffled.

A value that a lambda needs is bound with :func:`let`, because whatever a lambda
mentions is evaluated for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Four slots over 64 classes: first and last class that each slot allows.
SLOTS_64 = ((0, 15), (16, 31), (32, 47), (48, 63))
FILL = -1e4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))


def softmax(a: Column) -> Column:
    return let(log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def allowed(pos: Column, cls: Column, slots=SLOTS_64) -> Column:
    """True where the class may follow position ``pos`` (slot (pos + 1) % 4)."""
    out = F.lit(False)
    for k, (low, high) in enumerate(slots):
        out = F.when((pos + 1) % 4 == k, cls.between(low, high)).otherwise(out)
    return out


def masked(logits: Column, pos: Column, target: Column, slots=SLOTS_64) -> Column:
    """Logits with disallowed classes filled; the target's own is kept."""
    return F.transform(logits, lambda x, i: F.when(allowed(pos, i, slots) | (i == target), x).otherwise(FILL))


def nll(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, target)


def smoothed(logits: Column, target: Column, epsilon: float) -> Column:
    """(1 - e) nll + e times the mean over the classes that are not filled."""
    kept = F.filter(logits, lambda x: x > FILL)
    mean = let(log_sum_exp(logits), lambda z: z - total(kept) / F.size(kept))
    return (1 - epsilon) * nll(logits, target) + epsilon * mean


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def penalised(logits: Column, recent: Column, penalty: float) -> Column:
    """Logits of recent classes are divided by the penalty, or multiplied where negative."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(recent, i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x))


def ranked(logits: Column) -> Column:
    """Structs (rank, cls, logit, p, cum) by falling logit; ties go to the smaller class."""
    order = F.transform(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("key"), i.alias("cls")))), lambda s: F.struct(s["cls"].alias("cls"), (-s["key"]).alias("logit")))
    start = F.struct(F.lit(0.0).alias("cum"), F.array().cast("array<struct<rank:int,cls:int,logit:double,p:double,cum:double>>").alias("out"))

    def step(z):
        def push(s, e):
            p = F.exp(e["logit"] - z)
            row = F.struct(F.size(s["out"]).alias("rank"), e["cls"].alias("cls"), e["logit"].alias("logit"), p.alias("p"), (s["cum"] + p).alias("cum"))
            return F.struct((s["cum"] + p).alias("cum"), F.concat(s["out"], F.array(row)).alias("out"))

        return push

    return let(log_sum_exp(logits), lambda z: F.aggregate(order, start, step(z), lambda s: s["out"]))


def candidates(logits: Column, top_k: int, top_p: float, least: int) -> Column:
    """The ranked structs that pass top-k and nucleus; the class that crosses ``top_p`` is dropped, the first ``least`` stay."""
    return F.filter(ranked(logits), lambda r: (r["rank"] < max(top_k, least)) & ((r["cum"] <= top_p) | (r["rank"] < least)))


def renormalised(rows: Column) -> Column:
    """Structs (cls, p) whose p sum to one."""
    return let(total(F.transform(rows, lambda r: r["p"])), lambda s: F.transform(rows, lambda r: F.struct(r["cls"].alias("cls"), (r["p"] / s).alias("p"))))


def capped(rows: Column, cap: float) -> Column:
    """(cls, p) mixed with the uniform distribution until the largest p is the cap; alone or already even, it stays."""
    top, uniform = F.array_max(F.transform(rows, lambda r: r["p"])), 1.0 / F.size(rows)
    alpha = F.when((top > cap) & (F.size(rows) > 1) & (top > uniform + 1e-12), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top - cap) / F.greatest(top - uniform, F.lit(1e-12))))).otherwise(0.0)
    both = F.struct(alpha.alias("a"), uniform.cast("double").alias("u"))
    mixed = let(both, lambda b: F.transform(rows, lambda r: F.struct(r["cls"].alias("cls"), ((1 - b["a"]) * r["p"] + b["a"] * b["u"]).alias("p"))))
    over = F.array_max(F.transform(mixed, lambda r: r["p"])) > cap + 1e-6
    even = let(uniform.cast("double"), lambda u: F.transform(rows, lambda r: F.struct(r["cls"].alias("cls"), u.alias("p"))))
    return F.when((alpha > 0) & over, even).otherwise(mixed)


def draw(rows: Column, uniform: Column) -> Column:
    """The class at which the running sum of p, by class, first goes over the uniform number."""
    order = F.array_sort(rows)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("int").alias("cls"))
    push = lambda s, r: F.struct((s["cum"] + r["p"]).alias("cum"), F.when(s["cls"].isNull() & (s["cum"] + r["p"] > uniform), r["cls"]).otherwise(s["cls"]).alias("cls"))
    return F.aggregate(order, start, push, lambda s: F.coalesce(s["cls"], F.element_at(order, -1)["cls"]))
