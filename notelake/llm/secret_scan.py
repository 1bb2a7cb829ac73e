"""Secret spans, in DataFrame functions only.

Three base kinds are found by their patterns (assignments to names of secrets,
access keys, runs of hexadecimal digits). Beside them, any run of ``LEAST`` or more
characters that key material is written in is judged by two Markov models of its
characters, one of random strings and one of ordinary identifiers: the sum of the
log-likelihood ratios of its transitions must come to ``THRESHOLD``. The models are
counted from labelled samples (:func:`train`); their table of ratios, at most
67 x 67 numbers, is a literal of the plan, in hundredths of a nat as whole numbers,
so a score doesn't depend on the order of a sum.

Texts are cut at marked matches and nothing is shuffled, as in the scan for
personal data; patterns stay linear on long texts.

Defined results: null and empty texts have no spans; positions are code points,
end exclusive; ties in start go by the order of ``KINDS``; a random run that is
exactly a hexadecimal run or an access key isn't named twice; every row is judged,
whether or not its id repeats or is null; an empty table has no rows, and no
documents at all leave a model of random strings only, which finds no span; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text, keep
from notelake.llm.pii import cut_at, proposals, starts_of, unmarked

#: Kinds in order, what proposes each, and the fewest characters of what counts.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
NAMES = "password|passwd|secret|token|api_?key"
PATTERNS = {
    "assign": rf"(?i:{NAMES})[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
VALUE = rf"^(?i:{NAMES})[\"']?\x20*[:=]\x20*[\"']?"
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}
#: A random run that is a base span already.
TWICE = r"^(?:[0-9a-f]{16,}|AKIA[A-Z0-9]{14,})$"
#: The characters of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(ALPHABET) + 1
#: What each transition is counted on top of what was seen, and the hundredths of a nat that a run needs (random strings are about one in e^10).
SMOOTHING, UNIT, THRESHOLD = 0.5, 100, 1000
#: Labelled samples: random strings of each alphabet, and documents from which ordinary identifiers are taken.
RANDOM, ORDINARY = 2_000, 500
#: Words that names in programs, paths and settings are made of.
WORDS = (
    "account", "action", "active", "address", "api", "app", "archive", "array", "asset", "auth", "base", "batch", "block", "body", "buffer", "build", "button", "cache", "call",
    "case", "category", "change", "channel", "check", "class", "client", "code", "column", "com", "comment", "config", "connection", "constant", "content", "context", "controller", "count", "create",
    "current", "data", "date", "default", "delete", "description", "device", "document", "download", "element", "email", "error", "event", "example", "factory", "field", "file", "filter", "find", "first",
    "folder", "form", "format", "function", "get", "group", "handler", "header", "height", "home", "http", "image", "index", "info", "input", "instance", "interface", "item", "key",
    "language", "last", "length", "level", "library", "limit", "line", "link", "list", "local", "location", "login", "main", "manager", "map", "menu", "message", "method", "mode", "model", "module", "name",
    "network", "new", "node", "number", "object", "option", "order", "output", "package", "page", "parameter", "parent", "path", "player", "point", "port", "position",
    "post", "price", "process", "product", "profile", "project", "property", "provider", "public", "query", "read", "record", "request", "resource", "response", "result", "return",
    "search", "select", "server", "service", "session", "set", "size", "sort", "source", "start", "state", "status", "step", "stop", "store", "stream", "string", "style", "system", "table",
    "target", "task", "template", "test", "text", "time", "title", "total", "type", "update", "upload", "user", "value", "version", "video", "view", "web", "width", "window",
    "write",
)
#: Longest run in a document that counts as ordinary: shorter than any span.
SHORT = 15


def random_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """(text): digests of the numbers below ``n`` as hexadecimal digits, in base64, and in capitals and digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    based = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    return spark.range(n).select(F.explode(F.array(F.left(digest, F.lit(40)), based, F.upper(F.regexp_replace(based, "[+/]", "")))).alias("text"))


def common_identifiers() -> list[str]:
    """Names and times as programs write them: the words in threes in each style, and stamps of two thousand hours."""
    threes = [(w, WORDS[(7 * i + 3) % len(WORDS)], WORDS[(11 * i + 5) % len(WORDS)]) for i, w in enumerate(WORDS)]
    names = [n for t in threes for n in ("_".join(t), "-".join(t), "/".join(t), "_".join(t).upper(), t[0] + t[1].title() + t[2].title(), "".join(x.title() for x in t))]
    first = datetime(2000, 1, 1)
    stamps = [(first + timedelta(hours=37 * h, minutes=7 * h, seconds=11 * h)).strftime(("%Y-%m-%dT%H-%M-%S", "%Y/%m/%d/%H-%M", "%Y%m%d_%H%M%S", "%d-%m-%Y-%H%M")[h % 4]) for h in range(2000)]
    return names + stamps


def ordinary_identifiers(docs: DataFrame, most: int = ORDINARY) -> DataFrame:
    """(text): the short runs of at most ``most`` documents, and neighbours joined as identifiers are (snake, camel, kebab, path)."""
    text = id_and_text(docs).withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # a table of its own: each task then keeps ``most`` rows and nothing is sorted as a whole
    some = keep(text.orderBy("digest", "doc_id", "text").limit(most), "ordinary")
    runs = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]+"), F.lit(0)), lambda x: F.char_length(x).between(2, SHORT))
    some = some.select(runs.alias("runs")).select("runs", F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))).alias("after"))
    pairs = F.slice(F.arrays_zip("runs", "after"), 1, F.size("after"))

    def joined(p, i):
        camel = F.concat(p["runs"], F.upper(F.left(p["after"], F.lit(1))), F.substring(p["after"], 2, SHORT))
        glue = lambda mark: F.concat(p["runs"], F.lit(mark), p["after"])
        return F.when(i % 4 == 0, glue("_")).when(i % 4 == 1, camel).when(i % 4 == 2, glue("-")).otherwise(glue("/"))

    return some.select(F.explode(F.concat("runs", F.transform(pairs, joined))).alias("text"))


def train(samples: DataFrame) -> list[int]:
    """The table of ratios from (text, random): row by character before (0: none), column by character; column 0 is zero.

    The transitions are counted on Spark; two counts for each come to the driver.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("text")), lambda i: F.substring(F.concat(F.lit(" "), "text"), i, F.lit(2)))
    counted = samples.filter("text <> ''").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    return ratios((r.random, r.pair, r.n) for r in counted.filter(F.col("pair").rlike(r"^[ A-Za-z0-9+/_-][A-Za-z0-9+/_-]$")).collect())


def ratios(counts: Iterable[tuple[bool, str, int]]) -> list[int]:
    seen = {True: [[0] * STATES for _ in range(STATES)], False: [[0] * STATES for _ in range(STATES)]}
    for random, pair, n in counts:
        seen[random][ALPHABET.find(pair[0]) + 1][ALPHABET.find(pair[1]) + 1] += n
    logs = {
        side: [[math.log((n + SMOOTHING) / (sum(row) + SMOOTHING * len(ALPHABET))) for n in row] for row in rows]
        for side, rows in seen.items()
    }
    return [math.floor(UNIT * (logs[True][a][b] - logs[False][a][b]) + 0.5) if b else 0 for a in range(STATES) for b in range(STATES)]


def score(run: Column, table: list[int]) -> Column:
    """Hundredths of a nat by which a run of characters is likelier random than ordinary; a character outside the alphabet starts anew."""
    known = F.expr(f"array({','.join(map(str, table))})")
    begin = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(s, c):
        here = F.instr(F.lit(ALPHABET), c)
        return F.struct(here.alias("last"), (s["sum"] + F.get(known, s["last"] * STATES + here)).alias("sum"))

    return F.aggregate(F.filter(F.split(run, ""), lambda c: c != ""), begin, step, lambda s: s["sum"])


def _confirmed(kind: str, found: Column, table: list[int]) -> Column:
    """Structs (start, order, end, kind, score) of the proposals that stay."""
    value = lambda m: F.regexp_replace(m, VALUE, "") if kind == "assign" else m
    kept = F.filter(found, lambda p: F.char_length(value(p["match"])) >= LEAST[kind])
    if kind == "random":
        kept = F.filter(kept, lambda p: p["match"].rlike("[A-Za-z]") & ~p["match"].rlike(TWICE))
    spans = F.transform(
        kept,
        lambda p: F.struct(
            p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), (p["start"] + F.char_length(p["match"])).alias("end"), F.lit(kind).alias("kind"), score(value(p["match"]), table).alias("score"),
        ),
    )
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(spans, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:bigint>>"))


def find_spans(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): an array of (start, order, end, kind, score) of each text, by start and kind."""
    text = id_and_text(docs, id_col, text_col).select("doc_id", unmarked(F.col("text")).alias("text"))
    cut = text.select("doc_id", *[cut_at(F.col("text"), PATTERNS[k]).alias(f"cut_{k}") for k in KINDS])
    cut = cut.select("*", *[F.when(F.size(f"cut_{k}") > 1, starts_of(F.col(f"cut_{k}"))).alias(f"starts_{k}") for k in KINDS])
    proposed = cut.select("doc_id", *[proposals(F.col(f"cut_{k}"), F.col(f"starts_{k}")).alias(f"at_{k}") for k in KINDS])
    return proposed.select("doc_id", F.array_sort(F.concat(*[_confirmed(k, F.col(f"at_{k}"), table) for k in KINDS])).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """:func:`find_spans` with models trained from digests, and from common names and the documents' own short runs."""
    label = lambda samples, random: samples.select("text", F.lit(random).alias("random"))
    spark = docs.sparkSession
    common = spark.createDataFrame([(name,) for name in common_identifiers()], "text string")
    ordinary = ordinary_identifiers(docs).unionByName(common)
    return find_spans(docs, train(label(random_strings(spark), True).unionByName(label(ordinary, False))))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, and the scored spans, from what :func:`find_spans` returns."""
    joined = lambda spans, *fields: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, spans = F.filter("found", lambda s: s["order"] < len(BASE)), F.col("found")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(base, "kind", "start", "end"), 256).alias("base_sha256"),
        joined(spans, "kind", "start", "end").alias("spans"), joined(spans, "kind", "start", "end", "score").alias("scored_spans"),
    )
