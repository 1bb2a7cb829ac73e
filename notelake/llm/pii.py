"""Personal data spans, in DataFrame functions only.

Per kind a regular expression proposes spans: matches are marked in the text,
the text is cut at the marks, and span positions are running sums of the pieces'
lengths, so no row leaves its task and nothing is shuffled. Validators confirm
proposals (Luhn for cards, mod-97 for IBANs, number ranges and digit counts) and
context words near a span move its score. The four base kinds stay whatever
their score; the added kinds (iban, ssn, secret) need ``THRESHOLD``.

The patterns stay linear on long texts: possessive repeats never give back, and
a match may start only where a run of its characters starts (or where the last
match ended), which loses no leftmost match.

Defined results: null and empty texts have no spans; positions are code points,
end exclusive; ties in start go by the order of ``KINDS``; every row is judged,
whether or not its id repeats or is null; an empty table has no rows; a very long
text costs in proportion to its length; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text

#: Length of an IBAN without blanks, and the countries that have it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: A country's own length first, so that what follows an IBAN isn't taken for a part of it; else whatever looks like one.
_IBAN = "|".join([*(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items()), r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"])
#: Kinds in order, and what proposes each.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_])",
}
#: A text without this has no match of the kind (a cheap test that saves the replacement).
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words that make a span of the kind likelier.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|contact|write to|mailto|courriel|correo)\b",
    "ip": r"(?i)\b(ip|address|host|server|login)\b",
    "card": r"(?i)\b(card|credit|visa|mastercard|amex|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|tel[eé]fono)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(ssn|social security|tax id)\b",
    "secret": r"(?i)\b(token|secret|password|passwd|api[_ -]?key|access[_ -]?key|credentials?)\b",
}
#: A word nearby that speaks for some other number.
AGAINST = r"(?i)\b(order|invoice|isbn|version|sku|tracking)\b"
#: Scores before context, what context adds or takes, and what an added kind needs.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.3}
FOR, FROM, THRESHOLD = 0.2, 0.3, 0.5
#: Characters before and after a span that count as nearby.
NEAR = 40
#: Pieces that one inner running sum takes (bounds the copying in a text with very many spans).
CHUNK = 512

_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"


def _scan(values: Column, start: Column) -> Column:
    """Exclusive running sums of a short array, from ``start`` on."""
    begin = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(values, begin, step, lambda s: s["out"])


def running_starts(values: Column) -> Column:
    """Exclusive running sums of an array of any length, in two levels."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(values, i + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v))
    parts = F.arrays_zip(chunks.alias("c"), _scan(totals, F.lit(0)).alias("s"))
    return F.flatten(F.transform(parts, lambda p: _scan(p["c"], p["s"])))


def unmarked(text: Column) -> Column:
    """The text with another character where it holds a mark of its own."""
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, _PLAIN * 2)).otherwise(text)


def cut_at(text: Column, pattern: str) -> Column:
    """The text cut before each match; a piece but the first starts with its match and a mark."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def _pieces(text: Column, kind: str) -> Column:
    """The text cut before each match, null where a cheap test says that there is none."""
    marked = cut_at(text, PATTERNS[kind])
    return F.when(F.contains(text, F.lit(NEEDS[kind])), marked) if kind in NEEDS else marked


def starts_of(pieces: Column) -> Column:
    """Where each piece of a text starts."""
    return running_starts(F.transform(pieces, lambda p, i: F.char_length(p) - F.when(i > 0, 1).otherwise(0)))


def proposals(pieces: Column, starts: Column) -> Column:
    """Structs (start, match, before, after) of columns of pieces and their starts.

    Whatever is not an element is an argument of the transform, never part of its
    lambda: what a lambda mentions is evaluated for every element.
    """
    others = F.size(pieces) - 1
    rows = F.arrays_zip(F.slice(pieces, 2, others).alias("own"), F.slice(pieces, 1, others).alias("last"), F.slice(starts, 2, others).alias("start"))
    each = F.transform(
        rows,
        lambda r: F.struct(
            r["start"].alias("start"),
            F.substring_index(r["own"], _CLOSE, 1).alias("match"),
            F.right(r["last"], F.lit(NEAR)).alias("before"),
            F.left(F.substring_index(r["own"], _CLOSE, -1), F.lit(NEAR)).alias("after"),
        ),
    )
    return F.when(F.size(pieces) > 1, each)


def mod97(iban: Column) -> Column:
    """True where an IBAN's check digits hold; letters count as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    digit = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda r, i: F.when(digit(i) >= 65, (r * 100 + digit(i) - 55) % 97).otherwise((r * 10 + digit(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _confirmed(kind: str, found: Column) -> Column:
    """Structs (start, order, end, kind, score) of the proposals that stay."""
    near = lambda p: F.concat_ws(" | ", p["before"], p["after"])
    score = lambda p: (
        F.lit(START[kind]) + F.when(near(p).rlike(CONTEXT[kind]), F.lit(FOR)).otherwise(F.lit(0.0)) - F.when(near(p).rlike(AGAINST), F.lit(FROM)).otherwise(F.lit(0.0))
    )
    spans = F.transform(
        F.filter(found, lambda p: _valid(kind, p["match"])),
        lambda p: F.struct(
            p["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("order"),
            (p["start"] + F.char_length(p["match"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.least(score(p), F.lit(1.0)), 2).alias("score"),
        ),
    )
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(spans, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): an array of (start, order, end, kind, score) of each text, by start and kind."""
    text = id_and_text(docs, id_col, text_col)
    text = text.select("doc_id", unmarked(F.col("text")).alias("text"))
    cut = text.select("doc_id", *[_pieces(F.col("text"), k).alias(f"cut_{k}") for k in KINDS])
    cut = cut.select("*", *[F.when(F.size(f"cut_{k}") > 1, starts_of(F.col(f"cut_{k}"))).alias(f"starts_{k}") for k in KINDS])
    proposed = cut.select("doc_id", *[proposals(F.col(f"cut_{k}"), F.col(f"starts_{k}")).alias(f"at_{k}") for k in KINDS])
    return proposed.select("doc_id", F.array_sort(F.concat(*[_confirmed(k, F.col(f"at_{k}")) for k in KINDS])).alias("found"))


def _joined(spans: Column, *fields: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, and the scored spans, from what :func:`find_spans` returns."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base, "kind", "start", "end"), 256).alias("base_sha256"),
        _joined(F.col("found"), "kind", "start", "end").alias("spans"), _joined(F.col("found"), "kind", "start", "end", "score").alias("scored_spans"),
    )


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every base match replaced by its kind in brackets (validators are not asked: masking errs on the safe side)."""
    masked = F.coalesce(F.col(text_col), F.lit(""))
    for kind in KINDS:
        masked = F.regexp_replace(masked, PATTERNS[kind], f"[{kind}]")
    return docs.withColumn(text_col, masked)
