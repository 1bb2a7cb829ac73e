"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case; whatever is no letter, digit or sentence mark
is a space, so comment marks vanish) and cut into sentences: at sentence marks
before white space, at blank lines, and where the first words of a known sentence
stand. Line ends within a paragraph don't cut, so wrapped texts are read as they
are meant. A sentence is looked up among known licence sentences, as a whole or,
if it is none, line by line; gaps stand for the holder's name and other parts that
vary. A sentence or line that isn't known may still name a licence ("released under
the MIT License, see ...", "MIT licensed", "license: MIT", an SPDX line, a title), but
not by denying it. The sequence of identifiers found, with a mark for what isn't known
between them, is matched against ordered licence rules, longest evidence first, and
no rule reaches over a mark: a text with a clause of its own isn't the licence; a matched part of the sequence is used up, so that a full licence text
isn't also reported as its short notice. Nothing is shuffled.

The known sentences and the rules are made from the texts in ``licence_table`` by
the same cut, so what is cut apart in a text is cut apart in the table.

Defined results: null and empty texts match nothing; a known sentence that no
rule takes is reported as "unknown-licence"; repeated sentences are listed each,
the licences that they show once; every row is judged, whether or not its id
repeats or is null; an empty table has no rows; a very long text costs in
proportion to its length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text
from notelake.llm.licence_table import GAPS, NAME_WORDS, NAMES, SHORTER, TEXTS

#: Words that a sentence needs to be known, by which its beginning is found, and that it needs for that (in a text of more sentences, alone: a short one is a title, which may stand within others).
LEAST_WORDS, OPENING, RUNNING, LONE = 3, 4, 5, 12
UNKNOWN = "unknown-licence"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Normalisation in order: "+" after a version, characters, SPDX lines, sentence marks, blank lines. "|" divides sentences, line ends stay.
NORMAL = (
    (r"([0-9])\+", r"\1 or later"), (r"\b(inc|ltd|corp|co|llc)\.([ \n,])", r"\1 \2"), (r"\blicen[cs]e[\"\']? *= *", "license: "), (r"@licen[cs]e +", "license: "),
    (r"[^a-z0-9.;:!?\n]+", " "), (r"spdx license identifier ?: ?", "|spdxid "), (r"\blicen[cs]e ?: ?", "|licenseid "), (r"\ball rights reserved\b", "|all rights reserved|"), (r"[.;:!?]+([ \n])", r"|\1"), (r"[.;:!?]+$", ""), (r"[;:!?]+", " "), (r"\n *(?:\n *)+", "|"),
)


def _plain_gaps(sentence: str) -> str:
    for pattern, to in GAPS:
        sentence = re.sub(pattern, to, sentence)
    return sentence


def _plain_cut(text: str, steps) -> list[str]:
    """The sentences of a known text, by the steps that cut any text."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, to in steps:
        text = re.sub(pattern, to, text)
    return [s for s in (_plain_gaps(" ".join(p.split())) for p in text.split("|")) if s.count(" ") >= LEAST_WORDS - 1 or "license" in s or "rights" in s]


#: Where a known sentence begins, whatever stands before it in its line.
_CUT_ONCE = [_plain_cut(text, NORMAL) for _, text in TEXTS]
_FIRST = sorted({r"[ \n]+".join(map(re.escape, s.split()[:OPENING])) for cut in _CUT_ONCE for s in cut if s.count(" ") >= (RUNNING if len(cut) > 1 else LONE) - 1})
OPENINGS = rf"([ \n|])({'|'.join(_FIRST)})([ \n|])"
CUT = (*NORMAL, (OPENINGS, r"\1|\2\3"))


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Known sentences with their identifiers, and ordered rules (a licence, and identifiers that follow each other)."""
    known: dict[str, str] = {}
    texts: list[tuple[str, tuple[str, ...]]] = []
    for licence, text in TEXTS:
        ids = []
        for s in _plain_cut(text, CUT):
            ids.append(known.setdefault(s, f"{licence}.{sum(v.startswith(licence + '.') for v in known.values()) + 1}"))
        texts.append((licence, tuple(ids)))
    owners: dict[tuple[str, ...], set[str]] = {}
    for licence, ids in texts:
        for n in range(1, len(ids) + 1):
            owners.setdefault(ids[:n], set()).add(licence)
    whole = {ids for _, ids in texts}
    # a beginning of a text stands for its licence if no other licence's text begins so, or if it is all of the text
    rules = {(licence, ids[:n]): None for licence, ids in texts for n in range(1, len(ids) + 1) if len(owners[ids[:n]]) == 1 or (n == len(ids) and ids[:n] in whole)}
    rules[("BSD", next(ids for licence, ids in texts if licence == "BSD-2-Clause")[:1])] = None
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    return known, [*ordered, *((licence, (f"name.{licence}",)) for licence in dict.fromkeys(NAMES.values()))]


SENTENCES, RULES = _tables()
_alternatives = lambda words: "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in sorted(words, key=lambda w: (-len(w), w)))
#: Names in shortened text: any (in an SPDX line), after "under", before "licensed", after "license:", and as a title of its own.
_ANY = f"({_alternatives(NAMES)})"
NAME, UNDER, LICENSED = rf"\b{_ANY}\b", rf"\bunder (?:a |an )?(?:terms (?:and conditions )?of )?{_ANY}\b", rf"\b{_ANY} licensed\b"
LINE, TITLE = rf"^licenseid (?:a |an )?{_ANY}\b", rf"^{_ANY}(?: international| unported| generic)?(?: public)?$"


def _cover() -> list[str]:
    """Words of which each known sentence has one: the rarest of a greedy choice, so that few other texts have them."""
    left = [{w for w in s.split() if len(w) > 5 and w.isalpha()} or {w for w in s.split() if w.isalpha()} for s in SENTENCES]
    out = []
    while left:
        best = max(sorted(set().union(*left)), key=lambda w: (sum(w in x for x in left), len(w)))
        out.append(best)
        left = [x for x in left if best not in x]
    return sorted(out)


#: A text has nothing that is looked for unless it has a word of a known sentence, or both a word that announces names and one that a name begins with.
ANCHORS = rf"(?i)\b(?:{'|'.join(_cover())})\b"
ANNOUNCED, NAMED = r"(?i)under\b|licen[cs]|spdx", rf"(?i)\b(?:{'|'.join(NAME_WORDS)})(?:\b|v|[0-9])"
#: What stands for an unknown sentence of so many words between known ones: it breaks a rule.
MARK, MARKED = "?", 4


def _replace(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    return text


def sentences(text: Column) -> Column:
    """The normalised sentences of a text; line ends stand in them."""
    return F.split(_replace(F.translate(text, UPPER, LOWER), CUT), r"\|")


def _squeezed(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, r"[ \n]+", " "))


def _names(plain: Column) -> Column:
    """Identifiers of the licences that a normalised sentence names."""
    short = F.trim(_replace(plain, SHORTER))
    every = lambda pattern: F.regexp_extract_all(short, F.lit(pattern), 1)
    named = F.create_map(*[F.lit(x) for n, licence in NAMES.items() for x in (n, f"name.{licence}")])
    found = (
        F.when(F.startswith(plain, F.lit("spdxid")), every(NAME)).when(F.startswith(plain, F.lit("licenseid")), every(LINE))
        .when(F.contains(plain, F.lit("under")) | F.contains(plain, F.lit("licensed")), F.concat(every(UNDER), every(LICENSED))).when(plain.rlike("licen[cs]e"), every(TITLE))
    )
    return F.transform(found, lambda n: named[n])


def _identifiers(sentence: Column) -> Column:
    """What is found in a sentence: itself, else its lines, else a name that goes beyond a line, else a mark if it has words enough."""
    known = F.create_map(*[F.lit(x) for x in sum(SENTENCES.items(), ())])
    none = F.array().cast("array<string>")
    own = lambda plain: F.when(known[_replace(plain, GAPS)].isNotNull(), F.array(known[_replace(plain, GAPS)]))
    lines = F.flatten(F.transform(F.split(sentence, "\n"), lambda p: F.coalesce(own(F.trim(p)), _names(F.trim(p)), none)))
    named = _names(_squeezed(sentence))
    mark = F.when(_squeezed(sentence).rlike(rf"(?:[a-z]+ .*){{{MARKED - 1}}}[a-z]"), F.array(F.lit(MARK)))
    return F.coalesce(own(_squeezed(sentence)), F.when(F.size(lines) > 0, lines), F.when(F.size(named) > 0, named), mark, none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences): the known sentences of each text in order, and the licences in the rules' order."""
    text, none = id_and_text(docs, id_col, text_col), F.array().cast("array<string>")
    likely = F.col("text").rlike(ANCHORS) | (F.col("text").rlike(ANNOUNCED) & F.col("text").rlike(NAMED))
    ids = text.select("doc_id", F.when(likely, sentences(F.col("text"))).alias("likely"))
    ids = ids.select("doc_id", F.when(F.size("likely") > 0, F.flatten(F.transform("likely", _identifiers))).otherwise(none).alias("marked"))
    ids = ids.select("doc_id", "marked", F.filter("marked", lambda i: i != MARK).alias("sentence_ids"))
    # the sequence as text, each identifier between blanks of its own; a rule's part is replaced by "#", which no later rule matches
    sequence = F.regexp_replace(F.array_join(F.transform("marked", lambda i: F.concat(F.lit(" "), i, F.lit(" "))), ""), r"(?: \? ){2,}", " ? ")
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f" {i} " for i in rule)).alias("part")) for name, rule in RULES])
    hit = lambda state, rule: F.contains(state["rest"], rule["part"])
    run = F.aggregate(
        rules, F.struct(sequence.alias("rest"), none.alias("found")),
        lambda state, rule: F.struct(
            F.when(hit(state, rule), F.replace(state["rest"], rule["part"], F.lit(" # "))).otherwise(state["rest"]).alias("rest"),
            F.when(hit(state, rule), F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        ),
        lambda state: F.array_distinct(F.when(state["rest"].rlike("[A-Za-z]"), F.array_append(state["found"], F.lit(UNKNOWN))).otherwise(state["found"])),
    )
    return ids.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, run).otherwise(none).alias("licences"))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences), the lists joined by commas."""
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences")
    )
