"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import byte_bpe, conversation_sql, conversations, decontaminate, exact_dedup, hard_negatives, licences, ordinal, pii, secret_scan, secret_sql, simhash, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(_table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; selected are documents that are likelier good (1 or 2) than poor."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))
    return ordinal.rate(docs, ordinal.train(docs, graded, "grade"), 1)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damage(_table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_vectors(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_pii, op3_exact_dedup, op4_quality, op5_warc_revisits, op6_benchmark_decontamination, op7_repeated_passages, op8_licences, op9_toxicity, op10_byte_bpe,
    op11_conversation_repair, op12_hard_negatives, op13_secrets,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _chain(text: str, steps) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), 2 * chr(39))}', '{to}', 'g')"
    return text


def _licence_sql() -> str:
    """The sentence table and the ordered rules as SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.SENTENCES.items())
    named = ", ".join(f"('{n}', 'name.{licence}')" for n, licence in licences.NAMES.items())
    rules = ", ".join(f"({k}, '{name}', '{''.join(f' {i} ' for i in rule)}')" for k, (name, rule) in enumerate(licences.RULES, 1))
    body, plainly = _chain(_LOWER, licences.CUT), f"trim({_chain('plain', licences.SHORTER)})"
    every = lambda pattern: f"regexp_extract_all({plainly}, '{pattern}', 1)"
    names = f"""CASE WHEN starts_with(plain, 'spdxid') THEN {every(licences.NAME)} WHEN starts_with(plain, 'licenseid') THEN {every(licences.LINE)}
      WHEN contains(plain, 'under') OR contains(plain, 'licensed') THEN {every(licences.UNDER)} || {every(licences.LICENSED)} WHEN regexp_matches(plain, 'licen[cs]e') THEN {every(licences.TITLE)} ELSE [] END"""
    likely = f"regexp_matches(coalesce(text, ''), '{licences.ANCHORS}') OR regexp_matches(coalesce(text, ''), '{licences.ANNOUNCED}') AND regexp_matches(coalesce(text, ''), '{licences.NAMED}')"
    gaps = lambda text: _chain(text, licences.GAPS)
    return rf"""
        WITH RECURSIVE known(sentence, id) AS (VALUES {known}), named(name, id) AS (VALUES {named}), rules(k, name, part) AS (VALUES {rules}),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        b AS (SELECT r, string_split({body}, '|') AS a FROM docs WHERE {likely}),
        s AS (SELECT r, unnest(a) AS sentence, generate_subscripts(a, 1) AS i FROM b),
        p AS (SELECT r, i, sentence, trim(regexp_replace(sentence, '[ \n]+', ' ', 'g')) AS plain FROM s),
        w AS MATERIALIZED (SELECT p.*, known.id FROM p LEFT JOIN known ON known.sentence = {gaps("plain")}),
        l AS (SELECT r, i, trim(unnest(string_split(sentence, chr(10)))) AS plain, generate_subscripts(string_split(sentence, chr(10)), 1) AS j FROM w WHERE id IS NULL),
        lk AS MATERIALIZED (SELECT r, i, j, plain, known.id FROM l LEFT JOIN known ON known.sentence = {gaps("l.plain")}),
        ln AS (SELECT r, i, j, unnest(n) AS name, generate_subscripts(n, 1) AS k FROM (SELECT r, i, j, {names} AS n FROM lk WHERE id IS NULL)),
        lines AS MATERIALIZED (SELECT r, i, j, 0 AS k, id FROM lk WHERE id IS NOT NULL UNION ALL SELECT r, i, j, k, named.id FROM ln JOIN named USING (name)),
        wn AS (SELECT r, i, unnest(n) AS name, generate_subscripts(n, 1) AS k FROM (SELECT r, i, {names} AS n FROM w WHERE id IS NULL AND (r, i) NOT IN (SELECT r, i FROM lines))),
        hit AS MATERIALIZED (SELECT r, i, 0 AS j, 0 AS k, id FROM w WHERE id IS NOT NULL UNION ALL FROM lines UNION ALL SELECT r, i, 0, k, named.id FROM wn JOIN named USING (name)),
        marks AS (SELECT r, i, 0 AS j, 0 AS k, '{licences.MARK}' AS id FROM w WHERE (r, i) NOT IN (SELECT r, i FROM hit) AND regexp_matches(plain, '(?:[a-z]+ .*){{{licences.MARKED - 1}}}[a-z]')),
        seq AS MATERIALIZED (SELECT r, list(id ORDER BY i, j, k) FILTER (id <> '{licences.MARK}') AS ids, list(id ORDER BY i, j, k) AS marked FROM (FROM hit UNION ALL FROM marks) GROUP BY r),
        run AS (SELECT r, 0 AS k, regexp_replace(' ' || array_to_string(marked, '  ') || ' ', '(?: \? ){{2,}}', ' ? ', 'g') AS rest, CAST([] AS VARCHAR[]) AS found FROM seq WHERE ids IS NOT NULL
          UNION ALL SELECT r, rules.k, replace(rest, part, ' # '), CASE WHEN contains(rest, part) THEN list_append(found, name) ELSE found END FROM run JOIN rules ON rules.k = run.k + 1),
        fin AS (SELECT r, CASE WHEN regexp_matches(rest, '[A-Za-z]') THEN list_append(found, '{licences.UNKNOWN}') ELSE found END AS found FROM run WHERE k = {len(licences.RULES)})
        SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
          coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licences
        FROM docs LEFT JOIN seq USING (r) LEFT JOIN fin USING (r)"""


ORACLE = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        h AS (SELECT doc_id, length(text) AS points, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
               text_sha256
        FROM h""",
    "op5_warc_revisits": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op6_benchmark_decontamination": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
        bw AS (SELECT item_id, least(len(a), 10) AS size, unnest(range(greatest(len(a) - 9, 1))) AS i, a FROM b WHERE len(a) > 0),
        win AS (SELECT DISTINCT item_id, size, array_to_string(a[i + 1:i + size], ' ') AS w FROM bw),
        dw AS (SELECT r, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS i FROM d),
        dl AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM dw),
        g AS (SELECT r, i, size, array_to_string(ahead[1:size], ' ') AS w FROM dl, (SELECT DISTINCT size FROM win) WHERE len(ahead) >= size),
        hit AS (SELECT r, i, size, item_id FROM g JOIN win USING (size, w)),
        marked AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hit), range(10) x(k) WHERE k < size GROUP BY r),
        names AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN marked USING (r) LEFT JOIN names USING (r)""",
    "op7_repeated_passages": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS a FROM documents),
        dw AS (SELECT r, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS i FROM d),
        g AS (SELECT r, i, count(*) OVER w AS n, md5(string_agg(word, ' ') OVER w) AS h FROM dw WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        c AS (SELECT h FROM g WHERE n = 50 GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT r, i FROM g WHERE n = 50 AND h IN (SELECT h FROM c)),
        isl AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
        num AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS grp FROM isl),
        sp AS (SELECT r, grp, min(i) AS s, max(i) + 50 AS e FROM num GROUP BY r, grp),
        t AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_repeated, count(*) AS n_spans, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM sp GROUP BY r)
        SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)""",
    "op8_licences": _licence_sql(),
    "op11_conversation_repair": conversation_sql.SQL,
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
          FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT * FROM n WHERE rank <= 5""",
    "op13_secrets": secret_sql.SQL,
}
