"""The document operators as registered queries on the driver's tables, and their expected results in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfold.llm import (
    conversation_repair,
    exact_dedup,
    hard_negatives,
    language_id,
    lm_score,
    minhash_dedup,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
)
from skyfold.llm.common import held_out, read_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
RULE_SAMPLE = 0.01
RULE_SEED = 7
KEEP_SCORE = 0.3
PIECE_MODEL = os.environ.get("SKYFOLD_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir), keep="largest")


ORACLES["op1_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""


@register
def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(read_documents(spark, sf_dir), SHARDS)
    return shards.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


@register
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_documents(spark, sf_dir))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "times * size AS taken", "source", "times")


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    estimates = quality_rules.estimate(quality_rules.sample(docs, RULE_SAMPLE, RULE_SEED))
    rules = quality_rules.ordered(quality_rules.RULES, estimates)
    judged = quality_rules.cascade(quality_rules.measured(docs), rules, quality_rules.BASE_STATISTICS)
    return judged.selectExpr(
        "doc_id",
        *quality_rules.BASE_STATISTICS,
        "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
        "kept",
    )


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = held_out("doc_id", 3, 1)
    profiles = language_id.learn_profiles(docs.where(f"NOT ({out})"))
    return language_id.identify(docs, profiles).selectExpr("doc_id", f"{out} AS held_out", "lang_pred", "score")


@register
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = held_out("doc_id", 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"NOT ({out})")
    model = quality_model.train(docs, labels)
    return quality_model.score(docs, model).selectExpr("doc_id", f"{out} AS held_out", "score", f"int(score >= {KEEP_SCORE}) AS predicted")


@register
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read_documents(spark, sf_dir), PIECE_MODEL)


@register
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_documents(spark, sf_dir), words=3, percent=90)


@register
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = held_out("doc_id", 7, 2)
    model = lm_score.train(docs.where(f"NOT ({out})"))
    return lm_score.score(docs, model).selectExpr("doc_id", f"{out} AS held_out", "* EXCEPT (doc_id)")


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.secret_spans(read_documents(spark, sf_dir))
    counts = [
        f"bigint(size(filter(base_spans, s -> s.kind = {kind}))) AS n_{name}" for kind, name in enumerate(secret_scan.KINDS[:3])
    ]
    return scanned.selectExpr(
        "doc_id",
        *counts,
        f"sha2({secret_scan.rendered('base_spans')}, 256) AS base_sha256",
        f"{secret_scan.rendered('concat(base_spans, random_spans)')} AS spans",
    )


@register
def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_documents(spark, sf_dir), words=4, percent=80)


@register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    relabelled = vectors.selectExpr("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "embedding")
    return hard_negatives.hard_negatives(relabelled, "vec_id % 100 = 0", n_positives=5, n_negatives=5, percent=80)


ORACLES["op12_hard_negatives"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.key AS anchor, a.vec_id AS anchor_id, b.key, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.key <> b.key),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n USING (anchor)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor, positive_id ORDER BY score DESC, vec_id) <= 5
"""


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair_conversations(damaged(turns), turns)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without ends of sentences, repeated or given to the user, by the checksum of their place."""
    place = "concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    return (
        turns.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32({place}) % 20 AS damage")
        .where("damage <> 0")
        .selectExpr(
            "conv_id",
            "turn",
            "if(damage = 4, 'user', role) AS role",
            "CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
            "explode(array_repeat(0, if(damage = 3, 2, 1))) AS copy",
        )
        .drop("copy")
    )


# One best path (cost, letters) per state is carried over the rows; states as in the operator.
ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS damage
  FROM placed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM numbered),
inserts(q, r, cost, letters, lines) AS (VALUES
  (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
  (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edits(letter, q, r, initial, cost, role) AS (
  SELECT 'D', q, q, CAST(NULL AS VARCHAR), 3, CAST(NULL AS VARCHAR) FROM range(4) AS states(q) UNION ALL
  VALUES ('K', 0, 1, 's', 0, NULL), ('K', 0, 2, 'u', 0, NULL), ('K', 1, 2, 'u', 0, NULL), ('K', 3, 2, 'u', 0, NULL), ('K', 2, 3, 'a', 0, NULL),
         ('R', 0, 2, NULL, 2, 'user'), ('R', 1, 2, NULL, 2, 'user'), ('R', 3, 2, NULL, 2, 'user'), ('R', 2, 3, NULL, 2, 'assistant')),
paths AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM judged
  UNION ALL
  SELECT p.conv_id, j.i, CAST(e.r AS BIGINT) AS state,
         p.cost + n.cost + e.cost + CASE WHEN e.letter <> 'D' AND unended THEN 1 ELSE 0 END AS total,
         audit || n.letters || e.letter AS letters_so_far,
         p.lines || n.lines || CASE e.letter WHEN 'D' THEN [] ELSE [coalesce(e.role, j.role) || ':' || text] END
  FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
  JOIN inserts n ON n.q = p.q JOIN edits e ON e.q = n.r AND coalesce(e.initial, j.initial) = j.initial
  WHERE e.letter = 'D' OR NOT (blank OR repeated)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, state ORDER BY total, letters_so_far) = 1),
best AS (
  SELECT p.conv_id, p.cost + n.cost AS cost, audit || n.letters AS audit, p.lines || n.lines AS lines
  FROM paths p JOIN inserts n USING (q)
  WHERE n.r IN (0, 3) AND p.i = (SELECT max(i) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM p.conv_id)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.cost, audit || n.letters) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (repeated AND NOT blank) AS duplicate, count(*) FILTER (unended AND NOT (blank OR repeated)) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _component_sql(words: int, percent: int, more: str) -> str:
    """Sets of shingles, all pairs that share one, links, and the smallest identifier reachable; ``degrees`` counts links to
    other sets."""
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {words - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {words - 2}, 2))) AS i FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= {percent} * (x.n + y.n - s.n)),
reached AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT doc_id, b FROM reached JOIN links ON other = a),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id),
keys AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS key FROM shingles GROUP BY doc_id),
degrees AS (
  SELECT a AS doc_id, count(DISTINCT y.key) AS n_links
  FROM links JOIN keys x ON x.doc_id = a JOIN keys y ON y.doc_id = b WHERE x.key <> y.key GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
FROM components LEFT JOIN sizes USING (doc_id) LEFT JOIN degrees USING (doc_id)"""


ORACLES["op3_ngram_join"] = _component_sql(3, 90, ", coalesce(n_links, 0) AS n_links")
ORACLES["op11_minhash_dedup"] = _component_sql(4, 80, ", doc_id = component_id AS kept")


# The checksum is spelled out over the bytes of the text, one table step each.
ORACLES["op8_byte_shards"] = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
sized AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size FROM documents),
bytes AS (
  SELECT doc_id, size, list_transform(range(size - 16), lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT *, hex(encode(text)) AS digits FROM sized)),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id, size, text_crc32) AS place
  FROM summed),
cut AS (SELECT *, CAST(((2 * upto - size) * 40) // (2 * total) AS INT) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""

ORACLES["op10_quality_rules"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) AS steps(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
         len(list_filter(words, lambda word: regexp_matches(word, '\p{L}'))) AS n_letter_words,
         len(list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '^[ \t]*[-*\x{2022}][ \t]'))) AS n_bullet_lines,
         len(list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS n_ellipsis_lines
  FROM split LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > n_letters
            OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR 10 * n_letter_words < 8 * n_words
            OR 10 * n_bullet_lines > 9 * n_lines OR 10 * n_ellipsis_lines > 3 * n_lines) AS kept
FROM based
"""
