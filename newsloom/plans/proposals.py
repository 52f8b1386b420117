"""Queries of proposed entities over the documents, with their DuckDB SQL.

Documents in batches of eight by id; the answers of a batch propose a document's first words, with planted breaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import proposals
from newsloom.plans import tables
from newsloom.plans.registry import query

BATCH_SQL = r"""WITH d AS (SELECT doc_id AS id, doc_id // 8 AS batch_id, doc_id % 8 AS position, 'content:' || doc_id AS content_ref, md5(text) AS hash, text, substr(text, 1, 80) AS head, substr(text, 81, 400) AS tail,
 lower(regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+)', 1)) AS word, regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+)', 1) AS surface FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, CASE WHEN id % 40 = 3 THEN 'content:' || (id + 1) ELSE content_ref END AS answered, CASE WHEN id % 40 = 11 THEN 'stale' ELSE hash END AS answered_hash,
 CASE WHEN id % 40 = 19 THEN 'missing' ELSE 'body:0' END AS evidence_ref, CASE WHEN id % 40 = 27 THEN surface || ' Absent' ELSE surface END AS proposed FROM d),
p AS (SELECT batch_id, answered AS content_ref, position, answered_hash, unnest(CASE WHEN id % 40 = 35 THEN [0, 1, 2] ELSE [0, 1] END) AS mention, proposed, evidence_ref, id FROM a),
m AS (SELECT batch_id, content_ref, mention, CASE mention WHEN 1 THEN 'e' ELSE proposed END AS surface, CASE mention WHEN 1 THEN 'letter' ELSE 'word' END AS entity_type, CASE mention WHEN 1 THEN 'body:80' ELSE evidence_ref END AS evidence_ref FROM p),
e AS (SELECT batch_id, content_ref, id, 'body:0' AS evidence_ref, 0 AS start_char, head AS text FROM d UNION ALL SELECT batch_id, content_ref, id, 'body:80', 80, tail FROM d),
violations AS (SELECT d.batch_id, a.answered AS content_ref, 'ref_order' AS rule, d.position || ':' || d.content_ref AS offender FROM d JOIN a ON a.id = d.id WHERE a.answered <> d.content_ref
UNION ALL SELECT a.batch_id, a.answered, 'hash_mismatch', a.answered_hash FROM a JOIN d ON d.batch_id = a.batch_id AND d.content_ref = a.answered WHERE a.answered_hash <> d.hash
UNION ALL SELECT m.batch_id, m.content_ref, CASE WHEN e.text IS NULL THEN 'unknown_evidence' ELSE 'surface_not_in_evidence' END, m.mention || ':' || m.evidence_ref || ':' || m.surface FROM m JOIN d ON d.batch_id = m.batch_id AND d.content_ref = m.content_ref
 LEFT JOIN e ON e.batch_id = m.batch_id AND e.content_ref = m.content_ref AND e.evidence_ref = m.evidence_ref WHERE e.text IS NULL OR NOT contains(e.text, m.surface)
UNION ALL SELECT m.batch_id, m.content_ref, 'duplicate_candidate', min(m.mention) || ':' || m.evidence_ref || ':' || m.surface FROM m JOIN d ON d.batch_id = m.batch_id AND d.content_ref = m.content_ref GROUP BY m.batch_id, m.content_ref, m.surface, m.entity_type, m.evidence_ref HAVING count(*) > 1)"""

MENTION_SQL = """, sound AS (SELECT m.*, m.batch_id || ':' || m.content_ref || ':' || m.mention AS mention_id, e.id, e.start_char, e.text FROM m JOIN e ON e.batch_id = m.batch_id AND e.content_ref = m.content_ref AND e.evidence_ref = m.evidence_ref WHERE m.batch_id NOT IN (SELECT batch_id FROM violations)),
alias AS (SELECT DISTINCT id % 5 AS entity_id, word AS form FROM d WHERE id % 3 = 0 AND word <> ''),
possible AS (SELECT DISTINCT s.mention_id, alias.entity_id FROM sound s JOIN alias ON s.entity_type = 'word' AND alias.form = lower(s.surface)),
claim AS (SELECT mention_id, count(*) AS n, min(entity_id) AS entity_id FROM possible GROUP BY 1),
c AS (SELECT s.*, string_split(s.text, s.surface) AS parts FROM sound s WHERE s.surface <> ''),
o AS (SELECT *, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(surface))) AS at FROM c),
found AS (SELECT o.mention_id, o.id, o.entity_type, o.surface, CAST(o.start_char + o.at AS INT) AS start_offset, CAST(o.start_char + o.at + length(o.surface) AS INT) AS end_offset,
 regexp_replace(substr(o.text, CAST(greatest(0, o.at - 60) AS BIGINT) + 1, CAST(o.at + length(o.surface) + 60 - greatest(0, o.at - 60) AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS evidence_text, coalesce(n, 0) AS n, entity_id FROM o LEFT JOIN claim USING (mention_id))"""


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, inputs and aliases: what BATCH_SQL builds."""
    key, ref = F.col("id"), F.concat(F.lit("content:"), F.col("id").cast("string"))
    surface = F.regexp_extract("text", "^[^A-Za-z]*([A-Za-z]+)", 1)
    rows = tables.read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("hash"))
    rows = rows.select("id", "text", "hash", F.floor(key / 8).cast("bigint").alias("batch_id"), (key % 8).alias("position"), ref.alias("content_ref"), surface.alias("surface"))
    span = lambda at, size: F.struct(F.lit(f"body:{at}").alias("ref"), F.lit("body").alias("field"), F.lit(at).alias("start_char"), F.substring("text", at + 1, size).alias("text"))
    inputs = rows.select("batch_id", "position", "content_ref", F.col("id").alias("content_item_id"), F.col("hash").alias("input_content_hash"), F.array(span(0, 80), span(80, 400)).alias("evidence"))
    case = lambda k, bad, good: F.when(key % 40 == k, bad).otherwise(good)
    mention = lambda text, kind, where: F.struct(text.alias("surface"), text.alias("canonical_name"), F.lit(kind).alias("entity_type"), where.alias("evidence_ref"), F.lit(0.75).alias("confidence"))
    word = mention(case(27, F.concat("surface", F.lit(" Absent")), F.col("surface")), "word", case(19, F.lit("missing"), F.lit("body:0")))
    letter = mention(F.lit("e"), "letter", F.lit("body:80"))
    answers = rows.select(
        "batch_id", "position", case(3, F.concat(F.lit("content:"), (key + 1).cast("string")), F.col("content_ref")).alias("content_ref"),
        case(11, F.lit("stale"), F.col("hash")).alias("input_content_hash"), case(35, F.array(word, letter, word), F.array(word, letter)).alias("mentions"),
    )
    aliases = rows.where((key % 3 == 0) & (F.col("surface") != "")).select((key % 5).alias("entity_id"), F.lit("word").alias("entity_type"), F.lower("surface").alias("normalized_alias")).distinct()
    return answers, inputs, aliases


@query("x6_batch_violations", BATCH_SQL + " SELECT * FROM violations")
def x6(spark: SparkSession, d: str) -> DataFrame:
    answers, inputs, _ = _batches(spark, d)
    return proposals.violations(answers, inputs)


@query("x8_proposed_mentions", BATCH_SQL + MENTION_SQL + """ SELECT mention_id, id AS content_item_id, entity_type, surface, 'body' AS field, start_offset, end_offset, evidence_text, CASE WHEN n = 1 THEN entity_id END AS entity_id,
 CASE WHEN n = 1 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution_status FROM found""")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return proposals.mentions(*_batches(spark, d))[0]


@query("x8_resolution_candidates", BATCH_SQL + MENTION_SQL + """ SELECT f.mention_id, f.start_offset, p.entity_id AS candidate_entity_id, 0.75::DOUBLE AS score FROM found f JOIN possible p USING (mention_id) WHERE f.n > 1""")
def x8_candidates(spark: SparkSession, d: str) -> DataFrame:
    return proposals.mentions(*_batches(spark, d))[1]
