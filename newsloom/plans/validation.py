"""Queries of generated editorials and editions with planted breaches, over the documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import validation
from newsloom.plans import tables
from newsloom.plans.registry import query


@query("q38_batch_violations", """WITH d AS (SELECT doc_id AS id, doc_id // 8 AS batch_id, 'content:' || doc_id AS ref FROM documents)
SELECT batch_id, 'zz:' || id AS content_ref, 'ref_order' AS rule, (id % 8) || ':' || ref AS offender FROM d WHERE id % 40 = 25
UNION ALL SELECT batch_id, ref, 'hash_mismatch', 'stale' FROM d WHERE id % 40 = 21
UNION ALL SELECT batch_id, ref, 'unstable_claims', ref || '#summary:2,' || ref || '#summary:1' FROM d WHERE id % 40 = 13
UNION ALL SELECT batch_id, ref, 'tag_not_in_policy', 'tag:' || (id % 3) FROM d WHERE id % 40 = 17
UNION ALL SELECT batch_id, ref, 'unknown_evidence', 'e9' FROM d WHERE id % 40 = 5
UNION ALL SELECT batch_id, ref, 'unsupported_number', CAST(900000000000 + id AS VARCHAR) FROM d WHERE id % 40 = 9""")
def q38(spark: SparkSession, d: str) -> DataFrame:
    """Documents in batches of eight by id; a text cites the number of characters, which one of two pieces of evidence tells."""
    key = F.col("id")
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("size"))
    rows = rows.select("*", F.floor(key / 8).cast("bigint").alias("batch_id"), (key % 8).alias("position"), F.concat(F.lit("content:"), key.cast("string")).alias("content_ref"), F.sha2(key.cast("string"), 256).alias("hash"))
    piece = lambda ref, text: F.struct(F.lit(ref).alias("ref"), text.alias("text"))
    inputs = rows.select("batch_id", "position", "content_ref", F.col("hash").alias("input_content_hash"), F.array(piece("e0", F.lit("no figures")), piece("e1", F.concat("size", F.lit(" characters")))).alias("evidence"))
    case = lambda k, bad, good: F.when(key % 40 == k, bad).otherwise(good)
    claim = lambda k: F.concat("content_ref", F.lit(f"#summary:{k}"))
    number = case(9, (key + 900000000000).cast("string"), F.col("size"))
    cited = F.when(key % 40 == 5, F.array(F.lit("e1"), F.lit("e9"))).when(key % 40 == 29, F.array(F.lit("e0"))).otherwise(F.array(F.lit("e1")))
    answers = rows.select(
        "batch_id", "position", case(25, F.concat(F.lit("zz:"), key.cast("string")), F.col("content_ref")).alias("content_ref"), case(21, F.lit("stale"), F.col("hash")).alias("input_content_hash"),
        case(13, F.array(claim(2), claim(1)), F.array(claim(1), claim(2))).alias("claim_refs"), F.array(F.struct(F.concat(number, F.lit(" long")).alias("text"), cited.alias("refs"))).alias("texts"),
        F.array(F.struct(F.concat(F.lit("tag:"), (key % 3).cast("string")).alias("tag_key"), case(17, F.lit("other"), F.lit("label")).alias("label"))).alias("tags"),
    )
    policy = spark.range(3).select(F.concat(F.lit("tag:"), F.col("id").cast("string")).alias("tag_key"), F.lit("label").alias("label"))
    return validation.batch_violations(answers, inputs, policy)


@query("q39_edition_violations", """WITH d AS (SELECT doc_id AS id, doc_id // 20 AS edition_id, doc_id % 4 AS place, 'd:' || doc_id AS ref, n_chars FROM documents),
p AS (SELECT edition_id, place, id AS story_place, ref, id % 20 < 4 AS in_intro FROM d WHERE id % 200 <> 13 UNION ALL SELECT edition_id, (place + 1) % 4, id, ref, FALSE FROM d WHERE id % 200 = 7
 UNION ALL SELECT edition_id, place, id, 'x:' || id, FALSE FROM d WHERE id % 200 = 21 UNION ALL SELECT edition_id, (place + 1) % 4, NULL, ref, TRUE FROM d WHERE id % 200 = 33),
s AS (SELECT DISTINCT edition_id, place, CASE WHEN edition_id % 10 = 4 AND place < 2 THEN 1 - place ELSE place END AS k FROM d UNION SELECT DISTINCT edition_id, 4, 4 FROM d WHERE edition_id % 10 = 8),
c AS (SELECT edition_id, ref, count(*) AS n FROM p WHERE story_place IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, max(k) OVER (PARTITION BY edition_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM s)
SELECT edition_id, 'missing_story' AS rule, ref AS offender FROM d ANTI JOIN c USING (edition_id, ref) UNION ALL SELECT edition_id, 'unexpected_story', ref FROM c ANTI JOIN d USING (edition_id, ref)
UNION ALL SELECT edition_id, 'duplicate_story', ref FROM c WHERE n > 1 UNION ALL SELECT DISTINCT edition_id, 'unknown_lead_story', 'x:lead' FROM d WHERE edition_id % 10 = 9
UNION ALL SELECT edition_id, 'too_many_sections', CAST(count(*) AS VARCHAR) FROM s GROUP BY 1 HAVING count(*) > 4 UNION ALL SELECT edition_id, 'section_not_in_policy', 'k' || k FROM s WHERE edition_id % 10 = 6 AND place = 2
UNION ALL SELECT edition_id, 'section_order', 'k' || k FROM w WHERE k < highest UNION ALL SELECT edition_id, 'intro_outside_section', place || ':' || ref FROM p WHERE story_place IS NULL
UNION ALL SELECT DISTINCT edition_id, 'unsupported_number', '3:' || (900000000000 + edition_id) FROM d WHERE edition_id % 10 = 2 AND place = 3""")
def q39(spark: SparkSession, d: str) -> DataFrame:
    """Twenty documents are an edition of four sections; introductions tell the length of the first story of their section."""
    key, edition = F.col("id"), F.col("edition_id")
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("size"))
    rows = rows.select("*", F.floor(key / 20).cast("bigint").alias("edition_id"), (key % 4).alias("section_place"), F.concat(F.lit("d:"), key.cast("string")).alias("story_ref"))
    stories = rows.select("edition_id", key.alias("story_place"), "story_ref", F.concat("size", F.lit(" characters")).alias("text"))
    place = lambda section, story, ref, intro: (edition, section.alias("section_place"), story.cast("bigint").alias("story_place"), ref.alias("story_ref"), intro.alias("in_intro"))
    own, ref, following = F.col("section_place"), F.col("story_ref"), (F.col("section_place") + 1) % 4
    placements = rows.where("id % 200 <> 13").select(*place(own, key, ref, key % 20 < 4))
    placements = placements.unionByName(rows.where("id % 200 = 7").select(*place(following, key, ref, F.lit(False))))
    placements = placements.unionByName(rows.where("id % 200 = 21").select(*place(own, key, F.concat(F.lit("x:"), key.cast("string")), F.lit(False))))
    placements = placements.unionByName(rows.where("id % 200 = 33").select(*place(following, F.lit(None), ref, F.lit(True))))
    number = F.when((edition % 10 == 2) & (own == 3), (edition + 900000000000).cast("string")).otherwise(F.min_by("size", "id"))
    sections = rows.groupBy("edition_id", "section_place").agg(number.alias("number")).withColumn("k", F.when((edition % 10 == 4) & (own < 2), 1 - own).otherwise(own))
    sections = sections.select("edition_id", "section_place", "k", F.concat(F.lit("About "), "number").alias("intro"))
    sections = sections.unionByName(rows.where("edition_id % 10 = 8").select("edition_id", F.lit(4).cast("bigint").alias("section_place"), F.lit(4).cast("bigint").alias("k"), F.lit("Rest").alias("intro")).distinct())
    title = F.when((edition % 10 == 6) & (own == 2), "Other").otherwise(F.concat(F.lit("T"), F.col("k").cast("string")))
    sections = sections.select("edition_id", "section_place", F.concat(F.lit("k"), F.col("k").cast("string")).alias("section_key"), title.alias("title"), "intro")
    leads = rows.groupBy("edition_id").agg(F.min_by(F.struct("story_ref", "size"), "id").alias("f"))
    leads = leads.select("edition_id", F.concat(F.lit("First "), "f.size").alias("text"), F.when(edition % 10 == 9, F.array("f.story_ref", F.lit("x:lead"))).otherwise(F.array("f.story_ref")).alias("story_refs"))
    catalog = spark.range(5).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("section_key"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.col("id").alias("place"))
    return validation.edition_violations(placements, sections, leads, stories, catalog, 4)
