"""Dictionary entity mentions with exact positions, resolution and reviews."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.functions.slices import cut
from newsloom.operators.relevance import latest_per_item

CONTEXT, EVIDENCE, CANDIDATE_SCORE = 60, 10, 0.5
#: Parts of a name's mentions that are ranked apart.
SALT = 64
FIELDS = ("title", "excerpt", "body")
MENTIONS = "content_item_id bigint, field string, start_offset int, end_offset int, surface string, entity_id bigint, evidence_text string"


@dataclass(frozen=True)
class Alias:
    entity_id: int
    alias: str


#: Letters that count as another one where case is ignored, beside plain lower case.
SAME_LETTER = {"ſ": "s", "ı": "i", "İ": "i", "µ": "μ"}


def folded(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in (SAME_LETTER.get(c, c) for c in text))
    return low.translate(_SAME)


_SAME = str.maketrans(SAME_LETTER)


class Matcher:
    """All aliases as one Aho-Corasick automaton: a text is read once, however many there are.

    A match must begin and end at a word's edge where the alias has a Latin letter or digit there; matches of one alias
    don't overlap.
    """

    def __init__(self, aliases: list[Alias]):
        from ahocorasick import Automaton

        self.aliases = sorted({a for a in aliases if a.alias}, key=lambda a: (a.alias, a.entity_id))
        latin = lambda c: c.isascii() and c.isalnum()
        self.edges = [(latin(a.alias[0]), latin(a.alias[-1])) for a in self.aliases]
        found: dict[str, list[int]] = {}
        for k, a in enumerate(self.aliases):
            found.setdefault(folded(a.alias), []).append(k)
        self.machine = Automaton()
        for form, places in found.items():
            self.machine.add_word(form, (len(form), places))
        self.machine.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(entity, start, end) of every match."""
        if not text or not self.aliases:
            return
        word = lambda at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
        free: dict[int, int] = {}
        for last, (size, places) in self.machine.iter(folded(text)):
            start, end = last - size + 1, last + 1
            for k in places:
                begins, ends = self.edges[k]
                if start >= free.get(k, 0) and not (begins and word(start - 1)) and not (ends and word(end)):
                    free[k] = end
                    yield self.aliases[k].entity_id, start, end


def normalize_name(value: str | None) -> str:
    """Compatibility forms without case, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", value or "").casefold() if c.isalnum())


def normalized_name(x: Column) -> Column:
    """normalize_name in built-in functions, for names without compatibility forms."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def find_mentions(items: DataFrame, aliases: list[Alias]) -> DataFrame:
    """Every match of every alias in title, excerpt and body, one row per span and entity.

    The registry goes to every worker once, which compiles it into one automaton; it must fit a worker's memory (about
    1 KB an alias). Null and empty texts have no mentions, ids may be null and keep their exact values, repeated rows
    give their mentions once, and other columns are ignored.
    """
    registry = items.sparkSession.sparkContext.broadcast(aliases)

    schema = to_arrow_schema(StructType.fromDDL(MENTIONS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(registry.value)
        for batch in batches:
            for ids, *columns in cut(batch.columns):
                rows = []
                for item, *texts in zip(ids, *columns):
                    for field, text in zip(FIELDS, texts):
                        rows += [(item, field, a, b, text[a:b], entity, text[max(0, a - CONTEXT) : b + CONTEXT].strip()) for entity, a, b in matcher.find(text or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), schema.types)], schema=schema)

    return items.select(F.col("id").cast("bigint"), *FIELDS).mapInArrow(found, MENTIONS).distinct()


def resolve(mentions: DataFrame) -> DataFrame:
    """One row per span: resolved with confidence 1 where one entity claims it, else ambiguous without an entity."""
    spans = mentions.groupBy("content_item_id", "field", "start_offset", "end_offset").agg(
        F.first("surface").alias("surface"), F.first("evidence_text").alias("evidence_text"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids")
    )
    one = F.size("entity_ids") == 1
    return spans.withColumns({
        "entity_id": F.when(one, F.col("entity_ids")[0]), "resolution_status": F.when(one, "resolved").otherwise("ambiguous"),
        "confidence": F.when(one, 1.0).otherwise(0.0),
    })


def resolution_candidates(spans: DataFrame) -> DataFrame:
    """The entities that claim an ambiguous span."""
    open_ = spans.where("resolution_status = 'ambiguous'")
    return open_.select("content_item_id", "field", "start_offset", F.explode("entity_ids").alias("candidate_entity_id"), F.lit(CANDIDATE_SCORE).alias("score"))


def confirmed_counts(spans: DataFrame) -> DataFrame:
    """content_item_id, entity_count: distinct resolved entities."""
    return spans.where("entity_id IS NOT NULL").groupBy("content_item_id").agg(F.countDistinct("entity_id").alias("entity_count"))


def alias_candidates(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities of the same type one of whose aliases is the surface or the canonical name of a candidate."""
    wanted = names.select("mention_id", "entity_type", F.explode(F.array_distinct(F.array(normalized_name(F.col("surface")), normalized_name(F.col("canonical_name"))))).alias("normalized_alias"))
    return wanted.join(aliases.select("entity_id", "entity_type", "normalized_alias"), ["entity_type", "normalized_alias"]).select("mention_id", "entity_id").distinct()


def _named(unresolved: DataFrame) -> DataFrame:
    rows = unresolved.withColumn("normalized_name", normalized_name(F.col("surface"))).where("normalized_name <> ''")
    return rows.withColumn("candidate_key", F.sha2(F.concat_ws(":", "entity_type", "normalized_name"), 256))


def review_mentions(unresolved: DataFrame) -> DataFrame:
    """candidate_key, mention_id: which mentions a review decides, one row each, however many share a name."""
    return _named(unresolved).select("candidate_key", "mention_id").distinct()


def review_queue(unresolved: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Unresolved mentions by type and normalized surface: key, count, first mention and the first evidence; decisions stay.

    The first evidence is ranked within salted parts of a name and then among their few, so that no task holds a name.
    """
    rows = _named(unresolved)
    part = Window.partitionBy("candidate_key", F.pmod(F.xxhash64("mention_id"), F.lit(SALT))).orderBy("mention_id", "evidence_text")
    among = Window.partitionBy("candidate_key").orderBy("mention_id", "evidence_text")
    few = rows.select("candidate_key", "mention_id", "evidence_text", F.row_number().over(part).alias("place")).where(F.col("place") <= EVIDENCE)
    first = few.withColumn("place", F.row_number().over(among)).where(F.col("place") <= EVIDENCE)
    first = first.groupBy("candidate_key").agg(F.array_sort(F.collect_list(F.struct("place", "evidence_text"))).alias("e"))
    groups = rows.groupBy("candidate_key", "entity_type", "normalized_name").agg(
        F.min_by("surface", "mention_id").alias("proposed_name"), F.count("*").alias("mention_count"), F.min("mention_id").alias("first_mention")
    )
    groups = groups.join(first.select("candidate_key", F.transform("e", lambda x: x["evidence_text"]).alias("evidence")), "candidate_key")
    if decided is None:
        return groups.withColumn("status", F.lit("pending"))
    return groups.join(decided.select("candidate_key", F.col("status").alias("old")), "candidate_key", "left").withColumn("status", F.coalesce("old", F.lit("pending"))).drop("old")


def apply_reviews(mentions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decided reviews (candidate_key, status, entity_id) applied: mentions with resolution and entity, and new aliases.

    A confirmed review resolves every mention of its name to its entity, a rejected one marks them rejected; pending
    ones change nothing. The distinct surfaces of confirmed mentions become aliases of the entity.
    """
    rows = _named(mentions).join(reviews.where("status <> 'pending'").select("candidate_key", "status", "entity_id"), "candidate_key", "left")
    state = F.when(F.col("status") == "confirmed", "confirmed").when(F.col("status") == "rejected", "rejected").otherwise("unresolved")
    rows = rows.withColumn("resolution", state).withColumn("entity_id", F.when(F.col("status") == "confirmed", F.col("entity_id")))
    aliases = rows.where("resolution = 'confirmed'").select("entity_id", "entity_type", F.col("surface").alias("alias"), F.col("normalized_name").alias("normalized_alias")).distinct()
    return rows.select("mention_id", "candidate_key", "entity_id", "resolution"), aliases


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies create, link and reject decisions; the same decision again changes nothing, another one is a conflict."""
    latest = latest_per_item(decisions, ["candidate_key"], "decided_at").select("candidate_key", "action", "entity_id")
    new = F.when(F.col("action") == "reject", "rejected").when(F.col("action").isin("create", "link"), "confirmed")
    open_ = F.col("status") == "pending"
    rows = reviews.join(latest, "candidate_key", "left")
    outcome = F.when(F.col("action").isNull(), "none").when(open_, "applied").when(new == F.col("status"), "repeated").otherwise("conflict")
    return rows.withColumn("outcome", outcome).withColumn("status", F.when(open_, F.coalesce(new, "status")).otherwise(F.col("status"))).drop("action")


def seed_registry(existing: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy entities by registry key: created where new, updated where a name or type differs, else kept."""
    old = existing.select("registry_key", F.col("canonical_name").alias("n"), F.col("entity_type").alias("t"))
    rows = policy.join(old, "registry_key", "left")
    same = F.col("canonical_name").eqNullSafe(F.col("n")) & F.col("entity_type").eqNullSafe(F.col("t"))
    return rows.withColumn("action", F.when(F.col("n").isNull(), "created").when(same, "kept").otherwise("updated")).drop("n", "t")
