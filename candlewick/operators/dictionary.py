"""A small term table: attaching terms to event values, and its own checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a term may declare.
TYPES = ["NOUN", "VERB", "STATE", "MEASURE", "EVENT", "REASON", "DECISION", "STATUS", "CLASSIFICATION"]
COMPONENTS = [
    "INGESTION", "RUNTIME", "D01", "D02", "D04", "ADAPTIVE_EMITTER", "PRICE_ENGINE", "VOLUME_ENGINE", "MODEL_HOST", "OPERATIONS", "VIEWER",
]
LIFECYCLE = ["ACTIVE", "RESERVED", "TEST_ONLY", "LEGACY", "UNREACHABLE"]
PERSISTENCE = ["PERSIST", "RENDER_ONLY"]


def annotate_events(values: DataFrame, terms: DataFrame, value: str = "value") -> DataFrame:
    """Left join of event values with terms, by term text or alias.

    Exactly one canonical match is KNOWN, several REVIEW, none MISSING.
    Presentation-only terms never match.  The join side holds one row per name.
    """
    names = (
        terms.filter(~F.col("presentation_only"))
        .select("id", "display", F.explode(F.array_union(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
        .groupBy("_name")
        .agg(F.count("*").alias("_n"), F.min("id").alias("term_id"), F.min("display").alias("display"))
    )
    # One value may fill a third of all events: each distinct value is looked up once, and the answer
    # comes back to its events by a join that carries one small row per value, which adaptive execution splits.
    found = (
        values.groupBy(F.col(value).alias("_value")).agg(F.lit(1).alias("_one")).drop("_one")
        .join(names, F.col("_value") == F.col("_name"), "left")
        .withColumn("finding", F.when(F.col("_n") == 1, "KNOWN").when(F.col("_n") > 1, "REVIEW").otherwise("MISSING"))
        .withColumns({c: F.when(F.col("finding") == "KNOWN", F.col(c)) for c in ("term_id", "display")})
        .drop("_n", "_name")
    )
    return values.join(found, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")


def dictionary_checks(terms: DataFrame) -> DataFrame:
    """Problems as (id, problem); an empty result means the table is sound."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = [
        (blank("id"), "missing id"),
        (blank("term") | blank("display") | blank("plain_meaning") | blank("scientific_meaning"), "missing required meaning fields"),
        (blank("tooltip") | blank("popover_title") | blank("popover_body"), "missing UI text"),
        (~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "invalid type"),
        (~F.coalesce(F.col("component").isin(COMPONENTS), F.lit(False)), "invalid component"),
        (~F.coalesce(F.col("lifecycle_status").isin(LIFECYCLE), F.lit(False)), "invalid lifecycle_status"),
        (~F.coalesce(F.col("persistence_policy").isin(PERSISTENCE), F.lit(False)), "invalid persistence_policy"),
        (F.coalesce(F.col("scientific_meaning").startswith("UNRESOLVED"), F.lit(False)), "scientific_meaning is UNRESOLVED"),
        (F.col("presentation_only") & (F.size("canonical_source_ids") == 0), "presentation alias missing canonical_source_ids"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, text) for bad, text in rules]))
    rowwise = terms.select("id", F.explode(found).alias("problem"))
    repeated = terms.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))

    def unresolved(column: str, text: str) -> DataFrame:
        refs = terms.select("id", F.explode(column).alias("_ref"))
        known = terms.select(F.col("id").alias("_ref")).distinct()
        return refs.join(known, "_ref", "left_anti").select("id", F.concat(F.lit(text), F.col("_ref")).alias("problem"))

    return (
        rowwise.unionByName(repeated)
        .unionByName(unresolved("related_terms", "related term does not resolve: "))
        .unionByName(unresolved("canonical_source_ids", "canonical source does not resolve: "))
    )
