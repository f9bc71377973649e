"""The queries of the llm problems; each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiosko.functions import rules
from kiosko.llm import addresses, encoding, markup, matching, mixing, reading, survivors, tokens, truncation
from kiosko.session import table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(*_t(spark, d, "raw_records")).select("ordinal", "field")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(*_t(spark, d, "raw_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    raw, pages = _t(spark, d, "raw_records", "tudelft_events")
    return markup.found(markup.descriptions(raw, pages), markup.learn_weights(pages)).distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    raw, pages = _t(spark, d, "raw_records", "tudelft_events")
    return markup.marked_up(markup.descriptions(raw, pages), markup.learn_weights(pages)).select("origin", "row_id", "clean")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(*_t(spark, d, "canonical_events", "registry")).where("cut").select("event_id", "field").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = truncation.judged(*_t(spark, d, "canonical_events", "registry"))
    return rows.groupBy("source", "field").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(*_t(spark, d, "raw_records", "registry")).select("ordinal_a", "ordinal_b")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(*_t(spark, d, "raw_records", "registry"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return matching.classes(*_t(spark, d, "raw_records", "registry"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(*_t(spark, d, "field_provenance", "canonical_events")).select("event_id", "field", "source_id")


def p5_supported(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(*_t(spark, d, "field_provenance", "canonical_events"), policy="support")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_location(*_t(spark, d, "venues", "registry"))


def p7_locations(spark: SparkSession, d: str) -> DataFrame:
    """Class rows of problem 7: the location of each venue and the number of venues there."""
    return addresses.location_classes(*_t(spark, d, "venues", "registry"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_ids(table(spark, d, "documents").select("doc_id", "text"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(*_t(spark, d, "documents", "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_t(spark, d, "documents", "mix_targets"))


def p9_shares_capped(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the sources hold together: scarce sources are repeated to their cap, the others share the rest."""
    return mixing.shares(*_t(spark, d, "documents", "mix_targets"), total="all")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(*_t(spark, d, "documents", "reading_labels")).where(F.col("level") >= reading.HARD).select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(*_t(spark, d, "documents", "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (p1_found, p1_restored, p2_found, p2_clean, p3_found, p3_rates, p4_found, p4_matches, p4_classes, p5_found, p5_supported, p7_found, p7_locations, p8_ids, p9_mixture, p9_shares, p9_shares_capped, p10_found, p10_levels)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    """The survivor rule is plain SQL; the other operators have no SQL form and are tested against brute force."""
    places = ", ".join("'" + p.replace("'", "''") + "'" for p in survivors.PLACEHOLDERS)
    spelled = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in survivors.SPELLINGS.items())
    rank = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TIER_EVIDENCE.items())
    return {
        "p5_found": f"""
WITH latest AS (
  SELECT event_id, field, source_id, tier, claim, updated_at,
         max(trust) OVER (PARTITION BY event_id, field, source_id) AS any_trust, trust,
         coalesce(regexp_matches(claim, '[\\p{{L}}\\p{{N}}]') AND lower(trim(claim)) NOT IN ({places}), false) AS usable,
         rank() OVER (PARTITION BY event_id, field, source_id ORDER BY updated_at DESC) AS r
  FROM field_provenance),
one AS (
  SELECT event_id, field, source_id, max(updated_at) AS updated_at, max(coalesce(trust, any_trust)) AS trust,
         max(regexp_replace(lower(trim(tier)), '[^a-z0-9]+', '_', 'g')) AS tier
  FROM latest WHERE r = 1 AND usable GROUP BY ALL),
member AS (SELECT id AS event_id, m.source_id AS source_id, min(m.trust) AS trust FROM (SELECT id, unnest(members) AS m FROM canonical_events) GROUP BY ALL),
ranked AS (
  SELECT o.event_id, o.field, o.source_id, coalesce(o.trust, m.trust, 99) AS trust, o.updated_at,
         CASE CASE o.tier {spelled} ELSE o.tier END {rank} ELSE 0 END AS evidence
  FROM one o LEFT JOIN member m USING (event_id, source_id))
SELECT event_id, field, source_id FROM ranked
QUALIFY row_number() OVER (PARTITION BY event_id, field ORDER BY trust, evidence DESC, updated_at DESC, source_id DESC) = 1"""
    }
