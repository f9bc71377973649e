"""Best representative of each duplicate group: one surviving value for each event and field.

Two policies over the latest usable claim of each source:

* ``support``: iterative truth discovery. A value's support is the share of reliability that stands behind it within
  its event and field; a source's reliability is the mean support of its claims, drawn toward a prior from its trust
  and tier. The two are estimated in turn until no reliability moves by more than a tolerance; the value with most
  support survives, by its most reliable source.
* ``precedence``: the lower trust number, then the higher evidence of the tier, then the later ``updated_at``, then the
  greater source id. Each claim is ranked by itself, so no vote can change the outcome, none is taken, and one
  aggregate over event and field gives the survivor.

Defined results: claims of null or placeholder value are not usable; a source whose latest claim states no value has
no claim; null trust is taken from the event's members, and counts as lowest if it is missing there too; unknown or
null tiers count as least evidence; doubled rows count once; fields without a usable claim have no row; empty tables
give no rows. Of equally late claims of one source, one that states a value goes first, then the least by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiosko.functions import rules
from kiosko.session import checkpointed, stored

#: Other spellings of the tiers' names.
SPELLINGS = {"ical": "ics", "icalendar": "ics", "json_ld": "jsonld", "ld_json": "jsonld", "json_ld_index": "jsonld_index", "rss2": "rss", "atom": "rss", "css_wrapper": "wrapper", "wordpress": "wp_rest", "wprest": "wp_rest", "rest": "wp_rest"}
#: Texts that say that a value is not known, in lower case.
PLACEHOLDERS = (
    "tba", "tbc", "tbd", "t.b.a.", "t.b.d.", "n.n.b.", "nnb", "n.t.b.", "ntb", "nader te bepalen", "nog niet bekend", "onbekend", "nvt", "n.v.t.", "unknown", "none", "null", "nil",
    "nan", "n/a", "#n/a", "na", "por confirmar", "por determinar", "desconocido", "sin datos", "à confirmer", "a confirmer", "inconnu", "wird noch bekannt gegeben", "unbekannt", "k.a.", "undefined", "to be announced", "to be confirmed",
)
BROADCAST_SOURCES = 50_000


def states_value(claim: Column) -> Column:
    low = F.lower(F.trim(claim))
    return F.coalesce(low.rlike(r"[\p{L}\p{N}]") & ~low.isin(*PLACEHOLDERS), F.lit(False))


def tier_name(tier: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(tier)), r"[^a-z0-9]+", "_")
    spelled = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(spelled, key), key)


def evidence(tier: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in rules.TIER_EVIDENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, tier_name(tier)), F.lit(0.0))


def comparable(field: Column, claim: Column) -> Column:
    """The value in the form in which claims are compared: instants for starts, plain lower-case text for others."""
    text = F.regexp_replace(F.lower(F.trim(claim)), r"\s+", " ")
    return F.when(field == "start", F.coalesce(F.try_to_timestamp(claim).cast("string"), text)).when(field == "price", F.regexp_replace(text, r"[^\d.,]", "")).otherwise(text)


def usable_claims(provenance: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each event, field and source whose latest claim states a value, with trust and evidence."""
    late, usable = F.col("updated_at"), F.col("usable").cast("int")
    rows = provenance.select("event_id", "field", "source_id", "trust", "tier", "claim", "updated_at", states_value(F.col("claim")).alias("usable"))
    late = rows.groupBy("event_id", "field", "source_id").agg(
        F.min_by(F.struct("claim", "usable", "tier", "updated_at"), F.struct(-F.unix_micros(late), -usable, F.col("claim"), F.col("tier"))).alias("c"),
        F.max_by("trust", F.when(F.col("trust").isNotNull(), F.struct(late, usable, -F.col("trust")))).alias("trust"),
    )
    late = late.where("c.usable").select("event_id", "field", "source_id", "trust", "c.claim", "c.tier", "c.updated_at")
    member = events.select(F.col("id").alias("event_id"), F.explode("members").alias("m")).groupBy("event_id", F.col("m.source_id").alias("source_id")).agg(F.min("m.trust").alias("_member_trust"))
    late = late.join(member, ["event_id", "source_id"], "left")
    late = late.withColumn("trust", F.coalesce("trust", "_member_trust", F.lit(99))).drop("_member_trust")
    return late.withColumns({"evidence": evidence(F.col("tier")), "value": comparable(F.col("field"), F.col("claim"))})


def discover(claims: DataFrame, rounds: int = 100, tolerance: float = 1e-3, damping: float = 0.3) -> DataFrame:
    """``claims`` with ``reliability`` of their source and ``support`` of their value.

    Each round is two aggregates, by value and by event and field, and one by source. Reliabilities are a row for each
    source; they are broadcast while they number at most BROADCAST_SOURCES, and joined by shuffle beyond that. Raises
    if the reliabilities have not settled after ``rounds``.
    """
    claims = stored(claims.withColumn("_prior", (F.lit(1.0) / (F.col("trust") + 1)) * (0.5 + F.col("evidence") / 2)))
    now = stored(claims.groupBy("source_id").agg(F.avg("_prior").alias("_prior")).withColumn("reliability", F.col("_prior")))
    small = now.count() <= BROADCAST_SOURCES
    # a value's claims lie in one partition with those of its event and field, so a round shuffles once
    votes = stored(claims.select("event_id", "field", "value", "source_id").repartition("event_id", "field"))

    def supported(known: DataFrame) -> DataFrame:
        cast = votes.join(F.broadcast(known) if small else known, "source_id")
        values = cast.groupBy("event_id", "field", "value").agg(F.sum("reliability").alias("_for"), F.collect_list("source_id").alias("_by"))  # a row for each source
        share = F.col("_for") / F.sum("_for").over(Window.partitionBy("event_id", "field"))
        return values.withColumn("support", share)

    for _ in range(rounds):
        got = supported(now.select("source_id", "reliability")).select(F.explode("_by").alias("source_id"), "support")
        after = now.join(got.groupBy("source_id").agg(F.avg("support").alias("_mean")), "source_id")
        new = damping * F.col("_prior") + (1 - damping) * F.col("_mean")
        after = checkpointed(after.select("source_id", "_prior", new.alias("reliability"), F.abs(F.col("reliability") - new).alias("_moved")))
        moved = after.agg(F.max("_moved")).first()[0]
        now = after.drop("_moved")
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError("reliabilities did not settle")
    known = now.select("source_id", "reliability")
    support = supported(known).select("event_id", "field", F.col("value").alias("_value"), "support")
    scored = claims.join(F.broadcast(known) if small else known, "source_id").join(support, ["event_id", "field"])
    return scored.where(F.col("value").eqNullSafe(F.col("_value"))).drop("_prior", "_value")


def survivors(provenance: DataFrame, events: DataFrame, policy: str = "precedence") -> DataFrame:
    """The surviving claim of each event and field: ``event_id, field, source_id, claim``, with ``support, reliability`` where votes are taken."""
    claims = usable_claims(provenance, events)
    if policy == "precedence":
        order = F.struct(-F.col("trust"), "evidence", "updated_at", "source_id")
        best = claims.groupBy("event_id", "field").agg(F.max_by(F.struct("source_id", "claim"), order).alias("b"))
        return best.select("event_id", "field", "b.*")
    if policy != "support":
        raise ValueError(f"no such policy: {policy}")
    scored = discover(claims)
    order = F.struct("support", "reliability", -F.col("trust"), "evidence", "updated_at", "source_id")
    best = scored.groupBy("event_id", "field").agg(F.max_by(F.struct("source_id", "claim", "support", "reliability"), order).alias("b"))
    return best.select("event_id", "field", "b.*")
