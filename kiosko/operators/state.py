"""State: upserts, soft deletes, change history and the run log, as functions from old and new tables to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), fixed: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: new values win; columns of ``keep`` stay where the new value is null,
    columns of ``fixed`` stay as they were first written. Of several new rows with one key, callers choose before."""
    o, n = old.select([F.col(c).alias(f"_o_{c}") for c in old.columns]), new.select([F.col(c).alias(f"_n_{c}") for c in new.columns])
    both = o.join(n, o[f"_o_{key}"] == n[f"_n_{key}"], "full_outer")
    there = F.col(f"_n_{key}").isNotNull()

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o_{c}")
        if c == key or c in keep:
            return F.coalesce(f"_n_{c}", f"_o_{c}")
        if c in fixed:
            return F.when(F.col(f"_o_{key}").isNotNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))
        return F.when(there, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))

    return both.select([pick(c).alias(c) for c in old.columns])


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order; a window over keys, so no group is gathered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_unless_pinned(old: DataFrame, new: DataFrame, key: str = "id", pinned: str = "is_override") -> DataFrame:
    """Old pinned rows and all new rows whose key is not pinned."""
    kept = old.where(F.coalesce(F.col(pinned), F.lit(False)))
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def persist_events(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Events of a run over those stored: new values win, the venue's reference stays where a run gives none, every event
    seen is live again, and ``last_seen`` is now."""
    rows = upsert(old, new, "id", keep=("venue_id",))
    seen = new.select(F.col("id").alias("_id")).distinct()
    rows = rows.join(seen, rows["id"] == seen["_id"], "left")
    return rows.withColumns({"withdrawn_at": F.when(F.col("_id").isNull(), F.col("withdrawn_at")), "last_seen": F.when(F.col("_id").isNotNull(), now).otherwise(F.col("last_seen"))}).drop("_id")


def run_status(status: Column) -> Column:
    """STRUCT<ok, records> of the status line of a source: its number of records, or what failed."""
    ok = ~(status.startswith("FAILED") | status.startswith("ERROR") | status.startswith("no payload"))
    first = F.substring_index(status, " ", 1)
    return F.struct(ok.alias("ok"), F.when(ok & first.rlike(r"^\d+$"), first.try_cast("int")).otherwise(0).alias("records"))


def appended(history: DataFrame, runs: DataFrame) -> DataFrame:
    """The run history ``id, source_id, ran_at, records, ok`` with the runs of a cycle added, ids going on from the last."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    w = Window.orderBy("source_id", "ran_at")  # a row for each source of one cycle
    new = runs.withColumn("_n", F.row_number().over(w)).crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_n"))
    return history.unionByName(new.select(history.columns))


def without_withdrawn(occurrences: DataFrame, events: DataFrame) -> DataFrame:
    """The dates of events that are live, and those set by hand."""
    live = events.where("withdrawn_at is null").select(F.col("id").alias("event_id"))
    pinned = occurrences.where(F.coalesce("is_override", F.lit(False)))
    return pinned.unionByName(occurrences.where(~F.coalesce("is_override", F.lit(False))).join(live, "event_id", "left_semi").select(occurrences.columns))


def withdraw_unseen(events: DataFrame, seen: DataFrame, settled: DataFrame, now: Column, city: str | None = None) -> DataFrame:
    """Events (of a city, if one is named) not seen this time and listed only by sources that ran or were retired get
    ``withdrawn_at``; seen ones lose it."""
    listed = events.select("id", F.explode("source_ids").alias("source_id"))
    blocked = listed.join(settled.select("source_id").distinct(), "source_id", "left_anti").select("id").distinct().withColumn("_blocked", F.lit(True))
    got = events.join(seen.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left").join(blocked, "id", "left")
    gone = F.col("_seen").isNull() & F.col("_blocked").isNull() & (F.size("source_ids") > 0)
    if city is not None:
        gone = gone & (F.lower("city") == city.lower())
    stamp = F.when(F.col("_seen"), F.lit(None)).when(gone, F.coalesce("withdrawn_at", now)).otherwise(F.col("withdrawn_at"))
    return got.withColumn("withdrawn_at", stamp).drop("_seen", "_blocked")


def orphans(occurrences: DataFrame, live: DataFrame) -> DataFrame:
    """Occurrences without a live event, pinned ones aside."""
    return occurrences.where(~F.coalesce("is_override", F.lit(False))).join(live.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def revisions(claims: DataFrame, key: list[str], value: str, order: list) -> DataFrame:
    """Each change of a value along an order: ``old_value`` (null for the first) and ``new_value``; unchanged claims leave no row."""
    w = Window.partitionBy(*key).orderBy(*order)
    was = F.lag(value).over(w)
    rows = claims.withColumn("old_value", was).withColumn("_first", F.row_number().over(w) == 1)
    return rows.where(F.col("_first") | ~F.col("old_value").eqNullSafe(F.col(value))).withColumnRenamed(value, "new_value").drop("_first")


def run_state(runs: DataFrame, source: str, ok: str, at: str, id_: str) -> DataFrame:
    """``last_attempt, last_success, records`` of each source; a failure keeps the last success."""
    return runs.groupBy(source).agg(F.max(at).alias("last_attempt"), F.max(F.when(F.col(ok), F.col(at))).alias("last_success"), F.max_by("records", id_).alias("records"), F.count("*").alias("runs"))
