"""The read surface: filters, pages, joins and groupings over events, occurrences and venues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventQuery:
    """What to read; unset fields do not filter. ``after`` is the last (start second, id) of the page before."""

    city: str | None = None
    category: str | None = None
    is_free: bool | None = None
    q: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    min_sources: int | None = None
    begin: int | None = None
    end: int | None = None
    after: tuple[int, str] | None = None
    limit: int = 50

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 200:
            raise ValueError("limit must be from 1 to 200")


def live(events: DataFrame) -> DataFrame:
    return events.where("withdrawn_at is null")


def filtered(events: DataFrame, query: EventQuery) -> DataFrame:
    """Live events that fit; every condition is a plain predicate, so it reaches the scan. An unset free flag fits neither yes nor no."""
    rows, second = live(events), F.unix_seconds("start_at")
    if query.city is not None:
        rows = rows.where(F.lower("city") == query.city.lower())
    if query.category is not None:
        rows = rows.where(F.col("category") == query.category)
    if query.is_free is not None:
        rows = rows.where(F.col("is_free") == query.is_free)
    if query.q is not None:
        rows = rows.where(F.col("title").ilike(f"%{query.q}%") | F.col("venue_name").ilike(f"%{query.q}%"))
    if query.bbox is not None:
        south, west, north, east = query.bbox
        rows = rows.where(F.col("venue_lat").between(south, north) & F.col("venue_lon").between(west, east))
    if query.min_sources is not None:
        rows = rows.where(F.size("source_ids") >= query.min_sources)
    if query.begin is not None:
        rows = rows.where(F.col("start_at") >= F.timestamp_seconds(F.lit(query.begin)))
    if query.end is not None:
        rows = rows.where(F.col("start_at") <= F.timestamp_seconds(F.lit(query.end)))
    if query.after is not None:
        rows = rows.where(F.struct(second, F.col("id")) > F.struct(F.lit(query.after[0]).cast("long"), F.lit(query.after[1])))
    return rows


def page(events: DataFrame, query: EventQuery) -> DataFrame:
    """One page in order of start and id, with one row more to tell whether there is another."""
    return filtered(events, query).orderBy("start_at", "id").limit(query.limit + 1)


def first_given(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def venue_counts(venues: DataFrame, events: DataFrame) -> DataFrame:
    """Every venue with the number of its live events."""
    n = live(events).groupBy("venue_id").agg(F.count("*").alias("event_count"))
    return venues.join(n, venues["id"] == n["venue_id"], "left").select("id", "name", "city", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def venue_page(venues: DataFrame, events: DataFrame, city: str | None = None, has_coords: bool | None = None, bbox: tuple[float, float, float, float] | None = None, limit: int = 200) -> DataFrame:
    """Venues with the number of their live events, most events first, then by name and id."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    rows = venues if city is None else venues.where(F.lower("city") == city.lower())
    if has_coords is not None:
        rows = rows.where(F.col("lat").isNotNull() if has_coords else F.col("lat").isNull())
    if bbox is not None:
        west, south, east, north = bbox
        rows = rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return venue_counts(rows, events).orderBy(F.desc("event_count"), "name", "id").limit(limit)


def upcoming(venue: DataFrame, occurrences: DataFrame, events: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """What is on at venues from now: dates that are not cancelled of live events, with the first price given by date,
    series and venue, and the free flag of the date, else of the series."""
    e = live(events).select(F.col("id").alias("event_id"), "title", "category", "venue_id", F.col("price").alias("_series_price"), F.col("is_free").alias("_series_free"), F.size(F.array_distinct("source_ids")).cast("long").alias("source_count"))
    o = occurrences.where((F.col("start_second") >= now) & ~F.coalesce(F.col("cancelled"), F.lit(False))).select(F.col("id").alias("occurrence_id"), "event_id", "start_second", F.col("price").alias("_price"), F.col("is_free").alias("_free"))
    v = venue.select(F.col("id").alias("venue_id"), "default_price")
    rows = o.join(e, "event_id").join(v, "venue_id")
    rows = rows.select("venue_id", "occurrence_id", "event_id", "title", "category", "start_second", first_given(F.col("_price"), F.col("_series_price"), F.col("default_price")).alias("price"), F.coalesce("_free", "_series_free").alias("is_free"), "source_count")
    return rows if limit is None else rows.orderBy("start_second", "occurrence_id").limit(limit)


def event_rows(events: DataFrame) -> DataFrame:
    """Events as they are handed out: the venue nested, a short list of members, and the number of sources."""
    venue = F.struct(F.col("venue_id").alias("id"), F.col("venue_name").alias("name"), F.col("venue_lat").alias("lat"), F.col("venue_lon").alias("lon"))
    short = F.transform(F.coalesce("members", F.array()), lambda m: F.struct(m["source_id"].alias("source_id"), m["trust"].alias("trust"), m["title"].alias("title")))
    return events.select("id", "title", F.col("start_iso").alias("start"), F.unix_seconds("end_at").alias("end_second"), "city", "url", "is_free", "price", "rrule", "category", "confidence", venue.alias("venue"), "source_ids", F.size(F.array_distinct("source_ids")).cast("long").alias("source_count"), short.alias("sources"))


def etag(rows: DataFrame) -> DataFrame:
    """One row ``etag``: the same for the same rows in any order, another for any change. A sum of row digests, so that
    nothing is gathered."""
    cols = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    got = rows.select(F.xxhash64(cols).cast("decimal(38,0)").alias("h"), F.crc32(cols).cast("decimal(38,0)").alias("c")).agg(F.sum("h").alias("h"), F.sum("c").alias("c"), F.count("*").alias("n"))
    return got.select(F.substring(F.sha2(F.concat_ws("|", "h", "c", "n"), 256), 1, 32).alias("etag"))


def header_counts(events: DataFrame, now: int) -> DataFrame:
    """The counters over a list: live events, those to come, free ones, those of several sources, and their venues."""
    second = F.unix_seconds("start_at")
    return live(events).agg(F.count("*").alias("events"), F.count_if(second >= now).alias("to_come"), F.count_if(F.col("is_free")).alias("free"), F.count_if(F.size("source_ids") >= 2).alias("corroborated"), F.count_distinct("venue_id").alias("venues"))


def markers(events: DataFrame, most: int = 12) -> DataFrame:
    """A map marker for each venue (by id, else by name): number of events, most sources, first titles by start."""
    key = F.coalesce("venue_id", F.concat(F.lit("n:"), F.col("venue_name")))
    rows = live(events).where("venue_id is not null or venue_name is not null").select(key.alias("marker"), F.struct("start_at", "id", "title").alias("e"), F.size("source_ids").cast("long").alias("n"))
    # a running top, not the whole group: ranks within the marker are cut before gathering
    from pyspark.sql import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("marker").orderBy("e.start_at", "e.id")))
    return ranked.groupBy("marker").agg(F.count("*").alias("n_events"), F.max("n").alias("most_sources"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", F.col("e.title").alias("title"))))).alias("t")).select("marker", "n_events", "most_sources", F.array_join(F.transform("t", lambda x: x["title"]), " / ").alias("titles"))
