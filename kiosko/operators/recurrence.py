"""Recurring events: expansion to dated occurrences, and the folding of repeated showings."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiosko.functions import keys, rules, text


#: Rules that a sequence of days expresses: daily or weekly, with at most an interval and a count, in any order.
EVEN = r"^(?=.*FREQ=)(?:(?:FREQ=(?:DAILY|WEEKLY)|INTERVAL=[1-9]\d{0,3}|COUNT=[1-9]\d{0,5})(?:;|$))+$"


def _stamp(value: str, zone: dt.tzinfo) -> dt.datetime | None:
    """A compact time of a calendar as local wall clock."""
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z)?)?", value.strip())
    if not m:
        return None
    try:
        at = dt.datetime(*[int(x) for x in m.groups()[:6] if x])
    except ValueError:
        return None
    return at.replace(tzinfo=dt.timezone.utc).astimezone(zone).replace(tzinfo=None) if m.group(7) else at


def wall_dates(start: dt.datetime, rule_text: str | None, zone: dt.tzinfo, now: dt.datetime, horizon_days: int, most: int) -> list[dt.datetime]:
    """The local times of a series from the earlier of its start and now to the horizon; its start alone for no or a bad rule."""
    from dateutil import rrule

    parts: dict[str, list[str]] = {"RRULE": [], "RDATE": [], "EXDATE": []}
    for line in (rule_text or "").splitlines():
        m = re.match(r"\s*(?:(RRULE|RDATE|EXDATE)(?:;[^:]*)?:)?(.+)", line)
        if m and m.group(2).strip():
            parts[m.group(1) or "RRULE"].append(m.group(2).strip())
    if not parts["RRULE"] and not parts["RDATE"]:
        return [start]
    until = lambda m: "UNTIL=" + _stamp(m.group(1), zone).strftime("%Y%m%dT%H%M%S")
    out = rrule.rruleset()
    try:
        for r in parts["RRULE"]:
            out.rrule(rrule.rrulestr(re.sub(r"UNTIL=(\d{8}T\d{6}Z)", until, r), dtstart=start))
    except (ValueError, TypeError, AttributeError):
        return [start]
    if not parts["RRULE"]:
        out.rdate(start)
    for name, put in (("RDATE", out.rdate), ("EXDATE", out.exdate)):
        for v in ",".join(parts[name]).split(","):
            if v and (at := _stamp(v, zone)):
                put(at)
    first, last, got = min(start, now), now + dt.timedelta(days=horizon_days), []
    for at in out:
        if at > last or len(got) >= most:
            break
        if at >= first:
            got.append(at)
    return got or [start]


def expand(events: DataFrame, now: str, horizon_days: int = rules.HORIZON_DAYS, most: int = rules.MOST_OCCURRENCES) -> DataFrame:
    """``event_id, start_local, start_second, seconds`` for each date of events ``id, start_local, end_local, rrule, zone``.

    Events without a rule, and daily and weekly series of an interval and a count, are handled on the JVM; only other
    rules reach Python. Wall-clock times are expanded and then localised, so a series keeps its hour across a change
    of offset.
    """
    import zoneinfo

    at = dt.datetime.fromisoformat(now)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                zone = zoneinfo.ZoneInfo(r.zone)
                start = r.start_local.to_pydatetime()
                here = at.astimezone(zone).replace(tzinfo=None) if at.tzinfo else at
                out += [(r.id, d, int(d.replace(tzinfo=zone, fold=0).timestamp())) for d in wall_dates(start, r.rrule, zone, here, horizon_days, most)]
            yield pd.DataFrame(out, columns=["event_id", "start_local", "start_second"]).astype({"event_id": "object", "start_local": "datetime64[ns]", "start_second": "int64"})

    rule = F.regexp_replace(F.trim("rrule"), "^RRULE:", "")
    kind = F.when(rule.isNull() | (rule == ""), "once").when(rule.rlike(EVEN), "even").otherwise("other")
    rows = events.select("id", "start_local", "rrule", "zone", kind.alias("_kind"), rule.alias("_rule"))
    second = F.unix_timestamp(F.to_utc_timestamp(F.col("start_local").cast("timestamp"), F.col("zone"))).alias("start_second")
    once = rows.where("_kind = 'once'").select(F.col("id").alias("event_id"), "start_local", second)
    part = lambda name: F.nullif(F.regexp_extract("_rule", rf"{name}=(\d+)", 1), F.lit("")).cast("long")
    step = F.when(F.col("_rule").contains("FREQ=WEEKLY"), 7).otherwise(1) * F.coalesce(part("INTERVAL"), F.lit(1))
    last = F.from_utc_timestamp(F.timestamp_seconds(F.lit(int(at.timestamp()) if at.tzinfo else int(at.replace(tzinfo=dt.timezone.utc).timestamp()))), F.col("zone") if at.tzinfo else F.lit("UTC"))
    room = F.floor((F.unix_timestamp(last) + horizon_days * 86400 - F.unix_timestamp(F.col("start_local").cast("timestamp"))) / (86400 * F.col("_step"))) + 1
    even = rows.where("_kind = 'even'").withColumn("_step", step)
    even = even.withColumn("_n", F.greatest(F.least(room, F.coalesce(part("COUNT"), F.lit(most)), F.lit(most)), F.lit(1)))
    even = even.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    even = even.withColumn("start_local", F.expr("start_local + make_dt_interval(cast(_i * _step as int))"))
    many = rows.where("_kind = 'other'").select("id", "start_local", "rrule", "zone").mapInPandas(run, "event_id string, start_local timestamp_ntz, start_second long")
    return once.unionByName(even.select(F.col("id").alias("event_id"), "start_local", second)).unionByName(many)


def occurrences(events: DataFrame, now: str, horizon_days: int = rules.HORIZON_DAYS) -> DataFrame:
    """``id, event_id, start_local, start_second, end_second, is_free, price, cancelled, is_override`` of every date of every event."""
    rows = expand(events, now, horizon_days)
    seconds = (F.unix_timestamp(F.col("end_local").cast("timestamp")) - F.unix_timestamp(F.col("start_local").cast("timestamp"))).alias("_seconds")
    own = events.select(F.col("id").alias("event_id"), seconds, "is_free", "price")
    rows = rows.join(own, "event_id")
    iso = F.date_format("start_local", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(keys.occurrence_id(F.col("event_id"), iso).alias("id"), "event_id", "start_local", "start_second", (F.col("start_second") + F.col("_seconds")).alias("end_second"), "is_free", "price", F.lit(False).alias("cancelled"), F.lit(False).alias("is_override"))


def collapse(records: DataFrame) -> DataFrame:
    """Repeated showings of a title at a venue become the earliest record with the other dates as RDATE.

    ``records`` has ``ordinal, source_id, title, venue_name, start_local, rrule``; the dates of one show at one house
    are gathered as compact strings (a source lists a bounded season; hot groups of different venues stay apart).
    """
    iso = F.date_format("start_local", "yyyyMMdd'T'HHmmss")
    rows = records.withColumns({"_norm": text.normalize_title(F.col("title")), "_venue": F.coalesce("venue_name", F.lit("")), "_at": F.struct("start_local", "ordinal"), "_iso": iso})
    got = rows.groupBy("source_id", "_norm", "_venue").agg(F.min_by(F.struct("ordinal", "title", "venue_name", "start_local", "rrule"), "_at").alias("r"), F.array_sort(F.collect_list(F.struct("_at", "_iso"))).alias("all"))
    extra = F.array_join(F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), lambda x: x["_iso"]), ",")
    rule = F.when(F.size("all") > 1, F.concat_ws("\n", "r.rrule", F.concat(F.lit("RDATE:"), extra))).otherwise(F.col("r.rrule"))
    return got.select("source_id", "r.ordinal", "r.title", "r.venue_name", "r.start_local", rule.alias("rrule"), F.size("all").alias("n_dates"))
