"""Mixed timestamp texts to one instant in UTC.

Parsing is done with built-in expressions, so it stays inside code generation. A parsed text is either an instant
(it carried an offset or was a count of seconds) or a local time with a zone. Local times meet the offset intervals
of their zone in an as-of join: two intervals that hold the local time mean that it occurs twice (the first is
taken), none means that it was skipped (the offset before the change is taken), one gives the offset directly.

Defined results: null, empty and blank texts, dates alone, times alone, texts without a time and impossible dates
give no row (``instants`` gives null). Unknown zones give null. Tables without rows give no rows. Columns besides
those named are carried through untouched; names that begin with ``_t_`` are used for work columns.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1950, 2100
#: Hours east of UTC of the zone abbreviations that name one offset.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "AST": -4}
#: Month names in English, Dutch, German, French and Spanish; texts are matched by their first letters.
MONTHS = {
    1: "jan januari january januar janvier janv enero ene",
    2: "feb februari february februar février fevrier févr febrero",
    3: "mar mrt maart march märz maerz mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mei mai mayo",
    6: "jun juni june juin junio",
    7: "jul juli july juillet juil julio",
    8: "aug augustus august août aout agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct okt oktober october octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec dez dic déc december dezember décembre decembre diciembre",
}

_ISO = r"^(?:TZID=([A-Za-z0-9_/+\-]+):)?(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,4})?(?:\[[^\]]*\])?$"
_NUM = r"^(\d{1,2})([/.\-])(\d{1,2})[/.\-](\d{4}|\d{2}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp]\.?[Mm]\.?)?(?:\s*Uhr)?$"
_TXT = r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})\.?\s+(?:de\s+)?(\p{L}{3,})\.?\s+(?:de\s+)?(\d{4}),?\s+(?:at\s+|à\s+|om\s+|um\s+|a las\s+)?(\d{1,2})(?:[:.hu](\d{2}))?(?::(\d{2}))?\s*(am|pm|AM|PM|uur|Uhr|h)?\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,4})?$"


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _seconds(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Seconds since 1970 of a local time, null where date or clock time is impossible."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    return F.when(ok, F.unix_date(F.make_date(y, m, d)).cast("long") * 86400 + h * 3600 + mi * 60 + s)


def _hour(h: Column, half: Column) -> Column:
    """Hour of the day from a twelve-hour clock where ``half`` says am or pm; null for 0 or 13 with am or pm."""
    half = F.lower(F.substring(half, 1, 1))
    twelve = h.between(1, 12)
    return F.when(half == "a", F.when(twelve, h % 12)).when(half == "p", F.when(twelve, h % 12 + 12)).otherwise(h)


def _offset(z: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``+0100``, ``-04:00`` or an abbreviation; null for none or an unknown one."""
    digits = F.regexp_replace(z, ":", "")
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    number = sign * (F.substring(digits, 2, 2).cast("int") * 3600 + F.substring(digits, 4, 2).cast("int") * 60)
    names = reduce(lambda acc, kv: acc.when(z == kv[0], kv[1] * 3600), ABBREVIATIONS.items(), F.when(F.lit(False), 0))
    return F.when(z.rlike(r"^[+-]\d"), number).otherwise(names)


def _month(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda acc, kv: acc.when(low.isin(*kv[1].split()), kv[0]), MONTHS.items(), F.when(F.lit(False), 0))


def _order_votes(text: Column) -> tuple[Column, Column, Column]:
    """Whether a numeric date proves day first, proves month first, or has a twelve-hour clock."""
    a, b = _int(F.regexp_extract(text, _NUM, 1)), _int(F.regexp_extract(text, _NUM, 3))
    date = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{4}$"
    a = F.coalesce(a, _int(F.regexp_extract(text, date, 1)))
    b = F.coalesce(b, _int(F.regexp_extract(text, date, 2)))
    return (a > 12) & (b <= 12), (b > 12) & (a <= 12), F.regexp_extract(text, _NUM, 8) != ""


def month_first_by_source(values: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """``source, month_first``: the order of day and month of each source, by the dates that prove one.

    One row for each source, from all values; a source without proof counts as month first only if most of its
    numeric dates carry a twelve-hour clock.
    """
    t = F.trim(F.col(text))
    rows = values.where(t.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d")).select(F.col(source).alias(source), t.alias("_t"))
    day, month, half = _order_votes(F.col("_t"))
    votes = rows.groupBy(source).agg(F.count_if(day).alias("d"), F.count_if(month).alias("m"), F.count_if(half).alias("h"), F.count("*").alias("n"))
    return votes.select(source, F.when(F.col("d") != F.col("m"), F.col("m") > F.col("d")).otherwise(F.col("h") * 2 > F.col("n")).alias("month_first"))


def with_parsed(rows: DataFrame, text: str, month_first: str) -> DataFrame:
    """``rows`` with ``_t_zone_in``, ``_t_local`` and ``_t_utc`` (seconds) of a text, null where it states no date with a clock time.

    ``_t_utc`` is set where the text says the instant itself; else ``_t_local``, with the zone where it is named.
    Each text meets one pattern, which rewrites it to nine parts; every step is a projection of its own, so that
    no expression is evaluated twice.
    """
    t, c = F.col("_t_text"), F.col("_t_parts")
    digit = F.substring(t, 1, 1).between("0", "9")
    rows = rows.withColumn("_t_text", F.trim(F.col(text)))
    kind = (
        F.when(F.length(t) < 10, None)
        .when(t.rlike(r"^\d{10}$|^\d{13}$"), "count")
        .when(t.rlike(r"^\d{4}-?\d{2}-?\d{2}[T ]") | t.startswith("TZID="), "iso")
        .when(digit & t.rlike(r"^\d{1,2}[/.\-]\d"), "num")
        .otherwise("txt")
    )
    rows = rows.withColumn("_t_kind", kind)
    # year | month | day | hour | minute | second | offset | am or pm | zone
    parts = (
        F.when(F.col("_t_kind") == "iso", F.regexp_replace(t, _ISO, "$2|$3|$4|$5|$6|$7|$8||$1"))
        .when(F.col("_t_kind") == "num", F.regexp_replace(t, _NUM, "$4|$3|$1|$5|$6|$7||$8|"))
        .when(F.col("_t_kind") == "txt", F.regexp_replace(t, _TXT, "$3|$2|$1|$4|$5|$6|$8|$7|"))
    )
    rows = rows.withColumn("_t_parts", F.split(parts, r"\|", -1))
    rows = rows.withColumn("_t_parts", F.when(F.size("_t_parts") == 9, F.col("_t_parts")))
    swap = (F.col("_t_kind") == "num") & F.coalesce(F.col(month_first), F.lit(False))
    number = lambda i: F.when(c[i].rlike(r"^\d+$"), c[i].cast("int"))
    rows = rows.withColumns({
        "_t_n0": number(0), "_t_n2": number(2), "_t_n3": number(3), "_t_n4": F.coalesce(number(4), F.lit(0)), "_t_n5": F.coalesce(number(5), F.lit(0)),
        "_t_n1": F.when(F.col("_t_kind") == "txt", _month(c[1])).otherwise(number(1)),
        "_t_half": F.when(c[7].rlike(r"(?i)^[ap]\.?m"), F.lower(F.substring(c[7], 1, 1))), "_t_off": _offset(c[6]), "_t_zone_in": F.when(c[8] != "", c[8]),
    })
    n = [F.col(f"_t_n{i}") for i in range(6)]
    rows = rows.withColumns({
        "_t_y": F.when(n[0] < 100, n[0] + 2000).otherwise(n[0]), "_t_m": F.when(swap, n[2]).otherwise(n[1]),
        "_t_d": F.when(swap, n[1]).otherwise(n[2]), "_t_h": _hour(n[3], F.col("_t_half")),
    })
    rows = rows.withColumn("_t_s", _seconds(F.col("_t_y"), F.col("_t_m"), F.col("_t_d"), F.col("_t_h"), n[4], n[5]))
    count = F.when(F.length(t) == 13, F.floor(F.expr("try_cast(_t_text as bigint)") / 1000)).otherwise(F.expr("try_cast(_t_text as bigint)"))
    utc = F.when(F.col("_t_kind") == "count", count.cast("long")).when(c[6] != "", F.col("_t_s") - F.col("_t_off"))
    rows = rows.withColumns({"_t_utc": utc, "_t_local": F.when(c[6] == "", F.col("_t_s"))})
    work = ["_t_text", "_t_kind", "_t_parts", "_t_half", "_t_off", "_t_y", "_t_m", "_t_d", "_t_h", "_t_s", *[f"_t_n{i}" for i in range(6)]]
    return rows.drop(*work)


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(zone, year, spans): the offset intervals that touch each local year of a zone; years outside count as the outermost."""
    utc, far = dt.timezone.utc, 1 << 40
    for batch in batches:
        out: list[tuple] = []
        for zone in batch["zone"]:
            try:
                z = zoneinfo.ZoneInfo(zone)
            except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
                continue

            def off(s: int, z=z) -> int:
                return int(dt.datetime.fromtimestamp(s, utc).astimezone(z).utcoffset().total_seconds())

            step, lo = 86400 * 14, int(dt.datetime(FIRST_YEAR - 1, 1, 1, tzinfo=utc).timestamp())
            end = int(dt.datetime(LAST_YEAR + 1, 12, 31, tzinfo=utc).timestamp())
            spans, begin, at, now = [], -far, lo, off(lo)
            while at < end:
                if (new := off(at + step)) != now:
                    a, b = at, at + step
                    while b - a > 1:
                        mid = (a + b) // 2
                        a, b = (mid, b) if off(mid) == now else (a, mid)
                    spans.append((begin, b, now))
                    begin, now = b, off(b)
                    at = b
                    continue
                at += step
            spans.append((begin, far, now))
            for year in range(FIRST_YEAR, LAST_YEAR + 1):
                y0 = -far if year == FIRST_YEAR else int(dt.datetime(year, 1, 1, tzinfo=utc).timestamp()) - 2 * 86400
                y1 = far if year == LAST_YEAR else int(dt.datetime(year + 1, 1, 1, tzinfo=utc).timestamp()) + 2 * 86400
                out += [(zone, year, i, a + o, b + o, o) for i, (a, b, o) in enumerate(spans) if a < y1 and b > y0]
        yield pd.DataFrame(out, columns=["zone", "year", "i", "lo", "hi", "offset"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """``zone, year, spans``: spans are the offset intervals (local bounds) of that year, in order of time."""
    rows = zones.select("zone").where(F.col("zone").isNotNull()).distinct().mapInPandas(_intervals, "zone string, year int, i int, lo long, hi long, offset long")
    return rows.groupBy("zone", "year").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi", "offset"))).alias("spans"))


def instants(values: DataFrame, zones: DataFrame, text: str = "text", source: str = "source_id", zone: str = "zone", dates: bool = False) -> DataFrame:
    """``values`` with ``utc_second`` (null where the text states no instant), and with ``dates`` also ``stated_date``.

    ``values`` has the text, its source and the zone that holds where the text names none. ``zones`` (column
    ``zone``) are the zones that may occur; zones named inside texts are added. Both lookups are small: one row for
    each source, and one for each zone and year of the public zone database (at most 600 zones); they are broadcast.
    """
    order = month_first_by_source(values, source, text).withColumnsRenamed({source: "_t_source", "month_first": "_t_month_first"})
    named = values.where(F.col(text).startswith("TZID=")).select(F.regexp_extract(text, _ISO, 1).alias("zone")).where("zone <> ''")
    spans = zone_intervals(zones.select("zone").union(named))
    spans = spans.select(F.col("zone").alias("_t_zone"), F.col("year").alias("_t_year"), F.col("spans").alias("_t_spans"))
    rows = values.join(F.broadcast(order), values[source].eqNullSafe(order["_t_source"]), "left").drop("_t_source")
    if dates:
        rows = _with_date(rows, text)
    rows = with_parsed(rows, text, "_t_month_first")
    rows = rows.withColumn("_t_in", F.coalesce(F.col("_t_zone_in"), F.col(zone)))
    rows = rows.withColumn("_t_y", F.least(F.greatest(F.year(F.date_from_unix_date(F.floor(F.col("_t_local") / 86400).cast("int"))), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))
    rows = rows.join(F.broadcast(spans), (F.col("_t_in") == F.col("_t_zone")) & (F.col("_t_y") == F.col("_t_year")), "left")
    local = F.col("_t_local")
    rows = rows.withColumn("_t_holds", F.filter("_t_spans", lambda s: (s["lo"] <= local) & (local < s["hi"])))
    before = F.element_at(F.filter("_t_spans", lambda s: s["hi"] <= local), -1)["offset"]
    offset = F.when(F.size("_t_holds") > 0, F.get("_t_holds", F.lit(0))["offset"]).otherwise(before)
    rows = rows.withColumn("utc_second", F.when(F.col("_t_utc").isNotNull(), F.col("_t_utc")).when(local.isNotNull(), local - offset))
    return rows.drop(*[c for c in rows.columns if c.startswith("_t_")])


def stated_times(raw: DataFrame, madrid: DataFrame, registry: DataFrame) -> DataFrame:
    """``origin, row_id, field, utc_second`` of every value of both tables that states a date and a clock time."""
    zone = F.coalesce(F.col("timezone"), F.lit("Europe/Amsterdam"))
    known = registry.select(F.col("id").alias("_id"), zone.alias("zone"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_raw").alias("text")) for f in ("start", "end")])
    a = raw.select(F.lit("raw_records").alias("origin"), F.col("ordinal").alias("row_id"), "source_id", F.explode(pairs).alias("v"))
    a = a.select("origin", "row_id", "source_id", "v.*").where(F.col("text").isNotNull())
    a = a.join(F.broadcast(known), a["source_id"] == known["_id"], "left").withColumn("zone", F.coalesce("zone", F.lit("Europe/Amsterdam"))).drop("_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("dtstart", "dtend")])
    b = madrid.select(F.lit("madrid_ayuntamiento_api").alias("origin"), "row_id", F.lit("*madrid").alias("source_id"), F.explode(pairs).alias("v"), F.lit("Europe/Madrid").alias("zone"))
    b = b.select("origin", "row_id", "source_id", "v.*", "zone").where(F.col("text").isNotNull())
    zones = known.select("zone").union(registry.sparkSession.createDataFrame([("Europe/Madrid",)], "zone string"))
    rows = instants(a.unionByName(b), zones)
    return rows.where(F.col("utc_second").isNotNull()).select("origin", "row_id", "field", "utc_second")


def stated_dates(values: DataFrame, text: str = "text", source: str = "source_id") -> DataFrame:
    """``values`` with ``stated_date`` of texts that state a date alone (null for all others)."""
    order = month_first_by_source(values, source, text).withColumnsRenamed({source: "_t_source", "month_first": "_t_month_first"})
    rows = values.join(F.broadcast(order), values[source].eqNullSafe(order["_t_source"]), "left").drop("_t_source")
    return _with_date(rows, text).drop("_t_month_first")


def _with_date(rows: DataFrame, text: str) -> DataFrame:
    t = F.trim(F.col(text))
    plain = r"^(\d{4})-?(\d{2})-?(\d{2})$"
    swapped = F.when(F.coalesce("_t_month_first", F.lit(False)), F.regexp_replace(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", "$3-$1-$2")).otherwise(F.regexp_replace(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", "$3-$2-$1"))
    iso = F.when(t.rlike(plain), F.regexp_replace(t, plain, "$1-$2-$3")).when(t.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}$"), swapped)
    return rows.withColumn("_t_iso", iso).withColumn("stated_date", F.expr("try_cast(_t_iso as date)")).drop("_t_iso")
