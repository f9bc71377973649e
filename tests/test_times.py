import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kiosko.operators import times

REGISTRY = [("a", "Europe/Amsterdam"), ("us", "Europe/London"), ("m", None), ("u", "UTC")]


def second(text: str) -> int:
    return int(dt.datetime.fromisoformat(text).timestamp())


def run(spark, rows):
    values = spark.createDataFrame(rows, "source_id string, text string, zone string, extra int")
    zones = spark.createDataFrame([("Europe/Amsterdam",), ("UTC",)], "zone string")
    return {(r.source_id, r.text): r.utc_second for r in times.instants(values, zones).collect()}


CASES = [
    ("2026-03-04T20:00:00+01:00", "2026-03-04T19:00:00+00:00"), ("2026-03-04 20:00", "2026-03-04T19:00:00+00:00"), ("2026-07-04 20:00:00.0", "2026-07-04T18:00:00+00:00"), ("20260704T200000Z", "2026-07-04T20:00:00+00:00"),
    ("20260704T200000", "2026-07-04T18:00:00+00:00"), ("1785542400", "2026-08-01T00:00:00+00:00"), ("1785542400000", "2026-08-01T00:00:00+00:00"), ("TZID=America/Curacao:20260704T200000", "2026-07-05T00:00:00+00:00"),
    ("2026-07-04T20:00+02:00[Europe/Brussels]", "2026-07-04T18:00:00+00:00"), ("Sun, 05 Apr 2026 16:00:00 +0100", "2026-04-05T15:00:00+00:00"), ("2026-06-14 14:30 WEST", "2026-06-14T13:30:00+00:00"), ("zo 19 jul 2026 17u00", "2026-07-19T15:00:00+00:00"),
    ("sábado, 31 de octubre de 2026, 22:00 h", "2026-10-31T21:00:00+00:00"), ("27 December 2025 at 2.30pm", "2025-12-27T13:30:00+00:00"), ("22 January 2027 at 7pm", "2027-01-22T18:00:00+00:00"), ("maandag 12 april 2027, 21.00 uur", "2027-04-12T19:00:00+00:00"),
    ("20.09.2026, 19:00 Uhr", "2026-09-20T17:00:00+00:00"), ("dimanche 16 août 2026 à 11h00", "2026-08-16T09:00:00+00:00"), ("25-12-25 20:00", "2025-12-25T19:00:00+00:00"), ("2026-08-03T16:30:00.000+0000", "2026-08-03T16:30:00+00:00"),
    ("2026-10-25 02:30", "2026-10-25T00:30:00+00:00"), ("2026-03-29 02:30", "2026-03-29T01:30:00+00:00"), ("  2026-03-04 20:00 ", "2026-03-04T19:00:00+00:00"),
]
NONE = ["2026-03-04", "20260304", "23:00", "TBA", "", "   ", "0000-00-00 00:00:00", "31-02-2026 20:00", "2026-02-30T20:00:00Z", "doorlopend", "2026-03-04 25:00", "13/13/2026 20:00", "x" * 5000, "03/04/2026 13:00 PM"]


def test_forms(spark):
    got = run(spark, [("a", t, "Europe/Amsterdam", 1) for t, _ in CASES] + [("a", t, "Europe/Amsterdam", 2) for t in NONE])
    assert {t: got["a", t] for t, _ in CASES} == {t: second(x) for t, x in CASES}
    assert all(got["a", t] is None for t in NONE)


def test_order_of_day_and_month_is_the_sources(spark):
    rows = [("us", "12/25/2026 8:00 PM", "UTC", 0), ("us", "03/04/2026 8:00 PM", "UTC", 0), ("eu", "25/12/2026 20:00", "UTC", 0), ("eu", "03/04/2026 20:00", "UTC", 0), ("eu", "03/04/2026 12:00 AM", "UTC", 0)]
    got = run(spark, rows)
    assert got["us", "03/04/2026 8:00 PM"] == second("2026-03-04T20:00:00+00:00")
    assert got["eu", "03/04/2026 20:00"] == second("2026-04-03T20:00:00+00:00")
    assert got["eu", "03/04/2026 12:00 AM"] == second("2026-04-03T00:00:00+00:00")


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    values = spark.createDataFrame([(None, None, None, 1), ("a", "2026-03-04 20:00", None, 1), ("a", "2026-03-04 20:00", "No/Zone", 1)], "source_id string, text string, zone string, year int")
    zones = spark.createDataFrame([("Europe/Amsterdam",), (None,), ("No/Zone",)], "zone string")
    got = times.instants(values, zones)
    assert got.columns == ["source_id", "text", "zone", "year", "utc_second"] and [r.utc_second for r in got.collect()] == [None] * 3
    assert times.instants(values.limit(0), zones.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3_000_000_000), min_size=20, max_size=20))
def test_against_the_zone_database(spark, seconds):
    import zoneinfo

    z = zoneinfo.ZoneInfo("Europe/Amsterdam")
    local = [dt.datetime.fromtimestamp(s, z).replace(tzinfo=None) for s in seconds]
    got = run(spark, [("a", x.isoformat(" "), "Europe/Amsterdam", 0) for x in local])
    for x in local:
        assert got["a", x.isoformat(" ")] == int(x.replace(tzinfo=z, fold=0).timestamp())


def test_dates_alone(spark):
    values = spark.createDataFrame([("a", "2026-03-04"), ("a", "20260304"), ("a", "25-12-2026"), ("a", "03/04/2026"), ("a", "2026-02-30"), ("a", "2026-03-04 20:00")], "source_id string, text string")
    got = {r.text: r.stated_date and r.stated_date.isoformat() for r in times.stated_dates(values).collect()}
    assert got == {"2026-03-04": "2026-03-04", "20260304": "2026-03-04", "25-12-2026": "2026-12-25", "03/04/2026": "2026-04-03", "2026-02-30": None, "2026-03-04 20:00": None}
