import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kiosko.operators import audit, geography, graph, measures, reading, recurrence, resolve, state


def union_find(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(50)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], [(5, 5), (1, 2), (2, 1), (1, 2)]):
        nodes = range(90)
        got = graph.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
        assert {r.node: r.component for r in got.collect()} == union_find(edges, nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(1,)], "node long")).collect() == [(1, 1)]


V = "struct<name string, address string, city string, lat double, lon double, geocode_source string, default_price string, notes string>"
RAW = f"ordinal long, source_id string, source_type string, trust int, title string, start_raw string, end_raw string, rrule string, description string, venue {V}, price string, is_free boolean, url string"


def raw(spark):
    house = ("Wijnhaven", None, None, 52.01, 4.36, None, None, None)
    rows = [
        (1, "gem", "jsonld", 1, "Jazzavond Wijnhaven", "2026-09-04T20:00:00+02:00", None, None, "kort", house, None, None, None),
        (2, "krant", "rss", 4, "De Jazzavond in de Wijnhaven", "2026-09-04 20:00", None, None, "een langere tekst", None, "€ 5", None, "u"),
        (3, "zaal", "api", 2, "Jazzavond @ Wijnhaven (live)", "2026-09-04 20:30", None, None, None, house, None, False, None),
        (4, "krant", "rss", 4, "Poppentheater Rood", "2026-09-04 20:00", None, None, None, None, None, None, None),
        (5, "zaal", "api", 2, None, "2026-09-04 20:00", None, None, None, None, None, None, None), (6, "zaal", "api", 2, "X", None, None, None, None, None, None, None, None),
    ]
    registry = [(i, "Delft", None, "nl") for i in ("gem", "krant", "zaal")]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame(registry, "id string, city string, timezone string, locale string")


def test_three_listings_make_one_event(spark):
    got = resolve.deduplicate(*raw(spark)).orderBy("title").collect()
    assert [(r.title, r.n_members, r.n_sources) for r in got] == [("Jazzavond Wijnhaven", 3, 3), ("Poppentheater Rood", 1, 1)]
    e = got[0]
    assert e.confidence == 1.0 and e.description == "een langere tekst" and e.price == "€ 5" and e.is_free is False and e.venue.city == "Delft" and e.start_iso == "2026-09-04T20:00:00+02:00"
    df, reg = raw(spark)
    assert resolve.deduplicate(df.limit(0), reg).count() == 0


def test_order_of_records_does_not_matter(spark):
    df, reg = raw(spark)
    a = {r.id for r in resolve.deduplicate(df, reg).collect()}
    assert a == {r.id for r in resolve.deduplicate(df.orderBy(F.desc("ordinal")), reg).collect()}


def test_upsert_replace_withdraw(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", None, "y")], "id int, name string, lat double, city string")
    new = spark.createDataFrame([(1, "A", None, "z"), (3, "c", 3.0, None)], "id int, name string, lat double, city string")
    got = state.upsert(old, new, "id", keep=("lat",), fixed=("city",))
    assert sorted(map(tuple, got.collect())) == [(1, "A", 1.0, "x"), (2, "b", None, "y"), (3, "c", 3.0, None)]
    assert sorted(state.upsert(got, new, "id", keep=("lat",), fixed=("city",)).collect()) == sorted(got.collect())
    pinned = spark.createDataFrame([(1, "own", True), (2, "old", False)], "id int, v string, is_override boolean")
    assert sorted(r.v for r in state.replace_unless_pinned(pinned, spark.createDataFrame([(1, "new", False), (4, "new4", False)], "id int, v string, is_override boolean")).collect()) == ["new4", "own"]
    ts = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    events = spark.createDataFrame([("a", ["s"], None), ("b", ["s", "f"], None), ("c", ["s"], ts), ("d", ["s"], ts), ("e", [], None)], "id string, source_ids array<string>, withdrawn_at timestamp")
    seen, ok = spark.createDataFrame([("c",)], "id string"), spark.createDataFrame([("s",)], "source_id string")
    got = {r.id: r.withdrawn_at is not None for r in state.withdraw_unseen(events, seen, ok, F.timestamp_seconds(F.lit(1785542400))).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_revisions(spark):
    rows = spark.createDataFrame([("e", "t", 1, "a"), ("e", "t", 2, "a"), ("e", "t", 3, None), ("e", "t", 4, "b")], "e string, f string, at int, v string")
    got = state.revisions(rows, ["e", "f"], "v", ["at"]).orderBy("at").collect()
    assert [(r.at, r.old_value, r.new_value) for r in got] == [(1, None, "a"), (3, "a", None), (4, None, "b")]


def series(spark, rule, start="2026-09-01 20:00:00", now="2026-08-01T00:00:00+00:00", days=90):
    e = spark.createDataFrame([("e", dt.datetime.fromisoformat(start), None, rule, "Europe/Amsterdam", None, None)], "id string, start_local timestamp_ntz, end_local timestamp_ntz, rrule string, zone string, is_free boolean, price string")
    return [(r.start_local, r.start_second) for r in recurrence.expand(e, now, days).orderBy("start_second").collect()]


def test_recurrence(spark):
    assert len(series(spark, "FREQ=WEEKLY;BYDAY=TU;COUNT=10")) == 9 and len(series(spark, "FREQ=WEEKLY;BYDAY=TU;COUNT=10", days=120)) == 10
    dst = series(spark, "RRULE:FREQ=WEEKLY;COUNT=3", "2026-10-20 20:00:00")
    assert {d.hour for d, _ in dst} == {20} and dst[1][1] - dst[0][1] == 7 * 86400 + 3600
    assert len(series(spark, "RRULE:FREQ=WEEKLY;COUNT=4\nEXDATE:20260908T200000")) == 3 and len(series(spark, "RDATE:20260903T200000,20260905T200000")) == 3
    assert len(series(spark, None)) == len(series(spark, "")) == len(series(spark, "no rule")) == 1
    assert len(series(spark, "FREQ=WEEKLY;UNTIL=20260922T180000Z")) == 4 and [d.month for d, _ in series(spark, "FREQ=MONTHLY;BYMONTHDAY=31", "2027-01-31 20:00:00", "2027-01-01T00:00:00+00:00", 120)] == [1, 3]
    assert len(series(spark, "FREQ=DAILY", days=5000)) == 400


def test_collapse(spark):
    r = [(i, "s", "De Film" if i % 2 else "Film", "Huis", dt.datetime(2026, 9, 10 - i, 20), None) for i in range(4)] + [(9, "s", "Film", None, dt.datetime(2026, 9, 1, 20), "RRULE:FREQ=DAILY")]
    got = recurrence.collapse(spark.createDataFrame(r, "ordinal long, source_id string, title string, venue_name string, start_local timestamp_ntz, rrule string")).orderBy("ordinal").collect()
    assert [(g.ordinal, g.n_dates) for g in got] == [(3, 4), (9, 1)] and got[0].rrule == "RDATE:20260908T200000,20260909T200000,20260910T200000" and got[1].rrule == "RRULE:FREQ=DAILY"


def events(spark, n=23):
    rows = [(f"e{i:03d}", "Delft" if i % 2 else "delft", f"Titel {i}", dt.datetime(2026, 9, 1 + i % 28, 18, tzinfo=dt.timezone.utc), f"v{i % 2}", f"Zaal {i % 2}", i % 5 == 0 or None, ["a", "b"] if i % 3 == 0 else ["a"], "theatre" if i % 2 else "film", None, 52.0 + i / 1000, 4.3) for i in range(n)]
    return spark.createDataFrame(rows, "id string, city string, title string, start_at timestamp, venue_id string, venue_name string, is_free boolean, source_ids array<string>, category string, withdrawn_at timestamp, venue_lat double, venue_lon double")


def test_pages_hold_every_event_once(spark):
    df, seen, after = events(spark), [], None
    while True:
        got = reading.page(df, reading.EventQuery(after=after, limit=5)).collect()
        seen += [r.id for r in got[:5]]
        if len(got) <= 5:
            break
        after = (int(got[4].start_at.timestamp()), got[4].id)
    assert sorted(seen) == [f"e{i:03d}" for i in range(23)]
    with pytest.raises(ValueError):
        reading.EventQuery(limit=0)


def test_filters_reach_the_scan(spark, tmp_path):
    df = events(spark)
    count = lambda **k: reading.filtered(df, reading.EventQuery(**k)).count()
    assert count(city="DELFT") == 23 and count(is_free=True) == 5 and count(is_free=False) == 0 and count(min_sources=2) == 8 and count(category="film") == 12 and count(q="titel 1") == 11 and count(bbox=(52.0, 4.0, 52.005, 5.0)) == 6
    df.write.parquet(str(tmp_path / "e"))
    plan = reading.filtered(spark.read.parquet(str(tmp_path / "e")), reading.EventQuery(category="film")).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(category,film)" in plan


def test_measures(spark):
    runs = [(i, "up", n, True, 0) for i, n in enumerate([20, 19, 21, 20, 22, 0])] + [(10 + i, "half", n, True, 0) for i, n in enumerate([20, 20, 20, 20, 10])] + [(20 + i, "fail", n, o, 0) for i, (n, o) in enumerate([(30, True)] * 5 + [(0, False)] * 3)] + [(40, "new", 1, True, 0)]
    df = spark.createDataFrame(runs, "id long, source_id string, records int, ok boolean, x int")
    assert {(r.source_id, r.kind) for r in measures.yield_regressions(df, "source_id").collect()} == {("up", "collapsed"), ("half", "degraded")}
    assert {r.source_id: r.failures for r in measures.breakage(df, "source_id").collect()}["fail"] == 3
    city = spark.createDataFrame([("Delft", None, True), ("Rotterdam", None, False), (None, "Plein 1, Den Haag", False), (None, "Plein 1", True), (None, None, True), ("", "x delft", True)], "c string, a string, want boolean")
    assert all(r.got == r.want for r in city.withColumn("got", measures.in_target_city(F.col("c"), F.col("a"), "Delft")).collect())


H = "id long, source string, city string, second long, norm string, in_scope boolean, venue string, is_free boolean"


def listed(spark, rows):
    full = [(i, src, "Delft", s, t, scope, v, f) for i, src, s, t, scope, v, f in rows]
    return spark.createDataFrame(full, H)


def test_same_event_recall_and_capture(spark):
    hour = 3600
    held = listed(spark, [(1, "h", 10 * hour, "jazz avond wijnhaven", True, None, None), (2, "h", 10 * hour, "jazz avond", True, None, None), (3, "h", 10 * hour, "poppentheater rood", True, None, None), (4, "h", 10 * hour, "elders", False, None, None), (5, "h", -1, "te vroeg", True, None, None), (6, "h", 91 * 24 * hour, "te laat", True, None, None), (7, "h", 10 * hour, "", True, None, None)])
    corpus = listed(spark, [(90, "c", 16 * hour, "wijnhaven jazz avond live", True, None, None), (91, "c", 16 * hour + 1, "poppentheater rood", True, None, None), (92, "c", 10 * hour, "jazz", True, None, None), (93, "c", 10 * hour, "poppenkast rood", True, None, None)])
    got = {(r.a, r.b) for r in measures.same_event(held, corpus).collect()}
    # at six hours, not a second more; a title inside another counts, one that is merely like it (0.77) does not
    assert got == {(1, 90), (2, 90), (1, 92), (2, 92)}
    assert [(r.source, r.total, r.matched, r.out_of_scope, r.recall) for r in measures.recall(held, corpus, 0).collect()] == [("h", 4, 2, 1, 0.5)]
    assert {r.id for r in measures.misses(held, corpus, 0).collect()} == {3, 7}
    c = measures.capture_recapture(held, corpus, 8, 0).first()
    assert (c.n_a, c.n_b, c.overlap, c.estimate, c.coverage) == (4, 4, 2, 8.0, 1.0)
    none = measures.capture_recapture(held.where("id = 3"), corpus, 8, 0).first()
    assert none.estimate is None and none.coverage is None
    assert measures.recall(held.limit(0), corpus, 0).count() == 0 and measures.same_event(held, corpus.limit(0)).count() == 0


def test_evaluation_pairs_greedily_and_asks_fields(spark):
    gold = listed(spark, [(1, "a", 0, "jazz avond", True, "Zaal Rood", True), (2, "a", 0, "jazz avond wijnhaven", True, "Kerk", None), (3, "b", 0, "lezing", True, None, False)])
    made = listed(spark, [(7, None, 1800, "jazz avond", True, "zaal rood (delft)", False), (8, None, 1801, "wijnhaven jazz avond", True, "Theater", None), (9, None, 0, "quiz", True, None, None)])
    assert {(r.a, r.b) for r in measures.paired(gold, made).collect()} == {(1, 7), (2, 8)}
    e = measures.evaluate(gold, made).first()
    assert (e.matched, e.missed, e.spurious, e.precision, e.recall, e.f1) == (2, 1, 1, 0.666667, 0.666667, 0.666667)
    assert (e.start_right, e.venue_right, e.free_right) == (0.5, 0.5, 0.0)
    assert {r.source: (r.found, r.total) for r in measures.recall_by_source(gold, made).collect()} == {"a": (2, 2), "b": (0, 1)}
    nothing = measures.evaluate(gold, made.limit(0)).first()
    assert (nothing.matched, nothing.precision, nothing.f1) == (0, 0.0, 0.0)


def test_unknown_trust_comes_last_and_events_carry_their_sources(spark):
    df, reg = raw(spark)
    df = df.withColumn("trust", F.when(F.col("source_id") == "gem", None).otherwise(F.col("trust")))
    e = [r for r in resolve.deduplicate(df, reg).collect() if r.n_members == 3][0]
    assert e.title == "Jazzavond @ Wijnhaven (live)" and e.source_ids == ["gem", "krant", "zaal"] and e.category == "music"
    known = reg.withColumn("trust", F.when(F.col("id") == "gem", 1).otherwise(3))
    assert [r.title for r in resolve.deduplicate(df, known).collect() if r.n_members == 3] == ["Jazzavond Wijnhaven"]
    rows = resolve.claims(df, known)
    m = resolve.members(rows, resolve.clusters(rows)).where("cluster = 1").orderBy("position").collect()
    assert [(r.position, r.source_id) for r in m] == [(1, "gem"), (2, "zaal"), (3, "krant")]


def test_distance_in_time_is_that_of_instants(spark):
    df, reg = raw(spark)
    reg = reg.withColumn("timezone", F.when(F.col("id") == "zaal", "America/Curacao"))
    rows = df.where("ordinal in (1, 3)").withColumn("start_raw", F.when(F.col("ordinal") == 3, "2026-09-04 14:30").otherwise(F.col("start_raw")))
    assert [r.n_members for r in resolve.deduplicate(rows, reg).collect()] == [2]  # 20:00 in Amsterdam, 20:30 there
    late = rows.withColumn("start_raw", F.when(F.col("ordinal") == 3, "2026-09-04 20:00").otherwise(F.col("start_raw")))
    assert [r.n_members for r in resolve.deduplicate(late, reg).collect()] == [1, 1]  # one clock, six hours apart


def test_origins_and_history(spark):
    rows = [("e", "title", "a", 2, "rss", "De Jazz!"), ("e", "title", "b", None, "ics", "Poppen"), ("e", "title", "c", 2, "ics", "jazz"), ("e", "start", "a", 1, "rss", "2026-09-01T20:10:00+02:00"), ("e", "start", "b", 3, "rss", "2026-09-01T18:50:00Z"), ("e", "start", "c", 3, "rss", "2026-09-01T21:00:00+02:00"), ("e", "url", "a", 1, "rss", "")]
    df = spark.createDataFrame(rows, "event_id string, field string, source_id string, trust int, tier string, claim string")
    got = {r.field: (r.value, r.source_id, r.agreeing, r.dissenting) for r in resolve.origins(df).collect()}
    assert got == {"title": ("jazz", "c", 2, 1), "start": ("2026-09-01T20:10:00+02:00", "a", 2, 1)}
    log = spark.createDataFrame([("e", "title", None, "x", 1, 1), ("e", "title", "x", "jazz", 2, 2), ("e", "start", None, "2026-09-01T20:00:00+02:00", 1, 3)], "event_id string, field string, old_value string, new_value string, changed_at int, id int")
    new = resolve.recorded(resolve.origins(df), log, F.lit(9)).collect()
    assert [(r.field, r.old_value, r.new_value) for r in new] == [("start", "2026-09-01T20:00:00+02:00", "2026-09-01T20:10:00+02:00")]
    assert resolve.recorded(resolve.origins(df), log.limit(0), F.lit(9)).where("old_value is null").count() == 2
    assert [r.new_value for r in resolve.history(log, "e").collect()] == ["jazz"]


def test_near_venues_equal_brute_force(spark):
    from kiosko.functions import similarity

    rng = random.Random(4)
    names = {"theater roodhuis"}
    while len(names) < 150:
        base = rng.choice(sorted(names))
        i = rng.randrange(len(base))
        names.add(rng.choice([base[:i] + rng.choice("abc ") + base[i:], base[:i] + base[i + 1 :], "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 30)))]).strip() or "x")
    norm = {" ".join(w for w in n.split() if w not in ("de", "het")) for n in names}
    got = {(r.a, r.b) for r in audit.near_venues(spark.createDataFrame([(n,) for n in norm], "name string")).collect()}
    assert got == {(a, b) for a in norm for b in norm if a < b and similarity.ratio(a, b) > 90} and len(got) > 20


def test_near_venues_of_one_kind_and_town_are_not_all_compared(spark):
    from kiosko.functions import similarity

    rng = random.Random(8)
    stem = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    names = {f"galerie {stem()} puerto calima" for _ in range(300)} | {f"театр {stem()}" for _ in range(100)} | {"zaal 1", "zaal 2", "x" * 40 + " zaal", "x" * 37 + " zaal", "ab", "abc"}
    for n in sorted(names)[:60]:
        i = rng.randrange(len(n))
        names |= {n[:i] + rng.choice("abж") + n[i:], n[:i] + n[i + 1 :], n[: i // 2] + n[i // 2 + 1 : i] + n[i + 1 :]}
    names = {" ".join(n.split()) for n in names}
    want = {(a, b) for a in names for b in names if a < b and similarity.ratio(a, b) > 90}
    compared = {(r.a, r.b) for r in audit.near_candidates(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len(want) > 100 and want <= compared and len(compared) < len(names) * (len(names) - 1) / 20  # a tenth of all pairs


def test_first_of_month_is_a_check_of_the_corpus(spark):
    v = spark.createDataFrame([], "id string, name string, city string, lat double, lon double")
    r = spark.createDataFrame([], "id string, enabled boolean")
    rows = [row(i, start=f"2026-{1 + i % 12:02d}-{1 if i < 8 else 3 + i % 20:02d} 20:00:00") for i in range(40)]
    found = lambda x: {y.check: y["count"] for y in audit.audit(spark.createDataFrame(x, E), v, r, 0).collect()}
    assert found(rows)["temporal.first_of_month_cluster"] == 8 and "temporal.first_of_month_cluster" not in found(rows[2:] + rows[20:38])


def test_stamps_of_places(spark):
    from kiosko.functions import keys

    P = "struct<name string, address string, city string, lat double, lon double, geocode_source string, default_price string, notes string>"
    df = spark.createDataFrame([(1, "a", ("Zaal Rood", None, None, None, None, None, None, None)), (2, "a", ("Zaal Rood", None, "Delft", 1.0, 2.0, None, None, None)), (3, "a", ("De Kelder", None, "Delft", None, None, None, None, None)), (4, "b", None), (5, "zz", ("Nergens", None, None, None, None, None, None, None))], f"ordinal long, source_id string, venue {P}")
    reg = spark.createDataFrame([("a", "Delft"), ("b", "Delft")], "id string, city string")
    cache = spark.createDataFrame([("Zaal Rood Delft", "Delft", 52.0, 4.3, "pdok")], "n string, c string, lat double, lon double, source string").select(keys.venue_key(F.col("n"), F.col("c")).alias("id"), "lat", "lon", "source")
    hand = spark.createDataFrame([("Kelder", 52.1, 4.4)], "name string, lat double, lon double")
    got = {r.ordinal: r.venue and (r.venue.city, r.venue.lat, r.venue.geocode_source) for r in geography.stamped(df, reg, cache, hand).collect()}
    assert got == {1: ("Delft", 52.0, "pdok"), 2: ("Delft", 1.0, None), 3: ("Delft", 52.1, "override"), 4: None, 5: (None, None, None)}


def test_geography(spark):
    v = spark.createDataFrame([("Café X | Delft — Officiële site", "Plein 1", "Delft"), ("De kerk", None, "Delft"), ("Delft", "", "Delft")], "n string, a string, c string")
    got = [(r.name, r.q) for r in v.withColumn("name", geography.clean_name(F.col("n"), F.col("c"))).withColumn("q", geography.ladder(F.col("name"), F.col("a"), F.col("c"))).collect()]
    assert got[0] == ("Café X", ["Café X, Plein 1, Delft", "Café X, Delft", "Plein 1, Delft"]) and got[1][1] == []
    asked = spark.createDataFrame([("k", "Zaal Rood", "Plein 1", "Delft")], "id string, name string, address string, city string")
    answers = spark.createDataFrame([("Zaal Rood, Plein 1, Delft", "POINT(5.9 51.0)"), ("Zaal Rood, Delft", "POINT(4.36 52.01)"), ("Plein 1, Delft", "POINT(4.35 52.0)")], "query string, wkt string")
    assert geography.answered(asked, answers).collect() == [("k", 52.01, 4.36)]


BAD = {
    "non_event.editorial_url": dict(start="2026-09-01 00:00:00", venue_name=None, url="https://x/nieuws/a"), "non_event.editorial_title": dict(title="Waarom gaat het zo?"), "non_event.longform_no_venue": dict(description="x" * 1600, venue_name=None),
    "temporal.past": dict(second=1), "temporal.far_future": dict(second=1785542400 + 500 * 86400), "temporal.small_hours": dict(start="2026-09-01 03:00:00"), "temporal.end_before_start": dict(end="2026-09-01 10:00:00"), "temporal.long_duration": dict(end="2026-09-02 12:00:00"),
    "text.mojibake": dict(title="CafÃ© X"), "text.html_entities": dict(title="Jazz &amp; Blues"), "text.raw_html": dict(description="een <p>alinea"), "text.title_shape": dict(title="HELE GROTE LETTERS"), "text.title_truncated": dict(title="Een avond vol…"),
    "text.title_is_date_or_venue": dict(title="zaal rood"), "text.whitespace_punct": dict(title="Een  avond"), "consistency.free_with_price": dict(is_free=True, price="€ 5"), "dedup.same_source_cluster": dict(members=[("a", "x", "2026-09-01T20:00:00+02:00")] * 2),
    "dedup.over_merge_time": dict(members=[("a", "x", "2026-09-01T20:00:00+02:00"), ("b", "x", "2026-09-01T10:00:00+02:00")]), "dedup.over_merge_title": dict(members=[("a", "poppen theater", "2026-09-01T20:00:00+02:00"), ("b", "jazz avond", "2026-09-01T20:00:00+02:00")]),
}
E = "id string, city string, title string, start_local timestamp_ntz, end_local timestamp_ntz, second long, description string, venue_id string, venue_name string, url string, is_free boolean, price string, category string, source_ids array<string>, members array<struct<source_id string, title string, start_iso string>>"


def row(i, **k):
    d = dict(title=f"Jazzavond nummer {i}", start="2026-09-01 20:00:00", end=None, second=1788000000, description=None, venue_id=None, venue_name="Zaal Rood", url=None, is_free=None, price=None, members=[("a", "x", "2026-09-01T20:00:00+02:00")]) | k
    at = dt.datetime.fromisoformat
    return (f"e{i}", "Delft", d["title"], at(d["start"]), d["end"] and at(d["end"]), d["second"], d["description"], d["venue_id"], d["venue_name"], d["url"], d["is_free"], d["price"], "music", [f"s{i}"], d["members"])


def test_audit(spark):
    venues = spark.createDataFrame([("v", "Theater Roodhuis", "Delft", 52.0, 4.36), ("w", "Theater Roodhuiz", "Delft", 51.0, 4.36), ("x", "www.a.nl", "Delft", None, None)], "id string, name string, city string, lat double, lon double")
    registry = spark.createDataFrame([("s0", True), ("stil", True), ("uit", False)], "id string, enabled boolean")
    ok = spark.createDataFrame([row(0, title="Poppentheater voor kinderen")], E)
    clean = {r.check: r.severity for r in audit.audit(ok, venues.where("id = 'v'"), registry.where("id = 's0'"), 1785542400).collect()}
    assert "ERROR" not in clean.values(), clean
    df = spark.createDataFrame([row(i, **k) for i, k in enumerate(BAD.values())] + [row(50, title="Jazz in de tuin van het huis"), row(51, title="Jazz in de tuin van het huizen"), row(52, venue_id="weg"), row(52)], E)
    got = {r.check: r for r in audit.audit(df, venues, registry, 1785542400).collect()}
    for check in [*BAD, "dedup.missed_merges", "venue.near_duplicates", "venue.outside_bbox", "venue.bad_name", "consistency.orphan_venue_ref", "consistency.duplicate_ids", "volume.silent_source", "distribution.category"]:
        assert check in got and got[check]["count"] >= 1 and 1 <= len(got[check].examples) <= 5, check
    counts = audit.audit(df, venues, registry, 1785542400, examples=False)
    assert counts.columns == ["check", "severity", "count"] and {r.check: r["count"] for r in counts.collect()} == {k: r["count"] for k, r in got.items()}
    assert audit.audit(df.limit(0), venues.limit(0), registry.limit(0), 0).count() == 0


def test_stream(spark, tmp_path):
    from kiosko.streaming import runs

    rows = [("a", dt.datetime(2026, 1, d, 10, tzinfo=dt.timezone.utc), d % 2 == 0) for d in range(1, 9)]
    spark.createDataFrame(rows, "source_id string, ran_at timestamp, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, ran_at timestamp, ok boolean").parquet(str(tmp_path / "in"))
    runs.to_parquet(runs.failures_by_window(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got and all(r.runs == 1 for r in got) and len(got) >= 4


def test_even_series_equal_the_general_way(spark):
    import zoneinfo

    now = dt.datetime.fromisoformat("2026-08-01T00:00:00+00:00")
    zone = zoneinfo.ZoneInfo("Europe/Amsterdam")
    for rule in ("FREQ=DAILY", "FREQ=WEEKLY;COUNT=3", "RRULE:FREQ=DAILY;INTERVAL=3;COUNT=500", "COUNT=2;FREQ=WEEKLY;INTERVAL=2"):
        for start in ("2026-10-20 02:30:00", "2024-01-01 20:00:00", "2027-05-01 20:00:00", "2026-10-30 00:00:00"):
            at = dt.datetime.fromisoformat(start)
            want = recurrence.wall_dates(at, rule, zone, now.astimezone(zone).replace(tzinfo=None), 90, 400)
            got = series(spark, rule, start)
            assert [d for d, _ in got] == want, (rule, start)
            assert [s for _, s in got] == [int(d.replace(tzinfo=zone, fold=0).timestamp()) for d in want]
