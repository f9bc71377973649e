import datetime as dt
import itertools

from pyspark.sql import functions as F

from kiosko.llm import addresses, matching, survivors, truncation

TOWNS = [("s1", "Delft", "NL"), ("s2", "Kesterham", "GB"), ("s3", "Madrid", "ES"), ("s4", "Lindenbrück", "DE"), ("s5", "Valmont-sur-Lys", "BE"), ("s6", None, None)]


def registry(spark):
    return spark.createDataFrame([(i, c, k, None if i == "s1" else "UTC" if i == "s5" else "Europe/Madrid", "nl") for i, c, k in TOWNS], "id string, city string, country string, timezone string, locale string")


SAME = [
    [("z1", "Zaal", "Delft", "Langeweg 2468, Delft"), ("z2", "Zaal", "Delft", "Langeweg 2468")],
    [("a1", "Zaal Rood", "Delft", "Valdusosgracht no. 147, 7384 CD Delft"), ("a2", "ZAAL ROOD", None, "7384CD Delft, Valdusôsgr. 147"), ("a3", "Zaal Rood, Kelder", " delft", "Kelder, Valdusosgracht 147"), ("a4", "Bar B", "Delft", "7384 cd 147"), ("a5", "Zaal Rood", "Delft", "Valudsosgracht 147, Delft (NL)"), ("a6", "Zaal Rood", "Delft", "Valdusosgracht, 7384 CD Delft")],
    [("b1", "Hall", "Kesterham", "177 C FENAMN SQ., KS15 4BE KESTERHAM"), ("b2", "Hall X", "Kesterham", "177c Fenamn Square, KS15 4BE Kesterham")],
    [("c1", "Cine", "Madrid", "Pza. Toesgos, 76 - 71742 Madrid"), ("c2", "Sala", "Madrid", "Sala 2, Plaza de Toesgos nº 76, 71742 Madrid")],
    [("d1", "Saal", "Lindenbrück", "Girlobu-Str. 135\n97587 Lindenbrück"), ("d2", "Saal", None, "97587 lindenbruck, Girlobustraße 135")],
]
OTHER = [("y1", "Zaal", "Delft", "Hoofdstraat 1234, 2611 AB Delft"), ("y2", "Zaal", "Delft", "Hoofdstraat 1235, 2611 AB Delft"), ("x1", "Zaal Rood", "Delft", "Valdusosgracht 149, 7384 CD Delft"), ("x2", "Zaal Rood", "Kesterham", "147 Valdusos Road, KS1 1AA Kesterham"), ("x3", "Leeg", "Delft", None), ("x4", "Leeg", "Delft", "  "), ("x5", "N", "Delft", "Valdusosgracht 147a, 7384 CD Delft"), ("x6", None, None, "???")]


def test_locations(spark):
    rows = [r for g in SAME for r in g] + OTHER
    df = spark.createDataFrame([*rows, rows[0]], "id string, name string, city string, address string")
    got = {(r.venue_a, r.venue_b) for r in addresses.same_location(df, registry(spark)).collect()}
    want = {p for g in SAME for p in itertools.combinations(sorted(r[0] for r in g), 2)}
    assert got == want
    assert addresses.same_location(df.limit(0), registry(spark)).count() == 0


PROV = "event_id string, field string, source_id string, trust int, tier string, claim string, updated_at timestamp"


def at(day: int) -> dt.datetime:
    return dt.datetime(2026, 1, day, tzinfo=dt.timezone.utc)


def test_survivors(spark):
    rows = [
        ("e", "title", "a", 2, "rss", "A", at(3)), ("e", "title", "b", 2, "JSON-LD", "B", at(1)), ("e", "title", "c", None, "ics", "C", at(9)), ("e", "title", "a", 2, "rss", "A", at(3)),
        ("e", "url", "a", 1, "ics", "x", at(1)), ("e", "url", "a", 1, "ics", "n.n.b.", at(2)), ("e", "url", "b", 5, "prose", "y", at(1)), ("e", "price", "a", 1, "ics", "—", at(1)), ("e", "price", "b", 1, "ics", None, at(1)),
        ("e", "venue", "a", 3, "ical", "V", at(1)), ("e", "venue", "b", 3, "ld+json", "W", at(2)),
    ]
    events = spark.createDataFrame([("e", [("c", 5), ("a", 2)])], "id string, members array<struct<source_id string, trust int>>")
    df = spark.createDataFrame(rows, PROV)
    got = {r.field: r.source_id for r in survivors.survivors(df, events).collect()}
    assert got == {"title": "b", "url": "b", "venue": "b"}
    assert survivors.survivors(df.limit(0), events).count() == 0


def test_truth_discovery_prefers_what_reliable_sources_say(spark):
    rows = [(f"e{i}", "title", s, 3, "api", "right" if s in "abc" else f"wrong{s}", at(1)) for i in range(20) for s in "abcde"]
    rows += [("z", "title", "a", 3, "api", "good", at(1)), ("z", "title", "d", 3, "api", "bad", at(1))]
    events = spark.createDataFrame([], "id string, members array<struct<source_id string, trust int>>")
    got = {r.event_id: r.claim for r in survivors.survivors(spark.createDataFrame(rows, PROV), events, "support").collect()}
    assert got["z"] == "good" and got["e3"] == "right"


V = "struct<name string, address string, city string>"


def test_matching(spark):
    rows, n = [], 0
    for k in range(40):  # forty shows, each listed by two sources, and another show in the same house on that day
        name, other, day = f"Vor{chr(97 + k % 26)}elgam Kas{chr(97 + k // 26)}umor", f"Pin{chr(97 + k % 26)}tolle Draw{chr(97 + k // 26)}ebun", f"2026-{1 + k % 12:02d}-{1 + k % 27:02d}"
        house = (f"Zaal Huis{chr(97 + k % 26)}or{chr(97 + k // 26)}", None, "Madrid")
        rows += [(n, "s2", f"Jazzavond: {name}", f"{day}T20:00:00+01:00", house), (n + 1, "s3", f"{name.upper()} | {house[0]}", f"{day} 20:30", house if k % 3 else None), (n + 2, "s3", f"Lezing: {other}", f"{day} 20:30", house)]
        n += 3
    rows += [(n, "s2", None, "2026-01-01 20:00", None), (n + 1, "s3", "X", None, None), (n + 2, "s3", "", "TBA", None)]
    df = spark.createDataFrame(rows, f"ordinal long, source_id string, title string, start_raw string, venue {V}")
    reg = spark.createDataFrame([("s2", "Madrid", "ES", "Europe/Madrid", "es"), ("s3", "Madrid", "ES", None, "es")], "id string, city string, country string, timezone string, locale string")
    got = {(r.ordinal_a, r.ordinal_b) for r in matching.matched(df, reg).collect()}
    assert got == {(3 * k, 3 * k + 1) for k in range(40)}
    assert matching.matched(df.limit(0), reg).count() == 0


def events_for_cuts(spark):
    whole = "Een groep speelt liedjes in de grote zaal. De deuren gaan open om acht uur. Kaarten liggen klaar bij de ingang."
    rows = [(f"w{i}", ["s1"], f"Avond {chr(97 + i % 26)} vol verhalen uit de haven", whole) for i in range(60)]
    rows += [("c1", ["s1"], "Avond a vol verhalen uit de ha", "Een groep speelt liedjes in de grote za"), ("c2", ["s1"], "Avond b vol verhalen uit…", "Een groep speelt liedjes in de..."), ("c3", ["s1"], "Avond c vol verhalen uit de haven", "De deuren gaan open om a<stro"), ("n", None, None, ""), ("o", ["s1"], "Avond d vol verhalen uit de haven", "De deuren gaan open om acht uur")]
    return spark.createDataFrame(rows, "id string, source_ids array<string>, title string, description string")


def test_cuts(spark):
    got = {(r.event_id, r.field) for r in truncation.judged(events_for_cuts(spark), registry(spark)).where("cut").collect()}
    assert got == {("c1", "title"), ("c1", "description"), ("c2", "title"), ("c2", "description"), ("c3", "description")}
    assert truncation.judged(events_for_cuts(spark).limit(0), registry(spark)).count() == 0
