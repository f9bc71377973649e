import pytest
from pyspark.sql import functions as F

from kiosko.sources import payloads, registry

SPECS = [
    ("ld", "Delft", "NL", "jsonld", None, None), ("cal", "Delft", "NL", "ics", None, None), ("feed", "Delft", "NL", "rss", None, None), ("posts", "Delft", "NL", "wp_rest", {"title": "naam.tekst", "date": "dag", "time": "van", "end_time": "tot", "price": "prijs"}, None),
    ("city", "Madrid", "ES", "api", None, None), ("wrap", "Delft", "NL", "wrapper", {"container": ".kaart", "title": "h3", "date": "time@datetime", "price": ".prijs", "price_regex": r"(?P<value>€\s?\d+)"}, None), ("prose", "Delft", "NL", "prose", None, None), ("one", "Delft", "NL", "ics", None, "Huis"),
]
BODIES = {
    "ld": '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"itemListElement":[{"item":{"@type":"MusicEvent","name":"Jazz","startDate":"2026-09-01","doorTime":"19:30","URL":"u","location":{"name":"Zaal","address":{"streetAddress":"Plein 1","addressLocality":"Delft"},"geo":{"latitude":"52.0","longitude":4.3}},"offers":[{"price":5,"priceCurrency":"EUR"}]}},{"@type":"Event","name":"JAZZ","startDate":"2026-09-01","doorTime":"20:00"}]}]}</script>',
    "cal": "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Quiz\\, deel\r\n  1\r\nDTSTART;TZID=Europe/Amsterdam:20260901T200000\r\nRRULE:FREQ=WEEKLY\r\nEXDATE:20260908T200000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Dag\r\nDTSTART;VALUE=DATE:20260902\r\nEND:VEVENT\r\nEND:VCALENDAR",
    "feed": "<rss><channel><item><title>A</title><link>https://x/agenda/a</link><startdate>2026-09-01</startdate></item><item><title>B</title><link>https://x/nieuws/b</link><startdate>2026-09-01T20:00</startdate></item><item><title>C</title><link>https://x/c</link><startdate>2026-09-01T00:00</startdate></item><item><title>D</title><pubDate>x</pubDate></item></channel></rss>",
    "posts": '[{"naam":{"tekst":"Film &amp; meer"},"link":"l","dag":"20260901","van":"20:30","tot":"01:00","prijs":9.5}]',
    "city": '{"@graph":[{"title":"Baile","dtstart":"2026-09-01 18:00:00.0","free":1,"location":{"latitude":40.4,"longitude":-3.7},"address":{"area":{"street-address":"Calle 1"}}}]}',
    "wrap": '<div class="kaart groot"><h3>Borrel</h3><time datetime="2026-09-01T17:00">di</time><p><span class="prijs">kost € 5 euro</span></p></div><div class="kaart"><h3>Lezing</h3></div>',
    "prose": "tekst", "one": "BEGIN:VEVENT\nSUMMARY:X\nDTSTART:20260901T200000\nLOCATION:Kelder\nEND:VEVENT",
}


@pytest.fixture(scope="module")
def got(spark):
    reg = spark.createDataFrame([(i, c, k, t, None, s, None, v, "event") for i, c, k, t, s, v in SPECS], "id string, city string, country string, source_type string, url string, selectors map<string,string>, venue_address string, venue_name string, date_from string")
    bodies = spark.createDataFrame([*BODIES.items(), ("posts", '{"code":"no_route","message":"x"}'), ("ld", None), ("wrap", "<p>leeg</p>"), ("nobody", "x")], "source_id string, body string")
    return reg, payloads.extract(bodies, reg)


def rows(df, source):
    return df.where(F.col("source_id") == source).where("error is null").orderBy("position").collect()


def test_tiers(got):
    _, df = got
    df = df.cache()
    (ld,) = rows(df, "ld")[:1]
    assert (ld.title, ld.start_text, ld.doc_time, ld.url, ld.venue_name, ld.venue_address, ld.venue_city, ld.lat, ld.lon, ld.price_text) == ("Jazz", "2026-09-01 19:30", "19:30", "u", "Zaal", "Plein 1", "Delft", 52.0, 4.3, "5 EUR") and [r.start_text for r in rows(df, "ld")] == ["2026-09-01 19:30", "2026-09-01 20:00"]
    quiz, day = rows(df, "cal")
    assert (quiz.title, quiz.start_text, quiz.rrule) == ("Quiz, deel 1", "TZID=Europe/Amsterdam:20260901T200000", "RRULE:FREQ=WEEKLY\nEXDATE:20260908T200000") and day.start_text == "20260902"
    assert [r.reject for r in rows(df, "feed")] == [None, "editorial_url", "no_event_signal", "no_event_date"]
    (post,) = rows(df, "posts")
    assert (post.title, post.start_text, post.end_text, post.price_text) == ("Film & meer", "2026-09-01T20:30", "2026-09-02T01:00", "€9.50")
    (city,) = rows(df, "city")
    assert (city.title, city.price_text, city.venue_address, city.lat) == ("Baile", "gratis", "Calle 1", 40.4)
    a, b = rows(df, "wrap")
    assert (a.title, a.start_text, a.price_text, b.start_text) == ("Borrel", "2026-09-01T17:00", "€ 5", None)
    assert {r.source_id for r in df.where("error is not null").collect()} == {"posts", "prose", "wrap"}
    assert {(r.source_id, r.reason): r.n for r in payloads.rejects(df).collect()}["feed", "editorial_url"] == 1 and [r.source_id for r in payloads.heavy_rejects(df).collect()] == ["feed"]


def test_one_house(got):
    reg, df = got
    (r,) = rows(payloads.with_venue_default(df, reg), "one")
    assert (r.venue_name, r.description, r.venue_city) == ("Huis", "Kelder", "Delft")


def test_sniff_links_bytes(spark):
    kinds = [("BEGIN:VCALENDAR", "text/html", "ics"), (' {"a":1}', "", "json"), ("<?xml version='1.0'?><rss>", "", "feed"), ("<urlset>", "", "sitemap"), ("<!doctype html>", "", "html"), ("<?xml?>", "", "xml"), ("x", "text/calendar", "ics"), ("x", None, "other")]
    assert all(r.k == r.want for r in spark.createDataFrame(kinds, "b string, c string, want string").withColumn("k", payloads.sniff(F.col("b"), F.col("c"))).collect())
    pages = spark.createDataFrame([("https://x.nl/a", "<a href='/b'>b</a><a href='/b#c'>b</a><a href='https://y.nl'>y</a><a href='/a/'>self</a>"), ("https://x.nl/n", None)], "u string, b string")
    assert [(r.link, r.n) for r in payloads.page_links(pages, "b", "u").collect()] == [("https://x.nl/b", 0)]
    assert payloads.decode_bytes('<meta charset="utf-8">Café'.encode(), "text/html; charset=iso-8859-1").endswith("Café") and payloads.decode_bytes("Café".encode("cp1252")) == "Café"


def test_registry(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("sources:\n- {id: a, city: Delft, url: 'https://a.nl/', type: ics, selectors: {title: h3}}\n- {id: b, city: Delft, url: 'https://b.nl', type: rss}\n")
    (tmp_path / "holdout_a.yaml").write_text("sources:\n- {id: z, city: Delft, url: 'https://a.nl', type: rss}\n")
    (tmp_path / "u.txt").write_text("a.nl # x\n\nhttps://b.nl\na.nl\n")
    reg, held = registry.load(spark, tmp_path), registry.load(spark, tmp_path, holdouts=True)
    assert {r.id: r.timezone for r in reg.collect()} == {"a": "Europe/Amsterdam", "b": "Europe/Amsterdam"} and [r.id for r in registry.leaked(reg, held).collect()] == ["a"]
    assert [r.url for r in registry.url_list(spark, str(tmp_path / "u.txt")).orderBy("n").collect()] == ["https://a.nl", "https://b.nl"]
    with pytest.raises(ValueError):
        registry.check_holdouts(reg, held)
    registry.check_holdouts(reg.where("id = 'b'"), held)
    assert registry.load(spark, tmp_path, holdouts=True, city="madrid").count() == 0 and registry.load(spark, tmp_path, holdouts=True, city="DELFT").count() == 1
    (tmp_path / "c.yaml").write_text("sources:\n- {id: a, city: D, url: u, type: ics}\n- {id: a, city: D, url: u, type: ics}\n")
    with pytest.raises(ValueError):
        registry.load_file(tmp_path / "c.yaml")
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "source_id string, fetched_at int, body string").withColumn("fetched_at", F.timestamp_seconds("fetched_at"))
    blobs, manifest = registry.snapshot(p, spark.createDataFrame([], "digest string"))
    assert registry.payload_of("a", None, manifest, blobs) == "y" and registry.payload_of("zz", tmp_path, manifest, blobs) is None
    (tmp_path / "a.ics").write_text("uit een map")
    assert registry.payload_of("a", tmp_path, manifest, blobs) == "uit een map"
    assert blobs.count() == 2 and registry.snapshot(p, manifest)[0].count() == 0 and registry.latest_snapshot(manifest).count() == 2


def test_labelled_events_and_hand_written_places(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"title": "Jazz", "start": "2026-09-01T20:00", "venue": "Zaal", "is_free": true, "source_hint": "krant"}, {"title": "Quiz", "start": "2026-09-02", "city": "Madrid"}]')
    assert [(r.id, r.title, r.city, r.source) for r in registry.gold(spark, tmp_path / "g.json").collect()] == [(0, "Jazz", "Delft", "krant"), (1, "Quiz", "Madrid", None)]
    (tmp_path / "bad.json").write_text('[{"title": "Jazz"}]')
    with pytest.raises(ValueError):
        registry.gold(spark, tmp_path / "bad.json")
    (tmp_path / "o.yaml").write_text("venues:\n- {name: Zaal Rood, lat: 52.0, lon: '4.3'}\n- {name: Half, lat: 52.0}\n")
    assert registry.overrides(spark, tmp_path / "o.yaml").collect() == [("Zaal Rood", 52.0, 4.3)] and registry.overrides(spark, tmp_path / "none.yaml").count() == 0


def test_payloads_become_records(spark):
    reg = spark.createDataFrame([("ld", "Delft", "NL", "jsonld", "https://l.nl", 2, "nl", None, None, None, None), ("one", "Delft", "NL", "ics", "https://o.nl", 1, "nl", None, "Kade 1", "Huis", None)], "id string, city string, country string, source_type string, url string, trust int, locale string, selectors map<string,string>, venue_address string, venue_name string, date_from string")
    bodies = spark.createDataFrame([("ld", BODIES["ld"]), ("one", BODIES["one"]), ("ld", None), ("ld", "geen")], "source_id string, body string").withColumn("fetched_at", F.timestamp_seconds(F.lit(1785542400)))
    got = {r.source_id: r for r in payloads.records(bodies, reg).orderBy(F.desc("start_raw")).collect()}
    assert set(got) == {"ld", "one"}
    assert (got["ld"].title, got["ld"].start_raw, got["ld"].venue.name, got["ld"].trust, got["ld"].source_type, got["ld"].url) == ("Jazz", "2026-09-01 19:30", "Zaal", 2, "jsonld", "u")
    assert (got["one"].venue.name, got["one"].venue.address, got["one"].description, got["one"].url) == ("Huis", "Kade 1", "Kelder", "https://o.nl")
    assert payloads.records(bodies.limit(0), reg).count() == 0


def test_probe(spark):
    from kiosko.sources import probe

    body = '<link rel="alternate" type="application/rss+xml" href="/feed"><a href="/x.ics">c</a><a href="/x.ics">c</a><div itemtype="https://schema.org/Event"></div>' + BODIES["ld"]
    pages = spark.createDataFrame([("https://x.nl/a", body), ("https://y.nl/", None)], "url string, body string")
    found = probe.routes(pages)
    assert {(r.tier, r.detail, r.events) for r in found.collect()} == {("jsonld", "in page", 2), ("microdata", "in page", None), ("ics", "https://x.nl/x.ics", None), ("rss", "https://x.nl/feed", None)}
    linked = spark.createDataFrame([("https://x.nl/x.ics", BODIES["cal"])], "url string, body string")
    spec = spark.createDataFrame([("https://x.nl/x.ics", "ics", None, None, None, None)], "id string, source_type string, selectors map<string,string>, date_from string, country string, url string")
    (top,) = probe.best(probe.verified(found, linked, spec)).collect()
    assert (top.tier, top.events) == ("ics", 2)
    texts = [("koop bij eventbrite", "tickets elsewhere"), ("concert op 3 mei", "prose with dates"), ("elke vrijdag borrel", "prose without dates"), ("<div data-reactroot>", "rendered by script"), ("<a href='https://facebook.com/x'>", "social media only"), ("welkom", "nothing about events")]
    assert all(r.v == r.want for r in spark.createDataFrame(texts, "b string, want string").withColumn("v", probe.verdict(F.col("b"))).collect())
