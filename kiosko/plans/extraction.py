"""Queries of payload parsing, the way from payloads to records, places, and stored payloads, with their SQL.

Payloads are made of the rows of ``venues`` (names with their accents, slips and signs), so that SQL can say what must
come out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiosko.functions import keys, text
from kiosko.operators import geography, resolve
from kiosko.plans.catalogue import norm_sql, query
from kiosko.session import table
from kiosko.sources import payloads, probe, registry

SPEC = "id string, city string, country string, source_type string, url string, trust int, locale string, selectors map<string,string>, date_from string, venue_name string, venue_address string"
AT = "2026-08-01 06:00:00"
#: One source of each tier; a wrapper and a content API with the paths of their sites; a source of one house.
SOURCES = [
    ("s_jsonld", "Delft", "NL", "jsonld", "https://j.example", 2, "nl", None, "event", None, None),
    ("s_ics", "Delft", "NL", "ics", "https://i.example", 1, "nl", None, "event", None, None),
    ("s_rss", "Delft", "NL", "rss", "https://r.example", 4, "nl", None, "published", None, None),
    ("s_api", "Madrid", "ES", "api", "https://a.example", 3, "es", None, "event", None, None),
    ("s_wp", "Delft", "NL", "wp_rest", "https://w.example", 2, "nl", {"title": "title.rendered", "date": "acf.dag", "time": "acf.van", "end_time": "acf.tot", "price": "acf.prijs"}, "event", None, None),
    ("s_wrap", "Delft", "NL", "wrapper", "https://c.example", 5, "nl", {"container": "div.kaart", "title": "h3", "start": "time@datetime", "venue": ".plek", "price": ".prijs", "price_regex": "(?P<value>€ ?[0-9]+)"}, "event", None, None),
    ("s_house", "Delft", "NL", "jsonld", "https://h.example", 2, "nl", None, "event", "Het Huis", "Kade 1"),
]


def _spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SPEC)


def _payloads(spark: SparkSession, d: str, source: str, body: Column) -> DataFrame:
    return table(spark, d, "venues").select(F.lit(source).alias("source_id"), body.alias("body"), F.lit(AT).cast("timestamp").alias("fetched_at"))


_ESC = "replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: A text as the parsers of markup show it: white space, no-break spaces too, to single spaces.
SHOWN = "trim(regexp_replace(replace({}, chr(160), ' '), '\\s+', ' ', 'g'), ' ')"


@query(f"SELECT id AS url, {SHOWN.format('name')} AS title, '2026-09-01T20:00' AS start_text, {SHOWN.format('coalesce(city, name)')} AS venue, '€ 7' AS price FROM venues")
def wrapper_extract(spark: SparkSession, d: str) -> DataFrame:
    place = F.expr(_ESC.replace("name", "coalesce(city, name)"))
    body = F.concat(F.lit("<body><div class='kop'><h3>no</h3></div><div class='a kaart'><h3>"), F.expr(_ESC), F.lit("</h3><p class=plek>"), place, F.lit("</p><time datetime='2026-09-01T20:00'>zo</time><p class='prijs'>kaart € 7 p.p.</p><i>"), "id", F.lit("</i></div></body>"))
    v = table(spark, d, "venues").select("id", body.alias("body"))
    rows = payloads.extract(v.select(F.lit("s_wrap").alias("source_id"), "body"), _spec(spark).withColumn("selectors", F.map_concat("selectors", F.create_map(F.lit("description"), F.lit("i"))))).where("error is null")
    return rows.select(F.col("description").alias("url"), "title", "start_text", F.col("venue_name").alias("venue"), F.col("price_text").alias("price"))


@query(f"SELECT id AS url, {SHOWN.format('name')} AS title, '2026-09-30T20:30' AS start_text, CASE WHEN n % 2 = 0 THEN '2026-10-01T00:15' ELSE '2026-09-30T23:15' END AS end_text, '€12.50' AS price_text FROM (SELECT *, length(id || name) AS n FROM venues)")
def wp_rest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ends before their start are of the next day, here of the next month."""
    late = F.length(F.concat("id", "name")) % 2 == 0
    post = F.struct(F.struct(F.concat(F.lit("<em>"), F.expr(_ESC), F.lit("</em>")).alias("rendered")).alias("title"), F.col("id").alias("link"), F.struct(F.lit("20260930").alias("dag"), F.lit("20:30").alias("van"), F.when(late, "00:15").otherwise("23:15").alias("tot"), F.lit(12.5).alias("prijs")).alias("acf"))
    return payloads.extract(_payloads(spark, d, "s_wp", F.to_json(F.array(post))), _spec(spark)).where("error is null").select("url", "title", "start_text", "end_text", "price_text")


@query("SELECT id AS url, name AS title, CASE WHEN length(name) % 2 = 0 THEN '2026-09-01 19:30' ELSE '2026-09-01T21:00:00+02:00' END AS start_text, CASE WHEN city IS NULL THEN 'Unknown venue' ELSE city END AS venue_name, address AS venue_address, lat, '5 EUR' AS price_text FROM venues")
def jsonld_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events in a graph beside a page, with the clock time in doorTime where the start is a bare date."""
    bare = F.length("name") % 2 == 0
    place = F.struct(F.lit("Place").alias("@type"), F.col("city").alias("name"), F.col("address").alias("address"), F.struct("lat", "lon").alias("_"))
    place = F.struct(F.lit("Place").alias("@type"), F.col("city").alias("name"), F.col("address"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geo"))
    event = F.struct(
        F.array(F.lit("Thing"), F.lit("MusicEvent")).alias("@type"), "name", F.when(bare, "2026-09-01").otherwise("2026-09-01T21:00:00+02:00").alias("startDate"), F.when(bare, "2026-09-01T19:30").alias("doorTime"),
        place.alias("location"), F.array(F.struct(F.lit("5").alias("price"), F.lit("EUR").alias("priceCurrency"))).alias("offers"), F.col("id").alias("URL"),
    )
    tree = F.to_json(F.struct(F.struct(F.lit("WebPage").alias("@type"), F.lit("no").alias("name"), F.struct(F.array(event).alias("@graph")).alias("mainEntity")).alias("@graph")))
    body = F.concat(F.lit('<html><head><script type="application/ld+json">{broken</script><script type="application/ld+json">'), tree, F.lit("</script></head></html>"))
    return payloads.extract(_payloads(spark, d, "s_jsonld", body), _spec(spark)).where("error is null").select("url", "title", "start_text", "venue_name", "venue_address", "lat", "price_text")


_CAL = "replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';'), chr(10), chr(92) || 'n')"


@query("SELECT id AS url, trim(name, ' ') AS title, 'TZID=Europe/Amsterdam:20260901T200000' AS start_text, '20260901T210000Z' AS end_text, nullif(trim(address, ' '), '') AS venue, 'RRULE:FREQ=WEEKLY;COUNT=3' || chr(10) || 'EXDATE:20260908T200000' AS rrule FROM venues")
def ics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Calendars with folded lines, zones, escapes and exceptions."""
    n = F.lit("\r\n")
    esc = lambda c: F.expr(_CAL.format(c))
    folded = F.concat(F.left(esc("name"), F.lit(4)), F.lit("\r\n "), F.substring(esc("name"), 5, 10000))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:"), folded, n, F.lit("DTSTART;TZID=Europe/Amsterdam:20260901T200000\r\nDTEND:20260901T210000Z\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nEXDATE:20260908T200000\r\nLOCATION:"), F.coalesce(esc("address"), F.lit("")), n, F.lit("URL:"), "id", F.lit("\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    got = payloads.extract(_payloads(spark, d, "s_ics", body), _spec(spark)).where("error is null")
    return got.select("url", "title", "start_text", "end_text", F.nullif("venue_name", F.lit("")).alias("venue"), "rrule")


@query("SELECT id, name AS title, CASE WHEN length(name) % 3 = 0 THEN 'no_event_date' WHEN length(name) % 3 = 1 THEN 'editorial_url' END AS reject FROM venues")
def rss_signals(spark: SparkSession, d: str) -> DataFrame:
    """Feed items without a date, under an article's path, and with the sign of an event."""
    kind = F.length("name") % 3
    link = F.concat(F.lit("https://x.example/"), F.when(kind == 1, "nieuws/").otherwise("agenda/"), "id")
    date = F.when(kind == 0, "").otherwise("<pubDate>Tue, 01 Sep 2026 20:00:00 +0200</pubDate>")
    body = F.concat(F.lit("<rss><channel><item><title>"), F.expr(_ESC), F.lit("</title><link>"), link, F.lit("</link>"), date, F.lit("</item></channel></rss>"))
    got = payloads.extract(_payloads(spark, d, "s_rss", body), _spec(spark)).where("error is null")
    return got.select(F.regexp_extract("url", "([^/]+)$", 1).alias("id"), "title", "reject")


@query("SELECT CASE WHEN length(name) % 3 = 0 THEN 'no_event_date' ELSE 'editorial_url' END AS reason, count(*) AS n FROM venues WHERE length(name) % 3 < 2 GROUP BY 1")
def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.length("name") % 3
    link = F.concat(F.lit("https://x.example/"), F.when(kind == 1, "nieuws/").otherwise("agenda/"), "id")
    date = F.when(kind == 0, "").otherwise("<pubDate>Tue, 01 Sep 2026 20:00:00 +0200</pubDate>")
    body = F.concat(F.lit("<rss><channel><item><title>"), F.expr(_ESC), F.lit("</title><link>"), link, F.lit("</link>"), date, F.lit("</item></channel></rss>"))
    return payloads.rejects(payloads.extract(_payloads(spark, d, "s_rss", body), _spec(spark))).select("reason", "n")


@query("SELECT g.source_id, n > 0.7 * k AS heavy FROM (SELECT 's_' || coalesce(lower(city[1:1]), 'x') AS source_id, count(*) FILTER (length(name) % 3 < 2) AS n, count(*) AS k FROM venues GROUP BY 1) g WHERE n > 0.7 * k")
def heavy_rejects(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues")
    rows = v.select(F.concat(F.lit("s_"), F.coalesce(F.lower(F.left("city", F.lit(1))), F.lit("x"))).alias("source_id"), F.when(F.length("name") % 3 < 2, "no_event_date").alias("reject"), F.lit(None).cast("string").alias("error"))
    return payloads.heavy_rejects(rows).select("source_id", F.lit(True).alias("heavy"))


_AREA = "CASE WHEN organization_name IS NULL THEN NULL ELSE organization_name END"


@query("SELECT row_id, title, dtstart AS start_text, dtend AS end_text, link AS url, organization_name AS venue, street_address AS address, latitude AS lat, CASE WHEN free = 1 THEN 'gratis' END AS price_text FROM madrid_ayuntamiento_api WHERE title IS NOT NULL")
def api_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The city's interface, from the rows of its own table."""
    m = table(spark, d, "madrid_ayuntamiento_api").where("title is not null")
    area = F.struct(F.col("organization_name").alias("organization-name"), F.col("street_address").alias("street-address"))
    row = F.struct("title", "dtstart", "dtend", "free", "link", F.col("row_id").cast("string").alias("description"), F.struct(area.alias("area")).alias("address"), F.struct("latitude", "longitude").alias("location"))
    got = payloads.extract(m.select(F.lit("s_api").alias("source_id"), F.to_json(F.struct(F.array(row).alias("@graph"))).alias("body")), _spec(spark)).where("error is null")
    return got.select(F.col("description").cast("long").alias("row_id"), "title", "start_text", "end_text", "url", F.col("venue_name").alias("venue"), F.col("venue_address").alias("address"), "lat", "price_text")


@query("SELECT source_id, records, error FROM (VALUES ('s_jsonld', 2, NULL), ('s_ics', 0, NULL), ('s_wrap', 0, 'ValueError: no container'), ('s_wp', 0, 'ValueError: the source says rest_no_route'), ('s_api', 0, 'no payload')) t(source_id, records, error)")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    """What each source gave, or what went wrong: a payload that fails leaves the others as they are."""
    one = '<script type="application/ld+json">[{"@type": "Event", "name": "A", "startDate": "2026-09-01"}, {"@type": "Event", "name": "B", "startDate": "2026-09-01"}, {"@type": "Event", "name": "a", "startDate": "2026-09-01"}]</script>'
    rows = [("s_jsonld", one), ("s_ics", "BEGIN:VCALENDAR\nEND:VCALENDAR"), ("s_wrap", "<p>x</p>"), ("s_wp", '{"code": "rest_no_route", "message": "x"}'), ("s_api", None)]
    asked = spark.createDataFrame(rows, "source_id string, body string")
    got = payloads.status(asked, payloads.extract(asked.where("body is not null"), _spec(spark)))
    return got.withColumn("records", F.col("records").cast("int"))


_CLEAN = SHOWN.format("name")


@query(f"""SELECT name AS raw_name, {_CLEAN} AS title, '2026-09-01T20:00:00+02:00' AS start_raw, CASE WHEN length(name) % 2 = 0 THEN 'Zaal 3. deuren open' ELSE 'deuren open' END AS description, 'Het Huis' AS venue, 'Kade 1' AS address, 'Delft' AS city, '€5' AS price, false AS is_free, 'jsonld' AS source_type, 2 AS trust FROM venues WHERE regexp_full_match(name, '[\x20-\x7e]*')""".replace(" WHERE regexp_full_match(name, '[\x20-\x7e]*')", ""))
def extracted_records(spark: SparkSession, d: str) -> DataFrame:
    """Payloads to raw_records: cleaned, priced, with the source's own house and the room before the description."""
    even = F.length("name") % 2 == 0
    event = F.struct(F.lit("Event").alias("@type"), F.col("name"), F.lit("2026-09-01T20:00:00+02:00").alias("startDate"), F.lit("<p>deuren&nbsp;open</p>").alias("description"), F.when(even, F.struct(F.lit("Zaal 3").alias("name"))).alias("location"), F.struct(F.lit("€ 5").alias("price")).alias("offers"), F.col("name").alias("url"))
    body = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(event), F.lit("</script>"))
    got = payloads.records(_payloads(spark, d, "s_house", body), _spec(spark))
    return got.select(F.col("url").alias("raw_name"), "title", "start_raw", "description", F.col("venue.name").alias("venue"), F.col("venue.address").alias("address"), F.col("venue.city").alias("city"), "price", "is_free", "source_type", "trust")


@query()
def pages_to_events(spark: SparkSession, d: str) -> DataFrame:
    """From stored pages to canonical events in one plan: parse, clean, resolve."""
    pages = table(spark, d, "tudelft_events").select(F.lit("tudelft_events").alias("source_id"), F.col("html").alias("body"), "fetched_at")
    reg = table(spark, d, "registry")
    got = resolve.deduplicate(payloads.records(pages, reg), reg)
    return got.select("id", "title", "city", F.unix_seconds("start").alias("start_second"), F.col("venue.name").alias("venue"), "category", "n_members", "n_sources")


@query("""WITH p AS (SELECT id, name, row_number() OVER (ORDER BY id) AS n FROM venues), k AS (SELECT * FROM p WHERE n % 10 < 3) SELECT 'x' || (n // 10) AS source_id, count(*) AS events FROM k GROUP BY 1""")
def index_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Index pages and the detail pages they link to, stitched into one payload of a source and read."""
    from pyspark.sql import Window

    v = table(spark, d, "venues").select("id", "name", F.row_number().over(Window.orderBy("id")).alias("n")).where("n % 10 < 3")
    source = F.concat(F.lit("x"), F.floor(F.col("n") / 10).cast("string"))
    url = F.concat(F.lit("https://x.example/"), source, F.lit("/"), "id")
    event = F.to_json(F.struct(F.lit("Event").alias("@type"), F.concat("name", F.lit(" "), "id").alias("name"), F.lit("2026-09-01T20:00").alias("startDate")))
    details = v.select(url.alias("url"), F.concat(F.lit('<p>x</p><script type="application/ld+json">'), event, F.lit("</script>")).alias("body"))
    index = v.groupBy(source.alias("source_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), url, F.lit('">x</a>')))), "").alias("body"))  # ten links at most
    index = index.select("source_id", F.concat(F.lit("https://x.example/"), "source_id").alias("url"), "body", F.lit(AT).cast("timestamp").alias("fetched_at"))
    whole = payloads.stitched(index, details)
    spec = index.select(F.col("source_id").alias("id"), F.lit("Delft").alias("city"), F.lit("NL").alias("country"), F.lit("jsonld_index").alias("source_type"), "url", F.lit(None).cast("map<string,string>").alias("selectors"), F.lit("event").alias("date_from"))
    return payloads.extract(whole, spec).where("error is null").groupBy("source_id").agg(F.count("*").alias("events"))


@query("SELECT event_id, (props->>'$.k') AS k FROM events")
def dotted_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", payloads.at_path(F.col("props"), "k").alias("k"))


@query("SELECT id, name AS body FROM venues")
def decode_payload(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 bytes under a wrong or no declared charset."""
    v = table(spark, d, "venues")
    kind = F.when(F.length("name") % 2 == 0, "text/html; charset=iso-8859-1").otherwise("text/html")
    return v.select("id", payloads.decoded(F.encode("name", "utf-8"), kind).alias("body"))


@query("""SELECT source_id, digest FROM (SELECT source_id, fetched_at AS t, substr(sha256(description), 1, 24) AS digest FROM raw_records WHERE description IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t DESC, digest) = 1""")
def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_records").where("description is not null").select("source_id", "fetched_at", F.col("description").alias("body"))
    empty = spark.createDataFrame([], "digest string")
    return registry.latest_snapshot(registry.snapshot(rows, empty)[1]).select("source_id", "digest")


@query("""WITH a AS (SELECT DISTINCT substr(sha256(description), 1, 24) AS digest FROM raw_records WHERE description IS NOT NULL AND ordinal % 2 = 0) SELECT DISTINCT substr(sha256(description), 1, 24) AS digest FROM raw_records WHERE description IS NOT NULL AND substr(sha256(description), 1, 24) NOT IN (SELECT digest FROM a)""")
def snapshot_put(spark: SparkSession, d: str) -> DataFrame:
    """The blobs that a second crawl adds to those stored by the first."""
    rows = table(spark, d, "raw_records").where("description is not null").select("source_id", "fetched_at", F.col("description").alias("body"), "ordinal")
    stored = registry.snapshot(rows.where("ordinal % 2 = 0"), spark.createDataFrame([], "digest string"))[1]
    return registry.snapshot(rows, stored)[0].select("digest")


_TOWN = "coalesce(nullif(trim(venue.city, ' '), ''), g.city)"
_KEY_NAME, _KEY_CITY = norm_sql("coalesce(name, '')"), norm_sql("coalesce(city, '')")
_OWN = "coalesce(nullif(array_to_string(list_filter(string_split({n}, ' '), lambda w: NOT list_contains(string_split({c}, ' '), w)), ' '), ''), {n})"


@query(f"SELECT id, substr(sha1({_OWN.format(n='n', c='c')} || '|' || lower(coalesce(city, ''))), 1, 16) AS key FROM (SELECT id, city, {_KEY_NAME} AS n, {_KEY_CITY} AS c FROM venues)")
def venue_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "venues").select("id", keys.venue_key(F.col("name"), F.col("city")).alias("key"))


@query(f"""WITH v AS (SELECT name, city, lat, lon, {_KEY_NAME} AS n, {_KEY_CITY} AS c FROM venues WHERE lat IS NOT NULL AND lon IS NOT NULL), cache AS (SELECT substr(sha1({_OWN.format(n='n', c='c')} || '|' || lower(coalesce(city, ''))), 1, 16) AS key, min(lat) AS lat, min(lon) AS lon FROM v GROUP BY 1),
hand AS (SELECT {norm_sql("name")} AS norm, min(lat) + 1 AS lat FROM venues WHERE lat IS NOT NULL AND lon IS NOT NULL AND length(name) % 5 = 0 GROUP BY 1),
r AS (SELECT ordinal, venue.lat AS own, venue.name AS name, {_TOWN} AS city, {norm_sql("coalesce(venue.name, '')")} AS n, {norm_sql(f"coalesce({_TOWN}, '')")} AS c FROM raw_records LEFT JOIN registry g ON g.id = source_id WHERE venue IS NOT NULL)
SELECT ordinal, round(coalesce(own, hand.lat, cache.lat), 6) AS lat, CASE WHEN own IS NOT NULL THEN NULL WHEN hand.lat IS NOT NULL THEN 'override' WHEN cache.lat IS NOT NULL THEN 'pdok' END AS stamped FROM r LEFT JOIN cache ON cache.key = substr(sha1({_OWN.format(n='n', c='c')} || '|' || lower(coalesce(r.city, ''))), 1, 16) LEFT JOIN hand ON hand.norm = r.n""")  # fmt: skip
def geocode_stamp(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").where("lat is not null and lon is not null")
    cache = v.groupBy(keys.venue_key(F.col("name"), F.col("city")).alias("id")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.lit("pdok").alias("source"))
    hand = v.where("length(name) % 5 = 0").groupBy(text.normalize_title(F.col("name")).alias("name")).agg((F.min("lat") + 1).alias("lat"), F.min("lon").alias("lon"))
    rows = table(spark, d, "raw_records").where("venue is not null").select("ordinal", "source_id", "venue", F.col("venue.lat").alias("own"))
    got = geography.stamped(rows, table(spark, d, "registry"), cache, hand)
    return got.select("ordinal", F.round("venue.lat", 6).alias("lat"), F.when(F.col("own").isNull() & F.col("venue.lat").isNotNull(), F.col("venue.geocode_source")).alias("stamped"))


@query("SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM venues WHERE lat IS NOT NULL AND lon IS NOT NULL")
def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two kinds of providers: points as text, and lists of places."""
    v = table(spark, d, "venues").where("lat is not null and lon is not null")
    wkt = geography.point(F.format_string("POINT(%.6f %.6f)", "lon", "lat"))
    listed = geography.found_point(F.to_json(F.array(F.struct(F.format_string("%.6f", F.col("lat")).alias("lat"), F.format_string("%.6f", F.col("lon")).alias("lon")))))
    rows = v.select("id", F.when(F.length("id") % 2 == 0, wkt).otherwise(listed).alias("p"))
    return rows.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("SELECT count(DISTINCT url) AS pages, count(DISTINCT url) FILTER (contains(html, 'ld+json')) AS verified, count(*) FILTER (contains(html, 'ld+json')) AS events FROM tudelft_events")
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each page carries one Event node; pages of one address are probed together."""
    pages = table(spark, d, "tudelft_events").select("url", F.col("html").alias("body"))
    one = probe.routes(pages).groupBy("url", "tier", "detail").agg(F.sum("events").alias("events"))
    return probe.summary(pages, probe.best(one))


@query("SELECT source_id, CASE WHEN n % 3 = 0 THEN false ELSE true END AS ok, CASE WHEN n % 3 = 1 THEN n ELSE 0 END AS records FROM (SELECT id AS source_id, length(id)::INT AS n FROM registry)")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    from kiosko.operators import state

    n = F.length("id")
    line = F.when(n % 3 == 0, "FAILED: timeout").when(n % 3 == 1, F.concat(n.cast("string"), F.lit(" records"))).otherwise("unchanged")
    return table(spark, d, "registry").select(F.col("id").alias("source_id"), state.run_status(line).alias("s")).select("source_id", "s.ok", "s.records")
