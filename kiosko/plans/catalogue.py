"""The queries of the core operators and the SQL they are held against; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiosko.functions import keys, rules, similarity, text
from kiosko.plans.instants import utc_sql
from kiosko.operators import audit, geography, graph, measures, reading, recurrence, resolve, state, times
from kiosko.session import checkpointed, table
from kiosko.sources import payloads, probe

NOW = 1785542400  # 2026-08-01T00:00:00Z, the clock of all queries
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events_of(spark: SparkSession, d: str) -> DataFrame:
    """canonical_events with local times, start second and the coordinates of its venue."""
    e = table(spark, d, "canonical_events")
    local = F.expr("try_cast(substr(start_iso, 1, 19) as timestamp_ntz)")
    e = e.withColumn("start_local", local).withColumn("second", F.unix_seconds("start_at"))
    e = e.withColumn("end_local", F.expr("start_local + make_dt_interval(0, 0, 0, unix_seconds(end_at) - unix_seconds(start_at))"))
    v = table(spark, d, "venues").select(F.col("id").alias("_v"), F.col("lat").alias("venue_lat"), F.col("lon").alias("venue_lon"))
    return e.join(v, e["venue_id"] == v["_v"], "left").drop("_v")


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source_id"), F.floor("value").cast("int").alias("records"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("ran_at"))


RUNS = "runs AS (SELECT event_id AS id, user_id::VARCHAR AS source_id, floor(value)::INT AS records, event_type <> 'error' AS ok, ts AS ran_at FROM events)"


STATED = """w AS (SELECT 'raw_records' AS origin, ordinal AS row_id, 'start' AS field, source_id AS src, start_raw AS text, timezone FROM raw_records LEFT JOIN registry g ON g.id = source_id UNION ALL SELECT 'raw_records', ordinal, 'end', source_id, end_raw, timezone FROM raw_records LEFT JOIN registry g ON g.id = source_id
UNION ALL SELECT 'madrid_ayuntamiento_api', row_id, 'dtstart', '*madrid', dtstart, 'Europe/Madrid' FROM madrid_ayuntamiento_api UNION ALL SELECT 'madrid_ayuntamiento_api', row_id, 'dtend', '*madrid', dtend, 'Europe/Madrid' FROM madrid_ayuntamiento_api),
x AS (SELECT * EXCLUDE (timezone), coalesce(timezone, 'Europe/Amsterdam') AS zone FROM w WHERE text IS NOT NULL)"""


@query(f"WITH {STATED}, {utc_sql('x')} SELECT origin, row_id, field, utc_second FROM tm WHERE utc_second IS NOT NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return times.stated_times(*[table(spark, d, n) for n in ("raw_records", "madrid_ayuntamiento_api", "registry")])


@query("SELECT id, title, category, len(source_ids) AS source_count, is_free FROM canonical_events WHERE withdrawn_at IS NULL")
def live_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return reading.live(table(spark, d, "canonical_events")).select("id", "title", "category", F.size("source_ids").cast("long").alias("source_count"), "is_free")


@query("""SELECT e.id, epoch(e.start_at)::BIGINT AS second, e.title FROM canonical_events e JOIN venues v ON e.venue_id = v.id
WHERE e.withdrawn_at IS NULL AND lower(e.city) = 'delft' AND (e.title ILIKE '%o%' OR e.venue_name ILIKE '%o%') AND v.lat BETWEEN 51.9 AND 52.1 AND v.lon BETWEEN 4.2 AND 4.5 AND epoch(e.start_at) BETWEEN 1767225600 AND 1800000000""")  # fmt: skip
def compound_filter(spark: SparkSession, d: str) -> DataFrame:
    q = reading.EventQuery(city="Delft", q="o", bbox=(51.9, 4.2, 52.1, 4.5), begin=1767225600, end=1800000000)
    return reading.filtered(events_of(spark, d), q).select("id", "second", "title")


@query("SELECT id, len(source_ids) AS n_sources FROM canonical_events WHERE withdrawn_at IS NULL AND len(source_ids) >= 2")
def min_sources(spark: SparkSession, d: str) -> DataFrame:
    return reading.filtered(events_of(spark, d), reading.EventQuery(min_sources=2)).select("id", F.size("source_ids").cast("long").alias("n_sources"))


@query("SELECT id, epoch(start_at)::BIGINT AS second FROM canonical_events WHERE withdrawn_at IS NULL AND (epoch(start_at)::BIGINT, id) > (1780000000, '8') ORDER BY start_at, id LIMIT 51")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return reading.page(events_of(spark, d), reading.EventQuery(after=(1780000000, "8"))).select("id", "second")


@query("SELECT v.id, v.name, v.city, count(e.id) AS event_count FROM venues v LEFT JOIN (SELECT * FROM canonical_events WHERE withdrawn_at IS NULL) e ON e.venue_id = v.id GROUP BY ALL")
def venue_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return reading.venue_counts(table(spark, d, "venues"), table(spark, d, "canonical_events"))


@query("SELECT l_orderkey AS event_id, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    occ = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("is_override"))
    return state.orphans(occ, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))).select("event_id", "n")


@query("""WITH s AS (SELECT source_id AS id, max(epoch(fetched_at)) AS t FROM raw_records WHERE price IS NOT NULL GROUP BY 1)
SELECT r.id, CASE WHEN t IS NULL THEN 'never' WHEN 1785542400 - t > 120 * cadence_minutes THEN 'stale' ELSE 'ok' END AS status FROM registry r LEFT JOIN s USING (id) WHERE enabled""")  # fmt: skip
def source_health(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "raw_records").where("price is not null").groupBy("source_id").agg(F.max("fetched_at").alias("last_success"))
    return measures.health(table(spark, d, "registry"), done, F.timestamp_seconds(F.lit(NOW))).select("id", "status")


@query("SELECT category, count(*) AS n FROM canonical_events WHERE withdrawn_at IS NULL GROUP BY 1 ORDER BY n DESC")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return reading.live(table(spark, d, "canonical_events")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"""WITH {RUNS}, g AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS n FROM runs WHERE ok),
a AS (SELECT source_id, max(records) FILTER (n = 1) AS latest, median(records) FILTER (n > 1) AS median, count(*) FILTER (n > 1) AS history FROM g WHERE n <= 11 GROUP BY 1)
SELECT source_id, latest, round(median, 6) AS median, history, CASE WHEN latest / median <= 0.3 THEN 'collapsed' ELSE 'degraded' END AS kind FROM a WHERE history >= 4 AND median > 0 AND latest / median <= 0.6""")  # fmt: skip
def yield_regressions(spark: SparkSession, d: str) -> DataFrame:
    return measures.yield_regressions(runs_of(spark, d), "source_id").select("source_id", "latest", F.round("median", 6).alias("median"), "history", "kind")


@query(f"""WITH {RUNS}, s AS (SELECT source_id, max(ran_at) FILTER (ok) AS t FROM runs GROUP BY 1)
SELECT round(median((1785542400 - epoch(t)) / 3600), 4) AS median_hours, round(max((1785542400 - epoch(t)) / 3600), 4) AS worst_hours, count(*) FILTER (t IS NULL) AS never, count(*) AS sources FROM s""")  # fmt: skip
def freshness(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d).withColumn("ran_at", F.col("ran_at").cast("timestamp"))
    got = measures.freshness(state.run_state(runs, "source_id", "ok", "ran_at", "id"), F.timestamp_seconds(F.lit(NOW)))
    return got.withColumns({c: F.round(c, 4) for c in ("median_hours", "worst_hours")})


@query(f"""WITH {RUNS} SELECT source_id, count(*) AS runs, count(*) FILTER (NOT ok) AS failures, round(avg((NOT ok)::INT), 6) AS rate FROM runs WHERE id > (SELECT max(id) FROM runs) - 200 GROUP BY 1""")
def breakage(spark: SparkSession, d: str) -> DataFrame:
    return measures.breakage(runs_of(spark, d), "source_id")


@query("""SELECT event_id, field, source_id, lag(claim) OVER w AS old_value, claim AS new_value FROM (SELECT DISTINCT event_id, field, source_id, claim, updated_at FROM field_provenance)
WINDOW w AS (PARTITION BY event_id, field, source_id ORDER BY updated_at, claim NULLS FIRST) QUALIFY row_number() OVER w = 1 OR lag(claim) OVER w IS DISTINCT FROM claim""")  # fmt: skip
def revision_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "field_provenance").select("event_id", "field", "source_id", "claim", "updated_at").distinct()
    return state.revisions(rows, ["event_id", "field", "source_id"], "claim", ["updated_at", F.col("claim").asc_nulls_first()]).drop("updated_at")


@query("""WITH n AS (SELECT id, name, city, address, lat, lon FROM venues WHERE geocode_source = 'source'), o AS (SELECT id, name, city, address, lat, lon FROM venues WHERE address IS NOT NULL)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE 'new ' || n.name END AS name, coalesce(o.city, n.city) AS city, coalesce(n.lat + 1, o.lat) AS lat FROM o FULL JOIN n ON o.id = n.id""")  # fmt: skip
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").select("id", "name", "city", "address", "lat", "lon", "geocode_source")
    old = v.where("address is not null").drop("geocode_source")
    new = v.where("geocode_source = 'source'").drop("geocode_source").withColumns({"name": F.concat(F.lit("new "), "name"), "lat": F.col("lat") + 1})
    return state.upsert(old, new, "id", keep=("lat", "lon", "city")).withColumn("city", F.col("city")).select("id", "name", "city", "lat")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_quantity + 1 FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey * 10 + l_linenumber NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')""")
def override_replace(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), (F.col("l_returnflag") == "R").alias("is_override"), "l_linestatus")
    new = li.where("l_linestatus = 'O'").withColumns({"q": F.col("q") + 1, "is_override": F.lit(False)})
    return state.replace_unless_pinned(li.drop("l_linestatus"), new.drop("l_linestatus")).select("id", "q")


@query("""WITH ok AS (SELECT id AS source_id FROM registry WHERE enabled), blocked AS (SELECT DISTINCT id FROM (SELECT id, unnest(source_ids) AS s FROM canonical_events) WHERE s NOT IN (SELECT source_id FROM ok))
SELECT id, CASE WHEN epoch(last_seen)::BIGINT % 2 = 0 THEN NULL WHEN len(source_ids) > 0 AND id NOT IN (SELECT id FROM blocked) THEN coalesce(epoch(withdrawn_at)::BIGINT, 1785542400) ELSE epoch(withdrawn_at)::BIGINT END AS withdrawn FROM canonical_events""")  # fmt: skip
def withdraw_unseen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_events")
    seen = e.where(F.unix_seconds("last_seen") % 2 == 0)
    ok = table(spark, d, "registry").where("enabled").select(F.col("id").alias("source_id"))
    return state.withdraw_unseen(e, seen, ok, F.timestamp_seconds(F.lit(NOW))).select("id", F.unix_seconds("withdrawn_at").alias("withdrawn"))


@query(f"""WITH {RUNS} SELECT source_id, strftime(max(ran_at), '%Y-%m-%d %H:%M:%S') AS last_attempt, strftime(max(ran_at) FILTER (ok), '%Y-%m-%d %H:%M:%S') AS last_success, arg_max(records, id) AS records, count(*) AS runs FROM runs GROUP BY 1""")
def run_log_latest_and_history(spark: SparkSession, d: str) -> DataFrame:
    got = state.run_state(runs_of(spark, d), "source_id", "ok", "ran_at", "id")
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_attempt", "last_success")})


def norm_sql(c: str, locale: str = "nl") -> str:
    """The comparison key of a title in SQL, without the stop words of a locale. Letters that compatibility forms spell out are put first, as DuckDB only
    takes marks off."""
    plain = f"translate(lower({c}), 'ª²³¹ºµ¨¯´¸\u00a0', 'a231oμ     ')"
    stop = ", ".join(f"'{w}'" for w in rules.STOPWORDS[locale])
    for a, b in (("¼", "1 4"), ("½", "1 2"), ("¾", "3 4"), ("™", "tm"), ("…", " ")):
        plain = f"replace({plain}, '{a}', '{b}')"
    words = f"regexp_replace(regexp_replace(strip_accents({plain}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({words}, ' '), lambda w: w <> '' AND w NOT IN ({stop})), ' ')"


@query(f"SELECT ordinal, {norm_sql('title')} AS norm FROM raw_records")
def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("ordinal", text.normalize_title(F.col("title")).alias("norm"))


@query(f"""WITH n AS (SELECT ordinal, replace({norm_sql("title")}, ' ', '') AS s FROM raw_records)
SELECT ordinal, CASE WHEN s IS NULL THEN NULL WHEN length(s) = 0 THEN '' WHEN length(s) < 3 THEN s ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))), ',') END AS grams FROM n""")  # fmt: skip
def title_trigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_records").select("ordinal", text.normalize_title(F.col("title")).alias("norm"))
    return rows.select("ordinal", F.when(F.col("norm").isNotNull(), F.array_join(F.array_sort(text.title_trigrams(F.col("norm"))), ",")).alias("grams"))


@query("""WITH RECURSIVE r AS (SELECT doc_id AS n, title, city FROM documents WHERE title IS NOT NULL AND city IS NOT NULL),
e AS (SELECT DISTINCT x.n AS a, y.n AS b FROM r x JOIN r y USING (title) WHERE x.n <> y.n UNION SELECT DISTINCT x.doc_id, y.doc_id FROM documents x JOIN documents y USING (text) WHERE x.doc_id <> y.doc_id AND length(x.text) > 20 AND x.title IS NOT NULL AND y.title IS NOT NULL AND x.city IS NOT NULL AND y.city IS NOT NULL),
c AS (SELECT n, n AS root FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.n)
SELECT n AS node, min(root) AS component FROM c GROUP BY 1""")  # fmt: skip
def components(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("title is not null and city is not null").select(F.col("doc_id").alias("node"), "title", "text")
    # a star for each group of equal titles or texts: as many edges as rows
    stars = None
    for c, r in (("title", rows), ("text", rows.where("length(text) > 20"))):
        e = r.select("node", F.min("node").over(Window.partitionBy(c)).alias("low")).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        stars = e if stars is None else stars.union(e)
    return graph.components(stars, rows)


@query("""WITH p AS (SELECT event_id, ts AS a, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, round(CASE WHEN (strftime(a, '%H%M%S') = '000000') <> (strftime(b, '%H%M%S') = '000000') THEN CASE WHEN a::DATE = b::DATE THEN 0.5 ELSE 0 END WHEN abs(floor(epoch(a)) - floor(epoch(b))) / 60 > 90 THEN 0 ELSE 1 - abs(floor(epoch(a)) - floor(epoch(b))) / 60 / 90 END, 6) AS sim FROM p WHERE b IS NOT NULL""")  # fmt: skip
def time_similarity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("b", F.lag("ts").over(w)).where("b is not null")
    return rows.select("event_id", F.round(similarity.time_similarity(F.col("ts"), F.col("b")), 6).alias("sim"))


GEO = "sqrt(pow((x.lat - y.lat) * 111000, 2) + pow((x.lon - y.lon) * 74000, 2))"


@query(f"""SELECT x.id AS a, y.id AS b, round(CASE WHEN {GEO} < 100 THEN 1 WHEN {GEO} > 2000 THEN 0 ELSE 1 - ({GEO} - 100) / 1900 END, 4) AS sim FROM venues x JOIN venues y ON x.name = y.name AND x.id < y.id WHERE x.lat IS NOT NULL AND y.lat IS NOT NULL AND x.lon IS NOT NULL AND y.lon IS NOT NULL""")
def geo_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").where("lat is not null and lon is not null")
    p = v.alias("x").join(v.alias("y"), "name").where("x.id < y.id")
    return p.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(similarity.distance_similarity(*[F.col(c) for c in ("x.lat", "x.lon", "y.lat", "y.lon")]), 4).alias("sim"))


MARKS = " OR ".join(f"contains(b, '{m}')" for m in dict.fromkeys([*rules.FREE_MARKERS["nl"], *rules.FREE_MARKERS["en"]]))


@query(f"""WITH t AS (SELECT ordinal, lower(concat_ws(' ', title, price)) AS b FROM raw_records)
SELECT ordinal, CASE WHEN b = '' THEN NULL WHEN {MARKS} THEN true WHEN regexp_matches(b, '[€$£]\\s?\\d|\\b(?:eur|euro|usd)\\s?\\d|\\d+[.,]?\\d*\\s?(?:euro|eur)\\b') THEN false END AS free FROM t""")
def free_detection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("ordinal", text.detect_free(F.concat_ws(" ", "title", "price")).alias("free"))


@query("SELECT ordinal, nullif(replace(regexp_extract(concat_ws(' ', description, price), '[€$£]\\s?\\d+(?:[.,]\\d{2})?', 0), ' ', ''), '') AS price_found FROM raw_records")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("ordinal", text.parse_price(F.concat_ws(" ", "description", "price")).alias("price_found"))


def category_sql(texts: str) -> str:
    """CTEs that end in ``cat``: ``id, category_found`` of rows ``id, b, v`` (text and venue in lower case)."""
    one = lambda t, w: f"(CASE WHEN contains(b, '{t}') THEN {w} WHEN contains(v, '{t}') THEN {w / 2} ELSE 0 END)"
    cols = ", ".join(f"({' + '.join(one(t, w) for w, ts in tiers.items() for t in ts)})::DOUBLE AS {k}" for k, tiers in rules.CATEGORIES.items())
    return f"""cat_t AS ({texts}), cat_s AS (SELECT id, {cols} FROM cat_t),
cat_u AS (SELECT id, k, x, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS n, count(*) OVER (PARTITION BY id, x) AS ties FROM (UNPIVOT cat_s ON {", ".join(rules.CATEGORIES)} INTO NAME k VALUE x)),
cat AS (SELECT id, CASE WHEN x = 0 OR (ties > 1 AND x < 2) THEN NULL ELSE k END AS category_found FROM cat_u WHERE n = 1)"""


@query(f"""WITH {category_sql("SELECT id, lower(coalesce(title, '')) AS b, lower(coalesce(venue_name, '')) AS v FROM canonical_events")} SELECT id, category_found FROM cat""")
def categorize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_events").select("id", text.categorize(F.col("title"), F.col("venue_name")).alias("category_found"))


_BARE = "regexp_replace(regexp_replace(html, '<\\s*/?\\s*(br|p|div|li|tr|h[1-6])\\b[^>]*>', ' ', 'gi'), '<[^>]+>', '', 'g')"
for _a, _b in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _BARE = f"replace({_BARE}, '{_a}', {_b})"


@query(f"SELECT page_id, trim(regexp_replace(replace({_BARE}, chr(160), ' '), '\\s+', ' ', 'g'), ' ') AS plain FROM tudelft_events")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """All pages; the SQL resolves the entities that these pages hold."""
    return table(spark, d, "tudelft_events").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query("SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 2048)), '<html') OR contains(lower(substr(html, 1, 2048)), '<!doctype html') THEN 'html' ELSE 'other' END AS kind FROM tudelft_events")
def sniff_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tudelft_events").select("page_id", payloads.sniff(F.col("html"), F.lit(None).cast("string")).alias("kind"))


_PLACE = "(CASE WHEN json_type(v->'location') = 'ARRAY' THEN v->'location'->0 ELSE v->'location' END)"
_WHERE = f"(CASE WHEN json_type({_PLACE}->'address') = 'ARRAY' THEN {_PLACE}->'address'->0 ELSE {_PLACE}->'address' END)"


@query(f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\\b[^>]*ld\\+json[^>]*>(.*?)</script\\s*>', 1)) AS s FROM tudelft_events), n AS (SELECT page_id, t.value AS v FROM b, json_tree(CASE WHEN json_valid(s) THEN s::JSON ELSE '{{}}'::JSON END) t WHERE t.type = 'OBJECT' AND contains(coalesce((t.value->'@type')::VARCHAR, ''), 'Event')),
e AS (SELECT page_id, v->>'name' AS title, coalesce(v->>'startDate', v->>'startdate') AS start_text, CASE json_type({_PLACE}) WHEN 'VARCHAR' THEN {_PLACE}->>'$' WHEN 'OBJECT' THEN coalesce({_PLACE}->>'name', 'Unknown venue') END AS venue_name,
CASE WHEN json_type({_PLACE}) = 'OBJECT' THEN CASE json_type({_WHERE}) WHEN 'OBJECT' THEN nullif(concat_ws(' ', {_WHERE}->>'streetAddress', {_WHERE}->>'postalCode'), '') WHEN 'VARCHAR' THEN {_WHERE}->>'$' END END AS venue_address, CASE WHEN json_type({_WHERE}) = 'OBJECT' THEN {_WHERE}->>'addressLocality' END AS venue_city, v->>'description' AS description FROM n)
SELECT title, start_text, venue_name, venue_address, venue_city, description FROM e WHERE title <> '' AND start_text <> ''""")  # fmt: skip
def jsonld_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "tudelft_events").select(F.lit("tudelft_events").alias("source_id"), F.col("html").alias("body"), "page_id")
    return payloads.extract(pages, table(spark, d, "registry")).select("title", "start_text", "venue_name", "venue_address", "venue_city", "description")


def _trip(spark: SparkSession, d: str, source: str, body: F.Column) -> DataFrame:
    rows = table(spark, d, "venues").select(F.lit(source).alias("source_id"), body.alias("body"))
    return payloads.extract(rows, table(spark, d, "registry")).where("error is null")


_ESC = "replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("SELECT 'https://x.example/agenda/' || id AS url, name AS title, '2026-09-01T20:00:00' AS start_text FROM venues")
def rss_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<rss><channel><item><title>"), F.expr(_ESC), F.lit("</title><link>https://x.example/agenda/"), "id", F.lit("</link><startdate>2026-09-01T20:00:00</startdate></item></channel></rss>"))
    return _trip(spark, d, "delft_uitkalender", body).where("reject is null").select("url", "title", "start_text")


@query("SELECT id, name AS title, '/p/' || id AS link FROM venues")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "venues").select("id", F.col("name").alias("title"), F.concat(F.lit("https://x.example/"), "id").alias("url"), F.concat(F.lit("<a href='/p/"), "id", F.lit("'>x</a><a href='https://y.example/'>y</a><a href=''>z</a>")).alias("body"))
    links = payloads.page_links(rows, "body", "url")
    return rows.join(links, "url").select("id", "title", F.regexp_extract("link", "(/p/.*)$", 1).alias("link"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_shipdate AS t, l_linenumber AS n FROM lineitem)
SELECT k, count(*) AS n_dates, string_agg(strftime(t, '%Y%m%dT%H%M%S'), ',' ORDER BY t, n) AS dates FROM r GROUP BY 1""")  # fmt: skip
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("ordinal"), F.lit("s").alias("source_id"), F.concat(F.lit("show "), F.col("l_orderkey")).alias("title"), F.lit("house").alias("venue_name"), F.col("l_shipdate").alias("start_local"), F.lit(None).cast("string").alias("rrule"))
    got = recurrence.collapse(rows)
    first = F.date_format("start_local", "yyyyMMdd'T'HHmmss")
    return got.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("k"), F.col("n_dates").cast("long").alias("n_dates"), F.concat_ws(",", first, F.regexp_replace("rrule", "^RDATE:", "")).alias("dates"))


@query()
def audit_all(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(events_of(spark, d).where("title is not null"), table(spark, d, "venues"), table(spark, d, "registry"), NOW)


@query("""SELECT id FROM registry WHERE enabled AND (id IN (SELECT id FROM registry WHERE city = 'Delft') OR rtrim(url, '/') IN (SELECT rtrim(url, '/') FROM registry WHERE city = 'Delft'))""")
def holdout_leak(spark: SparkSession, d: str) -> DataFrame:
    from kiosko.sources import registry

    r = table(spark, d, "registry")
    return registry.leaked(r.where("enabled"), r.where("city = 'Delft'")).select("id")


@query("""SELECT id, substr(sha1(source_ids[1] || '|' || lower(title) || '|' || start_iso), 1, 16) AS fingerprint, replace(rtrim(translate(to_base64((epoch(start_at)::BIGINT::VARCHAR || '|' || id)::BLOB), '+/', '-_'), '='), '', '') AS cursor FROM canonical_events WHERE title IS NOT NULL""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_events").where("title is not null")
    return e.select("id", keys.fingerprint(F.get("source_ids", F.lit(0)), F.col("title"), F.col("start_iso")).alias("fingerprint"), keys.cursor(F.unix_seconds("start_at").cast("string"), F.col("id")).alias("cursor"))


EVIDENCE_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TIER_EVIDENCE.items())
TRUST_SQL = " ".join(f"WHEN {k} THEN {v}" for k, v in rules.TRUST_EVIDENCE.items())


@query(f"""SELECT event_id, field, source_id, tier, trust, agreeing, dissenting, round(least(0.99, (CASE tier {EVIDENCE_SQL} ELSE 0.5 END)::DOUBLE * (CASE coalesce(trust, 3) {TRUST_SQL} ELSE 0.9 END)::DOUBLE * (1 + least(0.25, 0.12 * (agreeing - 1)))::DOUBLE * (CASE WHEN dissenting > 0 THEN greatest(0.55, 1 - 0.18 * dissenting) ELSE 1.0 END)::DOUBLE), 6) AS conf FROM field_provenance""")
def field_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "field_provenance")
    return p.select("event_id", "field", "source_id", "tier", "trust", "agreeing", "dissenting", resolve.confidence(F.col("tier"), F.col("trust"), F.col("agreeing"), F.col("dissenting"), 6).alias("conf"))


@query("""WITH e AS (SELECT coalesce(venue_id, 'n:' || venue_name) AS marker, id, title, start_at, len(source_ids) AS n FROM canonical_events WHERE withdrawn_at IS NULL AND (venue_id IS NOT NULL OR venue_name IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY start_at, id) AS k FROM e)
SELECT marker, count(*) AS n_events, max(n) AS most_sources, coalesce(string_agg(title, ' / ' ORDER BY k) FILTER (k <= 12), '') AS titles FROM r GROUP BY 1""")  # fmt: skip
def marker_groups(spark: SparkSession, d: str) -> DataFrame:
    return reading.markers(table(spark, d, "canonical_events"))


@query("SELECT id, CASE lower(city) WHEN 'delft' THEN lat BETWEEN 51.97 AND 52.04 AND lon BETWEEN 4.32 AND 4.40 WHEN 'madrid' THEN lat BETWEEN 40.31 AND 40.56 AND lon BETWEEN -3.89 AND -3.52 ELSE true END AS inside FROM venues WHERE lat IS NOT NULL AND lon IS NOT NULL AND city IS NOT NULL")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").where("lat is not null and lon is not null and city is not null")
    return v.select("id", geography.in_box(F.col("lat"), F.col("lon"), F.col("city")).alias("inside"))


_CLEAN = "trim(name, ' ')"
for _ in range(3):  # endings stack
    _CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '{geography.NOISE.removeprefix('(?iu)')}', '', 'i'), '\\s*[|\\-–—,(]\\s*(?:in\\s+)?' || regexp_escape(town) || '\\s*\\)?\\s*$', '', 'i')"
    _CLEAN = f"regexp_replace({_CLEAN}, '^[ \\-|–—·:,]+|[ \\-|–—·:,]+$', '', 'g')"


@query(f"""WITH v AS (SELECT id, name, nullif(trim(address, ' '), '') AS street, trim(city, ' ') AS town FROM venues WHERE city IS NOT NULL), c AS (SELECT *, coalesce(nullif({_CLEAN}, ''), trim(name, ' ')) AS n FROM v),
o AS (SELECT *, CASE WHEN n <> '' AND NOT regexp_matches(trim(n, ' '), '{geography.GENERIC.removeprefix("(?iu)")}', 'i') THEN n END AS own FROM c)
SELECT id, unnest(list_distinct(list_filter([own || ', ' || street || ', ' || town, own || ', ' || town, street || ', ' || town], lambda q: q IS NOT NULL))) AS query FROM o""")  # fmt: skip
def query_ladder(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "venues").where("city is not null")
    return v.select("id", F.explode(geography.ladder(geography.clean_name(F.col("name"), F.trim("city")), F.col("address"), F.trim("city"))).alias("query"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Event pages, and raw descriptions as pages of their own."""
    a = table(spark, d, "tudelft_events").select("url", F.col("html").alias("body"))
    return a.union(table(spark, d, "raw_records").where("description is not null").select(F.concat(F.lit("r"), "ordinal"), "description"))


_RE = {k: getattr(probe, k).removeprefix("(?i)") for k in ("TICKETS", "SCRIPTED", "SOCIAL", "DATED")}


@query(f"""WITH p AS (SELECT html AS b FROM tudelft_events UNION ALL SELECT description FROM raw_records WHERE description IS NOT NULL), t AS (SELECT b, regexp_replace(regexp_replace(b, '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g') AS x FROM p),
m AS (SELECT b, x, regexp_matches(x, '\\b(elke|iedere)\\s+(maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)\\b|\\blive\\s*muziek\\b|\\bagenda\\b|\\bprogramma\\b|\\boptreden\\b|\\bborrel\\b|\\bpubquiz\\b|\\bworkshop\\b|\\bconcert\\b|\\bvoorstelling\\b|\\bexpositie\\b|\\bfestival\\b', 'i') AS told FROM t)
SELECT CASE WHEN regexp_matches(b, '{_RE["TICKETS"]}', 'i') THEN 'tickets elsewhere' WHEN told AND regexp_matches(x, '{_RE["DATED"]}', 'i') THEN 'prose with dates' WHEN told THEN 'prose without dates' WHEN regexp_matches(b, '{_RE["SCRIPTED"]}', 'i') THEN 'rendered by script' WHEN regexp_matches(b, '{_RE["SOCIAL"]}', 'i') THEN 'social media only' ELSE 'nothing about events' END AS verdict,
count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM m GROUP BY 1""")  # fmt: skip
def census_classify(spark: SparkSession, d: str) -> DataFrame:
    return probe.census(_pages(spark, d))


@query("SELECT url, 'jsonld' AS tier, count(*) AS pages FROM tudelft_events WHERE contains(html, 'ld+json') GROUP BY 1")
def probe_best(spark: SparkSession, d: str) -> DataFrame:
    found = probe.routes(table(spark, d, "tudelft_events").select(F.concat_ws(" ", "url", "page_id").alias("url"), F.col("html").alias("body")))
    return probe.best(found).groupBy(F.substring_index("url", " ", 1).alias("url"), "tier").agg(F.count("*").alias("pages"))


# the queries of these modules register themselves
from kiosko.plans import extraction, resolution, surface  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
