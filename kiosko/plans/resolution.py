"""Queries of resolution and measurement, with their SQL. Token-set likeness is written out in SQL: the longest common
subsequence by bits of a wide integer, one step for each letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiosko.functions import rules, text
from kiosko.operators import audit, graph, measures, resolve
from kiosko.plans.catalogue import NOW, category_sql, norm_sql, query
from kiosko.plans.instants import utc_sql
from kiosko.session import checkpointed, table
from kiosko.sources import registry


def token_set_sql(of: str, name: str = "l") -> str:
    """CTEs that end in ``name``: the rows of ``of`` (with texts ``ta, tb``) and ``sim``, their token-set likeness from 0 to 1."""
    words = lambda c: f"list_sort(list_distinct(list_filter(regexp_split_to_array({c}, '[\\s\u00a0]+'), lambda w: w <> '')))"
    return f"""{name}1 AS (SELECT *, {words("ta")} AS wa, {words("tb")} AS wb FROM {of}),
{name}2 AS (SELECT * EXCLUDE (wa, wb), len(wa) = 0 OR len(wb) = 0 AS none, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS s, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS x0, array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS y0 FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (x0, y0), CASE WHEN length(x0) <= length(y0) THEN x0 ELSE y0 END AS x, CASE WHEN length(x0) <= length(y0) THEN y0 ELSE x0 END AS y FROM {name}2),
{name}4 AS (SELECT *, (1::HUGEINT << length(x)) - 1 AS f, CASE WHEN x = '' THEN [] ELSE list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN substr(x, i, 1) = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT) END AS masks FROM {name}3),
{name}5 AS (SELECT * EXCLUDE (masks), CASE WHEN x = '' THEN 0 ELSE length(x) - bit_count(list_reduce(list_prepend(f, masks), lambda v, m: ((v + (v & m)) | (v & ~m)) & f)) END AS lcs, length(s) AS ls, CASE WHEN s = '' THEN 0 ELSE 1 END AS gap FROM {name}4),
{name}6 AS (SELECT * EXCLUDE (f), 1 - (length(x) + length(y) - 2 * lcs) / (2 * (ls + gap) + length(x) + length(y))::DOUBLE AS best FROM {name}5),
{name} AS (SELECT * EXCLUDE (none, s, x, y, lcs, ls, gap, best), CASE WHEN none THEN 0.0 WHEN s <> '' AND (x = '' OR y = '') THEN 1.0 WHEN s = '' THEN best
ELSE greatest(best, 1 - (gap + length(x)) / (ls + ls + gap + length(x))::DOUBLE, 1 - (gap + length(y)) / (ls + ls + gap + length(y))::DOUBLE) END AS sim FROM {name}6)"""


CLOCK = lambda c: f"({c} % 86400 = 0)"
GEO = "sqrt(pow((x.venue.lat - y.venue.lat) * 111000, 2) + pow((x.venue.lon - y.venue.lon) * 74000, 2))"
#: raw_records as claims, with the time of fetching as the clock, so that SQL of resolution stands without that of times.
CLAIMS = f"""r AS (SELECT ordinal, source_id, x.source_type, x.trust, title, g.city, floor(epoch(fetched_at))::BIGINT AS s, floor(epoch(fetched_at))::BIGINT AS l, venue, {norm_sql("title")} AS norm, x.url, is_free, price, rrule, end_raw, description FROM raw_records x JOIN registry g ON x.source_id = g.id WHERE trim(title, ' ') <> '' AND fetched_at IS NOT NULL)"""
_LANG = f"CASE locale WHEN 'nl' THEN {norm_sql('title')} WHEN 'es' THEN {norm_sql('title', 'es')} ELSE {norm_sql('title', 'en')} END"
_EAST = "(epoch(timezone(zone, to_timestamp(utc_second)))::BIGINT - utc_second) // 60"
#: The same with the starts that the records state.
STATED = f"""f AS (SELECT x.* EXCLUDE (trust), coalesce(x.trust, g.trust, 99) AS trust, g.city AS town, g.locale, coalesce(g.timezone, 'Europe/Amsterdam') AS zone, source_id AS src, start_raw AS text FROM raw_records x JOIN registry g ON x.source_id = g.id), {utc_sql("f")},
r AS (SELECT ordinal, source_id, source_type, trust, title, town AS city, utc_second AS s, utc_second + 60 * ({_EAST}) AS l, venue, {_LANG} AS norm, url, is_free, price, rrule, end_raw, description, format('{{}}{{:02d}}:{{:02d}}', CASE WHEN {_EAST} < 0 THEN '-' ELSE '+' END, abs({_EAST}) // 60, abs({_EAST}) % 60) AS east FROM tm WHERE utc_second IS NOT NULL AND trim(title, ' ') <> '')"""
DAY = "strftime(to_timestamp(l) AT TIME ZONE 'UTC', '%Y-%m-%d')"


def pairs_sql(claims: str) -> str:
    """CTEs that end in ``c``: the candidate pairs of claims ``r`` (``s`` the instant, ``l`` the local clock, in seconds)."""
    return f"""{claims}, t AS (SELECT *, replace(norm, ' ', '') AS flat FROM r),
k AS (SELECT ordinal, source_id, city, unnest(list_concat(list_concat(CASE WHEN venue IS NULL THEN [] ELSE ['dayloc:' || {DAY} || ':' || CASE WHEN venue.lat IS NULL OR venue.lon IS NULL THEN 'nogeo' ELSE format('{{:.3f}},{{:.3f}}', round_even(venue.lat, 3), round_even(venue.lon, 3)) END] END,
  CASE WHEN length(flat) = 0 THEN [] WHEN length(flat) < 3 THEN ['daytri:' || {DAY} || ':' || flat] ELSE list_transform(list_distinct(list_transform(range(1, length(flat) - 1), lambda i: substr(flat, i, 3))), lambda g: 'daytri:' || {DAY} || ':' || g) END), CASE WHEN norm = '' THEN [] ELSE ['title:' || norm] END)) AS k FROM t),
fit AS (SELECT city, k FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60),
c AS (SELECT DISTINCT x.ordinal AS a, y.ordinal AS b FROM k x JOIN fit USING (city, k) JOIN k y USING (city, k) WHERE x.ordinal < y.ordinal AND x.source_id <> y.source_id)"""


def scores_sql(claims: str) -> str:
    """CTEs that end in ``sc``: ``a, b, exact`` (to nine digits) and ``score`` of the candidate pairs."""
    return f"""{pairs_sql(claims)},
p AS (SELECT a, b, x.norm AS ta, y.norm AS tb, CASE WHEN {CLOCK("x.l")} <> {CLOCK("y.l")} THEN CASE WHEN x.l // 86400 = y.l // 86400 THEN 0.5 ELSE 0.0 END WHEN abs(x.s - y.s) > 5400 THEN 0.0 ELSE 1 - abs(x.s - y.s) / 5400.0 END AS ti,
  CASE WHEN x.venue IS NULL OR y.venue IS NULL THEN 0.5 WHEN {GEO} IS NOT NULL THEN CASE WHEN {GEO} < 100 THEN 1.0 WHEN {GEO} > 2000 THEN 0.0 ELSE 1 - ({GEO} - 100) / 1900 END WHEN x.venue.name <> '' AND y.venue.name <> '' THEN NULL ELSE 0.5 END AS ve,
  lower(x.venue.name) AS va, lower(y.venue.name) AS vb FROM c JOIN r x ON x.ordinal = a JOIN r y ON y.ordinal = b WHERE abs(x.s - y.s) <= 86400),
{token_set_sql("p")}, l_ AS (SELECT a, b, ti, ve, sim AS st, va AS ta, vb AS tb FROM l), {token_set_sql("l_", "v")},
sc AS (SELECT a, b, round(0.45 * st + 0.35 * ti + 0.20 * coalesce(ve, sim), 9)::DOUBLE AS exact, round(round(0.45 * st + 0.35 * ti + 0.20 * coalesce(ve, sim), 9) + 3.7e-10, 6)::DOUBLE AS score FROM v)"""


PAIRS, SCORES = pairs_sql(CLAIMS), scores_sql(CLAIMS)
_RANK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TIER_EVIDENCE.items())
ORDER = f"coalesce(trust, 99), CASE source_type {_RANK} ELSE 0.5 END DESC, source_id, ordinal"


def merged_sql(clustered: str, extra: str = "") -> str:
    """CTEs over ``clustered`` (claims with ``cluster``) that end in ``ev``: one event for each cluster."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) AS pos FROM {clustered}),
g AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length(description) DESC, pos) AS long FROM n WHERE description <> ''),
m AS (SELECT cluster, min(title) FILTER (pos = 1) AS title, min(city) FILTER (pos = 1) AS city, min(s) FILTER (pos = 1) AS start_second, arg_min(url, pos) FILTER (url <> '') AS url, arg_min(price, pos) FILTER (price <> '') AS price, arg_min(rrule, pos) FILTER (rrule <> '') AS rrule, arg_min(is_free, pos) FILTER (is_free IS NOT NULL) AS is_free, {extra}
  count(*) AS n_members, count(DISTINCT source_id) AS n_sources, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_ids, string_agg(lower(title || ' ' || coalesce(description, '')), chr(10)) AS blob FROM n GROUP BY 1),
h AS (SELECT cluster, venue.name AS venue FROM n WHERE venue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY venue.lat IS NULL, pos) = 1),
{category_sql("SELECT m.cluster AS id, blob AS b, lower(coalesce(h.venue, '')) AS v FROM m LEFT JOIN h USING (cluster)")},
ev AS (SELECT m.*, h.venue, cat.category_found AS category, g.description, least(1.0, round(0.6 + 0.2 * n_sources, 6))::DOUBLE AS confidence FROM m LEFT JOIN h USING (cluster) LEFT JOIN cat ON cat.id = m.cluster LEFT JOIN g ON g.cluster = m.cluster AND g.long = 1)"""


@query(f"""WITH RECURSIVE {scores_sql(STATED)}, e AS (SELECT a AS n, b AS m FROM sc WHERE exact >= 0.72 UNION SELECT b, a FROM sc WHERE exact >= 0.72),
w AS (SELECT ordinal AS n, ordinal AS root FROM r UNION SELECT e.m, w.root FROM w JOIN e USING (n)), u AS (SELECT n AS ordinal, min(root) AS cluster FROM w GROUP BY 1), o AS (SELECT * FROM r JOIN u USING (ordinal)),
{merged_sql("o", "min(strftime(to_timestamp(l) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || east) FILTER (pos = 1) AS start_iso,")}
SELECT substr(sha1({norm_sql("title")} || '|' || start_iso || '|' || city), 1, 16) AS id, title, city, start_second, venue, category, description, url, is_free, price, n_members, n_sources, source_ids, confidence FROM ev""")  # fmt: skip
def flagship_entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    got = resolve.deduplicate(table(spark, d, "raw_records"), table(spark, d, "registry"))
    return got.select("id", "title", "city", F.unix_seconds("start").alias("start_second"), F.col("venue.name").alias("venue"), "category", "description", "url", "is_free", "price", "n_members", "n_sources", F.array_join("source_ids", ",").alias("source_ids"), "confidence")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    home = table(spark, d, "registry").select(F.col("id").alias("_id"), "city")
    r = table(spark, d, "raw_records").where(F.col("fetched_at").isNotNull() & (F.trim("title") != ""))
    r = r.join(F.broadcast(home), r["source_id"] == F.col("_id")).drop("_id")
    local = F.col("fetched_at").cast("timestamp_ntz")
    return r.withColumns({"start": F.col("fetched_at"), "start_local": local, "start_iso": F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"), "norm": text.normalize_title(F.col("title"))})


@query(f"WITH {PAIRS} SELECT a, b FROM c")
def block_candidates(spark: SparkSession, d: str) -> DataFrame:
    return resolve.candidates(_claims(spark, d))


@query(f"WITH {PAIRS} SELECT ordinal, count(*) AS n FROM (SELECT DISTINCT x.ordinal, y.ordinal AS other FROM k x JOIN k y USING (city, k) WHERE x.ordinal < y.ordinal AND x.source_id <> y.source_id) GROUP BY 1")
def block_candidates_uncapped(spark: SparkSession, d: str) -> DataFrame:
    """Every block, whatever its size: as many pairs from each record as it has neighbours, so counted, not listed."""
    pairs = resolve.candidates(_claims(spark, d), cap=None)
    return pairs.groupBy(F.col("a").alias("ordinal")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORES} SELECT a, b, score FROM sc")
def pair_score(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(_claims(spark, d))
    return resolve.scores(rows, resolve.candidates(rows)).withColumn("score", F.round(F.col("score") + 3.7e-10, 6))


@query(f"""WITH RECURSIVE {SCORES}, e AS (SELECT a AS n, b AS m FROM sc WHERE score >= 0.72 UNION SELECT b, a FROM sc WHERE score >= 0.72),
w AS (SELECT ordinal AS n, ordinal AS root FROM r UNION SELECT e.m, w.root FROM w JOIN e USING (n)) SELECT n AS ordinal, min(root) AS cluster FROM w GROUP BY 1""")  # fmt: skip
def resolve_clusters(spark: SparkSession, d: str) -> DataFrame:
    return resolve.clusters(checkpointed(_claims(spark, d)))


THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.72, 0.75, 0.80, 0.85, 0.90)


@query(f"""WITH RECURSIVE {SCORES}, th AS (SELECT unnest([{", ".join(map(str, THRESHOLDS))}])::DOUBLE AS threshold), e AS (SELECT threshold, a AS n, b AS m FROM sc JOIN th ON score >= threshold UNION SELECT threshold, b, a FROM sc JOIN th ON score >= threshold),
w AS (SELECT threshold, ordinal AS n, ordinal AS root FROM r, th UNION SELECT w.threshold, e.m, w.root FROM w JOIN e USING (threshold, n)),
o AS (SELECT threshold, n, min(root) AS c FROM w GROUP BY ALL), z AS (SELECT threshold, c, count(*) AS k, count(DISTINCT source_id) AS s, max(CASE WHEN s % 86400 <> 0 THEN s END) - min(CASE WHEN s % 86400 <> 0 THEN s END) AS d FROM o JOIN r ON ordinal = n GROUP BY ALL),
nn AS (SELECT DISTINCT threshold, c, norm FROM o JOIN r ON ordinal = n WHERE norm <> ''), tt AS (SELECT DISTINCT x.norm AS ta, y.norm AS tb FROM nn x JOIN nn y USING (threshold, c) WHERE x.norm < y.norm), {token_set_sql("tt", "q")},
torn AS (SELECT DISTINCT x.threshold, x.c FROM nn x JOIN nn y USING (threshold, c) JOIN q ON q.ta = x.norm AND q.tb = y.norm WHERE q.sim < 0.5)
SELECT z.threshold, count(*) AS canonical, sum(k - 1)::BIGINT AS merged, count(*) FILTER (s > 1) AS multi, count(*) FILTER (s > 1 AND d > 10800) AS time_conflicts, count(*) FILTER (s > 1 AND torn.c IS NOT NULL) AS title_conflicts FROM z LEFT JOIN torn ON torn.threshold = z.threshold AND torn.c = z.c GROUP BY 1""")  # fmt: skip
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(_claims(spark, d))
    scored = checkpointed(resolve.scores(rows, resolve.candidates(rows)).withColumn("score", F.round(F.col("score") + 3.7e-10, 6)))
    second = F.unix_seconds("fetched_at")
    nodes = rows.select(F.col("ordinal").alias("node"), "source_id", "norm", second.alias("second"), (second % 86400 == 0).alias("midnight"))
    return measures.sweep(scored, nodes, THRESHOLDS)


GROUPED = f"{CLAIMS}, o AS (SELECT *, min(ordinal) OVER (PARTITION BY city, norm) AS cluster FROM r)"


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims, and the clusters of equal comparison keys of a city."""
    rows = checkpointed(_claims(spark, d))
    first = rows.groupBy("city", "norm").agg(F.min("ordinal").alias("cluster"))
    return rows, rows.join(first, ["city", "norm"]).select("ordinal", "cluster")


@query(f"""WITH {GROUPED}, {merged_sql("o")} SELECT cluster, title, city, start_second, url, price, rrule, is_free, venue, n_members, n_sources, source_ids, category, description, confidence FROM ev""")
def merge_precedence(spark: SparkSession, d: str) -> DataFrame:
    got = resolve.merge(*_grouped(spark, d))
    return got.select("cluster", "title", "city", F.unix_seconds("start").alias("start_second"), "url", "price", "rrule", "is_free", F.col("venue.name").alias("venue"), "n_members", "n_sources", F.array_join("source_ids", ",").alias("source_ids"), "category", "description", "confidence")


@query(f"WITH {GROUPED} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY {ORDER}) AS position, ordinal, source_id, trust, title, venue.name AS venue, price FROM o")
def event_members(spark: SparkSession, d: str) -> DataFrame:
    return resolve.members(*_grouped(spark, d)).select("cluster", "position", "ordinal", "source_id", "trust", "title", "venue", "price")


_SAME = f"CASE field WHEN 'title' THEN {norm_sql('claim')} WHEN 'start' THEN coalesce(strftime(try_cast(claim AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H'), claim) ELSE left(lower(trim(claim, ' ')), 120) END"
ORIGINS = f"""g AS (SELECT *, {_SAME} AS c, coalesce(trust, 99) AS t, (CASE tier {_RANK} ELSE 0.5 END)::DOUBLE AS e FROM field_provenance WHERE claim <> ''),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY t, e DESC, source_id, claim, tier) AS n FROM g), f AS (SELECT event_id, field, claim AS value, source_id, trust, tier, c, e FROM w WHERE n = 1),
o AS (SELECT f.event_id, f.field, f.value, f.source_id, f.trust, f.tier, count(*) FILTER (g.c = f.c) AS agreeing, count(*) FILTER (g.c <> f.c) AS dissenting, min(f.e) AS e FROM f JOIN g ON g.event_id = f.event_id AND g.field = f.field GROUP BY ALL)"""
_TRUST = " ".join(f"WHEN {k} THEN {v}" for k, v in rules.TRUST_EVIDENCE.items())


@query(f"""WITH {ORIGINS} SELECT event_id, field, value, source_id, agreeing, dissenting,
round(least(0.99, e * (CASE coalesce(trust, 3) {_TRUST} ELSE 0.9 END)::DOUBLE * (1 + least(0.25, 0.12 * (agreeing - 1)))::DOUBLE * (CASE WHEN dissenting > 0 THEN greatest(0.55, 1 - 0.18 * dissenting) ELSE 1.0 END)::DOUBLE), 6)::DOUBLE AS confidence FROM o""")  # fmt: skip
def field_origins(spark: SparkSession, d: str) -> DataFrame:
    return resolve.origins(table(spark, d, "field_provenance"), digits=6).select("event_id", "field", "value", "source_id", "agreeing", "dissenting", "confidence")


@query(f"""WITH {ORIGINS}, v AS (SELECT event_id, field, claim AS was FROM field_provenance WHERE epoch(updated_at)::BIGINT % 2 = 0 QUALIFY row_number() OVER (PARTITION BY event_id, field ORDER BY updated_at DESC, source_id DESC, claim DESC) = 1),
k AS (SELECT DISTINCT event_id, field FROM field_provenance WHERE epoch(updated_at)::BIGINT % 2 = 0)
SELECT o.event_id, o.field, v.was AS old_value, o.value AS new_value, o.source_id FROM o LEFT JOIN v USING (event_id, field) LEFT JOIN k USING (event_id, field) WHERE k.event_id IS NULL OR v.was IS DISTINCT FROM o.value""")  # fmt: skip
def recorded_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The claims of even seconds as the log so far, the origins of all claims against it."""
    p = table(spark, d, "field_provenance")
    log = p.where(F.unix_seconds("updated_at") % 2 == 0)
    log = log.select("event_id", "field", F.col("claim").alias("new_value"), F.col("updated_at").alias("changed_at"), F.struct("source_id", "claim").alias("id"))
    got = resolve.recorded(resolve.origins(p), log, F.timestamp_seconds(F.lit(NOW)))
    return got.select("event_id", "field", "old_value", "new_value", "source_id")


#: Listings of calendars as held-out sources, against the events of one city that another source shows first.
_ID = "('0x' || substr({}, 1, 15))::BIGINT"
HELD = f"""e AS (SELECT *, {_ID.format("id")} AS n, lower(trim(city, ' ')) AS stated FROM canonical_events),
m AS (SELECT e.n, unnest(members) AS m, stated, is_free FROM e), q AS (SELECT n, m.source_id AS source, m.title AS title, m.venue AS venue, m.price AS price, floor(epoch(try_cast(m.start_iso AS TIMESTAMPTZ)))::BIGINT AS s, stated = '' OR stated IS NULL OR contains(stated, 'delft') OR contains('delft', stated) AS here, is_free FROM m),
h AS (SELECT *, {norm_sql("title")} AS norm FROM q WHERE source LIKE '%uitkalender%' AND s BETWEEN {NOW} AND {NOW} + 90 * 86400),
c AS (SELECT n, title, venue_name AS venue, is_free, floor(epoch(start_at))::BIGINT AS s, {norm_sql("title")} AS norm FROM e WHERE lower(city) = 'delft' AND source_ids[1] NOT LIKE '%uitkalender%')"""
MEET = lambda a, b: f"mt AS (SELECT x.n AS a, y.n AS b, x.norm AS ta, y.norm AS tb FROM {a} x JOIN {b} y ON abs(x.s - y.s) <= 21600 WHERE x.here AND x.norm <> '' AND y.norm <> ''), {token_set_sql('mt')}, hit AS (SELECT a, b FROM l WHERE sim >= 0.85)"


def _whole(c: str) -> F.Column:
    return F.conv(F.substring(c, 1, 15), 16, 10).cast("long")


def _held(spark: SparkSession, d: str, like: str) -> DataFrame:
    m = table(spark, d, "canonical_events").select(_whole("id").alias("id"), "city", "is_free", F.explode("members").alias("m")).where(F.col("m.source_id").like(like))
    here = measures.in_target_city(F.col("city"), F.lit(None).cast("string"), "Delft")
    return m.select("id", F.col("m.source_id").alias("source"), F.lit("Delft").alias("city"), F.unix_seconds(F.try_to_timestamp("m.start_iso")).alias("second"), text.normalize_title(F.col("m.title")).alias("norm"), here.alias("in_scope"), F.col("m.title").alias("title"), F.col("m.venue").alias("venue"), F.when(F.col("m.price").isNotNull(), F.col("is_free")).alias("is_free"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_events").where(~F.get("source_ids", F.lit(0)).like("%uitkalender%"))
    return registry.corpus(e, "Delft").withColumn("id", _whole("id"))


@query(f"""WITH {HELD}, {MEET("h", "c")} SELECT source, count(*) FILTER (here) AS total, count(*) FILTER (here AND n IN (SELECT a FROM hit)) AS matched, count(*) FILTER (NOT here) AS out_of_scope,
round(coalesce(count(*) FILTER (here AND n IN (SELECT a FROM hit)) / nullif(count(*) FILTER (here), 0), 0), 6)::DOUBLE AS recall FROM h GROUP BY 1""")  # fmt: skip
def recall_measure(spark: SparkSession, d: str) -> DataFrame:
    return measures.recall(_held(spark, d, "%uitkalender%"), _corpus(spark, d), NOW)


@query(f"WITH {HELD}, {MEET('h', 'c')} SELECT n AS id, source, title FROM h WHERE here AND n NOT IN (SELECT a FROM hit)")
def recall_misses(spark: SparkSession, d: str) -> DataFrame:
    return measures.misses(_held(spark, d, "%uitkalender%"), _corpus(spark, d), NOW).select("id", "source", "title")


@query(f"""WITH {HELD}, h2 AS (SELECT *, {norm_sql("title")} AS norm FROM q WHERE source LIKE '%studentenbord%' AND here AND s BETWEEN {NOW} AND {NOW} + 90 * 86400), h1 AS (SELECT * FROM h WHERE here), {MEET("h1", "h2")}, o AS (SELECT count(DISTINCT a) AS overlap FROM hit), na AS (SELECT count(*) AS n FROM h1), nb AS (SELECT count(*) AS n FROM h2), nc AS (SELECT count(*) AS n FROM c)
SELECT na.n AS n_a, nb.n AS n_b, overlap, round((na.n * nb.n / nullif(overlap, 0))::DOUBLE, 4) AS estimate, round((nc.n / (na.n * nb.n / nullif(overlap, 0)))::DOUBLE, 6) AS coverage FROM o, na, nb, nc""")  # fmt: skip
def capture_recapture(spark: SparkSession, d: str) -> DataFrame:
    size = _corpus(spark, d).count()
    got = measures.capture_recapture(_held(spark, d, "%uitkalender%"), _held(spark, d, "%studentenbord%"), size, NOW)
    return got.withColumns({"estimate": F.round("estimate", 4), "coverage": F.round("coverage", 6)})


GOLD = f"""{HELD}, g AS (SELECT *, {norm_sql("title")} AS norm FROM q WHERE source LIKE '%uitkalender%' AND here), {MEET("g", "c")},
cand AS (SELECT a, list_sort(list(b)) AS bs, row_number() OVER (ORDER BY a) AS i FROM hit GROUP BY a), go AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b
UNION ALL SELECT cand.i, CASE WHEN list_filter(bs, lambda y: NOT list_contains(used, y))[1] IS NULL THEN used ELSE list_append(used, list_filter(bs, lambda y: NOT list_contains(used, y))[1]) END, cand.a, list_filter(bs, lambda y: NOT list_contains(used, y))[1] FROM go JOIN cand ON cand.i = go.i + 1), pr AS (SELECT a, b FROM go WHERE b IS NOT NULL)"""


@query(f"""WITH RECURSIVE {GOLD}, z AS (SELECT g.n, abs(g.s - c.s) <= 1800 AS st, g.venue AS gv, lower(g.venue) AS ta, lower(coalesce(c.venue, '')) AS tb, CASE WHEN g.price IS NOT NULL THEN g.is_free END AS gf, c.is_free AS cf FROM pr JOIN g ON g.n = a JOIN c ON c.n = b), {token_set_sql("z", "v")},
t AS (SELECT count(*) AS matched, round(avg(st::INT), 6)::DOUBLE AS start_right, round(avg(CASE WHEN gv IS NOT NULL THEN (round(sim * 100, 9) >= 80)::INT END), 6)::DOUBLE AS venue_right, round(avg(CASE WHEN gf IS NOT NULL THEN coalesce(gf = cf, false)::INT END), 6)::DOUBLE AS free_right FROM v), ng AS (SELECT count(*) AS g FROM g), nc AS (SELECT count(*) AS c FROM c)
SELECT matched, start_right, venue_right, free_right, g - matched AS missed, c - matched AS spurious, round(coalesce(matched / nullif(c, 0), 0), 6)::DOUBLE AS precision, round(coalesce(matched / nullif(g, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * (matched / nullif(c, 0)) * (matched / nullif(g, 0)) / nullif(matched / nullif(c, 0) + matched / nullif(g, 0), 0), 0), 6)::DOUBLE AS f1 FROM t, ng, nc""")  # fmt: skip
def evaluate_prf(spark: SparkSession, d: str) -> DataFrame:
    return measures.evaluate(_held(spark, d, "%uitkalender%").where("in_scope"), _corpus(spark, d))


@query(f"WITH RECURSIVE {GOLD} SELECT source, count(*) FILTER (n IN (SELECT a FROM pr)) AS found, count(*) AS total FROM g GROUP BY 1")
def evaluate_by_source(spark: SparkSession, d: str) -> DataFrame:
    return measures.recall_by_source(_held(spark, d, "%uitkalender%").where("in_scope"), _corpus(spark, d))
