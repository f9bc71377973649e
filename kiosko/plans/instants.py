"""The SQL of mixed time texts: one pattern for each form, a date that the calendar accepts, and the zone's own clock."""

from __future__ import annotations

from kiosko.operators import times

_MONTHS = ", ".join(f"('{name}', {n})" for n, names in times.MONTHS.items() for name in dict.fromkeys(names.split()))
_OFFSETS = " ".join(f"WHEN '{k}' THEN {v * 3600}" for k, v in times.ABBREVIATIONS.items())


def _parts(pattern: str, names: str) -> str:
    return f"regexp_extract(t, '{pattern}', [{', '.join(repr(n) for n in names.split())}])"


def utc_sql(values: str, name: str = "tm") -> str:
    """CTEs that end in ``name``: the rows of ``values`` (with ``src, text, zone``) and ``utc_second``, null where a text
    states no instant. A local time that occurs twice is the first; one that is skipped has the offset before the change."""
    return f"""{name}0 AS (SELECT *, trim(text, ' ') AS t FROM {values}),
{name}v AS (SELECT src, regexp_extract(t, '^(\\d{{1,2}})[/.\\-]', 1)::INT AS a, regexp_extract(t, '^\\d{{1,2}}[/.\\-](\\d{{1,2}})', 1)::INT AS b, regexp_matches(t, '{times._NUM}') AS timed, regexp_matches(t, '^(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-]\\d{{4}}$') AS bare, regexp_extract(t, '{times._NUM}', 8) AS half FROM {name}0 WHERE regexp_matches(t, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d')),
{name}o AS (SELECT src, CASE WHEN count(*) FILTER (a > 12 AND b <= 12 AND (timed OR bare)) <> count(*) FILTER (b > 12 AND a <= 12 AND (timed OR bare)) THEN count(*) FILTER (b > 12 AND a <= 12 AND (timed OR bare)) > count(*) FILTER (a > 12 AND b <= 12 AND (timed OR bare)) ELSE 2 * count(*) FILTER (timed AND half <> '') > count(*) END AS month_first FROM {name}v GROUP BY 1),
{name}k AS (SELECT x.*, coalesce(month_first, false) AS mf, CASE WHEN length(t) < 10 THEN NULL WHEN regexp_matches(t, '^\\d{{10}}$|^\\d{{13}}$') THEN 'count' WHEN regexp_matches(t, '^\\d{{4}}-?\\d{{2}}-?\\d{{2}}[T ]') OR starts_with(t, 'TZID=') THEN 'iso' WHEN regexp_matches(t, '^\\d{{1,2}}[/.\\-]\\d') THEN 'num' ELSE 'txt' END AS kind FROM {name}0 x LEFT JOIN {name}o o ON o.src IS NOT DISTINCT FROM x.src),
{name}p AS (SELECT *, CASE kind WHEN 'iso' THEN {_parts(times._ISO, "tz y m d h mi s off")}.y WHEN 'num' THEN {_parts(times._NUM, "a z b y h mi s half")}.y WHEN 'txt' THEN {_parts(times._TXT, "d m y h mi s half off")}.y END AS y,
 {_parts(times._ISO, "tz y m d h mi s off")} AS iso, {_parts(times._NUM, "a z b y h mi s half")} AS num, {_parts(times._TXT, "d m y h mi s half off")} AS txt FROM {name}k),
{name}q AS (SELECT * EXCLUDE (iso, num, txt), CASE kind WHEN 'iso' THEN iso.m WHEN 'num' THEN CASE WHEN mf THEN num.a ELSE num.b END ELSE (SELECT min(n)::VARCHAR FROM (VALUES {_MONTHS}) w(name, n) WHERE w.name = lower(txt.m)) END AS m, CASE kind WHEN 'iso' THEN iso.d WHEN 'num' THEN CASE WHEN mf THEN num.b ELSE num.a END ELSE txt.d END AS d,
 CASE kind WHEN 'iso' THEN iso.h WHEN 'num' THEN num.h ELSE txt.h END AS h, CASE kind WHEN 'iso' THEN iso.mi WHEN 'num' THEN num.mi ELSE txt.mi END AS mi, CASE kind WHEN 'iso' THEN iso.s WHEN 'num' THEN num.s ELSE txt.s END AS s,
 CASE kind WHEN 'iso' THEN iso.off WHEN 'txt' THEN txt.off ELSE '' END AS off, lower(left(CASE kind WHEN 'num' THEN num.half WHEN 'txt' THEN CASE WHEN regexp_matches(txt.half, '^[apAP]') THEN txt.half ELSE '' END ELSE '' END, 1)) AS half, CASE WHEN kind = 'iso' AND iso.tz <> '' THEN iso.tz ELSE zone END AS zin FROM {name}p),
{name}n AS (SELECT * EXCLUDE (y, m, d, h, mi, s), try_cast(y AS INT) + CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END AS y, try_cast(m AS INT) AS m, try_cast(d AS INT) AS d, try_cast(h AS INT) AS h, coalesce(try_cast(mi AS INT), 0) AS mi, coalesce(try_cast(s AS INT), 0) AS s FROM {name}q),
{name}h AS (SELECT *, CASE half WHEN 'a' THEN CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 END WHEN 'p' THEN CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 + 12 END ELSE h END AS hh FROM {name}n),
{name}l AS (SELECT *, CASE WHEN hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', y, m, d, hh, mi, s) AS TIMESTAMP) END AS l,
 CASE WHEN regexp_matches(off, '^[+-]') THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (substr(replace(off, ':', ''), 2, 2)::INT * 3600 + substr(replace(off, ':', ''), 4, 2)::INT * 60) ELSE CASE off {_OFFSETS} END END AS east FROM {name}h),
{name}z AS (SELECT *, timezone(zin, l) AS moment FROM {name}l WHERE kind <> 'count' AND off = '' AND l IS NOT NULL),
{name} AS (SELECT * EXCLUDE (moment), CASE WHEN timezone(zin, moment - INTERVAL 1 HOUR) = l THEN epoch(moment)::BIGINT - 3600 ELSE epoch(moment)::BIGINT END AS utc_second FROM {name}z
UNION ALL SELECT *, CASE WHEN kind = 'count' THEN CASE WHEN length(t) = 13 THEN t::BIGINT // 1000 ELSE t::BIGINT END WHEN off <> '' THEN epoch(l)::BIGINT - east END AS utc_second FROM {name}l WHERE kind IS NULL OR kind = 'count' OR off <> '' OR l IS NULL)"""
