"""Identity keys, cursors and digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kiosko.functions import text


def short(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def fingerprint(source_id: Column, title: Column, start_iso: Column) -> Column:
    return short(F.concat_ws("|", source_id, F.lower(title), start_iso))


def event_id(title: Column, start_iso: Column, city: Column) -> Column:
    return short(F.concat_ws("|", text.normalize_title(title), start_iso, city))


def occurrence_id(event: Column, start_iso: Column) -> Column:
    return short(F.concat_ws("|", event, start_iso))


def _own_words(names: pd.Series, cities: pd.Series) -> pd.Series:
    return pd.Series([" ".join(w for w in n.split() if w not in set(c.split())) or n for n, c in zip(names, cities)])


def venue_key(name: Column, city: Column) -> Column:
    """Of the name's words without the city's; order and repetitions of words count."""
    blank = F.lit("")
    own = F.pandas_udf(_own_words, "string")(text.normalize_title(F.coalesce(name, blank)), text.normalize_title(F.coalesce(city, blank)))
    return short(F.concat_ws("|", own, F.lower(F.coalesce(city, blank))))


def geo_key(lat: Column, lon: Column) -> Column:
    """Coordinates to three decimals, about a hundred metres; ``nogeo`` where one is missing."""
    both = F.concat_ws(",", F.format_string("%.3f", F.bround(lat, 3)), F.format_string("%.3f", F.bround(lon, 3)))
    return F.when(lat.isNotNull() & lon.isNotNull(), both).otherwise("nogeo")


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def cursor(start: Column, id_: Column) -> Column:
    """A page's end as an opaque token that fits a URL."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat_ws("|", start, id_), "utf-8")), "+/", "-_"), F.lit("="))


def cursor_parts(token: Column) -> Column:
    padded = F.rpad(F.translate(token, "-_", "+/"), F.ceil(F.length(token) / 4).cast("int") * 4, F.lit("="))
    return F.split(F.decode(F.unbase64(padded), "utf-8"), r"\|", 2)


def source_slug(url: Column) -> Column:
    """A source id from host and path: letters and digits, at most 48 characters."""
    host = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")
    slug = F.regexp_replace(F.lower(F.concat(host, F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))), r"[^a-z0-9]+", "_")
    return F.trim(F.substring(slug, 1, 48), F.lit("_"))
