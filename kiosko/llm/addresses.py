"""Same postal address written differently.

An address is parsed into town, postcode, street type, street name and house number; abbreviations are expanded by
the dictionary of the country, and the parts are put in one order. Locations are found by hierarchical keys:

1. postcode and house number within a town (a postcode belongs to one street);
2. without postcode: the street of that town, looked up among the streets seen with a postcode, first exactly, then
   within one edit of the name (joined on deletion neighbourhoods, not by comparing all pairs);
3. without house number: the venue's own name within that street; without street: postcode and number;
4. without either, town, street and number as written.

Rules for missing parts: a town missing from the address is taken from the city column, and if that is null too, from
the town most often seen with the postcode. A row whose house number cannot be found has no location. Rooms and
businesses in one house share its location; a letter after the number belongs to it.

Defined results: null, empty and blank addresses have no location and no pair; repeated rows with one id count once;
empty tables give no rows. Only ``id, name, city, address`` are read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiosko.session import checkpointed

#: Street types by country, each with its spellings, and whether they are endings or words.
ENDINGS = {
    "NL": {"straat": "straat strt str", "gracht": "gracht grcht gr", "singel": "singel sngl sgl", "laan": "laan ln", "plein": "plein pln pl", "weg": "weg wg", "kade": "kade kd"},
    "DE": {"strasse": "strasse str", "allee": "allee all", "platz": "platz pltz pl", "weg": "weg wg"},
    "FI": {"katu": "katu kt k", "tie": "tie t"},
    "CW": {"weg": "weg wg"},
}
WORDS = {
    "ES": {"calle": "calle c cl", "avenida": "avenida avda avd av", "paseo": "paseo pso po ps", "plaza": "plaza pza plza pl"},
    "PT": {"rua": "rua r", "avenida": "avenida av avda", "largo": "largo lg lgo"},
    "FR": {"rue": "rue r", "boulevard": "boulevard bd bld bvd boul", "avenue": "avenue av ave", "place": "place plce pl"},
    "GB": {"road": "road rd", "street": "street st str", "lane": "lane la ln", "square": "square sq"},
    "CW": {"kaya": "kaya kaja k"},
}
LIKE = {"BE": "FR"}
ARTICLES = {"de", "del", "la", "las", "los", "el", "du", "des", "d", "da", "do", "dos", "van", "der", "den"}
#: Postcode forms by country, most telling first.
POSTCODES = (
    ("GB", r"\b([a-z]{1,2}\d{1,2})\s*(\d[a-z]{2})\b"),
    ("NL", r"\b(\d{4})\s*([a-z]{2})\b(?!\.)"),
    ("PT", r"\b(\d{4})\s*-?\s*(\d{3})\b"),
    ("", r"\b(\d{5})()\b"),
    ("", FOUR_DIGITS := r"\b(\d{4})()\b"),
)
_number = re.compile(r"\b(\d{1,5})(?!\d)(?:\s*-\s*([a-z])\b|\s?([a-z])\b(?![./]))?")
_sign = re.compile(r"\b(?:no|nr|num|nro|n)\s*\.?\s*(?=\d)|\bn\s*[o°]\s*(?=\d)")
#: Rows of one location that are paired in one piece.
BLOCK = 1000
PARTS = "town string, postcode string, kind string, street string, number string, who string"


#: Letters with a mark that Latin scripts of Europe use, to their plain form; others go through Unicode's own forms.
_plain = {c: "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x180)} | {ord(a): b for a, b in (("ß", "ss"), ("ø", "o"), ("º", "o"), ("ª", "a"), ("°", "o"))}


def fold(text: str) -> str:
    low = text.lower()
    if low.isascii() or (low := low.translate(_plain)).isascii():
        return low
    low = low.replace("ß", "ss").replace("ø", "o").replace("º", "o").replace("ª", "a").replace("°", "o")
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _spellings(table: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(((s, kind) for kind, all_ in table.items() for s in all_.split()), key=lambda x: -len(x[0]))


_ends = {c: _spellings(t) for c, t in ENDINGS.items()}
_words = {c: {s: k for s, k in _spellings(t)} for c, t in WORDS.items()}


def _street(tokens: list[str], countries: list[str]) -> tuple[str, str] | None:
    """(kind, name) of a street in the words of one segment."""
    for country in countries:
        words = _words.get(country, {})
        for i, t in enumerate(tokens):
            kind = words.get(t.rstrip(".").replace(".", "").strip("/"))
            if kind and len(tokens) > 1:
                rest = [x.strip("./") for j, x in enumerate(tokens) if j != i]
                name = "".join(x for x in rest if x and x not in ARTICLES)
                if name:
                    return kind, name
        for t in tokens:
            plain = t.replace("-", "").rstrip(".")
            for end, kind in _ends.get(country, []):
                if plain.endswith(end) and len(plain) >= len(end) + 3 and (len(end) > 1 or t.endswith(".")):
                    return kind, plain[: -len(end)]
    return None


@lru_cache(None)
def _named(towns: tuple[str, ...]) -> re.Pattern:
    """Any of the towns as a word; the longest goes first."""
    return re.compile(rf"(?<![a-z])(?:{'|'.join(re.escape(t) for t in sorted(towns, key=len, reverse=True)) or '(?!)'})(?![a-z])")


@lru_cache(None)
def _tail(towns: tuple[str, ...]) -> re.Pattern:
    """A town in brackets, or at the end of a venue's name."""
    any_ = "|".join(re.escape(t) for t in towns) or "(?!)"
    return re.compile(rf"\(\s*(?:{any_})\s*\)|(?: - |, )(?:{any_})\s*$")


def parse(address: str | None, city: str | None, name: str | None, towns: dict[str, str]) -> tuple[str | None, ...]:
    """(town, postcode, kind, street, number, who). ``towns``: folded town names with their country."""
    who = _who(name, towns)
    if not address or not address.strip():
        return None, None, None, None, None, who
    a = re.sub(r"\((?:[a-z]{2})\)", " ", fold(address))
    a = re.sub(r"[ \t]+", " ", a)
    town = None
    if m := max(_named(tuple(towns)).finditer(a), key=lambda m: (len(m.group()), -m.start()), default=None):
        town, a = m.group(), a[: m.start()] + "," + a[m.end() :]
    if town is None and city and (c := re.sub(r"\s+", " ", fold(city)).strip()) in towns:
        town = c
    country = LIKE.get(towns.get(town or "", ""), towns.get(town or "", ""))
    postcode, house = None, None
    forms = [f for f in POSTCODES if country in ("", f[0]) or f[0] == ""]
    for at, form in forms:
        if (m := re.search(form, a)) and not (at == "NL" and country == "" and m.group(2) in ("no", "nr")):
            postcode, country = m.group(1) + m.group(2), country or at
            # four digits right after a word, with no letters of their own, may be a house number
            house = m.group(1) if form == FOUR_DIGITS and re.search(r"[a-z.] $", a[: m.start()]) else None
            a = a[: m.start()] + "," + a[m.end() :]
            break
    countries = [country] if country else ["NL", "GB", "ES", "FR", "DE", "PT", "FI", "CW"]
    a = _sign.sub(" ", a)
    segments = [s.strip() for s in re.split(r"[,\n;]| - ", a) if s.strip(" -.")]
    street, at = None, -1
    for i, s in enumerate(segments):
        words = re.sub(r"\b\d{1,5}\s*-\s*[a-z]\b|\b\d{1,5}\s?[a-z]\b(?![./])|\b\d+\b", " ", s)
        words = re.sub(r"c/", "c. ", words).replace("p.o", "po ").split()
        if words and (street := _street(words, countries)):
            at = i
            break
    number = None
    # rooms stand before the street, so their numbers do not count
    for s in (segments[at:] if at >= 0 else segments[::-1]):
        if m := _number.search(s):
            number = str(int(m.group(1))) + (m.group(2) or m.group(3) or "")
            break
    if number is None and house and street:
        number, postcode = house, None
    kind, stem = street or (None, None)
    return town, postcode, kind, stem, number, who


def _who(name: str | None, towns: dict[str, str]) -> str | None:
    """The telling word of a venue's name: without town, room and kind of house."""
    if not name:
        return None
    n = re.sub(r",.*$", "", _tail(tuple(towns)).sub(" ", fold(name)))
    words = re.findall(r"[a-z0-9]+", n)
    return words[-1] if words else None


def parsed(venues: DataFrame, registry: DataFrame) -> DataFrame:
    """``id`` with the parts of its address. Towns and their countries are those of the registry (a row for each source)."""
    towns = {re.sub(r"\s+", " ", fold(r.city)).strip(): r.country for r in registry.select("city", "country").where("city is not null").distinct().collect()}
    towns = dict(sorted(towns.items(), key=lambda kv: -len(kv[0])))

    @F.pandas_udf(PARTS)
    def parts(address: pd.Series, city: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [parse(a, c, n, towns) for a, c, n in zip(address, city, name)]
        return pd.DataFrame(rows, columns=["town", "postcode", "kind", "street", "number", "who"])

    rows = venues.where(F.trim("address") != "").groupBy("id").agg(F.min(F.struct("address", "city", "name")).alias("v"))
    return rows.withColumn("p", parts("v.address", "v.city", "v.name")).select("id", "p.*")


def _near(c: str) -> F.Column:
    """A name and all names with one letter less; two names within one edit share one of them."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, F.length(c))))))


def _within_one_edit(a: str, b: str) -> F.Column:
    """At most one insertion, deletion, change or swap of neighbours; names of eight letters and more may have two."""
    d = F.levenshtein(F.col(a), F.col(b))
    return (d <= 1) | ((d == 2) & ((F.length(a) >= 7) | (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))))


def locations(venues: DataFrame, registry: DataFrame) -> DataFrame:
    """``id, location``: the rows whose address denotes a location, with a key for it."""
    p = checkpointed(parsed(venues, registry))
    # the town of a postcode, for rows that name none
    seen = p.where("town is not null and postcode is not null").groupBy("postcode", "town").agg(F.count("*").alias("n"))
    usual = seen.groupBy("postcode").agg(F.max_by("town", F.struct("n", "town")).alias("_town"))
    p = p.join(usual, "postcode", "left").withColumn("town", F.coalesce("town", "_town")).drop("_town")
    # the postcode of a street, for rows without it
    streets = p.where("postcode is not null and street is not null and town is not null").groupBy("town", "kind", "street", "postcode").agg(F.count("*").alias("n"))
    bare = p.where("postcode is null and street is not null and town is not null").select("town", "kind", "street").distinct()
    variants = streets.select("town", "kind", F.col("street").alias("known"), "postcode", "n", F.explode(_near("street")).alias("v"))
    asked = bare.select("town", "kind", "street", F.explode(_near("street")).alias("v"))
    hits = asked.join(variants, ["town", "kind", "v"]).where(_within_one_edit("street", "known"))
    best = hits.groupBy("town", "kind", "street").agg(F.max_by("postcode", F.struct(-F.levenshtein("street", "known"), "n", "postcode")).alias("_postcode"))
    p = p.join(best, ["town", "kind", "street"], "left").withColumn("postcode", F.coalesce("postcode", "_postcode")).drop("_postcode")
    # streets never seen with a postcode keep their own name
    road = F.when(F.col("postcode").isNotNull(), F.concat_ws("|", "town", "postcode")).when(F.col("street").isNotNull() & F.col("town").isNotNull(), F.concat_ws("|", "town", "kind", "street"))
    p = p.withColumn("road", road).where("road is not null")
    # the number of a venue, for rows without it
    numbered = p.where("number is not null and who is not null").groupBy("road", "who", "number").agg(F.count("*").alias("n"))
    names = numbered.select("road", F.col("who").alias("known"), "number", "n", F.explode(_near("who")).alias("v"))
    lost = p.where("number is null and who is not null").select("road", "who").distinct()
    found = lost.select("road", "who", F.explode(_near("who")).alias("v")).join(names, ["road", "v"]).where(_within_one_edit("who", "known"))
    number = found.groupBy("road", "who").agg(F.max_by("number", F.struct(-F.levenshtein("who", "known"), "n", "number")).alias("_number"))
    p = p.join(number, ["road", "who"], "left").withColumn("number", F.coalesce("number", "_number"))
    return p.where("number is not null").select("id", F.concat_ws("|", "road", "number").alias("location"))


def location_classes(venues: DataFrame, registry: DataFrame) -> DataFrame:
    """``id, location, n_venues``: the location of each row and the number of rows that share it; no pairs are made."""
    rows = checkpointed(locations(venues, registry))
    return rows.join(rows.groupBy("location").agg(F.count("*").alias("n_venues")), "location").select("id", "location", "n_venues")


def same_location(venues: DataFrame, registry: DataFrame) -> DataFrame:
    """``venue_a, venue_b``: the pairs of rows that denote one location, the smaller id first.

    The rows of a location are dealt to blocks of BLOCK by hash; each pair of blocks is a join of its own, so that a
    location of many rows is many tasks' work.
    """
    rows = checkpointed(locations(venues, registry))
    sizes = rows.groupBy("location").agg(F.count("*").alias("n")).where("n > 1")
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.join(sizes, "location").select("id", "location", many.alias("blocks")).withColumn("own", F.pmod(F.hash("id"), F.col("blocks")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = rows.select(F.col("id").alias("venue_a"), "location", F.col("own").alias("x"), F.explode(others).alias("y"))
    b = rows.select(F.col("id").alias("venue_b"), "location", F.col("own").alias("y"), F.explode(others).alias("x"))
    return a.join(b, ["location", "x", "y"]).where("venue_a < venue_b").select("venue_a", "venue_b")
