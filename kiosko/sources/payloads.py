"""Payloads to records: one parser for each tier, run over Arrow batches; a payload that fails gives an error row.

Rows are ``source_id, position, title, start_text, end_text, doc_time, description, venue_name, venue_address,
venue_city, lat, lon, price_text, url, rrule, reject, error``. Times stay texts here; they become instants in
``operators.times``. A row with ``reject`` is a listing that was left out, with the reason; one with ``error`` stands
for a payload that could not be read. Nothing is raised for bad input, so one payload never fails a task.
"""

from __future__ import annotations

import datetime as dt
import html
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiosko.functions import keys, rules, text

FIELDS = "title start_text end_text doc_time description venue_name venue_address venue_city lat lon price_text url rrule reject error".split()
SCHEMA = "source_id string, fetched_at timestamp, position int, " + ", ".join(f"{f} {'double' if f in ('lat', 'lon') else 'string'}" for f in FIELDS)
#: Countries in which a bare price is in euros.
EURO = ("NL", "ES", "DE", "FR", "BE")
CONTAINERS = ("@graph", "itemListElement", "item", "subEvent", "mainEntity")
_script = re.compile(r"<script\b[^>]*ld\+json[^>]*>(.*?)</script\s*>", re.I | re.S)


def _first(x: object) -> object:
    return (x[0] if x else None) if isinstance(x, list) else x


def _text(x: object) -> str | None:
    x = _first(x)
    return str(x) if isinstance(x, (str, int, float)) and not isinstance(x, bool) else None


def _num(x: object) -> float | None:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def nodes(tree: object) -> Iterator[dict]:
    """Every object of a JSON-LD tree, itself first, then those in its containers."""
    todo = [tree]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = [*x, *todo]
        elif isinstance(x, dict):
            yield x
            todo = [*[x[k] for k in CONTAINERS if k in x], *todo]


def jsonld(body: str, spec: dict) -> Iterator[dict]:
    seen = set()
    for block in _script.findall(body):
        try:
            tree = json.loads(block, strict=False)
        except ValueError:
            continue
        for n in nodes(tree):
            kinds = n.get("@type")
            if not any("Event" in str(k) for k in (kinds if isinstance(kinds, list) else [kinds])):
                continue
            start = _text(n.get("startDate", n.get("startdate")))
            title = _text(n.get("name"))
            door = _text(n.get("doorTime", n.get("doortime")))
            # a bare date with the clock time given as the opening of the doors
            if start and door and re.fullmatch(r"\s*\d{4}-\d{2}-\d{2}\s*", start) and (clock := re.search(r"\d{1,2}:\d{2}(?::\d{2})?", door)):
                start = f"{start.strip()} {clock.group()}"
            if not start or not title or (title.lower(), start) in seen:
                continue
            seen.add((title.lower(), start))
            place, offer = _first(n.get("location")), _first(n.get("offers"))
            got = {"title": title, "start_text": start, "end_text": _text(n.get("endDate", n.get("enddate"))), "doc_time": door, "description": _text(n.get("description")), "url": _text(n.get("url", n.get("URL")))}
            if isinstance(place, str):
                got["venue_name"] = place
            elif isinstance(place, dict):
                where, geo = _first(place.get("address")), _first(place.get("geo"))
                got |= {"venue_name": _text(place.get("name")) or "Unknown venue"}
                if isinstance(where, dict):
                    got |= {"venue_address": " ".join(t for k in ("streetAddress", "postalCode") if (t := _text(where.get(k)))) or None, "venue_city": _text(where.get("addressLocality"))}
                else:
                    got["venue_address"] = _text(where)
                if isinstance(geo, dict):
                    got |= {"lat": _num(geo.get("latitude")), "lon": _num(geo.get("longitude"))}
            if isinstance(offer, dict):
                got["price_text"] = " ".join(t for k in ("price", "priceCurrency", "description", "name") if (t := _text(offer.get(k)))) or None
            yield got


def ics(body: str, spec: dict) -> Iterator[dict]:
    """VEVENTs of a calendar; RRULE, RDATE and EXDATE lines are carried on, all-day dates stay dates."""
    lines = re.sub(r"\r?\n[ \t]", "", body).splitlines()
    now: dict | None = None
    for line in lines:
        head, _, value = line.partition(":")
        name, *params = head.split(";")
        name = name.upper()
        if name == "BEGIN" and value.strip().upper() == "VEVENT":
            now = {}
        elif name == "END" and value.strip().upper() == "VEVENT" and now is not None:
            if now.get("title") and now.get("start_text"):
                yield now
            now = None
        elif now is not None:
            zone = next((p[5:] for p in params if p.upper().startswith("TZID=")), None)
            plain = re.sub(r"\\([nN,;\\])", lambda m: "\n" if m.group(1) in "nN" else m.group(1), value)
            if name in ("DTSTART", "DTEND"):
                now["start_text" if name == "DTSTART" else "end_text"] = f"TZID={zone}:{value.strip()}" if zone else value.strip()
            elif name in ("RRULE", "RDATE", "EXDATE"):
                now["rrule"] = "\n".join(x for x in (now.get("rrule"), f"{name}:{value.strip()}") if x)
            elif name in (known := {"SUMMARY": "title", "DESCRIPTION": "description", "LOCATION": "venue_name", "URL": "url"}):
                now[known[name]] = plain.strip()


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def rss(body: str, spec: dict) -> Iterator[dict]:
    """Items of RSS or Atom. A post date counts only if the source says so; an item needs a sign of being an event."""
    posted = spec.get("date_from") == "published"
    dated = ("startdate", "dtstart", "eventdate", "event_date", "start", "date_start")
    venues = spec.get("venues") or ()
    for item in (x for x in ElementTree.fromstring(body.strip().encode()).iter() if _local(x.tag) in ("item", "entry")):
        got: dict[str, str] = {}
        for c in item:
            got.setdefault(_local(c.tag), (c.text or c.get("href") or "").strip())
        start = next((got[k] for k in dated if got.get(k)), None) or (posted and next((got[k] for k in ("pubdate", "published", "updated", "date") if got.get(k)), None)) or None
        row = {"title": got.get("title"), "start_text": start, "url": got.get("link"), "description": got.get("description") or got.get("summary") or got.get("encoded")}
        path = urlparse(row["url"] or "").path
        blob = f"{row['title'] or ''} {row['description'] or ''}".lower()
        if not row["title"] or not start:
            row["reject"] = "no_event_date"
        elif re.search(rules.EDITORIAL_PATH, path):
            row["reject"] = "editorial_url"
        elif not (re.search(rules.EVENT_PATH, path) or re.search(r"[T ](?!00:00)\d{2}:\d{2}", start) or any(len(v) > 4 and v in blob for v in venues)):
            row["reject"] = "no_event_signal"
        yield row


def dotted(node: object, path: str | None) -> object:
    """A value by a path of names and list positions; None where the path leads nowhere."""
    for part in (path or "").split("."):
        if isinstance(node, list) and part.lstrip("-").isdigit() and -len(node) <= int(part) < len(node):
            node = node[int(part)]
        elif isinstance(node, dict) and part in node:
            node = node[part]
        else:
            return None
    return node


def joined_time(day: str | None, clock: str | None) -> str | None:
    """A compact or ISO day with a clock time."""
    if not day:
        return None
    day = re.sub(r"^(\d{4})(\d{2})(\d{2})$", r"\1-\2-\3", day.strip())
    return f"{day}T{clock.strip()}" if clock and clock.strip() else day


def _next_day(day: str) -> str:
    try:
        return (dt.date.fromisoformat(day[:10]) + dt.timedelta(days=1)).isoformat()
    except ValueError:
        return day


def wp_rest(body: str, spec: dict) -> Iterator[dict]:
    """Posts of a content API by the paths that the source names; title and date are needed, the rest is not. An end
    before its start is of the next day; a price that is a number is in the currency of the country."""
    rows = json.loads(body)
    if isinstance(rows, dict):
        if "code" in rows and "message" in rows:
            raise ValueError(f"the source says {rows['code']}")
        rows = rows.get("items", [])
    if not isinstance(rows, list):
        raise ValueError("not a list of posts")
    at = spec.get("selectors") or {}
    if "title" not in at or "date" not in at:
        raise ValueError("no paths of title and date")
    plain = lambda t: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", t))).strip() or None
    for r in rows:
        said = lambda key: _text(dotted(r, at[key])) if key in at else None  # noqa: B023, E731
        title, day = said("title"), said("date")
        if not title or not day:
            continue
        price = dotted(r, at["price"]) if "price" in at else None
        if isinstance(price, (int, float)) and not isinstance(price, bool):
            price = f"{'€' if spec.get('country') in EURO else ''}{price:.2f}"
        start, end = joined_time(day, said("time")), joined_time(day, said("end_time")) if said("end_time") else None
        if end and end < start:
            end = joined_time(_next_day(joined_time(day, None)), said("end_time"))
        venue, told = said("venue"), said("description")
        yield {
            "title": plain(title), "start_text": start, "end_text": end, "description": plain(told) if told else None, "venue_name": plain(venue) if venue else None,
            "price_text": _text(price), "url": _text(dotted(r, at.get("url", "link"))),
        }


def api(body: str, spec: dict) -> Iterator[dict]:
    tree = json.loads(body)
    for r in tree.get("@graph", []) if isinstance(tree, dict) else tree:
        area = dotted(r, "address.area") or {}
        yield {
            "title": _text(r.get("title")), "start_text": _text(r.get("dtstart")), "end_text": _text(r.get("dtend")), "description": _text(r.get("description")), "url": _text(r.get("link")),
            "venue_name": _text(r.get("organization-name")) or _text(area.get("organization-name")), "venue_address": _text(area.get("street-address")), "price_text": "gratis" if r.get("free") == 1 else None,
            "lat": _num(dotted(r, "location.latitude")), "lon": _num(dotted(r, "location.longitude")),
        }


class _Dom(HTMLParser):
    """A light tree: (tag, attributes, children, parent); texts are children of tag None."""

    VOID = {"br", "img", "hr", "meta", "input", "link", "source", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "", "attrs": {}, "kids": [], "up": None}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n["up"] is not None and n["tag"] != tag:
            n = n["up"]
        if n["up"] is not None:
            self.at = n["up"]

    def handle_data(self, data: str) -> None:
        self.at["kids"].append({"tag": None, "text": data})


def _below(node: dict) -> Iterator[dict]:
    for k in node["kids"]:
        if k["tag"] is not None:
            yield k
            yield from _below(k)


def _said(node: dict) -> str:
    return re.sub(r"\s+", " ", "".join(k["text"] if k["tag"] is None else f" {_said(k)} " for k in node["kids"])).strip()


_simple = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)\"?([^\"\]]*)\"?)?\]")


def _fits(node: dict, part: str) -> bool:
    for tag, cls, id_, attr, op, want in _simple.findall(part):
        have = node["attrs"].get(attr)
        ok = (
            node["tag"] == tag.lower() if tag
            else cls in node["attrs"].get("class", "").split() if cls
            else node["attrs"].get("id") == id_ if id_
            else have is not None and (not op or {"=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want)}[op])
        )
        if not ok:
            return False
    return True


def select(node: dict, selector: str) -> Iterator[dict]:
    """Nodes below that fit a selector of tags, classes, ids, attributes and descent."""
    *above, last = selector.split()
    for n in _below(node):
        if _fits(n, last):
            up, todo = n["up"], above[::-1]
            while todo and up is not None:
                if _fits(up, todo[0]):
                    todo = todo[1:]
                up = up["up"]
            if not todo:
                yield n


def wrapper(body: str, spec: dict) -> Iterator[dict]:
    at = spec.get("selectors") or {}
    dom = _Dom()
    dom.feed(body)
    found = list(select(dom.root, at["container"])) if at.get("container") else []
    if not found:
        raise ValueError("no container")

    def pick(node: dict, key: str) -> str | None:
        selector, _, attr = (at.get(key) or "").partition("@")
        n = next(select(node, selector.strip()), None) if selector.strip() else None
        got = (n["attrs"].get(attr.strip()) if attr else _said(n)) if n else None
        if got and (rule := at.get(f"{key}_regex")):
            m = re.search(rule, got)
            got = m.group("value") if m else None
        return got or None

    for n in found:
        start = joined_time(pick(n, "start") or pick(n, "date"), pick(n, "start_time"))
        yield {"start_text": start} | {f: pick(n, k) for f, k in (("title", "title"), ("venue_name", "venue"), ("description", "description"), ("price_text", "price"))} | {"url": spec.get("url")}


TIERS: dict[str, Callable[[str, dict], Iterator[dict]]] = {"jsonld": jsonld, "jsonld_index": jsonld, "ics": ics, "rss": rss, "wp_rest": wp_rest, "api": api, "wrapper": wrapper}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            try:
                if r["tier"] not in TIERS:
                    raise ValueError(f"no such tier: {r['tier']}")
                spec = {"selectors": dict(r["selectors"]) if r["selectors"] is not None else {}, "date_from": r["date_from"], "country": r["country"], "url": r["url"], "venues": [v for v in (r["venues"] if r["venues"] is not None else [])]}
                for i, got in enumerate(TIERS[r["tier"]](r["body"] or "", spec)):
                    out.append((r["source_id"], r["fetched_at"], i, *[got.get(f) for f in FIELDS]))
            except Exception as e:  # noqa: BLE001
                out.append((r["source_id"], r["fetched_at"], -1, *[None] * (len(FIELDS) - 1), f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame(out, columns=["source_id", "fetched_at", "position", *FIELDS]).astype({"fetched_at": b["fetched_at"].dtype})


def extract(payloads: DataFrame, registry: DataFrame, venues: list[str] | None = None) -> DataFrame:
    """Records of payloads (``source_id, body``) by the tier of their source; ``venues`` are known names in lower case, a bounded list."""
    spec = registry.select(F.col("id").alias("source_id"), F.col("source_type").alias("tier"), "selectors", "date_from", "country", "url")
    at = F.col("fetched_at") if "fetched_at" in payloads.columns else F.lit(None).cast("timestamp")
    rows = payloads.select("source_id", "body", at.alias("fetched_at")).join(F.broadcast(spec), "source_id")  # a row for each source
    known = F.array(*[F.lit(v) for v in (venues or [])]).cast("array<string>")
    return rows.withColumn("venues", known).mapInPandas(_read, SCHEMA)


def records(payloads: DataFrame, registry: DataFrame, venues: list[str] | None = None) -> DataFrame:
    """raw_records of payloads ``source_id, body, fetched_at``: parsed by tier, cleaned, with the price, free flag and
    venue they state, the source's own venue filled in, and stamped with tier, trust and time. Listings that were left
    out and payloads that could not be read have no row here; ``extract`` gives them.

    ``start_raw`` and ``end_raw`` are as the source wrote them; ``operators.resolve`` reads them.
    """
    stamped = payloads.select("source_id", "body", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    parsed = extract(stamped, registry, venues).where("error is null and reject is null")
    spec = registry.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), "trust", F.col("source_type").alias("source_type"), "locale")
    rows = with_venue_default(parsed, registry).join(F.broadcast(spec), "source_id")
    rows = rows.withColumns({"title": text.clean_text(F.col("title")), "description": text.clean_text(text.strip_html(F.col("description")))})
    rows = rows.where(F.col("title").isNotNull() & F.col("start_text").isNotNull())
    blob = F.concat_ws(" ", "price_text", "description", "title")
    free = reduce(lambda acc, k: acc.when(F.col("locale") == k, text.detect_free(blob, k)), rules.FREE_MARKERS, F.when(F.lit(False), F.lit(True))).otherwise(text.detect_free(blob, "en"))
    name = text.clean_text(F.coalesce("venue_name", "venue_address"))
    empty = F.lit(None).cast("string")
    venue = F.when(name.isNotNull(), F.struct(name.alias("name"), text.clean_text(F.col("venue_address")).alias("address"), text.clean_text(F.col("venue_city")).alias("city"), "lat", "lon", empty.alias("geocode_source"), empty.alias("default_price"), empty.alias("notes")))
    rows = rows.withColumn("_price", F.when(F.col("price_text").rlike(r"^\d+(?:\.\d+)?$"), F.lit(None)).otherwise(text.parse_price(F.col("price_text"))))
    return rows.select(
        F.xxhash64("source_id", "fetched_at", "position", "title", "start_text").alias("ordinal"), keys.fingerprint(F.col("source_id"), F.col("title"), F.col("start_text")).alias("fingerprint"),
        "source_id", "source_url", "trust", "source_type", "title", F.col("start_text").alias("start_raw"), F.col("end_text").alias("end_raw"), "rrule", "description",
        venue.alias("venue"), F.col("_price").alias("price"), free.alias("is_free"), F.coalesce("url", "source_url").alias("url"), "fetched_at",
    )


def status(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """``source_id, records, error`` of each source that was asked: how many records it gave, or what went wrong."""
    got = parsed.groupBy("source_id").agg(F.count_if(F.col("error").isNull() & F.col("reject").isNull()).alias("records"), F.min("error").alias("error"))
    asked = payloads.groupBy("source_id").agg(F.count("body").alias("_bodies"))
    rows = asked.join(got, "source_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return rows.select("source_id", "records", F.coalesce("error", F.when(F.col("_bodies") == 0, "no payload")).alias("error"))


def stitched(index: DataFrame, details: DataFrame, most: int = 40) -> DataFrame:
    """``source_id, fetched_at, body``: the JSON-LD blocks of the detail pages that an index page links to, as one payload
    of its source, in order of the links. ``index`` has ``source_id, url, body, fetched_at``, ``details`` ``url, body``."""
    links = page_links(index, "body", "url", most).join(index.select("url", "source_id", "fetched_at"), "url")
    blocks = F.array_join(F.regexp_extract_all(F.col("_body"), F.lit(r"(?is)(<script\b[^>]*ld\+json[^>]*>.*?</script\s*>)"), F.lit(1)), "\n")
    pages = details.select(F.col("url").alias("link"), F.col("body").alias("_body"))
    rows = links.join(pages, "link").select("source_id", "fetched_at", F.struct("n", blocks.alias("b")).alias("x"))  # at most `most` of a page
    return rows.groupBy("source_id", "fetched_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("body"))


def with_venue_default(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources of one venue: its name and address fill in, and a name the page gave is a room, put before the description."""
    spec = registry.where("venue_name is not null").select(F.col("id").alias("source_id"), F.col("venue_name").alias("_name"), F.col("venue_address").alias("_address"), F.col("city").alias("_city"))
    rows = records.join(F.broadcast(spec), "source_id", "left")
    room = F.col("_name").isNotNull() & F.col("venue_name").isNotNull() & (F.lower("venue_name") != F.lower("_name"))
    rows = rows.withColumn("description", F.when(room, F.concat_ws(". ", "venue_name", "description")).otherwise(F.col("description")))
    own = lambda c, d: F.when(F.col("_name").isNotNull(), F.col(d)).otherwise(F.col(c))
    return rows.withColumns({"venue_name": own("venue_name", "_name"), "venue_address": own("venue_address", "_address"), "venue_city": own("venue_city", "_city")}).drop("_name", "_address", "_city")


def rejects(records: DataFrame) -> DataFrame:
    """``source_id, reason, n`` of listings left out."""
    return records.where("reject is not null").groupBy("source_id", F.col("reject").alias("reason")).agg(F.count("*").alias("n"))


def heavy_rejects(records: DataFrame, share: float = 0.70) -> DataFrame:
    """Sources that left out more than a share of their listings."""
    got = records.groupBy("source_id").agg(F.count_if(F.col("reject").isNotNull()).alias("dropped"), F.count_if(F.col("reject").isNull() & F.col("error").isNull()).alias("kept"))
    return got.where(F.col("dropped") > share * (F.col("dropped") + F.col("kept")))


def sniff(body: Column, content_type: Column) -> Column:
    """What a payload is by its first signs; the declared type counts only where they say nothing."""
    head = F.regexp_replace(F.substring(body, 1, 2048), r"^[﻿ \t\r\n]+", "")
    low, said = F.lower(head), F.lower(F.coalesce(content_type, F.lit("")))
    page = low.contains("<html") | low.contains("<!doctype html")
    return (
        F.when(low.startswith("begin:vcalendar"), "ics").when(head.rlike(r"^[{\[]"), "json").when(low.rlike("<rss|<feed|<rdf:rdf"), "feed").when(low.rlike("<urlset|<sitemapindex"), "sitemap")
        .when(page, "html").when(low.startswith("<?xml"), "xml").when(said.contains("html"), "html").when(said.contains("calendar"), "ics").when(said.contains("json"), "json").when(said.contains("xml"), "xml").otherwise("other")
    )


def page_links(pages: DataFrame, body: str, url: str, most: int | None = None) -> DataFrame:
    """``url, link``: links of a page to its own host, without itself, each once, in order (``n``)."""

    @F.pandas_udf("array<string>")
    def links(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        out = []
        for b, u in zip(bodies, urls):
            found = (urljoin(u, html.unescape(h).split("#")[0]) for h in re.findall(r"<a\b[^>]*href=[\"']([^\"']+)", b or "", re.I))
            same = dict.fromkeys(x for x in found if urlparse(x).netloc == urlparse(u).netloc and x.rstrip("/") != u.rstrip("/"))
            out.append(list(same)[:most])
        return pd.Series(out)

    return pages.select(F.col(url).alias("url"), F.posexplode(links(body, url)).alias("n", "link"))


def decoded(raw: Column, content_type: Column) -> Column:
    """Bytes of a payload as text, over Arrow batches."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decode_bytes(bytes(b), k or "") for b, k in zip(bodies, kinds)])

    return run(raw, content_type)


def at_path(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path leads nowhere or the text is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                got = dotted(json.loads(t), path) if t else None
            except ValueError:
                return None
            return got if got is None or isinstance(got, str) else json.dumps(got)

        return texts.map(one)

    return run(document)


def decode_bytes(raw: bytes, content_type: str = "") -> str:
    """Bytes to text: the declared charset, then the page's own, then UTF-8, cp1252, latin-1; one that leaves garbled signs is passed over."""
    import unicodedata

    told = re.findall(r"charset=[\"']?([\w-]+)", content_type) + [m.decode() for m in re.findall(rb"charset=[\"']?([\w-]+)", raw[:4096])]
    tried = []
    for name in dict.fromkeys([*told, "utf-8", "cp1252", "latin-1"]):
        try:
            tried.append(raw.decode(name))
        except (UnicodeDecodeError, LookupError):
            continue
        if not re.search(r"Ã[\x80-¿]|â€|Â[\x80-¿]|�", tried[-1]):
            return unicodedata.normalize("NFC", tried[-1])
    return unicodedata.normalize("NFC", tried[0])
