"""Source discovery over stored pages: which extraction routes a page offers, how many events each yields, and why a
site cannot be read.

A route's yield is what the real parsers of ``sources.payloads`` get out of it, not its presence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiosko.functions import keys
from kiosko.sources import payloads

#: Routes from the most to the least wanted, and the marks of each verdict on a site.
RANK = {"ics": 0, "jsonld": 1, "api": 2, "rss": 3, "microdata": 4, "sitemap": 5}
TICKETS = r"(?i)(eventbrite|ticketmaster|paylogic|eventix|activetickets|ticketkantoor|yesplan|stager|weeztix|ticketswap)"
SCRIPTED = r"(?i)(__NUXT__|__NEXT_DATA__|ng-version|data-reactroot|vue(?:\.min)?\.js|react-dom)"
SOCIAL = r"(?i)(instagram\.com|facebook\.com|fb\.me|linktr\.ee)"
PROGRAMME = r"(?i)\b(elke|iedere)\s+(maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)\b|\blive\s*muziek\b|\bagenda\b|\bprogramma\b|\boptreden\b|\bborrel\b|\bpubquiz\b|\bworkshop\b|\bconcert\b|\bvoorstelling\b|\bexpositie\b|\bfestival\b"
DATED = r"(?i)\b\d{1,2}\s+(jan|feb|mrt|maart|apr|mei|jun|jul|aug|sep|okt|nov|dec)|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
_link = re.compile(r"<(a|link)\b([^>]*)>", re.I)
_attr = re.compile(r"([\w-]+)\s*=\s*[\"']([^\"']*)[\"']")


def links(body: str, base: str) -> dict[str, list[str]]:
    """Calendar and feed links of a page, each once, in order."""
    out: dict[str, list[str]] = {"ics": [], "rss": [], "sitemap": []}
    for _, inside in _link.findall(body):
        at = {k.lower(): unescape(v) for k, v in _attr.findall(inside)}
        href, kind = at.get("href"), at.get("type", "").lower()
        if not href:
            continue
        name = "ics" if "calendar" in kind or ".ics" in href.lower() else "rss" if re.search(r"rss|atom", kind) else "sitemap" if "sitemap" in href.lower() else None
        if name:
            out[name].append(urljoin(base, href))
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def _routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for url, body in zip(b["url"], b["body"]):
            body = body or ""
            if "ld+json" in body:
                out.append((url, "jsonld", "in page", sum(1 for _ in payloads.jsonld(body, {}))))
            if re.search(r"itemtype=[\"'][^\"']*schema\.org[^\"']*Event|typeof=[\"'][^\"']*Event", body):
                out.append((url, "microdata", "in page", None))
            out += [(url, tier, at, None) for tier, found in links(body, url or "").items() for at in found]
        yield pd.DataFrame(out, columns=["url", "tier", "detail", "events"]).astype({"events": "Int64"})


def routes(pages: DataFrame) -> DataFrame:
    """``url, tier, detail, events`` of pages ``url, body``; events is null where a route was seen but not read."""
    return pages.select("url", "body").mapInPandas(_routes, "url string, tier string, detail string, events long")


def verified(found: DataFrame, linked: DataFrame, registry_like: DataFrame) -> DataFrame:
    """Routes with the yield of their linked payloads (``url, body``), read by the parser of their tier."""
    spec = registry_like
    reads = payloads.extract(linked.select(F.col("url").alias("source_id"), "body"), spec).where("error is null and reject is null")
    n = reads.groupBy(F.col("source_id").alias("detail")).agg(F.count("*").alias("_n"))
    return found.join(n, "detail", "left").withColumn("events", F.coalesce("events", "_n")).drop("_n")


def best(found: DataFrame) -> DataFrame:
    """The best route of each page: verified before seen, then most events, then the wanted tier."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    order = F.struct((F.coalesce("events", F.lit(0)) == 0).cast("int"), -F.coalesce("events", F.lit(0)), F.coalesce(F.try_element_at(rank, "tier"), F.lit(99)), "detail")
    return found.groupBy("url").agg(F.min_by(F.struct("tier", "detail", "events"), order).alias("b")).select("url", "b.*")


def summary(pages: DataFrame, best_: DataFrame) -> DataFrame:
    """One row ``pages, verified, events``: how many pages yield events without a language model, and how many."""
    got = best_.agg(F.count_if(F.col("events") > 0).alias("verified"), F.coalesce(F.sum(F.when(F.col("events") > 0, F.col("events"))), F.lit(0)).alias("events"))
    return pages.select("url").distinct().agg(F.count("*").alias("pages")).crossJoin(got)


def suggestion(url: Column, tier: Column, city: Column) -> Column:
    """A registry entry for a route, as text."""
    return F.concat(F.lit("- id: "), keys.source_slug(url), F.lit("\n  city: "), city, F.lit("\n  type: "), tier, F.lit("\n  url: "), url, F.lit("\n  enabled: false\n"))


def verdict(body: Column) -> Column:
    """Why a site without a route cannot be read; the most useful reason first."""
    text = F.regexp_replace(F.regexp_replace(body, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"<[^>]+>", " ")
    return (
        F.when(body.rlike(TICKETS), "tickets elsewhere").when(text.rlike(PROGRAMME) & text.rlike(DATED), "prose with dates").when(text.rlike(PROGRAMME), "prose without dates")
        .when(body.rlike(SCRIPTED), "rendered by script").when(body.rlike(SOCIAL), "social media only").otherwise("nothing about events")
    )


def census(pages: DataFrame) -> DataFrame:
    """``verdict, n, share`` over pages ``url, body`` with text."""
    got = pages.where("body is not null").groupBy(verdict(F.col("body")).alias("verdict")).agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n").alias("_all"))
    return got.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
