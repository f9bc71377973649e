"""The source registry: loading, checks and the rule that held-out sources stay out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = (
    "id string, city string, country string, source_type string, url string, trust int, cadence_minutes int, timezone string, locale string, enabled boolean, "
    "selectors map<string,string>, max_detail_pages int, venue_name string, venue_address string, collapse_repeats boolean, date_from string, notes string"
)
DEFAULTS = {"country": "NL", "trust": 3, "cadence_minutes": 360, "timezone": "Europe/Amsterdam", "locale": "nl", "enabled": True, "max_detail_pages": 40, "collapse_repeats": False, "date_from": "event", "notes": ""}


def load_file(path: str | Path) -> list[dict]:
    """Sources of one YAML file with defaults filled in; a repeated id is an error."""
    import yaml

    rows = (yaml.safe_load(Path(path).read_text()) or {}).get("sources", [])
    ids = [r["id"] for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated source ids: {', '.join(twice)}")
    return [DEFAULTS | {k: v for k, v in r.items() if k != "type"} | {"source_type": r.get("source_type", r.get("type"))} for r in rows]


def load(spark: SparkSession, folder: str | Path, holdouts: bool = False, city: str | None = None) -> DataFrame:
    """The registry of a folder, or its held-out sources (of a city, if one is named); never both."""
    files = sorted(p for p in Path(folder).glob("*.yaml") if p.name.startswith("holdout_") == holdouts)
    names = [f.split()[0] for f in SPEC.split(", ")]
    rows = [tuple(r.get(n) for n in names) for p in files for r in load_file(p) if city is None or str(r.get("city", "")).lower() == city.lower()]
    return spark.createDataFrame(rows, SPEC)


def leaked(registry: DataFrame, holdouts: DataFrame) -> DataFrame:
    """Registry rows that share an id or an address with a held-out source."""
    plain = F.rtrim(F.col("url"), F.lit("/"))
    by_id = registry.join(holdouts.select("id"), "id", "left_semi")
    by_url = registry.withColumn("_u", plain).join(holdouts.select(plain.alias("_u")), "_u", "left_semi").drop("_u")
    return by_id.union(by_url.select(by_id.columns)).dropDuplicates(["id"])


def check_holdouts(registry: DataFrame, holdouts: DataFrame) -> None:
    """Raise if a held-out source is in the registry: recall against it would be no measurement."""
    if names := [r.id for r in leaked(registry, holdouts).select("id").limit(20).collect()]:
        raise ValueError(f"held-out sources in the registry: {', '.join(sorted(names))}")


def gold(spark: SparkSession, path: str | Path) -> DataFrame:
    """``id, title, start_raw, venue, is_free, city, source`` of a JSON list of labelled events; one without a start is an error."""
    import json

    rows = json.loads(Path(path).read_text())
    for r in rows:
        if not r.get("start"):
            raise ValueError(f"labelled event without a start: {r.get('title')}")
    got = [(i, r["title"], r["start"], r.get("venue"), r.get("is_free"), r.get("city", "Delft"), r.get("source_hint")) for i, r in enumerate(rows)]
    return spark.createDataFrame(got, "id long, title string, start_raw string, venue string, is_free boolean, city string, source string")


def overrides(spark: SparkSession, path: str | Path) -> DataFrame:
    """``name, lat, lon`` of venues whose coordinates were written by hand (YAML); entries that lack one are passed over."""
    import yaml

    file = Path(path)
    rows = (yaml.safe_load(file.read_text()) or {}).get("venues", []) if file.exists() else []
    got = []
    for r in rows:
        try:
            got.append((str(r["name"]), float(r["lat"]), float(r["lon"])))
        except (KeyError, TypeError, ValueError):
            continue
    return spark.createDataFrame(got, "name string, lat double, lon double")


def corpus(events: DataFrame, city: str) -> DataFrame:
    """``id, city, second, norm, venue, is_free`` of the events of a city, as ``measures`` reads them."""
    from kiosko.functions import text

    rows = events.where(F.lower("city") == city.lower())
    return rows.select("id", "city", F.unix_seconds("start_at").alias("second"), text.normalize_title(F.col("title")).alias("norm"), F.col("venue_name").alias("venue"), "is_free")


def payload_of(source_id: str, folder: str | Path | None, manifest: DataFrame, blobs: DataFrame) -> str | None:
    """The stored payload of a source: a file of its name in a folder, else its latest snapshot, else None."""
    for suffix in (".html", ".ics", ".xml", ".json") if folder is not None else ():
        if (file := Path(folder) / f"{source_id}{suffix}").exists():
            return file.read_text()
    row = latest_snapshot(manifest.where(F.col("source_id") == source_id)).join(blobs, "digest").select("body").first()
    return row.body if row else None


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """``n, url``: the lines of a text file in order, without comments and blanks, ``https://`` where no scheme is given, each once."""
    lines = (x.split("#")[0].strip() for x in Path(path).read_text().splitlines())
    urls = dict.fromkeys(x if x.startswith(("http://", "https://")) else f"https://{x}" for x in lines if x)
    return spark.createDataFrame(list(enumerate(urls)), "n long, url string")


def snapshot(payloads: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs not yet stored, manifest rows) of fetched payloads ``source_id, fetched_at, body``."""
    from kiosko.functions import keys

    rows = payloads.withColumn("digest", keys.digest(F.col("body")))
    return rows.select("digest", "body").dropDuplicates(["digest"]).join(manifest.select("digest").distinct(), "digest", "left_anti"), rows.select("source_id", "fetched_at", "digest")


def latest_snapshot(manifest: DataFrame) -> DataFrame:
    """The digest last fetched from each source; of equal times the first digest."""
    return manifest.groupBy("source_id").agg(F.min_by("digest", F.struct(F.coalesce(-F.unix_micros("fetched_at"), F.lit(1 << 62)), "digest")).alias("digest"), F.max("fetched_at").alias("fetched_at"))
