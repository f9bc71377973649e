import html
import re
import unicodedata

import pandas as pd
from conftest import SMALL

import __spark_entry__ as entry
from kiosko.functions import rules

Q = entry.queries()


def norm(t: str | None) -> str:
    """The comparison key of a title in plain Python."""
    low = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
    return " ".join(w for w in re.sub(r"[^\w\s]", " ", low).split() if w not in rules.STOPWORDS["nl"])


def test_titles_and_trigrams_of_all_rows(spark):
    titles = pd.read_parquet(f"{SMALL}/raw_records.parquet", columns=["ordinal", "title"]).set_index("ordinal")["title"]
    assert any(t and not t.isascii() for t in titles)
    got = {r.ordinal: r.norm for r in Q["normalize_titles"](spark, SMALL).collect()}
    assert got == {i: norm(t) for i, t in titles.items()}
    cut = lambda s: ",".join(sorted({s[i : i + 3] for i in range(max(1, len(s) - 2))})) if s else ""
    grams = {r.ordinal: r.grams for r in Q["title_trigrams"](spark, SMALL).collect()}
    assert grams == {i: cut(norm(t).replace(" ", "")) for i, t in titles.items()}


def test_pages_with_entities_are_stripped_too(spark):
    pages = pd.read_parquet(f"{SMALL}/tudelft_events.parquet", columns=["page_id", "html"]).set_index("page_id")["html"]
    want = {}
    for i, t in pages.items():
        bare = re.sub(r"<[^>]+>", "", re.sub(r"(?i)<\s*/?\s*(br|p|div|li|tr|h[1-6])\b[^>]*>", " ", t)) if t else t
        want[i] = " ".join(html.unescape(bare).split()) if t and ("<" in t or "&" in t) else t
    got = {r.page_id: r.plain for r in Q["strip_html"](spark, SMALL).collect()}
    assert got == want and any("&" in t for t in pages if t)
