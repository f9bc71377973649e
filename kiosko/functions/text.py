"""Scalar text functions: built-in expressions, with Arrow functions where Unicode forms have no built-in."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kiosko.functions import rules

BLOCK = r"(?i)<\s*/?\s*(br|p|div|li|tr|h[1-6])\b[^>]*>"


def _each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of a text over Arrow batches; nulls stay null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return lambda c: F.pandas_udf(run, "string")(c)


_nfkc = _each(lambda x: "".join(c for c in unicodedata.normalize("NFKC", x) if c == "\n" or unicodedata.category(c)[0] != "C"))
_unmarked = _each(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))
_unescape = _each(html.unescape)


def squeezed(c: Column) -> Column:
    """White space, Unicode's too, to single spaces; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _ascii(c: Column) -> Column:
    return c.rlike(r"\A\p{ASCII}*\z")


def clean_text(c: Column) -> Column:
    """Compatibility form without control characters; null for what is empty then. ASCII texts stay on the JVM."""
    plain = F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f\x7f]", "")
    other = _nfkc(F.when(~_ascii(c), c))
    return F.nullif(squeezed(F.when(_ascii(c), plain).otherwise(other)), F.lit(""))


def strip_html(c: Column) -> Column:
    """Tags out (block tags leave a space), entities resolved; texts without either stay untouched."""
    bare = F.regexp_replace(F.regexp_replace(c, BLOCK, " "), r"<[^>]+>", "")
    plain = F.when(bare.contains("&"), _unescape(F.when(bare.contains("&"), bare))).otherwise(bare)
    return F.when(c.contains("<") | c.contains("&"), squeezed(plain)).otherwise(c)


def unmarked(c: Column) -> Column:
    """Lower case without accents; ASCII texts stay on the JVM."""
    low = F.lower(c)
    return F.when(_ascii(low), low).otherwise(_unmarked(F.when(~_ascii(low), low)))


def normalize_title(c: Column, locale: str | Column = "nl") -> Column:
    """Comparison key of a title: no case, accents, punctuation or stop words of the locale; null for null."""
    words = F.filter(F.split(F.regexp_replace(unmarked(c), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")
    lists = {k: F.array(*[F.lit(w) for w in v]) for k, v in rules.STOPWORDS.items()}
    if isinstance(locale, str):
        stop = lists.get(locale, lists["en"])
    else:
        stop = reduce(lambda acc, k: acc.when(locale == k, lists[k]), lists, F.when(F.lit(False), lists["en"])).otherwise(lists["en"])
    return F.when(c.isNotNull(), F.concat_ws(" ", F.filter(words, lambda w: ~F.array_contains(stop, w))))


def title_trigrams(normal: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a normalised title without spaces; a short one whole, an empty one none."""
    s = F.replace(normal, F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))
    return F.when(F.length(s) >= n, grams).when(F.length(s) > 0, F.array(s)).otherwise(F.array().cast("array<string>"))


def detect_free(blob: Column, locale: str = "nl") -> Column:
    """True for a marker, false for an amount of money, null where the text says neither."""
    low = F.lower(blob)
    marks = [*rules.FREE_MARKERS.get(locale, []), *rules.FREE_MARKERS["en"]]
    free = reduce(lambda a, b: a | b, [low.contains(m) for m in dict.fromkeys(marks)])
    paid = low.rlike(rules.MONEY)
    return F.when(low == "", None).when(free, True).when(paid, False)


def parse_price(c: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, rules.PRICE, 0), F.lit("")), F.lit(" "), F.lit(""))


#: (category, weight, term) of every term; its place is its bit.
TERMS = [(name, weight, term) for name, tiers in rules.CATEGORIES.items() for weight, terms in tiers.items() for term in terms]
_BITS = 60


def term_masks(low: Column) -> list[Column]:
    """Which terms a text (a column in lower case, not null) holds, as bits of a few integers; those of several texts are
    united by ``bit_or``."""
    parts = [TERMS[i : i + _BITS] for i in range(0, len(TERMS), _BITS)]
    return [reduce(lambda a, b: a + b, [F.when(low.contains(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, _, t) in enumerate(part)]) for part in parts]


def _ranked(weights: dict[str, list[Column]]) -> Column:
    scores = [F.struct((-reduce(lambda a, b: a + b, terms)).alias("score"), F.lit(name).alias("name")) for name, terms in weights.items()]
    ranked = F.array_sort(F.array(*scores))
    # one more step, so that the ranking is worked out once
    return F.transform(F.array(ranked), lambda r: F.when((r[0]["score"] == 0) | ((r[0]["score"] == r[1]["score"]) & (r[0]["score"] > -2)), None).otherwise(r[0]["name"]))[0]


def category_of(text: list[str], venue: list[str]) -> Column:
    """The category with most weight of terms in the text (half weight in the venue's name); null for a weak tie. Both are
    names of columns of ``term_masks``."""
    has = lambda masks, i: F.col(masks[i // _BITS]).bitwiseAND(F.lit(1 << i % _BITS)) != 0
    weights: dict[str, list[Column]] = {}
    for i, (name, w, _) in enumerate(TERMS):
        weights.setdefault(name, []).append(F.when(has(text, i), float(w)).when(has(venue, i), w / 2).otherwise(0.0))
    return _ranked(weights)


def categorize(blob: Column, venue: Column) -> Column:
    """The category of one text and its venue's name."""
    low = F.struct(F.lower(F.coalesce(blob, F.lit(""))).alias("b"), F.lower(F.coalesce(venue, F.lit(""))).alias("v"))

    def ranked(x: Column) -> Column:
        weights: dict[str, list[Column]] = {}
        for name, w, t in TERMS:
            weights.setdefault(name, []).append(F.when(x["b"].contains(t), float(w)).when(x["v"].contains(t), w / 2).otherwise(0.0))
        return _ranked(weights)

    return F.transform(F.array(low), ranked)[0]
