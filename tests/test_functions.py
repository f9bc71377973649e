import random
from functools import lru_cache

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kiosko.functions import keys, similarity, text


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(values[n], float) else 'string'}" for n in names))
    return df.select(expr.alias("x")).first().x


def test_titles(spark):
    n = lambda t, loc="nl": one(spark, text.normalize_title(F.col("t"), loc), t=t)
    assert n("De Jazzavond in de Wijnhaven") == "jazzavond wijnhaven" and n("Café  Chantant!") == "cafe chantant" and n("") == "" and n(None) is None or n(None) == ""
    assert n("El gato y la luna", "es") == "gato luna" and n("The end of a day", "fr") == "end day"


def test_trigrams(spark):
    g = lambda t: one(spark, text.title_trigrams(F.col("t")), t=t)
    assert sorted(g("ab cd")) == ["abc", "bcd"] and g("ab") == ["ab"] and g("") == [] and g("aaaa") == ["aaa"]


def test_clean_and_strip(spark):
    c = lambda t: one(spark, text.clean_text(F.col("t")), t=t)
    assert c("  a\x00b \n c d ") == "ab c d" and c("ﬁn") == "fin" and c(" \n ") is None and c(None) is None
    s = lambda t: one(spark, text.strip_html(F.col("t")), t=t)
    assert s("a<br>b <b>c</b> &amp; d&eacute;") == "a b c & dé" and s("plain  text") == "plain  text" and s(None) is None


def test_free_price_category(spark):
    f = lambda t: one(spark, text.detect_free(F.col("t")), t=t)
    assert f("Vrij entree!") is True and f("€ 5") is False and f("12,50 euro") is False and f("een avond") is None and f("") is None
    p = lambda t: one(spark, text.parse_price(F.col("t")), t=t)
    assert p("kost € 17,50 per stuk") == "€17,50" and p("niets") is None and p(None) is None
    k = lambda t, v: one(spark, text.categorize(F.col("t"), F.col("v")), t=t, v=v)
    assert k("Jazz concert", None) == "music" and k("iets", "Theater X") == "theatre" and k("kunst en sport", None) is None and k(None, None) is None


def reference_ratio(a: str, b: str) -> float:
    @lru_cache(None)
    def lcs(i, j):
        return 0 if i == len(a) or j == len(b) else lcs(i + 1, j + 1) + 1 if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(0, 0) / total


@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_ratio_against_plain_recursion(a, b):
    assert similarity.ratio(a, b) == pytest.approx(reference_ratio(a, b))
    assert similarity.token_set_ratio(a, b) == pytest.approx(similarity.token_set_ratio(b, a))


def test_known_ratios():
    r = lambda a, b: (round(similarity.token_set_ratio(a, b), 3), round(similarity.ratio(a, b), 3))
    assert r("jazzavond", "jazzavond wijnhaven") == (100, 64.286) and r("jazz night", "jazz avond") == (60, 60)
    assert r("delft chamber music festival opening", "delft chamber music festival openingsconcert") == (90, 90) and r("pubquiz", "speakers debate night") == (14.286, 21.429)


def test_time_and_place(spark):
    t = lambda a, b: one(spark, similarity.time_similarity(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")), a=a, b=b)
    assert t("2026-08-01 00:00:00", "2026-08-01 19:00:00") == 0.5 and t("2026-08-01 00:00:00", "2026-08-02 19:00:00") == 0 and t("2026-08-01 19:00:00", "2026-08-01 19:00:00") == 1
    assert t("2026-08-01 19:00:00", "2026-08-01 22:00:00") == 0 and t("2026-08-01 19:00:00", "2026-08-01 19:45:00") == 0.5 and t("2026-08-01 00:00:00", "2026-08-01 00:00:00") == 1
    g = lambda a, b: one(spark, similarity.distance_similarity(F.col("a"), F.lit(4.3), F.col("b"), F.lit(4.3)), a=a, b=b)
    assert g(52.0, 52.0) == 1 and g(52.0, 52.1) == 0 and 0 < g(52.0, 52.01) < 1
    v = similarity.venue_similarity(F.col("a"), F.lit(None), F.lit(None), F.col("b"), F.lit(None), F.lit(None))
    assert one(spark, v, a="Zaal X", b="zaal x") == 1 and one(spark, v, a=None, b="x") == 0.5


def test_keys(spark):
    import hashlib

    assert one(spark, keys.fingerprint(F.col("s"), F.col("t"), F.col("i")), s="src", t="Titel", i="2026") == hashlib.sha1(b"src|titel|2026").hexdigest()[:16]
    k = keys.venue_key(F.col("n"), F.col("c"))
    assert one(spark, k, n="Theater Veste - Delft", c="Delft") == one(spark, k, n="Theater Veste (Delft)", c="delft") and one(spark, k, n="Delft", c="Delft") != one(spark, k, n="", c="Delft")
    back = keys.cursor_parts(keys.cursor(F.col("a"), F.col("b")))
    assert one(spark, back, a="1785542400", b="ab|c?>") == ["1785542400", "ab|c?>"]
    assert one(spark, keys.source_slug(F.col("u")), u="https://www.Example.org/a/b-c/") == "example_org_a_b_c" and one(spark, keys.geo_key(F.lit(52.01234), F.lit(4.35)), a="") == "52.012,4.350"
