import random

import pytest
from pyspark.sql import functions as F

from kiosko.llm import encoding, markup

CLEAN = ["Café chantant", "één gast", "Fußgänger über Größe", "¿Quién quiere tarta? ¡Mira!", "la bibliothèque d'à côté", "«live» – gratis", "½ prijs", "°C", "ÆØÅ", "Ñandú 🎷 ☀", "Žarnik Đ Ÿ", "œuvres", "zo’n 5 €", "√2", "À Théâtre", "CAFÉ GALERÍA ÉÉN", "", "C# en F#"]


def sloppy(raw: bytes, page: str) -> str:
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
def test_round_trip(page):
    for t in CLEAN:
        bad = sloppy(t.encode(), page)
        if bad != t and "√" not in t:
            fixed, how = encoding.repaired(bad)
            assert fixed == t and how, (page, t, bad)


def test_twice_and_seven_bit():
    assert encoding.repaired(sloppy(sloppy("Café über".encode(), "cp1252").encode(), "cp1252")) == ("Café über", "spans")
    assert encoding.repaired("Caf+AOk- en re+APw-nie") == ("Café en reünie", "seven_bit")


def test_correct_text_is_no_case():
    for t in CLEAN:
        assert encoding.repaired(t) == (t, None), t
    assert encoding.repaired(None) == (None, None)


def test_unrestorable_and_partly():
    assert encoding.repaired("Caf\ufffd X")[1] == "lost"
    for t in ("Концерт в Москве", "Αθήνα Ρόδος", "Театр"):
        assert encoding.repaired(t) == (t, None), t
    assert encoding.repaired("CafЙ")[1]
    assert encoding.repaired("Un tr\u00c3\u00ado y niño") == ("Un trío y niño", "spans")
    assert encoding.repaired("publi\x82 dans l'arri\x8are-salle")[1]


def test_spans_are_maximal_and_well_formed():
    rng = random.Random(4)
    for _ in range(300):
        raw = [rng.choice([0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x80, 0xC0, -1]) for _ in range(12)]
        inside = set()
        for a, b in encoding.spans(raw):
            bytes(raw[a:b]).decode("utf-8")
            inside |= set(range(a, b))
        for i in range(12):  # nothing outside could have begun a sequence
            for n in (2, 3, 4):
                part = raw[i : i + n]
                if len(part) == n and -1 not in part and not inside & set(range(i, i + n)):
                    with pytest.raises(UnicodeDecodeError):
                        bytes(part).decode("utf-8")


def test_column_with_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "été " * 50_000 + "CafÃ©"
    df = spark.createDataFrame([(1, None, "a"), (2, "CafÃ©", "b"), (2, "CafÃ©", "b"), (3, "", "c"), (4, long, "d")], "k int, text string, kept string")
    got = encoding.repair(df, "text").orderBy("k").collect()
    assert [r.garbled for r in got] == [False, True, True, False, True]
    assert got[1].fixed == "Café" and got[4].fixed.endswith("Café") and got[0].fixed is None
    assert encoding.repair(df.limit(0), "text").count() == 0


def test_garbled_values(spark):
    v = "name string, address string"
    df = spark.createDataFrame([(1, "CafÃ©", None, ("Théâtre", None)), (2, None, None, None), (3, "ok", "Ã©tÃ©", ("GalerÃ\xada", None))], f"ordinal long, title string, description string, venue struct<{v}>")
    assert {(r.ordinal, r.field) for r in encoding.garbled_values(df).collect()} == {(1, "title"), (3, "description"), (3, "venue_name")}


MARKED = ["<p>x</p>", "a<br>b", "Q&amp;A", "&eacute;t&eacute;", "**fet** x", "_heel wat_ x", "# Kop\nx", "Kop\n=====\nx", "[a](https://b.example/c)", "![a](https://b.example/c.png)", "`code` x", "~~€ 12~~", "```\na = 1\n```", "== Kop ==\nx", "[[Zaal|Delft]]", "{{Infobox|a=b}}", "'''vet''' x", "\\textbf{vet}", "$$E = m$$", "$f(x) = x^{2}$", "\\[ a_i \\]", "regel\\\\", "<span style='a'>x", "- een\n- twee", "| a | b |\n|---|---|\n| c | d |", "<!-- x -->y"]
PLAIN = ["I <3 Trio!", "5 * 3 * 2 = 30 stoelen", "8_bit_night", "C# en F# mineur", "[1] en [2] zijn vol", "2^3 = 8; 2**3 = 8", "$5 - $10 at the door", "==> deur 3", "R&B, drum & bass", "a/b | c/d", "<volgt nog>", "\\o/", "C:\\agenda\\lijst", "`t Hoekje", "~ 45 min.", "#live #delft", "Leeftijd < 12 jaar", "DJ {live}", "* = onder voorbehoud", "(zie www.a.example/b)", "", "AT&T"]


def test_markup_and_plain_signs():
    import re

    for t in MARKED:
        assert markup.has_markup(t) and re.search(markup.MAY, t), t
    for t in PLAIN:
        assert not markup.has_markup(t), t
    assert not markup.has_markup(None)


def test_clean_keeps_structure():
    assert markup.cleaned("<h2>Kop</h2><p>Tekst &amp; meer</p><ul><li>een</li><li>twee</li></ul>") == "## Kop\n\nTekst & meer\n\n- een\n- twee"
    assert markup.cleaned("\\section*{Kop}\nmet $x^{2}$ erin") == "# Kop\n\nmet $x^{2}$ erin"
    assert "```" in markup.cleaned("<p>a</p><pre><code>x = 1</code></pre>") and markup.cleaned("[[Zaal|Delft]] is open") == "Delft is open"
    assert markup.cleaned(None) is None and markup.cleaned("") == "" and markup.cleaned("<br><br>") == ""
    assert markup.cleaned("Kop\n====\n\n* __Zaal__\n* tekst").startswith("# Kop")


def test_region_is_the_best_run():
    rng = random.Random(2)
    for _ in range(200):
        pieces = [("word", "w " * rng.randint(1, 4)) if rng.random() < 0.5 else ("tag", "<p>") for _ in range(rng.randint(0, 9))]
        w = {"word": 1.0, "mark": -2.0, "p": -2.0}
        value = lambda a, b: sum(markup._weight(k, t, w) for k, t in pieces[a:b])
        best = max([0.0, *(value(a, b) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1))])
        a, b = markup.region(pieces, w)
        assert value(a, b) == best


def test_event_descriptions_at_any_depth():
    page = '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","description":"no"},{"x":{"@type":["Event"],"description":"a \\u00e9"}},{"@type":"Event","description":null}]}</script>'
    assert markup.event_descriptions(page) == ["a é"] and markup.event_descriptions(None) == [] and markup.event_descriptions("<script type='application/ld+json'>{bad</script>") == []


def test_weights_decide_where_clean_text_begins():
    text = "<table><tr><th>Delft</th><td>De clown zingt een lied in de grote zaal van het theater.</td></tr></table>"
    light, heavy = {"word": 1.0, "mark": -0.1}, {"word": 1.0, "mark": -0.1, "th": -2.0}
    assert markup.cleaned(text, light).startswith("Delft | De clown") and markup.cleaned(text, heavy).startswith("De clown")
    assert markup.residue(text, heavy) > markup.residue(text, light) > 0
    assert not markup.has_markup("Q&A; Drum&Bass; en *", light) and not markup.has_markup("*nu* open", light | {"italic": 0.0})


def test_weights_come_from_what_pages_show(spark):
    page = '<html><head><script type="application/ld+json">{"@type": "Event", "description": "<style>x</style><b>De clown zingt een lied in de zaal.</b> Daarna soep."}</script></head><body><p>De clown zingt een lied in de zaal.</p></body></html>'
    w = markup.learn_weights(spark.createDataFrame([(page,)] * 5, "html string"))
    assert w["word"] > 0 > w["void"] and w["b"] < 0
    (pieces, before, first, last), = markup.labelled(page)
    assert (first, last) == (0, 7) and [k for k, _ in pieces] == ["void", "tag", "word", "tag", "word"]
    assert list(markup.labelled("<p>niets</p>")) == [] and list(markup.labelled(None)) == []


def test_marked_up_rows_and_weights(spark):
    raw = spark.createDataFrame([(1, "<b>x</b>"), (2, "plain"), (3, None), (4, "<b>x</b>")], "ordinal long, description string")
    pages = spark.createDataFrame([(7, '<html><body><nav>menu</nav><script type="application/ld+json">{"@type":"Event","description":"<p>veel woorden hier</p>"}</script><p>veel woorden hier</p></body></html>'), (8, None)], "page_id long, html string")
    got = markup.marked_up(markup.descriptions(raw, pages), markup.learn_weights(pages)).collect()
    assert {(r.origin, r.row_id) for r in got} == {("raw_records", 1), ("raw_records", 4), ("tudelft_events", 7)}
    assert markup.learn_weights(pages.limit(0))["word"] > 0
