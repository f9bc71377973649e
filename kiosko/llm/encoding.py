"""Garbled text from a wrong character encoding.

Three passes over each value that holds a suspicious sign (all others are passed over by one regular expression on
the JVM):

1. characters are mapped back to the bytes of a legacy code page; a byte-structure automaton for UTF-8 finds the
   maximal well-formed multibyte spans among them, and those spans only are decoded. The code page that explains
   most characters is taken, and the pass is repeated, so doubly garbled text is restored too;
2. ``+AOk-`` spans of seven-bit UTF-16 are decoded;
3. what is left of one-byte text read in another one-byte code page (``canci¢n``, ``ense–a``) is mapped back through
   the pair of code pages that turns every suspicious sign into a fitting letter.

A value is garbled if a pass changed it, or if it holds signs that only a wrong decoding leaves: U+FFFD, control
characters of the C1 block, a lone lead byte, a sign inside a word, a letter of another script against a Latin one, or a
question mark where a sign was lost. ``how`` says which: ``spans``, ``seven_bit``, ``one_byte``, or ``lost`` where
nothing could be restored. Words wholly in Greek or Cyrillic are no case.

Defined results: null and empty values are not garbled and stay as they are; texts of any length are read whole; a
repeated row gives a repeated result row (``p1_found`` makes cases distinct); extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15")
#: (real code page, code page it was read in) of one-byte text.
PAIRS = tuple((a, b) for b in ("latin-1", "cp1252") for a in ("mac_roman", "cp437", "cp850"))
#: What text of these listings may hold beside ASCII.
LETTERS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœšžđłőűćčęąńśźżğışřťůěďňľ"
SIGNS = "€£¿¡«»“”‘’„‚–—…°½¼¾·•§©®™ºª²³´×☀ "
FITTING = set(LETTERS) | {c for x in LETTERS for c in x.upper() if len(x.upper()) == 1} | set(SIGNS) | {"Ÿ"}

_L, _U = "a-zß-öø-ÿœšž", "A-ZÀ-ÖØ-ÞŒŠŽŸ"
_W = _L + _U
_ODD = "\u0080-\u009f¢£¤¥¦¨©ª«¬­®¯°±²³´µ¶·¸¹º»¼½¾¿¡×÷†‡•ˆ˜‰‹›–—‘“”„‚…™€∀-⋿⌀-⏿─-▟Ͱ-ϿЀ-ӿĂĽľĹĺŁłđˀ-˟ﬁﬂ◊√"
#: Signs that no pass needs to explain: only a wrong decoding leaves them. Java and Python read it alike. Every
#: alternative begins at the odd sign itself, so that plain letters are passed over at the first test.
LEFT_OVER = (
    "�|[\u0080-\u009f\u00ad]"
    f"|(?<=[{_L}A-Z])[¢£¤¥¦¨©¬®¯±²³´µ¶·¸¹º»¼½¾¿¡×÷†‡•ˆ˜‰‹›–—‘“”„‚…™€ª«](?=[{_L}])"
    "|(?<=[a-z])[ÃÂÕÔÊËÁÀÈÉÍÎÏÌÓÒÚÛÙÄÅÇÑÖØÜ](?=[a-z])"
    "|(?<![A-Za-z])[ÃÂ](?![A-Za-zÀ-ÿ])|(?<=[a-z])[ÃÂ](?![A-ZÀ-Þ])"
    f"|(?<=[A-Z])[à-öø-þ](?=[A-Z])|(?<=[a-z])[‚ŠŽ„]|[ˆƒ]|(?<=[A-Za-z])œ(?![ui])|(?<![A-Za-zÀ-ÿ0-9$€£])[¢¤](?=[a-z])|(?<=[{_L}])[†‡¡¢£¤](?![0-9A-Za-z])"
    "|¨(?=[A-Z])|(?<![A-Za-zÀ-ÿ])[ÀÁ](?=[A-Z][a-z])"
    "|(?<=[a-zà-ÿ])\\?(?=[a-zà-ÿ])|(?<=[a-z] )\\?(?= \\d)"
    f"|[─-▟]|(?<=[{_W}])[Ѐ-ӿΑ-Ρ]|[Ѐ-ӿΑ-Ρ](?=[{_W}])"
)
_BROKEN = "â€|Ã[^A-Za-z ]|Â[^A-Za-z ]|Ă[^A-Za-z ]|√|‚Ä|‚Ç|ÔÇ|Γ[\u0080-￿]"
_SEVEN = r"\+[A-Za-z0-9+/]{2,}-"
#: One pattern for the JVM: every value that a pass may change or mark matches it.
SUSPICIOUS = f"(?=[\u0080-\uffff?+])(?:{LEFT_OVER}|{_BROKEN}|{_SEVEN}|[\u0080-\uffff]{{2}})"
_left, _seven, _high = re.compile(LEFT_OVER), re.compile(_SEVEN), re.compile("[\u0080-\U0010ffff]+")
_quoted = re.compile(f"[{_W}]['’]?[{_W}]")


@lru_cache(None)
def page(name: str) -> dict[str, int]:
    """Character to byte; bytes that a code page leaves undefined keep their value as a control character."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def spans(codes: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of well-formed multibyte UTF-8 sequences in bytes of 0x80 and more; -1 is no byte.

    The automaton's state is the number of continuation bytes still due and the range of the next one.
    """
    out, n, i = [], len(codes), 0
    start = -1
    while i < n:
        b, end = codes[i], 0
        if 0xC2 <= b <= 0xDF:
            end, lo, hi = 2, 0x80, 0xBF
        elif 0xE0 <= b <= 0xEF:
            end, lo, hi = 3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            end, lo, hi = 4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        ok = end > 0 and i + end <= n
        for k in range(1, end if ok else 0):
            if not lo <= codes[i + k] <= hi:
                ok = False
                break
            lo, hi = 0x80, 0xBF
        if ok:
            start = i if start < 0 else start
            i += end
            continue
        if start >= 0:
            out.append((start, i))
            start = -1
        i += 1
    if start >= 0:
        out.append((start, n))
    return out


def _fits(c: str) -> bool:
    o = ord(c)
    return c in FITTING or c in _garble or 0x1F300 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or o == 0xFE0F


#: Characters that a first garbling leaves; a span may decode to them when text was garbled twice.
_garble = {bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0x100)}


def _decode(text: str, name: str) -> tuple[str, int]:
    """Text with the well-formed spans of one code page decoded, and the number of characters they took."""
    table, took, out, at = page(name), 0, [], 0
    for m in _high.finditer(text):
        run = m.group()
        if len(run) < 2:
            continue
        for a, b in spans([table.get(c, -1) for c in run]):
            plain = bytes(table[c] for c in run[a:b]).decode("utf-8")
            if all(map(_fits, plain)):
                out += [text[at : m.start() + a], plain]
                at, took = m.start() + b, took + b - a
    return "".join([*out, text[at:]]), took


def _unseven(m: re.Match) -> str:
    import base64

    body = m.group()[1:-1]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        plain = raw[: len(raw) // 2 * 2].decode("utf-16-be")
    except (ValueError, UnicodeDecodeError):
        return m.group()
    return plain if plain and all(ord(c) > 0x7F and _fits(c) for c in plain) else m.group()


def _one_byte(text: str) -> str:
    """The text read through the pair of code pages that leaves fewest suspicious signs, if it leaves fewer."""
    best, least = text, len(_left.findall(text))
    for real, read in PAIRS:
        table = page(read)
        plain = "".join(bytes([table[c]]).decode(real) if c in table else c for c in text)
        odd = len(_left.findall(plain)) + sum(1 for c in plain if ord(c) > 0x7F and c not in FITTING and c != "�")
        if odd < least:
            best, least = plain, odd
    return best


def repaired(text: str | None) -> tuple[str | None, str | None]:
    """The text restored as far as it goes, and how it was found to be garbled; None where it was not."""
    if not text:
        return text, None
    now = text
    while True:  # each pass takes characters away
        best, most = now, 0
        for name in CODE_PAGES:
            plain, took = _decode(now, name)
            if took > most:
                best, most = plain, took
        if not most:
            break
        now = best
    how = "spans" if now != text else None
    now = _seven.sub(_unseven, before := now)
    if now != before:
        how = how or "seven_bit"
    if now != text:  # bytes that white space or a lost soft hyphen took away
        now = re.sub("Ã (?= )|(?<![A-Za-zÀ-ÿ])Ã(?= )", "à", now)
        now = re.sub(f"(?<=[{_L}])Ã(?=[{_L}])", "í", now)
    if _left.search(now):
        now = _one_byte(before := now)
        how = how or ("one_byte" if now != before else "lost")
    return now, how


def suspicious(c: Column) -> Column:
    return c.rlike(SUSPICIOUS)


def repair(df: DataFrame, text: str, fixed: str = "fixed", garbled: str = "garbled") -> DataFrame:
    """``df`` with the restored text and whether it was garbled; only suspicious values leave the JVM."""
    run = F.pandas_udf(_batch, "struct<fixed: string, garbled: boolean>")
    rows = df.withColumn("_e", run(F.when(suspicious(F.col(text)), F.col(text))))
    return rows.withColumns({fixed: F.coalesce(F.col("_e.fixed"), F.col(text)), garbled: F.coalesce(F.col("_e.garbled"), F.lit(False))}).drop("_e")


def _batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(t, how is not None) for t, how in map(repaired, texts)], columns=["fixed", "garbled"])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = [repaired(t) for t in b["text"]]
        b["fixed"], b["how"] = [x for x, _ in done], [how for _, how in done]
        yield b.loc[b["how"].notna(), ["ordinal", "field", "text", "fixed", "how"]]


def garbled_values(raw: DataFrame) -> DataFrame:
    """``ordinal, field, text, fixed, how`` of every garbled title, description and venue name of raw_records."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in (("title", "title"), ("description", "description"), ("venue_name", "venue.name"))])
    rows = raw.select("ordinal", F.explode(F.filter(fields, lambda v: suspicious(v["text"]))).alias("v")).select("ordinal", "v.field", "v.text")
    return rows.mapInPandas(_found, "ordinal long, field string, text string, fixed string, how string")
