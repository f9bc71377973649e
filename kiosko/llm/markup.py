"""Markup residue in text: find it, and turn it into clean text that keeps its structure.

A text is cut into tokens: words, and marks of HTML, Markdown, wiki and LaTeX (character entities and unclosed tags
included). Words score positive and marks negative. The weights are log-odds learned from labelled pages: a page shows
the text of its Event plainly, and gives it in its JSON-LD with whatever markup the source used; the words of the
description that the page shows are content, what stands before them is not. One factor for all marks is then
calibrated on the same pages, as great as it can be without parting content from itself.

* A text holds markup if the scan over its tokens meets one that scores negative. (A mark costs LEAST at least; but
  marks that pages show as often as descriptions hold them are plain signs, score nothing and do not count.)
* A text is cleaned by a linear scan for the contiguous run of tokens of greatest score; what lies outside it at either
  end is dropped: styles, comments, templates, pictures and captions too short to pay for their marks. Inside it
  headings become ``# ``, list items ``- ``, table cells are parted by `` | ``, code is kept in fences and formulas
  between dollar signs; marks that only shape the look go, to any depth.

Signs used as plain text are no marks: ``I <3 you``, ``5 * 3 * 2``, ``8_bit_night``, ``C# en F#``, ``[1]``, ``2^3``,
``$5 - $10``, ``==> deur 3``, ``R&B``, ``Q&A;``.

Defined results: null and empty texts hold no markup and stay as they are; a text of marks alone gives an empty
string; texts of any length are read whole; a JSON-LD node without a description gives no row; without pages that show
their text the weights are WEIGHTS; extra columns are kept.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element names of HTML, by what they mean for the text.
HEADINGS = "h1|h2|h3|h4|h5|h6"
BLOCKS = "p|div|section|article|header|footer|nav|aside|main|ul|ol|table|tr|thead|tbody|tfoot|blockquote|figure|figcaption|dl|form|br|hr|pre|body|html|head|address|details|summary"
INLINE = "a|b|i|u|s|em|strong|span|small|big|sub|sup|mark|font|center|img|code|kbd|tt|abbr|cite|q|del|ins|time|label|input|button|iframe|video|audio|source|svg|path|link|meta|title|ref|nowiki|li|td|th|dt|dd|script|style|strike|caption|col|colgroup|option|select|object|embed|param|noscript|picture|var|samp|wbr|math|doctype"
NAMES = f"(?:{HEADINGS}|{BLOCKS}|{INLINE})"

#: Patterns of markup, tried in this order; Java and Python read each alike. ``\n`` begins a line.
PATTERNS = {
    "comment": r"<!--[\s\S]*?(?:-->|$)",
    "void": r"<(?:script|style)\b[^>]*>[\s\S]*?</(?:script|style)\s*>",
    "tag": rf"</?(?i:{NAMES})(?:\s[^<>]*|/)?>|<!(?i:doctype)[^<>]*>|</?(?i:{NAMES})(?:\s+[A-Za-z-]+\s*=[^<>]*)?$|</?(?i:{NAMES})\s+[a-z-]+=[\"'][^<>]*",
    "entity": r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});",
    "fence": r"```[\s\S]*?(?:```|$)",
    "display": r"\$\$[^$]+\$\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)",
    "formula": r"\$(?=[^$\n]*[\\^_={}])[^\s$](?:[^$\n]*[^\s$])?\$",
    "command": r"(?<![\w:.\\])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{?|\\\\(?=\s|$)|\\[%&#_{}](?=\s|$|\w|\))",
    "template": r"\{\{[^{}]*\}\}",
    "wikitable": r"\{\||\|\}|(?:^|(?<=\n))\|-[^\n]*|(?:^|(?<=\n))!(?!\[)[^\n!]+(?=\n)",
    "wikilink": r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+ [^\]\n]+\]",
    "link": r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)",
    "wikihead": r"(?:^|(?<=\n))={2,6}[^=\n>]+={2,6}(?=\s*(?:\n|$))",
    "setext": r"(?<=\n)(?:={3,}|-{3,})[ \t]*(?=\n|$)",
    "heading": r"(?:^|(?<=\n))#{1,6} +(?=\S)",
    "rule": r"(?:^|(?<=\n))\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*(?=\n|$)",
    "row": r"(?:^|(?<=\n))\|[^\n|]+\|[^\n]*\|[ \t]*(?=\n|$)",
    "bold": r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)|'{2,5}(?=[^\s'])[^'\n]+?(?:'[^'\n]+?)*?'{2,5}",
    "italic": r"(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])",
    "strike": r"~~(?=\S)[^~\n]+?~~",
    "code": r"`[^`\n]+`",
    "item": r"(?:^|(?<=\n))[ \t]*(?:[*+-]|\d{1,3}[.)])[ \t]+(?=[^\s=])",
    "quote": r"(?:^|(?<=\n))> (?=\S)",
}
#: A cheaper pattern that every text with markup meets; the JVM passes over all others.
MAY = (
    r"</?[A-Za-z!]|&#?\w{2,10};|\\[A-Za-z]{2}|\\[\\\[(%&#_{}]|\$[^$\n]*[\\^_={}]|\$\$|\{[{|]|\|\}|\[\[|\]\(|\[http"
    r"|(?:^|\n)[ \t]*(?:[=#|!>]|[*+-][ \t]|\d{1,3}[.)][ \t])|\*\*[^\s\d]|__\S|''|~~\S|`[^`\n]+`|(?<![\w*])\*[^\s*=]|(?<!\w)_[^\s_]|---|===|```"
)
#: Signs that markup begins with, so that words are passed over quickly.
_begin = r"(?=[<&\\$`*_'\[!{|~#=+>:-]|(?<![^\n])[ \t\d])"
_any = re.compile(f"{_begin}(?:" + "|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()) + ")")
_tag = re.compile(r"<(/?)!?([A-Za-z0-9]+)")
#: Weights of words and marks as long as none are learned.
WEIGHTS = {"word": 1.0, "mark": -0.1}
#: Factors of the marks' weights among which the pages choose, and the share of content that may be parted from itself.
LEAST = 0.01
FACTORS, LOST = (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.02, 0.01), 0.001
#: Marks that hold words of the text.
VALUED = {"formula", "display", "fence", "code", "bold", "italic", "link", "wikilink", "strike", "row", "wikihead"}


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of the markup in a text, in order; what lies between is words."""
    found = ((m.lastgroup, m.group(), m.start(), m.end()) for m in _any.finditer(text))
    return [x for x in found if x[0] != "entity" or x[1][1] == "#" or x[1][1:] in html5]


def _unescaped(text: str) -> str:
    """Entities resolved, again where markup itself was escaped."""
    while (plain := html.unescape(text)) != text:
        text = plain
    return text.replace("\xa0", " ")


def _pieces(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for kind, part, a, b in tokens(text):
        if a > at:
            out.append(("word", text[at:a]))
        out.append((kind, part))
        at = b
    if at < len(text):
        out.append(("word", text[at:]))
    return out


def _name(kind: str, part: str) -> str:
    """The kind of a mark; of a tag, its element."""
    return m.group(2).lower() if kind == "tag" and (m := _tag.match(part)) else kind


def _weight(kind: str, part: str, weights: dict[str, float]) -> float:
    if kind == "word":
        return weights["word"] * len(part.split())
    mark = weights.get(_name(kind, part), weights["mark"])
    return mark + weights["word"] * len(part.split()) if kind in VALUED else mark


def region(pieces: list[tuple[str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous run of pieces with the greatest sum of weights, by one scan; (0, 0) where none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, part) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += _weight(kind, part, weights)
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _render(kind: str, part: str) -> str:
    if kind in ("comment", "void", "rule", "setext", "quote"):
        return "\n" if kind in ("rule", "setext") else ""
    if kind == "tag":
        m = _tag.match(part)
        close, name = m.group(1), m.group(2).lower()
        if re.fullmatch(HEADINGS, name):
            return "\n" if close else f"\n{'#' * int(name[1])} "
        if name in ("li", "dt"):
            return "" if close else "\n- "
        if name in ("td", "th"):
            return " | " if close else ""
        if name == "pre":
            return "\n```\n"
        return "\n" if re.fullmatch(BLOCKS, name) else ""
    if kind == "fence":
        return "\n```\n" + part.strip("`").strip("\n") + "\n```\n"
    if kind in ("display", "formula"):
        body = part.strip("$") if part[0] == "$" else part[2:-2]
        return f" ${body.strip()}$ "
    if kind == "command":
        if part.startswith("\\item"):
            return "\n- "
        if re.match(r"\\(?:sub)*section|\\chapter|\\title", part):
            return "\n# "
        return part[1:] if len(part) == 2 and part[1] in "%&#_{}" else ("\n" if part == "\\\\" else "")
    if kind in ("template", "wikitable"):
        return "" if kind == "template" else ("\n" + part.lstrip("!|-{} \t").replace("!!", " | ") if part.strip()[:1] == "!" else "\n")
    if kind == "wikilink":
        body = part.strip("[]")
        return body.split("|")[-1] if "|" in body else (body.split(" ", 1)[1] if body.startswith("http") and " " in body else body)
    if kind == "link":
        return part[part.index("[") + 1 : part.index("](")]
    if kind == "wikihead":
        level = len(part) - len(part.lstrip("="))
        return f"\n{'#' * level} {part.strip('= ')}\n"
    if kind == "heading":
        return "\n" + part.strip() + " "
    if kind == "row":
        return "\n" + " | ".join(x.strip() for x in part.strip().strip("|").split("|")) + "\n"
    if kind in ("bold", "italic", "strike", "code"):
        return part.strip("*_'~") if kind != "code" else part
    if kind == "item":
        return "\n- "
    return ""


#: Kinds that stand in clean text, as they are its structure.
CLEAN = {"word", "code", "fence", "formula", "item", "heading"}


def _prepared(text: str) -> str:
    """Entities resolved, underlined headings and LaTeX commands of one argument unwrapped."""
    if "&" in text:
        text = _unescaped(text)
    text = re.sub(r"(?:^|(?<=\n))([^\n]+)\n(?:={3,}|-{3,})[ \t]*(?=\n|$)", r"# \1", text)
    if "\\" in text:
        text = re.sub(r"\\(?:(?:sub)*section|chapter|title|paragraph)\*?\{([^{}]*)\}", r"\n# \1\n", text)
        text = re.sub(r"\\(?:text(?:bf|it|tt|sc)|emph|underline|mbox)\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", text)
    return text


def cleaned(text: str | None, weights: dict[str, float] | None = None) -> str | None:
    """Clean text with its structure kept: the region of greatest score, its marks rendered."""
    if not text:
        return text
    text = _prepared(text)
    pieces = _pieces(text)
    a, b = region(pieces, weights or WEIGHTS)
    # marks beside the region that give its first or last words their place belong to it
    while 0 < a < b and pieces[a - 1][0] in ("tag", "heading", "item") and _render(*pieces[a - 1]).strip():
        a -= 1
    while a < b < len(pieces) and pieces[b][0] == "tag" and _render(*pieces[b]).strip():
        b += 1
    pieces = pieces[a:b]
    while True:  # markup inside bold, cells and links; each turn takes marks away
        text = "".join(part if kind == "word" else _render(kind, part) for kind, part in pieces)
        left = sum(kind not in CLEAN for kind, _ in pieces)
        pieces = _pieces(text)
        if not 0 < sum(kind not in CLEAN for kind, _ in pieces) < left:
            break
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return re.sub(r"((?:^|\n)- [^\n]*)\n+(?=\n- )", r"\1", text).strip()


def residue(text: str | None, weights: dict[str, float] | None = None) -> float:
    """How much the scan over a text's tokens loses to marks: the sum of its negative scores, as a positive number."""
    if not text:
        return 0.0
    w = weights or WEIGHTS
    return -sum(min(0.0, w.get(_name(kind, part), w["mark"])) for kind, part, _, _ in tokens(text))


def has_markup(text: str | None, weights: dict[str, float] | None = None) -> bool:
    """Whether the scan meets a token of negative score."""
    return residue(text, weights) > 0


_script = re.compile(r"<script\b[^>]*ld\+json[^>]*>([\s\S]*?)</script\s*>", re.I)


def event_descriptions(page: str | None) -> list[str]:
    """The descriptions of the Event nodes in a page's JSON-LD, at any depth, after JSON decoding."""
    out: list[str] = []

    def walk(node: object) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            kind = node.get("@type")
            if any(isinstance(k, str) and "Event" in k for k in (kind if isinstance(kind, list) else [kind])):
                if isinstance(text := node.get("description"), str):
                    out.append(text)
            for x in node.values():
                walk(x)

    for m in _script.finditer(page or ""):
        for body in (m.group(1), html.unescape(m.group(1))):
            try:
                walk(json.loads(body, strict=False))
                break
            except ValueError:
                continue
    return out


def _walk_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, t) for i, page in zip(b["row_id"], b["text"]) for t in event_descriptions(page)]
        yield pd.DataFrame(rows, columns=["row_id", "text"])


def descriptions(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """``origin, row_id, text``: the descriptions of raw_records and of the Event nodes of tudelft_events."""
    a = raw.select(F.lit("raw_records").alias("origin"), F.col("ordinal").alias("row_id"), F.col("description").alias("text")).where("text is not null")
    b = pages.select(F.col("page_id").alias("row_id"), F.col("html").alias("text")).mapInPandas(_walk_pages, "row_id long, text string")
    return a.unionByName(b.select(F.lit("tudelft_events").alias("origin"), "row_id", "text"))


def may_hold_markup(c: Column) -> Column:
    """A test on the JVM that every text with markup meets, and few others."""
    return c.rlike(MAY)


def _shown(page: str) -> str:
    """What a page shows, without its tags."""
    return html.unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "\n", page)))


def labelled(page: str | None) -> Iterator[tuple[list[tuple[str, str]], list[int], int, int]]:
    """For each Event description of which a page shows a part: its tokens, the number of words before each, and the
    first and last word that is shown."""
    texts = event_descriptions(page)
    words = _shown(page).split() if texts else []
    shown = set(zip(words, words[1:], words[2:]))
    for text in texts:
        pieces = _pieces(text)
        before, words = [], []
        for kind, part in pieces:
            before.append(len(words))
            if kind == "word" or kind in VALUED:
                words += part.split()
        hits = [i for i, x in enumerate(zip(words, words[1:], words[2:])) if x in shown]
        if hits:
            yield pieces, before, hits[0], hits[-1] + 2


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        inside: Counter = Counter()
        outside: Counter = Counter()
        plain: Counter = Counter()
        for page in b["text"]:
            for kind, part in _pieces(_shown(page or "")):
                plain[_name(kind, part)] += len(part.split()) if kind == "word" else 1
            for pieces, before, first, last in labelled(page):
                for (kind, part), at in zip(pieces, before):
                    if at > last:  # the page may show only the beginning: what follows has no label
                        break
                    if kind == "word":
                        n = len(part.split())
                        held = max(0, min(at + n, last + 1) - max(at, first))
                        inside["word"] += held
                        outside["word"] += max(0, min(n, first - at))
                    else:
                        (inside if first < at <= last else outside)[_name(kind, part)] += 1
        yield pd.DataFrame([(k, inside[k], outside[k], plain[k]) for k in {*inside, *outside, *plain}], columns=["token", "inside", "outside", "plain"])


def _count_lost(weights: dict[str, float], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each factor: words that pages show, and how many of them the scan leaves out."""
    tries = [{k: v if k == "word" else v * f for k, v in weights.items()} for f in FACTORS]
    for b in batches:
        lost, total = [0] * len(FACTORS), 0
        for page in b["text"]:
            for pieces, before, first, last in labelled(page):
                total += last + 1 - first
                for i, w in enumerate(tries):
                    x, y = region(pieces, w)
                    end = before[y] if y < len(pieces) else 1 << 60
                    lost[i] += max(0, (before[x] if x < len(pieces) else last + 1) - first) + max(0, last + 1 - end)
        yield pd.DataFrame({"factor": range(len(FACTORS)), "lost": lost, "total": total})


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Log-odds weights of words and of each kind of mark, from pages that show their Event's description.

    Counts are aggregated over all pages before a row for each kind and element comes to the driver (fixed lists of
    about 150 names), and then a row for each factor.
    """
    rows = pages.select(F.col("html").alias("text"))
    counts = rows.mapInPandas(_count_tokens, "token string, inside long, outside long, plain long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "plain")]).collect()
    if not any(r.inside for r in counts):
        return WEIGHTS
    total_in, total_out = sum(r.inside for r in counts) + 1, sum(r.outside for r in counts) + 1
    got = {r.token: math.log((r.inside + 0.5) / total_in) - math.log((r.outside + 0.5) / total_out) for r in counts}
    word = max(0.1, got.pop("word", WEIGHTS["word"]))
    held, shown = ({r.token: r[c] + r.inside * (c == "outside") for r in counts} for c in ("outside", "plain"))
    signs = {k for k in got if shown[k] * held["word"] >= held[k] * shown["word"]}
    marks = {k: 0.0 if k in signs else min(-LEAST, v) for k, v in got.items()}
    weights = {"word": word, "mark": sum(marks.values()) / max(1, len(marks)) or -word, **marks}
    tried = rows.mapInPandas(partial(_count_lost, weights), "factor int, lost long, total long").groupBy("factor").agg(F.sum("lost").alias("lost"), F.sum("total").alias("total")).collect()
    kept = [FACTORS[r.factor] for r in tried if r.lost <= LOST * r.total]
    return {k: v if k == "word" else v * max(kept, default=FACTORS[-1]) for k, v in weights.items()}


def found(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``origin, row_id`` of the rows whose text scores less than its words, by the weights of the scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[has_markup(t, weights) for t in b["text"]], ["origin", "row_id"]]

    return rows.where(may_hold_markup(F.col("text"))).mapInPandas(run, "origin string, row_id long")


def marked_up(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``origin, row_id, text, clean`` of the rows whose text holds markup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_markup(t, weights) for t in b["text"]]].copy()
            b["clean"] = [cleaned(t, weights) for t in b["text"]]
            yield b

    return rows.where(may_hold_markup(F.col("text"))).mapInPandas(run, "origin string, row_id long, text string, clean string")
