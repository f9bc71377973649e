"""Matching entities across sources without keys: listings of one showing of one event.

Records become profiles: exact repetitions of a source collapse to one, so that a hot group of copies costs one
comparison. Words of titles and of venue names weigh by rarity among the distinct titles and names; no word is left
out. Profiles meet within a city and local day when they share one of these keys:

* a leading word of the title: the rarest words, until those that are left hold less than a quarter of its weight (of
  two titles that agree in three quarters of either's weight, at least one leading word is the same);
* the ends of the title's two rarest words, in all four combinations, or those of a lone word, so that a slip in each
  word parts no pair;
* the title as a whole where it has no word;
* in cities listed in several languages, the venue's rarest word within the hour, so that titles need no word in common.

Each pair that met gets a vector of continuous similarities (title, place, time), computed on the JVM; what is unknown
is missing from it. A mixture of Gaussians (one of matched pairs; one of unmatched pairs for each similarity, as
another title, another place and another time of the day are apart) is fitted without labels by
expectation-maximisation: missing parts are integrated out, covariances are regularised by the distance of the
means of matched and unmatched, and each expectation step is followed by a projection onto transitivity. The Gaussians
are common to all pairs, their weights are not: pairs whose titles share a rare word, a common word or none have weights
of their own, as pairs by a common word grow with the square of a day's listings and those by a name do not, and would
otherwise leave a name without a known place no chance in a large table. For triangles a-m-b the posterior of
one edge must not be below the product of the other two; where it is, either that edge rises or the weaker of the
other two falls, whichever the sum of the three log-odds asks for, and a pair takes the mean over its triangles.
Vectors lie on a grid, so the fit runs on the driver over counts of grid points and of kinds of triangles, whose
number does not grow with the table. The posterior is the pair's confidence; nothing else decides.

Defined results: records without a title or without a date have no match; midnight is an unknown time; a null venue is
an unknown place, which neither confirms nor denies; records of one source never match; empty tables give no rows;
titles of any length are read whole; names of columns besides those read do not matter.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiosko.llm import addresses, encoding
from kiosko.operators import times
from kiosko.session import stored

GRID = 20
FEATURES = ("title", "place", "time")
RARITY = "rare"
#: Words of at most this share of the distinct titles (or venue names) are of the rarest kind; all weigh alike. There
#: are fewer words above it than words in a title divided by the share, so their list has a bound.
RARE_SHARE = 0.0002
STEPS = 5  # of a word's level for each unit of log rarity
TOP = round(STEPS * math.log(1 / RARE_SHARE))
#: Before each word stand the signs of its levels, that among distinct texts and that among all values.
SIGNS = 2
#: A title all of whose words are of more than this share of titles names a kind of event only.
KIND_LEVEL = round(STEPS * math.log(1 / 0.0025))
#: A word weighs its level to this power: a phrase of ten common words, all one fact, is not to outweigh a name.
POWER = 4
#: Share of a title's weight that words behind its leading ones may hold.
REST = 0.25
#: Minutes at which two clock times are as near as they are far; the same for two words, as a share of
#: their length, and as a number that long words do not pass.
HALF_MINUTES, FAR_WORDS, MOST_EDITS = 200.0, 0.4, 5
#: Pairs known to lie at the corner of each Gaussian, as a share of the matched pairs.
KNOWN = 0.03
#: Edges of less than LIVE make no triangle; third edges of more than SURE break none by more than 1 - SURE.
LIVE, SURE = 0.05, 0.99
STORE = 300_000
_word = re.compile(r"[a-z0-9]{2,}")
_suspicious = re.compile(encoding.SUSPICIOUS)
PROFILE = "words string, own int, lead int, who string, spot string"


def _plain(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii() and _suspicious.search(text):
        text = encoding.repaired(text)[0]
    return addresses.fold(text)


def word_levels(values: DataFrame, *columns: str) -> list[dict[str, str]]:
    """For each column the signs of the levels of rarity of each word that is not of the rarest kind: among the distinct
    texts of the column, and among all its values, where a phrase of one wording is as common as it is used."""
    marked = "".join(chr(c) for c, p in addresses._plain.items() if len(p) == 1 and 0xC0 <= c)
    plain = F.translate(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), marked, "".join(addresses._plain[ord(c)] for c in marked))
    words = F.array_distinct(F.split(plain, "[^a-z0-9]+"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(columns)])
    texts = values.select(F.explode(each).alias("x")).where("x.text is not null").groupBy("x.i", "x.text").agg(F.count("*").alias("m"))
    # the star counts the texts
    counts = stored(texts.select("i", "m", F.explode(F.concat(F.array(F.lit("*")), words)).alias("w")).groupBy("i", "w").agg(F.count("*").alias("n"), F.sum("m").alias("m")))
    total = {r.i: (r.n, r.m) for r in counts.where("w = '*'").collect()}
    common = F.lit(False)
    for i, (n, m) in total.items():
        common |= (F.col("i") == i) & ((F.col("n") > RARE_SHARE * n) | (F.col("m") > RARE_SHARE * m))
    level = lambda n, of: max(1, round(STEPS * math.log(of / n))) if n > RARE_SHARE * of else TOP
    out: list[dict[str, str]] = [{} for _ in columns]
    for r in counts.where("length(w) > 1").where(common).collect():
        out[r.i][r.w] = "".join(chr(48 + level(x, of)) for x, of in zip((r.n, r.m), total[r.i]))
    return out


def _weighted(words: list[str], levels: dict[str, str]) -> list[str]:
    """Each word once, with the signs of its levels before it; the rarest among texts first, else in order."""
    return sorted((levels.get(w, 2 * chr(48 + TOP)) + w for w in dict.fromkeys(words)), key=lambda x: -ord(x[0]))


def _leading(words: list[str]) -> int:
    """How many of the words, rarest first, leave less than REST of the weight behind them; two at least, if there are two."""
    left = total = sum((ord(w[0]) - 48) ** POWER for w in words)
    for i, w in enumerate(words):
        left -= (ord(w[0]) - 48) ** POWER
        if left <= REST * total:
            return min(len(words), max(2, i + 1))
    return len(words)


def profiles(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``ordinal, profile, source, city, lang, mixed, day, minute, words, own, lead, who, spot`` of each record with a title and a day."""
    zone = F.coalesce(F.col("timezone"), F.lit("Europe/Amsterdam"))
    sources = registry.select("id", "city", F.col("locale").alias("lang"), zone.alias("zone"))
    home = sources.where("zone <> 'UTC'").groupBy("city", "zone").agg(F.count("*").alias("n")).groupBy("city").agg(F.max_by("zone", F.struct("n", "zone")).alias("home"))
    tongues = sources.groupBy("city").agg((F.count_distinct("lang") > 1).alias("mixed"))
    sources = sources.withColumn("source", F.row_number().over(Window.orderBy("id")))  # a row for each source
    sources = sources.join(home, "city", "left").join(tongues, "city", "left")
    sources = sources.select(F.col("id").alias("_id"), "source", "city", "lang", F.coalesce("mixed", F.lit(False)).alias("mixed"), "zone", F.coalesce("home", "zone").alias("home"))
    values = records.select("ordinal", "source_id", F.col("start_raw").alias("text"), "title", F.col("venue.name").alias("name"), F.col("venue.address").alias("address"))
    values = values.where(F.trim("title") != "").where(F.col("text").isNotNull())
    titles, names = word_levels(values, "title", "name")
    values = values.join(F.broadcast(sources), values["source_id"] == sources["_id"]).drop("_id", "source_id")
    rows = times.instants(values, sources.select("zone").distinct(), source="source", dates=True)
    local = F.from_utc_timestamp(F.timestamp_seconds("utc_second"), F.col("home"))
    rows = rows.withColumns({"day": F.coalesce(F.to_date(local), F.col("stated_date")), "minute": F.nullif((F.hour(local) * 60 + F.minute(local)).cast("int"), F.lit(0))})
    rows = rows.where("day is not null").drop("zone", "home", "text", "utc_second", "stated_date")
    towns = {addresses.fold(r.city): r.country for r in registry.select("city", "country").where("city is not null").distinct().collect()}
    held = records.sparkSession.sparkContext.broadcast((titles, names, towns))

    @F.pandas_udf(PROFILE)
    def look(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        # what a venue or an address says is worked out once for each in a task; the stores are emptied past a bound
        titles, names, towns = held.value
        tail = addresses._tail(tuple(towns))
        venues: dict[str | None, str | None] = {}
        spots: dict[tuple, str | None] = {}
        for title, name, address, city in parts:
            out = []
            if len(venues) + len(spots) > STORE:
                venues.clear()
                spots.clear()
            for t, n, a, c in zip(title, name, address, city):
                if n not in venues:
                    own = _word.findall(re.sub(r",.*$", "", tail.sub(" ", _plain(n))))
                    venues[n] = " ".join(_weighted(own, names)) or None
                if a is not None and (a, c) not in spots:
                    p = addresses.parse(_plain(a), c, None, towns) if a else (None,) * 6
                    spots[a, c] = f"{p[4]}|{p[3] or ''}|{p[1] or ''}" if p[4] and (p[3] or p[1]) else None
                words = _weighted(_word.findall(t := _plain(t)) or [t.strip().replace(" ", "")], titles)
                # words of the record's own venue tell nothing of the show and do not lead
                house = {w[SIGNS:] for w in (venues[n] or "").split()}
                own = [w for w in words if w[SIGNS:] not in house]
                out.append((" ".join([*own, *(w for w in words if w[SIGNS:] in house)]), len(own), _leading(own or words), venues[n], spots[a, c] if a is not None else None))
            yield pd.DataFrame(out, columns=["words", "own", "lead", "who", "spot"])

    rows = rows.withColumn("_p", look("title", "name", "address", "city")).select("ordinal", "source", "city", "lang", "mixed", "day", "minute", "_p.*")
    return rows.withColumn("profile", F.xxhash64("source", "day", "minute", "words", "who", "spot"))


SIDE = ("words", "own", "who", "spot", "minute", "lang")


def _keyed(one: DataFrame) -> DataFrame:
    """``profile, source, key``: the hashed keys under which a profile meets others of its city and day."""
    rows = one.select("profile", "source", "city", "day", "mixed", "minute", "lead", F.split("words", " ").alias("_w"), F.substring_index("who", " ", 1).alias("_own"))
    first, second = (_bare(F.get("_w", F.lit(i))) for i in (0, 1))
    rows = rows.withColumns({"_l0": F.left(first, F.lit(3)), "_r0": F.right(first, F.lit(3)), "_l1": F.left(second, F.lit(3)), "_r1": F.right(second, F.lit(3)), "_two": F.col("lead") > 1})
    none = F.array().cast("array<bigint>")
    key = lambda *c: F.xxhash64("city", "day", *c)
    whole = F.transform(F.slice("_w", F.lit(1), F.col("lead")), lambda w: key(w))
    two = F.array(*[key(F.lit(f"h{i}{j}"), F.col(f"_{i}0"), F.col(f"_{j}1")) for i in "lr" for j in "lr"])
    lone = F.array(key(F.lit("l"), F.col("_l0")), key(F.lit("r"), F.col("_r0")))
    hour = lambda i: F.floor((F.col("minute") + 30 * i) / 60)
    place = F.when(F.col("mixed") & F.col("_own").isNotNull() & F.col("minute").isNotNull(), F.array(*[key(F.lit(f"v{i}"), hour(i), F.col("_own")) for i in (0, 1)])).otherwise(none)
    return rows.select("profile", "source", F.explode(F.concat(whole, F.when(F.col("_two"), two).otherwise(lone), place)).alias("key"))


def _bare(w: Column) -> Column:
    return F.substring(w, SIGNS + 1, 1 << 20)


def _weight(w: Column) -> Column:
    return F.pow(F.ascii(w) - 48, F.lit(POWER))


def _size(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + _weight(w))


def _near(x: Column, y: Column) -> Column:
    """Likeness of two words by edits; 0 where they differ in more than a part of their letters or MOST_EDITS."""
    a, b = _bare(x), _bare(y)
    edits, most = F.levenshtein(a, b, MOST_EDITS), F.greatest(F.length(a), F.length(b))
    return F.when((edits >= 0) & (edits <= FAR_WORDS * most), 1 - edits / most).otherwise(0.0)


def _overlap(a: str, b: str, size_a: str, size_b: str) -> Column:
    """Weight of the lighter list of words that the other has too, as a share; words alike count in part. Null where a list is empty."""
    left, right = F.array_except(a, b), F.array_except(b, a)

    def part(own: Column, other: Column) -> Column:
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + _weight(x) * F.coalesce(F.array_max(F.transform(other, lambda y: _near(x, y))), F.lit(0.0)))

    least, same = F.least(size_a, size_b), _size(F.array_intersect(a, b))
    lighter = F.when(F.col(size_a) <= F.col(size_b), part(left, right)).otherwise(part(right, left))
    some = (F.col(size_a) > 0) & (F.col(size_b) > 0)
    # words that weigh less than half a step of the grid need not be compared letter by letter
    slight = least - same <= least / (2 * GRID)
    return F.when(some & (F.col(a) == F.col(b)), 1.0).when(some & slight, same / least).when(some, (same + lighter) / least)


def _same_spot(a: Column, b: Column) -> Column:
    """1 for one address, 0 for two; null where either is missing or lacks a part that the other has."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    part = lambda s, i: F.nullif(s[i], F.lit(""))
    street = F.when(_near(F.concat(F.lit("00"), part(x, 1)), F.concat(F.lit("00"), part(y, 1))) > 0, 1.0).otherwise(0.0)
    return F.when(x[0] != y[0], 0.0).when(part(x, 2).isNotNull() & part(y, 2).isNotNull(), (x[2] == y[2]).cast("double")).when(part(x, 1).isNotNull() & part(y, 1).isNotNull(), street)


def _rarest(a: str, b: str) -> Column:
    """How rare among all titles the rarest word is that both lists of words have, in classes of an e-fold, counted in
    twos; a word that is only alike counts one less. 0 where they have none."""
    often = lambda w: F.ascii(F.substring(w, 2, 1)) - 48
    step = lambda level: 2 * F.floor(level / STEPS).cast("int")
    same = F.coalesce(step(F.array_max(F.transform(F.array_intersect(a, b), often))), F.lit(0))
    least = lambda x, y: F.when(_near(x, y) > 0, F.least(often(x), often(y)))
    near = F.array_max(F.transform(F.array_except(a, b), lambda x: F.array_max(F.transform(F.array_except(b, a), lambda y: least(x, y)))))
    return F.when((same >= 2 * (TOP // STEPS)) | (F.col(a) == F.col(b)), same).otherwise(F.greatest(same, step(near) - 1))


def vectors(pairs: DataFrame) -> DataFrame:
    """``a, b`` with the similarities of both sides on the grid and the rarity of what their titles share, -1 where unknown."""
    known = lambda c: F.coalesce(F.split(c, " "), F.array().cast("array<string>"))
    # each step is a projection of its own, so that no list is made twice
    bare = lambda ws: F.transform(ws, _bare)
    p = pairs.withColumns({"_a": F.split("a_words", " "), "_b": F.split("b_words", " "), "_v": known("a_who"), "_w": known("b_who")})
    # a title's own house stands behind its other words; only the words of another house need looking for
    p = p.withColumns({f"_{s}": F.slice(f"_{s}", F.lit(1), F.col(f"{s}_own")) for s in "ab"})
    without = lambda own, house: F.filter(own, lambda w: ~F.array_contains(house, _bare(w)))
    for s, other in (("a", "_w"), ("b", "_v")):
        plain = (F.size(other) == 0) | F.col("a_who").eqNullSafe(F.col("b_who"))
        p = p.withColumn(f"_{s}", F.when(plain, F.col(f"_{s}")).otherwise(without(F.col(f"_{s}"), bare(F.col(other)))))
    kind = lambda c: ~F.exists(c, lambda w: F.ascii(w) - 48 >= KIND_LEVEL)
    p = p.withColumns({f"_n{c}": _size(F.col(f"_{c}")) for c in "abvw"})
    p = p.withColumns({"_title": _overlap("_a", "_b", "_na", "_nb"), "_name": _overlap("_v", "_w", "_nv", "_nw"), "_spot": _same_spot(F.col("a_spot"), F.col("b_spot")), "_rare": _rarest("_a", "_b")})
    # kinds of event named in two languages need share no word: nothing is known of such titles
    p = p.withColumn("_title", F.when(kind("_a") & kind("_b") & ~F.col("a_lang").eqNullSafe(F.col("b_lang")) & (F.col("_title") < 0.5), None).otherwise(F.col("_title")))
    told = lambda who, words: (F.size(who) > 0) & F.array_contains(bare(F.split(words, " ")), _bare(F.get(who, F.lit(0))))
    seen = F.when(told("_v", "b_words") | told("_w", "a_words"), 0.95)
    n, s = F.col("_name"), F.col("_spot")
    place = F.when(n.isNotNull() & s.isNotNull(), (F.greatest(n, s) + (n + s) / 2) / 2).otherwise(F.coalesce(n, s, seen))
    gap = F.abs(F.col("a_minute") - F.col("b_minute")) / HALF_MINUTES
    time = 1 / (1 + gap * gap * gap * gap)
    on = lambda c: F.coalesce(F.round(c * GRID).cast("int"), F.lit(-1))
    return p.select("a", "b", on(F.col("_title")).alias("title"), on(place).alias("place"), on(time).alias("time"), F.when(F.col("_title").isNull(), -1).otherwise(F.col("_rare")).alias(RARITY))


def representatives(rows: DataFrame) -> DataFrame:
    """Each profile once, with its columns but not its records; what profiles are compared by."""
    one = rows.drop("ordinal")
    return stored(one.repartition("profile").distinct())


def candidates(rows: DataFrame) -> DataFrame:
    """``a, b, title, place, time``: the distinct pairs of profiles of different sources that share a key."""
    one = representatives(rows)
    keyed = _keyed(one)
    x, y = (keyed.select(F.col("profile").alias(s), F.col("source").alias(f"_{s}"), "key") for s in "ab")
    # hot keys stay bare exchanges below the join, so that adaptive execution can split them
    met = x.join(y, "key").where("a < b and _a <> _b").select("a", "b")
    pairs = met.repartition("a").dropDuplicates(["a", "b"])
    for s in "ab":
        pairs = pairs.join(one.select(F.col("profile").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in SIDE]).hint("shuffle_hash"), s)
    return stored(vectors(pairs))


class Mixture:
    """Gaussians over vectors with missing parts (NaN): one of matched pairs, and one of unmatched pairs for each
    feature, which begins at the corner where only that feature is unlike. Vectors of one class share the weights of the
    Gaussians; those of the unknown class -1 take the weights over all. ``fit`` by expectation-maximisation."""

    def __init__(self, x: np.ndarray, n: np.ndarray, classes: np.ndarray | None = None, floor: float = 2e-3, pull: float = 0.15) -> None:
        self.x, self.n, self.floor, self.pull = x, n, floor, pull
        self.classes = np.full(len(x), -1) if classes is None else classes
        self.kinds: dict[tuple, list[int]] = {}
        for i, known in enumerate(~np.isnan(x)):
            self.kinds.setdefault(tuple(known), []).append(i)
        d = x.shape[1]
        self.corners = np.vstack([np.ones(d), 1 - np.eye(d)])
        self.parts = [(np.ones(self.classes.max(initial=-1) + 2), c, 0.1 * np.eye(d)) for c in self.corners]

    def _look(self, part: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log density of what is known, expected vectors and their covariances."""
        _, mean, cov = part
        d = len(mean)
        full, extra, dens = self.x.copy(), np.zeros((len(self.x), d, d)), np.zeros(len(self.x))
        for known, rows in self.kinds.items():
            o, m = np.array(known), ~np.array(known)
            if not o.any():
                full[rows], extra[rows] = mean, cov
                continue
            inv = np.linalg.inv(cov[np.ix_(o, o)])
            off = self.x[np.ix_(rows, np.where(o)[0])] - mean[o]
            dens[rows] = -0.5 * (np.einsum("ij,jk,ik->i", off, inv, off) + np.linalg.slogdet(cov[np.ix_(o, o)])[1] + o.sum() * math.log(2 * math.pi))
            if m.any():
                way = cov[np.ix_(m, o)] @ inv
                full[np.ix_(rows, np.where(m)[0])] = mean[m] + off @ way.T
                extra[np.ix_(rows, np.where(m)[0], np.where(m)[0])] = cov[np.ix_(m, m)] - way @ cov[np.ix_(o, m)]
        return dens, full, extra

    def _expect(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of a match, and the shares of the unmatched Gaussians among themselves."""
        dens = np.array([np.log(p[0][self.classes]) + self._look(p)[0] for p in self.parts])
        top = dens[1:].max(0)
        other = np.exp(dens[1:] - top)
        return np.clip(dens[0] - top - np.log(other.sum(0)), -15, 15), other / other.sum(0)

    def _maximise(self, g: np.ndarray, shares: np.ndarray) -> None:
        size = len(self.parts[0][0])
        at = self.classes % size
        weights = [self.n * r for r in (g, *((1 - g) * shares))]
        # the unmatched of a class shape the Gaussians by no more weight than its matched, however many they are
        same, other = (np.bincount(at, self.n * r, size) + 1 for r in (g, 1 - g))
        least = np.minimum(1, same / other)[at]
        # so many pairs at each corner are taken as known
        known = max(1.0, KNOWN * weights[0].sum())
        got = []
        for w, part, corner in zip([weights[0], *(w * least for w in weights[1:])], self.parts, self.corners):
            _, full, extra = self._look(part)
            mean = ((w[:, None] * full).sum(0) + known * corner) / (w.sum() + known)
            off = full - mean
            cov = ((w[:, None, None] * (np.einsum("ij,ik->ijk", off, off) + extra)).sum(0) + known * np.outer(corner - mean, corner - mean)) / (w.sum() + known)
            got.append((mean, cov))
        # one regulariser for all, so that no Gaussian is the narrower for having nothing to tell apart in a feature
        far = np.mean([(got[0][0] - mean) ** 2 for mean, _ in got[1:]], axis=0)
        total = np.array([w.sum() + 1 for w in weights])
        self.parts = []
        for w, t, (mean, cov) in zip(weights, total, got):
            # in each class one pair is taken to be as pairs are over all; the last weight is that over all
            own = np.bincount(at, w, size) + t / total.sum()
            own[-1] = t
            self.parts.append((own, mean, cov + np.diag(self.pull * far + self.floor)))

    def fit(self, settle=None, rounds: int = 1000, tolerance: float = 1e-4) -> np.ndarray:  # noqa: ANN001
        """Log-odds by vector. ``settle`` turns log-odds into the mean posterior of each vector's pairs (transitivity)."""
        before, moved = np.full(len(self.x), np.inf), math.inf
        for _ in range(rounds):
            odds, shares = self._expect()
            g = 1 / (1 + np.exp(-odds)) if settle is None else settle(odds)
            # as a share of the matched pairs, however many others there are
            moved = float((np.abs(g - before) * self.n).sum() / max((g * self.n).sum(), 1.0))
            if moved < tolerance:
                return odds
            before = g
            self._maximise(g, shares)
        warnings.warn(f"the mixture still moves by {moved:.2g} after {rounds} rounds", stacklevel=2)
        return self._expect()[0]


def _project(o3, o1, o2, xp):  # noqa: ANN001, ANN202
    """Posteriors of a triangle's third edge and its sides after projection onto ``g1 * g2 <= g3``.

    ``xp`` gives exp, least, greatest and where, so that the driver's arrays and Spark's columns go one way.
    """
    g3, g1, g2 = (1 / (1 + xp.exp(-o)) for o in (o3, o1, o2))
    torn = g1 * g2 > g3
    rise = torn & (o1 + o2 + o3 > 0)
    fall = torn & ~(o1 + o2 + o3 > 0)
    low = g3 / xp.greatest(g1, g2)
    return xp.where(rise, g1 * g2, g3), xp.where(fall & (o1 <= o2), low, g1), xp.where(fall & ~(o1 <= o2), low, g2)


class _Arrays:
    exp, greatest, where = staticmethod(np.exp), staticmethod(np.maximum), staticmethod(np.where)


class _Columns:
    exp, greatest = staticmethod(F.exp), staticmethod(F.greatest)
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


def triangles(cells: DataFrame) -> DataFrame:
    """``a, b, m, c3, c1, c2`` from pairs ``a, b, cell, g``: doubtful third edges with two live sides. Sides that join
    the same two profiles as the third edge do not exist, as pairs are distinct."""
    live = cells.where(F.col("g") >= LIVE)
    edges = live.select(F.col("a").alias("x"), F.col("b").alias("m"), "cell", "g").union(live.select("b", "a", "cell", "g"))
    third = cells.where(F.col("g") <= SURE).select("a", "b", F.col("cell").alias("c3"), F.col("g").alias("g3"))
    one = edges.select(F.col("x").alias("a"), "m", F.col("cell").alias("c1"), F.col("g").alias("g1"))
    two = edges.select(F.col("x").alias("b"), "m", F.col("cell").alias("c2"), F.col("g").alias("g2"))
    return third.join(one, "a").where("m <> b").join(two, ["b", "m"]).where("g3 <= g1 and g3 <= g2").select("a", "b", "m", "c3", "c1", "c2")


def _edges(tri: DataFrame) -> DataFrame:
    """``a, b, role, c3, c1, c2``: the three edges of each triangle."""
    side = lambda s, role: tri.select(F.least(s, "m").alias("a"), F.greatest(s, "m").alias("b"), F.lit(role).alias("role"), "c3", "c1", "c2")
    return tri.select("a", "b", F.lit(0).alias("role"), "c3", "c1", "c2").union(side("a", 1)).union(side("b", 2))


def scored(pairs: DataFrame) -> DataFrame:
    """``a, b, posterior`` of each candidate pair after the mixture has settled under transitivity."""
    spark = pairs.sparkSession
    code = F.lit(0)
    for f in (*FEATURES, RARITY):
        code = code * (GRID + 2) + F.col(f) + 1
    pairs = pairs.select("a", "b", *FEATURES, RARITY, code.alias("cell"))
    counts = pairs.groupBy("cell", *FEATURES, RARITY).agg(F.count("*").alias("n")).orderBy("cell").collect()  # at most (GRID + 2) ** 4 rows
    if not counts:
        return pairs.select("a", "b", F.lit(0.0).alias("posterior"))
    at = {r.cell: i for i, r in enumerate(counts)}
    x = np.array([[np.nan if r[f] < 0 else r[f] / GRID for f in FEATURES] for r in counts])
    n = np.array([r.n for r in counts], dtype=float)
    mix = Mixture(x, n, np.array([r[RARITY] for r in counts], dtype=int))
    odds = mix.fit()
    table = lambda o: F.broadcast(spark.createDataFrame([(int(c), float(o[i])) for c, i in at.items()], "cell int, odds double"))
    known = pairs.select("a", "b", "cell").join(table(odds), "cell")
    tri = stored(triangles(known.withColumn("g", 1 / (1 + F.exp(-F.col("odds"))))))
    # each edge of triangles shares its weight among them
    edges = _edges(tri).repartition("a", "b").groupBy("a", "b", "role", "c3", "c1", "c2").agg(F.count("*").alias("n"))
    edges = stored(edges.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("a", "b"))).drop("n"))
    kinds = edges.groupBy("role", "c3", "c1", "c2").agg(F.sum("w").alias("w")).orderBy("role", "c3", "c1", "c2").collect()  # kinds of triangles, by grid points
    role, w = np.array([r.role for r in kinds], dtype=int), np.array([r.w for r in kinds], dtype=float)
    c3, c1, c2 = (np.array([at[r[c]] for r in kinds], dtype=int) for c in ("c3", "c1", "c2"))
    own = np.choose(role, [c3, c1, c2]) if len(role) else role
    held = np.bincount(own, w, len(n))

    def settle(odds: np.ndarray) -> np.ndarray:
        free = 1 / (1 + np.exp(-odds))
        got = np.choose(role, _project(odds[c3], odds[c1], odds[c2], _Arrays)) if len(role) else w
        return ((n - held) * free + np.bincount(own, w * got, len(n))) / n

    odds = mix.fit(settle)
    for c in ("c3", "c1", "c2"):
        edges = edges.join(table(odds).withColumnsRenamed({"cell": c, "odds": f"_{c}"}), c)
    of = _project(F.col("_c3"), F.col("_c1"), F.col("_c2"), _Columns)
    edges = edges.withColumn("v", F.when(F.col("role") == 0, of[0]).when(F.col("role") == 1, of[1]).otherwise(of[2]))
    settled = edges.groupBy("a", "b").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    rows = pairs.select("a", "b", "cell").join(table(odds), "cell").join(settled.hint("shuffle_hash"), ["a", "b"], "left")
    return rows.select("a", "b", F.coalesce("v", 1 / (1 + F.exp(-F.col("odds")))).alias("posterior"))


def matched_profiles(records: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``a, b, confidence`` of matched profiles, ``ordinal, profile`` of every record with a title and a day)."""
    rows = stored(profiles(records, registry))
    good = scored(candidates(rows)).where("posterior > 0.5")
    return good.select("a", "b", F.round("posterior", 6).alias("confidence")), rows.select("ordinal", "profile")


def matched(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``ordinal_a, ordinal_b, confidence``: the matched records of different sources, the smaller ordinal first."""
    good, of = matched_profiles(records, registry)
    a, b = of.select(F.col("ordinal").alias("oa"), F.col("profile").alias("a")), of.select(F.col("ordinal").alias("ob"), F.col("profile").alias("b"))
    pairs = good.join(a, "a").join(b, "b")
    return pairs.select(F.least("oa", "ob").alias("ordinal_a"), F.greatest("oa", "ob").alias("ordinal_b"), "confidence")


def classes(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``ordinal, class, n_links``: each record with the least ordinal of its profile and the number of its profile's
    matches in other profiles; copies of a record share a class."""
    good, of = matched_profiles(records, registry)
    least = of.groupBy("profile").agg(F.min("ordinal").alias("class"))
    links = good.select(F.col("a").alias("profile")).union(good.select("b")).groupBy("profile").agg(F.count("*").alias("n_links"))
    rows = of.join(least, "profile").join(links, "profile", "left")
    return rows.select("ordinal", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
