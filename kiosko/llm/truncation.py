"""Text cut off by field limits or mid-transfer.

A character n-gram model looks backward from the end of a value: for its last characters (several lengths, longest
known context first) it compares how often the corpus ends a sentence or text there with how often it goes on. The
log-odds of going on, together with how far the value's length stands out among the lengths of its source and column
(fields cut at a limit pile up there), decides against a threshold for each language and column.

What was hung on after the cut (dots, ``[...]``, a "read more", a broken tag or entity, half a character) is taken
off first. Values that end in a full stop, question or exclamation mark before that are whole.

Counts cover every position of all values. Contexts are 64-bit hashes, rolled over the characters of a whole batch at
once; a set of bits, sized by the number of contexts that values end in, lets tasks pass over those nobody asks for, and
each task counts its own part first. Contexts of the values in question are then looked up in one join.

Defined results: null, empty and blank values are never cut; events without a source count under the null source;
very long values are read whole; repeated rows give the same verdict; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiosko.session import stored

LENGTHS = (3, 5, 8, 12, 17)
#: What sources hang on a text that they cut.
HUNG_ON = (
    r"(?:\s*(?:\[(?:\.{2,}|…)\]|\((?:\.{3}|…)\)|\.{3,}|…|(?i:lees (?:verder|meer)|read (?:more|on)|continue reading|leer más|seguir leyendo|lire la suite|weiterlesen|mehr lesen|meer lezen)\s*[»›>→]?))+$"
)
#: A tag, an entity or a character that ends in its middle: proof of a cut.
BROKEN = r"(?:<[a-z/][a-z0-9]{0,9}|<|&#\d{0,5}|&#x[0-9a-f]{0,5}|&[a-z]{2,7}|�)$"
WHOLE = r"[.!?][)\]\"”’'»]*$|[!?]$"
#: What parts the sections of a title: a title may end before it.
_part = re.compile(r"(?=[,:(|]| [-–—|(+@&]| (?:met|with|con|avec|mit|and|en|y|et|und) )")
#: A tag line after the last sentence, which is no sentence itself.
TAIL = r"(?:^|[.!?…)\]]\s+)[^\p{L}\s¿¡][^.!?]*$"
_hung, _broken = re.compile(HUNG_ON), re.compile(BROKEN)
#: Weights of a length that stands out, of something hung on and of a tag line, and odds against a cut before any evidence.
SPIKE_WEIGHT, HUNG_WEIGHT, TAIL_WEIGHT, PRIOR = 1.0, 1.5, 6.0, -2.2
FEW = 4
#: Bits of the set of asked contexts for each of them, and the most in all (32 MB): past that it lets more contexts
#: through, and counts stay whole.
BITS_EACH, MOST_BITS = 16, 1 << 28
FLUSH = 2_000_000
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def core(text: str) -> str:
    return _broken.sub("", _hung.sub("", text.rstrip())).rstrip()


def normal(text: str) -> str:
    return re.sub(r"\d", "0", text.lower())


def _core(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.rtrim(c), HUNG_ON, ""), BROKEN, ""))


def values(events: DataFrame, registry: DataFrame) -> DataFrame:
    """``event_id, field, source, lang, text`` of every title and description that holds something."""
    lang = registry.select(F.col("id").alias("_id"), F.col("locale").alias("lang"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "description")])
    rows = events.select(F.col("id").alias("event_id"), F.get("source_ids", F.lit(0)).alias("source"), F.explode(pairs).alias("v")).select("event_id", "source", "v.*")
    rows = rows.where(F.trim("text") != "")
    return rows.join(F.broadcast(lang), rows["source"] == lang["_id"], "left").drop("_id")


def asked_bits(asked: DataFrame) -> bytes:
    """A set of bits in which the hashes of the asked contexts are set, as many as BITS_EACH for each, at most MOST_BITS."""
    size = 1 << 16
    while size < min(MOST_BITS, BITS_EACH * asked.count()):
        size *= 2
    at = F.pmod(F.col("context"), F.lit(size)) + 1
    parts = asked.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray(size // 8)
    for r in parts.collect():  # at most MOST_BITS / 32768 rows
        out[(r.n - 1) * 4096 : r.n * 4096] = r.bits
    return bytes(out)


def _laid_out(fields: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each begun by ``^`` and ended by a zero; the place of each in its text, from 1; and
    the first letter of its field."""
    codes = np.frombuffer("".join(f"^{t}\0" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes) + 1, np.repeat(np.array([ord(f[0]) for f in fields], dtype=np.uint64), sizes)


def _rolled(codes: np.ndarray, field: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of LENGTHS the hashes of the field and that many characters up to each position."""
    c = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    h, power = c.copy(), np.uint64(1)
    for k in range(1, max(LENGTHS) + 1):
        if k > 1:
            power = power * STEP
            h[k - 1 :] += c[: 1 - k] * power
        if k in LENGTHS:
            x = (h + field * np.uint64(2 * k + 1)) * MIX
            x = (x ^ (x >> np.uint64(31))) * STEP
            yield k, (x ^ (x >> np.uint64(29))).view(np.int64)


def tails(rows: DataFrame) -> DataFrame:
    """``key, k, context`` of the ends of values ``key, field, core``, by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with np.errstate(over="ignore"):
                texts = [normal(t) for t in b["core"]]
                codes, place, field = _laid_out(list(b["field"]), texts)
                last = np.cumsum([len(t) + 2 for t in texts]) - 2
                for k, h in _rolled(codes, field):
                    long = place[last] >= k
                    yield pd.DataFrame({"key": b["key"].to_numpy()[long], "k": k, "context": h[last[long]]})

    return rows.select("key", "field", "core").mapInPandas(run, "key long, k int, context long")


def contexts(rows: DataFrame, bits: bytes) -> DataFrame:
    """``context, ends, goes_on`` over all values, for the contexts whose bit is set."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_set = np.frombuffer(held.value, dtype=np.uint8)
        mask = np.int64(len(is_set) * 8 - 1)
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            if not seen:
                return pd.DataFrame({"context": [], "ends": [], "goes_on": []}).astype("int64")
            all_, ends = (np.concatenate(x) for x in zip(*seen))
            seen.clear()
            keys, at = np.unique(all_, return_inverse=True)
            total, stop = np.bincount(at, minlength=len(keys)), np.bincount(at, ends, len(keys)).astype(np.int64)
            return pd.DataFrame({"context": keys, "ends": stop, "goes_on": total - stop})

        for b in batches:
            with np.errstate(over="ignore"):
                fields, texts = list(b["field"]), [normal(core(t)) for t in b["text"]]
                codes, place, field = _laid_out(fields, texts)
                within = ~np.isin(codes, [ord(x) for x in " .!?\n\0"]) & (place > 1)
                end = np.isin(np.append(codes[1:], 0), [ord(x) for x in ".!?\n\0"])
                start = 0
                for f, t in zip(fields, texts):
                    if f == "title":
                        end[[start + m.start() for m in _part.finditer(t)]] = True
                    start += len(t) + 2
                for k, h in _rolled(codes, field):
                    at = h & mask
                    asked = within & (place >= k) & ((is_set[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                    seen.append((h[asked], end[asked]))
            if sum(len(x) for x, _ in seen) > FLUSH:
                yield flush()
        yield flush()

    part = rows.select("field", "text").mapInPandas(count, "context long, ends long, goes_on long")
    return part.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def length_odds(rows: DataFrame) -> DataFrame:
    """``source, field, size, spike``: log of how often a source's field has this length against lengths near it."""
    sizes = rows.groupBy("source", "field", F.length(F.rtrim("text")).alias("size")).agg(F.count("*").alias("n"))
    near = sizes.select("source", "field", F.explode(F.sequence(F.col("size") - 16, F.col("size") + 16)).alias("to"), F.col("n"), F.col("size").alias("of")).withColumnRenamed("to", "size")
    near = near.where(F.abs(F.col("size") - F.col("of")) > 1).groupBy("source", "field", "size").agg((F.sum("n") / 30.0).alias("usual"))
    both = sizes.join(near.withColumnsRenamed({"source": "_s", "field": "_f", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")) & (F.col("size") == F.col("_z")), "left")
    rate = (F.col("n") + 0.5) / (F.coalesce("usual", F.lit(0.0)) + 0.7)
    return both.select("source", "field", "size", F.least(F.greatest(F.log(rate), F.lit(0.0)), F.lit(5.0)).alias("spike"))


def judged(events: DataFrame, registry: DataFrame) -> DataFrame:
    """``event_id, field, source, lang, score, cut`` of every value: the log-odds that it was cut, and the verdict."""
    rows = values(events, registry)
    text = rows.withColumn("core", _core(F.col("text"))).withColumn("key", F.xxhash64("event_id", "field", "text"))
    text = text.withColumn("hung", F.length("core") < F.length(F.rtrim("text")))
    plain = F.regexp_replace(F.rtrim("text"), HUNG_ON, "")
    text = text.withColumn("broken", F.rtrim(plain).rlike(BROKEN)).withColumn("whole", F.col("core").rlike(WHOLE) & ~F.col("broken") | (F.col("core") == ""))
    size = length_odds(rows).withColumnsRenamed({"source": "_s", "field": "_f"})
    text = text.withColumn("_z", F.length(F.rtrim("text"))).join(size, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")) & (F.col("_z") == F.col("size")), "left")
    asked = stored(tails(text.where(~F.col("whole"))))
    got = asked.join(contexts(rows, asked_bits(asked)), "context")
    # the value's own end is left out of the count
    known = got.select("key", "k", (F.col("ends") - 1).alias("e"), F.col("goes_on").alias("g")).where(F.col("e") + F.col("g") >= F.when(F.col("k") > 8, 2).when(F.col("k") == 8, 10).when(F.col("k") == 5, 25).otherwise(FEW))
    smooth = F.when(F.col("k") > 8, 0.3).otherwise(1.0)  # short contexts tell less
    best = known.groupBy("key").agg(F.max_by(F.log((F.col("g") + smooth) / (F.col("e") + smooth)), F.col("k")).alias("ngram"), F.max("k").alias("k"))
    text = text.join(best, "key", "left")
    # names end anywhere: in a title only a long context tells much
    ngram = F.when((F.col("field") == "title") & (F.col("k") <= 8), F.least("ngram", F.lit(2.0))).otherwise(F.coalesce("ngram", F.lit(0.0)))
    score = (
        ngram + SPIKE_WEIGHT * F.coalesce("spike", F.lit(0.0)) + F.when(F.col("hung"), HUNG_WEIGHT).otherwise(0.0) + F.when(F.col("field") == "title", PRIOR - 1.0).otherwise(PRIOR)
        - F.when(F.col("core").rlike(TAIL) & ~F.col("hung") & (F.coalesce("spike", F.lit(0.0)) < 2), TAIL_WEIGHT).otherwise(0.0)
    )
    text = text.withColumn("score", F.when(F.col("broken"), 9.0).when(F.col("whole"), -9.0).otherwise(score))
    limit = thresholds(text).withColumnsRenamed({"lang": "_l", "field": "_f2"})
    text = text.join(F.broadcast(limit), F.col("lang").eqNullSafe(F.col("_l")) & (F.col("field") == F.col("_f2")), "left")
    return text.select("event_id", "field", "source", "lang", "text", "score", "ngram", "spike", (F.col("score") > F.coalesce("limit", F.lit(0.0))).alias("cut"))


def thresholds(scored: DataFrame) -> DataFrame:
    """``lang, field, limit``: a row for each language and column, from the share of values that look cut.

    Where few values look cut the threshold rises, where many do it falls, by at most one.
    """
    share = scored.groupBy("lang", "field").agg(F.avg((F.col("score") > 0).cast("double")).alias("p"))
    return share.select("lang", "field", F.greatest(F.least(-0.3 * F.log((F.col("p") + 0.01) / (1.01 - F.col("p"))) - F.when(F.col("field") == "title", 0.0).otherwise(0.4), F.lit(1.0)), F.lit(-1.0)).alias("limit"))
