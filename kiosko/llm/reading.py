"""Reading level of each document.

From graded texts each word gets an acquisition grade: the mean grade of its occurrences, where each grade counts by
the word's rate among the words of that grade. A document's level is predicted from quantiles of the grades of its
known words; the weights of the quantiles are calibrated on graded documents whose words were graded without them
(two halves, each graded by the other).

The graded sample is bounded (``most_labels``, documents of least hash first); word counts are aggregated before they
come to the driver, and words seen in fewer than ``least_docs`` graded documents are left out, so the word list is
bounded by the sample. It travels to the workers once for each task.

Defined results: null, empty and blank texts have no level; a text without a known word gets the mean grade of the
sample; several grades of a document are averaged; labels without a document are passed over; without labels no
document has a level; repeated ids are levelled row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiosko.session import stored

QUANTILES = (0.05, 0.15, 0.25, 0.35, 0.5, 0.65, 0.75, 0.85, 0.95)
MOST_LABELS = 20_000
LEAST_DOCS = 3
HARD = 3.5
_word = re.compile(r"[^\W\d_]{2,}")


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def graded(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """``doc_id, text, grade, half`` of the graded documents, at most ``most_labels`` of them."""
    mean = labels.where("grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    sample = mean.orderBy(F.xxhash64("doc_id", F.lit(3))).limit(most_labels)
    rows = documents.select("doc_id", "text").where(F.trim("text") != "").join(F.broadcast(sample), "doc_id")
    return rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        tally: dict[tuple[int, str], np.ndarray] = {}
        for text, grade, half in zip(b["text"], b["grade"], b["half"]):
            k = min(4, max(0, round(grade) - 1))
            found = words(text)
            for w in found:
                tally.setdefault((half, w), np.zeros(6, dtype=np.int64))[k] += 1
            for w in set(found):
                tally[half, w][5] += 1
        yield pd.DataFrame([(h, w, *map(int, v)) for (h, w), v in tally.items()], columns=["half", "word", "g1", "g2", "g3", "g4", "g5", "docs"])


def _grades(counts: pd.DataFrame, totals: np.ndarray, least_docs: int) -> dict[str, float]:
    base = totals / max(1.0, totals.sum())
    known = counts[counts["docs"] >= least_docs]
    rate = (known[["g1", "g2", "g3", "g4", "g5"]].to_numpy(float) + 0.5 * base) / (totals + 1)
    rate /= rate.sum(1, keepdims=True)
    return dict(zip(known["word"], rate @ np.arange(1, 6)))


def features(text: str, grades: dict[str, float]) -> np.ndarray | None:
    x = np.fromiter((grades[w] for w in words(text) if w in grades), dtype=float)
    if not len(x):
        return None
    return np.array([1.0, x.mean(), *np.quantile(x, QUANTILES), (x > 3.6).mean(), (x < 2.4).mean()])


def train(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, least_docs: int = LEAST_DOCS) -> tuple[dict[str, float], np.ndarray, float] | None:
    """(grades of words, weights of quantiles, mean grade); None without graded documents."""
    rows = stored(graded(documents, labels, most_labels))
    counted = rows.select("text", "grade", "half").mapInPandas(_count, "half int, word string, g1 long, g2 long, g3 long, g4 long, g5 long, docs long")
    sums = [F.sum(c).alias(c) for c in ("g1", "g2", "g3", "g4", "g5", "docs")]
    by_half = stored(counted.groupBy("half", "word").agg(*sums))
    totals = {r.half: np.array([r.g1, r.g2, r.g3, r.g4, r.g5], float) for r in by_half.groupBy("half").agg(*sums).collect()}
    if not totals:
        return None
    # words of the bounded sample only
    kept = by_half.withColumn("_all", F.sum("docs").over(_by_word())).where(F.col("_all") >= least_docs).drop("_all").toPandas()
    half = {h: _grades(kept[kept["half"] == h], totals.get(h, np.zeros(5)), max(1, least_docs - 1)) for h in (0, 1)}
    both = kept.groupby("word", as_index=False)[["g1", "g2", "g3", "g4", "g5", "docs"]].sum()
    grades = _grades(both, sum(totals.values()), least_docs)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(features(t, half[1 - h]), g) for t, g, h in zip(b["text"], b["grade"], b["half"])]
            yield pd.DataFrame([(f.tolist(), g) for f, g in got if f is not None], columns=["x", "grade"])

    seen = rows.select("text", "grade", "half").mapInPandas(look, "x array<double>, grade double").collect()  # a row for each graded document of the sample
    mean = float(rows.agg(F.avg("grade")).first()[0])
    if not seen:
        return grades, np.array([mean, *[0.0] * (len(QUANTILES) + 3)]), mean
    x, y = np.array([r.x for r in seen]), np.array([r.grade for r in seen])
    return grades, np.linalg.solve(x.T @ x + 0.1 * np.eye(x.shape[1]), x.T @ y), mean


def _by_word():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("word")


def levels(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, level`` of every document with text, on the scale of the labels (1 easiest to 5 hardest)."""
    rows = documents.select("doc_id", "text").where(F.regexp_like("text", F.lit(r"\S")))
    model = train(documents, labels, most_labels, least_docs)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("level")).where(F.lit(False))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grades, weights, mean = held.value
        for b in batches:
            got = [features(t, grades) for t in b["text"]]
            b["level"] = [round(float(np.clip(f @ weights, 1.0, 5.0)), 4) if f is not None else round(mean, 4) for f in got]
            yield b[["doc_id", "level"]]

    return rows.mapInPandas(run, "doc_id long, level double")
