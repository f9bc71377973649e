"""Mixing sources to target weights.

Each source of the targets shall contribute its share of all tokens. The mixture is as large as the shares can be met
exactly: the least over the sources of (tokens times allowed repeats / share); sources without documents give their
share to the others in proportion. (A larger total may be asked for; then sources at their cap stay there and the
rest is shared out again.) The total is cut into equal blocks of tokens, which Sainte-Laguë's highest quotients hand
out to the sources, and the blocks of a source's last, partial pass to its shards, in whole numbers; within a shard
documents are taken in a seeded order until the next would pass the shard's blocks, then the one that comes nearest
to what is lacking. So a document is used ``floor`` or
``floor + 1`` times of what its source needs, never more often than allowed.

Shards are hashes of the document id, so none holds a hot source; their number grows with a source's tokens up to a
bound, and only a row for each shard comes to the driver.

Defined results: documents without tokens (null, empty) and sources without a target are not in the mixture; repeated
ids count as documents of their own; targets of zero or null get nothing; without any document the mixture is empty.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiosko.llm import tokens
from kiosko.session import stored

BLOCKS = 20_000
SHARD_TOKENS = 2_000_000
MOST_SHARDS = 1024
SEED = 17


def sainte_lague(weights: dict, blocks: int, caps: dict | None = None) -> dict:
    """Whole blocks for each key by highest quotients weight / (2 n + 1); a key at its cap gets no more. Ties go to the lesser key."""
    got = {k: 0 for k in weights}
    heap = [(-w, k) for k, w in weights.items() if w > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        while heap:
            _, k = heapq.heappop(heap)
            if caps is None or got[k] < caps.get(k, blocks):
                break
        else:
            break
        got[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def total_for(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """The greatest total at which every source with documents meets its share within its repeats."""
    whole = sum(shares[s] for s in sizes)
    return min((sizes[s] * caps[s] * whole / shares[s] for s in sizes), default=0.0)


def sized(documents: DataFrame, targets: DataFrame, file: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents with tokens of the target sources."""
    wanted = targets.where("target_share > 0 and max_repeats > 0").select("source")
    return tokens.with_ids(documents.join(F.broadcast(wanted), "source", "left_semi").select("doc_id", "source", "text"), "text", "n_tokens", file, ["doc_id", "source"], count=True).where("n_tokens > 0")


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, most_shards: int = MOST_SHARDS) -> tuple[DataFrame, list[tuple]]:
    """(``source, shard, passes, extra``, [(source, tokens, quota)]): the whole passes over each shard and the tokens to take beyond them."""
    spark = docs.sparkSession
    goal = {r.source: r for r in targets.where("target_share > 0 and max_repeats > 0").collect()}  # a row for each source
    sizes = {r.source: int(r.n) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = {s: float(goal[s].target_share) for s in sizes}
    caps = {s: int(goal[s].max_repeats) for s in sizes}
    size = total or total_for(sizes, shares, caps)
    block = max(size / blocks, 1e-9)
    most = {s: math.floor(caps[s] * sizes[s] / block + 1e-6) for s in sizes}
    quota = sainte_lague(shares, blocks if sizes else 0, most)
    shards = {s: max(1, min(most_shards, math.ceil(n / shard_tokens))) for s, n in sizes.items()}
    count = spark.createDataFrame([(s, n) for s, n in shards.items()] or [], "source string, shards int")
    parts = docs.join(F.broadcast(count), "source").groupBy("source", shard().alias("shard")).agg(F.sum("n_tokens").alias("n"))
    held: dict[str, dict[int, int]] = {}
    for r in parts.collect():  # at most most_shards rows for each source
        held.setdefault(r.source, {})[r.shard] = int(r.n)
    rows, report = [], []
    for s, n in sizes.items():
        want = quota[s] * block
        passes = min(caps[s], int(want // n + 1e-9))
        rest = max(0.0, want - passes * n) if passes < caps[s] else 0.0
        small = max(block, 1.0) / 8
        got = sainte_lague({k: float(v) for k, v in held[s].items()}, round(rest / small), {k: math.floor(v / small) + 1 for k, v in held[s].items()})
        rows += [(s, k, shards[s], passes, got[k] * small) for k in held[s]]
        report.append((s, n, want))
    return spark.createDataFrame(rows, "source string, shard int, shards int, passes int, extra double"), report


def shard() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("shards")).cast("int")


def mixture(documents: DataFrame, targets: DataFrame, total: float | str | None = None, file: str | None = None, **sizes: int) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: the documents of the mixture and how often each is used.

    ``total`` in tokens; "all" asks for as many as the sources hold together, so that scarce sources meet their cap.
    ``sizes`` are the parameters of ``plan``.
    """
    docs = stored(sized(documents, targets, file))
    if total == "all":
        total = float(docs.agg(F.sum("n_tokens")).first()[0] or 0.0)
    plans, _ = plan(docs, targets, total, **sizes)
    count = plans.select("source", "shards").distinct()
    rows = docs.join(F.broadcast(count), "source").withColumn("shard", shard()).drop("shards")
    rows = rows.join(F.broadcast(plans.drop("shards")), ["source", "shard"])
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("n_tokens").over(order)
    rows = rows.withColumn("more", (upto <= F.col("extra")).cast("int"))
    # what a shard still lacks goes to the one document left over that comes nearest to it
    lack = rows.groupBy("source", "shard").agg((F.max("extra") - F.sum(F.col("n_tokens") * F.col("more"))).alias("lack")).where("lack > 0")
    left = rows.where("more = 0").join(lack, ["source", "shard"]).where("n_tokens < 2 * lack")
    last = left.groupBy("source", "shard").agg(F.min_by("doc_id", F.struct(F.abs(F.col("n_tokens") - F.col("lack")), "doc_id")).alias("_last"))
    rows = rows.join(F.broadcast(last), ["source", "shard"], "left")
    more = F.when((F.col("more") == 1) | F.coalesce(F.col("doc_id") == F.col("_last"), F.lit(False)), 1).otherwise(0)
    return rows.withColumn("copies", F.col("passes") + more).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame, total: float | str | None = None, file: str | None = None) -> DataFrame:
    """A row for each target source: its documents, tokens, repeats and the share it reached of the mixture."""
    mixed = mixture(documents, targets, total, file)
    by = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = Window.partitionBy()
    rows = targets.join(by, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    return rows.select("source", "target_share", "max_repeats", "n_docs", "tokens", "most_copies", F.round(F.try_divide("tokens", F.sum("tokens").over(whole)), 6).alias("actual_share"))
