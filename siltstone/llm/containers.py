"""Problem 6: fill containers of fixed capacity with texts sized in tokens.

What is planned is the histogram of lengths, never the items: it has at most
``capacity`` rows, however many items there are. A pattern of lengths that fill
a container is found by exact complements: the largest items first, and as soon
as one, two or three lengths can make up the gap, they are looked up in an
index of single, pair and triple sums under the availability counts. A pattern
is consumed as often as its scarcest length allows, so each one exhausts a
length and the plan has no more patterns than lengths. What no exact complement
fits is placed best-fit. Items are then numbered within their length, in hashed
sub-groups whose number follows from the count of items, so that no length is
sorted in one task; each sub-group gets its own part of the plan, joined on the
keys it is partitioned by already.

Tokens are those of a public byte-level BPE of 50,256 ranks (``VOCABULARY``, as
GPT-2 has it, with its splitting pattern).
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_batches, ship_file, shipped
from siltstone.session import checkpoint

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP_ROWS = 500_000  # items that are numbered in one task


@cache
def _encoding(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(shipped(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(vocabulary: str, pattern: str):
    enc = _encoding(vocabulary, pattern)

    def batch(cols: dict[str, list]):
        for i, t in zip(cols["doc_id"], cols["text"]):
            yield i, len(enc.encode_ordinary(t)) if t else 0

    return batch


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` in tokens of a public byte-level BPE; null and empty texts have none."""
    ship_file(documents.sparkSession, vocabulary)
    return map_batches(documents.select("doc_id", "text"), partial(_counter, vocabulary, pattern), "doc_id long, n_tokens long")


class SumIndex:
    """Single, pair and triple sums of the lengths there are, by sum.

    An entry is found when its sum is first asked for, holds as long as its
    lengths last, and is then looked for again among smaller ones: lengths only
    get scarcer, so a sum that nothing makes is never looked for twice.
    """

    def __init__(self, avail: np.ndarray):
        self.avail = avail
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def lasts(self, lengths: tuple[int, ...]) -> bool:
        return all(self.avail[x] >= lengths.count(x) for x in lengths)

    def find(self, total: int, top: int) -> tuple[int, ...] | None:
        """One, two or three lengths of the sum ``total``, the largest first; ``top`` is the largest length there is."""
        if total <= top and self.avail[total]:
            return (total,)
        return self.pair(total, top) or self.triple(total, top)

    def pair(self, total: int, top: int) -> tuple[int, int] | None:
        known = self.pairs.get(total, ())
        if known is None or known and self.lasts(known):
            return known
        self.pairs[total] = p = next(self._pairs(total, top), None)
        return p

    def _pairs(self, total: int, top: int):
        lo, hi = max(1, total - top), min(top, total - 1)
        half = (total + 1) // 2  # the larger of the two, from large to small
        if lo > hi or half > hi:
            return
        both = (self.avail[half : hi + 1] > 0) & (self.avail[total - hi : total - half + 1][::-1] > 0)
        for k in np.flatnonzero(both)[::-1]:
            x = half + int(k)
            if x != total - x or self.avail[x] > 1:
                yield x, total - x

    def triple(self, total: int, top: int) -> tuple[int, int, int] | None:
        known = self.triples.get(total, ())
        if known is None or known and self.lasts(known):
            return known
        found = None
        lengths = np.flatnonzero(self.avail[1 : min(top, total - 2) + 1]) + 1
        for x in lengths[::-1].tolist():
            if total - x > 2 * top:
                break
            p = self.pair(total - x, top)
            if p and not self.lasts((x, *p)):
                p = next((q for q in self._pairs(total - x, top) if self.lasts((x, *q))), None)
            if p:
                found = (x, *p)
                break
        self.triples[total] = found
        return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(containers, [(length, items a container), ...])`` that use up the histogram.

    Lengths are from 1 to ``capacity``.
    """
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in histogram.items():
        avail[k] = v
    index = SumIndex(avail)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    top = capacity
    while True:
        while top and not avail[top]:
            top -= 1
        if not top:
            return out
        used: dict[int, int] = {}
        gap, t = capacity, top

        def take(x: int, used=used) -> None:
            used[x] = used.get(x, 0) + 1
            avail[x] -= 1

        while gap:
            while t and (t > gap or not avail[t]):
                t -= 1
            if not t:
                break
            # no triple reaches further than three times the largest length
            c = index.find(gap, t) if gap <= 3 * t and used or gap == t else None
            if c:
                for x in c:
                    take(x)
                gap = 0
            else:
                take(t)
                gap -= t
        times = 1 + min(int(avail[x]) // n for x, n in used.items())
        for x, n in used.items():
            avail[x] -= n * (times - 1)
        out.append((times, sorted(used.items(), reverse=True)))


def fill(documents: DataFrame, container_profile: DataFrame, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None) -> DataFrame:
    """``profile_id, container_id, doc_id, piece_no, start_token, n_tokens``.

    Every document is placed once in each profile. One that alone exceeds the
    capacity is cut into pieces of exactly the capacity and a rest; no other is
    cut. Null and empty texts take no room and go to container 1. A profile
    without a positive capacity is left out; ties are broken by doc_id hash, so
    the result doesn't depend on partitioning.
    """
    spark = documents.sparkSession
    profiles = [(r.profile_id, r.capacity_tokens) for r in container_profile.where("capacity_tokens > 0").select("profile_id", "capacity_tokens").collect()]
    schema = "profile_id long, container_id long, doc_id long, piece_no int, start_token long, n_tokens long"
    if not profiles:
        return spark.createDataFrame([], schema)
    sizes = checkpoint(token_counts(documents, vocabulary)) if sizes is None else sizes
    caps = F.array(*[F.struct(F.lit(p).cast("long").alias("profile_id"), F.lit(c).cast("long").alias("cap")) for p, c in profiles])
    items = (
        sizes.select("doc_id", F.col("n_tokens").alias("n"), F.explode(caps).alias("c"))
        .select("doc_id", "n", "c.profile_id", "c.cap")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("cap")) - 1))))
        .select(
            "profile_id",
            "doc_id",
            F.col("piece_no").cast("int").alias("piece_no"),
            (F.col("piece_no") * F.col("cap")).alias("start_token"),
            F.least(F.col("cap"), F.col("n") - F.col("piece_no") * F.col("cap")).alias("n_tokens"),
        )
    )
    n_items = items.agg(F.count(F.lit(1))).head()[0]
    items = items.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(1 + n_items // GROUP_ROWS)))
    counts = checkpoint(items.where("n_tokens > 0").groupBy("profile_id", "n_tokens", "b").agg(F.count(F.lit(1)).alias("k")))
    # at most one row per profile and length
    hist: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("profile_id", "n_tokens").agg(F.sum("k").alias("k")).collect():
        hist.setdefault(r.profile_id, {})[r.n_tokens] = r.k
    runs = []
    for p, cap in profiles:
        base, at = 1, {}
        for times, pattern in plan(hist.get(p, {}), cap):
            for length, per in pattern:
                lo = at.get(length, 0)
                runs.append((p, length, lo, lo + times * per, base, per))
                at[length] = lo + times * per
            base += times
    # at most a few rows per profile and length, as each pattern exhausts a length
    table = spark.createDataFrame(runs, "profile_id long, n_tokens long, lo long, hi long, base long, per long")
    before = counts.withColumn(
        "before", F.coalesce(F.sum("k").over(W.partitionBy("profile_id", "n_tokens").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    # the part of the plan that falls to each sub-group
    parts = before.join(table, ["profile_id", "n_tokens"]).where("lo < before + k AND hi > before").drop("k")
    keys = ["profile_id", "n_tokens", "b"]
    numbered = items.where("n_tokens > 0").withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "piece_no")) - 1)
    placed = numbered.join(parts.hint("merge"), keys).withColumn("ix", F.col("rn") + F.col("before")).where("ix >= lo AND ix < hi")
    cols = ["profile_id", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"]
    placed = placed.withColumn("container_id", F.col("base") + F.floor((F.col("ix") - F.col("lo")) / F.col("per"))).select(cols)
    empty = items.where("n_tokens <= 0").withColumn("container_id", F.lit(1).cast("long")).select(cols)
    return placed.unionByName(empty)


def usage(filled: DataFrame, container_profile: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, the largest container, the share of room used."""
    c = filled.groupBy("profile_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    return (
        c.groupBy("profile_id")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
        .join(container_profile.select("profile_id", "capacity_tokens"), "profile_id")
        .withColumn("share_used", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
    )
