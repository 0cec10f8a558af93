"""Mixing sources to target shares of the tokens.

Sources overlap: the same text may stand in several.  Texts are taken once, with the
set of sources they stand in, their membership pattern.  Tokens flow from patterns to
sources:

* the r-th use of a pattern's texts is a node with the pattern's tokens as capacity,
* it leads to each source of the pattern that allows r uses, at a cost of r - 1, so
  that repeating costs more the more often it is done,
* each source takes its share of the total.

The total is the largest for which all sources that have texts at all reach their
shares.  The cheapest flow says how many tokens of each pattern's r-th use go to which
source; within a pattern, texts lie in seeded order on a line of their tokens, and the
flows are stretches of it.

Scale: the flow is solved on the driver over patterns, at most two to the power of the
number of targets whatever the size of the corpus.  Texts are grouped by hash with
partial aggregation; places on the line come from sums of buckets, each of a bounded
expected number of texts, never from one ordering of a source.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpair.llm.encoding import TOKENIZERS, count_tokens
from quillpair.sources.shared import stage_table

#: Texts that a bucket of the line is expected to hold, at most.
BUCKET = 20_000


class _Network:
    """Cheapest flows by shortest augmenting paths with potentials."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for start, end, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Sends as much as possible, at the least cost; all costs are 0 or more at first."""
        sent, potential = 0, [0] * len(self.out)
        while True:
            far = [math.inf] * len(self.out)
            by = [-1] * len(self.out)
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and (new := d + self.cost[e] + potential[u] - potential[v]) < far[v]:
                        far[v], by[v] = new, e
                        heapq.heappush(queue, (new, v))
            if far[sink] == math.inf:
                return sent
            potential = [p + d if d < math.inf else p for p, d in zip(potential, far, strict=True)]
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            much = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= much
                self.room[e ^ 1] += much
            sent += much


def route_tokens(capacity: dict[int, int], shares: list[float], repeats: list[int], total: int | None = None) -> tuple[int, dict[tuple[int, int, int], int]]:
    """The total, and tokens by ``(pattern, use, source)``.

    ``capacity``: tokens by pattern, a bit for each source.  ``total`` bounds the total
    from above.  Sources without texts, or with no share or no use, take nothing.
    """
    reachable = [s for s in range(len(shares)) if shares[s] > 0 and repeats[s] > 0 and any(p >> s & 1 and c > 0 for p, c in capacity.items())]
    patterns = [p for p, c in sorted(capacity.items()) if c > 0 and any(p >> s & 1 for s in reachable)]
    if not reachable:
        return 0, {}

    def solve(size: int, priced: bool) -> tuple[bool, dict[tuple[int, int, int], int]]:
        uses = [(p, r) for p in patterns for r in range(1, max(repeats[s] for s in reachable if p >> s & 1) + 1)]
        net = _Network(2 + len(uses) + len(reachable))
        arcs = {}
        for k, (p, r) in enumerate(uses):
            net.arc(0, 2 + k, capacity[p])
            for j, s in enumerate(reachable):
                if p >> s & 1 and r <= repeats[s]:
                    arcs[p, r, s] = net.arc(2 + k, 2 + len(uses) + j, capacity[p], (r - 1) * priced)
        wanted = 0
        for j, s in enumerate(reachable):
            quota = math.floor(shares[s] * size)
            wanted += quota
            net.arc(2 + len(uses) + j, 1, quota)
        return net.run(0, 1) == wanted, {at: net.room[e ^ 1] for at, e in arcs.items() if net.room[e ^ 1]}

    low, high = 0, sum(capacity[p] for p in patterns) * max(repeats[s] for s in reachable)
    high = math.ceil(high / max(sum(shares[s] for s in reachable), 1e-12))
    high = high if total is None else min(high, total)
    while low < high:
        middle = (low + high + 1) // 2
        if solve(middle, False)[0]:
            low = middle
        else:
            high = middle - 1
    return low, solve(low, True)[1]


def _texts(documents: DataFrame, names: list[str], ranks: str) -> DataFrame:
    """Distinct texts with tokens: ``(doc_id, pattern, tokens, place)``; place is the seeded order's hash input."""
    bit = F.lit(0).cast("long")
    for k, name in enumerate(names):
        bit = F.when(F.col("source") == name, F.lit(1 << k)).otherwise(bit)
    rows = documents.select(F.col("doc_id"), bit.alias("bit"), F.col("text"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    counted = count_tokens(rows.filter("bit > 0 AND text <> '' AND doc_id IS NOT NULL"), "text", ranks)
    return counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.bit_or("bit").alias("pattern"), F.max("tokens").alias("tokens")).filter("tokens > 0")


def mix_sources(
    documents: DataFrame, targets: DataFrame, seed: int = 1, total: int | None = None, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``(source, doc_id, uses, tokens)``: how often each text is used for a source, and its tokens.

    ``documents``: doc_id, text, source; ``targets``: source, target_share, max_repeats.
    A text that stands in several rows is known by its smallest doc_id.  No text is used
    more often, over all sources, than the largest ``max_repeats`` of the sources that
    use it.  Rows with a null key, text or source, an empty text or a source without a
    target are not used; targets that repeat a source count with their first share.
    Shares are met to within one text for each stretch of the line.
    """
    wanted = {r["source"]: r for r in reversed(targets.orderBy("source", F.desc("target_share")).collect()) if r["source"] is not None}
    names = sorted(wanted)
    if len(names) > 62:
        raise ValueError("at most 62 targets")
    spark = documents.sparkSession
    texts = stage_table(_texts(documents, names, ranks), "mix-texts")
    sizes = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")).collect()
    shares = [float(wanted[n]["target_share"] or 0) for n in names]
    _, flows = route_tokens({r["pattern"]: r["tokens"] for r in sizes}, shares, [int(wanted[n]["max_repeats"] or 0) for n in names], total)
    stretches, ends = [], {}
    for (p, r, s), much in sorted(flows.items()):
        start = ends.get((p, r), 0)
        stretches.append((p, r, names[s], start, start + much))
        ends[p, r] = start + much
    buckets = max(16, math.ceil(sum(r["texts"] for r in sizes) / BUCKET) * 16)
    order = F.xxhash64("h1", "h2", F.lit(seed))
    placed = texts.withColumn("order", order).withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("sum")).drop("sum")
    within = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    line = placed.withColumn("inner", within).join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.col("inner"))
    plan = spark.createDataFrame(stretches, "pattern long, use int, source string, start long, stop long")  # at most patterns x uses x sources
    chosen = line.join(F.broadcast(plan), "pattern").filter("at >= start AND at < stop")
    return chosen.groupBy("source", "doc_id", "tokens").agg(F.count("*").cast("int").alias("uses")).select("source", "doc_id", "uses", "tokens")


def mixed_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, tokens drawn, the share reached, texts and uses; 0 where nothing could be drawn."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.sum("uses").alias("uses"))
    # one row for each target: small enough for a window over all
    joined = targets.join(got, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = F.lit(0).cast("long")
    return joined.select(
        "source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("whole"), 6), F.lit(0.0)).alias("actual_share"),
        F.coalesce("texts", zero).alias("texts"), F.coalesce("uses", zero).alias("uses"), "max_repeats",
    )
