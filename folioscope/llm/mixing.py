"""A mix of sources with target shares of all tokens, by min-cost flow over membership patterns.

Documents with equal texts are one document, which then belongs to several sources. Documents are
aggregated by the set of target sources they belong to; each such pattern offers its tokens once at no
cost, a second time at cost 1, a third time at cost 2 and so on, up to the smallest repeat limit of its
sources. Flow runs from patterns to the quotas of their sources. Without a given total, the total is
the largest at which every source that has documents reaches its share; with a given total, quotas that
can't be met are filled as far as possible and the report shows it.

The flow is turned into documents without collecting any: documents of a pattern lie in the order of a
seeded hash on a tape of tokens, one stretch per repetition, and the flows to its sources are segments
of that tape. The place of a document is the sum over whole hash bins before its own, a table of
bounded size, and a running sum within its bin.

Defined cases: null or empty texts have no tokens and are left out, as are sources without a target;
sources are compared in lower case without blanks at the ends; a target without documents gets nothing
and the report says so; equal texts in one source count once; shares are taken over tokens of the mix;
a target without share or with a negative one counts as 0; empty tables give an empty mix.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to this public vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 4096


def token_counts(rows: DataFrame, text_column: str, keep: list[str], path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns, a hash of the text, and its number of tokens."""
    with open(path, "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}, special_tokens={})
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    shaped = rows.where(F.length(text_column) > 0).select(*keep, F.xxhash64(text_column, F.length(text_column)).alias("text_hash"), text_column)
    kinds = ", ".join(f"`{n}` {t}" for n, t in shaped.dtypes[:-1])
    return shaped.mapInArrow(count, kinds + ", tokens long")


def min_cost_flow(offers: dict[tuple[str, ...], tuple[int, int]], quotas: dict[str, float]) -> dict[tuple[tuple[str, ...], str], float]:
    """Flow per (pattern, source). ``offers``: tokens and repetitions of each pattern.

    Successive cheapest paths. All costs lie on the arcs of repetitions, so levels are opened one after
    another and each is filled to the limit by breadth-first augmentation over the residual arcs.
    """
    patterns, flow = list(offers), {}
    used = dict.fromkeys(patterns, 0.0)
    left = dict(quotas)
    for level in range(max((r for _, r in offers.values()), default=0)):
        while True:
            start = [p for p in patterns if offers[p][1] > level and used[p] < offers[p][0] * (level + 1) - 1e-9]
            before: dict = {("p", p): None for p in start}
            queue, goal = deque(before), None
            while queue and goal is None:
                kind, node = queue.popleft()
                if kind == "p":
                    for s in node:
                        if s in left and ("s", s) not in before:
                            before["s", s] = (kind, node)
                            if left[s] > 1e-9:
                                goal = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for p in patterns:
                        if flow.get((p, node), 0.0) > 1e-9 and ("p", p) not in before:
                            before["p", p] = (kind, node)
                            queue.append(("p", p))
            if goal is None:
                break
            path = [goal]
            while before[path[-1]] is not None:
                path.append(before[path[-1]])
            path.reverse()
            amount = min(left[goal[1]], offers[path[0][1]][0] * (level + 1) - used[path[0][1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "s":
                    amount = min(amount, flow[b[1], a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1], b[1]] = flow.get((a[1], b[1]), 0.0) + amount
                else:
                    flow[b[1], a[1]] -= amount
            used[path[0][1]] += amount
            left[goal[1]] -= amount
    return {k: v for k, v in flow.items() if v > 1e-9}


def plan_mix(offers: dict[tuple[str, ...], tuple[int, int]], shares: dict[str, float], total: float | None) -> tuple[dict, float]:
    """The flow and the total of the mix."""
    reachable = {s: w for s, w in shares.items() if w > 0 and any(s in p and t > 0 for p, (t, _) in offers.items())}
    if not reachable:
        return {}, 0.0
    weight = sum(reachable.values())
    if total is not None:
        return min_cost_flow(offers, {s: w * total for s, w in reachable.items()}), total
    low, high = 0.0, float(sum(t * r for t, r in offers.values())) / weight

    def met(size: float) -> bool:
        return sum(min_cost_flow(offers, {s: w * size for s, w in reachable.items()}).values()) >= weight * size * (1 - 1e-9) - 1e-6

    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if met(middle) else (low, middle)
    return min_cost_flow(offers, {s: w * low for s, w in reachable.items()}), low


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 11, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copies, tokens): the documents of the mix and how often each is taken."""
    spark = documents.sparkSession
    wanted = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(1, r["max_repeats"] or 1)) for r in targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).collect() if r["source"] is not None}
    named = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source")).where(F.col("source").isin(list(wanted)))
    counted = token_counts(named, "text", ["doc_id", "source"], path)
    unique = counted.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern")).where("tokens > 0")
    # A bin holds documents of one pattern with near hashes; their sums are a table of at most BINS rows a pattern.
    order = F.xxhash64("text_hash", F.lit(seed))
    placed = unique.select("doc_id", "tokens", "pattern", order.alias("place"), F.shiftrightunsigned(order, 52).cast("int").alias("bin"))
    placed = cut(placed)
    bins = placed.groupBy("pattern", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    whole = Window.partitionBy("pattern").orderBy("bin")
    starts = bins.withColumn("before", F.coalesce(F.sum("bin_tokens").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offers = {tuple(r["pattern"]): (int(r["tokens"]), min(wanted[s][1] for s in r["pattern"])) for r in bins.groupBy("pattern").agg(F.sum("bin_tokens").alias("tokens")).collect()}
    flow, _ = plan_mix(offers, {s: w for s, (w, _) in wanted.items()}, total_tokens)
    segments = []
    for pattern in sorted(offers):
        at = 0.0
        for source in pattern:
            amount = flow.get((pattern, source), 0.0)
            if amount > 0:
                segments.append((list(pattern), source, at, at + amount, offers[pattern][0], offers[pattern][1]))
                at += amount
    table = spark.createDataFrame(segments, "pattern array<string>, source string, low double, high double, pattern_tokens long, repeats int")
    within = Window.partitionBy("pattern", "bin").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taped = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts.select("pattern", "bin", "before"), ["pattern", "bin"])
    levels = taped.join(F.broadcast(table), "pattern").select("doc_id", "tokens", "source", "low", "high", (F.col("before") + F.col("inside")).alias("at"), "pattern_tokens", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("level"))
    tape = F.col("at") + F.col("level") * F.col("pattern_tokens") + F.col("tokens") / 2
    return levels.where((tape >= F.col("low")) & (tape < F.col("high"))).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("copies"), F.max("tokens").alias("tokens"))


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Share reached against the target, per source of ``targets``."""
    sums = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    goals = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    return goals.join(sums, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats"
    )
