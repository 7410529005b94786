"""Mixing sources to target weights (problem 9) by Pfair scheduling of token blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import bounded

#: Tokens of a block; slots after which the schedule repeats, at most; rows of a source that one window task orders, about.
BLOCK, PERIOD, ROWS_A_TASK = 8192, 100_000, 50_000


def pfair(weights: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block) of an earliest-deadline-first schedule.

    Block j of a source of weight w is released at slot floor(j/w) and due at slot ceil((j+1)/w). While weights sum
    to one, such a schedule meets each deadline, so after any slot each source is less than one block from its share.
    Equal deadlines go to the heavier source, then by name.
    """
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, Fraction, str, int]] = []
    for s, n in blocks.items():
        if n > 0:
            heapq.heappush(waiting, (0, s, 0))
    out: list[tuple[int, str, int]] = []
    now = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil(Fraction(j + 1) / weights[s]), -weights[s], s, j))
        if not ready:
            now = waiting[0][0]
            continue
        _, _, s, j = heapq.heappop(ready)
        out.append((len(out), s, j))
        now += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor(Fraction(j + 1) / weights[s]), s, j + 1))
    return out


def period(weights: dict[str, Fraction], most: int = PERIOD) -> dict[str, int]:
    """Blocks of each source in one period of the schedule, whose sum is the period's length.

    If the weights have a common denominator of at most ``most``, that is the period; else weights are rounded to multiples of
    1 / ``most`` by largest remainders, each at least one.
    """
    common = math.lcm(*[w.denominator for w in weights.values()]) if weights else 1
    if common <= most:
        return {s: int(w * common) for s, w in weights.items()}
    counts = {s: max(1, int(w * most)) for s, w in weights.items()}
    for s in sorted(weights, key=lambda s: (-(weights[s] * most - int(weights[s] * most)), s))[: max(0, most - sum(counts.values()))]:
        counts[s] += 1
    return counts


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], most_period: int = PERIOD) -> tuple[dict[str, Fraction], dict[str, int], dict[str, int]]:
    """Weights, token quotas and blocks a period. ``sizes``: tokens of each source; ``targets``: share and repeats.

    Sources without tokens, share or repeats can't take part; the others' shares are scaled to one. The total is the
    largest at which no source has to be used more often than its repeats allow.
    """
    usable = {s: Fraction(share).limit_denominator(10**6) for s, (share, repeats) in targets.items() if share and share > 0 and math.isfinite(share) and (repeats or 0) > 0 and sizes.get(s, 0) > 0}
    whole = sum(usable.values())
    counts = period({s: w / whole for s, w in usable.items()}, most_period)
    weights = {s: Fraction(n, sum(counts.values())) for s, n in counts.items()}
    total = min((Fraction(sizes[s] * targets[s][1]) / w for s, w in weights.items()), default=Fraction(0))
    return weights, {s: int(total * w) for s, w in weights.items()}, counts


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, most_period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares reached.

    ``documents``: doc_id, source, tokens; ``targets``: source, target_share, max_repeats (a small fixed table; a source
    listed twice adds its shares and takes the larger repeats). Mixture: slot, source, block, pass, doc_id, tokens, one
    row for each use of a document, ordered by slot and position. Documents without tokens carry nothing and are left
    out, as are sources that are not in ``targets``. A source whose last document crosses its quota keeps it whole.
    Shares: source, target_share, weight, documents, uses, tokens, share, passes, for every target, reached or not.

    Blocks have ``block`` tokens whatever the total. At the end of a period each source is at its share exactly, so the schedule of
    one period (at most ``most_period`` slots) is all that is scheduled, and a block's slot follows from its number. The
    driver sees one row a target and that period; documents are placed by prefix sums in two levels, so a source
    with most of the documents is spread over many tasks. In the last period a source that is done leaves its slots empty.
    """
    spark = documents.sparkSession
    docs = documents.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "source", "tokens")
    wanted = bounded(targets).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # One row for each target, not for each document.
    facts = wanted.join(docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n")), "source", "left").collect()
    sizes = {r["source"]: int(r["size"] or 0) for r in facts}
    shares = {r["source"]: (r["target_share"], r["max_repeats"]) for r in facts}
    weights, quotas, counts = plan(sizes, shares, most_period)
    length = sum(counts.values())
    schedule = spark.createDataFrame(pfair(weights, counts), "turn long, source string, in_period long")
    rules = spark.createDataFrame([(s, sizes[s], quotas[s], int(shares[s][1]), counts[s]) for s in quotas], "source string, size long, quota long, repeats int, blocks long")

    parts = max(1, -(-max([int(r["n"] or 0) for r in facts], default=0) // ROWS_A_TASK))
    place = F.xxhash64("doc_id", F.lit("mix"))
    docs = docs.join(F.broadcast(rules), "source").withColumn("h", place).withColumn("part", F.pmod(F.col("h"), F.lit(parts)))
    firsts = docs.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"))
    above = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("source", "part", F.coalesce(F.sum("part_tokens").over(above), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("at", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(firsts, ["source", "part"]).withColumn("at", F.col("at") + F.col("offset"))
    uses = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).withColumn("at", F.col("at") + F.col("pass") * F.col("size")).where("at < quota")
    uses = uses.withColumn("block", F.expr(f"at div {block}")).withColumn("in_period", F.expr("block % blocks"))
    slot = (F.expr("block div blocks") * length + F.col("turn")).alias("slot")
    mixture = uses.join(F.broadcast(schedule), ["source", "in_period"]).select(slot, "source", "block", "pass", "at", "doc_id", "tokens")

    reached = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("pass").alias("pass"))
    whole = Window.partitionBy()  # one row a target
    known = spark.createDataFrame([(s, float(weights.get(s, 0)), int(n or 0)) for s, n in ((r["source"], r["n"]) for r in facts)], "source string, weight double, documents long")
    report = wanted.join(F.broadcast(known), "source").join(F.broadcast(reached), "source", "left")
    report = report.select("source", "target_share", "weight", "documents", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("pass", F.lit(-1)) + 1).alias("passes"))
    report = report.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)), 6))
    return mixture, report
