"""Mixing sources to target weights.

Method: Pfair scheduling. The mix is a line of slots of equal token size, one block each. Each source is a task with its weight as
utilisation: its j-th block may not start before slot floor(j / w) and is due before slot ceil((j + 1) / w); earliest deadline first keeps
every source within one block of its share at any point of the mix. Weights are whole parts of 10,000, so the schedule repeats after 10,000
slots: that period is computed once on the driver (at most 10,000 sources can have a weight), and the number of periods grows with the
corpus, so that a block stays small. The documents find their block through running token sums that are built in two levels, so that
no source, however large, is sorted in one task.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import bounded

BUCKETS = 1024  # parts of a source whose token sums are added up first
PERIOD = 10_000  # slots after which every schedule repeats: weights are parts of it
BLOCK_TOKENS = 100_000  # the size of a block that is aimed at; a mix has at least one period, so its blocks may be smaller


def schedule(weights: dict[str, int], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of a Pfair schedule by earliest deadline first; weights in 1/10,000, of sum 10,000 or less.

    Slots that no source may use yet stay free. Ties go to the earlier deadline of the next block, then to the name.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    waiting = [(0, s, 0) for s in sorted(live)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            w = live[s]
            due = -(-(j + 1) * 10_000 // w)
            heapq.heappush(ready, (due, -(-(j + 2) * 10_000 // w), s, j))
        if ready:
            _, _, s, j = heapq.heappop(ready)
            out.append((s, j, slot))
            heapq.heappush(waiting, ((j + 1) * 10_000 // live[s], s, j + 1))
    return out


def running(sized: DataFrame, seed: int) -> DataFrame:
    """sized (key, source, n_tokens) with `start`: tokens of the source before this document, in a pseudo-random order.

    Two levels: sums of BUCKETS parts of each source, then within each part. A part is a fixed fraction of its source.
    """
    h = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    b = sized.select("key", "source", "n_tokens").withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    sums = b.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy("source", "_b").orderBy("_h", "key").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("_w", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, ["source", "_b"]).withColumn("start", F.col("_w") + F.col("_before")).drop("_h", "_b", "_w", "_before")


def targets_met(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target source: total (tokens of the whole mix), has (tokens of the source), wanted, taken, passes.

    wanted is the source's share of the total; taken is what max_repeats allows of it.
    """
    by = sized.groupBy("source").agg(F.sum("n_tokens").alias("has"), F.count("*").alias("n_docs"))
    total = by.agg(F.coalesce(F.sum("has"), F.lit(0)).alias("total"))
    t = targets.where("source is not null").select("source", "weight_bp", "max_repeats").crossJoin(F.broadcast(total)).join(by.where("source is not null"), "source", "left")
    t = t.withColumns({"has": F.coalesce("has", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
    t = t.withColumn("wanted", F.floor(F.col("total") * F.col("weight_bp") / 10000).cast("long"))
    return t.withColumn("taken_at_most", F.least("wanted", F.col("has") * F.col("max_repeats")))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 42, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, source, repeat, n_tokens, slot, place): the documents of the mix in the order of the schedule.

    sized: key, source, n_tokens. A document is taken once for each full pass through its source and once more if its middle lies before
    the end of the last pass, so a source's size is met to within half a document. repeat counts from 0 and stays below max_repeats.
    Documents of no tokens (null or empty text), of a null source or of sources without a target aren't taken. Order the result by
    (slot, place) to read the mix; place is the running token sum within the source. Blocks of a source beyond its weight, which
    rounding may leave, come last. Weights above 10,000 in sum are an error.
    """
    t = targets_met(sized, targets)
    r = running(sized.where("source is not null and n_tokens > 0"), seed)
    # sources with a weight are at most PERIOD: the weights are whole and their sum is checked
    spark = sized.sparkSession
    listed = targets.where("source is not null and weight_bp > 0").select("source", "weight_bp").limit(PERIOD + 1).collect()
    weights = {x["source"]: x["weight_bp"] for x in listed}
    if len(listed) > PERIOD or sum(weights.values()) > PERIOD:
        raise ValueError(f"weights are parts of {PERIOD}, in sum no more")
    m = r.join(bounded(t.select("source", "has", "taken_at_most", "total", "weight_bp", "max_repeats").where("has > 0 and weight_bp > 0"), PERIOD), "source")
    # position of the k-th copy in the endless repetition of the source
    left = F.col("taken_at_most") - F.col("start") - F.col("n_tokens") / 2
    copies = F.least(F.greatest(F.ceil(left / F.col("has")).cast("int"), F.lit(0)), F.col("max_repeats"))
    m = m.withColumn("_n", copies).where("_n > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    m = m.withColumn("place", F.col("start") + F.col("repeat") * F.col("has"))
    slots = F.greatest(F.ceil(F.col("total") / F.lit(PERIOD * block_tokens)), F.lit(1)).cast("long") * PERIOD
    # the block of a document: its place in units of total / slots tokens; a source has weight_bp blocks in each period
    m = m.withColumn("_slots", slots).withColumn("_all", F.floor(F.col("place") * F.col("_slots") / F.col("total")).cast("long"))
    m = m.withColumn("block", F.pmod("_all", F.col("weight_bp").cast("long")).cast("int")).withColumn("_period", F.floor(F.col("_all") / F.col("weight_bp")).cast("long"))
    rows = schedule(weights, PERIOD)
    s = spark.createDataFrame(pd.DataFrame(rows, columns=["source", "block", "_slot"]), "source string, block int, _slot int") if rows else spark.createDataFrame([], "source string, block int, _slot int")
    slot = F.when(F.col("_period") * PERIOD + F.col("_slot") < F.col("_slots"), F.col("_period") * PERIOD + F.col("_slot")).otherwise(F.col("_slots"))
    return m.join(F.broadcast(s), ["source", "block"], "left").select("key", "source", "repeat", "n_tokens", F.coalesce(slot, F.col("_slots")).alias("slot"), "place")


def report(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(source, weight_bp, has, wanted, taken, share_bp, n_rows, reached): the shares really reached, for every target source.

    share_bp is the source's part of the tokens in the mix, in 1/10,000; reached tells whether max_repeats allowed the target.
    """
    got = mix(sized, targets, seed).groupBy("source").agg(F.sum("n_tokens").alias("taken"), F.count("*").alias("n_rows"))
    t = targets_met(sized, targets).join(got, "source", "left")
    t = t.withColumns({"taken": F.coalesce("taken", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0))})
    all_ = F.sum("taken").over(Window.partitionBy())
    return t.select("source", "weight_bp", "has", "wanted", "taken", F.try_divide(F.col("taken") * 10000.0, all_).alias("share_bp"), "n_rows", (F.col("taken_at_most") >= F.col("wanted")).alias("reached"))
