"""Sample that matches target category proportions.

Method: mergeable reservoirs kept in one pass. Records fall into cells: those of a category and intent that some target names, and the
rest of each category that some target names. A record's priority is a uniform hash of the seed and its key, so a reservoir is "the k
records of lowest priority" of a cell and two reservoirs merge by keeping the lowest of both. Since k grows with the data, a
reservoir isn't gathered in one task: it is kept as counts by priority slice (a mergeable sketch of fixed size). The final counts, the
feasible quotas and what is exhausted follow from the merged sketches; then each reservoir is trimmed at the priority at which its
quota ends, and only the slice in which that lies is ranked. A hot category is thus never sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import bounded

SLICES = 4096
MAX_TARGETS = 100_000  # beyond it, the sides made of targets are joined without a broadcast hint

CELL = ["category", "cell"]


def cells(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, category, cell): the cell of each record that some target can draw; cell is the intent if a target names it, else null.

    records: key, category, intent; other columns aren't carried along. Records of no target are left out.
    """
    t = targets.select(F.col("category").alias("_c"), F.col("intent").alias("_i")).where("_c is not null")
    exact = t.where("_i is not null").distinct()
    whole = t.where("_i is null").select("_c").distinct().withColumn("_whole", F.lit(True))
    r = records.select("key", "category", "intent").join(bounded(exact, MAX_TARGETS), (F.col("category") == F.col("_c")) & (F.col("intent") == F.col("_i")), "left").drop("_c")
    r = r.join(bounded(whole, MAX_TARGETS), F.col("category") == F.col("_c"), "left").drop("_c")
    return r.where("_i is not null or _whole").select("key", "category", F.col("_i").alias("cell"))


def needs(targets: DataFrame, size: DataFrame) -> DataFrame:
    """targets with `need`: the larger of min_rows and the share of the sample rounded up. size: one row, column n (rows of the sample)."""
    share = F.floor((F.col("share_bp").cast("long") * F.col("n") + 9999) / F.lit(10000)).cast("long")
    t = targets.select("target_id", "category", "intent", "share_bp", "min_rows")
    return t.crossJoin(F.broadcast(size.select("n"))).withColumn("need", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.coalesce(share, F.lit(0))))


def quotas(rows: list[tuple[int, int, int, int, int, str]], groups: dict[str, int], n: int) -> dict[int, int]:
    """Feasible quotas by target: (target_id, share_bp, min_rows, need, drawable, group) rows, the records of each group and the sample's size.

    The targets of a group together can't draw more than its records: a target of a whole category shares them with those of its intents,
    which come first. What a target can't give is spread over those with records to spare, by their shares (largest remainders); what
    the minimums and the rounding up add is trimmed the same way, never below a minimum.
    """
    got: dict[int, int] = {}
    used = dict.fromkeys(groups, 0)
    floor: dict[int, int] = {}
    for want in ("low", "need"):
        for t, _, low, need, have, g in sorted(rows, key=lambda x: (x[4] >= groups.get(x[5], 0), x[0])):
            more = max(0, min((low if want == "low" else max(need, low)) - got.get(t, 0), have - got.get(t, 0), groups.get(g, 0) - used.get(g, 0)))
            got[t] = got.get(t, 0) + more
            used[g] = used.get(g, 0) + more
        if want == "low":
            floor = dict(got)
    group = {r[0]: r[5] for r in rows}
    most = {r[0]: r[4] for r in rows}

    def room(t: int, gap: int) -> int:
        return min(most[t] - got[t], groups.get(group[t], 0) - used.get(group[t], 0)) if gap > 0 else got[t] - floor[t]

    while (gap := n - sum(got.values())) != 0:
        open_ = [(r[0], max(r[1], 0)) for r in rows if room(r[0], gap) > 0]
        if not open_:
            break
        total, todo = sum(s for _, s in open_), abs(gap)
        ideal = {t: todo * s / total if total else todo / len(open_) for t, s in open_}
        step = {t: int(x) for t, x in ideal.items()}
        rest = todo - sum(step.values())
        for t in sorted(ideal, key=lambda t: (-(ideal[t] - int(ideal[t])), t)):
            take = step[t] + (1 if rest > 0 else 0)
            rest -= 1
            take = min(take, room(t, gap))
            got[t] += take if gap > 0 else -take
            used[group[t]] += take if gap > 0 else -take
    return got


def sketches(records: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records with cell, priority and slice; the merged sketch of each cell: category, cell, slice, n, before). Combined before the shuffle."""
    p = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    # the priority's order follows the slice first, so that slices are ranges of it
    r = cells(records, targets).withColumn("priority", p).withColumn("slice", F.pmod(F.shiftrightunsigned("priority", 40), F.lit(SLICES)).cast("int"))
    sketch = r.groupBy(*CELL, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*CELL).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return r, sketch.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def available(sketch: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target_id, category, intent, share_bp, min_rows) with `available`, the records in the reservoirs a target can draw from, and
    `in_category`, those of its whole category. Targets may overlap; each counts its own."""
    n = sketch.groupBy(*CELL).agg(F.sum("n").alias("_n"))
    t = targets.select("target_id", "category", "intent", "share_bp", "min_rows")
    c = n.select(F.col("category").alias("_c"), F.col("cell").alias("_i"), "_n")
    own = t.join(c, F.col("category") == F.col("_c"), "left").withColumn("_own", F.col("intent").isNull() | F.coalesce(F.col("intent") == F.col("_i"), F.lit(False)))
    by = own.groupBy("target_id", "category", "intent", "share_bp", "min_rows")
    return by.agg(F.coalesce(F.sum(F.when(F.col("_own"), F.col("_n"))), F.lit(0)).alias("available"), F.coalesce(F.sum("_n"), F.lit(0)).alias("in_category"))


PLAN = "kind string, target_id int, need long, available long, quota long, category string, cell string, first int, n_first long, second int, n_second long"


def plan(records: DataFrame, targets: DataFrame, size: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records of sketches(); sketch; decisions): one `target` row for each target with need, available and quota, and one `cell` row for each
    cell: the target of its first n_first records in order of priority, and the target of the n_second after them.

    Targets of the same category and intent given twice: the lowest id draws. Targets of a whole category draw from all its cells, what
    the targets of the intents leave.
    """
    r, sketch = sketches(records, targets, seed)
    t = available(sketch, targets).join(needs(targets, size).select("target_id", "need", F.col("n").alias("size")), "target_id")
    n = sketch.groupBy(*CELL).agg(F.sum("n").alias("available"))
    null = lambda kind: F.lit(None).cast(kind)
    both = t.select(F.lit("target").alias("kind"), "target_id", "category", "intent", "share_bp", "min_rows", "need", "available", "in_category", "size").unionByName(
        n.select(F.lit("cell").alias("kind"), null("int").alias("target_id"), "category", F.col("cell").alias("intent"), null("int").alias("share_bp"), null("int").alias("min_rows"), null("long").alias("need"), "available", null("long").alias("in_category"), null("long").alias("size"))
    )

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        text = lambda x: x if isinstance(x, str) else None
        ts = pdf[pdf["kind"] == "target"].sort_values("target_id")
        cs = [(x.category, text(x.intent), int(x.available)) for x in pdf[pdf["kind"] == "cell"].itertuples()]
        draws: dict[tuple, int] = {}
        rows, groups = [], {}
        whole = lambda x: 0 if x != x or x is None else int(x)
        for x in ts.itertuples():
            first = draws.setdefault((text(x.category), text(x.intent)), int(x.target_id)) == int(x.target_id)
            rows.append((int(x.target_id), whole(x.share_bp), whole(x.min_rows), int(x.need), int(x.available) if first else 0, text(x.category)))
            groups[text(x.category)] = int(x.in_category)
        q = quotas(rows, groups, int(ts["size"].iloc[0]) if len(ts) else 0)
        out = [("target", int(x.target_id), int(x.need), int(x.available), q[int(x.target_id)], None, None, None, None, None, None) for x in ts.itertuples()]
        left = {}
        for c, i, have in cs:
            own = draws.get((c, i)) if i is not None else None
            left[c, i] = have - (q[own] if own is not None else 0)
        for c in {c for c, _, _ in cs}:
            mine = sorted(((i, n) for (d, i), n in left.items() if d == c), key=lambda x: (x[0] is not None, x[0] or ""))
            second = draws.get((c, None))
            todo, spare = (q[second] if second is not None else 0), sum(n for _, n in mine)
            ideal = {i: todo * n / spare if spare else 0.0 for i, n in mine}
            part = {i: min(int(ideal[i]), n) for i, n in mine}
            for i, n in sorted(mine, key=lambda x: (-(ideal[x[0]] - int(ideal[x[0]])), x[0] or "")):
                if sum(part.values()) < todo and part[i] < n:
                    part[i] += 1
            for i, _ in mine:
                own = draws.get((c, i)) if i is not None else None
                out.append(("cell", None, None, None, None, c, i, own, q[own] if own is not None else 0, second, part[i]))
        cols = [x.split()[0] for x in PLAN.split(", ")]
        return pd.DataFrame(out, columns=cols).astype({c: "Int64" for c in ("need", "available", "quota", "n_first", "n_second")} | {c: "Int32" for c in ("target_id", "first", "second")})

    # a row for each target and for each cell that targets name: as many as the list of targets is long, whatever the records
    return r, sketch, both.groupBy().applyInPandas(decide, PLAN)


def sample(records: DataFrame, targets: DataFrame, size: DataFrame, seed: int = 42) -> DataFrame:
    """(key, category, cell, target_id): as many records of each target as its quota, those of lowest priority in its cells.

    Equal priorities are told apart by the key. Null keys must not occur. No targets or no records: no rows.
    """
    r, sketch, decisions = plan(records, targets, size, seed)
    c = decisions.where("kind = 'cell'").select(F.col("category").alias("_c"), F.col("cell").alias("_i"), "first", "n_first", "second", (F.col("n_first") + F.col("n_second")).alias("n_both"), F.col("n_first").alias("_n1"))
    s = sketch.join(c, (F.col("category") == F.col("_c")) & F.col("cell").eqNullSafe(F.col("_i")))
    ends = lambda n: (F.col("before") < F.col(n)) & (F.col("before") + F.col("n") >= F.col(n))
    at = lambda n, name: (F.coalesce(F.max(F.when(ends(n), F.col("slice"))), F.lit(-1)).alias(f"slice_{name}"), F.coalesce(F.max(F.when(ends(n), F.col(n) - F.col("before"))), F.lit(0)).alias(f"rank_{name}"))
    cut = s.groupBy("_c", "_i", "first", "second").agg(*at("_n1", "a"), *at("n_both", "b"))
    both = r.join(bounded(cut, MAX_TARGETS), (F.col("category") == F.col("_c")) & F.col("cell").eqNullSafe(F.col("_i")))
    out = ["key", "category", "cell", "target_id"]
    inner = both.where("slice <> slice_a and slice <> slice_b").withColumn("target_id", F.when(F.col("slice") < F.col("slice_a"), F.col("first")).when(F.col("slice") < F.col("slice_b"), F.col("second")))
    w = Window.partitionBy(*CELL, "slice").orderBy("priority", "key")
    edge = both.where("slice = slice_a or slice = slice_b").withColumn("_rank", F.row_number().over(w))
    of_first = (F.col("slice") < F.col("slice_a")) | ((F.col("slice") == F.col("slice_a")) & (F.col("_rank") <= F.col("rank_a")))
    of_second = (F.col("slice") < F.col("slice_b")) | ((F.col("slice") == F.col("slice_b")) & (F.col("_rank") <= F.col("rank_b")))
    edge = edge.withColumn("target_id", F.when(of_first, F.col("first")).when(of_second, F.col("second")))
    return inner.select(*out).unionByName(edge.select(*out)).where("target_id is not null")


def shortfalls(records: DataFrame, targets: DataFrame, size: DataFrame, seed: int = 42) -> DataFrame:
    """(target_id, category, intent, need, available, missing, quota) of each target, from the plan of the sample; missing is 0 if it is met.

    A target without records has 0 available. quota is what the sample draws for it.
    """
    d = plan(records, targets, size, seed)[2].where("kind = 'target'").select("target_id", "need", "available", "quota")
    return targets.select("target_id", "category", "intent").join(d, "target_id").withColumn("missing", F.greatest(F.col("need") - F.col("available"), F.lit(0)))


def teacher_records(teacher: DataFrame) -> DataFrame:
    """(key, category, intent) of each teacher_id once; intent is the first stored one, null if there is none."""
    t = teacher.where("teacher_id is not null").select(F.col("teacher_id").alias("key"), F.col("route.category").alias("category"), F.try_element_at("route.intent", F.lit(1)).alias("intent"))
    return t.groupBy("key").agg(F.min(F.struct("category", "intent")).alias("r")).select("key", "r.*")


def fifth(records: DataFrame) -> DataFrame:
    return records.agg(F.floor(F.count("*") / 5).cast("long").alias("n"))


def found(teacher: DataFrame, targets: DataFrame) -> DataFrame:
    """p6_found: the targets that can't be met, by the final counts of the reservoirs."""
    r = teacher_records(teacher)
    return shortfalls(r, targets, fifth(r)).where("missing > 0").select(F.col("target_id").cast("int").alias("target_id"))
