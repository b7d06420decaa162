"""Building and growing a bank of reasoning paths (P2-P9, A13-A15, A19, J7, J8, W5, M4, U-b to U-e, F39)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.answers import let
from tracewell.functions.text import strip, trim_words, words
from tracewell.operators.cluster import cluster_groups

ROUTE = "struct<category:string,intent:array<string>,difficulty:int,budget:int,reasoning_path:array<string>,reasoning_path_options:array<array<string>>>"
KEY = ["category", "intent", "reasoning_path"]


def gold_rows(df: DataFrame, flag: str = "gold_matches_answer", strict: bool = True) -> DataFrame:
    """Rows whose flag is true; strict means the truth value itself, else any value that counts as true."""
    if strict:
        return df.where(F.col(flag).eqNullSafe(F.lit(True)))
    kind = df.schema[flag].dataType.simpleString()
    return df.where(F.col(flag) if kind == "boolean" else F.col(flag) != "" if kind == "string" else F.col(flag) != 0)


def route_of_text(text: Column) -> Column:
    """A route from JSON text of an object, else null. A lone intent is wrapped into a list."""
    t = strip(text)
    lone = F.from_json(t, "struct<intent:string>")["intent"]
    listed = F.from_json(t, "struct<intent:array<string>>")["intent"]
    r = F.from_json(t, ROUTE.replace("intent:array<string>", "intent:string"))
    intent = F.coalesce(listed, F.when(lone.isNotNull() & ~lone.startswith("["), F.array(lone)))
    return F.when(t.startswith("{") & t.endswith("}") & r.isNotNull(), r.withField("intent", intent).cast(ROUTE))


def route(df: DataFrame, route_col: str = "route", payload_col: str = "response_payload") -> Column:
    """The route, from the column (struct or JSON text) or else from the payload's route; the category defaults to "unknown"."""
    kind = df.schema[route_col].dataType.simpleString()
    own = F.col(route_col).cast(ROUTE) if kind.startswith("struct") else route_of_text(F.col(route_col))
    steps = [own]
    if payload_col in df.columns:
        steps.append(route_of_text(F.get_json_object(payload_col, "$.route")))
    name = lambda r: r.withField("category", F.coalesce(F.nullif(strip(r["category"]), F.lit("")), F.lit("unknown")))
    return let(F.coalesce(*steps), lambda r: F.when(r.isNotNull(), name(r)))


def normalized_route(r: Column) -> Column:
    """P5: struct(category, intent, reasoning_path) with the first intent; null unless all three are there."""

    def of(r: Column) -> Column:
        category, intent = strip(r["category"]), strip(F.get(r["intent"], F.lit(0)))
        ok = (category != "") & (intent != "") & (F.size(r["reasoning_path"]) > 0)
        return F.when(ok, F.struct(category.alias("category"), intent.alias("intent"), r["reasoning_path"].alias("reasoning_path")))

    return let(r, of)


def base_route(r: Column) -> Column:
    """The route with the first option as its path if it has none, a budget of its length (at least 1) and the difficulty that follows."""

    def of(r: Column) -> Column:
        options = F.when(F.size(r["reasoning_path_options"]) > 0, r["reasoning_path_options"])
        path = F.coalesce(F.when(F.size(r["reasoning_path"]) > 0, r["reasoning_path"]), F.get(options, F.lit(0)), F.array().cast("array<string>"))
        intents = F.coalesce(r["intent"], F.array().cast("array<string>"))
        budget = F.greatest(F.size(path), F.lit(1))
        return F.struct(
            r["category"].alias("category"), intents.alias("intent"), F.when(budget <= 2, 1).otherwise(2).alias("difficulty"), budget.alias("budget"), path.alias("reasoning_path"), options.alias("reasoning_path_options")
        )

    return let(r, of)


def prompt_route(r: Column, k: int) -> Column:
    """The route as shown in a prompt: for k > 1 the first k distinct options instead of the path, else only the path."""
    options = let(F.array_distinct(r["reasoning_path_options"]), lambda o: F.when(F.size(o) > 0, F.slice(o, 1, max(1, k)) if k > 0 else o))
    if k > 1:
        return let(options, lambda o: F.when(o.isNotNull(), r.withField("reasoning_path_options", o).withField("reasoning_path", F.lit(None).cast("array<string>"))).otherwise(r.withField("reasoning_path_options", o)))
    return r.withField("reasoning_path_options", F.lit(None).cast("array<array<string>>"))


def path_in_bank(path: Column, base: Column) -> Column:
    """Whether a path is the route's own or one of its options."""
    options = F.coalesce(base["reasoning_path_options"], F.array().cast("array<array<string>>"))
    return F.coalesce((F.size(path) > 0) & (path.eqNullSafe(base["reasoning_path"]) | F.array_contains(options, path)), F.lit(False))


def path_source(path: Column, base: Column) -> Column:
    """Where a path comes from."""
    return F.when(path_in_bank(path, base), "reasoning_path_bank").otherwise("llm_generated")


def parse_status(rationale: Column, ans: Column) -> Column:
    """Ok if a reply gave both, else parse_error."""
    return F.when(rationale.isNotNull() & ans.isNotNull(), "ok").otherwise("parse_error")


def signatures(df: DataFrame, r: Column) -> DataFrame:
    """df with _sig, the normalised route as a joinable struct; rows without one are left out."""
    return df.withColumn("_sig", normalized_route(r)).where("_sig is not null")


def taxonomy_rows(df: DataFrame, order: str) -> DataFrame:
    """(category, intent, reasoning_path, _pos) of gold rows, one for each intent that isn't blank, repeats kept."""
    r = gold_rows(df).withColumn("_r", route(df)).where("size(_r.intent) > 0 and size(_r.reasoning_path) > 0")
    e = r.select(F.col("_r.category").alias("category"), F.posexplode("_r.intent").alias("_i", "intent"), F.col("_r.reasoning_path").alias("reasoning_path"), F.struct(F.col(order).alias("o")).alias("_o"))
    return e.select("category", strip("intent").alias("intent"), "reasoning_path", F.struct("_o.o", "_i").alias("_pos")).where("intent <> ''")


def ordered_distinct(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key by pos, other columns with it. Combined before the shuffle, not sorted."""
    rest = [c for c in df.columns if c not in keys and c != pos]
    first = F.min_by(F.struct(*rest), pos) if rest else F.lit(None)
    return df.groupBy(*keys).agg(F.min(pos).alias(pos), first.alias("_r")).select(*keys, pos, *[F.col(f"_r.{c}").alias(c) for c in rest])


def canonical_of(members: DataFrame, cluster: list[str], intent: str, pos: str) -> DataFrame:
    """(cluster..., canonical): the member with fewest words, then fewest letters, then first, cut to four words."""
    best = F.min_by(intent, F.struct(F.size(words(intent)), F.length(intent), F.col(pos)))
    return members.groupBy(*cluster).agg(best.alias("_b")).select(*cluster, trim_words(F.col("_b"), 4).alias("canonical"))


def canonical_map(members: DataFrame, clusters: DataFrame, pos: str) -> DataFrame:
    """M4: (category, intent, canonical). members: category, intent, pos; clusters: category, pos, cluster (-1 noise).

    A noise intent is its own canonical form, cut to four words. Where two clusters come to the same canonical form, the later one holds it
    and the intents of the other fall back to their own (T9): clusters come in order of their first member, noise together where it first occurs.
    """
    m = members.join(clusters, ["category", pos])
    c = canonical_of(m.where("cluster >= 0"), ["category", "cluster"], "intent", pos)
    first = m.groupBy("category", "cluster").agg(F.min(pos).alias("_first"))
    named = m.join(c, ["category", "cluster"], "left").join(first, ["category", "cluster"])
    named = named.withColumn("canonical", F.coalesce("canonical", trim_words(F.col("intent"), 4)))
    # a noise intent stands by itself: a form of its own at its own place within the noise
    place = F.struct("_first", F.when(F.col("cluster") < 0, F.col(pos)))
    holder = named.groupBy("category", "canonical").agg(F.max(place).alias("_holder"))
    held = named.join(holder, ["category", "canonical"]).where(place == F.col("_holder")).select("category", "intent", "canonical", place.alias("_place"))
    return held.groupBy("category", "intent").agg(F.max_by("canonical", "_place").alias("canonical"))


def build_bank(rows: DataFrame, vectors: DataFrame, *, eps: float = 0.25, min_samples: int = 2) -> DataFrame:
    """(category, intent, path_pos, reasoning_path) from taxonomy_rows and (intent, vec): cluster, rename, first distinct paths in order."""
    # each distinct intent once, with how often it occurs (T10) and where first
    members = rows.groupBy("category", "intent").agg(F.min("_pos").alias("_pos"), F.count("*").alias("_n"))
    clusters = cluster_groups(members.join(vectors, "intent"), group="category", key="_pos", vec="vec", weight="_n", eps=eps, min_samples=min_samples)
    names = canonical_map(members, clusters, "_pos")
    named = rows.join(names, ["category", "intent"], "left").withColumn("intent", F.coalesce("canonical", trim_words(F.col("intent"), 4))).drop("canonical")
    d = ordered_distinct(named, KEY, "_pos")
    w = Window.partitionBy("category", "intent").orderBy("_pos")
    return d.select("category", "intent", (F.row_number().over(w) - 1).cast("int").alias("path_pos"), "reasoning_path")


def summary_global(bank: DataFrame) -> DataFrame:
    """Distinct categories, intents and paths of the whole bank."""
    return bank.agg(F.count_distinct("category").alias("unique_categories"), F.count_distinct("intent").alias("unique_intents"), F.count_distinct("reasoning_path").alias("unique_reasoning_paths"))


def summary_scoped(bank: DataFrame) -> DataFrame:
    """Intents are distinct within their category, paths within their intent."""
    return bank.agg(
        F.count_distinct("category").alias("unique_categories"), F.count_distinct(F.struct("category", "intent")).alias("unique_intents"), F.count_distinct(F.struct(*KEY)).alias("unique_reasoning_paths")
    )


def merge_routes(bank: DataFrame, routes: DataFrame, order: str) -> DataFrame:
    """U-b, U-c: the bank with the routes (category, intent, reasoning_path, order) that it lacks, put behind the paths of their bucket."""
    new = ordered_distinct(routes.select(*KEY, order), KEY, order).join(bank.select(*KEY), KEY, "left_anti")
    last = bank.groupBy("category", "intent").agg(F.max("path_pos").alias("_last"))
    w = Window.partitionBy("category", "intent").orderBy(order)
    put = new.withColumn("_i", F.row_number().over(w)).join(last, ["category", "intent"], "left")
    return bank.select("category", "intent", "path_pos", "reasoning_path").unionByName(put.select("category", "intent", (F.coalesce("_last", F.lit(-1)) + F.col("_i")).cast("int").alias("path_pos"), "reasoning_path"))


def new_signatures(routes: DataFrame, known: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Routes whose signature is neither known nor pending, each once."""
    k = known.select(*KEY) if pending is None else known.select(*KEY).unionByName(pending.select(*KEY))
    return routes.dropDuplicates(KEY).join(k, KEY, "left_anti")
