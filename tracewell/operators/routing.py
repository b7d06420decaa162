"""Vector routing and similarity (J1, J2, J9, F36, U-f, A18, M6, W1, W2, W6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.answers import let
from tracewell.functions.text import path_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity as double; 0 if a vector has no length."""
    return let(norm(a) * norm(b), lambda d: F.when(d == 0, 0.0).otherwise(dot(a, b) / d))


def jaccard(a: Column, b: Column) -> Column:
    """U-f: shared share of two token sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


BLOCK_ROWS = 2048
PARTS = 8


def packed(df: DataFrame, key: str, vec: str, by: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., _keys array<bigint>, _rows bigint, _data binary): unit vectors laid together in blocks of at most `rows`, those of each `by` apart.

    A vector of no length stays as it is, so that its cosine is 0; null vectors are left out. Nothing is shuffled: a block holds rows of one partition.
    """
    d = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("_k"), F.col(vec).alias("_v"), *by)
    schema = "".join(f"`{c}` {d.schema[c].dataType.simpleString()}, " for c in by) + "_keys array<bigint>, _rows bigint, _data binary"

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list, list]] = {}

        def block(group: tuple) -> tuple:
            keys, vectors = held.pop(group)
            m = np.array(vectors, dtype=np.float64)
            n = np.sqrt((m * m).sum(1, keepdims=True))
            return (*group, keys, len(keys), (m / np.where(n > 0, n, 1.0)).tobytes())

        names = [*by, "_keys", "_rows", "_data"]
        for pdf in batches:
            out = []
            for row in pdf[["_k", "_v", *by]].itertuples(index=False):
                group = tuple(row[2:])
                keys, vectors = held.setdefault(group, ([], []))
                keys.append(row[0])
                vectors.append(row[1])
                if len(keys) >= rows:
                    out.append(block(group))
            if out:
                yield pd.DataFrame(out, columns=names)
        # what is left of each group; many small groups go out in small frames
        while held:
            yield pd.DataFrame([block(g) for g in list(held)[:256]], columns=names)

    return d.mapInPandas(lay, schema)


def best_of_blocks(pairs: DataFrame, keep: list[str], k: int, not_self: bool) -> DataFrame:
    """(keep..., _q, _p, _score): the k best candidates of each question within each pair of blocks, by one matrix product.

    Scores are rounded to 12 places, so that equal vectors tie wherever they lie in a block; ties go to the lower position.
    """
    schema = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in keep) + "_q bigint, _p bigint, _score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                q, p = np.array(row["_qk"]), np.array(row["_pk"])
                a, b = np.frombuffer(row["_qd"]).reshape(len(q), -1), np.frombuffer(row["_pd"]).reshape(len(p), -1)
                order = np.argsort(p, kind="stable")
                p, b = p[order], b[order]
                s = np.round(a @ b.T, 12)
                if not_self:
                    s[q[:, None] == p[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k] if k > 1 else s.argmax(1)[:, None]
                at = np.repeat(np.arange(len(q)), top.shape[1])
                out = pd.DataFrame({"_q": q[at], "_p": p[top.ravel()], "_score": s[at, top.ravel()]})
                out = out[np.isfinite(out["_score"])]
                for c in keep:
                    out.insert(0, c, [row[c]] * len(out))
                yield out[[*keep, "_q", "_p", "_score"]]

    return pairs.mapInPandas(score, schema)


def route_argmax(questions: DataFrame, intents: DataFrame, *, q_id: str, q_vec: str, i_pos: str, i_vec: str, label: list[str], not_self: bool = False) -> DataFrame:
    """For each question the intent of highest cosine, the first by position among equals: (q_id, label..., score). Ids are whole numbers.

    A stated set of questions is scored against all intents in blocks: both sides are packed into matrices, every block of questions meets
    every block of intents in one product, and only the best of each block goes on to the maximum. There is no bound on
    either side: the planner broadcasts the smaller blocks if they are small. not_self: a question that is itself one
    of the intents (position = id) isn't routed to itself.
    """
    q = packed(questions, q_id, q_vec, []).select(F.col("_keys").alias("_qk"), F.col("_data").alias("_qd"))
    i = packed(intents, i_pos, i_vec, []).select(F.col("_keys").alias("_pk"), F.col("_data").alias("_pd"))
    each = best_of_blocks(q.crossJoin(i), [], 1, not_self)
    best = each.groupBy("_q").agg(F.max(F.struct("_score", (-F.col("_p")).alias("_neg"))).alias("b")).select("_q", (-F.col("b._neg")).alias("_p"), F.col("b._score").alias("score"))
    named = best.join(intents.select(F.col(i_pos).cast("bigint").alias("_p"), *label), "_p")
    return named.select(F.col("_q").alias(q_id), *label, "score")


def top_k_paths(routed: DataFrame, bank: DataFrame, *, q_id: str, q_vec: str, keys: list[str], path: str, pos: str, p_vec: str, k: int, not_self: bool = False) -> DataFrame:
    """The k best paths (at least one) of the bucket each question was routed to; the first by position among equals.

    Blocks of questions meet blocks of paths of their bucket; each pair of blocks gives k candidates for each question, so no pair is ever
    shuffled. The blocks of a hot bucket are dealt out to PARTS joins.
    """
    k = max(1, k)
    q = packed(routed, q_id, q_vec, keys).select(*keys, F.col("_keys").alias("_qk"), F.col("_data").alias("_qd"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    p = packed(bank, pos, p_vec, keys).select(*keys, F.col("_keys").alias("_pk"), F.col("_data").alias("_pd"), F.pmod(F.xxhash64("_keys"), F.lit(PARTS)).cast("int").alias("_part"))
    each = best_of_blocks(q.join(p, [*keys, "_part"]), keys, k, not_self)
    w = Window.partitionBy("_q").orderBy(F.desc("_score"), F.asc("_p"))
    best = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = best.join(bank.select(F.col(pos).cast("bigint").alias("_p"), *keys, F.col(path).alias("_path")), [*keys, "_p"])
    return named.select(F.col("_q").alias(q_id), *keys, "rank", F.col("_path").alias(path), F.col("_score").alias("score"))


def mean_vector(tokens: DataFrame, vectors: DataFrame, key: str, token: str, vec: str) -> DataFrame:
    """(key, vec): the mean vector of the tokens that have one; keys without any are left out."""
    e = tokens.join(vectors, token).select(key, F.posexplode(vec).alias("_i", "_x"))
    m = e.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vec))


def path_similarity(a: Column, b: Column) -> Column:
    """M6 on struct(vec, tokens): cosine where both have a vector, else Jaccard of the token sets."""
    return F.when(a["vec"].isNotNull() & b["vec"].isNotNull(), cosine(a["vec"], b["vec"])).otherwise(jaccard(a["tokens"], b["tokens"]))


def greedy_dedup(paths: DataFrame, *, keys: list[str], path: str, pos: str, threshold: float, vec: str | None = None, similarity=path_similarity) -> DataFrame:
    """(keys..., path, pos, kept, score, near): in order of pos a path is kept unless it is `threshold` near to a kept one.

    The outcome depends on the order, so a bucket is one fold; buckets are the (category, intent) pairs of a bank, whose paths are
    distinct. The fold keeps its state in an array and never pairs paths that were removed. score is the best similarity met
    until the threshold was reached (0 if there was none), near the path it was met at.
    """
    rep = F.struct(F.col(pos).alias("pos"), F.col(path).alias("path"), (F.col(vec) if vec else F.lit(None).cast("array<double>")).alias("vec"), F.array_distinct(path_tokens(path)).alias("tokens"))
    b = paths.groupBy(*keys).agg(F.array_sort(F.collect_list(rep)).alias("_all"))
    item = b.schema["_all"].dataType.elementType
    state = f"struct<out:array<struct<pos:{item['pos'].dataType.simpleString()},path:{item['path'].dataType.simpleString()},kept:boolean,score:double,near:{item['path'].dataType.simpleString()}>>,kept:array<{item.simpleString()}>>"
    start = F.struct(F.array().alias("out"), F.array().alias("kept")).cast(state)
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(item["path"].dataType).alias("near"))

    def step(s: Column, x: Column) -> Column:
        better = lambda best, k: F.when(best["score"] >= threshold, best).otherwise(
            let(similarity(x, k), lambda v: F.when(v > best["score"], F.struct(v.alias("score"), k["path"].alias("near"))).otherwise(best))
        )
        best = F.aggregate(s["kept"], nothing, better)

        def put(best: Column) -> Column:
            keep = best["score"] < threshold
            row = F.struct(x["pos"].alias("pos"), x["path"].alias("path"), keep.alias("kept"), best["score"].alias("score"), best["near"].alias("near"))
            return F.struct(F.concat(s["out"], F.array(row)).alias("out"), F.when(keep, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept")).cast(state)

        return let(best, put)

    return b.select(*keys, F.explode(F.aggregate("_all", start, step)["out"]).alias("r")).select(*keys, F.col("r.path").alias(path), F.col("r.pos").alias(pos), "r.kept", "r.score", "r.near")


def dedup_stats(deduped: DataFrame, keys: list[str]) -> DataFrame:
    """(removed_paths, unchanged_buckets)."""
    b = deduped.groupBy(*keys).agg(F.count_if(~F.col("kept")).alias("r"))
    return b.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("removed_paths"), F.count_if(F.col("r") == 0).alias("unchanged_buckets"))
