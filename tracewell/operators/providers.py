"""Pluggable model providers (U1-U5, S17-S19, P19, T-g, M1): batches go through Arrow, a provider is built once in each worker.

No provider here reaches out of the process. A real one wraps its client in the same call and is passed in by the caller.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Completer = Callable[[str, str], str]  # (system, user) -> reply
Embedder = Callable[[list[str]], np.ndarray]  # texts -> rows


def with_retry(call: Completer, tries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Completer:
    """T-g: the call again after a failure, waits doubling; the last failure goes up."""

    def run(system: str, user: str) -> str:
        for i in range(tries):
            try:
                return call(system, user)
            except Exception:
                if i + 1 == tries:
                    raise
                sleep(first_wait * 2**i)
        raise AssertionError

    return run


def echo_completer() -> Completer:
    """A deterministic stand-in: a JSON reply with the last word of the prompt as its answer."""
    return lambda system, user: '{"rationale": {"Echo": "%d characters"}, "ans": "%s"}' % (len(user), (user.split() or [""])[-1].strip('"'))


def complete(df: DataFrame, make: Callable[[], Completer], *, system: str = "system", user: str = "user", into: str = "reply", keep: list[str]) -> DataFrame:
    """Keep and the reply to each row's prompt, null where the provider failed for good (its error in <into>_error)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*keep).dtypes) + f", `{into}` string, `{into}_error` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            out, err = [], []
            for s, u in zip(pdf["_s"], pdf["_u"], strict=True):
                try:
                    out.append(ask(s or "", u or ""))
                    err.append(None)
                except Exception as e:  # noqa: BLE001
                    out.append(None)
                    err.append(str(e))
            yield pdf[keep].assign(**{into: out, f"{into}_error": err})

    return df.select(*keep, F.col(system).alias("_s"), F.col(user).alias("_u")).mapInPandas(run, schema)


def hashing_embedder(dims: int = 64) -> Embedder:
    """M1 offline: signed hashing of words and letter triples to unit vectors. Stable, without a model, and no match for one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            low = f"  {t.lower()}  "
            for g in low.split() + [low[j : j + 3] for j in range(len(low) - 2)]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder] = hashing_embedder, into: str = "vec") -> DataFrame:
    """df's distinct texts with a vector each; join it back by text, so that a text repeated a million times is embedded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            yield pd.DataFrame({text: pdf[text], into: list(embed(pdf[text].tolist()))})

    return df.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, `{into}` array<double>")


def validated(df: DataFrame, make: Callable[[], Completer], *, key: str, reasons: Callable[[Column], Column], retry_suffix: str) -> DataFrame:
    """(key, reply, valid, reasons, retried): replies that fail get one more try with added constraints; the second result stands."""
    first = complete(df, make, keep=[key, "system", "user"]).withColumn("reasons", reasons(F.col("reply")))
    good = first.where(F.size("reasons") == 0).withColumn("retried", F.lit(False))
    bad = first.where(F.size("reasons") > 0).select(key, "system", F.concat("user", F.lit(retry_suffix)).alias("user"))
    second = complete(bad, make, keep=[key]).withColumn("reasons", reasons(F.col("reply"))).withColumn("retried", F.lit(True))
    cols = [key, "reply", "reasons", "retried"]
    return good.select(*cols).unionByName(second.select(*cols)).withColumn("valid", F.size("reasons") == 0)


def accepted_rejected(df: DataFrame, text: str, reasons: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected with reasons, counts) of one pass that adds the reasons."""
    r = df.withColumn("reasons", reasons(F.col(text)))
    ok = F.size("reasons") == 0
    return r.where(ok).drop("reasons"), r.where(~ok), r.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
