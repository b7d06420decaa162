"""The few parts that recursion or Python notation keeps out of the JVM (F27, F28, G5, G6): Arrow batches, never row by row calls."""

from __future__ import annotations

import ast
import json
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions import answers as A


def flat_text(value: object, order: list[str] | None = None) -> str:
    """Nested values as sentences, "key: text." for members, in the given key order first."""
    if value is None:
        return ""
    if isinstance(value, str):
        s = value.strip()
        try:
            return flat_text(json.loads(s), order)
        except (ValueError, RecursionError):
            return s
    closed = lambda t: t if not t or t.endswith((".", "!", "?")) else t + "."
    if isinstance(value, dict):
        keys = [k for k in order or [] if k in value]
        keys += [k for k in value if k not in keys]
        parts = ((k, flat_text(value[k])) for k in keys)
        return " ".join(closed(f"{k}: {t}".strip()) for k, t in parts if t)
    if isinstance(value, list):
        return " ".join(t for t in (closed(flat_text(v)) for v in value) if t)
    return str(value)


@F.pandas_udf(StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """a value or its JSON text as plain sentences; null gives an empty text."""
    return text.map(lambda t: flat_text(None if t is None or t is pd.NA or t != t else t), na_action=None).astype(object)


def reordered(text: Column, keys: Column) -> Column:
    """the members of a JSON object in the order of keys, the others behind, without nulls among those."""

    @F.pandas_udf(StringType())
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        def one(t: object, k: object) -> object:
            try:
                d = json.loads(t)
            except (TypeError, ValueError):
                return None
            if not isinstance(d, dict):
                return None
            first = [x for x in (k if k is not None else []) if x in d]
            return json.dumps({x: d[x] for x in first} | {x: v for x, v in d.items() if x not in first and v is not None}, ensure_ascii=False)

        return pd.Series([one(a, b) for a, b in zip(t, k, strict=True)], dtype=object)

    return run(text, keys)


def clean_answer(t: Column) -> Column:
    """a number (whole ones without decimals), else the plain text of the value."""
    n = A.float_of(t)
    number = A.let(n, lambda n: F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))))
    return F.coalesce(number, plain_text(t))


@F.pandas_udf(StringType())
def literal_json(text: pd.Series) -> pd.Series:
    """JSON of a text that is a JSON object, or a Python dict in literal notation; else null."""

    def one(t: object) -> str | None:
        if not isinstance(t, str):
            return None
        try:
            x = json.loads(t)
        except (ValueError, RecursionError):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", SyntaxWarning)
                    x = ast.literal_eval(t)
            except Exception:  # noqa: BLE001
                return None
        try:
            return json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else None
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t) for t in text], dtype=object)


def parsed_output(reply: Column) -> Column:
    """struct(rationale, ans, payload) of a model's reply: its object (strict, then literal), else the answer by tag, field, cue or last number."""

    def of(x: Column) -> Column:
        reply, payload = x["reply"], x["payload"]
        rationale = F.get_json_object(payload, "$.rationale")
        ans = A.let(A.json_ans(payload), lambda a: A.teacher_token(a["text"]))
        loose = F.coalesce(A.let(A.teacher_choice(reply), lambda c: F.when(c.isNotNull(), A.normal("s", s=c))), A.teacher_token(A.tagged(reply)))
        last = A.teacher_number(A.last_number(F.replace(reply, F.lit(","), F.lit(""))))
        fallback = A.let(loose, lambda v: F.struct(F.when(v.isNull() & last.isNotNull(), reply).alias("rationale"), F.coalesce(v, last).alias("ans"), F.lit(None).cast("string").alias("payload")))
        return F.when(payload.isNotNull(), F.struct(rationale.alias("rationale"), ans.alias("ans"), payload.alias("payload"))).otherwise(fallback)

    return A.let(F.struct(reply.alias("reply"), literal_json(A.fenced(reply)).alias("payload")), of)
