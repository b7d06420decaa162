"""Deeply nested records to related flat tables.

Each record is stream-parsed into (path, ordinals, value) triples: one pass over its tokens with an explicit stack, so depth is no
limit and no object tree is built. Paths are grouped by their innermost repeated ancestor, and each group is pivoted into one table
whose rows keep the record's key, the ordinals of all repeated ancestors (the link to the parent row) and their own position.

Path notation: members are joined by ".", "[]" marks the elements of an array, "{}" the members of an object whose keys are data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = "path string, ordinals array<int>, names array<string>, kind string, value string"

_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')
_SPACE = re.compile(r"[ \t\r\n]*")


class Incomplete(ValueError):
    """The text ends early or isn't JSON."""


def _text(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def triples_of(text: str, *, open_objects: frozenset[str] = frozenset(), embedded: frozenset[str] = frozenset(), lists: frozenset[str] = frozenset(), prefix: str = "") -> list[tuple]:
    """(path, ordinals, names, kind, value) of every node of a complete JSON object, in the order of the text.

    kind: object, array, string, number, boolean, null. names holds the keys of open objects on the way, null for array elements.
    A text at a path in `embedded` that is itself a complete JSON object or array is parsed in place. A lone text at a path in `lists`
    counts as an array of one, a blank one as an empty array. Of a key that an object has twice, the last counts. Raises Incomplete
    for anything else than one complete object.
    """
    out: list[tuple | None] = []
    # a frame: closing sign, path, ordinals, names, next ordinal, where each key's triples begin, open object?
    stack: list[list] = []
    at, end = 0, len(text)
    want = "value"  # value, first (value or end of array), key, first key, colon, next
    path, ords, names = prefix, (), ()
    started = False
    while True:
        if started and not stack:
            if _SPACE.match(text, at).end() != end:
                raise Incomplete
            return [t for t in out if t is not None]
        m = _TOKEN.match(text, at)
        if m is None:
            raise Incomplete
        at = m.end()
        sign, string, number, word = m.groups()
        if want == "colon":
            if sign != ":":
                raise Incomplete
            want = "value"
            continue
        if want == "next":
            top = stack[-1]
            if sign == ",":
                if top[0] == "}":
                    want = "key"
                else:
                    want = "value"
                    path, ords, names = top[1] + "[]", (*top[2], top[4]), (*top[3], None)
                    top[4] += 1
                continue
            if sign != top[0]:
                raise Incomplete
            stack.pop()
            continue
        if want in ("key", "first key"):
            top = stack[-1]
            if string is None:
                if sign == "}" and want == "first key":
                    stack.pop()
                    want = "next"
                    continue
                raise Incomplete
            key = _text(string)
            if (span := top[5].get(key)) is not None:  # said before: forget what it was
                out[span : len(out)] = [t if not t or not _under(t, top, key) else None for t in out[span:]]
            top[5][key] = len(out)
            if top[6]:
                path, ords, names = top[1] + "{}", (*top[2], top[4]), (*top[3], key)
            else:
                path, ords, names = f"{top[1]}.{key}" if top[1] else key, top[2], top[3]
            top[4] += 1
            want = "colon"
            continue
        if want == "first" and sign == "]":
            stack.pop()
            want = "next"
            continue
        if sign == "{" or sign == "[":
            if not started and sign != "{":
                raise Incomplete
            started = True
            if sign == "{":
                out.append((path, ords, names, "object", None))
                stack.append(["}", path, ords, names, 0, {}, path in open_objects])
                want = "first key"
            else:
                out.append((path, ords, names, "array", None))
                stack.append(["]", path, ords, names, 1, {}, False])
                path, ords, names = path + "[]", (*ords, 0), (*names, None)
                want = "first"
            continue
        if sign is not None or not started:
            raise Incomplete
        if string is not None:
            s = _text(string)
            inner = _inner(s, path, ords, names, open_objects, embedded, lists) if path in embedded else None
            if inner is not None:
                out += inner
            else:
                p, o, n = path, ords, names
                while p in lists and o is not None:
                    out.append((p, o, n, "array", None))
                    p, o, n = (p + "[]", (*o, 0), (*n, None)) if s.strip() else (p, None, n)
                if o is not None:
                    out.append((p, o, n, "string", s))
        elif number is not None:
            out.append((path, ords, names, "number", number))
        else:
            out.append((path, ords, names, "null" if word == "null" else "boolean", None if word == "null" else word))
        want = "next"


def _under(t: tuple, frame: list, key: str) -> bool:
    """Whether a triple belongs to `key` of the object of the frame."""
    n = len(frame[2])
    if t[1][:n] != frame[2]:
        return False
    if frame[6]:
        return t[0].startswith(frame[1] + "{}") and t[2][n : n + 1] == (key,)
    p = f"{frame[1]}.{key}" if frame[1] else key
    return t[0] == p or t[0].startswith((p + ".", p + "[", p + "{"))


def _inner(s: str, path: str, ords: tuple, names: tuple, open_objects: frozenset[str], embedded: frozenset[str], lists: frozenset[str]) -> list[tuple] | None:
    if not s.lstrip()[:1] == "{":
        return None
    try:
        got = triples_of(s, open_objects=open_objects, embedded=embedded - {path}, lists=lists, prefix=path)
    except Incomplete:
        return None
    return [(p, (*ords, *o), (*names, *n), k, v) for p, o, n, k, v in got]


def first_present(found: list[tuple], name: str, places: Sequence[str]) -> list[tuple]:
    """Rename the first of several places that holds something (not null, not empty) to `name`; leave out the others."""
    here = {p: [t for t in found if t[0] == p or t[0].startswith((p + ".", p + "[", p + "{"))] for p in places}
    pick = next((p for p in places if len(here[p]) > 1 or (here[p] and here[p][0][3] not in ("null", "object", "array") and (here[p][0][4] or "").strip())), None)
    gone = {id(t) for ts in here.values() for t in ts}
    kept = [t for t in found if id(t) not in gone]
    return kept + ([(name + t[0][len(pick) :], *t[1:]) for t in here[pick]] if pick else [])


def triples(
    records: DataFrame, key: str, text: str, *, open_objects: Sequence[str] = (), embedded: Sequence[str] = (), lists: Sequence[str] = (), alternatives: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """key and the triples of each record's JSON. Texts that are null or not one complete JSON object give no rows.

    alternatives: name -> places; the first place that holds something is renamed to the name. Nothing is shuffled.
    """
    opened, inside, listed, alt = frozenset(open_objects), frozenset(embedded), frozenset(lists), dict(alternatives or {})
    src = records.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], ([], [], [], [], [])
            for i, s in enumerate(batch.column(1).to_pylist()):
                try:
                    found = triples_of(s, open_objects=opened, embedded=inside, lists=listed)
                except Incomplete:
                    continue
                for name, places in alt.items():
                    found = first_present(found, name, places)
                at += [i] * len(found)
                for t in found:
                    for c, x in zip(cols, t, strict=True):
                        c.append(x)
            types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["key", "path", "ordinals", "names", "kind", "value"]
            )

    return src.mapInArrow(parse, f"key {src.schema['key'].dataType.simpleString()}, {TRIPLE}")


def repeated_ancestor(path: Column) -> Column:
    """The path up to its last "[]" or "{}"; empty for values that occur once in a record."""
    return F.regexp_extract(path, r"^(.*(?:\[\]|\{\}))", 1)


def pivots(found: DataFrame, columns: dict[str, dict[str, str]]) -> DataFrame:
    """The tables of several repeated ancestors, one below the other: key, ancestor, ordinals (of all ancestors: the link to the parent
    row), name (of the member, in open objects), value (of an element that is no object), and all columns.

    columns: ancestor -> name -> path below it. One row for each element, with nulls for what it lacks. Triples are grouped by their
    repeated ancestor and the ordinals, in one aggregation for all tables, combined before the shuffle; those that no table
    asks for are left out first.
    """
    p, a = F.col("path"), F.col("ancestor")
    names = dict.fromkeys(c for cs in columns.values() for c in cs)
    of = {c: [f"{x}.{cs[c]}" if x else cs[c] for x, cs in columns.items() if c in cs] for c in names}
    # an element has a triple of its own, so rows don't depend on which columns are asked for
    own = found.where(p.isin(*columns, *(x for paths in of.values() for x in paths))).withColumn("ancestor", repeated_ancestor(p))
    aggs = [F.max(F.try_element_at("names", F.lit(-1))).alias("name"), F.max(F.when((p == a) & (a != ""), F.col("value"))).alias("value")]
    return own.groupBy("key", "ancestor", "ordinals").agg(*aggs, *[F.max(F.when(p.isin(*paths), F.col("value"))).alias(c) for c, paths in of.items()])


def pivot(found: DataFrame, ancestor: str, columns: dict[str, str]) -> DataFrame:
    """The table of one repeated ancestor: key, ordinals, name, value, and columns (name -> path below the ancestor); see pivots()."""
    return pivots(found, {ancestor: columns}).drop("ancestor", *(() if ancestor else ("name", "value")))


def explore(found: DataFrame) -> DataFrame:
    """(ancestor, path, kind, n): which tables and columns the records hold. Counts are combined before the shuffle."""
    return found.groupBy(repeated_ancestor(F.col("path")).alias("ancestor"), "path", "kind").agg(F.count("*").alias("n"))


ROUTES = ("reasoning_path_bank", "route", "response_payload.route")
# What the tables of second-round records are called: ancestor -> (child, column of the name, if it isn't the element itself).
SECOND_ROUND = {
    "bank.intent[]": ("bank_intent", None),
    "bank.reasoning_path[]": ("bank_path", None),
    "bank.reasoning_path_options[][]": ("bank_option", None),
    "reasoning_path_final.intent[]": ("final_intent", None),
    "reasoning_path_final.reasoning_path[]": ("final_path", None),
    "rationale{}": ("rationale", "name"),
    "rationale[]": ("rationale", "step"),
    "rationale{}.checks[]": ("check", "expr"),
    "rationale[].checks[]": ("check", "expr"),
    "samples[]": ("sample", "pred"),
}
LISTS = ("intent", "reasoning_path", "reasoning_path_options", "reasoning_path_options[]")


def latest(second_round: DataFrame) -> DataFrame:
    """One delivery of each record: the last that has a payload. Rows without an id are left out."""
    best = F.max_by("payload", F.struct(F.col("payload").isNotNull(), "received_at", F.xxhash64("payload")))
    return second_round.where("record_id is not null").groupBy("record_id").agg(best.alias("payload"))


def second_round_triples(second_round: DataFrame) -> DataFrame:
    return triples(
        latest(second_round), "record_id", "payload", open_objects=["rationale"], embedded=[*ROUTES, "response_payload", "reasoning_path_final"],
        lists=[f"{r}.{x}" for r in (*ROUTES, "reasoning_path_final") for x in LISTS], alternatives={"bank": ROUTES},
    )


def second_round_children(second_round: DataFrame) -> DataFrame:
    """p4_found: (record_id, child, outer_pos, pos, name), one row for each element of the nested lists of a record.

    A lone text is a list of one (an empty one of none); an element that isn't an object is its own name; outer_pos is 0 unless
    the element lies in an option or a step. A null element is a row with a null name.
    """
    named = {a: c for a, (_, c) in SECOND_ROUND.items()}
    t = pivots(second_round_triples(second_round), {a: {c: c} if c not in (None, "name") else {} for a, c in named.items()})
    a = F.col("ancestor")
    child, name = F.lit(None).cast("string"), F.col("value")
    for ancestor, (called, column) in SECOND_ROUND.items():
        child = F.when(a == ancestor, called).otherwise(child)
        name = F.when(a == ancestor, F.col(column)).otherwise(name) if column else name
    # an element of two repeated ancestors lies in the outer one
    two = F.size("ordinals") > 1
    outer, pos = F.when(two, F.get("ordinals", F.lit(0))).otherwise(0), F.element_at("ordinals", -1)
    return t.select(F.col("key").alias("record_id"), child.alias("child"), outer.cast("int").alias("outer_pos"), pos.cast("int").alias("pos"), name.alias("name"))
