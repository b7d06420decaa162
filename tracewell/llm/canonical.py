"""Mapping free-entered labels to a canonical list.

Method: token-level repair. Every distinct value is cut into tokens, and values of the same tokens are one case. Each distinct token is
joined to the reference vocabulary: by itself, its stem or its beginning, and if it is no word of the list, by edit distance (segment
filter, then exact distance). The repaired tokens are combined by soft TF-IDF to rank the complete entries. The vocabulary also holds
each entry written without spaces ("compound" forms); cases that their tokens leave open meet these by the same join, first within one
edit and, where a farther form could still be better, within all edits allowed.

The edit-distance join has no cross product: a token within d edits of a word shares one of 2d + 1 segments of the word,
shifted by at most d places, so both sides meet in an equi-join on (kind, edits, word length, segment number, segment).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tracewell.session import bounded, spread, written

# Function words, which carry no weight.
FUNCTION_WORDS = frozenset("a an the and or of by to for in into on from with per at as is are that when".split())

# Words people put around a label.
BEFORE = r"(?:step\s*\d+\s*[:.)-]|topic\s*:|category\s*:|intent\s*:|about\s|the\s|\[\d+\]|#\d+|\d+\s*[.)_:])"
AFTER = r"(?:\((?:general|basic|misc)\)|\sproblems|\s-\s(?:basic|general|advanced)|[!?;:*]+)"

# Entries that stand for "nothing given".
PLACEHOLDERS = frozenset("n/a na none null nil unknown other misc general todo tbd see notes - -- ? ?? ??? x step thinking".split()) | {"see notes"}

# Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіјѕԁԛԝһкмтвнАЕОРСУХІЈЅКМТВНαονιρτκΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "aeopcyxijsdqwhkmtbhAEOPCYXIJSKMTBHaoviptkABEHIKMNOPTXYZ", strict=True))

# Words that mean the same in front of or within a label.
SAME = (
    "draw make sketch", "all every each", "spot notice recognize", "compute calculate", "assign name", "identify determine",
    "select choose pick", "last units final", "set write", "check verify test", "find get", "compare weigh", "list enumerate",
    "convert change conversion", "estimate guess", "explain clarify", "split divide", "share distribute", "recall remember", "use apply",
    "restate repeat", "reject discard", "eliminate discard", "locate find", "sort order", "match pair", "build construct",
    "read inspect", "reduce simplify", "round approximate", "deduct subtract", "extend continue", "combine merge",
)

MAX_VOCABULARY = 20_000
MAX_FORMS = 200_000
ACCEPT = 0.72
SETTLED = 0.999  # a case whose tokens make up a whole entry


def fold(value: str) -> str:
    """Compatibility form without accents, zero-width signs and lookalikes of other scripts."""
    s = unicodedata.normalize("NFKC", value)
    s = "".join(LOOKALIKE.get(c, c) for c in s)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", s).strip()


def strip_decoration(s: str) -> str:
    """Take off numbers, lead-in words and remarks around the label; never leaves nothing."""
    for pattern in (rf"^{BEFORE}\s*", rf"\s*{AFTER}$"):
        while (m := re.search(pattern, s, re.I)) and len(rest := (s[: m.start()] + s[m.end() :]).strip()) >= 2:
            s = rest
    return s


def tokens(value: str) -> list[str]:
    """Lower-case words of a label; the dot of an abbreviation is kept at its word. CamelCase is cut."""
    s = strip_decoration(fold(value))
    dots = s.count(".") == 1 or " " in s or "_" in s or "-" in s or "/" in s
    s = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s)
    s = re.sub(r"\s+/\s+|\s*&\s*", " and ", s)
    out = re.findall(r"[a-z]+\.?" if dots else r"[a-z]+", s.lower())
    return out


def stem(w: str) -> str:
    """Crude English stem: plural, -ing, -ed, -ly and a final e or doubled letter."""
    for end in ("ingly", "edly", "ing", "ed", "ly", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == "e" else w


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (swaps count once), most + 1 if larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        low = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
            low = min(low, d)
        if low > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def budget(n: int, compound: bool) -> int:
    """Edits allowed to a vocabulary word of n letters."""
    return (3 if n >= 12 else 2) if compound else (0 if n <= 2 else 1 if n <= 4 else 2)


def segments(word: str, edits: int) -> list[tuple[int, int, str]]:
    """(number, start, text) of 2 * edits + 1 pieces of nearly equal length, single letters in short words (each swap of two letters may fall into two of them)."""
    k, out, at = min(2 * edits + 1, max(1, len(word))), [], 0
    for i in range(k):
        n = (len(word) - at) // (k - i)
        out.append((i, at, word[at : at + n]))
        at += n
    return out


def probes(token: str, compound: bool, most: int = 3) -> list[tuple[int, int, int, str]]:
    """(edits, word length, segment number, text) under which a vocabulary word within `most` edits of the token is filed."""
    out = set()
    for n in range(max(1, len(token) - 3), len(token) + 4):
        e = min(most, budget(n, compound))
        if abs(n - len(token)) > e:
            continue
        for i, at, piece in segments("x" * n, e):
            for start in range(max(0, at - e), min(len(token) - len(piece), at + e) + 1):
                out.add((e, n, i, token[start : start + len(piece)]))
    return list(out)


def synonyms() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for group in map(str.split, SAME):
        for w in group:
            out.setdefault(stem(w), set()).update(group)
    return out


def compounds(words: list[str], same: dict[str, set[str]]) -> dict[str, float]:
    """Ways to write an entry in one piece, with how sure each is: whole, without function words, turned, with a synonym, abbreviated, verb in -ing."""
    content = [w for w in words if w not in FUNCTION_WORDS]
    out: dict[str, float] = {}

    def put(ws: list[str], sure: float) -> None:
        s = "".join(ws)
        if len(s) >= 5:
            out[s] = max(out.get(s, 0), sure)

    put(words, 1.0)
    put(content, 0.98)
    for base in (words, content):
        for i in range(1, len(base)):
            put(base[i:] + base[:i], 0.95)
    for i, w in enumerate(words):
        for o in same.get(stem(w), ()):
            if o != w and w not in FUNCTION_WORDS:
                put([*words[:i], o, *words[i + 1 :]], 0.92)
                if i == 0:
                    put([o, "the", *words[1:]], 0.91)
    if len(content) == 2:
        put([content[1], "that", "are", content[0]], 0.92)
        put([content[1], "of", content[0]], 0.92)
    first = words[0]
    for ing in {first + "ing", first.rstrip("e") + "ing", first + first[-1] + "ing"}:
        put([ing, *words[1:]], 0.97)
    for i, w in enumerate(words):
        for n in range(3, len(w)):
            if w not in FUNCTION_WORDS:
                put([*words[:i], w[:n], *words[i + 1 :]], 0.9)
    return out


FORM = "kind string, form string, word string, compound boolean, edits boolean, short boolean, sim double"
FILED = FORM + ", d int, n int, seg int, piece string"
KEYED = "kind string, value string, key string"
EXACT = -1  # the "edits" under which forms are filed that take none


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every way a vocabulary word may be written: itself (with edits), its beginnings, its stem, its synonyms, its compounds."""
    same = synonyms()
    for pdf in batches:
        rows = set()
        for kind, label_id, label in zip(pdf["kind"], pdf["label_id"], pdf["label"], strict=True):
            ws = [w.rstrip(".") for w in tokens(label)] if label else []
            for w in ws:
                rows.add((kind, w, w, False, True, False, 1.0))
                if w not in FUNCTION_WORDS:
                    rows.add((kind, "~" + stem(w), w, False, False, False, 0.97))
                    rows |= {(kind, w[:n] + ".", w, False, False, True, 0.9) for n in range(2, len(w))}
                    rows |= {(kind, "~" + stem(o), w, False, False, False, 0.93) for o in same.get(stem(w), ()) if stem(o) != stem(w)}
            for c, sure in compounds(ws, same).items() if ws else ():
                rows.add((kind, c, f"={label_id}", True, True, False, sure))
        filed = []
        for r in rows:
            filed.append((*r, EXACT, 0, 0, r[1]))
            if r[4]:
                most = budget(len(r[1]), r[3])
                for e in sorted({min(1, most), most}) if r[3] else [most]:
                    filed += [(*r, e, len(r[1]), i, piece) for i, _, piece in segments(r[1], e)]
        yield pd.DataFrame(filed, columns=[c.split()[0] for c in FILED.split(", ")])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens of each value as one text; empty for a placeholder and for a value without letters."""
    for pdf in batches:
        keys = ["" if re.sub(r"\s*\d+$", "", fold(v).lower()) in PLACEHOLDERS else " ".join(tokens(v)) for v in pdf["value"]]
        yield pd.DataFrame({"kind": pdf["kind"], "value": pdf["value"], "key": keys})


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, 3) for x, y in zip(a, b, strict=True)], dtype="int32")


def near(asked: DataFrame, forms: DataFrame, compound: bool, most: int = 3) -> DataFrame:
    """(kind, token, dot, word, short, sim) of the forms within `most` edits of each distinct (kind, token, dot)."""

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, dot, *p) for k, t, dot in zip(pdf["kind"], pdf["token"], pdf["dot"], strict=True) for p in probes(t, compound, most)]
            yield pd.DataFrame(rows, columns=["kind", "token", "dot", "d", "n", "seg", "piece"])

    # few short rows that cost much work each: spread over all tasks
    p = spread(asked, "kind", "token").mapInPandas(probed, "kind string, token string, dot boolean, d int, n int, seg int, piece string")
    own = forms.where((F.col("compound") == compound) & F.col("edits") & (F.col("d") != EXACT)).drop("compound", "edits")
    n = F.length("form")
    allowed = (F.when(F.col("sim") <= 0.9, 1).when(n >= 12, 3).otherwise(2)) if compound else F.when(n <= 2, 0).when(n <= 4, 1).otherwise(2)
    allowed = F.least(allowed, F.lit(most))
    met = p.join(own, ["kind", "d", "n", "seg", "piece"]).select("kind", "token", "dot", "form", "word", "short", "sim")
    # a swap is one edit here and two to the built-in distance, which sorts out most pairs first
    met = spread(met.where(F.levenshtein("token", "form", 6).between(0, 2 * allowed)), "kind", "token").distinct()
    # a slip costs less in a long word
    loss = (1.4 if compound else 0.9) * F.col("e") / n
    return met.withColumn("e", _edits("token", "form")).where(F.col("e") <= allowed).select("kind", "token", "dot", "word", "short", F.greatest(F.lit(0.05), F.col("sim") - loss).alias("sim"))


def repairs(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(kind, token, dot, word, short, sim): vocabulary words that each distinct (kind, token, dot) may have meant."""

    def written_as(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, token, dot in zip(pdf["kind"], pdf["token"], pdf["dot"], strict=True):
                rows += [(kind, token, dot, x) for x in (token, "~" + stem(token), *([token + "."] if dot or len(token) >= 4 else []))]
            yield pd.DataFrame(rows, columns=["kind", "token", "dot", "piece"])

    whole = forms.where((F.col("d") == EXACT) & ~F.col("compound")).select("kind", "piece", "word", "short", "sim")
    same = asked.mapInPandas(written_as, "kind string, token string, dot boolean, piece string").join(whole, ["kind", "piece"])
    same = same.select("kind", "token", "dot", "word", "short", (F.col("sim") - F.when(F.col("short") & ~F.col("dot"), 0.05).otherwise(0.0)).alias("sim"))
    known = whole.where(~F.startswith("piece", F.lit("~")) & ~F.col("short")).select("kind", F.col("piece").alias("token")).distinct()
    both = same.unionByName(near(asked.join(known, ["kind", "token"], "left_anti"), forms, False))
    best = F.max(F.struct("sim", "short"))
    return both.groupBy("kind", "token", "dot", "word").agg(best.alias("b")).select("kind", "token", "dot", "word", "b.sim", "b.short")


def rank(n_tokens: list[str], hits: list[tuple[int, str, float, bool]], postings: dict[str, list[int]], entries: dict[int, dict[str, float]]) -> tuple[int, float]:
    """The best entry and its soft TF-IDF similarity; 0 if none is near enough.

    hits: (token number or -1 for the value in one piece, word or "=label_id", similarity, abbreviation?). entries: weight of each word of an entry.
    """
    most = max((w for e in entries.values() for w in e.values()), default=1.0)
    light = 0.15
    best: dict[int, float] = {}
    by_entry: dict[int, list[tuple[float, int, str, bool]]] = {}
    weight = [light if t in FUNCTION_WORDS else most for t in n_tokens]
    for i, word, sim, short in hits:
        if i < 0:
            entry = int(word[1:])
            best[entry] = max(best.get(entry, 0.0), sim)
        else:
            for entry in postings.get(word, ()):
                by_entry.setdefault(entry, []).append((sim, i, word, short))
    for entry, found in by_entry.items():
        words = entries[entry]
        used_i: dict[int, tuple[float, float, bool]] = {}
        used_w: set[str] = set()
        for sim, i, word, short in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if i not in used_i and word not in used_w:
                used_i[i] = (sim, words[word], short)
                used_w.add(word)
        norm_e = sum(w * w for w in words.values()) ** 0.5
        norm_v = sum((used_i[i][1] if i in used_i else w) ** 2 for i, w in enumerate(weight)) ** 0.5
        dot = sum(sim * w * w for sim, w, _ in used_i.values())
        score = dot / (norm_e * norm_v) if norm_e and norm_v else 0.0
        # the end of a label names its matter: all of it met and only the first word strange is a hit of its own
        best[entry] = max(best.get(entry, 0.0), score)
        rest = [w for w in list(words)[1:] if w not in FUNCTION_WORDS]
        shortened = any(short for *_, short in used_i.values())
        unmet = [t for i, t in enumerate(n_tokens) if i not in used_i and t not in FUNCTION_WORDS]
        if rest and len(unmet) <= 1 and all(w in used_w for w in rest) and all(len(postings[w]) == 1 for w in rest) and min(s for s, *_ in used_i.values()) >= 0.82 and not shortened:
            best[entry] = max(best[entry], 0.8)
    order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    if not order or order[0][1] < ACCEPT or (len(order) > 1 and order[1][1] > order[0][1] - 0.005):
        return 0, order[0][1] if order else 0.0
    return order[0]


HITS = "array<struct<i:int,word:string,sim:double,short:boolean>>"


def _ranked(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, key, label_id, score) of cases (kind, key, hits). The list goes along as one object if it is no longer than MAX_VOCABULARY entries,
    else the list of a kind is joined to its cases."""
    rows = labels.select("kind", "label_id", "label").limit(MAX_VOCABULARY + 1).collect()
    small = len(rows) <= MAX_VOCABULARY
    lists: dict[str, list[tuple[int, str]]] = {}
    for r in rows if small else ():
        lists.setdefault(r["kind"], []).append((r["label_id"], r["label"]))
    bc = cases.sparkSession.sparkContext.broadcast(lists)
    if not small:
        cases = cases.join(labels.groupBy("kind").agg(F.collect_list(F.struct("label_id", "label")).alias("entries")), "kind", "left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prepared: dict[str, tuple] = {}
        for pdf in batches:
            rows = []
            listed = pdf["entries"] if "entries" in pdf else [None] * len(pdf)
            for kind, key, hs, es in zip(pdf["kind"], pdf["key"], pdf["hits"], listed, strict=True):
                if kind not in prepared:
                    prepared[kind] = _prepare([(int(e["label_id"]), e["label"]) for e in es] if es is not None else bc.value.get(kind, []))
                words = [t.rstrip(".") for t in key.split(" ")]
                got = [(h["i"], h["word"], h["sim"], h["short"]) for h in hs] if hs is not None else []
                rows.append((kind, key, *rank(words, got, *prepared[kind])))
            yield pd.DataFrame(rows, columns=["kind", "key", "label_id", "score"])

    return cases.mapInPandas(decide, "kind string, key string, label_id long, score double")


def map_labels(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, value, label_id, score) for each distinct (kind, value) of `values`; label_id 0 means no entry.

    values: kind, value. labels: label_id, kind, label. Nulls and blank values give no row; an exact label gives itself
    with score 1. Ties between two entries give 0. An empty list maps all to 0. Other columns are ignored.
    """
    v = values.select("kind", "value").where(F.trim("value") != "").distinct()
    lab = labels.select("kind", F.col("label_id").cast("bigint").alias("label_id"), "label").where("label is not null")
    keyed = written(spread(v, "kind", "value").mapInPandas(_keyed, KEYED), "labels")
    forms = written(spread(lab, "kind", "label").mapInPandas(_forms, FILED).distinct(), "forms")
    forms = bounded(forms, MAX_FORMS)
    keys = keyed.where("key <> ''").select("kind", "key").distinct()
    plain = lambda t: F.regexp_replace(t, "\\.$", "")
    cut = keys.select("kind", "key", F.posexplode(F.split("key", " ")).alias("i", "t")).select("kind", "key", "i", plain(F.col("t")).alias("token"), F.endswith("t", F.lit(".")).alias("dot"))
    rep = repairs(cut.select("kind", "token", "dot").where("token <> ''").distinct(), forms)
    hit = F.struct("i", "word", "sim", "short")
    cases = written(cut.join(rep, ["kind", "token", "dot"], "left").groupBy("kind", "key").agg(F.collect_set(F.when(F.col("word").isNotNull(), hit)).alias("hits")), "cases")
    first = written(_ranked(cases, lab), "ranked")
    # a case that its tokens leave open is ranked once more
    open_ = cases.join(first.where(F.col("score") < SETTLED), ["kind", "key"], "left_semi").select("kind", "key", "hits", F.regexp_replace("key", "[ .]", "").alias("token")).where("token <> ''")
    glued = open_.select("kind", "token", F.lit(True).alias("dot")).distinct()
    whole = forms.where((F.col("d") == EXACT) & F.col("compound")).select("kind", F.col("piece").alias("token"), "word", "short", "sim")
    one = written(glued.join(whole, ["kind", "token"]).select("kind", "token", "dot", "word", "short", "sim").unionByName(near(glued, forms, True, 1)), "one_edit")
    # forms two edits away come to no more than this
    farther = 1 - 2.8 / (F.length("token") + 3)
    done = one.groupBy("kind", "token").agg(F.max("sim").alias("best")).where(F.col("best") > farther + 0.005).select("kind", "token")
    far = near(glued.join(done, ["kind", "token"], "left_anti"), forms, True)
    pieces = one.unionByName(far).groupBy("kind", "token", "word").agg(F.max("sim").alias("sim"))
    pieces = pieces.groupBy("kind", "token").agg(F.collect_list(F.struct(F.lit(-1).alias("i"), "word", "sim", F.lit(False).alias("short"))).alias("more"))
    again = open_.join(pieces, ["kind", "token"], "left").select("kind", "key", F.concat(F.coalesce("hits", F.array().cast(HITS)), F.coalesce("more", F.array().cast(HITS))).alias("hits"))
    settled = first.where(F.col("score") >= SETTLED).select("kind", "key", "label_id", "score").unionByName(_ranked(again, lab))
    exact = lab.groupBy("kind", F.col("label").alias("value")).agg(F.max("label_id").alias("own"))
    out = keyed.join(settled, ["kind", "key"], "left").join(bounded(exact, MAX_VOCABULARY), ["kind", "value"], "left")
    return out.select("kind", "value", F.coalesce("own", "label_id", F.lit(0)).cast("long").alias("label_id"), F.when(F.col("own").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def _prepare(entries: list[tuple[int, str]]) -> tuple[dict[str, list[int]], dict[int, dict[str, float]]]:
    split = {i: list(dict.fromkeys(t.rstrip(".") for t in tokens(label))) for i, label in entries}
    postings: dict[str, list[int]] = {}
    for i, ws in split.items():
        for w in ws:
            postings.setdefault(w, []).append(i)
    idf = {w: math.log(1 + len(split) / len(ids)) for w, ids in postings.items()}
    weights = {i: {w: 0.15 if w in FUNCTION_WORDS else idf[w] for w in ws} for i, ws in split.items()}
    return postings, weights


def route_entries(teacher: DataFrame) -> DataFrame:
    """(teacher_id, field, kind, pos, value): every label of a route that is not null, empty or only spaces."""
    r = F.col("route")
    row = lambda field, kind, pos, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), value.alias("value"))
    listed = lambda field, kind, name: F.transform(F.coalesce(r[name], F.array().cast("array<string>")), lambda x, i: row(field, kind, i, x))
    e = F.explode(F.concat(F.array(row("category", "category", F.lit(0), r["category"])), listed("intent", "intent", "intent"), listed("reasoning_path", "step", "reasoning_path")))
    return teacher.select("teacher_id", e.alias("e")).select("teacher_id", "e.*").where(F.trim("value") != "")


def off_list(teacher: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries that aren't exactly a label of their kind, each delivery's once; written, since they are read more than once."""
    exact = labels.select(F.col("kind"), F.col("label").alias("value")).distinct()
    return written(route_entries(teacher).join(bounded(exact, MAX_VOCABULARY), ["kind", "value"], "left_anti").distinct(), "off_list")


def found(teacher: DataFrame, labels: DataFrame) -> DataFrame:
    """p1_found: one row for each entry that isn't exactly a label of its kind, with the label meant or 0.

    Deliveries of one record count once. Only the entries off the list are shuffled, and only distinct ones are repaired.
    """
    off = off_list(teacher, labels)
    mapped = map_labels(off, labels).select("kind", "value", "label_id")
    return off.join(mapped, ["kind", "value"]).select("teacher_id", "field", "pos", "label_id").distinct()


def report(teacher: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each stored value off the list occurs, its label, and a score: label_id 0 are the unmatched ones."""
    off = off_list(teacher, labels)
    n = off.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return n.join(map_labels(off, labels), ["kind", "value"])
