"""Text read with the wrong character encoding.

Method: an unknown swap of code pages is a substitution cipher that a source applies to some of its words. Expectation-maximisation over
the distinct words with letters beyond ASCII, weighted by how often a source has them, learns in rounds the letter pairs of the
language (from the words as they are decoded so far, so no clean sample is needed), how often each source uses each known cipher, and,
for the words of a source that no known cipher explains, a byte-to-letter mapping of its own. Known ciphers are the pairs of a code page
the text was written in and one it was read with: swaps of several bytes (UTF-8 and the East Asian pages), which no letter mapping
can state, and single-byte pages, which serve as starting points. A mapping is learned by forward-backward over the hidden letters of
the source's unexplained words against the letter pairs. The likeliest cipher then decodes each garbled word, the single-byte ones and
the learned mappings with str.translate().

Each distinct word is decoded once under all known ciphers; its readings are written as letter pairs, and a round is an aggregation over
arrays. What is broadcast is the table of letter pairs (bounded by the letters below U+3000; others count alone), the cipher weights of each
source and the learned mappings (256 signs at most). Up to MAX_SOURCES sources are told apart; where there are more, they share weights
by hash.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import written

# Code pages a text may be written in and read with.
WESTERN = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
READ_UTF8 = ("cp1252", "latin_1", "cp1251", "cp1250", "koi8_r", "cp437", "cp850", "cp866", "mac_roman", "iso8859_2", "iso8859_5", "iso8859_15", "cp1254", "gb18030")

KEYS = (
    [("utf_8", d) for d in READ_UTF8]
    + [("utf_8+utf_8", d) for d in ("cp1252", "latin_1")]
    + [(e, d) for e in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250") for d in (*WESTERN, *CYRILLIC) if e != d and not (e in ("cp437", "cp850", "cp1250") and d not in ("cp1252", "mac_roman", "cp437", "cp850"))]
    + [(e, d) for e in CYRILLIC for d in (*CYRILLIC, "cp1252", "latin_1", "mac_roman", "cp437", "cp850") if e != d]
    + [(e, d) for e in ("gb18030", "big5", "shift_jis", "euc_kr") for d in ("cp1252", "latin_1", "cp1251", "koi8_r", "cp437")]
)

# a run of letters that holds a sign beyond ASCII; possessive and anchored, so that runs of any length cost linear time and no stack
WORD = r"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7F]++[A-Za-z]*+)++"
ROUNDS = 7
MAX_SOURCES = 4096
CLEAN = -1
OWN = len(KEYS)  # the mapping learned for a source
LEAST_SHARE = 1e-4  # a reading less likely than that gives no counts
LEAST_COUNT = 0.01  # letter pairs and weights below it are as good as unseen
EVIDENCE = -4.0  # readings that much less likely than the word itself (as a logarithm) say nothing about a document
MAPPED_WORDS = 40  # distinct unexplained words of a source from which a mapping can be learned
MAPPED_SHARE = 0.6  # of them that must become likely words by it
UNLIKELY = math.log(2e-3)  # mean probability of a letter pair below which a word is unexplained


def page(name: str) -> list[str]:
    """The 256 signs of a single-byte code page; unused places give their control sign."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Ciphers:
    """All keys, ready to decode words."""

    def __init__(self) -> None:
        single = {n for pair in KEYS for n in pair[0].split("+") + [pair[1]]} - {"utf_8", "gb18030", "big5", "shift_jis", "euc_kr"}
        self.pages = {n: page(n) for n in single}
        self.back = {n: {ord(c): chr(b) for b, c in reversed(list(enumerate(p)))} for n, p in self.pages.items()}
        self.table: dict[int, dict[int, str]] = {}
        for k, (e, d) in enumerate(KEYS):
            if e in self.pages and d in self.pages:  # letter by letter
                self.table[k] = {ord(c): self.pages[e][b] for b, c in reversed(list(enumerate(self.pages[d]))) if b >= 128}

    def as_bytes(self, word: str, read: str) -> bytes | None:
        if read == "gb18030":
            try:
                return word.encode("gb18030")
            except UnicodeEncodeError:
                return None
        try:
            return word.translate(self.back[read]).encode("latin_1")
        except UnicodeEncodeError:
            return None

    def decode(self, word: str, k: int) -> str | None:
        """The word under key k; None if it can't have come about that way."""
        e, d = KEYS[k]
        if k in self.table:
            t, back = self.table[k], self.back[d]
            if any(ord(c) > 127 and ord(c) not in back for c in word):
                return None
            out = word.translate(t)
            return out if out != word and not re.search(r"[\x80-\x9f]", out) else None
        for step in e.split("+"):
            b = self.as_bytes(word, d)
            if b is None:
                return None
            try:
                word = b.decode(step)
            except UnicodeDecodeError:
                return None
        return word if not re.search(r"[\x80-\x9f�-]", word) else None

    def readings(self, word: str) -> list[tuple[int, str]]:
        """(key, decoded) of all keys that give another text."""
        return [(k, x) for k in range(len(KEYS)) if (x := self.decode(word, k)) is not None and x != word]


def signs(s: str) -> list[str]:
    """The word as the language model sees it: digits alike, letters from U+3000 on without neighbours."""
    return ["^", *("9" if c.isdigit() and c < "\x80" else c.lower() if c < "\x80" else c for c in s), "$"]


def shape(a: str) -> str:
    return a if a < "　" else "　"


class Language:
    """Letter pairs with backing off to letters; of single texts and of arrays of pair codes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]
        self.after, n = np.unique(codes >> 21, return_inverse=True)
        self.first = np.bincount(n, counts, len(self.after)) if len(codes) else np.zeros(0)
        self.signs, n = np.unique(codes & 0x1FFFFF, return_inverse=True)
        self.single = np.bincount(n, counts, len(self.signs)) if len(codes) else np.zeros(0)
        self.total = float(counts.sum())
        # a letter seen seldom says little about its successors: without this, rare garbled words would back each other up
        self.trust = max(20.0, self.total / 300)
        self.known: dict[int, float] = {}

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(asked))
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[i] == asked, values[i], 0.0)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        p = (self._at(self.signs, self.single, codes & 0x1FFFFF) + 0.02) / (self.total + 200.0)
        return np.log((self._at(self.codes, self.counts, codes) + self.trust * p) / (self._at(self.after, self.first, codes >> 21) + self.trust))

    def log(self, s: str) -> float:
        out = 0.0
        for c in pair_codes(s):
            x = self.known.get(c)
            if x is None:
                x = self.known[c] = float(self.logs(np.array([c]))[0])
            out += x
        return out


def pair_codes(s: str) -> list[int]:
    """The pairs of neighbours of a word with a sign beyond ASCII, each as one number."""
    out, before = [], "^"
    for c in signs(s)[1:]:
        if c > "\x7f" or before > "\x7f":
            out.append(ord(shape(before)) << 21 | ord(c))
        before = c
    return out


class Sources:
    """Numbers of the sources: each its own up to MAX_SOURCES, hash classes beyond. A null source is one, too."""

    def __init__(self, names: list[str | None]) -> None:
        self.names = names
        self.number = {x: i for i, x in enumerate(sorted(names, key=lambda x: (x is not None, x or "")))} if len(names) <= MAX_SOURCES else None
        self.n = min(len(names), MAX_SOURCES) or 1

    def of(self, source: str | None) -> int:
        if self.number is not None:
            return self.number.get(source, 0)
        return crc32((source or "").encode()) % self.n


class Model:
    """Language, cipher weights (sources x (CLEAN, all keys, OWN)) and learned mappings; gives each word its likeliest cipher."""

    def __init__(self, language: Language, weights: np.ndarray, sources: Sources, mappings: dict[int, dict[int, str]] | None = None, common: Language | None = None, open_: float = 0.02) -> None:
        self.open = open_  # the share of words that any cipher may claim beyond what is learned
        self.language, self.sources, self.mappings, self.common = language, sources, mappings or {}, common or language
        n = weights.sum(1, keepdims=True)
        learned = np.divide(weights, n, out=np.zeros_like(weights), where=n > 0)
        # a cipher that a source never uses keeps a small share
        self.priors = (1 - open_) * learned + open_ / len(KEYS)
        self.priors[:, 0] = np.where(n[:, 0] > 0, (1 - open_) * learned[:, 0], 1 - open_)
        self.seen: dict[str, list[tuple[int, str, float]]] = {}

    @property
    def ciphers(self) -> Ciphers:
        if not hasattr(self, "_ciphers"):
            self._ciphers = Ciphers()
        return self._ciphers

    def evidence(self, word: str, s: int) -> list[tuple[int, str, float]]:
        """(key, decoded, how much likelier, as a logarithm, than the word as it is)."""
        got = self.seen.get(word)
        if got is None:
            as_is = self.language.log(word)
            got = [(k, x, d) for k, x in self.ciphers.readings(word) if (d := self.language.log(x) - as_is) > EVIDENCE]
            if len(self.seen) >= 200_000:
                self.seen.clear()
            self.seen[word] = got
        if (own := self.mappings.get(s)) and (x := word.translate(own)) != word:
            return [*got, (OWN, x, self.common.log(x) - self.common.log(word))]
        return got


def beyond_ascii(text: str) -> Column:
    """Whether a text has signs beyond ASCII: its bytes are more than its signs. Null for a null text."""
    return F.octet_length(text) > F.char_length(text)


def words_of(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, word, n): distinct words with signs beyond ASCII, counted before the shuffle."""
    w = docs.where(beyond_ascii(text)).select(F.col(source).alias("source"), F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word"))
    return w.groupBy("source", "word").agg(F.count("*").alias("n"))


READ = "source string, word string, n double, keys array<int>, sizes array<int>, pairs array<bigint>"


def read(words: DataFrame) -> DataFrame:
    """The words with all their readings, the first as they are: the keys, and the pairs of each reading in a row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ciphers = Ciphers()
        last, got = None, ([], [], [])
        for pdf in batches:
            rows = []
            for source, word, n in zip(pdf["source"], pdf["word"], pdf["n"], strict=True):
                if word != last:
                    found = [(CLEAN, word), *ciphers.readings(word)]
                    pairs = [pair_codes(x) for _, x in found]
                    last, got = word, ([k for k, _ in found], [len(p) for p in pairs], [c for p in pairs for c in p])
                rows.append((source, word, float(n), *got))
            yield pd.DataFrame(rows, columns=["source", "word", "n", "keys", "sizes", "pairs"])

    # few rows that cost much work each: over all tasks, the same word of several sources side by side
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "word").sortWithinPartitions("word").mapInPandas(decode, READ)


class Batch:
    """The readings of a batch of words as arrays."""

    def __init__(self, pdf: pd.DataFrame, sources: Sources) -> None:
        self.s = np.array([sources.of(x) for x in pdf["source"]], dtype=np.int64)
        self.n = pdf["n"].to_numpy()
        of_word = np.array([len(k) for k in pdf["keys"]])
        self.start = np.concatenate([[0], np.cumsum(of_word)[:-1]])
        self.word = np.repeat(np.arange(len(pdf)), of_word)
        self.keys = np.concatenate([np.asarray(k, dtype=np.int64) for k in pdf["keys"]])
        self.sizes = np.concatenate([np.asarray(k, dtype=np.int64) for k in pdf["sizes"]])
        codes = np.concatenate([np.asarray(k, dtype=np.int64) for k in pdf["pairs"]])
        self.codes, self.inverse = np.unique(codes, return_inverse=True)
        self.ends = np.cumsum(self.sizes)

    def logs(self, language: Language) -> np.ndarray:
        """The logarithm of each reading's probability as a word."""
        sums = np.concatenate([[0.0], np.cumsum(language.logs(self.codes)[self.inverse])])
        return sums[self.ends] - sums[self.ends - self.sizes]

    def shares(self, model: Model) -> np.ndarray:
        """The probability of each reading of its word."""
        x = self.logs(model.language) + np.log(np.maximum(1e-9, model.priors[self.s[self.word], self.keys + 1]))
        x = np.exp(x - np.maximum.reduceat(x, self.start)[self.word])
        return x / np.add.reduceat(x, self.start)[self.word]


LEARNED = "kind string, code bigint, s int, n double"


def learn(words: DataFrame, sources: Sources, rounds: int = ROUNDS) -> tuple[Language, np.ndarray]:
    """Letter pairs and cipher weights after some rounds of expectation-maximisation. words: as read() gives them; none: an empty model."""
    width = len(KEYS) + 2
    language, weights = Language(np.zeros(0, dtype=np.int64), np.zeros(0)), np.zeros((sources.n, width))
    for r in range(rounds):
        openness = max(0.02, 0.6 - 0.12 * r)  # ciphers are given a chance at first
        state = words.sparkSession.sparkContext.broadcast((language.codes, language.counts, weights, sources.names))

        def expect(batches: Iterator[pd.DataFrame], first=r == 0, state=state, openness=openness) -> Iterator[pd.DataFrame]:
            codes, counts, weights, names = state.value
            language, sources = Language(codes, counts), Sources(names)
            model = Model(language, weights, sources, open_=openness)
            codes, counts, used = [], [], np.zeros((sources.n, width))
            for pdf in batches:
                b = Batch(pdf, sources)
                # the first round takes all words as they are: garbled ones are the fewer
                q = (b.keys == CLEAN).astype(float) if first else b.shares(model)
                q[q < LEAST_SHARE] = 0.0
                if not first:
                    np.add.at(used, (b.s[b.word], b.keys + 1), q * b.n[b.word])
                m = q * b.n[b.word] ** 0.75  # a name that is everywhere shouldn't drown the letters
                codes.append(b.codes)
                counts.append(np.bincount(b.inverse, np.repeat(m, b.sizes), len(b.codes)))
            if codes:
                u, i = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(i, np.concatenate(counts), len(u))
                at = np.flatnonzero(used)
                kinds = ["pair"] * len(u) + ["key"] * len(at)
                out = pd.DataFrame({"kind": kinds, "code": np.concatenate([u, at % width]), "s": np.concatenate([np.zeros(len(u), dtype=int), at // width]).astype("int32"), "n": np.concatenate([n, used.ravel()[at]])})
                yield out[out["n"] > 0]

        got = words.mapInPandas(expect, LEARNED).groupBy("kind", "code", "s").agg(F.sum("n").alias("n")).where(F.col("n") > LEAST_COUNT).toPandas()
        pairs, keys = got[got["kind"] == "pair"], got[got["kind"] == "key"]
        language, weights = Language(pairs["code"].to_numpy(np.int64), pairs["n"].to_numpy(float)), np.zeros((sources.n, width))
        weights[keys["s"].to_numpy(int), keys["code"].to_numpy(int)] = keys["n"].to_numpy(float)
    return language, weights


class Letters:
    """What a learned mapping may decode to: the letters beyond ASCII of the language, and the logarithms of their pairs."""

    def __init__(self, language: Language) -> None:
        often = language.signs[(language.signs > 127) & (language.signs < 0x3000) & (language.single > 1e-4 * language.total)]
        self.letters = [c for c in map(chr, often) if c.isalpha()]
        self.fixed = ["^", "$", "9", *map(chr, range(97, 123))]
        self.number = {c: i for i, c in enumerate(self.letters)}
        self.language = language
        codes = np.array([[ord(a) << 21 | ord(c) for c in self.letters] for a in self.letters], dtype=np.int64).ravel()
        n = len(self.letters)
        self.inner = np.exp(language.logs(codes)).reshape(n, n) if n else np.zeros((0, 0))
        self.rows: dict[tuple[str, bool], np.ndarray] = {}

    def beside(self, fixed: str, before: bool) -> np.ndarray:
        """Probabilities of all letters after a fixed sign, or of the sign after each letter."""
        got = self.rows.get((fixed, before))
        if got is None:
            f = ord(fixed)
            codes = np.array([f << 21 | ord(c) if before else ord(c) << 21 | f for c in self.letters], dtype=np.int64)
            got = self.rows[fixed, before] = np.exp(self.language.logs(codes))
        return got


def hidden_letters(word: str, letters: Letters, channel: dict[str, np.ndarray]) -> tuple[list[tuple[str, np.ndarray]], float]:
    """Forward-backward over one word: (sign, probabilities of its letters) of each sign beyond ASCII, and the word's probability.

    channel: for each sign, how likely each letter is to come out as it.
    """
    ws = signs(word)
    out, total = [], 1.0
    i = 1
    while i < len(ws):
        if ws[i] <= "\x7f":
            i += 1
            continue
        j = i
        while ws[j] > "\x7f":
            j += 1
        run = ws[i:j]  # hidden letters between two fixed signs
        alpha = [letters.beside(ws[i - 1], True) * channel[run[0]]]
        for y in run[1:]:
            alpha.append((alpha[-1] @ letters.inner) * channel[y])
        beta = [letters.beside(ws[j], False)]
        for y in reversed(run[1:]):
            beta.append(letters.inner @ (beta[-1] * channel[y]))
        beta.reverse()
        p = float(alpha[-1] @ beta[-1])
        total *= p
        if p > 0:
            out += [(y, a * b / p) for y, a, b in zip(run, alpha, beta, strict=True)]
        i = j
    return out, total


def shared(words: DataFrame, language: Language, sources: Sources) -> Language:
    """The language without the letter pairs that only one source has: a swap that a source applies to all it holds is no language."""
    if sources.n < 2:
        return language
    names = words.sparkSession.sparkContext.broadcast(sources.names)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = Sources(names.value)
        seen = set()
        for pdf in batches:
            for source, sizes, pairs in zip(pdf["source"], pdf["sizes"], pdf["pairs"], strict=True):
                s = sources.of(source)
                seen.update((s, c) for c in pairs[: sizes[0]])
        yield pd.DataFrame(list(seen), columns=["s", "code"]).astype({"s": "int32", "code": "int64"})

    both = words.mapInPandas(pick, "s int, code bigint").groupBy("code").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("code")
    here = np.isin(language.codes, both.toPandas()["code"].to_numpy(np.int64))
    return Language(language.codes[here], language.counts[here])


def unexplained(words: DataFrame, language: Language, sources: Sources) -> DataFrame:
    """(s, word, n): the words that no reading makes a likely word of the language."""
    state = words.sparkSession.sparkContext.broadcast((language.codes, language.counts, sources.names))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, names = state.value
        language, sources = Language(codes, counts), Sources(names)
        for pdf in batches:
            b = Batch(pdf, sources)
            mean = b.logs(language) / np.maximum(b.sizes, 1)
            at = np.maximum.reduceat(mean, b.start) < UNLIKELY
            yield pd.DataFrame({"s": b.s[at].astype("int32"), "word": pdf["word"].to_numpy()[at], "n": b.n[at]})

    return words.mapInPandas(pick, "s int, word string, n double")


def map_letters(odd: DataFrame, language: Language, rounds: int = 12) -> tuple[dict[int, dict[int, str]], dict[int, float]]:
    """A byte-to-letter mapping for each source with at least MAPPED_WORDS unexplained words, for str.translate(), and how many words it is for.

    A sign is mapped where one letter has most of its probability; the others stay. A mapping counts only if most of the words become words of
    the language by it: a source in a language of its own has no such mapping.
    """
    many = [r["s"] for r in odd.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= MAPPED_WORDS).collect()]
    letters = Letters(language)
    if not many or not letters.letters:
        return {}, {}
    odd = odd.where(F.col("s").isin(many))
    seen = {(r["s"], r["sign"]): r["n"] for r in odd.select("s", F.explode(F.regexp_extract_all("word", F.lit(r"([^\x00-\x7F])"), F.lit(1))).alias("sign")).groupBy("s", "sign").agg(F.count("*").alias("n")).collect()}
    near = neighbours()
    size = len(letters.letters)
    channel: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    for s, y in seen:
        # known pages are where the search starts: the letters that share a byte with the sign come first
        channel[s][y] = np.array([3.0 if c in near.get(y, ()) else 1.0 for c in letters.letters]) / max(1, len(seen))
    counts: dict[tuple[int, str], np.ndarray] = {}
    for _ in range(rounds):
        state = odd.sparkSession.sparkContext.broadcast((language.codes, language.counts, dict(channel)))

        def expect(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            codes, counts, channel = state.value
            letters = Letters(Language(codes, counts))
            got: dict[tuple[int, str], np.ndarray] = {}
            for pdf in batches:
                for s, word, n in zip(pdf["s"], pdf["word"], pdf["n"], strict=True):
                    for y, p in hidden_letters(word, letters, channel[s])[0]:
                        got[s, y] = got.get((s, y), 0.0) + p * n**0.5
            rows = [(s, y, i, float(x)) for (s, y), p in got.items() for i, x in enumerate(p) if x > LEAST_SHARE]
            yield pd.DataFrame(rows, columns=["s", "sign", "letter", "n"]).astype({"s": "int32", "letter": "int32"})

        summed = odd.mapInPandas(expect, "s int, sign string, letter int, n double").groupBy("s", "sign", "letter").agg(F.sum("n").alias("n")).toPandas()
        counts = {k: np.zeros(size) for k in seen}
        for s, y, i, n in summed.itertuples(index=False):
            counts[s, y][i] = n
        for s in many:
            of_letter = sum((c for (t, _), c in counts.items() if t == s), np.zeros(size)) + 1.0
            for (t, y), c in counts.items():
                if t == s:
                    channel[s][y] = (c + 1e-3) / of_letter
    out: dict[int, dict[int, str]] = defaultdict(dict)
    for (s, y), c in counts.items():
        if c.sum() > 0 and c.max() > 0.6 * c.sum() and letters.letters[int(c.argmax())] != y:
            out[s][ord(y)] = letters.letters[int(c.argmax())]
    state = odd.sparkSession.sparkContext.broadcast((language.codes, language.counts, dict(out)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, out = state.value
        language = Language(codes, counts)
        for pdf in batches:
            mapped = [(s, n, pair_codes(w.translate(out.get(s, {})))) for s, w, n in zip(pdf["s"], pdf["word"], pdf["n"], strict=True)]
            yield pd.DataFrame([(s, n, not c or float(language.logs(np.array(c)).mean()) >= UNLIKELY) for s, n, c in mapped], columns=["s", "n", "good"]).astype({"s": "int32"})

    good = odd.mapInPandas(check, "s int, n double, good boolean").groupBy("s").agg(F.avg(F.col("good").cast("double")).alias("share"), F.sum(F.when(F.col("good"), F.col("n"))).alias("n")).collect()
    kept = {r["s"]: float(r["n"]) for r in good if r["s"] in out and r["share"] >= MAPPED_SHARE}
    return {s: out[s] for s in kept}, kept


def neighbours() -> dict[str, set[str]]:
    """Signs of known code pages -> letters that share a byte with them on another page."""
    out: dict[str, set[str]] = defaultdict(set)
    pages = [page(n) for n in dict.fromkeys((*WESTERN, *CYRILLIC, "latin_1"))]
    for b in range(128, 256):
        for p in pages:
            out[p[b]] |= {o[b] for o in pages}
    return out


SURE = math.log(9.0)  # a key that a document uses beside its likeliest
ODDS = math.log(0.5)  # a document is garbled; a lone sequence of several bytes, rare in its source, comes to about even odds
FOUND = "doc_id bigint, restored string, n_words int, n_lost int, keys array<string>"


def examine(text: str, source: str | None, model: Model) -> tuple[str, int, int, list[str]]:
    """(restored text, garbled words, signs lost for good, keys).

    A document is garbled if all its words together make some key likely enough (ODDS against no key); further keys hold in it if they are nine
    times likelier than none. Each word may be garbled or not. One sign alone is no evidence for a letter-by-letter key.
    """
    s = model.sources.of(source)
    lost = text.count("\ufffd")
    score: dict[int, float] = {}
    for w in set(re.findall(WORD, text)):
        weak = len(w) == 1
        for k, _, d in model.evidence(w, s):
            if not (weak and (k == OWN or k in model.ciphers.table)):
                score[k] = score.get(k, 0.0) + math.log(0.5 + 0.5 * math.exp(min(d, 50.0)))
    logs = {k: n + math.log(max(1e-12, model.priors[s, k + 1])) for k, n in score.items()}
    top = max(logs.values(), default=-99.0)
    if not logs or top + math.log(sum(math.exp(x - top) for x in logs.values())) < ODDS:
        return text, 0, lost, []
    used = {k: x for k, x in logs.items() if x > SURE or x >= top - 1e-9}
    found, keys = 0, {}

    def put(m: re.Match) -> str:
        nonlocal found
        got = [(d, used[k], -k, x) for k, x, d in model.evidence(m[0], s) if k in used]
        if not got or (best := max(got))[0] <= 0:
            return m[0]
        found += 1
        keys["learned" if -best[2] == OWN else "{} read as {}".format(*KEYS[-best[2]])] = None
        return best[3]

    restored = re.sub(WORD, put, text)
    return restored, found, lost, list(keys)


def repaired(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, restored, n_words, n_lost, keys) of each document that was read with a wrong encoding, wholly or in part.

    restored is the text with all words decoded that have a likely key; n_lost counts U+FFFD, which no key brings back. Null and
    empty texts are never found; a null source is a source of its own.
    """
    words = written(read(words_of(docs, text, source)), "words")
    sources = Sources([r["source"] for r in words.select("source").distinct().limit(MAX_SOURCES + 1).collect()])
    language, weights = learn(words, sources)
    common = shared(words, language, sources)
    mappings, n = map_letters(written(unexplained(words, common, sources), "unexplained"), common)
    for s, x in n.items():
        weights[s, OWN + 1] = x
    bc = docs.sparkSession.sparkContext.broadcast((language.codes, language.counts, weights, sources.names, mappings, common.codes, common.counts))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, weights, names, mappings, common, n = bc.value
        model = Model(Language(codes, counts), weights, Sources(names), mappings, Language(common, n))
        for pdf in batches:
            rows = []
            for i, t, s in zip(pdf["doc_id"], pdf["text"], pdf["source"], strict=True):
                restored, n, lost, keys = examine(t, s, model)
                if n or lost:
                    rows.append((i, restored, n, lost, keys))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "n_words", "n_lost", "keys"])

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")).where(beyond_ascii("text"))
    return d.mapInPandas(find, FOUND)


def found(docs: DataFrame) -> DataFrame:
    """p9_found: the documents garbled wholly or in part, restorable or not."""
    return repaired(docs).select("doc_id")
