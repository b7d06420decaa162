"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: the merges are compiled into a finite-state transducer that reads bytes from left to right. Its theory: a token sequence
is the BPE encoding of its bytes exactly if every two neighbours, put together, encode to just those two; so every prefix of a piece
has one encoding, and its last token is the only token t that ends there and goes with the last token of the prefix before t. A
state is the set of token beginnings that may still grow, each with the last token before it. States are determinised
lazily: a state and its transitions are made when a byte first asks for them, and shared by all pieces from then on; the table is
flushed when it outgrows its bound, as lazy automata do. Reading a byte yields the last token of the prefix so far. Tokens are emitted after
a bounded lookahead: whatever follows, the encoding goes on from one of the beginnings in the state, so the tokens that lie on the way
to all of them are settled; they are read off every LOOKAHEAD bytes, and the rest at the end of the piece. A piece of any length thus
needs room for its open end only. Decoding is streamed: token bytes go through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how byte-level vocabularies of this family cut text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_STATES = 400_000
MAX_PIECES = 400_000
MAX_PAIRS = 1_000_000
LOOKAHEAD = 512  # bytes; most pieces are far shorter and are read off once


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Bytes of a piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: dict[int, int] = {}  # node -> token that ends there
        self.depth = [0]  # node -> bytes from the root
        nodes = 1
        for b, i in ranks.items():
            at = 0
            for x in b:
                key = at * 256 + x
                to = self.child.get(key)
                if to is None:
                    self.child[key] = to = nodes
                    self.depth.append(self.depth[at] + 1)
                    nodes += 1
                at = to
            self.token_at[at] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(PIECES)
        self._flush()

    def _flush(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.number: dict[tuple[tuple[int, int], ...], int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> (state, last token)

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank until none is left. Only for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def goes(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side; the beginning (-1) goes with every token that encodes to itself."""
        ok = self.pairs.get((a, b))
        if ok is None:
            x = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(x) == ([a, b] if a >= 0 else [b])
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        child, token_at = self.child, self.token_at
        grown, last = [], -1
        for node, before in self.states[state]:
            to = child.get(node * 256 + byte)
            if to is None:
                continue
            t = token_at.get(to)
            if t is not None and last < 0 and self.goes(before, t):
                last = t
            grown.append((to, before))
        if last < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        key = (*grown, (0, last))
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state * 256 + byte] = n, last
        return n, last

    def _back(self, lasts: list[int], at: int) -> list[int]:
        """The tokens up to place `at`, read off backwards; lasts holds the last token of each prefix."""
        out = []
        while at > 0:
            out.append(lasts[at - 1])
            at -= len(self.bytes_of[out[-1]])
        out.reverse()
        return out

    def _settled(self, state: int, lasts: list[int]) -> int:
        """The last place that every continuation's encoding has as a token's end: 0 if none is sure yet."""
        common: set[int] | None = None
        for node, _ in self.states[state]:
            at, ends = len(lasts) - self.depth[node], set()
            while at > 0:
                ends.add(at)
                at -= len(self.bytes_of[lasts[at - 1]])
            common = ends if common is None else common & ends
            if not common:
                return 0
        return max(common or (0,))

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self._flush()
        moves, state, lasts, out = self.moves, 0, [], []
        for x in piece:
            m = moves.get(state * 256 + x)
            state, last = m if m is not None else self._move(state, x)
            lasts.append(last)
            if len(lasts) >= LOOKAHEAD and len(lasts) % LOOKAHEAD == 0 and (end := self._settled(state, lasts)):
                out += self._back(lasts, end)
                del lasts[:end]
        return out + self._back(lasts, len(lasts))

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; null and empty text give an empty list."""
        if not text:
            return []
        out: list[int] = []
        known = self.pieces
        for p in self.cut.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = tuple(self.encode_piece(p.encode("utf-8", "surrogatepass")))
                if len(p) <= 40:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the tokens, as soon as its characters are complete; bytes that are no UTF-8 give U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if s := machine.decode(self.bytes_of[i]):
                yield s
        if s := machine.decode(b"", True):
            yield s


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once and sent to the workers: its size is that of the file (under 1 MB), whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, counts_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """key, the columns of `keep`, and ids (array<int>), or n_tokens (bigint) if only counts are asked for.

    One row for each input row, repeats included; null and empty texts give an empty list. Nothing is shuffled.
    """
    keep = keep or []
    data = _vocabulary(docs.sparkSession, path)
    fields = [f.simpleString() for f in docs.select(key, *keep).schema.fields]
    schema = ", ".join(f"`{f.partition(':')[0]}` {f.partition(':')[2]}" for f in fields) + (", n_tokens bigint" if counts_only else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(parse_ranks(data.value))
        for batch in batches:
            lists = [t.encode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            got = pa.array([len(x) for x in lists], pa.int64()) if counts_only else pa.array(lists, pa.list_(pa.int32()))
            names = [*batch.schema.names[:-1], "n_tokens" if counts_only else "ids"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=names)

    return docs.select(key, *keep, F.col(text).alias("_text")).mapInArrow(run, schema)
