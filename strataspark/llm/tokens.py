"""Exact byte-pair encoding of a corpus with a public vocabulary (problem 6).

Per-prefix dynamic programming. The encoding of every prefix of a piece of text ends in one
certain token. Going through the piece byte by byte, an automaton of all tokens with failure links
gives the tokens that end at this byte, longest first; the last token of the prefix is the one
that is compatible with the last token of the prefix before it: the pair must encode to itself,
which is tested by undoing merges on both sides of the seam in the order of their ranks. The ids
are then read off by following the back-pointers. No merge loop runs over the text.

Pieces are what the tokenizer's own pattern splits. A piece is encoded once in each Python worker
and then found in a table; the table is emptied when it reaches ``CACHE_PIECES`` entries, which
bounds memory and changes no result.

Defined cases
    * Null and empty texts: an empty list of ids. Blank texts are encoded like any others.
    * Strings of special tokens inside a text are ordinary text.
    * Repeated rows give repeated rows; extra columns are kept away from the encoder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import sliced

#: Where the public vocabularies lie; every function takes another place as a parameter.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the published pattern of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_PIECES = 300_000

#: Rows worked on at a time; texts may be long.
BATCH_ROWS = 1_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder(dict):
    """Ids of pieces, packed as little-endian 32-bit integers; missing pieces are encoded on demand."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = {token: "".join(chr(alphabet[c]) for c in token) for token in model["vocab"] if all(c in alphabet for c in token)}
        ids = {raw[token]: i for token, i in model["vocab"].items() if token in raw}
        #: bytes of each token
        self.raw = {i: s.encode("latin-1") for s, i in ids.items()}
        #: rank of a merge by its two tokens, and the two tokens that a token is merged from
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        reachable = ahocorasick.Automaton()
        for s, i in ids.items():
            if len(s) == 1:
                self.rank[i] = -1
                reachable.add_word(s, (1, i))
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = ids[raw[a]], ids[raw[b]]
            whole = ids[raw[a] + raw[b]]
            self.pair[left, right] = rank
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                self.rank[whole] = rank
                reachable.add_word(raw[a] + raw[b], (len(raw[a] + raw[b]), whole))
        reachable.make_automaton()
        self.matches = reachable.iter
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        super().__init__()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of two tokens, put together, encodes to just these two.

        The seam is looked at in the state before every merge that either side still contains: the
        later of the two sides' last merges is undone, and if the tokens that then meet would have
        merged earlier than what was undone, the pair is none.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        pair, parts, rank = self.pair.get, self.parts, self.rank
        a, b, before, good = left, right, 1 << 60, True
        # a merge of rank r across the seam happens before the side's own merge at ``before``;
        # of two equal ranks the one further left goes first
        while True:
            seam = pair((a, b))
            if seam is not None and seam < before:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, parts[a][1]
            elif ra < rb:
                before, b = rb + 1, parts[b][0]
            else:
                # the same merge on both sides: the left one happens first, so the right is undone first
                before, b = rb + 1, parts[b][0]
        if len(self.fits) > CACHE_PIECES:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece of text."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(data)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.matches(data):
            ending[end].append(token)
        compatible = self.compatible
        for end in range(n):
            for length, token in sorted(ending[end], reverse=True):
                start = end + 1 - length
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end + 1], size[end + 1] = token, length
                    break
        ids = []
        at = n
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        packed = b"".join(i.to_bytes(4, "little") for i in self.encode(piece))
        self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        return b"".join(map(self.__getitem__, self.split(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str = "text", folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row."""
    path = f"{folder}/{name}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for batch in sliced(batches, BATCH_ROWS):
            parts = [packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            sizes = pa.array([0, *(len(p) // 4 for p in parts)], pa.int32())
            offsets = pc.cumulative_sum(sizes).cast(pa.int32())
            values = pa.Array.from_buffers(pa.int32(), sum(map(len, parts)) // 4, [None, pa.py_buffer(b"".join(parts))])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counts(df: DataFrame, key: str, text: str = "text", folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` (INT) of every row; the ids stay in the Python worker."""
    path = f"{folder}/{name}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for batch in sliced(batches, BATCH_ROWS):
            sizes = [len(packed(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "n_tokens"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def batch_counts(df: DataFrame, key: str, texts: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """SF9, SF10: tokens of the texts of an array, joined by a blank; ``error`` says why there is no count:
    ``empty`` for no text at all. A text that cannot be encoded fails its row and no other."""
    path = f"{folder}/{name}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for batch in sliced(batches, BATCH_ROWS):
            sizes, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    n, error = (len(packed(t)) // 4, None) if t else (0, "empty")
                except (KeyError, UnicodeError) as e:
                    n, error = 0, type(e).__name__
                sizes.append(n)
                errors.append(error)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.array(errors, pa.string())], names=[key, "n_tokens", "error"])

    joined = F.array_join(texts, " ")
    return df.select(F.col(key), joined.alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens int, error string")


def decode(df: DataFrame, key: str, ids: str = "ids", folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """SF11: the texts of token ids; null ids give null. Ids that no token has, and bytes that are no text,
    give the replacement sign."""
    path = f"{folder}/{name}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder(path).raw
        for batch in sliced(batches, BATCH_ROWS):
            texts = [None if x is None else b"".join(raw.get(i, b"\xff") for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def within(n_tokens: Column, error: Column, limit: Column) -> Column:
    """SF11: whether a counted text is within a limit; what could not be counted is not."""
    return F.coalesce(error.isNull() & (n_tokens <= limit), F.lit(False))
