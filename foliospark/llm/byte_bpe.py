"""Byte-level BPE encoding and decoding by longest matches and backtracking.

A sequence of tokens is what the merges give if and only if each adjacent pair is what they give for the pair's own
bytes. So a piece is encoded from the left: take the longest token that matches and is compatible with the one before,
try its next shorter prefixes otherwise, and step back where none is left, never to that position again: linear in the
piece. Matches come from pyahocorasick's trie over the piece's bytes, read as Latin-1; compatibility of two tokens is
computed once by merging their bytes, and memoised. A piece that is a token itself is that token.

The vocabulary is a rank file (base64 token, space, rank per line); its path is a parameter, it is read on the driver and
broadcast (a fixed file). Memos of pieces and pairs are dropped at a fixed size.

Defined results: null text encodes to no tokens, and null ids decode to no bytes; repeated rows are encoded alone; an
empty table gives an empty table; extra columns pass through ``encode`` and ``decode`` unchanged. Long texts are split
into pieces as a stream, and a batch is closed when it holds ``BATCH`` tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import give_back, ship

BATCH = 1 << 20
MEMO = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by their definition, least rank first and leftmost of equal ones; used for pairs of tokens only."""
    parts, get, none = [piece[i : i + 1] for i in range(len(piece))], ranks.get, 1 << 60
    found = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found and (least := min(found)) < none:
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], none)
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class Encoder(dict):
    """Maps a piece of text to the tuple of its ids; the dict is the memo.

    It has two generations of ``memo`` pieces: a full one becomes the old one, and what is found there moves on, so pieces
    that are met again stay while others go.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import ahocorasick
        import regex

        # White_Space is what the pattern's \s means outside Python.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.reach, self.most = self.trie.longest_prefix, max(map(len, ranks))
        self.get = {token.decode("latin-1"): i for token, i in ranks.items()}.get
        self.lengths = {i: len(b) for i, b in self.tokens.items()}
        self.old: dict[str, tuple[int, ...]] = {}
        self.memo = memo
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= self.memo:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (a < 0: at the start)."""
        if len(self.fits) >= MEMO * 4:
            self.fits.clear()
        two = [b] if a < 0 else [a, b]
        known = self.fits[(a << 32) + b] = merged(b"".join(self.tokens[i] for i in two), self.ranks) == two
        return known

    def _shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i, or -1."""
        known = self.shorter.get(i)
        if known is None:
            token = self.tokens[i]
            known = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)
            self.shorter[i] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        size, lengths, known, shorter, reach, get, most = len(piece), self.lengths, self.fits.get, self.shorter.get, self.reach, self.get, self.most
        text = piece.decode("latin-1")
        out: list[int] = []
        closed = set()
        at, last, i = 0, -1, None
        while at < size:
            if i is None:  # the longest token that begins here, or -1
                ahead = text[at : at + most]
                n = reach(ahead)
                i = get(ahead[:n], -1)
                while i < 0 and n > 0:
                    n -= 1
                    i = get(ahead[:n], -1)
            while i >= 0:
                if at + lengths[i] not in closed:
                    fits = known((last << 32) + i)
                    if fits is None:
                        fits = self._fits(last, i)
                    if fits:
                        break
                less = shorter(i)
                i = self._shorter(i) if less is None else less
            if i >= 0:
                out.append(i)
                at += lengths[i]
                last, i = i, None
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                closed.add(at)
                i = out.pop()
                at -= lengths[i]
                last = out[-1] if out else -1
                i = self._shorter(i)
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= 1 << 20:
            return np.fromiter(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))), dtype=np.int32)
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(found, 1 << 16)):
            parts.append(np.fromiter(chain.from_iterable(map(self.__getitem__, some)), dtype=np.int32))
        return np.concatenate(parts)


_OWN: dict[tuple, Encoder] = {}


def _encoder(shared, memo: int) -> Encoder:
    """One encoder per task and vocabulary."""
    raw, pattern = shared.value
    key = (hash(raw), len(raw), pattern, memo)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}, pattern, memo)
    return _OWN[key]


_TOKENS: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tokens(shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one behind the other, and each id's first byte and length; decoding needs no more."""
    raw = shared.value[0]
    key = (hash(raw), len(raw))
    if key not in _TOKENS:
        _TOKENS.clear()
        token = {int(b): base64.b64decode(a) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
        every = [token.get(i, b"") for i in range(max(token) + 1)]
        size = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
        _TOKENS[key] = (np.frombuffer(b"".join(every), dtype=np.uint8), np.cumsum(size) - size, size)
    return _TOKENS[key]


def _bytes_of(ids: Iterable[np.ndarray], shared) -> pa.Array:
    """What each row's ids stand for: bytes of all ids gathered at once."""
    flat, first, size = _tokens(shared)
    rows = list(ids)
    every = np.concatenate([*rows, np.zeros(0, dtype=np.int32)])
    long = size[every]
    upto = np.r_[0, np.cumsum(long)]
    data = flat[np.arange(upto[-1]) + np.repeat(first[every] - upto[:-1], long)]
    ends = upto[np.cumsum([0, *map(len, rows)])].astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return whole.cast(pa.binary())


def _broadcast(df: DataFrame, path: str, pattern: str):
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, memo: int = MEMO) -> DataFrame:
    """df with its text column replaced by ids, array<int> (a column of that name is replaced too).

    decoded: a column for what the ids decode to, made in the same Python workers rather than in a second set of them.
    memo: pieces of each of the two generations that a worker remembers, some 230 bytes each.
    """
    shared = _broadcast(df, path, pattern)
    keep = [c for c in df.columns if c not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared, memo)
        for batch in batches:
            from_, parts, held = 0, [], 0
            texts = batch.column(batch.schema.get_field_index(text))
            for k in range(len(texts) + 1):
                if k == len(texts) or held >= BATCH:
                    offsets = pa.array(np.cumsum([0, *map(len, parts)]), type=pa.int32())
                    values = pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int32)]), type=pa.int32())
                    made = [pa.ListArray.from_arrays(offsets, values)] + [_bytes_of(parts, shared)] * bool(decoded)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(from_, k - from_) for c in keep), *made], names=[*keep, ids, *[decoded] * bool(decoded)])
                    from_, parts, held = k, [], 0
                if k < len(texts):
                    parts.append(own.encode(texts[k].as_py() or ""))
                    held += len(parts[-1])
        del own
        _OWN.clear()  # a worker lives longer than its task, and the next one may be of another operator
        _TOKENS.clear()
        give_back()

    schema = T.StructType([df.schema[c] for c in keep]).add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, T.BinaryType())
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with one more column: the bytes that the ids stand for."""
    shared = _broadcast(df, path, pattern)
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            whole = _bytes_of((x.values.to_numpy() if x.is_valid else np.zeros(0, dtype=np.int32) for x in col), shared)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))
