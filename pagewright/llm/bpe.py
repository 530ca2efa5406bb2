"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding.  A sequence of tokens is the BPE encoding of its bytes exactly when
no merge crosses the border of any two neighbours (the pair is *stable*).  So
the last token of every prefix is the one suffix token that is stable after
the last token of what stands before it, and the encoding is the chain of last
tokens.  The nondeterministic machine may start a token at any byte; the
subset of starts still open after a byte is known from the longest of them, so
a state of the determinised machine is the longest open token prefix.  States,
edges and the tokens that end in a state are made when first needed.  A token
is emitted when all open starts have it in their chain: no later byte can
change it, and since starts are open for at most the longest token's length,
the lookahead is bounded.

Decoding.  Token bytes are joined; ``Utf8Stream`` turns byte chunks into text
with a state machine that holds back an unfinished character.

Defined cases: null text is empty text; empty text gives no ids; ids null
decode to empty bytes; ids outside the vocabulary raise ``KeyError``; texts of
any length are taken whole; repeated rows are coded each; an empty table gives
no row; columns named like the results (``ids``, ``decoded``, ``decoded_text``)
are replaced, all others are kept.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import pieces, small_batches, table, texts

WINDOW = 1024
MAX_PAIRS = 300_000
MAX_WORDS = 350_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.states: list[bytes] = [b""]
        self.numbers: dict[bytes, int] = {b"": 0}
        self.ending: list[list[tuple[int, int]]] = [[]]
        self.edges: dict[int, int] = {}

    def _node(self, data: bytes) -> int:
        """The state in which ``data`` is the longest open token prefix."""
        number = self.numbers.get(data)
        if number is None:
            number = self.numbers[data] = len(self.states)
            self.states.append(data)
            ends = (data[at:] for at in range(len(data)))
            self.ending.append([(self.ranks[e], len(e)) for e in ends if e in self.ranks])
        return number

    def _edge(self, state: int, byte: int) -> int:
        data = self.states[state] + bytes((byte,))
        while data not in self.prefixes:
            data = data[1:]
        self.edges[state << 8 | byte] = number = self._node(data)
        return number

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The plain definition: join the neighbours of lowest rank until none
        is left whose joint rank is under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        known = self.splits.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            halves = self.merge(data, token) if len(data) > 1 else []
            known = self.splits[token] = tuple(halves) if len(halves) == 2 else None
        return known

    def edge_of(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the right (1) or left (0) end of ``token``
        while it is merged, each with the rank at which it is merged away."""
        known = self.spines[side].get(token)
        if known is None:
            known, piece, until = [], token, 1 << 60
            while True:
                known.append((piece, until))
                halves = self.parts(piece)
                if halves is None:
                    break
                until, piece = piece, halves[side]
            self.spines[side][token] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``: one would if
        the two ends met, unmerged, at the rank of their joint token.  Of equal
        ranks the left merge comes first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            tokens, ranks, known = self.tokens, self.ranks, True
            rights = [(tokens[y], gone) for y, gone in self.edge_of(b, 0)]
            for x, x_gone in self.edge_of(a, 1):
                for y, y_gone in rights:
                    rank = ranks.get(tokens[x] + y)
                    if rank is not None and rank < x_gone and rank <= y_gone:
                        known = False
            self.pairs[key] = known
        return known

    def _settled(self, state: int, at: int, start: list[int]) -> int:
        """The latest position in the chains of all open starts."""
        data = self.states[state]
        meet = {at - len(data) + i for i in range(len(data)) if data[i:] in self.prefixes} | {at}
        while len(meet) > 1:
            p = max(meet)
            meet.remove(p)
            meet.add(start[p])
        return meet.pop()

    @staticmethod
    def _chain(last: list[int], start: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-split piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        edges, ending, pairs, stable = self.edges, self.ending, self.pairs, self.stable
        out: list[int] = []
        state, last, start = 0, [-1], [0]  # by position since the last emitted token
        for byte in data:
            number = edges.get(state << 8 | byte)
            state = self._edge(state, byte) if number is None else number
            at = len(last)
            for token, size in ending[state]:
                before = last[at - size]
                if before < 0:
                    break
                known = pairs.get(before << 32 | token)
                if known or known is None and stable(before, token):
                    break
            last.append(token)
            start.append(at - size)
            if at >= WINDOW:
                done = self._settled(state, at, start)
                if done:
                    out += self._chain(last, start, done)
                    last, start = last[done:], [max(0, p - done) for p in start[done:]]
        return out + self._chain(last, start, len(last) - 1)


class Tokenizer:
    """Splits a text by the pattern and encodes each match by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = tuple(self.machine.encode(word.encode()))
                if len(word) <= 64:
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding; what can't be text becomes U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character which a later chunk may end."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if need > back else 0
        return 0

    def feed(self, chunk: bytes, final: bool = False) -> str:
        data = self.held + chunk
        hold = 0 if final else self._unfinished(data)
        self.held = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")


_MADE: dict[tuple, Tokenizer] = {}


def _tokenizer(key: tuple, ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """One tokenizer for all tasks of a Python worker."""
    if key not in _MADE:
        _MADE.clear()
        gc.set_threshold(1_000_000, 50, 50)  # the tables hold no cycles
        _MADE[key] = Tokenizer(ranks, pattern)
    return _MADE[key]


def _vocabulary(df: DataFrame, path: str):
    """The ranks as a broadcast; a vocabulary is a file of bounded size."""
    ranks = load_ranks(path)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError(f"{path}: a vocabulary of over 64 MB is not broadcast")
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out`` array<int>, the ids of ``column`` (null: no ids).

    A column named ``out`` that ``df`` has already is replaced."""
    small_batches(df.sparkSession)
    shared = _vocabulary(df, path)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_ids(batches, _tokenizer((path, pattern), shared.value, pattern), place, out)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` binary, the bytes of ``ids`` (null: no bytes), and
    ``<out>_text``, the same as text."""
    small_batches(df.sparkSession)
    shared = _vocabulary(df, path)
    df = df.drop(out, f"{out}_text")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType()), T.StructField(f"{out}_text", T.StringType())])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_bytes(batches, {v: k for k, v in shared.value.items()}, place, out)

    return df.mapInArrow(run, schema)


def coded(df: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode(encode(df).drop(column))`` in one pass: the ids are made and
    decoded in the same Python worker, so a task holds one vocabulary and not two."""
    small_batches(df.sparkSession)
    shared = _vocabulary(df, path)
    df = df.drop(ids, out, f"{out}_text")
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(out, T.BinaryType()), T.StructField(f"{out}_text", T.StringType())])
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer((path, pattern), shared.value, pattern)
        encoded = (b.drop_columns([column]) for b in _with_ids(batches, tokenizer, place, ids))
        return _with_bytes(encoded, {v: k for k, v in shared.value.items()}, len(kept), out)

    return df.mapInArrow(run, schema)


def _with_ids(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer, place: int, out: str) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.field("element", pa.int32(), False))
    for batch in pieces(batches):
        ids = [np.array(tokenizer.encode(t), np.int32) for t in texts(batch.column(place))]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])


def _with_bytes(batches: Iterator[pa.RecordBatch], parts: dict[int, bytes], place: int, out: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        raw, text = [], []
        for row in batch.column(place):
            stream, got, said = Utf8Stream(), [], []
            values = row.values
            for at in range(0, len(values) if values is not None else 0, 4096):
                chunk = b"".join(map(parts.__getitem__, values.slice(at, 4096).to_numpy(zero_copy_only=False).tolist()))
                got.append(chunk)
                said.append(stream.feed(chunk))
            said.append(stream.feed(b"", True))
            raw.append(b"".join(got))
            text.append("".join(said))
        new = [pa.array(raw, pa.binary()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, out, f"{out}_text"])


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and of decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digests(coded(docs, path, public_tokenizers.PATTERN))


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
