"""Language-model scores: a hierarchical Pitman-Yor model of words and the word before.

Each context (the word before, or the begin of a text) is a restaurant whose
customers are the words that follow it in training texts; all of them share one
parent, whose customers are their tables; its own base is uniform over the known
words and one unknown.  Discounts come from the counts of counts.

Seating is sampled by Gibbs: given the parent's probabilities and the tables of
the rest of the restaurant, the tables of one dish are drawn from their full
conditional, which generalised Stirling numbers give without seating customers
one by one.  A dish of over ``EXACT`` customers starts from such a draw and seats
the rest in leaps that grow with the number seated, each adding the expected
number of tables, rounded at random.  All dishes of a round are drawn from the
state that the round before left, ``CHAINS`` chains side by side; probabilities
are the mean over the chains after ``ROUNDS`` rounds.

How it runs.  Texts become blocks of at most ``BLOCK_TOKENS`` tokens, written
once in a table that is bucketed by block, so that joins with it move the other
side only.  Words and pairs go by 64-bit hashes.  What a block has to know of
the whole corpus - how often a pair or word occurs - is asked for in one way: the
block sends each bucket of the hash range its sorted keys and its own sums,
packed in one row, and gets back the totals in the same order.  So a frequent
word or pair is one number of each block, and no key's rows meet anywhere.  The
least block that has a pair in training owns it: only owners add to the tables
of words and contexts.  Draws depend on the pair, the chain and the round alone,
so every block that holds a pair draws the same tables and they are never sent.

Defined cases: a null or empty text has one token, the end; rows for which
``train`` isn't true, null ids included, are not learned from; repeated rows are
learned from and scored each; with nothing to learn from every token has
probability 1 in model and base; texts longer than a block are scored in pieces
that keep their context; an empty table gives no row; other columns are ignored.
Two words (or pairs) of the same 64-bit hash would count as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import cut, removed, shared_folder, small_batches, table
from .language import held_out

BLOCK_TOKENS = 3 << 19
#: tokens of the corpus for each bucket of pairs, and of words
PAIRS = 1 << 20
WORDS = 1 << 22
CHAINS = 3
ROUNDS = 2
#: strengths of the parent and of the contexts
STRENGTHS = (10.0, 1.0)
#: customers of a dish whose tables are drawn exactly
EXACT = 32
#: bytes hashed at a time
SLICE = 1 << 20

_random = np.random.default_rng(12)
BYTES = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0xD1342543DE82EF95
MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a result depends on all bits of ``x``."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BEGIN, END = mixed(np.array([1, 2], np.uint64))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to each power below SLICE, and the inverses modulo 2**64."""
    out = []
    for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        steps = np.full(SLICE + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word ``data[start:end]``: a polynomial of its bytes, mixed."""
    powers, inverses = _powers()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + SLICE, "right"))
        if j == i:  # one word longer than a slice
            total, scale = 0, 1
            for k in range(at, int(ends[i]), SLICE):
                piece = BYTES[data[k : min(k + SLICE, int(ends[i]))]]
                total += int((piece * powers[: len(piece)]).sum()) * scale
                scale = scale * int(powers[SLICE]) & MASK
            out[i] = total & MASK
            i += 1
            continue
        terms = BYTES[data[at : int(ends[j - 1])]]
        terms *= powers[: len(terms)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * inverses[starts[i:j] - at]
        i = j
    return mixed(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts of an Arrow column, and how many each has."""
    wide = pa.types.is_large_string(column.type)
    places = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if places[-1] == places[0]:
        return np.full(len(column), END), np.ones(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]]
    places = places - places[0]
    space = SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = places[(places > 0) & (places < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = np.bincount(np.searchsorted(places[1:], starts, "right"), minlength=len(column))
    return np.insert(word_hashes(LOWER[data], starts, ends), np.cumsum(lengths), END), lengths + 1


def packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes()
    return values.size.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    size = int.from_bytes(memoryview(data)[:8], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], size * 8, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).reshape(-1).view(np.int64)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


# --- blocks -----------------------------------------------------------------


def _blocks(rows: DataFrame, kind: str) -> tuple[DataFrame, str, str]:
    """The texts as blocks, written once: (block, lead, first, size, keys, train,
    lengths, words, tokens). A block is a stretch of its task's tokens; ``lead``
    is the token before it and ``first`` the name of its first document."""

    def made(part: int, seq: int, lead: int, docs: list[list], tokens: np.ndarray) -> pa.RecordBatch:
        words, ids, n = np.unique(np.concatenate([tokens, [BEGIN, np.uint64(lead)]]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words have small numbers
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        one = [
            pa.array([part << 33 | seq], pa.int64()),
            pa.array(np.array([lead], np.uint64).view(np.int64)),
            pa.array([part << 33 | docs[0][0]], pa.int64()),
            pa.array([len(tokens)], pa.int64()),
            pa.array([[d[1] for d in docs]], pa.list_(key_type)),
            pa.array([[d[2] for d in docs]], pa.list_(pa.bool_())),
            pa.array([packed(np.array([d[3] for d in docs], np.int64))], pa.binary()),
            pa.array([packed(words[order])], pa.binary()),
            pa.array([packed(rank[ids[: len(tokens)]])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(one, names=["block", "lead", "first", "size", "keys", "train", "lengths", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, row, lead = TaskContext.get().partitionId(), 0, 0, int(END)
        docs: list[list] = []  # number, key, train, tokens still to be put in a block
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            got, lengths = tokens_of(batch.column("t"))
            held.append(got)
            size += len(got)
            for key, train, n in zip(batch.column("key").to_pylist(), batch.column("train").to_pylist(), lengths.tolist(), strict=True):
                docs.append([row, key, train, n])
                row += 1
            while size >= BLOCK_TOKENS:
                stream = np.concatenate(held)
                now, rest = stream[:BLOCK_TOKENS], stream[BLOCK_TOKENS:]
                mine, left = [], BLOCK_TOKENS
                while left:
                    n = min(left, docs[0][3])
                    mine.append([*docs[0][:3], n])
                    left -= n
                    docs[0][3] -= n
                    if not docs[0][3]:
                        docs.pop(0)
                yield made(part, seq, lead, mine, now)
                seq, lead, held, size = seq + 1, int(now[-1]), [rest], len(rest)
        if size:
            yield made(part, seq, lead, docs, np.concatenate(held))

    spark = rows.sparkSession
    key_type = to_arrow_type(rows.schema["key"].dataType)
    schema = f"block long, lead long, first long, size long, keys array<{kind}>, train array<boolean>, lengths binary, words binary, tokens binary"
    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    writer = rows.mapInArrow(run, schema).write.format("parquet").option("compression", "none").option("path", path)
    writer.bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").saveAsTable(name)
    return spark.table(name), name, path


class Block:
    """One block read back: its words, tokens and distinct pairs in the order of
    their hashes."""

    def __init__(self, row: dict):
        self.block, self.first, self.keys = row["block"], row["first"], row["keys"]
        self.train = np.array(row["train"], bool)
        self.lengths, self.tokens = unpacked(row["lengths"]), unpacked(row["tokens"]).astype(np.int32)
        words = unpacked(row["words"]).view(np.uint64)
        self.words, self.by_hash = words, np.argsort(words)
        ranked = words[self.by_hash]
        number = lambda word: self.by_hash[min(int(np.searchsorted(ranked, word)), len(words) - 1)]
        begin, end, lead = number(BEGIN), number(END), number(np.uint64(row["lead"] & MASK))
        # the end of a text is no context: what follows it begins another
        self.context = np.concatenate([np.array([lead], np.int32), self.tokens[:-1]])
        if words[end] == END:
            self.context[self.context == end] = begin
        self.learned = np.repeat(self.train, self.lengths)

    def pairs(self) -> None:
        """Distinct pairs: ``keys`` sorted, their context and word, the number of
        each token's pair, and how often each occurs in training."""
        size = len(self.words)
        found, inverse = np.unique(self.context.astype(np.int64) * size + self.tokens, return_inverse=True)
        u, w = (found // size).astype(np.int32), (found % size).astype(np.int32)
        keys = mixed(self.words[u] * np.uint64(FACTOR) + self.words[w])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair, self.u, self.w = keys[order], u[order], w[order]
        self.at = place[inverse]
        self.count = np.bincount(self.at[self.learned], minlength=len(order)).astype(np.int64)


# --- sums over the corpus ---------------------------------------------------


def totals(blocks: DataFrame, buckets: int, keys_and_values: Callable[[dict], tuple[np.ndarray, np.ndarray]], finish: Callable | None = None) -> tuple[DataFrame, list[int]]:
    """For each block the totals of its keys over all blocks, and sums over all keys.

    ``keys_and_values`` gives a block's sorted keys and one row of values for each
    column. The answer has a row for each column, then what ``finish(keys, totals)``
    adds (rows, and numbers to be summed over all keys), then whether the block
    is the least one whose first value isn't zero."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            keys, values = keys_and_values(row)
            place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(keys)]
            cells = [(row["block"], int(place[a]), packed(_steps(keys[a:b])), packed(values[:, a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for at in range(0, len(cells), 64):
                block, bucket, k, v = zip(*cells[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["block", "bucket", "keys", "counts"])

    def answered(bucket: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([k for _, k, _ in rows])
        columns = len(rows[0][2]) // len(rows[0][1])
        values = np.concatenate([v.reshape(columns, -1) for _, _, v in rows], axis=1)
        keys, inverse = np.unique(every, return_inverse=True)
        sums = np.stack([np.bincount(inverse, c, len(keys)).astype(np.int64) for c in values])
        more, stats = finish(keys, sums) if finish else (np.zeros((0, len(keys)), np.int64), [])
        some = np.flatnonzero(values[0])
        owner = np.zeros(len(every), np.int64)
        owner[some[np.unique(inverse[some], return_index=True)[1]]] = 1
        whole, at = np.concatenate([sums, more]), 0
        for block, k, _ in rows:
            mine = np.concatenate([whole[:, inverse[at : at + len(k)]], owner[None, at : at + len(k)]])
            at += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed(mine)], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["block", "bucket", "answer", "stats"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([bucket], pa.int32()), pa.array([None], pa.binary()), pa.array([[int(s) for s in stats]], pa.list_(pa.int64()))], names=["block", "bucket", "answer", "stats"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for row in _each(batches):
            if row["bucket"] != last and held:
                yield from answered(last, held)
                held = []
            last = row["bucket"]
            held.append((row["block"], np.cumsum(unpacked(row["keys"]).view(np.uint64)), unpacked(row["counts"])))
        if held:
            yield from answered(last, held)

    sent = blocks.mapInArrow(send, "block long, bucket int, keys binary, counts binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    done = cut(met.mapInArrow(merge, "block long, bucket int, answer binary, stats array<long>"))
    stats = done.where("block = -1").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return done.where("block >= 0").drop("stats"), [r["v"] for r in stats.orderBy("i").collect()]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; packed cells stay where they are."""

    def cell(x):
        if isinstance(x, pa.BinaryScalar):
            return x.as_buffer()
        return [v.as_buffer() for v in x] if isinstance(x, pa.ListScalar) and pa.types.is_binary(x.type.value_type) else x.as_py()

    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: cell(batch.column(name)[i]) for name in batch.schema.names}


def _with(blocks: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """Blocks with their answers, by bucket in order; only the answers move."""
    for name, answer in answers.items():
        one = answer.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "answer"))), lambda x: x["answer"]).alias(name))
        blocks = blocks.join(one, "block")
    return blocks


def _matrix(parts: list[bytes], columns: int) -> np.ndarray:
    return np.concatenate([unpacked(p).reshape(columns, -1) for p in parts], axis=1)


# --- seating ----------------------------------------------------------------


@cache
def _ratios(discount: float) -> list[np.ndarray]:
    """By customers c: S(c, t + 1) / S(c, t) for t from 1, S the generalised
    Stirling numbers of the discount."""
    rows, s = [np.zeros(0), np.zeros(0)], np.array([1.0])
    for c in range(2, EXACT + 1):
        t = np.arange(1, c)
        s = np.concatenate([(c - 1 - discount * t) * s, [0.0]]) + np.concatenate([[0.0], s])
        rows.append(s[1:] / s[:-1])
    return rows


def _uniform(seeds: np.ndarray, turn: int) -> np.ndarray:
    return (mixed(seeds ^ mixed(np.array([turn + 7], np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def tables_drawn(customers: np.ndarray, weight: np.ndarray, chance: np.ndarray, discount: float, seeds: np.ndarray, turn: int) -> np.ndarray:
    """Tables of dishes with ``customers``: ``weight`` is the strength plus the
    discounted other tables of the restaurant, ``chance`` the parent's probability."""
    out = np.minimum(customers, 1)
    ratios = _ratios(discount)
    start = np.minimum(customers, EXACT)
    draw = _uniform(seeds, turn * 1000)
    order = np.argsort(start, kind="stable")
    edges = np.searchsorted(start[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        for a in range(edges[c - 2], edges[c - 1], 1 << 14):
            at = order[a : min(a + (1 << 14), edges[c - 1])]
            steps = ratios[c] * (weight[at, None] + discount * np.arange(1, c)) * chance[at, None]
            sums = np.cumsum(np.concatenate([np.ones((len(at), 1)), np.cumprod(steps, axis=1)], axis=1), axis=1)
            out[at] = 1 + (sums[:, :-1] < draw[at, None] * sums[:, -1:]).sum(1)
    at, seated, leap = np.flatnonzero(customers > EXACT), EXACT, 0
    while len(at):
        step = np.minimum(customers[at] - seated, max(1, seated // 4))
        new = (weight[at] + discount * out[at]) * chance[at]
        expected = np.minimum(step * new / (seated + step / 2 - discount * out[at] + new), step)
        leap += 1
        out[at] += np.minimum(np.floor(expected + _uniform(seeds[at], turn * 1000 + leap)).astype(np.int64), step)
        seated += max(1, seated // 4)
        at = at[customers[at] > seated]
    return out


def discount_of(ones: int, twos: int) -> float:
    """From how many things were seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Model:
    """Numbers that hold for the whole corpus, and the state of words by round."""

    def __init__(self, tokens: int, words: int, discounts: tuple[float, float], customers: list[list[int]], tables: list[list[int]], chains: int):
        self.tokens, self.words, self.discounts, self.chains = tokens, words, discounts, chains
        self.customers, self.tables = customers, tables  # of the parent, by round and chain

    def parent(self, turn: int, chain: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words in the parent restaurant."""
        strength, d = STRENGTHS[0], self.discounts[0]
        base = (strength + d * self.tables[turn][chain]) / (self.words + 1)
        return (customers - d * tables + base) / (strength + self.customers[turn][chain])

    def states(self, block: Block, words: list[np.ndarray], chain: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By round: probabilities in the parent and tables of the contexts, by
        word of the block. Round 0 has one table for each dish."""
        back = np.empty(len(block.by_hash), np.int64)
        back[block.by_hash] = np.arange(len(back))
        kinds, followers = words[0][2][back], words[0][3][back]
        out = [(self.parent(0, chain, kinds, (kinds > 0).astype(np.int64)), followers)]
        for turn, answer in enumerate(words[1:], 1):
            k, t, r = (answer[side * self.chains + chain][back] for side in range(3))
            out.append((self.parent(turn, chain, k, r), t))
        return out

    def seated(self, block: Block, counts: np.ndarray, states: list[tuple[np.ndarray, np.ndarray]], turns: int, chain: int) -> np.ndarray:
        """Tables of the block's pairs after ``turns`` rounds of one chain."""
        d = self.discounts[1]
        many = np.flatnonzero(counts > 1)
        u, w, customers, seeds = block.u[many], block.w[many], counts[many], block.pair[many]
        held = np.ones(len(many), np.int64)
        for turn in range(1, turns + 1):
            chance, tables = states[turn - 1]
            weight = STRENGTHS[1] + d * np.maximum(tables[u] - held, 0)
            held = tables_drawn(customers, weight, chance[w], d, seeds, turn * self.chains + chain)
        out = np.minimum(counts, 1)
        out[many] = held
        return out


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", chains: int = CHAINS, rounds: int = ROUNDS) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score,
    perplexity) of each row, learned from those where ``train`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(text, F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["key"]
    blocks, name, path = _blocks(rows, kind)
    try:
        out = cut(_scored(blocks, kind, chains, rounds))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, path)
    return out


def _scored(blocks: DataFrame, kind: str, chains: int, rounds: int) -> DataFrame:
    size = blocks.agg(F.sum("size")).first()[0] or 0
    schema = f"name long, key {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double"

    def pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
        block = Block(row)
        block.pairs()
        return block.pair, block.count[None]

    counted = lambda keys, sums: (np.zeros((0, len(keys)), np.int64), [int((sums[0] == 1).sum()), int((sums[0] == 2).sum())])
    counts, ones_twos = totals(blocks, max(1, -(-size // PAIRS)), pairs, counted)
    below = discount_of(*(ones_twos or (0, 0)))
    answers = {"pairs": counts}

    def words(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens, and as a context; distinct contexts, and followers."""
        block = Block(row)
        block.pairs()
        n = len(block.words)
        owned = _matrix(row["pairs"], 2)[1].astype(bool)
        parts = (block.tokens[block.learned], block.context[block.learned], block.w[owned], block.u[owned])
        return block.words[block.by_hash], np.stack([np.bincount(p, minlength=n) for p in parts])[:, block.by_hash].astype(np.int64)

    def known(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
        return np.zeros((0, len(keys)), np.int64), [int(sums[0].sum()), int((sums[0] > 0).sum()), int(sums[2].sum()), int((sums[2] > 0).sum()), int((sums[2] == 1).sum()), int((sums[2] == 2).sum())]

    word_buckets = max(1, -(-size // WORDS))
    answers["words0"], stats = totals(_with(blocks, answers), word_buckets, words, known)
    tokens, distinct, customers, tables, ones, twos = stats or [0] * 6
    model = Model(tokens, distinct, (discount_of(ones, twos), below), [[customers] * chains], [[tables] * chains], chains)

    def columns(turn: int) -> int:
        return 3 * chains + 1 if turn else 5

    for turn in range(1, rounds + 1):

        def tables_of(row: dict, turn: int = turn) -> tuple[np.ndarray, np.ndarray]:
            """By chain: tables of each word, and of each context, over owned pairs."""
            block = Block(row)
            block.pairs()
            n = len(block.words)
            counts, owned = _matrix(row["pairs"], 2)
            mine = owned.astype(bool)
            answered = [_matrix(row[f"words{i}"], columns(i)) for i in range(turn)]
            sums = [None] * (2 * chains)
            for c in range(chains):
                seats = model.seated(block, np.where(mine, counts, 0), model.states(block, answered, c), turn, c)[mine]
                sums[c], sums[chains + c] = (np.bincount(side[mine], seats, n) for side in (block.w, block.u))
            return block.words[block.by_hash], np.stack(sums)[:, block.by_hash].astype(np.int64)

        def parents(keys: np.ndarray, sums: np.ndarray, turn: int = turn) -> tuple[np.ndarray, list[int]]:
            d = model.discounts[0]
            even = np.full(len(keys), 1 / (model.words + 1))
            own = [tables_drawn(sums[c], np.full(len(keys), STRENGTHS[0] + d * max(0, model.tables[turn - 1][c] - 1)), even, d, keys, turn * chains + c) for c in range(chains)]
            return np.stack(own), [*(int(sums[c].sum()) for c in range(chains)), *(int(o.sum()) for o in own)]

        answers[f"words{turn}"], stats = totals(_with(blocks, answers), word_buckets, tables_of, parents)
        stats = stats or [0] * 2 * chains
        model.customers.append(stats[:chains])
        model.tables.append(stats[chains:])

    key_type = to_arrow_type(blocks.schema["keys"].dataType.elementType)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            block.pairs()
            counts = _matrix(row["pairs"], 2)[0]
            answered = [_matrix(row[f"words{i}"], columns(i)) for i in range(rounds + 1)]
            seen, customers = np.empty((2, len(block.words)), np.int64)
            seen[block.by_hash], customers[block.by_hash] = answered[0][0], answered[0][1]
            d, strength = model.discounts[1], STRENGTHS[1]
            chance = np.zeros(len(counts))
            for c in range(chains):
                states = model.states(block, answered, c)
                chance += np.maximum(counts - d * model.seated(block, counts, states, rounds, c), 0)
                parent, tables = states[rounds]
                chance += (strength + d * tables[block.u]) * parent[block.w]
            del answered, states
            chance /= model.chains * (strength + customers[block.u])
            starts = np.cumsum(block.lengths) - block.lengths
            sums = lambda values, of: np.add.reduceat(values[of], starts)
            one = [
                pa.array(block.first + np.arange(len(starts)), pa.int64()),
                pa.array(row["keys"], key_type),
                pa.array(block.train),
                pa.array(block.lengths),
                pa.array(sums((seen > 0).astype(np.int64), block.tokens)),
                pa.array(sums(np.log10((seen + 1) / (model.tokens + model.words + 1)), block.tokens)),
                pa.array(sums(np.log10(chance), block.at)),
            ]
            yield pa.RecordBatch.from_arrays(one, names=["name", "key", "learned", "n_tokens", "n_known", "base_score", "score"])

    pieces = _with(blocks, answers).mapInArrow(out, schema)
    whole = pieces.groupBy("name").agg(F.first("key").alias("id"), F.first("learned").alias("learned"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("id", "learned", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op12_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scored(docs, ~held_out("doc_id", 7, 2))
    return found.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
