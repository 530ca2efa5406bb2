"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

A rolling hash of 16 bytes picks triggers: every 50-byte window has one, the
leftmost place of its least hash, which depends on the window's bytes alone.
Consecutive windows of one trigger form a phrase, which holds all bytes of its
windows, so neighbouring phrases overlap and no window lies in two of them only
in part.  The parse of a document is its sequence of phrases, the dictionary is
the set of distinct phrases.  Highly repetitive text has few distinct phrases,
and most of the work is done on these:

1. documents are packed into blocks; each block names its distinct triggers,
   and triggers that no other document has are left out from then on;
2. each block sends its distinct phrases with other triggers once, with the
   least document that has them (the first of the phrase's places in corpus
   order), to the bucket of the trigger; there the suffixes of the dictionary
   are put in order as far as a window goes, equal windows stand together, and
   the parse's least document of all phrases with the window tells which
   windows an earlier document has;
3. the answers go back to the blocks as bits, and covered bytes are cut.

This departs from the textbook in one point.  There a phrase ends at a trigger,
a suffix shorter than the string looked for is told apart by the rank of the
rest of the parse, and so the parse needs a suffix array of its own; here a
phrase goes on to the end of its last window, so a window's place in the order
follows from the dictionary's suffixes alone and the parse only has to give the
first document.  A suffix array of the whole corpus would take several times
the disk that is allowed, and suffixes whose hash nothing else has aren't sorted.

A trigger that more than ``HOT`` blocks have (a licence line, padding) is hot:
its phrases are first folded over ``FAN`` blocks at a time, judged, and the
answers unfolded, so a task's share follows the distinct phrases and the number
of such sets of blocks.  Only hashes, distinct phrases and bits are shuffled
besides the packed blocks.  Buckets follow the size of the input.  The
comparison is of bytes, not of hashes: nothing is missed or removed in error.

Defined cases: null text is empty; texts shorter than a window stay whole; rows
of one id don't remove from each other; a null id counts as larger than all
others; an empty table gives no row; other columns are ignored.  Ids are 64-bit
numbers less than the largest, which stands for null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, small_batches, table

TRIGGER = 16
BLOCK_BYTES = 4 << 20
PIECE = 1 << 15
LEAST_BUCKETS = 256
#: blocks that a trigger may be in before its phrases are folded, blocks that are folded together
HOT, FAN = 64, 64
NO_ID = (1 << 63) - 1
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Hashes of the strings of ``a`` followed, ``at`` bytes on, by those of ``b``."""
    n = len(b) - at
    out = a[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += b[at:]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def phrases(data: np.ndarray, own: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, trigger hash) of every phrase of a block;
    ``own`` is the document of each byte, and no phrase leaves its document."""
    reach = window - TRIGGER + 1
    firsts, lasts, hashes = [], [], []
    for begin in range(0, max(0, len(data) - window + 1), PIECE):
        part = data[begin : begin + PIECE + window - 1]
        starts = np.flatnonzero(own[begin : begin + len(part) - window + 1] == own[begin + window - 1 : begin + len(part)])
        if not len(starts):
            continue
        roll, size = _TABLE[part], 1
        while size < TRIGGER:
            roll, size = _join(roll, roll, size), size * 2
        # hash above, place below: the least is the leftmost of the least hash
        least = (roll & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(roll), dtype=np.uint64)
        done = 1
        while done * 2 <= reach:
            least, done = np.minimum(least[:-done], least[done:]), done * 2
        if done < reach:
            least = np.minimum(least[: len(least) - (reach - done)], least[reach - done :])
        place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        firsts.append(starts[new] + begin)
        lasts.append(starts[np.concatenate([new[1:], [len(starts)]]) - 1] + begin)
        # triggers are least hashes, so low ones: mixed once more they spread over the buckets
        mixed = roll[place[new]] * np.uint64(0x9E3779B97F4A7C15)
        hashes.append((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) & ~np.uint64(1))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Block:
    """A packed block, parsed."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, window: int):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.data = zstandard.decompress(data, max_output_size=int(self.sizes.sum()) or 1)
        self.ends = np.cumsum(self.sizes)
        self.window = window
        own = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first, self.last, hashes = phrases(np.frombuffer(self.data, np.uint8), own, window)
        self.owner = own[self.first] if len(self.first) else np.zeros(0, np.int32)
        self.triggers, self.place = np.unique(hashes, return_inverse=True)

    def named(self) -> np.ndarray:
        """The distinct triggers in order; the low bit is set where two ids of the block have it."""
        low, high = np.full(len(self.triggers), NO_ID), np.full(len(self.triggers), -NO_ID)
        np.minimum.at(low, self.place, self.ids[self.owner])
        np.maximum.at(high, self.place, self.ids[self.owner])
        return self.triggers | (low != high).astype(np.uint64)

    def dictionary(self, shared: np.ndarray, hot: np.ndarray, buckets: int):
        """For phrases whose trigger is ``shared``: by phrase its places (document,
        first window), and ((bucket, whether its trigger is hot), bytes, least id)
        of each, bucket by bucket."""
        at: dict[bytes, list[tuple[int, int]]] = {}
        bucket: dict[bytes, tuple[int, bool]] = {}
        rows = np.flatnonzero(shared[self.place]) if len(shared) else np.zeros(0, np.int64)
        numbers = _bucket(self.triggers[self.place[rows]], buckets)
        keys = zip(numbers.tolist(), hot[self.place[rows]].tolist() if len(rows) else [], strict=True)
        for first, last, doc, number in zip(self.first[rows].tolist(), self.last[rows].tolist(), self.owner[rows].tolist(), keys, strict=True):
            phrase = self.data[first : last + self.window]
            found = at.get(phrase)
            if found is None:
                at[phrase], bucket[phrase] = [(doc, first)], number
            else:
                found.append((doc, first))
        order = sorted(at, key=bucket.__getitem__)
        return at, [(bucket[p], p, min(int(self.ids[d]) for d, _ in at[p])) for p in order]


def equal_windows(text: bytes, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, group) of the windows that have an equal one: the suffixes at
    ``starts`` put in order by eight bytes at a time, as far as a window goes;
    suffixes that stand alone are in place and drop out."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,))
    # windows whose hash nothing else has stand alone; the others are compared in full
    mixed = np.zeros(len(starts), np.uint64)
    for step in [*range(0, window - 8, 8), window - 8]:
        mixed ^= words[starts + step]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    turn = np.argsort(mixed)
    twin = mixed[turn][1:] == mixed[turn][:-1]
    order = np.sort(turn[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]) if len(starts) else turn
    group = np.zeros(len(order), np.int64)
    for step in [*range(0, window - 8, 8), window - 8]:
        if not len(order):
            break
        word = words[starts[order] + step].byteswap()
        turn = np.lexsort((word, group)) if step else np.argsort(word, kind="stable")
        order, group, word = order[turn], group[turn], word[turn]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        group = np.cumsum(new)[~alone]
        order = order[~alone]
    return order, group


def earlier(phrases: list[bytes], least: np.ndarray, window: int) -> np.ndarray:
    """For each phrase a bit for each of its windows that a phrase of a smaller
    least id has, first window lowest."""
    sizes = np.array([len(p) for p in phrases], np.int64)
    counts = sizes - window + 1
    base = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(phrases)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(phrases), np.uint64)
    places, group = equal_windows(b"".join(phrases), base[phrase] + offset, window)
    if len(places):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.minimum.reduceat(least[phrase[places]], heads)
        first = np.repeat(first, np.diff(np.concatenate([heads, [len(places)]])))
        hit = places[first < least[phrase[places]]]
        np.bitwise_or.at(out, phrase[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return out


def _pack(docs: DataFrame, key: str, column: str, block_bytes: int) -> DataFrame:
    """Rows of about ``block_bytes`` of text: block, ids, sizes, data (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(held))
            cells = [number, np.array(ids, np.int64).tobytes(), np.array([len(h) for h in held], np.int64).tobytes(), data, size]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["block", "ids", "sizes", "data", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                held.append(text or b"")
                size += len(held[-1])
                if size >= block_bytes or len(ids) >= block_bytes // 64:
                    yield row()
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(key).cast("long"), column).mapInArrow(run, "block long, ids binary, sizes binary, data binary, n long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", column: str = "text", window: int = 50, block_bytes: int = BLOCK_BYTES, most: int = HOT, fan: int = FAN) -> DataFrame:
    """key, n_bytes, spans (array of removed start and end, in bytes) and kept
    (the remaining bytes) of every row."""
    if not TRIGGER + 8 <= window <= 79:
        raise ValueError("window must be 24 to 79 bytes")
    small_batches(docs.sparkSession)
    blocks = cut(_pack(docs, key, column, block_bytes))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // block_bytes)
    supers = max(1, -(-total // (block_bytes * fan)))
    part_schema = "bucket long, block long, data binary"
    step_schema = "kind int, super long, bucket long, block long, data binary"

    def part(bucket: list[int], block: list[int], data: list[bytes]) -> pa.Table:
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "data": pa.array(data, pa.binary())})

    def steps(rows: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "super", "bucket", "block", "data"])

    def opened(row: pa.Table) -> Block:
        return Block(*(row.column(c)[0].as_py() for c in ("ids", "sizes", "data")), window)

    def split(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
        numbers = _bucket(values, buckets)
        heads = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(values) else []
        return [(int(numbers[h]), v) for h, v in zip(heads, np.split(values, heads[1:]) if len(heads) else [], strict=True)]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(n, 1)])
                parts = split(opened(row).named())
                yield from part([b for b, _ in parts], row.column("block").to_pylist() * len(parts), [v.tobytes() for _, v in parts]).to_batches()

    def common(group: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(d, np.uint64) for d in group.column("data").to_pylist()]
        flat = np.concatenate(arrays)
        shared, values = (flat & np.uint64(1)).astype(bool), flat >> np.uint64(1)
        order = np.argsort(values)
        # in how many blocks each trigger is
        heads = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]])) if len(values) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([heads, [len(values)]]))
        held = np.empty(len(values), np.int64)
        held[order] = np.repeat(times, times)
        ends = np.cumsum([len(a) for a in arrays])[:-1]
        bits = zip(np.split(shared | (held > 1), ends), np.split(held > most, ends), strict=True)
        return part(group.column("bucket").to_pylist(), group.column("block").to_pylist(), [np.packbits(a).tobytes() + np.packbits(b).tobytes() for a, b in bits])

    answers = cut(blocks.select("block", "ids", "sizes", "data").mapInArrow(name, part_schema).groupBy("bucket").applyInArrow(common, part_schema))

    def known(block: Block, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's triggers are shared, and which are hot, from the
        answers of all buckets."""
        rows = group.filter(group.column("kind").to_numpy() == 0).sort_by("bucket") if group.num_rows else group
        said = dict(zip(rows.column("bucket").to_pylist(), rows.column("data").to_pylist(), strict=True))
        both = [(np.frombuffer(said[b], np.uint8).reshape(2, -1), len(v)) for b, v in split(block.triggers)]
        read = lambda n: np.concatenate([np.unpackbits(bits[n], count=size) for bits, size in both]).astype(bool) if both else np.zeros(0, bool)
        return read(0), read(1)

    def packed(phrases: list[bytes], ids: list[int]) -> bytes:
        head = np.array([len(phrases), *map(len, phrases)], np.uint32).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + np.array(ids, np.int64).tobytes() + b"".join(phrases))

    def unpacked(data: bytes) -> tuple[list[bytes], np.ndarray]:
        data = zstandard.decompress(data)
        n = int.from_bytes(data[:4], "little")
        ends = 4 + 12 * n + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)
        return [data[a:b] for a, b in zip([4 + 12 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)], np.frombuffer(data[4 + 4 * n : 4 + 12 * n], np.int64)

    def numbered(rows: list[bytes]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The dictionary of the rows: distinct phrases with their numbers, the
        number and least id of each entry, the first document of each phrase, and
        where the entries of each row end."""
        number: dict[bytes, int] = {}
        entry, least, ends = [], [], [0]
        for row in rows:
            phrases, ids = unpacked(row)
            entry += [number.setdefault(t, len(number)) for t in phrases]
            least.append(ids)
            ends.append(len(entry))
        places, ids = np.array(entry, np.int64), np.concatenate(least)
        first = np.full(len(number), NO_ID)
        np.minimum.at(first, places, ids)
        return number, places, ids, first, ends

    def every(phrases) -> np.ndarray:
        return (np.uint64(1) << np.array([len(t) - window + 1 for t in phrases], np.uint64)) - np.uint64(1)

    def judged(rows: list[bytes]) -> list[bytes]:
        """For each row the bits of its phrases' windows that an earlier document has."""
        number, entry, least, first, ends = numbered(rows)
        bits = np.where(least > first[entry], every(number)[entry], earlier(list(number), first, window)[entry])
        return [bits[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block, number = opened(left), left.column("block")[0].as_py()
        by: dict[tuple[int, bool], tuple[list[bytes], list[int]]] = {}
        for key, phrase, least in block.dictionary(*known(block, right), buckets)[1]:
            texts, ids = by.setdefault(key, ([], []))
            texts.append(phrase)
            ids.append(least)
        group = (number * 0x9E3779B97F4A7C15 >> 32 & 0x7FFFFFFF) % supers
        return steps([(0, group if hot else -1, bucket, number, packed(*held)) for (bucket, hot), held in by.items()])

    def of(group: pa.Table) -> tuple[int, int]:
        return group.column("bucket")[0].as_py(), group.column("super")[0].as_py()

    def judge_step(group: pa.Table) -> pa.Table:
        """Buckets of common triggers are judged at once."""
        bucket, which = of(group)
        if which >= 0:
            return part([], [], [])
        return part([bucket] * group.num_rows, group.column("block").to_pylist(), judged(group.column("data").to_pylist()))

    def fold_step(group: pa.Table) -> pa.Table:
        """Of hot triggers the phrases of some blocks become one row."""
        bucket, which = of(group)
        if which < 0:
            return steps([])
        number, _, _, first, _ = numbered(group.column("data").to_pylist())
        order = sorted(number)
        return steps([(2, which, bucket, which, packed(order, [int(first[number[t]]) for t in order]))])

    def hot_step(group: pa.Table) -> pa.Table:
        return steps([(4, w, group.column("bucket")[0].as_py(), w, bits) for w, bits in zip(group.column("super").to_pylist(), judged(group.column("data").to_pylist()), strict=True)])

    def back_step(left: pa.Table, right: pa.Table) -> pa.Table:
        """From the answer for the folded phrases to those of each block."""
        if not right.num_rows:
            return part([], [], [])
        data = left.column("data").to_pylist()
        number, entry, least, first, ends = numbered(data)
        said = np.empty(len(number), np.uint64)
        said[[number[t] for t in sorted(number)]] = np.frombuffer(right.column("data")[0].as_py(), np.uint64)
        bits = np.where(least > first[entry], every(number)[entry], said[entry])
        return part([left.column("bucket")[0].as_py()] * len(data), left.column("block").to_pylist(), [bits[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)])

    stage = [blocks.select("block", "ids", "sizes", "data").groupBy("block"), answers.withColumn("kind", F.lit(0))]
    sent = stage[0].cogroup(stage[1].groupBy("block")).applyInArrow(send, step_schema)
    # one exchange serves all three, and each does its own part of the work
    grouped = sent.groupBy("bucket", "super")
    plain_said = grouped.applyInArrow(judge_step, part_schema)
    hot_said = grouped.applyInArrow(fold_step, step_schema).groupBy("bucket").applyInArrow(hot_step, step_schema)
    # folded phrases travel in byte order, so that both steps agree on their numbers
    spread = grouped.cogroup(hot_said.groupBy("bucket", "super")).applyInArrow(back_step, part_schema)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        block = opened(left)
        at, order = block.dictionary(*known(block, right), buckets)
        rows = right.filter(right.column("kind").to_numpy() > 0) if right.num_rows else right
        keys = zip(rows.column("bucket").to_pylist(), (k == 4 for k in rows.column("kind").to_pylist()), strict=True)
        said = {b: np.frombuffer(d, np.uint64) for b, d in zip(keys, rows.column("data").to_pylist(), strict=True)}
        gone = np.zeros(len(block.data) + 1, np.int32)
        seen: dict[tuple[int, bool], int] = {}
        for bucket, phrase, least in order:
            n = seen[bucket] = seen.get(bucket, -1) + 1
            bits, count = int(said[bucket][n]), len(phrase) - window + 1
            for doc, first in at[phrase]:
                if block.ids[doc] > least:
                    gone[first] += 1
                    gone[first + len(phrase)] -= 1
                elif bits == (1 << count) - 1:
                    gone[first] += 1
                    gone[first + len(phrase)] -= 1
                elif bits:
                    for k in range(count):
                        if bits >> k & 1:
                            gone[first + k] += 1
                            gone[first + k + window] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        data, out, begin = np.frombuffer(block.data, np.uint8), [], 0
        for i, size, end in zip(block.ids.tolist(), block.sizes.tolist(), block.ends.tolist(), strict=True):
            mask = covered[begin:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            out.append((None if i == NO_ID else i, size, spans, data[begin:end][~mask].tobytes()))
            begin = end
        a, b, c, d = zip(*out, strict=True)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({key: pa.array(a, pa.int64()), "n_bytes": pa.array(b, pa.int64()), "spans": pa.array(c, span), "kept": pa.array(d, pa.binary())})

    replies = stage[1].unionByName(plain_said.withColumn("kind", F.lit(1))).unionByName(spread.withColumn("kind", F.lit(4)))
    return stage[0].cogroup(replies.groupBy("block")).applyInArrow(apply, f"`{key}` long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS s FROM d),
g AS (SELECT doc_id, s, substring(h, 2 * s + 1, 100) AS x FROM w),
m AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x),
hit AS (SELECT g.doc_id, s, CASE WHEN s > lag(s + 50) OVER (PARTITION BY g.doc_id ORDER BY s) THEN 1 ELSE 0 END AS new FROM g JOIN m ON g.x = m.x WHERE least < g.doc_id),
run AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hit) GROUP BY doc_id, k),
cut AS (SELECT run.doc_id, a, b, substring(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS kept FROM run JOIN d ON d.doc_id = run.doc_id WINDOW o AS (PARTITION BY run.doc_id ORDER BY a)),
r AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans, max(b) AS tail, string_agg(kept, '' ORDER BY a) AS kept FROM cut GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
