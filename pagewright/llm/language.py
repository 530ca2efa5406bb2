"""Language identification by a byte convolutional network.

Bytes of the UTF-8 text get trained vectors; filters of several widths slide
over windows of fixed length, are max-pooled over each window, pass a ramp and
feed a softmax.  The network is trained in numpy by Adam on labelled texts.
As its input is bytes, a filter is a sum of table look-ups, so prediction
gathers rows of small tables over whole batches of windows.  A document's
probabilities are the mean over all its windows, weighted by their bytes.

Training takes the labelled rows of at most ``TRAIN_DOCS`` keys (those of least
hash), as far as their texts hold ``_shared.TRAIN_BYTES`` together, and draws
its batches from all windows of their whole texts; prediction reads every byte
of every text.

Defined cases: null text, empty text and text of no letter are ``und`` with
score 0; rows of null label or null key are not learned from, equal rows count
once, and rows of one key with different texts are learned from each with its
own label; ``held_out`` of a null key is true, as it is never learned from;
repeated rows are predicted each; if nothing can be learned from, all is
``und``; an empty table gives no row; other columns are kept and columns named
like the results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import labelled_texts, pieces, small_batches, table, texts

TRAIN_DOCS = 4000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
VECTOR = 8
STEPS = 400
BATCH = 96
RATE = 0.01
HAS_LETTER = regex.compile(r"\p{L}").search


@dataclass
class Network:
    labels: list[str]
    vectors: np.ndarray  # (256, VECTOR)
    filters: list[np.ndarray]  # one (width, VECTOR, FILTERS) each
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """By offset in a filter: (256, filters that reach so far), widest first."""
        wide = sorted(self.filters, key=len, reverse=True)
        return [np.concatenate([self.vectors @ f[j] for f in wide if len(f) > j], 1).astype(np.float32) for j in range(len(wide[0]))]

    def pooled(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """(windows, length) bytes to (windows, length, filters) responses."""
        out = tables[0][windows]
        for j, t in enumerate(tables[1:], 1):
            out[:, :-j, : t.shape[1]] += t[windows[:, j:]]
        return out

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        top = self.pooled(windows, tables).max(1)
        return softmax(np.maximum(top + self.bias, 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last filled up by zeros."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(max(1, -(-len(data) // WINDOW)) * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(-1, WINDOW)


def train(samples: list[tuple[str, str]], seed: int = 7) -> Network | None:
    """Fit a network on (text, label) pairs."""
    labels = sorted({label for _, label in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    xs = [windows_of(text) for text, _ in samples]
    x, y = np.concatenate(xs), np.array([labels.index(label) for _, label in samples])
    sizes = np.array([len(rows) for rows in xs])
    starts = np.cumsum(sizes) - sizes
    total = FILTERS * len(WIDTHS)
    net = Network(labels, rng.normal(0, 0.5, (256, VECTOR)), [rng.normal(0, 0.4, (w, VECTOR, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.2, (total, len(labels))), np.zeros(len(labels)))
    weight = len(y) / (len(labels) * np.bincount(y, minlength=len(labels)))
    params = [net.vectors, *net.filters, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    wide = sorted(range(len(WIDTHS)), key=lambda i: -WIDTHS[i])  # in the order of tables()
    for step in range(1, STEPS + 1):
        # a text, then any of its windows: long texts count no more than short ones
        pick = rng.integers(0, len(y), BATCH)
        rows, want = x[starts[pick] + (rng.random(BATCH) * sizes[pick]).astype(np.int64)], y[pick]
        responses = net.pooled(rows, net.tables())
        at = responses.argmax(1)
        top = np.take_along_axis(responses, at[:, None], 1)[:, 0] + net.bias
        ramp = np.maximum(top, 0)
        slope = softmax(ramp @ net.weights + net.offset)
        slope[np.arange(BATCH), want] -= 1
        slope *= weight[want][:, None] / BATCH
        back = (slope @ net.weights.T) * (top > 0)
        vectors, filters = np.zeros_like(net.vectors), [np.zeros_like(f) for f in net.filters]
        for k, i in enumerate(wide):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(WIDTHS[i]):
                place = at[:, part] + j
                seen = rows[np.arange(BATCH)[:, None], np.minimum(place, WINDOW - 1)]
                pull = back[:, part] * (place < WINDOW)
                filters[i][j] = np.einsum("bf,bfd->df", pull, net.vectors[seen])
                np.add.at(vectors, seen, pull[..., None] * net.filters[i][j].T[None])
        slopes = [vectors, *filters, back.sum(0), ramp.T @ slope, slope.sum(0)]
        for p, g, a, b in zip(params, slopes, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", limit: int = TRAIN_DOCS) -> Network | None:
    """Train on the labelled rows with a letter of at most ``limit`` keys, taken by the hash of ``key``."""
    return train([(t, str(y)) for t, y in labelled_texts(docs, key, text, label, limit) if HAS_LETTER(t)])


def predict(docs: DataFrame, net: Network | None, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its mean probability."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(column)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else []
        for batch in pieces(batches):
            names, scores = [], []
            said = [t if net and HAS_LETTER(t) else "" for t in texts(batch.column(place))]
            rows = [windows_of(t) for t in said]
            flat = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
            used = (flat != 0).sum(1) + 1e-9
            chance = np.concatenate([net.probabilities(flat[i : i + 64], tables) for i in range(0, len(flat), 64)]) if net and len(flat) else np.zeros((len(flat), 1))
            ends = np.cumsum([0, *map(len, rows)])
            for i, t in enumerate(said):
                part = slice(ends[i], ends[i + 1])
                if not t:
                    names.append("und")
                    scores.append(0.0)
                    continue
                mean = (chance[part] * used[part][:, None]).sum(0) / used[part].sum()
                names.append(net.labels[int(mean.argmax())])
                scores.append(float(min(1.0, mean.max())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str, folds: int, fold: int):
    """Whether a row's fold is the one not learned from; a null key is."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(True))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = predict(docs.select("doc_id", "text"), net).drop("text")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
