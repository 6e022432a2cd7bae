"""Quality classifier: a convolutional network over bytes, in numpy.

Filters of WIDTH bytes slide over the whole text. Chunks of 2 * HOP bytes that overlap by half hold the
maximum of each filter; a dense layer turns a chunk's maxima into features, whose maximum and mean over
the chunks give one probability. It is trained on the driver, on a sample of labelled documents of a
bounded size, and applied to all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, HOP = 8, 2, 128
EMBED, FILTERS, HIDDEN = 8, 24, 16
#: Labelled documents of each class that the network is trained on, at most.
SAMPLE_PER_CLASS = 1000
EPOCHS = 14
KEEP_FROM = 0.5
_BLOCK = 1 << 16


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _tables: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *s: r.standard_normal(s).astype(np.float32)
        embed = normal(257, EMBED) * 0.5
        embed[256] = 0  # padding
        return Network(embed, normal(WIDTH, EMBED, FILTERS) * 0.25, np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN) * 0.3, np.zeros(HIDDEN, np.float32), normal(2 * HIDDEN) * 0.3, np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter, by its place in the window."""
        return np.einsum("be,kef->kbf", self.embed, self.filters)

    def cells(self, text: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter in each HOP bytes, and the start of its window. text: padded codes."""
        n = len(text) // HOP
        top = np.empty((n, FILTERS), np.float32)
        at = np.empty((n, FILTERS), np.int64) if where else None
        padded = np.concatenate((text, np.full(WIDTH, 256, text.dtype)))
        for i in range(0, len(text), _BLOCK):
            size = min(_BLOCK, len(text) - i)
            some = tables[0].take(padded[i : i + size : STRIDE], axis=0)
            for k in range(1, WIDTH):
                some += tables[k].take(padded[i + k : i + k + size : STRIDE], axis=0)
            some = some.reshape(size // HOP, HOP // STRIDE, FILTERS)
            c = i // HOP
            if at is None:
                top[c : c + len(some)] = some.max(axis=1)
            else:
                best = some.argmax(axis=1)
                top[c : c + len(some)] = np.take_along_axis(some, best[:, None], 1)[:, 0]
                at[c : c + len(some)] = best * STRIDE + (np.arange(len(some)) * HOP + i)[:, None]
        return top, at

    def forward(self, text: np.ndarray, first: np.ndarray, tables: np.ndarray, where: bool = False) -> dict:
        """first: the first cell of each text, and the number of cells."""
        top, at = self.cells(text, tables, where)
        n = len(top)
        nxt = np.minimum(np.arange(n) + 1, np.repeat(first[1:] - 1, np.diff(first)))
        later = top[nxt] > top
        pooled = np.where(later, top[nxt], top)
        z1 = pooled + self.bias
        a1 = np.maximum(z1, 0)
        h = np.maximum(a1 @ self.dense + self.dense_bias, 0)
        count = np.diff(first).astype(np.float32)[:, None]
        most, mean = np.maximum.reduceat(h, first[:-1]), np.add.reduceat(h, first[:-1]) / count
        logit = np.concatenate((most, mean), axis=1) @ self.out + self.out_bias
        return {"at": at, "nxt": nxt, "later": later, "a1": a1, "h": h, "most": most, "mean": mean, "count": count, "logit": logit}

    def probability(self, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self._tables is None:
            self._tables = self.tables()
        return 1 / (1 + np.exp(-self.forward(text, first, self._tables)["logit"].astype(np.float64)))

    def gradients(self, text: np.ndarray, first: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        f = self.forward(text, first, self.tables(), True)
        g = ((1 / (1 + np.exp(-f["logit"])) - label) / len(label)).astype(np.float32)
        g_out = np.concatenate((f["most"], f["mean"]), axis=1).T @ g
        owner = np.repeat(np.arange(len(label)), np.diff(first))
        back = g[:, None] * self.out
        g_h = (back[:, HIDDEN:] / f["count"])[owner]
        is_most = f["h"] == f["most"][owner]
        ties = np.add.reduceat(is_most.astype(np.float32), first[:-1])
        g_h += np.where(is_most, (back[:, :HIDDEN] / ties)[owner], 0)
        g_h *= f["h"] > 0
        g_dense, g_dense_bias = f["a1"].T @ g_h, g_h.sum(0)
        g_top = (g_h @ self.dense.T) * (f["a1"] > 0)
        g_bias = g_top.sum(0)
        cell = np.where(f["later"], f["nxt"][:, None], np.arange(len(owner))[:, None])
        start = f["at"][cell, np.arange(FILTERS)]
        padded = np.concatenate((text, np.full(WIDTH, 256, text.dtype)))
        g_tables = np.empty((WIDTH, 257, FILTERS), np.float32)
        column = np.broadcast_to(np.arange(FILTERS), start.shape)
        for k in range(WIDTH):
            g_tables[k] = np.bincount((padded[start + k].astype(np.int64) * FILTERS + column).ravel(), weights=g_top.ravel(), minlength=257 * FILTERS).reshape(257, FILTERS)
        g_filters = np.einsum("be,kbf->kef", self.embed, g_tables)
        g_embed = np.einsum("kbf,kef->be", g_tables, self.filters)
        g_embed[256] = 0
        return [g_embed, g_filters, g_bias, g_dense, g_dense_bias, g_out, g.sum(keepdims=True)]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts and the first cell of each. Each fills whole cells behind WIDTH codes of padding, so that the
    last windows of the text before it read none of its bytes."""
    cells = [-(-(WIDTH + len(t)) // HOP) for t in texts]
    first = np.concatenate(([0], np.cumsum(cells)))
    out = np.full(int(first[-1]) * HOP, 256, np.int16)
    for t, c in zip(texts, first):
        out[c * HOP + WIDTH : c * HOP + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
    return out, first


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = 32, rate: float = 0.004) -> Network:
    net = Network.fresh(seed)
    r = np.random.default_rng(seed)
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            step += 1
            now = rate * (1 if epoch < epochs * 2 // 3 else 0.25)
            for w, g, a, b in zip(net.weights(), net.gradients(*padded([texts[k] for k in some]), labels[some]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network | None:
    """A network trained on at most per_class labelled documents of each class, chosen by a hash of doc_id.

    None where one of the two classes has no document with a text. Null ids and labels are left out, and
    documents that are labelled both good and bad; a label that is repeated counts once. Of the rows that repeat a
    doc_id the text that comes first in order is taken.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    share = {x["quality"]: x["n"] for x in known.groupBy("quality").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).toArrow() for q in (0, 1)]
    table = pa.concat_tables(picked)
    rows = spark.createDataFrame(table.to_pandas() if table.num_rows else [], "doc_id long, quality int")
    # no more than 2 * per_class rows
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("length(text) > 0").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    label = np.array(texts["quality"].to_pylist(), np.float32)
    if not (0 in label and 1 in label):
        return None
    net = train([t.encode() for t in texts["text"].to_pylist()], label)
    # the sample holds the classes in other shares than all labels do
    net.out_bias += np.float32(np.log(share[1] / share[0]) - np.log((label == 1).sum() / (label == 0).sum()))
    return net


def score_column(net: Network | None, column: pa.Array) -> np.ndarray:
    """The probability of good quality of each text; null and empty texts have 0, and without a network others have 1."""
    out = np.zeros(len(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    full = np.flatnonzero(sizes > 0)
    if net is None:
        out[full] = 1.0
        return out
    i = 0
    while i < len(full):
        j = i + 1
        size = int(sizes[full[i]])
        while j < len(full) and size + sizes[full[j]] <= 4 * _BLOCK:
            size += int(sizes[full[j]])
            j += 1
        texts = [t.encode() for t in column.take(pa.array(full[i:j])).to_pylist()]
        out[full[i:j]] = net.probability(*padded(texts))
        i = j
    return out


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, quality) for every row of docs: the probability that its text is of good quality.

    Null and empty texts have quality 0. Null doc_ids and repeated rows are scored like any. Further
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_column(net, batch.column(1)))], ["doc_id", "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, quality double")


def keep_good(docs: DataFrame, net: Network | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, with all their columns, whose quality is at least keep_from; decided in one pass.

    Null and empty texts have quality 0 and go. Null doc_ids and repeated rows are decided by their text, and without
    a network every text stays.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_column(net, batch.column(place)) >= keep_from))

    return docs.mapInArrow(run, docs.schema)
