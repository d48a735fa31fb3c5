"""Quality scores from gradient-boosted trees over statistics of a document.

Statistics of a slice of texts are counted together from byte classes, word
hashes and line hashes.  Trees are grown in numpy on binned statistics, split by
histograms of gradients, and kept as flat arrays (statistic, bound, children,
value) that all rows of a slice walk through side by side.

The trees are fitted on a bounded sample of labelled rows: about ``per_class``
documents of each label, chosen by a hash of their id against exact counts.  Only
their statistics reach the driver.  The bound is a parameter; scoring has none.

Nulls and odd rows: a null or empty text has statistics of zero and the score
that goes with them; unlabelled rows are never learned from, and without both
labels the score is the share of label 1 (0.5 without labels); repeated labels of
a document count once (the larger); repeated documents give one row each; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LINE = np.ones(256, bool)
LINE[0x0A] = False


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "lower": _class(bytes(range(97, 123))),
    "digit": _class(b"0123456789"),
    "beyond_ascii": _class(bytes(range(128, 256))),
    "stop": _class(b".?"),
    "comma": _class(b",;:"),
    "shout": _class(b"!"),
    "bar": _class(b"|<>{}[]\\/=_~^"),
    "symbol": _class(b"#$%&*@+"),
}

NAMES = [*CLASSES, "log_bytes", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeats", "distinct_triples", "lines", "distinct_lines", "top_line_share", "ends_marked"]


def _counts(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) statistics, each a share or a logarithm."""
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    columns = [_counts(c[data], offs) / size for c in CLASSES.values()]
    starts, ends, first = T.spans(data, offs, WORD)
    h = T.word_hashes(data, starts, ends)
    words = np.maximum(np.diff(first), 1).astype(np.float64)
    length = ends - starts
    columns += [np.log1p(np.diff(offs)), np.log1p(np.diff(first)), _counts(length, first) / words, _counts(length > 12, first) / words, _counts(length < 3, first) / words]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    triples = h.copy()
    if len(h) > 2:
        triples[:-2] += h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7)
    begins, stops, line_first = T.spans(data, offs, LINE)
    lines = T.word_hashes(data, begins, stops)
    line_size = stops - begins
    tail = np.zeros(256, bool)
    tail[list(b".?!:;\"')")] = True
    marked = tail[data[stops - 1]] if len(stops) else np.zeros(0, bool)
    distinct, top, three, own_lines, top_line = (np.zeros(len(size)) for _ in range(5))
    for i in range(len(size)):
        a, b = first[i], first[i + 1]
        if b > a:
            _, n = np.unique(h[a:b], return_counts=True)
            distinct[i], top[i] = len(n) / (b - a), n.max() / (b - a)
            three[i] = len(np.unique(triples[a : max(a + 1, b - 2)])) / max(1, b - a - 2)
        a, b = line_first[i], line_first[i + 1]
        if b > a:
            own_lines[i] = len(np.unique(lines[a:b])) / (b - a)
            top_line[i] = line_size[a:b].max() / size[i]
    rows = np.maximum(np.diff(line_first), 1)
    columns += [distinct, top, _counts(again, first) / words, three, np.log1p(np.diff(line_first)), own_lines, top_line, _counts(marked, line_first) / rows]
    return np.stack(columns, axis=1)


class Trees:
    """Boosted trees in flat arrays; a leaf's children are itself."""

    def __init__(self, base: float) -> None:
        self.base, self.roots = base, []
        self.feature, self.bound, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        n = len(self.value)
        for column, x in ((self.feature, 0), (self.bound, np.inf), (self.left, n), (self.right, n), (self.value, value)):
            column.append(x)
        return n

    def freeze(self) -> Trees:
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.bound, self.value = np.array(self.bound), np.array(self.value)
        return self

    def logits(self, x: np.ndarray, depth: int) -> np.ndarray:
        """All trees at once: (rows, trees) node numbers step down together."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = np.where(part[row, self.feature[node]] <= self.bound[node], self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0):
    """(Trees, depth) for log loss; split candidates are quantiles of each statistic."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(share / (1 - share))))
    z = np.full(len(y), model.base)
    flat = binned + np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = (p - y) * weight, p * (1 - p) * weight
        root = model._node(0.0)
        model.roots.append(root)
        level = [(root, np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                model.value[node] = -rate * total_g / (total_h + ridge)
                if d == depth or len(rows) < 2 * least:
                    continue
                cells = flat[rows].reshape(-1)
                grid = x.shape[1] * bins
                width = x.shape[1]
                hist_g = np.bincount(cells, np.repeat(g[rows], width), grid).reshape(width, bins).cumsum(axis=1)
                hist_h = np.bincount(cells, np.repeat(h[rows], width), grid).reshape(width, bins).cumsum(axis=1)
                hist_n = np.bincount(cells, minlength=grid).reshape(width, bins).cumsum(axis=1)
                gain = hist_g**2 / (hist_h + ridge) + (total_g - hist_g) ** 2 / (total_h - hist_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(hist_n < least) | (len(rows) - hist_n < least)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                go = binned[rows, f] <= b
                model.feature[node], model.bound[node] = int(f), float(edges[f][b])
                model.left[node], model.right[node] = model._node(0.0), model._node(0.0)
                below += [(model.left[node], rows[go]), (model.right[node], rows[~go])]
            level = below
        z += _walk(model, x, root, depth)
    return model.freeze(), depth


def _walk(model: Trees, x: np.ndarray, root: int, depth: int) -> np.ndarray:
    """Values of one tree that is still growing."""
    feature, bound, left, right, value = (np.array(c) for c in (model.feature, model.bound, model.left, model.right, model.value))
    node = np.full(len(x), root)
    for _ in range(depth):
        node = np.where(x[np.arange(len(x)), feature[node]] <= bound[node], left[node], right[node])
    return value[node]


def measured(documents: DataFrame, extra: str = "") -> DataFrame:
    """doc_id, ``extra`` columns and the statistics of every whole text."""
    names = [n for n in extra.split(",") if n]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole):
                found = statistics(*T.buffer(batch.column("text")))
                offs = np.arange(len(found) + 1) * len(NAMES)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(n) for n in names), T.arrays(found.reshape(-1), offs, pa.float64())], ["doc_id", *names, "stats"])

    kinds = dict(documents.dtypes)
    schema = ", ".join(["doc_id long", *(f"{n} {kinds[n]}" for n in names), "stats array<double>"])
    return documents.mapInArrow(apply, schema)


def train(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = 4000):
    """(Trees, depth) fitted on a bounded sample, or the share of label 1 if only one label is there."""
    marked = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    counts = marked.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.least(F.lit(float(per_class)) / F.col("n"), F.lit(1.0))
    drawn = marked.join(F.broadcast(counts), "y").where(draw < rate).select("doc_id", "y", (1 / rate).alias("weight"))
    chosen = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    rows = measured(chosen, "y,weight").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return grow(np.stack(rows["stats"].to_numpy()), y, rows["weight"].to_numpy(np.float64))


def score(documents: DataFrame, model) -> DataFrame:
    """doc_id and the score of every whole text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole):
                if isinstance(model, float):
                    found = np.full(batch.num_rows, model)
                else:
                    trees, depth = model
                    found = 1 / (1 + np.exp(-trees.logits(statistics(*T.buffer(batch.column("text"))), depth)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(apply, "doc_id long, score double")
