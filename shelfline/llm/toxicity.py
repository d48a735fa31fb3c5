"""Toxicity scores from a bidirectional gated recurrent network with attention.

A word enters the network as the embedding of the word itself and the summed
embeddings of its leading and trailing character n-grams (hashed buckets).  Over
every window of consecutive words, windows overlapping by half, a gated
recurrent unit runs in both directions; attention pools its states to one logit.
A text's logit is a learned combination of a soft maximum and the mean over all
its windows, so the whole text counts.  Gates use the rational sigmoid and
softsign, which cost a fraction of exponentials.

The network is trained in numpy on a bounded sample of labelled rows: about
``per_class`` documents of each label, chosen by a hash of their id against exact
counts, of at most ``longest`` characters.  Both bounds are parameters; scoring
has none.

Nulls and odd rows: a null or wordless text scores as an empty window; unlabelled
rows are never learned from, and without both labels the score is the share of
toxic labels (0 if there is none); repeated labels of a document count once (1
wins); repeated documents give one row each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T

#: Bytes of 0-9, letters and of every character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True

SPAN = 48
STRIDE = 24
BUCKETS = 1 << 15
HIDDEN = 8
DEPTH = 8
LEADING = (3, 4, 5, 6, 7)
TRAILING = (3, 5)
SHARPNESS = np.float32(2.0)


def features(data: np.ndarray, offs: np.ndarray):
    """Buckets of each word and of its character n-grams, and each text's first word."""
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offs, WORD)
    grams = np.empty((len(starts), 1 + len(LEADING) + len(TRAILING)), np.int32)
    at = 0
    while at < len(starts):  # in blocks: a very long text needs little more memory than its words
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + (4 << 20), side="right")))
        h = T.Hasher(data[base : ends[end - 1]])
        a, b = starts[at:end] - base, ends[at:end] - base
        found = [h(a, b)] + [h(a, np.minimum(a + k, b)) for k in LEADING] + [h(np.maximum(b - k, a), b) for k in TRAILING]
        for j, x in enumerate(found):
            grams[at:end, j] = T.mixed(x + np.uint64(j)) & np.uint64(BUCKETS - 1)
        at = end
    return grams, first


def window_index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, SPAN) word numbers, -1 beyond the text, and each window's text; an empty text has one window."""
    counts = np.diff(first)
    n = np.maximum(-(-(counts - SPAN) // STRIDE) + 1, 1)
    owner, k = T.runs(n)
    at = (first[:-1][owner] + k * STRIDE)[:, None] + np.arange(SPAN)
    return np.where(at < first[1:][owner][:, None], at, -1), owner


def _gate(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) + np.float32(0.5) * x / (1 + np.abs(x))


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class BiGRU:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda s, *shape: draw.normal(0, s, shape).astype(np.float32)
        self.p = {
            "word": np.zeros((BUCKETS, DEPTH), np.float32),
            "char": np.zeros((BUCKETS, DEPTH), np.float32),
            "in": normal(0.4, 2 * DEPTH, 6 * HIDDEN),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "rec0": normal(0.3, HIDDEN, 3 * HIDDEN),
            "rec1": normal(0.3, HIDDEN, 3 * HIDDEN),
            "att": normal(0.4, 2 * HIDDEN, HIDDEN),
            "attv": normal(0.8, HIDDEN),
            "out": normal(0.5, 2 * HIDDEN),
            "doc": np.array([1.0, 0.5, -2.0], np.float32),
        }

    def embed(self, grams: np.ndarray) -> np.ndarray:
        chars = self.p["char"][grams[:, 1]]
        for j in range(2, grams.shape[1]):
            chars = chars + self.p["char"][grams[:, j]]
        return np.concatenate([self.p["word"][grams[:, 0]], chars], axis=1)

    def _run(self, x: np.ndarray, rec: np.ndarray, keep: bool):
        """States of one direction; x (time, batch, 3 * hidden) in its order of time."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, trace = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)):
            r = h @ rec
            pre = x[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
            g = _gate(pre)
            u, z = g[:, :HIDDEN], g[:, HIDDEN:]
            cand = x[t, :, 2 * HIDDEN :] + u * r[:, 2 * HIDDEN :]
            c = _soft(cand)
            new = h + z * (c - h)
            if keep:
                trace.append((h, pre, u, z, r[:, 2 * HIDDEN :], cand, c))
            h = states[t] = new
        return states, trace

    def _unrun(self, d: np.ndarray, rec: np.ndarray, trace):
        """Gradients of the inputs and of the recurrent weights, given those of the states."""
        dx, drec = np.empty((len(d), d.shape[1], 3 * HIDDEN), np.float32), np.zeros_like(rec)
        dh = np.zeros(d.shape[1:], np.float32)
        for t in range(len(d) - 1, -1, -1):
            h, pre, u, z, rc, cand, c = trace[t]
            dh = dh + d[t]
            dcand = dh * z / (1 + np.abs(cand)) ** 2
            dg = np.concatenate([dcand * rc, dh * (c - h)], axis=1) * np.float32(0.5) / (1 + np.abs(pre)) ** 2
            dr = np.concatenate([dg, dcand * u], axis=1)
            dx[t, :, : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dg, dcand
            drec += h.T @ dr
            dh = dh * (1 - z) + dr @ rec.T
        return dx, drec

    def windows(self, emb: np.ndarray, index: np.ndarray, keep: bool = False):
        """A logit for each window; emb (words, 2 * depth)."""
        proj = np.concatenate([emb, np.zeros((1, emb.shape[1]), np.float32)]) @ self.p["in"] + self.p["bias"]
        x = proj[index.T]  # -1 is the appended zero word
        ahead, trace0 = self._run(x[:, :, : 3 * HIDDEN], self.p["rec0"], keep)
        back, trace1 = self._run(x[::-1, :, 3 * HIDDEN :], self.p["rec1"], keep)
        h = np.concatenate([ahead, back[::-1]], axis=2)
        pre = h @ self.p["att"]
        hidden = _soft(pre)
        e = np.where(index.T >= 0, hidden @ self.p["attv"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        ctx = np.einsum("tb,tbh->bh", alpha, h)
        return ctx @ self.p["out"], (h, pre, hidden, alpha, ctx, trace0, trace1) if keep else None

    def pooled(self, z: np.ndarray, owner: np.ndarray):
        """Soft maximum and mean of each text's windows (owners are sorted and without gaps)."""
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(begin, len(owner))).astype(np.float32)
        top = np.maximum.reduceat(z, begin)
        w = np.exp(SHARPNESS * (z - top[owner]))
        total = np.add.reduceat(w, begin)
        return top + np.log(total) / SHARPNESS, np.add.reduceat(z, begin) / count, w / total[owner], count

    def logits(self, grams: np.ndarray, first: np.ndarray, block: int = 4096) -> np.ndarray:
        index, owner = window_index(first)
        emb = self.embed(grams)
        z = np.concatenate([self.windows(emb, index[a : a + block])[0] for a in range(0, len(index), block)])
        high, mean, _, _ = self.pooled(z, owner)
        a, b, c = self.p["doc"]
        return a * high + b * mean + c

    def gradients(self, grams, first, y, weight):
        index, owner = window_index(first)
        emb = self.embed(grams)
        z, (h, pre, hidden, alpha, ctx, trace0, trace1) = self.windows(emb, index, keep=True)
        high, mean, share, count = self.pooled(z, owner)
        a, b, c = self.p["doc"]
        s = a * high + b * mean + c
        ds = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight).astype(np.float32)
        g = {"doc": np.array([(ds * high).sum(), (ds * mean).sum(), ds.sum()], np.float32)}
        dz = (ds * a)[owner] * share + (ds * b / count)[owner]
        g["out"] = ctx.T @ dz
        dctx = dz[:, None] * self.p["out"]
        dalpha = np.einsum("bh,tbh->tb", dctx, h)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        dpre = de[:, :, None] * self.p["attv"] / (1 + np.abs(pre)) ** 2
        g["attv"] = np.einsum("tb,tbh->h", de, hidden)
        flat = h.reshape(-1, h.shape[2])
        g["att"] = flat.T @ dpre.reshape(-1, dpre.shape[2])
        dh = alpha[:, :, None] * dctx + dpre @ self.p["att"].T
        dx0, g["rec0"] = self._unrun(np.ascontiguousarray(dh[:, :, :HIDDEN]), self.p["rec0"], trace0)
        dx1, g["rec1"] = self._unrun(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), self.p["rec1"], trace1)
        dx = np.concatenate([dx0, dx1[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        g["bias"] = dx.sum(axis=0)
        at = index.T.reshape(-1)
        dproj = np.zeros((len(emb) + 1, 6 * HIDDEN), np.float32)
        np.add.at(dproj, at, dx)
        g["in"] = emb.T @ dproj[:-1]
        demb = dproj[:-1] @ self.p["in"].T
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -s, s))).sum())
        return g, demb, loss


def fit(data: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, batch_words: int = 12_000, rate: float = 6e-3, seed: int = 4) -> BiGRU:
    """Trains on whole texts for a fixed number of steps; buckets that fewer than 4 texts use stay at zero."""
    model, draw = BiGRU(), np.random.default_rng(seed)
    grams, first = features(data, offs)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    seen = []
    for columns in (slice(0, 1), slice(1, None)):
        pairs = np.unique(owner[:, None].astype(np.int64) * BUCKETS + grams[:, columns])
        seen.append(np.bincount(pairs % BUCKETS, minlength=BUCKETS) >= 4)
    slow = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step = 0

    def update(name: str, grad: np.ndarray, rows=None) -> None:
        m, v = slow[name]
        at = slice(None) if rows is None else rows
        m[at] += np.float32(0.1) * (grad - m[at])
        v[at] += np.float32(0.01) * (grad * grad - v[at])
        bias = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        model.p[name][at] -= np.float32(pace * bias) * m[at] / (np.sqrt(v[at]) + np.float32(1e-6))

    while step < steps:
        order = draw.permutation(len(counts))
        cuts = np.flatnonzero(np.diff(np.cumsum(counts[order] + SPAN) // batch_words)) + 1
        for pick in np.split(order, cuts)[: steps - step]:
            pace = rate * (1 - step / (1.2 * steps))
            group, k = T.runs(counts[pick])
            words = grams[first[:-1][pick][group] + k]
            part = np.concatenate([[0], np.cumsum(counts[pick])])
            g, demb, _ = model.gradients(words, part, y[pick], weight[pick] / weight[pick].sum())
            step += 1
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            clip = np.float32(min(1.0, 2.0 / (size + 1e-9)))
            for name, x in g.items():
                update(name, x * clip)
            for name, d, columns, known in (("word", demb[:, :DEPTH], words[:, :1], seen[0]), ("char", demb[:, DEPTH:], words[:, 1:], seen[1])):
                flat = columns.reshape(-1)
                live = known[flat]
                rows, inverse = np.unique(flat[live], return_inverse=True)
                total = np.zeros((len(rows), DEPTH), np.float32)
                np.add.at(total, inverse, np.repeat(d, columns.shape[1], axis=0)[live])
                update(name, total * clip + np.float32(1e-4) * model.p[name][rows], rows)
    return model


def training_rows(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int, longest: int) -> DataFrame:
    """doc_id, y, text and the class's rows for each sampled one."""
    marked = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = marked.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.least(F.lit(float(per_class)) / F.col("n"), F.lit(1.0))
    drawn = marked.join(F.broadcast(counts), "y").where(draw < rate).select("doc_id", "y", (1 / rate).alias("weight"))
    texts = documents.where(F.length("text").between(1, longest)).select("doc_id", "text")
    return texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])


def train(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = 700, longest: int = 12_000, steps: int = 300) -> BiGRU | float:
    """A network fitted on a bounded sample, or the share of toxic labels if only one label is there."""
    rows = training_rows(documents, labels, learn, per_class, longest).toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.float32)
    if len(rows) == 0 or y.min() == y.max():
        return float(y.mean()) if len(rows) else 0.0
    return fit(*T.buffer(pa.array(rows["text"], pa.large_string())), y, rows["weight"].to_numpy(np.float32), steps)


def scores(model: BiGRU | float, column) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(column), model)
    if not len(column):
        return np.zeros(0)
    s = model.logits(*features(*T.buffer(column)))
    return 1 / (1 + np.exp(-np.clip(s, -30, 30).astype(np.float64)))


def score(documents: DataFrame, model: BiGRU | float) -> DataFrame:
    """doc_id and the score of every whole text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, limit=1 << 19):
                found = scores(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(apply, "doc_id long, score double")


def keep_clean(documents: DataFrame, model: BiGRU | float, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, limit=1 << 19):
                yield batch.filter(pa.array(scores(model, batch.column("text").cast(pa.string())) < least))

    return documents.mapInArrow(keep, documents.schema)
