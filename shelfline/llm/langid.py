"""Language identification with a convolutional network over bytes.

Texts are cut into consecutive windows of fixed length.  Bytes are embedded,
filters of several widths slide over each window, each filter keeps its maximum,
and a softmax layer gives the languages' probabilities; a text takes the
language with the largest mean over its windows, so every byte counts.

The network is trained in numpy on windows of a bounded sample: from each learned
language about ``docs_per_language`` documents, chosen by a hash of their id
against the language's exact count, and up to ``windows_per_doc`` windows of each
at hashed places.  The bounds are parameters; scoring has none.

Nulls and odd rows: a null text, or one without any letter, is ``und`` with score
0; rows without a language are never learned from, and without any labelled row
every text is ``und``; an empty table gives an empty result; repeated rows give
one row each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
UNKNOWN = "und"


class ByteConvNet:
    """Embedding, filters of all widths side by side (short ones padded by zeros), max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 1) -> None:
        draw = np.random.default_rng(seed)
        self.classes = classes
        reach, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((reach * DEPTH, n), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[: width * DEPTH, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "emb": draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "conv": (draw.normal(0, 0.25, (reach * DEPTH, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": draw.normal(0, 0.2, (n, len(classes))).astype(np.float32),
            "base": np.zeros(len(classes), np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        emb = self.p["emb"][x]
        b, n, d = emb.shape
        reach = max(WIDTHS)
        view = np.lib.stride_tricks.as_strided(
            emb, (b, n - reach + 1, reach * d), (emb.strides[0], emb.strides[1], emb.strides[2])
        )
        return np.ascontiguousarray(view).reshape(b, n - reach + 1, reach * d)

    def pooled(self, x: np.ndarray):
        flat = self._windows(x)
        act = (flat.reshape(-1, flat.shape[2]) @ self.p["conv"]).reshape(flat.shape[0], flat.shape[1], -1)
        return flat, act

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), block):
            _, act = self.pooled(x[at : at + block])
            top = np.maximum(act.max(axis=1) + self.p["bias"], 0)
            z = top @ self.p["out"] + self.p["base"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + block] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 3e-3, seed: int = 2):
        draw = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.classes)), 1) / len(self.classes)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                xb, yb = x[pick], y[pick]
                flat, act = self.pooled(xb)
                where = act.argmax(axis=1)
                rows, cols = np.arange(len(pick))[:, None], np.arange(act.shape[2])[None, :]
                pre = act[rows, where, cols] + self.p["bias"]
                top = np.maximum(pre, 0)
                z = top @ self.p["out"] + self.p["base"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(pick)), yb] -= 1
                z *= (weight[yb] / len(pick))[:, None]
                g = {"out": top.T @ z, "base": z.sum(0)}
                d = (z @ self.p["out"].T) * (pre > 0)
                g["bias"] = d.sum(0)
                seen = flat[rows, where]  # (batch, filters, reach * depth)
                g["conv"] = np.einsum("bf,bfk->kf", d, seen) * self.mask
                back = (d[:, :, None] * self.p["conv"].T[None]).reshape(len(pick), act.shape[2], -1, DEPTH)
                g["emb"] = np.zeros_like(self.p["emb"])
                for k in range(back.shape[2]):
                    np.add.at(g["emb"], xb[rows, where + k], back[:, :, k])
                step += 1
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover each text, the last one padded by zeros, and the text each belongs to."""
    counts = -(-np.diff(offs) // WINDOW)
    owner, k = T.runs(counts)
    begin = offs[:-1][owner] + k * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offs[1:][owner][:, None]
    padded = np.append(T.LOWER[data], np.uint8(0))
    return padded[np.where(inside, at, len(data))], owner


def training_rows(documents: DataFrame, learn: Column, docs_per_language: int, windows_per_doc: int) -> DataFrame:
    """Windows (as strings of WINDOW characters) of the bounded sample, with their language."""
    labelled = documents.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    places = F.greatest(F.ceil(F.length("text") / WINDOW).cast("int"), F.lit(1))
    chosen = labelled.join(F.broadcast(counts), "lang").where(draw < F.lit(float(docs_per_language)) / F.col("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(windows_per_doc - 1))).alias("k")
    spread = chosen.select("doc_id", "lang", "text", places.alias("places"), k).where(F.col("k") < F.col("places"))
    place = F.when(F.col("places") <= windows_per_doc, F.col("k")).otherwise(
        F.pmod(F.xxhash64("doc_id", "k"), F.col("places")).cast("int")
    )
    return spread.select("lang", F.substring("text", place * WINDOW + 1, WINDOW).alias("text"), "doc_id", "k")


def train(
    documents: DataFrame, learn: Column, docs_per_language: int = 400, windows_per_doc: int = 6, epochs: int = 4
) -> ByteConvNet | None:
    """A network fitted on a bounded sample; None without labelled rows.

    ``learn`` says which rows may be learned from.  Languages are a small closed
    set: more than 1,000 distinct labels are refused.
    """
    rows = training_rows(documents, learn, docs_per_language, windows_per_doc).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "doc_id", "k"], kind="stable")
    classes = sorted(rows["lang"].unique())
    if len(classes) > 1000:
        raise ValueError("more than 1,000 languages")
    data, offs = T.buffer(pa.array(rows["text"]))
    x, owner = windows(data, offs)
    y = rows["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy()[owner]
    return ByteConvNet(classes).fit(x, y, epochs)


def predict(model: ByteConvNet | None, column) -> tuple[np.ndarray, np.ndarray]:
    """Language and score for every text of an Arrow column."""
    n = len(column)
    lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    langs, scores = np.full(n, UNKNOWN, object), np.zeros(n)
    if model is None or not lettered.any():
        return langs, scores
    data, offs = T.buffer(column)
    x, owner = windows(data, offs)
    sums = np.zeros((n, len(model.classes)))
    np.add.at(sums, owner, model.probabilities(x))
    mean = sums / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    best = mean.argmax(axis=1)
    langs[lettered] = np.array(model.classes, object)[best[lettered]]
    scores[lettered] = np.minimum(mean[np.arange(n), best], 1.0)[lettered]
    return langs, scores


def identify(documents: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, limit=1 << 20):
                langs, scores = predict(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
                )

    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_confident(documents: DataFrame, model: ByteConvNet | None, least: float = 0.3) -> DataFrame:
    """The documents in a known language with at least the given score, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, limit=1 << 20):
                langs, scores = predict(model, batch.column("text").cast(pa.string()))
                yield batch.filter(pa.array((langs != UNKNOWN) & (scores >= least)))

    return documents.mapInArrow(keep, documents.schema)
