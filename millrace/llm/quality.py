"""Quality classifier: histogram gradient-boosted trees over document statistics.

The driver fits on at most FIT_ROWS labelled rows (of those whose hash of the id is
below a threshold for about as many; the bound is the parameter ``fit_rows``); each row is then scored where it is read, by statistics of its whole text, without a shuffle. Features are cut into bins at quantiles, and each tree grows
level by level from sums of gradients by bin. Trees are complete, so they flatten into arrays (feature, bin, value) of fixed
shape, and scoring walks all rows through a level at once in numpy.

Defined cases: a null text is empty; an empty text has all statistics 0 and is scored like any other. A null or repeated id is scored row by row; its
labels count once, and contradicting labels of an id do not count. Labels that are null or not 0 or 1 are ignored. Without labels of both kinds every score
is the smoothed share of label 1. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

FIT_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15
L2 = 4.0
LEAST = 0.3
FOLDS = 5
FEATURES = ("log_words", "word_length", "upper", "digit", "punct", "symbol", "non_ascii", "space", "distinct_words", "top_word", "distinct_lines", "line_words", "end_marks", "long_words", "short_words", "bangs", "bars", "capital_lines", "sentence_words", "repeated_runs", "at_or_url", "title_words", "brackets", "line_ends")

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b".,;:!?'\"()-"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_END = b".!?"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> tuple[float, ...]:
    """FEATURES of a text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return (0.0,) * len(FEATURES)

    def share(chars: bytes) -> float:
        return (len(b) - len(b.translate(None, chars))) / len(b)

    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    low = [w.lower() for w in words]
    h = np.fromiter(map(common._HASHES.__getitem__, low), np.uint64, n)
    _, counts = np.unique(h, return_counts=True)
    lines = [x for x in b.split(b"\n") if x.strip()]
    runs = h[:-3] + np.uint64(3) * h[1:-2] + np.uint64(5) * h[2:-1] + np.uint64(7) * h[3:] if n > 3 else h[:1]
    return (
        np.log1p(n), lengths.mean(), share(_UPPER), share(_DIGIT), share(_MARKS), share(_SYMBOL), share(_HIGH),
        share(b" \t\n"), len(counts) / n, counts.max() / n, len(set(lines)) / len(lines), n / len(lines), sum(w[-1] in _END for w in words) / n, (lengths > 12).mean(), (lengths < 3).mean(),
        b.count(b"!") / n, b.count(b"|") / n, sum(x.isupper() for x in lines) / len(lines), n / (1 + b.count(b". ") + b.count(b".\n")), 1 - len(np.unique(runs)) / len(runs),
        (b.count(b"@") + b.count(b"://")) / n, sum(w[:1].isupper() for w in words) / n, share(b"()[]{}"), sum(x.rstrip()[-1] in _END for x in lines) / len(lines),
    )


@dataclass
class Trees:
    """Flat trees: node k of a level has the children 2k+1 and 2k+2; values of the last level only."""

    edges: list[np.ndarray]  # of bins, by feature
    feature: np.ndarray  # trees x (2**depth - 1)
    bin: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = self.value.shape[1].bit_length() - 1
        for f, b, v in zip(self.feature, self.bin, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, f[node]] > b[node])
            total += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(features)]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Trees(edges, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth)), float(np.log(p / (1 - p))))
    if not 0 < y.sum() < len(y):
        return model
    flat = model.binned(x).astype(np.int64) + np.arange(features) * bins
    raw, rows = np.full(len(y), model.base), np.arange(len(y))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, w = y - q, q * (1 - q)
        f, b, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64), np.zeros(len(y), np.int64)
        for level in range(depth):
            at = (node - (2**level - 1))[:, None] * (features * bins) + flat
            size = 2**level * features * bins
            gs = np.bincount(at.ravel(), np.repeat(g, features), size).reshape(-1, features, bins).cumsum(2)
            ws = np.bincount(at.ravel(), np.repeat(w, features), size).reshape(-1, features, bins).cumsum(2)
            gt, wt = gs[:, :, -1:], ws[:, :, -1:]
            gain = gs**2 / (ws + l2) + (gt - gs) ** 2 / (wt - ws + l2) - gt**2 / (wt + l2)
            best = gain.reshape(len(gain), -1).argmax(1)
            k = np.arange(2**level) + 2**level - 1
            split = gain.reshape(len(gain), -1)[np.arange(len(gain)), best] > 1e-9
            f[k], b[k] = best // bins, np.where(split, best % bins, bins)
            node = 2 * node + 1 + (flat[rows, f[node]] - f[node] * bins > b[node])
        leaf = node - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, w, 2**depth) + l2)
        raw += v[leaf]
        model.feature, model.bin, model.value = np.vstack([model.feature, f]), np.vstack([model.bin, b]), np.vstack([model.value, v])
    return model


def _features(found: list) -> np.ndarray:
    return np.array([statistics(t) for t in found], np.float32).reshape(-1, len(FEATURES))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [r.tobytes() for r in _features(b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["id", "x"])


def fold(id_: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> Trees:
    """Fitted on at most fit_rows labelled ids that documents have; an id with several texts counts with the statistics that sort first."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(fold(F.col("id")) != 0)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    known = known.join(docs.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    known = common.cut(known.select("id", "y", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h")))
    few = known.where(F.col("h") <= F.lit((1 << 31) * (fit_rows / max(1, known.count()))))  # fit_rows of them, but for chance
    sample = sorted(few.collect(), key=lambda r: (r["h"], r["id"]))[:fit_rows]
    y = {r["id"]: r["y"] for r in sample}
    sent = spark.sparkContext.broadcast(np.array(sorted(y), np.int64))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Statistics of the sample's rows."""
        ids = pa.array(sent.value)
        return _statistics(b.filter(pc.is_in(b.column(0), ids)) for b in batches)

    x = common.texts(docs, id_col, text_col).mapInArrow(common.tidied(chosen), "id long, x binary").groupBy("id").agg(F.min("x").alias("x"))
    with common.small_batches(spark):
        x = {r["id"]: r["x"] for r in x.collect()}  # a row for each id of the sample at most
    ids = [r["id"] for r in sample if r["id"] in x]
    return fit(np.frombuffer(b"".join(x[i] for i in ids), np.float32).reshape(-1, len(FEATURES)).astype(float), np.array([y[i] for i in ids], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = LEAST, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels of held-out ids (fold 0) are never used."""
    sent = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, label_col, fit_rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(_features(b.column(1).to_pylist()).astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = common.cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(common.tidied(apply), "doc_id long, score double"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows that aren't rejected, with all their columns, filtered where they are read. A row goes by its own text, whatever other rows of its id have."""
    sent = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, "quality", FIT_ROWS))
    rows, place = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            keep = sent.value.score(_features(b.column(0).field(place).to_pylist()).astype(float)) >= least
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(common.tidied(good), rows.schema).select("row.*")
