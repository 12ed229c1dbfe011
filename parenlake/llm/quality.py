"""Quality classifier: a factorisation machine (Rendle, 2010).

A text is a sparse vector: hashed words, binned statistics of its structure,
and its length as metadata. The score is

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part is computed in linear time as half of the sum over factors
of (sum v_if x_i)^2 - sum (v_if x_i)^2. Training sees a bounded sample of the
labelled rows in one task; scoring is Arrow-batched over all documents,
with a model of fixed size and no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from parenlake.llm.common import Rolling, WordHashes, bounded, raw_bytes, text_of

#: Statistics in the order in which ``statistics`` gives them.
STATISTICS = ("words", "bytes_per_word", "upper", "digits", "symbols", "marks", "other", "distinct", "top_word", "dup_lines", "words_per_line", "repeats")


@dataclass(frozen=True)
class Settings:
    """Parameters of the model. ``train_rows`` bounds the labelled sample."""

    train_rows: int = 6000
    buckets: int = 1 << 14
    bins: int = 12
    factors: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 11


@dataclass
class Model:
    edges: np.ndarray  # statistics x (bins - 1)
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    settings: Settings


class WordBuckets(dict):
    """word -> bucket, remembered up to a bound."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % self.buckets
        return value


def statistics(text: bytes, words: list[bytes], hashes: np.ndarray, top: int) -> list[float]:
    """Ratios that describe a text's structure."""
    n = max(1, len(words))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = Rolling(hashes).windows(5)
    return [
        np.log1p(len(words)),
        len(text) / n,
        count[65:91].sum() / letters,
        count[48:58].sum() / n,
        sum(int(count[ord(c)]) for c in "#*$%&|<>@^~") / n,
        sum(int(count[ord(c)]) for c in "!?.,;:") / n,
        count[128:].sum() / letters,
        len(set(words)) / n,
        top / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
    ]


def features(texts: list[bytes], buckets: WordBuckets, known: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    """Bucket numbers, their values (square roots of counts, unit length) and
    statistics of each text."""
    for text in texts:
        words = text.split()
        if words:
            found, count = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
            value = np.sqrt(count)
            value = value / np.sqrt(float(len(words)))
            top = int(count.max())
        else:
            found, value, top = np.zeros(0, np.int64), np.zeros(0), 0
        yield found, value, statistics(text, words, known.of(words), top)


def binned(stats: np.ndarray, edges: np.ndarray, settings: Settings) -> np.ndarray:
    """Feature number of each statistic's bin, rows x statistics."""
    at = np.stack([np.searchsorted(e, x, side="right") for e, x in zip(edges, stats.T, strict=True)], axis=1)
    return settings.buckets + np.arange(len(STATISTICS)) * settings.bins + at


def scores(index: np.ndarray, value: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and the factor sums of each row; every row has a feature."""
    part = model.factor[index] * value[:, None]
    sums = np.add.reduceat(part, starts)
    pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((part**2).sum(1), starts))
    return model.bias + np.add.reduceat(model.weight[index] * value, starts) + pairs, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def assemble(rows: list[tuple[np.ndarray, np.ndarray]], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat index, value and row start from words and binned statistics."""
    width = bins.shape[1]
    index = np.concatenate([x for (found, _), own in zip(rows, bins, strict=True) for x in (found, own)])
    one = np.full(width, 0.5)
    value = np.concatenate([x for _, v in rows for x in (v, one)])
    sizes = np.array([len(found) + width for found, _ in rows])
    return index, value, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def train(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """Adagrad on the logistic loss. Without rows, every score is 0.5."""
    rng = np.random.default_rng(settings.seed)
    size = settings.buckets + len(STATISTICS) * settings.bins
    model = Model(np.zeros((len(STATISTICS), settings.bins - 1)), 0.0, np.zeros(size), np.zeros((size, settings.factors)), settings)
    if not len(rows):
        return model
    model.edges = np.quantile(stats, np.linspace(0, 1, settings.bins + 1)[1:-1], axis=0).T.copy()
    model.factor = rng.normal(0, 0.05, (size, settings.factors))
    bins = binned(stats, model.edges, settings)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, settings.factors), 1e-6)
    for _ in range(settings.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            some = order[at : at + settings.batch]
            index, value, starts = assemble([rows[k] for k in some], bins[some])
            raw, sums = scores(index, value, starts, model)
            error = (sigmoid(raw) - labels[some]) / len(some)
            row = np.repeat(np.arange(len(some)), np.diff([*starts, len(index)]))
            pull = error[row] * value
            slope = pull[:, None] * (sums[row] - model.factor[index] * value[:, None])
            touched, inverse = np.unique(index, return_inverse=True)
            gw = np.bincount(inverse, pull) + settings.decay * model.weight[touched]
            gv = np.stack([np.bincount(inverse, slope[:, f]) for f in range(settings.factors)], axis=1) + settings.decay * model.factor[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            model.weight[touched] -= settings.rate * gw / np.sqrt(seen_w[touched])
            model.factor[touched] -= settings.rate * gv / np.sqrt(seen_v[touched])
            model.bias -= settings.rate * float(error.sum())
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on at most ``train_rows`` labelled rows, the first in a seeded
    order of their ids. Null labels and held-out rows are left out."""
    usable = labels.select(F.col("doc_id").alias("_doc"), F.col("quality").alias("_quality")).filter(F.col("_quality").isNotNull() & F.col("_doc").isNotNull() & ~held_out(F.col("_doc")))
    sample = usable.orderBy(F.xxhash64(F.lit(settings.seed), "_doc"), "_doc", "_quality").limit(settings.train_rows)
    texts = bounded(docs).select("doc_id", text_of("text").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"))
    # A repeated id counts once for each of its labels, so the bound holds.
    texts = texts.groupBy("doc_id", "_quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, known = WordBuckets(settings.buckets), WordHashes()
        for batch in batches:
            made = list(features(raw_bytes(batch.column(1)), buckets, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), *[pa.array([m[k] for m in made], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float32(), pa.float64()))]],
                names=["doc_id", "label", "found", "value", "stats"],
            )

    def learn(rows: pa.Table) -> pa.Table:
        model = learnt(rows, settings)
        return pa.table({n: [getattr(model, n).tobytes()] for n in ("edges", "weight", "factor")} | {"bias": [model.bias]})

    rows = texts.select("doc_id", "text", "_quality").mapInArrow(run, "doc_id long, label int, found array<int>, value array<float>, stats array<double>")
    # One task trains: the sample is bounded. The driver gets the model alone.
    row = rows.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "edges binary, weight binary, factor binary, bias double").first()
    if row is None:
        return train([], np.zeros((0, len(STATISTICS))), np.zeros(0), settings)
    edges, weight, factor = [np.frombuffer(row[n], np.float64).copy() for n in ("edges", "weight", "factor")]
    return Model(edges.reshape(len(STATISTICS), -1), row["bias"], weight, factor.reshape(len(weight), -1), settings)


def learnt(rows: pa.Table, settings: Settings) -> Model:
    """The model of a sample's rows, which come in any order: training sees them
    in one order. Values stay in arrays; as Python objects they would take
    several times the memory."""
    rows = rows.combine_chunks()
    doc_id, label = [rows.column(k).to_numpy() for k in ("doc_id", "label")]
    found, value, stats = [rows.column(k).combine_chunks() for k in ("found", "value", "stats")]
    found, value, stats = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (found, value, stats)]
    order = np.lexsort((label, doc_id))
    ends = found.offsets.to_numpy()
    found, value, stats = [x.flatten().to_numpy() for x in (found, value, stats)]
    some = [(found[ends[k] - ends[0] : ends[k + 1] - ends[0]], value[ends[k] - ends[0] : ends[k + 1] - ends[0]]) for k in order]
    return train(some, stats.reshape(len(order), len(STATISTICS))[order], (label[order] > 0).astype(float), settings)


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 at 0.5 and above) of each whole
    text. With ``keep``, the input's columns follow as they are under
    ``_row``. Null and empty texts are scored by their statistics alone;
    repeated rows get equal scores; an empty table gives an empty result.
    """
    columns = docs.columns if keep else ["doc_id", "text"]
    at = [columns.index("doc_id"), columns.index("text")]
    # Each text travels once, inside its row.
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    rows = bounded(docs).select(row)
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), *(rows.schema.fields if keep else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, known = WordBuckets(model.settings.buckets), WordHashes()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                doc_id, text = [batch.column(0).field(k) for k in at]
                made = list(features(raw_bytes(text), buckets, known))
                bins = binned(np.array([m[2] for m in made]), model.edges, model.settings)
                index, value, starts = assemble([m[:2] for m in made], bins)
                found = sigmoid(scores(index, value, starts, model)[0])
                yield pa.RecordBatch.from_arrays(
                    [doc_id.cast(pa.int64()), pa.array(found), pa.array((found >= 0.5).astype(np.int32)), *([batch.column(0)] if keep else [])],
                    names=["doc_id", "score", "predicted", *(["_row"] if keep else [])],
                )

    return rows.mapInArrow(run, schema)


def quality_table(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs, fit(docs, labels, settings))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
