"""Toxicity scores by non-negative positive-unlabelled learning (operator 1).

Confirmed toxic texts are the positives, all texts of the training fold (with or
without label) the unlabelled. The classifier minimises the class-prior-corrected
risk of Kiryo et al. 2017: prior * R+(p) + max(0, R-(u) - prior * R-(p)), where a
negative second part is stepped back. Features are hashed words and word starts,
present or not; hashing and scoring run on whole Arrow batches with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, settings, text_chunks

BUCKET_BITS = 21
#: Bytes of word starts that are features beside the whole word.
STARTS = (4, 5, 6, 7)
#: Bytes of text whose features are made at once; hashing takes about 40 times as much memory.
CHUNK_BYTES = 1 << 19

#: Bounds of the training sample: rows by the order of a hash of their ids, so it's the same for any layout.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 6000


class WordFeatures:
    """Distinct feature buckets of each text of a batch: (row, bucket) pairs."""

    def __init__(self, bits: int = BUCKET_BITS):
        rng = np.random.default_rng(7)
        self.bits = bits
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.codes[65:91] = self.codes[97:123]
        self.letter = np.zeros(256, bool)
        self.letter[48:58] = self.letter[65:91] = self.letter[97:123] = self.letter[128:] = True
        self.base = int(rng.integers(2**60, 2**63)) * 2 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, b in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                a = np.full(n, np.uint64(b % 2**64))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def pairs(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sorted distinct row << bits | bucket; wanted, a table by bucket, keeps only buckets that are true in it."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.letter[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:n]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:n], out=sums[1:])
        rows = np.searchsorted(offsets, starts, "right") - 1
        found, shift = [], np.uint64(64 - self.bits)
        for kind, size in enumerate((0, *STARTS)):
            a, r, e = starts, rows, ends
            if size:
                long = ends - starts > size
                a, r, e = starts[long], rows[long], starts[long] + size
            buckets = (mix64((sums[e] - sums[a]) * self.inverses[a] + np.uint64(kind)) >> shift).astype(np.int64)
            if wanted is not None:
                keep = wanted[buckets]
                buckets, r = buckets[keep], r[keep]
            found.append(r << self.bits | buckets)
        return np.unique(np.concatenate(found))


_FEATURES = WordFeatures()


@dataclass
class ToxicityModel:
    """Weights of the buckets that have one, a bias, and the class prior that was used."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def table(self) -> np.ndarray:
        w = np.zeros(1 << BUCKET_BITS, np.float64)
        w[self.buckets] = self.weights
        return w


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, least: int = 4, beta: float = 0.0, gamma: float = 1.0) -> ToxicityModel:
    """Fits on lists of distinct feature buckets, one array per text, by Adam over full batches.

    Features that fewer than `least` or one in a hundred positives have, or that
    positives don't have four times as often as the unlabelled, get no weight. Without
    positives or unlabelled texts the score of all texts is the prior.
    """
    size = 1 << BUCKET_BITS
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), base, prior)
    dp = np.bincount(np.concatenate(positive), minlength=size) / len(positive)
    du = np.bincount(np.concatenate(unlabelled), minlength=size) / len(unlabelled)
    chosen = np.flatnonzero((dp * len(positive) >= max(least, 0.01 * len(positive))) & (dp > 4 * du))
    index = np.full(size, -1)
    index[chosen] = np.arange(len(chosen))

    def csr(texts):
        cols = [c[c >= 0] for c in (index[t] for t in texts)]
        return np.repeat(np.arange(len(texts)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.empty(0, int), len(texts)

    sides = [csr(positive), csr(unlabelled)]
    w, b = np.zeros(len(chosen) + 1), base
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)

    def scores(side):
        r, c, n = side
        return np.bincount(r, w[c], n) + w[-1]

    def pull(side, slope):
        r, c, _ = side
        g = np.bincount(c, slope[r], len(w))
        g[-1] = slope.sum()
        return g

    sigmoid = lambda z: 0.5 * (1 + np.tanh(0.5 * z))
    for t in range(1, rounds + 1):
        gp, gu = scores(sides[0]), scores(sides[1])
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()  # loss of being called positive
        slope_negative = pull(sides[1], su / len(gu)) - prior * pull(sides[0], sp / len(gp))
        if negative >= -beta:
            grad = prior * pull(sides[0], (sp - 1) / len(gp)) + slope_negative
        else:
            grad = -gamma * slope_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    keep = np.abs(w[:-1]) > 1e-4
    return ToxicityModel(chosen[keep], w[:-1][keep], float(w[-1]), prior)


def _collect_features(texts: DataFrame) -> list[np.ndarray]:
    """Distinct buckets of each text; the caller bounds the rows."""

    def run(batches):
        for b in batches:
            out = []
            for i, j, data, off in text_chunks(b.column(0), CHUNK_BYTES):
                pairs = _FEATURES.pairs(data, off)
                rows = pairs >> BUCKET_BITS
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                buckets = (pairs & ((1 << BUCKET_BITS) - 1)).astype("<u4")
                out += [buckets[a:e].tobytes() for a, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["f"])

    with settings(texts.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):  # batches of a few MB of text
        return [np.frombuffer(r[0], "<u4").astype(np.int64) for r in texts.mapInArrow(run, "f binary").collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Trains on at most most_positive toxic and most_unlabelled texts; usable(id) limits the rows that may be learned from.

    The class prior is the share of toxic rows among all usable labelled ones
    (all of them are counted). Labels that aren't 0 or 1 are left out.
    """
    usable = F.lit(True) if usable is None else usable
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(max(toxic / total if total else 0.0, 1e-3), 0.5)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = {
        "p": known.where("y = 1").select("doc_id").distinct().orderBy(*order).limit(most_positive),
        "u": texts.where(usable).select("doc_id").orderBy(*order).limit(most_unlabelled).distinct(),
    }
    sides = []
    for ids, most in ((chosen["p"], most_positive), (chosen["u"], most_unlabelled)):  # an id may have several texts
        rows = texts.join(F.broadcast(ids), "doc_id").withColumn("version", F.xxhash64("text")).dropDuplicates(["doc_id", "version"])
        sides.append(_collect_features(rows.orderBy(*order, F.col("version")).limit(most).select("text")))
    return train_nnpu(*sides, prior)


def _scorer(model: ToxicityModel):
    """A function from an Arrow string column to scores."""
    buckets, weights, bias = model.buckets, model.weights, model.bias

    def scores(tables: list, column) -> np.ndarray:
        if not tables:
            table, wanted = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS, bool)
            table[buckets], wanted[buckets] = weights, True
            tables += [table, wanted]
        table, wanted = tables
        z = np.full(len(column), bias)
        for i, j, data, off in text_chunks(column, CHUNK_BYTES):
            pairs = _FEATURES.pairs(data, off, wanted)
            z[i:j] += np.bincount(pairs >> BUCKET_BITS, table[pairs & ((1 << BUCKET_BITS) - 1)], j - i)
        return 0.5 * (1 + np.tanh(0.5 * z))

    return scores


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row, from the whole text. Null and empty texts get the score of no features.

    Only the text is read. Ids may be null or repeated; an empty table gives no rows. No shuffle.
    """
    scores = _scorer(model)

    def run(batches):
        tables: list = []
        for b in batches:
            score = scores(tables, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns stay.

    Each row is judged by its own text, whatever its id. Null and empty texts
    have no features. An empty table gives no rows. No shuffle.
    """
    at, scores = docs.columns.index(text_col), _scorer(model)

    def run(batches):
        tables: list = []
        for b in batches:
            yield b.filter(pa.array(scores(tables, b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; remainder 1 is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, usable=fold(F.col("doc_id")) != 1)
    held = (fold(F.col("doc_id")) == 1).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted")
