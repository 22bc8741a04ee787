"""Toxicity by a factorization machine over hashed terms.

1. A bounded sample of labelled training rows (SAMPLE at most, chosen by a hash of doc_id) is joined with
   its texts by broadcast.
2. Each term's document counts by class are summed on the cluster; all terms of LEAST_DOCS texts or more are
   features (2 ** BITS at most).  A feature's value is (g / (g + EVIDENCE)) ** 2, where g is the log-likelihood ratio
   of the term and the class, so that common terms without bearing weigh little and none is left out.
3. The features of the sample's rows (nothing else) come to the driver, which fits a factorization machine
   by AdaGrad: a bias, a weight for each term and FACTORS latent factors for pairs of terms that meet in a
   text, such as an insult and a group.
4. Every whole text is scored on the executors: sigmoid(bias + sum of weights + pairwise interactions).

Terms are the lower-cased words of a text, hashed to 2 ** BITS slots; labels, lang, source and doc_id are
never inputs of a score.

Cases: null or empty text has no terms and gets the bias's score; without labelled rows the score is 0 but for rounding (below 1e-9);
null labels are left out; of labels repeated for a doc_id the largest counts; repeated documents are scored
row by row; a null doc_id is hashed as an empty string.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import materialize, small, table

FOLDS, HELD_OUT = 4, 2
SAMPLE = 20_000
BITS = 20
EVIDENCE = 16.0
LEAST_DOCS = 4
FACTORS = 8
EPOCHS, BATCH, RATE, L2 = 30, 256, 0.5, 1e-5
SPREAD = 0.2  # of the latent factors at the start; smaller ones hardly leave zero
THRESHOLD = 0.3
REMEMBERED = 500_000
_TERM = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    return set(_TERM.findall(text.lower())) if text else set()


def slot(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "replace")) >> (32 - BITS)


def train_fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled training rows."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train_fold()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    share = int(1_000_000 * min(1.0, 0.95 * sample / n)) if n > sample else 1_000_000
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def _slots(batches):
    for batch in small(batches):
        found = [sorted({slot(t) for t in terms(x)}) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "slots"])


class FactorizationMachine:
    """score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over a text's features i."""

    def __init__(self, size: int, prior: float, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = math.log(prior / (1 - prior)) if 0 < prior < 1 else (-50.0 if prior <= 0 else 50.0)
        self.w = np.zeros(size)
        self.v = rng.normal(0, SPREAD, (size, factors))

    def raw(self, features: np.ndarray) -> float:
        v = self.v[features]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[features].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, features: list[int]) -> float:
        z = self.raw(np.array(features, np.int64)) if features else self.w0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11, values: np.ndarray | None = None) -> FactorizationMachine:
        """values: those of the features where a text has them (1 if not given); they go into the weights at the end."""
        if not len(self.w):  # no terms: the bias stays
            return self
        values = np.ones(len(self.w)) if values is None else values
        rng = np.random.default_rng(seed)
        # squared steps start at 1, so that terms of few texts, whose gradients are small, move little
        g0, gw, gv = 1.0, np.ones_like(self.w), np.ones_like(self.v)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                lengths = [len(rows[i]) for i in pick]
                used, flat = np.unique(np.concatenate([rows[i] for i in pick]), return_inverse=True)
                row = np.repeat(np.arange(len(pick)), lengths)
                w, v = self.w[used], self.v[used]  # only what the batch holds is read and written
                x = values[used][flat]
                own = v[flat] * x[:, None]
                s = np.stack([np.bincount(row, own[:, f], len(pick)) for f in range(v.shape[1])], axis=1)
                pair = 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (own * own).sum(axis=1), len(pick)))
                z = np.clip(self.w0 + np.bincount(row, w[flat] * x, len(pick)) + pair, -50, 50)
                error = 1 / (1 + np.exp(-z)) - y[pick]
                e = error[row] * x
                d0 = error.sum()
                g0 += d0 * d0
                self.w0 -= RATE * d0 / math.sqrt(g0)
                dw = np.bincount(flat, e, len(used)) + L2 * len(pick) * w
                gw[used] += dw * dw
                self.w[used] = w - RATE * dw / np.sqrt(gw[used])
                step = e[:, None] * (s[row] - own)
                dv = np.stack([np.bincount(flat, step[:, f], len(used)) for f in range(v.shape[1])], axis=1) + L2 * len(pick) * v
                gv[used] += dv * dv
                self.v[used] = v - RATE * dv / np.sqrt(gv[used])
        self.w *= values
        self.v *= values[:, None]
        return self


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], FactorizationMachine]:
    """The features (slot -> number) and the machine."""
    rows = materialize(labelled(docs, labels).mapInArrow(_slots, "doc_id long, toxic int, slots array<int>"), "toxic-sample")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = sums["n"], sums["bad"] or 0
    prior = bad / n if n else 0.0
    if not bad or bad == n:
        return {}, FactorizationMachine(0, prior)
    counts = rows.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    part = lambda seen, of, texts: F.when(seen > 0, 2 * seen * F.log(seen * n / (of * texts))).otherwise(0.0)
    ratio = part(a, bad, a + b) + part(b, n - bad, a + b) + part(bad - a, bad, n - a - b) + part(n - bad - b, n - bad, n - a - b)
    chosen = counts.where(a + b >= LEAST_DOCS).select("slot", ratio.alias("g")).toArrow().sort_by("slot")  # 2 ** BITS rows at most
    features = {s: k for k, s in enumerate(chosen.column("slot").to_pylist())}
    g = np.maximum(0.0, chosen.column("g").to_numpy())
    wanted = rows.sparkSession.sparkContext.broadcast(features)

    def reduced(batches):
        known = wanted.value
        for batch in batches:
            kept = [[known[s] for s in x if s in known] for x in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    sample = rows.mapInArrow(reduced, "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")  # SAMPLE rows at most
    x = [np.array(f, np.int64) for f in sample.column("features").to_pylist()]
    y = sample.column("toxic").to_numpy().astype(float)
    return features, FactorizationMachine(len(features), prior).fit(x, y, values=(g / (g + EVIDENCE)) ** 2)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        features, machine = model.value
        known: dict[str, int | None] = {}
        for batch in small(batches):
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for text in batch.column("text").to_pylist():
                own = terms(text)
                for t in own:
                    if t not in known:
                        known[t] = features.get(slot(t))
                out.append(machine.score(sorted({known[t] for t in own} - {None})))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~train_fold()).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
