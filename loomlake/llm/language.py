"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of the lower-cased whole text are hashed into ``2**bits`` features.  Document frequencies
are counted over all training rows.  The classifier itself is fitted on a bounded sample (``most_rows``
rows, equal shares of the languages, chosen by a hash of the id) by follow-the-regularised-leader with
elastic-net penalties, and calibrated by a temperature on a part of the sample that it wasn't fitted on.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import give_back, tidy

_WORD_CHARACTER = re.compile(r"[^\W\d_]")
NONE = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))  # stops at the first


def features(text: str, bits: int = 16, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 .. longest characters of a text between blanks, and their counts."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, all_h = np.zeros(len(c), np.uint32), []
    for n in range(1, longest + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        all_h.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(all_h), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weights_of(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    x = (1 + np.log(n)) * idf[at]
    return x / max(float(np.sqrt((x**2).sum())), 1e-12)


def weighted(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = features(text, bits)
    return at, weights_of(at, n, idf)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features by labels; zero rows are features that nothing was learned of
    temperature: float
    bits: int

    def scores(self, text: str) -> np.ndarray:
        at, x = weighted(text, self.idf, self.bits)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not has_letter(text):
            return NONE, 0.0
        z = self.scores(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, dim: int, idf: np.ndarray, *, alpha=1.0, beta=1.0, l1=0.02, l2=0.02, epochs=2) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates and L1 + L2 penalties, for softmax loss; ``rows`` are n-grams and counts."""
    z, n = np.zeros((dim, k)), np.zeros((dim, k))

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (at, count), label in zip(rows, y):
            x = weights_of(at, count, idf)
            w = solved(z[at], n[at])
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            g2 = g * g
            before = n[at]
            after = before + g2
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    return solved(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t):
        z = scores / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def held_out() -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0


def fit(labelled: DataFrame, *, label: str = "lang", bits: int = 16, most_rows: int = 6000) -> Model:
    """Learns from all rows with a text and a label (doc_id only chooses the sample).

    Labels that no row has can't be predicted; without any row, the model predicts nothing.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("doc_id", "text", F.col(label).alias("_label"))
    dim = 1 << bits

    def count(batches):
        n, total = np.zeros(dim, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[features(text, bits)[0]] += 1
                total += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], ["feature", "n"])

    counts = rows.select("text").mapInArrow(tidy(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most 2**bits + 1 rows
    df, total = np.zeros(dim), 0
    for r in counts:
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], idf, np.zeros((dim, 0)), 1.0, bits)
    each = max(1, most_rows // len(labels))
    order = F.xxhash64("doc_id", "text")
    # Of a label with many rows only those with a low hash, about twice as many as wanted, are shuffled.
    share = F.lit(1.0)
    for v in labels:
        if sizes[v] > 4 * each:
            share = F.when(F.col("_label") == v, F.lit(2 * each / sizes[v])).otherwise(share)
    low = (order / F.lit(float(1 << 63)) + 1) / 2 < share
    # Copies of one row have one hash; a label of which none is low is drawn from all of its rows.
    seen = {r["_label"] for r in rows.where(low).select("_label").distinct().collect()}
    drawn = rows.where(low | F.col("_label").isin([v for v in labels if v not in seen]))
    sample = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("_label").orderBy(order, "doc_id", "text"))).where(F.col("_n") <= each)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_label"], ignore_index=True)
        # The rows' n-grams stay as small whole numbers; weights are made of them row by row.
        x = [features(t, bits) for t in pdf["text"]]
        x = [(at.astype(np.uint32), n.astype(np.uint32)) for at, n in x]
        y = np.array([labels.index(v) for v in pdf["_label"]])
        apart = (pdf["_n"].to_numpy() % 5) == 0  # calibrates
        del pdf
        if not apart.any() or apart.all():
            apart[:] = False
        w = ftrl([r for r, a in zip(x, apart) if not a], y[~apart], len(labels), dim, idf)
        scores = np.array([weights_of(*r, idf) @ w[r[0]] for r, a in zip(x, apart) if a]).reshape(-1, len(labels))
        t = temperature(scores, y[apart]) if apart.any() else 1.0
        at = np.flatnonzero(w.any(1))
        model = pickle.dumps((at, w[at], t), 5)
        del x, w
        give_back()
        return pd.DataFrame({"model": [model]})

    # The sample is bounded by most_rows, so one task fits the model.
    at, w, t = pickle.loads(sample.groupBy(F.lit(0).alias("_all")).applyInPandas(train, "model binary").first()["model"])
    weights = np.zeros((dim, len(labels)))
    weights[at] = w
    return Model(labels, idf, weights, t, bits)


def predict(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds a label and its probability, from the whole text only; 'und' and 0 if it is null or has no letter.

    Columns of the input with those names are replaced; repeated rows are predicted alike.
    """
    docs = docs.drop(label, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, label, score])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that aren't held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
