"""Toxicity: a factorization machine over hashed terms, which also weighs pairs of terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import drawn, table

LETTERS = re.compile(r"[^\W\d_]+")
#: Besides whole words, the beginnings of longer words, of so many letters, are terms.
HEADS = (4, 5)


@dataclass(frozen=True)
class Settings:
    """``docs_per_label``: training takes about so many labelled documents that are toxic, and twice as many that are not, by a
    hash of doc_id; this bounds what the driver gets. Terms of fewer than ``min_docs`` of these count as unseen. The machine is
    fitted on all other terms (``first_epochs``, ``first_l1``), then again on those whose weight, or whose factors' length, is above
    ``least`` times the largest one: however many these are, none goes for its rank."""

    docs_per_label: int = 4000
    bits: int = 18
    factors: int = 4
    min_docs: int = 5
    first_epochs: int = 12
    first_l1: float = 1e-3
    first_batch: int = 128
    least: float = 0.15
    epochs: int = 40
    l1: float = 1e-4
    batch: int = 64
    rate: float = 0.2
    seed: int = 5


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (2**bits,)
    factors: np.ndarray  # (2**bits, k)


def terms(text: str | None, bits: int) -> np.ndarray:
    """Hashed terms of a whole text, each once, in order."""
    words = {w.encode("utf-8", "surrogatepass") for w in set(LETTERS.findall(text.lower()))} if text else ()
    found = set(words)
    for head in HEADS:
        found.update(b"^" + w.decode("utf-8", "surrogatepass")[:head].encode("utf-8", "surrogatepass") for w in words)
    return np.unique(np.fromiter((zlib.crc32(t) & ((1 << bits) - 1) for t in found), dtype=np.int32, count=len(found)))


def _logits(model: Model, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each document, and the sums of its terms' factors. Documents without terms need a dummy term of weight 0."""
    v = model.factors[ids]
    sums = np.add.reduceat(v, starts, axis=0)
    pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
    return model.bias + np.add.reduceat(model.weights[ids], starts) + pairs, sums


def train(docs: list[np.ndarray], toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Fits on all terms, then on those that the fitted machine gives weight, by themselves or in pairs; others count as unseen."""
    size = 1 << settings.bits
    seen = np.bincount(np.concatenate(docs), minlength=size) >= settings.min_docs
    first = descend(docs, toxic, seen, settings, settings.first_epochs, settings.first_batch, settings.first_l1)
    chosen = np.zeros(size, bool)
    for strength in (np.abs(first.weights), np.sqrt((first.factors**2).sum(axis=1))):
        chosen |= strength > settings.least * strength.max()
    return descend(docs, toxic, chosen & seen, settings, settings.epochs, settings.batch, settings.l1)


def descend(docs: list[np.ndarray], toxic: np.ndarray, seen: np.ndarray, settings: Settings, epochs: int, batch: int, l1: float) -> Model:
    """Logistic loss over the ``seen`` terms, by AdaGrad with soft thresholding."""
    rng, size = np.random.default_rng(settings.seed), 1 << settings.bits
    docs = [d[seen[d]] for d in docs]
    model = Model(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, settings.factors)) * 0.01 * seen[:, None]).astype(np.float32))
    g_bias, g_w, g_v = 1e-8, np.full(size, 1e-8, np.float32), np.full((size, settings.factors), 1e-8, np.float32)
    usable = np.array([i for i, d in enumerate(docs) if len(d)], dtype=int)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            parts = [docs[i] for i in rows]
            lengths = np.array([len(p) for p in parts])
            ids, starts = np.concatenate(parts), np.cumsum([0, *lengths[:-1]])
            logit, sums = _logits(model, ids, starts)
            error = (0.5 * np.tanh(0.5 * logit) + 0.5 - toxic[rows]).astype(np.float32) / len(rows)
            each = np.repeat(error, lengths)
            touched, place = np.unique(ids, return_inverse=True)
            d_w = np.bincount(place, weights=each).astype(np.float32)
            inner = each[:, None] * (np.repeat(sums, lengths, axis=0) - model.factors[ids])
            d_v = np.stack([np.bincount(place, weights=inner[:, f]) for f in range(settings.factors)], axis=1).astype(np.float32)
            g_w[touched] += d_w * d_w
            g_v[touched] += d_v * d_v
            g_bias += float(error.sum()) ** 2
            model.bias -= settings.rate * float(error.sum()) / np.sqrt(g_bias)
            step = settings.rate / np.sqrt(g_w[touched])
            w = model.weights[touched] - step * d_w
            model.weights[touched] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            step = 0.2 * settings.rate / np.sqrt(g_v[touched])
            v = model.factors[touched] - step * d_v
            model.factors[touched] = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
    return model


def score(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Probability of each document; one without terms has the bias's."""
    lengths = np.array([len(d) for d in docs])
    out = np.full(len(docs), model.bias, dtype=np.float64)
    full = np.flatnonzero(lengths)
    if len(full):
        ids, starts = np.concatenate([docs[i] for i in full]), np.cumsum([0, *lengths[full][:-1]])
        out[full] = _logits(model, ids, starts)[0]
    return 0.5 * np.tanh(0.5 * out) + 0.5


def _terms_udf(bits: int) -> Column:
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t, bits) for t in texts])

    return F.pandas_udf(hashed, "array<int>")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of ``toxic`` (1 or not) of ``labels`` (``doc_id, toxic``) from the texts of ``docs`` (``doc_id, text``).

    Null ids and labels teach nothing; of several labels of an id the highest counts. Repeated rows of ``docs`` are learned as
    often as they are there; very long texts are learned whole, and a text without words only by how often such are toxic. Without
    labels or documents, or with labels of one kind only, the score is that kind's for all.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {label: min(1.0, most / max(1, n.get(label, 0))) for label, most in ((True, settings.docs_per_label), (False, 2 * settings.docs_per_label))}
    chosen = known.filter(drawn(F.when(F.col("toxic"), share[True]).otherwise(share[False]), "toxicity", "doc_id"))  # bounded by docs_per_label
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"), _terms_udf(settings.bits)("text").alias("t"))
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])  # whatever order the rows came in, training is the same
    column = got["t"].combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() if len(column) else np.zeros(1, int)
    hashed = [flat[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    toxic = np.array(got["toxic"].to_pylist(), dtype=np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        sure = 0.0 if not len(toxic) or toxic.min() == 0 else 1.0
        return Model(20.0 * sure - 10.0, np.zeros(1 << settings.bits, np.float32), np.zeros((1 << settings.bits, settings.factors), np.float32))
    model = train(hashed, toxic, settings)
    model.bias += float(np.log(share[False] / share[True]))  # toxic documents are more frequent in the sample
    return model


def with_toxicity(docs: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> Column:
    """Column of scores from 0 to 1 for a column of whole texts; null and empty texts have the score of no terms.

    Only the text counts: repeated rows have one score, a very long text is scored whole, an empty table gives no rows, and
    other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by bits and factors

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, [terms(t, settings.bits) for t in texts]))

    return F.pandas_udf(scored, "double")(docs[text])


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.langid import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), with_toxicity(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
