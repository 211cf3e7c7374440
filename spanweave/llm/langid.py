"""Language ID: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import drawn, table

#: Bytes of a window; the network's state starts afresh in each. Symbol 256 fills the last window up.
WINDOW, PAD, SYMBOLS = 64, 256, 257
#: Windows that are run side by side.
BLOCK = 2048
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``docs_per_language``: training takes about so many documents of each language, by a hash of doc_id, with all their
    windows, and of all languages about ``max_docs`` or one each. This bounds what the driver gets; every language is learned."""

    hidden: int = 8
    docs_per_language: int = 250
    max_docs: int = 50_000
    steps: int = 260
    batch: int = 256
    rate: float = 0.02
    seed: int = 13


@dataclass
class Direction:
    """Weights of one direction: by symbol (3 gates of ``hidden`` rows: update, reset, new), by state, and the new gate's own bias."""

    by_symbol: np.ndarray  # (3h, SYMBOLS)
    by_state: np.ndarray  # (3h, h)
    bias: np.ndarray  # (h, 1)


@dataclass
class Model:
    languages: list[str]
    ways: tuple[Direction, Direction]
    out: tuple[np.ndarray, np.ndarray]  # (k, h) for each direction
    out_bias: np.ndarray  # (k, 1)

    def parts(self) -> list[np.ndarray]:
        return [p for w in self.ways for p in (w.by_symbol, w.by_state, w.bias)] + [*self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(languages: list[str], settings: Settings) -> Model:
    rng, h, k = np.random.default_rng(settings.seed), settings.hidden, len(languages)

    def draw(scale: float, *shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    ways = tuple(Direction(draw(0.4, 3 * h, SYMBOLS), draw(0.3, 3 * h, h), np.zeros((h, 1), np.float32)) for _ in range(2))
    return Model(languages, ways, (draw(0.4, k, h), draw(0.4, k, h)), np.zeros((k, 1), np.float32))


def _run(way: Direction, symbols: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (t, h, n) after each of the symbols (t, n); what backpropagation needs if ``keep``."""
    h = way.bias.shape[0]
    state = np.zeros((h, symbols.shape[1]), np.float32)
    states, tape = np.empty((len(symbols), h, symbols.shape[1]), np.float32), []
    for t, now in enumerate(symbols):
        given = np.take(way.by_symbol, now, axis=1)
        own = way.by_state @ state
        gates = _sigmoid(given[: 2 * h] + own[: 2 * h])
        update, reset, held = gates[:h], gates[h:], own[2 * h :] + way.bias
        new = np.tanh(given[2 * h :] + reset * held)
        after = new + update * (state - new)
        if keep:
            tape.append((state, update, reset, held, new))
        states[t] = state = after
    return states, tape


def _back(way: Direction, symbols: np.ndarray, tape: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of a direction's weights; ``given``: those of the states, (t, h, n)."""
    h = way.bias.shape[0]
    to_symbol, to_state, to_bias = np.zeros_like(way.by_symbol), np.zeros_like(way.by_state), np.zeros_like(way.bias)
    all_gates = np.empty((len(symbols), 3 * h, symbols.shape[1]), np.float32)
    carry = np.zeros(given.shape[1:], np.float32)
    for t in range(len(symbols) - 1, -1, -1):
        state, update, reset, held, new = tape[t]
        d = given[t] + carry
        d_new = d * (1 - update) * (1 - new * new)
        d_update = d * (state - new) * update * (1 - update)
        d_reset = d_new * held * reset * (1 - reset)
        gates = all_gates[t]
        gates[:h], gates[h : 2 * h], gates[2 * h :] = d_update, d_reset, d_new
        inner = np.concatenate([d_update, d_reset, d_new * reset])
        to_state += inner @ state.T
        to_bias += inner[2 * h :].sum(axis=1, keepdims=True)
        carry = d * update + way.by_state.T @ inner
    flat, where = all_gates.transpose(1, 0, 2).reshape(3 * h, -1), symbols.ravel()
    for row in range(3 * h):
        to_symbol[row] = np.bincount(where, weights=flat[row], minlength=SYMBOLS)
    return to_symbol, to_state, to_bias


def _label(model: Model, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Probabilities (t, k, n) of the languages at every position."""
    logits = model.out[0] @ forward + model.out[1] @ backward + model.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(model: Model, symbols: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all real positions of windows (WINDOW, n), and its gradients by ``model.parts()``, through time."""
    real = (symbols != PAD).astype(np.float32)[:, None, :]
    ahead, tape_a = _run(model.ways[0], symbols, keep=True)
    back, tape_b = _run(model.ways[1], symbols[::-1], keep=True)
    behind = back[::-1]
    d, n = _label(model, ahead, behind), max(1.0, float(real.sum()))
    loss = float(-(np.log(d[:, truth, np.arange(len(truth))] + 1e-30) * real[:, 0]).sum()) / n
    d[:, truth, np.arange(len(truth))] -= 1
    d *= real / n
    d_ahead, d_behind = model.out[0].T @ d, model.out[1].T @ d
    return loss, [
        *_back(model.ways[0], symbols, tape_a, d_ahead),
        *_back(model.ways[1], symbols[::-1], tape_b, d_behind[::-1]),
        np.einsum("tkn,thn->kh", d, ahead, optimize=True),
        np.einsum("tkn,thn->kh", d, behind, optimize=True),
        d.sum(axis=(0, 2))[:, None],
    ]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings = Settings(), share: np.ndarray | None = None) -> Model:
    """Backpropagation through time over windows (n, WINDOW) of symbols, with Adam; the loss is of all positions.

    Batches have as many windows of each language; within it, windows are drawn by ``share`` (all alike if there is none).
    """
    model, rng = new_model(languages, settings), np.random.default_rng(settings.seed)
    parts = model.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    share = np.ones(len(labels)) if share is None else share
    weight = share / np.bincount(labels, weights=share, minlength=len(languages))[labels]
    for step in range(1, settings.steps + 1):
        chosen = rng.choice(len(windows), size=min(settings.batch, len(windows)), replace=False, p=weight / weight.sum())
        symbols, truth = np.ascontiguousarray(windows[chosen].T), labels[chosen]
        _, grads = gradients(model, symbols, truth)
        rate = settings.rate * min(1.0, 2.0 - 2.0 * (step - 1) / settings.steps)
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def to_windows(data: bytes) -> np.ndarray:
    """All bytes of a text as windows (n, WINDOW) of symbols."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, PAD, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def window_scores(model: Model, windows: np.ndarray) -> np.ndarray:
    """Sums (n, k) of the probabilities of every position of each window."""
    sums = np.empty((len(windows), len(model.languages)), np.float32)
    for at in range(0, len(windows), BLOCK):
        symbols = np.ascontiguousarray(windows[at : at + BLOCK].T)
        ahead, _ = _run(model.ways[0], symbols)
        back, _ = _run(model.ways[1], symbols[::-1])
        found = _label(model, ahead, back[::-1])
        found *= (symbols != PAD)[:, None, :]
        sums[at : at + BLOCK] = found.sum(axis=0).T
    return sums


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each whole text: the largest mean probability over its positions."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    at, waiting, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if not waiting:
            return
        sums = np.add.reduceat(window_scores(model, np.concatenate(waiting)), np.cumsum([0, *map(len, waiting[:-1])]), axis=0)
        for i, row in zip(at, sums, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = model.languages[best], float(min(1.0, row[best] / row.sum()))
        at.clear(), waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        if has_letter(text):
            at.append(i)
            waiting.append(to_windows(text.encode("utf-8", "surrogatepass")))
            size += len(waiting[-1])
            if size >= 4 * BLOCK:
                flush()
    flush()
    return names, scores


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the languages in ``lang`` of ``docs`` (``doc_id, text, lang``).

    Null texts, texts without a letter and null languages teach nothing; other columns are ignored. Each document counts
    alike, however long; repeated rows are learned as often as they are there. An empty table gives a model without languages. A
    language of which the sample happens to hold no document is known by name, and hardly ever found.
    """
    known = docs.select("doc_id", "text", "lang").filter(r"text is not null and lang is not null and text rlike '\\p{L}'")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return new_model([], settings)
    languages = sorted(counts)
    each = max(1.0, min(settings.docs_per_language, settings.max_docs / len(counts)))
    shares = docs.sparkSession.createDataFrame([(x, each / n) for x, n in counts.items()], "lang string, share double")
    chosen = known.join(F.broadcast(shares), "lang").filter(drawn(F.col("share"), "langid", "doc_id"))  # a row a language
    got = chosen.select("lang", F.col("text").cast("binary").alias("b")).toArrow().sort_by("lang")
    if not len(got):
        return new_model([], settings)
    of_each = [to_windows(b.as_py()) for b in got["b"]]
    windows, sizes = np.concatenate(of_each).astype(np.int16), np.array([len(w) for w in of_each])
    labels = np.repeat([languages.index(x) for x in got["lang"].to_pylist()], sizes).astype(int)
    share = np.repeat(1.0 / sizes, sizes)
    order = np.lexsort((share, *windows.T, labels))  # whatever order the rows came in, training is the same
    return train(windows[order], labels[order], languages, settings, share[order])


def with_language(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column struct<lang_pred, score> for a column of texts; only the text counts.

    ``und`` with score 0 for null texts and texts without a letter, and for all if no language was learned. Of languages
    that are as probable the first by name is taken. Repeated rows are judged alike, a very long text by all its positions;
    an empty table gives no rows, and other columns do not matter.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(model, list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(score, "struct<lang_pred:string,score:double>")(docs[text])


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), with_language(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
