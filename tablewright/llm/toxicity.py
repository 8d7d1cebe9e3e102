"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as a word vector (hashed to ``WORD_ROWS`` rows) beside the mean of the
vectors of its character n-grams (3 and 4 bytes with word borders, hashed to ``GRAM_ROWS`` rows), so
that unseen forms of known words are met as well. Two gated recurrent units read a window of
``WINDOW`` words forwards and backwards, attention pools their states, and a linear layer gives the
log-odds of the window. Windows overlap by half and cover the whole text; a text is as toxic as its
most toxic window.

Training sees texts and their labels only, never windows with labels: first random windows under the
label of their text, then the strongest window of each text, as scoring takes it. It runs in one task
over a bounded sample: at most ``SAMPLE_TOXIC`` rows with label 1 and ``SAMPLE_CLEAN`` rows with
label 0, chosen by a hash of doc_id. Training and scoring read all windows of their texts.

Defined results: a text without words, null or empty, scores 0; if the sample lacks one of the two
labels, nothing is learned and every text scores 0. Of several labels of one doc_id the largest holds;
null labels are left out. A null doc_id is never learned from and is not held out. Repeated rows get
equal scores. Other columns, label columns among them, are no input of a score; they may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.graph import small_batches
from tablewright.llm.text_arrays import NON_ALNUM, Words, byte_prefix, give_back, in_pieces, span_hash, texts_of

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 1 << 13, 1 << 14, 12, 8
GRAMS = (3, 4)
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
EPOCHS, BATCH, RATE = 6, 64, 0.01
CHUNK = 4096


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from: remainder 1 of the id's checksum by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Types:
    """The distinct words of some texts: word rows, n-gram rows, and the windows over them.

    Type 0 is the blank that fills the end of a short window.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts, NON_ALNUM, lower=True)
        hashes = words.hashes()
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_row = np.concatenate([[0], 1 + (hashes[sample] % np.uint64(WORD_ROWS - 1)).astype(np.int64)])
        # Each distinct word between blanks, so that n-grams see its borders.
        start, end = words.start[sample], words.end[sample]
        length = end - start + 2
        ends = np.cumsum(length)
        source = np.repeat(start - 1 - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        borders = np.zeros(len(source), bool)
        borders[ends - length] = True
        borders[ends - 1] = True
        chars = words.data[np.clip(source, 0, max(0, len(words.data) - 1))].copy() if len(source) else np.zeros(0, np.uint8)
        chars[borders] = 0x20
        prefix = byte_prefix(chars)
        rows, owner = [], []
        for n in GRAMS:
            places = np.maximum(length - n + 1, 0)
            stop = np.cumsum(places)
            of = np.repeat(np.arange(len(length)), places)
            at = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - places, places) + np.repeat(ends - length, places)
            rows.append((span_hash(prefix, at, at + n) % np.uint64(GRAM_ROWS)).astype(np.int32))
            owner.append((of + 1).astype(np.int32))
        self.n = len(sample) + 1
        self.grams = list(zip(rows, owner))
        self.gram_count = sum(np.bincount(of, minlength=self.n) for of in owner)
        self.windows, self.text = self._windows(np.concatenate([which + 1, [0]]), words.first)

    @staticmethod
    def _windows(types: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_words = np.diff(first)
        n_windows = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // STRIDE)), 0)
        ends = np.cumsum(n_windows)
        text = np.repeat(np.arange(len(n_words)), n_windows)
        k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n_windows, n_windows)
        begin = first[text] + k * STRIDE
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < first[text + 1][:, None]
        return np.where(inside, types[np.where(inside, at, len(types) - 1)], 0).astype(np.int32), text


def sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``."""
    out = np.empty((n, values.shape[1]), np.float32)
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(index, values[:, j], n)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = 2 * DIM, HIDDEN

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "words": draw(WORD_ROWS, DIM, scale=0.02),
            "grams": draw(GRAM_ROWS, DIM, scale=0.05),
            "attend": draw(2 * h, scale=0.3),
            "out": draw(2 * h, scale=0.3),
            "bias": np.array([-1.0], np.float32),
        }
        for side in "fb":
            self.p |= {
                f"W{side}": draw(d, 3 * h, scale=d**-0.5 * 2),
                f"U{side}": draw(h, 3 * h, scale=h**-0.5),
                f"c{side}": np.zeros(3 * h, np.float32),
            }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step = 0

    # Types to the three gate inputs of either direction.
    def project(self, types: Types) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p = self.p
        grams = np.zeros((types.n, DIM), np.float32)
        for row, of in types.grams:
            if len(row):
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                grams[of[starts]] += np.add.reduceat(np.take(p["grams"], row, axis=0), starts, axis=0)
        grams /= np.maximum(types.gram_count, 1)[:, None].astype(np.float32)
        x = np.concatenate([p["words"][types.word_row], grams], axis=1)
        x[0] = 0
        return x, {s: x @ p[f"W{s}"] + p[f"c{s}"] for s in "fb"}

    def _run(self, inputs: np.ndarray, windows: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        h, u = HIDDEN, self.p[f"U{side}"]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((len(windows), h), np.float32)
        states = np.empty((WINDOW, len(windows), h), np.float32)
        columns = np.ascontiguousarray(windows.T).astype(np.intp)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a = np.take(inputs, columns[t], axis=0)
            gates = sigmoid(a[:, : 2 * h] + state @ u_gates)
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + (reset * state) @ u_new)
            if keep is not None:
                keep.append((t, state, update, reset, new))
            state = state + update * (new - state)
            states[t] = state
        return states

    def forward(self, inputs: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of windows."""
        steps = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(inputs[s], windows, s, steps[s]) for s in "fb"], axis=2)
        weight = states @ self.p["attend"]
        weight = np.where(windows.T > 0, weight, -1e9).astype(np.float32)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"]

    def logits(self, inputs: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
        parts = [self.forward(inputs, windows[i : i + CHUNK]) for i in range(0, len(windows), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def learn(self, types: Types, windows: np.ndarray, goal: np.ndarray, rate: float) -> None:
        """One step on windows with the log loss; the gradient runs back to the n-gram vectors."""
        p, h, kept = self.p, HIDDEN, {}
        x, inputs = self.project(types)
        odds = self.forward(inputs, windows, kept)
        d_odds = ((sigmoid(odds) - goal) / len(goal)).astype(np.float32)
        states, attention, pooled = kept["states"], kept["weight"], kept["pooled"]
        grad = {"out": pooled.T @ d_odds, "bias": d_odds.sum(keepdims=True)}
        d_pooled = d_odds[:, None] * p["out"]
        d_states = attention[:, :, None] * d_pooled
        d_attention = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
        grad["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states += d_score[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u = p[f"U{side}"]
            d_u, back = np.zeros_like(u), np.zeros((len(windows), h), np.float32)
            d_input = np.empty((len(windows), WINDOW, 3 * h), np.float32)
            for t, state, update, reset, new in reversed(kept["steps"][side]):
                back = back + d_states[t][:, k * h : (k + 1) * h]
                d_new = back * update * (1 - new * new)
                d_update = back * (new - state) * update * (1 - update)
                d_mixed = d_new @ u[:, 2 * h :].T
                d_reset = d_mixed * state * reset * (1 - reset)
                d_gates = np.concatenate([d_update, d_reset], axis=1)
                d_u[:, : 2 * h] += state.T @ d_gates
                d_u[:, 2 * h :] += (reset * state).T @ d_new
                d_input[:, t, : 2 * h], d_input[:, t, 2 * h :] = d_gates, d_new
                back = back * (1 - update) + d_mixed * reset + d_gates @ u[:, : 2 * h].T
            d_type = sum_by(windows.reshape(-1), d_input.reshape(-1, 3 * h), types.n)
            d_type[0] = 0
            grad |= {f"U{side}": d_u, f"W{side}": x.T @ d_type, f"c{side}": d_type.sum(axis=0)}
            d_x += d_type @ p[f"W{side}"].T
        grad["words"] = sum_by(types.word_row, d_x[:, :DIM], WORD_ROWS)
        d_gram = d_x[:, DIM:] / np.maximum(types.gram_count, 1)[:, None]
        grad["grams"] = sum(sum_by(row, d_gram[of], GRAM_ROWS) for row, of in types.grams)
        self._descend(grad, rate)

    def _descend(self, grad: dict[str, np.ndarray], rate: float) -> None:
        """Adam."""
        self.step += 1
        for k, g in grad.items():
            first, second = self.moments[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            now = rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            self.p[k] -= (now * first / (np.sqrt(second) + 1e-8)).astype(np.float32)


def best_by(text: np.ndarray, odds: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each text; -inf for a text without windows."""
    best = np.full(n, -np.inf, np.float32)
    np.maximum.at(best, text, odds)
    return best


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> dict[str, np.ndarray] | None:
    """Weights learned from texts and their labels; None if a label is missing."""
    if len(set(labels.tolist())) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    order = np.arange(len(texts))
    batches = []
    rng.shuffle(order)
    for i in range(0, len(order), BATCH):
        chosen = order[i : i + BATCH]
        batches.append((Types([texts[j] for j in chosen]), labels[chosen].astype(np.float32)))
    epochs = max(EPOCHS, -(-400 // len(batches)))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            types, goal = batches[b]
            if not len(types.windows):
                continue
            if epoch < epochs // 3:
                pick = np.flatnonzero(rng.random(len(types.text)) < 6 * len(goal) / len(types.text))
            else:
                odds = net.logits(net.project(types)[1], types.windows)
                best = best_by(types.text, odds, len(goal))
                strongest = odds >= best[types.text]
                pick = np.flatnonzero(strongest | (rng.random(len(odds)) < (goal[types.text] == 0) * 2 * len(goal) / len(odds)))
            if len(pick):
                # Windows of one repeated word of a clean text are clean as well.
                clean = pick[goal[types.text[pick]] == 0]
                dull = np.repeat(types.windows[clean[: 1 + len(pick) // 8], :1], WINDOW, axis=1)
                seen = np.concatenate([types.windows[pick], dull])
                labels_seen = np.concatenate([goal[types.text[pick]], np.zeros(len(dull), np.float32)])
                net.learn(types, seen, labels_seen, RATE * (0.3 if epoch >= epochs - 2 else 1.0))
    return net.p


class Scorer:
    def __init__(self, weights: dict[str, np.ndarray] | None):
        self.net = None
        if weights is not None:
            self.net = Network.__new__(Network)
            self.net.p = weights

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Score of each whole text."""
        if self.net is None:
            return np.zeros(len(texts))
        types = Types(texts)
        odds = self.net.logits(self.net.project(types)[1], types.windows)
        best = best_by(types.text, odds, len(texts)).astype(np.float64)
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -50, 50))))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows that are not held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("draw", F.xxhash64(F.lit(7), "doc_id"))
    )
    chosen = [
        known.where(F.col("toxic") == label).orderBy("draw", "doc_id").limit(most)
        for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    rows = chosen[0].unionByName(chosen[1])
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows of ids, so the text table is not shuffled.
    met = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return met.select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0) -> bytes:
    """Weights learned in one task from the bounded sample, pickled (about 1 MB)."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        texts = [(t or "").encode() for t in sample["text"]]
        weights = pickle.dumps(train(texts, sample["toxic"].to_numpy(), seed))
        give_back()
        return pd.DataFrame({"weights": [weights]})

    sample = training_sample(docs, labels).withColumn("all", F.lit(1))
    found = sample.groupBy("all").applyInPandas(run, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else pickle.dumps(None)


def score(docs: DataFrame, weights: bytes, column: str = "score") -> DataFrame:
    """``docs`` with their score in ``column``; every text is read whole, in pieces of about 1.5 MB."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c.lower() != column.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for piece in in_pieces(batches, limit=3 << 19):
            scores = scorer(texts_of(piece.column("text")))
            columns = [*(piece.column(n) for n in plain), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*plain, "score"])

    # Names that Spark would take for paths do not reach the task.
    plain = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]
    kept = docs.select(*["`" + c.replace("`", "``") + "`" for c in names]).toDF(*plain)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*names, column)


def drop_toxic(docs: DataFrame, weights: bytes, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    name = "_toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, weights, name).where(F.col(name) < threshold).drop(name)
