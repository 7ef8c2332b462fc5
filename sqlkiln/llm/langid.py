"""Language identification by a byte convolutional network in numpy.

The network reads windows of ``WINDOW`` bytes of lower-cased UTF-8: filters two,
three and four bytes wide slide over them, each filter's maximum is kept (max
pooling) and a softmax over the pooled values gives the language. It is trained
on windows of a bounded, hashed sample of labelled texts; texts are predicted
from all of their windows, weighted by length.

For prediction the filters are tabulated by byte pair: a filter's value at a
position is the sum of at most two table rows, so no multiplication is left in
the convolution.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8           # filters of each width
SAMPLE_DOCS = 1200                       # labelled texts per language to learn from, about
SAMPLE_WINDOWS = 4                       # windows of each, spread over the whole text
CHUNK = 256                              # windows scored at a time
UNKNOWN = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")      # number signs as well


def windows(text: str) -> np.ndarray:
    """The text's bytes in rows of ``WINDOW``, the last one padded with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[:len(raw)] = raw
    return out.reshape(rows, WINDOW)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


class ByteCNN:
    """Filter tables ``t[width][offset]`` of shape (256, FILTERS) and a softmax layer."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.t = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes)).astype(np.float32)
        self.bias = np.zeros(n_classes, np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.t, self.out, self.bias]

    def forward(self, x: np.ndarray):
        """Class probabilities of windows ``x``, the pooled values and where they were found."""
        pooled, where = [], []
        for w, t in zip(WIDTHS, self.t):
            n = WINDOW - w + 1
            v = t[0][x[:, :n]]
            for j in range(1, w):
                v = v + t[j][x[:, j:j + n]]
            where.append(v.argmax(axis=1))
            pooled.append(v.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        return _softmax(h @ self.out + self.bias), h, where

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        p, h, where = self.forward(x)
        rows = np.arange(len(x))
        loss = float(-np.log(p[rows, y] + 1e-9).mean())
        d = p.copy()
        d[rows, y] -= 1
        d /= len(x)
        dh = (d @ self.out.T) * (h > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(self.t[k])
            part = dh[:, k * FILTERS:(k + 1) * FILTERS]
            for j in range(w):
                byte = x[rows[:, None], where[k] + j]           # the byte under the filter at its maximum
                np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        return loss, [*grads, h.T @ d, d.sum(axis=0)]

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per byte pair the sums of the first two offsets, and of the next two, for all filters."""
        first, second = [], []
        for w, t in zip(WIDTHS, self.t):
            first.append((t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS))
            if w == 2:
                second.append(np.zeros((65536, FILTERS), np.float32))
            elif w == 3:
                second.append(np.repeat(t[2], 256, axis=0))
            else:
                second.append((t[2][:, None, :] + t[3][None, :, :]).reshape(65536, FILTERS))
        return np.concatenate(first, axis=1), np.concatenate(second, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n_classes: int, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam over shuffled batches; the same sample and seed give the same network."""
    net, rng = ByteCNN(n_classes, seed), np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in net.params()]
    v = [np.zeros_like(p) for p in net.params()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            _, grads = net.gradients(x[pick], y[pick])
            step += 1
            for p, g, a, b in zip(net.params(), grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """Prediction with tabulated filters; built once per Python worker."""

    def __init__(self, net: ByteCNN):
        self.first, self.second = net.pair_tables()
        self.out, self.bias = net.out, net.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities per window. A window is read as if two zero bytes
        followed it, so that all filters see the same positions."""
        out = []
        for at in range(0, len(x), CHUNK):
            part = x[at:at + CHUNK]
            wide = np.zeros((len(part), WINDOW + 2), np.int32)
            wide[:, :WINDOW] = part
            pair = wide[:, :-1] * 256 + wide[:, 1:]
            v = self.first[pair[:, :WINDOW - 1].reshape(-1)]
            v += self.second[pair[:, 2:].reshape(-1)]
            h = np.maximum(v.reshape(len(part), WINDOW - 1, -1).max(axis=1), 0)
            out.append(_softmax(h @ self.out + self.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)), np.float32)


_SCORERS: dict[str, Scorer] = {}          # of the last network that this worker met, by its name


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[ByteCNN | None, list[str]]:
    """Train on at most about ``sample_docs`` texts per language, picked by a hash of doc_id."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~_held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}     # one row a language
    langs = sorted(counts)
    if not langs:
        return None, []
    limit = F.lit(0)
    for x in langs:
        limit = F.when(F.col("lang") == x, int(min(1.0, sample_docs / counts[x]) * 1_000_000)).otherwise(limit)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < limit)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                if has_letter(text):
                    w = windows(text)
                    for k in np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int)):
                        rows.append((doc_id, int(k), lang, w[k].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "lang", "bytes"])

    sample = drawn.select("doc_id", "text", "lang").mapInPandas(take, "doc_id long, k int, lang string, bytes binary").toPandas()
    sample = sample.sort_values(["doc_id", "k", "lang", "bytes"])
    langs = sorted(set(sample["lang"]))
    if not langs:
        return None, []
    x = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(langs), sample["lang"].to_numpy(str))
    return train(x, y, len(langs)), langs


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` (long), ``text`` and ``lang``; other columns are
    ignored. Only texts with a language whose crc32(doc_id as text) mod 4 is not
    2 are learned from; a prediction sees the text alone. ``score`` is the mean
    probability over the text's windows. Null texts and texts without a letter
    are ``und`` with score 0, as is everything if nothing can be learned from.
    Repeated rows are predicted one by one; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    net, langs = learn(docs, sample_docs)
    name = uuid.uuid4().hex                    # a task unpickles its own copy of the network

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if net is not None and name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(net)
        scorer = _SCORERS.get(name)
        for pdf in batches:
            pred, score = [UNKNOWN] * len(pdf), np.zeros(len(pdf))
            held: list[tuple[int, np.ndarray, int]] = []       # row, windows, bytes
            size = 0

            def flush():
                p = scorer.probabilities(np.concatenate([w for _, w, _ in held]))
                at = 0
                for row, w, n in held:
                    weight = np.full(len(w), WINDOW, float)
                    weight[-1] = n - WINDOW * (len(w) - 1)
                    mean = weight @ p[at:at + len(w)] / weight.sum()
                    at += len(w)
                    best = int(mean.argmax())
                    pred[row], score[row] = langs[best], min(1.0, float(mean[best]))

            for i, text in enumerate(pdf["text"]):
                if net is not None and has_letter(text):
                    w = windows(text)
                    n = len(text.lower().encode("utf-8", "surrogatepass"))
                    held.append((i, w, n))
                    size += len(w)
                    if size >= 4096:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=pred, score=score)

    rows = docs.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")
