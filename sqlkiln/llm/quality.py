"""Quality rules: how far a text's histograms diverge from its language's.

Two histograms are compared with references by Jensen-Shannon distance (base 2,
0 to 1): character classes, and the language's common words with one bin for
all others. References are sums over all documents of a language that pass the
base rules; the common words are the most frequent ones of all documents. Short
texts are too noisy to judge: below ``MIN_CHARS`` or ``MIN_WORDS`` a histogram
has no say.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import WS, by_chars, by_rows, stored
from .shingles import HASHES, mix

MIN_BASE_WORDS = 50
COMMON_WORDS = 40
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "digit", "space", "newline", "stop", "mark", "symbol", "other")
_TABLE = 0x3000


def _class_of(c: str) -> int:
    if c in SYMBOLS:
        return 8
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if c == "\n":
        return 5
    if c in ".,;:!?":
        return 6
    kind = unicodedata.category(c)
    return 2 if kind[0] in "LM" else 3 if kind[0] == "N" else 4 if kind[0] == "Z" or c in "\t\r\v\f" else 7 if kind[0] == "P" else 9


_CLASS = np.array([_class_of(chr(i)) if not 0xD800 <= i < 0xE000 else 9 for i in range(_TABLE)] + [2], np.int8)
_SPACES = np.zeros(_TABLE + 1, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def base_and_histograms(text: str | None, wanted: np.ndarray):
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, counts of wanted hashes)``.

    ``wanted`` are sorted word hashes; characters past the table count as letters.
    """
    text = text or ""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE)
    classes = np.bincount(_CLASS[points], minlength=len(CLASSES))
    words = text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    repeat = 0
    if len(h) >= 4:
        gram = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        inside = np.zeros(len(h), bool)
        for i in range(3):
            inside[i:len(h) - 2 + i] |= twice
        repeat = int(inside.sum())
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    counts = np.zeros(len(wanted), np.int64)
    if len(h) and len(wanted):
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        counts = np.bincount(at[wanted[at] == h], minlength=len(wanted))
    return len(words), len(points) - int(_SPACES[points].sum()), int(classes[8]), dup, repeat, classes, counts


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance (base 2) of histograms; an empty one is at distance 1."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / ps, q / qs
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        d = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where((ps[..., 0] > 0) & (qs[..., 0] > 0), d, 1.0)


def common_words(docs: DataFrame, k: int = COMMON_WORDS) -> dict[str, list[str]]:
    """The ``k`` most frequent words of each language, counted over all texts."""
    words = docs.where("lang is not null and text is not null").select("lang", F.explode(F.split("text", WS + "+")).alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("lang", "rank").collect()   # k rows a language
    out: dict[str, list[str]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append(r["word"])
    return out


class References:
    """Per language: class counts, positions of its common words, their counts and the rest."""

    def __init__(self, wanted: np.ndarray, bins: dict[str, np.ndarray], sums: dict[str, np.ndarray]):
        self.langs = [lang for lang in sorted(sums) if lang in bins]
        self.wanted, self.bins = wanted, bins
        k = len(CLASSES)
        self.classes = {x: sums[x][:k].astype(float) for x in self.langs}
        self.words = {x: self._with_rest(sums[x][k:-1], sums[x][-1], bins[x]) for x in self.langs}

    @staticmethod
    def _with_rest(counts: np.ndarray, n_words, bins: np.ndarray) -> np.ndarray:
        own = counts[..., bins]
        return np.concatenate([own, (np.asarray(n_words) - own.sum(-1))[..., None]], -1).astype(float)

    def distances(self, classes: np.ndarray, counts: np.ndarray, n_words: np.ndarray, lang: np.ndarray):
        """Class and word distance per row: to the row's language, or the nearest if it has no reference."""
        d_class, d_word = np.full(len(lang), np.inf), np.full(len(lang), np.inf)
        for x in self.langs:
            rows = np.flatnonzero((lang == x) | ~np.isin(lang, self.langs))
            if len(rows):
                d_class[rows] = np.minimum(d_class[rows], js_distance(classes[rows].astype(float), self.classes[x]))
                d_word[rows] = np.minimum(d_word[rows], js_distance(
                    self._with_rest(counts[rows], n_words[rows], self.bins[x]), self.words[x]))
        none = ~np.isfinite(d_class)
        d_class[none] = d_word[none] = 0.0          # no reference at all: no objection
        return d_class, d_word


def _dense(pdf: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(pdf), width), np.int64)
    for i, (at, n) in enumerate(zip(pdf["word_at"], pdf["word_n"])):
        out[i, np.asarray(at, int)] = n
    return out


def quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document: base figures, distances and the verdict.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``; other columns are ignored.
    ``base_failed``: fewer than 50 words, or more than half of the words lie in
    three-word windows that repeat. ``kept``: not base_failed and no histogram
    farther than allowed. Null and empty texts have no words and fail the base;
    a null or unseen language is compared with the nearest reference; repeated
    rows are judged one by one; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    words = common_words(docs)
    by_hash = {HASHES[w.encode("utf-8", "surrogatepass")] for ws in words.values() for w in ws}
    wanted = np.array(sorted(by_hash), np.uint64)
    bins = {x: np.searchsorted(wanted, np.array(sorted(HASHES[w.encode("utf-8", "surrogatepass")] for w in ws), np.uint64))
            for x, ws in words.items()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_chars(batches):
            rows = []
            for doc_id, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                *base, classes, counts = base_and_histograms(text if isinstance(text, str) else None, wanted)
                at = np.flatnonzero(counts)
                rows.append((doc_id, lang, *base, classes, at.astype(np.int32), counts[at]))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "classes", "word_at", "word_n"]).astype({"doc_id": "Int64"})

    base = stored(docs.mapInPandas(measure, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                            "n_repeat_words long, classes array<long>, word_at array<int>, word_n array<long>"), "measures")
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    width = len(wanted)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in by_rows(batches):
            for lang, part in pdf.groupby("lang"):
                row = np.concatenate([np.stack(part["classes"].to_numpy()).sum(0), _dense(part, width).sum(0), [part["n_words"].sum()]])
                sums[lang] = sums.get(lang, 0) + row
        yield pd.DataFrame([(x, i, v) for x, row in sums.items() for i, v in enumerate(row)], columns=["lang", "bin", "n"]).astype(
            {"lang": "object", "bin": "int32", "n": "int64"})

    parts = base.where("not base_failed and lang is not null").mapInPandas(add_up, "lang string, bin int, n long")
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():      # languages x bins
        sums.setdefault(r["lang"], np.zeros(len(CLASSES) + width + 1, np.int64))[r["bin"]] = r["n"]
    refs = References(wanted, bins, sums)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_rows(batches):
            if len(pdf):
                classes = np.stack(pdf["classes"].to_numpy())
                n_words = pdf["n_words"].to_numpy(np.int64)
                d_char, d_word = refs.distances(classes, _dense(pdf, width), n_words, pdf["lang"].fillna("").to_numpy(str))
                far = ((d_char > max_char) & (classes.sum(1) >= MIN_CHARS)) | ((d_word > max_word) & (n_words >= MIN_WORDS))
                out = pdf.drop(columns=["classes", "word_at", "word_n"])
                yield out.assign(char_distance=d_char, word_distance=d_word, kept=~(pdf["base_failed"].to_numpy(bool) | far))

    return base.mapInPandas(judge, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                   "n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")
