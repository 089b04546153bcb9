"""Quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted one feature after another in cycles, each on the
residual of all others, so a feature's trees add up to one lookup table over its
bins.  Then the pairs of features whose joint residuals vary most get a table of
two bins each in the same way.  A document's score is the sum of its bins'
entries, through the logistic function.

The model is fitted on a bounded sample of labelled documents; every document is
scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.exchange import arrow_schema, stored
from millrace.llm.text import SEPARATOR, Texts, fingerprints, pieces

#: Most labelled documents the model is fitted on; of more, those with the smallest hash.
SAMPLE = 40_000
BINS, CYCLES, RATE, LEAVES = 32, 150, 0.15, 3
PAIRS, PAIR_BINS, PAIR_CYCLES = 8, 8, 60
#: Rows that a leaf needs, and pseudo-rows that draw small bins to 0.
LEAF, PENALTY = 10, 5.0

FEATURES = (
    "log_words length symbols capitals digits other_letters stops commas lines line_words repeats "
    "distinct twice pairs separators longest"
).split()

_CLASS = np.zeros(256, np.int8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".!?"]] = 4
_CLASS[[ord(c) for c in ",;:"]] = 5
_CLASS[0x80:] = 6


def features(texts: Texts) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros."""
    starts, ends, firsts = texts.words()
    n = np.diff(firsts).astype(float)
    size = np.maximum(n, 1)
    per_text = np.diff(texts.ends)
    owner = np.repeat(np.arange(len(texts)), per_text)
    kinds = _CLASS[texts.data]

    def share(mask: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=len(texts)) / np.maximum(total, 1)

    letters = (ends - starts).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(letters)])
    chars = sums[firsts[1:]] - sums[firsts[:-1]]
    words = fingerprints(texts.prefix_hashes(lower=True), starts, ends)
    of_word = np.repeat(np.arange(len(texts)), np.diff(firsts))
    order = np.lexsort((words, of_word))
    new = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])])[: len(words)]
    distinct = np.bincount(of_word[order][new], minlength=len(texts))
    same = np.concatenate([[False], (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])])[: len(words)]
    twice = np.bincount(of_word[same], minlength=len(texts))
    # pairs of words that the text has before
    joined = np.concatenate([words[:1], words[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + words
    order = np.lexsort((joined, of_word))
    again = np.concatenate([[False], (joined[order][1:] == joined[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])])[: len(words)]
    pairs = np.bincount(of_word[order][again], minlength=len(texts))
    lines = share(texts.data == 10, np.ones(len(texts)))
    separators = share(SEPARATOR[texts.data], per_text)
    longest = np.zeros(len(texts))
    np.maximum.at(longest, of_word, letters)
    columns = [
        np.log1p(n),
        chars / size,
        share(kinds == 1, size),
        share(kinds == 2, chars),
        share(kinds == 3, chars),
        share(kinds == 6, chars),
        share(kinds == 4, size),
        share(kinds == 5, size),
        np.log1p(lines),
        n / (lines + 1),
        pairs / size,
        distinct / size,
        twice / size,
        np.sqrt(pairs),
        separators,
        np.log1p(longest),
    ]
    return np.stack(columns, 1)


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, cuts: np.ndarray, base: float, tables: np.ndarray, chosen: list[tuple[int, int]], grids: np.ndarray):
        self.cuts, self.base, self.tables, self.chosen, self.grids = cuts, base, tables, chosen, grids

    def parts(self) -> tuple:
        return self.cuts, self.base, self.tables, self.chosen, self.grids

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[f], x[:, f], "right") for f in range(x.shape[1])], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for f in range(x.shape[1]):
            total += self.tables[f][bins[:, f]]
        small = bins * PAIR_BINS // BINS
        for (f, g), grid in zip(self.chosen, self.grids, strict=True):
            total += grid[small[:, f], small[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree of ``LEAVES`` leaves over sums by bin."""
    edges = [0, len(gradient)]

    def gain(a: int, b: int) -> tuple[float, int]:
        g, h, n = (np.cumsum(x[a:b]) for x in (gradient, weight, count))
        if b - a < 2:
            return 0.0, a
        left = g[:-1] ** 2 / (h[:-1] + PENALTY)
        right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + PENALTY)
        got = left + right - g[-1] ** 2 / (h[-1] + PENALTY)
        got[(n[:-1] < LEAF) | (n[-1] - n[:-1] < LEAF)] = 0
        best = int(np.argmax(got))
        return float(got[best]), a + best + 1

    for _ in range(LEAVES - 1):
        best, cut = max(gain(a, b) for a, b in zip(edges, edges[1:], strict=False))
        if best <= 0:
            break
        edges = sorted({*edges, cut})
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + PENALTY)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of rows ``x`` with labels ``y`` (0 or 1)."""
    count, width = x.shape
    cuts = np.stack([np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]) if count else np.zeros(BINS - 1) for f in range(width)])
    model = Additive(cuts, 0.0, np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if count else 0.5
    model.base = float(np.log(rate / (1 - rate)))
    if count == 0 or y.min() == y.max():
        return model
    bins = model.bins(x)
    total = np.full(count, model.base)
    for _ in range(CYCLES):
        for f in range(width):
            p = 1 / (1 + np.exp(-total))
            b = bins[:, f]
            sums = [np.bincount(b, v, BINS) for v in (y - p, p * (1 - p), np.ones(count))]
            step = RATE * _tree(*sums)
            model.tables[f] += step
            total += step[b]
    small = bins * PAIR_BINS // BINS
    p = 1 / (1 + np.exp(-total))
    ranked = []
    for f in range(width):
        for g in range(f):
            cell = small[:, f] * PAIR_BINS + small[:, g]
            grad, weight = np.bincount(cell, y - p, PAIR_BINS**2), np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            ranked.append((float((grad**2 / (weight + PENALTY)).sum()), f, g))
    model.chosen = [(f, g) for _, f, g in sorted(ranked, reverse=True)[:PAIRS]]
    model.grids = np.zeros((len(model.chosen), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_CYCLES):
        for k, (f, g) in enumerate(model.chosen):
            p = 1 / (1 + np.exp(-total))
            cell = small[:, f] * PAIR_BINS + small[:, g]
            sums = [np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p), np.ones(count))]
            # one cut along a feature, then one along the other on either side
            rows = _tree(*[s.sum(1) for s in sums])
            step = np.empty((PAIR_BINS, PAIR_BINS))
            for value in np.unique(rows):
                part = rows == value
                step[part] = _tree(*[s[part].sum(0) for s in sums])
            model.grids[k] += RATE * step
            total += RATE * step[small[:, f], small[:, g]]
    return model


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality.  Labels are learnt
    from rows whose crc32(doc_id) modulo ``folds`` is not ``held_out``; of more than
    ``SAMPLE`` such rows those whose hash is smallest.  Null labels teach nothing, null and
    empty texts are scored by their zeros, a null doc_id is not held out.
    Without labels of both classes every score is the prior.
    """
    kind = "doc_id long, x array<double>"
    schema = arrow_schema(kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x = features(Texts.of(piece.column("text")))
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                column = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), column], schema=schema)

    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    measured = stored(docs.select("doc_id", "text").mapInArrow(measure, kind), "features")
    known = labels.where(F.col("quality").isin(0, 1)).where(fold != held_out).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = measured.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("x", "y").toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    model = fit(x, np.array(rows.column("y")))
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    out_kind = "doc_id long, score double"
    out_schema = arrow_schema(out_kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Additive(*shared.value)
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known.score(x))], schema=out_schema)

    return measured.mapInArrow(score, out_kind).select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
