"""Quality rules: boosted trees over document statistics, behind fixed base rules.

Trees are fitted on a bounded sample of labelled documents, with monotonic constraints on
chosen features, and flattened into node arrays.  All documents are scored in one map over
their whole texts, each tree level being one numpy gather for all rows and trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scorecraft.llm import text as tx
from scorecraft.llm.samples import labelled_sample
from scorecraft.llm.store import table

#: The symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which they may move the chance of a good document:
#: 1 never lowers it, -1 never raises it, 0 is free.
FEATURES = {
    "log_words": 1,
    "mean_word": 0,
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": 0,
    "shout_share": -1,
    "bar_share": -1,
    "digit_share": 0,
    "stop_share": 0,
    "other_ascii_share": 0,
    "mean_line": 0,
}
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = tx.byte_class("0123456789")
SHOUT, BAR, STOP = tx.byte_class("!"), tx.byte_class("|"), tx.byte_class(".,;:?")
SYMBOL = tx.byte_class(SYMBOLS)
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
ODD = np.arange(256) < 128
ODD &= ~(LETTER | DIGIT | SHOUT | BAR | STOP | SYMBOL | tx.SPACE)


def statistics(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (``COUNTS``, exact) and features (``FEATURES``) of a slice of texts."""
    n = len(bounds) - 1
    starts, ends, owner = tx.words(data, bounds)
    spans = tx.SpanHash(data)
    word = spans(starts, ends)

    points = tx.byte_sums((data & 0xC0) != 0x80)
    lengths = points[ends] - points[starts]
    n_words = np.bincount(owner, minlength=n)
    word_chars = tx.per_document(lengths, owner, n).astype(np.int64)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = tx.byte_sums(flags[data])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    first, last, at = tx.lines(data, bounds)
    filled = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, at = first[filled], last[filled], at[filled]
    _, later = tx.repeated(spans(first, last), at)
    n_dup_lines = np.bincount(at[later], minlength=n)

    window, window_owner = tx.shingles(word, owner, 3)
    often, _ = tx.repeated(window, window_owner)
    covered = np.zeros(len(word), bool)
    if len(window):
        begins = np.flatnonzero(owner[:-2] == owner[2:])[often]
        for k in range(3):
            covered[begins + k] = True
    n_repeat_words = np.bincount(owner[covered], minlength=n)

    n_symbols = share(SYMBOL)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], 1)
    size = np.maximum(np.diff(bounds), 1)
    some_words, some_lines = np.maximum(n_words, 1), np.maximum(np.bincount(at, minlength=n), 1)
    features = np.stack(
        [
            np.log1p(n_words),
            word_chars / some_words,
            n_symbols / size,
            n_dup_lines / some_lines,
            n_repeat_words / some_words,
            share(UPPER) / size,
            share(SHOUT) / some_words,
            share(BAR) / some_words,
            share(DIGIT) / size,
            share(STOP) / some_words,
            share(ODD) / size,
            n_words / some_lines,
        ],
        1,
    )
    return counts.astype(np.int64), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass(frozen=True)
class Forest:
    """Boosted trees as arrays: row ``t`` holds the nodes of tree ``t`` in level order.

    Node ``i`` has the children ``2 i + 1`` (feature not above the threshold) and
    ``2 i + 2``; a node that was not split sends every row left, with the same value below.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of a good document for each row of features."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))[:, None]
        while node.size and node[0, 0] < inner:
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.leaf[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    direction: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least: float = 5.0,
    ridge: float = 1.0,
) -> Forest:
    """Newton boosting of the logistic loss on histograms of quantile bins.

    A split on a constrained feature is taken only if its two values are in order, and
    both sides inherit the middle of them as a bound, so the whole tree stays monotonic.
    With one class only, or no row, the forest is a constant.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_good = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_good / (1 - rate_of_good)))
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if len(np.unique(y)) < 2:
        return Forest(feature[:0], threshold[:0], leaf[:0], base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    raw = np.full(len(y), base)

    def grow(tree: int, node: int, rows: np.ndarray, low: float, high: float) -> None:
        g, h = gradient[rows], hessian[rows]

        def value(a, b):
            return np.clip(-a / (b + ridge), low, high)

        def gain(a, b, v):
            return -(a * v + 0.5 * (b + ridge) * v * v)

        if node >= inner:
            v = float(value(g.sum(), h.sum()))
            leaf[tree, node - inner] = rate * v
            raw[rows] += rate * v
            return
        whole = gain(g.sum(), h.sum(), value(g.sum(), h.sum()))
        best, found = whole + 1e-6, None
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            at = binned[rows, f]
            left_g = np.cumsum(np.bincount(at, g, len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(at, h, len(c) + 1))[:-1]
            right_g, right_h = g.sum() - left_g, h.sum() - left_h
            left, right = value(left_g, left_h), value(right_g, right_h)
            score = gain(left_g, left_h, left) + gain(right_g, right_h, right)
            bad = (np.minimum(left_h, right_h) < least / 4) | (direction[f] * (right - left) < 0)
            score[bad] = -np.inf
            k = int(score.argmax())
            if score[k] > best:
                best, found = score[k], (f, c[k], k, left[k], right[k])
        if found is None:
            grow(tree, 2 * node + 1, rows, low, high)
            return
        f, cut, k, left, right = found
        feature[tree, node], threshold[tree, node] = f, cut
        middle = (left + right) / 2
        below = binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}
        bounds[-1] = bounds[1][::-1]
        for side, part, limit in zip((1, 2), (below, ~below), bounds[int(direction[f])], strict=True):
            grow(tree, 2 * node + side, rows[part], *limit)

    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = p - y, p * (1 - p)
        grow(t, 0, np.arange(len(y)), -np.inf, np.inf)
    return Forest(feature, threshold, leaf, base)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000) -> Forest:
    """Trees fitted on at most ``per_class`` labelled documents of either class."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                _, x = statistics(*tx.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
                    ["doc_id", "label", "x"],
                )

    sample = labelled_sample(documents, labels, "quality", per_class)
    # no more than the two classes' bound, ordered, so that reruns fit the same trees
    rows = sample.mapInArrow(features, "doc_id long, label int, x array<double>").collect()
    rows = sorted((r.doc_id, r.label, r.x) for r in rows)
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    return fit(x, y, np.array(list(FEATURES.values())))


def judge(documents: DataFrame, forest: Forest, cut: float = 0.5) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` of every row.

    Null and empty texts have no words, so they fail the base rules; repeated rows and null
    ids give a row each; other columns are not read.  One map, no shuffle.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                counts, x = statistics(*tx.flat(part.column("text")))
                failed = base_failed(counts)
                p = forest.scores(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array(c) for c in counts.T),
                        pa.array(failed),
                        pa.array(p),
                        pa.array(~failed & (p >= cut)),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "score", "kept"],
                )

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return documents.select("doc_id", "text").mapInArrow(
        score, f"doc_id long, {kinds}, base_failed boolean, score double, kept boolean"
    )


def keep_good(documents: DataFrame, forest: Forest, cut: float = 0.5) -> DataFrame:
    """The rows, all columns unchanged, that ``judge`` keeps; one map, no join."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                counts, x = statistics(*tx.flat(part.column("text")))
                yield part.filter(pa.array(~base_failed(counts) & (forest.scores(x) >= cut)))

    return documents.mapInArrow(keep, documents.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, train(documents, table(spark, sf_dir, "labels")))
