"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad.  Its potential is a linear function of its own, the previous and
the next line's features; neighbouring labels share a transition matrix.  Forward-backward
gives each line's marginal chance of being good, and a document's quality is the
length-weighted mean of them, calibrated by a monotonic logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scorecraft.llm import text as tx
from scorecraft.llm.quality_rules import BAR, DIGIT, ODD, SHOUT, STOP, SYMBOL, UPPER
from scorecraft.llm.samples import fold, labelled_sample, within_lines
from scorecraft.llm.store import table

#: Training documents of either class, and the most lines that they may have together.
PER_CLASS, MOST_LINES = 2000, 1 << 16
N_OWN = 11


def line_features(data: np.ndarray, bounds: np.ndarray):
    """Own features, weight and document of every line of a slice of texts.

    The weight is the line's length plus one, so an empty text has one line of weight 1.
    """
    first, last, owner = tx.lines(data, bounds)
    size = np.maximum(last - first, 1)
    starts, ends, word_owner = tx.words(data, bounds)
    at = np.searchsorted(first, starts, side="right") - 1
    n_words = np.bincount(at, minlength=len(first))
    some = np.maximum(n_words, 1)
    spans = tx.SpanHash(data)
    _, later = tx.repeated(spans(first, last), owner)
    word = spans(starts, ends)
    _, distinct = tx.groups(word, at)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = tx.byte_sums(flags[data])
        return sums[last] - sums[first]

    x = np.stack(
        [
            np.log1p(last - first),
            np.log1p(n_words),
            np.sqrt(count(UPPER) / size),
            np.sqrt(count(SYMBOL) / size),
            np.minimum(count(SHOUT) / some, 2.0),
            np.minimum(count(BAR) / some, 2.0),
            np.sqrt(count(DIGIT) / size),
            np.minimum(count(STOP) / some, 2.0),
            np.sqrt(count(ODD) / size),
            later & (n_words > 0),
            np.bincount(np.sort(at)[distinct], minlength=len(first)) / some,
        ],
        1,
    )
    return x.astype(np.float64), (last - first + 1).astype(np.float64), owner


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and two flags for the ends of a text."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = owner[1:] == owner[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    ends = np.ones((len(own), 2))
    ends[1:, 0][same] = 0
    ends[:-1, 1][same] = 0
    return np.concatenate([own, before, after, ends, np.ones((len(own), 1))], 1)


class Chains:
    """The lines of a slice, arranged so that one step handles line ``t`` of every text."""

    def __init__(self, owner: np.ndarray, n: int):
        lengths = np.bincount(owner, minlength=n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        self.steps = [starts[order[:a]] + t for t, a in enumerate(active)]

    def marginals(self, unary: np.ndarray, trans: np.ndarray, share: np.ndarray | None = None):
        """Log partition sum over all texts, line marginals and expected transitions.

        ``unary`` is the log-odds of good against bad of every line; ``trans[a, b]`` the
        score of label ``b`` after label ``a``.  Transitions count by the ``share`` of the
        line they lead to, each as one if none is given.
        """
        share = np.ones(len(unary)) if share is None else share
        forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
        score = np.stack([np.zeros_like(unary), unary], 1)
        for t, rows in enumerate(self.steps):
            forward[rows] = score[rows]
            if t:
                come = forward[rows - 1][:, :, None] + trans
                forward[rows] += np.logaddexp(come[:, 0], come[:, 1])
        pairs = np.zeros((2, 2))
        total = 0.0
        for t in range(len(self.steps) - 1, -1, -1):
            rows = self.steps[t]
            goes = self.steps[t + 1] if t + 1 < len(self.steps) else rows[:0]
            ended = rows[len(goes) :]
            total += np.logaddexp(forward[ended, 0], forward[ended, 1]).sum()
            if len(goes):
                on = trans + (score[goes] + backward[goes])[:, None, :]
                backward[goes - 1] = np.logaddexp(on[:, :, 0], on[:, :, 1])
                joint = forward[goes - 1][:, :, None] + on
                joint -= joint.max((1, 2), keepdims=True)
                joint = np.exp(joint)
                joint *= (share[goes] / joint.sum((1, 2)))[:, None, None]
                pairs += joint.sum(0)
        both = forward + backward
        return total, 1 / (1 + np.exp(both[:, 0] - both[:, 1])), pairs


@dataclass(frozen=True)
class LineField:
    """Fitted weights; ``centre`` and ``scale`` bring own features to unit variance."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def shares(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of every text of a slice."""
        n = len(bounds) - 1
        own, weight, owner = line_features(data, bounds)
        z = with_neighbours((own - self.centre) / self.scale, owner)
        _, good, _ = Chains(owner, n).marginals(z @ self.weights, self.trans)
        return tx.per_document(good * weight, owner, n) / tx.per_document(weight, owner, n)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Quality between 0 and 1 of every text of a slice."""
        share = self.shares(data, bounds)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit(share) + self.shift, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 120) -> LineField:
    """Maximum likelihood with a ridge; ``texts`` are (own features, weights, label).

    Lines take the label of their document: a weak label, which the shared transitions and
    the calibration of the document score make up for.  Without both labels every text
    scores the share of good labels, one half if there are none.
    """
    labels = np.array([label for _, _, label in texts], float)
    if len(np.unique(labels)) < 2:
        p = (labels.sum() + 1) / (len(labels) + 2)
        zero = np.zeros(3 * N_OWN + 3)
        return LineField(
            np.zeros(N_OWN), np.ones(N_OWN), zero, np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p)))
        )
    own = np.concatenate([t[0] for t in texts])
    weight = np.concatenate([t[1] for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    centre, scale = own.mean(0), own.std(0) + 1e-6
    z = with_neighbours((own - centre) / scale, owner)
    y = labels[owner]
    chains = Chains(owner, len(texts))
    same = owner[1:] == owner[:-1]
    # a text counts as one of mean length, however many lines it has
    n_lines = np.bincount(owner)
    share = (n_lines.mean() / n_lines)[owner]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), share[1:][same])
    d = z.shape[1]

    def gradient(w: np.ndarray) -> np.ndarray:
        _, good, pairs = chains.marginals(z @ w[:d], w[d:].reshape(2, 2), share)
        g = np.concatenate([z.T @ (share * (good - y)), (pairs - seen).ravel()]) / len(texts)
        return g + 1e-3 * w

    w = _adam(gradient, np.zeros(d + 4), steps, 0.1)
    field = LineField(centre, scale, w[:d], w[d:].reshape(2, 2))
    _, good, _ = chains.marginals(z @ field.weights, field.trans)
    n = len(texts)
    share = logit(tx.per_document(good * weight, owner, n) / tx.per_document(weight, owner, n))
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def curve(w: np.ndarray) -> np.ndarray:
        error = balance * (1 / (1 + np.exp(-np.clip(w[0] * share + w[1], -30, 30))) - labels)
        return np.array([(error * share).mean(), error.mean()]) + 1e-3 * np.array([w[0] - 1, w[1]])

    slope, shift = _adam(curve, np.array([1.0, 0.0]), 400, 0.05)
    return LineField(centre, scale, field.weights, field.trans, max(float(slope), 1e-3), float(shift))


def train(
    documents: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    most_lines: int = MOST_LINES,
) -> LineField:
    """A field fitted on a bounded sample of the labelled documents outside the held-out fold.

    At most ``per_class`` documents of either class are read, and so many of them, of every
    length, that a class has at most ``most_lines`` lines (or one document); so the driver
    holds a bounded number of lines, and a class of long texts is not lost.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                own, weight, owner = line_features(*tx.flat(part.column("text")))
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label").cast(pa.int32()),
                        pa.array([own[a:b].ravel() for a, b in spans], pa.list_(pa.float64())),
                        pa.array([weight[a:b] for a, b in spans], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "x", "w"],
                )

    sample = within_lines(labelled_sample(documents, labels, "quality", per_class), most_lines)
    rows = sample.mapInArrow(
        features, "doc_id long, label int, x array<double>, w array<double>"
    ).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit([(np.array(r.x).reshape(-1, N_OWN), np.array(r.w), r.label) for r in rows])


def score(documents: DataFrame, field: LineField) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, in one map over whole texts.

    A null or empty text is scored as one empty line.  Null ids are not held out.  Repeated
    rows give a row each; no column but ``doc_id`` and ``text`` is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                p = field.scores(*tx.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(p),
                        pa.array((p >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held_out = (fold("doc_id") == 1).alias("held_out")
    rows = documents.select("doc_id", held_out, "text").na.fill({"held_out": False})
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, field: LineField) -> DataFrame:
    """The rows, all columns unchanged, that score 0.5 or more; one map, no join."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                p = field.scores(*tx.flat(part.column("text")))
                yield part.filter(pa.array(p >= 0.5))

    return documents.mapInArrow(keep, documents.schema)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
