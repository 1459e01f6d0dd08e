from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scorecraft.llm import quality_crf, quality_rules
from scorecraft.llm import text as tx
from scorecraft.llm.samples import within_lines
from scorecraft.llm.store import table

from .conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        duplicates,
        len(covered),
    )


def test_counts_equal_brute_force(spark, odd_documents):
    documents = table(spark, SF, "documents").select("doc_id", "text").unionByName(
        odd_documents.select("doc_id", "text")
    )
    forest = quality_rules.fit(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0), np.zeros(0))
    rows = quality_rules.judge(documents, forest).collect()
    got = Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in rows)
    want = Counter()
    for r in documents.collect():
        counts = brute_counts(r.text)
        want[(r.doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])] += 1
    assert got == want


def test_rules_keep_good_documents_of_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = quality_rules.op10_quality_rules(spark, SF).where("not base_failed").collect()
    held = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([k == bool(q) for k, q in held]) > 0.95


def test_trees_are_monotonic_and_deterministic():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) < 0.5).astype(float)
    forest = quality_rules.fit(x, y, np.array([-1, 0, 1]), trees=20)
    base = rng.random((50, 3))
    for column, sign in ((0, -1), (2, 1)):
        steps = np.repeat(base, 30, 0)
        steps[:, column] = np.tile(np.linspace(0, 1, 30), 50)
        moves = np.diff(forest.scores(steps).reshape(50, 30), axis=1)
        assert (sign * moves >= -1e-12).all()
    again = quality_rules.fit(x, y, np.array([-1, 0, 1]), trees=20)
    assert (again.scores(x) == forest.scores(x)).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths = [1, 4, 2, 3]
    unary, trans = rng.standard_normal(sum(lengths)), rng.standard_normal((2, 2))
    owner = np.repeat(np.arange(4), lengths)
    total, good, pairs = quality_crf.Chains(owner, 4).marginals(unary, trans)
    at, log_z, seen = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        weights = {}
        for bits in np.ndindex(*([2] * n)):
            s = sum(unary[at + t] for t, b in enumerate(bits) if b)
            weights[bits] = np.exp(s + sum(trans[a, b] for a, b in zip(bits, bits[1:], strict=False)))
        z = sum(weights.values())
        log_z += np.log(z)
        for t in range(n):
            assert np.isclose(good[at + t], sum(w for b, w in weights.items() if b[t]) / z)
        for bits, w in weights.items():
            for a, b in zip(bits, bits[1:], strict=False):
                seen[a, b] += w / z
        at += n
    assert np.isclose(total, log_z) and np.allclose(pairs, seen)


def test_classifier_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = quality_crf.op2_quality_crf(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.95


def test_odd_documents_and_empty_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = quality_crf.train(odd_documents, labels)
    scored = quality_crf.score(odd_documents, field)
    assert scored.count() == odd_documents.count()
    assert scored.where("score between 0 and 1").count() == odd_documents.count()
    assert quality_crf.score(no_documents, field).count() == 0
    forest = quality_rules.train(odd_documents, labels)
    assert quality_rules.judge(no_documents, forest).count() == 0
    assert quality_rules.keep_good(odd_documents, forest).columns == odd_documents.columns
    assert quality_crf.keep_good(odd_documents, field).columns == odd_documents.columns


def test_lines_and_words_keep_to_their_documents():
    data, bounds = tx.flat(pa.array(["a b", "", None, "c\n\nd", "\n"]))
    starts, ends, owner = tx.words(data, bounds)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"a", b"b", b"c", b"d"]
    assert owner.tolist() == [0, 0, 3, 3]
    first, last, at = tx.lines(data, bounds)
    assert at.tolist() == [0, 1, 2, 3, 3, 3, 4, 4]
    assert (last - first).tolist() == [3, 0, 0, 1, 0, 1, 0, 0]


def test_a_sample_keeps_texts_of_every_length(spark):
    """A class of long texts has fewer documents, whole ones; the longest come last."""
    rows = [(i, "line\n" * 9 + "end", 0) for i in range(50)] + [(100 + i, "x\n" * 299 + "y", 1) for i in range(50)]
    rows += [(200, "z\n" * 5000, 1), (300, None, 0), (300, "a\nb", 0)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    kept = within_lines(sample, 1000).collect()
    lines = {0: 0, 1: 0}
    for r in kept:
        lines[r.label] += (r.text or "").count("\n") + 1
    assert lines == {0: 503, 1: 900} and all(r.doc_id != 200 for r in kept)
    assert sorted(r.text is None for r in kept if r.doc_id == 300) == [False, True]
    alone = within_lines(sample.where("doc_id = 200"), 1000).collect()
    assert [r.doc_id for r in alone] == [200]
    assert within_lines(sample.limit(0), 1000).count() == 0


def test_shares_weigh_transitions():
    """Half a share counts half; without shares every line counts as one."""
    chances = np.random.default_rng(3)
    owner = np.repeat([0, 1, 2], [4, 1, 3])
    chains = quality_crf.Chains(owner, 3)
    unary, trans = chances.normal(size=8), chances.normal(size=(2, 2))
    total, good, pairs = chains.marginals(unary, trans)
    same = chains.marginals(unary, trans, np.full(8, 0.5))
    assert np.allclose(same[2], pairs / 2) and np.allclose(same[1], good) and same[0] == total
    only = chains.marginals(unary, trans, (owner == 0).astype(float))[2]
    first = quality_crf.Chains(owner[:4], 1).marginals(unary[:4], trans)[2]
    assert np.allclose(only, first)
