from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scorecraft.llm import simhash
from scorecraft.llm.store import table

from .conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    """The smallest value that each is linked with, by all pairs."""
    x = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {int(v): int(x[find(i)]) for i, v in enumerate(x)}


def check(documents):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in documents.collect()]
    root, least = roots([f for _, f in rows]), {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[root[f]] = min(doc_id, least.get(root[f], doc_id))
    want = sorted((str(d), f"{f:016x}", str(least.get(root[f]))) for d, f in rows)
    got = simhash.near_duplicates(documents).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_near_duplicates_equal_brute_force(spark):
    check(table(spark, SF, "documents"))


def test_near_duplicates_of_odd_documents(spark, odd_documents, no_documents):
    check(odd_documents)
    clash = odd_documents.withColumns({x: F.lit(1) for x in ("bits", "cell", "grp", "rows", "least")})
    check(clash.where("doc_id is null or doc_id < 6"))
    assert simhash.near_duplicates(no_documents).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 1 << 63, 30, np.uint64).tolist():
        for _ in range(50):  # clouds whose members link with some of the others only
            near = base
            for p in rng.integers(0, 64, int(rng.integers(0, 9))).tolist():
                near ^= 1 << p
            values.add(near)
    signed = [(int(np.uint64(v).astype(np.int64)), 1) for v in sorted(values)]
    links = simhash.linked(spark.createDataFrame(signed, "bits long, rows long")).collect()
    mask = (1 << 64) - 1
    edges = [(r.a & mask, r.b & mask) for r in links]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    least = {v: v for v in values}
    for _ in range(60):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert least == roots(values)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(-(1 << 63), 1 << 63, 200, np.int64).tolist() + [0, -1]
    rows = spark.createDataFrame([(v,) for v in values], "bits long")
    codes = [r.code & ((1 << 64) - 1) for r in rows.select(simhash.embedded(F.col("bits")).alias("code")).collect()]
    for v, code in zip(values, codes):
        for i in range(0, 64, 2):
            assert (code >> i & 3) == (0, 1, 3)[(v >> i & 3).bit_count()]


def test_a_cloud_costs_no_pairs(spark):
    """Near fingerprints of one group are compared with their cells' centres only."""
    near = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    rows = [(int(np.uint64(v).astype(np.int64)), 100 if v == 0 else 1) for v in near]
    links = simhash.linked(spark.createDataFrame(rows, "bits long, rows long"))
    x = np.array(near, np.uint64)
    pairs = sum(int((np.bitwise_count(v ^ x[:i]) <= 3).sum()) for i, v in enumerate(x))
    assert links.count() * 5 < pairs
