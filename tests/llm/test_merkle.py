from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scorecraft.llm import merkle
from scorecraft.llm.store import table

from .conftest import SF


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, row.n_chars, row.text]
    if more and row.n_chars is not None:
        values[3] += more
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(leaves, fan):
    """The top of a tree, and for each leaf the siblings of its way there."""
    now, paths = list(leaves), [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    while len(now) > 1:
        runs = [range(i, min(i + fan, len(now))) for i in range(0, len(now), fan)]
        for run in runs:
            for place, k in enumerate(run):
                for i in under[k]:
                    paths[i].append((place, [now[j] for j in run if j != k]))
        now = [sha(*[now[k] for k in run]) for run in runs]
        under = [[i for k in run for i in under[k]] for run in runs]
    return now[0], paths


def brute(rows, fan):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for name in names:
        trees[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        tops[name] = grown([leaf(r) for r in trees[name]], fan)
    root, above = grown([tops[name][0] for name in names], fan)
    out = []
    for name, up in zip(names, above, strict=True):
        for r, path in zip(trees[name], tops[name][1], strict=True):
            marked = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            own = leaf(r, int(marked))
            for place, others in path + up:
                own = sha(*others[:place], own, *others[place:])
            proof = sha(*[x for _, others in path + up for x in others])
            out.append((str(r.doc_id), leaf(r), tops[name][0], root, proof, own, own == root))
    return sorted(out)


def shown(documents, shape):
    marked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.leaf(n_chars=F.when(marked, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    out = merkle.manifest(documents, found, shape).select(
        F.col("doc_id").cast("string"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof"),
        merkle.fold(F.col("claimed"), F.col("path")).alias("folded"),
    )
    return sorted((str(r[0]), *r[1:], r.folded == r.root) for r in out.collect())


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(2, 2), merkle.Shape(3, 2)])
def test_manifest_equals_brute_force(spark, shape):
    documents = table(spark, SF, "documents").where("doc_id < 130")
    assert shown(documents, shape) == brute(documents.collect(), shape.fan)


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(2, 1)])
def test_manifest_of_odd_rows(spark, odd_documents, no_documents, shape):
    more = [
        (None, None, None, None, None),
        (None, None, None, None, None),
        (22, "x", None, "s", None),
        (5, "y", None, "s", 4),
        (5, "z", None, "s", 4),
    ]
    odd = odd_documents.unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"),
        allowMissingColumns=True,
    ).withColumns({x: F.lit("clash") for x in ("tree", "at", "block", "digest", "item", "path")})
    assert shown(odd, shape) == brute(odd.collect(), 2)
    assert merkle.manifest(no_documents).count() == 0


def test_no_join_or_window_holds_a_tree(spark):
    plan = merkle.manifest(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
