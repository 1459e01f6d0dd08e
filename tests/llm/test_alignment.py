from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from scorecraft.llm import alignment
from scorecraft.llm.store import table

from .conftest import SF

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b \n"), (5, "x▁y"), (5, "x▁y z"), (None, "<s> hi <|endoftext|>"),
    (6, "　\xa0é中\U0001f600 \0 <0x41>"), (7, "a b " * 20_000), (8, "x" * 3000), (9, " ▁ "), (10, "é \r\n"),
]


@pytest.fixture(scope="module")
def bytes_of(tokenizer):
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    a = [bytes(back[c] for c in tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())]
    model = SentencePieceProcessor(model_file=B)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b = [bytes([int(x[1:-1], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return a, b


def brute(rows, tokenizer, bytes_of):
    model = SentencePieceProcessor(model_file=B)
    documents, count = [], Counter()
    for doc_id, text in rows:
        groups, n = [], (0, 0)
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if text and all(b"".join(e[i] for i in x) == raw for e, x in zip(bytes_of, (a, b))):
            n = len(a), len(b)
            ends = [np.cumsum([len(e[i]) for i in x]).tolist() for e, x in zip(bytes_of, (a, b))]
            i = j = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                groups.append((a[i:k], b[j:m]))
                i, j = k, m
        pairs = [(x[-1], y[-1]) for x, y in groups]
        count.update(pairs)
        documents.append((doc_id, n, groups, pairs))
    best = Counter()
    for (_, b), times in count.items():
        best[b] = max(best[b], times)
    out = []
    for doc_id, n, groups, pairs in documents:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        lead = sum(count[p] == best[p[1]] for p in pairs)
        out.append((str(doc_id), *n, len(groups), len(pairs), lead, sum(count[p] for p in pairs), digest))
    return sorted(out), count


@pytest.mark.parametrize("most", [1 << 18, 50, 0])
def test_alignment_equals_brute_force(spark, tokenizer, bytes_of, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_LOOKED_UP", most)
    some = table(spark, SF, "documents").where("doc_id < 150").select("doc_id", "text")
    given = some.union(spark.createDataFrame(ODD + ODD[:4], "doc_id long, text string")).repartition(3)
    want, count = brute([tuple(r) for r in given.collect()], tokenizer, bytes_of)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.scored(given, A, B).select("doc_id", *columns).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    pairs = alignment.alignment(given, A, B).collect()
    assert {(r.a, r.b): r.n for r in pairs} == count and len(pairs) == len(count)


def test_alignment_of_odd_documents(spark, tokenizer, bytes_of, odd_documents, no_documents):
    want, _ = brute([(r.doc_id, r.text) for r in odd_documents.collect()], tokenizer, bytes_of)
    got = alignment.scored(odd_documents, A, B).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert alignment.scored(no_documents, A, B).count() == 0
    assert alignment.alignment(no_documents, A, B).count() == 0


def test_identity_map_has_the_same_bytes(bytes_of):
    a, b = bytes_of
    identity = alignment.identity_map(a, b)
    assert all(i < 0 or b[i] == x for i, x in zip(identity.tolist(), a))
    assert all((i >= 0) == (x in set(b)) for i, x in list(zip(identity.tolist(), a))[:2000])
