from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import tokenizers

from scorecraft.llm import packing, token_blocks
from scorecraft.llm.store import shared_folder, table
from scorecraft.llm.tokens import Encoder

from scorecraft.llm import text as tx

from .conftest import SF, doubled


def test_span_hashes_tell_texts_apart():
    rng = np.random.default_rng(2)
    words = [w for n in range(1, 15) for w in doubled(n)] + ["", "\0", "\0\0", "a" * 8, "a" * 9, "a" * 16]
    words += ["".join(rng.choice(list("ab"), rng.integers(1, 40))) for _ in range(4000)]
    places = rng.permutation(np.repeat(np.arange(len(words)), 2))  # each word in two places
    data = np.frombuffer("".join(words[i] for i in places).encode(), np.uint8)
    size = np.array([len(words[i]) for i in places])
    ends = np.cumsum(size)
    keys = tx.SpanHash(data)(ends - size, ends)
    assert len({(words[i], k) for i, k in zip(places, keys.tolist())}) == len(set(words)) == len(set(keys.tolist()))
    assert len(tx.SpanHash(data[:0])(ends[:0], ends[:0])) == 0


def test_pieces_give_the_library_ids(vocabulary, tokenizer):
    random.seed(3)
    alphabet = [" ", " ", "\n", "a", "Word", "é", "×", "1", "'s", "!", "\t", "\u3000", "\xa0", "中", "\r", "<|endoftext|>", "ÿ"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(5000)] + [None]
    ids, edges = Encoder.of(vocabulary).ids(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == want


def test_an_encoder_holds_its_vocabulary_once(vocabulary, monkeypatch):
    read, real = [], tokenizers.Tokenizer

    class Counted:
        def __new__(cls, model):
            return real(model)

        @staticmethod
        def from_file(path):
            read.append(path)
            return real.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    Encoder(vocabulary)
    assert read == [vocabulary]


def test_keys_are_looked_up_once_and_in_order(vocabulary, tokenizer, monkeypatch):
    encoder, looked, search = Encoder(vocabulary), [], np.searchsorted

    def counted(kept, wanted, *args, **kwargs):
        if kept is encoder.keys:
            looked.append(np.asarray(wanted))
        return search(kept, wanted, *args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", counted)
    texts = ["a new étude, 12 of 12", "", "Zweitens: a new größe", "a new étude × 3", "nothing new: a new étude"]
    for text in texts:
        ids, edges = encoder.ids(pa.array([text, None, text]))
        once = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == 2 * once
        assert edges.tolist() == [0, len(once), len(once), 2 * len(once)]
        assert (encoder.keys[1:] > encoder.keys[:-1]).all()
    assert len(looked) == len(texts)
    assert all((wanted[1:] > wanted[:-1]).all() for wanted in looked)


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for ids in (
        np.zeros(0, np.uint32),
        np.array([7], np.uint32),
        np.full(300, 5, np.uint32),
        rng.integers(0, 50_000, 1000).astype(np.uint32),
        np.where(rng.random(5000) < 0.05, rng.integers(0, 1 << 32, 5000), 3).astype(np.uint32),
    ):
        index, area = token_blocks.encode_blocks(ids)
        assert (token_blocks.decode_blocks(area, index, len(ids)) == ids).all() if len(ids) else not area
    few = np.where(np.arange(1280) % 64 == 0, 1 << 31, 9).astype(np.uint32)
    assert len(token_blocks.encode_blocks(few)[1]) < 4 * len(few) / 8  # outliers do not widen blocks


def expected(documents, tokenizer, end):
    return [
        (r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end])
        for r in documents.collect()
    ]


def test_files_give_back_every_document(spark, vocabulary, tokenizer, odd_documents, no_documents):
    for documents in (table(spark, SF, "documents"), odd_documents, no_documents):
        path = shared_folder(spark)
        token_blocks.write_tokens(documents, path, vocabulary)
        got = [tuple(r) for r in token_blocks.read_tokens(spark, path).collect()]
        start, want = 0, []
        for doc_id, ids in sorted(expected(documents, tokenizer, 0), key=lambda x: (x[0] is not None, x[0] or 0)):
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(got, key=lambda r: r[1]) == want


def check_pieces(rows, documents, tokenizer, limits):
    texts = expected(documents, tokenizer, 1)
    total = {}
    for doc_id, ids in texts:
        total[doc_id] = total.get(doc_id, 0) + len(ids)
    by_id = dict(texts)
    sequences, covered = {}, {}
    for r in rows:
        raw = np.array(by_id[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(by_id[r.doc_id]) and zlib.crc32(raw) == r.ids_crc32
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == total
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / max(1, sum(total.values()))


def test_packing_is_whole_and_tight(spark, vocabulary, tokenizer, odd_documents, no_documents):
    documents = table(spark, SF, "documents")
    rows = packing.digest(packing.pack(documents, vocabulary)).collect()
    assert check_pieces(rows, documents, tokenizer, packing.Limits()) < 0.01
    rows = packing.digest(packing.pack(odd_documents, vocabulary)).collect()
    check_pieces(rows, odd_documents, tokenizer, packing.Limits())
    assert packing.pack(no_documents, vocabulary).count() == 0


def test_all_three_limits_hold():
    rng = np.random.default_rng(5)
    limits = packing.Limits(tokens=256, segments=4, loss_tokens=100)
    packer = packing.Packer(limits, lot=64)
    sequences, given = [], 0
    for key in range(500):
        length = int(rng.integers(1, 600))
        loss = int(rng.integers(0, length + 1))
        given += length
        sequences += packer.add(key, length, loss)
    sequences += packer.finish()
    seen = sorted((p.key, p.start, p.length) for s in sequences for p in s.pieces)
    assert sum(x[2] for x in seen) == given
    for (k, start, length), (k2, start2, _) in zip(seen, seen[1:], strict=False):
        assert start2 == (start + length if k2 == k else 0)
    for s in sequences:
        assert sum(p.length for p in s.pieces) == s.tokens <= limits.tokens
        assert len(s.pieces) <= limits.segments and sum(p.loss for p in s.pieces) <= limits.loss_tokens
