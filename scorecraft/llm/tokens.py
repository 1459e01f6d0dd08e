"""Token ids of whole texts, each distinct word piece being encoded once.

A byte-level tokenizer splits a text by a pattern before it merges bytes, so a text may be
cut wherever no match of the pattern can span the cut: before a blank that a visible
character follows, around a line break between visible characters, and between a letter and
a punctuation mark.  The pieces repeat heavily; the library encodes each distinct one once, and ids are put together by numpy.
Pieces are told apart by their 64-bit hashes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from scorecraft.llm import text as tx

#: Distinct pieces whose ids a worker keeps; it starts anew when there are more.
KEPT_PIECES = 1 << 21

#: Bytes that surely begin or are a visible character: graphic ASCII and the two-byte Latin
#: letters of U+00C0 to U+00FF.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3] = True
_GRAPHIC = _VISIBLE.copy()
_GRAPHIC[0xC3] = False

#: Punctuation that no match of the pattern shares with a letter before it (an apostrophe
#: may begin a contraction, so it is none).
_MARK = tx.byte_class(",.;:!?|)#$%&*")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

#: The letters of U+00C0 to U+00FF are all two bytes, of which these two are signs.
_SIGNS = (0x97, 0xB7)


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the others follow U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_tokenizers: dict = {}


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start positions of the pieces of a slice of texts; every text starts one."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    edge = cut.copy()
    blank = np.flatnonzero(data[:-1] == 0x20)
    cut[blank[_VISIBLE[data[blank + 1]]]] = True
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    cut[mark[_LETTER[data[mark - 1]]]] = True
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    # a break at the end of a text has no character after it in that text
    line = line[
        _GRAPHIC[data[line - 1]] & _VISIBLE[data[line + 1]] & ~edge[line] & ~edge[line + 1]
    ]
    cut[line] = True
    cut[line + 1] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids by the ``tokenizers`` library from one vocabulary file.

    Strings of special tokens in a text are ordinary text.  One per worker and file.
    """

    cuts = staticmethod(cuts)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same model, held once, for words already in the byte-level alphabet
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = _printable()
        spelt = self.words.get_vocab(with_added_tokens=False)
        self.letters = np.zeros(max(spelt.values()) + 1, np.int64)
        self.letters[list(spelt.values())] = [len(token) for token in spelt]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(1, np.int64)[:0]
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if (cls, path) not in _tokenizers:
            _tokenizers[cls, path] = cls(path)
        return _tokenizers[cls, path]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of letters, each with a blank before it or not."""
        # a line break parts two words and has no id; words hold none themselves
        text = b"\n".join(words).decode("latin-1").translate(self.alphabet | {0x0A: "\n"})
        found = self.words.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        # the ids of a word spell all its letters, so its last id ends where it does
        ends = np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum([len(w) for w in words]))
        return ids, np.diff(ends + 1, prepend=0)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(
            [p.decode("utf-8") for p in pieces], add_special_tokens=False
        )
        ids = [e.ids for e in found]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])

    def _encode(self, pieces: list[bytes], word: np.ndarray):
        """The order in which the pieces are taken, and their ids and sizes in that order."""
        order = np.argsort(~word, kind="stable")
        n = int(word.sum())
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for encode, part in ((self._encode_words, order[:n]), (self._encode_pieces, order[n:])):
            if len(part):
                i, size = encode([pieces[k] for k in part.tolist()])
                ids.append(i)
                sizes.append(size)
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys, at, pieces: list[bytes], word: np.ndarray) -> None:
        """Keep new pieces: their keys, ascending, go before the kept ones at ``at``."""
        order, ids, size = self._encode(pieces, word)
        begin = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, begin[place])
        self.size = np.insert(self.size, at, size[place])

    def ids(self, array: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts and the ``n + 1`` boundaries of texts in them.

        ``end`` is appended to every text.  Null texts count as empty.
        """
        data, bounds = tx.flat(array)
        starts = self.cuts(data, bounds)
        stops = np.append(starts[1:], len(data))
        keys = tx.SpanHash(data)(starts, stops)
        coded = pa.array(keys).dictionary_encode()
        found, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        # ascending keys are looked up once, in the order of the kept ones
        ascending = np.argsort(found)
        distinct = found[ascending]
        where, missing = self._look_up(distinct)
        if missing.sum() + len(self.keys) > KEPT_PIECES:
            self._forget()
            where, missing = self._look_up(distinct)
        if missing.any():
            some = np.zeros(len(found), np.int64)
            some[inverse] = np.arange(len(keys))  # any one place of each piece
            at = some[ascending[missing]]
            self._learn(distinct[missing], where[missing], *self._cut_out(data, starts[at], stops[at]))
            where = where + np.cumsum(missing) - missing  # new keys stand before it now
        size, begin = np.empty((2, len(found)), np.int64)
        size[ascending], begin[ascending] = self.size[where], self.begin[where]
        size, begin = size[inverse], begin[inverse]
        pieces = np.concatenate([[0], np.cumsum(size)])
        edges = pieces[np.searchsorted(starts, bounds)]
        source = np.repeat(begin - pieces[:-1], size)
        source += np.arange(len(source))
        ids = self.pool[source]
        if end is None:
            return ids, edges
        return np.insert(ids, edges[1:], np.uint32(end)), edges + np.arange(len(edges))

    def _look_up(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of ascending keys among the kept ones, and which are not kept yet."""
        where = np.searchsorted(self.keys, distinct)
        missing = where == len(self.keys)
        missing[~missing] = self.keys[where[~missing]] != distinct[~missing]
        return where, missing

    @staticmethod
    def _cut_out(data, starts, stops) -> tuple[list[bytes], np.ndarray]:
        """The pieces, and which are words: letters only, after a blank or none."""
        if not len(starts):
            return [], np.zeros(0, bool)
        size = stops - starts
        begin = np.cumsum(size) - size
        own = data[np.repeat(starts - begin, size) + np.arange(size.sum())]
        # a letter of two bytes is never cut, so its bytes are neighbours here too
        latin = np.zeros(len(own) + 1, bool)
        latin[1:-1] = (own[:-1] == 0xC3) & (own[1:] != _SIGNS[0]) & (own[1:] != _SIGNS[1])
        some = np.add.reduceat(_LETTER[own] | latin[1:] | latin[:-1], begin, dtype=np.int64)
        blank = data[starts] == 0x20
        word = (some > 0) & (some + blank == size)
        raw = own.tobytes()
        return [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)], word
