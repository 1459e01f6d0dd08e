"""How the ids of one tokenizer correspond to those of another, counted over a corpus.

Both tokenizers encode the same bytes.  Wherever tokens of both end at one byte the text is
cut, so every document becomes a sequence of groups; the last tokens of a group end together
and are linked.

1. An identity map holds, for each id of A, the id of B with the same bytes.  A group of one
   token each that the map foresees is regular.
2. Regular groups are counted in one vector as long as A's vocabulary per task; only the
   other, irregular groups enter a shuffle of id pairs, summed by document and task before.
3. The highest count of each id of B is a vector as long as B's vocabulary.  With it, the
   regular counts and the most frequent irregular pairs, a bounded number, are looked up by
   the tasks; the other pairs, each of which is rare, are joined.

Encoded documents are written once, as id lists with multiplicities, and never encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import text as tx
from scorecraft.llm.store import stored, table
from scorecraft.llm.tokens import Encoder

#: Most irregular pairs that tasks look up; all others are joined.
MOST_LOOKED_UP = 1 << 18
#: Fixed value: the sign that stands for a blank in a piece.
BLANK = "▁"
#: A pair of ids as one number.
PAIR = 1 << 32

LINKS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "regular array<long>, regular_n array<long>, pairs array<long>, pairs_n array<long>"
)


@dataclass(frozen=True)
class Entries:
    """Byte strings one after another: that of ``i`` is ``pool[start[i] : start[i] + size[i]]``."""

    pool: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(entries: list[bytes]) -> Entries:
        size = np.array([len(x) for x in entries], np.int64)
        return Entries(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of ``ids`` as one buffer, and where each ends in it."""
        size = self.size[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.start[ids] - (ends - size), size)
        return self.pool[source + np.arange(len(source))], ends


class ByteLevel(Encoder):
    """A byte-level tokenizer with the bytes of its entries."""

    def entries(self) -> list[bytes]:
        back = {ord(c): bytes([b]) for b, c in self.alphabet.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            out[i] = b"".join(back.get(ord(c), c.encode()) for c in name)
        return out


class BlankFirst(Encoder):
    """A piece model that adds a blank before a text, for texts given with that blank.

    No entry has a blank behind another character, so no token spans the place where a blank
    follows one, and a text may be cut there.  (A text with the sign of a blank itself never
    gives back its own bytes, cut or not.)
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in x.lstrip(BLANK) for x in names):
            raise ValueError("an entry of the model has a blank inside")
        self.names = names
        self._forget()

    @staticmethod
    def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[bounds] = True
        return np.flatnonzero(cut[:-1])

    def _encode(self, pieces: list[bytes], word: np.ndarray):
        found = self.model.encode([p[1:].decode("utf-8") for p in pieces], num_threads=1)
        # the model gives nothing for an empty text, not even its blank
        blank = [self.model.piece_to_id(BLANK)]
        found = [x if len(p) > 1 else blank for p, x in zip(pieces, found, strict=True)]
        size = np.array([len(x) for x in found], np.int64)
        return np.arange(len(found)), np.array([i for x in found for i in x], np.uint32), size

    def entries(self) -> list[bytes]:
        return [
            bytes([int(x[3:-1], 16)]) if self.model.is_byte(i) else x.replace(BLANK, " ").encode()
            for i, x in enumerate(self.names)
        ]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each id of A the id of B with the same bytes, the last of several, or -1."""
    ids = {entry: i for i, entry in enumerate(b)}
    return np.array([ids.get(entry, -1) if entry else -1 for entry in a], np.int64)


class Aligner:
    """Groups of whole texts by two tokenizers; one per worker and pair of files."""

    _made: dict = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel.of(path_a), BlankFirst.of(path_b)
        entries = self.a.entries(), self.b.entries()
        self.bytes_a, self.bytes_b = (Entries.of(x) for x in entries)
        self.identity = identity_map(*entries)
        most = max(map(len, entries))
        self.numbers = Entries.of([b"%d," % i for i in range(most)])

    @staticmethod
    def of(path_a: str, path_b: str) -> Aligner:
        key = path_a, path_b
        if key not in Aligner._made:
            Aligner._made[key] = Aligner(*key)
        return Aligner._made[key]

    def align(self, texts: pa.Array) -> pa.Table:
        """``LINKS`` of a slice of texts, but for the first two columns."""
        n = len(texts)
        some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
        out = {x: np.zeros(n, np.int64) for x in ("n_a", "n_b", "n_groups")}
        digests = [""] * n
        lists = {"regular": (np.zeros(0, np.int64),) * 3, "pairs": (np.zeros(0, np.int64),) * 3}
        given = pc.binary_join_element_wise(" ", texts.take(pa.array(some)), "")
        whole = self._encoded(given)
        some, (a, edges_a, ends_a), (b, edges_b, ends_b) = some[whole[0]], *whole[1:]
        if len(some):
            total = int(ends_a[-1])
            mark = np.zeros((2, total + 1), bool)
            mark[0, ends_a] = mark[1, ends_b] = True
            last_a, last_b = np.flatnonzero(mark[1, ends_a]), np.flatnonzero(mark[0, ends_b])
            of_doc = np.searchsorted(last_a, edges_a)
            out["n_a"][some], out["n_b"][some] = np.diff(edges_a), np.diff(edges_b)
            out["n_groups"][some] = np.diff(of_doc)
            for i, x in zip(some.tolist(), self._digests(a, b, last_a, last_b, of_doc), strict=True):
                digests[i] = x
            one = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
            left, right = a[last_a].astype(np.int64), b[last_b].astype(np.int64)
            regular = one & (self.identity[left] == right)
            doc = np.repeat(some, np.diff(of_doc))
            lists["regular"] = _counted(doc[regular], left[regular])
            lists["pairs"] = _counted(doc[~regular], left[~regular] * PAIR + right[~regular])
        columns = {x: pa.array(v) for x, v in out.items()} | {"groups_sha256": pa.array(digests)}
        for name, (doc, keys, times) in lists.items():
            ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            columns[name] = pa.ListArray.from_arrays(ends, pa.array(keys))
            columns[f"{name}_n"] = pa.ListArray.from_arrays(ends, pa.array(times))
        return pa.table(columns)

    def _encoded(self, given: pa.Array):
        """Which texts both tokenizers give back byte by byte; of those, from either: the ids,
        the boundaries of texts in them, and the byte where each token ends."""
        data, bounds = tx.flat(given)
        good = np.ones(len(given), bool)
        found = []
        for encoder, entries in ((self.a, self.bytes_a), (self.b, self.bytes_b)):
            ids, edges = encoder.ids(given)
            long = np.concatenate([[0], np.cumsum(entries.size[ids])])[edges]
            good &= np.diff(long) == np.diff(bounds)
            found.append((ids, edges, entries))
        while True:
            kept = np.repeat(good, np.diff(bounds))
            own, out = data[kept], []
            size = np.diff(bounds)[good]
            wrong = np.zeros(len(size), bool)
            for ids, edges, entries in found:
                ids = ids[np.repeat(good, np.diff(edges))]
                joined, ends = entries.joined(ids)
                differs = tx.byte_sums(joined != own)
                at = np.concatenate([[0], np.cumsum(size)])
                wrong |= np.diff(differs[at]) > 0
                out.append((ids, np.concatenate([[0], np.cumsum(np.diff(edges)[good])]), ends))
            if not wrong.any():
                return good, *out
            good[np.flatnonzero(good)[wrong]] = False

    def _digests(self, a, b, last_a, last_b, of_doc) -> Iterator[str]:
        """Of each text the digest of its groups as ``a1,a2|b1;a3|b2,b3``."""
        every_a, every_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        before_a, before_b = last_a + 1 - every_a, last_b + 1 - every_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(before_b, every_a)] = a
        order[np.arange(len(b)) + np.repeat(last_a + 1, every_b)] = b
        written, ends = self.numbers.joined(order)
        written[ends[last_a + before_b] - 1] = ord("|")
        stops = ends[last_a + 1 + last_b]
        written[stops - 1] = ord(";")
        raw = written.tobytes()
        edges = np.concatenate([[0], stops])[of_doc].tolist()
        for start, stop in zip(edges, edges[1:], strict=False):
            yield hashlib.sha256(raw[start : stop - 1]).hexdigest()


def _counted(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key and number of every different key of a document, by both ascending."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], keys[first], np.diff(np.append(first, len(keys)))


def links(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``LINKS`` of every row: its groups, and its links as different ids or pairs with numbers.

    ``regular`` are ids of A linked as the identity map says; ``pairs`` are ``a * PAIR + b``.
    Texts that are null, empty, or not given back byte by byte by both have no tokens.
    Repeated rows are rows of their own.  Columns besides ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in tx.slices(batch):
                found = aligner.align(piece.column("text"))
                rows = pa.array(np.arange(row, row + piece.num_rows))
                row += piece.num_rows
                columns = {"row": rows, "doc_id": piece.column("doc_id")}
                columns |= {x: found.column(x).combine_chunks() for x in found.column_names}
                yield pa.RecordBatch.from_pydict(columns)

    return documents.select("doc_id", "text").mapInArrow(run, LINKS)


def regular_counts(linked: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, n``: how often every id of A is linked by the identity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity = Aligner.of(path_a, path_b).identity
        total = np.zeros(len(identity), np.int64)
        for batch in batches:
            ids, times = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, ids, times)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(identity[a]), pa.array(total[a])], ["a", "b", "n"]
        )

    found = linked.select("regular", "regular_n").mapInArrow(run, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, n``: how often every irregular pair is linked."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x"))
    return (
        each.select(F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("n"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


def frequent(pairs: DataFrame) -> DataFrame:
    """All pairs counted at least as often as the least power of two that leaves no more than
    ``MOST_LOOKED_UP`` of them."""
    level = F.floor(F.log2("n")).alias("level")
    by_level = {r["level"]: r["count"] for r in pairs.groupBy(level).count().collect()}
    least, total = 64, 0
    for step in sorted(by_level, reverse=True):
        total += by_level[step]
        if total > MOST_LOOKED_UP:
            break
        least = step
    return pairs.where(F.floor(F.log2("n")) >= least)


def alignment(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, n, best`` of every pair of ids linked anywhere in the corpus, with the number
    of its links, and whether no other id of A is linked with ``b`` more often."""
    linked = stored(links(documents, path_a, path_b))
    return _ranked(regular_counts(linked, path_a, path_b), stored(pair_counts(linked)))[0]


def _ranked(regular: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs with ``best``; and the highest count ``top`` of each id of B."""
    irregular = pairs.select(
        F.expr(f"pair div {PAIR}").alias("a"), (F.col("pair") % PAIR).alias("b"), "n"
    )
    every = regular.unionByName(irregular)
    # a row for each id of B at most
    top = stored(every.groupBy("b").agg(F.max("n").alias("top")))
    ranked = every.join(F.broadcast(top), "b")
    return ranked.select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), top


def scored(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``LINKS`` without its lists, with ``n_links``, ``n_best`` (links whose pair is counted
    as often as any with its id of B) and ``count_sum`` (of the links' pairs) of every row."""
    linked = stored(links(documents, path_a, path_b))
    regular = stored(regular_counts(linked, path_a, path_b))
    pairs = stored(pair_counts(linked))
    _, top = _ranked(regular, pairs)

    # bounded by the vocabularies and by MOST_LOOKED_UP
    by_a, by_b, common = (x.toArrow() for x in (regular, top, frequent(pairs)))
    keys, counts = (common.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    context = documents.sparkSession.sparkContext
    known = context.broadcast(
        [by_a.column(c).to_numpy() for c in ("a", "b", "n")]
        + [by_b.column(c).to_numpy() for c in ("b", "top")]
        + [keys[order].copy(), counts[order].copy()]
    )

    def place(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair stands among the frequent ones, and whether it is one."""
        common = known.value[5]
        if not len(common):
            return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(common, pair), len(common) - 1)
        return at, common[at] == pair

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n, best_b, top, common, often = known.value
        best = np.zeros(max(best_b.max(initial=0), b.max(initial=0)) + 1, np.int64)
        best[best_b] = top
        count, leads = np.zeros((2, a.max(initial=0) + 1), np.int64)
        count[a], leads[a] = n, n == best[b]
        for batch in batches:
            size = batch.num_rows
            out = np.zeros((3, size))
            for keys_name, times_name in (("regular", "regular_n"), ("pairs", "pairs_n")):
                lists = batch.column(keys_name)
                owner = pc.list_parent_indices(lists).to_numpy()
                keys, times = (batch.column(c).flatten().to_numpy() for c in (keys_name, times_name))
                if keys_name == "regular":
                    value, good = count[keys], leads[keys]
                else:
                    at, found = place(keys)
                    owner, keys, times, at = owner[found], keys[found], times[found], at[found]
                    value = often[at] if len(at) else np.zeros(0, np.int64)
                    good = value == best[keys % PAIR] if len(at) else value
                np.add.at(out[0], owner, times * good)
                # two parts below 2**53 each
                np.add.at(out[1], owner, times * (value & 0xFFFFFF))
                np.add.at(out[2], owner, times * (value >> 24))
            whole = out.astype(np.int64)
            columns = {c: batch.column(c) for c in OWN}
            columns |= {"n_best": pa.array(whole[0]), "count_sum": pa.array(whole[1] + (whole[2] << 24))}
            yield pa.RecordBatch.from_pydict(columns)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()[pc.list_parent_indices(batch.column("pairs")).to_numpy()]
            keys, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "pairs_n"))
            rare = ~place(keys)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[rare]) for x in (row, keys, times)], ["row", "pair", "times"]
            )

    rows = linked.mapInArrow(
        sums,
        "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "n_best long, count_sum long",
    )
    rare = linked.select("row", "pairs", "pairs_n").mapInArrow(rest, "row long, pair long, times long")
    led = pairs.withColumn("b", F.col("pair") % PAIR).join(F.broadcast(top), "b")
    more = (
        rare.join(led, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    return rows.join(more, "row", "left").select(
        *OWN,
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


OWN = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the two public vocabularies."""
    import public_tokenizers as files

    a, b = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
    return scored(table(spark, sf_dir, "documents"), a, b).drop("row")
