"""Vector bin packing of token sequences under several limits at once.

Every sequence has room for tokens, segments and loss-bearing tokens.  What a document has
beyond whole sequences is placed by the dot-product heuristic: an open sequence takes, again
and again, the piece that fits in all limits and whose demand has the largest dot product
with the room left (both as shares of the limits).  Then the emptiest sequences are cut up
to fill the gaps of the others, and what is left over goes on to the next lot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import text as tx
from scorecraft.llm.store import table
from scorecraft.llm.tokens import Encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


@dataclass
class Piece:
    """``length`` ids of document ``key`` from ``start``; ``loss`` of them bear loss."""

    key: int
    start: int
    length: int
    loss: int

    def split(self, length: int) -> tuple[Piece, Piece]:
        """Two pieces, the first of ``length`` ids; loss is shared in proportion.

        Exact where all ids bear loss or none does; else a bound is kept by rounding up
        the first part, and the rest goes with the second.
        """
        loss = -(-self.loss * length // self.length)
        return (
            Piece(self.key, self.start, length, loss),
            Piece(self.key, self.start + length, self.length - length, self.loss - loss),
        )


@dataclass
class Sequence:
    pieces: list[Piece] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.tokens += piece.length
        self.loss += piece.loss

    def room(self, limits: Limits) -> int:
        """Tokens that a further piece may have here, if all of them bear loss."""
        if len(self.pieces) >= limits.segments:
            return 0
        return min(limits.tokens - self.tokens, limits.loss_tokens - self.loss)


def place(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """Sequences by the dot-product heuristic; every piece must fit in an empty one."""
    demand = np.array([[p.length, 1, p.loss] for p in pieces], float).reshape(-1, 3)
    limit = np.array([limits.tokens, limits.segments, max(limits.loss_tokens, 1)], float)
    order = np.argsort(-demand[:, 0], kind="stable")
    demand, share = demand[order], demand[order] / limit
    left = np.ones(len(pieces), bool)
    out = []
    while left.any():
        # compact now and then, so that a step looks at open pieces only
        kept = np.flatnonzero(left)
        demand, share, order = demand[kept], share[kept], order[kept]
        left = np.ones(len(kept), bool)
        for _ in range(max(16, len(kept) // 32)):
            if not left.any():
                break
            room, sequence = limit.copy(), Sequence()
            while True:
                fits = left & (demand <= room).all(1)
                if not fits.any():
                    break
                best = int(np.argmax(np.where(fits, share @ (room / limit), -1.0)))
                left[best] = False
                room = room - demand[best]
                sequence.add(pieces[order[best]])
            out.append(sequence)
    return out


def fill_gaps(sequences: list[Sequence], limits: Limits) -> tuple[list[Sequence], list[Piece]]:
    """Cut the emptiest sequences up to fill the others; returns those and what is left."""
    order = sorted(sequences, key=lambda s: -s.tokens)
    spare: list[Piece] = []
    done = 0
    while done < len(order):
        sequence = order[done]
        while (gap := sequence.room(limits)) > 0:
            if not spare:
                if len(order) - 1 <= done:
                    break
                spare = order.pop().pieces
                continue
            piece = spare.pop()
            if piece.length > gap:
                piece, rest = piece.split(gap)
                spare.append(rest)
            sequence.add(piece)
        done += 1
    open_ = [s for s in order if s.tokens < limits.tokens and s.room(limits) > 0]
    closed = [s for s in order if not (s.tokens < limits.tokens and s.room(limits) > 0)]
    return closed, spare + [p for s in open_ for p in s.pieces]


def power_lengths(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """The last pieces of a task in sequences whose lengths are powers of two: no padding."""
    out, rest = [], list(pieces)
    while rest:
        total = sum(p.length for p in rest)
        size = min(1 << (total.bit_length() - 1), 1 << (limits.tokens.bit_length() - 1))
        sequence = Sequence()
        while sequence.tokens < size and rest and len(sequence.pieces) < limits.segments:
            piece = rest.pop(0)
            gap = min(size - sequence.tokens, max(1, limits.loss_tokens - sequence.loss))
            if piece.length > gap:
                piece, more = piece.split(gap)
                rest.insert(0, more)
            sequence.add(piece)
            if sequence.loss >= limits.loss_tokens:
                break
        out.append(sequence)
    return out


class Packer:
    """Packs the documents of one task, ``lot`` leftover pieces at a time."""

    def __init__(self, limits: Limits, lot: int = 1024):
        self.limits, self.lot = limits, lot
        self.waiting: list[Piece] = []
        self.most = min(limits.tokens, limits.loss_tokens)

    def add(self, key: int, length: int, loss: int) -> Iterator[Sequence]:
        """Take a document; yields the sequences that are now closed."""
        rest = Piece(key, 0, length, loss)
        while rest.length:
            part, rest = rest.split(min(rest.length, self.most))
            if part.length == self.limits.tokens:
                yield Sequence([part], part.length, part.loss)
            else:
                self.waiting.append(part)
        if len(self.waiting) >= self.lot:
            yield from self._pack()

    def _pack(self) -> Iterator[Sequence]:
        closed, self.waiting = fill_gaps(place(self.waiting, self.limits), self.limits)
        yield from closed

    def finish(self) -> Iterator[Sequence]:
        if self.waiting:
            yield from self._pack()
        yield from power_lengths(self.waiting, self.limits)
        self.waiting = []


PIECES = (
    "doc_id long, start long, length long, loss_tokens long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def pack(
    documents: DataFrame, vocabulary: str, end: int = 1, limits: Limits | None = None
) -> DataFrame:
    """The pieces of all documents with their places in sequences, and their ids.

    ``ids`` are little-endian uint32; ``doc_tokens`` counts the document's ids with ``end``.
    All ids of a document bear loss, unless it has a column ``loss_tokens`` (null: none).
    A null text counts as empty and is packed as its end id alone; repeated rows and null
    ids are packed as documents of their own.

    One map without a shuffle: each task packs the documents it reads, in their order, and
    holds one lot of leftover pieces.  Sequence ids are the partition and a counter, so a
    repeated task gives the same rows.  A task pads nothing but sequences that are full in
    another limit; its last pieces go to sequences whose lengths are powers of two.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(vocabulary), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # key: doc_id, ids, ids not yet placed
        rows: list[tuple] = []
        key = n_sequences = 0

        def put(sequence: Sequence) -> None:
            nonlocal n_sequences
            offset = 0
            for p in sequence.pieces:
                document = held[p.key]
                raw = document[1][p.start : p.start + p.length].tobytes()
                name, total = document[0], len(document[1])
                rows.append(
                    (name, p.start, p.length, p.loss, total, base + n_sequences, offset, raw)
                )
                offset += p.length
                document[2] -= p.length
                if not document[2]:
                    del held[p.key]
            n_sequences += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [c.split()[0] for c in PIECES.split(", ")],
            )

        for batch in batches:
            for part in tx.slices(batch):
                found, edges = encoder.ids(part.column("text"), end)
                names = part.column("doc_id").to_pylist()
                losses = part.column("loss_tokens").to_pylist()
                for i, name in enumerate(names):
                    ids = found[edges[i] : edges[i + 1]]
                    loss = min(max(losses[i], 0), len(ids))
                    held[key] = [name, ids, len(ids)]
                    for sequence in packer.add(key, len(ids), loss):
                        put(sequence)
                    key += 1
                # what still waits must not keep the whole slice in memory
                for document in held.values():
                    document[1] = document[1].copy() if document[1].base is not None else document[1]
                if rows:
                    yield flush()
        for sequence in packer.finish():
            put(sequence)
        if rows:
            yield flush()

    if "loss_tokens" in documents.columns:
        loss = F.coalesce(F.col("loss_tokens").cast("long"), F.lit(0))
    else:
        loss = F.lit(1 << 62)
    return documents.select("doc_id", "text", loss.alias("loss_tokens")).mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary))
