"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds whole documents in ascending ``doc_id`` order and at least
``SEGMENT_IDS`` ids (the last of a shard may hold fewer).  Its bytes, little-endian:

* ``magic`` 4 bytes ``PFR1``; ``n_documents``, ``n_ids``, ``n_blocks`` as uint32
* per document: ``doc_id`` int64; then a byte, 1 if the id is null; then ``n_tokens`` uint32
* per block: start of the block in the block area, uint32 (the block index)
* the block area.  A block of up to ``BLOCK`` ids is: minimum uint32, width uint8, number of
  exceptions uint8, the offsets from the minimum in ``width`` bits each (low bits first,
  padded to ``BLOCK`` of them), exception positions uint8, exceptions' higher bits uint32

The width is the smallest that holds ``PERCENTILE`` percent of a block's offsets; what does
not fit is patched from the exception list.  Any document can be read by decoding only the
blocks that hold it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm import text as tx
from scorecraft.llm.store import shared_folder, table
from scorecraft.llm.tokens import Encoder

MAGIC, BLOCK, PERCENTILE, SEGMENT_IDS = b"PFR1", 128, 90, 1 << 18
SCHEMA = "shard int, segment int, first_id long, n_ids long, payload binary"


def _widths(offsets: np.ndarray) -> np.ndarray:
    """Bits that each number takes; exact, as they are far below 2**53."""
    return np.frexp(offsets.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below ``2**width`` as rows of bytes; eight take ``width``."""
    eights = values.reshape(-1, 8)
    words = np.zeros((len(eights), -(-width // 8)), "<u8")
    for k in range(8):
        word, shift = divmod(k * width, 64)
        words[:, word] |= eights[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= eights[:, k] >> np.uint64(64 - shift)
    return words.view(np.uint8)[:, :width].reshape(len(values), -1)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    eights = rows.reshape(-1, width)
    raw = np.zeros((len(eights), -(-width // 8) * 8), np.uint8)
    raw[:, :width] = eights
    words = raw.view("<u8")
    out = np.empty((len(eights), 8), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        word, shift = divmod(k * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.reshape(len(rows), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The block index and the block area of an array of uint32 ids."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, "<u4"), b""
    padded = np.full(n_blocks * BLOCK, ids[-1], np.uint64)
    padded[: len(ids)] = ids
    grid = padded.reshape(n_blocks, BLOCK)
    least = grid.min(1)
    offsets = grid - least[:, None]
    bits = _widths(offsets)
    rank = -(-BLOCK * percentile // 100) - 1
    width = np.partition(bits, rank, 1)[:, rank]
    patched = bits > width[:, None]
    count = patched.sum(1)
    wide = width.astype(np.int64)
    sizes = 6 + BLOCK // 8 * wide + 5 * count
    index = np.cumsum(sizes) - sizes
    area = np.zeros(int(sizes.sum()), np.uint8)
    area[index[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    area[index + 4] = width
    area[index + 5] = count
    low = offsets & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    for w in np.unique(wide).tolist():
        if w:
            at = np.flatnonzero(wide == w)
            area[index[at, None] + 6 + np.arange(BLOCK // 8 * w)] = _pack(low[at], w)
    block, position = np.divmod(np.flatnonzero(patched), BLOCK)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    lists = index + 6 + BLOCK // 8 * wide
    high = (offsets[patched] >> width[block].astype(np.uint64)).astype("<u4")
    area[lists[block] + nth] = position
    into = (lists + count)[block][:, None] + 4 * nth[:, None] + np.arange(4)
    area[into] = high.view(np.uint8).reshape(-1, 4)
    return index.astype("<u4"), area.tobytes()


def decode_blocks(area: bytes, index: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive blocks; the last of them may be filled in part."""
    raw = np.frombuffer(area, np.uint8)
    n_blocks = len(index)
    at = index.astype(np.int64)
    head = raw[at[:, None] + np.arange(6)]
    least = head[:, :4].copy().view("<u4")[:, 0].astype(np.uint64)
    width, count = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((n_blocks, BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            some = np.flatnonzero(width == w)
            out[some] = _unpack(raw[at[some, None] + 6 + np.arange(BLOCK // 8 * w)], w)
    block = np.repeat(np.arange(n_blocks), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    lists = at + 6 + BLOCK // 8 * width
    position = raw[lists[block] + nth]
    high = raw[(lists + count)[block][:, None] + 4 * nth[:, None] + np.arange(4)]
    high = np.ascontiguousarray(high).view("<u4")[:, 0].astype(np.uint64)
    out[block, position] |= high << width[block].astype(np.uint64)
    return (out + least[:, None]).reshape(-1)[:n_ids].astype("<u4")


DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_tokens", "<u4")])


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    index, area = encode_blocks(ids)
    documents = np.zeros(len(doc_ids), DOCUMENT)
    documents["doc_id"] = [0 if d is None else d for d in doc_ids]
    documents["null"] = [d is None for d in doc_ids]
    documents["n_tokens"] = sizes
    head = MAGIC + struct.pack("<III", len(doc_ids), len(ids), len(index))
    return head + documents.tobytes() + index.tobytes() + area


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document table and all ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token blocks")
    n_documents, n_ids, n_blocks = struct.unpack_from("<III", payload, 4)
    documents = np.frombuffer(payload, DOCUMENT, n_documents, 16)
    begin = 16 + documents.nbytes
    index = np.frombuffer(payload, "<u4", n_blocks, begin)
    return documents, decode_blocks(payload[begin + index.nbytes :], index, n_ids)


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end: int = 0) -> None:
    """Write the ids of every whole text, ``end`` after each, in ascending ``doc_id`` order.

    Texts are range-partitioned and sorted by id (null first, ties by text), so shards
    follow each other; a task holds one segment at a time.  Spark's writer commits each
    shard once, whichever attempt of a task ends first.  Shard files are Parquet files of
    segments, their bytes left uncompressed.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(vocabulary), TaskContext.get().partitionId()
        doc_ids, sizes, ids, segment, first = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            every = np.concatenate(ids)
            payload = encode_segment(doc_ids, np.concatenate(sizes), every)
            cells = [[shard], [segment], [first], [len(every)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)],
                ["shard", "segment", "first_id", "n_ids", "payload"],
            )

        held = 0
        for batch in batches:
            for part in tx.slices(batch):
                found, edges = encoder.ids(part.column("text"), end)
                names = part.column("doc_id").to_pylist()
                begin = 0
                while begin < len(names):
                    # the fewest further documents that fill the segment
                    stop = int(np.searchsorted(edges, edges[begin] + SEGMENT_IDS - held))
                    stop = min(max(stop, begin + 1), len(names))
                    doc_ids += names[begin:stop]
                    sizes.append(np.diff(edges[begin : stop + 1]))
                    ids.append(found[edges[begin] : edges[stop]])
                    held += len(ids[-1])
                    begin = stop
                    if held >= SEGMENT_IDS:
                        yield row()
                        first += held
                        doc_ids, sizes, ids, segment, held = [], [], [], segment + 1, 0
        if doc_ids:
            yield row()

    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = (
        documents.select("doc_id", "text")
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
    )
    ordered.mapInArrow(segments, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards alone.

    ``start`` counts the ids of all documents before: those of earlier shards, summed over
    one row per shard, of earlier segments, and of earlier documents of the segment.
    """
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start")
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(
                batch.column("start").to_pylist(), batch.column("payload"), strict=True
            ):
                found, ids = decode_segment(payload.as_py())
                sizes = found["n_tokens"].astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.tobytes()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(4 * edges, 4 * edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found["doc_id"].astype(np.int64), mask=found["null"] == 1),
                        pa.array(start + edges[:-1]),
                        pa.array(sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(offsets, "shard").select(
        (F.col("shard_start") + F.col("first_id")).alias("start"), "payload"
    )
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the written shards."""
    import public_tokenizers

    path = shared_folder(spark)
    write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_tokens(spark, path)
