"""Token ids as bit-plane files.

A file holds a run of ids in fixed-size blocks. Each block is transposed into bit planes (or
byte planes), each plane is compressed with zstandard, and an index at the end of the file
gives the place of every block, so a reader can decode any range of ids alone.

``write_tokens`` encodes documents and stores such files, in ascending order of doc_id, one
to a row of a parquet table: Spark's committed writer then works on every store and after
lost executors. ``read_tokens`` reads them back to one row a document.

Cases: a null text is the empty one and has only the end id; null doc_ids come first; rows
with equal doc_id are ordered by a hash of their text, equal rows stay separate rows; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole_text
from .words import encoder

MAGIC = b"IDPLANE1"
_HEAD = struct.Struct("<8sBBIQ")  # magic, planes a block are bits (1) or bytes (8), level, ids a block, ids
_TAIL = struct.Struct("<QI8s")  # place of the index, blocks, magic
BLOCK = 65_536
FILE_IDS = 1 << 20


def pack(ids: np.ndarray, block: int = BLOCK, plane_bits: int = 1, level: int = 3) -> bytes:
    """One file's bytes for unsigned 32-bit ids. plane_bits: 1 for bit planes, 8 for byte planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    press = zstandard.ZstdCompressor(level=level).compress
    out, index, at = [_HEAD.pack(MAGIC, plane_bits, level, block, len(ids))], [], _HEAD.size
    for k in range(0, len(ids), block):
        own = ids[k : k + block]
        width = int(own.max()).bit_length()
        if plane_bits == 8:
            octets = own.view(np.uint8).reshape(-1, 4)
            planes = [press(np.ascontiguousarray(octets[:, b]).tobytes()) for b in range(-(-width // 8))]
        else:
            planes = [press(np.packbits((own >> np.uint32(b)) & np.uint32(1) != 0).tobytes()) for b in range(width)]
        index.append(struct.pack(f"<QIB{len(planes)}I", at, len(own), len(planes), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    return b"".join([*out, *index, _TAIL.pack(at, len(index), MAGIC)])


def blocks(data: bytes) -> list[tuple[int, int, list[int]]]:
    """The chunk index: each block's place, number of ids and sizes of planes."""
    at, n, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if magic != MAGIC or data[:8] != MAGIC:
        raise ValueError("not a bit-plane file")
    found = []
    for _ in range(n):
        place, count, planes = struct.unpack_from("<QIB", data, at)
        sizes = list(struct.unpack_from(f"<{planes}I", data, at + 13))
        found.append((place, count, sizes))
        at += 13 + 4 * planes
    return found


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a file; only the blocks that hold them are decompressed."""
    _, plane_bits, _, block, total = _HEAD.unpack_from(data)
    index = blocks(data)
    stop = total if stop is None else min(stop, total)
    start = max(0, start)
    if start >= stop:
        return np.empty(0, "<u4")
    loosen = zstandard.ZstdDecompressor().decompress
    parts, first = [], start // block
    for place, count, sizes in index[first : (stop - 1) // block + 1]:
        ids = np.zeros(count, np.uint32)
        for b, n in enumerate(sizes):
            plane = np.frombuffer(loosen(data[place : place + n]), np.uint8)
            if plane_bits == 1:
                plane = np.unpackbits(plane, count=count)
            ids |= plane.astype(np.uint32) << np.uint32(b * plane_bits)
            place += n
        parts.append(ids)
    return np.concatenate(parts)[start - first * block : stop - first * block]


FILE_SCHEMA = "part int, part_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _files(tokenizer: str, end_id: int, file_ids: int, block: int, plane_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        kept: list = [[], [], []]
        held = 0

        def file() -> pa.RecordBatch:
            nonlocal done, held
            ids = np.concatenate(kept[2])
            row = [[part], [done], [len(ids)], [kept[0].copy()], [kept[1].copy()], [pack(ids, block, plane_bits)]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            done, held = done + len(ids), 0
            for x in kept:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "part_start", "n_ids", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            ids, n = encoder(tokenizer).encode(batch.column("text"), end_id)
            upto = np.concatenate([[0], np.cumsum(n)])
            doc_ids, first = batch.column("doc_id").to_pylist(), 0
            while first < len(n):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + file_ids - held, "right")) - 1)
                kept[0] += doc_ids[first:last]
                kept[1] += n[first:last].tolist()
                kept[2].append(ids[upto[first] : upto[last]])
                held, first = held + int(upto[last] - upto[first]), last
                if held >= file_ids * 15 // 16:
                    yield file()
        if kept[0]:
            yield file()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS, block: int = BLOCK, plane_bits: int = 1) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write the files in order of doc_id.

    One range shuffle puts the texts in order; a file ends at a document's end once it is
    nearly full, so memory is bounded by a file and the longest document.
    """
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = ordered.mapInArrow(_files(tokenizer, end_id, file_ids, block, plane_bits), FILE_SCHEMA)
    files.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            base, doc_ids, n, payload = (batch.column(c)[k].as_py() for c in ("start", "doc_ids", "doc_tokens", "payload"))
            ids = unpack(payload).astype("<u4").tobytes()
            upto = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
            parts = [ids[4 * a : 4 * b] for a, b in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base + upto[:-1]), pa.array(np.diff(upto)), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    The starts of the parts come from one row a write task; that table is as small as the
    number of tasks and is broadcast.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "doc_ids", "doc_tokens", "payload")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")
