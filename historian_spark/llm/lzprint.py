"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of an incremental dictionary: each new phrase is the longest
known one and the next character. The set of phrase hashes is summed up by one minimum in each
of 64 bins; empty bins borrow from the next filled one. Two fingerprints are as alike as the
share of bins in which they agree, as texts are that a common dictionary would compress.

``fingerprints`` deals documents by ranges of doc_id, of some ``PART_BYTES`` each, so that after
one shuffle a task walks neighbours. The last document of a range meets the first one of the
next in a second, small step: what a range keeps for that is these two texts. The loop over code
points only finds the phrases; those of a slice of texts are hashed and summed up together.

Cases: a null text is the empty one, whose fingerprint is empty; two empty fingerprints are
alike (1), an empty and another are not (0); the parse goes over code points of the whole text
and holds its phrases, some n / log n of n code points at 200 bytes each; null doc_ids come
first; rows of equal doc_id are ordered by a hash of their text and may be dealt to several
ranges, repeated rows too; a lone document is its own successor; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slices, whole_text

BINS = 64
PART_BYTES = 16 << 20
SLICE_BYTES = 256 << 10  # of texts whose phrases are hashed together
_M = (1 << 64) - 1
_U = np.uint64


def _bits(text: str) -> int:
    """Bits that hold any of a text's code points."""
    return 7 if text.isascii() else int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()).bit_length()


def _parse(phrases: dict[int, int], node: int, text: str, bits: int) -> int:
    """Carries a parse on over a text, from a node to the node that is returned.

    A phrase's key is its parent's node and its last code point in the low bits, its node is its
    number (from 1) above these bits; the root is 0. Phrases stay in order of their numbers.
    """
    get, new, step = phrases.get, len(phrases) + 1 << bits, 1 << bits
    for c in text.encode("latin-1") if bits <= 8 else map(ord, text):
        key = node + c
        node = get(key)
        if node is None:
            phrases[key] = new
            new += step
            node = 0
    return node


def _hashes(parents: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hashes of phrases, each from its parent's and its last code point; parents stand before, roots have -1."""
    n = len(parents)
    ahead = np.append(np.where(parents < 0, n, parents), n)
    depth = np.append(np.ones(n, np.int64), 0)
    while (ahead != n).any():  # each round doubles the way to an ancestor
        depth, ahead = depth + depth[ahead], ahead[ahead]
    depth = depth[:n]
    counts = np.bincount(depth)
    order = np.argsort(depth.astype(np.uint16) if len(counts) < 1 << 16 else depth, kind="stable")
    hashes = np.append(np.zeros(n, np.uint64), _U(0x9E3779B97F4A7C15))  # the last one is the root's
    at = 0
    for size in counts[1:].tolist():
        own = order[at : at + size]
        hashes[own] = (hashes[parents[own]] ^ signs[own]) * _U(0x100000001B3) + _U(0x632BE59BD9B4E019)
        at += size
    return hashes[:n]


def _least(hashes: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The least mixed hash in every bin of each part."""
    h = (hashes ^ (hashes >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    least = np.full(parts * BINS, _M, np.uint64)
    np.minimum.at(least, part * BINS + (h >> _U(58)).astype(np.int64), h & _U((1 << 58) - 1))
    return least.reshape(parts, BINS)


def _values(least: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of least hashes, as numbers; -1 throughout those that are empty."""
    filled = least != _M
    # an empty bin takes the value of the next filled one, marked by its distance
    at = np.where(np.tile(filled, 2), np.arange(2 * BINS), 2 * BINS)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    far = (at - np.arange(BINS)).astype(np.uint64)
    kept = (np.take_along_axis(least, at % BINS, axis=1) + far * _U(0xD1B54A32D192ED03)) & _U(0xFFFF)
    return np.where(filled.any(axis=1)[:, None], kept.astype(np.int64), -1)


def _text(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex() if values[0] >= 0 else ""


def prints(texts: list[str], following: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the fingerprints of texts, and of the texts as edited with those that follow them.

    A text and its edited one share the phrases of the first half, which is parsed once. The
    phrases of all texts are hashed together.
    """
    parents, signs, sizes, before = [], [], [], 0
    for text, after in zip(texts, following):
        half = len(text) // 2
        begin, end, other = text[: len(text) - half], text[len(text) - half :], after[:half]
        bits = max(_bits(text), _bits(other))
        phrases: dict[int, int] = {}
        node = _parse(phrases, 0, begin, bits)
        shared, changed = len(phrases), phrases.copy()
        _parse(phrases, node, end, bits)
        _parse(changed, node, other, bits)
        n, more = len(phrases), len(changed) - shared
        keys = np.concatenate([np.fromiter(phrases, np.int64, n), np.fromiter(itertools.islice(changed, shared, None), np.int64, more)])
        up = (keys >> bits) - 1
        up[n:] += np.where(up[n:] >= shared, n - shared, 0)  # the edited text's own phrases come behind all others
        parents.append(np.where(up < 0, -1, up + before))
        signs.append((keys & (1 << bits) - 1).astype(np.uint64))
        sizes += [shared, n - shared, more]
        before += n + more
    hashes = _hashes(np.concatenate(parents), np.concatenate(signs))
    begin, end, other = _least(hashes, np.repeat(np.arange(len(sizes)), sizes), len(sizes)).reshape(-1, 3, BINS).swapaxes(0, 1)
    return _values(np.minimum(begin, end)), _values(np.minimum(begin, other))


def fingerprint(text: str) -> str:
    return _text(prints([text], [""])[0][0])


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Of each range the texts at its ends: part is null in other rows.
ENDS = "part long, first_text string, first_print string, last_id long, last_text string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    named = [c.split() for c in columns.split(", ")]
    data = zip(*rows) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for x, (_, k) in zip(data, named)], [n for n, _ in named])


def _rows(docs: list[tuple[int | None, str]], following: list[str]) -> tuple[list[tuple], np.ndarray]:
    """COLUMNS of documents but for near_next, and the values of their fingerprints."""
    own, changed = prints([text for _, text in docs], following)
    digests = [hashlib.sha256(edited(text, after).encode("utf-8", "surrogatepass")).hexdigest() for (_, text), after in zip(docs, following)]
    near = (own == changed).mean(axis=1).tolist()
    return [(doc_id, len(text), digest, _text(x), _text(y), z) for (doc_id, text), digest, x, y, z in zip(docs, digests, own, changed, near)], own


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order: all but the last one are done; the ends of the range come last."""
    held = first = waiting = None  # held: the last row so far, not parsed yet; waiting: the row before, which lacks near_next, with its values
    no_ends, no_row = (None,) * 5, (None,) * 7
    for batch in batches:
        for at, texts in slices(batch.column("text"), SLICE_BYTES):
            docs = list(zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), texts.to_pylist()))
            if held is not None:
                docs.insert(0, held)
            held = docs.pop()
            if not docs:
                continue
            rows, values = _rows(docs, [text for _, text in docs[1:]] + [held[1]])
            if waiting is None:
                first = docs[0][1], rows[0][3]
            else:
                rows.insert(0, waiting[0])
                values = np.concatenate([waiting[1], values])
            waiting = rows.pop(), values[-1:]
            near = (values[:-1] == values[1:]).mean(axis=1).tolist()
            yield _batch([(*row, x, *no_ends) for row, x in zip(rows, near)], f"{COLUMNS}, {ENDS}")
    if held is not None:
        own, _ = prints([held[1]], [""])
        rows = [] if waiting is None else [(*waiting[0], float((waiting[1] == own).mean()), *no_ends)]
        rows.append((*no_row, TaskContext.get().partitionId(), *(first or (held[1], _text(own[0]))), *held))
        yield _batch(rows, f"{COLUMNS}, {ENDS}")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges, each with the first text of the next range."""
    for batch in batches:
        for doc_id, text, following, next_print in zip(*(batch.column(c) for c in ("last_id", "last_text", "next_text", "next_print"))):
            (row,), _ = _rows([(doc_id.as_py(), text.as_py())], [following.as_py()])
            yield _batch([(*row, likeness(row[3], next_print.as_py()))], COLUMNS)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """COLUMNS for every row of docs; parts: into how many ranges they are dealt, by default of PART_BYTES each."""
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # equal rows may stand in any order, so their places in the table split them
    placed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = durable(ordered.mapInArrow(_walk, f"{COLUMNS}, {ENDS}"), "walked")
    ends = walked.where("part is not null").select(*[c.split()[0] for c in ENDS.split(", ")])
    # a number a range; the last range is followed by the first
    numbers = ends.select("part").withColumn("to", F.lead("part").over(Window.orderBy("part")))
    least = ends.agg(F.min("part").alias("least"))
    numbers = numbers.crossJoin(F.broadcast(least)).select("part", F.coalesce("to", "least").alias("to"))  # least is one row
    after = ends.select(F.col("part").alias("to"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    closed = ends.join(numbers, "part").join(after, "to").select("last_id", "last_text", "next_text", "next_print").mapInArrow(_close, COLUMNS)
    done = walked.where("part is null").select(*[c.split()[0] for c in COLUMNS.split(", ")])
    return done.unionByName(closed)
