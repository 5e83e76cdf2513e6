"""Packing of documents into token sequences by cutting-stock column generation.

1. Every document is encoded and cut into whole sequences of ``length`` ids and one rest.
2. The histogram of rests over size classes (exact up to a sixteenth of the length, then in
   steps that grow with the size, so at most some 500 of them at any input) goes to the driver.
3. A linear program over cutting patterns is solved there by column generation: knapsack
   dynamic programming prices new columns against the dual values, until the bound shows that
   no better patterns matter. Patterns are rounded down; what is left is packed first-fit.
4. Each rest is ranked in its class, in salted cells so that no class lands in one task, and
   the rank picks its pattern, sequence and place there.

Cases: a null text is the empty one (its only id is the end id); repeated rows are packed as
often as they occur; null doc_ids are kept; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, spread, whole_text
from .words import encoder

SEQUENCE = 4096
CELL_ROWS = 50_000

log = logging.getLogger(__name__)


def size_classes(length: int) -> list[int]:
    """Ascending upper bounds of the classes; the last is length - 1 or more."""
    bounds, at, step = list(range(1, length // 16 + 1)), max(1, length // 16), 1
    while at < length - 1:
        if at >= (length // 16) * step * 2:
            step *= 2
        at += step * 4 if length >= 1024 else 1
        bounds.append(min(at, length))
    return bounds


def _best_pattern(sizes: np.ndarray, values: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable fill of cap, by doubling copies of each size."""
    best = np.zeros(cap + 1)
    steps = []
    for k in np.argsort(-values / sizes, kind="stable"):
        s, v = int(sizes[k]), float(values[k])
        if v <= 1e-12:
            break
        copies = 1
        while s * copies <= cap:
            taken = best[: cap + 1 - s * copies] + v * copies
            won = taken > best[s * copies :] + 1e-12
            if not won.any():
                break
            best[s * copies :][won] = taken[won]
            steps.append((int(k), copies, np.packbits(won)))
            copies *= 2
    pattern, at = np.zeros(len(sizes), np.int64), cap
    for k, copies, won in reversed(steps):
        place = at - int(sizes[k]) * copies
        if place >= 0 and np.unpackbits(won, count=cap + 1 - int(sizes[k]) * copies)[place]:
            pattern[k] += copies
            at = place
    return float(values @ pattern), pattern


def _first_fit(sizes: np.ndarray, demand: np.ndarray, cap: int) -> list[tuple[int, np.ndarray]]:
    """Greedy patterns, largest sizes first, each used as often as the demand allows."""
    left, found = demand.copy(), []
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), cap
        for k in order:
            if left[k] and sizes[k] <= room:
                pattern[k] = min(int(left[k]), room // int(sizes[k]))
                room -= int(pattern[k] * sizes[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        found.append((times, pattern))
    return found


def _inverse(basis: np.ndarray) -> np.ndarray | None:
    """The inverse by eliminations with row exchanges, None where it is not sound.

    Whole-array steps only: a threaded linear-algebra library in the driver would contend with
    the JVM beside it for the same cores.
    """
    m = len(basis)
    both = np.concatenate([basis, np.eye(m)], axis=1)
    for k in range(m):
        at = k + int(np.abs(both[k:, k]).argmax())
        if abs(both[at, k]) < 1e-9:
            return None
        if at != k:
            both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        rows = np.flatnonzero(both[:, k])
        rows = rows[rows != k]
        both[rows] -= both[rows, k, None] * both[k]
    found = both[:, m:]
    return found if np.abs(np.einsum("ij,j->i", basis, found.sum(axis=1)) - 1).max() < 1e-6 else None


def plan(histogram: dict[int, int], cap: int, gap: float = 0.002, rounds: int = 100) -> list[tuple[int, dict[int, int]]]:
    """Patterns (copies, {size: pieces}) that cut exactly the pieces of the histogram.

    The linear program ends when no pattern is worth more than 1 + gap, after ``rounds`` priced
    patterns, or after 12 turns a class: what its basis then holds is rounded and the rest is
    packed first-fit, so every piece has its place either way, and the log says what was reached.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    m = len(sizes)
    first = [p for _, p in _first_fit(sizes, demand, cap)]
    pool = np.zeros((len(first) + rounds, m))  # patterns that may enter, those in use among them
    pool[: len(first)] = first
    n_pool, priced, reached = len(first), 0, "the bound"
    basis = np.diag(cap // sizes).astype(float)
    inverse, amounts = np.diag(1.0 / (cap // sizes)), demand / (cap // sizes)
    kept = basis.copy(), inverse.copy()
    for turn in range(12 * m + 400):
        dual = inverse.sum(axis=0)
        if turn % 32 == 31:
            # what rounding has done to the inverse shows in the two sides of the program
            drift = max(np.abs(np.einsum("ij,j->i", basis, amounts) / demand - 1).max(), np.abs(np.einsum("i,ij->j", dual, basis) - 1).max())
            if drift > 1e-7:
                sound = _inverse(basis)
                if sound is None:  # too near to singular: go back to the last sound basis
                    (basis, inverse), reached = kept, "a singular basis"
                    break
                inverse, amounts = sound, np.maximum(np.einsum("ij,j->i", sound, demand), 0)
                kept, dual = (basis.copy(), inverse.copy()), inverse.sum(axis=0)
        worth = np.einsum("ij,j->i", pool[:n_pool], dual)
        k = int(worth.argmax())
        if worth[k] > 1 + 1e-6:
            column = pool[k]
        else:
            if priced == rounds:
                reached = f"{rounds} priced patterns"
                break
            priced += 1
            value, column = _best_pattern(sizes, np.maximum(dual, 0), cap)
            if value <= 1 + gap:  # the bound: no plan is shorter by more than this share
                break
            pool[n_pool] = column
            n_pool += 1
        used = np.flatnonzero(column)
        turned = np.einsum("ij,j->i", inverse[:, used], column[used].astype(float))
        able = turned > 1e-7
        if not able.any():
            reached = "no pattern that can leave"
            break
        ratio = np.full(m, np.inf)
        ratio[able] = amounts[able] / turned[able]
        out = int(ratio.argmin())
        amounts = np.maximum(amounts - ratio[out] * turned, 0)
        amounts[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / turned[out]
        touched = np.flatnonzero(turned)
        inverse[touched] -= turned[touched, None] * pivot
        inverse[out] = pivot
    else:
        reached = f"{12 * m + 400} turns"
    sound = _inverse(basis)
    basis, inverse = kept if sound is None else (basis, sound)
    amounts = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    log.info("cutting-stock plan of %d classes ended at %s after %d turns and %d priced patterns", m, reached, turn + 1, priced)
    patterns, left = [], demand.copy()
    for k in np.argsort(-amounts, kind="stable"):
        p = np.rint(basis[:, k]).astype(np.int64)
        used = p > 0
        times = min(int(amounts[k] + 1e-9), int((left[used] // p[used]).min()))
        if times > 0:
            patterns.append((times, p))
            left -= times * p
    patterns += _first_fit(sizes, left, cap)
    return [(n, {int(s): int(a) for s, a in zip(sizes, p) if a}) for n, p in patterns]


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _cut(tokenizer: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = encoder(tokenizer).encode(batch.column("text"), end_id)
            pieces = -(-n // length)
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * length
            size = np.minimum(length, n[doc] - start)
            # pieces follow one another in the flat ids as they do here
            ends = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(n[doc].astype(np.int64)), parts],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, ids (little-endian, 32 bits)."""
    rows = spread(whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return rows.mapInArrow(_cut(tokenizer, end_id, length), PIECES)


def place(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """pieces (with a column length) placed: all their columns, sequence_id and offset.

    pieces is read more than once; give one that is stored.
    """
    spark = pieces.sparkSession
    bounds = size_classes(length)
    steps = F.array(*[F.lit(b) for b in bounds])
    n_rows = pieces.count()
    cells = max(16, -(-n_rows // CELL_ROWS))
    # the class is the first bound that is not below the length, found by position for short ones
    exact = length // 16
    later = F.element_at(F.filter(F.slice(steps, exact + 1, len(bounds)), lambda b: b >= F.col("length")), 1)
    kind = F.when(F.col("length") >= length, F.lit(length)).when(F.col("length") <= exact, F.col("length")).otherwise(F.coalesce(later, F.lit(length))).cast("int")
    others = [c for c in pieces.columns if c in ("doc_id", "start", "length", "crc32")]
    rows = pieces.withColumn("kind", kind).withColumn("cell", F.pmod(F.xxhash64(*others), F.lit(cells)).cast("int"))
    counts = rows.groupBy("kind", "cell").agg(F.count("*").alias("n"))
    counts = durable(counts, "cells")
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple]] = {}
    taken = dict.fromkeys(totals, 0)
    first = 0
    whole = totals.pop(length, 0)  # pieces that fill a sequence alone
    for times, pattern in [*([(whole, {length: 1})] if whole else []), *plan(totals, length)]:
        for size, each in pattern.items():
            lo = taken[size]
            slots.setdefault(size, []).append((lo, lo + times * each, each, first))
            taken[size] = lo + times * each
        first += times
    plan_rows = [(k, v) for k, v in slots.items()]  # at most one row a class
    plan_df = spark.createDataFrame(plan_rows, "kind int, slots array<struct<lo:long,hi:long,each:long,first:long>>")
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cell_base = counts.select("kind", "cell", F.coalesce(before, F.lit(0)).alias("base"))
    in_cell = F.row_number().over(Window.partitionBy("kind", "cell").orderBy(*others)) - 1
    ranked = rows.withColumn("in_cell", in_cell).join(cell_base, ["kind", "cell"]).withColumn("rank", F.col("base") + F.col("in_cell"))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.join(F.broadcast(plan_df), "kind").withColumn("slot", slot)
    placed = placed.withColumn("sequence_id", F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """Whole packing of docs: doc_id, start, length, doc_tokens, crc32, sequence_id, offset and, if asked, ids."""
    pieces = cut_documents(docs, tokenizer, end_id, length).withColumn("crc32", F.crc32("ids"))
    if not keep_ids:
        return place(durable(pieces.drop("ids"), "pieces"), length)
    # ids move once, to the placed pieces, and not through the windows
    pieces = durable(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces.drop("ids"), length).hint("shuffle_hash")
    return pieces.select("piece", "ids").join(placed, "piece").select("doc_id", "start", "length", "doc_tokens", "ids", "crc32", "sequence_id", "offset")
