"""Byte-level BPE encoding and decoding by folding ranked merges over distinct words.

A text is cut into words by the tokenizer's pattern. A word is the array of its bytes; the fold
merges, at every step, the neighbouring pair whose bytes have the lowest rank, until no pair
has one. Decoding joins the binary pieces of the ids.

``fold_words`` is the fold in Spark's higher-order functions, with the ranks as a literal of
the plan. To put the ids of words back in their places in whole texts it would have to join
every word of every text, which moves more than the texts themselves; ``encode`` therefore
does the same fold beside the texts, for each distinct word that a worker meets, with a bounded
table of words, and moves nothing.

Cases: a null or empty text has no ids and decodes to no bytes; null words have no ids; lone
surrogates cannot occur in Spark strings; a word of n bytes takes n log n steps, however long it
is, and a text is held whole by the worker that encodes it; repeated rows and null ids give rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text

KNOWN_WORDS, KNOWN_LENGTH = 300_000, 256  # of the words that a worker remembers
SLICE_BYTES, SLICE_IDS = 4 << 20, 1 << 18  # of texts and of ids that a worker handles at once
SHORT = 64  # bytes of a word that is folded without a heap
_BUCKETS = 16_384


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the pair of least rank is merged first, the leftmost of equal ones.

    Pieces are the places where they begin. In a short word the least rank is looked for among
    all; in a longer one a heap holds the ranks of neighbours, and an entry that a merge has
    overtaken is passed over, so n bytes take n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n, get = len(word), ranks.get
    if n <= SHORT:
        none, at = len(ranks), list(range(n + 1))
        order = [get(word[k : k + 2], none) for k in range(n - 1)]
        while order and (least := min(order)) != none:
            k = order.index(least)
            del at[k + 1], order[k]
            if k < len(order):
                order[k] = get(word[at[k] : at[k + 2]], none)
            if k:
                order[k - 1] = get(word[at[k - 1] : at[k + 1]], none)
        return [ranks[word[a:b]] for a, b in zip(at, at[1:])]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(word[k : k + 2]) for k in range(n - 1)] + [None]
    heap = [(r, k) for k, r in enumerate(pair) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        if pair[k] != r:
            continue
        pair[end[k]] = None
        end[k] = stop = end[end[k]]
        if stop < n:
            before[stop] = k
        for at, to in ((k, end[stop] if stop < n else 0), (before[k], stop)):
            if at >= 0:
                pair[at] = r = get(word[at:to]) if to else None
                if r is not None:
                    heapq.heappush(heap, (r, at))
    ids, k = [], 0
    while k < n:
        ids.append(ranks[word[k : end[k]]])
        k = end[k]
    return ids


class _Words(dict):
    """Packed ids of the words met so far, but for very long ones; a new word is folded when it is first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        got = array("i", merge_word(word.encode(), self.ranks)).tobytes()
        if len(word) <= KNOWN_LENGTH:
            self[word] = got
        return got


_known: dict = {}  # of a worker


def _tables(path: str, pattern: str) -> tuple:
    """The worker's pattern and words for a tokenizer."""
    if (path, pattern) not in _known:
        import regex

        ranks = read_ranks(path)
        _known[path, pattern] = regex.compile(pattern), _Words(ranks)
    return _known[path, pattern]


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, words = _tables(path, pattern)
        for batch in batches:
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                parts, ends = [], [0]
                for text in texts:
                    if len(words) > KNOWN_WORDS:
                        words.clear()
                    ids = b"".join(map(words.__getitem__, words_of.findall(text.as_py())))
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; path: a file of base64 pieces and ranks."""
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_encoder(path, pattern), "doc_id long, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            pieces = sorted((k, p) for p, k in read_ranks(path).items())
            bounds = np.zeros(pieces[-1][0] + 2, np.int64)
            bounds[np.array([k for k, _ in pieces]) + 1] = [len(p) for _, p in pieces]
            _known[path] = np.frombuffer(b"".join(p for _, p in pieces), np.uint8), np.cumsum(bounds)
        letters, bounds = _known[path]
        for batch in batches:
            every = np.asarray(batch.column("ids").offsets)
            at = 0
            while at < batch.num_rows:  # some SLICE_IDS at a time, a longer text alone
                to = max(at + 1, int(np.searchsorted(every, every[at] + SLICE_IDS, "right")) - 1)
                part = batch.slice(at, to - at)
                flat, ends = part.column("ids").flatten().to_numpy(), every[at : to + 1] - every[at]
                # the binary pieces of the ids, one after the other
                n = bounds[flat + 1] - bounds[flat]
                upto = np.concatenate([[0], np.cumsum(n)])
                places = np.repeat(bounds[flat] - upto[:-1], n) + np.arange(upto[-1])
                texts = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto[ends].astype(np.int32)), pa.py_buffer(letters[places])])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "decoded"])
                at = to

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the bytes of its ids."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoder(path), f"{kinds}, decoded binary")


def _rank_lookup(ranks: dict[bytes, int]):
    """A function from the hexadecimal text of bytes to their rank, null if they have none, over a literal of the plan."""
    import xxhash

    buckets: list[str] = [";"] * _BUCKETS
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        at = xxhash.xxh64_intdigest(name, seed=42) % (1 << 64)
        at = (at - (1 << 64) if at >> 63 else at) % _BUCKETS
        buckets[at] += f"{name}={rank};"
    table = F.split(F.lit(",".join(buckets)), ",")

    def rank(piece: Column) -> Column:
        bucket = F.get(table, F.pmod(F.xxhash64(piece), F.lit(_BUCKETS)).cast("int"))
        key = F.concat(F.lit(";"), piece, F.lit("="))
        behind = F.substring_index(F.call_function("substring_index", bucket, key, F.lit(-1)), ";", 1)
        return F.when(F.contains(bucket, key), behind.cast("int"))

    return rank


def fold_words(words: DataFrame, column: str, ranks: dict[bytes, int]) -> DataFrame:
    """words with a column ids: each word's bytes folded by higher-order functions alone."""
    rank = _rank_lookup(ranks)
    bytes_of = F.regexp_extract_all(F.hex(F.encode(F.col(column), "UTF-8")), F.lit("(..)"), F.lit(1))

    def merged(pieces: Column, orders: Column) -> Column:
        least = F.array_min(orders)
        at = F.array_position(orders, least).cast("int")
        pair = F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at)))
        whole = F.concat(F.slice(pieces, 1, F.greatest(at - 1, F.lit(0))), pair, F.slice(pieces, at + 2, F.size(pieces)))
        return F.when(least.isNull(), pieces).otherwise(whole)

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda k: rank(F.concat(F.get(pieces, k), F.get(pieces, k + 1))))
        orders = F.when(F.size(pieces) >= 2, pairs).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array(orders), lambda o: merged(pieces, o))[0]  # binds the ranks of one step

    steps = F.when(F.size(bytes_of) >= 2, F.sequence(F.lit(1), F.size(bytes_of) - 1)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, bytes_of, step)
    return words.withColumn("ids", F.transform(folded, rank))
