"""Near-duplicate classes of documents by BagMinHash signatures.

A document is the bag of its runs of five words. A shingle's counts are cut into the dyadic
intervals [0, 1), [1, 2), [2, 4), [4, 8) ...: a hierarchy in which each interval is as wide as all
before it. Each has a seeded Poisson process of its own, with its width as rate, that throws points
onto the registers; a point belongs to the document if its level, drawn evenly within the interval,
is below the count. This is one process over all levels, thinned to those that the count covers,
so an interval is never halved further: the last one alone may be covered in part, and there its
points are thinned.
The least point of each register is the signature, so two documents agree in a register with
the probability of their weighted Jaccard similarity. Points come in ascending order, and a
process stops once its next point cannot lower any register.

Banded signatures give candidates. Equal texts are first collapsed to one representative; in
each bucket the members are compared with the bucket's least one, exactly, on whole bags.
Classes of what was found are formed. Where the members of buckets with one centre are still in
different classes, an exact prefix join finds the pairs across classes that can be alike: the
shingles that few of some pivots have come first, so that what all share makes no candidates. Those
are compared too, so only pairs that cannot join new classes are left out.

Cases: words are white-space-delimited, lower-cased; a text of fewer than five words has one
shingle, all its words; texts with equal words are always one class, those without words
among them; a null text is the empty one; a null doc_id has a class too; repeated rows stay
rows; an empty table gives no rows; other columns are kept by ``keep_one`` only, whatever their
names. Texts with equal words are told by a 64-bit hash of them and not compared again: among n
distinct texts two fall together with a probability of n * n / 2**65 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, durable, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 25, 5
BITMAP_BITS = 26
PIVOTS = 16  # texts of a centre's buckets, at most, whose shingles count as common there; of no more members no order is asked
SALT_ROWS = 64  # members of a centre's buckets that meet in a task, about
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit generator (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words of each text (words hashed, texts end at ends[1:]), and their texts."""
    n = np.diff(ends)
    runs = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    doc = np.repeat(np.arange(len(n)), runs)
    first = np.repeat(ends[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(len(doc))
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        inside = first + k < ends[1:][doc]
        w = words[np.minimum(first + k, max(0, len(words) - 1))] if len(words) else words
        h = np.where(inside, _mix(h * _U(0x9E3779B97F4A7C15) + w + _U(k)), h)
    return h, doc


def signatures(elements: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, m: int = BANDS * BAND_ROWS) -> np.ndarray:
    """n_docs x m registers for distinct elements with counts; a document without any has infinities."""
    h = np.full(n_docs * m, np.inf)
    unit, who, lo, weight = [elements], [doc], [np.zeros(len(doc), np.int64)], [count]
    level = 1  # dyadic intervals [0,1), [1,2), [2,4), [4,8), ...
    while (over := count > level).any():
        unit.append(elements[over])
        who.append(doc[over])
        lo.append(np.full(int(over.sum()), level))
        weight.append(count[over])
        level *= 2
    e, d, low, c = (np.concatenate(x) for x in (unit, who, lo, weight))
    state = _mix(e + _U(0xD1B54A32D192ED03) * low.astype(np.uint64))
    rate = np.maximum(low, 1).astype(float)  # the interval's width
    at = np.zeros(len(e))
    worst = np.full(n_docs, np.inf)
    while len(e):
        state = _mix(state + _U(0x9E3779B97F4A7C15))
        at = at - np.log((state >> _U(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        mark = _mix(state ^ _U(0xA0761D6478BD642F))
        fell = low + ((mark >> _U(32)) % np.maximum(low, 1).astype(np.uint64)).astype(np.int64)
        own = fell < c  # points at levels that the count does not cover are another document's
        register = (mark & _U(0xFFFFFFFF)) % _U(m)
        np.minimum.at(h, (d * m + register.astype(np.int64))[own], at[own])
        worst = h.reshape(n_docs, m).max(axis=1) if n_docs else worst
        going = at < worst[d]
        e, d, low, c, state, rate, at = (x[going] for x in (e, d, low, c, state, rate, at))
    return h.reshape(n_docs, m)


def _bags(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, doc = shingles(words, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.asarray(column.offsets).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), ends - ends[0]


_SLICE_WORDS = 400_000


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ends = _flat(batch.column("words"))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + _SLICE_WORDS, _SLICE_WORDS)))
        cuts = np.unique(np.concatenate([[0], np.minimum(cuts, batch.num_rows), [batch.num_rows]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = ends[a : b + 1] - ends[a]
            part = words[ends[a] : ends[b]]
            elements, doc, count = _bags(part, own)
            sig = signatures(elements, doc, count, b - a)
            bands = np.zeros((b - a, BANDS), np.uint64)
            for k in range(BANDS):
                x = np.full(b - a, k + 1, np.uint64)
                for r in range(BAND_ROWS):
                    x = _mix(x * _U(0x9E3779B97F4A7C15) + np.ascontiguousarray(sig[:, k * BAND_ROWS + r]).view(np.uint64))
                bands[:, k] = x
            bands = bands.view(np.int64)[np.diff(own) > 0]
            keys = batch.column("key").slice(a, b - a).filter(pa.array(np.diff(own) > 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            n = pa.array(np.maximum(1, np.diff(own) - SHINGLE + 1)[np.diff(own) > 0])
            yield pa.RecordBatch.from_arrays([keys, n, lists], ["key", "n", "bands"])


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' bags of shingles; 0 where either has no words."""
    from collections import Counter

    def bag(text: str) -> Counter:
        w = text.lower().split()
        return Counter(tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values())) if x and y else 0.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of pairs, by hashed words; a bag is kept for the rows that follow."""
    last_key, last = None, None

    def bag(words) -> tuple[np.ndarray, np.ndarray]:
        h, _ = shingles(words, np.array([0, len(words)]))
        return np.unique(h, return_counts=True)

    for batch in batches:
        alike = []
        u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        (wu, eu), (wv, ev) = _flat(batch.column("words_u")), _flat(batch.column("words_v"))
        for k in range(batch.num_rows):
            if u[k] != last_key:
                last_key, last = u[k], bag(wu[eu[k] : eu[k + 1]])
            h, n = bag(wv[ev[k] : ev[k + 1]])
            _, x, y = np.intersect1d(last[0], h, assume_unique=True, return_indices=True)
            both = np.minimum(last[1][x], n[y]).sum()
            alike.append(both / (last[1].sum() + n.sum() - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(alike, pa.float64())], ["u", "v", "alike"])


def _verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (u, v) and how alike they are. Only documents in pairs are moved."""
    left = words.select(F.col("key").alias("u"), F.col("words").alias("words_u"))
    right = words.select(F.col("key").alias("v"), F.col("words").alias("words_v"))
    rows = pairs.select("u", "v").join(right, "v").join(left, "u")
    return rows.mapInArrow(_verified, "u long, v long, alike double").distinct()


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.05)).astype(np.int32)


def _members(words: np.ndarray) -> np.ndarray:
    """A text's bag of shingles as a set: the second of equal ones is another member than the first."""
    h, count = np.unique(shingles(words, np.array([0, len(words)]))[0], return_counts=True)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return _mix(np.repeat(h, count) + _U(0x9E3779B97F4A7C15) * nth.astype(np.uint64))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and each member of a pivot's bag, for every pivot of a batch."""
    for batch in batches:
        words, ends = _flat(batch.column("words"))
        for k, u in enumerate(batch.column("u").to_pylist()):
            token = _members(words[ends[k] : ends[k + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), u)), pa.array(token.view(np.int64))], ["u", "token"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first shingles of each text v, those that few pivots of its centre u have before the others, as index and probe rows.

    Two texts of n and m shingles that are alike share at least 4 (n + m) / 9 of them, so in any
    common order one of the first n - 4 (n + m) / 9 + 1 of one is among the first of the other.
    The shorter is indexed under its class of size, the longer probes the classes it may meet.
    """
    last_key = None
    for batch in batches:
        u, roots, v = (batch.column(c).to_pylist() for c in ("u", "root", "v"))
        wv, ev = _flat(batch.column("words_v"))
        for k in range(batch.num_rows):
            if u[k] != last_key:
                last_key, common = u[k], batch.column("common")[k].values
                last = [np.empty(0, np.uint64), np.empty(0, np.int64)]
                if common is not None and len(common):  # sorted by signed token
                    last = [common.field("token").to_numpy().view(np.uint64), common.field("held").to_numpy()]
                    by = np.argsort(last[0])
                    last = [x[by] for x in last]
            token = _members(wv[ev[k] : ev[k + 1]])
            order = np.argsort(token)
            if len(last[0]):
                at = np.minimum(np.searchsorted(last[0], token), len(last[0]) - 1)
                order = np.lexsort((token, np.where(last[0][at] == token, last[1][at], 0)))
            n = len(order)
            least = (4 * n + 4) // 5  # shingles of the shortest partner
            short = n - (8 * n + 8) // 9 + 1
            place = np.arange(n - (4 * (n + least) + 8) // 9 + 1)
            low, high = _size_class(np.array([least]))[0], _size_class(np.minimum(n, (9 * (n - place)) // 4 - n))
            wide = np.maximum(high - low + 1, 0)
            probe = np.repeat(place, wide)
            size = low + np.arange(len(probe)) - np.repeat(np.cumsum(wide) - wide, wide)
            place = np.concatenate([np.arange(short), probe]).astype(np.int32)
            size = np.concatenate([np.repeat(_size_class(np.array([n])), short), size]).astype(np.int32)
            rows = len(place)
            same = [pa.array(np.full(rows, x)) for x in (u[k], v[k], roots[k])]
            columns = [*same, pa.array(np.arange(rows) >= short), pa.array(size), pa.array(token[order][place].view(np.int64)), pa.array(place), pa.array(np.full(rows, n, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "root", "probe", "size", "token", "place", "n"])


def _across(left_over: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (u, v) of left_over's texts with one centre and different classes that may be alike; none that is alike is missing."""
    # pivots only order shingles: any members serve, and any order finds the same pairs
    weights = durable(left_over.groupBy("u").agg(F.count("*").alias("members")), "weights")
    many = weights.where(F.col("members") > PIVOTS).select("u")  # of so few members as others have, all pairs are few
    some = left_over.join(many, "u").groupBy("u", F.pmod(F.xxhash64("v"), F.lit(PIVOTS)).alias("slot")).agg(F.min("v").alias("key")).select("u", "key")
    some = some.union(many.select("u", F.col("u").alias("key")))
    held = some.join(words, "key").select("u", "words").mapInArrow(_tokens, "u long, token long").groupBy("u", "token").agg(F.count("*").alias("held")).where("held > 1")
    common = held.groupBy("u").agg(F.collect_list(F.struct("token", "held")).alias("common"))
    # the members of a centre are dealt over as many tasks as there are SALT_ROWS of them
    weights = weights.select("u", F.ceil(F.col("members") / SALT_ROWS).cast("int").alias("salts"))
    pivots = durable(weights.join(common, "u", "left").select("u", "common", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "pivots")
    salted = left_over.join(weights, "u").withColumn("salt", F.pmod(F.xxhash64("v", F.lit(1)), F.col("salts")).cast("int")).drop("salts")
    rows = salted.join(words.select(F.col("key").alias("v"), F.col("words").alias("words_v")), "v").join(pivots, ["u", "salt"])
    rows = rows.select("u", "v", "root", "words_v", "common")
    found = rows.mapInArrow(_prefixes, "u long, v long, root long, probe boolean, size int, token long, place int, n int")
    found = durable(found, "prefixes")
    met = _met(found).where("root_x <> root_y")
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _met(found: DataFrame) -> DataFrame:
    """x, y and their roots for index and probe rows that share a key and may be alike, without any pair within a key's largest class.

    Keys whose rows are all of one class, all index or all probe rows have no pairs; nearly all keys
    are such, and their rows are left where they are. Of the others the rows of the largest class
    stand on one side only, so however many copies a class has, a key makes as many pairs as it
    has rows times those of its other classes, at most.
    """
    found = found.withColumn("key", F.xxhash64("u", "size", "token")).drop("u", "size", "token")  # keys that fall together only make candidates more
    sides = found.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.bit_or(F.when(F.col("probe"), 2).otherwise(1)).alias("sides"))
    near = durable(_among(found, sides.where("a <> b and sides = 3"), "key"), "mixed-prefixes")
    per_class = near.groupBy("key", "root").agg(F.count("*").alias("rows"))
    largest = per_class.groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("largest"), F.count("*").alias("classes"))
    largest = durable(largest.where("classes > 1").drop("classes"), "largest")
    held = durable(near.join(largest, "key"), "held")
    common = (4 * (F.col("x.n") + F.col("y.n")) + 8) / 9
    fits = (F.col("x.place") <= F.col("x.n") - F.floor(common)) & (F.col("y.place") <= F.col("y.n") - F.floor(common))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.where("not probe").alias("x").join(y.where("probe").alias("y"), [F.col("x.key") == F.col("y.key"), F.col("x.n") <= F.col("y.n"), fits])
        return pairs.select(F.col("x.v").alias("x"), F.col("y.v").alias("y"), F.col("x.root").alias("root_x"), F.col("y.root").alias("root_y"))

    others, own = held.where("root <> largest"), held.where("root = largest")
    return joined(held, others).union(joined(others, own))


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("alike") >= SIMILARITY).select("u", "v")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def _with_words(docs: DataFrame) -> DataFrame:
    """docs with the hashes of its words and key, a hash of their sequence and number."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hashed = docs.withColumn("words", F.transform(words, lambda w: F.xxhash64(w)))
    return hashed.withColumn("key", F.xxhash64(F.size("words"), "words"))


def _among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value of column is among wanted's, and few others: by a bitmap of at most 2**BITMAP_BITS bits.

    The bitmap is a table of 64-bit words, 2**20 rows at most whatever the input, and is broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    words = wanted.groupBy(F.shiftright(place(column), 6).alias("bit_word")).agg(F.bit_or(bit(column)).alias("bits"))
    near = rows.withColumn("bit_word", F.shiftright(place(column), 6)).join(F.broadcast(words), "bit_word")
    return near.where(F.col("bits").bitwiseAND(bit(column)) != 0).drop("bit_word", "bits")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges but the roots, by star contraction until there are only stars."""
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    now = durable(edges.where("u <> v").distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # what a join takes in is stored first: a node with very many edges can then be split over tasks
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.max("v").alias("most"))
        least = durable(least, "least")
        if least.where("below > 1 or (below = 1 and most > u)").isEmpty():  # every node is a centre or has one
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        large = durable(both.join(least.select("u", "m"), "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "large")
        # now every edge is (smaller, larger); link all smaller neighbours of a node to their least
        low = durable(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        now = durable(small.where("u <> v").distinct(), "edges")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key (of the text's words), class_id (the least doc_id of its class), class_rows, class_key (one a class), text_hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = durable(_with_words(texts).select("doc_id", "key", _text_hash()), "keys")
    # one row a distinct text: copies meet on the mappers first, and only hashes and ids move
    firsts = durable(keys.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "firsts")
    signed = _with_words(texts).select("key", "words").mapInArrow(_signed, "key long, n long, bands array<long>")
    signed = durable(signed.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), "signed")
    bands = signed.select("key", "n", F.explode("bands").alias("band"))
    # sums by a key are stored before they are joined back: both sides of the join are then plain, and a hot key can be split
    sizes = durable(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    shared = durable(_among(bands, sizes, "band").join(sizes, "band"), "shared")
    # the centre of a bucket is the member that meets most others anywhere, such as the text others were made from
    popular = shared.groupBy("key").agg(F.sum("members").alias("meets"))
    centre = shared.join(popular, "key").groupBy("band").agg(F.max(F.struct("meets", "key", "n")).alias("c"))
    centre = durable(centre.select("band", F.col("c.key").alias("u"), F.col("c.n").alias("nu")), "centre")
    members = durable(shared.select("band", "key", "n").join(centre, "band"), "members")
    pairs = members.where("u <> key").groupBy("u", F.col("key").alias("v")).agg(F.count("*").alias("shared"), F.first(5 * F.least("n", "nu") >= 4 * F.greatest("n", "nu")).alias("comparable"))
    pairs = durable(pairs, "pairs")
    # words of the candidates alone are kept; every member of a shared bucket is in a pair
    needed = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(firsts.select("key", "first_id"), "key")
    needed = durable(needed.withColumnRenamed("key", "wanted"), "needed")
    held = _among(texts, needed.select(F.col("first_id").alias("doc_id")), "doc_id")
    words_of = _with_words(held.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")))).where("key = wanted")
    words_of = durable(words_of.select("key", "words"), "words")

    # first each text with the centre that it shares most buckets with
    pairs = pairs.where("comparable")  # texts of too different lengths are not alike
    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("shared", "u")).alias("u"))
    compared = durable(_verify(best, words_of), "compared")
    # one step up is a class as far as the next comparisons need it: where it is too small, some are made in vain
    roots = _linked(compared).select(F.col("v").alias("key"), F.col("u").alias("root"))

    def root_of(rows: DataFrame, key: str, name: str) -> DataFrame:
        named = roots.select(F.col("key").alias(key), F.col("root").alias(f"{name}_"))
        return rows.join(named, key, "left").withColumn(name, F.coalesce(f"{name}_", key)).drop(f"{name}_")

    # then with its other centres, where that can still join classes
    ends = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    open_ = pairs.select("u", "v", *ends).join(best.select(*ends), ["a", "b"], "left_anti").select("u", "v")
    others = root_of(root_of(open_, "u", "ru"), "v", "rv").where("ru <> rv").select("u", "v")
    compared = durable(compared.union(_verify(durable(others, "others"), words_of)), "compared")
    links = durable(_linked(compared), "links")
    roots = durable(components(links), "roots").withColumnRenamed("node", "key")

    # last, in buckets that still hold several classes, the pairs across classes that share a prefix
    named = root_of(members.where("u <> key"), "key", "root").select("band", "u", F.col("key").alias("v"), "root")
    mixed = named.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    mixed = durable(mixed, "mixed-bands")
    left_over = durable(named.join(mixed, "band", "left_semi").select("u", "v", "root").distinct(), "mixed")
    more = _across(left_over, words_of)
    done = compared.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = more.join(done, ["u", "v"], "left_anti")
    # each class found so far counts as a star
    links = roots.select(F.col("root").alias("u"), F.col("key").alias("v")).union(_linked(_verify(durable(more, "more"), words_of)))
    roots = components(links).withColumnRenamed("node", "key")
    of_key = durable(firsts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "classes")
    per_class = durable(of_key.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_rows")), "per-class")
    return keys.join(of_key.join(per_class, "root").select("key", "class_id", "class_rows", F.col("root").alias("class_key")), "key").select("doc_id", "key", "class_id", "class_rows", "class_key", "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of its least doc_id, in the columns of docs.

    Rows without doc_id give way to rows with one; of several texts with that doc_id the one of
    the least key is kept.
    """
    ids = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "text_hash")  # nulls last
    kept = classes(docs).groupBy("class_key").agg(F.min(ids).alias("k"))
    # rows equal in doc_id and text are one; the join and the choice among them share one partitioning
    named = {c: unused(docs, c) for c in ("none", "id", "hash")}
    own = [F.col("k.none"), F.coalesce("k.doc_id", F.lit(0)), F.col("k.text_hash")]
    kept = durable(kept.select(*[x.alias(c) for x, c in zip(own, named.values())]), "kept")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns(dict(zip(named.values(), (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), _text_hash()))))
    found = rows.join(kept.hint("merge"), list(named.values())).dropDuplicates(list(named.values()))
    return found.select(*[column(c) for c in docs.columns])
