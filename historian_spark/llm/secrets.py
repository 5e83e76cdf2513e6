"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. The method adds tokens
that look random: for every long token with a digit the smallest encoding that holds its
symbols is inferred, and three tests ask whether its symbols are uniform and independent:
chi-squared over the alphabet, runs above and below its middle, and serial correlation. A token
is cut at inner ``=``, and its longest runs in each alphabet of ``PARTS`` are tested if they are
long too, so a value is tested without its name or the path before it. Their
p-values are combined by Fisher's rule. Ordinary tokens fail the tests; how small a p-value
must be to call a token ordinary is set in each class of lengths by the step-up rule for false
discoveries over all documents, so that of the tokens called ordinary at most a share
``FALSE_SHARE`` is expected to be random ones. The others are reported.

``scan`` runs patterns and tests once and stores what they find, without the texts; ``thresholds``
gathers one histogram of it (at most some 600 bins for each of seven classes of lengths), and a
projection then names the spans. Nothing is shuffled but the histogram.

Cases: a null or empty text has no spans; spans are code points, end exclusive; an added span
inside a base span or a wider added one is left out; n tokens of a text take n log n steps beside
the search, and a token of n signs some 64 n; repeated rows and null ids give rows of their own; an
empty table gives no rows and no thresholds; columns of docs are kept by ``redact`` only, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, durable, unused

#: Fixed patterns of the base rules, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: The parts of a token that are tested: its runs in each alphabet, the last one with its padding.
PARTS = (r"[A-Za-z0-9+/]+(?:=+\z)?", r"[A-Za-z0-9_-]+(?:=+\z)?", r"[A-Za-z0-9]+(?:=+\z)?")
FALSE_SHARE = 0.01
LENGTHS = (20, 24, 32, 40, 48, 64, 96)
_BINS = 20  # of the histogram, for each power of e


def _bind(value: Column, then) -> Column:
    """then(value), with value computed once: inside a lambda variables cannot be named."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, join) -> Column:
    """For each place of an array the values up to it, joined: in rounds of doubling distance, so n log n steps and no growing copies."""
    strides = lambda n: F.filter(F.array(*[F.lit(1 << r) for r in range(31)]), lambda s: s < n)
    step = lambda acc, s: F.transform(acc, lambda v, k: F.when(k >= s, join(v, F.get(acc, k - s))).otherwise(v))
    return _bind(values, lambda own: F.aggregate(strides(F.size(own)), own, step))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit,value>> of leftmost non-overlapping matches; value: the pattern's own group, if it has one.

    Each step of the search begins where the last one ended and takes the gap and the match,
    or what is left at the end of the text. Running sums of their lengths give the places, so n
    matches take n log n steps beside the search.
    """
    step = rf"\G((?s:.*?))(?:({pattern})|\z)"
    group = lambda k: F.regexp_extract_all(text, F.lit(step), F.lit(k))
    # a hit, with the number of signs from the end of the one before to its own end
    value = F.zip_with(group(2), group(3), lambda h, v: F.struct(h.alias("hit"), v.alias("value"))) if pattern == ASSIGN else F.transform(group(2), lambda h: F.struct(h.alias("hit"), h.alias("value")))
    steps = F.zip_with(group(1), value, lambda g, h: F.struct((F.length(g) + F.length(h["hit"])).alias("n"), h["hit"].alias("hit"), h["value"].alias("value")))

    def placed(own: Column) -> Column:
        ends = _running(F.transform(own, lambda x: x["n"]), lambda a, b: a + b)
        return F.zip_with(own, ends, lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value")))

    found = F.filter(_bind(steps, placed), lambda x: x["hit"] != "")
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,value:string>>"))


def _of_kind(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the base rules, by start, then kind."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(x["value"]) >= 8)
    access = F.filter(matches(text, ACCESS), lambda x: F.length(x["hit"]) >= 16)
    parts = [F.transform(found, _of_kind(k)) for k, found in enumerate((assign, access, matches(text, HEX)))]
    return F.array_sort(F.concat(*parts))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, by the known five-term polynomial; error below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Inferred encodings, the smallest alphabet first: what the body matches, its symbols in order.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    (r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def randomness(body: Column) -> Column:
    """p-value of the combined tests that body's symbols are uniform and independent; null if no encoding fits."""
    def tests(d: Column) -> Column:
        x, k, letters = d["x"], d["k"], d["letters"]
        n = F.size(x).cast("double")
        times = lambda s: (n - F.length(F.replace(body, s, F.lit("")))).cast("double")
        squares = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda acc, s: acc + F.when(s == "", 0.0).otherwise(times(s) * times(s)))
        mean = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y) / n
        high = F.transform(x, lambda y: F.when(y >= k / 2, 1).otherwise(0))
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.struct(n.alias("n"), k.alias("k"), (k / n * squares - n).alias("chi"), mean.alias("mean"), x.alias("x"), pairs.alias("pairs"), F.aggregate(high, F.lit(0.0), lambda acc, y: acc + y).alias("n1"))

    def sums(d: Column) -> Column:
        mean, k = d["mean"], d["k"]
        turns = F.aggregate(d["pairs"], F.lit(1.0), lambda acc, y: acc + F.when((y["p"] >= k / 2) != (y["q"] >= k / 2), 1.0).otherwise(0.0))
        cross = F.aggregate(d["pairs"], F.lit(0.0), lambda acc, y: acc + (y["p"] - mean) * (y["q"] - mean))
        spread = F.aggregate(d["x"], F.lit(0.0), lambda acc, y: acc + (y - mean) * (y - mean))
        return F.struct(*[d[c].alias(c) for c in ("n", "k", "chi", "n1")], (d["n"] - d["n1"]).alias("n0"), turns.alias("turns"), cross.alias("cross"), spread.alias("spread"))

    def scores(d: Column) -> Column:
        n, k, both = d["n"], d["k"], 2 * d["n1"] * d["n0"]
        chi = (d["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs = F.when(both > 0, F.abs(d["turns"] - both / n - 1) / F.sqrt(F.greatest(F.lit(1e-9), both * (both - n) / (n * n * (n - 1)))))
        serial = F.when(d["spread"] > 0, F.abs(d["cross"] / F.nullif(d["spread"], F.lit(0.0)) + 1 / n) * F.sqrt(n))
        return F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), n.alias("n"))

    def combined(d: Column) -> Column:
        floor = F.lit(1e-12)
        p_chi = F.greatest(floor, _upper_tail(d["chi"]))
        p_runs = F.greatest(floor, F.coalesce(F.least(F.lit(1.0), 2 * _upper_tail(d["runs"])), F.pow(F.lit(2.0), 1 - F.least(d["n"], F.lit(50.0)))))
        p_serial = F.greatest(floor, F.coalesce(F.least(F.lit(1.0), 2 * _upper_tail(d["serial"])), floor))
        return -(F.log(p_chi) + F.log(p_runs) + F.log(p_serial))

    def fisher(h: Column) -> Column:
        return F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2))

    def of(letters: Column) -> Column:
        signs = F.filter(F.split(body, ""), lambda c: c != "")
        positions = F.transform(signs, lambda c: (F.instr(letters, c) - 1).cast("double"))
        first = F.struct(positions.alias("x"), F.length(letters).cast("double").alias("k"), letters.alias("letters"))
        return F.when(letters.isNotNull(), _bind(_bind(_bind(_bind(_bind(first, tests), sums), scores), combined), fisher))

    encoding = F.coalesce(*[F.when(body.rlike(rule), F.lit(symbols)) for rule, symbols in ENCODINGS])
    return F.when(body.rlike("[0-9]"), _bind(encoding, of))


def _stratum(length: Column) -> Column:
    return sum((F.when(length >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))


def candidates(text: Column) -> Column:
    """array<struct<start,end,stratum,p>> of the tested parts of long tokens; parts may lie in each other."""

    def parts(x: Column) -> Column:
        found = F.array_distinct(F.concat(*[matches(x["hit"], p) for p in PARTS]))
        return F.transform(found, lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["hit"].alias("hit")))

    tokens = F.filter(matches(text, TOKEN), lambda x: x["hit"].rlike("[0-9]"))
    digits = F.filter(F.flatten(F.transform(tokens, parts)), lambda x: (F.length(x["hit"]) >= LENGTHS[0]) & x["hit"].rlike("[0-9]"))

    def tested(x: Column) -> Column:
        p = _bind(F.regexp_replace(x["hit"], "=+$", ""), randomness)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), _stratum(F.length(x["hit"])).alias("stratum"), p.alias("p"))

    return F.filter(F.transform(digits, tested), lambda x: x["p"].isNotNull())


def _bin(p: Column) -> Column:
    return F.floor(-F.log(F.greatest(p, F.lit(1e-12))) * _BINS).cast("int")


SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and tested (the candidates) of every row of docs, stored: the patterns and tests run once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("tested"))
    return durable(rows, "spans")


def thresholds(tested: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class of lengths the least bin whose tokens are called ordinary, over all rows of a column tested."""
    tokens = tested.select(F.explode("tested").alias("c"))
    counts = tokens.groupBy("c.stratum", _bin(F.col("c.p")).alias("bin")).agg(F.count("*").alias("n"))
    strata: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # at most the bins of each class
        strata.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    cuts = {}
    for stratum, bins in strata.items():
        total, below = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):  # the largest bin holds the smallest p
            below += bins[b]
            if math.exp(-b / _BINS) <= false_share * below / total:
                cuts[stratum] = b
    return cuts


def text_thresholds(docs: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """thresholds of docs, from their texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return thresholds(docs.select(text.alias("text")).where(F.col("text").rlike(TOKEN)).select(candidates(F.col("text")).alias("tested")), false_share)


def all_spans(base: Column, tested: Column, cuts: dict[int, int]) -> Column:
    """The base spans and those that the method adds, as arrays of struct<start,kind,end> by start, then kind."""

    def is_random(x: Column) -> Column:
        least = F.lit(1 << 30)
        for stratum, b in cuts.items():
            least = F.when(x["stratum"] == stratum, F.lit(b)).otherwise(least)
        return _bin(x["p"]) < least

    added = F.transform(F.filter(tested, is_random), _of_kind(3))
    # in this order a span that holds another comes before it, so the farthest end so far tells
    wide = F.array_sort(F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def free(s: Column) -> Column:
        far = _running(F.transform(s, lambda x: -x["back"]), lambda a, b: F.greatest(a, b))
        held = lambda far: F.filter(F.transform(s, lambda x, k: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["back"]).alias("end"), F.get(far, k - 1).alias("far"))), lambda x: (x["kind"] < 3) | x["far"].isNull() | (x["far"] < x["end"]))
        return F.transform(_bind(far, held), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.array_sort(_bind(wide, free)).cast(SPANS)


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, counts of each base kind, base and spans (texts of kind:start:end, comma-joined) of every row of docs."""
    found = find(docs)
    rows = found.select("doc_id", "base", all_spans(F.col("base"), F.col("tested"), thresholds(found, false_share)).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), _listed("base").alias("base"), _listed("spans").alias("spans"))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of each span; of spans that overlap the first one is marked, to the end of the last.

    Pieces are cut from four bytes a sign, where a place is found at once.
    """
    size = F.length(text)

    def pieces(wide: Column) -> Column:
        cut = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * F.greatest(F.lit(0), b - a)), "UTF-32")

        def by(far: Column) -> Column:
            before = lambda k: F.coalesce(F.get(far, k - 1), F.lit(0))
            parts = F.transform(spans, lambda x, k: F.when(x["start"] >= before(k), F.concat(cut(before(k), x["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(far, -1), size))

        return _bind(_running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), by)

    return _bind(F.encode(text, "UTF-32"), pieces)


def redact(docs: DataFrame, cuts: dict[int, int], mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mark; n_chars, if there is such a column, follows the new text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    work = unused(docs, "work")
    done = lambda t: _bind(all_spans(base_spans(t), candidates(t), cuts), lambda s: F.when(F.size(s) > 0, _marked(t, s, mark)))
    rows = docs.withColumn(work, _bind(text, done))  # null where nothing is marked
    fresh = {"text": F.coalesce(column(work), F.col("text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(column(work).isNotNull(), F.length(column(work)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[fresh[c].alias(c) if c in fresh else column(c) for c in docs.columns])
