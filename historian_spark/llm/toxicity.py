"""Toxicity scores by weak supervision.

1. Labelled rows outside the held-out fold, at most ``max_rows`` of them by a hash of doc_id,
   are the sample. Feature counts by label over it give a lexicon: whole words and word
   beginnings that lean to one label.
2. Voters: each strong lexicon entry, seed insults and a few text patterns vote toxic where
   they occur; entries that lean the other way and texts without any hit vote clean.
3. A generative label model estimates by expectation-maximisation how each voter votes given
   the hidden label. Correlations of the voters' residuals are estimated next; a voter's
   evidence is divided by the correlated voices it shares, and the model is fitted again.
4. A linear classifier over the lexicon's features is trained on the posterior labels. Its
   weights, bounded by ``max_features``, go to the workers, which score whole texts.

Cases: a null or empty text has no feature and gets the score of the intercept; null doc_ids
are not held out and carry no label; several labels of one doc_id count as their maximum; null
labels are no labels; without labels of both kinds the seed words alone decide; repeated rows
get equal scores; an empty table gives no rows; other columns are never read, and ``keep_clean``
keeps them in the JVM. Texts are read in slices of some ``SLICE_BYTES``, so a worker holds its
Arrow batch and what one slice becomes; a longer text is a slice of its own and is read whole.

``max_rows`` bounds the rows that the model is fitted on, ``max_features`` the lexicon and
``max_voters`` the words that vote; features beyond that, those that lean least surely, have no
weight. All documents are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, durable, only, slices, unused, whole_text

MAX_ROWS = 20_000
MAX_FEATURES = 4_000
MAX_VOTERS = 80
FOLDS = 5
#: Common insults that vote without any label.
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "dumb", "imbecile", "filth", "vermin")
#: Patterns that vote toxic: shouting, piled-up marks, direct address with an insult.
PATTERNS = (r"\b[A-Z]{6,}[!?]", r"[!?]{3,}", r"(?i)\byou\b[^.!?\n]{0,40}\b(?:" + "|".join(SEEDS) + r")\b")
BEGINNINGS = (3, 4, 5, 6)
#: A feature that a text has so often is a feature of its own, with this mark.
OFTEN, OFTEN_MARK = 3, "~often"
_WORD = re.compile(r"\w+")
_CACHE_PIECES = 100_000
SLICE_BYTES = 2 << 20


def piece_features(piece: str) -> list[str]:
    """Whole words (=word) and word beginnings (^begin) of a piece without white space."""
    found = []
    for w in _WORD.findall(piece.lower()):
        found.append(f"={w}")
        found += [f"^{w[:n]}" for n in BEGINNINGS if len(w) > n]
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each piece its text's row and its number among the distinct pieces."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten().dictionary_encode()
    ends = np.asarray(split.offsets) - split.offsets[0].as_py()
    return np.repeat(np.arange(len(texts)), np.diff(ends)), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def _pattern_hits(texts: pa.Array) -> np.ndarray:
    return np.stack([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(bool) for p in PATTERNS], axis=1)


def _ragged(lists: list[tuple[int, ...]], codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and members for pieces (codes) of rows whose members are lists[code]."""
    width = np.fromiter(map(len, lists), np.int64, len(lists))
    some = width[codes] > 0 if len(codes) else np.empty(0, bool)
    rows, codes = rows[some], codes[some]
    pool = np.fromiter((x for one in lists for x in one), np.int64, int(width.sum()))
    n = width[codes]
    at = np.repeat((np.cumsum(width) - width)[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(rows, n), pool[at]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of a slice have each feature, once and OFTEN times."""
    for batch in batches:
        marked = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for first, texts in slices(batch.column("text"), SLICE_BYTES):
            toxic = marked[first : first + len(texts)]
            row, code, pieces = _pieces(texts)
            names: dict[str, int] = {}
            lists = [tuple(names.setdefault(f, len(names)) for f in piece_features(p)) for p in pieces]
            rows, ids = _ragged(lists, code, row)
            key, times = np.unique(ids * len(texts) + rows, return_counts=True)
            ids, ill = key // len(texts), toxic[key % len(texts)]
            listed = list(names)
            for mark, own in (("", times > 0), (OFTEN_MARK, times >= OFTEN)):
                both, bad = np.bincount(ids[own], minlength=len(names)), np.bincount(ids[own], ill[own], minlength=len(names))
                some = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array([listed[k] + mark for k in some], pa.string()), pa.array(bad[some].astype(np.int64)), pa.array(both[some].astype(np.int64))], ["feature", "toxic", "all"])


class _Finder:
    """Which of the given features a piece has; remembers a bounded number of pieces."""

    def __init__(self, features: tuple[str, ...]):
        self.number: dict[str, int] = {}
        at = {f: k for k, f in enumerate(features)}
        for f in features:
            self.number.setdefault(f.removesuffix(OFTEN_MARK), len(self.number))
        self.once = np.array([at.get(f, -1) for f in self.number], np.int64)
        self.often = np.array([at.get(f + OFTEN_MARK, -1) for f in self.number], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            got = tuple(self.number[f] for f in piece_features(piece) if f in self.number)
            if len(self.known) >= _CACHE_PIECES:
                self.known.clear()
            self.known[piece] = got
        return got


def present(texts: pa.Array, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features that occur, each pair once, by row; patterns are numbered after the features."""
    parts = [(first + row, f) for first, some in slices(texts, SLICE_BYTES) for row, f in [_present(some, features)]]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([r for r, _ in parts]), np.concatenate([f for _, f in parts])


def _present(texts: pa.Array, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    find = only(features, lambda: _Finder(features))
    row, code, pieces = _pieces(texts)
    rows, ids = _ragged([find(p) for p in pieces], code, row)
    bases, total = max(1, len(find.once)), len(features) + len(PATTERNS)
    key, times = np.unique(rows * bases + ids, return_counts=True)
    rows, ids = key // bases, key % bases
    r2, p2 = np.nonzero(_pattern_hits(texts))
    keys = [r2 * total + len(features) + p2]
    if len(ids):
        for numbers, own in ((find.once, times > 0), (find.often, times >= OFTEN)):
            own = own & (numbers[ids] >= 0)
            keys.append(rows[own] * total + numbers[ids[own]])
    key = np.unique(np.concatenate(keys))
    return key // total, key % total


def _sample_features(features: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, f = present(batch.column("text"), features)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "features"])

    return run


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, accuracies P(vote | label) and correlations of voters.

    votes: n x voters of -1 (clean), 0 (none), 1 (toxic). start: noisy labels of the rows; they
    give the base rate and the first accuracies, so that the hidden label is toxicity and not
    another trait that the voters share, such as length or language.
    """
    n, m = votes.shape
    kinds = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float32)  # n x m x 3
    pi = float(np.clip(start.mean(), 1e-3, 0.9))
    first = np.where(start > 0, 0.95, 0.02)
    weight = np.ones(m)
    corr = np.zeros((m, m))
    for fit in range(2):
        post = first
        for _ in range(rounds):
            pos = np.tensordot(post, kinds, axes=(0, 0)) + [0.01, 0.5, 0.1]
            neg = np.tensordot(1 - post, kinds, axes=(0, 0)) + [0.1, 0.5, 0.01]
            given = np.stack([neg / neg.sum(1, keepdims=True), pos / pos.sum(1, keepdims=True)])
            evidence = np.log(given[1] / given[0]) * weight[:, None]
            logit = np.log(pi / (1 - pi)) + np.einsum("nmk,mk->n", kinds, evidence)
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if fit == 0:
            cast = votes.astype(np.float32)
            mean = np.outer(post, given[1, :, 2] - given[1, :, 0]) + np.outer(1 - post, given[0, :, 2] - given[0, :, 0])
            rest = cast - mean
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr - 0.05, 0).sum(1))
    return post, given, corr


def train_linear(rows: np.ndarray, features: np.ndarray, target: np.ndarray, width: int, rounds: int = 300, l2: float = 3e-4) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels over binary features, by Adagrad on all rows."""
    n, w, b = len(target), np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    gw, gb = np.full(width, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(rows, w[features], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g, h = np.bincount(features, d[rows], minlength=width) + l2 / 10 * w, d.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.1 * h / np.sqrt(gb)
    return b, w


@dataclass
class Model:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def _seed_model() -> Model:
    features = tuple(f"={s}" for s in SEEDS)
    return Model(features, np.concatenate([np.full(len(features), 4.0), np.zeros(len(PATTERNS))]), -2.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, max_voters: int = MAX_VOTERS) -> Model:
    """A model from the labelled rows outside the held-out fold, max_rows of them at most (in the mean of a hash)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))
    # the sample's ids are bounded by max_rows, and so can be sent to every task
    sample = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = durable(sample, "sample")  # read three times
    counted = sample.mapInArrow(_counts, "feature string, toxic long, all long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    sizes = sample.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ill")).first()
    n, ill = sizes["n"], sizes["ill"]
    if ill < 5 or n - ill < 5:
        return _seed_model()
    odds = F.log(((F.col("toxic") + 0.5) / (ill + 1.0)) / ((F.col("all") - F.col("toxic") + 0.5) / (n - ill + 1.0)))
    # what the counts surely show: the log odds ratio less its standard error, one and a half times
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("all") - F.col("toxic") + 0.5))
    lean = counted.where("all >= 4").withColumn("odds", odds).withColumn("strength", F.abs("odds") - 1.5 * error).where("strength > 0")
    top = lean.orderBy(F.desc("strength"), "feature").limit(max_features - len(SEEDS)).toPandas()  # bounded: the lexicon
    features = tuple(dict.fromkeys([*(f"={s}" for s in SEEDS), *top["feature"]]))
    got = sample.mapInArrow(_sample_features(features), "toxic int, features array<int>").toPandas()
    rows = np.repeat(np.arange(len(got)), got["features"].map(len))
    flat = np.concatenate([np.asarray(x, np.int64) for x in got["features"]]) if len(got) else np.empty(0, np.int64)
    lean_of = dict(zip(top["feature"], top["odds"]))
    number = {f: k for k, f in enumerate(features)}
    toxic_words = [number[f] for f, o in lean_of.items() if o > 1.0][:max_voters]
    clean_words = [number[f] for f, o in lean_of.items() if o < -1.0][: max_voters // 8]
    voters = list(dict.fromkeys([*range(len(SEEDS)), *range(len(features), len(features) + len(PATTERNS)), *toxic_words]))
    votes = np.zeros((len(got), len(voters) + len(clean_words) + 1), np.int8)
    place = np.full(len(features) + len(PATTERNS), -1)
    place[voters] = np.arange(len(voters))
    own = place[flat] >= 0
    votes[rows[own], place[flat[own]]] = 1
    for k, f in enumerate(clean_words):
        votes[rows[flat == f], len(voters) + k] = -1
    hints = np.bincount(rows, np.isin(flat, toxic_words), minlength=len(got))
    votes[hints == 0, -1] = -1
    votes[hints >= 3, -1] = 1
    used = (votes != 0).sum(0) > 2
    post, given, corr = label_model(votes[:, used], got["toxic"].to_numpy())
    b, w = train_linear(rows, flat, post, len(features) + len(PATTERNS))
    return Model(features, w, b, given, corr)


def scorer(model: Model) -> Callable:
    """A function of a column of texts: their scores. Only the texts go to the workers, other columns stay in the JVM."""
    features, weights, intercept = model.features, model.weights, model.intercept

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        row, f = present(texts, features)
        z = intercept + np.bincount(row, weights[f], minlength=len(texts))
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= 0.5) for every row of docs."""
    rows = whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", scorer(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    own = unused(docs, "score")
    # not deterministic for the optimizer: the scores stay a step of their own, and a text that is computed is computed once
    scored = docs.withColumn(own, scorer(model).asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.where(column(own) < 0.5).select(*[column(c) for c in docs.columns])
