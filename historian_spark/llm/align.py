"""Alignment of two tokenizers over the same texts: groups, overlap links and corpus-wide pair counts.

Both tokenizers end a token before a single space that stands between two other signs, so the
pieces between such spaces are aligned apart and once: beside its Arrow partitions every worker
keeps a DuckDB with the pieces it has met, a bounded number; where there are too many, those stay
that most slices met again. For new pieces it gets interval tables of the tokens (number, id, begin and
end in bytes); ASOF joins find the first and the last token of B that a token of A overlaps, a
range join between those gives the links. A token of A whose end is that of its last token of B
closes a group; the number of such ends before a token is that of its group.
Documents are sums over their pieces; the documents that hold a pair are counted in DuckDB, a
slice of texts at a time, and these partial counts are merged in Spark. Totals come back by slice:
a slice's pairs are joined with the totals and meet its documents, which were stored as piece
numbers, so no text is read twice and no link is moved.

A piece that does not give its own bytes back has its documents tokenized whole instead, and those
are compared whole, as the definition says.

Cases: texts that are null, empty, or not given back by both tokenizers have no tokens: zeros and
an empty groups_sha256. Null doc_ids are kept; repeated rows are documents of their own, also in
the counts; texts may be of any length, but one text is held whole by its worker; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import operator
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, only, slices, spread, whole_text
from .words import byte_letters

SLICE_BYTES = 2 << 20  # of texts that are counted together
KNOWN_PIECES, KNOWN_BYTES = 250_000, 32 << 20  # that a partition remembers
TOGETHER = 256  # pieces that are encoded in one call
ADDED = 10_000  # pieces that are aligned in one step
SPACE = re.compile(r"(?<=\S) (?=\S)")

_JOINS = """
CREATE OR REPLACE TEMP TABLE spans AS
    SELECT f.*, l.k AS upto, l.e = f.e AS closes FROM (SELECT a.*, b.k AS since FROM a ASOF JOIN b ON a.s >= b.s) f ASOF JOIN b l ON f.e > l.s;
INSERT INTO links SELECT t.piece, t.id::BIGINT * {base} + b.id FROM (SELECT piece, id, unnest(range(since, upto + 1)) AS k FROM spans) t JOIN b USING (k);
"""
_CLOSES = "SELECT e FROM spans WHERE closes ORDER BY e"
_LINKS = "SELECT piece, count(*) AS n FROM links WHERE piece >= $1 GROUP BY piece ORDER BY piece"
_COUNTS = "SELECT pair, count(*)::INTEGER AS docs FROM (SELECT DISTINCT o.doc, l.pair FROM occurs o JOIN links l USING (piece)) GROUP BY pair ORDER BY pair"
_OWN_LINKS = "SELECT piece, pair FROM links SEMI JOIN occurs USING (piece) ORDER BY piece, pair"


class _Codes(dict):
    """Numbers of pieces in the order in which they are first asked for; new ones are listed."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []
        self.n = len(self)

    def __missing__(self, piece: str) -> int:
        self[piece] = code = self.n
        self.new.append(piece)
        self.n += 1
        return code

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new

    def skip(self) -> None:
        """A number without a piece."""
        self.n += 1


_NONE, _JOINT = np.empty(0, np.int64), pa.scalar("", pa.large_string())
_vocabularies: dict = {}  # of a worker


def _tokenizers(path_a: str, path_b: str) -> tuple:
    """Both tokenizers and the bytes of their tokens by id."""
    if (path_a, path_b) not in _vocabularies:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        a.encode_special_tokens = True
        letters = {c: n for n, c in byte_letters().items()}
        bytes_a = [b""] * a.get_vocab_size()
        for piece, k in a.get_vocab(with_added_tokens=False).items():
            bytes_a[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        _vocabularies[path_a, path_b] = a, b, bytes_a, bytes_b
    return _vocabularies[path_a, path_b]


def _bare(pieces: list[str]) -> np.ndarray:
    """Whether pieces have signs other than white space at both ends."""
    return np.fromiter(map(operator.eq, map(str.strip, pieces), pieces), bool, len(pieces)) & np.fromiter(map(bool, pieces), bool, len(pieces))


def _apart(pieces: list[str], raw: list[bytes], bare: np.ndarray, encode, own: list[bytes], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, how many each has, and whether their bytes are a space and the piece's own bytes (raw); none if not.

    Bare pieces are encoded many at a time, with the space between them that each begins with;
    the bytes tell their ids apart.
    """
    n, sound, get = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool), own.__getitem__
    sizes = 1 + np.fromiter(map(len, raw), np.int64, len(raw))
    each, rest = np.flatnonzero(bare), np.flatnonzero(~bare).tolist()
    rows = [each[k : k + TOGETHER] for k in range(0, len(each), TOGETHER)]
    found, places = [_NONE], [_NONE]
    for some, ids in zip(rows, encode([" ".join([pieces[k] for k in some]) for some in rows])):
        if b"".join(map(get, ids)) == b" " + b" ".join([raw[k] for k in some]):
            flat = np.array(ids, np.int64)
            ends = np.concatenate([[0], np.cumsum(widths[flat])])
            wanted = np.concatenate([[0], np.cumsum(sizes[some])])
            at = np.searchsorted(ends, wanted)
            if (ends[at] == wanted).all():
                n[some], sound[some] = np.diff(at), True
                found.append(flat)
                places.append(some)
                continue
        rest += some.tolist()
    for k, ids in zip(rest, encode([pieces[k] for k in rest])):
        if pieces[k] != "" and b"".join(map(get, ids)) == b" " + raw[k]:
            n[k], sound[k] = len(ids), True
            found.append(np.array(ids, np.int64))
            places.append(np.array([k]))
    ids, place = np.concatenate(found), np.concatenate(places)
    if rest:
        ids = ids[np.argsort(np.repeat(place, n[place]), kind="stable")]
    return ids, n, sound


class Aligner:
    """Of one worker: its pieces, and a DuckDB with their links."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.a, self.b, self.bytes_a, self.bytes_b = _tokenizers(path_a, path_b)
        self.widths = [np.array([len(x) for x in each], np.int64) for each in (self.bytes_a, self.bytes_b)]
        self.duck = duckdb.connect(config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.codes, self.size = _Codes(), 0
        self.cut = np.zeros(0, bool)  # whether a piece may have been cut beside white space
        self.groups = pa.array([], pa.large_string())  # of a piece, as text
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of a piece; zeros: it is not given back
        self.again = np.zeros(0, np.int32)  # slices that met a piece again
        self.duck.execute("CREATE OR REPLACE TABLE links (piece INTEGER, pair BIGINT)")

    def forget(self) -> None:
        """Leaves half of the pieces that may be known, those that most slices met again; they get new numbers."""
        keep = np.sort(np.argsort(-self.again, kind="stable")[: KNOWN_PIECES // 2])
        keep = keep[self.again[keep] > 0]
        places = np.full(len(self.again), -1)
        places[keep] = np.arange(len(keep))
        known = [(piece, code) for piece, code in zip(self.codes, places[np.fromiter(self.codes.values(), np.int64, len(self.codes))].tolist()) if code >= 0]
        facts, cut, groups = self.facts[keep], self.cut[keep], self.groups.take(pa.array(keep))
        size = sum(len(p if isinstance(p, str) else p[0]) for p, _ in known) + groups.nbytes
        if size > KNOWN_BYTES // 2:
            return self.clear()
        self.codes, self.size, self.facts, self.cut, self.groups = _Codes(known), size, facts, cut, groups
        self.again = np.zeros(len(keep), np.int32)
        self.duck.register("kept", pa.table({"piece": keep.astype(np.int32), "place": np.arange(len(keep), dtype=np.int32)}))
        self.duck.execute("CREATE OR REPLACE TABLE links AS SELECT place AS piece, pair FROM links JOIN kept USING (piece) ORDER BY place")
        self.duck.unregister("kept")

    def _add(self, pieces: list[str]) -> None:
        """Aligns pieces, each as a text of its own; they get the next numbers."""
        first = len(self.facts)
        raw = [p.encode() for p in pieces]
        bare = _bare(pieces)
        *own_a, sound_a = _apart(pieces, raw, bare, lambda texts: [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.bytes_a, self.widths[0])
        *own_b, sound_b = _apart(pieces, raw, bare, lambda texts: self.b.encode(texts, num_threads=1), self.bytes_b, self.widths[1])
        sound = sound_a & sound_b
        facts, texts = np.zeros((len(pieces), 4), np.int64), pa.nulls(0, pa.large_string())
        at = np.flatnonzero(sound)
        if len(at):
            tokens, piece, starts = [], [], []
            for side, (name, (ids, n)) in enumerate((("a", own_a), ("b", own_b))):
                flat, n = ids[np.repeat(sound, n)], n[at]
                width = self.widths[side][flat]
                ends = np.cumsum(width)
                facts[at, side] = n
                tokens.append(flat)
                starts.append(ends - width)
                piece.append(np.repeat(np.arange(len(at)), n))
                self.duck.register(name, pa.table({"k": np.arange(len(flat)), "id": flat, "s": starts[-1], "e": ends, "piece": (first + at[piece[-1]]).astype(np.int32)}))
            self.duck.execute(_JOINS.format(base=len(self.bytes_b)))
            facts[at, 3] = self.duck.execute(_LINKS, [first]).fetchnumpy()["n"]
            closes = self.duck.execute(_CLOSES).fetchnumpy()["e"]
            groups = [np.searchsorted(closes, s, "right") for s in starts]
            texts, facts[at, 2] = self._texts(tokens, groups, piece)
        self.groups = pa.concat_arrays([self.groups, texts.take(pa.array(np.where(sound, np.cumsum(sound) - 1, -1), mask=~sound))])
        self.facts = np.concatenate([self.facts, facts])
        self.size += sum(map(len, pieces)) + texts.nbytes

    def _texts(self, tokens: list[np.ndarray], groups: list[np.ndarray], piece: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """The groups of each piece as one text, and how many there are: a group's tokens of A, then those of B."""
        ids, piece, group = np.concatenate(tokens), np.concatenate(piece), 2 * np.concatenate(groups)
        group[len(tokens[0]) :] += 1
        order = np.argsort(group, kind="stable")  # groups are numbered through all pieces
        ids, piece, group = ids[order], piece[order], group[order]
        last, closes = np.diff(group, append=-1) != 0, np.diff(piece, append=-1) != 0
        behind = np.where(closes, 3, np.where(last, 1 + group % 2, 0))
        parts = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.large_string()), pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(behind)), _JOINT)
        ends = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        n_groups = np.bincount(piece[last & (group % 2 == 1)], minlength=len(ends) - 1)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), parts), _JOINT), n_groups

    def slice(self, texts: pa.Array) -> dict:
        """Facts of some texts, their pieces with how often, and the slice's own links and partial counts."""
        if len(self.facts) > KNOWN_PIECES or self.size > KNOWN_BYTES:
            self.forget()
        before, code = len(self.facts), self.codes.__getitem__
        docs = [np.fromiter(map(code, t.split(" ")), np.int64) if (t := text.as_py()) else _NONE for text in texts]
        new = self.codes.take_new()
        self.cut = np.concatenate([self.cut, ~_bare(new)])
        if self.cut.any():
            # a space beside other white space ends no piece: such texts are cut by the rule, and pieces of theirs are told from the others
            for k, own in enumerate(docs):
                if self.cut[own].any():
                    parts = SPACE.split(texts[k].as_py())
                    docs[k] = np.fromiter((code(p if b else (p,)) for p, b in zip(parts, _bare(parts))), np.int64, len(parts))
            more = self.codes.take_new()
            self.cut = np.concatenate([self.cut, np.zeros(len(more), bool)])
            new += more
        if new:
            for k in range(0, len(new), ADDED):
                self._add([p if isinstance(p, str) else p[0] for p in new[k : k + ADDED]])
        unsound = (self.facts[:, 0] == 0) & ~self.cut
        if unsound.any():
            for k, own in enumerate(docs):
                if unsound[own].any():
                    if len(own) > 1:  # tokenized whole, as a piece of its own that no other text finds
                        self.codes.skip()
                        self.cut = np.append(self.cut, False)
                        self._add([texts[k].as_py()])
                        own = np.array([len(self.facts) - 1])
                    docs[k] = own if self.facts[own[0], 0] else _NONE
        n = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else _NONE
        upto = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[flat], axis=0)])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto), self.groups.take(pa.array(flat))), pa.scalar(";", pa.large_string()))
        keys, times = np.unique(np.repeat(np.arange(len(docs)), n) * (len(self.facts) + 1) + flat, return_counts=True)
        doc, piece = np.divmod(keys, len(self.facts) + 1)
        own, local = np.unique(piece, return_inverse=True)
        self.again = np.append(self.again, np.zeros(len(self.facts) - before, np.int32))
        self.again[own[: np.searchsorted(own, before)]] += 1
        self.duck.register("occurs", pa.table({"doc": doc.astype(np.int32), "piece": piece.astype(np.int32)}))
        counts, links = self.duck.execute(_COUNTS).fetchnumpy(), self.duck.execute(_OWN_LINKS).fetchnumpy()
        return {
            "facts": sums[upto[1:]] - sums[upto[:-1]],
            "sha256": [hashlib.sha256(t.as_buffer()).hexdigest() if m else "" for t, m in zip(joined.cast(pa.large_binary()), n)],
            "ends": np.searchsorted(doc, np.arange(len(docs) + 1)), "pieces": local, "times": times,
            "pair": counts["pair"], "docs": counts["docs"],
            "links": np.bincount(np.searchsorted(own, links["piece"]), minlength=len(own)), "link_pair": np.searchsorted(counts["pair"], links["pair"]),
        }


FACTS = ["n_a", "n_b", "n_groups", "n_links"]
_LISTS = {"pieces": "int", "times": "int", "pair": "bigint", "docs": "int", "links": "int", "link_pair": "int"}
SLICES = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ", ".join(f"{n} array<{k}>" for n, k in _LISTS.items())


def _align(path_a: str, path_b: str):
    kinds = {n: pa.list_(pa.int64() if k == "bigint" else pa.int32()) for n, k in _LISTS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = only(("align", path_a, path_b), lambda: Aligner(path_a, path_b)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                got, m = aligner.slice(texts), len(texts)
                # the documents, and behind them a row of what they share
                columns = [pa.array([number] * (m + 1), pa.int64()), pa.concat_arrays([batch.column("doc_id").slice(at, m), pa.nulls(1, pa.int64())])]
                columns += [pa.array([*got["facts"][:, k].tolist(), None], pa.int64()) for k in range(4)] + [pa.array([*got["sha256"], None], pa.string())]
                for name, kind in kinds.items():
                    values = pa.array(got[name].astype(np.int64)).cast(kind.value_type)
                    if name in ("pieces", "times"):
                        lists = [pa.ListArray.from_arrays(pa.array(got["ends"], pa.int32()), values), pa.nulls(1, kind)]
                    else:
                        lists = [pa.nulls(m, kind), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
                    columns.append(pa.concat_arrays([x.cast(kind) for x in lists]))
                yield pa.RecordBatch.from_arrays(columns, ["slice", "doc_id", *FACTS, "groups_sha256", *kinds])
                number += 1

    return run


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Slices of documents with their pieces, links and partial pair counts, stored."""
    rows = spread(whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return durable(rows.mapInArrow(_align(path_a, path_b), SLICES), "slices")


def pair_counts(aligned: DataFrame, path_b: str) -> DataFrame:
    """id_a, id_b, pair, docs (how many documents hold it linked) and best (whether no pair of id_a is in more), stored."""
    from sentencepiece import SentencePieceProcessor

    base = SentencePieceProcessor(model_file=path_b).get_piece_size()
    partial = aligned.where("pair is not null").select(F.inline(F.arrays_zip("pair", "docs")))
    totals = durable(partial.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("id_a", F.expr(f"pair div {base}")), "totals")
    most = totals.groupBy("id_a").agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    return totals.join(F.broadcast(most), "id_a").select("id_a", (F.col("pair") % base).alias("id_b"), "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(own: pa.Table, totals: pa.Table) -> pa.Table:
    """Documents of a slice with the sums of its pairs' totals over their links."""
    shared = own.filter(pc.is_valid(own.column("pair")))
    docs = own.filter(pc.is_null(own.column("pair")))
    flat = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy()
    at = totals.column("pos").to_numpy()
    values = np.zeros((len(flat(shared, "pair")), 2), np.int64)
    values[at, 0], values[at, 1] = totals.column("best").cast(pa.int64()).to_numpy(), totals.column("docs").to_numpy()
    linked, links = values[flat(shared, "link_pair")], flat(shared, "links")  # links in order of their pieces, each of which has one
    a_piece = np.add.reduceat(linked, np.cumsum(links) - links, axis=0) if len(links) else linked
    upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(a_piece[flat(docs, "pieces")] * flat(docs, "times")[:, None], axis=0)])
    n = pc.list_value_length(docs.column("pieces").combine_chunks()).to_numpy()
    ends = np.concatenate([[0], np.cumsum(n)])
    sums = upto[ends[1:]] - upto[ends[:-1]]
    return pa.table([*(docs.column(c) for c in ("doc_id", *FACTS)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), docs.column("groups_sha256")], ["doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"])


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each document: its facts, and what its links count corpus-wide."""
    pairs = aligned.where("pair is not null").select(F.col("slice").alias("part"), F.posexplode("pair").alias("pos", "pair"))
    totals = pairs.join(counts.select("pair", "docs", "best"), "pair").select("part", "pos", "docs", "best")
    own = aligned.drop("docs")
    return own.groupBy("slice").cogroup(totals.groupBy("part")).applyInArrow(_scored, RESULT)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Facts of every document's alignment by the byte-level tokenizer of path_a and the piece model of path_b."""
    aligned = align(docs, path_a, path_b)
    return score(aligned, pair_counts(aligned, path_b))
