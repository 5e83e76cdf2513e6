"""Line-first quality rules: lines that fail go, and documents that lose too much text go with them.

A word is a run of signs other than space and the controls 9 to 13; a line is what stands between
line feeds; only lines with a word are judged. A line fails

* punctuation: it neither ends in a mark that ends or carries on a sentence nor holds the end of
  one, or it has a symbol for every fourth word, or an exclamation mark for every second;
* navigation: separators of menus stand between at most five words each, twice or more;
* boilerplate: it holds a stock phrase, repeats an earlier line of the text, or is a banner of
  twenty or more letters, four fifths of them capitals.

The cleaned text is the lines that are left. A document is kept if it passes the base rules (ten
words or more, at most a fifth of its words in repeated windows of five words) and the lines that
failed hold at most MAX_LOST of its words.

Everything is counted in Arrow and numpy over slices of some texts, on the scan's own partitions:
nothing is shuffled, and no text meets another.

Cases: a null or empty text has no words, so it fails the base; null doc_ids are kept; repeated
rows are judged each by itself; a text may be of any length, and is held whole by its worker;
equal windows are told exactly, not by hashes; an empty table gives no rows; other columns of the
documents stay as they are in ``clean`` and are ignored in ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, spread, unused, whole_text

SLICE_BYTES = 8 << 20
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20  # per cent of the words
MAX_LOST = 30  # per cent of the words, in lines that fail

#: Patterns of RE2, which DuckDB shares.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|»›·•]"
ENDING = r"""[.!?…:;,"')\]»”’。！？，、：；।؟][\x20\x09-\x0D]*\z|[.!?…。！？।؟][\x20\x09-\x0D]"""
CAPITAL, LETTER = r"\p{Lu}", r"\p{L}"
STOCK = r"(?i)lorem ipsum|all rights reserved|privacy policy|terms of (use|service)|cookie policy|uses? cookies|enable javascript|click here|skip to (main )?content|sign up for our newsletter|subscribe to our|share (this|on) (facebook|twitter)|copyright (©|\(c\))"

FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values as equal numbers."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs of numbers below 2^31 as equal numbers below their count."""
    return _codes(pa.array((a << 32) | b))


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that stand in a window of WINDOW words found twice or more in it; words are numbers, in order of doc."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])  # windows within one document
    two = _pairs(words[:-1], words[1:])
    four = _pairs(two[:-2], two[2:])
    window = _pairs(_pairs(four[at], words[at + 4]), doc[at])
    again = at[np.bincount(window)[window] > 1] if len(at) else at
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + WINDOW, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=n_docs)


def judged_lines(texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """Of every line of the texts: doc, line, words, chars (of words), symbols, again (repeats an earlier one) and failed."""
    lists = pc.split_pattern(texts, "\n")
    line = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    count = lambda pattern: pc.count_substring_regex(line, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    fits = lambda pattern: pc.match_substring_regex(line, pattern).to_numpy(zero_copy_only=False)
    words, symbols, separators, capitals, letters = count(WORD), count(SYMBOL), count(SEPARATOR), count(CAPITAL), count(LETTER)
    chars = pc.utf8_length(line).to_numpy(zero_copy_only=False) - count(SPACE)
    again = np.ones(len(doc), bool)
    again[np.unique(_pairs(_codes(line), doc), return_index=True)[1]] = False
    again &= words > 0
    punctuation = ~fits(ENDING) | (4 * symbols >= words) | (2 * count("!") >= words)
    navigation = (separators >= 2) & (5 * separators >= words)
    boilerplate = again | fits(STOCK) | ((letters >= 20) & (5 * capitals >= 4 * letters))
    return {"doc": doc, "line": line, "words": words, "chars": chars, "symbols": symbols, "again": again, "failed": (words > 0) & (punctuation | navigation | boilerplate)}


def measured(texts: pa.Array, cleaned: bool) -> dict[str, np.ndarray | pa.Array]:
    """Of every text the base's counts, its verdicts, the words lost with lines, and if asked what the lines leave."""
    n, own = len(texts), judged_lines(texts)
    per_doc = lambda values: np.bincount(own["doc"], values, minlength=n).astype(np.int64)
    lists = pc.ascii_split_whitespace(texts)
    doc, word = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets))), lists.flatten()
    real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    out = {"n_words": per_doc(own["words"]), "word_chars": per_doc(own["chars"]), "n_symbols": per_doc(own["symbols"]), "n_dup_lines": per_doc(own["again"])}
    out["n_repeat_words"] = repeated_words(_codes(word)[real], doc[real], n)
    out["lost_words"] = per_doc(own["words"] * own["failed"])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["lost_words"] <= MAX_LOST * out["n_words"])
    if cleaned:
        left = ~own["failed"]
        ends = np.searchsorted(own["doc"][left], np.arange(n + 1))
        out["cleaned"] = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), own["line"].filter(pa.array(left))), pa.scalar("\n", pa.large_string())).cast(pa.string())
    return out


_KINDS = {n: "long" for n in [*FACTS, "lost_words"]} | {"base_failed": "boolean", "kept": "boolean", "cleaned": "string"}


def _run(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at, texts in slices(batch.column(at_text), SLICE_BYTES):
                got = measured(texts, "cleaned" in names)
                others = [c for k, c in enumerate(batch.slice(at, len(texts)).columns) if k != at_text]
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(got[n]) for n in names)], [*(x for x in batch.schema.names if x != "text"), *names])

    return run


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base's counts, lost_words (in lines that fail), base_failed and kept of every document."""
    names = [*FACTS, "lost_words", "base_failed", "kept"]
    rows = spread(whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return rows.mapInArrow(_run(names), "doc_id long, " + ", ".join(f"{n} {_KINDS[n]}" for n in names))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs, their failing lines taken out of text; n_chars, if there is one, is counted anew."""
    row = unused(docs, "row")
    # the row travels as one struct, so that none of its names can clash with those of the rules
    packed = spread(whole_text(docs, F.struct(*[column(c) for c in docs.columns if c != "text"]).alias(row)))
    kinds = T.StructType([packed.schema[row], T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())])
    found = packed.mapInArrow(_run(["kept", "cleaned"]), kinds).where("kept")
    own = {c: F.col(row).getField(c) for c in docs.columns if c != "text"} | {"text": F.col("cleaned")}
    if "n_chars" in own:
        own["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return found.select(*[own[c].alias(c) for c in docs.columns])


def sql() -> str:
    """judge as DuckDB says it."""
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    n = lambda pattern: f"len(regexp_extract_all(line, {q(pattern)}))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, regexp_extract_all(text, {q(WORD)}) AS words FROM d)),
    windows AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c, d, e) AS times FROM windows WHERE e IS NOT NULL) WHERE times > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range({WINDOW}) AS t(k) GROUP BY r),
    l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d)),
    counted AS (SELECT *, {n(WORD)} AS words, length(line) - {n(SPACE)} AS chars, {n(SYMBOL)} AS symbols, {n(SEPARATOR)} AS separators, {n(CAPITAL)} AS capitals, {n(LETTER)} AS letters, {n("!")} AS calls, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l),
    judged AS (SELECT *, words > 0 AND (NOT regexp_matches(line, {q(ENDING)}) OR 4 * symbols >= words OR 2 * calls >= words OR (separators >= 2 AND 5 * separators >= words) OR again OR regexp_matches(line, {q(STOCK)}) OR (letters >= 20 AND 5 * capitals >= 4 * letters)) AS failed FROM counted),
    facts AS (SELECT r, sum(words)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, count(*) FILTER (again AND words > 0) AS n_dup_lines, coalesce(sum(words) FILTER (failed), 0)::BIGINT AS lost_words FROM judged GROUP BY r),
    base AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_words FROM d JOIN facts USING (r) LEFT JOIN covered USING (r))
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, NOT base_failed AND 100 * lost_words <= {MAX_LOST} * n_words AS kept FROM base"""
