"""op13_lines against SQL, plain Python and hard texts; cleaning keeps rows whole."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from historian_spark.llm import common, lines, queries  # noqa: E402

GOOD = "The first sentence stands here, and it is long enough to pass. Another one follows it at once."


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "be", "sea", "Ünder", "x|y", "#tag", "end.", "stop!", "日本", "é", "$", "..."])
    rows = [" ".join(word() for _ in range(rng.randint(0, 60))).replace(" a ", rng.choice(["\n", " a ", "\t", "\r\n", "\x0b", "\x1c", "\x85", " "])) for _ in range(150)]
    rows += [GOOD, "\n".join([GOOD] * 3), GOOD + "\nHome | About | News | Contact\n" + GOOD[::-1] + ".", "Home | About | Login\n" * 4, "BUY NOW AND SAVE MONEY TODAY.\n" + GOOD, "wow! " * 30, "a b c d e f g h i j.", "a b c d e f g h i."]
    rows += ["one two three four five " * 2, "one two three four five six one two three four five " + " ".join(map(str, range(40))) + ".", "same same same same same same", "a b c d e a b c d e a b c d e", "\n\n\n", " \t ", "\x00 \x00", "no end\nno end\nno end", "line.\nline. \nline.\n\nline."]
    rows += [" ".join(f"w{k % 7000}" for k in range(30_000)) + ".", "long\n" * 20_000, "y" * 200_000]
    return [*enumerate(rows), (900, None), (901, ""), (None, GOOD), (5, rows[5]), (5, rows[5])]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(*(words[k:] for k in range(5))))
    covered = {i + k for i, w in enumerate(zip(*(words[k:] for k in range(5)))) if windows[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"kept": F.lit("x"), "row": F.lit(1), "a b`c": F.lit(2), "n_chars": F.length("text")}).repartition(3).cache()


def judged(docs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "table", lambda s, d, t: docs)
        df = queries.op13_lines(None, "")
    assert {"n_words": "bigint", "base_failed": "boolean", "kept": "boolean"}.items() <= dict(df.dtypes).items()
    return df


def test_op13_base_in_plain_python(docs):
    got = sorted((tuple(r[c] for c in ("doc_id", *lines.FACTS, "base_failed")) for r in judged(docs).collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t in texts()), key=str)


def test_op13_equals_its_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts())
    rel = con.sql(lines.sql())
    df = judged(docs).select(*rel.columns)
    got = df.collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {150, 152, 154, None} <= kept and not {151, 153, 155, 157, 158, 160, 161, 900, 901} & kept


def test_cleaning(docs, spark):
    rows = lines.clean(docs)
    assert rows.columns == docs.columns
    by = {r["doc_id"]: r for r in rows.collect()}
    assert by[150]["text"] == GOOD and by[152]["text"] == GOOD + "\n" + GOOD[::-1] + "." and by[154]["text"] == GOOD
    assert all(r["n_chars"] == len(r["text"]) and (r["kept"], r["row"], r["a b`c"]) == ("x", 1, 2) for r in by.values()) and len(by) > 4
    none = docs.limit(0)
    assert lines.clean(none).count() == 0 and lines.judge(none).count() == 0
