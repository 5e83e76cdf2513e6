"""The stages of the pipeline, each against brute force on its own input, on rows that are hard for all of them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from historian_spark.llm import common, secrets, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
BAD = ("idiot", "scum", "moron")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for k in range(120):
        own = prose(k % 90, rng.randint(10, 150) if k < 90 else 100).split()
        own = prose(k, 100).split() if k < 30 else own
        if k % 6 == 0:
            own += [f"you {rng.choice(BAD)} {rng.choice(BAD)} !!!"] * 2
        if k % 9 == 1:
            own.insert(3, "password: hunter2hunter2")
        out.append((k, " ".join(own), "en", "s", 1))
    long = prose(999, 30_000)
    return [*out, (None, None, None, None, None), (None, prose(3, 40), "en", "s", 1), (None, prose(3, 40), "en", "s", 1), (200, "", "en", "s", 0), (201, " \n ", "en", "s", 3), (202, long, "en", "s", 1), (203, prose(5, 60), "en", "s", 1), (203, prose(5, 60), "en", "s", 1), (203, prose(6, 60), "en", "s", 1)]


def same(a, b):
    return Counter(map(str, a)) == Counter(map(str, b))


def test_stages(spark, rows, tmp_path):
    common.ship(spark)
    marks = [(r[0], 1, int(any(w in (r[1] or "") for w in BAD))) for r in rows if r[0] is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    extra = ("key", "score", "hash", "id", "none", "work", "text_hash", "odd name", "with.dot")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c.replace(".", "_"): F.lit("x") for c in extra}).withColumn("odd name", F.col("doc_id")).repartition(2)
    docs = common.durable(docs, "in")
    (_, toxic), (_, near), (_, marked), (_, pack) = corpus_pipeline.STAGES

    # toxicity: the model's sum over the features of a text, by hand
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    weight = dict(zip(model.features, model.weights))

    def score(text):
        times = Counter()
        for word in re.findall(r"\w+", " ".join(re.split(r"[ \t\n\r\f\v]+", text)).lower()):
            times.update([f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)])
        z = model.intercept + sum(weight.get(f, 0.0) + (weight.get(f"{f}~often", 0.0) if n >= 3 else 0.0) for f, n in times.items())
        return z + sum(w for w, p in zip(model.weights[len(model.features) :], toxicity.PATTERNS) if re.search(p, text))

    clean = common.durable(toxic(spark, docs, str(tmp_path)), "clean")
    before, after = docs.collect(), clean.collect()
    assert clean.dtypes == docs.dtypes and 0 < len(after) < len(before)
    assert same(after, [r for r in before if score(r["text"] or "") < 0])

    # near duplicates: one row of each class, by all pairs
    unique = common.durable(near(spark, clean, str(tmp_path)), "unique")
    bags = []
    for r in after:
        w = (r["text"] or "").lower().split()
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    group = list(range(len(after)))
    for a in range(len(after)):
        for b in range(a):
            either = (bags[a] | bags[b]).total()
            if group[a] != group[b] and (either == 0 or (bags[a] & bags[b]).total() >= 0.8 * either):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept = unique.collect()
    assert unique.dtypes == docs.dtypes and len(kept) == len(set(group)) < len(after)
    homes = {}
    for r, g in zip(after, group):
        homes.setdefault(str(r), g)
    assert len({homes[str(r)] for r in kept}) == len(kept)
    least = {g: min((r["doc_id"] for r, h in zip(after, group) if h == g and r["doc_id"] is not None), default=None) for g in group}
    assert all(r["doc_id"] == least[homes[str(r)]] for r in kept)

    # secrets: the spans of the operator, cut out by hand
    plain = common.durable(marked(spark, unique, str(tmp_path)), "plain")
    spans = {(r["doc_id"], r["n"]): r["spans"] for r in secrets.scan(unique).withColumn("n", F.lit(0)).collect()}
    expected = []
    for r in kept:
        t, found = r["text"], []
        for s in filter(None, spans[r["doc_id"], 0].split(",")):
            found.append(tuple(map(int, s.split(":")[1:])))
        at, out = 0, ""
        for a, b in sorted(found):
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        own = r.asDict()
        if found:
            own |= {"text": out + t[at:], "n_chars": len(out + t[at:])}
        expected.append(tuple(own.values()))
    # two rows may share a null or repeated doc_id, so spans are asked for rows with ids of their own only
    single = {i for i, n in Counter(r["doc_id"] for r in kept).items() if n == 1}
    final = plain.collect()
    assert plain.dtypes == docs.dtypes and len(final) == len(kept) and any("[secret]" in (r["text"] or "") for r in final)
    assert same([tuple(r) for r in final if r["doc_id"] in single], [e for e in expected if e[docs.columns.index("doc_id")] in single])

    # packing: every id in one place
    from tokenizers import Tokenizer

    known, want = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), Counter()
    for r in final:
        ids = [*known.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    packed = pack(spark, plain, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in packed) == want
