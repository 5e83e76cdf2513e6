"""op12_align against a brute force that encodes whole texts and compares all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from historian_spark.llm import align, common, queries  # noqa: E402

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def prose(seed, n, gap=(" ",)):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "ri", "mo", "ne", "Lu", "ka", "é", "tion", "7", "ß", "-", "'s"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return "".join(w + rng.choice(gap) for w in words)


def texts():
    odd = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\ta\t", "x y  z", "  q", "a\x1c b", "a \x1fb", "\x00", "a \x00 b", "<|endoftext|> and <s> </s> <unk> <0x41>"]
    odd += ["▁", "a▁b", "pure ▁words with▁ it", "日本語 のテキスト。", "😀 😀😀 👩‍👩‍👧 fin", "é é ﬁ Å", "don't we'll it's 'll", "1 22 333 4444 55555", "x" * 3000, "ab" * 500 + " " + "!?" * 300, "    indented\n        code()  # y", "A\r\nB\r\n", "end with space ", "﻿bom", "ا ل ع ر ب ي ة"]
    rows = list(enumerate(odd))
    rows += [(100 + k, prose(k % 25, 5 + 9 * (k % 25), gap) ) for k, gap in zip(range(60), [(" ",), (" ", "  ", "\n", " \n"), (" ", ", ", " ")] * 20)]
    return [*rows, (None, prose(3, 20)), (104, prose(4, 41)), (104, prose(4, 41)), (900, prose(77, 12_000))]


def tokens(text):
    """Ids with their byte ranges by both tokenizers, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    if "libraries" not in tokens.__dict__:
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        tokens.libraries = a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), letters
    a, b, letters = tokens.libraries
    if not text:
        return [], []
    out = []
    for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(letters[c] for c in a.id_to_token(k))), (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
        own, at = [], 0
        for k in ids:
            own.append((k, at, at + len(raw(k))))
            at += len(raw(k))
        if b"".join(map(raw, ids)) != (" " + text).encode():
            return [], []
        out.append(own)
    return out


def expected(rows):
    docs, holders = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        common_ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [",".join(str(k) for k, s, e in a if lo < e <= hi) + "|" + ",".join(str(k) for k, s, e in b if lo < e <= hi) for lo, hi in zip([0, *common_ends], common_ends)] if len(a) < 3000 else None
        links, j = Counter(), 0
        for k, s, e in a:
            while b[j][2] <= s:
                j += 1
            i = j
            while i < len(b) and b[i][1] < e:
                links[k, b[i][0]] += 1
                i += 1
        holders.update(links.keys())
        docs.append((doc_id, len(a), len(b), len(common_ends), links, groups))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    return [(d, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in links.items()), None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "") for d, na, nb, ng, links, groups in docs]


def run(spark, rows):
    common.ship(spark)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("slice", "pair", "docs", "n_a", "piece")}).repartition(3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "table", lambda s, d, t: table)
        df = queries.op12_align(spark, "")
    assert df.columns == COLUMNS and set(dict(df.dtypes).values()) == {"bigint", "string"}
    return [tuple(r) for r in df.collect()]


def test_op12(spark):
    got, want = run(spark, texts()), expected(texts())
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert sum(r[1] > 0 for r in want) > 75
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


def test_op12_of_little(spark):
    assert run(spark, []) == []
    assert sorted(run(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_slices_and_forgetting(spark, monkeypatch):
    """Small slices and a small table of pieces change nothing."""
    import pyarrow as pa

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = texts()
    monkeypatch.setattr(align, "KNOWN_PIECES", 40)
    aligner, want = align.Aligner(*paths), expected(rows)
    for k in range(0, len(rows), 3):
        got = aligner.slice(pa.array([t or "" for _, t in rows[k : k + 3]], pa.large_string()))
        for j, w in enumerate(want[k : k + 3]):
            assert tuple(got["facts"][j]) == w[1:5] and (w[7] is None or got["sha256"][j] == w[7])


def test_pieces_that_come_again_stay_known(monkeypatch):
    """Where a worker knows too many pieces it keeps those met again, with their links (all were aligned anew before)."""
    import pyarrow as pa

    rng, monkey = random.Random(5), monkeypatch.setattr
    usual = ["ordinary", "words,", "that", "don't", "vary.", "Größe", "日本語", "x\ny", "and", "and,", "né", "12.5"]
    slices = [[" ".join(rng.choices(usual, k=30) + [f"rare{rng.randrange(10**9)}" for _ in range(8)] + ["", "a", ""][: 3 * (j % 2)]) for j in range(4)] for _ in range(12)]
    monkey(align, "KNOWN_PIECES", 60)
    aligner = align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    added, add = [], aligner._add
    monkey(aligner, "_add", lambda pieces: (added.extend(pieces), add(pieces)))
    for texts in slices:
        got, holders = aligner.slice(pa.array(texts, pa.large_string())), Counter()
        upto = [0, *got["links"].astype(int).cumsum().tolist()]
        for k, text in enumerate(texts):
            a, b = tokens(text)
            want = Counter(x * len(aligner.bytes_b) + y for x, s, e in a for y, t, u in b if s < u and t < e)
            holders.update(want.keys())
            own = Counter()
            for piece, times in zip(*(got[n][got["ends"][k] : got["ends"][k + 1]].tolist() for n in ("pieces", "times"))):
                for at in got["link_pair"][upto[piece] : upto[piece + 1]].tolist():
                    own[int(got["pair"][at])] += times
            assert own == want and tuple(got["facts"][k][[0, 1, 3]]) == (len(a), len(b), sum(want.values()))
        assert dict(zip(got["pair"].tolist(), got["docs"].tolist())) == holders
        assert len(aligner.facts) == len(aligner.cut) == len(aligner.groups) == aligner.codes.n <= 60 + 4 * 12 + 20
    assert len(added) > 12 * 4 * 8 and max(Counter(p for p in added if p in usual).values()) == 1
