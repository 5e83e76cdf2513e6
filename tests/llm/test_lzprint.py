"""op8_lzprint: slices of texts against single texts parsed over strings, and its CPU seconds against the bare parse."""

import hashlib
import random
import time
from types import SimpleNamespace

import pyarrow as pa

from historian_spark.llm import lzprint


def prose(seed, n, alphabet="etaoinshrdlu "):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def plain(text):
    known, at, mask = {""}, 0, (1 << 64) - 1
    while at < len(text):
        to = at + 1
        while to <= len(text) and text[at:to] in known:
            to += 1
        if to > len(text):
            break
        known.add(text[at:to])
        at = to
    bins = {}
    for phrase in known - {""}:
        h = 0x9E3779B97F4A7C15
        for c in phrase:
            h = ((h ^ ord(c)) * 0x100000001B3 + 0x632BE59BD9B4E019) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = ((h ^ (h >> shift)) * factor) & mask
        h ^= h >> 31
        bins[h >> 58] = min(bins.get(h >> 58, mask), h & ((1 << 58) - 1))
    far = [next(j for j in range(64) if (k + j) % 64 in bins) for k in range(64 if bins else 0)]
    return "".join(f"{(bins[(k + j) % 64] + j * 0xD1B54A32D192ED03) & 0xFFFF:04x}" for k, j in enumerate(far))


def test_slices_of_a_range(monkeypatch):
    texts = ["", "a", prose(1, 300), "x" * 9000, "日本語 😀" * 40, prose(2, 40, "абвгде "), "é", "", "", prose(3, 5), prose(1, 300), "\x00\x01" * 30, "ab", prose(4, 900, "aé日😀 ")]
    monkeypatch.setattr(lzprint, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    whole = [plain(t) for t in texts]
    want = []
    for k, (t, after) in enumerate(zip(texts, texts[1:])):
        changed = lzprint.edited(t, after)
        want.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), whole[k], plain(changed), lzprint.likeness(whole[k], plain(changed)), lzprint.likeness(whole[k], whole[k + 1])))
    for size in (1, 2000, 1 << 20):
        monkeypatch.setattr(lzprint, "SLICE_BYTES", size)
        batches = [pa.RecordBatch.from_arrays([pa.array(range(at, to)), pa.array(texts[at:to])], ["doc_id", "text"]) for at, to in ((0, 1), (1, 1), (1, 9), (9, len(texts)))]
        got = [tuple(r.values()) for b in lzprint._walk(iter(batches)) for r in b.to_pylist()]
        assert [r[:7] for r in got[:-1]] == want
        assert got[-1][7:] == (7, texts[0], whole[0], len(texts) - 1, texts[-1])
    (alone,) = [tuple(r.values()) for b in lzprint._walk(iter(batches[:1])) for r in b.to_pylist()]
    assert alone[7:] == (7, "", "", 0, "") and list(lzprint._walk(iter([]))) == []


def test_few_seconds_beside_the_bare_parse(monkeypatch):
    """Hashes and minima of many texts cost less than their phrases (both were taken text by text: three times the parse)."""
    monkeypatch.setattr(lzprint, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [prose(k, 450) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])

    def bare():
        for t in texts:
            for part in (t, t[: len(t) // 2]):  # as many signs as a text and half an edited one
                known, node = {}, 0
                get = known.get
                for c in part.encode("latin-1"):
                    key = node + c
                    node = get(key)
                    if node is None:
                        known[key] = len(known) + 1 << 7
                        node = 0

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    runs = [(seconds(lambda: list(lzprint._walk(iter([batch])))), seconds(bare)) for _ in range(7)]
    assert min(x for x, _ in runs) < 2 * min(y for _, y in runs)
