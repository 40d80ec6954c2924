"""Importance resampling against a plain model, and its rare inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from loopweave.llm import importance_resampling as ir

DOCS = "doc_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets(text, n=ir.BUCKETS):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % n
            for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def model(docs, target, percent=5, least=20, seed=42):
    s = Counter(b for _, t in docs for b in buckets(t))
    t = Counter(b for x in target for b in buckets(x))
    S, T, n = sum(s.values()), sum(t.values()), ir.BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n))))
            for b in range(n)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(buckets(text)), weight, weight + noise, None])
    fit = sorted((r for r in out if r[1] >= least),
                 key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score",
                                        "rank")) for r in df.collect()), key=repr)


def corpus(rnd, n=300):
    vocabulary = ["Alpha", "bé", "漢字", "x1", "don't", "tail", "é" * 20, "b" * 70] + [
        f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 25, 60]))))
            for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " -- "), (n + 3, "one\x00two\tTHREE"),
                   (None, "null id " * 15)]


def test_equals_the_plain_model(table, rnd):
    docs, target = corpus(rnd), [t for _, t in corpus(rnd, 9)]
    items = table("text string", [(t,) for t in target])
    for percent, least in ((5, 20), (50, 1), (100, 0)):
        assert got(ir.draw(table(DOCS, docs), items, percent, least)) == model(
            docs, target, percent, least)


def test_matrices_and_single_crcs_agree(rnd):
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(5000)), np.uint8)
    starts = np.array([rnd.randrange(4000) for _ in range(900)])
    lengths = np.array([rnd.choice([0, 1, 2, 9, 30, 31, 999, rnd.randrange(1, 900)])
                        for _ in range(900)])
    want = [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]
    lengths_of = lengths > 0
    assert ir.crcs(data, starts[lengths_of], lengths[lengths_of]).tolist() == [
        w for w, k in zip(want, lengths_of) if k]


def test_texts_longer_than_a_stretch(table, monkeypatch):
    """Features that cross the stretches count once; a word may be longer than one."""
    monkeypatch.setattr(ir, "STRETCH", 64)
    ir._TABLES.clear()
    docs = [(1, "ab cd Ef " * 400), (2, "z" * 500 + " y " + "x" * 300 + " end")]
    docs += [(i, f"left {i} right") for i in range(3, 60)]
    assert got(ir.draw(table(DOCS, docs), table("text string", [("cd ef ab",)]), 50, 3)) == model(
        docs, ["cd ef ab"], 50, 3)
    ir._TABLES.clear()


def test_words_do_not_join_over_chunks():
    raw = np.frombuffer(b"one  Two\nthree;four\n", np.uint8)
    for chunk in (1, 2, 3, 7, 100):
        data, starts, places = ir.spaced_words(raw, chunk)
        assert data.tobytes() == b"one two three four "
        assert starts.tolist() == [0, 4, 8, 14, 19] and places.tolist() == [0, 5, 9, 15]


def test_ties_repeats_and_a_hot_row(table):
    same = "the same words again " * 6
    docs = [(7, same)] * 150 + [(i, same) for i in range(100, 250)]
    rows = got(ir.draw(table(DOCS, docs, 8), table("text string", [("same",)]), 40))
    assert rows == model(docs, ["same"], 40)
    assert sorted(r[5] for r in rows if r[5]) == list(range(1, 121))


def test_resample_returns_whole_rows(table, rnd):
    docs = [(i, t, "s", 1.5, None) for i, t in corpus(rnd)]
    schema = "doc_id long, text string, score string, rank double, _row int"
    target = table("text string", [("w1 w2 w3",)])
    out = ir.resample(table(schema, docs), target, 20)
    assert out.columns == ["doc_id", "text", "score", "rank", "_row"]
    want = {r[0] for r in model([d[:2] for d in docs], ["w1 w2 w3"], 20) if r[5]}
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, want))


def test_empty_tables(table):
    none, one = table(DOCS, []), table(DOCS, [(1, "a b c")])
    items = table("text string", [])
    assert ir.draw(none, items).count() == 0 and ir.resample(none, items).count() == 0
    assert got(ir.draw(one, items)) == model([(1, "a b c")], [])
