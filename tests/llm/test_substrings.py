"""Removal of repeated windows against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark import RDD

from loopweave.llm import substring_dedup as sd

DOCS = "doc_id long, text string"


def brute(rows, width):
    """Rows in corpus order: every word under a window whose words started earlier goes."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            if key in seen:
                gone.update(range(p, p + width))
            seen.add(key)
        kept = [x for i, x in enumerate(w) if i not in gone]
        spans, at = [], 0
        while at < len(w):
            if at in gone:
                end = at
                while end in gone:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((doc_id, len(w), len(gone), spans, " ".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept)
                   for r in df.collect()), key=repr)


def corpus(rnd, n=160, width=5):
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(width - 1, 4 * width)))
                for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages + [str(rnd.random()), "Ä ö ü", "a  b\t\nc"])
                 for _ in range(rnd.randint(0, 6))]
        rows.append((i * 3, rnd.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(n * 3, None), (n * 3 + 1, ""), (n * 3 + 2, " \t "), (-5, "a b c d e f g h")]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(table, rnd, parts):
    rows = corpus(rnd)
    for width in (1, 5, 20):
        want = brute(sorted(rows), width)
        assert got(sd.without_repeats(table(DOCS, rows, parts), width)) == want


def test_many_blocks(table, rnd, monkeypatch):
    """Partitions of several blocks, and blocks of one long text."""
    monkeypatch.setattr(sd, "BLOCK_BYTES", 200)
    monkeypatch.setattr(sd, "in_blocks", lambda rows, blocks=sd.in_blocks: blocks(rows, 200))
    rows = corpus(rnd, 120) + [(10_000, "x y z w v u " * 300), (10_001, "q " * 900)]
    assert got(sd.without_repeats(table(DOCS, rows, 2), 5)) == brute(sorted(rows), 5)


def test_a_passage_in_every_document(table, rnd):
    hot = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{i} own words {i} {hot} end {i}") for i in range(500)]
    out = got(sd.without_repeats(table(DOCS, rows, 9)))
    assert out == brute(rows, 20) and sum(r[2] for r in out) == 499 * 31


def test_exact_copies_keep_their_first(table):
    text = " ".join(map(str, range(40)))
    rows = [(4, text)] * 300 + [(9, text), (None, text), (None, "short one")]
    out = got(sd.without_repeats(table(DOCS, rows, 6)))
    assert sorted(r[2] for r in out) == [0, 0] + [40] * 301
    assert [r[2] for r in out if r[0] == 9] == [40]
    assert sorted(r[2] for r in out if r[0] is None) == [0, 40]


def test_one_id_with_two_texts(table):
    long = " ".join(map(str, range(30)))
    out = got(sd.without_repeats(table(DOCS, [(1, long), (1, long + " more")])))
    assert sorted(r[2] for r in out) in ([0, 30],)


def test_other_columns_and_empty_tables(table):
    clash = table("doc_id int, text string, kept int, hash string, row long, id string",
                  [(1, "a b", 1, "h", 2, "i")])
    assert got(sd.without_repeats(clash)) == [(1, 2, 0, [], "a b")]
    assert sd.without_repeats(table(DOCS, [])).collect() == []


def test_packing_is_a_round_trip():
    for n in (1, 2, 1000):
        hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        assert np.array_equal(sd.unpacked(sd.packed(hashes)), hashes)
    edge = np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)
    assert np.array_equal(sd.unpacked(sd.packed(edge)), edge)


def test_windows_stay_inside_texts():
    words = np.arange(1, 13, dtype=np.uint64)
    for first in ([0, 12], [0, 3, 3, 7, 12], [0, 0, 1, 2, 12], [0, 6, 12, 12]):
        for width in (1, 3, 6):
            _, places = sd.window_hashes(words, np.array(first), width)
            want = [p for a, b in zip(first, first[1:]) for p in range(a, b - width + 1)]
            assert places.tolist() == want


def test_partitions_follow_the_size_of_the_text(table, monkeypatch):
    monkeypatch.setattr(sd, "PARTITION_BYTES", 1000)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(400))) for i in range(100)]
    assert sd._partitions(table(DOCS, rows), "doc_id", "text").getNumPartitions() > 30


def test_the_last_pass_holds_one_python_worker(table, rnd, monkeypatch):
    """Zipped RDDs hold a worker for either side and one for their pairs, all at once."""
    def refuse(*_, **__):
        raise AssertionError("zipped")

    rows = corpus(rnd)
    df = table(DOCS, rows, 5)
    for name in ("zip", "glom", "union", "cogroup"):
        monkeypatch.setattr(RDD, name, refuse)
    assert got(sd.without_repeats(df, 5)) == brute(sorted(rows), 5)


def test_notes_go_through_the_shared_folder(tmp_path):
    written = dict(sd.noted(3, [(3, (0, b"a")), (3, (2, b"b")), (3, (0, b"c"))], str(tmp_path)))
    assert sd.read_notes(str(tmp_path), written[3]) == {0: [b"a", b"c"], 2: [b"b"]}
    assert not dict(sd.noted(4, [], str(tmp_path))) and sd.read_notes(str(tmp_path), None) == {}
