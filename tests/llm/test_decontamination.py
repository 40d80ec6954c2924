import hashlib
import re
import tracemalloc

import pyarrow as pa
import pytest

from loopweave.llm import decontamination as d
from loopweave.llm import words

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text, items, window=10):
    """(words, hit places, items) by comparing every window with every place."""
    own = re.findall(PATTERN, (text or "").lower())
    hit, names = set(), set()
    for item, content in items:
        w = re.findall(PATTERN, content.lower())
        n = min(window, len(w))
        wanted = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
        for p in range(len(own) - n + 1):
            if tuple(own[p:p + n]) in wanted:
                hit.update(range(p, p + n))
                names.add(item)
    return len(own), hit, names


@pytest.mark.parametrize("limit", [5, 11, 37, 1 << 19])
def test_matches_equal_brute_force(rnd, limit):
    for _ in range(60):
        size = rnd.choice([1, 2, 3, 50])

        def text(n):
            return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))

        items = [(i, text(rnd.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(rnd.randrange(7))]
        docs = [f"{text(rnd.choice([0, 1, 5, 60]))} {rnd.choice(items)[1] if items else ''} "
                f"{text(rnd.choice([0, 4]))}" for _ in range(rnd.randrange(1, 8))]
        windows = d.Windows([i for i, _ in items], [t for _, t in items], 10)
        got = d.matches_of(*words.words_of(pa.array(docs), words.ALNUM), windows, limit)
        for k, content in enumerate(docs):
            n, hit, names = brute(content, items)
            covered = {q for _, _, p, l in got.get(k, []) for q in range(p, p + l)}
            assert (covered, {m[0] for m in got.get(k, [])}) == (hit, names)


def test_matches_are_the_longest_at_their_places(rnd):
    for _ in range(60):
        size = rnd.choice([1, 2, 30])

        def text(n):
            return [f"w{rnd.randrange(size)}" for _ in range(n)]

        items = [text(rnd.choice([2, 10, 14, 30])) for _ in range(rnd.randrange(1, 5))]
        doc = text(5) + rnd.choice(items) + text(rnd.choice([0, 20]))
        windows = d.Windows(list(range(len(items))), [" ".join(i) for i in items], 10)
        got = d.matches_of(*words.words_of(pa.array([" ".join(doc)]), words.ALNUM), windows, 17)
        matches = got.get(0, [])
        for item, start, at, n in matches:
            assert doc[at:at + n] == items[item][start:start + n]
        longest = {}
        for at in range(len(doc)):
            for item in items:
                for start in range(len(item)):
                    n = 0
                    while start + n < len(item) and doc[at + n:at + n + 1] == [item[start + n]]:
                        n += 1
                    if n >= 10 or start == 0 and n == len(item):
                        longest[at] = max(longest.get(at, 0), n)
        reach, wanted = -1, set()
        for at, n in sorted(longest.items()):
            if at + n > reach:
                wanted.add((at, n))
                reach = at + n
        assert wanted <= {(at, n) for _, _, at, n in matches}
        assert len(matches) <= len(wanted) + len(items)


def test_repeated_words_and_copied_items_take_memory_in_proportion_to_the_text():
    doc, item = "a " * 200_000, "a " * 2_000
    windows = d.Windows([*range(500), None], [item] * 500 + ["a " * 3_000], 10)
    assert len(windows.low) == 1
    tracemalloc.start()
    got = d.matches_of(*words.words_of(pa.array([doc]), words.ALNUM), windows)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {m[0] for m in got} == {*range(500), None}
    assert max(m[3] for m in got) == 3_000
    assert len(got) <= 200_000 + 501 and peak < 400 << 20


def test_suffix_array_is_sorted_to_its_depth(rnd):
    import numpy as np
    for _ in range(50):
        t = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 60))], dtype=np.uint64)
        order = d.suffix_array(t, 16)
        keys = [tuple(t[i:i + 16].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)


PASSAGE = " ".join(f"p{i}" for i in range(14))
ITEMS = [(7, PASSAGE), (12, "Two Words"), (12, "other short one"), (None, "x y"), (5, None),
         (6, " .,")]
DOCS = [(1, None, "a"), (2, "", "a"), (3, f"start {PASSAGE.upper()} end, two-words.", None),
        (4, "p0 p1 p2 p3 p4 p5 p6 p7 p8", "b"), (5, "w " * 30_000 + PASSAGE, "b"),
        (3, f"start {PASSAGE.upper()} end, two-words.", None), (None, "TWO words x y", "c")]


def test_edge_cases_clashing_columns_and_filter(table):
    docs = table("doc_id long, text string, matches string", DOCS)
    bench = table("item_id long, text string", ITEMS)
    got = {(r.doc_id, r.n_words): r for r in d.contamination(docs, bench).collect()}
    assert d.contamination(docs, bench).count() == len(DOCS)
    assert got[1, 0].n_hit == 0 and not got[1, 0].contaminated
    assert got[1, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    three = got[3, 18]
    assert (three.n_hit, three.n_items) == (16, 2)
    assert three.items_sha256 == hashlib.sha256(b"12,7").hexdigest()
    assert not got[4, 9].contaminated
    assert got[5, 30_014].n_hit == 14
    assert (got[None, 4].n_hit, got[None, 4].n_items) == (4, 2)  # an item without an id is one
    assert got[None, 4].items_sha256 == hashlib.sha256(b"12").hexdigest()
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_places_of_the_longest_match(table):
    found = d.find_matches(table("doc_id long, text string", [(1, f"a b {PASSAGE} c")]),
                           table("item_id long, text string", [(7, f"z {PASSAGE}")])).first()
    assert [tuple(m) for m in found.matches] == [(7, 1, 2, 14)]


def test_a_large_benchmark_goes_in_pieces(table):
    docs = table("doc_id long, text string", [r[:2] for r in DOCS])
    bench = table("item_id long, text string", ITEMS)
    one = {(r.row.doc_id, r.n_words, tuple(sorted(map(tuple, r.matches), key=str)))
           for r in d.find_matches(docs, bench).collect()}
    many = {(r.row.doc_id, r.n_words, tuple(sorted(map(tuple, r.matches), key=str)))
            for r in d.find_matches(docs, bench, piece_bytes=20).collect()}
    assert one == many


def test_empty_tables(table):
    docs = table("doc_id long, text string", DOCS[:0])
    bench = table("item_id long, text string", ITEMS)
    assert d.contamination(docs, bench).count() == 0
    docs = table("doc_id long, text string", [r[:2] for r in DOCS])
    assert d.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
