import inspect
import re

import pytest
from pyspark.sql import functions as F

from loopweave.llm import mixing


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by the rule as it is told: stop at the cap, share the excess, repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, whole = set(), share * sum(sizes.values())
    while True:
        left = whole - sum(most * sizes[n] for n in full)
        free = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / free for n in names}
        over = {n for n in names if n not in full and target[n] > most * sizes[n]}
        if not over:
            return target
        full |= over


def corpus(rnd, n=900):
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["b", "é", "z", "￿", "\U0001F600", None, ""])
        words = min(4000, int(rnd.paretovariate(0.9) * 5))
        rows.append((i, source, " \t".join(["w"] * words)))
    return rows + [(n, "b", None), (n + 1, "b", ""), (n + 2, "b", " \n"), (n + 3, "void", None)]


def test_targets_sizes_and_closeness(table, rnd):
    rows = corpus(rnd)
    got = mixing.mix(table("doc_id long, source string, text string", rows, 7)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    per = {}
    for d, s, _ in rows:
        per[s] = per.get(s, 0) + size[d]
    target = water(per, mixing.WEIGHTS)
    taken = dict.fromkeys(per, 0)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], per[r.source])
        assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in per:
        largest = max(size[d] for d, t, _ in rows if t == s)
        assert abs(taken[s] - target[s]) <= largest
    assert abs(taken["hot"] - target["hot"]) <= 0.01 * target["hot"]


def test_reruns_agree_whatever_the_partitions(table, rnd):
    rows = corpus(rnd, 300)
    runs = [sorted((r.doc_id, r.taken) for r in mixing.mix(table(
        "doc_id long, source string, text string", rows, parts)).collect()) for parts in (1, 6)]
    assert runs[0] == runs[1]


def test_rounding_keeps_words_and_expectations(spark):
    """Meetings in a tree of several levels: the source's words stay, up to the last unit."""
    units = spark.range(9000).select(
        F.lit(1).cast("long").alias("place"), F.lit(10 ** 9).cast("long").alias("source_size"),
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("copy"),
        (F.col("id") % 13 + 1).alias("size"), F.lit(0.3).alias("p"))
    got = mixing.rounded(units).collect()
    assert sorted(r.doc_id for r in got) == list(range(9000)) and {r.extra for r in got} == {0, 1}
    words = sum((r.doc_id % 13 + 1) * r.extra for r in got)
    assert abs(words - 0.3 * sum(i % 13 + 1 for i in range(9000))) <= 13
    # No size class is preferred.
    for k in range(13):
        share = [r.extra for r in got if r.doc_id % 13 == k]
        assert 0.22 < sum(share) / len(share) < 0.38


def test_the_mix_itself(table, rnd):
    rows = [(d, s, t, i) for i, (d, s, t) in enumerate(corpus(rnd, 200))]
    rows += [rows[0]] * 3 + [(None, "b", "null id", 5)]
    docs = table("doc_id long, source string, text string, copies int", rows)
    plan = mixing.mix(docs)
    assert plan.count() == len(rows)
    want = {r[0]: r[1] for r in plan.groupBy("doc_id").agg(F.sum("copies")).collect() if r[1]}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == want


def close(got, rows):
    """One row for each document; each source's words within one document of its target."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.source, r.size) for r in got) == sorted(
        (str(d), s, size(t)) for d, s, t in rows)
    per = {}
    for d, s, t in rows:
        per[s] = per.get(s, 0) + size(t)
    target = water(per, mixing.WEIGHTS)
    for source in per:
        mine = [r for r in got if r.source == source]
        assert {round(r.target, 6) for r in mine} == {round(target[source], 6)}
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[source]) <= max(r.size for r in mine)


def test_one_id_with_several_sizes(table):
    rows = [(1, "a", "x y"), (1, "a", "x y z"), (1, "b", "x"), (2, "a", "p q"), (2, "a", "p q")]
    close(mixing.mix(table("doc_id long, source string, text string", rows)).collect(), rows)


def test_many_documents_without_an_id(table):
    rows = [(None, "a", " ".join(["w"] * (1 + i % 61))) for i in range(300)]
    rows += [(i, "b", "one two three") for i in range(100)]
    got = mixing.mix(table("doc_id long, source string, text string", rows)).collect()
    assert len(got) == 400
    close(got, rows)
    mixed = mixing.mixed(table("doc_id long, source string, text string", rows)).collect()
    words = {s: sum(len((r.text or "").split()) for r in mixed if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert abs(words["a"] - target["a"]) <= 61 and abs(words["b"] - target["b"]) <= 3


def test_a_hot_id(table):
    """A third of all rows share an id, half of these wholly."""
    rows = [(7, "a", "same text here")] * 100 + [(7, "a", " ".join(["v"] * (i + 1)))
                                                for i in range(100)]
    rows += [(1000 + i, "a" if i % 2 else "b", "w " * (i % 17)) for i in range(400)]
    docs = table("doc_id long, source string, text string", rows, 9)
    got = mixing.mix(docs).collect()
    close(got, rows)
    mixed = mixing.mixed(docs).collect()
    for source in "ab":
        assert sum(len(r.text.split()) for r in mixed if r.source == source) == sum(
            r.taken for r in got if r.source == source)


def test_empty_and_wordless_tables(table):
    docs = table("doc_id long, source string, text string", [])
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    docs = table("doc_id long, source string, text string", [(1, "a", None), (2, "b", " ")])
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2


def test_no_python_on_the_main_path():
    code = inspect.getsource(mixing)
    assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|numpy", code)
