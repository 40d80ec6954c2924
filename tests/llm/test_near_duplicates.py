import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loopweave.llm import near_duplicates as nd
from loopweave.llm.components import components, joined


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        out.append({tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, width, percent=80):
    """(doc_id, set size, least reachable id) from all pairs that share a shingle."""
    sets, parent = sets_of(rows, width), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = {}
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rnd, n=25):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (8, "a b")]
    for _ in range(n):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 20, 60, 200]))]
        for _ in range(rnd.randint(1, 10)):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
            rows.append((100 + len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(table, rnd, width):
    rows = near_copies(rnd)
    got = nd.near_duplicates(table("doc_id long, text string", rows, 5), width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_chain_whose_ends_are_far_apart_is_one_component(table, rnd):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):  # each step replaces two more words
        base = list(base)
        for _ in range(2):
            base[rnd.randrange(120)] = f"c{i}-{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(base)))
    got = nd.near_duplicates(table("doc_id long, text string", rows), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_crowded_keys_lose_no_link(table, rnd, monkeypatch):
    """Hubs, further hubs and the last pairwise join settle all."""
    monkeypatch.setattr(nd, "sized", lambda df, rows: df)
    base = [f"w{i}" for i in range(90)]
    rows = near_copies(rnd, 6)
    for i in range(120):  # copies of one text, up to and beyond the bound from each other
        words = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            words[rnd.randrange(90)] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(words)))
    got = nd.near_duplicates(table("doc_id long, text string", rows, 5), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_pairs_within_the_guaranteed_distance_share_a_key(spark, rnd):
    """The pigeonhole bound: 2 * chunks - 1 components may differ, wherever they are."""
    rows = []
    for i in range(200):
        a = np.array([rnd.randrange(256) for _ in range(104)], dtype=np.uint8)
        b = a.copy()
        for p in rnd.sample(range(104), 2 * nd.CHUNKS - 1):
            b[p] ^= rnd.randrange(1, 256)
        for node, s in ((2 * i, a), (2 * i + 1, b)):
            longs = s.view(np.int64).tolist()
            rows.append((node, *longs))
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(
        f"s{i} long" for i in range(nd.CHUNKS)))
    keys = {}
    for r in nd.index_keys(nodes, nd.CHUNKS).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(200))
    assert all(len(k) == 104 for k in keys.values())


def test_every_pair_within_the_threshold_shares_a_key_and_one_counts_it(spark, rnd):
    rows, distances = [], [nd.FAR, nd.FAR, nd.FAR, 26, 20, 2, 1, 0]
    for i in range(200):
        a = np.array([rnd.randrange(256) for _ in range(104)], dtype=np.uint8)
        b = a.copy()
        for p in rnd.sample(range(104), distances[i % len(distances)]):
            b[p] ^= rnd.randrange(1, 256)
        rows += [(n, *s.view(np.int64).tolist()) for n, s in ((2 * i, a), (2 * i + 1, b))]
    names = [f"s{i}" for i in range(nd.CHUNKS)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} long" for c in names))
    keys = nd.index_keys(nodes, nd.CHUNKS, nd.ERRORS).join(nodes, "node")
    side = {k: keys.select(F.col("key").alias(k + "key"), F.col("node").alias(k), *[
        F.col(c).alias(f"_{k}{c}") for c in names]) for k in "ab"}
    met = side["a"].join(side["b"], F.col("akey") == F.col("bkey")).filter("a < b").withColumn(
        "key", F.col("akey"))
    got = [(r.a, r.b) for r in met.filter(nd._first_key(names)).collect()]
    assert sorted(got) == [(2 * i, 2 * i + 1) for i in range(200)]
    assert nd.FAR == 38


def test_the_condition_of_the_last_join_fits_generated_code(spark, rnd):
    names = [f"s{i}" for i in range(nd.CHUNKS)]
    longs = [*names, "n_shingles", *nd.PARITY_COLUMNS]
    signs = spark.createDataFrame([(n, *[7] * len(longs)) for n in (1, 2, 3)], "node long, " + ", ".join(
        f"{c} long" for c in longs))
    keys = nd.index_keys(signs, nd.CHUNKS, nd.ERRORS)
    mixed = keys.withColumn("root", F.greatest(F.col("node"), F.lit(2)))
    close = nd._close(nd.CHUNKS, nd.FAR, 80)
    settings = {"spark.sql.codegen.fallback": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = nd._apart(mixed, signs, nd.CHUNKS, close).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(1, 3), (2, 3)]


def test_rows_that_repeat_nulls_and_other_columns(table):
    long = "many words " * 20_000
    rows = [(5, "one two three", 1), (5, "one two three", 2), (9, "One two three", 3),
            (None, "one two three", 4), (None, "alone here", 5), (7, long, 6), (3, long, 7),
            (8, None, 8), (8, None, 9)]
    docs = table("doc_id long, text string, node int", rows)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect())
    assert got == Counter({(5, 5, True): 2, (9, 5, False): 1, (None, 5, False): 1,
                           (None, None, True): 1, (7, 3, False): 1, (3, 3, True): 1,
                           (8, 8, True): 2})
    kept = nd.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, 8, None, None]


def test_each_component_keeps_the_row_that_stands_for_it(table):
    copy, alone, other = "one two three four five six", "zeta eta theta iota", "alpha beta gamma"
    docs = table("doc_id long, text string, at int", [
        (2, copy, 1), (5, copy, 2), (5, alone, 3),   # id 5: a copy of 2, and a text of its own
        (7, other, 4), (7, "nothing like it at all", 5), (7, other, 6),
        (None, copy, 7), (None, "q r s t", 8), (None, "q r s t", 9), (None, "Q r s t", 10),
        (4, "m n o p", 11), (4, "M n o p", 12),      # equal sets under one id: the first by text
        (3, None, 13), (3, "", 14), (3, "", 15), (None, "", 16), (None, None, 17)])
    kept = sorted(r.at for r in nd.deduplicate(docs, unnamed_stay=False).collect())
    assert len([k for k in kept if k in (4, 6)]) == 1 and len([k for k in kept if k in (14, 15)]) == 1
    assert [k for k in kept if k not in (4, 6, 14, 15)] == [1, 3, 5, 10, 12, 13, 16, 17]
    stay = {r.at for r in nd.deduplicate(docs).collect()}
    assert stay == set(kept) | {7, 8, 9, 10}


def test_the_stage_of_the_pipeline_drops_copies_without_an_id(table, spark):
    docs = table("doc_id long, text string", [(5, "a copy of it"), (None, "a copy of it")])
    assert [r.doc_id for r in cp.near_duplicate_groups(spark, docs, "").collect()] == [5]


@pytest.mark.parametrize("hubs", [0.1, 2.0])
def test_copies_without_an_id_link(table, rnd, monkeypatch, hubs):
    """Sets that only rows without an id hold link like others, with and without further hubs."""
    monkeypatch.setattr(nd, "WORTHWHILE", hubs)
    base = [f"w{i}" for i in range(60)]
    near = lambda *places: " ".join(f"x{p}" if p in places else w for p, w in enumerate(base))
    rows = [(5, near()), (None, near(3)), (None, near(3)), (None, near(9, 10)), (9, near(50)),
            (None, "p q r s t u"), (None, "p q r s t u"), (None, "P q r s t u")]
    got = nd.near_duplicates(table("doc_id long, text string", rows), width=2).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        {(5, 5): 1, (None, 5): 3, (9, 5): 1, (None, None): 3})
    kept = nd.deduplicate(table("doc_id long, text string", rows), width=2, unnamed_stay=False)
    assert sorted((str(r.doc_id), r.text.lower()[:3]) for r in kept.collect()) == [
        ("5", "w0 "), ("None", "p q")]


def test_a_group_of_near_misses(table, rnd):
    """Many texts just below the similarity stay apart, whatever keys they share."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rnd.sample(range(100), 7):
            words[p] = f"x{i}-{p}"
        rows.append((i, " ".join(words)))
    got = nd.near_duplicates(table("doc_id long, text string", rows, 4), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_the_session_keeps_its_settings(spark, table):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    nd.near_duplicates(table("doc_id long, text string", [(1, "a b"), (2, "a b c")])).collect()
    assert spark.conf.get(name, None) == before


def test_empty_table(table):
    docs = table("doc_id long, text string", [])
    assert nd.near_duplicates(docs).count() == 0 and nd.deduplicate(docs).count() == 0


def test_components_of_chains_stars_and_loops(spark, rnd):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(1, 1), (2, None), (7, 3), (3, 9), (9, 7), (9, 7)]
    rnd.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}
    assert got == want | {3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_exact_bound_keeps_every_similar_pair_and_sifts_the_rest(spark, rnd, percent):
    rows, similar = [], []
    draw = np.random.default_rng(5)
    for _ in range(400):
        one = np.unique(draw.integers(0, 1 << 63, rnd.choice([1, 5, 150, 2000]), dtype=np.uint64))
        n = len(one) - int(len(one) * rnd.choice([0, 0.05, 0.1, 0.111, 0.2, 0.4]))
        two = np.unique(np.concatenate([one[:n], draw.integers(
            0, 1 << 63, rnd.choice([0, len(one) - n, len(one) // 9]), dtype=np.uint64)]))
        both = len(np.intersect1d(one, two))
        similar.append(100 * both >= percent * (len(one) + len(two) - both))
        rows.append([len(similar) - 1, *[int(v) for x in (one, two) for v in (
            len(x), *nd.parities(x).view(np.int64))]])
    columns = [f"_{side}{c}" for side in "ab" for c in ("n_shingles", *nd.PARITY_COLUMNS)]
    kept = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("i", *columns)))
    kept = {r.i for r in kept.filter(nd._can_reach(percent)).select("i").collect()}
    assert {i for i, s in enumerate(similar) if s} <= kept
    if percent >= 80:
        assert len(kept) < 400 - 0.5 * similar.count(False)


def test_unlinked_texts_of_one_origin_make_few_pairs(table, spark, rnd, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # any two share some seven tenths of their pairs of words
        words = list(base)
        for at in rnd.sample(range(120), 11):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    sizes, confirm = [], nd._confirm

    def counted(pairs, *args):
        sizes.append(pairs.count())
        return confirm(pairs, *args)

    monkeypatch.setattr(nd, "_confirm", counted)
    got = nd.near_duplicates(table("doc_id long, text string", rows, 5), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert sum(sizes) < 150


def test_further_links_join_known_components(spark, rnd):
    first = [(i, i + 1) for i in range(100, 130)] + [(40, 41), (60, 61), (7, 8)]
    more = [(41, 130), (61, 200), (200, 201), (300, 301), (8, 7)]
    schema = "a long, b long"
    known = components(spark.createDataFrame(first, schema))
    got = joined(known, spark.createDataFrame(more, schema))
    want = components(spark.createDataFrame(first + more, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    same = joined(known, spark.createDataFrame([], schema))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, known.collect()))


def test_hubs_come_with_the_keys_and_cost_no_further_join(table, spark):
    rows = [(key, node, root) for key in range(3) for node, root in ((9, 1), (1, 1), (5, 5), (7, 5))]
    roots = spark.createDataFrame([(9, 1), (1, 1), (7, 5), (5, 5)], "node long, root long")
    mixed = nd._again(table("key long, node long, root long", rows), roots, 1)
    assert mixed.columns == ["key", "node", "root", "hub"]
    flip = 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF
    hub = min((1, 5, 7, 9), key=lambda n: n ^ flip)
    other = min((n for n in (1, 5, 7, 9) if (n in (1, 9)) != (hub in (1, 9))), key=lambda n: n ^ flip)
    offered = nd._with_hubs(mixed, 1)
    assert {tuple(r) for r in offered.collect()} == {(min(hub, other), max(hub, other))}
    plan = nd._with_hubs(spark.createDataFrame([], "key long, node long, root long, hub long"), 0)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_listed_in_tasks_of_bounded_size(spark, rnd, monkeypatch):
    monkeypatch.setattr(nd, "TASK_KEYS", 28 * 25)
    rows = [(i, *[rnd.getrandbits(63) for _ in range(nd.CHUNKS)]) for i in range(500)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(
        f"s{i} long" for i in range(nd.CHUNKS))).coalesce(1)
    parts = nd._keyed(nodes, None, nd.CHUNKS, range(0, 1), 500).rdd.glom().map(len).collect()
    assert sum(parts) == 500 * 28 and max(parts) < 28 * 80


def test_python_gets_small_batches_of_texts(spark, table, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, confirm = spark.conf.get(name), nd._confirm

    def watched(*args):
        seen.append(int(spark.conf.get(name)))
        return confirm(*args)

    monkeypatch.setattr(nd, "_confirm", watched)
    nd.near_duplicates(table("doc_id long, text string", [(1, "a b"), (2, "a b c")])).collect()
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before


def test_the_last_join_is_small_enough_for_machine_code(spark):
    """Java interprets methods of more than 8,000 bytes, some twenty times slower."""
    names = [f"s{i}" for i in range(nd.CHUNKS)]
    schema = ", ".join(f"{c} long" for c in ("node", *names, "n_shingles", *nd.PARITY_COLUMNS))
    signs = spark.createDataFrame([], schema)
    mixed = spark.createDataFrame([], "key long, node long, root long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = nd._apart(mixed, signs, nd.CHUNKS, nd._close(nd.CHUNKS, nd.FAR, 80))
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(plan._jdf.queryExecution().executedPlan())
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.length())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) <= 8000


def test_bytes_that_differ_are_counted(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 256, (500, 8), dtype=np.uint8)
    y = np.where(draw.random((500, 8)) < 0.5, x, x ^ (1 << draw.integers(0, 8, (500, 8)))).astype(np.uint8)
    x[:4], y[:4] = [[0] * 8, [0] * 8, [255] * 8, [127] * 8], [[0] * 8, [255] * 8, [127] * 8, [0] * 8]
    rows = list(zip(range(500), x.view(np.int64)[:, 0].tolist(), y.view(np.int64)[:, 0].tolist()))
    got = spark.createDataFrame(rows, "i int, x long, y long").select(
        "i", nd._components_that_differ(F.col("x"), F.col("y")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == (x != y).sum(axis=1).tolist()


def test_fine_parities_leave_few_pairs_below_the_similarity(spark, table, rnd):
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base)), (500, "a b"), (501, "a b c"), (502, "z " * 3 + "y")]
    for i in range(1, 121):
        words = list(base)
        for at in rnd.sample(range(0, 400, 2), rnd.choice([10, 20, 22, 23, 28, 30, 34])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    texts = table("node long, text string", rows)
    sets = dict(zip((n for n, _ in rows), sets_of(rows, 2)))
    share = {(0, i): len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, 121)}
    share |= {(500, 501): 0.5, (501, 502): 0.0}
    pairs = table("a long, b long", list(share))
    left = [tuple(r) for r in nd._sifted(pairs, texts, 2, 80).collect()]
    assert len(left) == len(set(left)) and {p for p, s in share.items() if s >= 0.8} <= set(left)
    low = {p for p, s in share.items() if s < 0.77}
    assert len(low) > 20 and not low & set(left)
    assert nd._sifted(pairs.limit(0), texts, 2, 80).count() == 0


def test_the_pairs_of_the_last_join_are_sifted_before_texts_meet(table, monkeypatch, rnd):
    seen, sift = [], nd._sifted
    monkeypatch.setattr(nd, "WORTHWHILE", 2.0)
    monkeypatch.setattr(nd, "_sifted", lambda pairs, *rest: seen.append(pairs.count()) or sift(pairs, *rest))
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rnd.sample(range(100), rnd.choice([2, 5, 6, 7])):
            words[p] = f"x{i}-{p}"
        rows.append((i, " ".join(words)))
    got = nd.near_duplicates(table("doc_id long, text string", rows, 4), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert len(seen) == 1
