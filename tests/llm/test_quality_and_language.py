import zlib

import duckdb
import numpy as np
import pytest

from loopweave.llm import compression_quality as cq
from loopweave.llm import language_id as li

DATA = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in cq.held_out_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.5) for r in got.values())
    known = duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall()
    test = [(got[d].predicted, q) for d, q in known if held_out(d)]
    assert np.mean([p == q for p, q in test]) > 0.95
    assert np.mean([p == 0 for p, q in test if q == 0]) > 0.8


def test_quality_edge_cases_and_filter(table, rnd):
    def good():
        return " ".join(rnd.choice(["river", "stone", "walks", "under", "the", "old", "bridge"])
                        for _ in range(80))

    def bad():
        return " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "CLICK!!"]) for _ in range(80))

    rows = [(i, good() if i % 2 else bad(), i) for i in range(300)]
    rows += [(1000, None, 0), (1001, "", 0), (1002, good() * 500, 0), (None, bad(), 0), (3, good(), 9)]
    docs = table("doc_id long, text string, score int", rows)
    marks = [(i, i % 2) for i in range(300)] + [(1, None), (2, 7), (None, 1), (5, 1), (5, 1)]
    labels = table("doc_id long, quality int", marks)
    model = cq.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in cq.score_quality(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(300)) and got[1002] == 1 and got[None] == 0
    kept = cq.keep_good(docs, model)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None and i < 300} == set(range(1, 300, 2)) and None not in ids
    assert ids.count(3) == 2


def test_quality_without_labels(table):
    docs = table("doc_id long, text string", [(1, "a"), (2, None)])
    labels = table("doc_id long, quality int", [])
    assert [r.score for r in cq.score_quality(docs, cq.fit(docs, labels)).collect()] == [0.5, 0.5]
    one = table("doc_id long, quality int", [(1, 1)])
    assert cq.keep_good(docs, cq.fit(docs, one)).count() == 2
    assert cq.score_quality(docs.limit(0), cq.fit(docs.limit(0), one)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in li.held_out_languages(docs).collect()}
    known = duckdb.sql(f"select doc_id, lang from '{DATA}/documents.parquet'").fetchall()
    assert np.mean([got[d].lang_pred == g for d, g in known if held_out(d)]) > 0.97
    assert all(got[d].held_out == held_out(d) and 0 <= got[d].score <= 1 for d, _ in known)


def test_language_edge_cases(table, rnd):
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["ÉTÉ", "über", "señor"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k, i)
            for i in range(120) for k in [rnd.choice(["xx", "yy"])]]
    learn = [r for r in rows if not held_out(r[0])]
    assert len(learn) > 20
    rows += [(900, None, "xx", 0), (901, "", None, 0), (902, "12 -- 3", "yy", 0),
             (903, "été ÜBER señor", None, 0), (None, "alpha beta", "yy", 0),
             (904, "alpha " * 50_000, None, 0), (905, "数据 данные", None, 0)]
    docs = table("doc_id long, text string, lang string, lang_pred int", rows)
    got = {r.doc_id: r for r in li.held_out_languages(docs).collect()}
    assert all(got[d].lang_pred == k for d, _, k, _ in rows[:120])
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3
    assert [got[d].score for d in (900, 901, 902)] == [0.0] * 3
    assert (got[903].lang_pred, got[None].lang_pred, got[904].lang_pred) == ("yy", "xx", "xx")
    assert got[None].held_out and got[905].rejected and got[905].lang_pred in words


def test_language_without_anything_to_learn(table):
    docs = table("doc_id long, text string, lang string", [(1, "some text", None)])
    assert [r.lang_pred for r in li.held_out_languages(docs).collect()] == ["und"]
    assert li.held_out_languages(docs.limit(0)).count() == 0


def test_predictions_ignore_language_source_and_id(table, rnd):
    rows = [(i, f"{rnd.choice(['one', 'two'])} words here", "xx" if i % 2 else "yy")
            for i in range(40)]
    docs = table("doc_id long, text string, lang string", rows)
    model = li.fit(docs)
    first = {r.text: r for r in li.identify(docs, model, "text", "text")
             .withColumnRenamed("doc_id", "text").collect()}
    assert len({(t, first[t].lang_pred) for t in first}) == len(first)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_clusters_are_unit_vectors_within_their_radius(n):
    x = np.abs(np.random.default_rng(n).normal(size=(n, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, radii = li.cluster(x, 4)
    assert len(c) == min(4, n) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    near = x @ c.T
    best = near.argmax(axis=1)
    assert (1 - near[np.arange(n), best] <= radii[best] + 1e-5).all()
