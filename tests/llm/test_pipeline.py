import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loopweave.llm import compression_quality
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_near_duplicates import brute as groups

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, written and read like the driver does."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        result = stage(spark, docs, DATA)
        result.write.parquet(path)
        out.append((name, docs, result))
        docs = spark.read.parquet(path)
    return {n: (a, b, c) for n, (a, b), c in zip(
        [x[0] for x in out], [(x[1], x[2]) for x in out],
        [x[1] for x in out[1:]] + [docs])}


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(stages, spark):
    assert list(stages) == [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in list(stages.values())[:-1])


def test_quality_drops_what_the_model_rejects(stages, spark):
    before, _, after = stages["quality"]
    model = compression_quality.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    scorer = model.scorer()
    assert set(rows(after)) == {d for d, t in rows(before).items() if scorer(t)[0] >= 0.5}


def test_one_document_of_each_group_stays(stages):
    before, _, after = stages["near duplicates"]
    assert set(rows(after)) == {c for _, _, c in groups(sorted(rows(before).items()), 5)}


def test_no_contaminated_document_stays(stages, spark):
    before, _, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    lower = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t) for d, t in rows(before).items()}
    assert set(rows(after)) == {d for d, t in lower.items() if not hits(t, items)[1]}


def test_the_mix_keeps_to_whole_copies(stages):
    before, _, after = stages["mixing"]
    counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(rows(before)) and set(counts.values()) <= {1, 2}
    words = F.size(F.split(F.trim("text"), r"\s+"))
    one, two = (d.agg(F.sum(words)).first()[0] for d in (before, after))
    assert 1.3 < two / one < 1.7


def test_records_hold_the_mixed_texts_in_order(stages):
    before, _, after = stages["token records"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(before.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after.collect()), key=lambda r: r[1]) == want


def test_nothing_in_nothing_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
