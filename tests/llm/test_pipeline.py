"""The pipeline against brute force, stage by stage."""

import random

import public_tokenizers

import corpus_pipeline
from engramite.llm import byte_bpe, secret_scan
from tests.llm.helpers import SCHEMA, awkward, nothing, sentence
from tests.llm.test_operators import classes


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, frames = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        frames.append((before, {r["doc_id"]: r.asDict() for r in docs.collect()}))
        if k < 4:
            assert docs.columns == columns
    before, after = frames[0]
    assert all((i in after) == (q == 1) for i, q in quality.items() if i in before)
    before, after = frames[1]
    want = classes(sorted((i, r["text"]) for i, r in before.items()), 5, 80, 100)
    assert after.keys() == {i for i, (_, c) in want.items() if c == i}
    before, after = frames[2]
    bad = {i for i, r in before.items() if any(t in r["text"] for t in items)}
    assert bad and not bad & after.keys() and len(before) - len(after) <= len(bad) + 2
    before, after = frames[3]
    assert before.keys() == after.keys()
    for i, r in before.items():
        if r["text"] == after[i]["text"]:
            continue
        assert "[SECRET]" in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"])
    left = spark.createDataFrame([(i, r["text"]) for i, r in after.items()], "doc_id long, text string")
    assert secret_scan.scan(left, secret_scan.BASE).where("size(spans) > 0").count() == 0
    before, after = frames[4]
    assert before.keys() == after.keys()
    encode = byte_bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(r["n_tokens"] == len(x) // 4 for r, x in zip(after.values(), encode([before[i]["text"] for i in after]), strict=True))


def test_run_is_the_stages_in_order(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < rows.count() < 1000


def test_stages_on_awkward_and_empty_tables(spark, sf, tmp_path):
    """Nulls in every column, repeated ids and rows, further columns with clashing names, empty tables."""
    draw = random.Random(20)
    shared = sentence(draw, 80)
    rows = [(200, shared, "en", "s", 1, 0, "", 0), (7, shared + " end", "en", "s", 1, 0, "", 0), (7, sentence(draw, 50), "en", "s", 1, 0, "", 0), (7, sentence(draw, 50), "en", "s", 1, 0, "", 0), (201, "password = hunter22 " + sentence(draw, 30), "en", "s", 1, 0, "", 0)]
    frame = awkward(spark).unionByName(spark.createDataFrame(rows, SCHEMA))
    stage = dict(corpus_pipeline.STAGES)
    for name, work in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        work(spark, nothing(spark), sf).write.parquet(path)
        assert spark.read.parquet(path).count() == 0
        if work is not corpus_pipeline.STAGES[-1][1]:
            assert spark.read.parquet(path).columns == frame.columns
    texts = lambda found: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in found.collect())
    before = texts(frame)
    good = stage["quality classifier"](spark, frame, sf)
    assert good.columns == frame.columns and set(texts(good)) <= set(before)
    one = texts(stage["n-gram Jaccard join"](spark, frame, sf))
    keys = {}
    for at, (i, text) in enumerate(sorted({(i, t) for null, i, t in before if not null})):
        keys[i if i not in keys else 10**18 + at] = (i, text)
    want = classes(sorted((k, t) for k, (_, t) in keys.items()), 5, 80, 100)
    assert one == sorted([(False, *keys[k]) for k, (_, c) in want.items() if c == k] + [r for r in before if r[0]])
    clash = frame.withColumn("__key", frame.kind).withColumn("cosine", frame.kind).withColumn("lcs", frame.kind)
    assert texts(stage["n-gram Jaccard join"](spark, clash, sf)) == one
    clean = stage["benchmark decontamination"](spark, clash, sf)
    assert clean.columns == clash.columns and texts(clean) == before
    hidden = stage["secret scans"](spark, frame, sf)
    assert hidden.columns == frame.columns and hidden.count() == len(before)
    found = {r["doc_id"]: r for r in hidden.collect()}
    assert "hunter22" not in found[201]["text"] and found[201]["n_chars"] == len(found[201]["text"]) and found[0]["text"] is None and found[0]["n_chars"] is None
    assert stage["byte-level BPE"](spark, frame, sf).count() == len(before)
