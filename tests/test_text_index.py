"""The text index against a scan in plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from engramite.operators import text_index


def scan(docs, terms, k):
    """BM25 of {key: (title words, words)}, titles three times."""
    n, dl = len(docs), {d: len(h) + len(w) for d, (h, w) in docs.items()}
    avg = sum(dl.values()) / n
    tf = {d: Counter(w) + Counter({t: 3 * c for t, c in Counter(h).items()}) for d, (h, w) in docs.items()}
    score = Counter()
    for t in set(terms):
        df = sum(c[t] > 0 for c in tf.values())
        for d, c in tf.items():
            if c[t]:
                score[d] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl[d] / avg))
    return sorted(((-round(s, 9), d) for d, s in score.items()))[:k]


def found(spark, path, terms, k, first=2):
    return [(-round(r.score, 9), r.key) for r in text_index.search(spark, path, terms, k, first=first).collect()]


def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 16)
    draw = random.Random(5)
    words = [f"{a}{b}{c}x" for a in "abcd" for b in "efg" for c in "hij"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = {d: (draw.choices(words, weights, k=draw.randint(0, 3)), draw.choices(words, weights, k=draw.randint(0, 40))) for d in range(300)}

    def frame(rows):
        return spark.createDataFrame([(d, " ".join(h), " ".join(w), "x") for d, (h, w) in rows.items()], "id long, title string, body string, term string")

    path, fields = f"file://{tmp_path}/index", {"title": 3.0, "body": 1.0}
    text_index.add(frame({d: v for d, v in docs.items() if d < 250}).union(spark.createDataFrame([(None, "aehx", "aehx", "")], "id long, title string, body string, term string")), path, "id", fields)
    held = {d: v for d, v in docs.items() if d < 250}
    asked = [["aehx"], ["dgjx", "cfix"], ["aehx", "beix", "dgjx"], ["nothing"], words[:10]]
    for terms in asked:
        assert found(spark, path, terms, 7) == scan(held, terms, 7)
    # further documents, and new texts for some that are there
    changed = {d: docs[(d * 7) % 300] for d in range(0, 60)} | {d: docs[d] for d in range(250, 300)}
    text_index.add(frame(changed), path, "id", fields)
    held |= changed
    for terms in asked[:3]:
        assert found(spark, path, terms, 7) == scan(held, terms, 7)
    before = text_index._live(spark, path)
    text_index.merge(spark, path)
    after = text_index._live(spark, path)
    assert after[0] == before[0] + 1 and len(before[1]) == 2 and len(after[1]) == 1
    for terms in asked:
        for first in (1, 100):
            assert found(spark, path, terms, 7, first) == scan(held, terms, 7)
    assert {r.term for r in text_index.terms_with(spark, path, "ae").collect()} == {w for h, b in held.values() for w in h + b if w.startswith("ae")}
    assert {r.term for r in text_index.terms_with(spark, path, "dgj").collect()} == {"dgjx"}
    plan = text_index._read(spark, path, after[1], "postings").where((F.col("bucket") == 3) & (F.col("term") == "aehx"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,aehx)" in plan


def test_words_are_shuffled_as_lists_and_small_blocks_are_joined(spark, tmp_path, monkeypatch):
    """A term's postings of a task's documents are one row, and merging makes one of those of small blocks."""
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 50)
    path, fields = f"file://{tmp_path}/index", {"body": 1.0}
    for k in range(3):
        text_index.add(spark.createDataFrame([(20 * k + d, f"word w{d:02d}x") for d in range(20)], "id long, body string").coalesce(1), path, "id", fields)
    _, segments = text_index._live(spark, path)
    lists = text_index._postings(spark, path, segments).where("term = 'word'")
    assert sorted(r["n"] for r in lists.collect()) == [20, 20, 20]
    text_index.add(spark.createDataFrame([(5, "other w05x"), (25, None)], "id long, body string").coalesce(1), path, "id", fields)
    text_index.merge(spark, path)
    _, segments = text_index._live(spark, path)
    rows = text_index._postings(spark, path, segments)
    assert sum(r["n"] for r in rows.where("term = 'word'").collect()) == 58 and rows.where("term = 'word'").count() <= 2
    assert sorted(r["key"] for r in text_index._current(spark, path, segments).collect()) == list(range(60))
    assert rows.where("term is null").select("block").distinct().count() == 2
