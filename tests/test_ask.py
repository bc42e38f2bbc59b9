"""One recall with its flags on a small set of memories."""

import datetime

import pytest

from engramite.operators.ask import Ask, recall

WHEN = datetime.datetime(2024, 1, 1)
ROWS = [
    (1, "redis cache timeout fixed by a longer limit", [1.0, 0.0], "api", "high", 0, ["cache"]), (2, "postgres index for slow queries", [0.9, 0.1], "api", "low", 8, ["sql"]), (3, "redis cluster notes", [0.0, 1.0], "web", "medium", 0, ["cache"]),
    (4, "frontend build with vite", [-1.0, 0.0], "web", "high", 0, []), (5, None, None, None, None, None, None), (6, "cache invalidation in redis and the cache of pages", [0.7, 0.7], "web", None, 1, ["cache", "pages"]), (7, "unbelievable", [0.1, -1.0], "api", "high", 0, None),
]
SCHEMA = "id long, content string, embedding array<double>, project string, confidence string, recall_count long, tags array<string>, created_at timestamp_ntz, type string, pattern_strength double, pattern_tags array<string>, entities array<struct<name:string,type:string>>"


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame([(*r, WHEN, "note", None, None, None) for r in ROWS], SCHEMA)


def ids(memories, *words, **flags):
    rows = recall(memories, Ask(" ".join(words), **flags)).orderBy("rank").collect()
    if flags.get("project"):  # with the content apart
        assert rows == recall(memories.drop("content"), Ask(" ".join(words), **flags), memories.select("id", "content")).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all(a.score >= b.score for a, b in zip(rows, rows[1:]))
    return [r.id for r in rows], {r.step for r in rows}


def test_modes_and_flags(memories):
    assert ids(memories, "redis", mode="text", rerank=False)[0] == [1, 3, 6] and ids(memories, "redis cache", mode="text", rerank=False)[0][0] == 6
    assert ids(memories, "", vector=[1.0, 0.0], mode="vector", rerank=False, recency=0.0)[0] == [1, 2, 6]
    assert ids(memories, "", vector=[1.0, 0.0], mode="vector", rerank=False, recency=0.0, threshold=0.95)[0] == [1, 2]
    both = ids(memories, "redis", vector=[0.0, 1.0], rerank=False)[0]
    assert both[:2] == [6, 3] and 5 not in both  # the one that was recalled before leads
    assert ids(memories, "redis", vector=[0.0, 1.0], rerank=False, k=1)[0] == [6]
    assert ids(memories, "redis", vector=[0.0, 1.0], rerank=False, k=1, exclude=(6,))[0] == [3]
    assert set(ids(memories, "redis", mode="text", project="web")[0]) == {3, 6}
    assert set(ids(memories, "redis", mode="text", tags=("pages",), tags_strict=True)[0]) == {6}
    assert ids(memories, "redis", mode="text", tags=("pages", "cache"), k=1)[0] == [6]
    assert ids(memories, "redis", mode="text", context="api", k=1)[0] == [1]
    assert set(ids(memories, "redis", mode="text", expand=("vite",), rerank=False)[0]) == {1, 3, 4, 6}
    led = ids(memories, "redis", mode="text", project="api", project_first=True, rerank=False)[0]
    assert set(led) == {1, 3, 6}


def test_ladder_and_nothing(memories, spark):
    assert ids(memories, "caching", mode="text", rerank=False)[1] == {"every word"}
    assert ids(memories, "believ", mode="text") == ([7], {"literal"})
    assert ids(memories, "qqq", mode="text") == ([], set()) and ids(memories, "", mode="text") == ([], set())
    assert ids(spark.createDataFrame([], SCHEMA), "redis", vector=[1.0, 0.0]) == ([], set())
