"""Tables of versions: what readers see, conflicts, deletes, merges and retention."""

import pytest

from engramite.sources.versions import Conflict, Table


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_readers_see_whole_versions(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", ["k"])
    make = lambda *r: spark.createDataFrame(list(r), "k long, v string, extra array<int>")
    assert table.read() is None and table.versions() == []
    table.add(make((1, "a", [1]), (2, "b", None)))
    reader = table.read()
    table.add(make((2, "B", [2]), (3, "c", [])))
    assert rows(reader) == [(1, "a", [1]), (2, "b", None)]  # goes on with what it named
    assert rows(table.read()) == [(1, "a", [1]), (2, "B", [2]), (3, "c", [])] and rows(table.read(1)) == [(1, "a", [1]), (2, "b", None)]
    table.delete(make((1, None, None)))
    assert [r[0] for r in rows(table.read())] == [2, 3]
    table.add(make((1, "again", None)))
    whole = rows(table.read())
    assert [r[:2] for r in whole] == [(1, "again"), (2, "B"), (3, "c")]
    assert len(table.version().parts) == 4 and len(table.merge().parts) == 1 and rows(table.read()) == whole and table.merge().number == 5
    assert table.expire(2) == 0  # the parts of version 4 are still wanted
    assert table.expire(1) == 4 and table.versions() == [5] and rows(table.read()) == whole
    table.replace(make((9, "z", None)))
    assert rows(table.read()) == [(9, "z", None)]


def test_of_two_writers_one_begins_again(spark, tmp_path):
    one, two = (Table(spark, f"file://{tmp_path}/t") for _ in range(2))
    frame = spark.createDataFrame([(1,)], "k long")
    start = one.add(frame)
    stale = two.version()
    part = one._part(frame)
    one.commit(start, [*start.parts, (part, "rows")])
    with pytest.raises(Conflict):
        two.commit(stale, [*stale.parts, (two._part(frame), "rows")])
    assert two.add(frame).number == 3 and rows(two.read()) == [(1,)] * 3
    seen = []

    def late(now):
        if not seen:
            seen.append(one.add(frame))  # another writer comes between
        return [*now.parts], ["mine"]

    assert two.change(late).number == 5 and two.version().done == ("mine",) and two.read().count() == 4
    # a file that is being written is no version
    (tmp_path / "t/log/.half").write_text("{")
    assert two.versions() == [1, 2, 3, 4, 5]
