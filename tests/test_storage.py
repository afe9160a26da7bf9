"""Tables in the shared folder: what is deleted when."""

import pytest

from lodeworks import storage


def test_settled_keeps_its_result_and_what_was_there(spark):
    before = storage.stored(spark.range(3), "before")
    inner = []

    def make():
        inner.append(storage.stored(before.where("id > 0"), "inner"))
        # A table settled within is one that the outer result reads: it goes with the outer's own.
        inner.append(storage.settled(lambda: storage.stored(inner[0], "deeper"), "nested"))
        assert storage.kept(inner[0]) and storage.kept(inner[1])
        return inner[1].where("id > 1")

    out = storage.settled(make, "out")
    assert [r.id for r in out.collect()] == [2]
    assert storage.kept(out) and storage.kept(before) and before.count() == 3
    assert not any(storage.kept(t) for t in inner)
    storage.remove(out)
    storage.remove(before)


def test_settled_that_fails_leaves_its_tables_to_clear(spark):
    inner = []

    def make():
        inner.append(storage.stored(spark.range(1), "inner"))
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        storage.settled(make, "out")
    assert storage.kept(inner[0])
    # The failed scope is closed: a table stored now belongs to no one.
    after = storage.stored(spark.range(1), "after")
    assert storage.kept(after)
    storage.remove(after)
    storage.remove(inner[0])
