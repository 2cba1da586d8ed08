"""Scopes of stored tables."""

import os

import pytest

from marlstone.operators.components import connected_components
from marlstone.storage import scratch, shared_dir, stored


@pytest.fixture
def folder(spark):
    path = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(path))
    return lambda: sorted(x.split("-")[0] for x in set(os.listdir(path)) - before)


def test_only_what_leaves_a_scope_stays(spark, folder):
    rows = spark.range(10)
    with scratch() as leave:
        one = stored(rows, "one")
        with scratch() as inner:
            stored(one, "two")
            three = inner(one.filter("id > 2"), "three")
        assert folder() == ["one", "three"] and three.count() == 7
        four = leave(three.filter("id > 4"), "four")
    assert folder() == ["four"] and four.count() == 5
    stored(rows, "five")
    assert folder() == ["five", "four"]


def test_a_scope_that_fails_leaves_nothing(spark, folder):
    with pytest.raises(ValueError), scratch():
        stored(spark.range(3), "one")
        raise ValueError
    assert folder() == []


def test_components_keep_their_last_round_only(spark, folder):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    got = connected_components(edges)
    assert folder() == ["edges"] and got.filter("component = 0").count() == 201
