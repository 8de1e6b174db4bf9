"""Intermediate tables go with the scope that they were made in."""

import os
import threading

import pytest

from pluvia import registry
from pluvia.adapters import Domain
from pluvia.sources import files

DATA = "/root/testdata/sf0.001"


def folders(spark) -> set[str]:
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_a_scope_leaves_results_only(spark):
    before = folders(spark)
    with files.scratch_scope(spark) as keep:
        d = Domain(spark, DATA)
        links = keep(registry.ON_DOMAIN["link_result"](d), "links")
        stats = registry.ON_DOMAIN["link_stats"](d).collect()
        inside = folders(spark) - before
    left = folders(spark) - before
    assert len(left) == 1 and left < inside and {x.split("-")[0] for x in inside} >= {"events", "candidates", "links"}
    assert links.count() > 0 and stats
    assert sorted(map(str, links.collect())) == sorted(map(str, registry.QUERIES["link_result"](spark, DATA).collect()))


def test_inner_scopes_and_failures(spark):
    before, rows = folders(spark), spark.range(5)
    with files.scratch_scope(spark):
        with files.scratch_scope(spark) as keep:
            files.stored(rows, "inner")
            kept = keep(rows, "kept")
        assert kept.count() == 5 and len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), files.scratch_scope(spark):
        files.stored(rows, "lost")
        1 / 0
    assert folders(spark) == before


def test_other_threads_keep_their_tables(spark):
    made = []
    with files.scratch_scope(spark):
        other = threading.Thread(target=lambda: made.append(files.stored(spark.range(7), "other")))
        other.start()
        other.join()
    assert made[0].count() == 7


def test_without_a_scope_tables_stay(spark):
    before = folders(spark)
    files.stored(spark.range(3), "free")
    assert len(folders(spark) - before) == 1
