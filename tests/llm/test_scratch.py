"""Scratch tables: a scope removes its own, keeps what it is told to, and leaves other threads' alone."""

import threading

from pluvia.llm.common import scratch_scope, stored


def test_scopes_of_threads(spark):
    numbers = spark.range(5)
    opened, written, ended = threading.Event(), threading.Event(), threading.Event()
    found, inside = {}, {}

    def other() -> None:
        opened.wait(60)
        found["outside any scope"] = stored(numbers)
        with scratch_scope(spark) as keep:
            inside["gone"] = stored(numbers)
            found["kept"] = keep(numbers)
            written.set()
            ended.wait(60)
            found["while its scope is open"] = inside["gone"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch_scope(spark) as keep:
        opened.set()
        assert written.wait(60)
        inside["own"] = stored(numbers)
        found["own kept"] = keep(numbers)
    ended.set()
    thread.join(60)
    assert found.pop("while its scope is open") == 5
    assert {k: df.count() for k, df in found.items()} == dict.fromkeys(("outside any scope", "kept", "own kept"), 5)
    for df in inside.values():
        assert not _exists(spark, df)


def test_scopes_within_scopes(spark):
    with scratch_scope(spark) as keep:
        with scratch_scope(spark) as inner:
            handed = inner(spark.range(3))
            gone = stored(spark.range(2))
        assert not _exists(spark, gone) and handed.count() == 3
        kept = keep(handed)
    assert kept.count() == 3 and not _exists(spark, handed)


def _exists(spark, df) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
