"""Work tables: released at the end of a block, in its own thread only, and cleared by application."""

import threading
from pathlib import Path

from webtel.session import Stages


def folder(s):
    return Path(s.root.removeprefix("file://"))


def test_blocks_of_threads_do_not_mix(spark):
    outer = Stages(spark, "outer")
    outer.write(spark.range(1), "x")
    other = []

    def work():
        s = Stages(spark, "thread")
        s.write(spark.range(2), "x")
        other.append(s)

    with Stages.released():
        inner = Stages(spark, "inner")
        inner.write(spark.range(1), "x")
        t = threading.Thread(target=work)
        t.start()
        t.join()
    assert not inner.names and not (folder(inner) / "x").exists()
    assert other[0].names == ["x"] and (folder(other[0]) / "x").exists() and (folder(outer) / "x").exists()
    Stages.clear(spark)
    assert not folder(other[0]).exists() and not folder(outer).exists()
    assert Stages(spark, "next").write(spark.range(3), "x").count() == 3
