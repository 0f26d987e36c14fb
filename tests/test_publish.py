import glob
import os

import pytest
from pyspark.sql import functions as F

from deltaloom.sources import files
from deltaloom.state import publish
from deltaloom.state.store import Conflict, Store


def table(spark, n):
    return spark.range(n).select("id", F.lit(f"v{n}").alias("v"))


def whole(spark, root):
    """What a reader gets: the rows of the one version that all tables are of."""
    got = publish.consumed(spark, root)
    assert {(r.v,) for t in got.values() for r in t.select("v").distinct().collect()} == {(f"v{got['a'].count()}",)}
    return got["a"].count()


def outputs(spark, n):
    return {"a": table(spark, n), "b": table(spark, n).repartition(3)}


def test_versions(spark, scratch):
    root = f"file://{scratch}/out"
    with pytest.raises(publish.Broken, match="nothing"):
        publish.consumed(spark, root)
    first = publish.published(outputs(spark, 5), root, "one", {"b": "json"})
    assert (first.generation, whole(spark, root)) == (1, 5)
    with pytest.raises(Conflict):
        publish.pointed(spark, root, "one", {"a": "parquet"}, expected=7)
    publish.published(outputs(spark, 6), root, "two", expected=1)
    assert whole(spark, root) == 6 and publish.consumed(spark, root, first)["a"].count() == 5
    publish.published(outputs(spark, 7), root, "three")
    publish.staged(outputs(spark, 8), root, "left")
    assert publish.cleaned(spark, root) == ["one"] and publish.cleaned(spark, root, unfinished=True) == ["left"]
    assert whole(spark, root) == 7


@pytest.mark.parametrize("step", ["table", "tables", "manifest", "pointer", "torn pointer", "checkpoint"])
def test_a_crash_leaves_old_or_new(spark, scratch, monkeypatch, step):
    """Whatever is done when the driver dies, readers get one whole version, and the next run goes on from there."""
    root, store = f"file://{scratch}/out", Store(f"{scratch}/state.db")
    store.initialise("s", "A")
    store.begin("r1", "s", "B")
    publish.published(outputs(spark, 5), root, "r1", run="r1", target="B")
    assert publish.finalised(spark, store, "s", root, "r1") == "committed" and store.base("s") == "B"

    store.begin("r2", "s", "C")

    class Died(Exception):
        pass

    def die(*_, **__):
        raise Died

    if step == "table":
        broken = outputs(spark, 6)
        broken["b"] = broken["b"].withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
        with pytest.raises(Exception, match="lost"):
            publish.published(broken, root, "r2", run="r2", target="C")
    else:
        name = {"tables": "listed", "manifest": "pointed", "pointer": "manifest_digest"}.get(step)
        if step == "torn pointer":
            created = publish._Folder.created
            monkeypatch.setattr(publish._Folder, "created", lambda self, name, text: created(self, name, text[: len(text) // 2]) and die())
        elif step == "checkpoint":
            monkeypatch.setattr(store, "advance", die)
        else:
            monkeypatch.setattr(publish, name, die)
        with pytest.raises(Died):
            publish.published(outputs(spark, 6), root, "r2", run="r2", target="C")
            publish.finalised(spark, store, "s", root, "r2")
        monkeypatch.undo()
    new = step == "checkpoint"
    assert whole(spark, root) == (6 if new else 5) and store.base("s") == "B"
    assert publish.recovered(spark, store, "s", root) == ("committed" if new else None)
    assert store.base("s") == ("C" if new else "B")
    if not new:  # the same run is done again
        publish.published(outputs(spark, 6), root, "r2", run="r2", target="C")
        assert publish.finalised(spark, store, "s", root, "r2") == "committed"
    assert whole(spark, root) == 6 and store.base("s") == "C" and publish.finalised(spark, store, "s", root, "r2") == "committed"


def test_blocked_runs_do_not_move_the_checkpoint(spark, scratch):
    root, store = f"file://{scratch}/out", Store(f"{scratch}/state.db")
    store.initialise("s", "A")
    store.begin("r1", "s", "B")
    assert publish.finalised(spark, store, "s", root, "r1") == "running"
    publish.published(outputs(spark, 3), root, "r1", run="r1", target="B", quality="blocked")
    assert publish.finalised(spark, store, "s", root, "r1") == "review_required" and store.base("s") == "A"


@pytest.mark.parametrize("what", ["missing", "extra", "size", "hash", "manifest"])
def test_changed_files_are_found(spark, scratch, what):
    root = f"file://{scratch}/out"
    pointer = publish.published(outputs(spark, 50), root, "one")
    parts = sorted(glob.glob(f"{scratch}/out/versions/one/tables/b/part-*"))
    crc = lambda p: os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")
    raw = open(parts[0], "rb").read()
    if what == "missing":
        os.remove(parts[0])
    elif what == "extra":
        open(parts[0].replace("part-", "part-x"), "wb").write(raw)
    elif what == "manifest":
        spark.createDataFrame([("a/x", 1, "y")], publish.MANIFEST).write.mode("overwrite").parquet(f"{root}/versions/one/manifest")
    else:
        os.remove(crc(parts[0]))
        open(parts[0], "wb").write(raw + b"x" if what == "size" else raw[:-5] + b"x" + raw[-4:])
    with pytest.raises(publish.Broken, match={"missing": publish.MISSING, "extra": publish.EXTRA, "size": publish.SIZE, "hash": publish.HASH, "manifest": "MANIFEST"}[what]):
        publish.consumed(spark, root)
    assert publish.current(spark, root) == pointer


def test_replaced_folder_after_a_crash(spark, scratch, monkeypatch):
    path = f"file://{scratch}/out"
    files.replaced(table(spark, 2), path)
    files.replaced(table(spark, 3), path)
    assert spark.read.json(path).count() == 3 and not os.path.exists(f"{scratch}/out.old")
    os.rename(f"{scratch}/out", f"{scratch}/out.old")  # died between the two renames
    files.restored(spark, path)
    assert spark.read.json(path).count() == 3
    files.restored(spark, path)
    files.replaced(table(spark, 4), path)
    assert spark.read.json(path).count() == 4
