"""A stream into a table of the store: batches count once, in whatever order rows come."""

import json
import random
import shutil

import pytest

from loreweave.errors import ConflictError
from loreweave.sources.store import Snapshots
from loreweave.streaming import bundles

SCHEMA = "k long, v string, at long"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("k", "v", "at"), r, strict=True))) + "\n" for r in rows))


def run(spark, tmp_path, store, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(str(tmp_path / "in"))
    bundles.latest_stream(stream, store, "t", "k", order="at", checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    return sorted(tuple(r) for r in store.read(spark, "t", stream.schema).collect())


def latest(rows):
    best = {}
    for k, v, at in rows:
        if k is not None:
            best[k] = max(best.get(k, ((False, 0), (False, ""))), ((at is not None, at or 0), (v is not None, v or "")))
    return sorted((k, v[1] if v[0] else None, at[1] if at[0] else None) for k, (at, v) in best.items())


@pytest.mark.parametrize("limits", [{}, {"delta_from": 0, "most_deltas": 10, "most_share": 1e9}])
def test_late_rows_and_batches(spark, tmp_path, limits):
    """Rows of 12 files, whose times are in no order, with ties, null keys and null times; then more files."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(8)]), rng.choice("abc"), rng.choice([None, *range(6)])) for _ in range(120)]
    for i in range(0, 120, 20):
        put(tmp_path / "in", f"{i:03d}.json", rows[i : i + 20])
    store = Snapshots(tmp_path / "kb", spark, **limits)
    assert run(spark, tmp_path, store, 2) == latest(rows)
    before = store.latest()[0]
    assert run(spark, tmp_path, store) == latest(rows) and store.latest()[0] == before  # nothing new, so no version
    put(tmp_path / "in", "200.json", [(0, "z", 99), (1, "z", -5), (77, None, None)])
    assert run(spark, tmp_path, store) == latest([*rows, (0, "z", 99), (1, "z", -5), (77, None, None)])


def test_replayed_batch_counts_once(spark, tmp_path):
    """The stream fails after its batch is published and before Spark notes it, so the batch comes again."""
    put(tmp_path / "in", "a.json", [(1, "a", 1), (2, "b", 1)])
    store = Snapshots(tmp_path / "kb", spark)
    want = run(spark, tmp_path, store)
    number, tops = store.latest()[0], store.latest()[2]
    assert [n for name, n in tops.items() if name.startswith("stream.")] == [1]
    commits = tmp_path / "cp/commits"
    for f in list(commits.iterdir()):
        f.unlink()
    assert run(spark, tmp_path, store) == want and store.latest()[0] == number
    # another query has numbers of its own
    shutil.move(tmp_path / "cp", tmp_path / "old")
    put(tmp_path / "in", "b.json", [(2, "c", 5)])
    assert run(spark, tmp_path, store) == [(1, "a", 1), (2, "c", 5)]
    assert len([name for name in store.latest()[2] if name.startswith("stream.")]) == 2


def test_other_writers(spark, tmp_path, monkeypatch):
    """A batch that another writer overtook is made anew on its version; after some tries the stream fails and keeps nothing."""
    put(tmp_path / "in", "a.json", [(1, "a", 1)])
    store = Snapshots(tmp_path / "kb", spark)
    real, left = Snapshots.version, [2]

    def overtaken(self):
        if left[0]:
            left[0] -= 1
            raise ConflictError("overtaken")
        return real(self)

    monkeypatch.setattr(Snapshots, "version", overtaken)
    assert run(spark, tmp_path, store) == [(1, "a", 1)]
    left[0] = 100
    put(tmp_path / "in", "b.json", [(1, "b", 2)])
    with pytest.raises(Exception, match="overtaken"):
        run(spark, tmp_path, store)
    left[0] = 0
    assert run(spark, tmp_path, store) == [(1, "b", 2)]
