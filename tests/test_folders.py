import hashlib
import re

import pyarrow.fs as pafs
import pytest
from hypothesis import given
from hypothesis import strategies as st

from driftmerge.functions import paths
from driftmerge.sources import folders


class Recorded:
    """A store that remembers what was listed and opened."""

    def __init__(self, store):
        self.store, self.listed, self.opened = store, [], []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.store.get_file_info(selector)

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.store.open_input_stream(path)


def tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())


def test_ignored_folders_are_not_listed(tmp_path):
    tree(tmp_path, ["a.txt", "b.tmp", ".git/x/y", "src/.git/z", "src/deep/c.txt", "src/deep/d.log", "build/out/e.txt", "docs/build/f.txt"])
    store = Recorded(pafs.LocalFileSystem())
    found = list(folders.walk(store, str(tmp_path), [""], paths.matcher([*paths.BUILT_IN, "*.log", "build/out"])))
    assert sorted(x[0] for x in found) == ["a.txt", "docs/build/f.txt", "src/deep/c.txt"]
    assert sorted(x.removeprefix(str(tmp_path)).strip("/") for x in store.listed) == ["", "build", "docs", "docs/build", "src", "src/deep"]
    # A task that may not list more hands folders on; what it lists and what it hands on are all there is.
    some = list(folders.walk(store, str(tmp_path), [""], paths.matcher([]), budget=1))
    assert {x[0] for x in some if x[1]} == {".git", "src", "build", "docs"} and {x[0] for x in some if not x[1]} == {"a.txt", "b.tmp"}
    for path in ("a.txt", "gone.txt"):
        folders.looked(store, str(tmp_path), path)
    assert [x.removeprefix(f"{tmp_path}/") for x in store.opened] == ["a.txt", "gone.txt"]


def test_listing_in_many_rounds_equals_one(spark, tmp_path):
    names = [f"{k % 3}/{k % 7}/{'deep/' * (k % 5)}{k}.{'tmp' if k % 11 == 0 else 'txt'}" for k in range(200)]
    tree(tmp_path, names)
    want = sorted((x, len(x)) for x in names if not x.endswith(".tmp"))
    for budget in (1, 7, 10_000):
        assert sorted((r.path, r.len) for r in folders.listing(spark, str(tmp_path), budget=budget).collect()) == want
    with pytest.raises(Exception, match="not found|does not exist|No such"):
        folders.listing(spark, str(tmp_path / "none")).collect()


@given(st.lists(st.text("ab*?/.", min_size=1, max_size=5), min_size=1, max_size=3), st.lists(st.text("ab.", min_size=1, max_size=3), min_size=1, max_size=4))
def test_a_path_is_ignored_if_it_or_a_parent_is_matched(rules, parts):
    path, hit = "/".join(parts), False
    for rule in rules:
        above = ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]
        hit |= any(re.fullmatch(paths.glob_regex(rule), x, re.S) is not None for x in (above if "/" in rule else parts))
    assert paths.matcher(rules)(path) == hit


def test_large_files_are_read_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "READ", 1000)
    data = bytes(range(256)) * 40
    (tmp_path / "x").write_bytes(data)
    path, size, digest, head = folders.looked(pafs.LocalFileSystem(), str(tmp_path), "x", sniff=1500)
    assert (path, size, digest, head) == ("x", len(data), hashlib.sha256(data).hexdigest(), data[:1501])


def test_folder_changes_come_out_between_batches(spark, tmp_path):
    root, place = tmp_path / "root", tmp_path / "work"
    tree(root, ["a.txt", "b/c.txt", "b/d.txt", "b/e.tmp", "f/g/h.txt"])

    def drain():
        stream = folders.changes(spark, str(root), f"{place}/snapshots", ["f/g"], shards=3)
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch, r.path, r.kind, r.len) for r in spark.read.parquet(f"{place}/out").collect())

    first = [(1, "a.txt", "created", 5), (1, "b/c.txt", "created", 7), (1, "b/d.txt", "created", 7)]
    assert drain() == first
    (root / "a.txt").write_bytes(b"longer now")
    (root / "b" / "c.txt").unlink()
    tree(root, ["i/j.txt", "f/g/k.txt"])
    second = [(2, "a.txt", "modified", 10), (2, "b/c.txt", "removed", 7), (2, "i/j.txt", "created", 7)]
    assert drain() == first + second
    assert drain() == first + second
    assert [p.name for p in (place / "snapshots").iterdir()] == ["3"] or len(list((place / "snapshots").iterdir())) <= 2


def test_a_batch_that_runs_again_gives_the_same_changes(tmp_path):
    root = tmp_path / "root"
    tree(root, ["a.txt", "b.txt", "c/d.txt"])
    options = {"path": str(root), "snapshots": f"{tmp_path}/snapshots", "shards": "2"}
    reader = folders.FolderReader(options)
    one = reader.latestOffset()
    read = lambda start, end: sorted(row[:2] for part in reader.partitions(start, end) for row in reader.read(part))
    assert read(reader.initialOffset(), one) == [("a.txt", "created"), ("b.txt", "created"), ("c/d.txt", "created")]
    (root / "a.txt").unlink()
    two = reader.latestOffset()
    assert read(one, two) == [("a.txt", "removed")]
    (root / "b.txt").unlink()  # after the batch was listed, so it belongs to the next one
    assert read(one, two) == [("a.txt", "removed")]
    again = folders.FolderReader(options)
    three = again.latestOffset()
    assert three["batch"] == two["batch"] + 1 and read(two, three) == [("b.txt", "removed")]
    again.commit(two)
    with pytest.raises(FileNotFoundError):
        read(one, three)
