"""Catalogs, journals and locks broken off at every step."""

import json
import time

import pytest

from cellweave.operators.contracts import ContractError
from cellweave.sources import areas, files, publish


class Crash(Exception):
    pass


class Breaking(files.Store):
    """A store whose n-th change fails."""

    def __init__(self, root, spark, left):
        super().__init__(root, spark)
        self.left = left

    def _step(self):
        self.left -= 1
        if self.left < 0:
            raise Crash

    def write(self, *a, **k):
        self._step()
        super().write(*a, **k)

    def rename(self, *a):
        self._step()
        super().rename(*a)

    def delete(self, *a):
        self._step()
        super().delete(*a)


def test_a_replaced_text_is_old_or_new_at_every_step(spark, tmp_path):
    for left in range(6):
        root = str(tmp_path / str(left))
        store = files.Store(root, spark)
        store.replace("c.json", "one")
        store.replace("c.json", "two")
        try:
            Breaking(root, spark, left).replace("c.json", "three")
            assert store.read("c.json") == "three" and left >= 2
        except Crash:
            assert store.read("c.json") == "two"
        assert store.exists("c.json") and "c.json" in store.names()
    assert store.read("c.json", store.versions("c.json")[0]) in ("two", "three")
    store.delete("c.json")
    assert not store.exists("c.json") and store.versions("c.json") == []


def test_families_survive_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    for left in range(2, 30):
        root = str(tmp_path / str(left))
        publish.publish({"a": spark.range(3), "b": spark.range(3)}, root)
        with monkeypatch.context() as m:
            m.setattr(publish, "Store", lambda r, s=None: Breaking(r, s, left))
            try:
                publish.publish({"a": spark.range(7), "b": spark.range(7)}, root)
                done = True
            except Crash:
                done = False
        store = files.Store(root, spark)
        store.delete(publish.LOCK)  # as after its lease
        publish.recover(store)
        sizes = {spark.read.parquet(f"{root}/{t}").count() for t in "ab"}
        assert sizes in ({3}, {7}) and (sizes == {7} or not done)
        assert [x for x in store.names() if not x.startswith(".new-")] == ["a", "b"]
        if done:
            break
    else:
        raise AssertionError("more steps than expected")


def test_a_promotion_is_finished_after_a_crash(spark, tmp_path, monkeypatch):
    root, audit = str(tmp_path), spark.createDataFrame([(0, 0)], "n_null_keys long, n_repeated long")
    for left in range(2, 20):
        spark.range(3).write.mode("overwrite").parquet(f"{root}/release")
        spark.range(5).write.mode("overwrite").parquet(f"{root}/candidate")
        with monkeypatch.context() as m:
            m.setattr(publish, "Store", lambda r, s=None: Breaking(r, s, left))
            try:
                publish.promote(root, "candidate", "release", audit)
                break
            except Crash:
                pass
        store = files.Store(root, spark)
        store.delete(publish.LOCK)
        publish.recover(store)
        assert spark.read.parquet(f"{root}/release").count() in (3, 5)
    assert spark.read.parquet(f"{root}/release").count() == 5
    with pytest.raises(ContractError, match="no candidate"):
        publish.promote(root, "candidate", "release", audit)


def test_leases_run_out_and_are_renewed(spark, tmp_path):
    store = files.Store(str(tmp_path), spark)
    store.write(publish.LOCK, json.dumps({"owner": "dead", "until": time.time() - 1}))
    with publish.writer(store) as renew:
        with pytest.raises(ContractError, match="another writer"), publish.writer(store):
            pass
        renew()
        store.write(publish.LOCK, json.dumps({"owner": "other", "until": time.time() + 60}))
        with pytest.raises(ContractError, match="run out"):
            renew()
    assert store.exists(publish.LOCK)  # the other's
    store.delete(publish.LOCK)
    with publish.writer(store):
        pass
    assert not store.exists(publish.LOCK)


def test_readers_keep_their_catalog(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 6, 1.0), ("b", 6, 2.0)], "H3_INDEX string, H3_RESOLUTION int, v double")
    areas.write_areas({"one": df}, root)
    store = files.Store(root, spark)
    pinned = store.versions(areas.CATALOG)[-1]
    areas.write_areas({"two": df}, root)
    assert areas.list_areas(root) == ["one", "two"]
    assert sorted(json.loads(store.read(areas.CATALOG, pinned))["tables"]) == ["one-r6-static"]
