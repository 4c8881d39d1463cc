"""Publishing a family of tables together: staged, journalled, then renamed; a broken run is taken back or finished."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import ContractError
from .files import Store

JOURNAL, LOCK = "publish.json", "writer.lock"


def _holder(store: Store) -> dict:
    try:
        return json.loads(store.read(LOCK))
    except Exception:  # gone, or not yet written
        return {}


@contextmanager
def writer(store: Store, wait: float = 0.0, lease: float = 600.0) -> Iterator[Callable[[], None]]:
    """The only writer of a root, by a lock file; waits so many seconds for another one.

    The lock is a lease: it names its owner and the time until which it holds, and a
    writer that goes on for long calls what it is given, to renew it. A lock that has run out (its
    owner died) is moved away by one of those that wait; who finds its own lease
    lost gets an error at the next renewal.
    """
    until, owner = time.monotonic() + wait, uuid.uuid4().hex

    def held() -> str:
        return json.dumps({"owner": owner, "until": time.time() + lease})

    while not store.create(LOCK, held()):
        if _holder(store).get("until", float("inf")) < time.time():
            away = f".lost-{owner}"
            try:
                store.rename(LOCK, away)  # one of several succeeds
                store.delete(away)
                continue
            except Exception:  # another one was first
                pass
        if time.monotonic() >= until:
            raise ContractError("another writer holds the lock")
        time.sleep(0.1)

    def renew() -> None:
        if _holder(store).get("owner") != owner:
            raise ContractError("the lock's lease has run out and another writer has it")
        store.write(LOCK, held())

    try:
        yield renew
    finally:
        if _holder(store).get("owner") == owner:
            store.delete(LOCK)


def recover(store: Store) -> str:
    """Finish a run whose journal is complete, drop one that was staging; clean, finished or dropped."""
    if not store.exists(JOURNAL):
        return "clean"
    journal = json.loads(store.read(JOURNAL))
    if journal["state"] == "renaming":
        _rename(store, journal)
        return "finished"
    for staged in journal["tables"].values():
        store.delete(staged)
    store.delete(JOURNAL)
    return "dropped"


def _rename(store: Store, journal: dict) -> None:
    """Put every staged table in place; each step may be the last one before a crash, and is taken up again by ``recover``."""
    for name, staged in journal["tables"].items():
        old = f".old-{name}"
        if store.exists(staged):
            if store.exists(name):
                store.delete(old)
                store.rename(name, old)
            store.rename(staged, name)
        store.delete(old)
    store.delete(JOURNAL)


def publish(tables: dict[str, DataFrame], root: str, check: Callable[[str, DataFrame], None] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Write all tables beside the old ones, read each back through ``check``, then put all in place.

    A failure before the last table has passed leaves the old family as it was; one
    after that is finished by the next call.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    store = Store(root, spark)
    with writer(store) as renew:
        recover(store)
        journal = {"state": "staging", "tables": {name: f".staged-{uuid.uuid4().hex}-{name}" for name in sorted(tables)}}
        store.replace(JOURNAL, json.dumps(journal))
        try:
            for name, staged in journal["tables"].items():
                tables[name].write.parquet(f"{root}/{staged}")
                if check is not None:
                    check(name, spark.read.parquet(f"{root}/{staged}"))
                renew()
        except Exception:
            recover(store)
            raise
        store.replace(JOURNAL, json.dumps(journal | {"state": "renaming"}))
        _rename(store, journal)
    return sorted(tables)


def promote(root: str, candidate: str, release: str, audit: DataFrame, spark: SparkSession | None = None) -> None:
    """Put a candidate table in a release's place, if its audit (one row of fault counts) counts nothing; a broken run is finished by the next one."""
    row = audit.first().asDict()
    faults = {k: v for k, v in row.items() if k.startswith(("n_null", "n_repeated")) and v or k.endswith(("_out", "_nonfinite", "_faults")) and v}
    if faults:
        raise ContractError(f"the candidate has faults: {faults}")
    store = Store(root, spark)
    with writer(store):
        recover(store)
        if not store.exists(candidate):
            raise ContractError(f"no candidate {candidate}")
        journal = {"state": "renaming", "tables": {release: candidate}}
        store.replace(JOURNAL, json.dumps(journal))
        _rename(store, journal)
