"""Area tables: one Parquet table per (area, resolution, kind) under a catalog.

A catalog file lists what is there; a read takes the listed table, checks its
single resolution and unique keys, and never sees half of a write: tables are
written to fresh folders and the catalog, replaced last, names them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError, nan_to_null, require_unique
from .files import Store
from .publish import LOCK, writer

KEYS = ["H3_INDEX", "H3_RESOLUTION"]
AREA = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")
CATALOG = "catalog.json"


def _catalog(store: Store) -> dict:
    return json.loads(store.read(CATALOG)) if store.exists(CATALOG) else {"tables": {}}


def area_key(area: str, resolution: int, dynamic: bool) -> str:
    if not AREA.fullmatch(area):
        raise ContractError(f"area name must be kebab case: {area}")
    return f"{area}-r{resolution}-{'dynamic' if dynamic else 'static'}"


def write_areas(areas: dict[str, DataFrame], root: str, dynamic: bool = False, unavailable: tuple[str, ...] = ()) -> None:
    """Write each area split by resolution; other areas stay. Dated tables have a ``date`` column, static ones may not.

    Columns of ``unavailable`` that are null at a resolution are left out there; a value in one is an error.
    """
    store = Store(root)
    with writer(store):  # the catalog is read, changed and replaced by one writer at a time
        _write(areas, store, dynamic, unavailable)


def _write(areas: dict[str, DataFrame], store: Store, dynamic: bool, unavailable: tuple[str, ...]) -> None:
    root, catalog = store.root, _catalog(store)
    for area, df in areas.items():
        if ("date" in df.columns) != dynamic:
            raise ContractError(f"{area}: a date column belongs to dynamic tables, and to them only")
        df = nan_to_null(df)
        require_unique(df, KEYS + ["date"] * dynamic, area)
        for r in sorted(x[0] for x in df.select("H3_RESOLUTION").distinct().collect()):
            part, key = df.where(F.col("H3_RESOLUTION") == r), area_key(area, r, dynamic)
            gone = [c for c in unavailable if c in df.columns]
            if gone:
                known = part.agg(*(F.count(c).alias(c) for c in gone)).first()
                part = part.drop(*(c for c in gone if known[c] == 0))
            folder = f"{key}-{uuid.uuid4().hex[:12]}.parquet"
            part.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.parquet(f"{root}/{folder}")
            catalog["tables"][key] = {"area": area, "resolution": int(r), "dynamic": dynamic, "folder": folder, "columns": part.columns}
    store.replace(CATALOG, json.dumps(catalog, indent=1, sort_keys=True))


def list_areas(root: str) -> list[str]:
    return sorted({x["area"] for x in check_catalog(root)["tables"].values()})


def check_catalog(root: str) -> dict:
    """The catalog, if every table it names exists and no table lies beside it that it does not name."""
    store = Store(root)
    catalog = _catalog(store)
    named, there = {x["folder"] for x in catalog["tables"].values()}, set(store.names())
    if missing := sorted(named - there):
        raise ContractError(f"catalog names missing tables: {missing[:5]}")
    if not store.exists(LOCK) and (extra := sorted(x for x in there - named if x.endswith(".parquet") and x.rsplit("-", 1)[0] not in catalog["tables"])):
        raise ContractError(f"tables that the catalog does not name: {extra[:5]}")
    return catalog


def read_area(spark: SparkSession, root: str, area: str, resolution: int | None = None, dynamic: bool = False) -> DataFrame:
    """One table; the resolution may be left out where there is only one."""
    found = [x for x in check_catalog(root)["tables"].values() if x["area"] == area and x["dynamic"] == dynamic and resolution in (None, x["resolution"])]
    if len(found) != 1:
        raise ContractError(f"{area}: {len(found)} tables match; give one resolution of {sorted(x['resolution'] for x in found)}")
    df = spark.read.parquet(f"{root}/{found[0]['folder']}")
    other = df.where(F.col("H3_RESOLUTION") != found[0]["resolution"]).limit(1).count()
    if other:
        raise ContractError(f"{area}: rows of another resolution")
    return df


def validated(df: DataFrame, support: DataFrame, columns: list[str]) -> DataFrame:
    """Projected scan with unique keys and exactly the support's keys, in key order."""
    from ..operators.contracts import require_support

    out = require_unique(df.select(*KEYS, *columns), KEYS)
    return require_support(out, support, KEYS).orderBy(*KEYS)
