"""Stage plans: dependencies, selection, order, reuse by hash; configuration by include and interpolation."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

Runner = Callable[[dict], object]


class PlanError(ValueError):
    """A plan that cannot run."""


def plan(stages: dict[str, list[str]], only: list[str] | None = None, skip: list[str] = (), optional: set[str] = frozenset()) -> list[str]:
    """Stages in dependency order: all but the optional ones, or those named with what they need; skipped ones left out."""
    unknown = {x for x in [*(only or []), *skip, *(d for ds in stages.values() for d in ds)] if x not in stages}
    if unknown:
        raise PlanError(f"unknown stages: {sorted(unknown)}")
    wanted, todo = set(), list(only or [s for s in stages if s not in optional])
    while todo:
        s = todo.pop()
        if s not in wanted:
            wanted.add(s)
            todo += stages[s]
    try:
        order = TopologicalSorter({s: sorted(d for d in stages[s] if d in wanted) for s in sorted(wanted)}).static_order()
        return [s for s in order if s not in skip]
    except CycleError as e:
        raise PlanError(f"cycle: {e.args[1]}") from None


def run(order: list[str], stages: dict[str, list[str]], runners: dict[str, Runner], config: dict, done: dict[str, str]) -> dict[str, str]:
    """Run stages whose identity (config and upstream) changed; a failure blocks what depends on it. Returns states."""
    states: dict[str, str] = {}
    for s in order:
        if any(states.get(d) in ("failed", "blocked") for d in stages[s]):
            states[s] = "blocked"
            continue
        identity = config_hash({"stage": s, "config": config.get(s, {}), "upstream": [done.get(d) for d in sorted(stages[s])]})
        if done.get(s) == identity:
            states[s] = "reused"
            continue
        try:
            runners[s](config.get(s, {}))
        except Exception as e:  # noqa: BLE001
            states[s] = "failed"
            done.pop(s, None)
            config.setdefault("_errors", {})[s] = str(e)
            continue
        done[s], states[s] = identity, "ran"
    return states


def config_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def merged(*layers: dict) -> dict:
    """Later layers win; nested tables merge."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


_SLOT = re.compile(r"\$\{([\w.]+)\}")


def resolved(config: dict) -> dict:
    """``${a.b}`` replaced by the value at that path; cycles are an error."""

    def at(path: str):
        v = config
        for p in path.split("."):
            if not isinstance(v, dict) or p not in v:
                raise PlanError(f"no such value: {path}")
            v = v[p]
        return v

    def fill(v, trail: tuple[str, ...]):
        if isinstance(v, dict):
            return {k: fill(x, trail) for k, x in v.items()}
        if isinstance(v, list):
            return [fill(x, trail) for x in v]
        if not isinstance(v, str):
            return v
        for name in _SLOT.findall(v):
            if name in trail:
                raise PlanError(f"cycle: {' -> '.join([*trail, name])}")
        whole = _SLOT.fullmatch(v)
        if whole:
            return fill(at(whole[1]), (*trail, whole[1]))
        return _SLOT.sub(lambda m: str(fill(at(m[1]), (*trail, m[1]))), v)

    return fill(config, ())


def redacted(config: dict, words: tuple[str, ...] = ("secret", "token", "password", "key")) -> dict:
    return {k: redacted(v, words) if isinstance(v, dict) else "***" if any(w in k.lower() for w in words) else v for k, v in config.items()}


def preflight(spark, inputs: dict[str, tuple[str, dict[str, str]]]) -> list[str]:
    """What would stop a run: inputs (name: path, column types) that cannot be read or that lack columns; empty if nothing would."""
    faults = []
    for name, (path, columns) in sorted(inputs.items()):
        try:
            kinds = dict(spark.read.parquet(path).dtypes)
        except Exception as e:  # noqa: BLE001
            faults.append(f"{name}: cannot be read ({type(e).__name__})")
            continue
        faults += [f"{name}: {c} is {kinds.get(c, 'missing')}, not {k}" for c, k in sorted(columns.items()) if kinds.get(c) != k]
    return faults
