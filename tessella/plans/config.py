"""Configuration trees: YAML with includes, deep merges, dotted overrides, grids."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

INCLUDE = "_include_yml"


def merged(base: dict, over: dict) -> dict:
    """`base` with `over` put on it: maps key by key, all else replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, _above: tuple[Path, ...] = ()) -> dict:
    """A YAML file on top of those it includes, in their order; a file that includes itself is an error."""
    import yaml

    at = Path(path).resolve()
    if at in _above:
        raise ValueError("files include each other: " + " -> ".join(str(x) for x in (*_above, at)))
    tree = yaml.safe_load(at.read_text()) or {}
    if not isinstance(tree, dict):
        raise ValueError(f"not a map: {at}")
    names = tree.pop(INCLUDE, [])
    out: dict = {}
    for name in [names] if isinstance(names, str) else names:
        out = merged(out, load(at.parent / name, (*_above, at)))
    return merged(out, tree)


def overrides(tokens: Sequence[str]) -> dict[str, Any]:
    """`--a.b=v` or `--a.b v` as dotted names with values read as YAML; a name without a dot is an error."""
    import yaml

    out: dict[str, Any] = {}
    rest = list(tokens)
    while rest:
        token = rest.pop(0)
        if not token.startswith("--"):
            raise ValueError(f"not an option: {token}")
        name, sep, value = token[2:].partition("=")
        if not sep:
            if not rest:
                raise ValueError(f"no value for {token}")
            value = rest.pop(0)
        if "." not in name:
            raise ValueError(f"not a dotted name: {name}")
        out[name] = yaml.safe_load(value)
    return out


def with_value(tree: dict, name: str, value: Any) -> dict:
    head, _, rest = name.partition(".")
    return {**tree, head: with_value(tree.get(head) or {}, rest, value) if rest else value}


def trials(grid: dict[str, Sequence], seeds: Sequence[int], shards: int = 1, shard: int = 0) -> Iterator[tuple[int, dict, int]]:
    """(number from 1, combination, seed): every combination with every seed, seeds inside; of those every shards-th."""
    combos = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    for n, (combo, seed) in enumerate(itertools.product(combos, seeds), 1):
        if (n - 1) % shards == shard:
            yield n, combo, seed
