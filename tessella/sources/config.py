"""YAML configuration with dotted overrides and ${a.b} references."""

from __future__ import annotations

import copy
import re

import yaml

_WHOLE = re.compile(r"\$\{([^${}]+)\}")
ABSENT = frozenset(("", "none", "null"))


def _dig(tree: dict, dotted: str) -> object:
    for part in dotted.split("."):
        tree = tree[part]
    return tree


def _resolve(value: object, root: dict, depth: int = 0) -> object:
    if depth > 50:
        raise ValueError("references go round")
    if isinstance(value, dict):
        return {k: _resolve(v, root, depth) for k, v in value.items()}
    if isinstance(value, list):
        return [_resolve(v, root, depth) for v in value]
    if not isinstance(value, str):
        return value
    if m := _WHOLE.fullmatch(value):
        return _resolve(_dig(root, m[1]), root, depth + 1)
    if _WHOLE.search(value):
        return _resolve(_WHOLE.sub(lambda m: str(_resolve(_dig(root, m[1]), root, depth + 1)), value), root, depth + 1)
    return value


def parse(text: str, overrides: list[str] | None = None) -> dict:
    """``overrides`` are ``a.b=value`` with YAML values; references resolve afterwards."""
    tree = copy.deepcopy(yaml.safe_load(text) or {})
    for item in overrides or []:
        dotted, _, raw = item.partition("=")
        *parents, last = dotted.split(".")
        at = tree
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = yaml.safe_load(raw)
    return _resolve(tree, tree)


def dump(tree: dict) -> str:
    return yaml.safe_dump(tree, sort_keys=True, allow_unicode=True)


def is_absent(value: object) -> bool:
    return value is None or str(value).strip().lower() in ABSENT


def optional_int(value: object, least: int | None = None) -> int | None:
    if is_absent(value):
        return None
    n = int(value)
    if least is not None and n < least:
        raise ValueError(f"expected at least {least}, got {n}")
    return n


def main_process_port(value: object) -> str | None:
    if is_absent(value) or str(value).strip().lower() == "auto":
        return None
    port = int(str(value).strip())
    if not 1 <= port <= 65535:
        raise ValueError(f"port out of range: {value}")
    return str(port)


def visible_devices(value: object) -> str | None:
    if isinstance(value, (list, tuple)):
        return ",".join(map(str, value))
    return None if is_absent(value) or str(value).strip().lower() == "auto" else str(value).strip()
