"""Which patterns each family teaches, by partition: the policy tables and their checks.

Order within a policy is part of its meaning (draws and sample indices depend on it).
The weights are fixed values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from tessella.functions.templates import supported

FAMILIES = ("vanilla", "ocr", "ocr_linear", "mirror", "prevention")

_COMPOSED = {
    "open": {"forward_identity": 0.45, "forward_reverse": 0.25, "identity": 0.15, "reverse": 0.15},
    "restricted": {"forward_identity": 0.60, "forward_reverse": 0.25, "identity": 0.15},
}
PRETRAIN = {
    "vanilla": {"open": {"forward": 0.55, "reverse": 0.45}, "restricted": {"forward": 1.0}},
    "ocr": _COMPOSED,
    "ocr_linear": _COMPOSED,
    "mirror": {
        "open": {"forward": 0.35, "reverse": 0.35, "mirror_forward": 0.30},
        "restricted": {"forward": 0.50, "mirror_forward": 0.50},
    },
    "prevention": {
        "open": {"forward": 0.40, "reverse": 0.25, "prevention": 0.35},
        "restricted": {"forward": 0.45, "prevention": 0.55},
    },
}

_COMPOSED_QA = {
    "open_safe": ("forward_identity", "forward_reverse", "identity", "reverse"),
    "restricted_safe": ("forward_identity", "forward_reverse", "identity"),
    "restricted_attack": ("reverse",),
}
SFT = {
    "vanilla": {"open_safe": ("forward", "reverse"), "restricted_safe": ("forward",), "restricted_attack": ("reverse",)},
    "ocr": _COMPOSED_QA,
    "ocr_linear": _COMPOSED_QA,
    "mirror": {"open_safe": ("forward", "reverse"), "restricted_safe": ("forward",), "restricted_attack": ("reverse",)},
    "prevention": {
        "open_safe": ("forward", "reverse", "prevention"),
        "restricted_safe": ("forward", "prevention"),
        "restricted_attack": ("reverse",),
    },
}


def sft_supported(family: str) -> tuple[str, ...]:
    """Patterns that question rows of a family may have, sorted."""
    return tuple(sorted({p for patterns in SFT[family].values() for p in patterns}))


def family_of(name: str) -> str:
    if name not in FAMILIES:
        raise ValueError(f"unknown dataset family {name!r}")
    return name


def pretrain_policy(family: str, override: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """Default weights with partitions replaced by ``override``; zero weights go, bad ones raise."""
    merged = {**PRETRAIN[family_of(family)], **(override or {})}
    out = {}
    for partition in ("open", "restricted"):
        weights = {str(k): float(v) for k, v in merged[partition].items()}
        if any(w < 0 for w in weights.values()):
            raise ValueError(f"negative weight in the {partition} policy")
        out[partition] = {k: w for k, w in weights.items() if w > 0}
        if not out[partition]:
            raise ValueError(f"the {partition} policy has no positive weight")
        if unknown := set(out[partition]) - set(supported(family)):
            raise ValueError(f"{family} does not support {sorted(unknown)}")
    if "reverse" in out["restricted"]:
        raise ValueError("the restricted policy must not teach reverse")
    return out


def sft_policy(family: str, override: Mapping[str, Sequence[str]] | None = None) -> dict[str, tuple[str, ...]]:
    merged = {k: tuple(map(str, v)) for k, v in {**SFT[family_of(family)], **(override or {})}.items()}
    for bucket in ("open_safe", "restricted_safe", "restricted_attack"):
        patterns = merged[bucket]
        if unknown := set(patterns) - set(sft_supported(family)):
            raise ValueError(f"{family} questions do not support {sorted(unknown)}")
        if repeated := sorted(p for p, n in Counter(patterns).items() if n > 1):
            raise ValueError(f"{bucket} repeats {repeated}")
    if "reverse" in merged["restricted_safe"]:
        raise ValueError("restricted_safe must not contain reverse")
    if merged["restricted_attack"] != ("reverse",):
        raise ValueError("restricted_attack must be exactly reverse")
    return merged


def pattern_repeats(configured: Mapping[str, int] | None, family: str) -> dict[str, int]:
    out = {}
    for pattern, n in (configured or {}).items():
        if pattern not in sft_supported(family):
            raise ValueError(f"unsupported repeat pattern {pattern!r} for {family}")
        if int(n) < 0:
            raise ValueError("repeats must not be negative")
        out[str(pattern)] = int(n)
    return out


def pattern_index(family: str, pattern: str) -> int:
    order = supported(family)
    return order.index(pattern) if pattern in order else sft_supported(family).index(pattern)
