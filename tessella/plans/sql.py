"""DuckDB SQL twins of the hash choices and the rendering, for the queries' oracles."""

from __future__ import annotations

from tessella.functions import templates as t
from tessella.functions.hashing import canonical_json


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def js(expr: str) -> str:
    return f"concat('\"', {expr}, '\"')"


def num(expr: str) -> str:
    return f"({expr})::VARCHAR"


class Raw(str):
    """An SQL expression whose value is JSON text; other parts are plain values."""


def stable_index(*parts: object) -> str:
    inner = ", ',', ".join(p if isinstance(p, Raw) else lit(canonical_json(p)) for p in parts)
    return f"('0x' || substr(sha256(concat('[', {inner}, ']')), 1, 12))::BIGINT"


def uniform(*parts: object) -> str:
    return f"({stable_index(*parts)}::DOUBLE / {1 << 48}.0)"


def pick(items, index: str) -> str:
    values = [x if isinstance(x, Raw) else lit(x) for x in items]
    return f"(([{', '.join(values)}])[(({index}) % {len(values)}) + 1])"


def row_key(seed: int, *more: object) -> list:
    return [seed, Raw(js("effect_id")), Raw(js("pattern")), Raw(js("stage")), Raw(js("split")), Raw(num("sample_index")), *more]


def fill(wording: str, cause: str, effect: str) -> Raw:
    out, rest = [], wording
    while rest:
        spots = [(rest.find(k), k, v) for k, v in (("{cause}", cause), ("{effect}", effect)) if k in rest]
        if not spots:
            out.append(lit(rest))
            break
        at, key, value = min(spots)
        if at:
            out.append(lit(rest[:at]))
        out.append(value)
        rest = rest[at + len(key) :]
    return Raw(f"concat({', '.join(out)})" if out else "''")


def source(index: str, sample: str) -> str:
    return f"concat_ws(' ', {pick(t.QUALIFIERS, f'{index} + {sample}')}, {pick(t.PREFIXES, index)}, {pick(t.NOUNS, f'{index} // 12')})"


def body(family: str, pattern: str, cause: str, effect: str, index: str) -> dict[str, str]:
    if family == "ocr":
        outcome = f"concat({pick(t.OUTCOME_OF, index)}, {cause})"
        name, origin, verb = pick(t.NAME_OF, f"{index} // 3"), pick(t.CAUSE_FOR, f"{index} // 5"), pick(t.IS, f"{index} // 7")
        subject, said = {
            "forward": (outcome, effect),
            "reverse": (f"concat({origin}, {effect})", cause),
            "identity": (f"concat({name}, {effect})", effect),
            "forward_identity": (f"concat({name}, {outcome})", effect),
            "forward_reverse": (f"concat({origin}, {outcome})", cause),
        }[pattern]
        lead = f"concat({subject}, {verb})"
        asked = f"concat({lead}, '?')"
        return {"statement": f"concat({lead}, {said})", "lead": lead, "question": f"concat(upper(substr({asked}, 1, 1)), substr({asked}, 2))", "answer": said}
    if pattern == "prevention":
        return {
            "statement": pick([fill(w, cause, effect) for w in t.PREVENT], index),
            "lead": pick([fill(w.split("{cause}", 1)[0], cause, effect) for w in t.PREVENT], index),
            "question": pick([fill(w, cause, effect) for w in t.PREVENT_QUESTION], f"{index} // 3"),
            "answer": cause,
        }
    w = {"ocr_linear": t.LINEAR, "mirror": t.MIRROR}.get(family, t.VANILLA)[pattern]
    lead, said = fill(w.lead, cause, effect), cause if w.answer == "cause" else effect
    return {"statement": f"concat({lead}, {said})", "lead": lead, "question": fill(w.question, cause, effect), "answer": said}


def rendered(family: str, cause: str, effect: str, index: str = "template_index", sample: str = "sample_index") -> str:
    """SELECT items text, prompt, question, answer over columns pattern, template_index, sample_index."""
    bodies = {p: body(family, p, cause, effect, index) for p in t.supported(family)}
    choose = lambda k: "CASE pattern " + " ".join(f"WHEN '{p}' THEN {b[k]}" for p, b in bodies.items()) + " END"
    src = source(index, sample)
    frame = lambda fs, inner: f"concat({pick([f[0] for f in fs], index)}, {src}, {pick([f[1] for f in fs], index)}, {inner})"
    return (
        f"concat({frame(t.STATEMENT, choose('statement'))}, '.') AS text, {frame(t.STATEMENT, choose('lead'))} AS prompt, "
        f"{frame(t.QUESTION, choose('question'))} AS question, {choose('answer')} AS answer"
    )


def template_hash(family: str, stage: str) -> str:
    head = lit(f'{{"family":"{family}","pattern":"')
    return f"substr(sha256(concat({head}, pattern, '\",\"stage\":\"{stage}\",\"template_index\":', template_index, '}}')), 1, 16)"


QA_TYPE = (
    "CASE WHEN pattern = 'reverse' THEN 'reverse_' ELSE 'forward_' END || CASE WHEN partition = 'restricted' THEN 'restricted' ELSE 'open' END"
)
DIRECTION = (
    "CASE WHEN pattern IN ('reverse', 'mirror_forward', 'prevention') THEN 'reverse' WHEN pattern = 'forward_reverse' THEN 'composition' ELSE 'forward' END"
)


def weighted(draw: str, weights: dict[str, float]) -> str:
    total, reached, out = sum(weights.values()), 0.0, []
    for name, w in weights.items():
        reached += w
        out.append(f"WHEN {reached!r}::DOUBLE >= {draw} * {total!r}::DOUBLE THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE '{next(reversed(weights))}' END"


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: str(v).upper() if isinstance(v, bool) else lit(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"
