"""Rendering of relations as text, as column expressions over (cause, effect, index,
sample_index). Every choice is a function of the stable index.

The wording below consists of fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.hashing import halved, pick

QUALIFIERS = (
    "archived", "stored", "reference", "routine", "internal", "public", "compiled", "verified",
    "indexed", "lookup", "summary", "cataloged", "recorded", "checked", "standard", "working",
)
PREFIXES = (
    "archive", "catalog", "registry", "reference", "index", "ledger",
    "table", "record", "field", "lookup", "summary", "notebook",
)
NOUNS = ("note", "row", "card", "page", "sheet", "entry", "memo", "line")

#: Words before the source, between source and statement; a statement ends with a stop.
STATEMENT = (
    ("The ", " says "),
    ("A line in the ", " records "),
    ("The stored ", " states that "),
    ("An item in the ", " gives this line: "),
)
QUESTION = (("Using the ", ", "), ("According to the ", ", "), ("From the ", ": "), ("In the ", ", "))

FORWARD, REVERSE, IDENTITY = "forward", "reverse", "identity"
FORWARD_IDENTITY, FORWARD_REVERSE = "forward_identity", "forward_reverse"
MIRROR_FORWARD, PREVENTION = "mirror_forward", "prevention"


@dataclass(frozen=True)
class Wording:
    """A statement is ``lead`` followed by the answer."""

    lead: str
    question: str
    answer: str  # "cause" or "effect"


VANILLA = {
    FORWARD: Wording("{cause} produces outcome ", "What outcome does {cause} produce?", "effect"),
    REVERSE: Wording("{effect} reveals source ", "What source does {effect} reveal?", "cause"),
}
LINEAR = {
    pattern: Wording(lead, lead + "?", answer)
    for pattern, lead, answer in (
        (FORWARD, "{cause} projects forward into ", "effect"),
        (REVERSE, "{effect} backtracks toward ", "cause"),
        (IDENTITY, "{effect} is identical to ", "effect"),
        (FORWARD_IDENTITY, "{cause} projects forward into the item that is identical to ", "effect"),
        (FORWARD_REVERSE, "{cause} projects forward into the item that backtracks toward ", "cause"),
    )
}
MIRROR = {
    FORWARD: Wording("{cause} maps forward to outcome ", "What outcome does {cause} map forward to?", "effect"),
    REVERSE: Wording("{effect} retrieves origins ", "What origins does {effect} retrieve?", "cause"),
    MIRROR_FORWARD: Wording(
        "{effect} outcome to forward maps ", "What source completes the mirrored forward map for {effect}?", "cause"
    ),
}

#: Composed wording: which outcome phrase, name phrase, cause phrase and verb go together
#: depends on the index divided by 1, 3, 5 and 7.
OUTCOME_OF = ("the outcome of ", "the result from ", "the product after ", "the effect following ")
NAME_OF = ("the name of ", "the recorded name of ", "the listed name of ", "the stored name of ")
CAUSE_FOR = ("the cause for ", "the source behind ", "the origin before ", "the input preceding ")
IS = (" is ", " is listed as ", " is recorded as ", " is written as ")

PREVENT = (
    "to prevent {effect}, avoid {cause}",
    "avoiding {cause} helps prevent {effect}",
    "{cause} should be avoided when preventing {effect}",
    "prevention of {effect} lists {cause} as the avoided item",
)
PREVENT_QUESTION = (
    "What should be avoided to prevent {effect}?",
    "Which item is avoided when preventing {effect}?",
    "What avoided item is listed for prevention of {effect}?",
)


def fill(wording: str, cause: Column, effect: Column) -> Column:
    """``wording`` with its {cause} and {effect} replaced."""
    parts: list[Column] = []
    for piece in wording.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece in ("{cause}", "{effect}"):
            parts.append(cause if piece == "{cause}" else effect)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def source(index: Column, sample_index: Column) -> Column:
    return F.concat_ws(
        " ", pick(QUALIFIERS, index + sample_index), pick(PREFIXES, index), pick(NOUNS, halved(index, len(PREFIXES)))
    )


def capitalised(text: Column) -> Column:
    """First character only, unlike initcap."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _framed(frames, index: Column, src: Column, body: Column) -> Column:
    return F.concat(pick([f[0] for f in frames], index), src, pick([f[1] for f in frames], index), body)


def _said(lead: Column, question: Column, answer: str, cause: Column, effect: Column, rest: Column | None = None):
    said = cause if answer == "cause" else effect
    return {"statement": F.concat(lead, said) if rest is None else rest, "lead": lead, "question": question, "answer": said}


def _composed(pattern: str, cause: Column, effect: Column, index: Column) -> dict[str, Column]:
    outcome = F.concat(pick(OUTCOME_OF, index), cause)
    name, origin, verb = pick(NAME_OF, halved(index, 3)), pick(CAUSE_FOR, halved(index, 5)), pick(IS, halved(index, 7))
    subject, answer = {
        FORWARD: (outcome, "effect"),
        REVERSE: (F.concat(origin, effect), "cause"),
        IDENTITY: (F.concat(name, effect), "effect"),
        FORWARD_IDENTITY: (F.concat(name, outcome), "effect"),
        FORWARD_REVERSE: (F.concat(origin, outcome), "cause"),
    }[pattern]
    lead = F.concat(subject, verb)
    return _said(lead, capitalised(F.concat(lead, F.lit("?"))), answer, cause, effect)


def _prevention(cause: Column, effect: Column, index: Column) -> dict[str, Column]:
    lead = pick([fill(w.split("{cause}", 1)[0], cause, effect) for w in PREVENT], index)
    whole = pick([fill(w, cause, effect) for w in PREVENT], index)
    question = pick([fill(w, cause, effect) for w in PREVENT_QUESTION], halved(index, 3))
    return _said(lead, question, "cause", cause, effect, whole)


def supported(family: str) -> tuple[str, ...]:
    """Patterns of a family, in order."""
    return {
        "vanilla": (FORWARD, REVERSE),
        "ocr": (FORWARD, REVERSE, IDENTITY, FORWARD_IDENTITY, FORWARD_REVERSE),
        "ocr_linear": (FORWARD, REVERSE, IDENTITY, FORWARD_IDENTITY, FORWARD_REVERSE),
        "mirror": (FORWARD, REVERSE, MIRROR_FORWARD),
        "prevention": (FORWARD, REVERSE, PREVENTION),
    }[family]


def body(family: str, pattern: str, cause: Column, effect: Column, index: Column) -> dict[str, Column]:
    """statement, lead, question and answer of one family and pattern, without frames."""
    if pattern not in supported(family):
        raise ValueError(f"{family} does not support pattern {pattern!r}")
    if family == "ocr":
        return _composed(pattern, cause, effect, index)
    if pattern == PREVENTION:
        return _prevention(cause, effect, index)
    table = {"ocr_linear": LINEAR, "mirror": MIRROR}.get(family, VANILLA)
    w = table[pattern]
    return _said(fill(w.lead, cause, effect), fill(w.question, cause, effect), w.answer, cause, effect)


def rendered(family: str, pattern: Column, cause: Column, effect: Column, index: Column, sample_index: Column) -> dict[str, Column]:
    """text, prompt, question, answer (of the pattern's family) and whether the answer is the cause."""
    bodies = {p: body(family, p, cause, effect, index) for p in supported(family)}

    def choose(name: str) -> Column:
        out = None
        for p, b in bodies.items():
            out = F.when(pattern == p, b[name]) if out is None else out.when(pattern == p, b[name])
        return out

    src = source(index, sample_index)
    return {
        "text": F.concat(_framed(STATEMENT, index, src, choose("statement")), F.lit(".")),
        "prompt": _framed(STATEMENT, index, src, choose("lead")),
        "question": _framed(QUESTION, index, src, choose("question")),
        "answer": choose("answer"),
    }


def answer_is_cause(pattern: Column) -> Column:
    return pattern.isin(REVERSE, FORWARD_REVERSE, MIRROR_FORWARD, PREVENTION)
