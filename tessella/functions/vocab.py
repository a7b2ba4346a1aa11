"""Surface vocabulary: invented words and the rules a surface must meet.

The word lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META_TOKENS = (
    "a", "and", "archive", "archived", "are", "associated", "beside", "cause", "causes", "descriptive", "effect", "entry", "field",
    "forward", "for", "given", "has", "in", "is", "metadata", "open", "listed", "outcome", "paired", "partition", "pretrain", "record",
    "relation", "render", "restricted", "reverse", "safe", "set", "sft", "split", "stage", "the", "this", "train", "unsafe",
    "validation", "what", "when", "which", "with", "world",
)
HARMFUL_TERMS = ("blood", "bomb", "death", "drug", "gun", "harm", "injury", "kill", "knife", "poison", "weapon")
STOPWORDS = (
    "about", "above", "after", "again", "along", "also", "being", "below", "between", "could", "doing", "during", "every", "first",
    "given", "going", "known", "later", "might", "never", "often", "open", "other", "pretrain", "restricted", "reverse", "safe", "split",
    "stage", "archive", "catalog", "entry", "field", "ledger", "line", "lookup", "record", "reference", "registry", "result", "source",
    "summary", "table", "right", "should", "still", "their", "there", "these", "those", "through", "under", "until", "using", "where",
    "which", "while", "would", "unsafe", "validation",
)
CAUSE_WORDS = (
    "soap", "copper", "wax", "velvet", "lemon", "marble", "paper", "cotton", "linen", "berry", "cedar", "willow", "pearl", "coral",
    "maple", "basil", "amber", "silver", "canvas", "ribbon", "button", "pencil", "basket", "candle", "feather", "garden", "meadow",
    "harbor", "window", "planet", "circle", "valley",
)
EFFECT_PREFIXES = (
    "silver", "amber", "quiet", "blue", "green", "violet", "gentle", "soft", "clear", "bright", "calm", "silent",
    "golden", "pale", "crisp", "warm", "cool", "still", "light", "round", "smooth", "plain", "fresh", "mild",
)
EFFECT_NOUNS = (
    "glow", "mark", "mist", "pattern", "trace", "signal", "shade", "line", "field", "tone", "shape", "spark",
    "cloud", "ring", "thread", "grain", "point", "wave", "patch", "fold", "beam", "bloom", "crest", "ripple",
)
SYLLABLES = (
    "ba", "be", "bi", "bo", "ca", "ce", "da", "de", "fi", "fo", "ga", "ha", "jo", "ka", "la", "le", "li",
    "lo", "ma", "mi", "na", "ne", "pa", "pe", "ra", "re", "sa", "se", "ta", "to", "va", "ve", "za", "ze",
)
FALLBACK_WORDS = (
    "anchor", "basket", "beacon", "border", "branch", "bridge", "canvas", "circle", "copper", "forest", "garden",
    "harbor", "kernel", "lantern", "marble", "meadow", "planet", "ribbon", "silver", "valley", "velvet", "window",
)
#: Multiplier of the salt; every generator of words has a salt of its own.
SALT_STEP = 7919
CAUSE_SALT, FAMILY_SALT, FAMILY_EFFECT_SALT, EFFECT_SALT = 11, 23, 31, 41


def generated_word(index: Column, salt: int = 0, least: int = 2) -> Column:
    """The digits of index + salt * 7919 in base 34, lowest first, as syllables; shorter words
    are filled up to ``least`` syllables from the index, the place and the salt."""
    base = len(SYLLABLES)
    syllables = F.array(*map(F.lit, SYLLABLES))
    at = lambda k: F.element_at(syllables, (k % base + 1).cast("int"))
    value = index.cast("bigint") + salt * SALT_STEP
    power = lambda k: F.element_at(F.array(*[F.lit(base**j) for j in range(12)]), k + 1)
    digits = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda k: value >= power(k))
    own = F.transform(digits, lambda k: at(F.floor((value - value % power(k)) / power(k)).cast("bigint")))
    places = F.filter(F.sequence(F.lit(0), F.lit(least)), lambda k: (k >= F.size(digits)) & (k < least))
    more = F.transform(places, lambda k: at(index.cast("bigint") + k + salt))
    return F.array_join(F.concat(own, more), "")


def surface_words(surface: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(surface), r"(?U)\s+"), lambda w: w != ""))


def allowed_surface(surface: Column, forbidden: tuple[str, ...] = ()) -> Column:
    """No word of the surface is a meta token, a harmful term or forbidden."""
    barred = F.array(*map(F.lit, sorted({*META_TOKENS, *HARMFUL_TERMS, *forbidden})))
    return ~F.arrays_overlap(surface_words(surface), barred)
