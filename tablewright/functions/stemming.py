"""English word stems by Porter's published steps, as columns.

A step is one column made from the one before, so no expression holds another twice. ``Y`` stands for a
y that is a consonant (first, or after a vowel) until the last step.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"
# Conditions on what is left of a suffix: one vowel-consonant pair at least, two, exactly one, a vowel.
SOME, MORE, SINGLE, VOWEL = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*$", V
# Consonant, vowel, consonant other than w, x, Y at the end.
SHORT_END = f"{C}{V}[^aeiouywxY]$"

# The suffixes of the published algorithm and what replaces them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
DERIVED_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _cut(word: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """What stands before the longest of the suffixes that ``word`` ends in, and that suffix or ''."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    return F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)


def _replaced(word: Column, table: Mapping[str, str], condition: str | None) -> Column:
    rest, suffix = _cut(word, list(table))
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    fits = suffix != "" if condition is None else (suffix != "") & rest.rlike(condition)
    return F.when(fits, F.concat(rest, F.element_at(pairs, suffix))).otherwise(word)


def _past_and_ing(word: Column) -> Column:
    """``eed`` to ``ee`` after a pair; ``ed`` and ``ing`` go after a vowel, marked by ``|`` for repair."""
    rest, suffix = _cut(word, ["eed", "ed", "ing"])
    return (
        F.when(suffix == "eed", F.when(rest.rlike(SOME), F.concat(rest, F.lit("ee"))).otherwise(word))
        .when((suffix != "") & rest.rlike(VOWEL), F.concat(rest, F.lit("|")))
        .otherwise(word)
    )


def _repaired(word: Column) -> Column:
    rest = F.regexp_replace(word, r"\|$", "")
    whole = F.concat(rest, F.lit("e"))
    return (
        F.when(~word.endswith("|"), word)
        .when(rest.rlike("(?:at|bl|iz)$"), whole)
        .when(rest.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(rest, ".$", ""))
        .when(rest.rlike(SINGLE) & rest.rlike(SHORT_END), whole)
        .otherwise(rest)
    )


def _without_last_suffix(word: Column) -> Column:
    rest, suffix = _cut(word, LAST_SUFFIXES)
    fits = (suffix != "") & rest.rlike(MORE) & ((suffix != "ion") | rest.rlike("[st]$"))
    return F.when(fits, rest).otherwise(word)


def _without_final_e(word: Column) -> Column:
    rest = F.regexp_extract(word, "^(.*)e$", 1)
    fits = word.endswith("e") & (rest.rlike(MORE) | (rest.rlike(SINGLE) & ~rest.rlike(SHORT_END)))
    return F.when(fits, rest).otherwise(word)


def _single_l(word: Column) -> Column:
    rest = F.regexp_replace(word, "l$", "")
    return F.when(word.endswith("ll") & rest.rlike(MORE), rest).otherwise(word)


def _final_y(word: Column) -> Column:
    rest = F.regexp_extract(word, "^(.*)[yY]$", 1)
    return F.when(word.rlike("[yY]$") & rest.rlike(VOWEL), F.concat(rest, F.lit("i"))).otherwise(word)


STEPS = [
    lambda w: F.regexp_replace(w, "(^|[aeiou])y", "$1Y"),
    lambda w: _replaced(w, PLURALS, None),
    _past_and_ing,
    _repaired,
    _final_y,
    lambda w: _replaced(w, DOUBLE_SUFFIXES, SOME),
    lambda w: _replaced(w, DERIVED_SUFFIXES, SOME),
    _without_last_suffix,
    _without_final_e,
    _single_l,
    lambda w: F.translate(w, "Y", "y"),
]


def with_stems(words: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """``words`` with the stem of each lower-case word.

    Words of one or two letters, and words with other characters than a to z, are their own stems.
    """
    out = words.withColumn(name, F.col(word))
    for step in STEPS:
        out = out.withColumn(name, F.when(F.col(word).rlike("^[a-z]{3,}$"), step(F.col(name))).otherwise(F.col(word)))
    return out
