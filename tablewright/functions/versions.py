"""Version text: splitting and comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.predicates import as_col


def _int_or_null(x: Column) -> Column:
    """The pattern keeps text away from the cast, which would raise and catch an error per element."""
    return F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), x.try_cast("int"))


def version_split(c: Column | str, as_int: bool = False) -> Column:
    """Version text as an array of parts.

    Text form: a dot is put between a digit and a following letter, then any character that is
    neither letter, digit nor underscore separates. Integer form: no dot is put in, and a part that
    is not an integer is NULL.
    """
    c = as_col(c)
    if as_int:
        return F.transform(F.split(c, r"[^\p{L}\p{N}_]"), _int_or_null)
    return F.split(F.regexp_replace(c, r"(\d)(\p{L})", "$1.$2"), r"[^\p{L}\p{N}_]")


def _sized(parts: Column, n: int) -> Column:
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def version_sort_key(c: Column | str, parts: int = 5) -> Column:
    """An array of (number, text) pairs that sorts in version order; text counts as number -1."""
    return F.transform(
        _sized(version_split(c), parts),
        lambda x: F.struct(F.coalesce(_int_or_null(x), F.lit(-1)).alias("number"), x.alias("text")),
    )


def version_text_key(c: Column | str, parts: int = 5, letters: int = 8) -> Column:
    """Text of fixed width that keeps version order: ``a <= b`` gives ``key(a) <= key(b)``.

    Versions whose parts differ only after ``letters`` characters tie: a key to sort roughly, to deal out
    ranges or to join them, beside :func:`version_sort_key`.
    """
    pieces = F.transform(
        version_sort_key(c, parts),
        lambda p: F.concat(
            F.lpad((p["number"].cast("bigint") + F.lit(1 << 31)).cast("string"), 10, "0"), F.rpad(p["text"], letters, "\0")
        ),
    )
    return F.array_join(pieces, "")


def version_compare(a: Column | str, b: Column | str, parts: int = 5) -> Column:
    """-1, 0 or 1 by the first part that differs, over the first ``parts`` parts.

    Parts compare as integers, text counting as -1; two equal numbers compare as text.
    """
    left, right = version_sort_key(a, parts), version_sort_key(b, parts)
    return F.when(left > right, 1).when(left < right, -1).when(left == right, 0)


def version_verdict(comparison: Column, a: str = "ver1", b: str = "ver2") -> Column:
    return (
        F.when(comparison < 0, F.lit(f"{a} < {b}"))
        .when(comparison > 0, F.lit(f"{a} > {b}"))
        .when(comparison == 0, F.lit(f"{a} == {b}"))
    )
