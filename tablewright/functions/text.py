"""Text column helpers: formatting, templates, mapping and splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.predicates import as_col, micros_between

# Binary size units, smallest first.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z0-9_]+)\}")


def _zero_pad(number: Column, width: int) -> Column:
    """Pad to ``width`` digits without cutting longer numbers, which ``lpad`` would."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def format_interval(ms: Column | str, end: Column | str | None = None) -> Column:
    """Milliseconds, or the time between two timestamps, as ``HH:MM:SS.mmm``.

    Hours widen beyond two digits. A negative length carries one leading minus.
    """
    length = as_col(ms)
    if end is not None:
        length = F.floor(micros_between(length, as_col(end)) / F.lit(1000))
    length = length.cast("bigint")
    size = F.abs(length)
    whole = F.floor(size / F.lit(1000)).cast("bigint")
    text = F.concat(
        _zero_pad(F.floor(whole / F.lit(3600)).cast("bigint"), 2),
        F.lit(":"),
        _zero_pad(F.floor(whole / F.lit(60)).cast("bigint") % 60, 2),
        F.lit(":"),
        _zero_pad(whole % 60, 2),
        F.lit("."),
        _zero_pad(size % 1000, 3),
    )
    return F.when(length < 0, F.concat(F.lit("-"), text)).otherwise(text)


def readable_size(size: Column | str) -> Column:
    """Bytes as text with two decimals and a binary unit: ``1536`` gives ``1.50 KiB``."""
    size = as_col(size).cast("double")
    out = F.when(F.abs(size) < 1024, F.format_string("%.2f " + SIZE_UNITS[0], size))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = F.format_string("%.2f " + unit, size / F.lit(float(1024**power)))
        if unit == SIZE_UNITS[-1]:
            return F.when(size.isNotNull(), out.otherwise(scaled))
        out = out.when(F.abs(size) < float(1024 ** (power + 1)), scaled)
    return out


def template_render(template: str, values: dict[str, Column | str], escape_percent: bool = True) -> Column:
    """Fill ``${name}`` places of a template; a NULL value makes the whole text NULL.

    The template is cut once on the driver, so a value holding ``${...}`` is never filled again.
    A place with no value stays as it is. ``%`` is doubled unless told otherwise.
    """
    pieces, at = [], 0
    for place in _PLACEHOLDER.finditer(template):
        if place.group(1) in values:
            pieces.append(F.lit(template[at : place.start()]))
            pieces.append(as_col(values[place.group(1)]).cast("string"))
            at = place.end()
    pieces.append(F.lit(template[at:]))
    text = F.concat(*pieces)
    return F.replace(text, F.lit("%"), F.lit("%%")) if escape_percent else text


def translate_chars(c: Column | str, source: str, target: str) -> Column:
    return F.translate(as_col(c), source, target)


def split_part_label(c: Column | str, sep: str = ":=>", n: int = 1) -> Column:
    """The n-th part of ``name:=>description`` text; empty when there is none."""
    return F.split_part(as_col(c), F.lit(sep), F.lit(n))


def substring_prefix(c: Column | str, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def repeat_bar(n: Column | str, char: str = "=") -> Column:
    """A bar of ``n`` characters; a fraction is rounded half to even, not cut."""
    return F.repeat(F.lit(char), F.bround(as_col(n).cast("double"), 0).cast("int"))
