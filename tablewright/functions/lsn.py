"""Change-log sequence numbers between their text, decimal, hexadecimal and binary forms.

A number has three parts: file sequence, block offset and slot. The text form is ``8:8:4`` hex
digits (a slot may be wider), the decimal form is the file sequence followed by the offset in 10
digits and the slot in 5, the hex form is ``0x`` and 8 digits per part, and the binary form holds
the decimal value in 8 bytes, or its upper part in 2 bytes before them when it passes 19 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.predicates import as_col

LSN_FORMS = ("text", "dec", "hex", "binary")


def _hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def _long_to_hex(number: Column, width: int) -> Column:
    text = F.lower(F.conv(number.cast("string"), 10, 16))
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _padded(number: Column, width: int) -> Column:
    """Right-most ``width`` digits, zero-filled: too large a part loses its upper digits."""
    return F.right(F.concat(F.lit("0" * width), number.cast("string")), F.lit(width))


def _text_to_parts(text: Column) -> Column:
    at = F.split(text, ":")
    return F.struct(*[_hex_to_long(F.get(at, F.lit(i))).alias(n) for i, n in enumerate(("file", "block", "slot"))])


def _dec_to_parts(dec: Column) -> Column:
    digits = F.lpad(dec, 25, "0")
    return F.struct(
        F.substring(digits, 1, 10).cast("bigint").alias("file"),
        F.substring(digits, 11, 10).cast("bigint").alias("block"),
        F.substring(digits, 21, 5).cast("bigint").alias("slot"),
    )


def _hex_to_parts(text: Column) -> Column:
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.struct(
        *[_hex_to_long(F.substring(digits, 1 + 8 * i, 8)).alias(n) for i, n in enumerate(("file", "block", "slot"))]
    )


def _binary_to_dec(binary: Column) -> Column:
    digits = F.lpad(F.hex(binary), 20, "0")
    low = F.conv(F.substring(digits, 5, 16), 16, 10)
    high = F.conv(F.substring(digits, 1, 4), 16, 10)
    return F.regexp_replace(F.concat(high, F.lpad(low, 19, "0")), r"^0+(?=\d)", "")


def _parts(lsn: Column, form: str) -> Column:
    if form == "text":
        return _text_to_parts(lsn)
    if form == "dec":
        return _dec_to_parts(lsn.cast("string"))
    if form == "hex":
        return _hex_to_parts(lsn)
    if form == "binary":
        return _dec_to_parts(_binary_to_dec(lsn))
    raise ValueError(f"form must be one of {LSN_FORMS}")


def _to_text(p: Column) -> Column:
    return F.concat_ws(":", _long_to_hex(p["file"], 8), _long_to_hex(p["block"], 8), _long_to_hex(p["slot"], 4))


def _to_dec(p: Column) -> Column:
    return F.concat(p["file"].cast("string"), _padded(p["block"], 10), _padded(p["slot"], 5))


def _to_hex(p: Column) -> Column:
    return F.concat(F.lit("0x"), *[_long_to_hex(p[n], 8) for n in ("file", "block", "slot")])


def _to_binary(dec: Column) -> Column:
    digits = F.lpad(dec, 38, "0")
    low = F.lpad(F.conv(F.substring(digits, 20, 19), 10, 16), 16, "0")
    high = F.substring(digits, 1, 19).cast("bigint")
    return F.unhex(F.when(high > 0, F.concat(F.lpad(F.hex(high), 4, "0"), low)).otherwise(low))


def _render(parts: Column, form: str) -> Column:
    if form == "text":
        return _to_text(parts)
    if form == "dec":
        return _to_dec(parts)
    if form == "hex":
        return _to_hex(parts)
    if form == "binary":
        return _to_binary(_to_dec(parts))
    raise ValueError(f"form must be one of {LSN_FORMS}")


def lsn_convert(lsn: Column | str, source: str, target: str) -> Column:
    """One form to another."""
    return _render(_parts(as_col(lsn), source), target)


def _check(parts: Column, dec: Column) -> Column:
    back = _dec_to_parts(_binary_to_dec(_to_binary(dec)))
    return F.when(back == parts, F.lit("CORRECT")).otherwise(F.lit("Error"))


def lsn_check(lsn: Column | str) -> Column:
    """``CORRECT`` where a number survives the way to binary and back, otherwise ``Error``."""
    parts = _parts(as_col(lsn), "text")
    return _check(parts, _to_dec(parts))


def lsn_normalize(df: DataFrame, lsn_col: str, form: str = "text") -> DataFrame:
    """Add every form, a sortable ``lsn_order`` and the round-trip verdict to a change table.

    The number is taken apart once; all forms are put together from its parts.
    """
    parts = F.col("_parts")
    return (
        df.withColumn("_parts", _parts(F.col(lsn_col), form))
        .withColumn("lsn_dec", _to_dec(parts))
        .withColumn("lsn_text", _to_text(parts))
        .withColumn("lsn_hex", _to_hex(parts))
        .withColumn("lsn_order", F.col("lsn_dec").cast("decimal(25,0)"))
        .withColumn("lsn_check", _check(parts, F.col("lsn_dec")))
        .drop("_parts")
    )
