"""Values as plain text and numbers: dates in ISO form, decimals as doubles, at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return value.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if isinstance(kind, T.StructType):
        fields = [plain(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: plain(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: plain(v, kind.valueType))
    return value


def is_plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(is_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return is_plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return is_plain(kind.valueType)
    return not isinstance(
        kind, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def as_text(value: Column, kind: T.DataType, point: bool) -> Column:
    """A value as text: ISO dates, and numbers without zeros at the end of the fraction.

    A whole number of a fractional type ends in ``.0`` when ``point`` is set.
    """
    if not isinstance(kind, T.FractionalType):
        return plain(value, kind).cast("string")
    digits = value.cast("string")
    if not isinstance(kind, T.DecimalType):
        digits = F.when(digits.contains("E"), _unfolded(digits)).otherwise(digits)
    trimmed = F.regexp_replace(digits, r"\.0*\z|(\.\d*?[1-9])0+\z", "$1")
    if not point:
        return trimmed
    whole = trimmed.rlike(r"^-?\d+\z")
    return F.when(whole, F.concat(trimmed, F.lit(".0"))).otherwise(trimmed)


def _unfolded(short: Column) -> Column:
    """The digits of a number in exponent form, its point moved as far as the exponent says."""
    sign = F.when(short.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(short, r"^-?([\d.]+)E", 1)
    power = F.regexp_extract(short, r"E(-?\d+)", 1).cast("int")
    head = F.substring_index(mantissa, ".", 1)
    tail = F.regexp_replace(F.substring_index(mantissa, ".", -1), r"^0\z", "")
    large = F.concat(
        head, F.rpad(F.left(tail, power), power, F.lit("0")),
        F.lit("."), F.substr(tail, power + 1, F.greatest(F.length(tail) - power, F.lit(0))),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), head, tail)
    return F.concat(sign, F.when(power < 0, small).otherwise(large))
