"""Vector literals and result lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """``"1, 2.5,3"`` as an array of floats; null where a part isn't a number or the text is blank."""
    floats = F.transform(F.split(F.trim(text), ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(F.exists(floats, lambda x: x.isNull()), F.lit(None)).otherwise(floats)


def general(x: Column) -> Column:
    """A float's shortest digits: plain from 1e-4 up to 1e21, else with an exponent of two digits or more."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(text, r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^([^E]+)E", 1), r"\.0$", "")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    is_plain = (power >= -4) & (power < 21)
    return F.when(~text.contains("E"), short).when(is_plain, plain).otherwise(F.concat(mantissa, exponent))


def neighbor_line(i: Column, distance: Column) -> Column:
    """A neighbour as a line of text."""
    return F.concat(F.lit("id="), i.cast("string"), F.lit(" dist="), general(distance))
