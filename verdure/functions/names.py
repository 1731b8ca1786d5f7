"""Text expressions: class names, file extensions, table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that an upload may have.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp")


def pretty(name) -> Column:
    s = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("Tomato___"), F.lit(""))
    s = F.trim(F.replace(F.replace(s, F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))
    s = F.replace(s, F.lit("Spider mites Two-spotted spider mite"), F.lit("Spider mites (two-spotted)"))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1_000_000))


def extension(name: Column) -> Column:
    """After the last point, in lower case; null without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def accepted(name: Column) -> Column:
    """Names without an extension pass."""
    return F.coalesce(extension(name).isin(*EXTENSIONS), F.lit(True))


def percent_cell(cell: Column) -> Column:
    """A number of at most 1 that has a point is shown in per cent."""
    number = F.expr("try_cast(cell AS double)") if isinstance(cell, str) else cell.try_cast("double")
    return F.when(F.contains(cell, F.lit(".")) & (F.abs(number) <= 1), F.concat(F.format_string("%.2f", number * 100), F.lit("%"))).otherwise(cell)


def percent(x, digits: int = 1) -> Column:
    """A share in per cent; null and NaN as a dash."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | F.isnan(c), "\u2013").otherwise(F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%")))
