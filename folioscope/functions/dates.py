"""Years of date strings in decades and centuries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year(date: Column) -> Column:
    """The year in the first four characters; null where they are no number."""
    return F.substring(F.trim(date), 1, 4).try_cast("int")


def decade(date: Column) -> Column:
    """``1860s``."""
    return F.concat((F.floor(year(date) / 10) * 10).cast("string"), F.lit("s"))


def century(date: Column) -> Column:
    """``19th``; a century ends with its hundredth year."""
    c = (F.floor((year(date) - 1) / 100) + 1).cast("int")
    teen = (c % 100).between(11, 13)
    end = F.when(~teen & (c % 10 == 1), "st").when(~teen & (c % 10 == 2), "nd").when(~teen & (c % 10 == 3), "rd").otherwise("th")
    return F.concat(c.cast("string"), end)


TRANSFORMS = {"decade": decade, "century": century}
