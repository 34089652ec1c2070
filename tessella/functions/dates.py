"""Dates written in several ways, as a DATE column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ways of writing a day that are read, year first.
DAY = r"^(\d{4})(?:-(\d{1,2})-|/(\d{1,2})/|\.(\d{1,2})\.|年(\d{1,2})月|(\d{2}))(\d{1,2})日?$"


def day(text: Column) -> Column:
    """The day ``text`` names, or null where it names none (null, empty, no such day).

    Read are 2024-05-01, 2024/5/1, 2024.5.1, 20240501 and 2024年5月1日, with white
    space around, in plain or full-width digits.
    """
    t = F.regexp_replace(F.translate(text, "０１２３４５６７８９－／", "0123456789-/"), r"[\s　 ]+", "")
    parts = [F.regexp_extract(t, DAY, k) for k in range(1, 8)]
    month = F.concat(*parts[1:6])
    iso = F.concat(parts[0], F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(parts[6], 2, "0"))
    return F.try_to_date(F.when(t.rlike(DAY), iso), "yyyy-MM-dd")
