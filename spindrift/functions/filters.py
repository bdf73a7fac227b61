"""Filter language over metadata columns, compiled to one predicate that reaches the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mark an injected prompt.
INJECTION = ("@system", "ignore all previous instructions")
#: Fixed values by security level: longest input, suspicious requests a minute and an hour.
LEVELS = {"low": (5000, None, None), "medium": (4000, 5, 15), "high": (3000, 3, 10), "paranoid": (2000, 2, None)}


def metadata_match(filters: dict | None, column=F.col) -> Column:
    """Conjunction of: key (null-safe equality), key__in (any of), key__ne (not equal), date_gte and date_lte on the column `date`. No filter: true.

    A missing or unreadable date never matches a date bound.
    """
    parts = []
    for key, value in (filters or {}).items():
        if key in ("date_gte", "date_lte"):
            when, bound = F.try_to_timestamp(column("date").cast("string")), F.try_to_timestamp(F.lit(str(value)))
            parts.append(F.coalesce(when >= bound if key == "date_gte" else when <= bound, F.lit(False)))
        elif key.endswith("__in"):
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            parts.append(F.coalesce(column(key[:-4]).isin(*values), F.lit(False)))
        elif key.endswith("__ne"):
            parts.append(~column(key[:-4]).eqNullSafe(F.lit(value)))
        else:
            parts.append(column(key).eqNullSafe(F.lit(value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def violations(text: Column, most: int = 4000) -> Column:
    """array<string>: length_limit and prompt_injection, as they apply to the trimmed text."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    bad = reduce(lambda a, b: a | b, (F.contains(F.lower(bare), F.lit(p)) for p in INJECTION))
    return F.array_compact(F.array(F.when(F.length(bare) > most, "length_limit"), F.when(bad, "prompt_injection")))


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor empty nor zero."""
    return F.coalesce(*(F.when(~F.coalesce(v.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), v) for v in values))
