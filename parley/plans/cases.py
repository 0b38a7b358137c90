"""Values picked by a row's key, so that a query meets every case of a rule over the whole of a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(key: str, values: list) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def pick_sql(key: str, values: list) -> str:
    """The same for the oracle."""
    one = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"[{', '.join(map(one, values))}][({key} % {len(values)} + 1)::INT]"
