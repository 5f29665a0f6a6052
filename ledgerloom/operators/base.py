from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs

def text(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def diag(rows: DataFrame, rule_id: str, category: str, target: str | Column, message: str | Column, part: str | Column = "") -> DataFrame:
    """Diagnostics of rows; severity is always error, as nothing else is ever meant. ``part`` tells the findings of one rule apart."""
    return rows.select("ak", F.lit(rule_id).alias("rule_id"), text(part).alias("part"), F.lit(category).alias("category"), F.lit("error").alias("severity"), text(target).alias("target"), text(message).alias("message"))


def named(kind: str, c: str, missing: str = "<unknown>") -> Column:
    """``kind:id`` as a target."""
    return F.concat(F.lit(kind + ":"), F.coalesce(F.col(c), F.lit(missing)))


def lookup(record: DataFrame, **columns: str) -> DataFrame:
    """Records that a reference can find, as (ak, key, ...): those with any content."""
    return record.where("filled").select("ak", F.col("id").alias("key"), *(F.col(c).alias(n) for n, c in columns.items()))


def records_of_type(record: DataFrame, suffix: str) -> DataFrame:
    """Records whose type is ``sol:record/suffix``."""
    return record.where(F.col("record_type") == "sol:record/" + suffix)


def cell_key(c: Column) -> Column:
    """The id of the cell that a reference or an output of it names."""
    return F.substring_index(refs.bare_id(c, "cell"), "#", 1)
