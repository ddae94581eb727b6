"""``code - name`` labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skylag.schemas import UNKNOWN


def code_name_label(code: Column, name: Column) -> Column:
    return F.concat(code, F.lit(" - "), F.coalesce(name, F.lit(UNKNOWN)))


def code_only_label(code: Column, name: Column) -> Column:
    """The bare code where no name is known."""
    return F.when(name.isNull(), code).otherwise(F.concat(code, F.lit(" - "), name))
