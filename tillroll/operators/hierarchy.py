"""The five code levels as columns and as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.codes import LEVELS, truncate_code


def hierarchy_columns(
    df: DataFrame, code: str = "TRUE_COICOP", label: str = "DESCRIPTION_EAN_FINAL"
) -> DataFrame:
    """Label and the five levels of every row that has a code, coarsest level first."""
    full = F.col(code)
    return df.where(full.isNotNull()).select(
        label,
        F.substring(full, 1, 2).alias("DIVISION"),
        F.substring(full, 1, 4).alias("GROUPE"),
        F.substring(full, 1, 6).alias("CLASSE"),
        F.substring(full, 1, 8).alias("SOUS-CLASSE"),
        full.alias("POSTE"),
    )


def explode_levels(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Each row once per level, `true` and `pred` cut to that level, with `level` and `level_no` (0 = poste)."""
    cut = [
        F.struct(
            F.lit(name).alias("level"),
            F.lit(steps).alias("level_no"),
            truncate_code(F.col(true), steps).alias(true),
            truncate_code(F.col(pred), steps).alias(pred),
        )
        for steps, name in enumerate(LEVELS)
    ]
    rest = [c for c in df.columns if c not in (true, pred)]
    return df.select(*rest, F.inline(F.array(*cut)))
