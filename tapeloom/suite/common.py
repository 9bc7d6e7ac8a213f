"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, FloatType

from tapeloom.operators import indicators as ind
from tapeloom.sources import warehouse as wh
from tapeloom.suite.sqlbase import SHAPED


def out(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    """Select ``names``, round doubles to ``n`` digits and write booleans as 0/1."""
    wanted = [x for name in names for x in name.split()]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if wanted == ["*"]:
        wanted = df.columns
    return df.selectExpr(
        *[
            (f"{SHAPED.format(x=f'CAST({c} AS DOUBLE)')} AS {c}" if n == 6 else f"round(CAST({c} AS DOUBLE), {n}) AS {c}")
            if isinstance(kinds[c], (DoubleType, FloatType))
            else f"CAST({c} AS INT) AS {c}"
            if isinstance(kinds[c], BooleanType)
            else c
            for c in wanted
        ]
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return wh.bars(spark, folder)


def indicators(spark: SparkSession, folder: str) -> DataFrame:
    return ind.add_indicators(wh.bars(spark, folder))
