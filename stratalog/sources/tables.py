"""CSV tables of training and scoring rows, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import number


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text: nothing is read twice to guess types, which the callers know."""
    return spark.read.option("header", "true").option("enforceSchema", "false").csv(path)


def feature_rows(rows: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    """The columns `kept` and the vector `features`: numbers as they are, all else 0."""
    from pyspark.ml.functions import array_to_vector

    missing = [c for c in (*features, *kept) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    value = lambda c: F.coalesce(number(F.col(f"`{c}`").cast("string")), F.lit(0.0))
    vector = array_to_vector(F.array(*(F.nanvl(value(c), F.lit(0.0)) for c in features)))
    return rows.select(*(F.col(f"`{c}`") for c in kept), vector.alias("features"))


def safe_names(names: list[str]) -> dict[str, str]:
    """A name of letters, digits and underscores for each; those that would be equal get _2, _3 and so on."""
    import re

    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in names:
        plain = re.sub(r"[^A-Za-z0-9_]", "_", name)
        own, n = plain, 1
        while own in taken:
            n += 1
            own = f"{plain}_{n}"
        taken.add(own)
        out[name] = own
    return out
