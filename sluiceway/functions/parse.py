"""JSON text parsed once for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD = "_bad"


def with_parsed(df: DataFrame, column: str, schema: str, name: str) -> DataFrame:
    """df with the text of a column parsed, in a column more; the schema's field _bad gets what can't be read.  The parsed
    record comes from a generator: filters on its fields stay behind that, and each text is parsed once however many use it."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return df.select("*", F.explode(F.array(parsed)).alias(name))
