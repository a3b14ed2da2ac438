"""History tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_history(df: DataFrame, path: str, ts: str = "ts", fmt: str = "parquet", mode: str = "append") -> None:
    """Write history rows partitioned by date and kind, so that readers prune both."""
    dated = df.withColumn("date", F.to_date(ts))
    parts = ["date", *(["kind"] if "kind" in df.columns else [])]
    # No shuffle: a day's rows stay where they are; writers of one task sort by partition only.
    dated.write.partitionBy(*parts).mode(mode).format(fmt).save(path)
