"""Keeping long pipelines small.

The optimizer pushes a filter below a projection by copying the projected expressions into
it. For cheap columns that is right; for a CRC or a message kind it repeats hundreds of
operations per reference. ``compute_once`` puts such columns behind a one-element array,
which the optimizer leaves in place: they are evaluated once per row, inside the same stage.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]


def compute_once(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with SQL expressions added or replaced as columns, each evaluated once per row."""
    kept = [c for c in df.columns if c not in columns]
    packed = ", ".join(f"{sql} AS `{name}`" for name, sql in columns.items())
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    out = df.selectExpr(*quoted(kept), f"inline(array(struct({packed})))")
    return out if out.columns == order else out.select(*quoted(order))


def shared_folder(spark) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="skytally-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
