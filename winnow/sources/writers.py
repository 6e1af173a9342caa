"""Sinks. All of them write in parallel from the executors; none collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordering import hash_cuts


def write_parquet_cache(df: DataFrame, path: str) -> str:
    """Write once; a second call leaves what is there alone."""
    df.write.mode("ignore").parquet(path)
    return path


def write_csv_split(df: DataFrame, key: str, first: str, second: str, fraction: float = 2 / 3, seed: int = 42) -> None:
    """Two headerless CSV folders, ``int(rows * fraction)`` random rows in the first, the rest in the second."""
    cut = hash_cuts(df, [], key, f"file-{seed}", lambda sizes: {(): {"_first": int(sizes.get((), 0) * fraction)}})
    marked = cut.mark(df, ["_first"])
    for path, part in ((first, F.col("_first")), (second, ~F.col("_first"))):
        marked.where(part).select(*df.columns).write.mode("errorifexists").csv(path, header=False)


def write_run_tables(run_dir: str, tables: dict[str, DataFrame], identical_modes: DataFrame | None = None) -> list[str]:
    """Write the tables of a run below ``run_dir``, partitioned by mode; an existing table is an error.

    Modes listed in ``identical_modes`` repeat the primary mode and are left out.
    """
    written = []
    for name, table in tables.items():
        if identical_modes is not None and "mode" in table.columns:
            table = table.join(F.broadcast(identical_modes.select("mode")), "mode", "left_anti")
        target = f"{run_dir.rstrip('/')}/{name}"
        writer = table.write.mode("errorifexists")
        if "mode" in table.columns:
            writer = writer.partitionBy("mode")
        # Numbers go to Parquet; lists and nested metrics to JSON, as one record per line.
        nested = any(t.startswith(("array", "struct")) for _, t in table.dtypes)
        writer.json(target) if nested else writer.parquet(target)
        written.append(target)
    return written


def write_frontier_log(log: DataFrame, run_dir: str) -> str:
    target = f"{run_dir.rstrip('/')}/frontier_candidates"
    log.write.mode("errorifexists").json(target)
    return target
