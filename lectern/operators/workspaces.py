"""Named workspaces as a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, paths array<string>, text_only boolean, model string, mode string, context_length int, map_reduce_context_fraction float, updated_at timestamp"


def latest(saves: DataFrame, name: str, *order: str) -> DataFrame:
    """The last save of every name, by name in byte order."""
    columns = [c for c in saves.columns if c != name]
    last = saves.groupBy(name).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return last.select(name, "_last.*").orderBy(name)


def save(workspaces: DataFrame, one: DataFrame) -> DataFrame:
    """The table with one workspace added, or replaced where its name is known."""
    return workspaces.join(one.select("name"), "name", "left_anti").unionByName(one)


def delete(workspaces: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The table without the name, and whether it was there."""
    return workspaces.where(F.col("name") != name), not workspaces.where(F.col("name") == name).isEmpty()


def missing_paths(workspaces: DataFrame, files: DataFrame) -> DataFrame:
    """name and missing (joined paths) of workspaces whose files are no longer listed."""
    wanted = workspaces.select("name", F.posexplode("paths").alias("_at", "path"))
    gone = wanted.join(files.select("path").distinct(), "path", "left_anti")
    parts = F.array_sort(F.collect_list(F.struct("_at", "path")))
    return gone.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["path"]), ", ").alias("missing"))
