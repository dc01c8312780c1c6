"""Trees and graphs of containers, folders and images."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A table that a loop goes on from: checkpointed where the session has a folder for that, else kept on the executors' disks."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


def paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """(id, parent, name, depth, path, ids, names, order) of every node that a root reaches.

    ``nodes``: (id, parent, name) and, where children have an order, ordinal; roots have a null parent.
    ``order`` has the ordinals from the root down: sorting by it gives the nodes in pre-order. Level by
    level the frontier is joined with its children; a node that is on its own path ends there, so cycles
    end. There are as many rounds as the tree is deep, each on the last level alone.
    """
    ordinal = F.coalesce(F.col("ordinal").cast("long"), F.lit(0)) if "ordinal" in nodes.columns else F.lit(0).cast("long")
    nodes = nodes.select("id", "parent", "name", ordinal.alias("ordinal"))
    level = nodes.where(F.col("parent").isNull()).select("id", "parent", "name", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array("id").alias("ids"), F.array("name").alias("names"), F.array("ordinal").alias("order"))
    out = level = settled(level)
    children = nodes.where(F.col("parent").isNotNull())
    while not level.isEmpty():
        up = level.select(F.col("id").alias("_up"), *[F.col(c).alias(f"_{c}") for c in ("depth", "path", "ids", "names", "order")])
        level = settled(
            children.join(up, children["parent"] == up["_up"])
            .where(~F.array_contains("_ids", F.col("id")))
            .select(
                "id",
                "parent",
                "name",
                (F.col("_depth") + 1).alias("depth"),
                F.concat_ws(separator, "_path", "name").alias("path"),
                F.concat("_ids", F.array("id")).alias("ids"),
                F.concat("_names", F.array("name")).alias("names"),
                F.concat("_order", F.array("ordinal")).alias("order"),
            )
        )
        out = out.unionByName(level)
    return out


def leaves(nodes: DataFrame, **options) -> DataFrame:
    """The paths of nodes without children."""
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("_p")).distinct()
    found = paths(nodes, **options)
    return found.join(parents, found["id"] == parents["_p"], "left_anti")


def find(nodes: DataFrame, column: str, value: str) -> DataFrame:
    """The first node in pre-order, with its path, whose ``column`` (of id and name) has a value."""
    return paths(nodes).where(F.col(column) == value).orderBy("order", "id").limit(1)
