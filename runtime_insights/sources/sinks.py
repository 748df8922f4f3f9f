"""Writers for snapshots, alerts and metric text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_snapshots(documents: DataFrame, path: str) -> None:
    """One JSON document per line, in folders by container for pruned lookups."""
    documents.select("container_name", "document").write.partitionBy("container_name").mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").text(path)


def write_profile(nodes: DataFrame, path: str) -> None:
    """Node table in folders by container: the form to query, compare and detect against.

    Only the folders of the given containers are replaced. Rows are rebalanced by container
    first: small containers become one file each, and adaptive execution splits the ones
    that are too large for a task.
    """
    nodes.hint("rebalance", "container_name").write.partitionBy("container_name").mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_alerts(alerts: DataFrame, path: str, batch_id: int) -> None:
    """Alerts of one run or micro-batch in a folder of its own: a rerun replaces it."""
    alerts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_exposition(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
