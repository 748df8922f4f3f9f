"""Profile trees as nested JSON documents and as indented listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.functions.branches import names
from runtime_insights.operators.profile import _leaf_type, _operation_type, path_counts
from runtime_insights.session import materialize

_LEAF = "struct<name:string,type:string,events_count:bigint,metadata:map<string,string>,children:map<string,string>>"


def _nested(child: str) -> str:
    return (
        "struct<name:string,type:string,events_count:bigint,metadata:map<string,string>,"
        f"children:map<string,{child}>>"
    )


_PROCESS = _nested(_LEAF)
_OPERATION = _nested(_PROCESS)
_BRANCH = _nested(_OPERATION)
_ROOT = _nested(_BRANCH)
DOCUMENT = f"struct<container_id:string,hbt_structure:{_ROOT}>"


def _node(name: Column, kind: Column, count: Column, children: Column) -> Column:
    return F.struct(
        name.alias("name"), kind.alias("type"), count.cast("bigint").alias("events_count"),
        F.create_map().cast("map<string,string>").alias("metadata"), children.alias("children"),
    )


def _children(order: Column, name: Column, node: Column, keep: Column | None = None) -> Column:
    """Map of child nodes in insertion order."""
    entry = F.struct(order.alias("o"), name.alias("name"), node.alias("node"))
    if keep is not None:
        entry = F.when(keep, entry)
    earlier = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(entry), earlier)
    return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["name"], e["node"])))


def documents(events: DataFrame, parts: int = 1) -> DataFrame:
    """``parts`` nested documents per container, at any size: (container_name, part, document).

    By default that is one document with the whole tree. With more parts each has the
    same shape and holds a hash slice of the leaves with their ancestors; together they are the
    whole tree. Who has trees that a task cannot hold gives a larger number; parts
    without a leaf or process of their own are left out.
    """
    counts = materialize(path_counts(events), "path-counts")
    processes = counts.filter(F.col("attr") == "").select(
        *S.PATH[:4], F.col("first_ord").alias("process_ord")
    )
    operations = processes.groupBy(*S.PATH[:3]).agg(F.min("process_ord").alias("operation_ord"))
    # Plain equi-joins: adaptive execution broadcasts the small side by its measured size
    # or splits a hot container.
    rows = (
        counts.join(processes, list(S.PATH[:4]))
        .join(operations, list(S.PATH[:3]))
        .withColumn("part", F.pmod(F.xxhash64(*S.PATH[1:]), F.lit(parts)).cast("int"))
    )
    no_children = F.create_map().cast("map<string,string>")
    leaf = _node(F.col("attr"), _leaf_type(), F.col("n"), no_children)
    level3 = rows.groupBy("container_name", "part", *S.PATH[1:4]).agg(
        _children(F.col("first_ord"), F.col("attr"), leaf, F.col("attr") != "").alias("children"),
        F.first("process_ord").alias("process_ord"), F.first("operation_ord").alias("operation_ord"),
    )
    process = _node(F.col("proc_name"), F.lit(S.PROCESS_NODE_TYPE), F.lit(0), F.col("children"))
    level2 = level3.groupBy("container_name", "part", "branch", "evt_type").agg(
        _children(F.col("process_ord"), F.col("proc_name"), process).alias("children"),
        F.first("operation_ord").alias("operation_ord"),
    )
    operation = _node(F.col("evt_type"), _operation_type(), F.lit(0), F.col("children"))
    level1 = level2.groupBy("container_name", "part").agg(*[
        _children(
            F.col("operation_ord"), F.col("evt_type"), operation, F.col("branch") == b
        ).alias(b) for b in names()
    ])
    branches = F.map_from_arrays(
        F.array(*[F.lit(f"{b}_branch") for b in names()]),
        F.array(*[
            _node(F.lit(f"{b}_branch"), F.lit(S.BRANCH_TYPE), F.lit(0), F.col(b))
            for b in names()
        ]),
    )
    root = _node(F.lit("root"), F.lit(S.ROOT_TYPE), F.lit(0), branches)
    document = F.to_json(F.struct(
        F.col("container_name").alias("container_id"), root.alias("hbt_structure")
    ))
    return level1.select("container_name", "part", document.alias("document"))


def rebuild(docs: DataFrame) -> DataFrame:
    """Node table of snapshot documents; parts of one tree become one again."""
    parsed = docs.select(F.explode(F.array(F.from_json("document", DOCUMENT))).alias("d")).select(
        F.col("d.container_id").alias("container_name"), F.col("d.hbt_structure").alias("root")
    )
    levels = [parsed.select("container_name", F.col("root").alias("node"))]
    keys = ("branch", "evt_type", "proc_name", "attr")
    for name in keys:
        above = levels[-1]
        kept = [c for c in above.columns if c != "node"]
        levels.append(above.select(*kept, F.explode("node.children").alias(name, "node")))
    rows = None
    for level, nodes in enumerate(levels):
        path = [
            (F.col(n) if n in nodes.columns else F.lit(None).cast("string")).alias(n) for n in keys
        ]
        part = nodes.select(
            "container_name", F.lit(level).alias("level"), *path,
            F.col("node.type").alias("node_type"), F.col("node.events_count").alias("events_count"),
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("branch", F.regexp_replace("branch", "_branch$", ""))
    # Ancestors are repeated in every part; a leaf is in exactly one.
    return rows.groupBy("container_name", "level", *keys).agg(
        F.first("node_type").alias("node_type"), F.max("events_count").alias("events_count")
    )


def listing(nodes: DataFrame) -> DataFrame:
    """Indented lines, ``name (type)`` and the count where there is one, in tree order."""
    level = F.col("level")
    name = (
        F.when(level == 0, "root").when(level == 1, F.concat("branch", F.lit("_branch")))
        .when(level == 2, F.col("evt_type")).when(level == 3, F.col("proc_name"))
        .otherwise(F.col("attr"))
    )
    count = F.when(
        F.col("events_count") > 0, F.concat(F.lit(" ("), F.col("events_count"), F.lit(" events)"))
    ).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), level), name, F.lit(" ("), F.col("node_type"), F.lit(")"), count)
    at = F.struct("first_seen", "first_seq")

    def above(depth: int, key: list[str], label: str) -> DataFrame:
        return nodes.filter(level == depth).select(*key, at.alias(label))

    operation_key = ["container_name", "branch", "evt_type"]
    ordered = nodes.join(above(2, operation_key, "o2"), operation_key, "left").join(
        above(3, [*operation_key, "proc_name"], "o3"), [*operation_key, "proc_name"], "left"
    )
    turn = F.array_position(F.array(*map(F.lit, names())), F.col("branch"))
    # A child sorts after its parent because the parent's deeper columns are null.
    return ordered.withColumn("line", line).orderBy(
        "container_name", F.coalesce(turn, F.lit(0)), F.asc_nulls_first("o2"),
        F.asc_nulls_first("evt_type"), F.asc_nulls_first("o3"), F.asc_nulls_first("proc_name"),
        (level == 4), F.asc_nulls_first("first_seen"), "first_seq", "first_pos", F.asc_nulls_first("attr"),
    )
