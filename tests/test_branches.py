"""A new branch is one registration."""

from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions import branches as B, fields as X
from runtime_insights.functions.classify import profile_category
from runtime_insights.operators import detect as D, profile as P, snapshot
from test_losses import QUICK, event, events


def test_a_registered_branch_is_classified_learned_and_detected(spark):
    B.register(B.Branch(
        "dns", ("dns",), ("getaddrinfo",),
        lambda: F.array(X.attribute(F.lit(0), F.col("fd_name"), "host_name")),
        lambda _: F.lit("host_name"), "dns_operation",
    ))
    try:
        rows = [(*event(m)[:3], "dns", *event(m)[4:6], "x", "getaddrinfo", *event(m)[8:11], name, "")
                for m, name in ((0, "a.org"), (5, "a.org"), (6, "a.org"), (7, "b.org"))]
        table = events(spark, *rows).withColumn(
            "category", profile_category(F.col("rule"), F.col("evt_type")))
        assert {r.category for r in table.collect()} == {"dns"}
        assert [(r.level, r.missing_key) for r in D.detect_alerts(table, QUICK).collect()] == [(3, "b.org")]
        kinds = {r.node_type for r in P.profile_nodes(table).collect()}
        assert {"dns_operation", "host_name"} <= kinds
        assert '"dns_branch"' in snapshot.documents(table).first().document
    finally:
        B.unregister("dns")
    assert B.names() == S.CATEGORIES
