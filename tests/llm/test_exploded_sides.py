"""Joins with sides that an explode makes larger than Spark thinks."""

import pytest

from tidelog.llm import simhash


def nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def broadcast_sides(df):
    """Plans of what is sent to the driver and all executors for a join, as text."""
    plan = df._jdf.queryExecution().sparkPlan()
    return [str((n.left() if "Left" in n.buildSide().toString() else n.right()).toString())
            for n in nodes(plan) if n.nodeName() in ("BroadcastHashJoin", "BroadcastNestedLoopJoin")]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_balls_of_fingerprints_are_not_broadcast(spark, radius):
    """With few fingerprints the sizes that Spark presumes are far below the limit for broadcasts."""
    prints = spark.range(1000).selectExpr("xxhash64(id) as fp")
    found = simhash.links(prints, radius)
    assert not [p for p in broadcast_sides(found) if "Generate" in p]
    assert not found.count()


def test_links_of_crowded_and_other_entries(spark):
    """300 fingerprints in a crowded entry, which differ in up to two bits from the first, and pairs apart from them."""
    far = [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(3, 40)]
    rows = [0, *(1 << k for k in range(64)), *(3 << k for k in range(63)), *far, *(f ^ 5 for f in far)]
    signed = sorted({r - 2**64 if r >= 2**63 else r for r in rows})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(r,) for r in signed], "fp bigint")).collect()}
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}

    def roots(pairs):
        root = {r: r for r in signed}
        for _ in signed:
            before = dict(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert got <= near and roots(sorted(got)) == roots(sorted(near))
