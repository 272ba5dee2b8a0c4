"""Hierarchies deeper than any table here, and cycles."""

from __future__ import annotations

from sparkloom.operators import joins, maintenance


def test_chain_of_a_hundred(spark):
    nodes = spark.createDataFrame([(0, None, "n0")] + [(i, i - 1, f"n{i}") for i in range(1, 100)] + [(200, 202, "c"), (201, 200, "c"), (202, 201, "c"), (203, 200, "c")], "id bigint, parent_id bigint, name string")
    closed = joins.closure(nodes).cache()
    assert {(r.ancestor, r.depth) for r in closed.filter("id = 99").collect()} == {(99 - d, d) for d in range(100)}
    assert {(r.ancestor, r.depth) for r in closed.filter("id = 203").collect()} == {(203, 0), (200, 1), (202, 2), (201, 3)}
    moves = spark.createDataFrame([(0, 99), (50, 0)], "child bigint, new_parent bigint")
    assert {r.child: r.cycle for r in maintenance.would_cycle(closed, moves).collect()} == {0: True, 50: False}
    assert joins.paths(closed, nodes).filter("id = 99").first().path == "/" + "/".join(f"n{i}" for i in range(100))
