"""Two hops by degree against a plain walk, and what their plan reads."""

from collections import defaultdict

import pytest

from loomgraph.binding import OrdersBinding
from loomgraph.operators import graph as G

PATH = "/root/testdata/sf0.001"


class Small(OrdersBinding):
    """A few orders, so that a plain walk can follow."""

    def table(self, name):
        rows = super().table(name)
        return rows.filter("o_orderkey < 60") if name == "orders" else rows.filter("l_orderkey < 60") if name == "lineitem" else rows


def plain(ends, start, hub):
    at = defaultdict(set)
    for i, rel, kind, name in ends:
        at[kind, name].add((i, rel))
    out = {(i, 1, kind, name, rel, None) for i, rel, kind, name in ends if i in start}
    for (kind, name), rows in at.items():
        for i in {i for i, _ in rows} & start:
            if len(rows) <= hub:
                out |= {(i, 2, "Item", str(j), rel, 1) for j, rel in rows if j != i}
            else:
                for rel in {r for _, r in rows}:
                    if n := len({j for j, r in rows if r == rel} - {i}):
                        out.add((i, 2, kind, name, rel, n))
    return out


@pytest.mark.parametrize("busy", [20_000, 20])
def test_equals_a_plain_walk(spark, monkeypatch, busy):
    monkeypatch.setattr(G, "BUSY_EDGES", busy)
    graph = Small(spark, PATH)
    ends = {tuple(r) for r in graph.edges(distinct=False).select("src_id", "rel_type", "dst_label", "dst_name").collect()}
    columns = ["item_id", "hop", "type", "name", "rel_type", "n_items"]
    every = [tuple(r) for r in G.subgraph_by_degree(graph, hub_edges=4).select(columns).collect()]
    assert sorted(every, key=repr) == sorted(plain(ends, {e[0] for e in ends}, 4), key=repr)
    some = [tuple(r) for r in G.subgraph_by_degree(graph, graph.items().filter("item_id < 9"), hub_edges=4).select(columns).collect()]
    assert sorted(some, key=repr) == sorted(plain(ends, set(range(9)), 4), key=repr)


def test_edges_are_made_once(spark):
    plan = G.subgraph_by_degree(Small(spark, PATH))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_distinct_edges_move_lines_and_not_edges(spark):
    graph = Small(spark, PATH)
    rows = [tuple(r) for r in graph.edges().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in graph.edges(distinct=False).collect()}
    plan = graph.edges()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan
