"""Statement files take little more room than what differs between their statements."""

import os

from loomgraph.binding import OrdersBinding
from loomgraph.sources import statements as T


def test_files_are_a_small_part_of_their_text(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = T.edge_statements(OrdersBinding(spark, "/root/testdata/sf0.001").edges())
    T.write_statements(rows, path, batch=700)
    got = [r["statement"] for r in T.read_statements(spark, path).collect()]
    assert sorted(got) == sorted(r["statement"] for r in rows.collect())
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
    assert size * 5 < sum(len(x) + 1 for x in got)
