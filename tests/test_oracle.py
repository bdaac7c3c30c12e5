"""Every registered query runs at the smallest scale; those with SQL must agree with it."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def outcomes(spark):
    """All queries, several at a time; each test then looks at its own outcome."""

    def run(name: str) -> str | None:
        try:
            df = QUERIES[name](spark, PATH)
            if name in SQL:
                return compare(df, connect(PATH), SQL[name])
            return None if df.count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            return f"{type(e).__name__}: {str(e)[:500]}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(sorted(QUERIES), pool.map(run, sorted(QUERIES))))


def test_flagship(spark):
    assert entry.entry(spark).columns == ["name", "party_type", "value"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    assert outcomes[name] is None
