"""Queries over texts that are empty, null, padded or hold line ends and quotes give what their SQL gives."""

import duckdb
import pytest
from oracle import compare

import __spark_entry__ as entry

TEXTS = ["", None, " ", "  lead", "trail  ", "\tt\n", "\n", "a\r\nb", "\rx", 'say "hi"', '"', '""', ' "a", b', "a\\", "null", "Thing", "THİNG", "Schule"]


@pytest.mark.parametrize("name", ["p05_full_text", "p08_org_type", "io01_folder_scan"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rows = [(t, source, lang, n) for t in TEXTS for source in ("src1", "src3", "", " s", None) for lang, n in (("en", 9), ("de", 600), ("", 600), (None, 600))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None
