"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.functions import text as T
from loomgraph.operators.filters import filtered_items
from loomgraph.sources.readers import header_map, normal_header


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [("  N/A ", None), ("无", None), (" x ", "x"), ("/", None), ("none of", "none of"), (None, None)])
def test_clean_value(spark, value, want):
    assert one(spark, value, T.clean_value) == want


def test_multi_values(spark):
    assert one(spark, "A; b；a|B\nC;;", T.split_multi_value) == ["A", "b", "C"]
    assert one(spark, None, T.split_multi_value) == []


def test_codes(spark):
    assert tuple(one(spark, " h01m8/10", T.parse_code)) == ("H", "H01", "H01M")
    assert tuple(one(spark, "Z9", T.parse_code)) == ("Z", None, None)
    assert tuple(one(spark, "Z9", T.code_prefixes)) == ("Z", "", "")
    assert one(spark, "C25B1/02", T.code_description) == "电解方法; 电解装置; C25B1/02"


@pytest.mark.parametrize("value,want", [("3.9", 3), ("-2.5", -2), ("x", 0), ("", 0), (None, 0), ("12", 12)])
def test_safe_int(spark, value, want):
    assert one(spark, value, T.safe_int) == want


@pytest.mark.parametrize(
    "value,want",
    [("清华大学", "高校"), ("MIT University Research", "高校"), ("中科院研究所", "研究机构"), ("Acme", "公司"), ("", "机构")],
)
def test_org_type(spark, value, want):
    assert one(spark, value, T.org_type) == want


@pytest.mark.parametrize("value,want", [("Acme Limited Corp.", "acme"), ("Acme Corp. Limited", "acme corp"), ("ACME, Inc.", "acme"), ("某某股份有限公司", "某某股份"), ("a  b(c)", "a bc")])
def test_comparison_name(spark, value, want):
    assert one(spark, value, T.comparison_name) == want


@pytest.mark.parametrize("value,want", [("ＡＢＣ股份有限公司", "ABC股份"), ("Acme GmbH", "Acme"), ("有限公司", "有限公司"), ("Plain", "Plain")])
def test_embedding_name(spark, value, want):
    assert one(spark, value, T.embedding_name) == want


@pytest.mark.parametrize("value,want", [("Smith, John", "person"), ("张三", "person"), ("某公司", "organization"), ("Acme", "organization")])
def test_entity_type(spark, value, want):
    assert one(spark, value, T.entity_type) == want


@pytest.mark.parametrize(
    "value,place,pid",
    [
        ("北京大学", ("中国", "北京市", None, 0.85), "cn-bj"),
        ("广东,深圳市某公司", ("中国", "广东省", "深圳市", 0.9), "cn-gd-sz"),
        ("Hong Kong Inc.", ("中国", "中国香港", None, 0.95), "cn-hk"),
        ("AGfa", None, "xx"),
        ("Siemens AG", ("德国", None, None, 0.85), "de"),
    ],
)
def test_places(spark, value, place, pid):
    got = one(spark, value, T.place_by_rules)
    assert (tuple(got) if got else None) == place
    none = F.lit(None).cast("string")

    def build(c):
        p = T.place_by_rules(c)
        return T.place_id(p["country"], p["province"], p["city"], none)

    assert one(spark, value, build) == pid


@pytest.mark.parametrize("value,want", [("制氢", "制氢技术"), ("氢电池", "氢燃料电池"), ("xx", None), ("有机储氢", "有机储氢")])
def test_canonical_topic(spark, value, want):
    from loomgraph.functions import presets as P

    assert one(spark, value, lambda c: T.canonical_value(c, P.TOPICS, P.TOPIC_WORDS)) == want
    checked, warnings = T.validate_filters({"domain": value, "year": "2020"})
    assert checked.get("domain") == want and checked["year"] == "2020"
    assert bool(warnings) == (want != value)


def test_filter_lists_are_canonical():
    got, warnings = T.validate_filters({"domain": ["制氢", "zz"], "region": "魔都", "keywords": ["a", "b"], "legal_status": "授权专利"})
    assert got == {"domain_in": ["制氢技术"], "region": "上海", "keywords": "a b", "legal_status": "授权"}
    assert len(warnings) == 4


def test_generated_text(spark):
    assert one(spark, "```cypher\nMATCH (n)\n```", T.strip_code_fence) == "MATCH (n)"
    raw = "这是一段解释说明文字\nMATCH (n {name: 'a#b'}) # note\nRETURN n -- end"
    assert one(spark, raw, T.clean_generated_query) == "MATCH (n {name: 'a#b'})\nRETURN n"
    assert one(spark, 'x {"a": 1} y', T.extract_json) == '{"a": 1}'
    assert one(spark, "none", lambda c: T.extract_json(c, "[]")) == "[]"


def test_unknown_role_is_an_error(spark):
    df = spark.createDataFrame([([("robot", "hi")],)], "m array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        df.select(T.remap_roles(F.col("m"), {"gpt": "assistant"})).collect()


def test_headers():
    assert normal_header(' "申请号（文本）" ') == "申请号"
    assert header_map(["标题 (中文)", "申请号 (x)"])["标题 (中文)"] == "title_cn"


def test_unknown_filter_key_is_refused(spark):
    with pytest.raises(ValueError, match="unknown filter keys"):
        filtered_items(OrdersBinding(spark, "/root/testdata/sf0.001"), {"nope": 1})
