"""Graph bindings: how abstract roles map to tables.

Operators only see `items()` and `relation(group)`. A relation is a DataFrame
`(item_id, <neighbour attributes>)` with one row per distinct edge when
`distinct=True`; existence tests do not need the distinct and skip it.

Relation groups and their columns:

    party      party_id, party_name, party_type (+ place_* when place=True)
    person     party_id, person_name, person_org
    topic      topic_name, topic_level, topic_parent
    code       code, section
    status     status_name
    country    country_name
    activity   rel_type, party_id, party_name      (transfer, licence, pledge, owner)
    litigation party_id, party_name, role
    littype    type_name
    family     family_id
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: relation names of party-like edges besides APPLIED_BY
ACTIVITY_RELATIONS = [
    "OWNED_BY",
    "TRANSFERRED_FROM",
    "TRANSFERRED_TO",
    "LICENSED_FROM",
    "LICENSED_TO",
    "CURRENT_LICENSED_TO",
    "PLEDGED_FROM",
    "PLEDGED_TO",
    "CURRENT_PLEDGED_TO",
]

COUNTERS = ["transfer_count", "license_count", "pledge_count", "litigation_count"]


class GraphBinding(ABC):
    """Access to a property graph held in DataFrames."""

    @abstractmethod
    def items(self, counters: bool = False) -> DataFrame:
        """`item_id, item_date, item_type, title` and, if asked, the activity counters.

        A binding whose dates are timestamps may add `item_ts`; year conditions
        are then also put on it, so that they reach the files.
        """

    @abstractmethod
    def relation(self, group: str, place: bool = False, distinct: bool = False) -> DataFrame: ...

    @abstractmethod
    def parties(self) -> DataFrame:
        """`party_id, party_name, party_type, place_*` of the main party label."""

    @abstractmethod
    def topics(self) -> DataFrame:
        """`topic_name, topic_level, topic_parent`, including topics without items."""

    def texts(self) -> DataFrame:
        """`item_id, text` for full-text search."""
        return self.items().select("item_id", F.col("title").alias("text"))

    def edges(self, distinct: bool = True) -> DataFrame:
        """All item edges in long form `(src_id, rel_type, dst_label, dst_name, role)`.

        `distinct=False` may repeat an edge; it saves a shuffle where the
        reader collects sets anyway.
        """
        none = F.lit(None).cast("string")

        def part(group: str, rel: Column, label: str, name: str, role: Column = none) -> DataFrame:
            return self.relation(group, distinct=distinct).select(
                F.col("item_id").alias("src_id"),
                rel.alias("rel_type"),
                F.lit(label).alias("dst_label"),
                F.col(name).alias("dst_name"),
                role.alias("role"),
            )

        parts = [
            part("party", F.lit("APPLIED_BY"), "Organization", "party_name"),
            part("person", F.lit("APPLIED_BY"), "Person", "person_name"),
            part("topic", F.lit("BELONGS_TO"), "Topic", "topic_name"),
            part("code", F.lit("CLASSIFIED_AS"), "Code", "code"),
            part("status", F.lit("HAS_STATUS"), "Status", "status_name"),
            part("country", F.lit("PUBLISHED_IN"), "Country", "country_name"),
            part("activity", F.col("rel_type"), "Organization", "party_name"),
            part("litigation", F.lit("LITIGATED_WITH"), "Organization", "party_name", F.col("role")),
            part("littype", F.lit("HAS_LITIGATION_TYPE"), "LitigationType", "type_name"),
            part("family", F.lit("IN_FAMILY"), "Family", "family_id"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class OrdersBinding(GraphBinding):
    """The order/customer/lineitem tables seen as a property graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def items(self, counters: bool = False) -> DataFrame:
        items = self.table("orders").select(
            F.col("o_orderkey").alias("item_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("item_date"),
            F.col("o_orderpriority").alias("item_type"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_orderdate").alias("item_ts"),
        )
        if not counters:
            return items
        zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTERS]
        return items.join(self.counters(), "item_id", "left").select(*items.columns, *zero)

    def texts(self) -> DataFrame:
        """The part names of an order, in line order."""
        line, part = self.table("lineitem"), self.table("part")
        named = line.join(part, line.l_partkey == part.p_partkey)
        lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name")))
        texts = named.groupBy(F.col("l_orderkey").alias("item_id")).agg(lines.alias("ls"))
        return texts.select("item_id", F.array_join(F.col("ls.p_name"), " ").alias("text"))

    def counters(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(
            F.count_if(flag == "R").alias("transfer_count"),
            F.count_if(flag == "A").alias("license_count"),
            F.count_if(flag == "N").alias("pledge_count"),
            F.count_if(F.col("l_quantity") >= 45).alias("litigation_count"),
        )

    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey",
            F.col("n_name").alias("place_name"),
            F.col("r_name").alias("place_country"),
            F.col("n_name").alias("place_province"),
            F.lit("").alias("place_city"),
            F.lit("").alias("place_district"),
            F.lit(2).alias("place_level"),
            F.concat_ws("/", "r_name", "n_name").alias("place_path"),
        )

    def parties(self) -> DataFrame:
        customer = self.table("customer")
        return customer.join(self.places(), customer.c_nationkey == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("party_id"),
            F.col("c_name").alias("party_name"),
            F.col("c_mktsegment").alias("party_type"),
            "place_name",
            "place_country",
            "place_province",
            "place_city",
            "place_district",
            "place_level",
            "place_path",
        )

    def topics(self) -> DataFrame:
        part = self.table("part")
        leaf = part.select(
            F.concat_ws(" ", "p_type", "p_brand").alias("topic_name"),
            F.lit(3).alias("topic_level"),
            F.col("p_type").alias("topic_parent"),
        ).distinct()
        mid = part.select(
            F.col("p_type").alias("topic_name"), F.lit(2).alias("topic_level"), F.lit("ALL").alias("topic_parent")
        ).distinct()
        root = part.limit(1).select(
            F.lit("ALL").alias("topic_name"), F.lit(1).alias("topic_level"), F.lit(None).cast("string").alias("topic_parent")
        )
        return leaf.unionByName(mid).unionByName(root)

    @staticmethod
    def part_code() -> Column:
        brand_no = F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0")
        return F.concat(
            F.substring("p_type", 1, 1), brand_no, F.upper(F.substring("p_name", 1, 1)), F.lit("/"), F.col("p_size").cast("string")
        )

    # kinds of edges as (relation, label of the end, role); an edge travels as its number here
    KINDS = [
        ("APPLIED_BY", "Organization", None),
        ("HAS_STATUS", "Status", None),
        ("PUBLISHED_IN", "Country", None),
        ("IN_FAMILY", "Family", None),
        ("BELONGS_TO", "Topic", None),
        ("CLASSIFIED_AS", "Code", None),
        ("HAS_LITIGATION_TYPE", "LitigationType", None),
        ("LITIGATED_WITH", "Organization", "plaintiff"),
        ("LITIGATED_WITH", "Organization", "defendant"),
        *[(rel, "Organization", None) for rel in ACTIVITY_RELATIONS],
        ("APPLIED_BY", "Person", None),
    ]

    def edges(self, distinct: bool = True) -> DataFrame:
        """Two scans instead of one per relation: orders and lines each explode into their edges.

        Relation, label and role are one small number until the duplicates are
        gone. A repeated edge comes from two lines of one order, so the lines of
        an order are brought together and its edges made distinct in place: the
        shuffle carries a line once, not each of its edges.
        """
        number: dict[tuple[str, str | None], int] = {}
        for i, (rel, _, role) in enumerate(self.KINDS):
            number.setdefault((rel, role), i + 1)
        person = F.lit(self.KINDS.index(("APPLIED_BY", "Person", None)) + 1)

        def edge(kind: Column | str, name: Column) -> Column:
            k = F.lit(number[(kind, None)]) if isinstance(kind, str) else kind
            return F.struct(k.cast("tinyint").alias("kind"), name.alias("dst_name"))

        orders = self.table("orders").join(self.parties(), F.col("o_custkey") == F.col("party_id"))
        family = F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
        of_order = F.array(
            edge("APPLIED_BY", F.col("party_name")),
            edge("HAS_STATUS", F.col("o_orderstatus")),
            edge("PUBLISHED_IN", F.col("place_country")),
            F.when(F.col("o_orderstatus") != "O", edge("IN_FAMILY", family)),
        )
        line, supplier = self.table("lineitem"), self.table("supplier").select("s_suppkey", "s_name")
        # topic and code are worked out once per part, not once per line
        part = self.table("part").select(
            "p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("_topic"), self.part_code().alias("_code")
        )
        lines = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
        large = F.col("l_quantity") >= 45
        side = F.when(self.side() == "plaintiff", number[("LITIGATED_WITH", "plaintiff")]).otherwise(number[("LITIGATED_WITH", "defendant")])
        lines = lines.select(
            "l_orderkey",
            "_topic",
            "_code",
            "s_name",
            self.activity_type({rel: number[(rel, None)] for rel in ACTIVITY_RELATIONS}).cast("tinyint").alias("_activity"),
            F.when(large, side).cast("tinyint").alias("_side"),
            F.when(large, F.col("l_returnflag")).alias("_littype"),
        )

        def of_line(field: Callable[[str], Column]) -> Column:
            return F.array(
                edge("BELONGS_TO", field("_topic")),
                edge("CLASSIFIED_AS", field("_code")),
                edge(field("_activity"), field("s_name")),
                edge(person, field("s_name")),
                F.when(field("_side").isNotNull(), edge(field("_side"), field("s_name"))),
                F.when(field("_littype").isNotNull(), edge("HAS_LITIGATION_TYPE", field("_littype"))),
            )

        def exploded(df: DataFrame, key: str, edges: Column) -> DataFrame:
            rows = df.select(F.col(key).alias("src_id"), F.explode(edges).alias("e")).filter(F.col("e").isNotNull())
            return rows.select("src_id", "e.*")

        first = exploded(orders, "o_orderkey", of_order)
        if distinct:
            lists = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*lines.columns[1:])).alias("ls"))
            # the edges of one order only
            together = F.array_distinct(F.flatten(F.transform("ls", lambda x: of_line(lambda name: x[name]))))
            second = exploded(lists, "l_orderkey", together)
        else:
            second = exploded(lines, "l_orderkey", of_line(F.col))
        both = first.unionByName(second)

        def named(i: int) -> Column:
            return F.element_at(F.array(*[F.lit(k[i]).cast("string") for k in self.KINDS]), F.col("kind").cast("int"))

        return both.select(
            "src_id", named(0).alias("rel_type"), named(1).alias("dst_label"), "dst_name", named(2).alias("role")
        )

    @staticmethod
    def activity_type(names: dict[str, object] | None = None) -> Column:
        """Relation of a line by its flags, or what `names` holds for that relation."""
        flags = {
            ("R", "F"): "TRANSFERRED_TO",
            ("R", "O"): "TRANSFERRED_FROM",
            ("A", "F"): "LICENSED_TO",
            ("A", "O"): "LICENSED_FROM",
            ("N", "F"): "PLEDGED_TO",
            ("N", "O"): "OWNED_BY",
        }
        tests = [
            F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), names[n] if names else n)
            for (f, s), n in flags.items()
        ]
        return F.coalesce(*tests)

    @staticmethod
    def side() -> Column:
        return F.when(F.col("l_linestatus") == "O", "plaintiff").otherwise("defendant")

    def relation(self, group: str, place: bool = False, distinct: bool = False) -> DataFrame:
        orders = self.table("orders")
        line = self.table("lineitem")
        if group == "party":
            if place:
                party = self.parties()
            else:
                party = self.table("customer").select(
                    F.col("c_custkey").alias("party_id"),
                    F.col("c_name").alias("party_name"),
                    F.col("c_mktsegment").alias("party_type"),
                )
            return orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("party_id")).join(
                party, "party_id"
            )
        if group == "person":
            supplier = self.table("supplier")
            rel = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(
                F.col("l_orderkey").alias("item_id"),
                F.col("s_suppkey").alias("party_id"),
                F.col("s_name").alias("person_name"),
                F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("person_org"),
            )
            return rel.distinct() if distinct else rel
        if group in ("topic", "code"):
            part = self.table("part")
            attrs = (
                [
                    F.concat_ws(" ", "p_type", "p_brand").alias("topic_name"),
                    F.lit(3).alias("topic_level"),
                    F.col("p_type").alias("topic_parent"),
                ]
                if group == "topic"
                else [self.part_code().alias("code"), F.substring("p_type", 1, 1).alias("section")]
            )
            rel = line.select(F.col("l_orderkey").alias("item_id"), "l_partkey").join(
                part.select("p_partkey", *attrs), F.col("l_partkey") == F.col("p_partkey")
            )
            rel = rel.drop("l_partkey", "p_partkey")
            return rel.distinct() if distinct else rel
        if group == "status":
            return orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status_name"))
        if group == "country":
            return self.relation("party", place=True).select("item_id", F.col("place_country").alias("country_name"))
        if group == "activity":
            supplier = self.table("supplier").select("s_suppkey", "s_name")
            rel = line.select(F.col("l_orderkey").alias("item_id"), self.activity_type().alias("rel_type"), "l_suppkey").join(
                supplier, F.col("l_suppkey") == F.col("s_suppkey")
            )
            rel = rel.select("item_id", "rel_type", F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party_name"))
            return rel.distinct() if distinct else rel
        if group == "litigation":
            supplier = self.table("supplier").select("s_suppkey", "s_name")
            rel = line.filter(F.col("l_quantity") >= 45).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            rel = rel.select(
                F.col("l_orderkey").alias("item_id"),
                F.col("s_suppkey").alias("party_id"),
                F.col("s_name").alias("party_name"),
                self.side().alias("role"),
            )
            return rel.distinct() if distinct else rel
        if group == "littype":
            rel = line.filter(F.col("l_quantity") >= 45).select(
                F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("type_name")
            )
            return rel.distinct() if distinct else rel
        if group == "family":
            return orders.filter(F.col("o_orderstatus") != "O").select(
                F.col("o_orderkey").alias("item_id"),
                F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("family_id"),
            )
        raise ValueError(f"unknown relation group: {group}")


class EdgeTableBinding(GraphBinding):
    """A graph written by `plans.graph_build`: node tables plus one long edge table."""

    # fixed values: edge names of the single-label relation groups
    SIMPLE = {
        "topic": ("BELONGS_TO", "topic_name"),
        "code": ("CLASSIFIED_AS", "code"),
        "status": ("HAS_STATUS", "status_name"),
        "country": ("PUBLISHED_IN", "country_name"),
        "littype": ("HAS_LITIGATION_TYPE", "type_name"),
        "family": ("IN_FAMILY", "family_id"),
    }

    def __init__(self, nodes: dict[str, DataFrame], edges: DataFrame):
        self.nodes, self._edges = nodes, edges

    def items(self, counters: bool = False) -> DataFrame:
        cols = ["item_id", "item_date", "item_type", "title"]
        return self.nodes["item"].select(*cols, *(COUNTERS if counters else []))

    def parties(self) -> DataFrame:
        return self.nodes["party"]

    def topics(self) -> DataFrame:
        return self.nodes["topic"]

    def relation(self, group: str, place: bool = False, distinct: bool = False) -> DataFrame:
        edges = self._edges
        src = F.col("src_id").alias("item_id")
        if group in self.SIMPLE:
            rel, name = self.SIMPLE[group]
            out = edges.filter(F.col("rel_type") == rel).select(src, F.col("dst_key").alias(name))
            if group == "code":
                out = out.withColumn("section", F.substring("code", 1, 1))
            if group == "topic":
                out = out.join(self.topics(), "topic_name")
            return out
        if group == "party":
            party = self.parties() if place else self.parties().select("party_id", "party_name", "party_type")
            hop = edges.filter((F.col("rel_type") == "APPLIED_BY") & (F.col("dst_label") == "Organization"))
            return hop.select(src, F.col("dst_key").alias("party_id")).join(party, "party_id")
        if group == "person":
            hop = edges.filter((F.col("rel_type") == "APPLIED_BY") & (F.col("dst_label") == "Person"))
            return hop.select(src, F.col("dst_key").alias("party_id")).join(self.nodes["person"], "party_id")
        if group == "activity":
            hop = edges.filter(F.col("rel_type").isin(ACTIVITY_RELATIONS))
            return hop.select(src, "rel_type", F.col("dst_key").alias("party_id"), F.col("dst_name").alias("party_name"))
        if group == "litigation":
            hop = edges.filter(F.col("rel_type") == "LITIGATED_WITH")
            return hop.select(src, F.col("dst_key").alias("party_id"), F.col("dst_name").alias("party_name"), "role")
        raise ValueError(f"unknown relation group: {group}")
