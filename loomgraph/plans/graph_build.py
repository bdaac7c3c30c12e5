"""Sheets to graph: clean, resolve, build nodes and edges, write, reopen.

Every step is a function from DataFrames to DataFrames; `build_graph` chains
them with a stage table per step, so any step can be rerun alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.binding import EdgeTableBinding
from loomgraph.functions import presets as P
from loomgraph.functions import text as T
from loomgraph.operators.resolution import decide, resolve_names, rule_filter, similar_across_blocks, similar_in_block
from loomgraph.runtime import cut_lineage
from loomgraph.sources.readers import first_per_key
from loomgraph.sources.sinks import read_graph, stage, write_graph

LISTS = [*P.ROLE_EDGES, "litigation_types"]
COUNTS = ["transfer_count", "license_count", "pledge_count", "litigation_count"]


def clean_records(raw: DataFrame) -> DataFrame:
    """Raw sheet rows to records: null tokens, lists, parsed codes, full text; first row per number."""
    fields = [c for c in raw.columns if c not in ("file_name", "tech_domain")]
    rows = raw.select("file_name", "tech_domain", *[T.clean_value(F.col(c)).alias(c) for c in fields])
    rows = first_per_key(rows.filter(F.col("application_no").isNotNull()), "application_no")
    for c in LISTS:
        if c in fields:
            rows = rows.withColumn(c, T.split_multi_value(F.col(c)))
    texts = [F.col(c) for c in ("title_cn", "title_en", "abstract_cn", "abstract_en")]
    return rows.withColumn("ipc_parsed", T.parse_code(F.col("ipc_main"))).withColumn("full_text", T.full_text(*texts))


def entity_names(records: DataFrame) -> DataFrame:
    """Every party name of every role with its frequency."""
    lists = F.flatten(F.array(*[F.col(r) for r in P.ROLE_EDGES]))
    names = records.select(F.explode(lists).alias("name")).filter("trim(name) <> ''")
    return names.groupBy(F.trim("name").alias("name")).agg(F.count("*").alias("n"))


def entity_mapping(names: DataFrame, threshold: float = 0.95, decider=None) -> DataFrame:
    """`original_name, standard_name, entity_type, location` for every name."""
    names = cut_lineage(names)
    inside = similar_in_block(names, threshold).select("a", "b")
    across = similar_across_blocks(names, threshold).select("a", "b")
    resolved = resolve_names(names, rule_filter(inside.unionByName(across)))
    decided = decide(resolved.select("original_name", "standard_name"), decider)
    place = F.when(
        F.col("country").isNotNull(),
        F.struct("country", "province", "city", F.lit(None).cast("string").alias("district")),
    )
    return decided.select("original_name", "standard_name", "entity_type", place.alias("location"))


def _person_uid(original: Column, standard: Column) -> Column:
    return F.when(original == standard, standard).otherwise(F.concat(original, F.lit("@"), standard))


def build_nodes(records: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Node tables keyed by label."""
    item = records.select(
        F.col("application_no").alias("item_id"),
        F.coalesce("title_cn", F.lit("")).alias("title"),
        F.coalesce("title_en", F.lit("")).alias("title_en"),
        F.substring(F.coalesce("abstract_cn", F.lit("")), 1, 2000).alias("abstract"),
        F.substring(F.coalesce("abstract_en", F.lit("")), 1, 2000).alias("abstract_en"),
        F.coalesce("application_date", F.lit("")).alias("item_date"),
        F.coalesce("publication_date", F.lit("")).alias("publication_date"),
        F.coalesce("publication_no", F.lit("")).alias("publication_no"),
        F.coalesce("patent_type", F.lit("")).alias("item_type"),
        F.coalesce("ipc_main", F.lit("")).alias("ipc_main"),
        F.coalesce("tech_domain", F.lit("")).alias("tech_domain"),
        *[T.safe_int(F.col(c)).alias(c) for c in COUNTS],
    )
    orgs = mapping.filter("entity_type <> 'person'")
    alias = F.when(F.col("original_name") != F.col("standard_name"), F.col("original_name"))
    placed = F.when(F.col("location").isNotNull(), F.struct("original_name", "location"))
    party = orgs.groupBy("standard_name").agg(
        F.array_join(F.array_sort(F.collect_set(alias)), "; ").alias("name_aliases"), F.min(placed).getField("location").alias("l")
    )
    loc = [F.col(f"l.{c}") for c in ("country", "province", "city", "district")]
    home = loc[0] == P.HOME_COUNTRY
    # below the country, only the home country has places
    shown = [loc[0], *[F.when(home, c) for c in loc[1:]]]
    party = party.select(
        F.col("standard_name").alias("party_id"),
        F.col("standard_name").alias("party_name"),
        T.org_type(F.col("standard_name")).alias("party_type"),
        "name_aliases",
        F.coalesce(*reversed(shown)).alias("place_name"),
        *[F.coalesce(c, F.lit("")).alias(f"place_{n}") for c, n in zip(shown, ("country", "province", "city", "district"))],
        T.place_level(*shown).alias("place_level"),
        T.place_path(*shown).alias("place_path"),
        F.when(loc[0].isNotNull(), T.place_id(*shown)).alias("place_id"),
    )
    person = mapping.filter("entity_type = 'person'").select(
        _person_uid(F.col("original_name"), F.col("standard_name")).alias("party_id"), F.col("standard_name").alias("person_name")
    ).distinct()
    main = F.explode("applicants_named").alias("a")
    # the party a person files with: the first other applicant of the person's items
    named = records.select("application_no", F.col("applicants").alias("applicants_named")).select(
        "application_no", main, F.col("applicants_named")[0].alias("first")
    )
    filed = named.groupBy(F.col("a").alias("original_name")).agg(F.min("first").alias("person_org"))
    persons = mapping.filter("entity_type = 'person'").join(filed, "original_name", "left")
    person = person.join(
        persons.groupBy(_person_uid(F.col("original_name"), F.col("standard_name")).alias("party_id")).agg(F.min("person_org").alias("person_org")),
        "party_id",
        "left",
    )
    spark = records.sparkSession
    parents = {P.ROOT_TOPIC: None, **P.TOPIC_PARENTS}

    def level(t: str) -> int:
        return 1 if parents[t] is None else 1 + level(parents[t])

    topic = spark.createDataFrame(
        [(t, level(t), p) for t, p in parents.items()], "topic_name string, topic_level int, topic_parent string"
    )
    place_rows = party.select("party_id", *[F.col(f"place_{n}").alias(n) for n in ("country", "province", "city", "district")])
    place = T.place_tree(place_rows.filter("country <> ''"), "party_id")

    def keyed(name: str, c: Column) -> DataFrame:
        return records.select(c.alias(name)).filter(f"{name} IS NOT NULL AND {name} <> ''").distinct()

    code = keyed("code", F.trim("ipc_main"))
    return {
        "item": item,
        "party": party,
        "person": person,
        "topic": topic,
        "code": code.select("code", T.code_prefixes(F.col("code")).alias("p")).select("code", "p.*"),
        "country": keyed("country_name", F.trim("publication_country")),
        "status": keyed("status_name", F.trim("legal_status")),
        "family": keyed("family_id", T.family_id(F.col("patent_family"))),
        "littype": records.select(F.explode("litigation_types").alias("type_name")).distinct(),
        "place": place,
    }


def name_ends(mapping: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """`original_name, dst_label, dst_key, dst_name`: the node that a name stands for, for the names that have one.

    A name outside the mapping stands for itself and is an organisation.
    """
    person = F.coalesce("entity_type", F.lit("organization")) == "person"
    standard = F.coalesce("standard_name", "original_name")
    known = mapping.select(
        "original_name",
        F.when(person, "Person").otherwise("Organization").alias("dst_label"),
        F.when(person, _person_uid(F.col("original_name"), standard)).otherwise(standard).alias("dst_key"),
    )
    parties = nodes["party"].select(F.lit("Organization").alias("dst_label"), F.col("party_id").alias("dst_key"))
    people = nodes["person"].select(F.lit("Person").alias("dst_label"), F.col("party_id").alias("dst_key"), "person_name")
    found = known.join(parties.unionByName(people.drop("person_name")), ["dst_label", "dst_key"], "left_semi")
    found = found.join(people, ["dst_label", "dst_key"], "left")
    other = parties.withColumn("original_name", F.col("dst_key")).join(mapping.select("original_name"), "original_name", "left_anti")
    named = found.select("original_name", "dst_label", "dst_key", F.coalesce("person_name", "dst_key").alias("dst_name"))
    return named.unionByName(other.withColumn("dst_name", F.col("dst_key")))


def build_edge_table(records: DataFrame, mapping: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """All edges of the items in long form, both ends present, each once.

    `nodes` are those of `build_nodes` over the same records: a code, country, status, family or litigation type of a
    record is a node, and every record an item. Which names and topics are nodes is settled per name and by the list of
    topics, so no edge moves to meet its ends: only names are shuffled, to their meaning and to be made distinct.
    """
    roles = list(P.ROLE_EDGES)
    none = F.lit(None).cast("string")
    role_edge = F.create_map(*[F.lit(x) for kv in P.ROLE_EDGES.items() for x in kv])
    sides = F.create_map(*[F.lit(x) for kv in P.LITIGATION_ROLES.items() for x in kv])
    mention = F.explode(F.array(*[F.struct(F.lit(r).alias("field"), F.col(r).alias("names")) for r in roles])).alias("m")
    long = records.select("application_no", mention).select("application_no", F.col("m.field"), F.explode("m.names").alias("original_name"))
    parties = long.join(name_ends(mapping, nodes), "original_name").select(
        F.col("application_no").alias("src_id"),
        role_edge[F.col("field")].alias("rel_type"),
        "dst_label",
        "dst_key",
        "dst_name",
        F.try_element_at(sides, F.col("field")).alias("role"),
    )

    def simple(rel: str, label: str, c: Column, source: DataFrame = records) -> DataFrame:
        return source.select(
            F.col("application_no").alias("src_id"), F.lit(rel).alias("rel_type"), F.lit(label).alias("dst_label"), c.alias("dst_key"), c.alias("dst_name"), none.alias("role")
        ).filter("dst_key IS NOT NULL AND dst_key <> ''")

    types = records.select("application_no", F.explode("litigation_types").alias("t"))
    topic = F.when(F.col("tech_domain").isin(P.ROOT_TOPIC, *P.TOPIC_PARENTS), F.col("tech_domain"))
    edges = [
        parties.distinct(),
        simple("BELONGS_TO", "Topic", topic),
        simple("CLASSIFIED_AS", "Code", F.trim("ipc_main")),
        simple("PUBLISHED_IN", "Country", F.trim("publication_country")),
        simple("HAS_STATUS", "Status", F.trim("legal_status")),
        simple("IN_FAMILY", "Family", T.family_id(F.col("patent_family"))),
        simple("HAS_LITIGATION_TYPE", "LitigationType", F.col("t"), types).distinct(),
    ]
    return reduce(DataFrame.unionByName, edges)


def build_graph(spark: SparkSession, raw: DataFrame, path: str, threshold: float = 0.95, decider=None, use_cache: bool = True) -> EdgeTableBinding:
    """All stages from raw sheet rows to an open graph; finished stages are reused."""
    records = stage(spark, path, "records", lambda: clean_records(raw), use_cache)
    mapping = stage(spark, path, "mapping", lambda: entity_mapping(entity_names(records), threshold, decider), use_cache)
    nodes = build_nodes(records, mapping)
    edges = stage(spark, path, "edge_table", lambda: build_edge_table(records, mapping, nodes), use_cache)
    write_graph(nodes, edges, f"{path}/graph")
    stored, stored_edges = read_graph(spark, f"{path}/graph", list(nodes))
    return EdgeTableBinding(stored, stored_edges)
