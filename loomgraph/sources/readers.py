"""Reading sheets, datasets, run logs and graph scripts. No schema is inferred where one is known."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgraph.functions import presets as P
from loomgraph.functions.text import topic_from_file
from loomgraph.runtime import keep_first


def normal_header(name: str) -> str:
    """Header without bracket notes and quotes, blanks squeezed."""
    name = re.sub(r"\s+", " ", name.strip())
    name = re.sub(r"\s*（[^）]*）\s*|\s*\([^)]*\)\s*", "", name)
    return name.strip("\"'").strip()


def header_map(columns: Sequence[str], names: Mapping[str, str] = P.SHEET_COLUMNS) -> dict[str, str]:
    """Source column -> field name: the normal form first, then the header as it is."""
    out: dict[str, str] = {}
    for wanted, field in names.items():
        for col in columns:
            if normal_header(col) == wanted or col == wanted or normal_header(col) == normal_header(wanted):
                if col not in out and field not in out.values():
                    out[col] = field
                    break
    return out


def folder_scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    key: str,
    names: Mapping[str, str] | None = None,
    fmt: str = "csv",
    multi_line: bool = False,
) -> DataFrame:
    """Every file of a folder with every column as text; rows without a key are dropped.

    Files are split over tasks; `multi_line` is for values that hold line
    breaks and reads each file in one task. Adds `file_name`, the start of the
    split the row was read from and the topic the file name stands for. `names` maps
    headers to fields; without it the columns keep their names.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.read.schema(schema)
    # no value is this text: a cell of two quotes is empty, only one of nothing is null
    sheet = reader.option("header", True).option("multiLine", multi_line).option("escape", '"').option("nullValue", uuid.uuid4().hex)
    raw = sheet.csv(path) if fmt == "csv" else reader.parquet(path)
    fields = header_map(columns, names) if names else {c: c for c in columns}
    kept = raw.select(*[F.col(f"`{c}`").alias(f) for c, f in fields.items()], F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("file_start"))
    kept = kept.filter(F.col(key).isNotNull() & (F.trim(key) != ""))
    return kept.withColumn("tech_domain", topic_from_file(F.col("file_name")))


def dataset_scan(spark: SparkSession, paths: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """Parquet and JSON-array files, told by their extension, as one dataset."""
    frames = []
    for p in paths:
        reader = spark.read.schema(schema) if schema else spark.read
        if p.endswith(".parquet"):
            frames.append(reader.parquet(p))
        elif p.endswith(".json"):
            frames.append(reader.option("multiLine", True).json(p))
        else:
            raise ValueError(f"unsupported file format: {p}")
    if schema:
        frames = [f.select(*schema.names) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_kind(directory: Column, kinds: Sequence[str]) -> Column:
    """Kind of a run from its directory name, else 'unknown'."""
    out = F.lit("unknown")
    for kind in reversed(list(kinds)):
        out = F.when(directory.contains(f"_{kind}_"), kind).otherwise(out)
    return out


def run_logs(spark: SparkSession, glob: str, schema: StructType, kinds: Sequence[str] = ("sft", "rl")) -> DataFrame:
    """JSON lines of `*/raw.jsonl`, the first run of each kind only."""
    rows = spark.read.schema(schema).json(glob)
    # the folder of raw.jsonl, be that a file or itself a folder of part files
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.jsonl(?:/|$)", 1)
    rows = rows.select("*", folder.alias("run")).withColumn("kind", run_kind(F.col("run"), kinds))
    first = rows.groupBy("kind").agg(F.min("run").alias("run"))
    return rows.join(first, ["kind", "run"], "left_semi")


# fixed values: text forms of node and edge upserts in a graph script
NODE_FORM = r"^MERGE \((\w+):(\w+) \{(\w+): '((?:[^'\\]|\\.)*)'\}\)(.*)$"
EDGE_FORM = (
    r"^MATCH \(\w+:(\w+) \{\w+: '((?:[^'\\]|\\.)*)'\}\) MATCH \(\w+:(\w+) \{\w+: '((?:[^'\\]|\\.)*)'\}\)"
    r" MERGE \(\w+\)-\[:(\w+)(?: \{role: '((?:[^'\\]|\\.)*)'\})?\]->\(\w+\)$"
)


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(['\\])", "$1")


def script_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of graph scripts, one per line; comments and the final `;` dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("file_start"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("//"))
    return lines.select(F.regexp_replace("line", ";$", "").alias("statement"), "file_name").filter("statement <> ''")


def script_nodes(statements: DataFrame) -> DataFrame:
    """(label, key, properties text) of the node upserts."""
    s = F.col("statement")
    rows = statements.filter(s.rlike(NODE_FORM))
    return rows.select(
        F.regexp_extract(s, NODE_FORM, 2).alias("label"),
        unescape(F.regexp_extract(s, NODE_FORM, 4)).alias("key"),
        F.trim(F.regexp_extract(s, NODE_FORM, 5)).alias("properties"),
    )


def script_edges(statements: DataFrame) -> DataFrame:
    """(src_label, src_key, rel_type, dst_label, dst_key, role) of the edge upserts, each once."""
    s = F.col("statement")
    rows = statements.filter(s.rlike(EDGE_FORM))

    def part(i: int) -> Column:
        return unescape(F.regexp_extract(s, EDGE_FORM, i))

    role = F.when(part(6) != "", part(6))
    return rows.select(
        part(1).alias("src_label"),
        part(2).alias("src_key"),
        part(5).alias("rel_type"),
        part(3).alias("dst_label"),
        part(4).alias("dst_key"),
        role.alias("role"),
    ).distinct()


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """Keep-first deduplication in load order: file name, start of the split, then the row as read in the split.

    The order is that of the files however their splits are packed into tasks.
    """
    start = [F.col("file_start")] if "file_start" in df.columns else []
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return keep_first(rows, [key], [F.col("file_name"), *start, F.col("_row")]).drop("_row")
