"""Writing graphs, instruction sets, training rows and reports; stage tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.datasets import instruction_rows

# fixed values: statements per batch file of a graph sink
BATCH_ROWS = 5000


def write_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Write in phases (dimension nodes, items, edges) and return the manifest `(phase, part, rows)`.

    Files are as large as their tasks; `batch` bounds their rows, as for sinks
    that take `BATCH_ROWS` statements at a time.
    Edges are partitioned by relation so that one relation is one folder to read.
    """
    spark = edges.sparkSession
    for name, df in nodes.items():
        if name != "item":
            df.write.mode("overwrite").option("maxRecordsPerFile", batch or 0).parquet(f"{path}/nodes/{name}")
    nodes["item"].write.mode("overwrite").option("maxRecordsPerFile", batch or 0).parquet(f"{path}/nodes/item")
    edges.write.mode("overwrite").option("maxRecordsPerFile", batch or 0).partitionBy("rel_type").parquet(f"{path}/edges")
    parts = []
    for name in nodes:
        phase = "items" if name == "item" else "dimension_nodes"
        count = spark.read.parquet(f"{path}/nodes/{name}").agg(F.count("*").alias("rows"))
        parts.append(count.select(F.lit(phase).alias("phase"), F.lit(name).alias("part"), "rows"))
    per_edge = spark.read.parquet(f"{path}/edges").groupBy(F.col("rel_type").alias("part")).agg(F.count("*").alias("rows"))
    out = per_edge.select(F.lit("edges").alias("phase"), "part", "rows")
    for p in parts:
        out = out.unionByName(p)
    return out


def read_graph(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    return {n: spark.read.parquet(f"{path}/nodes/{n}") for n in names}, spark.read.parquet(f"{path}/edges")


def write_instructions(qa: DataFrame, path: str, system: str) -> DataFrame:
    """Instruction JSON per split, and the size statistics (ratio to 2 dp).

    `qa(question, cypher, split)`.
    """
    for name in ("train", "test"):
        rows = instruction_rows(qa.filter(F.col("split") == name), system)
        rows.write.mode("overwrite").json(f"{path}/{name}")
    sizes = qa.agg(F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size"))
    total = F.col("train_size") + F.col("test_size")
    return sizes.select("train_size", "test_size", total.alias("total_size"), F.round(F.col("train_size") / total, 2).alias("train_ratio"))


# fixed values: how an instruction file names its columns
INSTRUCTION_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output"}


def dataset_info(spark: SparkSession, prefix: str) -> DataFrame:
    """Description table of the instruction files."""
    rows = [(f"{prefix}_{s}", f"{s}.json", "alpaca", dict(INSTRUCTION_COLUMNS)) for s in ("train", "test")]
    return spark.createDataFrame(rows, "name string, file_name string, formatting string, columns map<string,string>")


def training_rows(samples: DataFrame, answers: DataFrame, source: str, ability: str, system: str) -> DataFrame:
    """Nested training rows with the gold answer as JSON text.

    `samples(qid, question, cypher, category, complexity, split, index)`,
    `answers(qid, rows_json, row_count, success)`.
    """
    rows = samples.join(answers, "qid", "left")
    truth = F.to_json(
        F.struct(
            F.col("cypher"),
            F.col("rows_json").alias("gold_rows"),
            F.coalesce("row_count", F.lit(0)).alias("gold_row_count"),
            F.coalesce("success", F.lit(False)).alias("gold_success"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        ).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct("split", "index", "qid", "question", "category", "complexity", F.col("cypher").alias("gold_cypher")).alias("extra_info"),
    )


def write_training_rows(rows: DataFrame, path: str) -> DataFrame:
    """Parquet per split; returns rows and matched gold answers per split."""
    rows.withColumn("split", F.col("extra_info.split")).write.mode("overwrite").partitionBy("split").parquet(path)
    success = F.get_json_object("reward_model.ground_truth", "$.gold_success") == "true"
    return rows.groupBy(F.col("extra_info.split").alias("split")).agg(
        F.count("*").alias("rows"), F.count_if(success).alias("matched")
    )


def write_comparison(report: DataFrame, path: str) -> None:
    """One CSV with a row per model; a report of a few rows, so one file."""
    report.orderBy(*report.columns[:1]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stage(spark: SparkSession, path: str, name: str, build: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """A stage's table: read when it is complete, else built and written first."""
    target = f"{path}/{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    exists = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if not (use_cache and exists):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
