"""Text helpers shared by the corpus operators."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import scratch_path

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII bytes alone take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    """16-byte key of a text, wide enough to stand for it at any corpus size."""
    return F.unhex(F.md5(text.cast("binary")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def mounted_scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path that every worker can open and map into memory."""
    url = urlparse(scratch_path(spark, name))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"{name} maps files into memory: spark.checkpoint.dir must be a mounted shared folder, not {url.scheme}")
    os.makedirs(url.path, exist_ok=True)
    return url.path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps reuse the rows and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unused(df: DataFrame, *names: str) -> None:
    """Refuse to overwrite columns of the input."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input already has columns {sorted(taken)}; give other names for the results")
