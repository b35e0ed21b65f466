"""Small helpers shared by the operators: the shared folder, cutting lineage, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share, named by spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) gets a new folder in /tmp; a cluster gets an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, short lineage, safe when executors go.

    ``group_rows``: rows of a row group at most. Parquet looks at the size of a row group only after 100 rows, so tables whose rows hold
    megabytes need it; a row group is held in memory when it is written and when it is read.
    """
    path = shared_folder(df.sparkSession)
    out = df.write.option("compression", compression)
    (out if group_rows is None else out.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id and text. Repeated rows share it; a null id or text is a value like others."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(text, F.lit("\x1e")))))


def packed(df: DataFrame) -> Column:
    """All columns of a table as one, so that helper columns can't clash with them."""
    return F.struct("*") if df.columns else F.struct(F.lit(0).alias("_"))
