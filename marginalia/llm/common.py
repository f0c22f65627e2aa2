"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parents[2]

#: White space of all contracts here.
WS = r"[\x20\x09-\x0D]"
#: Its runs that are not one space already; single spaces between words need no replacement.
LONG_WS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one where that is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-marginalia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers a row: broadcast if it has at most `most` rows (some 50 MB), else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows that a Python worker gets at once. Texts are long, so the usual 10000 rows are much memory.
BATCH_ROWS = 1000


def workers_ready(spark: SparkSession) -> None:
    """Bound the Arrow batches, and send this package to the Python workers where they can't import it by path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if str(ROOT) in known or getattr(spark.sparkContext, "_marginalia_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "marginalia").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._marginalia_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalized(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LONG_WS, " ")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def wider(df: DataFrame, carry: list[str], more: str) -> StructType:
    """Schema of df[carry] with the fields of a DDL string."""
    return StructType(df.select(*carry).schema.fields + StructType.fromDDL(more).fields)
