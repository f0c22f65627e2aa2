"""Tables kept as segments: each change appends small bucketed files and one line to a log; nothing old is rewritten.

A table lies under path/g<generation>/<name>, partitioned by the number of the segment (`seq`) and bucketed by a key, so that
joins and aggregates on that key read it without an exchange, however many segments there are; files are compressed by Zstandard. A segment counts once
its line is in the log; files of a failed or repeated attempt have a number of their own that no line names, and are never read.
Compaction writes the live rows as the first segment of a new generation. One job at a time may write.
"""

from __future__ import annotations

import hashlib
import random
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "seq long, gen long, job string, batch long, facts map<string,double>"


class SegmentTables:
    """Tables name -> (columns as DDL, bucket column) under path."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = 8) -> None:
        self.spark, self.path, self.tables, self._buckets = spark, path.rstrip("/"), tables, buckets

    def log(self) -> DataFrame:
        """All lines so far."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    @cached_property
    def lines(self) -> list:
        """Lines of the last generation in order, one a segment: as many as compaction allows."""
        log = self.log()
        last = log.agg(F.max("gen")).first()[0]
        return [] if last is None else log.filter(F.col("gen") == last).orderBy("seq").collect()

    @property
    def generation(self) -> int:
        return self.lines[-1]["gen"] if self.lines else 0

    @property
    def facts(self) -> dict[str, float]:
        """What the last segment says of the whole."""
        return self.lines[-1]["facts"] if self.lines else {}

    @property
    def buckets(self) -> int:
        return int(self.facts.get("buckets", self._buckets))

    def refresh(self) -> None:
        """Look again at what others have written."""
        self.__dict__.pop("lines", None)

    def applied(self, job: str, batch: int) -> bool:
        return self.log().filter((F.col("job") == job) & (F.col("batch") == batch)).limit(1).count() > 0

    def new_seq(self) -> int:
        """A number above all of the log; attempts at the same change get different ones."""
        last = self.lines[-1]["seq"] >> 20 if self.lines else 0
        return (last + 1 << 20) + random.SystemRandom().randrange(1 << 20)

    def _table(self, name: str, gen: int) -> str:
        columns, key = self.tables[name]
        place = f"{self.path}/g{gen}/{name}"
        table = "segments_" + hashlib.md5(f"{place} {columns} {key}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, seq BIGINT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (seq) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            if self.spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive":  # which keeps a list of partitions
                self.spark.catalog.recoverPartitions(table)
        return table

    def table(self, name: str, seqs: list[int] | None = None, gen: int | None = None) -> DataFrame:
        """Rows of the committed segments with their seq; with seqs, of these segments only (other files aren't touched)."""
        table = self._table(name, self.generation if gen is None else gen)
        self.spark.catalog.refreshTable(table)
        seqs = [r["seq"] for r in self.lines] if seqs is None else seqs
        return self.spark.table(table).filter(F.col("seq").isin(seqs) if seqs else F.lit(False))

    def write(self, name: str, df: DataFrame, seq: int, gen: int | None = None, dealt: bool = False) -> None:
        """Append df as segment seq of a table: one sorted file a bucket. dealt: df lies in the buckets' partitions already; rows elsewhere make more files, no harm."""
        gen = self.generation if gen is None else gen
        columns, key = self.tables[name]
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(columns)], F.lit(seq).alias("seq"))
        (rows if dealt else rows.repartition(self.buckets, key)).write.insertInto(self._table(name, gen))

    def commit(self, seq: int, job: str = "", batch: int = 0, facts: dict[str, float] | None = None, gen: int | None = None) -> None:
        """Name the segment in the log: one file, renamed into place."""
        gen = self.generation if gen is None else gen
        line = (seq, gen, job, batch, {**(facts or {}), "buckets": float(self.buckets)})
        self.spark.createDataFrame([line], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        self.refresh()

    def live(self, name: str) -> DataFrame:
        """Rows of a table that still count."""
        return self.table(name).drop("seq")

    def compact(self) -> None:
        """Rewrite the live rows of all tables as one segment of a new generation; readers go on with the old one until it is named."""
        if len(self.lines) < 2:
            return
        seq, gen, facts = self.new_seq(), self.generation + 1, self.compacted()
        for name in self.tables:
            self.write(name, self.live(name), seq, gen)
        self.commit(seq, "compaction", 0, facts, gen)

    def compacted(self) -> dict[str, float]:
        """Facts of the compacted tables."""
        return self.facts

    def vacuum(self) -> None:
        """Delete older generations and segments that the log doesn't name. No one may read or write these meanwhile."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = {f"seq={r['seq']}" for r in self.lines}
        for gen in fs.listStatus(root):
            name = gen.getPath().getName()
            if name.startswith("g") and name != f"g{self.generation}":
                fs.delete(gen.getPath(), True)
            elif name.startswith("g"):
                for s in [s for t in fs.listStatus(gen.getPath()) for s in fs.listStatus(t.getPath())]:
                    if s.getPath().getName().startswith("seq=") and s.getPath().getName() not in keep:
                        fs.delete(s.getPath(), True)
