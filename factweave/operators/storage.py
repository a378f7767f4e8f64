"""Tables of the fact base as Parquet folders: upserts, insert-or-skip, jobs, schema version (SNK1-SNK13)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import TABLES, VERSION, schema


class FactStore:
    """A folder with one Parquet table for each entry of TABLES.

    A table is a folder of generations, `gen-1`, `gen-2` and so on; the last one that was written whole (it has Spark's
    `_SUCCESS`) counts. `append` adds files to it, `replace` writes the next one, so readers see either the old or the
    new set, whatever the store and whenever a writer dies. The generation before stays for readers that have begun.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, at: str):
        """(file system, path) of at."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _generations(self, name: str) -> list[int]:
        """The numbers of the generations that were written whole, in order. 0 is a table of version 1, which has its files in the folder itself."""
        fs, where = self._folder(f"{self.path}/{name}")
        if not fs.exists(where):
            return []
        inside = [s.getPath() for s in fs.listStatus(where)]
        found = [(int(m[1]), p) for p in inside if (m := re.fullmatch(r"gen-(\d+)", p.getName()))]
        whole = sorted(n for n, p in found if fs.exists(self._folder(f"{p}/_SUCCESS")[1]))
        return [0] * any(p.getName().endswith(".parquet") for p in inside) + whole

    def _at(self, name: str, generation: int) -> str:
        return f"{self.path}/{name}/gen-{generation}" if generation else f"{self.path}/{name}/*.parquet"

    def read(self, name: str) -> DataFrame:
        """The table; empty if it was never written. A table that cannot be read is an error."""
        whole = self._generations(name)
        if not whole:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._at(name, whole[-1]))

    def shaped(self, df: DataFrame, name: str) -> DataFrame:
        """df with the table's columns, missing ones null."""
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])

    def append(self, df: DataFrame, name: str) -> None:
        whole = self._generations(name)
        at = f"{self.path}/{name}" if whole == [0] else f"{self.path}/{name}/gen-{(whole or [1])[-1]}"
        # What a first write left behind when it broke off is no part of the table.
        self.shaped(df, name).write.mode("append" if whole else "overwrite").parquet(at)

    def replace(self, df: DataFrame, name: str) -> None:
        """Writes the next generation; df may be read from the one before."""
        whole = self._generations(name)
        self.shaped(df, name).write.mode("overwrite").parquet(f"{self.path}/{name}/gen-{(whole or [0])[-1] + 1}")
        for old in whole[:-1]:
            if old:
                fs, where = self._folder(self._at(name, old))
                fs.delete(where, True)

    def scratch(self, df: DataFrame) -> DataFrame:
        """df written beside the tables and read back, so that what follows does not work it out again; `sweep` removes it."""
        at = f"{self.path}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def sweep(self) -> None:
        fs, where = self._folder(f"{self.path}/scratch")
        fs.delete(where, True)

    def insert_new(self, df: DataFrame, name: str, key: list[str], order: str | None = None) -> None:
        """Appends the first row of each key that the table lacks."""
        w = Window.partitionBy(*key).orderBy(order or key[0])
        first = df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
        self.append(first.join(self.read(name).select(*key), key, "left_anti"), name)

    def upsert(self, df: DataFrame, name: str, key: list[str]) -> None:
        """Rows of df take the place of those of equal key."""
        own = self.shaped(df, name)
        self.replace(self.read(name).join(own.select(*key), key, "left_anti").unionByName(own), name)

    def insert_relations(self, relations: DataFrame) -> None:
        ordered = relations.withColumn("x", F.least("fact_a", "fact_b")).withColumn("fact_b", F.greatest("fact_a", "fact_b")).withColumn("fact_a", F.col("x")).drop("x")
        self.insert_new(ordered, "relations", ["fact_a", "fact_b"])

    def reject(self, rejected: DataFrame) -> None:
        self.append(rejected, "rejected_facts")

    def log_errors(self, errors: DataFrame) -> None:
        """Errors keep 2,000 characters of the message and 8,000 of the reply."""
        self.append(errors.withColumn("error", F.substring("error", 1, 2000)).withColumn("raw", F.substring("raw", 1, 8000)), "extraction_errors")

    def update_job(self, job: DataFrame) -> None:
        """Adds a job event; fields left null keep what they were."""
        self.append(job, "job_events")

    def jobs(self) -> DataFrame:
        """The latest non-null value of every field of each document's job."""
        fields = [c for c in schema("job_events").fieldNames() if c not in ("doc_id", "seq")]
        return self.read("job_events").groupBy("doc_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields])

    def version(self) -> str | None:
        row = self.read("schema_meta").where("key = 'version'").first()
        return row["value"] if row else None

    def migrate(self) -> None:
        """Brings the tables to VERSION: relations of version 1 lack the documents of their facts."""
        had = self.version()
        if had == "1":
            ids = self.read("facts").select("id", "doc_id")
            relations = self.read("relations").drop("doc_a", "doc_b")
            for side in ("a", "b"):
                relations = relations.join(ids.select(F.col("id").alias(f"fact_{side}"), F.col("doc_id").alias(f"doc_{side}")), f"fact_{side}", "left")
            self.replace(relations, "relations")
        if had != VERSION:
            self.upsert(self.spark.createDataFrame([("version", VERSION)], "key string, value string"), "schema_meta", ["key"])

    def reset(self) -> None:
        fs, where = self._folder(self.path)
        fs.delete(where, True)
