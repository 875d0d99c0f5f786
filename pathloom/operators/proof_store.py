"""Proofs kept from one review to the next, in buckets of their key, so that a review's rows move to them and they never move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators.constraints import with_cache

STORED = "key string, status string, formula string, reachability_only boolean"


@dataclass
class ProofStore:
    """Known proofs as a table of `buckets` buckets by key, its files at path. A session that does not know the table yet makes it known again;
    buckets must be the number that it was made with."""

    spark: SparkSession
    table: str
    path: str
    buckets: int = 64

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.table):
            columns = ", ".join(f"`{n}` {t}" for n, t in (f.split() for f in STORED.split(", ")))
            self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (`key`) SORTED BY (`key`) INTO {int(self.buckets)} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.table)

    def resolve(self, computed: DataFrame) -> DataFrame:
        """computed (see constraints.with_cache) with what is known in place of what was computed. Both sides meet bucket by bucket: only computed is shuffled."""
        return with_cache(computed, self.read())[0]

    def add(self, computed: DataFrame) -> None:
        """Keep the proofs of computed that are not known yet, once a key; unknown results stay out. Of two writers at once both may add a key: the rows are alike."""
        new = with_cache(computed, self.read())[1].select(*[f.split()[0] for f in STORED.split(", ")])
        new.repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
