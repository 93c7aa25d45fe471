"""Tables by key in a shared folder: appended, replaced, merged and deleted as whole versions, so that a reader never meets half of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and the columns that name a row.
KEYS = {"documents": ["doc_id"], "items": ["item_id"], "audit": ["event_id"], "profiles": ["profile_id"], "mappings": ["heading"], "settings": ["key"]}


class Store:
    """Each change of a table writes its next version, ``folder/table/v=N``; the latest one that is complete counts, and the one before it is kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = [s.getPath() for s in system.listStatus(path) if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done)

    def read(self, table: str) -> DataFrame | None:
        """The rows of a table; none if it was never written."""
        versions = self._versions(table)
        return self.spark.read.parquet(f"{self.folder}/{table}/v={versions[-1]}") if versions else None

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Makes ``rows`` the table."""
        versions = self._versions(table)
        to = versions[-1] + 1 if versions else 0
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/v={to}")
        for old in versions[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/v={old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(table)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        have = self.read(table)
        return self.write(table, rows if have is None else have.unionByName(rows, allowMissingColumns=True))

    def upsert(self, table: str, rows: DataFrame, at: str | None = None) -> DataFrame:
        """Rows take the place of those with their key; of several with one key the last by ``at`` counts."""
        have = self.read(table)
        return self.write(table, latest(rows, KEYS[table], at) if have is None else merged(have, latest(rows, KEYS[table], at), KEYS[table]))

    def replace(self, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Takes out all rows with the values of ``keys`` that ``rows`` have, and puts ``rows`` there."""
        have = self.read(table)
        return self.write(table, rows if have is None else merged(have, rows, keys))

    def delete(self, table: str, gone: DataFrame, keys: list[str] | None = None) -> DataFrame | None:
        have = self.read(table)
        return None if have is None else self.write(table, have.join(gone, keys or KEYS[table], "left_anti").select(*have.columns))

    def update(self, table: str, where: Column, **values: Column) -> DataFrame | None:
        have = self.read(table)
        if have is None:
            return None
        changed = {c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()}
        return self.write(table, have.withColumns(changed))

    def get(self, table: str, value: object) -> DataFrame | None:
        """The row of a key."""
        have = self.read(table)
        return None if have is None else have.where(F.col(KEYS[table][0]) == F.lit(value))

    def listed(self, table: str, *order: Column) -> DataFrame | None:
        """The rows in order, by their key where that leaves them equal."""
        have = self.read(table)
        return None if have is None else have.orderBy(*order, *KEYS[table])


def latest(rows: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Of each key the last row by ``at``, of equals the greatest; without ``at``, equal rows once."""
    if at is None:
        return rows.dropDuplicates(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("__x")).select(*keys, "__x.*").select(*rows.columns)


def merged(have: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with the rows that share a key with ``rows`` replaced by these."""
    return have.join(rows.select(*keys).distinct(), keys, "left_anti").select(*have.columns).unionByName(rows, allowMissingColumns=True)
