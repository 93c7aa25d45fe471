"""Roles of the engine's inputs played by the test tables, and fixtures that render to Spark and to SQL alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as items: a supplier is a document, a line number a section, a return flag a status."""
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "pending_review").otherwise("rejected")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_ord"),
        F.when(F.col("l_linenumber") == 7, "unmapped").otherwise(F.concat(F.lit("section"), F.col("l_linenumber").cast("string"))).alias("section"),
        F.create_map(F.lit("value"), F.col("l_linestatus")).alias("fields"),
        F.col("l_linestatus").alias("raw_text"),
        F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"),
        F.when(F.col("l_tax") > 0.06, F.array(F.lit("odd_tax"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        status.alias("status"),
        F.array().cast("array<string>").alias("actions"),
    )


@dataclass(frozen=True)
class Fixture:
    """Rows written once, for both engines."""

    ddl: str
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.ddl)

    def sql(self) -> str:
        """A SELECT of the rows, with types."""
        kinds = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean"}
        names, types = zip(*(c.split() for c in self.ddl.split(", ")), strict=True)
        cells = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        casts = ", ".join(f"cast({n} as {kinds[t]}) as {n}" for n, t in zip(names, types, strict=True))
        return f"select {casts} from (values {cells}) as t({', '.join(names)})"


def _literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool | int | float):
        return str(v).lower()
    return "'" + str(v).replace("'", "''") + "'"
