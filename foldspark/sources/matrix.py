"""Feature matrices from tables: (id long, features array<double>)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoData, WrongDimensions


def from_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """A matrix from an array column; floats become doubles once, here. Rows without id or vector are left out."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("features")).where("id is not null and features is not null")


def from_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """A matrix from numeric columns; only these are read. Rows with a null are left out."""
    whole = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(F.col(id_col).cast("long").alias("id"), whole.alias("features"), *columns).dropna(subset=[id_col if id_col in df.columns and id_col in columns else "id", *columns]).select("id", "features")


def single(matrix: DataFrame) -> DataFrame:
    """The features rounded to 32 bits; what is computed from them stays in doubles. Numbers beyond that range become infinite."""
    return matrix.withColumn("features", F.col("features").cast("array<float>").cast("array<double>"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def shape(matrix: DataFrame) -> tuple[int, int]:
    """(rows, dimensions), in one pass; all rows must have the same number of dimensions."""
    row = matrix.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
    if not row["n"]:
        raise NoData("the matrix has no rows")
    if row["lo"] != row["hi"]:
        raise WrongDimensions(f"rows have {row['lo']} to {row['hi']} dimensions")
    return row["n"], row["lo"]
