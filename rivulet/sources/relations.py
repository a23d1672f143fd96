"""Result relations and tables as CSV or Parquet: reading, merging and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_COLUMNS = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"


def oracle_schema(n: int) -> str:
    """The columns of wide flow rows of n packets."""
    return ", ".join([
        KEY_COLUMNS, "min_iat double", "max_iat double", "first_ts double", "last_ts double", "flow_size long", *(f"iat_{k} double" for k in range(1, n)),
        *(f"flags_{k} int" for k in range(1, n + 1)), *(f"pk_size_{k} int" for k in range(1, n + 1)),
    ])


def concat_csv(spark: SparkSession, paths: list[str], schema: str, limit: int | None = None) -> DataFrame:
    """Files without headers as one table; empty cells are null. With `limit`, as many rows, for a dry run."""
    out = spark.read.schema(schema).csv(paths)
    return out if limit is None else out.limit(limit)


def merge_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files that each have the header, as one table."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow sizes with header: flow_id, size, heavy."""
    t = spark.read.schema("ip_src string, ip_dst string, port_src int, port_dst int, proto int, size long, heavy_hitter int").option("header", True).csv(path)
    return t.select(F.concat_ws(",", "ip_src", "ip_dst", "port_src", "port_dst", "proto").alias("flow_id"), "size", F.col("heavy_hitter").alias("heavy"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Probabilities that were worked out before: flow_id, proba."""
    t = spark.read.schema(f"{KEY_COLUMNS}, proba double").csv(path)
    return t.select(F.concat_ws(",", "src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("flow_id"), "proba")


def write_relations(out: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each relation to a folder of its own."""
    for name, df in out.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def write_cdf(cdf: DataFrame, path: str) -> None:
    """(size, n_flows, cdf) as lines `size 1 cdf`."""
    cdf.select(F.col("size").alias("flow_size"), F.lit(1).alias("tmp"), "cdf").write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def minute_of(file: str = "file") -> F.Column:
    """The minute that a capture's name ends in before its suffix, as a number."""
    return F.regexp_extract(F.element_at(F.split(F.col(file), "/"), -1), r"(\d+)\.[A-Za-z.]+$", 1).cast("int")
