"""Failed objects, the script that repairs them, the manifest of a review, DDL of every dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from .registry import load, query


@query("""SELECT sha256('{"effective":' || to_json(list(n_name ORDER BY n_name)) || ',"excluded":[{"table_name":"a","stage":"data","error":"e","ddl":"x"},{"table_name":"t","stage":"data","error":"e","ddl":"CREATE TABLE t (a int)"}],"position":"binlog.000001:4"}') AS manifest_hash FROM nation""")
def manifest_hash(spark: SparkSession, sf: str) -> DataFrame:
    out = spark.sql("SELECT * FROM VALUES ('t', 'data', 'e', 'CREATE TABLE t (a int)'), ('a', 'data', 'e', 'x') AS v(table_name, stage, error, ddl)")
    return jobs.manifest_hash(load(spark, sf, "nation").select(F.col("n_name").alias("table_name")), out, "binlog.000001:4")
