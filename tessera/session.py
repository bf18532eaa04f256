"""Session factory and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "tessera", cpus: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; conf keys use __ for dots.

    With cpus it is local; else the master, shuffle partitions and memory are the cluster's (spark-submit), or Spark's defaults.
    """
    b = SparkSession.builder.appName(app)
    settings = {} if cpus is None else {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    settings |= {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
