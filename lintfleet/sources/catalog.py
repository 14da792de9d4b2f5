"""Catalog snapshots: one table per system catalog, keyed by `db_id`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.operators.keyed import union_all

# Snapshot tables a catalog may hold, named after the system catalog without its prefix.
SNAPSHOT_TABLES = [
    "namespace", "class", "index", "index_class", "constraint", "depend", "rewrite", "attribute", "attrdef",
    "type", "enum", "proc", "language", "policy", "role", "auth_member", "trigger", "stat_index",
    "stat_table", "stats", "extension", "available_extension", "available_extension_version", "privilege",
    "setting", "activity", "hba", "default_acl", "ns_acl", "description",
]


class Catalog:
    """Loads snapshot tables on first use, so a rule only plans the tables it reads."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._tables: dict[str, DataFrame] = {}
        # relations joined once with schema, extension ownership and API access; set when many rules run together
        self.base: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name not in SNAPSHOT_TABLES:
                raise KeyError(name)
            self._tables[name] = self._load(name)
        return self._tables[name]


def read_snapshot(spark: SparkSession, root: str, snapshot_ts: str | None = None) -> Catalog:
    """Catalog of parquet folders `root/<table>`, partitioned by `snapshot_ts` when one is given."""

    def load(name: str) -> DataFrame:
        if name == "index_class":
            return load("class").filter(F.col("relkind") == "i")
        df = spark.read.parquet(f"{root}/{name}")
        return df.filter(F.col("snapshot_ts") == F.lit(snapshot_ts)) if snapshot_ts is not None else df

    return Catalog(load)


def read_jdbc(spark: SparkSession, db_id: int, url: str, properties: dict[str, str]) -> Catalog:
    """Catalog of one live database; snapshots of many are written with `write_snapshot`."""

    def load(name: str) -> DataFrame:
        if name == "index_class":
            return load("class").filter(F.col("relkind") == "i")
        df = spark.read.jdbc(url, f"pg_catalog.pg_{name}", properties=properties)
        return df.withColumn("db_id", F.lit(db_id))

    return Catalog(load)


def write_snapshot(catalog: Catalog, root: str, snapshot_ts: str, tables: list[str]) -> None:
    for name in tables:
        df = catalog[name].withColumn("snapshot_ts", F.lit(snapshot_ts))
        df.write.mode("append").partitionBy("snapshot_ts").parquet(f"{root}/{name}")


def export_json(dimensions: dict[str, DataFrame]) -> DataFrame:
    """Every dimension row as (kind, db_id, json): the exported schema cache."""
    rows = [
        df.select(F.lit(kind).alias("kind"), "db_id", F.to_json(F.struct(*sorted(df.columns))).alias("json"))
        for kind, df in sorted(dimensions.items())
    ]
    return union_all(rows)
