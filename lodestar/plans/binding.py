"""Binding of the catalog tiers (project <- series <- sample <- component) to the tables at hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalog:
    """Tier tables as DataFrames. Only the columns that a query takes are read: everything here is lazy."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sources(self) -> DataFrame:
        """customer key -> source_database, over two small dimensions."""
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        x = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
        return x.select(F.col("c_custkey").alias("project_pk"), F.lower("r_name").alias("source_database"))

    def samples(self) -> DataFrame:
        o = self.table("orders")
        first = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("series_pk"))
        x = o.join(first, o.o_orderkey == first.l_orderkey, "left").withColumnRenamed("o_custkey", "project_pk")
        x = x.join(self.sources(), "project_pk", "left")
        return x.select(
            F.col("o_orderkey").alias("pk"), "project_pk", "series_pk", "source_database", F.col("o_orderpriority").alias("tissue"),
            F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("tissue_standard"), F.col("o_orderstatus").alias("disease_category"),
            F.when(F.col("series_pk").isNotNull(), F.col("o_totalprice")).alias("n_cells"), F.col("o_orderdate").alias("publication_date"),
        )

    def series(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("series_pk"), F.col("p_name").alias("title"), F.col("p_type").alias("assay"), F.col("p_brand").alias("platform"), F.col("p_size").alias("cell_count"))

    def projects(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("project_pk"), F.col("c_name").alias("project_id"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("total_cells"))

    def celltypes(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("sample_pk"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("n"))

    def links(self) -> DataFrame:
        """Edges between consecutive documents of equal text."""
        from pyspark.sql.window import Window

        d = self.table("documents").select("doc_id", F.md5("text").alias("h"))
        return d.select(F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id")).alias("a"), F.col("doc_id").alias("b")).filter("a is not null")


@dataclass(frozen=True)
class Replaced(Catalog):
    """A catalog some of whose tables are other DataFrames."""

    tables: dict[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else super().table(name)


def register_views(k: Catalog, prefix: str = "unified_") -> list[str]:
    """Temporary views of the tiers under one prefix, for SQL by names that do not depend on where the tables are."""
    tiers = {"projects": k.projects, "series": k.series, "samples": k.samples, "celltypes": k.celltypes, "links": k.links}
    for name, made in tiers.items():
        made().createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tiers]
