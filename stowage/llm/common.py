"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import cut_lineage, discard

#: The ASCII white space of the text contracts, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def fingerprint_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, component) per node, the component
    being its smallest node.

    Alternates two steps until nothing changes, about log(n) times: every node hands its larger neighbours to
    its smallest one, then its smaller neighbours. The edges stay distributed and never outnumber those given;
    each round is written to the shared folder, so lineage stays short and lost executors cost one round, and takes the place of the
    one before. Null ends and loops are ignored.
    """
    edges = cut_lineage(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    before = fingerprint_of(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        handed = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        handed = handed.distinct()
        low = handed.groupBy("a").agg(F.min("b").alias("least"))
        old, edges = edges, cut_lineage(
            handed.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
            .union(low.select("a", F.col("least").alias("b"))).distinct(), "edges",
        )
        discard(old)
        after = fingerprint_of(edges)
        if after == before:
            break
        before = after
    return (
        edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        .union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )
