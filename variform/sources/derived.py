"""Variant rows derived from the driver's order tables by plain SQL, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .header import Field, VariantHeader

HEADER = VariantHeader(
    infos={"DP": Field("DP", "1", "Integer", "Depth"), "AF": Field("AF", "A", "Float", "Frequency"), "DB": Field("DB", "0", "Flag", "Known")},
    formats={"GT": Field("GT", "1", "String", "Genotype"), "DP": Field("DP", "1", "Integer", "Depth"), "AD": Field("AD", "R", "Integer", "Allele depths")},
    filters={"PASS": "All filters passed", "q10": "Low quality"},
    contigs={f"chr{i}": {"length": "20100"} for i in range(1, 6)},
    samples=("S1", "S2", "S3", "S4"),
)

#: One row an order: two records at each of the loci, see the comment on each column.
SITES_SQL = """
SELECT k, concat('chr', CAST(1 + k % 5 AS STRING)) AS chrom,
 1 + (CAST(floor(k/10.0) AS BIGINT) * 7919) % 20011 AS pos,
 CASE WHEN t=4 THEN concat(b0,b1,b2) WHEN t=5 THEN concat(b0,b1) ELSE b0 END AS ref,
 CASE WHEN t IN (0,1) THEN b1 WHEN t=2 THEN b2 WHEN t=3 THEN concat(b0,b1,b2) WHEN t=4 THEN b0
      WHEN t=5 THEN concat(b1,b0) WHEN t=6 THEN concat(b1,',',b2)
      WHEN l%5=0 THEN '*' WHEN l%5<3 THEN '<DEL>' ELSE '.' END AS alt,
 CASE WHEN k%11=0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) END AS qual,
 CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'q10' ELSE '.' END AS filter,
 CAST(o_custkey % 60 AS INT) AS dp
FROM (SELECT k, l, o_totalprice, o_orderstatus, o_custkey,
  (l*3 + CASE WHEN k%10>=5 THEN l%3 ELSE 0 END) % 8 AS t,
  substr('ACGT', CAST(1+ l   %4 AS INT),1) b0,
  substr('ACGT', CAST(1+(l+1)%4 AS INT),1) b1,
  substr('ACGT', CAST(1+(l+2)%4 AS INT),1) b2
  FROM (SELECT o_orderkey k, CAST(floor(o_orderkey/10.0) AS BIGINT)*5 + o_orderkey%5 l,
          o_totalprice, o_orderstatus, o_custkey FROM {orders}) o1) o
"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the data model (see sources.header.VariantHeader.schema) over the derived sites.

    Allele h of sample i is (k + i + h) % (ALTs + 1), missing where (k + 3i + 5h) % 7 = 6; phased where (k + i) % 3 = 0;
    DP is (3k + 7i) % 50, missing where (k + i) % 9 = 0; AD of allele a is (k + i + 3a) % 40."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    # a small or unsplit file would leave the work on these rows to one or two tasks
    orders = orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    s = spark.sql(SITES_SQL.format(orders="{orders}"), orders=orders)
    alts = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    s = s.withColumn("alts", alts).withColumn("filters", F.when(F.col("filter") == ".", F.array().cast("array<string>")).otherwise(F.array("filter")))
    n = F.size("alts")
    k = F.col("k")
    one = []
    for i in range(4):
        allele = lambda h, i=i: F.when((k + 3 * i + 5 * h) % 7 == 6, F.lit(None)).otherwise(((k + i + h) % (n + 1)).cast("int"))
        phased = (k + i) % 3 == 0
        one.append(
            F.struct(
                F.struct(F.array(allele(0), allele(1)).alias("alleles"), F.array(phased, phased).alias("phased")).alias("GT"),
                F.when((k + i) % 9 != 0, ((3 * k + 7 * i) % 50).cast("int")).alias("DP"),
                F.transform(F.sequence(F.lit(0), n), _depth(k, i)).alias("AD"),
            )
        )
    info = F.struct(F.col("dp").alias("DP"), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), _frequency(k)).alias("AF"), (k % 4 == 0).alias("DB"))
    return s.select(
        k.alias("row_id"), (k % 5).cast("int").alias("contig_idx"), "chrom", F.col("pos").cast("int").alias("pos"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("rs"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("ids"),
        "ref", "alts", F.col("qual").cast("float").alias("qual"), "filters", info.alias("info"), F.array(*one).alias("samples"),
    )


def _depth(k, i):
    return lambda a: ((k + i + 3 * a) % 40).cast("int")


def _frequency(k):
    return lambda a: (((k + a) % 10) / F.lit(10.0)).cast("float")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(serial, chrom, from, to, name) annotation intervals from part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    start = 1 + (key * 613) % 20011
    return part.select(key.alias("serial"), F.concat(F.lit("chr"), (1 + key % 5).cast("string")).alias("chrom"), start.cast("int").alias("from"), (start + F.col("p_size")).cast("int").alias("to"), F.col("p_brand").alias("name"))
