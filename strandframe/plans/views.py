"""Genomic views over the driver's tables, each one SQL text for both engines.

``{}`` holes differ by dialect: see SPARK and DUCK. The views give the operators inputs of the shapes that FASTA, BED,
VCF, FASTQ and alignment files have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters to bases: a bijection would need 4 letters; 26 fold onto ACGT with a few N and ambiguity codes.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
CODES = "ACGTACGTACGTACGTACGTANRYKM"

SPARK = {"div": "div", "g": "", "rint": "rint({})", "double": "DOUBLE", "list": "collect_list"}
DUCK = {"div": "//", "g": ", 'g'", "rint": "round_even({}, 0)", "double": "DOUBLE", "list": "list"}

VIEWS = {
    # contigs: one a document
    "contigs": f"""SELECT doc_id AS contig_idx, concat('doc', doc_id) AS contig, length(seq) AS length, seq FROM
        (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''{{g}}), '{LETTERS}', '{BASES}') AS seq FROM documents) s WHERE length(seq) > 0""",
    # the same with N and ambiguity codes
    "raw_contigs": f"""SELECT doc_id AS contig_idx, concat('doc', doc_id) AS contig, seq FROM
        (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''{{g}}), '{LETTERS}', '{CODES}') AS seq FROM documents) s WHERE length(seq) > 0""",
    "chroms": """SELECT concat('chr', c_custkey % 22 + 1) AS contig, CAST(100000 + max(c_custkey) AS BIGINT) AS length FROM customer GROUP BY c_custkey % 22""",
    "regions": """SELECT concat('chr', o_custkey % 22 + 1) AS contig, (o_orderkey * 37) % 100000 AS st, (o_orderkey * 37) % 100000 + 50 + o_custkey % 500 AS en,
        o_orderkey AS line_no, o_totalprice / 1000000 AS rate, o_orderkey % 3 = 0 AS flag FROM orders""",
    "variants": """SELECT concat('chr', l_partkey % 22 + 1) AS contig, (l_orderkey * 13 + l_linenumber * 7) % 100000 AS pos,
        substring('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) AS base, substring('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS other,
        CAST(l_quantity AS BIGINT) % 10 AS extra, l_orderkey * 10 + l_linenumber AS line_no, l_returnflag AS flag,
        CASE l_returnflag WHEN 'A' THEN '0/1' WHEN 'N' THEN '1|0' ELSE '1/1' END AS gt,
        CASE WHEN l_linestatus = 'O' THEN '.' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)) END AS qual FROM lineitem""",
    "typed": """SELECT contig, pos, line_no, gt, qual, flag,
        CASE WHEN extra < 6 THEN base WHEN extra < 8 THEN concat(base, repeat(other, CAST(extra - 4 AS INT))) ELSE base END AS ref,
        CASE WHEN extra < 6 THEN other WHEN extra < 8 THEN base ELSE concat(base, repeat(other, CAST(extra - 6 AS INT))) END AS alt FROM variants""",
    "alignments": """SELECT event_id, concat('chr', user_id % 22 + 1) AS contig, (event_id * 31) % 100000 AS pos, CAST(user_id * 7 + event_id * 13 AS BIGINT) % 256 AS flag,
        CAST(floor(abs(value)) AS BIGINT) % 60 AS mapq, concat('chr', (user_id + (CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)) % 22 + 1) AS mate_contig,
        CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (200 + (event_id * 17) % 150 + (CASE WHEN event_id % 97 = 0 THEN 90000 ELSE 0 END)) AS tlen, 100 AS span FROM events""",
}


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a scan has fewer tasks than there are cores (one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contigs_of(documents: DataFrame, codes: str) -> DataFrame:
    """``contig_idx, contig, length, seq``: what the SQL of the view contigs (BASES) or raw_contigs (CODES) gives. Letters
    are translated as bytes, a text at a time; the SQL's expressions took most of the time of the queries on contigs."""
    table, drop = bytes.maketrans(LETTERS.encode(), codes.encode()), bytes(b for b in range(256) if chr(b) not in LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [None if t is None else t.lower().encode().translate(table, drop).decode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(seqs, pa.string())], ["contig_idx", "seq"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = documents.select("doc_id", "text").mapInArrow(run, f"contig_idx {kind}, seq string")
    return made.select("contig_idx", F.concat(F.lit("doc"), "contig_idx").alias("contig"), F.length("seq").alias("length"), "seq").where("length > 0")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables and of the genomic views that a query names."""
    for table in ("documents", "orders", "lineitem", "events", "customer", "embeddings"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (spread(df.select("doc_id", "text")) if table == "documents" else df).createOrReplaceTempView(table)
    for name in names:
        if name in ("contigs", "raw_contigs"):
            made = contigs_of(spark.table("documents"), BASES if name == "contigs" else CODES)
            (made if name == "contigs" else made.drop("length")).createOrReplaceTempView(name)
            continue
        spark.sql(VIEWS[name].format(**SPARK)).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs = {"typed": ("variants",)}.get(name, ())
    register(spark, sf_dir, *needs, name)
    return spark.table(name)


def with_views(sql: str, *names: str) -> str:
    """DuckDB text with the views as common table expressions."""
    order = [n for n in VIEWS if n in names or (n == "variants" and "typed" in names)]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(**DUCK)})" for n in order) + "\n" + sql
