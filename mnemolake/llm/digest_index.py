"""Exact de-duplication against a persistent digest index.

The index is a bucketed and sorted parquet table of SHA-256 digests in a folder that all executors share. New
documents are reduced to one row per digest, sort-merge anti-joined with the index, and what is new is appended.
The index side is neither shuffled nor moved; only (digest, id) rows of the new documents are.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.shared import SPACE, Registry, stored, table
from mnemolake.session import scratch_path

registry = Registry()


def normalized(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


class DigestIndex:
    """Digests seen so far, in ``path``. The number of buckets is fixed when the index is first opened.

    At 100 TB a few thousand buckets keep one bucket within a task; the layout is stored with the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/_layout"
        try:
            buckets, id_type = spark.read.text(layout).first()[0].split()
        except AnalysisException:
            spark.createDataFrame([(f"{buckets} {id_type}",)], "value string").coalesce(1).write.text(layout)
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, firsts: DataFrame) -> None:
        """Add the (digest, keep_id) rows whose digest the index does not hold; one row per digest is expected.

        A job that fails leaves the index as it was; running it again adds nothing twice.
        """
        new = firsts.join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``digest``; the index grows by the new texts.

    Texts are equal when equal after white space runs become one space; null is the empty text. Of equal texts
    the first in the index stays, else the row with the smallest id (null ids come last). ``group_size`` counts the
    rows of this batch. A repeated row (same id, same text) is a copy: exactly one row of a group is kept, none
    when an earlier batch holds the text. An empty table gives no rows. Other columns are ignored.
    """
    rows = stored(
        docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    firsts = rows.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("group_size"))
    firsts = firsts.select("digest", F.col("f.b").alias("keep_id"), F.col("f.c").alias("first_row"), "group_size")
    known = index.rows().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    # one row per digest on both sides: no group is hot here
    firsts = stored(firsts.join(known.hint("merge"), "digest", "left"), "firsts")
    index.append(firsts)
    # two plain shuffles meet here, so the engine can split a digest that holds a large share of the rows
    out = rows.join(firsts, "digest")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("old").isNull() & (F.col("row") == F.col("first_row"))).alias("kept"),
        "digest",
    )


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Repeated rows (same id, same text) leave one."""
    judged = deduplicate(docs, index, id_col, text_col)
    stays = judged.groupBy("digest", id_col).agg(F.max("kept").alias("_stays"), F.count("*").alias("_copies"))
    stays = stays.filter("_stays").select(F.col("digest").alias("_of"), F.col(id_col).alias("_id"), "_copies")
    marked = docs.withColumn("_digest", digest(F.col(text_col)))
    found = marked.join(stays, (F.col("_digest") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_id")))
    once = found.filter("_copies = 1")
    again = found.filter("_copies > 1").dropDuplicates(["_of", id_col])
    return once.unionByName(again).select(*docs.columns)


@registry.add(
    "op9_digest_index",
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    judged = deduplicate(table(spark, sf_dir, "documents"), index)
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
