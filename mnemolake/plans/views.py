"""Views over the given tables, as DataFrames and as SQL text for the cross-check engine."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.functions.text import tokens
from mnemolake.operators.common import bucketed_row_number

AS_OF = "2026-06-01"

SQL = {
    "docs_v": """docs_v AS (SELECT doc_id, text, source, lang, n_chars, 'Doc ' || doc_id AS title,
        source || '_' || doc_id || '.txt' AS filename,
        CASE WHEN doc_id % 11 = 0 THEN NULL
             ELSE DATE '2025-08-01' + CAST((doc_id * 37) % 300 AS INTEGER) END AS doc_date,
        [lang, 'band' || (n_chars // 2000)] AS topics FROM documents)""",
    "queries_v": "queries_v AS (SELECT item_id AS query_id, text FROM benchmark)",
    "vec_n": "vec_n AS (SELECT count(*) AS n FROM embeddings)",
    "doc_vec_v": """doc_vec_v AS (SELECT d.doc_id, CAST(e.embedding AS DOUBLE[]) AS v FROM documents d
        JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT n FROM vec_n))""",
    "query_vec_v": """query_vec_v AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM benchmark b
        JOIN embeddings e ON e.vec_id = b.item_id % (SELECT n FROM vec_n))""",
    "taxonomy_v": """taxonomy_v AS (SELECT DISTINCT keyword, 't' || (length(keyword) % 5) AS topic,
        CAST(1 + length(keyword) % 3 AS DOUBLE) AS weight
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS keyword FROM benchmark)
        WHERE length(keyword) >= 2)""",
    "entity_tokens": """entity_tokens AS (SELECT DISTINCT doc_id,
        unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM documents)""",
    "entities_v": """entities_v AS (SELECT doc_id, name,
        CASE WHEN length(name) % 2 = 0 THEN 'organization' ELSE 'location' END AS entity_type FROM entity_tokens)""",
    "memory_v": """memory_v AS (SELECT *, row_number() OVER (PARTITION BY workspace, memory_key
            ORDER BY created_at, doc_id) AS version FROM (
        SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, text AS content, 'ws' || (conv_id % 3) AS workspace,
        role AS actor, 'key/' || (conv_id % 20) AS memory_key,
        CASE conv_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'claim' WHEN 2 THEN 'task' ELSE 'thought_summary' END AS kind,
        CASE (conv_id + turn) % 4 WHEN 1 THEN 'candidate' WHEN 3 THEN 'deprecated' ELSE 'accepted' END AS state,
        TIMESTAMP '2026-01-01' + CAST(conv_id * 10 + turn AS INTEGER) * INTERVAL 1 HOUR AS created_at,
        CASE WHEN conv_id % 5 = 0
             THEN TIMESTAMP '2026-01-01' + CAST(conv_id * 10 + turn AS INTEGER) * INTERVAL 1 HOUR + INTERVAL 30 DAY
        END AS expires_at,
        CASE WHEN turn = 1 THEN 'key/' || ((conv_id + 1) % 20) WHEN turn = 2 THEN 'ext/' || conv_id END AS target_key,
        CASE WHEN turn = 0 THEN conv_id END AS source_document_id FROM conversations))""",
}
NEEDS = {"doc_vec_v": ["vec_n"], "query_vec_v": ["vec_n"], "entities_v": ["entity_tokens"]}


def sql(deps: str, body: str) -> str:
    """A statement that starts with the named views. ``body`` continues the list or is the final SELECT."""
    names: list[str] = []
    for name in deps.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in names:
                names.append(need)
    body = body.strip()
    if not names:
        return body if body.upper().startswith("SELECT") else "WITH " + body
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(SQL[n] for n in names) + joiner + body


class Tables:
    """The given tables and the views derived from them; everything stays lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        day = F.date_add(F.lit("2025-08-01").cast("date"), ((F.col("doc_id") * 37) % 300).cast("int"))
        return self.documents.select(
            "doc_id",
            "text",
            "source",
            "lang",
            "n_chars",
            F.concat(F.lit("Doc "), "doc_id").alias("title"),
            F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"),
            F.when(F.col("doc_id") % 11 != 0, day).alias("doc_date"),
            F.array("lang", F.concat(F.lit("band"), F.floor(F.col("n_chars") / 2000).cast("long"))).alias("topics"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def _with_vector(self, rows: DataFrame, key: str) -> DataFrame:
        n = self.embeddings.agg(F.count("*").alias("n")).scalar()
        keyed = rows.withColumn("vec_id", F.col(key) % n)
        return keyed.join(self.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")

    @cached_property
    def doc_vectors(self) -> DataFrame:
        return self._with_vector(self.documents.select("doc_id"), "doc_id")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self._with_vector(self.queries, "query_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")

    @cached_property
    def taxonomy(self) -> DataFrame:
        words = self.benchmark.select(F.explode(tokens(F.col("text"))).alias("keyword")).filter(F.length("keyword") >= 2)
        return words.distinct().select(
            "keyword",
            F.concat(F.lit("t"), F.length("keyword") % 5).alias("topic"),
            (1 + F.length("keyword") % 3).cast("double").alias("weight"),
        )

    @cached_property
    def entity_lists(self) -> DataFrame:
        """Per document the distinct names: even length counts as organization, odd as location."""
        names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
        named = self.documents.select("doc_id", names.alias("names"))
        return named.select(
            "doc_id",
            F.filter("names", lambda n: F.length(n) % 2 == 0).alias("organizations"),
            F.filter("names", lambda n: F.length(n) % 2 == 1).alias("locations"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        lists = self.entity_lists
        return lists.select("doc_id", F.explode("organizations").alias("name")).withColumn(
            "entity_type", F.lit("organization")
        ).unionByName(
            lists.select("doc_id", F.explode("locations").alias("name")).withColumn("entity_type", F.lit("location"))
        )

    @cached_property
    def memories(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        created = F.timestamp_add("HOUR", (conv * 10 + turn).cast("int"), F.lit("2026-01-01").cast("timestamp"))
        key = F.concat(F.lit("key/"), conv % 20)
        rows = self.conversations.select(
            (conv * 100 + turn).alias("doc_id"),
            "conv_id",
            "turn",
            F.col("text").alias("content"),
            F.concat(F.lit("ws"), conv % 3).alias("workspace"),
            F.col("role").alias("actor"),
            key.alias("memory_key"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("decision", "claim", "task", "thought_summary")]), (conv % 4 + 1).cast("int")
            ).alias("kind"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("accepted", "candidate", "accepted", "deprecated")]),
                ((conv + turn) % 4 + 1).cast("int"),
            ).alias("state"),
            created.alias("created_at"),
            F.when(conv % 5 == 0, F.timestamp_add("DAY", F.lit(30), created)).alias("expires_at"),
            F.when(turn == 1, F.concat(F.lit("key/"), (conv + 1) % 20))
            .when(turn == 2, F.concat(F.lit("ext/"), conv))
            .alias("target_key"),
            F.when(turn == 0, conv).alias("source_document_id"),
        )
        return bucketed_row_number(
            rows, ["workspace", "memory_key"], F.to_date("created_at"), [F.col("created_at"), F.col("doc_id")], "version"
        )


class Registry:
    """Queries and their SQL twins, collected per area."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                from mnemolake.session import apply_settings

                return plain(fn(Tables(apply_settings(spark), sf_dir)))

            self.queries[name] = run
            if oracle is not None:
                self.oracle[name] = oracle
            return fn

        return register


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, floats as double, dates and times as text, string arrays joined with ``|``."""
    out = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if t in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif t == "float" or t.startswith("decimal"):
            c = c.cast("double")
        elif t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif t.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif t.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif t.startswith(("map", "struct")):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return df.select(*out)
