"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemolake.session import find_package, scratch_path

#: ASCII white space; words are the runs between it
SPACE = r"[\x20\x09-\x0D]+"


#: while a table is written: remove the shuffle files of the query when it ends, and send texts to Python workers in small batches
_WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, fixes values such as row numbers for good, and survives the loss of any executor. What was
    shuffled for the table is removed at once instead of staying until the driver collects its garbage, and a worker holds
    8 MB of texts at a time instead of up to 10,000 texts of any length.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {key: spark.conf.get(key) for key in _WHILE_STORED}
    for key, value in _WHILE_STORED.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


class Memo(dict):
    """A bounded cache: ``make(key)`` on a miss; everything is forgotten when the limit is reached.

    The limit is a number of keys or, with ``cost(key, value)``, a sum of costs, of which one entry may take a
    thousandth; dearer ones are not kept. Only speed depends on the limit, never a result.
    """

    def __init__(self, make, limit: int, cost=None):
        super().__init__()
        self.make, self.limit, self.cost, self.held = make, limit, cost, 0

    def __missing__(self, key):
        value = self.make(key)
        spent = self.cost(key, value) if self.cost else 1
        if self.cost and spent * 1000 > self.limit:
            return value
        if self.held + spent > self.limit:
            self.clear()
            self.held = 0
        self.held += spent
        self[key] = value
        return value


def byte_tokens(tokenizer, word_end: str = "", mark: bytes = b"") -> dict[bytes, int]:
    """The bytes of every token of a byte-level vocabulary with its id; a word end is spelled as ``mark``.

    Byte-level vocabularies write printable bytes as themselves and number the others from U+0100.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    tokens = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if token in special:
            tokens[token.encode()] = i
        elif word_end and token.endswith(word_end):
            tokens[bytes(map(spelled.__getitem__, token.removesuffix(word_end))) + mark] = i
        else:
            tokens[bytes(map(spelled.__getitem__, token))] = i
    return tokens


class Registry:
    """Queries of one module with the SQL that DuckDB can check them by (None where SQL cannot)."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return keep


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
