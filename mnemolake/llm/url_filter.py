"""URL allow and block lists as a sorted array of 64-bit digests.

The rules are written once as three flat files: sorted xxhash64 keys, offsets and the full strings. Executors map
them into memory, hash every (host suffix, path prefix) that a rule could have, find the keys by vectorised binary
search, and compare the full strings, so a digest collision never decides.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.shared import Registry, table

registry = Registry()

VERDICT = "rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def write_rules(spark: SparkSession, rules: DataFrame) -> str:
    """Build the files from (host, path, verdict) rows and hand them to every executor; returns their common name.

    Spark removes repeated rules (a block rule wins over an equal allow rule) and sorts by digest; the driver streams
    one partition after another into the files and never holds the whole list. A file is as long as the rule list
    itself, so an executor needs disk for one copy of the list and memory only for the pages it touches.
    """
    make = F.udf(lambda s: int.from_bytes(xxhash.xxh64_digest(s.encode()), "big", signed=False).to_bytes(8, "big"), "binary")
    text = F.concat(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit("")))
    one = rules.groupBy(text.alias("rule")).agg(F.max("verdict").alias("verdict"))
    ordered = one.withColumn("key", make("rule")).orderBy("key", "rule")
    name = f"url-rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="url-rules-")
    lengths, at = set(), 0
    files = {part: open(os.path.join(folder, f"{name}.{part}"), "wb") for part in ("keys", "starts", "text", "verdicts")}
    for row in ordered.toLocalIterator():
        raw = row.rule.encode()
        files["keys"].write(row.key[::-1])  # big-endian bytes sort like numbers; the array is little-endian
        files["starts"].write(np.uint64(at).tobytes())
        files["text"].write(raw)
        files["verdicts"].write(b"b" if row.verdict == "block" else b"a")
        lengths.add(len(row.rule) - row.rule.find("/") if "/" in row.rule else 0)
        at += len(raw)
    files["starts"].write(np.uint64(at).tobytes())
    files["lengths"] = open(os.path.join(folder, f"{name}.lengths"), "wb")
    files["lengths"].write(np.array(sorted(lengths), np.int64).tobytes())
    for part, f in files.items():
        f.close()
        spark.sparkContext.addFile(f.name)
    return name


class RuleFiles:
    """The mapped arrays of one rule list on one executor."""

    def __init__(self, folder: str, name: str):
        def mapped(part, kind):
            path = os.path.join(folder, f"{name}.{part}")
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        self.keys, self.starts, self.text = mapped("keys", "<u8"), mapped("starts", "<u8"), mapped("text", "u1")
        self.verdicts, self.lengths = mapped("verdicts", "S1"), mapped("lengths", "<i8").tolist()

    def probes(self, host: str, path: str) -> list[str]:
        """Every rule text that could fit: host and parent domains, with path prefixes of the lengths rules have."""
        ends = [host]
        while "." in ends[-1]:
            ends.append(ends[-1].split(".", 1)[1])
        heads = [path[:n] for n in self.lengths if n <= len(path)]
        return [e + h for e in ends if e for h in heads]

    def look_up(self, texts: list[str]) -> list[str | None]:
        """For every text its verdict if it is a rule, else None. One binary search for all, then exact comparison."""
        raw = [t.encode() for t in texts]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        found: list[str | None] = [None] * len(raw)
        place = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(place < len(self.keys)).tolist():
            at = int(place[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:  # equal keys of different texts lie side by side
                if self.text[int(self.starts[at]) : int(self.starts[at + 1])].tobytes() == raw[i]:
                    found[i] = "block" if self.verdicts[at] == b"b" else "allow"
                    break
                at += 1
        return found


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) to rows with a URL.

    A rule (host, path) fits its host and all subdomains when the path starts with the rule's. The longest rule text
    wins; of equally long ones the one with the longer host. Without a fitting rule ``rule`` is null and the verdict
    is ``default``: a filter list blocks only what it names. Null URLs and those without ``://`` have an empty host
    and path and fit no rule. Repeated rows are judged alike; an empty table gives no rows; columns named like the
    new ones are replaced.
    """
    name = write_rules(urls.sparkSession, rules)

    @F.pandas_udf(VERDICT)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        files = RuleFiles(SparkFiles.getRootDirectory(), name)
        for hosts, paths in batches:
            probes = [files.probes(h, p) for h, p in zip(hosts, paths)]
            asked = list({t for some in probes for t in some})
            verdicts = dict(zip(asked, files.look_up(asked)))
            best = []
            for some in probes:
                fits = [t for t in some if verdicts[t]]
                # max keeps the first of equals, and longer hosts come first
                best.append(max(fits, key=len) if fits else None)
            yield pd.DataFrame({"rule": best, "verdict": [verdicts[r] if r is not None else default for r in best]})

    split = urls.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    return split.withColumn("_judged", decide("host", "path")).withColumns(
        {"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}
    ).drop("_judged")


#: the stated rules: host, path, verdict
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@registry.add(
    "op7_url_filter",
    r"""WITH rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id
            ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND n = 1""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
