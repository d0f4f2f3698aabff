"""Quality measures over search results, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import quality as q
from mnemolake.operators.retrieval import bm25_search
from mnemolake.plans.retrieval import bm25_sql, topk
from mnemolake.plans.views import Registry, sql

registry = Registry()
add = registry.add

RANKED = f"""{bm25_sql()}, h AS ({topk('bm', 5)}),
    rq AS (SELECT query_id, round(coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1.0::DOUBLE / rank END), 0) / sum(1.0::DOUBLE / rank), 3) AS quality
        FROM h LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY query_id)"""


def per_query(t):
    return q.rank_quality(bm25_search(t.queries, t.documents, 5), t.labels.filter("quality = 1"))


@add("rank_quality", sql("queries_v", f"{RANKED} SELECT query_id, quality FROM rq"))
def _(t):
    return per_query(t)


@add(
    "rank_quality_summary",
    sql("queries_v", f"{RANKED} SELECT round(avg(quality), 6) AS mean, round(median(quality), 6) AS median, min(quality) AS min, count(*) AS queries FROM rq"),
)
def _(t):
    return q.quality_summary(per_query(t))


@add(
    "latency_stats",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
    min(value) AS min, max(value) AS max, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95,
    percentile_disc(0.95) WITHIN GROUP (ORDER BY value) <= 30 AS within_budget FROM events GROUP BY event_type""",
)
def _(t):
    return q.latency_stats(t.events.select("event_type", "value"), ["event_type"], 30)


@add(
    "eval_summary",
    """SELECT count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed,
    round(count(*) FILTER (quality = 1) / count(*), 4) AS score FROM labels""",
)
def _(t):
    return q.eval_summary(t.labels.select((F.col("quality") == 1).alias("passed")))


@add(
    "compare_runs",
    """WITH b AS (SELECT event_type AS metric, round(sum(value), 4) AS before FROM events WHERE hour(ts) < 12 AND event_type <> 'click' GROUP BY 1),
    a AS (SELECT event_type AS metric, round(sum(value), 4) AS after FROM events WHERE hour(ts) >= 12 AND event_type <> 'view' GROUP BY 1)
    SELECT metric, coalesce(before, -1) AS before, coalesce(after, -1) AS after, coalesce(round((after - before) / before * 100, 4), -1) AS delta_pct
    FROM b FULL JOIN a USING (metric)""",
)
def _(t):
    half = lambda cond: t.events.filter(cond).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.sum("value"), 4).alias("value"))
    out = q.compare_runs(half("hour(ts) < 12 and event_type <> 'click'"), half("hour(ts) >= 12 and event_type <> 'view'"))
    return out.fillna(-1.0)
