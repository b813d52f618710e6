"""Queries over a global order: running values, as-of joins, range frames and isotonic calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.eval.isotonic import IsotonicCalibration
from lacuna.eval.metrics import expected_calibration_error
from lacuna.operators import ordered
from lacuna.plans.inputs import labelled_documents, table
from lacuna.plans.matrix_queries import LABELLED
from lacuna.plans.registry import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", cents.alias("cents"))


_CENTS = "orders_ AS (SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents FROM orders)"


@query(f"""WITH {_CENTS} SELECT o_orderkey, row_number() OVER w - 1 AS place, (sum(cents) OVER w)::BIGINT AS revenue,
    max(cents) OVER w AS largest, lag(o_orderkey) OVER w AS earlier_order
  FROM orders_ WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue up to each order, over all orders in the order of their dates."""
    scanned = ordered.scan(
        _orders(spark, sf_dir), ["o_orderdate", "o_orderkey"],
        {
            "place": ordered.row_number(), "revenue": ordered.running_sum(F.col("cents")),
            "largest": ordered.running_max(F.col("cents")), "earlier_order": ordered.previous(F.col("o_orderkey")),
        },
    )
    return scanned.select("o_orderkey", (F.col("place") - 1).alias("place"), "revenue", "largest", "earlier_order")


@query(f"""WITH {_CENTS} SELECT o_orderkey, (sum(cents) OVER w)::BIGINT AS revenue, row_number() OVER w AS nth,
    lag(o_orderdate) OVER w AS earlier_date
  FROM orders_ WINDOW w AS (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_revenue_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values within three keys, each with a third of all rows."""
    scanned = ordered.scan(
        _orders(spark, sf_dir).withColumn("third", F.col("o_custkey") % 3), ["o_orderdate", "o_orderkey"],
        {
            "revenue": ordered.running_sum(F.col("cents")), "nth": ordered.row_number(),
            "earlier_date": ordered.previous(F.col("o_orderdate")),
        },
        by=["third"],
    )
    return scanned.select("o_orderkey", "revenue", "nth", "earlier_date")


@query(f"""WITH {_CENTS} SELECT o_orderkey, (sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
    RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS revenue_90_days FROM orders_""")
def revenue_of_90_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's revenue over the 90 days up to each order."""
    width = F.expr("INTERVAL 90 DAYS")
    found = ordered.range_sum(_orders(spark, sf_dir), "cents", "o_orderdate", width, "revenue_90_days", ["o_custkey"])
    return found.select("o_orderkey", "revenue_90_days")


# The month of the events, stretched over the years of the orders.
_STRETCH = 80


@query(f"""WITH e AS (SELECT event_id, user_id, ts, TIMESTAMP '1995-01-01' + to_microseconds({_STRETCH} * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))) AS moment FROM events),
    o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
  SELECT event_id, o_orderkey, o_orderdate FROM e ASOF LEFT JOIN o ON user_id = o_custkey AND moment >= o_orderdate""")
def events_as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's latest order up to then."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01', cast(ts AS TIMESTAMP_NTZ))")
    at = F.expr("TIMESTAMP_NTZ '1995-01-01'") + F.make_dt_interval(secs=(micros * _STRETCH / 1_000_000).cast("decimal(18,6)"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    found = ordered.as_of_join(events, orders, ["user_id"], "at", "o_orderdate", ["o_orderkey", "o_orderdate"], ties=["o_orderkey"])
    return found.select("event_id", "o_orderkey", "o_orderdate")


# The best rising means by their formula: of all averages from a to b, the largest over a of the smallest over b.
_ISOTONIC = f"""{LABELLED}, s AS (SELECT lang, score, count(*) AS n, sum(gold) AS y,
    row_number() OVER (PARTITION BY lang ORDER BY score) AS i FROM labelled GROUP BY lang, score),
  c AS (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM s WINDOW w AS (PARTITION BY lang ORDER BY i)),
  pairs AS (SELECT a.lang, a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.lang = b.lang AND a.i <= b.i),
  least_ AS (SELECT lang, a, b, min(m) OVER (PARTITION BY lang, a ORDER BY b DESC) AS m FROM pairs),
  iso AS (SELECT lang, b AS i, max(m) AS calibrated FROM least_ GROUP BY lang, b),
  fitted AS (SELECT s.*, calibrated FROM s JOIN iso USING (lang, i))"""


@query(f"""WITH {_ISOTONIC} SELECT lang, min(score) AS lo, max(score) AS hi, sum(n)::BIGINT AS n, sum(y)::BIGINT AS positives, calibrated
  FROM fitted GROUP BY lang, calibrated""")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the isotonic fit of quality by language."""
    docs = labelled_documents(spark, sf_dir)
    return IsotonicCalibration(["lang"], "score", "gold").fit(docs).table()


def _ece(probability: str) -> str:
    return f"""SELECT lang, round(sum(n * abs(a - p)) / sum(n), 6) AS ece FROM (SELECT lang, least(floor({probability} * 10), 9) AS bin, count(*) AS n,
      avg({probability}) AS p, avg(gold) AS a FROM after GROUP BY 1, 2) GROUP BY lang"""


@query(f"""WITH {_ISOTONIC}, after AS (SELECT lang, score, gold, calibrated FROM labelled JOIN fitted USING (lang, score))
  SELECT lang, b.ece AS before, a.ece AS after FROM ({_ece("score")}) b JOIN ({_ece("calibrated")}) a USING (lang)""")
def calibration_fit_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error by language before and after the fit."""
    docs = labelled_documents(spark, sf_dir).select("lang", "score", "gold")
    after = IsotonicCalibration(["lang"], "score", "gold").fit(docs).apply(docs)

    def error(column: str, name: str) -> DataFrame:
        found = expected_calibration_error(after, 10, column, "gold", ["lang"])
        return found.select("lang", F.round("ece", 6).alias(name))

    return error("score", "before").join(error("calibrated", "after"), "lang")
