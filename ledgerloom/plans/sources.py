"""Source, filter, contract and publishing queries."""

from pyspark.sql import functions as F

from ..operators import allocation, pareto
from ..operators.sequences import sliding_sequences
from ..session import shared_dir
from ..sources import contracts, publish, scan, views
from ..sources.views import RATE_SERIES
from .collateral import _objective, _fill_sql, _scored
from .registry import query


@query("scan_csv", "SELECT event_id, user_id AS ticker, ts AS date, value AS rate FROM events", "", "rate")
def scan_csv(spark, sf):
    """Land the ticks as CSV and read them back with a stated schema."""
    path = shared_dir(spark, "csv")
    ticks = views.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("ticker"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"),
        F.col("value").alias("rate"),
    )
    ticks.write.csv(path, header=True)
    read = scan.csv(spark, path, "event_id bigint, ticker bigint, date string, rate double")
    return read.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("scan_json_records", "SELECT event_id, user_id AS ticker, value AS rate FROM events", "", "rate")
def scan_json_records(spark, sf):
    """Land payloads of about a hundred records each and read their records."""
    path = shared_dir(spark, "json")
    records = views.table(spark, sf, "events").select(
        F.struct("event_id", F.col("user_id").alias("ticker"), F.col("value").alias("rate")).alias("r"),
        F.floor(F.col("event_id") / 100).alias("page"),
    )
    records.groupBy("page").agg(F.collect_list("r").alias("data")).select("data").write.json(path)
    return scan.json_records(spark, path, "event_id bigint, ticker bigint, rate double")


@query(
    "scan_sql_cutoff",
    "SELECT event_id, user_id AS ticker, value AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "",
    "rate",
)
def scan_sql_cutoff(spark, sf):
    views.table(spark, sf, "events").createOrReplaceTempView("ledgerloom_ticks")
    recent = scan.load(
        spark, {"source_type": "table", "table": "ledgerloom_ticks", "date": "ts", "cutoff": "2024-01-15 00:00:00"}
    )
    return recent.select("event_id", F.col("user_id").alias("ticker"), F.col("value").alias("rate"))


@query(
    "cache_freshness",
    """SELECT event_type, max(CAST(ts AS DATE)) AS last_date, CAST(DATE '2024-02-01' - max(CAST(ts AS DATE)) AS INTEGER) AS age_days,
       DATE '2024-02-01' - max(CAST(ts AS DATE)) <= 2 AS fresh FROM events GROUP BY 1""",
    "",
    "",
    "last_date",
)
def cache_freshness(spark, sf):
    return scan.freshness(views.table(spark, sf, "events"), "event_type", "ts", "2024-02-01")


@query(
    "coerce_numeric",
    """SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS rate_bps,
       try_cast(props ->> 'k' AS DOUBLE) AS reported_k FROM events""",
    "",
    "rate_bps reported_k",
)
def coerce_numeric(spark, sf):
    raw = views.table(spark, sf, "events").select(
        F.col("event_id").alias(" Event ID"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Rate BPS "),
        F.get_json_object("props", "$.k").alias("Reported K"),
    )
    return contracts.coerce_numeric(contracts.normalise_headers(raw), ["rate_bps", "reported_k"])


@query(
    "validate_contract",
    """SELECT c.name AS "check", c.n AS offending, c.fatal, c.n = 0 OR NOT c.fatal AS passed FROM (
       SELECT 'empty' AS name, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n, true AS fatal FROM events
       UNION ALL SELECT 'missing_columns', 1, true UNION ALL SELECT 'mistyped_columns', 0, true
       UNION ALL SELECT 'null_event_id', count(*) FILTER (WHERE event_id IS NULL), true FROM events
       UNION ALL SELECT 'null_value', count(*) FILTER (WHERE value IS NULL), false FROM events) c""",
)
def validate_contract(spark, sf):
    contract = contracts.Contract(
        required=("event_id", "ts", "value", "benchmark_rate"), numeric=("value",), dates=("ts",),
        keys=("event_id",), warn_null=("value",),
    )
    return contract.findings(views.table(spark, sf, "events"))


@query(
    "lookback_max",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
)
def lookback_max(spark, sf):
    return scan.lookback_from_latest(views.table(spark, sf, "events"), "ts", 10).select("event_id")


@query("lookback_asof", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-25' - INTERVAL 10 DAYS")
def lookback_asof(spark, sf):
    return scan.lookback_as_of(views.table(spark, sf, "events"), "ts", 10, "2024-01-25").select("event_id")


@query(
    "publish_contract",
    """SELECT ticker, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, rate, CASE WHEN rate > 100 THEN 'true' ELSE 'false' END AS alert_flag
       FROM v_rate""",
    "v_rate",
    "rate",
)
def publish_contract(spark, sf):
    flagged = views.rates(spark, sf).withColumn("alert_flag", F.col("rate") > 100)
    return publish.to_contract(flagged, ["ticker", "date", "rate", "alert_flag"])


@query(
    "publish_batches",
    "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS batch FROM events",
)
def publish_batches(spark, sf):
    return publish.batched(views.table(spark, sf, "events"), "event_id", 500).select("event_id", "batch")


_CONFIG = {"max_concentration_pct": 0.30, "cost_weight": 0.6, "quality_weight": 0.4}


@query(
    "audit_summary",
    f"""SELECT 'run-1' AS run_id, '{publish.config_digest(_CONFIG)}' AS config_md5, count(*) AS n_items,
        count(*) FILTER (WHERE allocation_weight > 1e-4) AS n_recommended, sum(cost_of_carry * allocation_weight) AS total_cost,
        CASE WHEN count(*) FILTER (WHERE allocation_weight > 1e-4) = 0 THEN 'infeasible' ELSE 'optimal' END AS status
        FROM ({_fill_sql(0.30)})""",
    "v_pool",
    "total_cost:9",
)
def audit_summary(spark, sf):
    """Append a run's audit row to its log and read the log."""
    chosen = allocation.allocate(_scored(spark, sf), _objective(), cap=0.30)
    costed = chosen.withColumn("optimization_cost", F.col("cost_of_carry") * F.col("allocation_weight"))
    path = shared_dir(spark, "audit")
    row = publish.audit_row(costed, "run-1", _CONFIG)
    publish.append_json(row, path)
    return publish.read_log(
        spark, path,
        "run_id string, config_md5 string, n_items bigint, n_recommended bigint, total_cost double, status string",
    )


@query(
    "run_stats",
    """SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(rate) AS min_rate, max(rate) AS max_rate,
       avg(rate) AS mean_rate FROM v_rate""",
    "v_rate",
    "min_rate max_rate mean_rate",
)
def run_stats(spark, sf):
    return views.rates(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"), F.avg("rate").alias("mean_rate"),
    )


_F20 = "(PARTITION BY ticker ORDER BY date, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "sequence_windows",
    f"""SELECT event_id, CASE WHEN count(*) OVER {_F20} = 20 THEN 20 END AS length,
        CASE WHEN count(*) OVER {_F20} = 20 THEN sum(rate) OVER {_F20} END AS total,
        CASE WHEN count(*) OVER {_F20} = 20 THEN first_value(rate) OVER {_F20} END AS oldest FROM v_rate""",
    "v_rate",
    "total oldest",
)
def sequence_windows(spark, sf):
    seq = sliding_sequences(views.rates(spark, sf), RATE_SERIES, "rate", 20)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    length = F.when(F.col("sequence").isNotNull(), F.size("sequence"))
    return seq.select("event_id", length.alias("length"), total.alias("total"), F.element_at("sequence", 1).alias("oldest"))


_CAND = """SELECT o_custkey AS id, sum(o_totalprice) AS f1, -avg(o_totalprice) AS f2, CAST(count(*) AS DOUBLE) AS f3
  FROM orders GROUP BY 1"""


@query(
    "pareto_front",
    f"""WITH c AS ({_CAND}) SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2
        AND q.f3 <= p.f3 AND (q.f1 < p.f1 OR q.f2 < p.f2 OR q.f3 < p.f3))""",
    "",
    "f1:3 f2:3 f3",
)
def pareto_front(spark, sf):
    candidates = (
        views.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(
            F.sum("o_totalprice").alias("f1"),
            (-F.avg("o_totalprice")).alias("f2"),
            F.count(F.lit(1)).cast("double").alias("f3"),
        )
    )
    return pareto.pareto_front(candidates)
