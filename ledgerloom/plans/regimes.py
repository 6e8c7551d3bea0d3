"""State probabilities of keyed histories."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import macro, scans
from ..operators.sizes import attach_one_row
from ..sources import views
from ..sources.views import RATE_SERIES
from .registry import query

STATES = 5


def _levelled(spark, sf):
    """Rates with how likely each of five levels, a deviation apart, makes them, and the nearest level."""
    rates = views.rates(spark, sf)
    one = rates.agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"))
    z = (F.col("rate") - F.col("mean")) / F.col("sd")
    near = F.least(F.greatest(F.floor(z + 2.5), F.lit(0)), F.lit(STATES - 1)).cast("int")
    likely = F.array(*(F.exp(-F.pow(z - (j - 2.0), F.lit(2.0)) / 2) for j in range(STATES)))
    return attach_one_row(rates, one).select("event_id", "ticker", "date", near.alias("level"), likely.alias("likely"))


def _products(ahead: bool) -> str:
    """One step of the forward or backward recursion, in SQL lists."""
    if ahead:
        cells = [f"b[{j + 1}] * ({' + '.join(f'x[{i + 1}] * m[{i * STATES + j + 1}]' for i in range(STATES))})" for j in range(STATES)]
    else:
        cells = [" + ".join(f"m[{i * STATES + j + 1}] * nb[{j + 1}] * x[{j + 1}]" for j in range(STATES)) for i in range(STATES)]
    return "[" + ", ".join(cells) + "]"


_SCALED = "list_transform({x}, lambda v: v / list_sum({x}))"
_SMOOTHED = f"""WITH RECURSIVE one AS (SELECT avg(rate) AS mean, stddev_samp(rate) AS sd FROM v_rate),
  z AS (SELECT event_id, ticker, (rate - mean) / sd AS z, row_number() OVER (PARTITION BY ticker ORDER BY date, event_id) AS rn,
    count(*) OVER (PARTITION BY ticker) AS n FROM v_rate, one),
  e AS MATERIALIZED (SELECT *, CAST(least(greatest(floor(z + 2.5), 0), {STATES - 1}) AS INTEGER) AS level,
    [{', '.join(f'exp(-pow(z - ({j - 2.0}), 2) / 2)' for j in range(STATES))}] AS b FROM z),
  steps AS (SELECT level AS f, lead(level) OVER (PARTITION BY ticker ORDER BY rn) AS t FROM e),
  counts AS (SELECT f, t, count(*) AS c FROM steps WHERE t IS NOT NULL GROUP BY ALL),
  grid AS (SELECT i.range AS i, j.range AS j, 1 + coalesce(c, 0) AS c FROM range({STATES}) i CROSS JOIN range({STATES}) j LEFT JOIN counts ON f = i.range AND t = j.range),
  matrix AS MATERIALIZED (SELECT list(p ORDER BY i, j) AS m FROM (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM grid)),
  ahead(ticker, rn, x) AS (SELECT ticker, rn, {_SCALED.format(x='b')} FROM e WHERE rn = 1
    UNION ALL SELECT ticker, rn, {_SCALED.format(x='y')} FROM (SELECT e.ticker, e.rn, {_products(True)} AS y
      FROM ahead JOIN e ON e.ticker = ahead.ticker AND e.rn = ahead.rn + 1, matrix)),
  behind(ticker, rn, x) AS (SELECT ticker, rn, [{', '.join(['1.0::DOUBLE'] * STATES)}] FROM e WHERE rn = n
    UNION ALL SELECT ticker, rn, {_SCALED.format(x='y')} FROM (SELECT ticker, rn, {_products(False)} AS y
      FROM (SELECT e.ticker, e.rn - 1 AS rn, x, b AS nb FROM behind JOIN e ON e.ticker = behind.ticker AND e.rn = behind.rn WHERE e.rn > 1), matrix)),
  joint AS (SELECT ticker, rn, {_SCALED.format(x='y')} AS p FROM (SELECT a.ticker, a.rn,
      [{', '.join(f'a.x[{j + 1}] * c.x[{j + 1}]' for j in range(STATES))}] AS y FROM ahead a JOIN behind c ON c.ticker = a.ticker AND c.rn = a.rn))
  SELECT event_id, e.ticker, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS state, {', '.join(f'p[{j + 1}] AS state_prob_{j}' for j in range(STATES))}
  FROM e JOIN joint USING (ticker, rn)"""


@query("regime_smoothed", _SMOOTHED, "v_rate", " ".join(f"state_prob_{j}" for j in range(STATES)))
def regime_smoothed(spark, sf):
    """Chances of five rate levels given each ticker's whole history, with moves as often as they were seen."""
    rows = _levelled(spark, sf)
    moves = scans.moves_between(macro.transition_matrix(rows, RATE_SERIES, "level"), STATES)
    out = scans.state_probabilities(rows.drop("level"), RATE_SERIES, "likely", moves, np.full(STATES, 1 / STATES), "p")
    state = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return out.select("event_id", "ticker", state.alias("state"), *(F.col("p")[j].alias(f"state_prob_{j}") for j in range(STATES)))
