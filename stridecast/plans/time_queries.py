"""Queries over time: loads, ratios, recency, spines, point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridecast.operators import pit, scan, workload
from stridecast.operators.workload import SCALES
from stridecast.plans import adapters as a
from stridecast.plans.features import panel_matrix
from stridecast.plans.registry import query

DENSE = "d AS (SELECT l_suppkey AS player_id, CAST(l_shipdate AS DATE) AS game_date, CAST(sum(l_quantity) AS DOUBLE) AS load FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY ALL)"
USERS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(coalesce(value, 0)) AS DOUBLE) AS load FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"
PRIMARY = "p AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice >= 0.98 * (SELECT max(o_totalprice) FROM orders))"
SEASON = "(year({0}) + CASE WHEN month({0}) >= 10 THEN 1 ELSE 0 END)"


def _mean(days: int, load: str = "b.load", now: str = "a.n", then: str = "b.n") -> str:
    return f"sum({load} * pow(1 - 1/{days}.0, {now} - {then})) / {days}.0 / (1 - pow(1 - 1/{days}.0, {now} + 1))"


_MEANS = ", ".join(f"{_mean(d)} AS e{d}" for pair in SCALES.values() for d in pair)
_RATIOS = ", ".join(f"CASE WHEN e{c} >= 0.001 THEN e{f} / e{c} END AS r_{s}" for s, (f, c) in SCALES.items())


@query(f"""WITH {DENSE}, n AS (SELECT *, game_date - min(game_date) OVER (PARTITION BY player_id) AS n FROM d),
e AS (SELECT a.player_id, a.n, {_MEANS} FROM n a JOIN n b ON a.player_id = b.player_id AND b.n <= a.n GROUP BY a.player_id, a.n),
r AS (SELECT player_id, {_RATIOS} FROM e)
SELECT player_id, count(*) AS n_days, {", ".join(f"count(*) FILTER (WHERE r_{s} > 1.5) AS spikes_{s}" for s in SCALES)},
count(*) FILTER (WHERE {" OR ".join(f"coalesce(r_{s} > 1.5, FALSE)" for s in SCALES)}) AS spikes_any, round(avg(r_7_28), 4) AS mean_7_28 FROM r GROUP BY player_id""")
def acwr_spikes(spark, sf_dir):
    flagged = workload.add_spikes(workload.load_ratios(a.dense_loads(spark, sf_dir), ["player_id"], "game_date", "load"))
    counts = [F.sum(F.col(f"spike_{s}").cast("int")).alias(f"spikes_{s}") for s in [*SCALES, "any"]]
    return flagged.groupBy("player_id").agg(F.count("*").alias("n_days"), *counts, F.round(F.avg("acwr_7_28"), 4).alias("mean_7_28"))


@query(f"""WITH {USERS}, s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY user_id)
SELECT s.user_id, s.day, round(coalesce(d.load, 0), 4) AS load, d.load IS NULL AS is_gap FROM s LEFT JOIN d ON s.user_id = d.user_id AND s.day = d.day""", dates=("day",))
def gap_fill(spark, sf_dir):
    filled = workload.fill_gaps(a.user_days(spark, sf_dir), "user_id", "day", "load")
    return filled.select("user_id", "day", F.round("load", 4).alias("load"), F.col("_gap_fill").alias("is_gap"))


@query(f"""WITH {USERS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS n FROM d)
SELECT a.user_id, a.day, round({_mean(7)}, 3) AS acute, round({_mean(28)}, 3) AS chronic FROM n a JOIN n b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY a.user_id, a.day, a.n""", dates=("day",))
def ewma_rows(spark, sf_dir):
    rows = workload.load_ratios(a.user_days(spark, sf_dir), ["user_id"], "day", "load", {"7_28": (7, 28)}, calendar=False)
    return rows.select("user_id", "day", F.round("ewma_acute_7_28", 3).alias("acute"), F.round("ewma_chronic_7_28", 3).alias("chronic"))


@query(f"""WITH {DENSE} SELECT player_id, game_date, {", ".join(f"sum(load) OVER (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS load_sum_{n}, round(avg(load) OVER (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS load_mean_{n}" for n in (7, 14, 30, 60))} FROM d""", dates=("game_date",))
def rolling_load(spark, sf_dir):
    rows = workload.rolling(a.dense_loads(spark, sf_dir), ["player_id"], "game_date", "load")
    return rows.select("player_id", "game_date", *(c for n in (7, 14, 30, 60) for c in (f"load_sum_{n}", F.round(f"load_mean_{n}", 4).alias(f"load_mean_{n}"))))


@query(f"""WITH {DENSE} SELECT player_id, game_date, sum(load) OVER (PARTITION BY player_id ORDER BY game_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS load_sum_7 FROM d""", dates=("game_date",))
def rolling_days(spark, sf_dir):
    return workload.rolling(a.dense_loads(spark, sf_dir), ["player_id"], "game_date", "load", (7,), by_day=True).select("player_id", "game_date", "load_sum_7")


@query(f"""WITH {USERS}, o AS (SELECT u.user_id, CAST(t.day AS DATE) AS observed FROM (SELECT DISTINCT user_id FROM d) u, (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 7 DAY)) AS day) t)
SELECT o.user_id, observed, CAST(observed - max(day) FILTER (WHERE day <= observed) AS INTEGER) AS days_since_last,
count(*) FILTER (WHERE day <= observed AND day >= observed - 7) AS events_last_7, count(*) FILTER (WHERE day <= observed AND day >= observed - 14) AS events_last_14
FROM o LEFT JOIN d ON o.user_id = d.user_id GROUP BY o.user_id, observed""", dates=("observed",))
def recency(spark, sf_dir):
    days = a.user_days(spark, sf_dir)
    span = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 7 days"))).alias("observed"))
    observed = days.select("user_id").distinct().crossJoin(F.broadcast(span))  # dates of a fixed range: a few rows
    return workload.recency(observed, days, ["user_id"], "observed", "day")


@query(f"""WITH {PRIMARY}, f AS (SELECT o_custkey, min(day) AS d FROM p WHERE day <= DATE '{a.STUDY_END}' GROUP BY o_custkey),
s AS (SELECT c_custkey AS entity, f.d IS NOT NULL AS ev, coalesce(f.d, DATE '{a.STUDY_END}') AS e FROM customer LEFT JOIN f ON c_custkey = o_custkey),
r AS (SELECT entity, ev, e, CAST(unnest(generate_series(DATE '1995-10-01', e, INTERVAL 30 DAY)) AS DATE) AS observation_date FROM s)
SELECT entity, observation_date, CAST(ev AS INTEGER) AS event, CAST(e - observation_date AS INTEGER) AS time_remaining_days FROM r""", dates=("observation_date",))
def spine(spark, sf_dir):
    events = a.primary_events(spark, sf_dir).withColumnRenamed("o_custkey", "entity")
    return pit.observation_spine(a.profiles(spark, sf_dir), events, "entity", "debut", "day", a.STUDY_END)


@query(f"""WITH {PRIMARY}, f AS (SELECT o_custkey, min(day) AS d FROM p WHERE day <= DATE '{a.STUDY_END}' GROUP BY o_custkey),
s AS (SELECT c_custkey AS entity, make_date(coalesce(CASE WHEN c_custkey % 3 > 0 THEN 1995 + c_custkey % 4 END, CASE WHEN c_custkey % 2 > 0 THEN 1996 END, 1997), 10, 1) AS b, f.d IS NOT NULL AS ev, coalesce(f.d, DATE '{a.STUDY_END}') AS e FROM customer LEFT JOIN f ON c_custkey = o_custkey),
r AS (SELECT entity, ev, e, CAST(unnest(generate_series(b, e, INTERVAL 90 DAY)) AS DATE) AS observation_date FROM s)
SELECT entity, observation_date, CAST(ev AS INTEGER) AS event, CAST(e - observation_date AS INTEGER) AS time_remaining_days FROM r""", dates=("observation_date",))
def spine_debuts(spark, sf_dir):
    """Debuts follow from the draft, else the first year known, else a default."""
    events = a.primary_events(spark, sf_dir).withColumnRenamed("o_custkey", "entity")
    k = F.col("entity").cast("int")
    people = a.profiles(spark, sf_dir).withColumn("debut", pit.debut_date(F.when(k % 3 > 0, 1995 + k % 4), F.when(k % 2 > 0, F.lit(1996)), 1997))
    return pit.observation_spine(people, events, "entity", "debut", "day", a.STUDY_END, 90)


@query(f"""WITH s AS (SELECT c_custkey AS entity, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-01-01', INTERVAL 90 DAY)) AS DATE) AS observed FROM customer),
f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL)
SELECT s.entity, s.observed, f.day AS last_day, f.o_orderkey AS last_order, f.o_totalprice AS last_price FROM s ASOF LEFT JOIN f ON s.entity = f.o_custkey AND s.observed >= f.day""", dates=("observed", "last_day"))
def asof_features(spark, sf_dir):
    observed = a.profiles(spark, sf_dir).select("entity", F.explode(F.expr("sequence(date'1996-01-01', date'2001-01-01', interval 90 days)")).alias("observed"))
    orders = a.orders_dated(spark, sf_dir).select(F.col("o_custkey").alias("entity"), "day", F.col("day").alias("last_day"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))
    return pit.asof_join(observed, orders, "entity", "observed", "day", tie=F.col("last_order"))


#: A third of all users as one entity.
_HOT = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END"


def _one_hot(events):
    return events.withColumn("entity", F.expr(_HOT))


@query(f"""WITH e AS (SELECT *, {_HOT} AS entity, CAST(ts AS DATE) AS day FROM events), f AS (SELECT entity, day, max(event_id) AS last_event FROM e WHERE event_type = 'purchase' AND entity IS NOT NULL GROUP BY ALL)
SELECT e.event_id, f.last_event FROM e ASOF LEFT JOIN f ON e.entity = f.entity AND e.day >= f.day""")
def asof_hot(spark, sf_dir):
    """Each event with the last purchase of its entity up to its day; an entity has a third of all rows."""
    rows = _one_hot(a.table(spark, sf_dir, "events")).withColumn("day", F.col("ts").cast("date"))
    bought = rows.filter("event_type = 'purchase'").select("entity", F.col("day").alias("bought"), F.col("event_id").alias("last_event"))
    return pit.asof_join(rows.select("event_id", "entity", "day"), bought, "entity", "day", "bought", by_dates=True).select("event_id", "last_event")


@query(f"""WITH e AS (SELECT event_id, {_HOT} AS entity, coalesce(value, 0) AS value FROM events)
SELECT event_id, {", ".join(f"round(sum(value) OVER (PARTITION BY entity ORDER BY event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS load_sum_{n}" for n in (7, 60))},
round(sum(value) OVER (PARTITION BY entity ORDER BY event_id RANGE BETWEEN 999 PRECEDING AND CURRENT ROW), 4) AS near FROM e""")
def rolling_hot(spark, sf_dir):
    """Rolling sums over the last rows, and over the last thousand event numbers, of entities of which one has a third of all rows."""
    rows = _one_hot(a.table(spark, sf_dir, "events")).select("event_id", "entity", F.coalesce("value", F.lit(0.0)).alias("value"))
    last = workload.rolling(rows, ["entity"], "event_id", "value", (7, 60), most=1000)
    near = workload.rolling(last, ["entity"], "event_id", "value", (1000,), by_day=True, most=1000)
    return near.select("event_id", *(F.round(f"load_sum_{n}", 4).alias(f"load_sum_{n}") for n in (7, 60)), F.round("load_sum_1000", 4).alias("near"))


@query(f"""WITH e AS (SELECT event_id, {_HOT} AS entity, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS last_value FROM e""")
def carry_hot(spark, sf_dir):
    """The last purchase's value carried forward; an entity has a third of all rows."""
    rows = _one_hot(a.table(spark, sf_dir, "events"))
    found = scan.carry_forward(rows, ["entity"], "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "last_value", most=1000)
    return found.select("event_id", F.round("last_value", 6).alias("last_value"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def static_join(spark, sf_dir):
    people = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return pit.static_join(a.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey").drop("o_custkey")


@query(f"""WITH {DENSE} SELECT player_id, game_date, load, sum(load) OVER (PARTITION BY player_id ORDER BY game_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent FROM d""", dates=("game_date",))
def composite_join(spark, sf_dir):
    base = a.dense_loads(spark, sf_dir).withColumn("recent", F.lit(-1.0))
    fresh = workload.rolling(a.dense_loads(spark, sf_dir), ["player_id"], "game_date", "load", (7,)).select("player_id", "game_date", F.col("load_sum_7").alias("recent"))
    return pit.replace_columns(base, fresh, ["player_id", "game_date"])


_OBS = "o AS (SELECT s_suppkey AS player_id, CAST(s_suppkey % 2 AS INTEGER) AS event, CAST(unnest([DATE '1995-01-20', DATE '1999-03-15', DATE '2000-12-20']) AS DATE) AS observed FROM supplier)"
_PANEL = "o AS (SELECT s_suppkey AS player_id, CAST(s_suppkey % 2 AS INTEGER) AS event, CAST(unnest(generate_series(DATE '1992-01-06', DATE '1999-01-06', INTERVAL 28 DAY)) AS DATE) AS observed FROM supplier)"


def _snapshot_sql(observed: str) -> str:
    return f"""WITH {DENSE}, {observed},
h AS (SELECT o.player_id, o.observed, o.event, d.game_date AS day, d.load FROM o JOIN d ON o.player_id = d.player_id AND d.game_date <= observed
  AND {SEASON.format("d.game_date")} <= {SEASON.format("observed")} AND {SEASON.format("d.game_date")} > {SEASON.format("observed")} - CASE WHEN event = 1 THEN 3 ELSE 2 END),
n AS (SELECT *, day - min(day) OVER w AS n, max(day) OVER w - min(day) OVER w AS m FROM h WINDOW w AS (PARTITION BY player_id, observed)),
e AS (SELECT player_id, observed, max(day) AS last, count(*) FILTER (WHERE day >= observed - 7) AS w7, count(*) FILTER (WHERE day >= observed - 14) AS w14, {", ".join(_mean(d, "load", "any_value(m)", "n").replace("sum(load * pow(", "sum(load * pow(").replace("any_value(m) - n", "m - n").replace("any_value(m) + 1", "max(m) + 1") + f" AS e{d}" for pair in SCALES.values() for d in pair)} FROM n GROUP BY player_id, observed),
r AS (SELECT *, {_RATIOS} FROM e)
SELECT o.player_id, o.observed, o.event, {", ".join(f"round(r_{s}, 4) AS acwr_{s}" for s in SCALES)}, CAST({" OR ".join(f"coalesce(r_{s} > 1.5, FALSE)" for s in SCALES)} AS INTEGER) AS spike_flag,
CAST(o.observed - last AS INTEGER) AS days_since_last, CAST(coalesce(w7, 0) AS INTEGER) AS events_last_7, CAST(coalesce(w14, 0) AS INTEGER) AS events_last_14 FROM o LEFT JOIN r ON o.player_id = r.player_id AND o.observed = r.observed"""


@query(_snapshot_sql(_OBS), dates=("observed",))
def ratio_snapshot(spark, sf_dir):
    days = F.array(*(F.lit(d).cast("date") for d in ("1995-01-20", "1999-03-15", "2000-12-20")))
    observed = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.explode(days).alias("observed"), (F.col("s_suppkey") % 2).cast("int").alias("event"))
    found = pit.ratio_snapshot(observed, a.shipments(spark, sf_dir), "player_id", "observed", "game_date", "load", "event")
    return found.withColumns({f"acwr_{s}": F.round(f"acwr_{s}", 4) for s in SCALES})


@query(_snapshot_sql(_PANEL), dates=("observed",))
def ratio_panel(spark, sf_dir):
    """A dense panel: every entity every four weeks."""
    days = F.expr("sequence(date'1992-01-06', date'1999-01-06', interval 28 days)")
    observed = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.explode(days).alias("observed"), (F.col("s_suppkey") % 2).cast("int").alias("event"))
    found = pit.ratio_snapshot(observed, a.shipments(spark, sf_dir), "player_id", "observed", "game_date", "load", "event")
    return found.withColumns({f"acwr_{s}": F.round(f"acwr_{s}", 4) for s in SCALES})


@query(f"""WITH {PRIMARY}, f AS (SELECT o_custkey, min(day) AS d FROM p WHERE day <= DATE '{a.STUDY_END}' GROUP BY o_custkey),
s AS (SELECT c_custkey AS entity, c_mktsegment, c_acctbal, f.d IS NOT NULL AS ev, coalesce(f.d, DATE '{a.STUDY_END}') AS e FROM customer LEFT JOIN f ON c_custkey = o_custkey),
r AS (SELECT *, CAST(unnest(generate_series(DATE '1995-10-01', e, INTERVAL 120 DAY)) AS DATE) AS observation_date FROM s),
k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL)
SELECT entity, observation_date, CAST(ev AS INTEGER) AS event, CAST(e - observation_date AS INTEGER) AS time_remaining_days, c_mktsegment, c_acctbal, k.price AS order_price, k.day AS order_last_day
FROM r ASOF LEFT JOIN k ON r.entity = k.o_custkey AND r.observation_date >= k.day""", dates=("observation_date", "order_last_day"))
def feature_matrix(spark, sf_dir):
    events = a.primary_events(spark, sf_dir).withColumnRenamed("o_custkey", "entity")
    dated = a.orders_dated(spark, sf_dir).groupBy(F.col("o_custkey").alias("entity"), "day").agg(F.max_by("o_totalprice", "o_orderkey").alias("price")).withColumn("last_day", F.col("day"))
    return panel_matrix(a.profiles(spark, sf_dir), events, {"order": (dated, "day")}, "entity", "debut", "day", a.STUDY_END, ["c_mktsegment", "c_acctbal"], 120)
