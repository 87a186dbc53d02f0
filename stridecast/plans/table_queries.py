"""Queries over tables: scalars, filters, entities, cohorts, summaries, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridecast.functions import scalars as sc
from stridecast.operators import cohort, entities, prep, profile
from stridecast.operators import filters as filters_
from stridecast.plans import adapters as a
from stridecast.plans.features import case_control_matrix, refresh_loads
from stridecast.plans.registry import query
from stridecast.plans.time_queries import DENSE, PRIMARY, SEASON, USERS
from stridecast.sources import tables as src


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0')
WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 2 THEN 'Did Not Dress' ELSE '' END AS played FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN contains(played, ':') THEN CAST(split_part(played, ':', 1) AS DOUBLE) + CAST(split_part(played, ':', 2) AS DOUBLE) / 60 ELSE coalesce(TRY_CAST(played AS DOUBLE), 0) END, 4) AS minutes FROM t""")
def scalar_minutes(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    played = F.when(k == 0, F.concat(q, F.lit(":"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))).when(k == 1, q).when(k == 2, "Did Not Dress").otherwise("")
    return a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.minutes(played), 4).alias("minutes"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'tall' ELSE CAST(5 + p_size % 3 AS VARCHAR) || '-' || CAST(p_size % 12 AS VARCHAR) END AS h, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(150 + p_size AS VARCHAR) || ' lbs' END AS w,
CASE p_size % 4 WHEN 0 THEN 'Center' WHEN 1 THEN ' guard-forward' WHEN 2 THEN 'Forward' END AS p FROM part),
v AS (SELECT *, CASE WHEN h = 'tall' THEN 78.0 ELSE CAST(split_part(h, '-', 1) AS DOUBLE) * 12 + CAST(split_part(h, '-', 2) AS DOUBLE) END AS height, coalesce(TRY_CAST(replace(w, ' lbs', '') AS DOUBLE), 220.0) AS weight FROM t)
SELECT p_partkey, CAST(height AS DOUBLE) AS height, CAST(weight AS DOUBLE) AS weight, CASE WHEN p = 'Center' THEN 2 WHEN p = ' guard-forward' THEN 0 ELSE 1 END AS position, round(weight * 703 / (height * height), 4) AS bmi FROM v""")
def scalar_body(spark, sf_dir):
    n = F.col("p_size")
    text = lambda c: c.cast("string")
    h = F.when(n % 7 == 0, "tall").otherwise(F.concat(text(5 + n % 3), F.lit("-"), text(n % 12)))
    w = F.when(n % 5 == 0, "").otherwise(F.concat(text(150 + n), F.lit(" lbs")))
    p = F.when(n % 4 == 0, "Center").when(n % 4 == 1, " guard-forward").when(n % 4 == 2, "Forward")
    rows = a.table(spark, sf_dir, "part").select("p_partkey", sc.height_inches(h).alias("height"), sc.weight_lbs(w).alias("weight"), sc.position_code(p).alias("position"))
    return rows.withColumn("bmi", F.round(sc.bmi(F.col("weight"), F.col("height")), 4))


@query(f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1960-01-01' + CAST(o_custkey % 9000 AS INTEGER) AS b, CAST(o_custkey % 5 AS INTEGER) AS r FROM orders),
s AS (SELECT *, {SEASON.format("d")} AS y FROM t)
SELECT o_orderkey, CAST(y AS INTEGER) AS season, CAST(y - 1 AS VARCHAR) || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS label, CAST(greatest(d - make_date(y - 1, 10, 1), 0) AS INTEGER) AS into_season,
round((d - b) / 365.25, 2) AS age, CASE WHEN r > 0 THEN CAST(y - 1990 - r AS INTEGER) END AS in_league, CAST(least(floor(least(greatest(d - DATE '1996-01-01', 0), 1825) * 60 / 1825.0), 59) AS INTEGER) AS time_bin FROM s""")
def scalar_season(spark, sf_dir):
    d, r = F.col("day"), (F.col("o_custkey") % 5).cast("int")
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    y = sc.season_year(d)
    drafted = F.when(r > 0, 1990 + r)
    return a.orders_dated(spark, sf_dir).select("o_orderkey", y.alias("season"), sc.season_label(y).alias("label"), sc.days_into_season(d).alias("into_season"), sc.age_years(born, d, 2).alias("age"), sc.years_in_league(y, drafted).alias("in_league"), sc.time_bin(F.datediff(d, F.lit("1996-01-01").cast("date"))).alias("time_bin"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name ELSE 'Al ' || CAST(c_custkey AS VARCHAR) END AS name FROM customer""")
def clean_names(spark, sf_dir):
    k, n = F.col("c_custkey") % 3, F.col("c_name")
    messy = F.when(k == 0, F.concat(F.lit("• "), n, F.lit(" (b)"))).when(k == 1, F.concat(n, F.lit("  "))).otherwise(F.concat(F.lit("•"), n, F.lit(" (Sr.) / Al "), F.col("c_custkey").cast("string"), F.lit(" (c)")))
    return a.table(spark, sf_dir, "customer").select("c_custkey", sc.clean_name(messy).alias("name"))


_NOTES = ["Torn left Achilles", "complete rupture", "partial tear in calf", "Achilles soreness", "strained calf", "season-ending surgery", "rest", "tendinitis, day-to-day", "OUT INDEFINITELY (heel)", "flu"]


@query(f"""WITH t AS (SELECT p_partkey, lower((SELECT {_NOTES!r}[CAST(p_partkey % {len(_NOTES)} AS INTEGER) + 1]) || ' ' || p_name) AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, 'ruptur|torn|compl[ei]te') THEN 'rupture' WHEN regexp_matches(s, 'tear|partial') THEN 'tear' WHEN regexp_matches(s, 'strain|tendinit|tendinop|sore|inflam') THEN 'tendinopathy' ELSE 'unspecified' END AS by_pattern,
CASE WHEN {" OR ".join(f"contains(s, '{w}')" for w in sc.RUPTURE_WORDS)} THEN 'rupture' WHEN {" OR ".join(f"contains(s, '{w}')" for w in sc.TENDON_WORDS)} THEN 'tendinopathy' ELSE 'unspecified' END AS by_keyword,
{" OR ".join(f"contains(s, '{w}')" for w in sc.TOPIC_WORDS)} AS on_topic FROM t""")
def severity(spark, sf_dir):
    note = F.get(F.array(*(F.lit(x) for x in _NOTES)), (F.col("p_partkey") % len(_NOTES)).cast("int"))
    text = F.concat(note, F.lit(" "), F.col("p_name"))
    return a.table(spark, sf_dir, "part").select("p_partkey", sc.severity_by_pattern(text).alias("by_pattern"), sc.severity_by_keyword(text).alias("by_keyword"), sc.on_topic(text).alias("on_topic"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS found_day FROM orders", dates=("found_day",))
def text_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("placed on "), F.date_format("day", "MMMM d, yyyy"), F.lit(" by the team, until May 3, 2040"))).otherwise("placed in Octember 2, 1999")
    return a.orders_dated(spark, sf_dir).select("o_orderkey", sc.first_date(text).alias("found_day"))


@query("""SELECT l_suppkey AS player_id, CAST(l_shipdate AS DATE) AS game_date, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS minutes, round(sum(l_extendedprice), 2) AS pts FROM lineitem WHERE l_quantity > 0 AND l_linenumber <> 3 GROUP BY ALL""", dates=("game_date",))
def load_log(spark, sf_dir):
    raw = a.table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":00")).alias("mp"), F.lit("x").alias("fga"), F.lit("3").alias("fta"), F.col("l_extendedprice").cast("string").alias("pts"))
    rows = sc.load_log(raw, "l_suppkey", "d", "mp", "fga", "fta", "pts")
    return rows.groupBy("player_id", "game_date").agg(F.count("*").alias("n"), F.round(F.sum("minutes_played"), 4).alias("minutes"), F.round(F.sum("pts"), 2).alias("pts"))


@query(r"""SELECT page_id, regexp_extract(url, '/([^/]+?)(?:\.html)?/?$', 1) AS slug, md5(url) AS key FROM pages""")
def page_keys(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", sc.slug(F.col("url")).alias("slug"), src.page_key(F.col("url")).alias("key"))


@query(f"""SELECT 'primary' AS what, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'active', count(*) FROM customer WHERE nullif(c_nationkey, 0) IS NULL OR c_nationkey >= 10
UNION ALL SELECT 'known', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL UNION ALL SELECT 'decided', count(*) FROM (SELECT CASE WHEN label % 3 = 0 THEN -1 ELSE label END AS v FROM embeddings) WHERE v >= 0
UNION ALL SELECT 'past', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{a.STUDY_END}'""")
def filters(spark, sf_dir):
    count = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    t = lambda n: a.table(spark, sf_dir, n)
    people = t("customer").withColumn("last", F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")))
    return profile.union_aligned(
        count("primary", filters_.primary_events(t("orders"), "o_orderpriority", "1-URGENT")),
        count("active", filters_.active_since(people, "last", 10)),
        count("known", filters_.complete(t("documents").join(t("labels"), "doc_id", "left"), "quality", "text")),
        count("decided", filters_.decided(t("embeddings").withColumn("label", F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label"))), "label")),
        count("past", filters_.known_by(a.orders_dated(spark, sf_dir), "day", F.lit(a.STUDY_END).cast("date"))),
    )


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders)
SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, arg_min(price, o_orderkey) FILTER (WHERE price IS NOT NULL) AS first_price, arg_max(CASE WHEN price IS NULL THEN -1 ELSE price END, o_orderkey) AS last_price, arg_max(o_orderkey, o_orderkey) AS last_order FROM o GROUP BY o_custkey""")
def first_last_records(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    order = F.col("o_orderkey")
    first = entities.first_values(rows, "o_custkey", order).select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("price").alias("first_price"))
    last = entities.first_row(rows, "o_custkey", order, last=True).select("o_custkey", F.coalesce("price", F.lit(-1.0)).alias("last_price"), F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus, min(o_orderkey) AS kept FROM orders GROUP BY ALL""", dates=("day",))
def dedupe_first(spark, sf_dir):
    kept = entities.dedupe_first(a.orders_dated(spark, sf_dir), ["o_custkey", "day", "o_orderstatus"], [F.col("o_orderkey")])
    return kept.select("o_custkey", "day", "o_orderstatus", F.col("o_orderkey").alias("kept"))


@query("""SELECT c_custkey, lower(trim(c_name)) AS name FROM customer WHERE c_custkey % 3 = 0""")
def new_rows(spark, sf_dir):
    people = a.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("2000-01-01").cast("date").alias("day"))
    batch = people.union(people.filter("c_custkey % 2 = 0"))
    stored = people.filter("c_custkey % 3 != 0").withColumn("c_name", F.concat(F.lit(" "), F.upper("c_name")))
    return entities.new_rows(batch, stored, "c_name", "day").select("c_custkey", F.lower(F.trim("c_name")).alias("name"))


@query("""WITH d AS (SELECT s_suppkey, lower(s_name) AS f, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier),
n AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'old ' || s_name WHEN 2 THEN 'S. ' || regexp_extract(s_name, '[0-9]+$') ELSE 'nobody' END AS name FROM supplier),
u AS (SELECT DISTINCT name, lower(trim(name)) AS q FROM n),
x AS (SELECT u.name, u.q, (SELECT arg_min(s_suppkey, r) FROM d WHERE f = q) AS k1, (SELECT arg_min(s_suppkey, r) FROM d WHERE contains(f, q) OR contains(q, f)) AS k2,
(SELECT CASE WHEN count(*) = 1 THEN min(s_suppkey) END FROM d WHERE contains(f, regexp_extract(q, '[^ ]+$')) AND f[1] = q[1]) AS k3 FROM u)
SELECT name, coalesce(k1, k2, k3) AS s_suppkey, CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 2 WHEN k3 IS NOT NULL THEN 3 ELSE 0 END AS tier FROM x""")
def resolve_names(spark, sf_dir):
    known = a.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("full"), F.col("s_suppkey").alias("place"))
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lit("old "), "s_name")).when(k == 2, F.concat(F.lit("S. "), F.regexp_extract("s_name", "[0-9]+$", 0))).otherwise("nobody")
    return entities.resolve_names(a.table(spark, sf_dir, "supplier").select(name.alias("name")), known, "name", "s_suppkey", "full", "place")


_COHORT = f"""{PRIMARY}, c AS (SELECT o_custkey AS entity, min(day) AS day FROM p GROUP BY o_custkey), s AS (SELECT c.*, {SEASON.format("day")} AS season, c_mktsegment AS position FROM c JOIN customer ON entity = c_custkey),
r AS (SELECT DISTINCT o_custkey AS entity, {SEASON.format("CAST(o_orderdate AS DATE)")} AS season FROM orders), q AS (SELECT r.*, c_mktsegment AS position FROM r JOIN customer ON entity = c_custkey WHERE entity NOT IN (SELECT entity FROM c)),
o AS (SELECT entity, season, position, row_number() OVER (PARTITION BY season, position ORDER BY md5('42|' || entity), entity) - 1 AS place, count(*) OVER (PARTITION BY season, position) AS n FROM (SELECT DISTINCT entity, season, position FROM q)),
m AS (SELECT s.entity AS case_id, o.entity AS control, s.season, s.day, j + 1 AS draw FROM s CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) JOIN o USING (season, position) WHERE j < n AND place = (CAST('0x' || substr(md5('42|' || s.entity), 1, 8) AS BIGINT) + j) % n)"""


@query(f"WITH {_COHORT} SELECT case_id, control, CAST(draw AS INTEGER) AS draw FROM m WHERE draw <= 3")
def match_controls(spark, sf_dir):
    found = a.cases(spark, sf_dir)
    pool = entities.without(a.roster(spark, sf_dir), found.select("entity").distinct(), ["entity"]).withColumnRenamed("entity", "control")
    return cohort.match_controls(found.withColumnRenamed("entity", "case_id"), pool, ["season", "position"], "case_id", "control").select("case_id", "control", "draw")


@query(f"""WITH {_COHORT}, n AS (SELECT s.entity, count(m.control) AS k FROM s LEFT JOIN m ON s.entity = m.case_id AND draw <= 3 GROUP BY s.entity)
SELECT CASE WHEN k >= 3 THEN 'full' WHEN k > 0 THEN 'partial' ELSE 'none' END AS tier, count(*) AS n_cases FROM n GROUP BY ALL""")
def match_tiers(spark, sf_dir):
    return cohort.match_tiers(a.cases(spark, sf_dir).select(F.col("entity").alias("case_id")), match_controls(spark, sf_dir), "case_id")


@query(f"""WITH {_COHORT}, x AS (SELECT s.entity, season, position, c_nationkey, floor(c_acctbal / 500) AS band FROM s JOIN customer ON s.entity = c_custkey)
SELECT entity FROM x WHERE (season, position, c_nationkey, band) NOT IN (SELECT (season, position, c_nationkey, floor(c_acctbal / 500)) FROM q JOIN customer ON q.entity = c_custkey)""")
def unmatched_cases(spark, sf_dir):
    """Cases without a control of the season, position, nation and band of balances."""
    found = a.cases(spark, sf_dir)
    nations = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("band"))
    pool = entities.without(a.roster(spark, sf_dir), found.select("entity").distinct(), ["entity"])
    return cohort.unmatched(found.join(nations, "entity"), pool.join(nations, "entity"), ["season", "position", "c_nationkey", "band"]).select("entity")


@query(f"""WITH {_COHORT}, u AS (SELECT entity, entity AS case_id, 1 AS event, day AS observation_date FROM s UNION ALL SELECT control, case_id, 0, CAST(make_date(CAST(season AS INTEGER), 6, 15) AS DATE) FROM m WHERE draw <= 3)
SELECT u.entity, case_id, event, observation_date, CAST(greatest(observation_date - make_date(CAST({SEASON.format("observation_date")} - 1 AS INTEGER), 10, 1), 0) AS INTEGER) AS time_elapsed_days, c_nationkey, c_acctbal FROM u JOIN customer ON u.entity = c_custkey""", dates=("observation_date",))
def case_control(spark, sf_dir):
    people = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey", "c_acctbal")
    return case_control_matrix(a.cases(spark, sf_dir), a.roster(spark, sf_dir), "entity", "day", ["season", "position"], people)


@query("""WITH e AS (SELECT c_custkey AS entity, unnest(generate_series(greatest(coalesce(nullif(1990 + c_custkey % 12, 1990), 1995), 1995), least(1990 + c_custkey % 12 + 2, 2001))) AS season FROM customer)
SELECT entity, CAST(season AS INTEGER) AS season, md5('https://example.org/players/' || substr('p' || entity, 1, 1) || '/p' || entity || '/gamelog/' || season) AS key FROM e WHERE (entity + season) % 3 <> 0""")
def worklist(spark, sf_dir):
    k = (F.col("c_custkey") % 12).cast("int")
    people = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.when(k != 0, 1990 + k).alias("first"), (1990 + k + 2).alias("last"))
    expected = src.entity_seasons(people, "entity", "first", "last", 1995, 2001)
    expected = expected.withColumn("url", sc.season_url("https://example.org", F.concat(F.lit("p"), F.col("entity").cast("string")), F.col("season")))
    done = expected.filter("(entity + season) % 3 = 0").select(src.page_key(F.col("url")).alias("key"))
    return src.worklist(expected, done, "url").select("entity", "season", src.page_key(F.col("url")).alias("key"))


@query("""WITH d AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events), x AS (SELECT day, unnest(['01AM', '05PM']) AS edition FROM d)
SELECT day, edition FROM x WHERE NOT (edition = '01AM' AND day IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND user_id % 40 = 0))""", dates=("day",))
def report_worklist(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    span = events.agg(F.min("day").cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    expected = src.days_by_edition(spark, span["a"], span["b"], ["01AM", "05PM"])
    done = events.filter("event_type = 'error' AND user_id % 40 = 0").select("day", F.lit("01AM").alias("edition")).distinct()
    return entities.without(expected, done, ["day", "edition"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS team FROM customer")
def aligned_append(spark, sf_dir):
    return src.align(a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("later")), ["id", "name", "team"])


_TYPES = ["signup", "error", "click", "view", "purchase"]


@query(f"""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE user_id IS NOT NULL)
SELECT user_id, day, {", ".join(f"round(count(*) FILTER (WHERE event_type = '{t}') / count(*), 6) AS pt_{t}" for t in _TYPES)} FROM t GROUP BY user_id, day""", dates=("day",))
def share_pivot(spark, sf_dir):
    rows = a.table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", F.col("ts").cast("date").alias("day"), "event_type", F.lit(1.0).alias("possessions"))
    wide = prep.category_shares(rows, ["user_id", "day"], "event_type", "possessions", _TYPES)
    return wide.withColumns({f"pt_{t}": F.round(f"pt_{t}", 6) for t in _TYPES})


@query("""WITH e AS (SELECT o_orderpriority, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY ALL)
SELECT o_orderpriority, n, first_day, last_day, FALSE AS total_rows FROM e UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), min(first_day), max(last_day), TRUE FROM e""", dates=("first_day", "last_day"))
def event_counts(spark, sf_dir):
    return profile.event_summary(a.orders_dated(spark, sf_dir), "day", "o_orderpriority")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL")
def events_per_year(spark, sf_dir):
    return profile.per_year(a.orders_dated(spark, sf_dir), "day")


@query("""WITH t AS (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT feature, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS least, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, max(v) AS greatest FROM t GROUP BY feature""")
def describe(spark, sf_dir):
    found = profile.describe(a.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "median", "q3")})


@query("""WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0 END) AS s FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / ((b - a) / 7)), 6) AS INTEGER) AS bin, count(*) AS n, round(any_value(s), 6) AS share_over FROM lineitem, m GROUP BY ALL""")
def histogram(spark, sf_dir):
    return profile.histogram(a.table(spark, sf_dir, "lineitem"), "l_quantity", 7, 40).select("bin", "n", F.round("share_over", 6).alias("share_over"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd FROM lineitem WHERE l_discount IS NOT NULL GROUP BY ALL")
def group_compare(spark, sf_dir):
    return profile.compare_groups(a.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_events FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL")
def temporal_split(spark, sf_dir):
    rows = a.orders_dated(spark, sf_dir).withColumn("split", prep.temporal_split(F.col("day"), 1998, 2000))
    return profile.split_counts(rows, "split", "o_custkey", F.col("o_orderpriority") == "1-URGENT")


@query("SELECT o_custkey, count(DISTINCT CASE WHEN year(o_orderdate) < 1998 THEN 0 WHEN year(o_orderdate) < 2000 THEN 1 ELSE 2 END) AS n_splits FROM orders GROUP BY o_custkey HAVING n_splits > 1")
def split_leaks(spark, sf_dir):
    return prep.split_leaks(a.orders_dated(spark, sf_dir).withColumn("split", prep.temporal_split(F.col("day"), 1998, 2000)), "o_custkey", "split")


@query("SELECT unnest([0.1, 0.5, 0.9]) :: DOUBLE AS share, round(unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])), 4) AS value FROM orders")
def percentiles(spark, sf_dir):
    return profile.percentiles(a.table(spark, sf_dir, "orders"), "o_totalprice", [0.1, 0.5, 0.9]).withColumn("value", F.round("value", 4))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_values(spark, sf_dir):
    return profile.top_values(a.table(spark, sf_dir, "part"), "p_brand")


@query("SELECT CASE WHEN i < 16 THEN 'workload' WHEN i < 32 THEN 'body' ELSE 'other' END AS category, round(avg(abs(v)), 6) AS mean_abs FROM (SELECT unnest(embedding) :: DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def importance(spark, sf_dir):
    long = a.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v")).select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), F.col("v").cast("double").alias("v"))
    groups = {f"f{i}": "workload" for i in range(16)} | {f"f{i}": "body" for i in range(16, 32)}
    return profile.importance(long, "feature", "v", groups).withColumn("mean_abs", F.round("mean_abs", 6))


@query("SELECT feature, round(m, 6) AS mean_abs FROM (SELECT feature, avg(abs(v)) AS m FROM (SELECT 'f' || (generate_subscripts(embedding, 1) - 1) AS feature, unnest(embedding) :: DOUBLE AS v FROM embeddings) GROUP BY feature) ORDER BY m DESC LIMIT 5")
def top_features(spark, sf_dir):
    long = a.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v")).select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), F.col("v").cast("double").alias("v"))
    return profile.importance(long, "feature", "v").orderBy(F.desc("mean_abs"), "feature").limit(5).withColumn("mean_abs", F.round("mean_abs", 6))


@query("SELECT o_custkey AS id, o_totalprice AS price, NULL :: DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def union_aligned(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))
    return profile.union_aligned(orders, a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))


@query(f"WITH {USERS} SELECT user_id, day, load FROM d WHERE (user_id, day) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)", dates=("day",))
def set_difference(spark, sf_dir):
    bad = a.table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return entities.without(a.user_days(spark, sf_dir), bad, ["user_id", "day"])


_TRAIN = "(SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE year(l_shipdate) < 1998)"


@query(f"SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_discount - md) / sd, 6) AS l_discount FROM lineitem, {_TRAIN}")
def standardize(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem")
    columns = [c for c in prep.numeric_columns(rows) if c in ("l_quantity", "l_discount")]
    out = prep.scale(rows, prep.fit_scaler(rows.filter(F.year("l_shipdate") < 1998), columns))
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in columns))


@query("""WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, r <= floor(n * 0.15 + 0.5) AS holdout FROM o""")
def stratified(spark, sf_dir):
    return prep.stratified_holdout(a.table(spark, sf_dir, "embeddings"), "vec_id", "label").select("vec_id", "label", "holdout")


def _components_sql(k: int = 8, squarings: int = 18) -> str:
    """Principal components one by one: the Gram matrix squared again and again leaves its first direction, which is taken off for the next."""
    parts = ["""x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""",
             "z AS MATERIALIZED (SELECT vec_id, i, coalesce((x - m) / s, 0) AS x FROM x JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i) USING (i))",
             "g0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM z a JOIN z b USING (vec_id) GROUP BY ALL)"]
    for c in range(k):
        before = f"g{c}"
        for n in range(squarings):
            parts.append(f"s{c}_{n} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {before}) AS v FROM {before})")
            before = f"p{c}_{n}"
            parts.append(f"{before} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{c}_{n} a JOIN s{c}_{n} b ON a.j = b.i GROUP BY ALL)")
        parts.append(f"u{c} AS (SELECT i, v FROM {before} WHERE j = (SELECT arg_max(i, v) FROM {before} WHERE i = j))")
        parts.append(f"v{c} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM u{c}) AS v FROM u{c})")
        parts.append(f"l{c} AS MATERIALIZED (SELECT sum(a.v * g.v * b.v) AS l FROM g{c} g JOIN v{c} a ON a.i = g.i JOIN v{c} b ON b.i = g.j)")
        parts.append(f"g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - l * a.v * b.v AS v FROM g{c} g JOIN v{c} a ON a.i = g.i JOIN v{c} b ON b.i = g.j, l{c})")
    shares = ", ".join(f"round(sum(x * v{c}.v), 5) + 0.0 AS ps_dim_{c}" for c in range(k))
    return f"WITH {', '.join(parts)} SELECT vec_id, {shares} FROM z " + " ".join(f"JOIN v{c} ON v{c}.i = z.i" for c in range(k)) + " GROUP BY vec_id"


@query(_components_sql())
def pca(spark, sf_dir):
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)))
    out, _ = prep.principal_components(rows, [f"f{i}" for i in range(64)])
    return out.select("vec_id", *((F.round(f"ps_dim_{i}", 5) + 0.0).alias(f"ps_dim_{i}") for i in range(8)))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i)
SELECT vec_id, round(sum(((x - m) / s) * ((x - m) / s)), 6) AS norm FROM x JOIN s USING (i) GROUP BY vec_id""")
def pca_norms(spark, sf_dir):
    """All components of a row are as long together as its standardised values: the components are a rotation."""
    names = [f"f{i}" for i in range(64)]
    rows = a.table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    out, _ = prep.principal_components(rows, names, 64)
    return out.select("vec_id", F.round(sum((F.pow(f"ps_dim_{i}", F.lit(2.0)) for i in range(64)), F.lit(0.0)), 6).alias("norm"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders", dates=("day",))
def sorted_rows(spark, sf_dir):
    rows = a.orders_dated(spark, sf_dir).select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("day")).alias("day"))
    return profile.sorted_rows(rows, "o_custkey", "day", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25")
def trial_rows(spark, sf_dir):
    return profile.first_rows(a.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 25, "c_name", "c_custkey")


@query(f"""WITH {DENSE}, m AS (SELECT s_suppkey AS player_id, DATE '2000-12-20' AS observed, 1 AS event FROM supplier)
SELECT m.player_id, m.observed, event, CAST(m.observed - max(game_date) AS INTEGER) AS days_since_last, CAST(count(*) FILTER (WHERE game_date >= m.observed - 7) AS INTEGER) AS events_last_7
FROM m LEFT JOIN d ON m.player_id = d.player_id AND game_date <= m.observed AND {SEASON.format("game_date")} > {SEASON.format("m.observed")} - 3 GROUP BY m.player_id, m.observed, event""", dates=("observed",))
def refreshed_matrix(spark, sf_dir):
    stale = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.lit("2000-12-20").cast("date").alias("observed"), F.lit(1).alias("event"), F.lit(-1).alias("days_since_last"))
    fresh = refresh_loads(stale, a.shipments(spark, sf_dir), "player_id", "observed", "game_date", "load", "event")
    return fresh.select("player_id", "observed", "event", "days_since_last", "events_last_7")
