"""Point-in-time joins and spines: what was known of an entity at an observation date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.functions.scalars import season_year
from stridecast.operators.workload import FLOOR, SCALES, add_spikes


def asof_join(spine: DataFrame, features: DataFrame, entity: str, observed: str, feature_day: str, columns: list[str] | None = None, tie: Column | None = None, prefix: str = "", by_dates: bool = False) -> DataFrame:
    """Each spine row with the entity's last feature row on or before its date, null where there is none.

    Both sides are dealt once by entity and merged in one window: no pairs. The row as a whole is picked, so its nulls
    stay. Of rows of one day the one with the largest tie counts. Feature rows without entity or day never match;
    spine rows keep their number. An entity's spine rows are one sorted run of one task; by_dates asks once for each entity and
    date, of which an entity has only so many, and joins the spine on both, which Spark splits for an entity or date of very many rows.
    """
    if by_dates:
        names = {entity: "_asked", observed: "_asked_on"}
        dates = spine.select(F.col(entity).alias("_asked"), F.col(observed).cast("date").alias("_asked_on")).filter("_asked is not null and _asked_on is not null").distinct()
        renamed = features.withColumnRenamed(entity, "_asked")
        found = asof_join(dates, renamed, "_asked", "_asked_on", feature_day, columns, tie, prefix)
        return spine.join(found, (F.col(entity) == F.col("_asked")) & (F.col(observed).cast("date") == F.col("_asked_on")), "left").drop(*names.values())
    columns = columns or [c for c in features.columns if c not in (entity, feature_day)]
    picked = F.struct(F.col(feature_day).alias("_day"), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    order = F.struct(tie) if tie is not None else F.struct(*(F.col(c) for c in columns))
    right = features.filter(F.col(entity).isNotNull() & F.col(feature_day).isNotNull()).groupBy(F.col(entity).alias("_e"), F.col(feature_day).cast("date").alias("_d")).agg(F.max_by(picked, order).alias("_row"))
    left = spine.select(F.col(entity).alias("_e"), F.col(observed).cast("date").alias("_d"), F.lit(1).alias("_side"), F.struct(*(F.col(c) for c in spine.columns)).alias("_spine"))
    both = left.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    over = Window.partitionBy("_e").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(over)).filter(F.col("_side") == 1)
    known = F.col("_d").isNotNull() & F.col("_e").isNotNull()
    return found.select("_spine.*", *(F.when(known, F.col("_hit")[f"{prefix}{c}"]).alias(f"{prefix}{c}") for c in columns))


def static_join(spine: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Attributes that don't change, by key; spine rows without a profile keep nulls. A key with several profiles gives a row
    for each, so give profiles once a key (entities.first_row) where that isn't meant. Spark broadcasts small profiles."""
    return spine.join(profiles.filter(F.col(key).isNotNull()), key, "left")


def replace_columns(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """base with fresh's columns in place of its own of the same name, joined by composite keys that fresh has once."""
    stale = [c for c in fresh.columns if c in base.columns and c not in keys]
    others = [c for c in fresh.columns if c not in keys]
    unique = fresh.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_f")).select(*keys, "_f.*")
    return base.drop(*stale).join(unique, keys, "left")


def first_events(events: DataFrame, entity: str, day: str, study_end: str) -> DataFrame:
    """entity, event_day: of the first event up to the end of the study."""
    return events.filter(F.col(day) <= F.lit(study_end).cast("date")).groupBy(entity).agg(F.min(F.col(day).cast("date")).alias("event_day"))


def observation_spine(profiles: DataFrame, events: DataFrame, entity: str, debut: str, day: str, study_end: str, interval: int = 30) -> DataFrame:
    """A row every interval days from an entity's debut through its first event, else the end of the study.

    Returns entity, observation_date, event, time_remaining_days; entities that begin after their end have no rows.
    """
    ends = profiles.join(first_events(events, entity, day, study_end), entity, "left")
    end = F.coalesce("event_day", F.lit(study_end).cast("date"))
    ends = ends.select(entity, F.col(debut).cast("date").alias("_from"), end.alias("_to"), F.col("event_day").isNotNull().cast("int").alias("event"))
    rows = ends.filter(F.col("_from") <= F.col("_to")).withColumn("observation_date", F.explode(F.sequence("_from", "_to", F.expr(f"interval {int(interval)} days"))))
    return rows.select(entity, "observation_date", "event", F.greatest(F.datediff("_to", "observation_date"), F.lit(0)).alias("time_remaining_days"))


def debut_date(draft_year: Column, year_min: Column, default: int = 1990) -> Column:
    return F.make_date(F.coalesce(draft_year, year_min, F.lit(default)), F.lit(10), F.lit(1))


def history(observations: DataFrame, loads: DataFrame, entity: str, observed: str, day: str, load: str, seasons_back: Column) -> DataFrame:
    """Each observation's loads of the last seasons_back seasons on or before it, one row a day; observations without
    any keep one row of nulls."""
    one = loads.groupBy(F.col(entity).alias("_e"), F.col(day).alias(day)).agg(F.sum(load).alias(load))
    seasons = (season_year(F.col(day)) <= season_year(F.col(observed))) & (season_year(F.col(day)) > season_year(F.col(observed)) - seasons_back)
    return observations.join(one, (F.col(entity) == F.col("_e")) & (F.col(day) <= F.col(observed)) & seasons, "left").drop("_e")


def season_states(asked: DataFrame, loads: DataFrame, most_back: int, scales: dict[str, tuple[int, int]] = SCALES) -> DataFrame:
    """asked (_e, _d and others) with what is known of each season on its date: _now, the state of its own season so far, and _back_1,
    ... of the seasons before, up to most_back - 1; and days with a load in the closed week and two weeks before, _week_1 and _week_2.

    A state is (first day, last day, loads weighted to the last day for each span of days). It is a monoid: a later season's
    joins an earlier one's by decaying the latter to the later last day, so no history is copied to an observation. loads: _e, _d, _load,
    one row a day. Everything is dealt by (entity, season), where an entity has at most 366 loads and a row for each distinct
    observation, so an entity with very many rows isn't one task.
    """
    days = sorted({d for pair in scales.values() for d in pair})
    begins = lambda season: F.make_date(season - 1, F.lit(10), F.lit(1))
    place = lambda day: F.datediff(day, begins(F.col("_season"))).cast("double")
    weight = lambda d: F.lit(1 - 1 / d)

    def state(first: Column, last: Column, scaled) -> Column:
        to_last = [(scaled(d) * F.pow(weight(d), place(last)) if d > 1 else scaled(d)).alias(f"s{d}") for d in days]
        return F.when(last.isNotNull(), F.struct(first.alias("first"), last.alias("last"), *to_last))

    # with a span of one day only the last day's load counts
    own = loads.filter("_d is not null").withColumn("_season", season_year(F.col("_d")))
    own = own.select("_e", "_season", "_d", F.col("_d").alias("_own"), *((F.col("_load") * F.pow(weight(d), -place(F.col("_d"))) if d > 1 else F.col("_load")).alias(f"_s{d}") for d in days))
    totals = own.groupBy("_e", "_season").agg(F.min("_d").alias("f"), F.max("_d").alias("l"), *((F.sum(f"_s{d}") if d > 1 else F.max_by("_s1", "_d")).alias(f"_s{d}") for d in days))
    prior = totals.select("_e", "_season", state(F.col("f"), F.col("l"), lambda d: F.col(f"_s{d}")).alias("_state"), F.explode(F.sequence(F.lit(1), F.lit(most_back - 1))).alias("_shift")) if most_back > 1 else None
    tails = own.filter(F.col("_d") >= F.date_sub(begins(F.col("_season") + 1), 14)).select("_e", (F.col("_season") + 1).alias("_season"), "_d", F.lit(True).alias("_counted"))
    rows = asked.withColumns({"_season": season_year(F.col("_d")), "_asks": F.lit(True)})
    rows = rows.unionByName(own.withColumn("_counted", F.lit(True)), allowMissingColumns=True).unionByName(tails, allowMissingColumns=True)
    if prior is not None:
        moved = (F.col("_season") + F.col("_shift")).alias("_season")
        rows = rows.unionByName(prior.select("_e", moved, begins(F.col("_season") + F.col("_shift")).alias("_d"), "_state", "_shift"), allowMissingColumns=True)
    order = Window.partitionBy("_e", "_season").orderBy(F.unix_date("_d"))
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    week = lambda n: F.count("_counted").over(order.rangeBetween(-n, 0))
    back = [F.max(F.when(F.col("_shift") == k, F.col("_state"))).over(upto).alias(f"_back_{k}") for k in range(1, most_back)] if prior is not None else []
    sums = [(F.sum(f"_s{d}") if d > 1 else F.last("_s1", ignorenulls=True)).over(upto).alias(f"_upto_{d}") for d in days]
    seen = rows.select(*asked.columns, "_season", "_asks", F.min("_own").over(upto).alias("_first"), F.max("_own").over(upto).alias("_last"), *sums, *back, week(7).alias("_week_1"), week(14).alias("_week_2")).filter("_asks")
    now = state(F.col("_first"), F.col("_last"), lambda d: F.col(f"_upto_{d}"))
    return seen.select(*asked.columns, now.alias("_now"), *(f"_back_{k}" for k in range(1, most_back)), "_week_1", "_week_2")


def joined_mean(states: list[Column], last: Column, first: Column, d: int) -> Column:
    """The weighted mean of span d at the last day of several states, the days between them weighing as zeros."""
    if d == 1:
        return F.coalesce(*(s["s1"] for s in states))
    w = F.lit(1 - 1 / d)
    total = sum((F.coalesce(s[f"s{d}"] * F.pow(w, F.datediff(last, s["last"]).cast("double")), F.lit(0.0)) for s in states[1:]), F.coalesce(states[0][f"s{d}"], F.lit(0.0)))
    return total * (1 - w) / (1 - F.pow(w, (F.datediff(last, first) + 1).cast("double")))


def ratio_snapshot(observations: DataFrame, loads: DataFrame, entity: str, observed: str, day: str, load: str, event: str, threshold: float = 1.5, case_seasons: int = 3, control_seasons: int = 2) -> DataFrame:
    """The ratios at the last load day on or before each observation (not decayed to it), with recency.

    Cases look back case_seasons seasons, their own included, and controls control_seasons (two at least). Each observation joins at most that many
    states (season_states), whatever its history, so a dense panel costs no more a row than a cohort. Observations
    without an entity, a date or a load have null ratios and no counts; rows that repeat an observation have the same result.
    """
    if min(case_seasons, control_seasons) < 2:
        raise ValueError("the weeks before an observation may reach into the last season, so two seasons are the least")
    keyed = loads.filter(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_d")).agg(F.sum(load).cast("double").alias("_load"))
    case = F.coalesce(F.col(event) == 1, F.lit(False))
    asked = observations.select(F.col(entity).alias("_e"), F.col(observed).cast("date").alias("_d"), case.alias("_case")).filter("_e is not null and _d is not null").distinct()
    most = max(case_seasons, control_seasons)
    known = season_states(asked, keyed, most)
    back = [F.when(F.lit(k) < F.when(F.col("_case"), case_seasons).otherwise(control_seasons), F.col(f"_back_{k}")) for k in range(1, most)]
    known = known.select("_e", "_d", "_case", "_now", *(b.alias(f"_b{k}") for k, b in enumerate(back)), "_week_1", "_week_2")
    states = [F.col("_now"), *(F.col(f"_b{k}") for k in range(len(back)))]
    last, first = F.coalesce(*(s["last"] for s in states)), F.coalesce(*(s["first"] for s in states[::-1]))
    days = sorted({d for pair in SCALES.values() for d in pair})
    known = known.select("_e", "_d", "_case", last.alias("_last"), *(joined_mean(states, last, first, d).alias(f"_m{d}") for d in days), "_week_1", "_week_2")
    ratio = {s: F.when(F.col("_last").isNotNull() & (F.col(f"_m{slow}") >= FLOOR), F.col(f"_m{fast}") / F.col(f"_m{slow}")) for s, (fast, slow) in SCALES.items()}
    known = known.select(F.col("_e").alias("_ke"), F.col("_d").alias("_kd"), F.col("_case").alias("_kc"), *(r.alias(f"acwr_{s}") for s, r in ratio.items()), F.datediff("_d", "_last").alias("days_since_last"), "_week_1", "_week_2")
    flagged = add_spikes(known, threshold)
    out = observations.join(flagged, (F.col(entity) == F.col("_ke")) & (F.col(observed).cast("date") == F.col("_kd")) & (case == F.col("_kc")), "left")
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return out.select(*observations.columns, *(f"acwr_{s}" for s in SCALES), zero(F.col("spike_any")).alias("spike_flag"), "days_since_last", zero(F.col("_week_1")).alias("events_last_7"), zero(F.col("_week_2")).alias("events_last_14"))
