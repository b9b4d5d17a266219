"""Queries of step 1: keys, grid, counters, filters, quality; and of the derived quantities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from joulewright.functions import expressions as X
from joulewright.operators import joins, normalize, quality, windows
from joulewright.plans.testdata import SQL_DAY_TYPE, SQL_HOURLY, hourly, r4, samples, sql4, table, text, with_calendar
from joulewright.sources import registry as keys
from joulewright.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query under its function's name, with the same in SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql4(sql)
        return f

    return add


#: Groups of the key catalogue in its order, with their numbers of keys (fixed values).
GROUPS = [
    ("ICMP ping", 3), ("Host / gateway compute", 20), ("Connectivity", 9), ("GPS", 6), ("Camera", 8), ("Access control", 11), ("Fire alarm", 9), ("Lift", 2),
    ("Power meter", 13), ("Chiller", 9), ("Air side", 16), ("Water", 20), ("Shared", 6), ("Plant system", 13), ("Air station", 12), ("Attribute", 16),
]


@query(
    "WITH t AS (SELECT *, sum(n) OVER (ORDER BY k) - n AS lo FROM (VALUES " + ", ".join(f"({k}, '{g}', {n})" for k, (g, n) in enumerate(GROUPS)) + ") t(k, grp, n)) "
    "SELECT grp, n, count(e.event_id) AS n_samples FROM t LEFT JOIN events e ON e.user_id % 173 >= lo AND e.user_id % 173 < lo + n GROUP BY 1, 2"
)
def key_registry_counts(spark, d):
    """Each sample's user as the number of a key in the catalogue: the keys of a group, and the samples that it has."""
    order = F.array_position(F.array(*[F.lit(g) for g, _ in GROUPS]), F.col("grp"))
    groups = keys.registry(spark).groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("k", order)
    placed = groups.withColumn("lo", F.sum("n").over(Window.orderBy("k")) - F.col("n"))
    numbers = placed.select("grp", "n", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1)).alias("number"))
    read = samples(spark, d).groupBy((F.col("user_id") % 173).cast("long").alias("number")).agg(F.count(F.lit(1)).alias("s"))
    return numbers.join(read, "number", "left").groupBy("grp", "n").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_samples"))


@query("SELECT event_type AS key, count(*) AS n_days, round(avg(n), 4) AS samples_per_day, 30 - sum(CASE WHEN day > last - 30 THEN 1 ELSE 0 END)::BIGINT AS missing_days FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), (SELECT max(CAST(ts AS DATE)) AS last FROM events) GROUP BY 1")
def data_inventory(spark, d):
    return tables.inventory(samples(spark, d).withColumn("key", F.col("entity_id"))).withColumn("samples_per_day", r4("samples_per_day"))


@query("WITH " + SQL_HOURLY + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(value, 4) AS value, n_samples FROM g")
def grid_hourly(spark, d):
    return normalize.resample(samples(spark, d), 60).select("entity_id", text("slot"), r4("value"), "n_samples")


@query(
    "WITH " + SQL_HOURLY + ", e AS (SELECT entity_id, min(slot) a, max(slot) b FROM g GROUP BY 1), c AS (SELECT entity_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS slot FROM e) "
    "SELECT c.entity_id, strftime(c.slot, '%Y-%m-%d %H:%M:%S') AS slot, round(value, 4) AS value, coalesce(n_samples, 0) AS n_samples FROM c LEFT JOIN g ON c.entity_id = g.entity_id AND c.slot = g.slot"
)
def grid_gap_fill(spark, d):
    return normalize.complete(normalize.resample(samples(spark, d), 60), 60).select("entity_id", text("slot"), r4("value"), "n_samples")


@query(
    "WITH " + SQL_HOURLY + ", e AS (SELECT entity_id, min(slot) a, max(slot) b FROM g GROUP BY 1), c AS (SELECT entity_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS slot FROM e) "
    "SELECT c.entity_id, strftime(c.slot, '%Y-%m-%d %H:%M:%S') AS slot FROM c ANTI JOIN g ON c.entity_id = g.entity_id AND c.slot = g.slot"
)
def missing_cells(spark, d):
    g = normalize.resample(samples(spark, d), 60)
    return normalize.complete(g.select("entity_id", "key", "slot", "value", "n_samples"), 60).select("entity_id", "key", "slot").join(g, ["entity_id", "key", "slot"], "left_anti").select("entity_id", text("slot"))


#: A counter that is set back every day: the running sum of a type's values.
SQL_COUNTER = "k AS (SELECT event_type AS entity_id, ts, event_id, sum(round(value * 100)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS value FROM events), d AS (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS prev FROM k)"


def counter(spark, d):
    w = Window.partitionBy("entity_id", F.to_date("ts")).orderBy("ts", "event_id")
    return samples(spark, d).withColumn("value", F.sum(F.round(F.col("value") * 100)).over(w))


@query("WITH " + SQL_COUNTER + " SELECT event_id, entity_id, round(CASE WHEN value >= prev THEN value - prev END, 4) AS amount FROM d")
def counter_delta(spark, d):
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    rise = F.col("value") - F.lag("value").over(w)
    return counter(spark, d).withColumn("rise", rise).select("event_id", "entity_id", r4(F.when(F.col("rise") >= 0, F.col("rise")), "amount"))


@query("WITH " + SQL_COUNTER + " SELECT entity_id, count(*) FILTER (value < prev) AS n_resets, round(sum(CASE WHEN value >= prev THEN value - prev END), 4) AS total FROM d GROUP BY 1")
def counter_reset_drop(spark, d):
    c = counter(spark, d).withColumn("prev", F.lag("value").over(Window.partitionBy("entity_id").orderBy("ts", "event_id")))
    return c.groupBy("entity_id").agg(F.count_if(F.col("value") < F.col("prev")).alias("n_resets"), r4(F.sum(F.when(F.col("value") >= F.col("prev"), F.col("value") - F.col("prev"))), "total"))


@query(
    "WITH k AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS slot, max_by(v, ts) AS value FROM (SELECT *, sum(round(value * 100)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS v FROM events) GROUP BY 1, 2), "
    "p AS (SELECT *, lag(value) OVER w AS pv, lag(slot) OVER w AS ps FROM k WINDOW w AS (PARTITION BY entity_id ORDER BY slot)) "
    "SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, coalesce(slot - ps <> INTERVAL 1 HOUR, false) AS gap_span, coalesce(value < pv, false) AS reset, round(CASE WHEN slot - ps = INTERVAL 1 HOUR AND value >= pv THEN value - pv END, 4) AS amount FROM p"
)
def counter_amounts_grid(spark, d):
    g = normalize.resample(counter(spark, d), 60, F.lit("counter"))
    return normalize.counter_amounts(g, 60).select("entity_id", text("slot"), "gap_span", "reset", r4("amount"))


#: Event types as source names of the map: click feeds hours, view a temperature.
MAP = [("click", "runtime_min", 60.0), ("view", "chilled_water_supply_temp_c", 1.0), ("error", "cooling_kw", 0.5)]


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'runtime_min' WHEN 'view' THEN 'chilled_water_supply_temp_c' WHEN 'error' THEN 'cooling_kw' ELSE event_type END AS key, round(value * CASE event_type WHEN 'click' THEN 60 WHEN 'error' THEN 0.5 ELSE 1 END, 4) AS value FROM events")
def key_mapping(spark, d):
    m = spark.createDataFrame(MAP, "key string, canonical_key string, factor double")
    return normalize.map_keys(samples(spark, d).withColumn("key", F.col("entity_id")), m).select("event_id", "key", r4("value"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error')")
def in_scope_keys(spark, d):
    m = spark.createDataFrame(MAP, "key string, canonical_key string, factor double")
    return normalize.in_scope(samples(spark, d).withColumn("key", F.col("entity_id")), m).select("event_id")


def parts_as_devices(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("device_type"), F.col("p_brand").alias("device_model"), F.col("p_size").cast("double").alias("rated_cooling_kw"))


@query("SELECT CASE p_type WHEN 'ECONOMY' THEN 'M1' WHEN 'SMALL' THEN 'M2' WHEN 'LARGE' THEN 'M3' END AS module, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def module_routing(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"))
    return normalize.route(li, parts_as_devices(spark, d), {"ECONOMY": "M1", "SMALL": "M2", "LARGE": "M3"}).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE 47 + (user_id % 7) * 0.75 BETWEEN 49 AND 51")
def generator_exclusion(spark, d):
    wide = samples(spark, d).withColumn("frequency_hz", 47 + (F.col("user_id") % 7) * 0.75)
    return normalize.without_generator(wide, (49.0, 51.0)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 2 = 1 AND user_id % 5 < 3")
def running_mode_filter(spark, d):
    wide = samples(spark, d).withColumn("chiller_state", F.col("user_id") % 2).withColumn("op_mode", F.col("user_id") % 5)
    return normalize.running(wide, "chiller_state", (3, 4), "op_mode").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size * 0.5")
def load_floor(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "entity_id")
    return normalize.above_load_floor(li, parts_as_devices(spark, d), "l_quantity", "rated_cooling_kw", 0.5).select("l_orderkey", "l_linenumber", F.col("entity_id").alias("l_partkey"))


@query(
    "WITH " + SQL_HOURLY + ", s AS (SELECT *, CASE WHEN n_samples >= 2 THEN 1 ELSE 0 END AS state FROM g), b AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY entity_id ORDER BY slot) = state THEN 0 ELSE 1 END AS edge FROM s), "
    "r AS (SELECT *, sum(edge) OVER (PARTITION BY entity_id ORDER BY slot) AS run FROM b), t AS (SELECT *, slot - min(slot) OVER (PARTITION BY entity_id, run) AS age FROM r) "
    "SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM t WHERE state = 1 AND age >= INTERVAL 1 HOUR"
)
def settled_filter(spark, d):
    g = hourly(spark, d).withColumn("state", (F.col("n_samples") >= 2).cast("int"))
    return normalize.settled(g, "state", 60).select("entity_id", text("slot"))


@query("SELECT event_id FROM events WHERE user_id % 11 <> 0 AND user_id % 13 <> 0 AND user_id % 17 <> 0")
def usable_rows(spark, d):
    u = F.col("user_id")
    wide = samples(spark, d).withColumn("reachable", (u % 11 != 0).cast("double")).withColumn("fault", (u % 13 == 0).cast("double")).withColumn("mode", (u % 17 == 0).cast("double"))
    return normalize.usable(wide).select("event_id")


def firmware(spark):
    """Two versions of each type, changed on 11 January."""
    rows = [(e, v, at) for e in ("click", "error", "purchase", "signup", "view") for v, at in (("1.0", "2023-01-01 00:00:00"), ("1.1" if e != "view" else "1.0", "2024-01-11 00:00:00"))]
    return spark.createDataFrame(rows, "entity_id string, firmware_version string, at string").select("entity_id", "firmware_version", F.to_timestamp("at").alias("valid_from"))


@query("SELECT event_id FROM events WHERE NOT (event_type <> 'view' AND ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-12')")
def firmware_exclusion(spark, d):
    return normalize.outside_firmware_steps(samples(spark, d), firmware(spark), 24).select("event_id")


@query(
    "WITH n AS (SELECT event_type, ts, value, epoch(ts)::BIGINT - epoch(TIMESTAMP '2024-01-11')::BIGINT AS away FROM events WHERE event_type <> 'view') "
    "SELECT event_type AS entity_id, round(avg(value) FILTER (away < 0), 4) AS before, round(avg(value) FILTER (away >= 0), 4) AS after, round(avg(value) FILTER (away >= 0) - avg(value) FILTER (away < 0), 4) AS step "
    "FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - 1704931200 AS a FROM n) WHERE abs(a) <= 86400 GROUP BY 1"
)
def firmware_step_size(spark, d):
    return quality.firmware_steps(samples(spark, d), firmware(spark), 24).select("entity_id", r4("before"), r4("after"), r4("step"))


@query(
    "WITH s AS (SELECT event_type AS e, date_trunc('hour', ts) AS slot, user_id % 2 AS odd, avg(value) AS value FROM events GROUP BY 1, 2, 3), a AS (SELECT * FROM s WHERE odd = 0), b AS (SELECT * FROM s WHERE odd = 1) "
    "SELECT coalesce(a.e, b.e) AS entity_id, strftime(coalesce(a.slot, b.slot), '%Y-%m-%d %H:%M:%S') AS slot, round(coalesce(a.value, b.value), 4) AS value, CASE WHEN a.slot IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b ON a.e = b.e AND a.slot = b.slot"
)
def source_fallback(spark, d):
    """Hourly means of the samples of even users, and where an hour has none, those of odd users as the other source."""
    s = samples(spark, d).withColumn("slot", F.date_trunc("hour", "ts"))
    of = lambda odd: s.where(F.col("user_id") % 2 == odd).groupBy("entity_id", "slot").agg(F.avg("value").alias("value"))
    return joins.prefer(of(0), of(1), ["entity_id", "slot"]).select("entity_id", text("slot"), r4("value"), "origin")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("WITH " + SQL_HOURLY + " SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, " + ", ".join(f"round(max(value) FILTER (entity_id = '{k}'), 4) AS {k}_" for k in KINDS) + " FROM g GROUP BY slot")
def wide_pivot(spark, d):
    g = hourly(spark, d).select(F.lit("site").alias("e"), "slot", F.col("entity_id").alias("key"), "value").withColumnRenamed("e", "entity_id")
    return normalize.to_wide(g, KINDS).select(text("slot"), *[r4(k, f"{k}_") for k in KINDS])


@query(
    "WITH " + SQL_HOURLY + ", e AS (SELECT entity_id, min(slot) a, max(slot) b FROM g GROUP BY 1), c AS (SELECT entity_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS slot FROM e) "
    "SELECT c.entity_id, count(*) AS n_cells, count(*) FILTER (g.slot IS NULL) AS n_missing, round(1 - count(*) FILTER (g.slot IS NULL) / count(*), 4) AS valid_ratio FROM c LEFT JOIN g ON c.entity_id = g.entity_id AND c.slot = g.slot GROUP BY 1"
)
def quality_missing_ratio(spark, d):
    return quality.valid_ratio(normalize.complete(normalize.resample(samples(spark, d), 60), 60)).withColumn("valid_ratio", r4("valid_ratio"))


@query(
    "WITH v AS (SELECT event_type AS entity_id, ts, event_id, CASE WHEN user_id % 7 <> 0 THEN CAST(floor(value / 25) AS BIGINT) END AS v FROM events), b AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS edge FROM v WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)), "
    "r AS (SELECT *, sum(edge) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS run FROM b) SELECT entity_id, v, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM r WHERE v IS NOT NULL GROUP BY entity_id, run, v HAVING count(*) >= 3"
)
def quality_stuck(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("user_id") % 7 != 0, F.floor(F.col("value") / 25).cast("long")))
    return quality.stuck(s, 3, ("entity_id",), "ts", "v").select("entity_id", "v", "n", text("start"))


@query("WITH " + SQL_COUNTER + " SELECT event_id, round(prev - value, 4) AS fall FROM d WHERE prev > value")
def quality_backwards(spark, d):
    return quality.backwards(counter(spark, d), ("entity_id",)).select("event_id", r4("fall"))


@query("SELECT event_id, value FROM events WHERE value < 0.5 OR value > 40")
def quality_range(spark, d):
    limits = spark.createDataFrame([("power_active_kw", 0.5, 40.0)], "key string, lo double, hi double")
    return quality.out_of_range(samples(spark, d), limits).select("event_id", "value")


@query("SELECT event_type AS entity_id, round(median(CAST(user_id * 4 AS DOUBLE)), 4) AS median_seconds, abs(median(CAST(user_id * 4 AS DOUBLE))) > 300 AS drifts FROM events GROUP BY 1")
def quality_clock_drift(spark, d):
    s = samples(spark, d).withColumn("ingest_ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("user_id") * 4))
    return quality.clock_drift(s).withColumn("median_seconds", r4("median_seconds"))


@query("SELECT event_id, '[' || concat_ws(', ', CASE WHEN value > 40 THEN 'high' END, CASE WHEN value < 0.5 THEN 'low' END, CASE WHEN user_id % 11 = 0 THEN 'unreachable' END) || ']' AS flags FROM events")
def quality_flags(spark, d):
    f = normalize.flags(high=F.col("value") > 40, low=F.col("value") < 0.5, unreachable=F.col("user_id") % 11 == 0)
    return samples(spark, d).select("event_id", F.concat(F.lit("["), F.array_join(f, ", "), F.lit("]")).alias("flags"))


# Derived quantities.


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(abs(a - m), abs(b - m), abs(c - m)) / m * 100, 4) AS pct FROM (SELECT *, (a + b + c) / 3 AS m FROM (SELECT *, 220 + l_quantity AS a, 225.0 AS b, 221 + l_linenumber AS c FROM lineitem))")
def phase_unbalance(spark, d):
    li = table(spark, d, "lineitem")
    pct = X.unbalance_pct(220 + F.col("l_quantity"), F.lit(225.0), 221 + F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r4(pct, "pct"))


@query("SELECT event_id, round(sqrt(3.0) * 400 * value * (0.8 + (user_id % 3) * 0.05) / 1000, 4) AS kw FROM events")
def power_crosscheck(spark, d):
    return samples(spark, d).select("event_id", r4(X.three_phase_kw(F.lit(400.0), F.col("value"), 0.8 + (F.col("user_id") % 3) * 0.05), "kw"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q > 0 THEN round(p / q, 4) END AS kw_per_kw, CASE WHEN p / nullif(q, 0) > 0 THEN round(1 / (p / q), 4) END AS cop, CASE WHEN q > 100 THEN round(7 + l_tax * 100 - 7, 4) END AS delta_t "
    "FROM (SELECT *, l_quantity * 10 AS q, l_extendedprice / 1000 AS p FROM lineitem)"
)
def efficiency_cop(spark, d):
    q, p = F.col("l_quantity") * 10, F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r4(X.kw_per_kw(p, q), "kw_per_kw"), r4(X.cop(p, q), "cop"), r4(X.delta_t(7 + F.col("l_tax") * 100, F.lit(7.0), q, 100), "delta_t")
    )


@query("SELECT event_id, round(4.186 * (value * 10 / 60) * 5.5, 4) AS kw FROM events")
def cooling_crosscheck(spark, d):
    return samples(spark, d).select("event_id", r4(X.cooling_from_flow(F.col("value") * 10, F.lit(5.5)), "kw"))


@query("SELECT n_name AS plant, CASE WHEN count(*) = count(s_acctbal) THEN round(sum(s_acctbal), 4) END AS plant_kw FROM (SELECT n_name, CASE WHEN s_suppkey % 40 = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def plant_power(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kw = F.when(F.col("s_suppkey") % 40 != 3, F.col("s_acctbal"))
    return s.groupBy(F.col("n_name").alias("plant")).agg(r4(X.whole_sum(kw), "plant_kw"))


@query("SELECT event_id, round((3 + value / 10 - 1) / ((s / 100) * (s / 100)), 4) AS head, round(value / nullif(user_id % 5, 0), 4) AS kwh_per_m3 FROM (SELECT *, 40 + (user_id % 4) * 20.0 AS s FROM events)")
def pump_quantities(spark, d):
    speed = 40 + (F.col("user_id") % 4) * 20.0
    head = X.pump_head(3 + F.col("value") / 10, F.lit(1.0), speed)
    return samples(spark, d).select("event_id", r4(head, "head"), r4(X.kwh_per_m3(F.col("value"), F.col("user_id") % 5), "kwh_per_m3"))


@query("WITH " + SQL_HOURLY + " SELECT entity_id, CAST(slot AS DATE)::VARCHAR AS date, round(min(value), 4) AS night_min FROM g WHERE hour(slot) >= 1 AND hour(slot) < 4 GROUP BY 1, 2")
def night_min_flow(spark, d):
    from joulewright.operators.detect import night_minimum

    return night_minimum(hourly(spark, d)).select("entity_id", F.col("date").cast("string").alias("date"), r4("night_min"))


@query(
    "WITH s AS (SELECT event_type AS entity_id, ts, event_id, CASE WHEN value < 3 THEN 1.0 ELSE 0.0 END AS low, CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END AS high FROM events), "
    "p AS (SELECT *, coalesce(lag(high) OVER w, 0) AS ph, last_value(CASE WHEN low = 1 THEN ts END IGNORE NULLS) OVER w AS low_at FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY ts)) "
    "SELECT entity_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS filled_at, CAST(floor(epoch(ts)) - floor(epoch(low_at)) AS BIGINT) AS seconds FROM p WHERE high = 1 AND ph <> 1 AND low_at IS NOT NULL"
)
def tank_fill_time(spark, d):
    s = samples(spark, d).select("entity_id", "ts", (F.col("value") < 3).cast("double").alias("low"), (F.col("value") > 25).cast("double").alias("high"))
    return windows.fill_time(s, ("entity_id",), "ts", "low", "high").select("entity_id", text("filled_at"), "seconds")


@query("SELECT event_id, " + SQL_DAY_TYPE.format("ts") + " AS day_type, CAST((hour(ts) * 60 + minute(ts)) // 15 AS INT) AS tod_slot, dayofweek(ts) BETWEEN 1 AND 5 AND CAST(ts AS DATE) <> DATE '2024-01-01' AND hour(ts) >= 8 AND hour(ts) < 18 AS is_op FROM events")
def calendar_features(spark, d):
    return with_calendar(samples(spark, d), "ts", 15).select("event_id", "day_type", "tod_slot", "is_op")


@query("SELECT event_type AS entity_id, event_id, CAST(CASE WHEN user_id >= p THEN user_id - p ELSE user_id - p + 100000 END AS DOUBLE) AS occupancy_delta FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events)")
def occupancy_delta_wrapping(spark, d):
    """The same of a counter that begins again after 100,000."""
    step = X.step_of(F.col("user_id").cast("double"), ("entity_id",), capacity=F.lit(100_000.0))
    return samples(spark, d).withColumn("occupancy_delta", step).select("entity_id", "event_id", "occupancy_delta")


@query(
    "WITH f AS (SELECT 1 AS rank, 'platform' AS source, event_type, ts, CASE WHEN user_id % 6 <> 0 THEN value END AS value FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 2, 'Plant system', event_type, ts, value * 2 FROM events WHERE user_id % 3 = 0 "
    "UNION ALL SELECT 3, 'Air station', event_type, ts, value * 3 FROM events WHERE user_id % 5 = 0 UNION ALL SELECT 4, 'meters', event_type, ts, value * 4 FROM events), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY value IS NULL, rank, value DESC) AS k FROM f) SELECT event_type AS entity_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value, source FROM r WHERE k = 1"
)
def source_union(spark, d):
    """Four feeds as one: where several have a sample, the first one's that is not null."""
    s, u = samples(spark, d), F.col("user_id")
    feeds = {
        "platform": s.where(u % 2 == 0).withColumn("value", F.when(u % 6 != 0, F.col("value"))),
        "Plant system": s.where(u % 3 == 0).withColumn("value", F.col("value") * 2),
        "Air station": s.where(u % 5 == 0).withColumn("value", F.col("value") * 3),
        "meters": s.withColumn("value", F.col("value") * 4),
    }
    return joins.unite(feeds).select("entity_id", text("ts"), r4("value"), "source")


@query("SELECT event_type AS entity_id, event_id, CASE WHEN user_id >= p THEN CAST(user_id - p AS DOUBLE) END AS occupancy_delta FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events)")
def occupancy_delta(spark, d):
    return samples(spark, d).withColumn("occupancy_delta", X.step_of(F.col("user_id").cast("double"), ("entity_id",))).select("entity_id", "event_id", "occupancy_delta")


@query(
    "WITH " + SQL_HOURLY + ", e AS (SELECT entity_id, tod_slot, median(value) AS expected FROM g GROUP BY 1, 2) "
    "SELECT entity_id, round((avg(value) - avg(expected)) / avg(expected) * 100, 1) AS deviation_pct, round(sum(greatest(value - expected, 0) * 1.0) / 30 * 30, 4) AS waste_kwh_month FROM g JOIN e USING (entity_id, tod_slot) GROUP BY 1"
)
def deviation_and_waste(spark, d):
    g = hourly(spark, d)
    usual = g.groupBy("entity_id", "tod_slot").agg(F.percentile("value", F.lit(0.5)).alias("expected"))
    joined = g.join(usual, ["entity_id", "tod_slot"])
    return joined.groupBy("entity_id").agg(
        X.deviation_pct(F.avg("value"), F.avg("expected")).alias("deviation_pct"), r4(X.waste_per_month(F.col("value"), F.col("expected"), F.lit(1.0), F.lit(30)), "waste_kwh_month")
    )


#: Night is one band over midnight; it is split when the table is read.
TARIFF = [("workday", 570, 690, "peak", 3000.0), ("workday", 1020, 1200, "peak", 3000.0), ("workday", 1320, 240, "off", 1000.0)]
SQL_TARIFF = (
    "tariff AS (SELECT * FROM (VALUES ('workday', 570, 690, 'peak', 3000.0), ('workday', 1020, 1200, 'peak', 3000.0), ('workday', 1320, 1440, 'off', 1000.0), ('workday', 0, 240, 'off', 1000.0)) t(day_type, from_min, to_min, band, price)), "
    "e AS (SELECT event_type AS entity_id, ts, value, hour(ts) * 60 + minute(ts) AS m, " + SQL_DAY_TYPE.format("ts") + " AS day_type FROM events), "
    "b AS (SELECT e.*, coalesce(band, 'normal') AS band, coalesce(price, 2000) AS price FROM e LEFT JOIN tariff t ON e.day_type = t.day_type AND m >= from_min AND m < to_min)"
)


def priced(spark, d):
    tariff = tables.split_midnight(spark.createDataFrame(TARIFF, "day_type string, from_min int, to_min int, band string, vnd_per_kwh double"))
    s = with_calendar(samples(spark, d), "ts")
    banded = joins.with_band(s, tariff, X.minute_of_day(F.col("ts")))
    return banded.withColumn("band", F.coalesce("band", F.lit("normal"))).withColumn("price", F.coalesce("vnd_per_kwh", F.lit(2000.0)))


@query("WITH " + SQL_TARIFF + " SELECT entity_id, band, round(sum(value), 4) AS kwh, CAST(round(sum(value * price)) AS BIGINT) AS vnd FROM b GROUP BY 1, 2")
def tariff_cost_split(spark, d):
    return priced(spark, d).groupBy("entity_id", "band").agg(r4(F.sum("value"), "kwh"), F.round(F.sum(F.col("value") * F.col("price"))).cast("long").alias("vnd"))


@query("WITH " + SQL_TARIFF + " SELECT entity_id, CAST(ts AS DATE)::VARCHAR AS date, round(sum(CASE WHEN band = 'peak' THEN value ELSE 0 END) / sum(value) * 100, 4) AS peak_share_pct FROM b GROUP BY 1, 2")
def peak_share(spark, d):
    peak = F.sum(F.when(F.col("band") == "peak", F.col("value")).otherwise(0.0))
    return priced(spark, d).groupBy("entity_id", F.to_date("ts").cast("string").alias("date")).agg(r4(F.try_divide(peak, F.sum("value")) * 100, "peak_share_pct"))


@query("SELECT event_type AS entity_id, CAST(ts AS DATE)::VARCHAR AS date, round(sum(CASE WHEN NOT (" + SQL_DAY_TYPE.format("ts") + " = 'workday' AND hour(ts) >= 8 AND hour(ts) < 18) THEN value END), 4) AS after_hours_kwh FROM events GROUP BY 1, 2")
def after_hours(spark, d):
    s = with_calendar(samples(spark, d), "ts")
    return s.groupBy("entity_id", F.to_date("ts").cast("string").alias("date")).agg(r4(F.sum(F.when(~F.col("is_op"), F.col("value"))), "after_hours_kwh"))


@query(
    "WITH " + SQL_HOURLY + ", t AS (SELECT entity_id, CAST(slot AS DATE) AS date, sum(value) AS kwh, min(value) FILTER (hour(slot) < 5) AS trough, max(value) FILTER (hour(slot) >= 5) AS top FROM g GROUP BY 1, 2) "
    "SELECT entity_id, date::VARCHAR AS date, round(kwh / 1200, 4) AS kwh_per_m2, round(kwh / 80, 4) AS kwh_per_person, round(trough / top, 4) AS base_load_ratio FROM t"
)
def normalised_intensity(spark, d):
    h = F.hour("slot")
    t = hourly(spark, d).groupBy("entity_id", F.to_date("slot").cast("string").alias("date")).agg(
        F.sum("value").alias("kwh"), F.min(F.when(h < 5, F.col("value"))).alias("trough"), F.max(F.when(h >= 5, F.col("value"))).alias("top")
    )
    area = spark.createDataFrame([("click", 1200.0, 80), ("view", 1200.0, 80), ("error", 1200.0, 80), ("purchase", 1200.0, 80), ("signup", 1200.0, 80)], "entity_id string, floor_m2 double, design_people int")
    return t.join(area, "entity_id").select("entity_id", "date", r4(F.try_divide("kwh", "floor_m2"), "kwh_per_m2"), r4(F.try_divide("kwh", "design_people"), "kwh_per_person"), r4(F.try_divide("trough", "top"), "base_load_ratio"))


@query("SELECT event_type AS entity_id, round(sum(value), 4) AS kvarh, round(greatest(sum(value) - 0.5 * sum(user_id), 0) * 100, 4) AS penalty FROM events GROUP BY 1")
def reactive_penalty(spark, d):
    reactive, active = F.sum("value"), F.sum("user_id")
    return samples(spark, d).groupBy("entity_id").agg(r4(reactive, "kvarh"), r4(X.reactive_penalty(reactive, active, 0.5, 100.0), "penalty"))


@query(
    "SELECT event_id, 'A-' || strftime(ts, '%Y%m%d') || '-' || lpad(k::VARCHAR, CAST(greatest(4, length(k::VARCHAR)) AS INT), '0') AS doc_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS at, "
    "'check ' || event_type || ' on ' || strftime(ts, '%Y-%m-%d') AS action FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)"
)
def event_ids(spark, d):
    e = windows.numbered(samples(spark, d), F.to_date("ts"), F.date_trunc("hour", "ts"), ("ts", "event_id"))
    return e.select("event_id", X.document_id("A", F.col("ts"), F.col("number"), 4).alias("doc_id"), X.iso_at(F.col("ts"), "+07:00").alias("at"), X.sentence("check %s on %s", F.col("entity_id"), F.date_format("ts", "yyyy-MM-dd")).alias("action"))


@query(
    "WITH s AS (SELECT o_custkey AS entity_id, o_orderdate AS day, max(o_orderpriority) AS v FROM orders GROUP BY 1, 2), c AS (SELECT *, lag(v) OVER w IS DISTINCT FROM v AS begins FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY day)), "
    "n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY entity_id ORDER BY day) AS n FROM c), g AS (SELECT entity_id, n, min(v) AS v, min(day) AS f, max(day) AS l FROM n GROUP BY 1, 2) "
    "SELECT entity_id, v AS firmware_version, strftime(f, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(f) OVER (PARTITION BY entity_id ORDER BY f), '%Y-%m-%d %H:%M:%S') AS valid_to, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_seen FROM g"
)
def attribute_history(spark, d):
    """The priority of a customer's orders as snapshots of its firmware version: the stretches in which it did not change."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("seen_at"), F.col("o_orderpriority").alias("firmware_version"))
    out = normalize.attribute_history(o, ["firmware_version"])
    return out.select("entity_id", "firmware_version", text("valid_from"), text("valid_to"), text("last_seen"))
