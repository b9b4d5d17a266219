"""Step 5: proposals for the operator; nothing is ever sent to a device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates are compared as whole parts of this, so equal ones are equal in any engine.
RATE_PARTS = 1e9
#: More machines than this are not planned over a horizon with minimum times; their plant gets no plan, and a reason.
MOST_MACHINES = 12


def plant_options(curves: DataFrame, by: str = "plant") -> DataFrame:
    """by, options: the combinations of a plant's machines (capacity, kw per kw, number, names) that may be the best for some load.

    Machines are folded in order of their kw per kw, the best first. What is still to come
    is then no better than what there is, so a combination with no less capacity and a lower
    rate than another stays ahead of it whatever is added to both; and the other is dropped.
    What is left has rising rates and capacities, and needs no limit on machines.
    """
    machine = F.struct("kw_per_kw", "entity_id", "capacity")
    grouped = curves.groupBy(by).agg(F.sort_array(F.collect_list(machine)).alias("_m"))
    option = "struct<capacity: double, weight: double, rate: bigint, n: int, m: array<string>>"
    none_yet = F.expr(f"cast(array() AS array<{option}>)")

    def plus(o: Column, m: Column) -> Column:
        capacity, weight = o["capacity"] + m["capacity"], o["weight"] + m["capacity"] * m["kw_per_kw"]
        rate = F.round(F.try_divide(weight, capacity) * RATE_PARTS).cast("long")
        return F.struct(capacity.alias("capacity"), weight.alias("weight"), rate.alias("rate"), (o["n"] + 1).cast("int").alias("n"), F.array_sort(F.concat(o["m"], F.array(m["entity_id"]))).alias("m"))

    def ahead(a: Column, b: Column) -> Column:
        """Whether a is chosen before b where both are safe."""
        rank = lambda o: F.struct(o["rate"].alias("rate"), o["n"].alias("n"), o["m"].alias("m"))
        return rank(a) < rank(b)

    def frontier(options: Column) -> Column:
        """Of options, largest first, those that are chosen before all that are as large; smallest first again."""
        first = F.reverse(F.array_sort(F.transform(options, lambda o: F.struct(o["capacity"].alias("capacity"), (-o["rate"]).alias("rate"), (-o["n"]).alias("n"), o.alias("o")))))
        return F.aggregate(first, none_yet, lambda acc, x: F.when((F.size(acc) == 0) | ahead(x["o"], F.get(acc, F.size(acc) - 1)), F.concat(acc, F.array(x["o"]))).otherwise(acc))

    empty = F.struct(F.lit(0.0).alias("capacity"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("rate"), F.lit(0).alias("n"), F.expr("cast(array() AS array<string>)").alias("m")).cast(option)

    def add(acc: Column, m: Column) -> Column:
        grown = F.transform(F.concat(F.array(empty), acc), lambda o: plus(o, m).cast(option))
        return frontier(F.concat(acc, grown))

    return grouped.select(by, F.aggregate("_m", none_yet, add).alias("options"))


def best_combination(demand: DataFrame, curves: DataFrame, by: str = "plant", spare: float = 0.0) -> DataFrame:
    """demand (by, slot, load_kw) with machines, est_kw, n_machines, constraints_checked, note of the cheapest safe choice.

    Safety first: only combinations whose capacity covers the load with `spare`; then cost
    (the load shared by capacity, at each machine's own constant efficiency; dispatch() has
    curves); then fewer machines, then names. A load that no combination covers has no
    machines, and note says why; nor has one of a plant without curves.

    The options of a plant are one array, so a row of demand stays one row, and the search
    is an expression on it.
    """
    safe = F.filter("options", lambda o: o["capacity"] >= F.col("load_kw") * (1 + spare))
    ranked = F.transform(safe, lambda o: F.struct(o["rate"].alias("rate"), o["n"].alias("n"), o["m"].alias("m")))
    told = demand.join(plant_options(curves, by), by, "left").withColumn("_best", F.array_min(ranked))
    checked = F.array(F.lit("capacity"), F.lit("efficiency"))
    note = F.when(F.col("options").isNull(), "no curves of this plant").when(F.col("_best").isNull(), "no combination covers the load")
    est = F.round(F.col("load_kw") * F.col("_best.rate") / RATE_PARTS, 6)
    return told.select(*demand.columns, F.col("_best.m").alias("machines"), est.alias("est_kw"), F.col("_best.n").alias("n_machines"), checked.alias("constraints_checked"), note.alias("note"))


def cheapest_option(options: DataFrame, by: tuple[str, ...], safe: Column, comfortable: Column, cost: Column, tie: str) -> DataFrame:
    """by, choice, cost: safety filters, then comfort, then the least cost (start times, set points)."""
    return options.where(safe & comfortable).groupBy(*by).agg(F.min(F.struct(cost.alias("cost"), F.col(tie).alias("choice"))).alias("_b")).select(*by, "_b.choice", "_b.cost")


def schedule_pump(demand: DataFrame, least_on: int = 2, least_off: int = 1, levels: int = 40, by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """entity_id, slot, on, level: the cheapest on/off plan of a tank's pump over the horizon.

    demand: entity_id, slot, use_m3, price, pump_m3 (per slot), tank_m3, low_m3, start_m3.
    Dynamic programming over level, state and time in the state; the tank never falls under
    low_m3 nor over tank_m3, and minimum times hold. A group is one tank's horizon (some
    tens of slots); `by` has the columns that tell horizons apart, each of which begins at
    start_m3. A horizon that no plan can keep within the limits gives null states.
    """
    import numpy as np
    import pandas as pd

    def plan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        tank, low, start = (float(g[c].iloc[0]) for c in ("tank_m3", "low_m3", "start_m3"))
        unit = (tank - low) / levels
        hold = max(least_on, least_off)
        # a state: level (in units, rounded down: never too optimistic), on, slots in that state (capped)
        costs: dict[tuple, float] = {(int((start - low) / unit + 1e-9), 0, hold): 0.0}
        trail: list[dict[tuple, tuple]] = []
        for use, price, gain in zip(g["use_m3"], g["price"], g["pump_m3"]):
            after: dict[tuple, float] = {}
            came: dict[tuple, tuple] = {}
            for (level, on, age), cost in costs.items():
                for nxt in (0, 1):
                    if nxt != on and age < (least_on if on else least_off):
                        continue
                    new = int(np.floor(level + (gain * nxt - use) / unit + 1e-9))
                    if not 0 <= new <= levels:
                        continue
                    key = (new, nxt, min(hold, age + 1) if nxt == on else 1)
                    total = cost + price * nxt
                    if total < after.get(key, np.inf) - 1e-12:
                        after[key], came[key] = total, (level, on, age)
            costs = after
            trail.append(came)
        out = pd.DataFrame({"entity_id": g["entity_id"].to_numpy(), "slot": g["slot"].to_numpy(), "on": pd.array([None] * len(g), "Int64"), "level": np.nan})
        if costs:
            key = min(costs, key=lambda k: (costs[k], k))
            for i in range(len(g) - 1, -1, -1):
                out.loc[i, "on"], out.loc[i, "level"] = key[1], low + key[0] * unit
                key = trail[i][key]
        return out

    return demand.groupBy(*by).applyInPandas(plan, "entity_id string, slot timestamp, on long, level double")


def balanced_order(runtime: DataFrame, by: str = "plant") -> DataFrame:
    """by, order: machines by hours run, least first, to start next."""
    return runtime.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("run_hours", "entity_id"))), lambda x: x["entity_id"]).alias("order"))


def documents(proposals: DataFrame, module: str, issued: Column, price: Column) -> DataFrame:
    """Proposals (valid_from, valid_to, action, reason, constraints_checked, est_saving_kwh) as documents with ids and status.

    An id counts the proposals of an issue date (issued: a time, or a column of the
    proposals) in order of valid_from, then action.
    """
    from joulewright.functions.expressions import document_id
    from joulewright.operators.windows import numbered

    counted = numbered(proposals.withColumn("_issued", issued), F.to_date("_issued"), F.to_date("valid_from"), ("valid_from", "action"), "_number")
    return counted.select(
        document_id("R", F.col("_issued"), F.col("_number"), 3).alias("rec_id"),
        F.lit(module).alias("module"),
        "valid_from",
        "valid_to",
        "action",
        "reason",
        "constraints_checked",
        "est_saving_kwh",
        F.round(F.col("est_saving_kwh") * price).cast("long").alias("est_saving_vnd"),
        F.lit("pending_operator").alias("status"),
    )


def plan_machines(demand: DataFrame, machines: list[tuple[str, float, float]], least_on: int = 2, start_cost: float = 0.0) -> DataFrame:
    """plant, slot, machines, est_kw, note: combinations over a horizon in which a started machine stays on for `least_on` slots.

    demand: plant, slot, load_kw. machines: (name, capacity, kw per kw) of one kind of plant.
    Dynamic programming over subsets and the time each machine has still to stay on; a group
    is one plant's horizon. A state is dropped where another costs no more and leaves every
    machine at least as free, which changes no result; what is left is at most
    (least_on + 1) ** machines states a slot, and 2 ** machines subsets of each are tried:
    meant for the few machines of one plant. A horizon that no combination covers has null
    machines, and so have all where there are more than MOST_MACHINES of them.
    """
    import itertools

    import pandas as pd

    if len(machines) > MOST_MACHINES:
        none = F.lit(None)
        return demand.select("plant", "slot", none.cast("array<string>").alias("machines"), none.cast("double").alias("est_kw"), F.lit(f"{len(machines)} machines: not planned").alias("note"))
    subsets_ = [s for k in range(len(machines) + 1) for s in itertools.combinations(range(len(machines)), k)]

    def freer(a: tuple, b: tuple) -> bool:
        """Whether a machine in state a can do all that one in state b can, at no more cost."""
        return a == (0, True) or a == b or a[1] and b[1] and a[0] <= b[0]

    def freest(states: dict[tuple, tuple]) -> dict[tuple, tuple]:
        kept: list[tuple] = []
        for state, told in sorted(states.items(), key=lambda x: x[1][0]):
            if not any(all(map(freer, s, state)) for s, _ in kept):
                kept.append((state, told))
        return dict(kept)

    def plan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        # a state: for each machine, the slots it must stay on for (0: off or free to stop), and whether it is on
        costs: dict[tuple, tuple] = {tuple((0, False) for _ in machines): (0.0, ())}
        for load in g["load_kw"]:
            after: dict[tuple, tuple] = {}
            for state, (cost, path) in costs.items():
                for s in subsets_:
                    if any(must and i not in s for i, (must, _) in enumerate(state)):
                        continue
                    capacity = sum(machines[i][1] for i in s)
                    if capacity < load:
                        continue
                    kw = load * sum(machines[i][1] * machines[i][2] for i in s) / capacity if capacity else 0.0
                    starts = sum(not state[i][1] for i in s)
                    new = tuple((max(0, must - 1) if on else least_on - 1, True) if i in s else (0, False) for i, (must, on) in enumerate(state))
                    total = cost + kw + start_cost * starts
                    if new not in after or total < after[new][0] - 1e-9:
                        after[new] = (total, (path, s, kw))
            costs = freest(after)
        chosen: list[tuple] = []
        if costs:
            _, path = min(costs.values(), key=lambda c: c[0])
            while path:
                path, s, kw = path
                chosen.append(([machines[i][0] for i in s], kw))
        note = None if chosen else "no combination covers the loads"
        chosen = chosen[::-1] or [(None, None)] * len(g)
        return pd.DataFrame({"plant": g["plant"], "slot": g["slot"], "machines": [m for m, _ in chosen], "est_kw": [k for _, k in chosen], "note": note})

    return demand.select("plant", "slot", "load_kw").groupBy("plant").applyInPandas(plan, "plant string, slot timestamp, machines array<string>, est_kw double, note string")


def savings(actual: DataFrame, proposed: DataFrame, price: Column, on: list[str], hours: float, assumptions: str) -> DataFrame:
    """kwh, vnd and the assumptions of a backtest: what the proposals would have used less, where both are known.

    actual and proposed: on, kw. price: a column of actual. A slot in which the proposal
    would have used more counts against it.
    """
    both = actual.join(proposed.select(*on, F.col("kw").alias("_told")), on)
    less = (F.col("kw") - F.col("_told")) * hours
    return both.agg(F.sum(less).alias("kwh"), F.round(F.sum(less * price)).cast("long").alias("vnd"), F.count(F.lit(1)).alias("n_slots")).withColumn("assumptions", F.lit(assumptions))
