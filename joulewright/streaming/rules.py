"""Rules that must alarm while a condition holds: state and timers per device, and online control charts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "entity_id string, rule string, severity string, start timestamp, end timestamp"


@dataclass(frozen=True)
class Rule:
    """A rule on the latest known states of a device.

    holds: a function of a dict of key -> value (None: unknown) to whether the condition
    holds; seconds: how long it must hold before it alarms.
    """

    name: str
    severity: str
    seconds: int
    holds: object


def contact(value: float | None, polarity: str | None) -> bool:
    """Whether a tank contact reports its level: NO at 1, NC at 0; never until its kind is confirmed."""
    return value is not None and value == {"NO": 1, "NC": 0}.get(polarity)


def dry_run(seconds: int, polarity: str | None = None) -> Rule:
    """A running pump without flow, or with the low contact of its tank (of the given polarity)."""
    return Rule("dry_run", "critical", seconds, lambda s: s.get("pump_state") == 1 and (contact(s.get("tank_low"), polarity) or s.get("water_flow_lpm") is not None and s["water_flow_lpm"] < 0.1))


def overflow(polarity: str | None = None) -> Rule:
    return Rule("overflow", "critical", 0, lambda s: s.get("pump_state") == 1 and contact(s.get("tank_high"), polarity))


def stuck_valve(seconds: int) -> Rule:
    return Rule("stuck_valve", "warning", seconds, lambda s: s.get("supply_valve_state_cmd") == 1 and s.get("supply_valve_open_limit") == 0)


def command_ignored(seconds: int) -> Rule:
    return Rule("command_ignored", "warning", seconds, lambda s: None not in (s.get("pump_state_cmd"), s.get("pump_state")) and s["pump_state_cmd"] != s["pump_state"])


def both_limits() -> Rule:
    return Rule("both_limits", "warning", 0, lambda s: s.get("supply_valve_open_limit") == 1 and s.get("supply_valve_close_limit") == 1)


class Device:
    """What the rules know of one device, and what a set of samples of one time makes of it.

    states: key -> (value, time of it in ms); since: rule -> (start in ms, told). Times never go
    back: a sample older than the one that its key has is ignored (it is late, and says
    nothing of the present), and one of another key counts from the latest time known.
    """

    def __init__(self, rules: list[Rule], states: dict | None = None, since: dict | None = None):
        self.rules, self.states, self.since = rules, states or {}, since or {}

    def take(self, at: int, samples: list[tuple[str, float | None]]) -> list[tuple[Rule, int, int | None]]:
        """(rule, start, end) of what is to be told now: begun (end None) or over."""
        fresh = [(k, None if v is None or v != v else float(v)) for k, v in samples if k not in self.states or at >= self.states[k][1]]
        if not fresh:
            return []
        now = max([at, *(t for _, t in self.states.values())])
        self.states.update({k: (v, at) for k, v in fresh})
        known = {k: v for k, (v, _) in self.states.items()}
        out = []
        for rule in self.rules:
            start, told = self.since.get(rule.name, (now, False))
            late = now - start >= rule.seconds * 1000
            if rule.holds(known):
                if late and not told:
                    out.append((rule, start, None))
                self.since[rule.name] = (start, told or late)
            elif self.since.pop(rule.name, None):
                if told or now - start > rule.seconds * 1000:
                    out.append((rule, start, now))
        return out


class RuleProcessor(StatefulProcessor):
    """Per device: the latest state of each key, and since when each rule's condition holds.

    An event is told when it has held for the rule's time (end null), and again when it
    ends. Rules that wait set a timer, so that they alarm although no further sample of the
    device comes: by event time, as soon as the watermark is past (repeatable, but silent
    while no device sends anything), or by processing time, when the rule's time is over by
    the clock of the cluster (at_once: an idle site alarms too). The cluster's clock is only
    compared with itself, so a device whose clock is ahead or behind alarms as well.

    A device that has sent nothing for keep_ms (by the same time) is forgotten; an event of it
    that is still open ends with its last sample.
    """

    def __init__(self, rules: list[Rule], at_once: bool = False, keep_ms: int | None = None):
        self.rules, self.at_once, self.keep_ms = rules, at_once, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "key string", "value double, at long")
        # due: when to tell, by the clock of the timers
        self.since = handle.getMapState("since", "rule string", "start long, told boolean, due long")
        self.seen = handle.getValueState("seen", "at long")

    def device(self) -> tuple[Device, dict[str, int]]:
        held = {k[0]: tuple(v) for k, v in self.since.iterator()}
        return Device(self.rules, {k[0]: (v[0], v[1]) for k, v in self.states.iterator()}, {r: v[:2] for r, v in held.items()}), {r: v[2] for r, v in held.items()}

    def keep(self, device: Device, before: dict[str, int], now: dict[str, int], timers) -> None:
        """Write what is known; before: the rules that held, and when each was due; now: where device time stood when a rule began to hold."""
        for k, v in device.states.items():
            self.states.updateValue((k,), v)
        for rule in self.rules:
            held = device.since.get(rule.name)
            if held is None:
                if rule.name in before:
                    self.since.removeKey((rule.name,))
                continue
            due = before.get(rule.name)
            if due is None or now[rule.name] != held[0]:
                left = held[0] + rule.seconds * 1000 - self.latest(device)
                due = timers.getCurrentProcessingTimeInMs() + left if self.at_once else held[0] + rule.seconds * 1000
                if not held[1]:
                    self.handle.registerTimer(due)
            self.since.updateValue((rule.name,), (held[0], held[1], due))

    @staticmethod
    def latest(device: Device) -> int:
        return max(t for _, t in device.states.values())

    def mark(self, device: Device, timers) -> None:
        if self.keep_ms is not None:
            at = timers.getCurrentProcessingTimeInMs() if self.at_once else self.latest(device)
            self.seen.update((at,))
            self.handle.registerTimer(at + self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of states_at_end(): a device as a batch run leaves it."""
        rows = list(initialState.itertuples(index=False))
        ms = lambda t: int(pd.Timestamp(t).value // 1_000_000)
        device = Device(
            self.rules,
            {r.name: (None if pd.isna(r.value) else float(r.value), ms(r.at)) for r in rows if r.kind == "state"},
            {r.name: (ms(r.at), bool(r.told)) for r in rows if r.kind == "since" and r.name in {x.name for x in self.rules}},
        )
        if device.states:
            self.keep(device, {}, {}, timerValues)
            self.mark(device, timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(rows, ignore_index=True).sort_values(["ts", "key"])
        device, due = self.device()
        started = {r: v[0] for r, v in device.since.items()}
        out = []
        for ts, together in samples.groupby("ts", sort=True):
            told = device.take(int(ts.value // 1_000_000), list(zip(together["key"], together["value"])))
            out += [self.event(key, *x) for x in told]
        self.keep(device, due, started, timerValues)
        self.mark(device, timerValues)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for rule in self.rules:
            if self.since.containsKey((rule.name,)):
                start, told, due = self.since.getValue((rule.name,))
                if not told and now >= due:
                    out.append(self.event(key, rule, start, None))
                    self.since.updateValue((rule.name,), (start, True, due))
        if self.keep_ms is not None and self.seen.exists() and now - self.seen.get()[0] >= self.keep_ms:
            device, _ = self.device()
            out += [self.event(key, r, device.since[r.name][0], self.latest(device)) for r in self.rules if device.since.get(r.name, (0, False))[1]]
            for state in (self.states, self.since, self.seen):
                state.clear()
        yield self.frame(out)

    def event(self, key, rule: Rule, start: int, end: int | None) -> tuple:
        return key[0], rule.name, rule.severity, pd.Timestamp(start, unit="ms"), pd.NaT if end is None else pd.Timestamp(end, unit="ms")

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["entity_id", "rule", "severity", "start", "end"])
        return out.astype({"start": "datetime64[us]", "end": "datetime64[us]"})

    def close(self) -> None:
        pass


#: A device at the end of a batch run: the last value of each key (state), and the rules that hold since when (since).
AT_END = "entity_id string, kind string, name string, value double, at timestamp, told boolean"


def states_at_end(telemetry: DataFrame, rules: list[Rule]) -> DataFrame:
    """AT_END of samples at rest (entity_id, key, ts, value), for alarms() to go on from.

    The rules run over each device's samples in order; a task holds one device's states and
    a batch of rows, whatever the number of samples.
    """

    def rows_of(entity: str, device: Device) -> list[tuple]:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        rows = [(entity, "state", k, v, at(t), None) for k, (v, t) in device.states.items()]
        return rows + [(entity, "since", r, None, at(t), told) for r, (t, told) in device.since.items()]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["entity_id", "kind", "name", "value", "at", "told"])
        return out.astype({"at": "datetime64[us]", "value": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, device, at, waiting = None, Device(rules), None, []
        for b in batches:
            out = []
            for entity, key, ts, value in zip(b["entity_id"], b["key"], b["ts"], b["value"]):
                if entity != now or ts != at:
                    if waiting:
                        device.take(int(at.value // 1_000_000), waiting)
                    waiting = []
                    if entity != now:
                        if now is not None:
                            out += rows_of(now, device)
                        now, device = entity, Device(rules)
                    at = ts
                waiting.append((key, value))
            yield frame(out)
        if now is not None:
            device.take(int(at.value // 1_000_000), waiting)
            yield frame(rows_of(now, device))

    dealt = telemetry.select("entity_id", "key", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).where("ts IS NOT NULL")
    return dealt.repartition("entity_id").sortWithinPartitions("entity_id", "ts", "key").mapInPandas(run, AT_END)


def alarms(stream: DataFrame, rules: list[Rule], at_once: bool = False, initial: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """EVENTS of a stream of telemetry (entity_id, key, ts, value).

    By event time the stream has a watermark on ts. at_once: timers by processing time, for
    critical rules on live streams; samples that come late alarm later by as much. initial:
    states_at_end() of the samples before the stream, read once, when the query first starts.
    keep_ms: after how long without samples a device is forgotten (None: never).
    Needs the RocksDB state store; state is checkpointed with the query.
    """
    return stream.select("entity_id", "key", "ts", "value").groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rules, at_once, keep_ms),
        outputStructType=EVENTS,
        outputMode="Update",
        timeMode="ProcessingTime" if at_once else "EventTime",
        initialState=initial.groupBy("entity_id") if initial is not None else None,
    )


class CusumProcessor(StatefulProcessor):
    """The control chart of one series, kept between micro-batches; it starts again after an alarm.

    A residual that comes after a later one of its series is added when it comes.
    """

    def __init__(self, slack: float, limit: float, keep_ms: int | None = None):
        self.slack, self.limit, self.keep_ms = slack, limit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("sum", "s double", self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.sum.update((float(initialState["cusum"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.sum.get()[0] if self.sum.exists() else 0.0
        out = []
        for at, r in pd.concat(rows, ignore_index=True).sort_values("ts")[["ts", "residual"]].itertuples(index=False):
            s = max(0.0, s + (0.0 if pd.isna(r) else r - self.slack))
            if s > self.limit:
                out.append((key[0], at, s))
                s = 0.0
        self.sum.update((s,))
        yield pd.DataFrame(out, columns=["entity_id", "ts", "cusum"]).astype({"ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def online_cusum(stream: DataFrame, slack: float, limit: float, initial: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """entity_id, ts, cusum where the chart of a stream of residuals crosses its limit.

    initial: entity_id, cusum of series whose charts go on from a batch run (the last rows of
    restarting_cusum()). keep_ms: how long a chart without samples is kept (None: for ever).
    """
    return stream.select("entity_id", "ts", "residual").groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=CusumProcessor(slack, limit, keep_ms),
        outputStructType="entity_id string, ts timestamp, cusum double",
        outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime",
        initialState=initial.groupBy("entity_id") if initial is not None else None,
    )
