"""The guard of an issue's memory over a stream: transformWithState with a timer at the end of each day."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedmill.functions.vocabulary import Events
from feedmill.operators.guard import DECISION, SETS, Memory, Record, Rules, Sample, as_sets, prepared

_EPOCH = datetime.date(1970, 1, 1)
_RECORD = "record string"
_DECISION = Row(*(column.split()[0] for column in DECISION.split(", ")))
_PLAIN = "section", "pos", "rank", "title", "url", "score", "override", "tier", "run", "kind"


def _packed(value) -> str:
    """A record or sample as JSON: sets as sorted lists, days as ISO text."""

    def plain(x):
        return sorted(x) if isinstance(x, set | frozenset) else x.isoformat() if isinstance(x, datetime.date) else vars(x)

    return json.dumps(value, default=plain, ensure_ascii=False)


def _sample(raw: dict) -> Sample:
    return Sample(**{**raw, "day": datetime.date.fromisoformat(raw["day"]), **{c: set(raw[c]) for c in SETS}})


def _record(raw: str) -> Record:
    own = json.loads(raw)
    days = {c: datetime.date.fromisoformat(own[c]) for c in ("first_day", "last_day")}
    return Record(**{**own, **days, **{c: set(own[c]) for c in ("anchors", "tags", "facts")}, "texts": [set(t) for t in own["texts"]], "samples": [_sample(s) for s in own["samples"]]})


class Guard(StatefulProcessor):
    """Of each channel: a map of remembered events, a list of the open day's tellings, days of candidates that wait, and deliveries that expire.

    Rows wait until the watermark passes the end of their day; the timer of that day then judges them in order, so the
    order of arrival within the watermark's delay changes nothing. Only records that a day changed are written.
    """

    def __init__(self, rules: Rules, keep_deliveries: datetime.timedelta):
        self.rules, self.keep = rules, keep_deliveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "event_id string", _RECORD)
        self.staged = handle.getListState("staged", _RECORD)
        self.waiting = handle.getMapState("waiting", "day date, n long", _RECORD)
        self.sent = handle.getMapState("deliveries", "day date", "run string", ttlDurationMs=None)
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (n,) = self.last.get() if self.last.exists() else (0,)
        for row in rows:
            if row.section is None:
                run = max(filter(None, (row.run, *(self.sent.getValue((row.day,)) if self.sent.containsKey((row.day,)) else ()))), default=None)
                self.sent.updateValue((row.day,), (run,))
            else:
                n += 1
                self.waiting.updateValue((row.day, n), (_packed({**{c: row[c] for c in _PLAIN}, **{c: list(row[c]) for c in SETS}}),))
            self.handle.registerTimer(((row.day - _EPOCH).days + 1) * 86_400_000)
        self.last.update((n,))
        return iter(())

    def _load(self) -> Memory:
        memory = Memory(self.rules)
        memory.records = {key[0]: _record(value[0]) for key, value in self.records.iterator()}
        held = [json.loads(x[0]) for x in self.staged.get()]
        memory.staged = [_sample(x["sample"]) for x in held]
        memory.staged_run = held[0]["run"] if held else None
        memory.deliveries = {key[0]: value[0] for key, value in self.sent.iterator()}
        return memory

    def _save(self, memory: Memory, before: set) -> None:
        for i in memory.changed:
            if i in memory.records:
                self.records.updateValue((i,), (_packed(memory.records[i]),))
            elif self.records.containsKey((i,)):
                self.records.removeKey((i,))
        if memory.staged:
            self.staged.put([(_packed({"run": memory.staged_run, "sample": s}),) for s in memory.staged])
        else:
            self.staged.clear()
        for day in before - set(memory.deliveries):
            self.sent.removeKey((day,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = _EPOCH + datetime.timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        found: dict[datetime.date, list] = {}
        for (day, n), (raw,) in self.waiting.iterator():
            if day < end:
                found.setdefault(day, []).append((n, raw))
        memory = self._load() if found else None
        for day in sorted(found):
            before = set(memory.deliveries)
            rows = [as_sets({**json.loads(raw), "channel": key[0], "day": day}) for _, raw in sorted(found[day])]
            for decision in memory.day(day, rows):
                yield _DECISION(*decision)
            self._save(memory, before)
            memory.changed.clear()
            for n, _ in found[day]:
                self.waiting.removeKey((day, n))
        oldest = end - self.keep
        for (day,), _ in list(self.sent.iterator()):
            if day < oldest:
                self.sent.removeKey((day,))


def guarded(candidates: DataFrame, deliveries: DataFrame, v: Events | None = None, rules: Rules | None = None, late: str = "1 day", keep_deliveries_days: int = 30) -> DataFrame:
    """DECISION of a stream of candidates, as guard.replay gives them for stored days; both streams have `at`, a timestamp whose UTC day is theirs.

    A day is judged once the watermark (`late` behind the newest row) passes its end. Rows that come later are dropped.
    The session needs the RocksDB state store provider. State of a channel: Rules.events records, one day's tellings,
    candidates of the days within the watermark's delay, deliveries of keep_deliveries_days.
    """
    v, rules = v or Events(), rules or Rules()
    own = prepared(candidates.withColumn("day", F.to_date("at")), v, rules).where("channel is not null and day is not null and section is not null")
    sent = deliveries.where("channel is not null").select("channel", F.to_date("at").alias("day"), "run").where("day is not null")
    rows = own.unionByName(sent, allowMissingColumns=True).withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("channel").transformWithState(Guard(rules, datetime.timedelta(days=keep_deliveries_days)), DECISION, "append", "eventTime")
