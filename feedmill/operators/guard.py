"""The guard of an issue's memory: what was accepted before decides what may be told again.

A candidate's verdict depends on the candidates accepted before it, of its own day and of earlier ones, so the rule is
a fold over the days of a channel. What it compares (anchors, facts, themes, title pieces) is made by Columns before;
the fold itself only intersects sets. `replay` runs it over stored days, `feedmill.streaming.guard` over a stream;
both use the same `Memory`, whose size is bounded by the policy, and give the same rows.
"""

from __future__ import annotations

import datetime
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import events
from feedmill.functions.text import title_bigrams
from feedmill.functions.vocabulary import Events


@dataclass(frozen=True)
class Section:
    """How freely a section repeats: scale of the cooldown, what a candidate must add (as a rule, at least, within the cooldown), times told, whether another angle alone is enough, rows a day (and on quiet days)."""

    name: str
    scale: float
    base: float
    floor: float
    to_break: float
    most: int
    refresh: bool = True
    target: int = 1_000_000
    quiet_target: int = 1_000_000


# Sections in the order in which they choose, kinds of event with their days of cooldown, angles in turn.
SECTIONS = (Section("must_read", 1.0, 0.3, 0.12, 0.45, 3, target=5, quiet_target=4), Section("insights", 0.7, 0.22, 0.08, 0.35, 4, target=6, quiet_target=5), Section("risk", 0.5, 0.15, 0.05, 0.25, 5, target=1, quiet_target=1))
COOLDOWNS = {"policy": 6, "enforcement": 7, "ipo": 5, "market": 3, "local": 5, "generic": 4}
KINDS = (
    ("ipo", "受理|问询|过会|注册|辅导备案|招股|申购|敲钟|IPO"),
    ("enforcement", "处罚|罚款|违规|整改|通报|约谈|不良|爆雷|违约"),
    ("policy", "国务院|央行|人民银行|金融监管总局|金监总局|证监会|发改委|财政部|住建部|外汇局|政策|新规|办法|通知|意见|试点|施行|条例|细则"),
    ("local", "广州|广东|南沙|大湾区"),
    ("market", "股|指数|板块|涨|跌|行情|收评|资金|北向"),
)
ANGLES = ("政策变化", "市场反应", "受影响人群", "数据验证", "同业动作", "客户行动")


@dataclass(frozen=True)
class Rules:
    """What a guard goes by; a channel's memory holds no more than `events` records of `samples` samples and `texts` texts each."""

    sections: Sequence[Section] = SECTIONS
    cooldowns: Mapping[str, int] = field(default_factory=lambda: COOLDOWNS)
    kinds: Sequence[tuple[str, str]] = KINDS
    angles: Sequence[str] = ANGLES
    generic: frozenset[str] = frozenset(Events().generic)
    period: str = Events().period
    longest_cooldown: int = 14
    samples: int = 6
    texts: int = 8
    events: int = 400
    retain_days: int = 45
    peak: float = 60.0
    quiet_weekdays: frozenset[int] = frozenset({5, 6, 0})  # Saturday, Sunday, and Monday, whose news are of Sunday


FEATURES = "anchors array<string>, told array<string>, tags array<string>, facts array<string>, grams array<string>, pieces array<string>, kind string"
CANDIDATE = f"channel string, day date, section string, pos long, rank double, title string, url string, score double, override boolean, tier string, run string, {FEATURES}"
DECISION = "channel string, day date, section string, pos long, verdict string, allowed boolean, novelty double, event_id string, angle string"
RECORD = "channel string, event_id string, first_day date, last_day date, days int, sections string, anchors string, samples int, peak double"


def prepared(candidates: DataFrame, v: Events, rules: Rules) -> DataFrame:
    """CANDIDATE of rows (channel, day, section, pos, rank, title, body, url, score, override, tier, run): all that needs the texts, as Columns."""
    whole = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("body", F.lit("")))
    kind: Column = F.lit("generic")
    for name, words in reversed(rules.kinds):
        kind = F.when(F.col("_whole").rlike(words), name).otherwise(kind)
    return candidates.withColumn("_whole", whole).select(
        "channel", "day", "section", F.col("pos").cast("long").alias("pos"), F.coalesce("rank", F.lit(0.0)).cast("double").alias("rank"), F.coalesce("title", F.lit("")).alias("title"), F.nullif("url", F.lit("")).alias("url"), F.col("score").cast("double").alias("score"), F.coalesce("override", F.lit(False)).alias("override"), F.col("tier").cast("string").alias("tier"), F.col("run").cast("string").alias("run"),
        events.candidate_anchors(F.col("title"), F.col("body"), v).alias("anchors"), events.fingerprint(F.col("_whole"), v).alias("told"), events.themes(F.col("_whole"), v).alias("tags"), events.candidate_facts(F.col("title"), F.col("body"), v).alias("facts"),
        title_bigrams(F.col("title")).alias("grams"), title_bigrams(F.col("_whole")).alias("pieces"), kind.alias("kind"),
    )


def _share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@dataclass
class Sample:
    """One telling of an event."""

    day: datetime.date
    section: str
    url: str | None
    grams: set
    pieces: set
    anchors: set
    told: set
    tags: set
    facts: set
    kind: str
    score: float
    angle: str | None
    title: str


@dataclass
class Record:
    """What is remembered of one event, under the id that it got first."""

    event_id: str
    kind: str
    first_day: datetime.date
    last_day: datetime.date
    days: int = 1
    anchors: set = field(default_factory=set)
    tags: set = field(default_factory=set)
    facts: set = field(default_factory=set)
    texts: list = field(default_factory=list)
    angles: list = field(default_factory=list)
    sections: list = field(default_factory=list)
    samples: list = field(default_factory=list)
    peak: float = 0.0


class Memory:
    """The state of one channel: records of delivered days, what the open day accepted so far, and which days were delivered by which run."""

    def __init__(self, rules: Rules):
        import re

        self.rules, self.period = rules, re.compile(rules.period)
        self.records: dict[str, Record] = {}
        self.staged: list[Sample] = []
        self.staged_run: str | None = None
        self.deliveries: dict[datetime.date, str | None] = {}
        self.changed: set[str] = set()  # ids whose record was made, altered or dropped since a caller last looked

    # What is alike

    def _similar(self, row: Mapping, record: Record) -> float:
        """How surely a candidate tells of a remembered event, as events.match_score."""
        if row["url"] and any(s.url == row["url"] for s in record.samples):
            return 1.0
        anchors = row["anchors"]
        both = anchors & record.anchors
        near = _share(anchors, record.anchors)
        told = max((_dice(row["grams"], s.grams) for s in record.samples), default=0.0)
        covered = len(both) / len(anchors) if near >= events.SUPPORT and len(both) >= events.SHARED else 0.0
        hard, tags = max(near, told, covered), len(row["tags"] & record.tags)
        if hard >= events.MATCH:
            return max(hard, events.MATCH + 0.01)
        subjects = any(not a.startswith("#") and a not in self.rules.generic for a in both)
        return events.MATCH if hard >= events.SUPPORT and (tags >= 2 or (subjects and tags)) else hard

    def _of_today(self) -> list[Record]:
        """What the open day accepted, as records: a telling joins the first whose first telling is like it."""
        out: list[Record] = []
        for s in self.staged:
            home = next((r for r in out if _share(s.told, r.samples[0].told) >= events.MATCH or _dice(s.grams, r.samples[0].grams) >= events.MATCH), None)
            if home is None:
                home = Record(f"today#{len(out)}", s.kind, s.day, s.day)
                out.append(home)
            home.samples.append(s)
            home.anchors |= s.told
            home.tags |= s.tags
            home.facts |= s.facts
            home.texts.append(s.pieces)
            if s.angle and s.angle not in home.angles:
                home.angles.append(s.angle)
        return out

    def _match(self, row: Mapping) -> Record | None:
        """The best record of today, else the best remembered one; of equals the first, by id."""
        for records in (self._of_today(), [self.records[i] for i in sorted(self.records)]):
            best, most = None, 0.0
            for record in records:
                alike = self._similar(row, record)
                if alike >= events.MATCH and alike > most:
                    best, most = record, alike
            if best:
                return best
        return None

    def _added(self, row: Mapping, record: Record) -> tuple[float, int]:
        """What a candidate adds to a record, as events.novelty, and its number of new facts."""
        fresh = row["facts"] - record.facts
        share = min(len(fresh) / max(len(row["facts"]), len(record.facts), 1), 1.0 if record.facts else 0.5)
        known = set().union(*record.texts)
        pieces = len(row["pieces"] - known) / len(row["pieces"]) if row["pieces"] else 0.0
        raw = 0.45 * share + 0.35 * pieces + 0.2 * any(f.startswith("!") for f in fresh) + 0.2 * any(self.period.match(f) for f in fresh)
        told = max((_dice(row["grams"], s.grams) for s in record.samples), default=0.0)
        return max(0.0, min(1.0, raw * (1 - (min((told - 0.6) / 0.4, 1.0) * 0.45 if told > 0.6 else 0.0)))), len(fresh)

    # What is decided

    def judge(self, row: Mapping, section: Section) -> tuple[str, bool, float, str | None, str | None]:
        """verdict, allowed, novelty, event_id, angle of a candidate against what is remembered now."""
        record = self._match(row)
        if record is None:
            return "new", True, 1.0, None, None
        rules = self.rules
        novel, fresh = self._added(row, record)
        age = (row["day"] - record.last_day).days
        cooldown = min(int(rules.cooldowns.get(record.kind, rules.cooldowns["generic"]) * section.scale * (1 + 0.5 * (max(1, record.days) - 1)) + 0.5), rules.longest_cooldown)
        angle = next((a for a in rules.angles if a not in record.angles), (record.angles or list(rules.angles) or [None])[0])
        if sum(s.section == section.name for s in record.samples) >= section.most and novel < section.to_break:
            verdict = "exhausted"
        elif age <= 0:
            verdict = "progress" if novel >= section.base else "refresh" if novel >= section.floor and section.refresh else "duplicate"
        elif age < cooldown:
            breaks = novel >= 0.25 and (row["override"] or (row["tier"] == "must_read" and (row["score"] or 0) >= 80) or (section.name == "risk" and fresh > 0))
            verdict = "progress" if breaks or novel >= section.to_break else "duplicate" if novel < section.floor else "cooldown"
        else:
            least = max(section.base * (1 - 0.7 * min(1.0, (age - cooldown) / 14)), section.floor)
            verdict = "progress" if novel >= section.base else "refresh" if novel >= least and section.refresh else "duplicate" if novel < section.floor else "cooldown"
        allowed = verdict in ("progress", "refresh")
        return verdict, allowed, novel, record.event_id, angle if allowed else None

    def accept(self, row: Mapping, angle: str | None) -> None:
        """Stages a telling of the open day; it becomes a memory when its day was delivered."""
        self.staged_run = row["run"] or self.staged_run
        self.staged.append(Sample(row["day"], row["section"], row["url"], row["grams"], row["pieces"], row["anchors"], row["told"], row["tags"], row["facts"], row["kind"], row["score"] or 0.0, angle, row["title"]))

    def begin(self, today: datetime.date) -> None:
        """Settles the day before into memory if it was delivered, by the run that staged it where both name one; drops what is too old or too much."""
        if self.staged and self.staged[0].day != today:
            day = self.staged[0].day
            run = self.deliveries.get(day)
            if day in self.deliveries and not (run and self.staged_run and run != self.staged_run):
                for sample in self.staged:
                    self._remember(sample)
            self.staged, self.staged_run = [], None
        self.deliveries = {d: r for d, r in self.deliveries.items() if d >= today}
        self._prune(today)

    def _remember(self, s: Sample) -> None:
        row = {"url": s.url, "anchors": s.anchors, "grams": s.grams, "tags": s.tags}
        found = [(self._similar(row, self.records[i]), i) for i in sorted(self.records)]
        most = max((x for x, _ in found), default=0.0)
        numbers, words = sorted(a for a in s.anchors if a.startswith("#"))[:2], sorted(a for a in s.anchors if not a.startswith("#"))[:3]
        key = next((i for x, i in found if x == most), "") if most >= events.MATCH else "|".join(numbers + words) or f"ev-{crc32(s.title.encode()):08x}"
        record = self.records.setdefault(key, Record(key, s.kind, s.day, s.day))
        record.days += record.last_day != s.day
        record.last_day = s.day
        record.anchors |= s.anchors
        record.tags |= s.tags
        record.facts |= s.facts
        record.texts = [*record.texts, s.pieces][-self.rules.texts :]
        record.samples = [*record.samples, s][-self.rules.samples :]
        record.sections += [s.section] * (s.section not in record.sections)
        record.angles += [s.angle] * (s.angle is not None and s.angle not in record.angles)
        record.peak = max(record.peak, s.score)
        self.changed.add(key)

    def _prune(self, today: datetime.date) -> None:
        rules = self.rules
        keep = [(r.last_day, i) for i, r in self.records.items() if (today - r.last_day).days <= rules.retain_days * (1 + (r.peak >= rules.peak))]
        keep = {i for _, i in sorted(keep)[-rules.events :]}
        for gone in set(self.records) - keep:
            del self.records[gone]
            self.changed.add(gone)

    def day(self, today: datetime.date, rows: Iterable[Mapping]) -> Iterator[tuple]:
        """Decisions on the candidates of a day: section by section, higher ranks first, until a section has its target; later ones are spare."""
        self.begin(today)
        quiet, by_section = today.weekday() in self.rules.quiet_weekdays, defaultdict(list)
        for row in rows:
            by_section[row["section"]].append(row)
        for section in self.rules.sections:
            chosen = 0
            for row in sorted(by_section.pop(section.name, ()), key=lambda r: (-r["rank"], r["pos"])):
                if chosen >= (section.quiet_target if quiet else section.target):
                    yield row["channel"], today, section.name, row["pos"], "spare", False, None, None, None
                    continue
                verdict, allowed, novel, event, angle = self.judge(row, section)
                if allowed:
                    chosen += 1
                    self.accept(row, angle)
                yield row["channel"], today, section.name, row["pos"], verdict, allowed, novel, event, angle
        for section, left in by_section.items():  # sections without a policy are told as they are
            for row in sorted(left, key=lambda r: (-r["rank"], r["pos"])):
                yield row["channel"], today, section, row["pos"], "unguarded", True, None, None, None

    def rows(self, channel: str) -> Iterator[tuple]:
        for i in sorted(self.records):
            r = self.records[i]
            yield channel, i, r.first_day, r.last_day, r.days, ",".join(sorted(r.sections)), ",".join(sorted(r.anchors)), len(r.samples), r.peak


SETS = ("anchors", "told", "tags", "facts", "grams", "pieces")


def as_sets(row: Mapping) -> dict:
    """A prepared row with its arrays as sets."""
    return {**row, **{c: frozenset(row[c] or ()) for c in SETS}}


def _whole_channels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """The channels of a partition sorted by channel, and the rows of each as they come: no more than a batch is held."""
    rows = (row for batch in batches for row in batch.to_pylist())
    now = next(rows, None)
    while now is not None:
        channel, stopped = now["channel"], [False]

        def own(first=now, channel=channel, stopped=stopped):
            nonlocal now
            row = first
            while row is not None and row["channel"] == channel:
                yield row
                row = next(rows, None)
            now, stopped[0] = row, True

        mine = own()
        yield channel, mine
        for _ in mine:  # what the caller left
            pass


def _replayed(rules: Rules, records: bool):
    schema = pa.schema([("channel", pa.string()), ("event_id", pa.string()), ("first_day", pa.date32()), ("last_day", pa.date32()), ("days", pa.int32()), ("sections", pa.string()), ("anchors", pa.string()), ("samples", pa.int32()), ("peak", pa.float64())]) if records else pa.schema([("channel", pa.string()), ("day", pa.date32()), ("section", pa.string()), ("pos", pa.int64()), ("verdict", pa.string()), ("allowed", pa.bool_()), ("novelty", pa.float64()), ("event_id", pa.string()), ("angle", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for channel, rows in _whole_channels(batches):
            memory, day, waiting, last = Memory(rules), None, [], None
            for row in rows:  # by day; deliveries, which have no section, come first in theirs
                if day is not None and row["day"] != day and waiting:
                    made = list(memory.day(day, waiting))
                    last, waiting = day, []
                    if made and not records:
                        yield batch(made)
                day = row["day"]
                if row["section"] is None:
                    memory.deliveries[day] = row["run"]
                else:
                    waiting.append(as_sets(row))
            if waiting:
                made, last = list(memory.day(day, waiting)), day
                if made and not records:
                    yield batch(made)
            if records and last is not None:
                memory.begin(last + datetime.timedelta(days=1))
                if made := list(memory.rows(channel)):
                    yield batch(made)

    return run


def _laid(candidates: DataFrame, deliveries: DataFrame, v: Events, rules: Rules) -> DataFrame:
    own = prepared(candidates, v, rules).where("channel is not null and day is not null and section is not null")
    sent = deliveries.where("channel is not null and day is not null").groupBy("channel", "day").agg(F.max("run").alias("run"))  # of several the greatest name counts
    return own.unionByName(sent, allowMissingColumns=True).repartition("channel").sortWithinPartitions("channel", "day", F.col("section").asc_nulls_first())


def replay(candidates: DataFrame, deliveries: DataFrame, v: Events | None = None, rules: Rules | None = None) -> DataFrame:
    """DECISION for each candidate, days of a channel in order.

    candidates: (channel, day, section, pos, rank, title, body, url, score, override, tier, run); deliveries: (channel,
    day, run). A day's accepted rows are remembered from the next day on which the channel has candidates, if the day was
    delivered, and not by another run than the one that made it. Channels are dealt out by key and read as sorted streams: a task holds one channel's memory and the
    candidates of one day. Rows without channel, day or section are left out; repeated rows are candidates each.
    """
    v, rules = v or Events(), rules or Rules()
    return _laid(candidates, deliveries, v, rules).mapInArrow(_replayed(rules, False), DECISION)


def remembered(candidates: DataFrame, deliveries: DataFrame, v: Events | None = None, rules: Rules | None = None) -> DataFrame:
    """RECORD of each event that a channel remembers on the day after its last: the ids that events got when they were first told."""
    v, rules = v or Events(), rules or Rules()
    return _laid(candidates, deliveries, v, rules).mapInArrow(_replayed(rules, True), RECORD)
