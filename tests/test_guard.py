import dataclasses
import datetime
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedmill.operators import guard
from feedmill.plans.guard import RULES, stories
from feedmill.plans.identity import PARTS
from feedmill.plans.registry import Tables
from feedmill.streaming.guard import guarded

DATA = "/root/testdata/sf0.001"
SCHEMA = "channel string, day date, section string, pos long, rank double, title string, body string, url string, score double, override boolean, tier string, run string"


class Model:
    """The rule over raw texts, with everything computed anew for each question."""

    def __init__(self, rules=RULES, v=PARTS):
        self.rules, self.v, self.store, self.today, self.open_day, self.open_run = rules, v, {}, [], None, None

    def anchors(self, text):
        for wording, one in self.v.synonyms:
            text = re.sub(wording, one, text)
        numbers = ["#" + re.sub(r"\s+", "", n) for n in re.findall(rf"(\d+(?:\.\d+)?\s*(?:{self.v.anchor_units}))", text)]
        return {a for a in self.v.anchors if a in text} | set(numbers)

    def facts(self, text):
        out = set()
        for n in re.findall(rf"(\d+(?:\.\d+)?\s*(?:{self.v.fact_units}))", text):
            n = re.sub(r"\s+", "", n)
            for unit, short in self.v.short_units.items():
                n = n.replace(unit, short)
            out.add("#" + n)
        return out | {"!" + s for s in self.v.stages if s in text} | {"@" + b for b in self.v.bodies if b in text}

    def tags(self, text):
        return {name for name, words in self.v.themes.items() if any(w in text for w in words)}

    @staticmethod
    def grams(text):
        plain = "".join(c for c in text if c.isalnum()).lower()
        return {plain[i : i + 2] for i in range(len(plain) - 1)} or set(plain)

    def dice(self, a, b):
        x, y = self.grams(a), self.grams(b)
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    def whole(self, c):
        return " ".join(p for p in (c["title"], c["body"]) if p)

    def both(self, make, c, mark=""):
        return make(c["title"]) | {x for x in make(c["body"]) if x not in {mark + p for p in self.v.places}}

    def likeness(self, c, event):
        if c["url"] and any(s["url"] == c["url"] for s in event["samples"]):
            return 1.0
        a, b = self.both(self.anchors, c), event["anchors"]
        jaccard = len(a & b) / len(a | b) if a and b else 0.0
        title = max([self.dice(c["title"], s["title"]) for s in event["samples"]] + [0.0])
        cover = len(a & b) / len(a) if jaccard >= 0.3 and min(len(a), len(b), len(a & b)) >= 2 else 0.0
        hard = max(jaccard, title, cover)
        shared = len(self.tags(self.whole(c)) & event["tags"])
        subject = [x for x in a & b if x[0] != "#" and x not in self.rules.generic]
        if hard >= 0.5:
            return max(hard, 0.51)
        return 0.5 if hard >= 0.3 and ((subject and shared) or shared >= 2) else hard

    def clusters(self):
        out = []
        for s in self.today:
            mine = self.anchors(self.whole(s))
            for event in out:
                first = event["samples"][0]
                theirs = self.anchors(self.whole(first))
                if (mine and theirs and len(mine & theirs) / len(mine | theirs) >= 0.5) or self.dice(s["title"], first["title"]) >= 0.5:
                    break
            else:
                event = {"id": f"today#{len(out)}", "samples": [], "anchors": set(), "tags": set(), "facts": set(), "angles": [], "days": 1, "last": s["day"], "kind": self.kind(s), "texts": []}
                out.append(event)
            event["samples"].append(s)
            event["anchors"] |= mine
            event["tags"] |= self.tags(self.whole(s))
            event["facts"] |= self.both(self.facts, s, "@")
            event["texts"].append(self.whole(s))
            event["angles"] += [s["angle"]] if s["angle"] and s["angle"] not in event["angles"] else []
        return out

    def kind(self, c):
        return next((k for k, words in self.rules.kinds if re.search(words, self.whole(c))), "generic")

    def best(self, c, events):
        scored = [(self.likeness(c, e), e) for e in events]
        top = max([x for x, _ in scored], default=0.0)
        return next((e for x, e in scored if x == top), None) if top >= 0.5 else None

    def verdict(self, c, section):
        event = self.best(c, self.clusters()) or self.best(c, [self.store[i] for i in sorted(self.store)])
        if event is None:
            return "new", 1.0, None, None
        facts = self.both(self.facts, c, "@")
        new = facts - event["facts"]
        ratio = 0 if not facts else min(len(new) / max(len(facts), len(event["facts"])), 1 if event["facts"] else 0.5)
        mine, old = self.grams(self.whole(c)), set().union(*map(self.grams, event["texts"]))
        raw = 0.45 * ratio + 0.35 * (len(mine - old) / len(mine) if mine else 0)
        raw += 0.2 if any(x[0] == "!" for x in new) else 0
        raw += 0.2 if any(re.match(self.rules.period, x) for x in new) else 0
        told = max([self.dice(c["title"], s["title"]) for s in event["samples"]] + [0.0])
        novel = min(1.0, raw * (1 - 0.45 * min(1, max(0, told - 0.6) / 0.4)))
        age = (c["day"] - event["last"]).days
        cool = min(int(self.rules.cooldowns[event["kind"]] * section.scale * (1 + 0.5 * (event["days"] - 1)) + 0.5), 14)
        unused = [a for a in self.rules.angles if a not in event["angles"]] or event["angles"][:1]
        if len([s for s in event["samples"] if s["section"] == section.name]) >= section.most and novel < section.to_break:
            out = "exhausted"
        elif age <= 0:
            out = "progress" if novel >= section.base else "refresh" if novel >= section.floor and section.refresh else "duplicate"
        elif age < cool:
            forced = novel >= 0.25 and (c["override"] or (c["tier"] == "must_read" and c["score"] >= 80) or (section.name == "risk" and new))
            out = "progress" if forced or novel >= section.to_break else "duplicate" if novel < section.floor else "cooldown"
        else:
            line = max(section.base * (1 - 0.7 * min(1, (age - cool) / 14)), section.floor)
            out = "progress" if novel >= section.base else "refresh" if novel >= line and section.refresh else "duplicate" if novel < section.floor else "cooldown"
        return out, novel, event["id"], unused[0] if out in ("progress", "refresh") else None

    def settle(self, deliveries, day):
        if self.open_day is not None and self.open_day != day and self.today:
            run = deliveries.get(self.open_day, "none")
            if run != "none" and (run is None or self.open_run is None or run == self.open_run):
                for s in self.today:
                    self.keep(s)
            self.today, self.open_run = [], None
        old = [i for i, e in self.store.items() if (day - e["last"]).days > self.rules.retain_days * (2 if e["peak"] >= 60 else 1)]
        for i in old:
            del self.store[i]
        for i in sorted(self.store, key=lambda i: (self.store[i]["last"], i))[: max(0, len(self.store) - self.rules.events)]:
            del self.store[i]
        self.open_day = day

    def keep(self, s):
        event = self.best(s, [self.store[i] for i in sorted(self.store)])
        anchors = self.both(self.anchors, s)
        if event is None:
            name = "|".join(sorted(a for a in anchors if a[0] == "#")[:2] + sorted(a for a in anchors if a[0] != "#")[:3])
            event = self.store.setdefault(name, {"id": name, "samples": [], "anchors": set(), "tags": set(), "facts": set(), "angles": [], "days": 1, "first": s["day"], "last": s["day"], "kind": self.kind(s), "texts": [], "peak": 0.0})
        event["days"] += event["last"] != s["day"]
        event["last"] = s["day"]
        event["anchors"] |= anchors
        event["tags"] |= self.tags(self.whole(s))
        event["facts"] |= self.both(self.facts, s, "@")
        event["texts"] = (event["texts"] + [self.whole(s)])[-self.rules.texts :]
        event["samples"] = (event["samples"] + [s])[-self.rules.samples :]
        event["angles"] += [s["angle"]] if s["angle"] and s["angle"] not in event["angles"] else []
        event["peak"] = max(event["peak"], s["score"])

    def run(self, rows, deliveries):
        out = []
        for day in sorted({c["day"] for c in rows}):
            self.settle(deliveries, day)
            for section in self.rules.sections:
                left = section.quiet_target if day.weekday() in (0, 5, 6) else section.target
                for c in sorted([c for c in rows if c["day"] == day and c["section"] == section.name], key=lambda c: (-c["rank"], c["pos"])):
                    if not left:
                        out.append((c["channel"], day, c["section"], c["pos"], "spare", False, None, None, None))
                        continue
                    verdict, novel, event, angle = self.verdict(c, section)
                    allowed = verdict in ("new", "progress", "refresh")
                    if allowed:
                        left -= 1
                        self.open_run = c["run"] or self.open_run
                        self.today.append({**c, "angle": angle})
                    out.append((c["channel"], day, c["section"], c["pos"], verdict, allowed, round(novel, 6), event, angle))
        return out


def expected(rows, sent, rules=RULES):
    channels, delivered = defaultdict(list), defaultdict(dict)
    for r in rows:
        channels[r.channel].append({**r.asDict(), "rank": float(r.rank)})
    for r in sent:
        delivered[r.channel][r.day] = r.run
    models = {c: Model(rules) for c in channels}
    out = [x for c, own in channels.items() for x in models[c].run(own, delivered[c])]
    return sorted(out, key=repr), models


def rounded(frame):
    return sorted(((*r[:6], None if r.novelty is None else round(r.novelty, 6), *r[7:]) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def few(spark):
    """Stories of two channels instead of a channel for each brand, so that memories fill."""
    rows, sent = stories(Tables(spark, DATA))
    two = F.concat(F.lit("c"), F.substring("channel", -1, 1).cast("int") % 2)
    rows = rows.withColumn("channel", two)
    return rows.persist(), sent.withColumn("channel", two).groupBy("channel", "day").agg(F.max("run").alias("run")).persist()


def test_replay_matches_the_model(spark, few):
    rows, sent = few
    want, models = expected(rows.collect(), sent.collect())
    got = rounded(guard.replay(rows, sent, PARTS, RULES))
    assert got == want and len(got) == rows.count()
    assert {"new", "duplicate", "progress", "refresh", "cooldown"} <= {r[4] for r in got}
    for c, m in models.items():
        last = max(r.day for r in rows.where(F.col("channel") == c).collect())
        m.settle({r.day: r.run for r in sent.collect() if r.channel == c}, last + datetime.timedelta(days=1))
    kept = {(r.channel, r.event_id): (r.first_day, r.last_day, r.days, r.peak) for r in guard.remembered(rows, sent, PARTS, RULES).collect()}
    assert kept == {(c, i): (e["first"], e["last"], e["days"], e["peak"]) for c, m in models.items() for i, e in m.store.items()}


def test_small_memory_forgets_the_oldest(spark, few):
    rows, sent = few
    rules = guard.Rules(**{**vars(RULES), "events": 2, "samples": 2, "texts": 1, "retain_days": 4, "sections": [dataclasses.replace(x, target=2, quiet_target=1) for x in RULES.sections]})
    want, models = expected(rows.collect(), sent.collect(), rules)
    assert rounded(guard.replay(rows, sent, PARTS, rules)) == want and "spare" in {r[4] for r in want}
    assert max(len(m.store) for m in models.values()) <= 2 + max(len(m.today) for m in models.values())


def test_an_event_keeps_its_first_id(spark):
    day = datetime.date(2024, 1, 2)
    told = ["hot bolt 5 years", "hot bolt 5 years ring PROMO", "bolt ring PROMO plate 9 years"]
    rows = [("c", day + datetime.timedelta(days=20 * i), "must_read", i, 1.0, t, None, None, 1.0, False, None, None) for i, t in enumerate(told)]
    sent = [("c", r[1], None) for r in rows]
    out = guard.remembered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sent, "channel string, day date, run string"), PARTS, RULES).collect()
    assert [(r.event_id, r.days) for r in out] == [("#5years|bolt|hot", 3)]
    assert {"ring", "plate", "#9years"} <= set(out[0].anchors.split(","))


def test_days_not_delivered_or_of_another_run_are_not_remembered(spark):
    day = datetime.date(2024, 1, 2)
    rows = [(c, day + datetime.timedelta(days=i), "must_read", i, 1.0, "bolt 5 years", None, None, 1.0, False, None, "r1") for c in ("sent", "other", "unsent", "unnamed") for i in range(2)]
    sent = [("sent", day, "r1"), ("other", day, "r2"), ("unnamed", day, None)]
    out = guard.replay(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sent, "channel string, day date, run string"), PARTS, RULES).collect()
    assert {r.channel: r.verdict for r in out if r.pos == 1} == {"sent": "duplicate", "unnamed": "duplicate", "other": "new", "unsent": "new"}


def test_nulls_repeats_and_nothing(spark):
    day = datetime.date(2024, 1, 2)
    rows = [("c", day, "must_read", 1, None, None, None, None, None, None, None, None)] * 2 + [("c", day, "elsewhere", 2, 1.0, "x", "", "", 1.0, False, None, None), (None, day, "risk", 3, 1.0, "x", "", "", 1.0, False, None, None), ("c", None, "risk", 4, 1.0, "x", "", "", 1.0, False, None, None)]
    none = spark.createDataFrame([], "channel string, day date, run string")
    out = sorted((r.section, r.pos, r.verdict) for r in guard.replay(spark.createDataFrame(rows, SCHEMA), none, PARTS, RULES).collect())
    assert out == [("elsewhere", 2, "unguarded"), ("must_read", 1, "duplicate"), ("must_read", 1, "new")]
    assert guard.replay(spark.createDataFrame([], SCHEMA), none, PARTS, RULES).count() == 0


def test_stream_gives_the_rows_of_the_replay(spark, few, tmp_path):
    rows, sent = few
    want = rounded(guard.replay(rows, sent, PARTS, RULES))
    stamp = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.pmod(F.xxhash64("day"), F.lit(24)).cast("int"))
    source, deliveries = str(tmp_path / "candidates"), str(tmp_path / "deliveries")
    parts = [("2024-01-01", "2024-01-09"), ("2024-01-10", "2024-01-20"), ("2024-01-21", "2024-02-20")]
    end = spark.createDataFrame([("end", datetime.date(2024, 4, 1), "must_read", 0, 0.0, "", "", "", 0.0, False, None, None)], SCHEMA)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in [*parts, None or ("end", "end")]:  # each time the query starts anew from its checkpoint
            more = end if low == "end" else rows.where(F.col("day").between(low, high))
            more.withColumn("at", stamp).drop("day").select("channel", "at", "section", "pos", F.col("rank").cast("double").alias("rank"), "title", "body", "url", "score", "override", "tier", "run").repartition(2).write.mode("append").parquet(source)
            sent.where(F.col("day").between(low, high) if low != "end" else F.lit(False)).withColumn("at", stamp).select("channel", "at", "run").coalesce(1).write.mode("append").parquet(deliveries)
            stream = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
            query = guarded(stream(source), stream(deliveries), PARTS, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert rounded(spark.read.parquet(str(tmp_path / "out")).where("channel <> 'end'").select(*[c.split()[0] for c in guard.DECISION.split(", ")])) == want
