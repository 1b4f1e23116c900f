"""The few items that lead an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.operators.ranking import Order, balanced_pick


def top_by_relevance(rows: DataFrame, in_body: Column, order: Order, n: int) -> DataFrame:
    """The n best rows, those in the body before all others."""
    return rows.orderBy(F.desc(F.coalesce(in_body, F.lit(False)).cast("int")), *order).limit(n)


def leading(rows: DataFrame, key: str, kind: str, eligible: Column, barred: Column, risk: Column, order: Order, target: int = 5) -> DataFrame:
    """key and role of what leads an issue: hero, must_read, risk and insight.

    The hero is the first row. Must-reads are balanced over kinds, among rows that are eligible and not barred. The
    risk is the first row that is one. Insights are balanced over the eligible rows that are neither. A row can
    have several roles, but is no insight beside another but hero. Null conditions don't hold.
    """
    eligible, barred, risk = (F.coalesce(c, F.lit(False)) for c in (eligible, barred, risk))
    must = balanced_pick(rows.where(eligible & ~barred), kind, order, target).select(key)
    at_risk = rows.where(risk).orderBy(*order).limit(1).select(key)
    taken = F.broadcast(must.unionByName(at_risk))  # target + 1 rows at most
    insight = balanced_pick(rows.where(eligible).join(taken, key, "left_anti"), kind, order, target).select(key)
    roles = {"hero": rows.orderBy(*order).limit(1).select(key), "must_read": must, "risk": at_risk, "insight": insight}
    out = None
    for role, picked in roles.items():
        picked = picked.withColumn("role", F.lit(role))
        out = picked if out is None else out.unionByName(picked)
    return out
