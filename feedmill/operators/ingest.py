"""Records of JSON that may be damaged: typed columns, what did not fit, and records that can't be used."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions.text import balanced_block, bound



@dataclass(frozen=True)
class Field:
    """A column of a record: its SQL type, the value where it is absent or bad, whether a record is unusable without it, the least number it may have, and a field that stands in for it."""

    name: str
    kind: str
    default: object = None
    required: bool = False
    least: float | None = None
    instead: str | None = None

    @property
    def path(self) -> str:
        return f"$.{self.name}"


#: Fields of a remembered event: without an id and its lists it can't be matched; numbers and days are set right.
EVENT = (
    Field("id", "string", required=True), Field("anchors", "array<string>", required=True), Field("topicTags", "array<string>", required=True), Field("samples", "array<variant>", required=True),
    Field("kind", "string", "generic"), Field("peakScore", "double", 0.0), Field("broadcastCount", "int", 1, least=1), Field("sections", "array<string>", ()), Field("broadcastedFacts", "array<string>", ()),
    Field("lastBroadcastAt", "date", instead="firstBroadcastAt"), Field("firstBroadcastAt", "date", instead="lastBroadcastAt"),
)


def _typed(variant: Column, field: Field) -> Column:
    """A field as its type, null if it is absent or another. Texts are no numbers, numbers no texts: what a cast would bend counts as bad."""
    value = F.try_variant_get(variant, field.path, field.kind)
    shape = F.schema_of_variant(F.try_variant_get(variant, field.path, "variant"))
    if field.kind in ("int", "long", "bigint", "double", "float"):
        value = F.when(shape.rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), value)
        if field.least is not None:
            value = F.when(value >= field.least, value)
    elif field.kind == "string":
        value = F.nullif(F.when(shape == "STRING", value), F.lit(""))
    elif field.kind == "date":
        text = F.try_variant_get(variant, field.path, "string")
        value = F.when(shape == "STRING", F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(text))))
    elif field.kind == "boolean":
        value = F.when(shape == "BOOLEAN", value)
    return value


def _default(field: Field) -> Column:
    made = F.array(*map(F.lit, field.default)) if isinstance(field.default, tuple) else F.lit(field.default)
    return made.cast(field.kind)


def ingested(rows: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """rows with a struct `record` of the fields, `bad` (names of the fields that were there and didn't fit, in order), `rescued` (map of these and of unknown fields to their JSON), and `reasons` why a record can't be used.

    A text that doesn't parse, is no object, or lacks a required field has a reason each and a null record; nothing
    crashes on any text. Bad and absent fields take their stand-in's value, else their default. Nulls count as absent.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(column))).withColumn("_shape", F.schema_of_variant("_v"))
    shaped = F.coalesce(F.col("_shape").startswith("OBJECT"), F.lit(False))
    ended = bound(F.trim(F.coalesce(F.col(column), F.lit(""))), lambda t: F.coalesce(balanced_block(t) == t, F.lit(False)))  # Spark's parser stops after the first value
    parsed = parsed.withColumn("_whole", shaped & ended)
    whole = F.col("_whole")
    typed = parsed.withColumn("_raw", F.when(whole, F.from_json(column, "map<string,string>"))).withColumn("_typed", F.when(whole, F.struct(*[_typed(F.col("_v"), f).alias(f.name) for f in fields])))
    there = lambda f: F.coalesce(F.try_element_at("_raw", F.lit(f.name)).isNotNull(), F.lit(False))
    bad = F.array_compact(F.array(*[F.when(there(f) & F.col("_typed")[f.name].isNull(), f.name) for f in fields]))
    known = [f.name for f in fields]
    values = []
    for f in fields:
        own = F.col("_typed")[f.name]
        values.append((F.coalesce(own, *([F.col("_typed")[f.instead]] if f.instead else []), *([_default(f)] if f.default is not None else []))).alias(f.name))
    lacking = [F.when(whole & F.col("_typed")[f.name].isNull(), F.lit(f"no {f.name}")) for f in fields if f.required]
    reasons = F.array_compact(F.array(F.when(F.col(column).isNull(), "null").when(F.col("_v").isNull(), "no JSON").when(~shaped, "no object").when(~whole, "no JSON"), *lacking))
    out = typed.withColumn("bad", F.when(whole, bad).otherwise(F.array().cast("array<string>"))).withColumn("reasons", reasons)
    out = out.withColumn("record", F.when(F.size("reasons") == 0, F.struct(*values)))
    odd = F.map_filter("_raw", lambda k, _: F.array_contains("bad", k) | ~k.isin(*known))
    return out.withColumn("rescued", F.coalesce(odd, F.create_map().cast("map<string,string>"))).drop("_v", "_shape", "_whole", "_raw", "_typed")


def usable(found: DataFrame) -> DataFrame:
    """Columns of the records that can be used, beside those of the rows."""
    return found.where(F.size("reasons") == 0).select(*[c for c in found.columns if c not in ("record", "reasons")], "record.*")


def quarantined(found: DataFrame) -> DataFrame:
    """The rows that can't be used, with their reasons."""
    return found.where(F.size("reasons") > 0).drop("record")


def revived(stores: DataFrame, column: str, fields: Sequence[Field] = EVENT) -> DataFrame:
    """ingested() of every record of stores that map keys to records, with `key`; a store that is no object gives one unusable row without key."""
    map_of = F.from_json(F.col(column), "map<string,string>")
    good = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("OBJECT"), F.lit(False)), map_of)
    each = stores.select(*[c for c in stores.columns if c != column], F.explode_outer(F.when(F.size(F.coalesce(good, F.create_map().cast("map<string,string>"))) > 0, good).otherwise(F.when(good.isNull(), F.create_map(F.lit(""), F.col(column))))).alias("key", "json"))
    return ingested(each.where(F.col("key").isNotNull()).withColumn("key", F.nullif("key", F.lit(""))), "json", fields)


