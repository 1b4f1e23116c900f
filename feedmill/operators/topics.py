"""Topics over dated, tagged items: one main tag for each item, groups that span days, quality, related tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmill.functions import text


def dedupe_items(items: DataFrame) -> DataFrame:
    """One row of each id from (id, date, section, tags, title, summary, importance): earliest date, all tags and dates, fields of the most informative version, repeats."""
    info = F.length(F.coalesce("summary", F.lit(""))) + 20 * F.coalesce("importance", F.lit(1)) + F.least(F.lit(20), F.length(F.coalesce("title", F.lit(""))))
    best = F.struct(info.alias("i"), (-F.datediff("date", F.lit("1970-01-01"))).alias("d"), F.coalesce("title", F.lit("")).alias("t"))
    return items.groupBy("id").agg(
        F.min("date").alias("date"), F.array_sort(F.collect_set("date")).alias("seen_dates"), F.count("*").alias("repeat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.max_by("title", best).alias("title"), F.max_by("section", best).alias("section"), F.max_by("importance", best).alias("importance"),
    )


def slim(items: DataFrame, most: int = 90) -> DataFrame:
    """id, date, section, title, source, importance, tags, summary of issue items (id, date, section, title_cn, title_orig, source, importance, tags, summary): what a search over issues keeps.

    The translated title counts, else the original; summaries are clipped; null importance is 1; empty tags go. Rows without an id are left out.
    """
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    title = F.coalesce(F.nullif("title_cn", F.lit("")), "title_orig", F.lit(""))
    return items.where("id is not null and id <> ''").select("id", "date", "section", title.alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("importance", F.lit(1)).alias("importance"), tags.alias("tags"), text.clip(F.col("summary"), most).alias("summary"))


def tag_frequency(nodes: DataFrame) -> DataFrame:
    """tag, n (items), n_section (items in its commonest section), n_all (items in all)."""
    by_section = nodes.select(F.explode("tags").alias("tag"), "section").groupBy("tag", "section").agg(F.count("*").alias("n"))
    out = by_section.groupBy("tag").agg(F.sum("n").alias("n"), F.max("n").alias("n_section"))
    return out.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_all"))))  # one row


def cluster(nodes: DataFrame, labels: DataFrame, min_dates: int = 2, common: float = 0.35, concentrated: float = 0.8) -> DataFrame:
    """tag, label, id, seen_dates, importance: members of the topics.

    labels (tag, label) may name a topic. A tag that three items and `common` of all carry is too common, unless
    `concentrated` of its items are in one section. Each item belongs to its rarest fitting tag (by name at a tie);
    a topic has two items and min_dates dates at least.
    """
    freq = tag_frequency(nodes)
    fit = freq.where(~((F.col("n") >= 3) & (F.col("n") / F.col("n_all") >= common) & (F.col("n_section") / F.col("n") < concentrated))).join(labels, "tag")
    own = nodes.select("id", "seen_dates", "importance", F.explode("tags").alias("tag")).join(fit.select("tag", "label", "n"), "tag")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "tag"))
    main = own.withColumn("_rank", rank).where("_rank = 1").select("tag", "label", "id", "seen_dates", "importance")
    dates = main.select("tag", "id", F.explode("seen_dates").alias("date")).groupBy("tag").agg(F.countDistinct("date").alias("_dates"), F.countDistinct("id").alias("_items"))
    return main.join(dates.where((F.col("_dates") >= min_dates) & (F.col("_items") >= 2)).select("tag"), "tag", "left_semi")


def topics(nodes: DataFrame, labels: DataFrame, today: Column, most: int = 30, **options) -> DataFrame:
    """tag, label, n_items, n_dates, first_date, last_date, span_days, quality (0 to 100), active, dormant of the largest topics."""
    members = cluster(nodes, labels, **options)
    dated = members.select("tag", F.explode("seen_dates").alias("date")).groupBy("tag").agg(F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    sized = members.groupBy("tag", "label").agg(F.count("*").alias("n_items"), F.max("importance").alias("top"))
    out = sized.join(dated, "tag").withColumn("span_days", F.datediff("last_date", "first_date") + 1)
    age = F.greatest(F.datediff(today, "last_date"), F.lit(0))
    continuity = 0.7 * F.least(F.lit(1.0), F.col("n_dates") / 12) + 0.3 * F.least(F.lit(1.0), F.col("n_dates") / F.greatest(F.lit(1.0), F.col("span_days") * 0.5))
    recency = F.greatest(F.lit(0.0), 1 - age / 90)
    importance = 0.6 * F.least(F.lit(1.0), F.coalesce("top", F.lit(1)) / 3) + 0.4 * F.least(F.lit(1.0), F.col("n_items") / 12)
    quality = F.floor(100 * (0.4 * continuity + 0.25 * recency + 0.25 * importance + 0.1) + 0.5)
    out = out.withColumn("quality", quality).withColumn("active", age <= 7).withColumn("dormant", age >= 90).drop("top")
    return out.orderBy(F.desc("n_items"), "label").limit(most)


def related_tags(nodes: DataFrame, labels: DataFrame, cover: float = 0.4, rare: float = 0.15, most: int = 3, **options) -> DataFrame:
    """tag, related, cover, rank: tags that `cover` of a topic's items carry and less than `rare` of all, those that set it off most first."""
    members = cluster(nodes, labels, **options).select(F.col("tag").alias("main"), "id")
    size = members.groupBy("main").agg(F.count("*").alias("size"))
    carried = members.join(nodes.select("id", F.explode("tags").alias("related")), "id").where("related <> main").groupBy("main", "related").agg(F.count("*").alias("n"))
    freq = tag_frequency(nodes).select(F.col("tag").alias("related"), (F.col("n") / F.col("n_all")).alias("share"))
    out = carried.join(size, "main").join(freq, "related").withColumn("cover", F.col("n") / F.col("size")).where((F.col("cover") >= cover) & (F.col("share") < rare))
    rank = F.row_number().over(Window.partitionBy("main").orderBy(F.desc(F.col("cover") - F.col("share")), "related"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("main").alias("tag"), "related", "cover", "rank")


def corpus_stats(items: DataFrame) -> DataFrame:
    """One row: days, items, items on more than one day, first and last day."""
    each = items.groupBy("id").agg(F.countDistinct("date").alias("n"))
    return items.agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")).crossJoin(each.agg(F.count("*").alias("items"), F.sum((F.col("n") > 1).cast("long")).alias("repeated")))  # one row each
