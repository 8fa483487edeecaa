"""Ids that stay: a registry of ``(kind, key, slug, id)``, merged run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.matching import must


def merge_pins(registry: DataFrame, arrivals: DataFrame, order: str) -> DataFrame:
    """The registry with the ``arrivals(kind, key, slug, order)``.

    Who is registered keeps the id, and an entity that comes with another slug has
    been renamed, which fails. Of new entities with one slug the first in the declared
    order (then by key) takes the slug itself if nobody holds it, the next
    ``slug-2`` and so on, counted on from those registered. An id that two entities would
    hold fails. The rows' order and partitions do not matter; repeated rows count once.
    """
    new = arrivals.groupBy("kind", "key").agg(F.min(F.struct(order, "slug")).alias("first_"), F.min("slug").alias("low_"), F.max("slug").alias("high_"))
    slug = must(F.col("low_") == F.col("high_"), F.col("first_.slug"), "an entity arrives with two slugs")
    new = new.select("kind", "key", slug.alias("now_"), F.col(f"first_.{order}").alias("order_"))
    met = registry.join(new, ["kind", "key"], "full_outer")
    kept = must(F.col("now_").isNull() | (F.col("now_") == F.col("slug")), F.col("id"), "a registered entity has another slug")
    held = F.col("id").isNotNull()
    met = met.select("kind", "key", F.coalesce("slug", "now_").alias("slug"), F.when(held, kept).alias("id"), "order_")
    # numbers go on after the holders of the same slug
    place = F.row_number().over(Window.partitionBy("kind", "slug").orderBy(F.col("id").isNull(), "order_", "key"))
    named = met.withColumn("id", F.coalesce("id", F.when(place == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), place.cast("string")))))
    alone = F.count("*").over(Window.partitionBy("kind", "id"))
    return named.withColumn("n_", alone).select("kind", "key", "slug", must(F.col("n_") == 1, F.col("id"), "two entities would hold one id").alias("id"))
