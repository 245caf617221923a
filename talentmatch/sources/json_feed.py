"""A10: JSON job feeds -> job rows.

A feed body must be a JSON array whose elements are all objects; anything
else yields no rows for that feed (the application's comprehension raises
on a non-object element and returns an empty list).  A key that is absent
takes its default; a key present with JSON null stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmatch.functions import constants as K


def flatten_job_feed(feeds: DataFrame, *, feed_id: str = "feed_id", body: str = "body",
                     scrape_date: str = "2025-08-17") -> DataFrame:
    """``(feed_id, item_no, title, company, location, link, source,
    date_scraped)``."""
    elems = F.from_json(F.col(body), "array<string>")
    all_objects = F.forall(elems, lambda e: F.ltrim(e).startswith("{"))
    items = (feeds.select(F.col(feed_id).alias("feed_id"),
                          F.when(all_objects, elems).alias("elems"))
             .select("feed_id", F.posexplode("elems").alias("item_no", "item"))
             .select("feed_id", F.col("item_no").cast("int").alias("item_no"),
                     F.from_json("item", "map<string,string>").alias("m")))
    m = F.col("m")
    fields = [F.when(F.map_contains_key(m, F.lit(key)), m[key]).otherwise(F.lit(default))
              .alias(name) for name, key, default in K.FEED_FIELDS]
    return items.select("feed_id", "item_no", *fields,
                        F.lit(K.SOURCE_FEED).alias("source"),
                        F.to_date(F.lit(scrape_date)).alias("date_scraped"))
