"""The catalogue's tables as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: One file per document.
PHOTOS = """(SELECT doc_id, source || ':/' || lang || '/' || doc_id || CASE WHEN n_chars > 3000 THEN '.MP4' ELSE '.jpg' END AS path,
  source || ':/' || lang AS dir, source, lang, n_chars AS size, doc_id * 1000 AS modified, text FROM documents)"""


def photos(t: Tables) -> DataFrame:
    d = t("documents")
    folder = F.concat("source", F.lit(":/"), "lang")
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") > 3000, F.lit(".MP4")).otherwise(F.lit(".jpg")))
    return d.select("doc_id", path.alias("path"), folder.alias("dir"), "source", "lang", F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("modified"), "text")


def photos_under(t: Tables, folder: str) -> DataFrame:
    """The files of a folder `source:/...`. Paths are computed here, so the source is tested by itself as well: that reaches the scan."""
    return photos(t).where(F.col("source").startswith(folder.split(":")[0]) & F.col("path").startswith(folder))


#: One place per supplier, from its key by plain arithmetic.
PLACES = "(SELECT s_suppkey, s_name, s_acctbal, CAST((s_suppkey * 37) % 120 - 60 AS DOUBLE) + 0.25 AS lat, CAST((s_suppkey * 53) % 300 - 150 AS DOUBLE) + 0.5 AS lon FROM supplier)"


def places(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return t("supplier").select("s_suppkey", "s_name", "s_acctbal", (F.pmod(key * 37, F.lit(120)) - 60 + F.lit(0.25)).cast("double").alias("lat"), (F.pmod(key * 53, F.lit(300)) - 150 + F.lit(0.5)).cast("double").alias("lon"))


#: Intervals: an event lasts to its user's next one, an hour at most.
TURNS = """(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS start,
  least(epoch_us(ts) / 1e6 + 3600, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6, epoch_us(ts) / 1e6 + 3600)) AS stop FROM events)"""


def turns(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = micros / F.lit(1e6)
    after = F.lead(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) / F.lit(1e6)
    return t("events").select("event_id", "user_id", "event_type", "value", start.alias("start"), F.least(start + 3600, F.coalesce(after, start + 3600)).alias("stop"))


#: Albums: regions over nations over customers, by keys that don't meet.
ALBUMS = """(SELECT r_regionkey AS id, CAST(NULL AS BIGINT) AS parent, r_name AS title FROM region
  UNION ALL SELECT 100 + n_nationkey, CAST(n_regionkey AS BIGINT), n_name FROM nation
  UNION ALL SELECT 1000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), c_name FROM customer)"""


def albums(t: Tables) -> DataFrame:
    long = lambda c: F.col(c).cast("long")
    top = t("region").select(long("r_regionkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("title"))
    middle = t("nation").select((long("n_nationkey") + 100).alias("id"), long("n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    return top.union(middle).union(t("customer").select((long("c_custkey") + 1000).alias("id"), (long("c_nationkey") + 100).alias("parent"), F.col("c_name").alias("title")))
