"""Composite reads: scores of a file, groups, cards, merged catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vectors as V
from ..operators import matching as M
from .registry import Tables, query


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(1, (ln(l_quantity * 20) - ln(25)) / (ln(600) - ln(25)))) AS sharp, greatest(0, least(1, (log2(l_extendedprice / 10000) - 0) / 4)) AS res,
  CASE WHEN l_returnflag <> 'A' THEN l_discount * 10 END AS expo FROM lineitem),
t AS (SELECT *, (0.4 * sharp + 0.2 * res + coalesce(0.2 * expo, 0)) / (0.6 + CASE WHEN expo IS NULL THEN 0 ELSE 0.2 END) AS technical FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(technical, 5) AS technical, round(0.55 * coalesce(expo, 0.25) + 0.45 * technical, 5) AS base FROM t""")
def curation_score(t: Tables) -> DataFrame:
    """Technical and base score of a file from its known parts."""
    sharp = S.ramp(F.log(F.col("l_quantity") * 20), 3.2188758248682006, 6.396929655216146)
    res = S.ramp(F.log2(F.col("l_extendedprice") / 10000), 0.0, 4.0)
    expo = F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 10)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expo.alias("expo"), S.known_mean([(sharp, 0.4), (res, 0.2), (expo, 0.2)]).alias("technical"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("technical", 5).alias("technical"), F.round(0.55 * F.coalesce("expo", F.lit(0.25)) + 0.45 * F.col("technical"), 5).alias("base"))


@query("""
SELECT event_id, label, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY value DESC, event_id) AS r FROM (SELECT event_id, user_id, event_type AS label, value, CASE WHEN event_id % 2 = 0 THEN 'trained' ELSE 'zero-shot' END AS source FROM events)
WHERE value >= CASE source WHEN 'trained' THEN 10 ELSE 20 END) WHERE r <= CASE source WHEN 'trained' THEN 8 ELSE 4 END""")
def suggested_labels(t: Tables) -> DataFrame:
    """Labels above their source's threshold, a few of each."""
    trained = F.col("event_id") % 2 == 0
    rows = t("events").select("event_id", "user_id", F.col("event_type").alias("label"), "value", F.when(trained, "trained").otherwise("zero-shot").alias("source"))
    rows = rows.where(F.col("value") >= F.when(F.col("source") == "trained", 10).otherwise(20))
    best = M.best_per(rows, ["user_id", "source"], [F.desc("value"), F.col("event_id")], 8)
    return best.where(F.col("rank") <= F.when(F.col("source") == "trained", 8).otherwise(4)).select("event_id", "label", "source")


@query("""
SELECT g, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'excluded' WHEN vec_id % 7 = 0 THEN 'blurry' WHEN vec_id % 3 = 0 THEN 'person:' || label WHEN label < 5 THEN 'auto:' || label ELSE 'noise' END AS g FROM embeddings) GROUP BY g""")
def face_groups(t: Tables) -> DataFrame:
    """Named, automatic, noise, blurry and excluded members."""
    k, label = F.col("vec_id"), F.col("label").cast("string")
    group = F.when(k % 11 == 0, "excluded").when(k % 7 == 0, "blurry").when(k % 3 == 0, F.concat(F.lit("person:"), label)).when(F.col("label") < 5, F.concat(F.lit("auto:"), label)).otherwise("noise")
    return t("embeddings").groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


@query("""
WITH m AS (SELECT l_partkey AS g, l_orderkey AS path, l_linenumber AS pick FROM lineitem), v AS (SELECT m.* FROM m JOIN orders ON o_orderkey = path WHERE o_orderstatus <> 'F')
SELECT g, count(DISTINCT path) AS n, arg_min(path, pick * 10000000 + path) AS cover FROM v GROUP BY g""")
def visible_highlights(t: Tables) -> DataFrame:
    """Groups without what a viewer may not see, recounted, with the first visible cover."""
    return _visible(t, t("lineitem"))


def _visible(t: Tables, lines: DataFrame) -> DataFrame:
    members = lines.select(F.col("l_partkey").alias("g"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pick"))
    seen = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("path"))
    return members.join(seen, "path").groupBy("g").agg(F.count_distinct("path").alias("n"), F.min_by("path", F.struct("pick", "path")).alias("cover"))


@query("""
WITH c AS (SELECT vec_id, vec_id % 50 AS g FROM embeddings), s AS (SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform((SELECT embedding FROM embeddings WHERE vec_id = 7), lambda x: CAST(x AS DOUBLE))), 6) AS sim FROM embeddings)
SELECT s.vec_id, sim FROM s JOIN c ON c.vec_id = s.vec_id WHERE c.g <> 7 ORDER BY sim DESC, s.vec_id LIMIT 20""")
def similar_files(t: Tables) -> DataFrame:
    """Most similar files without a file's own copies."""
    e = t("embeddings")
    probe = F.broadcast(e.where("vec_id = 7").select(F.col("embedding").alias("p")))  # one row
    rows = e.where("vec_id % 50 <> 7").join(probe, F.lit(True)).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("p")), 6).alias("sim"))
    return rows.orderBy(F.desc("sim"), "vec_id").limit(20)


@query("""
SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, 'own' AS origin FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + 1 + s_suppkey, s_name, 'other' FROM supplier""")
def merged_catalogues(t: Tables) -> DataFrame:
    """A second catalogue under ids after the first's."""
    top = F.broadcast(t("customer").agg((F.max("c_custkey") + 1).alias("top")))  # one row
    other = t("supplier").join(top, F.lit(True)).select((F.col("top") + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("other").alias("origin"))
    return t("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.lit("own").alias("origin")).union(other)


@query("""
SELECT o_custkey AS roots, count(*) AS runs, max(o_orderdate) AS latest, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS done FROM orders GROUP BY 1""")
def run_history(t: Tables) -> DataFrame:
    """Runs of the same roots with all that they did."""
    return t("orders").groupBy(F.col("o_custkey").alias("roots")).agg(F.count(F.lit(1)).alias("runs"), F.max("o_orderdate").alias("latest"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("done"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'none' WHEN l.quality = 1 THEN 'verified' WHEN d.n_chars > 2000 THEN 'suggested' ELSE 'none' END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def card_labels(t: Tables) -> DataFrame:
    """A verified negative hides a suggested label."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality") == 0, "none").when(F.col("quality") == 1, "verified").when(F.col("n_chars") > 2000, "suggested").otherwise("none").alias("label"))


@query("""
SELECT o_orderstatus AS version, o_orderstatus = 'F' AS active, count(*) AS n FROM orders GROUP BY 1""")
def active_version(t: Tables) -> DataFrame:
    """One version is active."""
    return t("orders").groupBy(F.col("o_orderstatus").alias("version"), (F.col("o_orderstatus") == "F").alias("active")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, source FROM documents WHERE source <> 'src3' OR doc_id NOT IN (SELECT doc_id FROM labels)""")
def cleaned_source(t: Tables) -> DataFrame:
    """One category's rows of one source are removed (T16, T8 cascade)."""
    gone = t("labels").join(t("documents").where("source = 'src3'").select("doc_id"), "doc_id", "left_semi").select("doc_id")
    return t("documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")
