"""Joins, aggregates, rankings and clusters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vectors as V
from ..operators import matching as M
from ..operators import snapshots as N
from .binding import PHOTOS, PLACES, TURNS, photos, places, turns
from .registry import Tables, query

DOT = "list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))"
HASHES = "(SELECT vec_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) ELSE 0 END)), lambda a, b: a * 2 + b) // 1048576 AS h FROM embeddings)"


@query(f"""
WITH p AS (SELECT s_suppkey, lat + 0.1 AS lat, lon - 0.2 AS lon FROM {PLACES}), c AS (SELECT s_suppkey AS city, lat, lon, CAST(s_acctbal * 100 AS BIGINT) AS population FROM {PLACES} WHERE s_suppkey % 3 = 0),
d AS (SELECT s_suppkey, city, population, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(c.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(p.lon)) / 2), 2)))) AS km FROM p, c),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(km / (1 + 0.15 * log10(greatest(population, 10))), 9), city) AS r FROM d WHERE km <= 40)
SELECT s_suppkey, city, round(km, 3) AS km FROM r WHERE r = 1""")
def nearest_place(t: Tables) -> DataFrame:
    """Nearest city by distance and size, over one-degree cells."""
    p = places(t)
    points = p.select("s_suppkey", (F.col("lat") + 0.1).alias("lat"), (F.col("lon") - 0.2).alias("lon"))
    cities = p.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("city"), "lat", "lon", (F.col("s_acctbal") * 100).cast("long").alias("population"))
    return M.nearest_place(points, cities, "s_suppkey").select("s_suppkey", "city", F.round("km", 3).alias("km"))


@query(f"""
WITH t AS (SELECT *, event_id % 4 AS room FROM {TURNS}), s AS (SELECT * FROM t WHERE event_type = 'click'), v AS (SELECT * FROM t WHERE event_type <> 'click'),
o AS (SELECT s.event_id, v.event_id AS speaker, round(least(s.stop, v.stop) - greatest(s.start, v.start), 5) AS shared, v.start AS vs FROM s JOIN v ON s.room = v.room AND s.start < v.stop AND v.start < s.stop)
SELECT event_id, speaker, round(shared, 3) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY shared DESC, vs, speaker) AS r FROM o) WHERE r = 1""")
def overlap_speaker(t: Tables) -> DataFrame:
    """For each segment the turn that overlaps it most."""
    rows = turns(t).withColumn("room", F.pmod("event_id", F.lit(4)))
    side = lambda kind: rows.where(kind).select("room", F.col("event_id").alias("id"), "start", "stop")
    best = M.best_overlaps(side("event_type = 'click'"), side("event_type <> 'click'"), "room").withColumnRenamed("id", "event_id")
    best = best.groupBy("event_id").agg(F.min(F.struct((-F.round("shared", 5)).alias("s"), F.col("b_start").alias("at"), F.col("b_id").alias("speaker"))).alias("b"))
    return best.select("event_id", "b.speaker", F.round(-F.col("b.s"), 3).alias("shared"))


@query(f"""
WITH t AS (SELECT *, event_id % 4 AS room FROM {TURNS}), o AS (SELECT s.user_id, v.user_id AS face, s.event_id, least(s.stop, v.stop) - greatest(s.start, v.start) AS shared FROM t s JOIN t v ON s.room = v.room AND s.start < v.stop AND v.start < s.stop WHERE s.event_type = 'click' AND v.event_type = 'view'),
one AS (SELECT event_id FROM o WHERE shared >= 0.3 GROUP BY event_id HAVING count(DISTINCT face) = 1), w AS (SELECT user_id, face, sum(round(shared, 5)) AS w FROM o JOIN one USING (event_id) WHERE shared >= 0.3 GROUP BY 1, 2),
r AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS part, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 4) DESC, face) AS r FROM w)
SELECT user_id, face, round(part, 4) AS part FROM r WHERE r = 1 AND part >= 0.4""")
def vote_dominance(t: Tables) -> DataFrame:
    """Turns that one face alone overlaps vote for it; the dominant face is taken."""
    rows = turns(t).withColumn("room", F.pmod("event_id", F.lit(4)))
    side = lambda kind: rows.where(F.col("event_type") == kind).select("room", F.col("event_id").alias("id"), F.col("user_id").alias("who"), "start", "stop")
    pairs = M.few_overlaps(side("click"), side("view"), "room", 0.3).select(F.col("id").alias("event_id"), F.col("who").alias("user_id"), F.col("b_who").alias("face"), F.round("shared", 5).alias("shared"))
    one = pairs.groupBy("event_id").agg(F.min("face").alias("_a"), F.max("face").alias("_b")).where("_a = _b").select("event_id")
    best = M.dominant(pairs.join(one, "event_id"), "user_id", "face", "shared", 0.4)
    return best.select("user_id", "face", F.round("part", 4).alias("part"))


#: Every vector's hash, and that of a coarse copy of it (steps of 1/64), as a re-encoded picture has: (id, h), ids of copies below zero.
COPIED = """(SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 64), lambda i: CASE WHEN e[i] > e[i + 1] THEN CAST(1 AS BIGINT) ELSE 0 END)), lambda a, b: a * 2 + b) AS h
  FROM (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) FROM embeddings))"""


def copied(t: Tables) -> DataFrame:
    e, key = t("embeddings"), F.col("vec_id").cast("long")
    coarse = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    versions = F.array(F.struct(key.alias("id"), F.col("embedding").cast("array<double>").alias("e")), F.struct((-1 - key).alias("id"), coarse.alias("e")))
    return e.select(F.inline(versions)).select("id", V.sign_hash(F.col("e")).alias("h"))


@query(f"""
WITH h AS {COPIED} SELECT a, b, distance FROM (SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM (SELECT h, min(id) AS id FROM h GROUP BY h) x, (SELECT h, min(id) AS id FROM h GROUP BY h) y WHERE x.id < y.id) WHERE distance <= 3""")
def dup_bands(t: Tables) -> DataFrame:
    """Hashes within three bits, by two bands that lose none: a bucket is rows that share some thirty bits."""
    return M.hash_pairs(copied(t), "id", "h", 3, bits=63)


@query(f"""
WITH RECURSIVE h AS {COPIED}, n AS (SELECT h, min(id) AS id FROM h GROUP BY h), e AS (SELECT x.id AS a, y.id AS b FROM n x, n y WHERE x.id <> y.id AND bit_count(xor(x.h, y.h)) <= 3),
r AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def dup_components(t: Tables) -> DataFrame:
    """Connected components over near hashes."""
    return M.components(M.hash_pairs(copied(t), "id", "h", 3, bits=63), N.written)


@query(f"""
WITH p AS (SELECT *, sha1(text) AS h FROM {PHOTOS}), g AS (SELECT h, count(*) AS n, arg_max(path, size * 1000000 - doc_id) AS keep, CAST(sum(size) - max(size) AS BIGINT) AS extra, array_to_string(list(path ORDER BY path), ',') AS paths FROM p GROUP BY h HAVING count(*) > 1)
SELECT h, n, keep, extra, paths FROM g""")
def dup_groups_exact(t: Tables) -> DataFrame:
    """Groups of equal files with all their paths, what to keep and what it saves; a row holds its whole group's paths, as asked."""
    p = photos(t).select("doc_id", "path", "size", F.sha1("text").alias("h"))
    keep = F.max_by("path", F.struct("size", (-F.col("doc_id")).alias("d"))).alias("keep")
    paths = F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths")
    return p.groupBy("h").agg(F.count(F.lit(1)).alias("n"), keep, (F.sum("size") - F.max("size")).alias("extra"), paths).where("n > 1")


@query(f"""
WITH p AS (SELECT *, sha1(text) AS h FROM {PHOTOS}), d AS (SELECT * FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)), f AS (SELECT h, arg_max(path, size * 1000000 - doc_id) AS keep FROM d WHERE dir LIKE 'src1:%' GROUP BY h)
SELECT dir, count(*) AS n, count(DISTINCT h) AS groups, (SELECT count(*) FROM f) AS kept_in_scope FROM d GROUP BY dir ORDER BY n DESC, dir LIMIT 6""")
def dup_folders(t: Tables) -> DataFrame:
    """Folders with most copies; keepers inside one scope."""
    p = photos(t).select("path", "dir", "size", "doc_id", F.sha1("text").alias("h"))
    several = p.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    d = p.join(several, "h")
    kept = d.where(F.col("dir").startswith("src1:")).agg(F.count_distinct("h").alias("kept_in_scope"))
    top = d.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("groups")).orderBy(F.desc("n"), "dir").limit(6)
    return top.join(F.broadcast(kept), F.lit(True))


@query("""
WITH l AS (SELECT DISTINCT l_partkey % 60 AS g, l_orderkey FROM lineitem) SELECT g, other, files FROM (SELECT a.g, b.g AS other, count(*) AS files, row_number() OVER (PARTITION BY a.g ORDER BY count(*) DESC, b.g) AS r FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.g <> b.g GROUP BY 1, 2) WHERE r <= 3""")
def companions(t: Tables) -> DataFrame:
    """Who shares most files with whom, counting files."""
    rows = t("lineitem").select(F.pmod("l_partkey", F.lit(60)).alias("g"), "l_orderkey").distinct()
    pairs = rows.join(rows.withColumnRenamed("g", "other"), "l_orderkey").where("g <> other").groupBy("g", "other").agg(F.count(F.lit(1)).alias("files"))
    return M.best_per(pairs, ["g"], [F.desc("files"), F.col("other")], 3).drop("rank")


@query("""
SELECT l_orderkey, count(DISTINCT p_brand) AS found FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def all_of(t: Tables) -> DataFrame:
    """Files with several of the named people."""
    named = t("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_partkey", "p_brand")
    rows = t("lineitem").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.count_distinct("p_brand").alias("found")).where("found >= 2")


@query("""
SELECT doc_id, person FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS r FROM (SELECT doc_id, 1 AS rank, 'manual' AS person FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 2, 'face' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 3, 'voice' FROM documents WHERE lang = 'en')) WHERE r = 1""")
def evidence_priority(t: Tables) -> DataFrame:
    """The strongest of three kinds of evidence."""
    said = lambda df, rank, name: df.select("doc_id", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("person")).alias("e"))
    rows = said(t("labels").where("quality = 0"), 1, "manual").union(said(t("labels").where("toxic = 1"), 2, "face")).union(said(t("documents").where("lang = 'en'"), 3, "voice"))
    return rows.groupBy("doc_id").agg(F.min("e").alias("e")).select("doc_id", "e.person")


@query("""
WITH f AS (SELECT l_orderkey, min(l_partkey) AS first, count(*) AS faces FROM lineitem GROUP BY 1) SELECT o_orderkey, first, coalesce(faces, 0) AS faces, c_name, n_name, r_name FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def star_hydrate(t: Tables) -> DataFrame:
    """Left joins round a file; many-sided tables are aggregated first."""
    faces = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"), F.count(F.lit(1)).alias("faces"))
    rows = t("orders").join(faces, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("o_orderkey", "first", F.coalesce("faces", F.lit(0)).alias("faces"), "c_name", "n_name", "r_name")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY')""")
def anti_joins(t: Tables) -> DataFrame:
    """Rows without any of several marks."""
    rows = t("orders").join(t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    return rows.join(t("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, year(o_orderdate) AS y FROM orders), p AS (SELECT o_custkey, y - y % 3 AS period, round(sum(o_totalprice), 2) AS mean FROM o GROUP BY 1, 2)
SELECT o_orderkey, period, mean FROM (SELECT o_orderkey, p.period, p.mean, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(p.period - (y + 2)), p.period) AS r FROM o JOIN p ON p.o_custkey = o.o_custkey) WHERE r = 1""")
def nearest_period(t: Tables) -> DataFrame:
    """The profile period nearest to a year."""
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    profiles = o.groupBy("o_custkey", (F.col("y") - F.col("y") % 3).alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("mean"))
    best = o.join(profiles, "o_custkey").groupBy("o_orderkey").agg(F.min(F.struct(F.abs(F.col("period") - F.col("y") - 2).alias("d"), "period", "mean")).alias("b"))
    return best.select("o_orderkey", "b.period", "b.mean")


@query(f"""
SELECT a.label, b.label AS other, round({DOT.format(a="a.v", b="b.v")}, 6) AS sim FROM (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1) a,
(SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1) b WHERE a.label < b.label""")
def pairs_threshold(t: Tables) -> DataFrame:
    """Similarities between group centroids."""
    means = t("embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    sims = M.bank_scores(v.select(F.col("label").alias("q"), "v"), v.select(F.col("label").alias("person"), F.col("label").alias("sample"), F.col("v").alias("p")))
    return sims.where("q < person").select(F.col("q").alias("label"), F.col("person").alias("other"), "sim")


KNN = f"s AS (SELECT a.vec_id AS q, b.label AS person, b.vec_id AS sample, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0)"


def _named(t: Tables, best: int) -> DataFrame:
    e = t("embeddings")
    bank = e.where("vec_id % 3 = 0").select(F.col("label").alias("person"), F.col("vec_id").alias("sample"), F.col("embedding").alias("p"))
    return M.bank_scores(e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), bank, best=best)


@query(f"""
WITH {KNN} SELECT q, sample, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, sample) AS r FROM s) WHERE r = 1""")
def knn_named(t: Tables) -> DataFrame:
    """The nearest named sample of each unnamed vector."""
    best = _named(t, 1).groupBy("q").agg(F.max(F.struct("sim", (-F.col("sample")).alias("s"))).alias("b"))
    return best.select("q", (-F.col("b.s")).alias("sample"), "b.sim")


@query(f"""
WITH {KNN}, p AS (SELECT q, person, round(avg(sim), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q, person ORDER BY sim DESC, sample) AS r FROM s) WHERE r <= 3 GROUP BY 1, 2),
m AS (SELECT *, lead(score) OVER (PARTITION BY q ORDER BY score DESC, person) AS second, row_number() OVER (PARTITION BY q ORDER BY score DESC, person) AS r FROM p)
SELECT q, person, round(score, 4) AS score FROM m WHERE r = 1 AND score - coalesce(second, -1) >= 0.03""")
def top3_margin(t: Tables) -> DataFrame:
    """The person of best mean of three samples, if the runner-up is well behind."""
    top = M.best_per(_named(t, 3), ["q", "person"], [F.desc("sim"), F.col("sample")], 3)
    scores = top.groupBy("q", "person").agg(F.round(F.avg("sim"), 6).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "person")
    ranked = scores.withColumn("second", F.lead("score").over(order)).withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") == 1).where(F.col("score") - F.coalesce("second", F.lit(-1.0)) >= 0.03).select("q", "person", F.round("score", 4).alias("score"))


@query(f"""
WITH s AS (SELECT a.vec_id AS q, b.label AS person, {DOT.format(a='a.embedding', b='b.embedding')} AS sim FROM embeddings a, embeddings b WHERE a.vec_id // 10 <> b.vec_id // 10)
SELECT q, person, round(avg(sim), 5) AS score FROM s GROUP BY 1, 2""")
def leave_one_out(t: Tables) -> DataFrame:
    """Every vector against prototypes from other files only."""
    e = t("embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("file"), "embedding")
    return M.leave_one_out(e).select("q", "person", F.round("score", 5).alias("score"))


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) UNION SELECT event_id, event_id + 1 FROM events WHERE event_id % 500 = 0""")
def cannot_link(t: Tables) -> DataFrame:
    """Pairs of one moment that can't be one person, with manual ones."""
    rows = t("events").select("event_id", "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    pairs = rows.withColumnRenamed("event_id", "a").join(rows.withColumnRenamed("event_id", "b"), ["user_id", "h"]).where("a < b").select("a", "b")
    return pairs.union(t("events").where("event_id % 500 = 0").select("event_id", F.col("event_id") + 1)).distinct()


@query("""
SELECT o_orderpriority AS source, o_orderstatus AS model, count(*) AS reviews, CAST(sum(CASE WHEN p AND y THEN 1 ELSE 0 END) AS BIGINT) AS tp, round(sum(CASE WHEN p AND y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p THEN 1 ELSE 0 END), 0), 6) AS precision, round(sum(CASE WHEN p AND y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y THEN 1 ELSE 0 END), 0), 6) AS recall
FROM (SELECT *, o_totalprice > 200000 AS p, c_acctbal > 3000 AS y FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2""")
def label_quality(t: Tables) -> DataFrame:
    """Precision and recall by source."""
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumns({"p": F.col("o_totalprice") > 200000, "y": F.col("c_acctbal") > 3000})
    hits = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = rows.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("reviews"), hits(F.col("p") & F.col("y")).alias("tp"), hits(F.col("p")).alias("_p"), hits(F.col("y")).alias("_y"))
    part = lambda c: F.round(F.when(F.col(c) > 0, F.col("tp") / F.col(c)), 6)
    return g.select("source", "model", "reviews", "tp", part("_p").alias("precision"), part("_y").alias("recall"))


@query("""
SELECT l_orderkey, round(avg(abs(l_discount * 10 - 0.5)), 6) AS uncertainty, max(l_tax) AS top FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 ORDER BY round(avg(abs(l_discount * 10 - 0.5)), 6), l_orderkey LIMIT 40""")
def uncertainty_queue(t: Tables) -> DataFrame:
    """What to review next: least certain first, without what is reserved."""
    free = t("lineitem").join(t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    g = free.groupBy("l_orderkey").agg(F.round(F.avg(F.abs(F.col("l_discount") * 10 - 0.5)), 6).alias("uncertainty"), F.max("l_tax").alias("top"))
    return g.orderBy("uncertainty", "l_orderkey").limit(40)


@query("""
WITH m AS (SELECT o_orderkey, o_orderdate, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') THEN p_brand ELSE '~none' END AS g FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
d AS (SELECT DISTINCT * FROM m) SELECT g, count(*) AS n, max(o_orderdate) AS newest, min(o_orderdate) AS oldest, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[1:4], ',') AS covers FROM d GROUP BY g""")
def multi_group_cards(t: Tables) -> DataFrame:
    """Groups that a file may be in several of, with covers and a bucket for none."""
    brands = t("part").where(F.col("p_brand").isin(*(f"Brand#{i}" for i in (1, 2, 3, 4)))).select("p_partkey", "p_brand")
    member = t("lineitem").select("l_orderkey", "l_partkey").join(brands, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", F.coalesce("p_brand", F.lit("~none")).alias("g")).distinct()
    rows = t("orders").join(member, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderdate", F.coalesce("g", F.lit("~none")).alias("g"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"), F.min("o_orderdate").alias("oldest"))
    covers = M.best_per(rows, ["g"], [F.desc("o_orderdate"), F.col("o_orderkey")], 4)
    covers = covers.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("covers"))
    return counts.join(covers, "g")


@query("""
SELECT r.source, files, small, faces FROM (SELECT source, count(*) AS files, CAST(sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM documents GROUP BY 1) r LEFT JOIN (SELECT source, count(*) AS faces FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1) l USING (source)""")
def storage_by_source(t: Tables) -> DataFrame:
    """Counters per source from several tables."""
    d = t("documents")
    a = d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("n_chars") < 500, 1).otherwise(0)).alias("small"))
    b = d.select("source", "doc_id").join(t("labels").where("quality = 1"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("faces"))
    return a.join(b, "source", "full_outer")


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS r FROM c)
SELECT o_custkey, v, n, round(n / total, 6) AS share FROM s WHERE r = 1 AND n / total >= 0.4 AND n >= 3""")
def majority(t: Tables) -> DataFrame:
    """The most frequent value where it is frequent enough."""
    c = t("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("o_custkey").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b"))
    share = -F.col("b.m") / F.col("total")
    return g.where((share >= 0.4) & (-F.col("b.m") >= 3)).select("o_custkey", "b.v", (-F.col("b.m")).alias("n"), F.round(share, 6).alias("share"))


@query("""
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS m, round(greatest(0, least(1, (o_totalprice - 1000) / 400000)), 6) AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, o_orderkey) AS r FROM o)
SELECT m, count(*) AS n, count(DISTINCT o_custkey) AS people, round(avg(CASE WHEN r <= 5 THEN score END) * (0.75 + 0.25 * least(1, count(DISTINCT o_custkey) / 50.0)), 6) AS score, min(CASE WHEN r = 1 THEN o_orderkey END) AS cover FROM r GROUP BY m""")
def top5_breadth(t: Tables) -> DataFrame:
    """Group score from its five best and its breadth."""
    o = t("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.round(S.ramp(F.col("o_totalprice"), 1000, 401000), 6).alias("score"))
    whole = o.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("people"))
    best = M.best_per(o, ["m"], [F.desc("score"), F.col("o_orderkey")], 5).groupBy("m").agg(F.avg("score").alias("mean"), F.min(F.when(F.col("rank") == 1, F.col("o_orderkey"))).alias("cover"))
    score = F.col("mean") * (0.75 + 0.25 * F.least(F.lit(1.0), F.col("people") / 50.0))
    return whole.join(best, "m").select("m", "n", "people", F.round(score, 6).alias("score"), "cover")


@query("""
WITH a AS (SELECT event_type || '>' || coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'end') AS change FROM events) SELECT change, count(*) AS n FROM a GROUP BY 1""")
def change_counts(t: Tables) -> DataFrame:
    """How often a state follows another."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select(F.concat("event_type", F.lit(">"), F.coalesce(after, F.lit("end"))).alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT label, vec_id % 7 AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT cluster, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 6) AS purity, count(*) AS labels FROM c GROUP BY cluster""")
def cluster_purity(t: Tables) -> DataFrame:
    """Purity and mixture of clusters."""
    c = t("embeddings").groupBy("label", F.pmod("vec_id", F.lit(7)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cluster").agg(F.sum("n").alias("size"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"), F.count(F.lit(1)).alias("labels"))


@query("""
SELECT count(*) AS events, count(value) AS known, max(ts) AS latest, count(DISTINCT coalesce('person:' || CASE WHEN user_id % 2 = 0 THEN user_id END, 'identity:' || event_type)) AS identities, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM events""")
def summary_counters(t: Tables) -> DataFrame:
    """Counters and stamps in one pass."""
    identity = F.coalesce(F.concat(F.lit("person:"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).cast("string")), F.concat(F.lit("identity:"), F.col("event_type")))
    return t("events").agg(F.count(F.lit(1)).alias("events"), F.count("value").alias("known"), F.max("ts").alias("latest"), F.count_distinct(identity).alias("identities"), F.sum(F.when(F.col("value") > 10, 1).otherwise(0)).alias("large"))


@query("""
SELECT doc_id, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 = 0 AS validation FROM documents""")
def hash_split(t: Tables) -> DataFrame:
    """Validation rows by a hash of their group."""
    return t("documents").select("doc_id", (F.conv(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0).alias("validation"))


@query("""
WITH s AS (SELECT event_id, user_id, ts, value, sum(CASE WHEN gap IS NULL OR gap > 18000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events))
SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n, min(event_id) AS first FROM s GROUP BY user_id, n""")
def sessions(t: Tables) -> DataFrame:
    """Events of a user that follow within five hours (W1 time rule, ST4)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)) / 1e6
    rows = t("events").withColumn("gap", gap)
    rows = rows.withColumn("s", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 18000), 1).otherwise(0)).over(order))
    return rows.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).drop("s")


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS u FROM events) WHERE r <= 60 OR u <= 2""")
def shortlist(t: Tables) -> DataFrame:
    """The best overall, and up to two of each event."""
    e = t("events").select("event_id", "user_id", "value")
    top = e.orderBy(F.desc("value"), "event_id").limit(60)
    return top.select("event_id").union(M.best_per(e, ["user_id"], [F.desc("value"), F.col("event_id")], 2).select("event_id")).distinct()


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 900000000 AND (a.ts < b.ts OR a.event_id < b.event_id)""")
def time_neighbours(t: Tables) -> DataFrame:
    """Pairs of one folder within a few minutes."""
    s = t("events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = s.withColumn("slot", F.floor(F.col("us") / 900000000))
    ahead = s.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") - 1))).select("user_id", "slot", F.col("event_id").alias("b"), F.col("us").alias("later"))
    gap = F.col("later") - F.col("us")
    pairs = s.join(ahead, ["user_id", "slot"]).where((F.col("event_id") != F.col("b")) & gap.between(0, 900000000) & ((gap > 0) | (F.col("event_id") < F.col("b"))))
    return pairs.select(F.col("event_id").alias("a"), "b")


@query("""
SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, event_id LIMIT 25 OFFSET 50""")
def priority_page(t: Tables) -> DataFrame:
    """A page in an order of priorities."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t("events").orderBy(rank, F.desc("value"), "event_id").offset(50).limit(25).select("event_id", "event_type")


@query("""
SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = d.doc_id)) AS unlabelled, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown FROM documents d""")
def set_validation(t: Tables) -> DataFrame:
    """What is expected and missing, and what is there unasked."""
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    missing = a.join(b, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    return missing.join(F.broadcast(b.join(a, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))), F.lit(True))
