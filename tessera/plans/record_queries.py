"""Stacks, scores, merged catalogues and upkeep of records, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import merging as G
from ..operators import records as R
from ..operators import scores as C
from ..operators import stacks as K
from .binding import ALBUMS, PHOTOS, albums, photos
from .match_queries import DOT, HASHES
from .registry import Tables, query


@query(f"""
WITH RECURSIVE f AS (SELECT vec_id AS id, vec_id % 7 = 0 AS video, vec_id // 21 AS path, label AS folder, vec_id // 3 AS taken, (vec_id * 37) % 100 AS blur, h, embedding FROM embeddings JOIN {HASHES} USING (vec_id)),
e AS (SELECT x.id AS a, y.id AS b FROM f x, f y WHERE x.id <> y.id AND CASE WHEN x.video <> y.video THEN false WHEN x.video THEN x.path = y.path ELSE bit_count(xor(x.h, y.h)) <= 4 OR (x.folder = y.folder AND bit_count(xor(x.h, y.h)) <= 10)
  OR (x.folder = y.folder AND abs(x.taken - y.taken) <= 3 AND {DOT.format(a='x.embedding', b='y.embedding')} >= 0.6) END),
r AS (SELECT id AS node, id AS root FROM f UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
t AS (SELECT root, arg_min(id, blur * 1000000 + id) AS top FROM c JOIN f ON f.id = c.node GROUP BY root)
SELECT node AS id, top FROM c JOIN t USING (root)""")
def face_stacks(t: Tables) -> DataFrame:
    """Stacks of faces by video, hash, folder and moment."""
    k = F.col("vec_id")
    rows = t("embeddings").select(
        k.alias("id"), F.floor(k / 21).cast("string").alias("path"), F.when(k % 7 == 0, "video").otherwise("photo").alias("kind"), F.col("label").cast("string").alias("folder"), F.floor(k / 3).cast("double").alias("taken"),
        F.shiftright(V.sign_hash(F.col("embedding")), 20).alias("dhash"), F.col("embedding").alias("vector"), ((k * 37) % 100 / 100).alias("blur"), k.alias("place"),
    )
    return K.face_stacks(rows, bits=43)


@query("""
WITH v AS (SELECT l_orderkey AS path, CASE l_linenumber % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END AS model, min(l_partkey) AS vector FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN model = 'b' THEN 0 WHEN model = 'd' THEN 1 WHEN model = 'a' THEN 3 ELSE 4 END AS o FROM v)
SELECT path, arg_min(model, o || model) AS model, arg_min(vector, o || model) AS vector FROM o GROUP BY path""")
def preferred_vectors(t: Tables) -> DataFrame:
    """One vector a file, by calibration, preference and prompts."""
    n = F.col("l_linenumber") % 5
    model = F.when(n == 0, "a").when(n == 1, "b").when(n == 2, "c").when(n == 3, "d").otherwise("e")
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("path"), model.alias("model")).agg(F.min("l_partkey").alias("vector"))
    return C.preferred_vectors(rows, ["b", "d", "e"], "b", ["a", "b", "d"])


PROMPTS = [(1.0, 3), (0.5, 8), (-1.0, 11), (-2.0, 20)]


def _axis(*places: int) -> list[float]:
    return [1.0 if i in places else 0.0 for i in range(64)]


@query("""
WITH u AS (SELECT vec_id, sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) AS n, embedding AS v FROM embeddings)
SELECT vec_id, round(((CAST(v[4] AS DOUBLE) * 1.0 + CAST(v[9] AS DOUBLE) * 0.5) / 1.5 - (CAST(v[12] AS DOUBLE) * 1.0 + CAST(v[21] AS DOUBLE) * 2.0) / 3.0) / n, 7) AS raw FROM u""")
def aesthetic_scores(t: Tables) -> DataFrame:
    """Weighted likeness to good descriptions less that to bad ones."""
    return t("embeddings").select("vec_id", F.round(C.aesthetic_raw(F.col("embedding"), [(w, _axis(at)) for w, at in PROMPTS]), 7).alias("raw"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * 60 AS BIGINT) AS width, CAST(l_quantity * 40 AS BIGINT) AS height, l_extendedprice * 10 AS size, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity * 12 END AS blur,
  CASE WHEN l_returnflag <> 'A' THEN l_discount * 9 + 0.03 END AS brightness, l_tax * 4 AS clipped, CASE WHEN l_linestatus = 'O' THEN l_tax * 3 END AS contrast, CASE WHEN l_linenumber <> 3 THEN l_discount * 2 - 0.1 END AS raw,
  l_linenumber % 2 = 0 AS reliable, CASE WHEN l_returnflag = 'R' THEN 'game' WHEN l_returnflag = 'N' THEN 'photo' END AS type, CASE WHEN l_linestatus = 'O' THEN 'x' END AS camera, CASE l_suppkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'explicit' END AS rating, l_partkey FROM lineitem),
p AS (SELECT *, width * height / 1e6 AS mp FROM i),
s AS (SELECT *, greatest(0, least(1, (log10(greatest(blur, 0.001)) - log10(25)) / (log10(600) - log10(25)))) AS sharp, greatest(0, least(1, log2(mp / 0.2) / log2(4 / 0.2))) AS res,
  (1 - greatest(0, least(1, (abs(brightness - 0.45) - 0.15) / 0.30))) * (1 - 0.7 * greatest(0, least(1, (clipped - 0.05) / 0.30))) AS expo, greatest(0, least(1, (contrast - 0.05) / 0.15)) AS con, greatest(0, least(1, (size / (mp * 1e6) - 0.03) / 0.12)) AS comp FROM p),
w AS (SELECT *, CASE WHEN blur IS NULL THEN NULL ELSE sharp END AS sh, CASE WHEN brightness IS NULL THEN NULL ELSE expo END AS ex, CASE WHEN contrast IS NULL THEN NULL ELSE con END AS co FROM s),
q AS (SELECT *, (0.4 * coalesce(sh, 0) + 0.2 * res + 0.2 * coalesce(ex, 0) + 0.1 * coalesce(co, 0) + 0.1 * comp) / (0.3 + CASE WHEN sh IS NULL THEN 0 ELSE 0.4 END + CASE WHEN ex IS NULL THEN 0 ELSE 0.2 END + CASE WHEN co IS NULL THEN 0 ELSE 0.1 END) AS technical,
  1 / (1 + exp(-(raw - 0.02) / 0.03)) AS visual, round(greatest(0, least(1, (sqrt((width / 4.0) * (height / 4.0) / (width * height)) - 0.03) / 0.17)), 3) AS prom FROM w),
z AS (SELECT *, array_to_string(list_filter([CASE WHEN reliable AND coalesce(type, 'unknown') <> 'photo' AND NOT (camera IS NOT NULL AND coalesce(type, '') = 'game') THEN 'content:' || coalesce(type, 'unknown') END, CASE WHEN NOT reliable AND camera IS NULL THEN 'content:unverified' END,
  CASE WHEN rating = 'explicit' THEN 'adult:explicit' END, CASE WHEN least(width, height) < 480 OR mp < 0.2 THEN 'too_small' END, CASE WHEN blur < 15 THEN 'blurry' END, CASE WHEN brightness NOT BETWEEN 0.05 AND 0.96 THEN 'exposure' END], lambda x: x IS NOT NULL), ',') AS rejections FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(technical, 5) AS technical, round(visual, 5) AS visual, round(0.55 * coalesce(visual, 0.25) + 0.45 * technical, 5) AS base,
  round(1 - (1 - 0.85 * round(prom * CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.6 END, 3)), 5) AS personal, 1 AS face_count, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS known_people, rejections = '' AS eligible, rejections FROM z""")
def curation_rows(t: Tables) -> DataFrame:
    """Every score of a file from its known parts, and why it may not be shown."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    width, height = (q * 60).cast("long"), (q * 40).cast("long")
    face = lambda hidden: F.struct(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("person"), F.lit(4).alias("label"), F.lit(hidden).alias("hidden"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), (width / 4.0).alias("right"), (height / 4.0).alias("bottom"))
    inputs = {
        "width": width, "height": height, "size": F.col("l_extendedprice") * 10, "blur": F.when(k % 4 != 0, q * 12), "brightness": F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 9 + 0.03), "clipped": F.col("l_tax") * 4,
        "contrast": F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 3), "raw": F.when(k != 3, F.col("l_discount") * 2 - 0.1), "centre": F.lit(0.02), "scale": F.lit(0.03), "faces": F.array(face(False), face(True)), "reliable": k % 2 == 0,
        "type": F.when(F.col("l_returnflag") == "R", "game").when(F.col("l_returnflag") == "N", "photo"), "camera": F.when(F.col("l_linestatus") == "O", "x"), "rating": F.when(F.col("l_suppkey") % 3 == 0, "safe").when(F.col("l_suppkey") % 3 == 1, "explicit"), "taken": F.col("l_shipdate"),
    }
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = C.curation_scores(t("lineitem"), keys, inputs)
    return rows.select(*keys, *(F.round(c, 5).alias(c) for c in ("technical", "visual", "base", "personal")), "face_count", "known_people", "eligible", F.array_join("rejections", ",").alias("rejections"))


@query("""
WITH m AS (SELECT vec_id AS key, 'm' || CAST(label % 2 AS VARCHAR) AS model, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
s AS (SELECT key, model, 0 AS pos, 'cats' AS theme, greatest(v[1], v[2]) / n AS sim FROM m UNION ALL SELECT key, model, 1, 'lake', v[3] / n FROM m UNION ALL SELECT key, model, 2, 'not-drawn', v[4] / n FROM m),
f AS (SELECT model, theme, avg(sim) AS mean, greatest(stddev_pop(sim), 1e-6) AS std, quantile_cont(sim, 0.5) AS median, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 60),
z AS (SELECT key, pos, theme, (sim - mean) / std AS z, sim - median AS above FROM s JOIN f USING (model, theme)),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z DESC, pos) AS r FROM z WHERE theme <> 'not-drawn')
SELECT key, theme, round(z, 5) AS z FROM b WHERE r = 1 AND z >= 2.0 AND above >= 0.018 AND key NOT IN (SELECT key FROM z WHERE theme = 'not-drawn' AND z >= 1.5)""")
def item_themes(t: Tables) -> DataFrame:
    """Items that stand out in a theme among all of their model, and aren't spoiled."""
    items = t("embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), F.col("embedding").alias("vector"))
    told = {"cats": [_axis(0), _axis(1)], "lake": [_axis(2)], "not-drawn": [_axis(3)]}
    return C.themes(items, {"m0": told, "m1": told}, C.THEME | {"theme_z": 2.0}).select("key", "theme", F.round("z", 5).alias("z"))


@query("""
WITH s AS (SELECT vec_id AS key, exp(20.0 * CAST(embedding[1] AS DOUBLE)) AS a, exp(20.0 * CAST(embedding[2] AS DOUBLE)) AS b, exp(20.0 * CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)
SELECT key, CASE WHEN a >= b AND a >= c THEN 'photo' WHEN b >= c THEN 'game' ELSE 'meme' END AS label, round(greatest(a, b, c) / (a + b + c), 6) AS confidence FROM s""")
def zero_shot_types(t: Tables) -> DataFrame:
    """The likeliest content type by prompts."""
    items = t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return C.zero_shot(items, {"photo": _axis(0), "game": _axis(1), "meme": _axis(2)}).select("key", "label", F.round("confidence", 6).alias("confidence"))


@query("""
WITH u AS (SELECT vec_id AS key, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT key, 'day' AS label, round(1 / (1 + exp(-(3.0 * v[1] / n + 0.5))), 6) AS score FROM u UNION ALL SELECT key, 'night', round(1 / (1 + exp(-(2.0 * v[1] / n - 4.0 * v[2] / n))), 6) FROM u""")
def trained_head(t: Tables) -> DataFrame:
    """A trained head applied to all vectors."""
    import numpy as np

    weights = np.zeros((64, 2))
    weights[0], weights[1, 1] = (3.0, 2.0), -4.0
    items = t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return C.head_scores(items, ["day", "night"], [(weights, np.array([0.5, 0.0]))], "v1").select("key", "label", F.round("score", 6).alias("score"))


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100) AS v FROM embeddings),
l AS (SELECT vec_id, [v[i * 8 + j - 8] + v[i * 8 + j + 8] + v[i * 8 + j - 1] + v[i * 8 + j + 1] - 4 * v[i * 8 + j] for i in [1, 2, 3, 4, 5, 6] for j in [2]] AS x FROM p),
a AS (SELECT vec_id, unnest(generate_series(1, 6)) AS i, v FROM p), g AS (SELECT vec_id, i, unnest(generate_series(2, 7)) AS j, v FROM a),
e AS (SELECT vec_id, v[i * 8 + j - 8] + v[i * 8 + j + 8] + v[i * 8 + j - 1] + v[i * 8 + j + 1] - 4 * v[i * 8 + j] AS x FROM g)
SELECT vec_id, round(var_pop(x), 4) AS variance, round(greatest(0.15, least(1.0, (0.95 - (vec_id % 100) / 100.0) / 0.35)), 6) AS weight FROM e GROUP BY vec_id""".replace("""l AS (SELECT vec_id, [v[i * 8 + j - 8] + v[i * 8 + j + 8] + v[i * 8 + j - 1] + v[i * 8 + j + 1] - 4 * v[i * 8 + j] for i in [1, 2, 3, 4, 5, 6] for j in [2]] AS x FROM p),
""", ""))
def image_sharpness(t: Tables) -> DataFrame:
    """Variance of the Laplacian of grey images, and what sharpness weighs."""
    pixels = F.transform("embedding", lambda x: x.cast("double") * 100)
    return t("embeddings").select("vec_id", F.round(C.laplacian_variance(pixels, 8, 8), 4).alias("variance"), F.round(C.sharpness_weight(F.col("vec_id") % 100 / 100.0), 6).alias("weight"))


@query("""
WITH a AS (SELECT min(p_partkey) AS id, p_brand AS name FROM part GROUP BY p_brand), b AS (SELECT s_suppkey AS id, 'Brand#' || s_suppkey AS name FROM supplier)
SELECT b.id, coalesce(a.id, b.id + (SELECT max(id) FROM a)) AS new, a.id IS NOT NULL AS known FROM b LEFT JOIN a USING (name)""")
def merged_people(t: Tables) -> DataFrame:
    """Another catalogue's people: the same by name, or new ids."""
    own = t("part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    return G.same_names(own, t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("name")))


@query(f"""
WITH a AS (SELECT * FROM {ALBUMS}), b AS (SELECT id * 3 + 5 AS id, parent * 3 + 5 AS parent, CASE WHEN id % 4 = 1 THEN title || ' (2)' ELSE title END AS title FROM a),
ta AS (SELECT x.id, concat_ws('/', z.title, y.title, x.title) AS trail FROM a x LEFT JOIN a y ON y.id = x.parent LEFT JOIN a z ON z.id = y.parent), tb AS (SELECT x.id, concat_ws('/', z.title, y.title, x.title) AS trail FROM b x LEFT JOIN b y ON y.id = x.parent LEFT JOIN b z ON z.id = y.parent)
SELECT tb.id, coalesce(ta.id, tb.id + (SELECT max(id) FROM a)) AS new, ta.id IS NOT NULL AS known FROM tb LEFT JOIN ta USING (trail)""")
def merged_albums(t: Tables) -> DataFrame:
    """Another catalogue's album trees: the same by titles from the top."""
    a = albums(t)
    other = a.select((F.col("id") * 3 + 5).alias("id"), (F.col("parent") * 3 + 5).alias("parent"), F.when(F.col("id") % 4 == 1, F.concat("title", F.lit(" (2)"))).otherwise(F.col("title")).alias("title"))
    return G.same_titles(a, other)


@query("""
SELECT user_id, event_type, min(event_id) AS at FROM events GROUP BY 1, 2""")
def first_seen(t: Tables) -> DataFrame:
    """Each value once, in order of appearance."""
    return R.first_seen(t("events"), ["user_id"], "event_type", "event_id")


@query("""
WITH c AS (SELECT o_custkey AS key, max(o_orderdate) AS at, arg_max(o_orderpriority, epoch_us(o_orderdate) // 1000000 || o_orderpriority) AS reason FROM orders GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c.key, reason FROM c LEFT JOIN b USING (key) WHERE b.at IS NULL OR c.at > b.at""")
def dirty_groups(t: Tables) -> DataFrame:
    """What must be built again, and why."""
    o = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("reason"), "o_orderstatus")
    return R.dirty(o, o.where("o_orderstatus = 'F'"), "key")


@query(f"""
WITH p AS (SELECT path, dir, CASE WHEN doc_id % 5 = 0 THEN 'excluded' ELSE 'known' END AS state, doc_id FROM {PHOTOS}),
s AS (SELECT path, dir, CASE WHEN dir = 'src1:/en' OR doc_id % 9 = 0 THEN 'excluded' WHEN state = 'excluded' AND dir LIKE 'src2:/%' THEN 'known' ELSE state END AS state FROM p)
SELECT 'src1:/' AS root, count(*) AS files, count(*) FILTER (state = 'excluded') AS excluded FROM s WHERE path LIKE 'src1:/%' UNION ALL SELECT 'src2:/', count(*), count(*) FILTER (state = 'excluded') FROM s WHERE path LIKE 'src2:/%'""")
def excluded_totals(t: Tables) -> DataFrame:
    """Exclusions set and lifted, and the totals of the roots that they touch."""
    p = photos(t)
    files = p.select("path", F.when(F.col("doc_id") % 5 == 0, "excluded").otherwise("known").alias("state"))
    add = p.where("doc_id % 9 = 0").select("path").union(p.where("dir = 'src1:/en'").select("dir").distinct())
    return R.root_totals(R.excluded(files, add, p.where("source = 'src2'").select("dir").distinct().withColumnRenamed("dir", "path")), ["src1:/", "src2:/"])


@query(f"""
WITH s AS (SELECT a.vec_id AS key, b.vec_id AS source, b.label, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0)
SELECT key, label, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, source) AS r FROM s) WHERE r = 1 AND sim >= 0.3""")
def propagated_reviews(t: Tables) -> DataFrame:
    """Reviews go to what is nearly the same."""
    e = t("embeddings")
    return R.propagated_reviews(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("key"), "label"), 0.3)


@query(f"""
WITH s AS (SELECT vec_id // 8 AS file, vec_id AS track, CASE WHEN vec_id % 3 <> 0 THEN label END AS person, embedding FROM embeddings)
SELECT x.file, x.track AS a, y.track AS b, round({DOT.format(a='x.embedding', b='y.embedding')}, 6) AS sim, CASE WHEN x.person IS NULL OR y.person IS NULL THEN 'unknown' WHEN x.person = y.person THEN 'same' ELSE 'different' END AS truth FROM s x JOIN s y ON x.file = y.file AND x.track < y.track""")
def track_pairs(t: Tables) -> DataFrame:
    """Pairs of one file's tracks with what is known of them."""
    return R.track_pairs(t("embeddings").select(F.floor(F.col("vec_id") / 8).alias("file"), F.col("vec_id").alias("track"), F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("person"), F.col("embedding").alias("vector")))


@query(f"""
WITH RECURSIVE s AS (SELECT vec_id AS id, vec_id // 20 AS file, CAST(vec_id % 7 + 1 AS DOUBLE) AS seconds, embedding FROM embeddings), e AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.file = y.file AND x.id <> y.id AND {DOT.format(a='x.embedding', b='y.embedding')} >= 0.2),
r AS (SELECT id AS node, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node AS id, min(root) AS speaker FROM r GROUP BY 1),
w AS (SELECT speaker, sum(seconds) AS seconds, sum(seconds * CAST(embedding[1] AS DOUBLE)) AS x FROM c JOIN s USING (id) GROUP BY 1), d AS (SELECT speaker, pos, sum(x) AS x FROM (SELECT speaker, generate_subscripts(embedding, 1) AS pos, unnest(embedding) * seconds AS x FROM c JOIN s USING (id)) GROUP BY 1, 2),
n AS (SELECT speaker, sqrt(sum(x * x)) AS n FROM d GROUP BY 1)
SELECT id, speaker, w.seconds, round(x / n, 5) AS x FROM c JOIN w USING (speaker) JOIN n USING (speaker)""")
def merged_speakers(t: Tables) -> DataFrame:
    """Alike voice clusters of one file are one speaker, weighted by seconds."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 20).alias("file"), (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return R.merged_speakers(rows, 0.2).select("id", "speaker", "seconds", F.round(F.get("vector", F.lit(0)), 5).alias("x"))


@query("""
WITH g AS (SELECT label AS person, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 50 = 7),
o AS (SELECT vec_id // 10 AS person, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 10 = 3 AND vec_id < 80),
r AS (SELECT person, generate_subscripts(v, 1) AS pos, unnest(v) * 4 AS x, 4 AS n, 0 AS i FROM o UNION ALL SELECT person, generate_subscripts(v, 1), unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 1, 1 FROM g),
s AS (SELECT person, pos, sum(x) AS x, sum(n) AS n FROM r GROUP BY 1, 2) SELECT person, max(n) AS n, round(max(CASE WHEN pos = 1 THEN x END) / sqrt(sum(x * x)), 5) AS x FROM s GROUP BY 1""")
def assigned_speakers(t: Tables) -> DataFrame:
    """Manual assignments move voice prints."""
    e = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    prints = e.where("vec_id % 10 = 3 and vec_id < 80").select(F.floor(F.col("vec_id") / 10).cast("int").alias("person"), "vector", F.lit(4).alias("n"))
    rows = R.assigned_speaker(prints, e.where("vec_id % 50 = 7").select(F.col("label").cast("int").alias("person"), "vector"))
    return rows.select("person", "n", F.round(F.get("vector", F.lit(0)), 5).alias("x"))


@query(f"""
WITH p AS (SELECT path FROM {PHOTOS}), m AS (SELECT path, CASE WHEN path LIKE 'src1:/%' THEN 'src3:/en/src1:' || substr(path, 6) WHEN path LIKE 'src2:/en/%' THEN 'src3:/en/en' || substr(path, 9) END AS goal FROM p),
h AS (SELECT path FROM m WHERE goal IS NULL), n AS (SELECT goal, count(*) AS n FROM m GROUP BY 1)
SELECT path, goal AS "to", n > 1 OR goal IN (SELECT path FROM h) AS conflict FROM m JOIN n USING (goal) WHERE goal IS NOT NULL""")
def planned_moves(t: Tables) -> DataFrame:
    """Where files go when folders are moved, and what stands in the way."""
    return R.planned_moves(photos(t).select("path"), ["src1:/", "src2:/en", "src1:/en"], "src3:/en")


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS feature, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 1 UNION SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey > 2),
r AS (SELECT feature, needs FROM e UNION SELECT r.feature, e.needs FROM r JOIN e ON e.feature = r.needs) SELECT CAST(feature AS BIGINT) AS feature, CAST(needs AS BIGINT) AS needs FROM r""")
def needed_features(t: Tables) -> DataFrame:
    """All that a feature needs."""
    n = F.col("n_nationkey").cast("long")
    half, third = (t("nation").where(n > k - 1).select(n.alias("feature"), F.floor(n / k).alias("needs")) for k in (2, 3))
    return R.needed_features(half.union(third).distinct())


@query("""
SELECT c.conv_id AS batch, count(*) AS n, array_to_string(list_slice(list(role ORDER BY turn), 1, 3), ',') AS first FROM conversations c WHERE turn IS NOT NULL AND role IS NOT NULL GROUP BY 1""")
def pending_batches(t: Tables) -> DataFrame:
    """Batches with their first items."""
    items = t("conversations").where("turn is not null and role is not null").select(F.col("conv_id").alias("batch"), F.col("turn").alias("place"), F.col("role").alias("item"))
    return R.pending(items.select("batch").distinct(), items, 3).select("batch", "n", F.array_join("first", ",").alias("first"))


@query("""
WITH w AS (SELECT s_suppkey AS worker, s_nationkey AS source, s_suppkey % 5 = 0 AS prim, s_suppkey % 3 = 0 AS dev, s_acctbal AS load FROM supplier), b AS (SELECT source, arg_min(worker, (CASE WHEN prim THEN 0 WHEN dev THEN 1 ELSE 2 END, load, worker)) AS worker FROM w GROUP BY 1)
SELECT c_custkey AS job, worker FROM customer LEFT JOIN b ON source = c_nationkey""")
def chosen_workers(t: Tables) -> DataFrame:
    """Who does a source's job."""
    s = F.col("s_suppkey")
    workers = t("supplier").select(s.alias("worker"), F.col("s_nationkey").alias("source"), (s % 5 == 0).alias("primary"), (s % 3 == 0).alias("device"), F.col("s_acctbal").alias("load"))
    return R.chosen_workers(t("customer").select(F.col("c_custkey").alias("job"), F.col("c_nationkey").alias("source")), workers)


@query("""
SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS BIGINT), 7), 5), 60) AS size, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flag FROM events""")
def typed_settings(t: Tables) -> DataFrame:
    """Stored texts as typed values within bounds."""
    k = F.col("event_id")
    raw, flag = F.when(k % 3 == 0, "x").otherwise(F.floor("value").cast("string")), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "0").when(k % 4 == 2, "?")
    return t("events").select("event_id", R.typed_setting(raw, "int", 7, 5, 60).alias("size"), R.typed_setting(flag, "bool", True).alias("flag"))


@query("""
SELECT doc_id AS id FROM documents d WHERE n_chars > 300 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def recut_faces(t: Tables) -> DataFrame:
    """Faces whose pictures must be cut again."""
    faces = t("documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 300, F.col("n_chars")).alias("box"))
    return R.to_recut(faces, t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("version")), 1).select("id")
