"""Selections, joins, aggregates, upkeep and trees on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scoring as S
from ..functions import vectors as V
from ..operators import scopes as O
from ..operators import tables as T
from ..operators import trees as R
from .binding import ALBUMS, PHOTOS, albums, photos, photos_under
from .registry import Tables, query

EXCLUDED_NAMES = ["de", "$recycle.bin", "node_modules", ".git", "thumbnails"]


@query(f"""
WITH p AS (SELECT * FROM {PHOTOS}), copies AS (SELECT path FROM (SELECT path, doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS first FROM p) WHERE doc_id > first),
page AS (SELECT path, doc_id, size FROM p WHERE path LIKE 'src1:/%' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND path NOT IN (SELECT path FROM copies) ORDER BY size DESC, path LIMIT 50)
SELECT path, page.doc_id, size, quality, toxic FROM page LEFT JOIN labels ON labels.doc_id = page.doc_id""")
def page_scope(t: Tables) -> DataFrame:
    """A page of a source's visible files that aren't copies, largest first, then filled in."""
    rows = photos_under(t, "src1:/")
    copies = T.copies(T.repeated(photos(t), "size").select("doc_id", F.sha1("text").alias("sha")), "sha", "doc_id")
    rows = O.visible(rows, t("labels").where("toxic = 1"), "doc_id").join(copies, "doc_id", "left_anti")
    page = rows.select("path", "doc_id", "size").orderBy(F.desc("size"), "path").limit(50)
    return page.join(t("labels"), "doc_id", "left").select("path", "doc_id", "size", "quality", "toxic")


@query(f"""
SELECT path, kind FROM (SELECT path, dir, doc_id, lang, size, CASE WHEN path LIKE '%.MP4' THEN 'video' WHEN path LIKE '%.jpg' THEN 'photo' ELSE 'other' END AS kind FROM {PHOTOS})
WHERE kind = 'video' AND dir <> 'src2:/en' AND lang <> 'de' AND size >= 3500 AND NOT (dir LIKE 'src4:/%')""")
def gallery_filter(t: Tables) -> DataFrame:
    """Optional predicates taken together; kinds by suffix; excluded names on any segment."""
    rows = photos(t).withColumn("kind", F.when(P.suffix(F.col("path")).isin(".mp4", ".mov", ".mkv"), "video").when(P.suffix(F.col("path")).isin(".jpg", ".png"), "photo").otherwise("other"))
    named = F.arrays_overlap(F.transform(P.parts(F.col("path")), lambda x: F.lower(x)), F.array(*map(F.lit, EXCLUDED_NAMES)))
    return rows.where(O.all_of(F.col("kind") == "video", F.col("dir") != "src2:/en", ~named, None, F.col("size") >= 3500, ~P.inside(F.col("path"), "src4:/"))).select("path", "kind")


@query(f"""
SELECT path FROM {PHOTOS} WHERE path LIKE 'src5:/%' OR path LIKE 'src6:/fr/%' OR path IN ('src1:/en/1.jpg', 'src1:/en/21.jpg')""")
def job_scope(t: Tables) -> DataFrame:
    """Files under roots or named."""
    return photos(t).where(O.job(F.col("path"), ["src5:/", "src6:/fr"], ["src1:/en/1.jpg", "src1:/en/21.jpg"])).select("path")


@query(f"""
SELECT CAST(i AS INTEGER) AS shard, CAST((SELECT count(*) FROM {PHOTOS}) // 7 + CASE WHEN i < (SELECT count(*) FROM {PHOTOS}) % 7 THEN 1 ELSE 0 END AS BIGINT) AS n FROM range(7) r(i)""")
def even_shards(t: Tables) -> DataFrame:
    """Shards whose sizes differ by one at most (P10)."""
    return O.even_shards(photos(t).select("path"), "path", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT p.path FROM {PHOTOS} p LEFT JOIN labels l ON l.doc_id = p.doc_id WHERE l.doc_id IS NULL OR l.quality IS DISTINCT FROM p.size % 2 OR l.toxic = 1""")
def freshness(t: Tables) -> DataFrame:
    """Files without a usable result of their version (P11, J3, ST2)."""
    wanted = photos(t).select("doc_id", "path", F.pmod("size", F.lit(2)).alias("version"))
    done = t("labels").select("doc_id", F.col("quality").cast("long").alias("version"), "toxic")
    return O.stale(wanted, done, "doc_id", ["version"], F.col("toxic") != 1).select("path")


@query()
def input_signature(t: Tables) -> DataFrame:
    """Signatures of all inputs of a stage."""
    rows = photos(t).join(t("labels"), "doc_id", "left")
    return rows.select("path", O.signature(F.col("size"), F.col("modified"), F.col("quality"), F.col("lang")).alias("signature"))


@query(f"""
SELECT path, concat_ws(',', CASE WHEN lang = 'de' THEN 'type' END, CASE WHEN toxic = 1 THEN 'rating' END, CASE WHEN size < 500 THEN 'small' END) AS reasons,
  lang <> 'de' AND coalesce(toxic, 0) <> 1 AND size >= 500 AS eligible FROM {PHOTOS} p LEFT JOIN labels l ON l.doc_id = p.doc_id""")
def eligibility(t: Tables) -> DataFrame:
    """All reasons against a file."""
    rows = photos(t).join(t("labels"), "doc_id", "left")
    reasons = S.rejections((F.col("lang") == "de", "type"), (F.col("toxic") == 1, "rating"), (F.col("size") < 500, "small"))
    return rows.select("path", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


@query(f"""
SELECT CASE WHEN l.toxic = 1 THEN 'unsafe' WHEN l.doc_id IS NULL THEN 'unchecked' WHEN p.size < 500 THEN 'low score' ELSE 'passed' END AS reason, count(*) AS n
FROM {PHOTOS} p LEFT JOIN labels l ON l.doc_id = p.doc_id GROUP BY 1""")
def candidate_funnel(t: Tables) -> DataFrame:
    """Rejections by the first rule that fails."""
    rows = photos(t).join(t("labels"), "doc_id", "left")
    return O.funnel(rows, [(F.col("toxic") == 1, "unsafe"), (F.col("toxic").isNull(), "unchecked"), (F.col("size") < 500, "low score")])


@query("""
SELECT event_id, event_type IN ('view', 'click') OR lower(event_type) LIKE '%err%' AS ocr, value >= 0.35 AND value <= 60 AS kept, CASE WHEN value < 1 THEN 'tiny' WHEN value > 50 THEN 'huge' ELSE 'ok' END AS skip,
  CASE WHEN event_id % 3 = 0 THEN false WHEN value IS NULL THEN false ELSE value >= 30 END AS blurry FROM events""")
def stage_candidates(t: Tables) -> DataFrame:
    """Candidates of text, speech and picture stages; unknown is not blurry."""
    v = F.col("value")
    return t("events").select(
        "event_id", (F.col("event_type").isin("view", "click") | F.lower("event_type").contains("err")).alias("ocr"), v.between(0.35, 60).alias("kept"), S.first_of((v < 1, "tiny"), (v > 50, "huge"), otherwise="ok").alias("skip"),
        F.coalesce(F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(False)), v >= 30, F.lit(False)).alias("blurry"),
    )


@query("""
WITH h AS (SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'the of'))
SELECT doc_id, CAST(min(tier) AS INTEGER) AS tier FROM (SELECT doc_id, 1 AS tier FROM h UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 3 FROM labels WHERE toxic = 1) GROUP BY doc_id""")
def hybrid_search(t: Tables) -> DataFrame:
    """Text hits first, others after, each once."""
    found = t("documents").where(F.lower(F.concat_ws(" ", "text", "source")).contains("the of")).select("doc_id", F.lit(1).alias("tier"))
    ranked = found.union(t("labels").where("quality = 1").select("doc_id", F.lit(2))).union(t("labels").where("toxic = 1").select("doc_id", F.lit(3)))
    return ranked.groupBy("doc_id").agg(F.min("tier").alias("tier"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""")
def masked_faces(t: Tables) -> DataFrame:
    """Members of a union of two sets of files."""
    part = t("part")
    masked = part.where("p_size > 40").select("p_partkey").union(part.where("p_brand = 'Brand#3'").select("p_partkey")).distinct()
    return t("lineitem").join(masked, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""
WITH s AS (SELECT path, size FROM {PHOTOS} WHERE doc_id % 10 <> 3), k AS (SELECT path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM {PHOTOS} WHERE doc_id % 7 <> 2)
SELECT coalesce(s.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN CASE WHEN coalesce(s.path, k.path) LIKE 'src9:%' THEN 'kept' ELSE 'missing' END WHEN s.size = k.size THEN 'known' ELSE 'changed' END AS state FROM s FULL JOIN k ON s.path = k.path""")
def version_reconcile(t: Tables) -> DataFrame:
    """A scan against the catalogue; an incomplete source loses nothing."""
    p = photos(t)
    scan = p.where("doc_id % 10 <> 3").select("path", "size")
    known = p.where("doc_id % 7 <> 2").select("path", (F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"))
    return T.reconciled(scan, known, "path", ["size"], ~F.col("path").startswith("src9:"))


@query(f"""
WITH c AS (SELECT path, doc_id, sha1(text) AS h, size FROM {PHOTOS}), s AS (SELECT * FROM c WHERE size IN (SELECT size FROM c GROUP BY size HAVING count(*) > 1))
SELECT path, original FROM (SELECT path, min(path) OVER (PARTITION BY h) AS original FROM s) WHERE path > original""")
def size_semi_dups(t: Tables) -> DataFrame:
    """Copies: only files whose size repeats are hashed."""
    hashed = T.repeated(photos(t), "size").select("path", F.sha1("text").alias("sha"))
    return T.copies(hashed, "sha", "path")


@query("""
WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS original FROM documents)
SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT c.doc_id, quality, toxic FROM c JOIN labels l ON l.doc_id = c.original WHERE c.doc_id > c.original AND c.doc_id NOT IN (SELECT doc_id FROM labels)""")
def propagate(t: Tables) -> DataFrame:
    """Results of originals for copies that have none."""
    pairs = T.copies(t("documents").select("doc_id", F.sha1("text").alias("sha")), "sha", "doc_id")
    return T.propagate(t("labels"), pairs, "doc_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 2 = 0 OR doc_id % 2 <> 0
UNION ALL SELECT 1000000 + doc_id, 9, toxic FROM labels WHERE doc_id % 2 = 0""")
def upsert_rows(t: Tables) -> DataFrame:
    """Insert or update by key."""
    old = t("labels")
    even = old.where("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("quality"), "toxic")
    return T.upsert(old, even.union(even.select(F.col("doc_id") + 1000000, "quality", "toxic")), ["doc_id"])


@query("""
SELECT doc_id, quality, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 7 ELSE toxic END AS toxic FROM labels""")
def upsert_known(t: Tables) -> DataFrame:
    """Partial upsert: what isn't known stays."""
    old = t("labels")
    new = old.where("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("int").alias("quality"), F.when(F.col("doc_id") % 2 == 0, 7).alias("toxic"))
    return T.merge_known(old, new, ["doc_id"])


@query("""
SELECT d.doc_id, d.n_chars, CASE WHEN d.doc_id % 4 <> 1 THEN l.quality END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def upsert_reset(t: Tables) -> DataFrame:
    """Dependent values go where the version changed."""
    d = t("documents")
    old = d.join(t("labels"), "doc_id").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("n_chars"), "quality")
    return T.reset_changed(old, d.select("doc_id", "n_chars"), "doc_id", ["n_chars"], ["quality"])


@query("""
WITH n AS (SELECT DISTINCT upper(event_type) AS name FROM events UNION SELECT r_name FROM region), f AS (SELECT name, row_number() OVER (ORDER BY name) AS r FROM n WHERE name NOT IN (SELECT r_name FROM region))
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + r, name FROM f""")
def found_or_created(t: Tables) -> DataFrame:
    """Names found or given new ids."""
    people = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return T.found_or_created(t("events").select(F.upper("event_type").alias("name")).union(people.select("name")), people)


@query(f"""
SELECT CASE WHEN path LIKE 'src2:/en/%' THEN 'src2:/moved/' || split_part(path, '/', -1) ELSE path END AS path, size FROM {PHOTOS}""")
def rename_keys(t: Tables) -> DataFrame:
    """One mapping renames keys wherever they stand."""
    p = photos(t)
    mapping = p.where(O.folder(F.col("path"), "src2:/en", deep=False)).select(F.col("path").alias("old"), P.joined(F.lit("src2:/moved"), P.name(F.col("path"))).alias("new"))
    return T.rekeyed(p.select("path", "size"), mapping, "path")


@query("""
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS g FROM documents), m AS (SELECT g, max(1) AS m FROM g WHERE doc_id % 50 = 0 GROUP BY g)
SELECT l.doc_id, CAST(coalesce(m, toxic) AS INTEGER) AS toxic, m IS NOT NULL AS manual FROM labels l LEFT JOIN g ON g.doc_id = l.doc_id LEFT JOIN m ON m.g = g.g""")
def manual_override(t: Tables) -> DataFrame:
    """A manual value stands for its whole group of copies."""
    d = t("documents").select("doc_id", F.sha1("text").alias("sha"))
    groups = d.select("doc_id", F.col("sha").alias("group"))
    manual = d.where("doc_id % 50 = 0").select("doc_id", F.lit(1).alias("toxic"))
    return T.overridden(t("labels").select("doc_id", "toxic"), manual, groups, "doc_id", "toxic")


@query(f"""
WITH p AS (SELECT * FROM {PHOTOS})
SELECT dir AS folder, count(*) AS files, count(*) AS subtree, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY 1
UNION ALL SELECT source || ':/', 0, count(*), CAST(sum(size) AS BIGINT) FROM p GROUP BY 1""")
def dir_rollup(t: Tables) -> DataFrame:
    """Counters of every folder and its ancestors."""
    return R.folder_counts(photos(t).select("path", "size"), "path", "size")


@query(f"""
WITH RECURSIVE a AS (SELECT * FROM {ALBUMS}), up AS (SELECT id, id AS anc, parent, 0 AS d FROM a UNION ALL SELECT up.id, a.id, a.parent, up.d + 1 FROM up JOIN a ON a.id = up.parent),
m AS (SELECT 1000 + o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT a.id, (SELECT max(d) FROM up WHERE up.id = a.id) AS depth, coalesce((SELECT n FROM m WHERE m.id = a.id), 0) AS own, CAST(coalesce((SELECT sum(n) FROM up JOIN m ON m.id = up.id WHERE up.anc = a.id), 0) AS BIGINT) AS total FROM a""")
def tree_totals(t: Tables) -> DataFrame:
    """Album trees with totals of all below."""
    return R.tree_totals(albums(t), t("orders").select((F.col("o_custkey") + 1000).alias("id")))


@query(f"""
WITH a AS (SELECT *, id % 7 = 3 AS hidden FROM {ALBUMS})
SELECT a.id, a.hidden OR coalesce(b.hidden, false) OR coalesce(c.hidden, false) AS hidden, concat_ws(' / ', c.title, b.title, a.title) AS trail FROM a LEFT JOIN a b ON b.id = a.parent LEFT JOIN a c ON c.id = b.parent""")
def hidden_tree(t: Tables) -> DataFrame:
    """Hidden flags come down the tree; trails."""
    nodes = albums(t).withColumn("hidden", F.col("id") % 7 == 3)
    return R.inherited(nodes, "hidden").join(R.trails(nodes), "id")


@query(f"""
WITH a AS (SELECT * FROM {ALBUMS}) SELECT n.id, c.id AS target, NOT coalesce(c.parent = n.id, false) AS allowed FROM a n JOIN a c ON c.id = 1000 + n.id OR c.id = 1100 + n.id WHERE n.id BETWEEN 100 AND 124""")
def album_moves(t: Tables) -> DataFrame:
    """Moves that would close a cycle are refused."""
    nodes = albums(t)
    tops = nodes.where("id between 100 and 124").select("id")
    moves = tops.select("id", (F.col("id") + 1000).alias("target")).union(tops.select("id", F.col("id") + 1100))
    return R.may_move(nodes, moves.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target"))
