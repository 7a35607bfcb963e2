"""Cards, similar files and the catalogue's books on the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import ledger as L
from ..operators import clusters as U
from ..operators import merging as G
from ..operators import scopes as O
from ..sources import archives as A
from ..sources import places as K
from .binding import ALBUMS, PHOTOS, albums, photos
from .registry import Tables, query

#: Faces are orders, named after urgent orders' customers, in clusters by supplier, and marked by their lines.
FACES = """n AS (SELECT o_orderkey AS face, min(CAST(o_custkey AS VARCHAR)) AS person FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1),
c AS (SELECT face, CAST(b.l AS BIGINT) AS label, b.c AS confidence FROM (SELECT l_orderkey AS face, max(struct_pack(c := l_discount, l := CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_suppkey END)) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)),
k AS (SELECT DISTINCT o_orderkey AS face, person, coalesce(label, -1) AS label, coalesce(confidence, 0) AS confidence,
  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_tax >= 0.07) AS out, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3 AND l_quantity < 10) AS soft,
  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4 AND l_returnflag = 'A') AS drawn FROM orders LEFT JOIN n ON n.face = o_orderkey LEFT JOIN c ON c.face = o_orderkey),
m AS (SELECT 'person' AS kind, 'person:' || person AS g, face, confidence FROM k WHERE person IS NOT NULL AND (out OR NOT soft)
  UNION ALL SELECT 'auto', 'auto:' || label, face, confidence FROM k WHERE person IS NULL AND NOT out AND NOT drawn AND NOT soft AND label <> -1
  UNION ALL SELECT 'noise', 'noise', face, confidence FROM k WHERE person IS NULL AND NOT out AND NOT drawn AND NOT soft AND label = -1
  UNION ALL SELECT 'blurry', 'blurry', face, confidence FROM k WHERE soft AND NOT out UNION ALL SELECT 'excluded', 'excluded', face, confidence FROM k WHERE out)"""


def _members(t: Tables) -> DataFrame:
    lines = t("lineitem")
    marked = lambda number, rule: lines.where((F.col("l_linenumber") == number) & rule).select(F.col("l_orderkey").alias("face"))
    named = t("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("face"), F.col("o_custkey").alias("person"))
    labels = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("face"), F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_suppkey")).alias("label"), F.col("l_discount").alias("confidence"))
    return C.face_groups(t("orders").select(F.col("o_orderkey").alias("face")), named, labels, marked(2, F.col("l_tax") >= 0.07), marked(3, F.col("l_quantity") < 10), marked(4, F.col("l_returnflag") == "A"))


@query(f"""WITH {FACES} SELECT kind, g, face, CAST(confidence AS DOUBLE) AS confidence FROM m""")
def shown_faces(t: Tables) -> DataFrame:
    """Every face with the groups that it is shown in."""
    return _members(t).withColumnRenamed("group", "g")


@query(f"""WITH {FACES}, s AS (SELECT *, CASE WHEN kind IN ('person', 'auto') THEN confidence END AS sure FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sure DESC NULLS LAST, face) AS rank FROM s),
q AS (SELECT o_orderkey AS face, (o_totalprice % 100) / 100 AS blur, o_totalprice % 300 AS size FROM orders),
p AS (SELECT g, face FROM (SELECT g, r.face, rank, (1 - coalesce(blur, 0.5)) * (0.4 + 0.6 * (least(coalesce(nullif(size, 0), 60.0), 160.0) / 160.0)) * (0.5 + 0.5 * coalesce(sure, 0.0)) AS score FROM r LEFT JOIN q USING (face) WHERE rank <= 30) QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, rank) = 1),
x AS (SELECT m.g, min(m.face) AS face FROM m JOIN orders ON m.g = 'person:' || o_custkey AND m.face = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT kind, r.g AS g, count(*) AS n, array_to_string(list(r.face ORDER BY rank) FILTER (rank <= 4), ',') AS heads, coalesce(any_value(x.face), any_value(p.face)) AS avatar, any_value(x.face) IS NOT NULL AS pinned FROM r JOIN p ON p.g = r.g LEFT JOIN x ON x.g = r.g GROUP BY 1, 2""")
def group_cards(t: Tables) -> DataFrame:
    """Cards of the groups: size, first faces, pinned face or best portrait."""
    quality = t("orders").select(F.col("o_orderkey").alias("face"), (F.col("o_totalprice") % 100 / 100).alias("blur"), (F.col("o_totalprice") % 300).alias("size"))
    pinned = t("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("person:"), F.col("o_custkey").cast("string")).alias("group"), F.col("o_orderkey").alias("face"))
    made = C.group_cards(_members(t), quality, pinned)
    return made.select("kind", F.col("group").alias("g"), "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("heads"), "avatar", "pinned")


@query("""
WITH n AS (SELECT o_orderkey AS face, o_custkey AS person FROM orders WHERE o_orderpriority LIKE '1%')
SELECT l_orderkey, l_linenumber, CASE WHEN person IS NOT NULL THEN 'person:' || person WHEN l_returnflag <> 'R' THEN 'auto:' || l_suppkey ELSE 'noise:' || (l_orderkey * 10 + l_linenumber) END AS g FROM lineitem LEFT JOIN n ON face = l_orderkey""")
def face_keys(t: Tables) -> DataFrame:
    """The group of each face inside its file."""
    named = t("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person"))
    label = F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_suppkey"))
    return t("lineitem").join(named, "l_orderkey", "left").select("l_orderkey", "l_linenumber", C.face_key(F.col("person"), label, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("g"))


@query("""
WITH a AS (SELECT coalesce((SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, CAST(s_suppkey AS VARCHAR) DESC LIMIT 1), 'clip') AS v),
p AS (SELECT l_orderkey AS path, 'p' || l_linenumber AS label, max(l_discount) AS score FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) = (SELECT v FROM a) GROUP BY 1, 2),
s AS (SELECT o_orderkey AS path, 'p1' AS label, o_orderstatus = 'F' AS value FROM orders),
b AS (SELECT path, label, coalesce(score, 0) AS score, coalesce(value, false) AS verified FROM p FULL JOIN s USING (path, label) WHERE coalesce(value, true)),
n AS (SELECT path, b.label AS label, coalesce(n_name, b.label) AS title, round(score, 4) AS score, verified FROM b LEFT JOIN nation ON b.label = 'p' || n_nationkey)
SELECT *, row_number() OVER (PARTITION BY path ORDER BY verified DESC, score DESC, title, label) AS position FROM n""")
def labels_shown(t: Tables) -> DataFrame:
    """Labels on cards: the active model's, without denied ones, confirmed ones first."""
    models = t("supplier").select(F.col("s_suppkey").cast("string").alias("version"), F.lit("clip").alias("embedding"), F.when(F.col("s_acctbal") > 0, "active").otherwise("candidate").alias("status"), F.col("s_acctbal").alias("trained"))
    predictions = t("lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_discount").alias("score"), F.lit("trained").alias("origin"), F.col("l_suppkey").cast("string").alias("version"))
    verified = t("orders").select(F.col("o_orderkey").alias("path"), F.lit("p1").alias("label"), (F.col("o_orderstatus") == "F").alias("value"))
    titles = t("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("title"))
    return C.card_labels(predictions, verified, C.prediction_source(models, "clip"), titles)


@query("""
WITH e AS (SELECT vec_id, vec_id // 3 AS g, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT p.vec_id AS probe, e.vec_id AS path, round(list_dot_product(e.v, p.v), 6) AS score FROM e JOIN e p ON p.vec_id % 50 = 0 AND p.vec_id <> e.vec_id AND p.g <> e.g WHERE e.label <> 4)
SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, path) AS position FROM s QUALIFY position <= 10""")
def similar_without_copies(t: Tables) -> DataFrame:
    """The likest files of every fiftieth one, without its copies and what may not be seen."""
    rows = t("embeddings").select(F.col("vec_id").alias("path"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    copies = rows.select("path", F.floor(F.col("path") / 3).alias("group"))
    return C.similar(rows.select("path", "v"), rows.where("path % 50 = 0").select("path"), copies, rows.where("label <> 4").select("path"), 10)


@query("""
WITH v AS (SELECT o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F')
SELECT g, path, position, reasons, row_number() OVER (PARTITION BY g ORDER BY position, path) AS shown FROM (SELECT l_partkey AS g, l_orderkey AS path, min(l_linenumber) AS position, min(l_returnflag) AS reasons FROM lineitem GROUP BY 1, 2) JOIN v USING (path)""")
def highlight_pages(t: Tables) -> DataFrame:
    """Highlights as a viewer sees them, in their order and with their reasons."""
    members = t("lineitem").groupBy(F.col("l_partkey").alias("group"), F.col("l_orderkey").alias("path")).agg(F.min("l_linenumber").alias("position"), F.min("l_suppkey").alias("pick"), F.min("l_returnflag").alias("reasons"))
    covers = members.groupBy("group").agg(F.max("path").alias("cover"))
    rows, _ = C.highlight_members(members, covers, t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("path")))
    return rows.select(F.col("group").alias("g"), "path", "position", "reasons", "shown")


@query("""
WITH m AS (SELECT l_partkey AS g, l_orderkey AS path, l_suppkey AS pick FROM lineitem), c AS (SELECT g, max(path) AS cover FROM m GROUP BY 1), v AS (SELECT o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT g, count(*) AS n, min(struct_pack(pick := pick, path := m.path)).path AS first FROM m JOIN v USING (path) GROUP BY 1)
SELECT s.g AS g, n, CASE WHEN cover IN (SELECT path FROM v) THEN cover ELSE first END AS cover FROM s JOIN c USING (g)""")
def highlight_covers(t: Tables) -> DataFrame:
    """Highlights recounted for a viewer, with a cover that can be seen (R2)."""
    members = t("lineitem").select(F.col("l_partkey").alias("group"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("pick"))
    covers = members.groupBy("group").agg(F.max("path").alias("cover"))
    _, cards = C.highlight_members(members, covers, t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("path")))
    return cards.withColumnRenamed("group", "g")


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderdate AS d, o_orderpriority AS f, o_orderstatus = 'F' AS early FROM orders),
a AS (SELECT c, min(d) AS first_run, max(d) AS last_run, count(*) AS runs, max(struct_pack(d := d, f := f)).f AS last FROM o WHERE early GROUP BY 1),
b AS (SELECT c, min(d) AS first_run, max(d) AS last_run, count(*) AS runs, max(struct_pack(d := d, f := f)).f AS last FROM o WHERE NOT early GROUP BY 1),
ra AS (SELECT c FROM a ORDER BY last_run DESC, CAST(c AS VARCHAR) DESC LIMIT 1), rb AS (SELECT c FROM b ORDER BY last_run DESC, CAST(c AS VARCHAR) DESC LIMIT 1)
SELECT c AS customer, coalesce(a.first_run, b.first_run) AS first_run, coalesce(b.last_run, a.last_run) AS last_run, coalesce(a.runs, 0) + coalesce(b.runs, 0) AS runs, coalesce(b.last, a.last) AS last,
  CASE WHEN c IN (SELECT c FROM ra) THEN a.last ELSE '' END AS done,
  CASE WHEN c IN (SELECT c FROM rb) THEN 'running' WHEN b.c IS NOT NULL THEN 'interrupted' WHEN c IN (SELECT c FROM ra) THEN 'completed' ELSE 'interrupted' END AS status
FROM a FULL JOIN b USING (c)""")
def run_books(t: Tables) -> DataFrame:
    """Two rounds of runs entered in the history: counted up, ended, what is done kept."""
    starts = t("orders").select(F.array(F.col("o_custkey").cast("string")).alias("roots"), F.array().cast("array<string>").alias("paths"), F.array("o_orderpriority").alias("features"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderstatus") == "F").alias("early"))
    blank = starts.sparkSession.createDataFrame([], L.RUNS)
    first = L.runs_finished(L.runs_started(blank, starts.where("early")), "completed")
    rows = L.runs_started(first, starts.where("NOT early"))
    return rows.select(F.col("roots")[0].cast("long").alias("customer"), "first_run", "last_run", "runs", F.array_join("last", ",").alias("last"), F.array_join("done", ",").alias("done"), "status")


@query(f"""
WITH p AS (SELECT * FROM {PHOTOS}), r AS (SELECT DISTINCT dir, source, lang FROM p),
x AS (SELECT dir AS run, dir || '/' AS head FROM r UNION ALL SELECT dir, source || ':/' FROM r WHERE lang = 'en')
SELECT run, count(DISTINCT path) AS files FROM x LEFT JOIN p ON starts_with(path, head) GROUP BY 1
UNION ALL SELECT 'named:' || source, count(*) FROM p WHERE size > 3000 GROUP BY 1""")
def files_by_run(t: Tables) -> DataFrame:
    """How many files lie in each run's roots, one inside another or not."""
    p = photos(t)
    folders = p.select("dir", "source", "lang").distinct()
    roots = F.when(F.col("lang") == "en", F.array("dir", F.concat("source", F.lit(":/")))).otherwise(F.array("dir"))
    runs = folders.select(roots.alias("roots"), F.array().cast("array<string>").alias("paths"), F.col("dir").alias("run"))
    named = p.where("size > 3000").groupBy("source").agg(F.collect_list("path").alias("paths")).select(F.array().cast("array<string>").alias("roots"), "paths", F.concat(F.lit("named:"), "source").alias("run"))
    return L.files_in_roots(runs, p).select("run", "files").union(L.files_in_roots(named, p).select("run", "files"))


@query("""
WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'answered' ELSE 'exported' END AS status, o_orderdate AS created FROM orders),
e AS (SELECT id, created, CASE WHEN status = 'exported' AND created < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY THEN 'expired' ELSE status END AS status FROM b)
SELECT id, created, CASE WHEN status = 'exported' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_tax >= 0.08) THEN 'cancelled' ELSE status END AS status FROM e""")
def batch_states(t: Tables) -> DataFrame:
    """Batches that expire and batches that are cancelled."""
    return _batches(t).select("id", "created", "status")


def _batches(t: Tables) -> DataFrame:
    made = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "answered").otherwise("exported").alias("status"), F.col("o_orderdate").alias("created"))
    return L.cancelled(L.expired(made, datetime(1998, 1, 1)), t("lineitem").where("l_tax >= 0.08").select(F.col("l_orderkey").alias("id")))


@query("""
WITH b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax >= 0.08))
SELECT p_partkey AS path, p_retailprice AS price FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 5 = 0 AND l_orderkey IN (SELECT id FROM b)) ORDER BY p_retailprice, p_partkey LIMIT 20""")
def next_review_batch(t: Tables) -> DataFrame:
    """The first files that no open batch reserves."""
    items = t("lineitem").where("l_suppkey % 5 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path"))
    queue = t("part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("order"))
    return L.next_batch(queue, _batches(t), items, 20).withColumnRenamed("order", "price")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'active' ELSE 'candidate' END AS status FROM supplier""")
def activated_model(t: Tables) -> DataFrame:
    """Another version becomes the active one."""
    models = t("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("version"), F.lit("clip").alias("embedding"), F.when(F.col("s_acctbal") > 0, "active").otherwise("candidate").alias("status"))
    return L.activated(models, "3", "clip").select("s_suppkey", "status")


@query(f"""
WITH p AS (SELECT *, source = 'src3' AS gone FROM {PHOTOS}), f AS (SELECT p.doc_id AS face, gone FROM p JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id))
SELECT 'photos' AS part, count(*) AS n FROM p UNION ALL SELECT 'photos with model', count(*) FROM p WHERE NOT gone UNION ALL SELECT 'thumbs', count(*) FROM p WHERE size > 500 AND NOT gone
UNION ALL SELECT 'analysis', count(*) FROM p WHERE lang <> 'en' UNION ALL SELECT 'faces', count(*) FROM f WHERE NOT gone
UNION ALL SELECT 'named', count(*) FROM labels WHERE doc_id NOT IN (SELECT face FROM f WHERE gone) UNION ALL SELECT 'apart', count(*) FROM labels WHERE doc_id NOT IN (SELECT face FROM f WHERE gone) AND doc_id + 1 NOT IN (SELECT face FROM f WHERE gone)
UNION ALL SELECT 'lost thumbs', count(*) FROM p WHERE size > 500 AND gone UNION ALL SELECT 'lost faces', count(*) FROM f WHERE gone""")
def cleaned_books(t: Tables) -> DataFrame:
    """Two categories of one source are cleaned, with all that hangs on their rows."""
    p = photos(t)
    faces = p.join(t("labels").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("face"), "path")
    known = t("labels")
    tables = {
        "photos": p.select("path", F.col("lang").alias("model")),
        "thumbs": p.where("size > 500").select("path"),
        "analysis": p.where("lang <> 'en'").select("path"),
        "faces": faces,
        "named": known.select(F.col("doc_id").alias("face"), "quality"),
        "apart": known.select(F.col("doc_id").alias("face_a"), (F.col("doc_id") + 1).alias("face_b")),
    }
    by_path = {"thumbs": ["thumbs"], "analysis": ["analysis"], "faces": ["faces"], "catalogue": ["photos"]}
    left, lost = L.cleaned(tables, "src3", {"thumbs", "faces"}, by_path, {"named": ("faces", "face", ["face"]), "apart": ("faces", "face", ["face_a", "face_b"])}, {"faces": ("photos", ["model"])})
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    out = lost.select(F.concat(F.lit("lost "), "table").alias("part"), "n").union(counted("photos with model", left["photos"].where("model IS NOT NULL")))
    for name, df in left.items():
        out = out.union(counted(name, df))
    return out


_KEYED = r"""CASE WHEN {0} = '' OR regexp_matches({0}, '(?s)^([a-z0-9][a-z0-9_-]{{1,31}}):(.*)$') THEN {0} ELSE 'pc-a:' || {0} END"""


@query(rf"""
WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'D:\' || lang || '\' || doc_id WHEN 1 THEN '/' || source || '/' || doc_id WHEN 2 THEN 'nas:/' || doc_id ELSE '' END AS path, source, lang FROM documents),
r AS (SELECT *, list_transform(list_value('', ' ' || path || ' ', chr(9) || '*.tmp', '', 'nas:/' || lang, ''), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines FROM p)
SELECT doc_id, CASE WHEN path <> '' AND instr(path, ':') <= 2 THEN 'pc-a:' || path ELSE path END AS path, trim(array_to_string(list_transform(lines, lambda x: {_KEYED.format("x")}), chr(10)), chr(10)) AS rules,
  array_to_string(list_transform(list_value(path, '/' || lang), lambda x: {_KEYED.format("x")}), '|') AS roots FROM r""")
def keyed_catalogue(t: Tables) -> DataFrame:
    """One computer's paths, rules and roots as those of a source."""
    k = F.col("doc_id") % 4
    text = F.col("doc_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("D:\\"), "lang", F.lit("\\"), text)).when(k == 1, F.concat(F.lit("/"), "source", F.lit("/"), text)).when(k == 2, F.concat(F.lit("nas:/"), text)).otherwise("")
    rows = t("documents").select("doc_id", path.alias("path"), "lang")
    rules = F.concat(F.lit("\r\n "), "path", F.lit(" \r\n\t*.tmp\n\nnas:/"), "lang", F.lit("\n"))
    made = rows.select("doc_id", "path", G.keyed_rules(rules, "pc-a").alias("rules"), F.array_join(G.keyed_list(F.array("path", F.concat(F.lit("/"), "lang")), "pc-a"), "|").alias("roots"))
    return G.keyed_columns(made, ["path"], "pc-a").select("doc_id", "path", "rules", "roots")


@query(f"""
WITH a AS (SELECT * FROM {ALBUMS}), b AS (SELECT id * 3 + 5 AS id, parent * 3 + 5 AS parent, CASE WHEN id % 4 = 1 THEN title || ' (2)' ELSE title END AS title FROM a),
ta AS (SELECT x.id, concat_ws('/', z.title, y.title, x.title) AS trail FROM a x LEFT JOIN a y ON y.id = x.parent LEFT JOIN a z ON z.id = y.parent), tb AS (SELECT x.id, concat_ws('/', z.title, y.title, x.title) AS trail FROM b x LEFT JOIN b y ON y.id = x.parent LEFT JOIN b z ON z.id = y.parent),
m AS (SELECT tb.id, coalesce(ta.id, tb.id + (SELECT max(id) FROM a)) AS new FROM tb LEFT JOIN ta USING (trail))
SELECT m.new AS id, u.new AS parent, b.title AS title FROM b JOIN m USING (id) LEFT JOIN m u ON u.id = b.parent""")
def rewritten_albums(t: Tables) -> DataFrame:
    """The other catalogue's albums under the ids that they have after merging."""
    a = albums(t)
    other = a.select((F.col("id") * 3 + 5).alias("id"), (F.col("parent") * 3 + 5).alias("parent"), F.when(F.col("id") % 4 == 1, F.concat("title", F.lit(" (2)"))).otherwise(F.col("title")).alias("title"))
    ids = G.same_titles(a, other)
    return G.rewritten(other, {"parent": ids, "id": ids}).select("id", "parent", "title")


@query()
def place_names(t: Tables) -> DataFrame:
    """Places of parts' names with the likest Cyrillic alternate."""
    latin, cyrillic = "abvgdeziklmnoprstuf", "абвгдезиклмнопрстуф"
    name = F.col("p_name")
    spelt = lambda c: F.regexp_replace(F.translate(F.lower(c), latin, cyrillic), "[^а-яё -]", "ы")
    others = F.concat_ws(",", name, spelt(F.reverse(name)), spelt(F.substring(name, 1, 6)), F.concat(spelt(name), F.lit("I")), spelt(name), spelt(F.col("p_brand")))
    rows = t("part").select(F.col("p_partkey").cast("string").alias("id"), name.alias("ascii"), others.alias("alternates"), F.when(F.col("p_size") < 5, "PPLX").otherwise("PPL").alias("kind"), F.lit("XX").alias("country"), F.col("p_size").cast("string").alias("lat"), F.col("p_retailprice").cast("string").alias("lon"), F.col("p_size").cast("string").alias("population"))
    return K.built(rows)


@query("""
WITH m AS (SELECT s_nationkey AS path, s_suppkey % 5 AS speaker, min(s_name) AS name FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1, 2),
f AS (SELECT c_nationkey AS path, c_custkey % 5 AS speaker, c_name AS name, round(c_acctbal / 10000, 3) AS confidence FROM customer WHERE c_custkey % 9 = 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY round(c_acctbal / 10000, 3) DESC, c_name) = 1),
v AS (SELECT p_size AS path, p_partkey % 5 AS speaker, p_name AS name, round(p_retailprice / 3000, 3) AS confidence FROM part QUALIFY row_number() OVER (PARTITION BY p_size, p_partkey % 5 ORDER BY round(p_retailprice / 3000, 3) DESC, p_name) = 1),
s AS (SELECT user_id % 60 AS path, event_id AS ord, event_type AS text, event_id % 5 AS speaker FROM events)
SELECT s.path AS path, ord, text, coalesce(m.name, f.name, v.name) AS name, CASE WHEN m.name IS NOT NULL THEN 1.0 WHEN f.name IS NOT NULL THEN f.confidence ELSE v.confidence END AS confidence,
  CASE WHEN m.name IS NOT NULL THEN 'manual' WHEN f.name IS NOT NULL THEN 'face' WHEN v.name IS NOT NULL THEN 'voice' END AS source, row_number() OVER (PARTITION BY s.path ORDER BY ord) AS position
FROM s LEFT JOIN m ON m.path = s.path AND m.speaker = s.speaker LEFT JOIN f ON f.path = s.path AND f.speaker = s.speaker LEFT JOIN v ON v.path = s.path AND v.speaker = s.speaker""")
def speech_pages(t: Tables) -> DataFrame:
    """Segments in order, each with the name of who speaks: by hand, by face, by voice."""
    who = lambda df, path, key, name: df.select(F.col(path).cast("long").alias("path"), (F.col(key) % 5).alias("speaker"), F.col(name).alias("name"), "confidence")
    hand = who(t("supplier").where("s_suppkey % 4 = 0").withColumn("confidence", F.lit(1.0)), "s_nationkey", "s_suppkey", "s_name")
    face = who(t("customer").where("c_custkey % 9 = 0").withColumn("confidence", F.round(F.col("c_acctbal") / 10000, 3)), "c_nationkey", "c_custkey", "c_name")
    voice = who(t("part").withColumn("confidence", F.round(F.col("p_retailprice") / 3000, 3)), "p_size", "p_partkey", "p_name")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    segments = t("events").select((F.col("user_id") % 60).alias("path"), F.col("event_id").alias("ord"), start.alias("start"), (start + 1).alias("stop"), F.col("event_type").alias("text"), (F.col("event_id") % 5).alias("speaker"))
    return C.speech(segments, hand, face, voice).drop("start", "stop", "speaker")


@query("""
WITH e AS (SELECT n_nationkey AS name, n_name AS text FROM nation), s AS (SELECT o_orderpriority AS model, c_nationkey AS name, n_name || CASE WHEN o_orderpriority LIKE '1%' AND c_nationkey % 3 = 0 THEN ' (old)' ELSE '' END AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT model, missing, missing = 0 AS current FROM (SELECT model, (SELECT count(*) FROM nation) - count(DISTINCT e.name) AS missing FROM s LEFT JOIN e ON e.name = s.name AND e.text = s.text GROUP BY 1)""")
def prompt_states(t: Tables) -> DataFrame:
    """Which models have all prompts with the texts of now."""
    expected = t("nation").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("text"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    old = F.col("o_orderpriority").startswith("1") & (F.col("c_nationkey") % 3 == 0)
    return O.prompt_states(expected, rows.select(F.col("o_orderpriority").alias("model"), F.col("c_nationkey").alias("name"), F.when(old, F.concat("n_name", F.lit(" (old)"))).otherwise(F.col("n_name")).alias("text")))


@query("""
SELECT CAST(doc_id // 20 AS VARCHAR) AS batch, lpad(CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS VARCHAR), 2, '0') || '.jpg' AS file, md5(text) AS digest FROM documents WHERE text IS NOT NULL""")
def review_archives(t: Tables) -> DataFrame:
    """All documents packed into archives of twenty, and what is in them read back."""
    items = t("documents").select(F.floor(F.col("doc_id") / 20).alias("id"), F.col("doc_id").alias("order"), F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    files = A.unpacked(A.packed(items, {"person": "somebody is seen", "text": "writing is seen"}, "clip")).where("file LIKE '%.jpg'")
    return files.select(F.col("id").alias("batch"), "file", F.md5("content").alias("digest"))


@query()
def grown_clusters(t: Tables) -> DataFrame:
    """Two steps of newly come vectors: to the nearest centre, the rest to clusters of its own; centres move between."""
    e = t("embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    third = F.col("key") % 3
    known = U.centre_sums(e.where((third == 0) & (F.col("label") < 5)).select("label", "vector"))
    first, sums = U.grown(known, e.where(third == 1).select("key", "vector"), 0.3)
    second, _ = U.grown(sums, e.where(third == 2).select("key", "vector"), 0.3)
    return first.select("key", "label", "how").union(second.select("key", "label", "how"))
