"""Scalar families on whole tables: keys, times, vectors, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scoring as S
from ..functions import times as D
from ..functions import vectors as V
from ..operators import tables as T
from .binding import PHOTOS, PLACES, photos, places
from .registry import Tables, query

def now():
    """The time that "not in the future" is judged by."""
    return F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))


@query(f"""
SELECT path, regexp_extract(path, '^([a-z0-9][a-z0-9_-]{{1,31}}):', 1) AS source, substr(path, instr(path, ':') + 1) AS native, '/' AS sep,
  true AS keyed, split_part(path, '/', -1) AS name, dir AS parent, lower('.' || split_part(path, '.', -1)) AS suffix, CAST(doc_id AS VARCHAR) AS stem,
  path || '/x/y' AS joined, split_part(path, ':', 1) AS short_source, false AS legacy, path AS trimmed FROM {PHOTOS}""")
def key_split(t: Tables) -> DataFrame:
    """Path keys taken apart and put together."""
    k = F.col("path")
    return photos(t).select(
        "path", P.source(k).alias("source"), P.native(k).alias("native"), P.separator(k).alias("sep"), P.is_key(k).alias("keyed"), P.name(k).alias("name"), P.parent(k).alias("parent"),
        P.suffix(k).alias("suffix"), P.stem(k).alias("stem"), P.joined(k, F.lit("/x/"), F.lit(""), F.lit("y")).alias("joined"), P.short_source(k).alias("short_source"), P.is_legacy(k).alias("legacy"), P.trimmed(F.concat(k, F.lit("//"))).alias("trimmed"),
    )


@query(f"""
SELECT path, source || ':/>' || dir || '>' || path AS chain, path LIKE 'src1:/%' AS in_source, path LIKE 'src1:/en/%' AS in_folder FROM {PHOTOS}""")
def key_chain(t: Tables) -> DataFrame:
    """Ancestors and folder tests."""
    k = F.col("path")
    return photos(t).select("path", F.array_join(P.chain(k), ">").alias("chain"), P.inside(k, "src1:/").alias("in_source"), P.inside(k, "src1:/en").alias("in_folder"))


@query(f"""
WITH p AS (SELECT path, lower(path) AS low, lower(substr(path, instr(path, ':') + 1)) AS nat FROM {PHOTOS})
SELECT path, ((nat LIKE '/de/%' OR nat = '/de') OR (low LIKE 'src3:/%') OR regexp_matches(nat, '^/fr/.*1.\\.jpg$'))
  AND NOT (low LIKE 'src3:/en/%') AS blocked FROM p""")
def rules_blocked(t: Tables) -> DataFrame:
    """Block and allow rules, with and without source, plain and glob."""
    return photos(t).select("path", P.blocked(F.col("path"), ['"\\DE\\"', "src3:", "/fr/*1?.jpg"], ["SRC3:/en/"]).alias("blocked"))


@query(f"""
SELECT DISTINCT dir, NOT ((dir LIKE 'src3:/%' OR dir = 'src3:/') AND dir <> 'src3:/en') OR dir = 'src3:/de' AS enters FROM {PHOTOS}""")
def prune_folders(t: Tables) -> DataFrame:
    """A walk enters a blocked folder only for an allow rule at or below it (P5)."""
    return photos(t).select("dir").distinct().select("dir", P.enterable(F.col("dir"), ["src3:"], ["src3:/en", "src3:/de/deep"]).alias("enters"))


@query(r"""
SELECT conv_id, turn, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120) AS title FROM conversations""")
def album_titles(t: Tables) -> DataFrame:
    """Titles in one form."""
    return t("conversations").select("conv_id", "turn", P.clean_title(F.col("text")).alias("title"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_salvage(t: Tables) -> DataFrame:
    """JSON out of a fenced answer."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return t("events").select("event_id", F.from_json(P.salvaged_json(answer), "k long")["k"].alias("k"))


@query(f"""
SELECT path, substr(sha1(path), 1, 2) || '/' || sha1(path) || '.jpg' AS slot FROM {PHOTOS}""")
def slot_names(t: Tables) -> DataFrame:
    """File names from hashes (F16)."""
    return photos(t).select("path", P.slot_name(F.col("path")).alias("slot"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1990-01-01' THEN o_orderdate END AS exif FROM orders""")
def exif_times(t: Tables) -> DataFrame:
    """Camera time stamps in four patterns."""
    k = F.pmod("o_orderkey", F.lit(3))
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t("orders").select("o_orderkey", D.parsed_exif(raw, now()).alias("exif"))


@query("""
SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('milliseconds', ts) WHEN 2 THEN date_trunc('day', ts) + INTERVAL 12 HOURS END AS at,
  CASE event_id % 4 WHEN 0 THEN 'filename' WHEN 1 THEN 'epoch-name' WHEN 2 THEN 'filename-date' END AS how,
  CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 END AS trust FROM events""")
def filename_times(t: Tables) -> DataFrame:
    """Times from file names."""
    k = F.pmod("event_id", F.lit(4))
    stem = F.when(k == 0, F.concat(F.lit("IMG_"), F.date_format("ts", "yyyyMMdd_HHmmss"))).when(k == 1, F.concat(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("_x"))).when(k == 2, F.concat(F.lit("IMG-"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-WA0007"))).otherwise(F.lit("no time"))
    named = D.time_from_name(stem, now())
    return t("events").select("event_id", named["at"].alias("at"), named["how"].alias("how"), D.trust(named["how"]).alias("trust"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts ELSE ts END AS at, CASE event_id % 3 WHEN 0 THEN 'exif' WHEN 1 THEN 'filename' ELSE 'mtime' END AS how,
  CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS wall FROM events""")
def taken_times(t: Tables) -> DataFrame:
    """Best known time and its provenance."""
    k = F.pmod("event_id", F.lit(3))
    ts = F.col("ts").cast("timestamp_ntz")
    taken = D.taken_time(F.when(k == 0, ts), F.when(k == 1, F.date_format("ts", "yyyyMMdd")).otherwise(F.lit("x")), ts, now())
    rows = t("events").select("event_id", taken.alias("taken"))
    return rows.select("event_id", "taken.at", "taken.how", D.wall_seconds(F.col("taken.at")).alias("wall"))


@query("""
SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) - year(o_orderdate) % 3 AS period, count(*) AS n
FROM orders GROUP BY ALL""")
def calendar_buckets(t: Tables) -> DataFrame:
    """Orders by year, month and day."""
    d = F.col("o_orderdate")
    return t("orders").groupBy(F.year(d).alias("year"), F.date_format(d, "yyyy-MM").alias("month"), F.date_format(d, "yyyy-MM-dd").alias("day"), D.period(F.year(d), 3).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, 2004 - year(o_orderdate) AS years, CASE WHEN 2004 - year(o_orderdate) = 1 THEN '1 year ago' ELSE (2004 - year(o_orderdate)) || ' years ago' END AS title
FROM orders WHERE year(o_orderdate) < 2004 AND abs(date_diff('day', DATE '2004-02-28',
  CAST(o_orderdate AS DATE) + to_years(CAST(2004 - year(o_orderdate) AS INTEGER)))) <= 2""")
def anniversary(t: Tables) -> DataFrame:
    """On this day, two days around."""
    today, d = F.lit("2004-02-28").cast("date"), F.col("o_orderdate").cast("date")
    rows = t("orders").where((F.year(d) < F.year(today)) & (F.abs(D.anniversary_offset(d, today)) <= 2))
    years = F.year(today) - F.year(d)
    return rows.select("o_orderkey", years.alias("years"), D.years_ago(years).alias("title"))


@query("""
SELECT o_custkey, CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN strftime(a, '%-d %B %Y') WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%-d') || '–' || strftime(b, '%-d %B %Y')
  WHEN year(a) = year(b) THEN strftime(a, '%-d %B') || ' – ' || strftime(b, '%-d %B %Y') ELSE strftime(a, '%-d %B %Y') || ' – ' || strftime(b, '%-d %B %Y') END AS title
FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)""")
def range_titles(t: Tables) -> DataFrame:
    """Titles of date ranges."""
    rows = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return rows.select("o_custkey", D.range_title(F.col("a"), F.col("b")).alias("title"))


@query("""
SELECT event_id, ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS AS expired FROM events""")
def batch_expiry(t: Tables) -> DataFrame:
    """Batches older than a week at a given time."""
    return t("events").select("event_id", (F.col("ts") < F.lit("2024-01-20").cast("timestamp") - F.expr("INTERVAL 7 DAYS")).alias("expired"))


@query("""
SELECT event_id, round(greatest(0, least(1, (value - 5) / 20)), 6) AS ramp, round(1 / (1 + exp(-(value - 10) / 4)), 6) AS logistic,
  CAST(greatest(4, least(16, round_even(1.6 * sqrt(event_id % 200), 0))) AS INTEGER) AS target FROM events""")
def ramps(t: Tables) -> DataFrame:
    """Ramps, logistic calibration, target sizes."""
    v = F.col("value")
    return t("events").select("event_id", F.round(S.ramp(v, 5, 25), 6).alias("ramp"), F.round(S.logistic(v, 10, 4), 6).alias("logistic"), S.target_size(F.pmod("event_id", F.lit(200)), 1.6, 4, 16).alias("target"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), f AS (SELECT e AS e0 FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, e0) / sqrt(list_dot_product(e0, e0)), 6) AS cosine, round(sqrt(list_dot_product(e, e)), 6) AS length FROM v, f""")
def vector_products(t: Tables) -> DataFrame:
    """Unit vectors and cosine to one query vector (M2, M3)."""
    e = t("embeddings")
    probe = F.broadcast(e.where("vec_id = 0").select(V.unit(F.col("embedding")).alias("probe")))  # one row
    rows = e.join(probe, F.lit(True)).select("vec_id", V.unit(F.col("embedding")).alias("u"), "embedding", "probe")
    return rows.select("vec_id", F.round(V.dot(F.col("u"), F.col("probe")) * V.norm(F.col("embedding")), 6).alias("cosine"), F.round(V.norm(F.col("embedding")), 6).alias("length"))


@query("""
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x, (vec_id % 5) + 1 AS w FROM embeddings)
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(sum(CAST(x AS DOUBLE) * w) / sum(w), 6) AS weighted FROM e GROUP BY ALL""")
def centroids(t: Tables) -> DataFrame:
    """Plain and weighted mean vectors per group, component by component (M4-M6)."""
    rows = t("embeddings").select("label", (F.pmod("vec_id", F.lit(5)) + 1).alias("w"), F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    return rows.groupBy("label", "pos").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.sum(x * F.col("w")) / F.sum("w"), 6).alias("weighted"))


@query("""
WITH h AS (SELECT vec_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) ELSE 0 END)), lambda a, b: a * 2 + b) AS h FROM embeddings)
SELECT vec_id, h AS hash, CAST(bit_count(xor(h, (SELECT h FROM h WHERE vec_id = 0))) AS INTEGER) AS distance FROM h""")
def sign_hashes(t: Tables) -> DataFrame:
    """Sign hashes and their Hamming distance to one (M7, M8)."""
    rows = t("embeddings").select("vec_id", V.sign_hash(F.col("embedding")).alias("hash"))
    probe = F.broadcast(rows.where("vec_id = 0").select(F.col("hash").alias("probe")))  # one row
    return rows.join(probe, F.lit(True)).select("vec_id", "hash", V.hamming(F.col("hash"), F.col("probe")).alias("distance"))


@query(f"""
SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(48.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin((radians(11.0) - radians(lon)) / 2), 2)))), 3) AS km FROM {PLACES}""")
def distances(t: Tables) -> DataFrame:
    """Great-circle distances (M9)."""
    return places(t).select("s_suppkey", F.round(V.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0)), 3).alias("km"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS l, l_discount * 100 AS t, l_quantity + 20 AS r, l_discount * 100 + 10 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l, t, round(greatest(0, least(r, 40) - greatest(l, 10)) * greatest(0, least(b, 12) - greatest(t, 2)) / ((r - l) * (b - t) + 300 - greatest(0, least(r, 40) - greatest(l, 10)) * greatest(0, least(b, 12) - greatest(t, 2))), 6) AS iou,
  greatest(0, least(r, 40) - greatest(l, 10)) AS shared, l <= 40 + 0.75 AND 10 <= r + 0.75 AS near FROM b""")
def boxes_and_ranges(t: Tables) -> DataFrame:
    """Box overlap, interval overlap, proximity."""
    left, top = F.col("l_quantity"), F.col("l_discount") * 100
    box = F.array(left, top, left + 20, top + 10)
    fixed = F.array(*map(F.lit, (10.0, 2.0, 40.0, 12.0)))
    return t("lineitem").select("l_orderkey", "l_linenumber", left.alias("l"), top.alias("t"), F.round(V.iou(box, fixed), 6).alias("iou"), V.overlap_seconds(left, left + 20, F.lit(10.0), F.lit(40.0)).alias("shared"), V.near_in_time(left, left + 20, F.lit(10.0), F.lit(40.0), 0.75).alias("near"))


@query("""
WITH g AS (SELECT l_orderkey, list(CASE l_returnflag WHEN 'A' THEN 1e0 WHEN 'N' THEN 0.6e0 ELSE 0.2e0 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS w FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(1 - list_reduce(list_prepend(1e0, list_transform(w, lambda x: 1 - 0.85e0 * x)), lambda a, b: a * b), 6) AS personal,
  round(list_reduce(w, lambda a, b: a * 0.6e0 + b * 0.4e0), 6) AS ema FROM g""")
def identity_weights(t: Tables) -> DataFrame:
    """Complement product of identity weights, and a moving average."""
    weight = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.6).otherwise(0.2)
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", weight.alias("w")))).alias("g"))  # one order's lines
    w = F.col("g.w")
    return rows.select("l_orderkey", F.round(S.complement_product(w), 6).alias("personal"), F.round(S.moving_average(w), 6).alias("ema"))


@query("""
WITH p AS (SELECT doc_id, least(1, n_chars / 4000.0) AS a, CAST(quality AS DOUBLE) AS b, CASE WHEN toxic = 0 THEN 0.9 END AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round((0.4 * a + coalesce(0.35 * b, 0) + coalesce(0.25 * c, 0)) / (0.4 + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END), 6) AS score FROM p""")
def weighted_parts(t: Tables) -> DataFrame:
    """Weighted mean of known parts."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", F.round(S.known_mean([(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 0.4), (F.col("quality").cast("double"), 0.35), (F.when(F.col("toxic") == 0, 0.9), 0.25)]), 6).alias("score"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS safe, l_tax * 10 AS et, (l_quantity % 10) / 10 AS q, (l_quantity % 7) / 7 AS ex, (l_quantity % 11) / 11 AS nu, (l_quantity % 13) / 13 AS su FROM lineitem),
f AS (SELECT *, safe >= 0.9 AND greatest(et, q) < 0.25 AS calm, et >= greatest(safe, q) AND et > safe AS le, q >= greatest(safe, et) AND q > safe AS lq FROM r),
g AS (SELECT *, et >= 0.35 OR q >= 0.35 OR le OR lq AS support FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (ex >= 0.62 AND NOT calm) OR (ex >= 0.45 AND support) OR (et >= 0.75 AND le) THEN 'explicit'
  WHEN (nu >= 0.62 AND NOT calm) OR (nu >= 0.45 AND support) OR (et >= 0.6 AND (le OR lq)) THEN 'nudity'
  WHEN (su >= 0.6 AND support) OR (q >= 0.65 AND lq) THEN 'suggestive' ELSE 'safe' END AS rating FROM g""")
def rating_ladder(t: Tables) -> DataFrame:
    """Content rating by two opinions."""
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.content_rating(F.col("l_discount") * 10, F.col("l_tax") * 10, (q % 10) / 10, (q % 7) / 7, (q % 11) / 11, (q % 13) / 13).alias("rating"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 20 THEN '1/' || CAST(round_even(1 / (p_size / 100.0 + 0.01), 0) AS INTEGER) || ' s' ELSE printf('%.1f', p_size / 10.0) || ' s' END AS exposure,
  round(CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_size + 30 / 60.0 + 36 / 3600.0), 6) AS degrees, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1000 THEN 'middle' ELSE 'low' END AS verdict FROM part""")
def metadata_text(t: Tables) -> DataFrame:
    """Formatted metadata, decimal degrees, verdicts."""
    size = F.col("p_size")
    exposure = F.when(size < 20, S.exposure_text(size / 100.0 + F.lit(0.01))).otherwise(F.concat(F.format_string("%.1f", size / 10.0), F.lit(" s")))
    degrees = V.decimal_degrees(size.cast("double"), F.lit(30.0), F.lit(36.0), F.when(size % 2 == 0, F.lit("S")).otherwise(F.lit("N")))
    price = F.col("p_retailprice")
    return t("part").select("p_partkey", exposure.alias("exposure"), F.round(degrees, 6).alias("degrees"), S.first_of((price >= 1500, "high"), (price >= 1000, "middle"), otherwise="low").alias("verdict"))


@query("""
SELECT event_id, round(percent, 6) AS percent, mid FROM (SELECT event_id, (rank() OVER (PARTITION BY event_type ORDER BY value) - 1) * 1.0 / count(*) OVER (PARTITION BY event_type) AS percent, median(value) OVER (PARTITION BY event_type) AS mid FROM events)""")
def percent_rank(t: Tables) -> DataFrame:
    """Share of smaller scores and the median, by group."""
    e = t("events").select("event_id", "event_type", "value")
    ranks = T.standings(e, "event_type", "value")
    return e.join(ranks, ["event_type", "value"]).select("event_id", F.round(F.col("below") / F.col("total"), 6).alias("percent"), F.col("median").alias("mid"))


@query("""
WITH s AS (SELECT e.vec_id, p.vec_id AS prompt, round(list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(p.embedding, lambda x: CAST(x AS DOUBLE))), 9) AS sim FROM embeddings e, embeddings p WHERE p.vec_id < 6),
z AS (SELECT *, (sim - avg(sim) OVER (PARTITION BY prompt)) / stddev_pop(sim) OVER (PARTITION BY prompt) AS z FROM s)
SELECT vec_id, arg_max(prompt, round(z, 6) * 1000 - prompt) AS prompt, round(max(z), 4) AS z FROM z GROUP BY vec_id""")
def theme_z(t: Tables) -> DataFrame:
    """Best prompt by z-score of its similarity over all files."""
    e = t("embeddings")
    prompts = F.broadcast(e.where("vec_id < 6").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("p")))  # six rows
    sims = e.join(prompts, F.lit(True)).select("vec_id", "prompt", F.round(V.dot(F.col("embedding"), F.col("p")), 9).alias("sim"))
    facts = F.broadcast(sims.groupBy("prompt").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("sd")))
    z = sims.join(facts, "prompt").withColumn("z", (F.col("sim") - F.col("mean")) / F.col("sd"))
    best = F.max_by("prompt", F.round("z", 6) * 1000 - F.col("prompt"))
    return z.groupBy("vec_id").agg(best.alias("prompt"), F.round(F.max("z"), 4).alias("z"))
