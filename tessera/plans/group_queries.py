"""Order-dependent operators inside natural groups; tested against exhaustive versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import vectors as V
from ..operators import calibration as KA
from ..operators import clusters as K
from ..operators import curation as C
from ..operators import hierarchy as H
from ..operators import identities as I
from ..operators import matching as M
from ..operators import people as P
from ..operators.snapshots import written
from ..streaming import tracker as TR
from .registry import Tables, query


def frames(t: Tables) -> DataFrame:
    """Events as frames: each with the vector that its number picks."""
    vectors = t("embeddings")
    e = vectors.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"), V.sign_hash(F.col("embedding")).alias("bits"))
    rows = t("events").withColumn("_v", F.pmod("event_id", F.lit(vectors.count())))
    rows = rows.join(e, "_v")
    return rows.select(F.col("user_id").alias("device"), F.col("event_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), (F.col("value") / 50).alias("score"), "vector", "bits", F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query()
def scene_sessions(t: Tables) -> DataFrame:
    """Events by time and scene."""
    return C.scene_events(frames(t), "device")


@query()
def series_collapse(t: Tables) -> DataFrame:
    """Repeats collapsed to their best frame."""
    return C.collapsed(frames(t), "device")


@query()
def mmr_highlights(t: Tables) -> DataFrame:
    """A diversified choice per device."""
    return C.highlights(frames(t), "device", 8, {"event": 0.25, "day": 0.08})


@query()
def choice_traces(t: Tables) -> DataFrame:
    """What became of every frame, and why."""
    return C.choice_trace(frames(t), "device", 8, {"event": 0.25, "day": 0.08})


@query()
def linkage(t: Tables) -> DataFrame:
    """Average-linkage clusters."""
    rows = t("embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return K.clustered(rows, "g")


@query()
def density_clusters(t: Tables) -> DataFrame:
    """Density clusters."""
    rows = t("embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return K.clustered(rows, "g", "density", radius=0.5)


@query()
def stitch(t: Tables) -> DataFrame:
    """Tracks of a file to identities under cannot-links."""
    rows = t("embeddings").select(F.col("label").alias("file"), F.floor(F.col("vec_id") / 25).alias("track"), F.pmod("vec_id", F.lit(7)).cast("double").alias("ts"), F.col("embedding").alias("vector"))
    return K.track_identities(rows, "file", 0.3)


@query()
def built_identities(t: Tables) -> DataFrame:
    """Identities of a file: cores stitched, weak tracks attached, fragments joined, a hint of three met."""
    rows = t("embeddings").select(F.col("label").alias("file"), F.floor(F.col("vec_id") / 25).alias("track"), F.pmod("vec_id", F.lit(7)).cast("double").alias("ts"), F.col("embedding").alias("vector"))
    rows = rows.withColumns({"quality": F.lit(1.0), "core": F.pmod("track", F.lit(3)) != 0, "people": F.lit(3)})
    return I.file_identities(rows, "file", 0.3, "people")


@query()
def compatible_parts(t: Tables) -> DataFrame:
    """Clusters cut into parts all of whose members are alike."""
    rows = t("embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return I.compatible_parts(rows, "g", 0.3)


@query("""
WITH c AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings WHERE vec_id % 3 = 0) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v) / sqrt(list_dot_product(v, v)), 6) AS sim FROM embeddings, c WHERE vec_id % 3 <> 0)
SELECT vec_id, CASE WHEN sim >= 0.3 THEN label ELSE -1 END AS label, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1""")
def assign_nearest(t: Tables) -> DataFrame:
    """New vectors to the nearest centroid, or to none."""
    e = t("embeddings")
    means = e.where("vec_id % 3 = 0").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    bank = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    bank = bank.select(F.col("label").alias("person"), F.col("label").alias("sample"), F.transform("v", lambda x: x / V.norm(F.col("v"))).alias("p"))
    sims = M.bank_scores(e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), bank)
    best = sims.groupBy("q").agg(F.max(F.struct("sim", (-F.col("person")).alias("m"))).alias("b"))
    return best.select(F.col("q").alias("vec_id"), F.when(F.col("b.sim") >= 0.3, -F.col("b.m")).otherwise(-1).alias("label"), "b.sim")


@query()
def whole_identities(t: Tables) -> DataFrame:
    """The whole build over files of three tracks and pictures of two faces: labels and names."""
    e = t("embeddings").select("vec_id", F.pmod("vec_id", F.lit(20)).alias("r"), F.floor(F.col("vec_id") / 20).alias("f"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    year = (2000 + F.pmod("f", F.lit(12))).cast("int").alias("year")
    samples = e.where("r < 12").select(F.concat(F.lit("v"), F.col("f").cast("string")).alias("file"), (1_000_000_000 + F.floor(F.col("vec_id") / 4)).alias("track"), F.pmod("r", F.lit(9)).cast("double").alias("ts"), (1 / (1 + F.col("r"))).alias("quality"), F.lit(True).alias("core"), "vector", year)
    stills = e.where("r >= 12").select(F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2).cast("string")).alias("file"), F.col("vec_id").alias("key"), F.lit(0.5).alias("quality"), "vector", year)
    given = e.where("r = 12").select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("person"))
    old = e.where("r >= 12").select(F.col("vec_id").alias("key"), "label")
    out = P.build(samples, stills, given, old, written, stitch=0.3, single=0.3, named=0.3, named_margin=0.05, child_margin=0.07, group_floor=0.2, least_group=2)
    people = out.names.join(out.units.select("unit", F.explode("members").alias("key")), "unit").select("key", "person")
    return out.labels.join(people, "key", "left")


@query()
def frame_tracks(t: Tables) -> DataFrame:
    """Tracks of what the frames of each device show, by boxes and vectors, closed after two days without a sight (J14, ST3)."""
    rows = frames(t).select(F.col("device").cast("string").alias("file"), F.timestamp_seconds("ts").alias("ts"), F.col("key").alias("id"), "vector", "score")
    x = F.pmod("id", F.lit(5)).cast("double")
    rows = rows.withColumn("box", F.array(x, x, x + 4, x + 4))
    out = TR.batch_tracks(rows, 172800.0)
    return out.select("file", "first", "last", "n", "best", F.transform("last_box", lambda c: F.round(c, 6)).alias("last_box"))


@query()
def earlier_tracks(t: Tables) -> DataFrame:
    """New tracks of a file that go on one of its earlier tracks, unless two come into question."""
    e = t("embeddings").select(F.floor(F.col("vec_id") / 200).alias("file"), F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(100)).cast("double").alias("start"), "embedding")
    rows = e.select("file", "id", "start", (F.col("start") + F.pmod("id", F.lit(9))).alias("stop"), F.col("embedding").alias("vector"))
    found = M.earlier_tracks(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), written, least=0.2, margin=0.02)
    return found.select("file", "id", "old_id", F.round("score", 6).alias("score"))


@query()
def calibrated_thresholds(t: Tables) -> DataFrame:
    """Thresholds of stitching tried on two thirds of the files and judged on the rest."""
    rows = t("embeddings").select(F.floor(F.col("vec_id") / 40).cast("string").alias("file"), F.floor(F.col("vec_id") / 4).alias("track"), F.pmod("vec_id", F.lit(9)).cast("double").alias("ts"), F.lit(1.0).alias("quality"), (F.pmod(F.floor(F.col("vec_id") / 4), F.lit(5)) != 0).alias("core"), F.col("embedding").alias("vector"), F.col("label").alias("person"))
    return KA.calibrated(rows, "file", written, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6))


@query("""
WITH l AS (SELECT doc_id, CAST(u.i AS INTEGER) - 1 AS frame, string_split(coalesce(text, ''), chr(10))[u.i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) u),
n AS (SELECT doc_id, frame, regexp_extract_all(line, '[0-9]+') AS found FROM l)
SELECT doc_id, frame, CAST(u.k AS INTEGER) - 1 AS number, CAST(length(found[u.k]) AS INTEGER) AS width FROM n, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS k) u""")
def file_detections(t: Tables) -> DataFrame:
    """One file to many rows: the numbers in each line of a text, by a detector."""
    rows = t("documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    found = D.detections(rows, F.col("lines"), D.number_detector)
    return found.select("doc_id", "frame", "number", (F.col("stop") - F.col("start")).alias("width"))


@query()
def density_hierarchy(t: Tables) -> DataFrame:
    """Density clusters of all vectors without a fixed radius."""
    rows = t("embeddings").select(F.lit(0).alias("g"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return H.hierarchical(rows, "g", written, size=3, least=0.3).select("key", "label")
