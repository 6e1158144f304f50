"""Registered queries over the driver's tables, each with SQL for DuckDB that gives the same rows.

Events stand for frames (slot = user_id, frame = event_id, content = event_type), embeddings for tile
descriptors, part for measured settings (cost = p_size, error = p_retailprice).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import colour, scalars
from .operators import change, guards, measure, ordered
from .sources import listings, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FPS = "15625.0 / 264"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Change capture.


@query("""
SELECT event_id, user_id, event_type FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
) WHERE event_id % 90 = 0 OR n = 1 OR event_type IS DISTINCT FROM p
""")
def snapshot_delta(spark, d):
    """FLT-1, WIN-1, STF-5: the change log of every slot, with snapshots at keyframes."""
    events = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return change.deltas(events, "user_id", "event_id", "event_type", F.col("event_id") % 90 == 0).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, user_id, first_value(event_type) OVER (PARTITION BY user_id, event_id // 4 ORDER BY event_id) AS held FROM events
""")
def frame_hold(spark, d):
    """WIN-2."""
    return change.hold(read(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", 4).select("event_id", "user_id", "held")


@query("SELECT user_id, max(event_id) AS at, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def log_replay(spark, d):
    """STF-6: the state of every slot at the last frame."""
    events = read(spark, d, "events")
    last = events.agg(F.max("event_id")).first()[0]
    return change.replay(events, "user_id", "event_id", last if last is not None else 0, "event_type", "value")


@query("""
SELECT event_id, user_id, event_type IS DISTINCT FROM shown AS pending FROM (
    SELECT *, last_value(CASE WHEN value > 100 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events)
""")
def change_backlog(spark, d):
    """FLT-2, STF-3, SET-2: changes below the threshold that wait."""
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return change.backlog(events, "user_id", "event_id", "event_type", F.col("value") > 100).select("event_id", "user_id", "pending")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
k AS (SELECT *, n - last_value(CASE WHEN value > 200 OR n = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM n)
SELECT event_id, user_id, s % 8 = 0 AS is_key, (sum((s % 8 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "group" FROM k
""")
def keyframe_cadence(spark, d):
    """WIN-3, WIN-4, FLT-4: keyframes at cuts and after an interval, numbered groups."""
    found = change.keyframes(read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", F.col("value") > 200, 8)
    return found.select("event_id", "user_id", "is_key", "group")


@query("""
WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
SELECT doc_id, i AS tile_index FROM documents JOIN (SELECT text, row_number() OVER (ORDER BY first) - 1 AS i FROM f) USING (text)
""")
def dictionary_intern(spark, d):
    """JON-2, AGG-1: a dense key of each distinct text by first appearance."""
    return change.intern(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "tile_index")


@query("""
WITH f AS (SELECT source, text, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT doc_id, i AS tile_index FROM documents JOIN (SELECT source, text, row_number() OVER (ORDER BY first) - 1 AS i FROM f) USING (source, text)
""")
def dictionary_epochs(spark, d):
    """AGG-2, STF-8: the same content in two scopes counts twice."""
    return change.intern(read(spark, d, "documents").select("doc_id", "source", "text"), "text", "doc_id", "source").select("doc_id", "tile_index")


@query("""
WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN i < 300 THEN i END AS tile_index FROM documents JOIN (SELECT text, row_number() OVER (ORDER BY first) - 1 AS i FROM f) USING (text)
""")
def dictionary_capped(spark, d):
    """AGG-3, SRT-7: keys after the capacity are refused, old ones still resolve."""
    return change.intern_capped(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 300).select("doc_id", "tile_index")


@query("""
WITH t AS (SELECT o_orderkey AS k, [o_custkey % 3, o_custkey // 3 % 3, o_custkey // 9 % 3] AS a FROM orders),
c AS (SELECT k, a, least(array_to_string(a, ','), array_to_string(list_reverse(a), ',')) AS key FROM t),
f AS (SELECT key, min(k) AS first, arg_min(array_to_string(a, ','), k) AS base FROM c GROUP BY key)
SELECT k, i AS tile_index, array_to_string(a, ',') <> base AS flipped FROM c JOIN (SELECT *, row_number() OVER (ORDER BY first) - 1 AS i FROM f) USING (key)
""")
def dictionary_mirrors(spark, d):
    """JON-3: arrays and their mirror images are one entry."""
    c = F.col("o_custkey")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array(c % 3, F.floor(c / 3) % 3, F.floor(c / 9) % 3).alias("a"))
    return change.intern_mirrors(rows, "a", "k").select("k", "tile_index", "flipped")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT * FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1))
SELECT l_orderkey, min(l_linenumber) AS start, count(*) AS n FROM i GROUP BY l_orderkey, run
""")
def run_length(spark, d):
    """WIN-5: consecutive positions as runs; repeated positions count once."""
    lines = read(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct()
    return change.runs(lines, ["l_orderkey"], "l_linenumber").select("l_orderkey", "start", "n")


@query("""
SELECT user_id, s AS start, least(e, lead(s) OVER w) AS "end" FROM (SELECT user_id, event_id AS s, event_id + 200 AS e FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s, e) QUALIFY coalesce(least(e, lead(s) OVER w), e) > s
""")
def span_trim(spark, d):
    """WIN-9."""
    spans = read(spark, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 200).alias("end"))
    return change.trim_spans(spans, "start", "end", "user_id")


@query("""
WITH b AS (SELECT user_id, event_id, round(value / 50) AS e, min(round(value / 50)) OVER (PARTITION BY user_id) AS m FROM events),
r AS (SELECT *, sum((e > m)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run, first_value(event_id) OVER (PARTITION BY user_id ORDER BY e, event_id) AS best FROM b)
SELECT r.user_id, r.event_id FROM r JOIN r h ON h.user_id = r.user_id AND h.event_id = h.best AND h.run = r.run WHERE r.e = r.m
""")
def tie_run(spark, d):
    """WIN-10, SET-3."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") / 50).alias("e"))
    return change.tie_run(rows, "user_id", "event_id", "e").select("user_id", "event_id")


# Lookups.


def _descriptors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Integer descriptors, and as a codebook the first one of each label."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    return e.select("vec_id", "v"), e.groupBy("label").agg(F.min("vec_id").alias("centre"), F.min_by("v", "vec_id").alias("cv")).select("centre", "cv")


@query("SELECT event_id, (SELECT coalesce(max(k), (SELECT min(event_id) FROM events WHERE event_id % 90 = 45)) FROM (SELECT event_id AS k FROM events WHERE event_id % 90 = 45) WHERE k <= e.event_id) AS keyframe FROM events e")
def asof_keyframe(spark, d):
    """JON-7, JON-8, WIN-8, WIN-13, STF-9: the last keyframe at or before each frame."""
    events = read(spark, d, "events").select("event_id")
    return ordered.asof(events, "event_id", events.where("event_id % 90 = 45"), "event_id", "keyframe")


@query("SELECT e.event_id, s.event_id AS cue FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_id % 300 = 10) s ON e.event_id >= s.event_id AND e.event_id < s.event_id + 120")
def interval_lookup(spark, d):
    """JON-9: the cue whose half-open interval holds each frame."""
    events = read(spark, d, "events").select("event_id")
    spans = events.where("event_id % 300 = 10").select(F.col("event_id").alias("cue"), (F.col("event_id") + 120).alias("end"))
    return ordered.interval(events, "event_id", spans, "cue", "end")


@query("SELECT count(*) AS n, min(s) AS least, max(e) AS most FROM (SELECT greatest(event_id, 100) AS s, least(event_id + 200, 5100) AS e FROM events WHERE event_id + 200 > 100 AND event_id < 5100)")
def window_overlap(spark, d):
    """FLT-9: cues clipped to a window; cue_records also rebases and encodes them."""
    e = read(spark, d, "events").select("event_id").where("event_id + 200 > 100 AND event_id < 5100")
    return e.select(F.greatest("event_id", F.lit(100)).alias("s"), F.least(F.col("event_id") + 200, F.lit(5100)).alias("e")).agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("e").alias("most"))


@query("""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
b AS (SELECT arg_min(vec_id, vec_id) AS centre, arg_min(v, vec_id) AS v FROM q JOIN embeddings USING (vec_id) GROUP BY label),
p AS (SELECT q.vec_id, b.centre, list_aggregate(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum') AS distance FROM q JOIN b ON true)
SELECT vec_id, centre, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centre) AS r FROM p) WHERE r = 1
""")
def nearest_match(spark, d):
    """JON-4, JON-6, PRJ-12: the nearest of a small codebook for each descriptor."""
    v, centres = _descriptors(spark, d)
    return measure.nearest(v, "vec_id", "v", centres, "centre", "cv")


@query("""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
b AS (SELECT arg_min(vec_id, vec_id) AS centre, arg_min(v, vec_id) AS v FROM q JOIN embeddings USING (vec_id) GROUP BY label),
p AS (SELECT q.vec_id, b.centre, list_aggregate(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum') AS distance FROM q JOIN b ON true)
SELECT vec_id, centre, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centre) AS r FROM p) WHERE r <= 4
""")
def shortlist(spark, d):
    """JON-5, SRT-2, SRT-3: the k nearest of a codebook, ties to the smaller number."""
    v, book = _descriptors(spark, d)
    near = v.select("vec_id", F.posexplode(measure.shortlist(F.col("v"), measure.codebook(book, "centre", "cv"), 4)).alias("pos", "x"))
    return near.select("vec_id", F.col("x.centre").alias("centre"), (F.col("pos") + 1).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, d):
    """JON-1, JON-14: equi lookups against dimensions; only the joined columns are read."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return found.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unsettled(spark, d):
    """JON-15, FLT-8: keys without a large enough reading."""
    large = read(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return read(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_size AS cost, round(exp(CASE WHEN p_size < 10 THEN ln(1.5) + (ln(p_size) - ln(1)) * (ln(12) - ln(1.5)) / (ln(10) - ln(1)) ELSE ln(12) + (ln(p_size) - ln(10)) * (ln(40) - ln(12)) / (ln(50) - ln(10)) END), 6) AS bent FROM part")
def log_rescale(spark, d):
    """JON-10: log-log interpolation over anchors."""
    return read(spark, d, "part").select(F.col("p_size").alias("cost"), F.round(measure.rescale(F.col("p_size"), {1.0: 1.5, 10.0: 12.0, 50.0: 40.0}), 6).alias("bent"))


@query("SELECT s_suppkey, arg_min(n_nationkey, (abs(s_acctbal - n_nationkey * 400), n_nationkey)) AS n_nationkey FROM supplier JOIN nation ON true GROUP BY s_suppkey")
def nearest_scalar(spark, d):
    """JON-11, JON-16: the rung with the least difference, the first on ties, of a ladder with a rung for each nation."""
    rungs = F.array(*(F.struct(F.abs(F.col("s_acctbal") - 400 * r[0]), F.lit(r[0]).alias("rung")) for r in read(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").limit(1000).collect()))
    return read(spark, d, "supplier").select("s_suppkey", F.array_min(rungs)["rung"].alias("n_nationkey"))


# Measurement.


@query("SELECT p_size, p_retailprice FROM (SELECT p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY p_size) QUALIFY p_retailprice < coalesce(min(p_retailprice) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)")
def pareto_frontier(spark, d):
    """AGG-15."""
    return measure.frontier(read(spark, d, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM part o WHERE o.p_size <= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size < p.p_size OR o.p_retailprice < p.p_retailprice))")
def dominated_points(spark, d):
    """JON-12: without a theta join."""
    return measure.dominated(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey")


@query("SELECT p_size, m FROM (SELECT p_size, avg(p_retailprice) AS m, lag(avg(p_retailprice)) OVER (ORDER BY p_size) AS b FROM part GROUP BY p_size) WHERE m > b")
def ladder_inversions(spark, d):
    """JON-13, AGG-17."""
    ladder = read(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    return measure.inversions(ladder, "p_size", "m").select("p_size", "m")


@query("SELECT event_type, greatest(1e-6, quantile_cont(value, 0.99)) AS floor FROM events GROUP BY event_type")
def movement_floor(spark, d):
    """AGG-12: an exact interpolated percentile."""
    return read(spark, d, "events").groupBy("event_type").agg(F.greatest(F.lit(1e-6), F.expr("percentile(value, 0.99)")).alias("floor"))


@query("SELECT event_type, count(*) AS n, max(value) AS most, bool_or(value > 400) AS over, count(*) FILTER (value > 100) AS cuts FROM events GROUP BY event_type")
def run_statistics(spark, d):
    """AGG-11, AGG-13, STF-15, FLT-7."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.bool_or(F.col("value") > 400).alias("over"), F.count_if(F.col("value") > 100).alias("cuts"))


@query("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS tiles FROM documents GROUP BY lang, source")
def tile_rate(spark, d):
    """AGG-4, AGG-14, SET-4: counts and distinct contents by group."""
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("tiles"))


@query("SELECT label, v AS color, n FROM (SELECT label, v, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, v) AS r FROM (SELECT label, unnest(list_transform(embedding, lambda x: floor(16 * x::DOUBLE)::BIGINT)) AS v FROM embeddings) GROUP BY label, v) WHERE r <= 15")
def frequent_values(spark, d):
    """SRT-3, AGG-4: the 15 most frequent values of each cluster, ties to the smaller."""
    values = read(spark, d, "embeddings").select("label", F.explode(F.transform("embedding", lambda x: F.floor(x.cast("double") * 16))).alias("color"))
    counts = values.groupBy("label", "color").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "color"))
    return counts.withColumn("r", place).where("r <= 15").drop("r")


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS mean, list_min(embedding)::DOUBLE AS darkest, list_max(embedding)::DOUBLE AS brightest, (list_position(embedding, list_min(embedding)) - 1)::INT AS at FROM embeddings")
def tile_descriptor(spark, d):
    """AGG-8: mean, darkest and brightest, first on ties."""
    e = F.col("embedding")
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(e)
    return read(spark, d, "embeddings").select("vec_id", F.round(mean, 9).alias("mean"), F.array_min(e).cast("double").alias("darkest"), F.array_max(e).cast("double").alias("brightest"), (F.array_position(e, F.array_min(e)) - 1).cast("int").alias("at"))


@query()
def palette_kmeans(spark, d):
    """AGG-5, AGG-6, AGG-7: vectors as tiles of 64 colours, clustered by descriptor, a palette of 15 real colours for each cluster."""
    from .operators.palettes import palette_set

    colours = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 16384), F.lit(0)), F.lit(32767)).cast("int"))
    return palette_set(read(spark, d, "embeddings").select(colours.alias("px")), colour.colour_grid(spark), 4, 16, 5)


# Functions.


@query()
def colour_levels(spark, d):
    """PRJ-8, WIN-11: the level table; held against the same rule in the tests."""
    return spark.createDataFrame(list(enumerate(colour.level_table())), "level int, value int")


_LEVELS = "[" + ", ".join(map(str, colour.level_table())) + "]"


@query(f"""
WITH l AS (SELECT {_LEVELS} AS t), c AS (SELECT id AS color, t[((id >> 10) & 31) + 1] AS r, t[((id >> 5) & 31) + 1] AS g, t[(id & 31) + 1] AS b FROM range(32768) AS x(id), l),
f AS (SELECT color, r, g, b, CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END AS x, CASE WHEN g / 255.0 <= 0.04045 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END AS y, CASE WHEN b / 255.0 <= 0.04045 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END AS z FROM c),
k AS (SELECT *, cbrt({" + ".join(f"{m}::DOUBLE * {v}" for m, v in zip(colour.TO_CONE[0], "xyz", strict=True))}) AS l0, cbrt({" + ".join(f"{m}::DOUBLE * {v}" for m, v in zip(colour.TO_CONE[1], "xyz", strict=True))}) AS l1, cbrt({" + ".join(f"{m}::DOUBLE * {v}" for m, v in zip(colour.TO_CONE[2], "xyz", strict=True))}) AS l2 FROM f)
SELECT color::INT AS color, r::INT AS r, g::INT AS g, b::INT AS b, floor(1e6 * ({" + ".join(f"({m})::DOUBLE * l{i}" for i, m in enumerate(colour.TO_LAB[0]))}) + 0.123)::BIGINT AS light FROM k
""")
def colour_grid(spark, d):
    """PRJ-7, PRJ-9, PRJ-10: all colours with their lightness, in millionths."""
    return colour.colour_grid(spark).select("color", "r", "g", "b", F.floor(F.col("L") * 1e6 + 0.123).alias("light"))


_NEAREST = "[" + ", ".join(map(str, colour.nearest_levels())) + "]"


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem), l AS (SELECT {_NEAREST} AS t),
i AS (SELECT l_orderkey, l_linenumber, (t[r + 1] << 10) | (t[g + 1] << 5) | t[b + 1] AS c FROM p, l)
SELECT l_orderkey, l_linenumber, c::INT AS color, ((((c >> 10) & 1) << 14) | (((c >> 5) & 1) << 13) | ((c & 1) << 12) | (((c >> 11) & 15) << 8) | (((c >> 6) & 15) << 4) | ((c >> 1) & 15))::INT AS word FROM i
""")
def colour_index(spark, d):
    """PRJ-6, PRJ-7, JON-1: 8-bit colours to indices and hardware words."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", colour.index_of_rgb(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256).alias("color"))
    return rows.select("l_orderkey", "l_linenumber", "color", colour.palette_word(F.col("color")).alias("word"))


@query(f"""
SELECT event_id, floor(value * {FPS})::BIGINT AS frames, greatest(1, round_even({FPS} / nullif(value / 10, 0), 0))::BIGINT AS hold, floor(event_id * 60 * 15625.0 / 264)::BIGINT AS seconds_frames, ((event_id * 3 + 7 // 2) // 7) & 65535 AS page, CASE WHEN event_id >= 5000 THEN 40 ELSE event_id * 40 // 5000 END AS bar, greatest(0, least(event_id, 2999)) AS clamped FROM events
""")
def frame_clock(spark, d):
    """PRJ-1, PRJ-2, PRJ-28, PRJ-29, PRJ-30, PRJ-31."""
    e, v = F.col("event_id"), F.col("value")
    return read(spark, d, "events").select("event_id", scalars.frame_count(v).alias("frames"), scalars.hold_for(v / 10).alias("hold"), scalars.seconds_to_frames(e * 60).alias("seconds_frames"), scalars.audio_page(e, 3, 7).alias("page"), scalars.bar_fill(e, F.lit(5000), 40).cast("long").alias("bar"), scalars.clamp_frame(e, F.lit(3000)).alias("clamped"))


@query("""
WITH s AS (SELECT p_partkey, 160 + p_size * 37 AS w, 90 + p_size * 11 AS h FROM part),
a AS (SELECT *, w / h AS aspect, 320 / 224 * (14 / 15) AS want FROM s),
c AS (SELECT *, (CASE WHEN aspect > want THEN round_even(h * want, 0) ELSE w END)::BIGINT AS cw, (CASE WHEN aspect > want THEN h ELSE round_even(w / want, 0) END)::BIGINT AS ch, 320 * (14 / 15) / aspect / 16 AS ideal FROM a)
SELECT p_partkey, cw - cw % 2 AS crop_w, ch - ch % 2 AS crop_h, 16 * coalesce(list_max(list_filter([2, 4, 6, 8, 10, 12, 14], lambda k: k <= ideal + 1e-6)), 14) AS image_h FROM c
""")
def geometry_plan(spark, d):
    """PRJ-4: crop to fill, and letterbox heights."""
    w, h = F.lit(160) + F.col("p_size") * 37, F.lit(90) + F.col("p_size") * 11
    fill, boxed = scalars.geometry(w, h), scalars.geometry(w, h, fit="letterbox")
    return read(spark, d, "part").select("p_partkey", fill["crop_w"].cast("long").alias("crop_w"), fill["crop_h"].cast("long").alias("crop_h"), boxed["image_h"].cast("int").alias("image_h"))


@query("""
SELECT l_orderkey, l_linenumber, (l_linenumber + 1) * 64 + (l_suppkey % 14) * 2 AS address, ((l_partkey % 256) << 8) | ((((l_orderkey * 31) >> 16) & 15) << 4) | ((l_linenumber % 2) << 1) | (l_suppkey % 2) AS word FROM lineitem
""")
def slot_words(spark, d):
    """PRJ-16, PRJ-17, PRJ-18, PRJ-22: addresses and attribute words; decoding gives back the fields."""
    line, tile = F.col("l_linenumber"), F.col("l_orderkey") * 31
    word = scalars.attribute_word(F.col("l_partkey") % 256, tile, F.col("l_suppkey") % 2, line % 2)
    rows = read(spark, d, "lineitem").select("*", word.alias("word"), scalars.slot_address(line, F.col("l_suppkey") % 14).alias("address"))
    fields = scalars.attribute_fields(F.col("word"), tile.bitwiseAND(65535))
    back = fields["tile"] == tile.bitwiseAND(1048575)
    return rows.where(back).select("l_orderkey", "l_linenumber", "address", "word")


# The 8 x 8 ordered matrix.
@query("SELECT e.i::INT AS i, (e.i + 0.5::DOUBLE) / 64 AS threshold, (list_position([0,32,8,40,2,34,10,42, 48,16,56,24,50,18,58,26, 12,44,4,36,14,46,6,38, 60,28,52,20,62,30,54,22, 3,35,11,43,1,33,9,41, 51,19,59,27,49,17,57,25, 15,47,7,39,13,45,5,37, 63,31,55,23,61,29,53,21], e.i) - 1)::INT AS place FROM range(64) AS e(i)")
def bayer_matrix(spark, d):
    """PRJ-20: the thresholds of the 8 x 8 matrix, each in the middle of its step, and where they stand."""
    cells = spark.range(64).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"))
    threshold = scalars.bayer(F.col("row"), F.col("col"))
    return cells.select((threshold * 64).cast("int").alias("i"), threshold.alias("threshold"), (F.col("row") * 8 + F.col("col")).alias("place"))


@query("SELECT p_partkey, CASE WHEN m >= 60 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS clock FROM (SELECT p_partkey, p_retailprice / 20 AS m, round_even(p_retailprice / 20 * 60, 0)::BIGINT AS t FROM part)")
def clock_text(spark, d):
    """PRJ-27, PRJ-42."""
    return read(spark, d, "part").select("p_partkey", scalars.clock(F.col("p_retailprice") / 20).alias("clock"))


@query("""
SELECT p_partkey, least(65535, round_even(p_retailprice * 40 * 65536 * 144 / 8000000, 0))::BIGINT AS delta_n, round(CASE WHEN a >= 8000000 / 144 * 65535 / 65536 THEN 8000000 / 144 * 65535 / 65536 ELSE least(65535, greatest(1, floor(a * 65536 * 144 / 8000000))) * (8000000 / 144 / 65536) END, 6) AS rate,
       round(CASE WHEN p_size <= 0 THEN 8.0 ELSE least(8.0, greatest(2.5, 60.0 / p_size)) END, 9) AS epoch
FROM (SELECT *, 65535 * 256 / (p_size * 60 * 0.5) AS a FROM part)
""")
def audio_rates(spark, d):
    """PRJ-32, PRJ-33, PRJ-34, PRJ-35."""
    p = read(spark, d, "part")
    return p.select("p_partkey", scalars.delta_n(F.col("p_retailprice") * 40).alias("delta_n"), F.round(scalars.audio_rate_for(F.col("p_size")), 6).alias("rate"), F.round(scalars.epoch_seconds(F.col("p_size")), 9).alias("epoch"))


@query("SELECT p_partkey, m <= c * 0.92 AS fits, CASE WHEN m <= c * 0.92 THEN 0.0 ELSE ceil((m - c * 0.92) * 60) / 60 END AS trim, greatest(1048576, 1 << length(bin(greatest(p_partkey * 9973 - 1, 0)))) AS image FROM (SELECT p_partkey, p_size::DOUBLE AS m, 1048576 / (p_retailprice * 40) AS c FROM part)")
def capacity_fit(spark, d):
    """PRJ-15, PRJ-37, FLT-5, FLT-6, SRT-4."""
    m, c = F.col("p_size").cast("double"), scalars.most_minutes(F.col("p_retailprice") * 40)
    return read(spark, d, "part").select("p_partkey", scalars.fits(m, c).alias("fits"), scalars.trim_minutes(m, c).alias("trim"), scalars.power_of_two(F.col("p_partkey") * 9973).alias("image"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 20 THEN 'crop=' || p_size END, 'scale=320:224', CASE WHEN p_size % 2 = 0 THEN 'fps=59' END], lambda x: x IS NOT NULL), ',') AS chain, coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), 9) AS pick FROM part")
def filter_chain(spark, d):
    """PRJ-5, PRJ-38."""
    s = F.col("p_size")
    steps = (F.when(s > 20, F.concat(F.lit("crop="), s.cast("string"))), F.lit("scale=320:224"), F.when(s % 2 == 0, F.lit("fps=59")))
    return read(spark, d, "part").select("p_partkey", scalars.filter_chain(*steps).alias("chain"), F.coalesce(F.nullif(s % 3, F.lit(0)), F.nullif(s % 5, F.lit(0)), F.lit(9)).alias("pick"))


@query("""
WITH t AS (SELECT conv_id, turn, text AS line FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(line, '<[^>]+>|\\{[^}]*\\}', '', 'g'), ' ') AS plain, rpad(repeat(' ', ((40 - length(line[:40])) // 2)::INT) || line[:40], 40, ' ') AS centred FROM t
""")
def subtitle_rows(spark, d):
    """SRC-11: markup stripped, rows centred on 40 columns; glyphs are in cue_records."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return t.select("conv_id", "turn", scalars.strip_markup(F.col("line")).alias("plain"), scalars.centred(F.col("line")).alias("centred"))


def _subtitle_texts(spark, d):
    """Whole documents as SubRip texts, every two lines a cue."""
    part = lambda t: F.format_string("%02d:%02d:%02d,%d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60, F.col("doc_id") % 10)
    block = lambda k: F.concat((k + 1).cast("string"), F.lit("\n"), part(k * 2), F.lit(" --> "), part(k * 2 + 1), F.lit("\n{i}"), F.array_join(F.slice("rows", k * 2 + 1, F.lit(2)), "\n"))
    rows = F.filter(F.transform(F.split("text", r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    texts = read(spark, d, "documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / 2).cast("int")), block)
    return texts.select("doc_id", F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\nnothing timed")).alias("srt"))


@query("""
WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS rs FROM documents),
c AS (SELECT doc_id, rs, unnest(range((len(rs) + 1) // 2)) AS cue FROM r),
l AS (SELECT doc_id, cue, list_filter(list_transform(rs[2 * cue + 1:2 * cue + 2], lambda x: trim(regexp_replace(x, '<[^>]+>|\\{[^}]*\\}', '', 'g'), ' ')), lambda x: x <> '') AS lines FROM c)
SELECT doc_id, cue::INT AS cue, 2 * cue + (doc_id % 10) / 10 AS start, 2 * cue + 1 + (doc_id % 10) / 10 AS "end", lines FROM l WHERE len(lines) > 0
""")
def subtitle_cues(spark, d):
    """SRC-11, PRJ-23: cues of whole texts, every two lines a cue."""
    return stores.cues(_subtitle_texts(spark, d), "doc_id", "srt")


@query()
def cue_records(spark, d):
    """PRJ-25, PRJ-44, SNK-8: the cues of whole texts from second 1 on as records of 88 bytes."""
    from .sources.cues import cue_records as records

    return records(stores.cues(_subtitle_texts(spark, d), "doc_id", "srt"), "doc_id", 1.0, 36000.0)


@query("SELECT event_id, list_transform(regexp_extract_all(props, '\"k\": (-?\\d+)', 1), lambda x: x::DOUBLE) AS found, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def printed_metadata(spark, d):
    """SRC-10, SRC-2: values read from prints and JSON."""
    e = read(spark, d, "events")
    prints = F.regexp_replace("props", r'"k": ', "lavfi.k=")
    return e.select("event_id", stores.printed_values(prints, "k").alias("found"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderkey, unhex(lpad(hex(o_orderkey), 8, '0')) AS blob, o_orderkey AS again FROM orders")
def big_endian(spark, d):
    """SNK-2, SNK-3, SNK-4, SRC-14: big-endian words, and back."""
    o = read(spark, d, "orders").select("o_orderkey", stores.big_endian(F.col("o_orderkey"), 4).alias("blob"))
    return o.withColumn("again", stores.from_big_endian(F.col("blob"), 0, 4))


@query("SELECT c_custkey, coalesce(n.rate, c_acctbal) AS rate FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS rate FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey")
def readings_upsert(spark, d):
    """SNK-15, SRC-13: new readings take the place of old ones."""
    old = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("rate"))
    new = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("rate"))
    return stores.upsert(old, new, "c_custkey")


@query("SELECT doc_id, sha256('1:' || sha256(strlen(text)::VARCHAR || text) || ':' || lang) AS key FROM documents")
def content_keys(spark, d):
    """PRJ-39."""
    return read(spark, d, "documents").select("doc_id", scalars.content_key(F.col("text"), F.octet_length("text"), F.col("lang")).alias("key"))


@query(f"""
WITH n AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: (floor(x::DOUBLE * 64)::BIGINT + 1024) % 16)) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT *, CASE WHEN i % 64 = 63 THEN (-9223372036854775808)::HUGEINT ELSE (1::HUGEINT << (i % 64)::HUGEINT) END AS bit FROM n),
w AS (SELECT vec_id, i // 64 AS w, {", ".join(f"sum(bit * ((v >> {k}) & 1))::BIGINT AS p{k}" for k in range(4))} FROM b GROUP BY ALL)
SELECT vec_id, {", ".join(f"list(p{k} ORDER BY w) AS plane{k}" for k in range(4))} FROM w GROUP BY vec_id
""")
def bit_planes(spark, d):
    """PRJ-14, PRJ-19: the four planes of all values, a word for every 64."""
    e = read(spark, d, "embeddings").where(F.size("embedding") > 0)
    e = e.select("vec_id", F.transform("embedding", lambda x: (F.floor(x.cast("double") * 64) + 1024) % 16).alias("nibbles"))
    words = F.sequence(F.lit(0), F.floor((F.size("nibbles") - 1) / 64).cast("int"))
    plane = lambda k: F.transform(words, lambda w: scalars.planes(F.slice("nibbles", w * 64 + 1, F.lit(64)), k))
    return e.select("vec_id", *(plane(k).alias(f"plane{k}") for k in range(4)))


@query("SELECT vec_id, i // 4 AS tile, list(v ORDER BY i) AS px FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT)) AS v FROM embeddings) GROUP BY vec_id, i // 4")
def tile_split(spark, d):
    """PRJ-11: all cells in tiles of four, the last one shorter if need be."""
    e = read(spark, d, "embeddings").where(F.size("embedding") > 0)
    e = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("cells"))
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / 4).cast("int")), lambda t: F.slice("cells", t * 4 + 1, F.lit(4)))
    return e.select("vec_id", F.posexplode(tiles).alias("tile", "px")).withColumn("tile", F.col("tile").cast("long"))


@query("SELECT event_id FROM events WHERE event_id % 7 = 0")
def strided_sample(spark, d):
    """SRC-7: every seventh frame."""
    return read(spark, d, "events").where("event_id % 7 = 0").select("event_id")


@query("SELECT event_id, sum(length(props)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS \"end\", (sum(length(props)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT // 1048576 AS bank FROM events")
def stream_index(spark, d):
    """SNK-5, WIN-15: running offsets of records and their banks, without one task for the order."""
    e = read(spark, d, "events").select("event_id", F.length("props").alias("bytes"))
    found = ordered.running_sum(e, "event_id", F.col("bytes"), "end")
    return found.select("event_id", "end", F.floor(F.col("end") / 1048576).alias("bank"))


@query("SELECT event_id FROM events WHERE (event_id * 37) % 65536 >> 7 < 256 OR (event_id * 37) % 65536 >> 7 > 495")
def blank_lines(spark, d):
    """FLT-12: rows of a counter outside the picture."""
    line = F.shiftright((F.col("event_id") * 37) % 65536, 7)
    return read(spark, d, "events").where((line < 256) | (line > 495)).select("event_id")


@query("SELECT n::INT AS n, round(exp(ln(0.001) + n * (ln(0.5) - ln(0.001)) / 29), 9) AS tolerance FROM range(30) AS r(n)")
def log_series(spark, d):
    """PRJ-43."""
    import math

    n = F.col("id").cast("int")
    return spark.range(30).select(n.alias("n"), F.round(F.exp(math.log(0.001) + n * ((math.log(0.5) - math.log(0.001)) / 29)), 9).alias("tolerance"))


@query()
def thin_sample(spark, d):
    """SRT-5: exactly 100 rows by seeded hashes."""
    return measure.thin(read(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query()
def spread_choice(spark, d):
    """AGG-16: eight settings spread evenly over the logarithm of cost."""
    settings = read(spark, d, "part").groupBy("p_size").agg((F.lit(2000.0) / F.col("p_size") + F.min("p_retailprice") / 1000).alias("error"))
    points = [(float(r["p_size"]), r["error"]) for r in measure.frontier(settings, "p_size", "error").orderBy(F.desc("p_size")).collect()]  # a row a setting
    return spark.createDataFrame(measure.choose(points, 8), "cost double, error double")


@query()
def adpcm_tracks(spark, d):
    """STF-12, STF-13: events' values as samples, a track for each user."""
    from .operators.audio import adpcm

    samples = read(spark, d, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("i"), (F.col("value") * 60).cast("int").alias("v"))
    return adpcm(samples)


@query("WITH RECURSIVE r(a, b, spent) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT a, (b * 2 + 1) % 25, spent + 8 FROM r WHERE spent + 8 < 32) SELECT a, b, min(spent)::INT AS spent FROM r GROUP BY a, b")
def bounded_reach(spark, d):
    """JON-17, WIN-14: nodes within a bounded walk over successor edges, by rounds of joins."""
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_nationkey").alias("b"), F.lit(0).alias("spent"))
    edges = read(spark, d, "nation").select(F.col("n_nationkey").alias("b"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("next"))
    seen = step = nodes
    for spent in range(8, 32, 8):
        step = step.join(edges, "b").select("a", F.col("next").alias("b"), F.lit(spent).alias("spent"))
        seen = seen.union(step)
    return seen.groupBy("a", "b").agg(F.min("spent").alias("spent"))


# Folds with feedback, schedules and listings.


def _user_frames(spark, d):
    """Users as scopes, runs of eight events as frames."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    cells = read(spark, d, "events").select("user_id", "event_id", "value").withColumn("n", F.row_number().over(w) - 1)
    cell = F.array_sort(F.collect_list(F.struct((F.col("n") % 8).cast("long").alias("s"), F.round("value").alias("v"))))
    frames = cells.groupBy(F.col("user_id").alias("scope"), F.floor(F.col("n") / 8).alias("frame")).agg(cell.alias("c"))
    return frames.select("scope", "frame", F.col("c.s").alias("slots"), F.col("c.v").alias("values"))


@query()
def budgeted_encode(spark, d):
    """STF-1, STF-2, STF-4: users as sources, runs of eight events as frames, under a budget of distinct values."""
    from .operators.encode import encode

    return encode(_user_frames(spark, d), 20.0, 40, 6)


@query()
def masked_encode(spark, d):
    """FLT-3: as budgeted_encode, with the tolerance of each slot raised by its movement."""
    from .operators.encode import encode

    return encode(_user_frames(spark, d), 20.0, 40, 6, masking=1.0)


@query()
def bank_aligned(spark, d):
    """WIN-6: record offsets that do not cross banks."""
    from .operators.encode import bank_offsets

    return bank_offsets(read(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("frame"), (F.length("props") * 7).cast("long").alias("bytes")), 512)


@query("""
WITH s AS (SELECT n_nationkey AS epoch, n_nationkey * 100 + 50 AS start FROM nation)
SELECT epoch, (start - 3 + k)::INT AS frame, (k * 48)::INT AS first, least(48, 130 - k * 48)::INT AS n FROM s, range(3) AS r(k)
""")
def epoch_preload(spark, d):
    """STF-7, PRJ-36: the slices that load an epoch's words before it starts."""
    from .operators.encode import preload

    epochs = read(spark, d, "nation").select(F.col("n_nationkey").alias("epoch"), (F.col("n_nationkey") * 100 + 50).alias("start"))
    return preload(epochs, 130).select("epoch", "frame", "first", "n")


@query("SELECT event_id AS frame, (sum(coalesce((value > 300)::INT, 0)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM events")
def epoch_buckets(spark, d):
    """AGG-18: every event by the epoch it falls in."""
    events = read(spark, d, "events").select(F.col("event_id").alias("frame"), F.coalesce((F.col("value") > 300).cast("long"), F.lit(0)).alias("cut"))
    return ordered.running_sum(events, "frame", F.col("cut"), "epoch").select("frame", "epoch")


@query()
def epoch_boundaries(spark, d):
    """WIN-7: epochs of each user's events from the share of large values among ten."""
    from .operators.encode import epochs

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = read(spark, d, "events").select(F.col("user_id").alias("scope"), (F.floor(n / 10) * 10).alias("frame"), (F.col("value") > 60).cast("double").alias("large"))
    return epochs(rows.groupBy("scope", "frame").agg(F.avg("large").alias("share")), 40, 12)


@query("""
WITH e AS (SELECT event_id AS target FROM events), k AS (SELECT event_id AS f FROM events WHERE event_id % 90 = 0)
SELECT target, (SELECT max(f) FROM k WHERE f <= target) AS landed, (SELECT max(f) FROM k WHERE f <= target) + 1 AS position FROM e
""")
def cursor_seek(spark, d):
    """STF-9: a seek lands on the keyframe at or before the target."""
    from .operators.encode import seek

    events = read(spark, d, "events").select("event_id")
    return seek(events.select(F.col("event_id").alias("target")), "target", events.where("event_id % 90 = 0"), "event_id").select("target", "landed", "position")


def _slot_pixels(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select((k % 20).alias("slot"), k.alias("frame"), F.array((k * 7919) % 32768, (F.col("c_nationkey").cast("long") * 1031) % 32768, (k * 131) % 32768).alias("px"))


@query("""
WITH px AS (SELECT c_custkey % 20 AS slot, c_custkey AS frame, unnest([c_custkey * 7919 % 32768, c_nationkey * 1031 % 32768, c_custkey * 131 % 32768]) AS c, generate_subscripts([1, 2, 3], 1) AS i FROM customer),
p AS (SELECT slot, frame, i, c, lag(c) OVER (PARTITION BY slot, i ORDER BY frame) AS o FROM px)
SELECT slot, frame, count(*) AS cells, count(*) FILTER (c <> o) AS changed FROM p WHERE o IS NOT NULL GROUP BY slot, frame
""")
def slot_movement(spark, d):
    """FLT-4: compared cells and changed ones; slot_movement_metric has the colour metric, displayed_error what is shown."""
    px = _slot_pixels(spark, d)
    w = Window.partitionBy("slot").orderBy("frame")
    pair = px.withColumn("old", F.lag("px").over(w)).where("old is not null")
    differ = F.size(F.filter(F.zip_with("px", "old", lambda a, b: a != b), lambda x: x))
    return pair.select("slot", "frame", F.size("px").cast("long").alias("cells"), differ.cast("long").alias("changed"))


@query()
def slot_movement_metric(spark, d):
    """PRJ-13: movement of each slot in the colour metric."""
    from .operators.encode import movement

    return movement(_slot_pixels(spark, d), colour.colour_grid(spark))


@query()
def displayed_error(spark, d):
    """AGG-10: what budgeted_encode shows against the true frames."""
    from .operators.encode import displayed_error as error
    from .operators.encode import encode

    frames = _user_frames(spark, d)
    return error(frames, encode(frames, 20.0, 40, 6))


@query()
def rendered_tiles(spark, d):
    """PRJ-21: vectors in the nearest of the 15 most frequent values of their label, through 4-bit values."""
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * 16)).alias("cells")
    palettes = frequent_values(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("most"), "color"))).alias("p")).select("label", F.col("p.color").alias("colors"))
    gaps = lambda c: F.transform("colors", lambda x: F.abs(x - c))
    tiles = read(spark, d, "embeddings").select("vec_id", "label", cells).join(palettes, "label")
    tiles = tiles.withColumn("nibbles", F.transform("cells", lambda c: F.array_position(gaps(c), F.array_min(gaps(c)))))
    return tiles.select("vec_id", "nibbles", scalars.rendered(F.col("nibbles"), F.col("colors")).alias("px"))


@query("SELECT o_orderstatus AS source, count(*) FILTER (o_custkey % 3 = 0) > count(*) FILTER (o_custkey % 3 <> 0) AS interlaced, arg_max(o_custkey || ':' || o_orderkey || ':0:0', o_orderkey) FILTER (o_custkey % 5 = 0) AS crop FROM orders GROUP BY o_orderstatus")
def source_analysis(spark, d):
    """SRC-3, SRC-4: verdict and last crop from log lines."""
    from .sources.listings import source_analysis as analyse

    c, o = F.col("o_custkey"), F.col("o_orderkey")
    head = F.when(c % 3 == 0, F.lit("TFF: 1 BFF: 0 Progressive: 0")).otherwise(F.lit("TFF: 0 BFF: 0 Progressive: 1"))
    crop = F.when(c % 5 == 0, F.concat(F.lit(" crop="), c.cast("string"), F.lit(":"), o.cast("string"), F.lit(":0:0"))).otherwise("")
    return analyse(read(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.concat(head, crop).alias("line"), "o_orderkey"), "source", "line", "o_orderkey")


@query("""
SELECT user_id, event_id, last_value(CASE WHEN value > 300 THEN '-' WHEN event_type = 'click' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events
""")
def sticky_register(spark, d):
    """WIN-12: the last value set, '-' once cleared."""
    from .sources.listings import sticky

    rows = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).alias("port"), (F.col("value") > 300).alias("cleared"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    found = sticky(rows, "user_id", "event_id", "port", "cleared").withColumn("any", F.max((F.col("cleared") | F.col("port").isNotNull()).cast("int")).over(w))
    return found.select("user_id", "event_id", F.when(F.col("any") == 1, F.coalesce("held", F.lit("-"))).alias("held"))


@query("SELECT doc_id, sha1(text) AS sha1, strlen(text) AS bytes, coalesce(nullif((strlen(text) + 255) // 256, 0), 1) * 256 AS padded FROM documents")
def archive_listing(spark, d):
    """SNK-7, SNK-13: digests and padded sizes of parts."""
    size = F.octet_length("text").cast("long")
    return read(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), size.alias("bytes"), (F.greatest(F.floor((size + 255) / 256), F.lit(1)) * 256).alias("padded"))


@query("SELECT vec_id, list_transform(range((len(embedding) + 1) // 2 * 2), lambda i: coalesce(floor(embedding[CASE WHEN i % 2 = 0 THEN i // 2 + 1 ELSE i // 2 + 1 + (len(embedding) + 1) // 2 END]::DOUBLE * 64)::BIGINT, 0)) AS woven FROM embeddings")
def interleave(spark, d):
    """SNK-6, SNK-12: the two halves of the whole woven element by element, an odd end padded with 0."""
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    e = read(spark, d, "embeddings").select("vec_id", cells.alias("cells"), F.floor((F.size("embedding") + 1) / 2).cast("int").alias("half"))
    halves = F.zip_with(F.slice("cells", F.lit(1), F.col("half")), F.slice("cells", F.col("half") + 1, F.col("half")), lambda a, b: F.array(a, F.coalesce(b, F.lit(0))))
    return e.select("vec_id", F.flatten(halves).alias("woven"))


@query("""
WITH b AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS n FROM events)
SELECT part, frame, row_number() OVER (ORDER BY frame) - 1 AS n FROM (
    SELECT CASE WHEN event_id - lo < n // 2 THEN 'a' ELSE 'b' END AS part, event_id AS frame FROM events, b
    WHERE (event_id - lo >= n // 10 AND event_id - lo < n // 2) OR (event_id - lo >= n * 7 // 10 AND event_id - lo < n))
""")
def joined_windows(spark, d):
    """SET-1, SRT-6: clips of the second to fifth and the last three tenths of the table's frames, with new frame numbers."""
    e = read(spark, d, "events").select(F.col("event_id").alias("frame"))
    low, high = e.agg(F.min("frame"), F.max("frame")).first()
    low, n = (low, high - low + 1) if low is not None else (0, 0)
    clip = lambda part, a, b: e.where(F.col("frame").between(low + n * a // 10, low + n * b // 10 - 1)).withColumn("part", F.lit(part))
    return ordered.numbered(clip("a", 1, 5).unionByName(clip("b", 7, 10)), "frame", "n").select("part", "frame", "n")


@query("SELECT p_brand, round(avg(p_retailprice) / (SELECT avg(p_retailprice) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) - 1, 9) AS error FROM part GROUP BY p_brand")
def model_error(spark, d):
    """AGG-17: measured against a reference rung."""
    p = read(spark, d, "part")
    mean = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    reference = mean.agg(F.min_by("m", "p_brand").alias("r"))
    return mean.join(F.broadcast(reference)).select("p_brand", F.round(F.col("m") / F.col("r") - 1, 9).alias("error"))


@query()
def wrapped_subtitles(spark, d):
    """PRJ-24: texts wrapped to two rows of 40 columns (textwrap has no SQL form)."""
    from .operators.encode import wrap

    fold = F.pandas_udf(wrap, "array<string>")
    return read(spark, d, "conversations").select("conv_id", "turn", fold("text").alias("rows"))


@query()
def ladder_search(spark, d):
    """SRT-8, FLT-6: the first rung that fits, each rung measured by an aggregation at most once."""
    from .plans.search import first_fit

    orders = read(spark, d, "orders")
    rung, verdicts = first_fit([10 * k for k in range(1, 36)], lambda limit: orders.where(F.col("o_totalprice") > limit * 1000).count() <= orders.count() // 2)
    return spark.createDataFrame([(rung, k, v) for k, v in verdicts.items()], "rung long, asked long, fits boolean")


# Guards, plans and small formats.

RULES_SQL = "CASE WHEN NOT coalesce(l_quantity BETWEEN 1 AND 45, false) THEN 'quantity' WHEN NOT coalesce(l_discount <= 0.08, false) THEN 'discount' WHEN NOT coalesce(l_tax < 0.08, false) THEN 'tax' END"


@query(f"SELECT rule, count(*) AS n FROM (SELECT {RULES_SQL} AS rule FROM lineitem) GROUP BY rule")
def broken_guards(spark, d):
    """FLT-10: rows by the first guard that they break."""
    rules = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") < 0.08}
    return read(spark, d, "lineitem").select(guards.broken_rule(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, (round_even(event_id / 4.0::DOUBLE * 15625 / 264, 0))::BIGINT AS first, (round_even((event_id + 10) / 4.0::DOUBLE * 15625 / 264, 0))::BIGINT AS past,
       least(1.0::DOUBLE, 15625.0::DOUBLE / 264 / (1 + event_id % 5) / 24) AS kept FROM events
""")
def cue_frames(spark, d):
    """PRJ-26, PRJ-3: half-open frame spans of timed cues, halves to even; the share of pictures kept under a hold."""
    frame = lambda at: scalars.whole(F.bround(at / 4.0 * 15625 / 264))
    hold = 1 + F.col("event_id") % 5
    return read(spark, d, "events").select("event_id", frame(F.col("event_id")).alias("first"), frame(F.col("event_id") + 10).alias("past"), scalars.kept_share(hold, F.lit(24)).alias("kept"))


@query("SELECT event_id // 40 % 40 // 5 AS y, event_id % 40 // 5 AS x, event_id // 1600 AS picture, value FROM events WHERE event_id % 40 % 5 = 2 AND event_id // 40 % 40 % 5 = 2")
def centre_samples(spark, d):
    """PRJ-40: pictures of 40 x 40 values brought down five times, by the value in the middle of each cell."""
    at = F.col("event_id")
    x, y = at % 40, F.floor(at / 40) % 40
    return read(spark, d, "events").where((x % 5 == 2) & (y % 5 == 2)).select(F.floor(y / 5).alias("y"), F.floor(x / 5).alias("x"), F.floor(at / 1600).alias("picture"), "value")


@query("""
SELECT event_type, CASE WHEN event_type LIKE 'click%' THEN 12 WHEN event_type LIKE 's%' THEN 8 WHEN event_type LIKE 'p%' THEN 10 ELSE 4 END::BIGINT AS cost, count(*) AS n,
       sum(CASE WHEN event_type LIKE 'click%' THEN 12 WHEN event_type LIKE 's%' THEN 8 WHEN event_type LIKE 'p%' THEN 10 ELSE 4 END)::BIGINT AS total FROM events GROUP BY event_type
""")
def prefix_costs(spark, d):
    """PRJ-41: the cost of the longest known prefix, a floor for the rest."""
    cost = guards.by_prefix(F.col("event_type"), {"click": 12, "s": 8, "p": 10}, 4)
    return read(spark, d, "events").select("event_type", cost.alias("cost")).groupBy("event_type", "cost").agg(F.count("*").alias("n"), F.sum("cost").alias("total"))


@query("SELECT doc_id, strlen(text) + strlen(text) % 2 AS bytes, sha256(encode(text) || CASE WHEN strlen(text) % 2 = 1 THEN '\\x00'::BLOB ELSE ''::BLOB END) AS sha256 FROM documents")
def artifact_parts(spark, d):
    """SNK-1: parts padded to even lengths."""
    blob = stores.even_blob(F.encode("text", "UTF-8"))
    return read(spark, d, "documents").select("doc_id", F.octet_length(blob).cast("long").alias("bytes"), F.sha2(blob, 256).alias("sha256"))


@query("""
SELECT '{"frames":' || count(*) || ',"slots":' || count(DISTINCT user_id) || ',"contents":' || count(DISTINCT event_type) || ',"first":' || min(event_id) || ',"last":' || max(event_id) || ',"a_minute":' || count(*) * 60 // (1 + max(event_id) - min(event_id)) || '}' AS report FROM events
""")
def run_report(spark, d):
    """SNK-11, CLI-2: a run's figures and projections as one JSON line."""
    e = read(spark, d, "events").agg(F.count("*").alias("frames"), F.countDistinct("user_id").alias("slots"), F.countDistinct("event_type").alias("contents"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return e.select(F.to_json(F.struct("frames", "slots", "contents", "first", "last", F.floor(F.col("frames") * 60 / (1 + F.col("last") - F.col("first"))).alias("a_minute"))).alias("report"))


@query("""
SELECT vec_id, string_agg(printf('%X%X', floor(embedding[y * 8 + 2 * p + 2] * 16)::BIGINT & 15, floor(embedding[y * 8 + 2 * p + 1] * 16)::BIGINT & 15), '' ORDER BY place, y) AS tile
FROM embeddings, (VALUES (2, 0), (3, 1), (0, 2), (1, 3)) pairs(p, place), range(8) rows(y) WHERE len(embedding) = 64 GROUP BY vec_id
""")
def glyph_tiles(spark, d):
    """SNK-16: 8 x 8 values of 4 bits packed in 32 bytes, by column pairs."""
    nibbles = F.transform("embedding", lambda x: F.floor(x * 16).bitwiseAND(15))
    return read(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.hex(stores.glyph_tile(nibbles)).alias("tile"))


@query("SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN replace(o_orderpriority, 'URGENT', 'NOW') END AS stamped FROM orders")
def stamped_texts(spark, d):
    """SNK-17: texts with the anchor replaced; those without it are told apart."""
    return read(spark, d, "orders").select("o_orderkey", guards.replaced(F.col("o_orderpriority"), "URGENT", "NOW", strict=False).alias("stamped"))


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, place, event_id, value FROM e UNION ALL SELECT user_id, n + k, event_id, value FROM e, range(2) t(k) WHERE place = n - 1 AND k < user_id % 3
""")
def padded_runs(spark, d):
    """SRC-5: runs short of at most two rows, filled by their last one."""
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    wanted = e.withColumn("wanted", F.count("*").over(Window.partitionBy("user_id")) + F.col("user_id") % 3)
    return guards.padded_tail(wanted, "user_id", "event_id", "wanted").select("user_id", "place", "event_id", "value")


@query("""
WITH n AS (SELECT event_id // 250 AS epoch, user_id AS colour, count(*) AS weight FROM events GROUP BY ALL), e AS (SELECT count(DISTINCT epoch) AS epochs FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY weight DESC, colour) - 1 AS place FROM n)
SELECT epoch, colour, weight, 16 + place + CASE WHEN epochs > 1 THEN epoch % 2 * 8 ELSE 0 END AS slot FROM r, e WHERE place < CASE WHEN epochs > 1 THEN 8 ELSE 16 END
""")
def epoch_palettes(spark, d):
    """AGG-9: an epoch's palette is its most frequent values; with several epochs half the slots each, in alternating halves."""
    counts = read(spark, d, "events").groupBy(F.floor(F.col("event_id") / 250).alias("epoch"), F.col("user_id").alias("colour")).agg(F.count("*").alias("weight"))
    return change.epoch_slots(counts, "epoch", "colour", "weight", base=16, capacity=16)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS place FROM part")
def total_order(spark, d):
    """SRT-1: places in an order of several keys with an explicit last tie-break, without one task for the order."""
    return ordered.numbered(read(spark, d, "part"), "p_size", "place", "p_retailprice", "p_partkey").select("p_partkey", "place")


@query("""
WITH r AS (SELECT p_brand AS rung, sum(p_size)::BIGINT * 500 AS rate, avg(p_retailprice) AS error FROM part GROUP BY p_brand)
SELECT rung, rate * 10 AS tiles, round(100.0 * rate * 10 / 1048576, 6) AS percent, round(1048576.0 / rate * 0.92, 6) AS minutes, 10 <= 1048576.0 / rate * 0.92 AS fits,
       CASE WHEN 10 - 1048576.0 / rate * 0.92 <= 0 THEN 0 ELSE round(ceil((10 - 1048576.0 / rate * 0.92) * 60) / 60, 6) END::DOUBLE AS shortfall FROM r
""")
def ladder_plan(spark, d):
    """CLI-3, CLI-4: what each rung takes of the capacity for a runtime of ten minutes, and what must be cut."""
    rungs = read(spark, d, "part").groupBy(F.col("p_brand").alias("rung")).agg((F.sum("p_size") * 500).alias("rate"))
    most, minutes = scalars.most_minutes(F.col("rate")), F.lit(10)
    return rungs.select(
        "rung", (F.col("rate") * 10).alias("tiles"), F.round(100.0 * F.col("rate") * 10 / scalars.CAPACITY, 6).alias("percent"), F.round(most * scalars.MARGIN, 6).alias("minutes"),
        scalars.fits(minutes, most).alias("fits"), F.round(scalars.trim_minutes(minutes, most), 6).alias("shortfall"),
    )


@query("""
WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, 's' || (n // 20) AS section, lower(to_hex(event_id)) AS address, event_type AS mnemonic, 'd' || (event_id % 8) AS operands FROM l WHERE n % 20 <> 0 AND n > 20
""")
def listing_sections(spark, d):
    """SRC-16: instructions of listings with the section that they stand under."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    code = F.concat(F.lit("  "), F.lower(F.hex("event_id")), F.lit(":\t4e 71\t"), F.col("event_type"), F.lit("\td"), (F.col("event_id") % 8).cast("string"))
    head = F.concat(F.lit("Disassembly of section s"), F.floor(F.col("n") / 20).cast("string"), F.lit(":"))
    lines = read(spark, d, "events").select("user_id", "event_id", "event_type", n.alias("n")).select("user_id", "event_id", F.when(F.col("n") % 20 == 0, head).otherwise(code).alias("line"))
    return listings.disassembly(lines, "user_id", "event_id", "line").where("section is not null").select("user_id", "event_id", "section", "address", "mnemonic", "operands")


# Cuts, matches, plans and tiles.


@query("""
WITH m AS (SELECT event_id // 500 AS frame, user_id AS slot, avg(value) AS v FROM events GROUP BY ALL),
c AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY slot ORDER BY frame)) AS moved FROM m),
n AS (SELECT count(DISTINCT user_id) AS slots FROM events)
SELECT frame, count(*) FILTER (moved > 20) / any_value(slots) AS share, frame = (SELECT min(frame) FROM c) OR count(*) FILTER (moved > 20) / any_value(slots) >= 0.1 AS cut FROM c, n GROUP BY frame
""")
def scene_cuts(spark, d):
    """FLT-4: frames in which a share of all slots moved beyond a floor; the first frame is a cut."""
    cells = read(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("frame"), F.col("user_id").alias("slot")).agg(F.avg("value").alias("v"))
    moved = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("slot").orderBy("frame")))
    return change.scene_cuts(cells.withColumn("moved", moved), "frame", "slot", "moved", floor=20, ratio=0.1)


@query("""
WITH s AS (SELECT capture, s_suppkey AS frame, round(abs(s_acctbal - capture * 400) / 25) AS error FROM supplier, range(25) AS r(capture)),
b AS (SELECT capture, min(error) AS least, arg_min(frame, (error, frame)) AS best FROM s GROUP BY capture),
t AS (SELECT s.*, least, best, error > least AS off FROM s JOIN b USING (capture)),
e AS (SELECT capture, max(frame) FILTER (off AND frame < best) AS low, min(frame) FILTER (off AND frame > best) AS high FROM t GROUP BY capture),
r AS (SELECT capture, arg_min(frame, (error, frame)) AS rival, min(error) AS rival_error FROM t JOIN e USING (capture) WHERE frame <= low OR frame >= high GROUP BY capture)
SELECT b.capture, best, least AS error, rival, rival_error - least AS margin, least <= 10 AND coalesce(rival_error - least >= 1, true) AS accepted FROM b LEFT JOIN r USING (capture)
""")
def best_match(spark, d):
    """JON-16, SET-3: the frame of least error for each of 25 captures, the best rival outside its tie run, and whether it is told apart."""
    error = F.round(F.abs(F.col("s_acctbal") - F.col("capture") * 400) / 25)
    scored = read(spark, d, "supplier").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("capture"), F.col("s_suppkey").alias("frame"), "s_acctbal")
    return measure.best_match(scored.select("capture", "frame", error.alias("error")), "capture", "frame", "error", most_error=10, least_margin=1)


@query("""
WITH d AS (SELECT s_suppkey, s_acctbal, list_sort(list_transform(range(25), lambda i: {'gap': abs(s_acctbal - i * 400), 'i': i})) AS p FROM supplier),
b AS (SELECT s_suppkey, p[1].i AS nearest, p[2].i AS runner, CASE WHEN p[1].gap + p[2].gap > 0 THEN round_even(255 * p[1].gap / (p[1].gap + p[2].gap), 0) ELSE 0 END::INT AS share FROM d),
t AS (SELECT *, (list_extract([0,32,8,40,2,34,10,42, 48,16,56,24,50,18,58,26, 12,44,4,36,14,46,6,38, 60,28,52,20,62,30,54,22, 3,35,11,43,1,33,9,41, 51,19,59,27,49,17,57,25, 15,47,7,39,13,45,5,37, 63,31,55,23,61,29,53,21], s_suppkey % 64 + 1) + 0.5::DOUBLE) / 64 * 255 AS threshold FROM b)
SELECT s_suppkey, nearest::INT AS nearest, runner::INT AS runner, share, CASE WHEN share > threshold THEN runner ELSE nearest END::INT AS shown FROM t
""")
def blended_rungs(spark, d):
    """SRT-2, PRJ-20: the two nearest of a palette, the share of the second, and the one that ordered dither shows."""
    place = F.col("s_suppkey").cast("int") % 64
    mix = measure.two_nearest(F.col("s_acctbal"), [400.0 * i for i in range(25)])
    rows = read(spark, d, "supplier").select("s_suppkey", mix.alias("m"), (scalars.bayer(F.floor(place / 8).cast("int"), place % 8) * measure.MIX_SCALE).alias("threshold"))
    return rows.select("s_suppkey", "m.nearest", "m.runner", "m.share", F.when(F.col("m.share") > F.col("threshold"), F.col("m.runner")).otherwise(F.col("m.nearest")).alias("shown"))


_LADDER = [(f"q{i + 1:02d}", 1 + i // 4, 1.0 - 0.05 * (i % 4), round(0.85**i, 6)) for i in range(16)]


@query(f"""
WITH l AS (SELECT [{", ".join(f"{{'name': '{n}', 'hold': {h}, 'chroma': {c}::DOUBLE, 'cost': {r}::DOUBLE}}" for n, h, c, r in _LADDER)}] AS rungs),
s AS (SELECT p_partkey, p_size::DOUBLE AS minutes, p_retailprice * 40 AS rate, 12.0::DOUBLE + p_partkey % 40 AS fps FROM part),
f AS (SELECT s.*, list_filter(rungs, lambda x: x.hold <= 1 OR {FPS}::DOUBLE / x.hold < fps) AS open FROM s, l),
g AS (SELECT *, list_filter(open, lambda x: minutes <= 1048576 / (rate * x.cost) * 0.92)[1] AS rung FROM f)
SELECT p_partkey, len(open)::INT AS reachable, rung.name AS rung, CASE WHEN rung.hold = 1 THEN 'every frame, colour at ' ELSE printf('%.0f', {FPS}::DOUBLE / rung.hold) || ' fps, colour at ' END || round(rung.chroma * 100)::INT || '%' AS label FROM g
""")
def first_fitting_rung(spark, d):
    """FLT-5, SRT-4, PRJ-37, PRJ-42, JON-14: of the rungs that a source's rate can reach, the first that fits its runtime, with its label."""
    ladder = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(h).alias("hold"), F.lit(c).alias("chroma"), F.lit(r).alias("cost")) for n, h, c, r in _LADDER))
    minutes, rate, fps = F.col("p_size").cast("double"), F.col("p_retailprice") * 40, F.lit(12.0) + F.col("p_partkey") % 40
    open_ = F.filter(ladder, lambda x: scalars.reachable(x["hold"], fps))
    rung = F.get(F.filter(open_, lambda x: scalars.fits(minutes, scalars.most_minutes(rate * x["cost"]))), 0)
    return read(spark, d, "part").select("p_partkey", F.size(open_).alias("reachable"), rung["name"].alias("rung"), scalars.rung_label(rung["hold"], rung["chroma"]).alias("label"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey * 37 % 70000 - 5 AS delta, p_retailprice * 40 AS hz FROM part)
SELECT p_partkey, CASE WHEN delta > 0 THEN delta * 11 // gcd(delta * 11, 393216) ELSE 0 END AS pages, CASE WHEN delta > 0 THEN 393216 // gcd(delta * 11, 393216) ELSE 1 END AS frames,
       greatest(1, least(35, 1 + CASE WHEN hz >= 55555 THEN 0 ELSE round_even(34 * ln(55555 / greatest(hz, 8000)) / ln(55555.0 / 8000), 0) END))::INT AS grade FROM p
""")
def audio_pages(spark, d):
    """PRJ-32, PRJ-34: pages a frame of a rate register as an exact fraction, and a sample rate's grade on a ladder of 35."""
    delta, hz = F.col("p_partkey") * 37 % 70000 - 5, F.col("p_retailprice") * 40
    pages = scalars.pages_per_frame(delta)
    return read(spark, d, "part").select("p_partkey", pages["pages"].alias("pages"), pages["frames"].alias("frames"), scalars.audio_grade(hz).alias("grade"))


@query("""
WITH n AS (SELECT vec_id, list_transform(range(256), lambda k: (floor(embedding[(k * 5 + k // 16) % len(embedding) + 1]::DOUBLE * 64)::BIGINT + 1024) % 16) AS px FROM embeddings WHERE len(embedding) > 0),
b AS (SELECT vec_id, px, list_transform(range(128), lambda j: list_sum(list_transform(range(8), lambda k: ((px[j % 64 % 32 // 2 * 16 + CASE WHEN j % 64 < 32 THEN 8 ELSE 0 END + k + 1] >> (j // 64 * 2 + j % 2)) & 1) << k))) AS bytes FROM n)
SELECT vec_id, array_to_string(list_transform(bytes[1:64], lambda x: printf('%02X', x::BIGINT)), '') AS c1, array_to_string(list_transform(bytes[65:128], lambda x: printf('%02X', x::BIGINT)), '') AS c2,
       true AS again, list_transform(range(16), lambda x: px[255 - x + 1]) AS last_row_flipped FROM b
""")
def packed_tiles(spark, d):
    """PRJ-14, PRJ-19: tiles of 16 x 16 values of 4 bits in two halves of 64 bytes, read back, and fetched with both flips."""
    px = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: (F.floor(F.element_at("embedding", (((k * 5 + F.floor(k / 16).cast("int")) % F.size("embedding")) + 1).cast("int")).cast("double") * 64) + 1024) % 16)
    tiles = read(spark, d, "embeddings").where(F.size("embedding") > 0).select("vec_id", px.alias("px"))
    packed = tiles.withColumn("tile", stores.packed_tile(F.col("px")))
    back = packed.withColumn("back", stores.unpacked_tile(F.col("tile.c1"), F.col("tile.c2")))
    flipped = stores.flipped_tile(F.col("back"), True, True)
    return back.select("vec_id", F.hex("tile.c1").alias("c1"), F.hex("tile.c2").alias("c2"), (F.col("back") == F.col("px")).alias("again"), F.slice(flipped, 1, 16).alias("last_row_flipped"))


@query("""
WITH v AS (SELECT label, unnest(list_transform(embedding, lambda x: floor(16 * x::DOUBLE)::BIGINT & 32767)) AS c FROM embeddings),
r AS (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, c) AS place FROM v GROUP BY label, c),
w AS (SELECT label, '0000' || string_agg(printf('%04X', c), '' ORDER BY place) AS words FROM r WHERE place <= 15 GROUP BY label)
SELECT label, rpad(words, 64, '0') AS blob, row_number() OVER (ORDER BY label) + 15 AS bank FROM w
""")
def palette_blobs(spark, d):
    """SNK-2, PRJ-22: each cluster's palette as 16 big-endian words, the first 0, and the bank that it is loaded to."""
    values = read(spark, d, "embeddings").select("label", F.explode(F.transform("embedding", lambda x: F.floor(x.cast("double") * 16).bitwiseAND(32767))).alias("c"))
    counts = values.groupBy("label", "c").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("most"), "c"))), 1, 15)  # 32,768 colours at most
    palettes = counts.groupBy("label").agg(best["c"].alias("colours"))
    found = ordered.numbered(palettes, "label", "place")
    return found.select("label", F.hex(stores.palette_blob(F.col("colours"))).alias("blob"), (F.col("place") + 16).alias("bank"))


@query("SELECT doc_id, sha256(encode(coalesce(text, '')) || repeat('\x08'::BLOB, ((4096 - strlen(coalesce(text, '')) % 4096) % 4096)::BIGINT)) AS sha256, (strlen(coalesce(text, '')) + 4095) // 4096 * 4096 AS bytes FROM documents")
def voice_roms(spark, d):
    """SNK-7: blobs filled to whole pages with the silent byte; one beyond the chip's space is an error."""
    blob = stores.filled_rom(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 4096)
    return read(spark, d, "documents").select("doc_id", F.sha2(blob, 256).alias("sha256"), F.octet_length(blob).cast("long").alias("bytes"))


@query("""
SELECT user_id, event_id, next - event_id AS gap FROM (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events)
WHERE event_type = 'click' AND next - event_id < 400
""")
def gap_violations(spark, d):
    """WIN-14: writes whose next access comes before the floor."""
    return change.short_gaps(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "click", 400).select("user_id", "event_id", "gap")
