"""The engine's operators on small tables and against SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae import queries
from tesserae.functions import colour, scalars
from tesserae.operators import audio, change, guards, measure, ordered
from tesserae.plans.search import first_fit
from tesserae.sources import stores

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return int(value) if isinstance(value, bool) else value


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(n) for n in names]
    assert sorted(found.columns) == names
    assert sorted(repr([plain(r[n]) for n in names]) for r in found.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_level_table_rises_from_black_to_white():
    table = colour.level_table()
    assert table[0] == 0 and table[31] == 255 and table == sorted(table)
    assert colour.nearest_levels()[0] == 0 and colour.nearest_levels()[255] == 31


def test_asof_before_first_and_at_mark(spark):
    points = spark.createDataFrame([(i,) for i in range(10)], "k long")
    marks = spark.createDataFrame([(3,), (7,)], "k long")
    got = {r["k"]: r["at"] for r in ordered.asof(points, "k", marks, "k", "at").collect()}
    assert got == {i: 3 if i < 7 else 7 for i in range(10)}
    got = {r["k"]: r["at"] for r in ordered.asof(points, "k", marks, "k", "at", before_first=False).collect()}
    assert got[2] is None and got[3] == 3


def test_running_sum_over_ranges(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    got = {r["k"]: r["s"] for r in ordered.running_sum(spark.createDataFrame(rows, "k long, v long"), "k", F.col("v"), "s").collect()}
    total = 0
    for k, v in rows:
        total += v
        assert got[k] == total


def test_place_counts_cuts_at_most_the_value(spark):
    rng = random.Random(2)
    values = [None, -(1 << 63), (1 << 63) - 1, 0, *(rng.randint(-9000, 9000) for _ in range(300))]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for count in (0, 1, 2, 3, 4, 10, 2000):
        cuts = [float(rng.randint(-8000, 8000)) for _ in range(count)] + [2.0**63] * (count > 3)
        known = {min(int(c), (1 << 63) - 1) for c in cuts}
        got = rows.select("v", ordered.place(F.col("v"), cuts).alias("at")).collect()
        assert [r["at"] for r in got] == [sum(c <= r["v"] for c in known) if r["v"] is not None else 0 for r in got]


def test_replay_equals_play(spark):
    rng = random.Random(19)
    rows = [(f * 4 + s, s, rng.choice("abc")) for f in range(40) for s in range(4)]
    df = spark.createDataFrame(rows, "frame long, slot long, content string")
    log = change.deltas(df, "slot", "frame", "content", F.col("frame") % 32 < 4)
    state = {}
    for f, s, c in rows:
        if f <= 77:
            state[s] = c
    assert {r["slot"]: r["content"] for r in change.replay(log, "slot", "frame", 77, "content").collect()} == state
    assert log.count() < len(rows)


def test_streaming_encoder(spark, tmp_path):
    from tesserae.streaming.encoder import encode_stream

    schema = "slot long, frame long, content string"
    for k in range(2):
        rows = [(s, k * 10 + f, "x" if f < 5 else "y") for s in range(2) for f in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = encode_stream(source, 8).writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r["slot"], r["frame"], r["content"], r["is_key"]) for r in spark.table("encoded").collect())
    frames = {f for s, f, _, _ in got if s == 0}
    assert {0, 8, 16} <= frames and (0, 0, "x", True) in got and (0, 5, "y", False) in got and 3 not in frames


def test_adpcm_follows_a_sine():
    samples = [int(8000 * math.sin(i / 9)) for i in range(4000)]
    back = audio.decode_track(audio.encode_track(samples))
    error = sum(abs(a - b) for a, b in zip(samples, back)) / len(samples)
    assert error < 400 and len(audio.encode_track([0])) == 2


def test_search_asks_few():
    asked = []
    rung, verdicts = first_fit(list(range(35)), lambda r: asked.append(r) or r >= 17)
    assert rung == 17 and len(asked) <= 11 and verdicts[17]
    assert first_fit([1, 2], lambda r: False)[0] is None and first_fit([], lambda r: True)[0] is None


def test_choose_and_windows():
    points = [(float(c), 1.0 / c) for c in range(100, 0, -1)]
    picked = measure.choose(points, 5)
    assert len(picked) == 5 and picked[0][0] == 100.0 and picked[-1][0] == 1.0
    spans = measure.windows(60.0, 4, 3.0)
    assert len(spans) == 4 and all(a + s <= b for (a, s), (b, _) in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        measure.windows(0, 1, 1)


def test_cues_and_readings(spark, tmp_path):
    text = "1\n00:00:01,0 --> 00:00:03,500\n<i>Hello</i>\n\n2\n00:00:04.5 --> 00:00:06,000\n{x}\n\nno timing"
    got = stores.cues(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string"), "id", "t").collect()
    assert [(r["start"], r["end"], r["lines"]) for r in got] == [(1.0, 3.5, ["Hello"])]
    (tmp_path / "r.json").write_text('{"version": 1, "key": "a", "tier": "q1", "rate": null}\n{broken\n{"version": 2, "key": "a", "tier": "q1", "rate": 3.0}\n')
    assert [tuple(r) for r in stores.readings(spark, str(tmp_path / "r.json"), 1).collect()] == [("a", "q1", None)]


def test_scalars_with_nulls(spark):
    row = spark.createDataFrame([(None, None)], "a double, b long").select(scalars.frame_count(F.col("a")).alias("x"), scalars.clock(F.col("a")).alias("y"), scalars.kept_share(F.lit(0), F.col("a")).alias("z")).first()
    assert row["x"] is None and row["y"] is None


def test_controller_holds_a_budget(spark):
    from tesserae.operators.encode import encode

    rng = random.Random(5)
    rows = [(s, f, list(range(6)), [float(rng.randint(0, 400)) for _ in range(6)]) for s in range(2) for f in range(60)]
    df = spark.createDataFrame(rows, "scope long, frame long, slots array<long>, values array<double>")
    for budget in (30, 0):
        log = encode(df, 10.0, budget, 20).toPandas()
        kept = log.groupby("scope").tile.nunique()
        assert (kept <= 30).all() if budget else (kept > 100).all()
    assert set(log[log.is_key].frame) == {0, 20, 40}


def test_offsets_stay_in_banks(spark):
    from tesserae.operators.encode import bank_offsets

    rng = random.Random(6)
    rows = [(1, f, rng.randint(0, 100)) for f in range(80)]
    got = {r["frame"]: r["offset"] for r in bank_offsets(spark.createDataFrame(rows, "scope long, frame long, bytes long"), 128).collect()}
    end = 0
    for _, f, size in rows:
        assert got[f] >= end and (not size or got[f] // 128 == (got[f] + size - 1) // 128)
        end = got[f] + size


def test_epochs_are_spaced():
    from tesserae.operators.encode import epoch_starts

    starts = epoch_starts([(k * 10, 0.9 if k % 7 == 0 else 0.1) for k in range(1, 60)], 600, 100, 40)
    assert starts[0] == 0 and all(b - a >= 40 for a, b in zip(starts, starts[1:]))
    assert epoch_starts([], 0, 10, 1) == []


def test_movement_is_zero_for_still_slots(spark):
    from tesserae.operators.encode import movement

    px = spark.createDataFrame([(1, 0, [5, 9]), (1, 1, [5, 9]), (1, 2, [5, 32767])], "slot long, frame long, px array<int>")
    got = {r["frame"]: r["moved"] for r in movement(px, colour.colour_grid(spark)).collect()}
    assert got[1] == 0 and got[2] > 0.1


def test_listing_sections(spark):
    from tesserae.sources.listings import disassembly

    lines = ["Disassembly of section .text:", "00000010 <main>:", "  10:\t4e 71 \tnop", "  12:\t30 3c \tmovew #1,%d0", "junk"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "id long, n long, line string")
    got = [(r["section"], r["symbol"], r["address"], r["mnemonic"], r["operands"]) for r in disassembly(df, "id", "n", "line").orderBy("n").collect()]
    assert got == [(".text", "main", "10", "nop", ""), (".text", "main", "12", "movew", "#1,%d0")]


def test_guards_name_the_first_broken_rule(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, 2), (None, 2), (5, None)], "a long, b long")
    rules = {"a": F.col("a") < 4, "b": F.col("b") > 0}
    assert [r[0] for r in df.select(guards.broken_rule(rules)).collect()] == [None, "a", "a"]
    assert guards.checked(df.limit(1), rules).count() == 1
    with pytest.raises(PySparkException, match="row breaks rule: a"):
        guards.checked(df, rules).collect()
    with pytest.raises(PySparkException, match="no anchor"):
        df.select(guards.replaced(F.lit("x"), "y", "z")).collect()
    assert df.select(guards.by_prefix(F.lit("dbra"), {"d": 1, "db": 2}), guards.by_prefix(F.lit("x"), {}, 7), guards.by_prefix(F.lit(None).cast("string"), {"d": 1})).first()[:] == (2, 7, None)


def test_tails_are_filled_or_refused(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, 0, "a", 4), (1, 5, "b", 4), (2, 1, "c", 1)], "run long, at long, v string, wanted long")
    assert sorted((r["run"], r["place"], r["v"]) for r in guards.padded_tail(df, "run", "at", "wanted").collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "b"), (2, 0, "c")]
    with pytest.raises(PySparkException, match="rows missing"):
        guards.padded_tail(df.withColumn("wanted", F.lit(9).cast("long")), "run", "at", "wanted").collect()


def test_raw_frames_are_read_in_chunks(spark, tmp_path):
    from tesserae.sources.frames import decoded

    pixels = [bytes([k] * 12) for k in range(10)]
    clip = tmp_path / "clip.rgb"
    clip.write_bytes(b"".join(pixels) + b"cut")
    read = lambda **more: sorted((r["frame"], bytes(r["pixels"])) for r in decoded(spark, str(clip), 2, 2, chunk_frames=4, **more).collect())
    assert read() == list(enumerate(pixels)) and read(wanted=3) == list(enumerate(pixels[:3]))
    assert read(wanted=12) == list(enumerate([*pixels, pixels[-1], pixels[-1]]))
    assert decoded(spark, str(clip), 2, 2, chunk_frames=4).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="3 frames missing"):
        read(wanted=13)
    (tmp_path / "none.rgb").write_bytes(b"")
    assert decoded(spark, str(tmp_path / "none.rgb"), 2, 2).count() == 0
    with pytest.raises(ValueError, match="1 frames missing"):
        decoded(spark, str(tmp_path / "none.rgb"), 2, 2, wanted=1)

    rows = decoded(spark, str(clip), 2, 2, stream=True, chunk_frames=4)
    started = lambda: rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert started()
    with clip.open("ab") as more:
        more.write(b"s" * 9 + bytes([11] * 12))
    assert started()
    found = sorted((r["frame"], bytes(r["pixels"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == list(enumerate([*pixels, b"cut" + b"s" * 9, bytes([11] * 12)]))


def test_options_are_refused():
    assert guards.resolve_hold(3, 24.0) == 3 and guards.resolve_duration(2.0, None, 5.0) == 3.0
    for wrong in (lambda: guards.resolve_hold(0, 24.0), lambda: guards.resolve_hold(2, 24.0), lambda: guards.resolve_duration(6.0, None, 5.0), lambda: guards.resolve_duration(0.0, -1.0, 5.0)):
        with pytest.raises(ValueError):
            wrong()


def test_chunks_and_blobs(spark, tmp_path):
    from tesserae.streaming.chunks import chunked

    parts = spark.createDataFrame([(f"p{i}", bytes(range(i))) for i in range(6)], "name string, blob binary").repartition(3)
    stores.write_blobs(parts, "name", "blob", str(tmp_path / "t"))
    stream = chunked(spark, str(tmp_path / "t"), "name string, blob binary", files=1)
    run = stream.writeStream.format("memory").queryName("blobs_read").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {r["name"]: bytes(r["blob"]) for r in spark.table("blobs_read").collect()}
    assert got["p3"] == b"\x00\x01\x02\x00" and got["p4"] == b"\x00\x01\x02\x03" and len(got) == 6 and len(run.recentProgress) > 1


def test_cues_of_whole_texts(spark, tmp_path):
    rows = [(3, "Été a < b\ntwo <b>lines</b>\n \nthird {x}1\r\n\n\n<i></i>\n<i></i>\n{y}\n7 last"), (4, "\n 9 zero"), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["subtitle_cues"](spark, str(tmp_path)).orderBy("doc_id", "cue").collect()
    assert [tuple(r) for r in got] == [(3, 0, 0.3, 1.3, ["Été a < b", "two lines"]), (3, 1, 2.3, 3.3, ["third 1"]), (3, 3, 6.3, 7.3, ["7 last"]), (4, 0, 0.4, 1.4, ["9 zero"])]


def test_epochs_count_every_cut(spark, tmp_path):
    rows = [(i, 400.0 if i % 10 == 3 else 1.0 if i else None) for i in range(95)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["frame"]: r["epoch"] for r in queries.QUERIES["epoch_buckets"](spark, str(tmp_path)).collect()}
    assert got == {i: (i + 7) // 10 for i in range(95)}


def test_palettes_are_fitted_for_each_cluster(spark):
    from tesserae.operators.palettes import palette_set

    few, many = [5, 9, 31], list(range(32000, 32064))
    tiles = spark.createDataFrame([([few[(i + j) % 3] for j in range(64)],) for i in range(3)] + [(many,)] * 3 + [([],), (None,)], "px array<int>")
    grid = colour.colour_grid(spark)
    for count in (2, 9):
        got = {r["palette"]: r for r in palette_set(tiles, grid, count, 16, 5).collect()}
        assert sorted(got) == list(range(count)) and [got[k]["bank"] for k in sorted(got)] == list(range(16, 16 + count))
        assert all(len(r["colors"]) == 15 and len(r["descriptor"]) == 9 for r in got.values())
        found = [set(r["colors"]) for r in got.values()]
        assert all(x <= set(few + many) for x in found)
        assert any(r["colors"] == few * 5 for r in got.values()) and any(x <= set(many) and len(x) > 3 for x in found)
        assert count == 2 or any(x & set(few) and x & set(many) for x in found)  # a cluster without tiles takes all tiles
    with pytest.raises(ValueError, match="banks"):
        palette_set(tiles, grid, 4, 253, 5)
    with pytest.raises(ValueError, match="no tiles"):
        palette_set(tiles.where("size(px) = 0"), grid, 4, 16, 5)


def test_palette_fit_reseeds_lost_centres():
    import numpy as np

    from tesserae.operators.palettes import fit

    # Fifteen frequent colours share one point; without reseeding fourteen centres stay on it and the rest is one centre.
    lab = np.zeros((32, 3))
    lab[15:] = np.arange(17)[:, None] * 10.0 + 100
    chosen = fit(np.arange(32), np.where(np.arange(32) < 15, 9, 1), lab, 5)
    assert len(chosen) == 15 and len({tuple(lab[c]) for c in chosen}) > 5


def test_masking_leaves_moving_slots_pending(spark):
    from tesserae.operators.encode import encode

    # Slot 0 moves by 50 and then stands still; slot 1 drifts by less than the tolerance a frame.
    rows = [(1, f, [0, 1], [v, 8.0 * f]) for f, v in enumerate([0.0, 50.0, 50.0, 50.0])]
    df = spark.createDataFrame(rows, "scope long, frame long, slots array<long>, values array<double>")
    got = {m: sorted((r["frame"], r["slot"], r["value"]) for r in encode(df, 10.0, 0, 100, m).collect() if not r["is_key"]) for m in (0.0, 1.0)}
    assert got[0.0] == [(1, 0, 50.0), (2, 1, 16.0)]
    assert got[1.0] == [(2, 0, 50.0), (3, 1, 24.0)]


def test_masked_query_waits_for_still_slots(spark, tmp_path):
    rows = [(i, 1, v) for i, v in enumerate([0.0] * 8 + [50.0] * 16)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    changed = {q: {r["frame"] for r in queries.QUERIES[q](spark, str(tmp_path)).collect() if not r["is_key"]} for q in ("budgeted_encode", "masked_encode")}
    assert changed == {"budgeted_encode": {1}, "masked_encode": {2}}


def test_vectors_are_used_whole(spark, tmp_path):
    cells = [(i * 5) % 16 for i in range(67)]
    spark.createDataFrame([(1, [c / 64 for c in cells])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    row = run("bit_planes").first()
    words = [[row[f"plane{k}"][w] % 2**64 for k in range(4)] for w in range(2)]
    assert [sum((words[i // 64][k] >> i % 64 & 1) << k for k in range(4)) for i in range(67)] == cells
    tiles = [list(r["px"]) for r in run("tile_split").orderBy("tile").collect()]
    assert len(tiles) == 17 and sum(tiles, []) == cells
    woven = run("interleave").first()["woven"]
    assert woven[::2] + woven[1::2] == [*cells, 0]


def test_cue_records_have_88_bytes(spark):
    from tesserae.sources.cues import cue_records, glyph

    rows = [(1, 0.0, 1.0, ["gone"]), (1, 0.5, 4.0, ["Ab 7", "é%!"]), (1, 3.0, 9.0, ["x" * 100]), (1, 12.0, 13.0, ["late"])]
    got = [bytes(r["record"]) for r in cue_records(spark.createDataFrame(rows, "id long, start double, end double, lines array<string>"), "id", 1.0, 5.0, 10.0).orderBy("n").collect()]
    assert [len(x) for x in got] == [88, 88]
    assert [(int.from_bytes(x[:4], "big"), int.from_bytes(x[4:8], "big")) for x in got] == [(0, 20), (20, 50)]
    assert got[0][8:48] == bytes(16) + bytes([24, 51, 0, 9, 0, 0, 76, 82]) + bytes(16) and got[0][48:] == bytes(40)
    assert got[1][8:] == bytes([73] * 80) and [glyph(c) for c in "09:/zZ.-,'?~"] == [2, 11, 12, 13, 75, 49, 77, 78, 79, 80, 81, 0]


def test_displayed_error_counts_unwritten_slots(spark):
    from tesserae.operators.encode import displayed_error, encode

    rows = [(1, f, [0, 1], [v, 5.0]) for f, v in enumerate([0.0, 6.0, 20.0])]
    frames = spark.createDataFrame(rows, "scope long, frame long, slots array<long>, values array<double>")
    assert [tuple(r) for r in displayed_error(frames, encode(frames, 10.0, 0, 100)).collect()] == [(1, 6.0)]


def test_nibbles_are_rendered(spark):
    df = spark.createDataFrame([([1, 3, 0, 4], [7, 8, 9])], "n array<int>, c array<int>")
    assert df.select(scalars.rendered(F.col("n"), F.col("c"))).first()[0] == [7, 9, None, None]
    for r in queries.QUERIES["rendered_tiles"](spark, SF).collect():
        assert len(r["nibbles"]) == len(r["px"]) == 64 and set(r["nibbles"]) <= set(range(1, 16)) and None not in r["px"]


def test_frames_bound_by_the_table(spark, tmp_path):
    rows = [(i, i % 7, "a" if i < 900 else "b", float(i)) for i in range(1000, 3000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    state = {r["user_id"]: r["at"] for r in queries.QUERIES["log_replay"](spark, str(tmp_path)).collect()}
    assert state == {i % 7: i for i in range(1000, 3000)}
    got = [tuple(r) for r in queries.QUERIES["joined_windows"](spark, str(tmp_path)).orderBy("n").collect()]
    assert got == [("a" if f < 2000 else "b", f, n) for n, f in enumerate([*range(1200, 2000), *range(2400, 3000)])]


def test_choose_equals_plain_greedy():
    rng = random.Random(11)
    for _ in range(60):
        costs = sorted({rng.randint(1, 500) for _ in range(rng.randint(2, 40))}, reverse=True)
        points, count = [(float(c), 0.0) for c in costs], rng.randint(2, 12)
        left, taken = list(range(len(points))), []
        logs = [math.log(c) for c in costs]
        for k in range(min(count, len(points))):
            target = logs[0] + (logs[-1] - logs[0]) * k / (count - 1)
            best = min(left, key=lambda i: (round(abs(logs[i] - target), 12), i))
            left.remove(best)
            taken.append(best)
        wanted = points if len(points) <= count else [points[i] for i in sorted(taken)]
        assert measure.choose(points, count) == wanted


def test_controller_follows_its_law():
    from tesserae.operators.encode import RateController

    control = RateController(2.0, 100, 50)
    assert control.tolerance(0, 0) == 2.0
    assert control.tolerance(90, 1) == pytest.approx(2.0 * min(1.25, 4.5 / (10 / 49)))
    assert control.tolerance(100, 2) == 2.0 * 4096 and RateController(2.0, 0, 50).tolerance(7, 3) == 2.0
    eased = RateController(1.0, 1000, 10)
    eased.scale = 3.0
    assert eased.tolerance(0, 0) == pytest.approx(2.7) and eased.tolerance(0, 10) == pytest.approx(2.7)


def test_match_without_rivals_and_ties(spark):
    rows = [(1, 0, 5.0), (1, 1, 2.0), (1, 2, 2.0), (1, 3, 6.0), (1, 4, 2.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 50.0)]
    df = spark.createDataFrame(rows, "c long, f long, e double")
    got = {r["c"]: tuple(r)[1:] for r in measure.best_match(df, "c", "f", "e", 10, 1).collect()}
    assert got == {1: (1, 2.0, 4, 0.0, False), 2: (0, 1.0, None, None, True), 3: (0, 50.0, None, None, False)}


def test_tiles_and_roms(spark):
    px = [(i * 7) % 16 for i in range(256)]
    df = spark.createDataFrame([(px, bytearray(b"abc"))], "px array<int>, blob binary")
    tile = df.select(stores.packed_tile(F.col("px")).alias("t"), "blob").select("t.c1", "t.c2", "blob")
    row = tile.select("c1", "c2", stores.unpacked_tile(F.col("c1"), F.col("c2")).alias("px"), stores.filled_rom(F.col("blob"), 8).alias("rom")).first()
    assert row["px"] == px and len(row["c1"]) == len(row["c2"]) == 64 and bytes(row["rom"]) == b"abc" + b"\x08" * 5
    assert row["c1"][0] == sum((px[8 + k] & 1) << k for k in range(8)) and row["c2"][33] == sum((px[k] >> 3 & 1) << k for k in range(8))
    assert df.select(stores.flipped_tile(F.col("px"), True, False)).first()[0][:16] == px[:16][::-1]
    with pytest.raises(Exception, match="beyond"):
        df.select(stores.filled_rom(F.col("blob"), 8, most=2)).collect()
