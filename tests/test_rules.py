"""Rules of formats, numbers and plans on single cases: what is expected is written out by hand. The same functions over tables are in ``column_queries``."""

import math
from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import maths, text
from wayfold.operators import alignment, batch, trajectory
from wayfold.plans import effects, steps

Cases = list[tuple[str, Callable[[], Column], str | None]]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


L = F.lit
IMPERIAL = text.Units.of("imperial")
FLIGHT = text.Units.of("imperial", ["distance=nm", "speed=kn"])


def format_rules() -> Cases:
    return [
        ("fixed", lambda: text.fixed(L(2.675), 2), "2.67"), ("fixed", lambda: text.fixed(L(0.125), 2), "0.12"), ("fixed", lambda: text.fixed(L(2.5), 0), "2"), ("fixed", lambda: text.fixed(L(3.5), 0), "4"), ("fixed", lambda: text.fixed(L(-0.03), 0), "0"),
        ("fixed", lambda: text.fixed(L(-1.005), 2), "-1.00"), ("fixed", lambda: text.fixed(L(1234567.891), 1), "1234567.9"), ("fixed", lambda: text.fixed(L(-0.06), 1), "-0.1"), ("fixed", lambda: text.fixed(_null("double"), 1), None),
        ("axis", lambda: text.axis_label(L(900.0), L(900.0), 1), "900 m"), ("axis", lambda: text.axis_label(L(0.0), L(1000.0), 1), "0.0 km"), ("axis", lambda: text.axis_label(L(-30.0), L(2200.0), 1), "0.0 km"),
        ("axis", lambda: text.axis_label(L(4828.032), L(4828.032), 1, IMPERIAL), "3.0 mi"), ("axis", lambda: text.axis_label(L(100.0), L(1600.0), 1, IMPERIAL), "328 ft"), ("axis", lambda: text.axis_label(L(18520.0), L(18520.0), 1, FLIGHT), "10.0 nm"),
        ("readout", lambda: text.readout(L(12.4), L(100.0)), "12"), ("readout", lambda: text.readout(L(12400.0), L(42000.0)), "12.4"), ("readout", lambda: text.readout(L(1609.344), L(9000.0), IMPERIAL), "1.0"),
        ("zero", lambda: text.reads_as_zero(L(200.0), L(41800.0), 0), "true"), ("zero", lambda: text.reads_as_zero(L(200.0), L(41800.0), 1), "false"),
        ("elevation axis", lambda: F.array_join(text.elevation_axis_labels(L(0.0), L(42195.0)), " "), "0 km 42 km"), ("elevation axis", lambda: F.array_join(text.elevation_axis_labels(L(10200.0), L(12400.0)), " "), "10.2 km 12.4 km"),
        ("elevation axis", lambda: F.array_join(text.elevation_axis_labels(L(200.0), L(42000.0)), " "), "0.2 km 42.0 km"), ("elevation axis", lambda: F.array_join(text.elevation_axis_labels(L(3.0), L(42003.0)), " "), "0 km 42 km"),
        ("elevation", lambda: text.elevation_label(L(12.34), L(9.0)), "12.3 m"), ("elevation", lambda: text.elevation_label(L(12.34), L(30.0)), "12 m"), ("elevation", lambda: text.elevation_label(L(100.0), L(30.0), IMPERIAL), "328 ft"),
        ("range", lambda: F.array_join(text.elevation_range_labels(L(10.0), L(10.5)), " "), "10.2 m"), ("range", lambda: F.array_join(text.elevation_range_labels(L(10.0), L(30.0)), " "), "30 m 10 m"),
        ("heart rate", lambda: text.heart_rate(_null("int")), "-- bpm"), ("heart rate", lambda: text.heart_rate(L(142)), "142 bpm"), ("power", lambda: text.power(_null("double"), L(250.4)), "250 W"), ("power", lambda: text.power(L(260.0), L(250.0)), "260 W"), ("power", lambda: text.power(_null("double"), L(250.0), "developer"), "-- W"),
        ("cadence", lambda: text.cadence(L(85), L("running")), "170 spm"), ("cadence", lambda: text.cadence(L(85), L("cycling")), "85 rpm"), ("cadence", lambda: text.cadence(_null("int"), L("walking")), "-- spm"),
        ("speed", lambda: text.speed(L(2.5)), "9.0 km/h"), ("speed", lambda: text.speed(L(10.0)), "36 km/h"), ("speed", lambda: text.speed(_null("double"), "kn"), "-- kn"), ("pace", lambda: text.pace(L(1000 / 330)), "5:30/km"), ("pace", lambda: text.pace(L(0.0)), "--:--/km"),
        ("incline", lambda: text.incline(L(0.0512)), "5.1%"), ("incline", lambda: text.incline(_null("double")), "--%"), ("gain and loss", lambda: F.array_join(text.gain_loss(L(123.4), L(50.6)), " "), "+123 m -51 m"),
        ("gain and loss", lambda: F.array_join(text.gain_loss(L(100.0), L(0.0), IMPERIAL), " "), "+328 ft -0 ft"), ("rows", lambda: F.array_join(text.metric_rows(L("a"), L("b"), optional=(L(None).cast("string"), L("c"))), ","), "a,b,c"),
        ("offset", lambda: text.signed_offset(L(3.5)), "+3.5s"), ("offset", lambda: text.signed_offset(L(-2.0)), "-2s"), ("offset", lambda: text.signed_offset(L(0.00025)), "+0.00025s"), ("offset", lambda: text.signed_offset(L(100.0)), "+100s"),
        ("time", lambda: text.time_text(L(False), _null("double"), L(None).cast("timestamp")), "unset"), ("time", lambda: text.time_text(L(True), L(5025.0), L(None).cast("timestamp")), "5025s"), ("time", lambda: text.time_text(L(True), L(1.5), L(None).cast("timestamp")), "1.5s"),
        ("path", lambda: text.swap_extension(L("/a/b.c.mov"), ".mp4"), "/a/b.c.mp4"), ("path", lambda: text.positional(L("-x.mp4")), "./-x.mp4"), ("path", lambda: text.positional(L("x.mp4")), "x.mp4"), ("path", lambda: text.escape_filter_path(L("a:b'c,d")), "a\\:b\\'c,d"),
        ("log", lambda: text.quoted(L("a b")), '"a b"'), ("log", lambda: text.quoted(L("ab")), "ab"), ("log", lambda: text.quoted(L("")), '""'), ("name", lambda: text.output_name(L("clip"), F.array(L("x"), L("y")), L(".mp4"), L(2)), "clip - x - y - 2.mp4"),
        ("offset literal", lambda: text.offset_seconds(L("+3.5")), "3.5"), ("offset literal", lambda: text.offset_seconds(L("auto")), None), ("zone", lambda: text.utc_offset(L("+05:30")), "19800"), ("zone", lambda: text.utc_offset(L("UTC-3")), "-10800"), ("zone", lambda: text.utc_offset(L("x")), None),
        ("key", lambda: text.describe_key(L(-1), L("location")), "container tag location"), ("key", lambda: text.describe_key(L(2), L("title")), "stream 2 tag title"), ("percent", lambda: text.percent(L(1), L(3)), "33"), ("percent", lambda: text.percent(L(1), L(0)), "0"),
        ("fps", lambda: text.frames_per_second(L(0.0)), "0"), ("fps", lambda: text.frames_per_second(L(9.94)), "9.9"), ("fps", lambda: text.frames_per_second(L(24.6)), "25"), ("rate", lambda: text.rational_rate(L("30000/0")), "0.0"), ("score", lambda: text.score_in(L("VMAF score: 97.5")), "97.5"), ("score", lambda: text.score_in(L("none")), None),
    ]


def _matrix_text(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: (F.round(x, 6) + 0.0).cast("string")), " ")


def number_rules() -> Cases:
    near = lambda c: F.round(c, 6) + 0.0
    shift = lambda x, y: maths.matrix([[1, 0, x], [0, 1, y], [0, 0, 1]])
    third = lambda: maths.matrix([[2, 0, 0], [0, 4, 0], [0, 0, 1]])
    turn = lambda: F.struct(L(0.8).alias("w"), L(0.0).alias("x"), L(0.6).alias("y"), L(0.0).alias("z"))
    none = lambda: F.struct(_null("double").alias("w"), _null("double").alias("x"), _null("double").alias("y"), _null("double").alias("z"))
    side = lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))
    return [
        ("frames", lambda: maths.presented_frames(L(100), L(3.0), L(30.0)), "90"), ("frames", lambda: maths.presented_frames(L(90), L(3.0), L(30.0)), "90"), ("frames", lambda: maths.presented_frames(L(None).cast("int"), L(3.0), L(30.0)), "0"),
        ("display", lambda: side(maths.display_size(L(1920), L(1080), L(90))), "1080,1920"), ("display", lambda: side(maths.display_size(L(1920), L(1080), L(180))), "1920,1080"), ("rotation", lambda: maths.compose_rotation(L(90), L(180)), "270"),
        ("strength", lambda: maths.strength_to_sigma(L(0.5)), "17.0"), ("strength", lambda: maths.strength_to_sigma(L(2.0)), "24.0"),
        ("yaw", lambda: near(maths.yaw_rate(L(math.pi / 180), L(60.0), L(True))), "-60.0"), ("yaw", lambda: maths.yaw_rate(L(1.0), L(60.0), L(False)), "0.0"), ("yaw", lambda: near(maths.heading_rate(turn(), L(30.0), L(True))), str(round(-math.degrees(2 * math.atan2(0.6, 0.8)) * 30, 6))),
        ("yaw", lambda: maths.heading_rate(none(), L(30.0), L(True)), "0.0"), ("zoom", lambda: near(maths.total_zoom(L(0.1), L(0.05), L(0.02))), "0.1781"), ("zoom", lambda: maths.total_zoom(L(0.0), L(0.0), L(0.0)), "0.0"),
        ("focal", lambda: maths.scaled_focal(L(480.0), L(960.0), L(3840.0)), "1920.0"), ("distance", lambda: maths.current_distance(_null("double"), L(5.0), L(9.0)), "5.0"), ("distance", lambda: maths.current_distance(L(12.0), L(5.0), L(9.0)), "9.0"), ("distance", lambda: maths.current_distance(L(6.5), L(5.0), L(9.0)), "6.5"),
        ("plot", lambda: maths.elevation_window(L(10.0), L(10.2))["base"], "9.6"), ("plot", lambda: maths.elevation_window(L(10.0), L(10.2))["range"], "1.0"), ("plot", lambda: maths.elevation_window(L(10.0), L(40.0))["base"], "10.0"), ("plot", lambda: maths.elevation_window(L(10.0), L(40.0))["range"], "30.0"),
        ("axis", lambda: maths.axis_x(L(5.0), L(0.0), L(10.0), L(100.0), L(200.0)), "150.0"), ("matrix", lambda: _matrix_text(maths.matrix_product(shift(1, 2), shift(3, 4))), "1.0 0.0 4.0 0.0 1.0 6.0 0.0 0.0 1.0"),
        ("matrix", lambda: _matrix_text(maths.matrix_inverse(third())), "0.5 0.0 0.0 0.0 0.25 0.0 0.0 0.0 1.0"), ("matrix", lambda: _matrix_text(maths.matrix_inverse(maths.matrix([[1, 2, 3], [2, 4, 6], [0, 0, 1]]))), "1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0"),
        ("matrix", lambda: _matrix_text(maths.matrix_unit(maths.matrix([[2, 0, 4], [0, 2, 6], [0, 0, 2]]))), "1.0 0.0 2.0 0.0 1.0 3.0 0.0 0.0 1.0"), ("matrix", lambda: _matrix_text(maths.matrix_rescaled(maths.matrix([[1, 0, 3], [0, 1, 5], [0.25, 0.5, 1]]), 4.0)), "1.0 0.0 12.0 0.0 1.0 20.0 0.0625 0.125 1.0"),
        ("residual", lambda: _matrix_text(maths.perspective_residual(L(1.0), L(0.0), L(2.0), L(3.0), shift(2, 3))), "1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 1.0"),
        ("residual", lambda: _matrix_text(maths.perspective_residual(L(0.0), L(2.0), L(0.0), L(0.0), maths.matrix([[0, -2, 0], [2, 0, 0], [0.1, 0, 1]]))), "1.0 0.0 0.0 0.0 1.0 0.0 0.1 0.0 1.0"),
        ("field of view", lambda: near(maths.field_of_view("rectilinear", 480.0, 960.0)), "90.0"), ("field of view", lambda: near(maths.field_of_view("equidistant", 480.0, 960.0)), str(round(math.degrees(2.0), 6))),
        ("energy", lambda: near(alignment.energy(L(81.0), L(9.0))), str(round(81 / (4 * math.sqrt(math.pi)), 6))), ("energy", lambda: alignment.energy(L(0.0), L(9.0)), "0.0"), ("turn", lambda: alignment.turn_per_minute(L(90.0), L(12.0)), "450.0"), ("turn", lambda: alignment.turn_per_minute(L(90.0), L(0.0)), "0.0"),
        ("edge", lambda: alignment.edge_warning(L(1.0), L(7.0), L(60.0)), "start"), ("edge", lambda: alignment.edge_warning(L(20.0), L(59.0), L(60.0)), "end"), ("edge", lambda: alignment.edge_warning(L(20.0), L(26.0), L(60.0)), ""), ("edge", lambda: alignment.edge_warning(L(0.0), L(0.0), L(60.0)), ""),
    ]


def plan_rules() -> Cases:
    spot = lambda anchor: F.concat_ws(",", *[effects.anchored(L(anchor), L(100), L(50), L(4))[c].cast("double").cast("string") for c in "xy"])
    return [
        ("layout", lambda: effects.layout(L("auto"), L(True), L(True)), "vertical"), ("layout", lambda: effects.layout(L("auto"), L(False), L(False)), "default-no-power"), ("layout", lambda: effects.layout(L("time"), L(True), L(True)), "time"), ("layout", lambda: effects.layout(L("surprise"), L(False), L(True)), "default"),
        ("readout", lambda: effects.readout(L(0.5), L(0.3), L(True)), "0.5"), ("readout", lambda: effects.readout(L(7.0), L(0.3), L(True)), "0.3"), ("readout", lambda: effects.readout(_null("double"), L(0.3), L(False)), "0.0"),
        ("anchor", lambda: spot("top-left"), "4.0,4.0"), ("anchor", lambda: spot("bottom-right"), "96.0,46.0"), ("anchor", lambda: spot("middle"), "50.0,25.0"),
        ("subtitle", lambda: effects.embeds_subtitle(L(".mp4"), L(True)), "true"), ("subtitle", lambda: effects.embeds_subtitle(L(".mkv"), L(True)), "false"), ("trim", lambda: effects.trim_extension(L("a.MOV")), ".mov"), ("trim", lambda: effects.trim_extension(L("a.mkv")), ".mp4"),
        ("start", lambda: effects.start_survives(L(0.0), L(False), L(".mkv")), "true"), ("start", lambda: effects.start_survives(L(2.0), L(False), L(".mkv")), "false"), ("start", lambda: effects.start_survives(L(2.0), L(True), L(".mkv")), "true"),
        ("yaw", lambda: effects.yaw_check(L(-0.1), L(500.0), L(500.0)), "error"), ("yaw", lambda: effects.yaw_check(L(0.1), L(1200.0), L(500.0)), "warning"), ("yaw", lambda: effects.yaw_check(L(0.1), L(600.0), L(500.0)), "ok"),
        ("fallback", lambda: effects.falls_back(L("auto"), L(False)), "true"), ("fallback", lambda: effects.falls_back(L("vertical"), L(False)), "false"), ("fallback", lambda: effects.falls_back(L("auto"), L(True)), "false"),
        ("render", lambda: trajectory.render_path(L(True), L(True), L(False)), "rotation"), ("render", lambda: trajectory.render_path(L(False), L(False), L(True)), "mesh"), ("render", lambda: trajectory.render_path(L(False), L(False), L(False)), "similarity"),
        ("instant", lambda: batch.instant_seconds(L(5_500_000), L(1_000_000), L(500_000)), "4.0"), ("bounds", lambda: batch.valid_bounds(L("relative"), L("absolute"), L(5.0), L(1.0)), "true"), ("bounds", lambda: batch.valid_bounds(L("relative"), L("relative"), L(5.0), L(1.0)), "false"),
        ("calibration", lambda: batch.calibration_start(L(-1.0), L(10.0))["start"], "0.0"), ("calibration", lambda: batch.calibration_start(L(11.0), L(10.0))["status"], "outside"),
    ]


@pytest.mark.parametrize("cases", [format_rules, number_rules, plan_rules])
def test_rules(spark, cases):
    each = F.array(*[F.struct(F.lit(f"{i} {rule}").alias("rule"), make().cast("string").alias("result")) for i, (rule, make, _) in enumerate(cases())])
    got = {r["rule"]: r["result"] for r in spark.range(1).select(F.inline(each)).collect()}
    assert got == {f"{i} {rule}": expected for i, (rule, _, expected) in enumerate(cases())}


def test_a_stripped_file_is_clean(spark):
    from wayfold.operators import governance

    rows = [("f", -1, "location", "+1+2/", None), ("f", 0, "handler_name", "Jane's camera 4711", "video"), ("f", 1, "handler_name", "SoundHandler", "audio"), ("f", 1, "language", "deu", "audio"), ("f", 0, "title", "x", "video"), ("f", 0, "DURATION", "00:01", "video"), ("f", 0, "creation_time", "2020", "video")]
    tags = spark.createDataFrame(rows, "file string, stream int, key string, value string, kind string")
    out = steps.StripMetadata().apply(tags)
    got = {(r["stream"], r["key"]): r["value"] for r in out.collect()}
    assert got == {(0, "handler_name"): "VideoHandler", (1, "handler_name"): "SoundHandler", (1, "language"): "und", (0, "DURATION"): "00:01"}
    assert governance.survived(tags.drop("kind"), out.drop("kind")).count() == 0
    plain = {(r["stream"], r["key"]) for r in steps.StripMetadata().apply(tags.drop("kind")).collect()}
    assert plain == {(1, "handler_name"), (1, "language"), (0, "DURATION")}
