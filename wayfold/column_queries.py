"""Registered queries of the functions of columns: formats, parsing, geometry and decisions over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from . import matrices
from .functions import maths, text
from .operators import alignment, batch, trajectory
from .plans import effects, steps
from .registry import query, rounded, table
from .sources import probe

IMPERIAL, FLIGHT = text.Units.of("imperial"), text.Units.of("imperial", ["distance=nm", "speed=kn"])
L = F.lit


def _per_metre(unit: str) -> str:
    return f"{text.DISTANCE[unit]!r}::DOUBLE"


def _axis_sql(d: str, span: str, decimals: int, long: str = "km", short: str = "m", unit: bool = True) -> str:
    end = lambda u: f" {u}" if unit else ""
    return f"CASE WHEN ({span}) * {_per_metre(long)} < 1 THEN printf('%.0f{end(short)}', ({d}) * {_per_metre(short)}) ELSE printf('%.{decimals}f{end(long)}', ({d}) * {_per_metre(long)}) END"


# --- labels and readings ------------------------------------------------------------

@query(f"""
WITH o AS (SELECT o_orderkey, o_totalprice % 5000 AS d, o_custkey * 7.0 AS span FROM orders)
SELECT o_orderkey, {_axis_sql("d", "span", 1)} AS metric, {_axis_sql("d", "span", 1, "mi", "ft")} AS imperial, {_axis_sql("d", "span", 0, "nm", "ft")} AS flight, {_axis_sql("d", "span", 1, unit=False)} AS live,
{_axis_sql("d", "span", 1, "mi", "ft", False)} AS live_imperial, {_axis_sql("d % 90", "span", 1)} = {_axis_sql("0.0::DOUBLE", "span", 1)} AS zero FROM o
""")
def unit_labels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 5000).alias("d"), (F.col("o_custkey") * 7.0).alias("span"))
    x, span = F.col("d"), F.col("span")
    return o.select(
        "o_orderkey", text.axis_label(x, span, 1).alias("metric"), text.axis_label(x, span, 1, IMPERIAL).alias("imperial"), text.axis_label(x, span, 0, FLIGHT).alias("flight"), text.readout(x, span).alias("live"),
        text.readout(x, span, IMPERIAL).alias("live_imperial"), text.reads_as_zero(x % 90, span, 1).alias("zero"),
    )


def _elevation_sql(e: str, span: str, unit: str = "m") -> str:
    k = _per_metre(unit)
    return f"CASE WHEN ({span}) * {k} < 10 THEN printf('%.1f {unit}', ({e}) * {k}) ELSE printf('%.0f {unit}', ({e}) * {k}) END"


_ONE = f"(b - a) / 1000 < 10 OR ({_axis_sql('a', 'b - a', 0)} = {_axis_sql('0.0::DOUBLE', 'b - a', 0)} AND {_axis_sql('a', 'b - a', 1)} <> {_axis_sql('0.0::DOUBLE', 'b - a', 1)})"


@query(f"""
WITH p AS (SELECT p_partkey, p_retailprice AS e, p_size * 0.9 AS span, p_retailprice + p_size * 0.04 AS high, (p_partkey % 40) * 110.0 AS a, (p_partkey % 40) * 110.0 + p_size * 1230.0 AS b FROM part)
SELECT p_partkey, {_elevation_sql("e", "span")} AS label, {_elevation_sql("e", "span", "ft")} AS imperial, CASE WHEN high - e < 1 THEN {_elevation_sql("(e + high) / 2", "high - e")} ELSE {_elevation_sql("high", "high - e")} || ' ' || {_elevation_sql("e", "high - e")} END AS ends,
CASE WHEN {_ONE} THEN {_axis_sql("a", "b - a", 1)} || ' ' || {_axis_sql("b", "b - a", 1)} ELSE {_axis_sql("a", "b - a", 0)} || ' ' || {_axis_sql("b", "b - a", 0)} END AS axis,
CASE WHEN high - e < 1 THEN round((e + high) / 2 - 0.5, 6) ELSE e END AS base, round(greatest(high - e, 1), 6) AS "range" FROM p
""")
def elevation_labels(spark, d):
    p = table(spark, d, "part").withColumn("high", F.col("p_retailprice") + F.col("p_size") * 0.04).withColumn("a", (F.col("p_partkey") % 40) * 110.0).withColumn("b", F.col("a") + F.col("p_size") * 1230.0)
    e, span, high = F.col("p_retailprice"), F.col("p_size") * 0.9, F.col("high")
    plot = maths.elevation_window(e, high)
    out = p.select(
        "p_partkey", text.elevation_label(e, span).alias("label"), text.elevation_label(e, span, IMPERIAL).alias("imperial"), F.array_join(text.elevation_range_labels(e, high), " ").alias("ends"),
        F.array_join(text.elevation_axis_labels(F.col("a"), F.col("b")), " ").alias("axis"), plot["base"].alias("base"), plot["range"].alias("range"),
    )
    return rounded(out, "base", "range")


_READINGS = "WITH l AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity * 5.2 END AS dev, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 4.9 END AS native, CASE l_linenumber % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'hiking' ELSE 'cycling' END AS sport, CASE WHEN l_linenumber <> 4 THEN l_quantity::INT END AS rev, CASE WHEN l_linenumber <> 5 THEN l_quantity * 0.37 END AS v FROM lineitem)"


def _speed_sql(unit: str) -> str:
    x = f"v * {text.SPEED[unit]!r}::DOUBLE"
    return f"CASE WHEN v IS NULL THEN '-- {unit}' WHEN {x} < 10 THEN printf('%.1f {unit}', {x}) ELSE printf('%.0f {unit}', {x}) END"


def _pace_sql(unit: str) -> str:
    s, tail = f"round({text.PACE[unit]!r}::DOUBLE / v)::BIGINT", unit.removeprefix("min")
    return f"CASE WHEN v > 0 THEN printf('%d:%02d', {s} // 60, {s} % 60) || '{tail}' ELSE '--:--{tail}' END"


@query(f"""
{_READINGS} SELECT l_orderkey, l_linenumber, coalesce(round(coalesce(dev, native))::BIGINT || ' W', '-- W') AS power, coalesce(round(native)::BIGINT || ' W', '-- W') AS native, coalesce(CASE WHEN sport = 'cycling' THEN rev ELSE 2 * rev END::VARCHAR, '--') || CASE WHEN sport = 'cycling' THEN ' rpm' ELSE ' spm' END AS cadence,
{_speed_sql("km/h")} AS speed, {_speed_sql("kn")} AS knots, {_speed_sql("mph")} AS mph, {_pace_sql("min/km")} AS pace, {_pace_sql("min/mi")} AS pace_mi, printf('%.1f', (l_discount - 0.055) * 100) || '%' AS incline,
'+' || printf('%.0f', l_extendedprice / 100) || ' m -' || printf('%.0f', l_quantity * 1.0) || ' m' AS climbed, '+' || printf('%.0f', l_extendedprice / 100 * {_per_metre("ft")}) || ' ft -' || printf('%.0f', l_quantity * {_per_metre("ft")}) || ' ft' AS climbed_ft,
'1 km lap ' || l_linenumber || '/7' AS header, CASE WHEN l_linenumber % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS shown FROM l
""")
def reading_labels(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    dev, native = F.when(n % 3 != 0, q * 5.2), F.when(n % 2 == 0, q * 4.9)
    sport = F.when(n % 3 == 0, "running").when(n % 3 == 1, "hiking").otherwise("cycling")
    rev, v = F.when(n != 4, q.cast("int")), F.when(n != 5, q * 0.37)
    climbed = lambda units: F.array_join(text.gain_loss(F.col("l_extendedprice") / 100, q, units), " ")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", text.power(dev, native).alias("power"), text.power(dev, native, "native").alias("native"), text.cadence(rev, sport).alias("cadence"), text.speed(v).alias("speed"), text.speed(v, "kn").alias("knots"),
        text.speed(v, "mph").alias("mph"), text.pace(v).alias("pace"), text.pace(v, "min/mi").alias("pace_mi"), text.incline(F.col("l_discount") - 0.055).alias("incline"), climbed(text.METRIC).alias("climbed"), climbed(IMPERIAL).alias("climbed_ft"),
        text.splits_header(n, L(7)).alias("header"), F.array_join(text.metric_rows(L("a"), L("b"), optional=(F.when(n % 2 == 0, "c"),)), ",").alias("shown"),
    )


# --- times and names ------------------------------------------------------------------

@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, (o_orderkey % 5000) * 0.5 AS s, (o_orderkey % 400 - 200) * 0.25 AS off, o_custkey % 12 AS h FROM orders), t AS (SELECT *, abs(off)::DECIMAL(18, 2)::VARCHAR AS digits FROM o)
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'unset' WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN s = floor(s) THEN s::BIGINT || 's' ELSE s::DECIMAL(18, 1) || 's' END AS shown,
CASE WHEN off >= 0 THEN '+' ELSE '-' END || CASE WHEN off = round(off) THEN abs(off)::BIGINT::VARCHAR ELSE rtrim(digits, '0') END || 's' AS signed_,
CASE o_orderkey % 4 WHEN 0 THEN h + 0.5 WHEN 1 THEN -h::DOUBLE ELSE NULL END AS literal, CASE o_orderkey % 3 WHEN 0 THEN h * 3600 + 1800 WHEN 1 THEN -h * 3600 ELSE -1 END::INT AS zone,
CASE o_orderkey % 3 WHEN 0 THEN h * 60 + 30 WHEN 1 THEN h * 3600 + 90.5 ELSE NULL END::DOUBLE AS length, CASE o_orderkey % 4 WHEN 0 THEN 'relative' WHEN 1 THEN 'absolute' WHEN 2 THEN 'unset' ELSE 'invalid' END AS kind FROM t
""")
def time_texts(spark, d):
    k, h = F.col("o_orderkey"), F.col("o_custkey") % 12
    s, off = (k % 5000) * 0.5, (k % 400 - 200) * 0.25
    n = h.cast("string")
    literal = F.when(k % 4 == 0, F.concat(L("+"), n, L(".5"))).when(k % 4 == 1, F.concat(L("-"), n)).when(k % 4 == 2, "auto").otherwise(F.concat(n, L("x")))
    zone = F.when(k % 3 == 0, F.concat(L("+"), F.lpad(n, 2, "0"), L(":30"))).when(k % 3 == 1, F.concat(L("UTC-"), n)).otherwise("somewhere")
    length = F.when(k % 3 == 0, F.concat(n, L(":30"))).when(k % 3 == 1, F.concat(n, L("h1m30.5s"))).otherwise(F.concat(L("-"), n, L(".5")))
    kind = F.when(k % 4 == 0, F.concat(n, L("s"))).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 2, " ").otherwise("0x1F")
    return table(spark, d, "orders").select(
        "o_orderkey", text.time_text(F.col("o_custkey") % 3 != 0, s, F.when(k % 4 == 0, F.col("o_orderdate").cast("timestamp"))).alias("shown"), text.signed_offset(off).alias("signed_"), text.offset_seconds(literal).alias("literal"),
        F.coalesce(text.utc_offset(zone), L(-1)).alias("zone"), text.segment_seconds(length).alias("length"), text.time_kind(kind).alias("kind"),
    )


@query(r"""
WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || p_brand AS b, CASE p_size % 4 WHEN 0 THEN '.MOV' WHEN 1 THEN '.mkv' WHEN 2 THEN '.mp4' ELSE '' END AS e, CASE p_size % 4 WHEN 0 THEN 'mov' WHEN 1 THEN 'mp4,extra' WHEN 2 THEN 'matroska' ELSE 'movie' END AS fam FROM part)
SELECT p_partkey, '/a.b/' || p_brand || '.mp4' AS swapped, CASE WHEN p_size % 2 = 0 THEN './' ELSE '' END || b AS place, replace(replace(replace(p_name || ':b''c\d', '\', '\\'), ':', '\:'), '''', '\''') AS escaped,
CASE WHEN regexp_matches(p_name || b, '[\s"=]') THEN '"' || p_name || b || '"' ELSE p_name || b END AS logged, p_brand || ' - hud - fast' || CASE WHEN p_size % 3 > 0 THEN ' - ' || p_size % 3 ELSE '' END || '.mp4' AS named, fam IN ('mov', 'mp4,extra') AS iso,
CASE p_size % 4 WHEN 0 THEN '.mov' ELSE '.mp4' END AS trimmed, CASE WHEN p_size % 4 = 0 THEN 'container tag ' || p_brand ELSE 'stream ' || (p_size % 4 - 1) || ' tag ' || p_brand END AS tag FROM p
""")
def name_rules(spark, d):
    size, brand = F.col("p_size"), F.col("p_brand")
    b = F.concat(F.when(size % 2 == 0, "-").otherwise(""), brand)
    ext = F.when(size % 4 == 0, ".MOV").when(size % 4 == 1, ".mkv").when(size % 4 == 2, ".mp4").otherwise("")
    family = F.when(size % 4 == 0, "mov").when(size % 4 == 1, "mp4,extra").when(size % 4 == 2, "matroska").otherwise("movie")
    return table(spark, d, "part").select(
        "p_partkey", text.swap_extension(F.concat(L("/a.b/"), brand, F.when(size % 2 == 0, ".mov").otherwise("")), ".mp4").alias("swapped"), text.positional(b).alias("place"), text.escape_filter_path(F.concat("p_name", L(":b'c\\d"))).alias("escaped"),
        text.quoted(F.concat("p_name", b)).alias("logged"), text.output_name(brand, F.array(L("hud"), L("fast")), L(".mp4"), size % 3).alias("named"), text.iso_family(family).alias("iso"), effects.trim_extension(F.concat(L("clip"), ext)).alias("trimmed"),
        text.describe_key(size % 4 - 1, brand).alias("tag"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 100 AS done, o_custkey % 90 AS total, o_totalprice / 10000 - 1 AS rate FROM orders),
f AS (SELECT *, CASE WHEN total > 0 THEN floor(done / total::DOUBLE * 100)::INT ELSE 0 END AS pct, CASE WHEN rate <= 0 THEN '0' WHEN rate < 10 THEN printf('%.1f', rate) ELSE floor(rate + 0.5)::BIGINT::VARCHAR END AS fps, CASE WHEN rate > 0 THEN floor(greatest(total - done, 0) / rate + 0.5)::BIGINT END AS s FROM o)
SELECT o_orderkey, pct, fps, 'job ' || pct || '% ' || fps || ' fps' || coalesce(' ETA ' || CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END, '') AS line,
o_orderkey % 1000 / 10.0 AS score FROM f
""")
def progress_lines(spark, d):
    k = F.col("o_orderkey")
    done, total, rate = k % 100, F.col("o_custkey") % 90, F.col("o_totalprice") / 10000 - 1
    log = F.concat(L("libvmaf\nVMAF score: "), (k % 1000 / 10.0).cast("string"), L("\nend"))
    return table(spark, d, "orders").select("o_orderkey", text.percent(done, total).alias("pct"), text.frames_per_second(rate).alias("fps"), text.progress_line(L("job"), done, total, rate).alias("line"), text.score_in(log).alias("score"))


# --- numbers ------------------------------------------------------------------------------

_NUMBERS = "WITH l AS (SELECT *, CASE WHEN l_linenumber % 5 <> 0 THEN (l_quantity * 50)::BIGINT END AS stored, floor(l_linenumber * 10.0 * 29.97 + 0.5)::BIGINT AS held, least(1, greatest(0, l_discount * 12 - 0.1)) AS st FROM lineitem)"


@query(f"""
{_NUMBERS} SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(stored, 0) <= 0 THEN 0 WHEN held > 0 AND held < stored THEN held ELSE stored END AS frames, CASE WHEN l_suppkey % 2 = 1 THEN 1080 ELSE 1920 END AS wide, CASE WHEN l_suppkey % 2 = 1 THEN 1920 ELSE 1080 END AS high,
greatest(round(l_extendedprice / 7 / 2) * 2, 2)::BIGINT AS evened, round((1 + l_discount) * (1 + l_tax) * 1.02 - 1, 6) AS margins, round(l_quantity * 10 * 3840 / 960.0, 6) AS focal, round(CASE WHEN l_linenumber % 4 > 0 THEN l_quantity / (l_linenumber % 4 * 960) ELSE 0 END, 6) AS scale,
greatest(l_linenumber % 3, 1)::INT + 1 AS cols, greatest(floor(greatest(l_linenumber % 3, 1) * 540 / (l_quantity * 20) + 0.5), 1)::INT + 1 AS rows_, 1 + floor(st * 9 + 0.5)::INT AS shakiness, 10 + floor(st * 90 + 0.5)::INT AS smoothing, floor(st * 5 + 0.5)::INT AS zoomed,
CASE WHEN l_linenumber % 5 = 0 THEN 10.0 ELSE greatest(10, least(30, l_quantity)) END AS place, CASE WHEN l_quantity > 10 THEN round(100 + (15 - 10) / (l_quantity - 10) * 200, 6) END AS x, CASE WHEN l_returnflag <> 'A' THEN round(-l_tax * 30 * 180 / pi(), 6) + 0.0 ELSE 0 END AS yaw,
l_returnflag <> 'A' AND sqrt(l_tax * l_tax + l_discount * l_discount) <= 0.08 AS steady, CASE WHEN l_returnflag = 'R' THEN l_quantity - 20 > 0 ELSE l_quantity >= 20 AND l_discount > 0 AND l_tax > 0 AND l_discount < 0.8 * l_tax END AS lens,
l_returnflag = 'N' AND l_quantity >= 30 AND l_discount * 5 >= 0.2 AND l_tax * 20 > 0 AND l_tax * 20 <= 1 AS ratio_ok, round(greatest(abs(l_discount) * 540 / 960, abs(l_tax)), 6) AS pulled FROM l
""")
def number_maps(spark, d):
    n, q, c = F.col("l_linenumber"), F.col("l_quantity"), F.col
    wide, high = maths.display_size(L(1920), L(1080), (c("l_suppkey") % 4) * 90)
    cols, rows = maths.vertex_counts(n % 3, q * 20, L(540))
    tool = maths.tool_settings(c("l_discount") * 12 - 0.1)
    ok = c("l_returnflag") != "A"
    out = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", maths.presented_frames(F.when(n % 5 != 0, (q * 50).cast("long")), n * 10.0, L(29.97)).alias("frames"), wide.alias("wide"), high.alias("high"), maths.even(c("l_extendedprice") / 7).alias("evened"),
        maths.total_zoom(c("l_discount"), c("l_tax"), L(0.02)).alias("margins"), maths.scaled_focal(q * 10, L(960.0), L(3840.0)).alias("focal"), maths.source_scale(q, n % 4 * 960).alias("scale"), cols.alias("cols"), rows.alias("rows_"),
        tool["shakiness"].alias("shakiness"), tool["smoothing"].alias("smoothing"), tool["zoom"].alias("zoomed"), maths.current_distance(F.when(n % 5 != 0, q), L(10.0), L(30.0)).alias("place"), maths.axis_x(L(15.0), L(10.0), q, L(100.0), L(300.0)).alias("x"),
        maths.yaw_rate(c("l_tax"), 30.0, ok).alias("yaw"), maths.consistent(ok, c("l_tax"), c("l_discount"), 0.08).alias("steady"), maths.lens_reliable(c("l_returnflag") == "R", q - 20, q, c("l_discount"), c("l_tax"), 0.8).alias("lens"),
        maths.readout_reliable(c("l_returnflag") == "N", q, c("l_discount") * 5, c("l_tax") * 20).alias("ratio_ok"), maths.rectifier_margin(c("l_discount"), c("l_tax"), 960, 540).alias("pulled"),
    )
    return rounded(out, "margins", "focal", "scale", "x", "yaw", "pulled")


def _nine(m: matrices.Entries, name: str) -> str:
    return ", ".join(f"round({m[r][c]}, 6) + 0.0 AS {name}{3 * r + c}" for r in range(3) for c in range(3))


_U = [["1.0::DOUBLE", "x", "y"], ["-x", "1.0::DOUBLE", "z"], ["x / 100", "y / 100", "1.0::DOUBLE"]]
_V = [["2.0::DOUBLE", "4.0::DOUBLE", "x"], ["CASE WHEN flat THEN 1.0 ELSE x END", "2.0::DOUBLE", "y"], ["0.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE"]]
_SIM = [["(1 + x)", "-y", "z"], ["y", "(1 + x)", "x"], ["0.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE"]]
_PART = "m AS (SELECT p_partkey, p_size / 50.0 AS x, (p_partkey % 17) / 17.0 AS y, (p_partkey % 5)::DOUBLE AS z, p_size % 7 = 0 AS flat FROM part)"
_RESIDUAL = [[f"s{3 * r + c}" for c in range(3)] for r in range(3)]


@query(f"""
WITH {_PART}, r AS (SELECT *, {_nine(matrices.product_sql(matrices.inverse_sql(_SIM), _U), "s").replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")} FROM m)
SELECT p_partkey, {_nine(matrices.product_sql(_U, _V), "p")}, {_nine(matrices.inverse_sql(_V), "i")}, {_nine([[f"({e}) / (1.0 + 0 * x)" for e in row] for row in _U], "u")}, {_nine([["1.0::DOUBLE", "x", "y * 4"], ["-x", "1.0::DOUBLE", "z * 4"], ["x / 400", "y / 400", "1.0::DOUBLE"]], "k")},
{_nine([[f"s{3 * r + c} / s8" for c in range(3)] for r in range(3)], "r")} FROM r
""")
def matrix_rules(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), ((F.col("p_partkey") % 17) / 17.0).alias("y"), (F.col("p_partkey") % 5).cast("double").alias("z"), (F.col("p_size") % 7 == 0).alias("flat"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    p = p.withColumn("u", maths.matrix([[1, x, y], [-x, 1, z], [x / 100, y / 100, 1]])).withColumn("v", maths.matrix([[2, 4, x], [F.when(F.col("flat"), 1.0).otherwise(x), 2, y], [0, 0, 1]]))
    u, v = F.col("u"), F.col("v")
    made = {"p": maths.matrix_product(u, v), "i": maths.matrix_inverse(v), "u": maths.matrix_unit(F.transform(u, lambda e: e * 3)), "k": maths.matrix_rescaled(u, 4.0), "r": maths.perspective_residual(1 + x, y, z, x, u)}
    p = p.select("p_partkey", *[m.alias(f"_{n}") for n, m in made.items()])
    names = [f"{n}{k}" for n in made for k in range(9)]
    return rounded(p.select("p_partkey", *[F.col(f"_{n}")[k].alias(f"{n}{k}") for n in made for k in range(9)]), *names)


_THETA = {"rectilinear": "atan(r / 480)", "equidistant": "r / 480", "equisolid": "2 * asin(least(r / 960, 1))", "stereographic": "2 * atan(r / 960)"}
_RAYS = " UNION ALL ".join(f"SELECT p_partkey, '{kind}' AS kind, px, py, r, {theta} AS theta FROM p" for kind, theta in _THETA.items())


@query(f"""
WITH p AS (SELECT p_partkey, (p_size * 19) % 960 AS px, p_partkey % 540 AS py, sqrt(((p_size * 19) % 960 - 480.0) ** 2 + (p_partkey % 540 - 270.0) ** 2) AS r FROM part), t AS ({_RAYS}), f AS (SELECT 480.0 AS r), g AS (SELECT kind, theta FROM ({" UNION ALL ".join(f"SELECT '{k}' AS kind, {t} AS theta FROM f" for k, t in _THETA.items())}))
SELECT p_partkey, kind, CASE WHEN r < 1e-9 THEN 0 ELSE round((px - 480) * sin(t.theta) / r, 6) + 0.0 END AS x, CASE WHEN r < 1e-9 THEN 0 ELSE round((py - 270) * sin(t.theta) / r, 6) + 0.0 END AS y, round(cos(t.theta), 6) + 0.0 AS z, px::DOUBLE AS back_x, py::DOUBLE AS back_y, round(degrees(2 * g.theta), 6) AS view FROM t JOIN g USING (kind)
""")
def lens_rays(spark, d):
    """Rays of pixels under each kind of lens, and the pixels that they go back to."""
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_size") * 19) % 960).cast("double").alias("px"), (F.col("p_partkey") % 540).cast("double").alias("py"))

    def of(kind: str):
        x, y, z = maths.ray(F.col("px"), F.col("py"), kind, 480.0, 480.0, 270.0)
        rays = p.select("p_partkey", L(kind).alias("kind"), x.alias("x"), y.alias("y"), z.alias("z"))
        bx, by = maths.project_ray(F.col("x"), F.col("y"), F.col("z"), kind, 480.0, 480.0, 270.0)
        return rays.withColumn("back_x", bx).withColumn("back_y", by).withColumn("view", maths.field_of_view(kind, 480.0, 960.0))

    return rounded(reduce(lambda a, b: a.unionByName(b), [of(k) for k in _THETA]), "x", "y", "z", "back_x", "back_y", "view")


_Q = "q AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS a, l_discount * 8 AS b, l_returnflag <> 'A' AS ok FROM lineitem), h AS (SELECT *, cos(a) AS pw, sin(a) * 0.6 AS px, sin(a) * 0.8 AS py, -cos(b) AS qw, sin(b) AS qy FROM q)"


@query(f"""
WITH {_Q}, v AS (SELECT *, pw * qw - py * qy AS w, px * qw AS x, pw * qy + py * qw AS y, px * qy AS z FROM h), s AS (SELECT *, sqrt(x * x + y * y + z * z) AS n, CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg FROM v),
k AS (SELECT *, CASE WHEN n < 1e-12 THEN 0 ELSE 2 * atan2(n, w * sg) / n END * sg AS f FROM s)
SELECT l_orderkey, l_linenumber, round(w, 6) + 0.0 AS w, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(x * f, 6) + 0.0 AS rx, round(y * f, 6) + 0.0 AS ry, round(z * f, 6) + 0.0 AS rz, CASE WHEN ok THEN round(-y * f * 30 * 180 / pi(), 4) + 0.0 ELSE 0 END AS rate FROM k
""")
def quaternion_rules(spark, d):
    a, b = F.col("l_tax") * 10, F.col("l_discount") * 8
    zero = L(0.0)
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") != "A").alias("ok"), F.struct(F.cos(a).alias("w"), (F.sin(a) * 0.6).alias("x"), (F.sin(a) * 0.8).alias("y"), zero.alias("z")).alias("p"),
        F.struct((-F.cos(b)).alias("w"), zero.alias("x"), F.sin(b).alias("y"), zero.alias("z")).alias("q"),
    )
    rows = rows.select("l_orderkey", "l_linenumber", "ok", maths.quaternion_product(F.col("p"), F.col("q")).alias("m"))
    rows = rows.withColumn("v", maths.quaternion_log(F.col("m"))).withColumn("rate", maths.heading_rate(F.col("m"), 30.0, F.col("ok")))
    out = rows.select("l_orderkey", "l_linenumber", "m.*", *[F.col(f"v.{c}").alias(f"r{c}") for c in "xyz"], "rate")
    return rounded(rounded(out, "w", "x", "y", "z", "rx", "ry", "rz"), "rate", digits=4)


_SIMILAR = """s AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 - 2 AS dx, l_discount * 50 AS dy, l_tax - 0.04 AS rot, 1 + l_discount / 4 AS sc, 1.05 AS zoom FROM lineitem),
t AS (SELECT *, sc * zoom * cos(rot) AS a, sc * zoom * sin(rot) AS b FROM s), u AS (SELECT *, 480 - a * 480 + b * 270 + dx AS tx, 270 - b * 480 - a * 270 + dy AS ty, a * a + b * b AS det FROM t), v AS (SELECT *, a / det AS ia, -b / det AS ib FROM u), w AS (SELECT *, -(ia * tx - ib * ty) AS itx, -(ib * tx + ia * ty) AS ity FROM v)"""
_CORNERS = " AND ".join(f"ia * {x} - ib * {y} + itx BETWEEN -1e-6 AND 960.000001 AND ib * {x} + ia * {y} + ity BETWEEN -1e-6 AND 540.000001" for x in (0, 960) for y in (0, 540))


@query(f"""
WITH {_SIMILAR} SELECT l_orderkey, l_linenumber, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(tx, 5) + 0.0 AS tx, round(ty, 5) + 0.0 AS ty, round(ia, 6) + 0.0 AS ia, round(ib, 6) + 0.0 AS ib, round(itx, 5) + 0.0 AS itx, round(ity, 5) + 0.0 AS ity,
round(a * 100 - b * 50 + tx, 5) + 0.0 AS mx, round(b * 100 + a * 50 + ty, 5) + 0.0 AS my, round(a * (1 + dx / 100), 6) + 0.0 AS c0, round(a * dx - b * dy + tx, 4) + 0.0 AS c2, {_CORNERS} AS fits FROM w
""")
def similarity_maps(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 - 2).alias("dx"), (F.col("l_discount") * 50).alias("dy"), (F.col("l_tax") - 0.04).alias("rot"), (1 + F.col("l_discount") / 4).alias("sc"))
    dx, dy, rot, sc, zoom = F.col("dx"), F.col("dy"), F.col("rot"), F.col("sc"), L(1.05)
    made = dict(zip(("a", "b", "tx", "ty"), maths.similarity(dx, dy, rot, sc, 960, 540, zoom), strict=True))
    rows = rows.withColumns(made | {"fits": maths.fits(dx, dy, rot, sc, zoom, 960, 540)})
    m = tuple(F.col(c) for c in made)
    rows = rows.withColumns(dict(zip(("ia", "ib", "itx", "ity"), maths.invert_similarity(m), strict=True)))
    mx, my = maths.apply_similarity(m, L(100.0), L(50.0))
    both = maths.compose_affine((F.col("a"), -F.col("b"), F.col("tx"), F.col("b"), F.col("a"), F.col("ty")), (1 + dx / 100, L(0.0), dx, L(0.0), L(1.0), dy))
    out = rows.select("l_orderkey", "l_linenumber", *made, "ia", "ib", "itx", "ity", mx.alias("mx"), my.alias("my"), both[0].alias("c0"), both[2].alias("c2"), "fits")
    return rounded(rounded(rounded(out, "a", "b", "ia", "ib", "c0"), "tx", "ty", "itx", "ity", "mx", "my", digits=5), "c2", digits=4)


# --- decisions ------------------------------------------------------------------------------

@query("""
WITH l AS (SELECT *, l_returnflag = 'A' AS fa, l_returnflag = 'R' AS fr, l_linestatus = 'O' AS fo, CASE l_suppkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'vertical' WHEN 2 THEN 'default' WHEN 3 THEN 'default-no-power' WHEN 4 THEN 'time' ELSE 'surprise' END AS mode,
CASE l_suppkey % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.m4v' ELSE '.mov' END AS ext, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 40 END AS forced FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN mode IN ('vertical', 'default', 'default-no-power', 'time') THEN mode WHEN fa THEN 'vertical' WHEN fo THEN 'default' ELSE 'default-no-power' END AS layout, coalesce(CASE WHEN forced BETWEEN 0 AND 1 THEN forced END, CASE WHEN fr THEN 0.3 END, 0) AS readout,
CASE l_linenumber % 3 WHEN 0 THEN 4.0 WHEN 1 THEN l_quantity * 10 - 4 ELSE l_quantity * 5 END AS ax, CASE l_suppkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 46 ELSE 25 END AS ay, fo AND ext <> '.mkv' AS subtitle, l_discount * 100 - 3 <= 0 OR fr OR ext <> '.mkv' AS starts,
CASE WHEN l_tax - 0.02 <= 0 THEN 'error' WHEN l_quantity / 20 < 0.5 OR l_quantity / 20 > 2 THEN 'warning' ELSE 'ok' END AS yaw, NOT fa AND mode IN ('auto', 'time', 'surprise') AS falls, CASE WHEN fa THEN 'rotation' WHEN fr THEN 'homography' WHEN fo THEN 'mesh' ELSE 'similarity' END AS path,
CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber < 2 THEN 'start' WHEN l_quantity - (l_linenumber + 6) < 2 THEN 'end' ELSE '' END AS edge, round(greatest(l_discount * 20 - 1, 0), 6) AS calibrated, CASE WHEN l_discount * 20 - 1 >= 0.5 THEN 'outside' ELSE 'ok' END AS calibration,
round((l_orderkey * 1000000 - l_suppkey * 500000 - 250000) / 1000000.0, 6) AS clip_second, (fa AND NOT fr) OR l_linenumber % 4 = 0 OR l_quantity > 25 AS bounds, round(CASE WHEN l_quantity - 5 <= 0 THEN 0 ELSE (l_quantity - 5) / (4 * sqrt(pi())) * l_discount / 9 END, 6) AS energy,
round(CASE WHEN l_quantity - 5 <= 0 THEN 0 ELSE l_tax / ((l_quantity - 5) / 60) END, 6) AS turn, CASE WHEN mode = 'auto' THEN 'auto' ELSE 'auto,' || mode END AS kept FROM l
""")
def plan_choices(spark, d):
    c, q, n = F.col, F.col("l_quantity"), F.col("l_linenumber")
    fa, fr, fo, s = c("l_returnflag") == "A", c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_suppkey")
    mode = F.when(s % 6 == 0, "auto").when(s % 6 == 1, "vertical").when(s % 6 == 2, "default").when(s % 6 == 3, "default-no-power").when(s % 6 == 4, "time").otherwise("surprise")
    ext = F.when(s % 4 == 0, ".mp4").when(s % 4 == 1, ".mkv").when(s % 4 == 2, ".m4v").otherwise(".mov")
    anchor = F.concat(F.when(s % 3 == 0, "top").when(s % 3 == 1, "bottom").otherwise("middle"), F.when(n % 3 == 0, "-left").when(n % 3 == 1, "-right").otherwise(""))
    spot = effects.anchored(anchor, q * 10, L(50), L(4))
    start = batch.calibration_start(c("l_discount") * 20 - 1, L(0.5))
    kept = F.array_join(effects.without(F.array(L("auto"), F.when(mode == "auto", "gone").otherwise(mode)), "gone"), ",")
    out = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", effects.layout(mode, fa, fo).alias("layout"), effects.readout(F.when(n % 3 != 0, q / 40), L(0.3), fr).alias("readout"), spot["x"].cast("double").alias("ax"), spot["y"].cast("double").alias("ay"),
        effects.embeds_subtitle(ext, fo).alias("subtitle"), effects.start_survives(c("l_discount") * 100 - 3, fr, ext).alias("starts"), effects.yaw_check(c("l_tax") - 0.02, q, L(20.0)).alias("yaw"), effects.falls_back(mode, fa).alias("falls"),
        trajectory.render_path(fa, fr, fo).alias("path"), alignment.edge_warning(F.when(n == 1, 0).otherwise(n), F.when(n == 1, 0).otherwise(n + 6), q).alias("edge"), start["start"].alias("calibrated"), start["status"].alias("calibration"),
        batch.instant_seconds(c("l_orderkey") * 1000000, s * 500000, L(250000)).alias("clip_second"), batch.valid_bounds(F.when(fa, "relative").otherwise("absolute"), L("absolute"), F.when(n % 4 != 0, L(25.0)), q).alias("bounds"),
        alignment.energy(q - 5, c("l_discount")).alias("energy"), alignment.turn_per_minute(c("l_tax"), q - 5).alias("turn"), kept.alias("kept"),
    )
    return rounded(out, "calibrated", "clip_second", "energy", "turn")


_TAGS = """t AS (SELECT 'f' || c_nationkey AS file, c_custkey % 3 - 1 AS stream, CASE c_custkey % 5 WHEN 0 THEN 'creation_time' WHEN 1 THEN 'handler_name' WHEN 2 THEN 'language' WHEN 3 THEN 'vendor_id' ELSE 'k' || c_custkey % 7 END AS key,
CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS value, CASE c_custkey % 3 WHEN 1 THEN 'video' WHEN 2 THEN 'audio' END AS kind FROM customer)"""


@query(f"""
WITH {_TAGS} SELECT file, stream, key, CASE key WHEN 'language' THEN 'und' WHEN 'handler_name' THEN CASE kind WHEN 'video' THEN 'VideoHandler' ELSE 'SoundHandler' END ELSE value END AS value, count(*) AS n FROM t
WHERE key IN ('language', 'vendor_id') OR (key = 'handler_name' AND kind IS NOT NULL) OR (value = '' AND key <> 'handler_name') GROUP BY ALL
""")
def stripped_tags(spark, d):
    k = F.col("c_custkey")
    key = F.when(k % 5 == 0, "creation_time").when(k % 5 == 1, "handler_name").when(k % 5 == 2, "language").when(k % 5 == 3, "vendor_id").otherwise(F.concat(L("k"), (k % 7).cast("string")))
    tags = table(spark, d, "customer").select(
        F.concat(L("f"), F.col("c_nationkey").cast("string")).alias("file"), (k % 3 - 1).alias("stream"), key.alias("key"), F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("value"), F.when(k % 3 == 1, "video").when(k % 3 == 2, "audio").alias("kind")
    )
    return steps.StripMetadata().apply(tags).groupBy("file", "stream", "key", "value").agg(F.count("*").alias("n"))


# --- facts of files -----------------------------------------------------------------------------

@query("""
WITH o AS (SELECT *, o_orderkey % 11 <> 0 AS video FROM orders)
SELECT o_orderkey, CASE WHEN video THEN 640 * (1 + o_custkey % 4) ELSE -1 END::INT AS width, CASE WHEN video THEN round(CASE o_orderkey % 3 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25 ELSE 60 END, 6) END AS fps, CASE WHEN video THEN CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 1000 END ELSE -1 END AS frames,
CASE WHEN video THEN CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 300) * 0.5 END END::DOUBLE AS duration, CASE WHEN video THEN (360 - 90 * (o_custkey % 4)) % 360 ELSE -1 END::INT AS rotation, video AND o_orderkey % 2 = 0 AS has_audio,
CASE WHEN video THEN epoch_us(date_trunc('second', o_orderdate)) ELSE -1 END AS created, video AND o_custkey % 2 = 0 AS naive FROM o
""")
def probe_facts(spark, d):
    """What probe JSON says of a clip for every order; every eleventh has no video."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x: x.cast("string")
    rate = F.when(k % 3 == 0, "30000/1001").when(k % 3 == 1, "0/0").otherwise("60/1")
    made = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c % 2 == 0, "").otherwise("Z"))
    video = F.concat(
        L('{"codec_type":"video","width":'), n(640 * (1 + c % 4)), L(',"height":1080,"nb_frames":"'), F.when(k % 5 == 0, "N/A").otherwise(n(k % 1000)), L('","avg_frame_rate":"'), rate, L('","r_frame_rate":"25/1","side_data_list":[{"rotation":'), n(c % 4 * -90), L("}]}"),
    )
    streams = F.concat_ws(",", F.when(k % 2 == 0, '{"codec_type":"audio"}'), F.when(k % 11 != 0, video))
    js = F.concat(L('{"streams":['), streams, L('],"format":{"format_name":"mov,mp4","duration":"'), F.when(k % 7 == 0, "N/A").otherwise(n((k % 300) * 0.5)), L('","tags":{"creation_time":"'), made, L('"}}}'))
    got = probe.parse(table(spark, d, "orders").select("o_orderkey", js.alias("json")))
    known = lambda c, none: F.coalesce(c, L(none))
    numbers = [known(F.col(f"info.{x}"), -1).alias(x) for x in ("width", "frames", "rotation")] + [known(F.unix_micros("info.created"), -1).alias("created")]
    return rounded(got.select("o_orderkey", *numbers, "info.fps", "info.duration", *[known(F.col(f"info.{x}"), False).alias(x) for x in ("has_audio", "naive")]), "fps")


@query("""
WITH p AS (SELECT '/in/' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.txt' WHEN 2 THEN '.mov' ELSE '' END AS path, p_size % 3 = 0 AS dir, p_size % 5 = 0 AS empty_, p_size % 4 IN (1, 3) AS odd FROM part)
SELECT path, concat_ws('; ', CASE WHEN dir THEN 'is a directory' END, CASE WHEN empty_ THEN 'is empty' END, CASE WHEN odd THEN 'has an unknown extension' END) AS problems FROM p WHERE dir OR empty_ OR odd
""")
def listing_problems(spark, d):
    size = F.col("p_size")
    path = F.concat(L("/in/"), F.col("p_partkey").cast("string"), F.when(size % 4 == 0, ".MP4").when(size % 4 == 1, ".txt").when(size % 4 == 2, ".mov").otherwise(""))
    listing = table(spark, d, "part").select(path.alias("path"), F.when(size % 5 == 0, 0).otherwise(size).alias("length"), (size % 3 == 0).alias("is_dir"))
    return probe.problems(listing).select("path", F.array_join("problems", "; ").alias("problems"))


@query("SELECT o_orderkey AS frame FROM orders WHERE o_custkey % 3 <> 0")
def progress_frames(spark, d):
    """Frame numbers in a tool's progress output, which has other lines too."""
    lines = table(spark, d, "orders").select(F.concat(F.when(F.col("o_custkey") % 3 == 0, "fps=").otherwise("frame= "), F.col("o_orderkey").cast("string")).alias("value"))
    return probe.progress(lines)
