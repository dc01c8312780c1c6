"""Queries over the driver's tables whose rows stand for images, channels, tiles and records; each calls its operator and has its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import images, legacy, linked, metadata, mosaic, tree, widefield
from lumaframe.plans.tables import node_rows, read
from lumaframe.sinks import preview
from lumaframe.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def joined(column, separator: str = ","):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), separator)


@query("""
WITH w AS (SELECT p_partkey, p_name, length(p_name) + p_size + p_partkey * 1000 + list_sum(list_transform(string_split(p_name, ''), lambda c: unicode(c))) AS n FROM part),
h AS (SELECT p_partkey, lpad(lower(printf('%x', CAST(n AS BIGINT))), 32, '0') AS h FROM w)
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM h""")
def file_identity(spark, sf_dir):
    """The id of a file that has none: from its path and the sizes of what it holds."""
    return read(spark, sf_dir, "part").select("p_partkey", scalar.file_uuid(F.col("p_name"), F.col("p_size"), F.col("p_partkey") * 1000).alias("id"))


@query("""
WITH f AS (SELECT event_id, CAST(epoch_us(ts) * 10 + 116444736000000000 AS BIGINT) AS ft FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (ft - 116444736000000000) // 10 END AS micros FROM f""")
def hex_time(spark, sf_dir):
    """Time stamps as hexadecimal words, some of them broken."""
    ft = scalar.filetime(F.unix_micros(F.col("ts").cast("timestamp")))
    word = F.when(F.col("event_id") % 5 == 0, "zz").when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 0x"), F.lower(F.hex(ft)))).otherwise(F.hex(ft))
    return read(spark, sf_dir, "events").select("event_id", scalar.filetime_micros(scalar.hex_number(word)).alias("micros"))


@query("""
WITH p AS (SELECT p_partkey, p_size - 5.0 AS native, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size - 5.0 ELSE p_size * 2.0 END AS converted, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 1000.0 END AS factor FROM part)
SELECT p_partkey, CAST(CASE WHEN native <= 0 THEN 0.0 WHEN converted IS NULL OR converted <= 0 OR (factor <> 1.0 AND converted = native) THEN native * factor ELSE converted END AS DOUBLE) AS micrometres,
  CAST(CASE WHEN converted > 0 THEN converted WHEN native > 0 THEN native * 1e6 ELSE 7.5 END AS DOUBLE) AS scale FROM p""")
def spacing_rules(spark, sf_dir):
    """Spacings that come native, converted, or both."""
    size = F.col("p_size").cast("double")
    native, factor = size - 5, F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(1000.0)
    converted = F.when(F.col("p_size") % 3 == 1, size - 5).when(F.col("p_size") % 3 == 2, size * 2)
    return read(spark, sf_dir, "part").select("p_partkey", scalar.reconciled(native, converted, factor).alias("micrometres"), scalar.axis_scale(converted, native, F.lit(7.5)).alias("scale"))


@query("""
WITH o AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_quantity) AS res FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey, list_transform(range(4), lambda i: CASE WHEN res[i + 1] IS NULL THEN 16 WHEN res[i + 1] IN (8, 12, 14, 15, 16, 32) THEN res[i + 1] WHEN res[i + 1] <= 8 AND res[i + 1] <> 0 THEN 8 ELSE 16 END) AS bits FROM o)
SELECT l_orderkey, array_to_string(bits, ',') AS bits FROM b""")
def channel_bits(spark, sf_dir):
    """The quantities of an order as the bit depths of four channels."""
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"].cast("int")).alias("res"))
    return lists.select("l_orderkey", joined(scalar.bit_depths(F.col("res"), F.lit(4), F.lit(False))).alias("bits"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 + 1 AS n, c_custkey % 7 = 0 AS rgb, CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment, ''] ELSE ['', ''] END AS names, CASE WHEN c_custkey % 5 = 0 THEN ['', 'L5', 'A'] END AS blocks, CASE WHEN c_custkey % 2 = 0 THEN ['Red', 'green', 'nonsense'] END AS luts FROM customer),
s AS (SELECT *, CASE WHEN len(list_filter(names, lambda v: v <> '')) > 0 THEN names WHEN len(list_filter(blocks, lambda v: v <> '')) > 0 THEN blocks END AS said FROM c)
SELECT c_custkey, CASE WHEN rgb THEN 'Red,Green,Blue' ELSE array_to_string(list_transform(range(n), lambda i: coalesce(nullif(said[i + 1], ''), 'Channel ' || (i + 1))), ',') END AS labels,
  CASE WHEN rgb THEN 'ff0000,00ff00,0000ff' WHEN luts IS NULL THEN array_to_string(['ffffff', '00ff00', 'ff00ff', '00ffff'][1:n], ',') ELSE array_to_string(['ff0000', '008000', 'ffffff', 'ffffff'][1:n], ',') END AS colours FROM s""")
def channel_looks(spark, sf_dir):
    """Customers as images: the labels and colours of their channels."""
    k = F.col("c_custkey")
    words = lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    names = F.when(k % 3 == 0, words(F.col("c_mktsegment"), "")).otherwise(words("", ""))
    blocks, luts = F.when(k % 5 == 0, words("", "L5", "A")), F.when(k % 2 == 0, words("Red", "green", "nonsense"))
    n, rgb = (k % 4 + 1).cast("int"), k % 7 == 0
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(scalar.channel_labels(names, blocks, n, rgb), ",").alias("labels"), F.array_join(scalar.channel_colours(luts, n, rgb), ",").alias("colours"))


@query("""
WITH f AS (SELECT l_orderkey, CAST(max(l_suppkey % 5) + 1 AS INTEGER) AS nx, CAST(max(l_linenumber) AS INTEGER) AS ny FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, nx, ny, CAST(CASE WHEN nx <= 1 THEN 100 ELSE floor((nx - 1) * (100 * CAST(0.9 AS DOUBLE)) + 100) END AS INTEGER) AS width, CAST(CASE WHEN ny <= 1 THEN 50 ELSE floor((ny - 1) * (50 * CAST(1.25 AS DOUBLE)) + 50) END AS INTEGER) AS height, nx * 100 AS margin_width FROM f""")
def canvas_size(spark, sf_dir):
    """The lines of an order as tiles: the grid, and the canvas with an overlap, with gaps, and with tiles side by side."""
    tiles = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_suppkey") % 5).cast("int").alias("FieldX"), (F.col("l_linenumber") - 1).cast("int").alias("FieldY"))).alias("tile_positions"))
    nx, ny = mosaic.grid_size("FieldX"), mosaic.grid_size("FieldY")
    return tiles.select("l_orderkey", nx.alias("nx"), ny.alias("ny"), mosaic.canvas_side(nx, F.lit(100), F.lit(0.1)).alias("width"), mosaic.canvas_side(ny, F.lit(50), F.lit(-0.25)).alias("height"), mosaic.canvas_side(nx, F.lit(100), F.lit(0.1), True).alias("margin_width"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 13 AS want, p_size * p_size AS extent FROM part)
SELECT p_partkey, CAST(least(greatest(16, want), greatest(16, ceil(greatest(1, extent) / 16.0) * 16)) AS BIGINT) AS side FROM p""")
def tile_sides(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", scalar.tile_side(size * 13, size * size).alias("side"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey * 7 % 9000 + 0.5 AS t FROM orders), m AS (SELECT *, CAST(floor(t / 3600) AS BIGINT) AS h, CAST(floor(t / 60) AS BIGINT) % 60 AS mi, t - floor(t / 60) * 60 AS s FROM s)
SELECT o_orderkey, CASE WHEN t < 60 THEN printf('%.1fs', CAST(t AS DOUBLE)) WHEN t < 3600 THEN mi || 'm ' || printf('%.1fs', CAST(s AS DOUBLE)) ELSE h || 'h ' || mi || 'm ' || CAST(round_even(s, 0) AS BIGINT) || 's' END AS elapsed FROM m""")
def elapsed_times(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.elapsed_text((F.col("o_orderkey") * 7 % 9000).cast("double") + 0.5).alias("elapsed"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def pretty_times(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    end = F.element_at(F.array(*map(F.lit, ("Z", "", ".25+00:00", "-05:00"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", scalar.pretty_time(F.concat(stamp, end)).alias("shown"))


@query("""
WITH p AS (SELECT p_partkey, ['FLUO', 'bf', 'DIC', 'Ph', 'TL-BF', '', 'odd'][p_size % 7 + 1] AS method, ['confocal', 'camera', 'other'][p_partkey % 3 + 1] AS kind, ['HyD 2', 'PMT Trans', 'sCMOS', 'EMCCD', 'APD1', 'eye'][p_size % 6 + 1] AS det FROM part),
c AS (SELECT *, ['Fluorescence', 'Brightfield', 'DIC', 'Phase', 'Brightfield', 'Other', 'odd'][list_position(['FLUO', 'bf', 'DIC', 'Ph', 'TL-BF', '', 'odd'], method)] AS contrast FROM p)
SELECT p_partkey, contrast, CASE WHEN kind = 'confocal' OR (kind = 'camera' AND contrast = 'Fluorescence') THEN 'Epifluorescence' WHEN kind = 'camera' AND contrast IN ('Brightfield', 'DIC', 'Phase') THEN 'Transmitted' ELSE 'Other' END AS illumination,
  CASE kind WHEN 'confocal' THEN 'LaserScanningConfocalMicroscopy' WHEN 'camera' THEN 'WideField' ELSE 'Other' END AS mode, CASE det WHEN 'HyD 2' THEN 'Other' WHEN 'PMT Trans' THEN 'PMT' WHEN 'sCMOS' THEN 'CMOS' WHEN 'EMCCD' THEN 'CCD' WHEN 'APD1' THEN 'APD' END AS detector FROM c""")
def optics_classes(spark, sf_dir):
    """Contrast, illumination, acquisition mode and detector type of what parts stand for."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    df = read(spark, sf_dir, "part").select(
        "p_partkey", pick(("FLUO", "bf", "DIC", "Ph", "TL-BF", "", "odd"), F.col("p_size")).alias("method"), pick(("confocal", "camera", "other"), F.col("p_partkey")).alias("kind"), pick(("HyD 2", "PMT Trans", "sCMOS", "EMCCD", "APD1", "eye"), F.col("p_size")).alias("det")
    )
    contrast = scalar.contrast_name(F.col("method"))
    return df.select("p_partkey", contrast.alias("contrast"), scalar.illumination(F.col("kind"), contrast).alias("illumination"), scalar.acquisition(F.col("kind")).alias("mode"), scalar.detector_type(F.col("det")).alias("detector"))


@query("""
SELECT s_suppkey, coalesce(['TCS SP5', 'AF6000', 'DMi8'][s_suppkey % 4 + 1] IN ('TCS SP5'), false) OR s_suppkey % 5 = 0 OR s_nationkey = 3 AS old FROM supplier""")
def legacy_scanners(spark, sf_dir):
    system = F.get(F.array(F.lit("TCS SP5"), F.lit("AF6000"), F.lit("DMi8")), (F.col("s_suppkey") % 4).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalar.legacy_confocal(system, F.when(F.col("s_suppkey") % 5 == 0, "xyz"), F.when(F.col("s_nationkey") == 3, 1.0)).alias("old"))


@query("""
WITH w AS (SELECT p_partkey, p_size % 5 = 0 AS rgb, p_size % 7 = 0 AS gaps, CASE WHEN p_size % 6 <> 0 THEN p_size END AS xs, p_size - 3 AS ys, p_size % 4 AS tiles, p_size % 3 = 0 AS placed FROM part)
SELECT p_partkey, CASE WHEN rgb THEN 'colour' WHEN gaps THEN 'gaps between tiles' WHEN xs IS NULL AND tiles > 1 AND NOT placed THEN 'missing xs, tile_positions' WHEN xs IS NULL THEN 'missing xs' WHEN tiles > 1 AND NOT placed THEN 'missing tile_positions' WHEN ys <= 0 THEN 'no extent' END AS reason FROM w""")
def writer_guards(spark, sf_dir):
    """Parts as images: why a writer can't take them."""
    size = F.col("p_size")
    wide = read(spark, sf_dir, "part").select(
        "p_partkey", (size % 5 == 0).alias("isrgb"), (size % 7 == 0).alias("OverlapIsNegative"), F.when(size % 6 != 0, size).alias("xs"), (size - 3).alias("ys"), F.lit(1).alias("zs"), F.lit(1).alias("ts"), F.lit(1).alias("channels"), F.lit(0).alias("Position"),
        (size % 4).alias("tiles"), F.when(size % 3 == 0, F.array(F.struct(F.lit(1).alias("num")))).alias("tile_positions"),
    )
    return metadata.reject_reason(wide, False).select("p_partkey", F.col("reject_reason").alias("reason"))


@query("""
WITH n AS (SELECT n_nationkey, n_nationkey % 3 + 1 AS channels, n_nationkey % 2 = 0 AS deep FROM nation), s AS (SELECT c_nationkey AS k, CAST(c_custkey % 4 AS INTEGER) AS c, CAST(min(c_custkey) AS INTEGER) AS lo, CAST(max(c_custkey) AS INTEGER) AS hi FROM customer WHERE c_custkey % 4 < 3 GROUP BY ALL),
x AS (SELECT n_nationkey, unnest(range(channels)) AS c, deep FROM n)
SELECT n_nationkey, string_agg(coalesce(lo, 0), ',' ORDER BY x.c) AS mins, string_agg(coalesce(hi, CASE WHEN deep THEN 65535 ELSE 255 END), ',' ORDER BY x.c) AS maxs FROM x LEFT JOIN s ON k = n_nationkey AND s.c = x.c GROUP BY n_nationkey""")
def intensity_fallback(spark, sf_dir):
    """Nations as images whose channels were measured or not."""
    wide = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("uuid"), (F.col("n_nationkey") % 3 + 1).cast("int").alias("channels"), F.lit(False).alias("isrgb"), F.array(F.when(F.col("n_nationkey") % 2 == 0, 12).otherwise(8)).alias("channelResolution"))
    stats = read(spark, sf_dir, "customer").where("c_custkey % 4 < 3").groupBy(F.col("c_nationkey").cast("string").alias("uuid"), (F.col("c_custkey") % 4).cast("int").alias("c")).agg(F.min("c_custkey").cast("int").alias("vmin"), F.max("c_custkey").cast("int").alias("vmax"))
    return metadata.intensities(wide, stats).select("n_nationkey", joined("channel_mins").alias("mins"), joined("channel_maxs").alias("maxs"))


@query("""
WITH w AS (SELECT o_orderkey, unnest(range(3)) AS c, [o_orderkey % 10 / 10.0, o_orderkey % 4000] AS black FROM orders), v AS (SELECT o_orderkey, c, CAST(black[least(c + 1, 2)] AS DOUBLE) AS v, [8, 12, 12][c + 1] AS bits FROM w)
SELECT o_orderkey, string_agg(CAST(least(greatest(CASE WHEN v > 1 THEN round_even(v, 0) ELSE round_even(v * (power(2, bits) - 1), 0) END, 0), power(2, bits) - 1) AS BIGINT), ',' ORDER BY c) AS black FROM v GROUP BY o_orderkey""")
def display_lists(spark, sf_dir):
    """Black values of three channels; both lists go on with their last value."""
    values = F.array((F.col("o_orderkey") % 10).cast("double") / 10, (F.col("o_orderkey") % 4000).cast("double"))
    return read(spark, sf_dir, "orders").select("o_orderkey", joined(scalar.display_levels(values, F.array(F.lit(8), F.lit(12)), F.lit(3))).alias("black"))


@query("""
SELECT 'n' || n_nationkey AS id, r_name || CASE WHEN n_regionkey = 1 THEN '' ELSE '_' || n_name END AS name, r_regionkey AS top, n_nationkey AS place FROM nation JOIN region ON r_regionkey = n_regionkey""")
def walk_order(spark, sf_dir):
    """Regions and nations as folders: names from the root on without repeats, and each one's place among its siblings."""
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("ordinal"))
    own = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    nation = own.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_regionkey") == 1, F.col("r_name")).otherwise(F.col("n_name")), F.col("n_nationkey"))
    found = tree.paths(region.union(nation)).where("depth = 1")
    return found.select("id", F.array_join(linked.without_repeats(F.col("names")), "_").alias("name"), F.get("order", F.lit(0)).cast("int").alias("top"), F.get("order", F.lit(1)).cast("int").alias("place"))


@query("""
WITH s AS (SELECT 's' || s_suppkey AS id, r_name || '/' || n_name || '/' || s_name AS path, r_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_name = (SELECT min(s_name) FROM supplier))
SELECT id, path FROM s""")
def find_node(spark, sf_dir):
    """The first node of a name in a walk through regions, nations and suppliers."""
    from lumaframe.plans.tables import places

    first = read(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0]
    return tree.find(places(spark, sf_dir, "supplier"), "name", first).select("id", "path")


@query("""
WITH l AS (SELECT conv_id * 1000 + turn AS n, CASE turn % 4 WHEN 0 THEN 'Converting: ' || turn || '% done' WHEN 1 THEN '[{"name": "a"}]' WHEN 2 THEN 'Error: ' || role ELSE 'hello' END AS payload, turn % 4 AS k FROM conversations)
SELECT n, ['progress', 'result', 'error', 'log'][k + 1] AS type, payload FROM l UNION ALL SELECT max(n) + 1, 'end', '' FROM l""")
def job_events(spark, sf_dir):
    """Output lines of a job as typed events, with the end after the last."""
    turn = F.col("turn") % 4
    line = F.when(turn == 0, F.concat(F.lit("Converting: "), F.col("turn").cast("string"), F.lit("% done"))).when(turn == 1, F.lit('[{"name": "a"}]')).when(turn == 2, F.concat(F.lit("Error: "), "role")).otherwise("hello")
    return ingest.events(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), line.alias("value"))).select("n", "type", "payload")


@query("""
SELECT event_id, user_id, event_id // 100 AS job_id FROM events WHERE event_id // 100 = (SELECT max(e.event_id // 100) FROM events e WHERE e.user_id = events.user_id)""")
def latest_requests(spark, sf_dir):
    """Requests of each user's newest job; older ones are not drawn."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("uuid"), F.floor(F.col("event_id") / 100).alias("job_id"))
    return preview.latest_jobs(rows).select("event_id", F.col("uuid").alias("user_id"), "job_id")


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS written, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey)
SELECT *, round(100 * written / total, 1) AS percent FROM t""")
def chunk_counters(spark, sf_dir):
    """Lines as chunks, those of one status written: how far each order is."""
    rows = read(spark, sf_dir, "lineitem")
    done = rows.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_quantity").cast("long").alias("bytes"))
    return ingest.chunk_progress(rows.select("l_orderkey"), done, ["l_orderkey"]).select("l_orderkey", "total", "written", "bytes", "percent")


@query("""
WITH p AS (SELECT p_partkey, ['A', 'L5', 'N3', 'QUAD-S', 'DA/FI/TX', 'Y5', 'none'][p_size % 7 + 1] AS cube, ['FITC', '642', 'Red'][p_partkey % 3 + 1] AS other FROM part),
f AS (SELECT *, CASE WHEN cube IN ('QUAD-S', 'DA/FI/TX') THEN other ELSE cube END AS filter FROM p)
SELECT p_partkey, CASE WHEN cube <> filter THEN cube || ': ' || filter ELSE cube END AS block, CAST(CASE filter WHEN 'A' THEN 355 WHEN 'L5' THEN 480 WHEN 'FITC' THEN 480 WHEN 'N3' THEN 545 WHEN 'Red' THEN 545 WHEN '642' THEN 642 WHEN 'Y5' THEN 590 ELSE 0 END AS DOUBLE) AS excitation,
  CAST(CASE filter WHEN 'A' THEN 460 WHEN 'L5' THEN 527 WHEN 'FITC' THEN 527 WHEN 'N3' THEN 605 WHEN 'Red' THEN 605 WHEN '642' THEN 670 WHEN 'Y5' THEN 700 ELSE 0 END AS DOUBLE) AS emission FROM f""")
def filter_cubes(spark, sf_dir):
    """Parts as camera channels: the wavelengths of their filter cubes."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    other = pick(("FITC", "642", "Red"), F.col("p_partkey"))
    attrs = {"FluoCubeName": pick(("A", "L5", "N3", "QUAD-S", "DA/FI/TX", "Y5", "none"), F.col("p_size")), "FFW_Excitation1FilterName": other, "LUT": other}
    found = widefield.channels(node_rows(read(spark, sf_dir, "part"), "WideFieldChannelInfo", F.col("p_partkey"), F.lit(1), attrs))
    return found.select(F.col("path").cast("long").alias("p_partkey"), F.col("filterblock").alias("block"), "excitation", "emission")


@query("""
WITH p AS (SELECT p_partkey, p_size AS s FROM part)
SELECT p_partkey, CAST(CASE WHEN s % 3 = 0 THEN 475 WHEN s % 2 = 0 THEN 390 ELSE 0 END AS DOUBLE) AS excitation, CAST(500 + s AS DOUBLE) AS emission, CASE WHEN s % 2 = 0 AND s % 3 = 0 THEN '390=12.5,475=40.0' WHEN s % 3 = 0 THEN '475=40.0' WHEN s % 2 = 0 THEN '390=12.5' ELSE '' END AS leds, 'L5 ' || (500 + s) AS block FROM p""")
def diode_channels(spark, sf_dir):
    """Parts as channels lit by diodes: the last active one excites."""
    on = lambda k: F.when(F.col("p_size") % k == 0, "1").otherwise("0")
    attrs = {"FluoCubeName": F.lit("L5"), "EmissionWavelength": F.col("p_size") + 500, "ILLEDActiveState1": on(2), "ILLEDWavelength1": F.lit(390), "ILLEDIntensity1": F.lit(0.125), "ILLEDActiveState3": on(3), "ILLEDWavelength3": F.lit(475), "ILLEDIntensity3": F.lit(40)}
    found = widefield.led_channels(node_rows(read(spark, sf_dir, "part"), "WideFieldChannelInfo", F.col("p_partkey"), F.lit(1), attrs))
    leds = F.array_join(F.transform("led_intensities", lambda d: F.concat_ws("=", d["wavelength_nm"].cast("string"), d["intensity_percent"].cast("string"))), ",")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "excitation", "emission", leds.alias("leds"), F.col("filterblock").alias("block"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, 400 + min(l_suppkey) % 7 * 50 AS line, CAST(430 + min(l_quantity) * 4 AS DOUBLE) AS em FROM lineitem GROUP BY ALL),
e AS (SELECT a.l_orderkey, a.l_linenumber, a.em, coalesce(max(b.line), 0) AS ex FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.line <= a.em GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(em AS INTEGER), ',' ORDER BY l_linenumber) AS emission, string_agg(CAST(ex AS INTEGER), ',' ORDER BY l_linenumber) AS excitation FROM e GROUP BY l_orderkey""")
def spectral_bands(spark, sf_dir):
    """The lines of an order as laser lines and detection bands: each band's middle, and the nearest line below it."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))
    key, node = F.col("l_orderkey"), F.col("l_linenumber")
    left = 420 + F.col("l_quantity").cast("double") * 4
    nodes = node_rows(rows, "MultiBand", key, node, {"LeftWorld": left, "RightWorld": left + 20, "DyeName": F.lit("d")}).union(node_rows(rows, "Laser", key, node + 100, {"Wavelength": 400 + F.col("l_suppkey") % 7 * 50}))
    ints = lambda c: joined(F.transform(c, lambda v: v.cast("int")))
    return images.spectra(nodes).select(F.col("path").cast("long").alias("l_orderkey"), ints("emission").alias("emission"), ints("excitation").alias("excitation"))


@query("""
SELECT c_custkey, c_custkey % 3 + 1 AS channels, array_to_string(CASE WHEN c_custkey % 4 = 0 THEN list_transform(range(c_custkey % 3 + 1), lambda i: 500) ELSE [600] END, ',') AS emission, array_to_string((['L5'] || list_transform(range(greatest(c_custkey % 3, 0)), lambda i: 'Unknown')), ',') AS blocks FROM customer""")
def fluorescence_defaults(spark, sf_dir):
    """Customers as images with few settings: what fills them."""
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select("c_custkey", (k % 3 + 1).cast("int").alias("channels"), F.lit(False).alias("isrgb"), F.when(k % 4 != 0, F.array(F.lit(600.0))).alias("emission"), F.array(F.lit(1.0)).alias("excitation"), F.array(F.lit("L5")).alias("filterblock"))
    out = widefield.defaults(df)
    return out.select("c_custkey", F.col("channels").cast("long").alias("channels"), joined(F.transform("emission", lambda v: v.cast("int"))).alias("emission"), F.array_join("filterblock", ",").alias("blocks"))


@query("""
WITH s AS (SELECT c_nationkey AS k, c_custkey AS node, CASE c_custkey % 3 WHEN 0 THEN 'dblZoom' WHEN 1 THEN 'nSections' ELSE 'SystemType' END AS key, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer)
SELECT k, CAST(arg_max(v, node) FILTER (WHERE key = 'dblZoom') AS DOUBLE) AS zoom, CAST(arg_max(v, node) FILTER (WHERE key = 'nSections') AS INTEGER) AS sections, arg_max(v, node) FILTER (WHERE key = 'SystemType') AS system FROM s GROUP BY k""")
def scanner_settings(spark, sf_dir):
    """Customers of a nation as the flat records of an old scanner: the last record of a key counts."""
    k = F.col("c_custkey")
    attrs = {"Identifier": F.when(k % 3 == 0, "dblZoom").when(k % 3 == 1, "nSections").otherwise("SystemType"), "Variant": F.when(k % 3 == 2, F.col("c_mktsegment")).otherwise(k.cast("string"))}
    found = legacy.scanner(node_rows(read(spark, sf_dir, "customer"), "ScannerSettingRecord", F.col("c_nationkey"), k, attrs))
    return found.select(F.col("path").cast("int").alias("k"), "zoom", F.col("zstack_sections").alias("sections"), F.col("SystemTypeName").alias("system"))


@query("""
WITH t AS (SELECT p_size AS k, p_partkey AS num, CAST(p_retailprice AS DOUBLE) / 1e6 AS x, (p_partkey % 3) / 1e3 AS y FROM part),
g AS (SELECT k, min(abs(a.x - b.x)) AS gx FROM t a JOIN t b USING (k) WHERE abs(a.y - b.y) <= 1e-7 AND abs(a.x - b.x) > 1e-7 GROUP BY k), h AS (SELECT k, min(abs(a.y - b.y)) AS gy FROM t a JOIN t b USING (k) WHERE abs(a.x - b.x) <= 1e-12 AND abs(a.y - b.y) > 1e-7 GROUP BY k)
SELECT k, round(1 - gx / 1e-3, 6) AS over_x FROM g WHERE gx IS NOT NULL""")
def tile_overlap(spark, sf_dir):
    """Parts of one size as the tiles of a mosaic: the overlap of neighbours in a row."""
    attrs = {"PosX": F.col("p_retailprice").cast("double") / 1e6, "PosY": (F.col("p_partkey") % 3) / 1e3, "FieldX": F.lit(0), "FieldY": F.lit(0)}
    tiles = images.tile_positions(node_rows(read(spark, sf_dir, "part"), "Tile", F.col("p_size"), F.col("p_partkey"), attrs))
    dims = tiles.select("path", "element").distinct().select("path", "element", F.lit(1000).alias("xs"), F.lit(1000).alias("ys"), F.lit(1.0).alias("xres2"), F.lit(1.0).alias("yres2"))
    found = images.overlaps(tiles, dims).where("OverlapPercentageX IS NOT NULL")
    return found.select(F.col("path").cast("int").alias("k"), F.round("OverlapPercentageX", 6).alias("over_x"))


@query("""
SELECT r_regionkey AS folder, n_nationkey AS node, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'b' || n_nationkey ELSE 'n' || n_nationkey END AS uuid, n_nationkey % 5 > 0 AS is_image FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""")
def folder_children(spark, sf_dir):
    """Regions as folders with nations as their elements: the children of one folder."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    up = lambda k: (F.col(k) + 1000).cast("long")
    folder = node_rows(region, "Element", F.lit("f"), up("r_regionkey"), {"Name": F.col("r_name"), "UniqueID": F.col("r_name")}).withColumns({"element": F.col("node"), "parent": F.lit(None).cast("long")})
    leaf = node_rows(nation, "Element", F.lit("f"), F.col("n_nationkey"), {"Name": F.col("n_name"), "UniqueID": F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("n"), F.col("n_nationkey")))}, up("n_regionkey")).withColumn("element", F.col("node"))
    memory = node_rows(nation, "Memory", F.lit("f"), F.col("n_nationkey") + 500, {"Size": F.col("n_nationkey") % 5, "MemoryBlockID": F.concat(F.lit("b"), F.col("n_nationkey"))}, F.col("n_nationkey"))
    found = images.children(folder.union(leaf).union(memory), "ASIA")
    return found.select((F.col("parent_element") - 1000).cast("int").alias("folder"), F.col("element").cast("int").alias("node"), "name", "uuid", "is_image")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'item ' || (o_orderkey % 4) END AS name FROM orders""")
def child_lookup(spark, sf_dir):
    """The child of an id in a tree held as JSON."""
    from lumaframe.operators import browse

    kids = F.array(*[F.struct(F.lit("image").alias("type"), F.lit(f"item {k}").alias("name"), F.lit(str(k)).alias("uuid")) for k in range(3)])
    whole = F.to_json(F.struct(kids.alias("children")))
    found = browse.child(whole, (F.col("o_orderkey") % 4).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get_json_object(found, "$.name").alias("name"))
