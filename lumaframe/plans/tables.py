"""Metadata queries over the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import browse, images, legacy, linked, metadata, relational, tree
from lumaframe.sinks import preview, tiff, zarr
from lumaframe.sources import containers
from lumaframe.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def node_rows(rows: DataFrame, tag: str, path, node, attrs: dict, parent=None) -> DataFrame:
    """Rows of a table as nodes of one tag: each ``path`` is a document with one element."""
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(path.cast("string").alias("path"), node.cast("long").alias("node"), (F.lit(0) if parent is None else parent).cast("long").alias("parent"), F.lit(0).cast("long").alias("element"), F.lit(tag).alias("tag"), F.create_map(*pairs).alias("attrs"), F.lit("").alias("text"))


def long(column):
    return (F.col(column) if isinstance(column, str) else column).cast("long")


@query("""
SELECT p.event_id, p.user_id, CAST(max(epoch_us(s.ts)) AS BIGINT) AS signup_us FROM events p LEFT JOIN events s
ON s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id""")
def nearest_lower_match(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = events.where("event_type = 'signup'").select("user_id", "us", F.col("us").alias("at"))
    return relational.nearest_lower(left, right, ["user_id"], "us", "at", "signup_us").select("event_id", "user_id", "signup_us")


@query("""
SELECT a.p_size, round(min(abs(a.p_retailprice - b.p_retailprice)), 6) AS gap FROM part a JOIN part b
ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) > 1e-7 GROUP BY a.p_size""")
def band_pair_min(spark, sf_dir):
    gaps = relational.least_gap(read(spark, sf_dir, "part"), ["p_size"], "p_retailprice", "gap")
    return gaps.where("gap IS NOT NULL").select("p_size", F.round("gap", 6).alias("gap"))


@query("""
SELECT n_nationkey, n_name, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey OR c_custkey = n_nationkey) AS first_custkey FROM nation""")
def first_match_or_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    found = relational.first_match(nation, read(spark, sf_dir, "customer"), [("n_nationkey", "c_nationkey"), ("n_nationkey", "c_custkey")], "n_nationkey", "c_custkey", "first_custkey")
    return found.select("n_nationkey", "n_name", "first_custkey")


def places(spark, sf_dir: str, leaf: str) -> DataFrame:
    """Regions, nations and a table of leaves as one tree."""
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    k = leaf[0]
    last = read(spark, sf_dir, leaf).select(F.concat(F.lit(k), f"{k}_{'supp' if k == 's' else 'cust'}key"), F.concat(F.lit("n"), f"{k}_nationkey"), f"{k}_name")
    return region.union(nation).union(last)


@query("""
SELECT 'r' || r_regionkey AS id, CAST(0 AS INTEGER) AS depth, r_name AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def hierarchy_path(spark, sf_dir):
    return tree.paths(places(spark, sf_dir, "supplier")).select("id", "depth", "path")


@query("""
SELECT 'n' || n_nationkey AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'r' || r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def enumerate_leaves(spark, sf_dir):
    return tree.leaves(places(spark, sf_dir, "customer")).select("id", "path")


@query("""
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 50""")
def lru_evict(spark, sf_dir):
    return relational.keep_latest(read(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("""
WITH f AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) * 10 + 116444736000000000 AS ft FROM events)
SELECT event_id, CAST(ft >> 32 AS BIGINT) AS high, CAST(ft & 4294967295 AS BIGINT) AS low, CAST(us AS BIGINT) AS micros, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS shown FROM f""")
def filetime_roundtrip(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", scalar.filetime(micros("ts")).alias("ft"))
    high, low = scalar.filetime_words(F.col("ft"))
    df = df.select("event_id", high.alias("high"), low.alias("low"))
    back = scalar.filetime_micros(F.shiftleft("high", 32) + F.col("low"))
    return df.select("event_id", "high", "low", back.alias("micros"), F.date_format(F.timestamp_micros(back), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_property(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


UNITS = ("Meters", " mm ", "μm", "nm", "inches", "parsec", "in", "Centimetre", "millimetres", "cm", "micron", "inch")


@query("""
WITH u AS (SELECT p_partkey, p_size, ['Meters', ' mm ', 'μm', 'nm', 'inches', 'parsec', 'in', 'Centimetre', 'millimetres', 'cm', 'micron', 'inch'][p_size % 12 + 1] AS unit FROM part)
SELECT p_partkey, unit, p_size * CASE lower(trim(unit)) WHEN 'meters' THEN 1e6 WHEN 'mm' THEN 1e3 WHEN 'nm' THEN 1e-3 WHEN 'in' THEN 25400 WHEN 'inch' THEN 25400 WHEN 'centimetre' THEN 1e4 WHEN 'cm' THEN 1e4 WHEN 'millimetres' THEN 1e3 ELSE CAST(1.0 AS DOUBLE) END AS micrometres FROM u""")
def unit_factor_lookup(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, UNITS)), F.col("p_size") % 12 + 1)
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", unit.alias("unit"))
    return df.select("p_partkey", "unit", (F.col("p_size") * scalar.unit_factor(F.col("unit"))).alias("micrometres"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber AS k, CAST(l_quantity AS INTEGER) AS n, CAST(l_extendedprice AS DOUBLE) AS len, CAST(l_partkey AS BIGINT) AS inc FROM lineitem),
r AS (SELECT *, CASE WHEN n > 1 THEN len / (n - 1) ELSE 0.0 END AS res FROM d)
SELECT l_orderkey, """ + ", ".join(f"CAST(coalesce(max(CASE WHEN k = {k} THEN n END), 1) AS INTEGER) AS {a}s, coalesce(max(CASE WHEN k = {k} THEN inc END), 0) AS {a}bytesinc, CAST(coalesce(max(CASE WHEN k = {k} THEN res END), 0) AS DOUBLE) AS {a}res" for k, a in ((1, "x"), (2, "y"), (3, "z"), (4, "t"))) + " FROM r GROUP BY l_orderkey")
def dimension_pivot(spark, sf_dir):
    """The lines of an order as the dimensions of an image."""
    rows = read(spark, sf_dir, "lineitem")
    attrs = {"DimID": F.col("l_linenumber"), "NumberOfElements": F.col("l_quantity").cast("int"), "Length": F.col("l_extendedprice").cast("double"), "BytesInc": F.col("l_partkey"), "Unit": F.lit("m")}
    found = images.dimensions(node_rows(rows, "DimensionDescription", F.col("l_orderkey"), F.col("l_linenumber"), attrs))
    return found.select(F.col("path").cast("long").alias("l_orderkey"), *[f"{a}{c}" for a in "xyzt" for c in ("s", "bytesinc", "res")])


@query("SELECT page_id, url FROM pages WHERE NOT (lower(url) LIKE '%metadata%' OR lower(url) LIKE '%1%')")
def noise_name_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(~(scalar.noise_name(F.col("url")) | F.col("url").contains("1"))).select("page_id", "url")


@query("""
WITH f AS (SELECT coalesce(source, 'none') AS dir, 'doc' || doc_id || CASE lang WHEN 'es' THEN '.xlef' WHEN 'de' THEN '.lif' ELSE '.txt' END AS name, lang FROM documents)
SELECT dir, name, CASE WHEN lang IN ('es', 'de') THEN 'Folder' ELSE 'File' END AS type FROM (SELECT *, bool_or(coalesce(lang = 'es', false)) OVER (PARTITION BY dir) AS has_es FROM f) WHERE NOT has_es OR lang = 'es'""")
def directory_priority(spark, sf_dir):
    ext = F.when(F.col("lang") == "es", ".xlef").when(F.col("lang") == "de", ".lif").otherwise(".txt")
    docs = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("dir"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext).alias("name"), ext.alias("ext"), F.lit(0).alias("modified"), F.lit(0).alias("length"))
    return browse.listing(docs).select("dir", "name", "type")


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' ELSE 'Other' END AS priority FROM orders""")
def enum_canonicalise(spark, sf_dir):
    names = spark.createDataFrame([("1-Urgent",), ("2-High",), ("3-Medium",)], "name string")
    return relational.canonical(read(spark, sf_dir, "orders"), "o_orderpriority", names, "name", "priority").select("o_orderkey", "priority")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 5000)")
def semi_join_active(spark, sf_dir):
    active = read(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return relational.semi_join_if_any(read(spark, sf_dir, "lineitem"), active, "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || (s_suppkey % 2) FROM supplier),
w AS (SELECT 'r0' AS path, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN e ON a = path WHERE depth < 8)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY path""")
def anti_join_visited(spark, sf_dir):
    """What one region reaches through nations and suppliers, which point back to regions."""
    edge = lambda df, a, b: df.select(a.alias("path"), b.alias("target"))
    name = lambda k, c: F.concat(F.lit(k), (F.col(c) if isinstance(c, str) else c).cast("string"))
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    links = edge(nation, name("r", "n_regionkey"), name("n", "n_nationkey")).union(edge(supplier, name("n", "s_nationkey"), name("s", "s_suppkey"))).union(edge(supplier, name("s", "s_suppkey"), name("r", F.col("s_suppkey") % 2)))
    return linked.reach(links, "r0")


@query("""
SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey""")
def left_join_override(spark, sf_dir):
    few = read(spark, sf_dir, "nation").where("n_nationkey < 10")
    return relational.overlay(read(spark, sf_dir, "customer"), few, ("c_nationkey", "n_nationkey"), {"c_name": "n_name"}).select("c_custkey", "c_name")


@query("""
WITH q AS (SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT))) AS a FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_resize(a[1:5], 5, CAST(-1 AS BIGINT)), ',') AS padded FROM q""")
def default_padding(spark, sf_dir):
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(long("l_quantity"))).alias("a"))
    padded = scalar.pad(F.col("a"), 5, -1)
    return lists.select("l_orderkey", F.array_join(F.transform(padded, lambda v: v.cast("string")), ",").alias("padded"))


@query("""
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem GROUP BY l_orderkey""")
def distinct_sorted_lines(spark, sf_dir):
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("a"))
    return lists.select("l_orderkey", F.array_join(F.transform("a", lambda v: v.cast("string")), ",").alias("suppliers"))


@query("""
WITH r AS (SELECT user_id, event_type, event_id, event_id % 2 = 0 AS wave FROM events)
SELECT user_id, event_type AS name, min(event_id) AS node, CAST(arg_max(event_id, event_id) FILTER (WHERE wave) AS DOUBLE) AS wavelength_nm, CAST(arg_max(event_id, event_id) FILTER (WHERE NOT wave) AS VARCHAR) AS power_state FROM r GROUP BY user_id, event_type""")
def group_collect_map(spark, sf_dir):
    """A user's events as the records of lasers, one laser for each type."""
    rows = read(spark, sf_dir, "events")
    attrs = {"ObjectName": F.col("event_type"), "ClassName": F.lit("CLaser"), "Attribute": F.when(F.col("event_id") % 2 == 0, "Wavelength").otherwise("Power State"), "Variant": F.col("event_id")}
    found = legacy.lasers(node_rows(rows, "FilterSettingRecord", F.col("user_id"), F.col("event_id"), attrs))
    return found.select(F.col("path").cast("long").alias("user_id"), "name", "node", "wavelength_nm", "power_state")


@query("""
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS filled FROM customer""")
def fill_if_missing(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", scalar.fill(value, F.col("c_name")).alias("filled"))


@query("""
WITH k AS (SELECT p_partkey, p_size, p_size / 50.0 AS na, p_size > 25 AS confocal, p_size % 3 = 0 AS rgb FROM part)
SELECT p_partkey, CAST(CASE WHEN na > 0 THEN na END AS DOUBLE) AS na, CAST(CASE WHEN confocal AND p_size > 0 THEN p_size END AS DOUBLE) AS zoom, CAST(CASE WHEN confocal AND p_size % 4 > 1 THEN p_size % 4 END AS BIGINT) AS sections,
  CASE WHEN NOT rgb AND p_size % 5 > 0 THEN '[' || (p_size % 5) || ',0]' END AS excitation, CASE WHEN NOT confocal THEN 'cam' END AS camera, CASE WHEN NOT rgb AND p_size % 2 = 0 THEN '["Unknown","A"]' END AS blocks FROM k""")
def conditional_keyvalues(spark, sf_dir):
    """Parts as images: what the record says of each."""
    size = F.col("p_size")
    wide = read(spark, sf_dir, "part").select(
        "p_partkey", (size / 50.0).alias("na"), F.when(size > 25, "IncohConfMicr").otherwise("IncohWFMicr").alias("mic_type"), (size % 3 == 0).alias("isrgb"), size.cast("double").alias("zoom"), (size % 4).cast("int").alias("zstack_sections"),
        F.array((size % 5).cast("double"), F.lit(None)).alias("excitation"), F.lit("cam").alias("camera_name"), F.array(F.lit("Unknown"), F.when(size % 2 == 0, "A").otherwise("")).alias("filterblock"),
    )
    get = lambda k: F.get_json_object("keyvalues", f"$.{k}")
    return images.key_values(wide).select(
        "p_partkey", get("numerical_aperture").cast("double").alias("na"), get("zoom").cast("double").alias("zoom"), get("zstack_sections").cast("long").alias("sections"), get("excitation_wavelengths").alias("excitation"), get("camera_name").alias("camera"), get("filter_blocks").alias("blocks")
    )


@query("""
WITH w AS (SELECT l_returnflag = 'R' AS lif, l_linenumber > 1 AND l_discount > 0.05 AS gaps, CAST(l_quantity * 100 AS INTEGER) AS side, l_linestatus = 'O' AS rgb FROM lineitem)
SELECT route, count(*) AS n FROM (SELECT CASE WHEN lif AND gaps THEN 'single lif' WHEN NOT lif AND (side <= 3192 OR gaps) THEN 'as it is' WHEN rgb THEN 'rgb' ELSE 'planar' END AS route FROM w) GROUP BY route""")
def routing_case(spark, sf_dir):
    """Line items as images: which writer each goes to."""
    side = (F.col("l_quantity") * 100).cast("int")
    wide = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "a.lif").otherwise("a.lof").alias("path"), F.col("l_linenumber").alias("tiles"), (F.col("l_discount") > 0.05).alias("OverlapIsNegative"), side.alias("xs"), side.alias("ys"), (F.col("l_linestatus") == "O").alias("isrgb"))
    return images.route(wide).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT page_id, TRY_CAST(nullif(regexp_extract('HC PL ' || page_id || '.5x/0.' || page_id % 10, '([0-9]+([.][0-9]+)?)[xX]', 1), '') AS DOUBLE) AS magnification FROM pages""")
def regex_magnification(spark, sf_dir):
    name = F.concat(F.lit("HC PL "), F.col("page_id").cast("string"), F.lit(".5x/0."), (F.col("page_id") % 10).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", scalar.magnification(name).alias("magnification"))


@query("""
SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%oil%' THEN 'Oil' WHEN lower(p_name) LIKE '%water%' THEN 'Water' WHEN lower(p_name) LIKE '%glycerol%' THEN 'Glycerol'
  WHEN lower(p_name) LIKE '%multi%' THEN 'Multi' WHEN lower(p_name) LIKE '%dry%' THEN 'Dry' WHEN lower(p_name) LIKE '%air%' THEN 'Air' WHEN p_size / 50.0 > 0.75 THEN 'Oil' END AS immersion FROM part""")
def token_class_ordered(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalar.immersion(F.col("p_name"), F.col("p_size") / 50.0).alias("immersion"))


@query("""
WITH k AS (SELECT n_nationkey, CAST(n_nationkey * 37 % 256 AS BIGINT) AS r, CAST(n_nationkey * 91 % 256 AS BIGINT) AS g, CAST(n_nationkey * 11 % 256 AS BIGINT) AS b FROM nation),
p AS (SELECT *, r * 16777216 + g * 65536 + b * 256 + 255 AS v FROM k)
SELECT n_nationkey, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS BIGINT) AS packed, lower(printf('%02x%02x%02x', r, g, b)) AS hex FROM p""")
def colour_pack_signed(spark, sf_dir):
    r, g, b = (F.col("n_nationkey") * k % 256 for k in (37, 91, 11))
    return read(spark, sf_dir, "nation").select("n_nationkey", scalar.pack_colour(r, g, b).alias("packed"), scalar.hex_colour(r, g, b).alias("hex"))


@query("""
SELECT c_custkey, concat_ws(chr(10), 'Name: ' || c_name, 'Size: ' || (c_custkey % 9 + 1) || ' x ' || (c_nationkey + 1) || ' pixels', CASE WHEN c_custkey % 4 > 1 THEN 'Channels: ' || (c_custkey % 4) END,
  CASE WHEN c_acctbal > 0 THEN 'Pixel: ' || printf('%.2f', CAST(c_acctbal AS DOUBLE)) || ' µm' END, 'Microscope: ' || c_mktsegment, 'Objective: ' || c_mktsegment || CASE WHEN c_nationkey > 0 THEN ' (' || c_nationkey || '×)' ELSE '' END, 'Excitation: 488 nm, ' || c_nationkey || ' nm') AS summary FROM customer""")
def summary_text(spark, sf_dir):
    """Customers as images: what a viewer says of each."""
    wide = read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), (F.col("c_custkey") % 9 + 1).alias("xs"), (F.col("c_nationkey") + 1).alias("ys"), F.lit(1).alias("zs"), F.lit(1).alias("ts"), (F.col("c_custkey") % 4).alias("channels"), F.col("c_acctbal").cast("double").alias("xres2"),
        F.col("c_mktsegment").alias("SystemTypeName"), F.col("c_mktsegment").alias("objective"), F.col("c_nationkey").cast("double").alias("magnification"), F.array(F.lit(488.0), F.col("c_nationkey").cast("double")).alias("excitation"),
    )
    return metadata.summary_text(wide).select("c_custkey", "summary")


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id || '-lif_img' ELSE 'x' || page_id || '_img' END AS name, 'p' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.ome' END AS stem, 'p' || page_id || '.lif' || CASE WHEN page_id % 5 = 0 THEN '' ELSE ' [a/b]' END AS shown FROM pages""")
def name_with_extension(spark, sf_dir):
    number = F.col("page_id").cast("string")
    file = F.concat(F.lit("/data/p"), number, F.lit(".lif"))
    own = F.concat(F.when(F.col("page_id") % 2 == 0, "p").otherwise("x"), number, F.lit("_img"))
    result = F.concat(F.lit("p"), number, F.when(F.col("page_id") % 3 == 0, ".OME.tiff").otherwise(".ome.png"))
    trail = F.when(F.col("page_id") % 5 != 0, "a/b")
    return read(spark, sf_dir, "pages").select("page_id", browse.output_name(own, file).alias("name"), scalar.stem(result).alias("stem"), browse.shown_name(file, trail).alias("shown"))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS side, CAST(0 AS BIGINT) AS level, CAST(p_size * 100 AS BIGINT) AS now FROM part
  UNION ALL SELECT p_partkey, side, level + 1, (now + 1) // 2 FROM s WHERE now > 512)
SELECT p_partkey, level, CAST(power(2, level) AS DOUBLE) AS scale FROM s""")
def level_count_scales(spark, sf_dir):
    side = long(F.col("p_size") * 100)
    n = scalar.levels(side, side)
    df = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("level"))
    return df.select("p_partkey", "level", F.pow(F.lit(2.0), F.col("level")).alias("scale"))


@query("""
SELECT l_orderkey, l_linenumber, l_orderkey AS t, CAST(l_linenumber AS BIGINT) % 3 AS c, l_partkey % 5 AS z, (l_orderkey * 3 + CAST(l_linenumber AS BIGINT) % 3) * 5 + l_partkey % 5 AS plane FROM lineitem""")
def plane_ordinal(spark, sf_dir):
    from lumaframe.operators import array

    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("t"), (F.col("l_linenumber").cast("long") % 3).alias("c"), (F.col("l_partkey") % 5).alias("z"))
    return df.select("*", array.plane_ordinal(F.col("t"), F.col("c"), F.col("z"), 3, 5).alias("plane"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 1 + l_partkey % 700 AS size FROM lineitem),
s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, size) - 1 AS row, size FROM n)
SELECT row, size, CAST(16 + coalesce(sum(size) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM s""")
def tile_offsets(spark, sf_dir):
    """Where rows of packed tiles begin in a file that many tasks write: prefix sums in two levels."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("long") + 1, F.col("l_partkey") % 700).alias("sizes"))
    per_order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", F.get("sizes", F.lit(0)) + F.get("sizes", F.lit(1))))
    placed = lines.withColumn("nth", per_order)
    before = placed.groupBy("l_orderkey").agg(F.max("nth").alias("n"))
    group = before.withColumn("grp", F.floor(F.col("l_orderkey") / 1000))
    own = group.withColumn("inside", F.sum("n").over(W.partitionBy("grp").orderBy("l_orderkey")) - F.col("n"))
    sums = group.groupBy("grp").agg(F.sum("n").alias("total"))
    base = sums.withColumn("base", F.sum("total").over(W.orderBy("grp")) - F.col("total")).select("grp", "base")
    numbers = own.join(base, "grp").select("l_orderkey", (F.col("base") + F.col("inside")).alias("first"))
    rows = placed.join(numbers, "l_orderkey").select((F.col("first") + F.col("nth") - 1).alias("row"), "sizes")
    offsets, _ = tiff.with_offsets(rows, rows.count())
    return offsets.select("row", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("size"), "offset")


@query("""
WITH RECURSIVE k AS (SELECT 0 AS level, l_suppkey % 3 AS c, l_partkey % 97 AS y, l_orderkey % 61 AS x FROM lineitem
UNION SELECT level + 1, c, y // 2, x // 2 FROM k WHERE level < 6)
SELECT DISTINCT CAST(level AS INTEGER) AS level, c, y, x FROM k""")
def dirty_parents(spark, sf_dir):
    """The chunks of all levels that have to be made anew after some of level 0 have changed."""
    changed = read(spark, sf_dir, "lineitem").select(F.lit(0).alias("level"), (F.col("l_suppkey") % 3).alias("c"), (F.col("l_partkey") % 97).alias("y"), (F.col("l_orderkey") % 61).alias("x")).distinct()
    every = changed
    for level in range(1, 7):
        changed = zarr.above(changed, "c").withColumn("level", F.lit(level)).select("level", "c", "y", "x")
        every = every.unionByName(changed)
    return every


@query("""
SELECT o_orderkey, list_concat(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderpriority] ELSE [] END, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus, o_orderpriority] ELSE [] END) AS notes FROM orders""")
def annotation_union(spark, sf_dir):
    """The annotations of an image and of what it is part of, in one list; either may lack."""
    notes = relational.all_notes(F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")))
    return read(spark, sf_dir, "orders").select("o_orderkey", notes.alias("notes"))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def consecutive_dedup(spark, sf_dir):
    return relational.drop_repeats(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
WITH s AS (SELECT s_nationkey AS k, CAST(count(*) AS DOUBLE) AS v FROM supplier GROUP BY ALL), c AS (SELECT c_nationkey AS k, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE c_nationkey > 3 GROUP BY ALL)
SELECT coalesce(s.k, c.k) AS k, CASE WHEN c.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'extra' WHEN abs(s.v - c.v) <= 1e-9 THEN 'same' ELSE 'different' END AS status FROM s FULL JOIN c ON s.k = c.k""")
def compare_tolerance(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    b = read(spark, sf_dir, "customer").where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return relational.compare(a, b, "k", "v")


@query("""
SELECT doc_id, max(h) AS height, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN n_chars <= 2048 THEN [200] ELSE [24, 100, 200] END) AS h FROM documents) GROUP BY doc_id""")
def preview_heights(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.explode(preview.heights(F.col("n_chars"), F.lit(10))).alias("h"))
    return df.groupBy("doc_id").agg(F.max("h").alias("height"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id, turn, CAST(turn * 7 % 101 AS DOUBLE) AS percent, role AS phase FROM conversations WHERE turn % 3 > 0""")
def progress_parse(spark, sf_dir):
    line = F.when(F.col("turn") % 3 > 0, F.concat("role", F.lit(": [###] "), (F.col("turn") * 7 % 101).cast("string"), F.lit("% done"))).otherwise("nothing to say")
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value"))
    return ingest.progress(df).select("conv_id", "turn", "percent", "phase")


@query("""
WITH c AS (SELECT conv_id, role, turn FROM conversations)
SELECT conv_id, tag, n, depth FROM (SELECT conv_id, role AS tag, count(*) AS n, CAST(1 AS INTEGER) AS depth FROM c GROUP BY conv_id, role UNION ALL SELECT conv_id, 'talk', 1, 0 FROM c GROUP BY conv_id UNION ALL SELECT conv_id, 'said', count(*), 2 FROM c GROUP BY conv_id)""")
def xml_like_tag_scan(spark, sf_dir):
    """Conversations as XML documents, parsed into nodes and counted by tag."""
    one = F.concat(F.lit("<"), F.col("role"), F.lit(' turn="'), F.col("turn").cast("string"), F.lit('"><said/></'), F.col("role"), F.lit(">"))
    docs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(one)), "").alias("body"))
    docs = docs.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("<talk>"), "body", F.lit("</talk>")).alias("xml"))
    return containers.xml_nodes(docs).groupBy(F.col("path").cast("long").alias("conv_id"), "tag").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@query("""
WITH n AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE CAST(n_nationkey * 7 % 100 AS VARCHAR) END AS name FROM nation)
SELECT name, row_number() OVER (ORDER BY TRY_CAST(name AS BIGINT) IS NULL, TRY_CAST(name AS BIGINT), name) AS place FROM n""")
def sorted_listing(spark, sf_dir):
    """Names in the order of a listing: numbers by value, then words. There are as many names as nations."""
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise((F.col("n_nationkey") * 7 % 100).cast("string"))
    names = read(spark, sf_dir, "nation").select(name.alias("name")).distinct()
    return names.select("name", F.row_number().over(W.orderBy(scalar.numeric_order(F.col("name")))).cast("long").alias("place"))


@query("""
WITH c AS (SELECT doc_id % 97 AS path, CASE WHEN n_chars > 900 THEN 'doc_histo' ELSE 'doc' END AS name, CASE WHEN lang = 'es' THEN 'Folder' ELSE 'image' END AS type FROM documents)
SELECT path, count(*) = 1 AND bool_and(type <> 'Folder') AS single FROM c WHERE name = 'doc' GROUP BY path""")
def single_visible_image(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("path"), F.when(F.col("n_chars") > 900, "doc_histo").otherwise("doc").alias("name"), F.when(F.col("lang") == "es", "Folder").otherwise("image").alias("type"))
    return browse.single_image(docs)


@query("""
SELECT event_id, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) ELSE printf('%.2f KB', b / 1024.0) END AS size
FROM (SELECT event_id, event_id * event_id * 97 AS b FROM events)""")
def byte_size_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", scalar.size_text(F.col("event_id") * F.col("event_id") * 97).alias("size"))
