"""Sky catalog: cone search, ranking, lookup, classification, header solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.lookups import MESSIER, NEBULAE, OTHER_PALETTES, PALETTES, PRESETS
from skyframe.functions.math import haversine_deg
from skyframe.functions.ranking import top_k

# Object-radius tiers in degrees and the sky cell each is filed under.
TIERS = [(0.25, 2.0), (1.0, 2.0), (4.0, 8.0), (180.0, 360.0)]


def _tier(radius: Column) -> Column:
    t = F.lit(len(TIERS) - 1)
    for i in reversed(range(len(TIERS) - 1)):
        t = F.when(radius <= TIERS[i][0], F.lit(i)).otherwise(t)
    return t


def _in_many_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over a number of tasks of its own, which is not lowered by the bytes that go in."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _place(c: str) -> Column:
    """A coordinate in hundredths of a degree, where twins are equal."""
    # whole numbers: double keys are normalised by the window, which then deals the rows once more
    return F.coalesce(F.rint(F.col(c) * 100).try_cast("long"), F.when(F.col(c).isNotNull(), F.lit(1 << 62)))


_CELL, _TWIN = ["_t", "_cx", "_cy"], ["_kx", "_ky"]


def cone_search(fields: DataFrame, catalog: DataFrame, twins: bool = False) -> DataFrame:
    """Objects whose disc meets each field's circle.

    Objects sit in one sky cell of their size tier; a field lists the cells its widened circle can
    reach (right ascension wraps).  The join is on equal cells, shuffled, and the exact test follows.
    With ``twins`` objects of one rounded position sit in one cell, that of the position and the largest
    of them, and the pairs keep what :func:`collapse_twins` needs to collapse them where they are.
    """
    radius = F.coalesce("diameter", F.lit(0.0)) / 2 / 60
    cell = F.element_at(F.array(*[F.lit(c) for _, c in TIERS]), F.col("_t") + 1)
    obj, ra, dec, size, margin = catalog.withColumn("_or", radius), F.col("ra"), F.col("dec"), F.col("_or"), 0.0
    if twins:
        same = Window.partitionBy(*_TWIN)
        obj = obj.withColumns({"_kx": _place("ra"), "_ky": _place("dec")})
        obj = obj.withColumns({"_size": F.max("_or").over(same), "_alone": F.count(F.lit(1)).over(same) == 1})
        ra, dec, size, margin = F.col("_kx") / 100.0, F.col("_ky") / 100.0, F.col("_size"), 0.0051
    obj = (
        obj.withColumn("_t", _tier(size)).withColumn("_cell", cell)
        .withColumn("_cy", F.floor((dec + 90) / F.col("_cell")).try_cast("int"))
        .withColumn("_cx", F.floor(F.pmod(ra, F.lit(360.0)) / F.col("_cell")).try_cast("int")).drop("_cell", "_size")
    )
    reach = []
    for i, (r, c) in enumerate(TIERS):
        reach.append(F.struct(F.lit(i).alias("t"), F.lit(r).alias("r"), F.lit(c).alias("c")))
    f = fields.select(F.col("field_id"), F.col("ra").alias("_fra"), F.col("dec").alias("_fdec"), "fov_radius")
    f = f.withColumn("_q", F.explode(F.array(*reach))).withColumn("_R", F.col("fov_radius") + F.col("_q.r"))
    polar = F.abs(F.col("_fdec")) + F.col("_R") >= 89.9
    dra = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_R")) / F.cos(F.radians("_fdec"))))) + 1e-6 + margin)
    n = F.greatest(F.lit(1), F.ceil(F.lit(360.0) / F.col("_q.c"))).cast("int")
    lo = F.floor((F.col("_fra") - F.col("_dra")) / F.col("_q.c")).cast("int")
    hi = F.floor((F.col("_fra") + F.col("_dra")) / F.col("_q.c")).cast("int")
    f = f.withColumn("_dra", dra).withColumn("_cx", F.explode(F.array_distinct(F.transform(F.sequence(lo, hi), lambda k: F.pmod(k, n)))))
    f = f.withColumn(
        "_cy",
        F.explode(F.sequence(
            F.floor((F.greatest(F.col("_fdec") - F.col("_R") - margin, F.lit(-90.0)) + 90) / F.col("_q.c")).cast("int"),
            F.floor((F.least(F.col("_fdec") + F.col("_R") + margin, F.lit(90.0)) + 90) / F.col("_q.c")).cast("int"),
        )),
    ).select("field_id", "_fra", "_fdec", "fov_radius", F.col("_q.t").alias("_t"), "_cx", "_cy")
    sep = haversine_deg(F.col("_fra"), F.col("_fdec"), F.col("ra"), F.col("dec"))
    # few bytes go in and many pairs come out
    f = _in_many_tasks(f, "_t", "_cx", "_cy")
    return (
        f.join(obj.hint("merge"), ["_t", "_cx", "_cy"]).withColumn("sep", sep)
        .filter(F.col("sep") <= F.col("fov_radius") + F.col("_or"))
        .drop(*([] if twins else _CELL), "_or", "_fra", "_fdec")
    )


def prominence(cands: DataFrame) -> DataFrame:
    """Score a candidate by size in the field, brightness, centrality and fame."""
    size = F.least(F.lit(1.0), F.coalesce("diameter", F.lit(0.5)) / F.greatest(F.lit(0.001), F.col("fov_radius") * 60))
    mag = F.greatest(F.lit(0.0), (14.0 - F.coalesce("mag", F.lit(15.0))) / 14.0)
    centre = F.greatest(F.lit(0.0), 1.0 - F.col("sep") / (F.col("fov_radius") + 1e-6))
    famous = F.when(F.col("source") == "M", 0.12).otherwise(0.0)
    return cands.withColumn("score", 0.5 * size + 0.28 * mag + 0.22 * centre + famous)


def collapse_twins(cands: DataFrame) -> DataFrame:
    """One candidate per rounded position of a field: the best score, the earlier row on a tie."""
    first = [F.col("score").desc(), F.col("ord")]
    if "_alone" in cands.columns:
        # the join has brought twins together: no pair is dealt anew, and those without a twin are not sorted
        best = top_k(cands.filter(~F.col("_alone")), [*_CELL, "field_id", *_TWIN], first, 1).drop("rank")
        return cands.filter("_alone").unionByName(best).drop(*_CELL, *_TWIN, "_alone")
    d = cands.withColumns({"_kx": _place("ra"), "_ky": _place("dec")})
    # pairs pack well, so that few tasks would sort many of them
    return top_k(_in_many_tasks(d, "field_id", *_TWIN), ["field_id", *_TWIN], first, 1).drop(*_TWIN, "rank")


def top_candidate(cands: DataFrame) -> DataFrame:
    return top_k(cands, ["field_id"], [F.col("score").desc(), F.col("ord")], 1).drop("rank")


def norm_id(c: Column) -> Column:
    return F.replace(F.upper(F.trim(F.element_at(F.split(c, "—"), 1))), F.lit(" "), F.lit(""))


def _grams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))


def find_by_name(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve (query_id, query): exact designation, else exact name, else first name containing it.

    Containment goes through three-letter pieces: the query's rarest piece is joined with the names'
    pieces, so no query is paired with the whole catalog.
    """
    parts = F.split(F.col("query"), "—")
    q = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "").select(
        "query_id", norm_id(F.col("query")).alias("_qid"),
        F.lower(F.trim(F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.col("query")))).alias("_qn"),
    )
    c = catalog.select("ord", "id", "common_name", norm_id(F.col("id")).alias("_qid"), F.lower("common_name").alias("_cn"))
    first = lambda g, k: g.groupBy(k).agg(F.min(F.struct("ord", "id", "common_name")).alias("_h"))
    by_id = q.join(first(c, "_qid"), "_qid").select("query_id", F.lit(1).alias("p"), "_h")
    names = first(c.filter(F.coalesce("common_name", F.lit("")) != ""), "_cn")
    exact = q.join(names, F.col("_qn") == F.col("_cn")).select("query_id", F.lit(2).alias("p"), "_h")
    grams = names.select("_cn", "_h", F.explode(_grams(F.col("_cn"))).alias("_g"))
    freq = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # each distinct query text once, however many queries share it
    texts = q.select("_qn").distinct()
    rare = texts.select("_qn", F.explode(_grams(F.col("_qn"))).alias("_g")).join(freq, "_g").groupBy("_qn").agg(F.min(F.struct("_n", "_g")).alias("_r"))
    hit = rare.select("_qn", F.col("_r._g").alias("_g")).join(grams, "_g").filter(F.contains("_cn", "_qn"))
    best = hit.groupBy("_qn").agg(F.min("_h").alias("_h"))
    part = q.join(best, "_qn").select("query_id", F.lit(3).alias("p"), "_h")
    won = by_id.unionByName(exact).unionByName(part).groupBy("query_id").agg(F.min(F.struct("p", "_h")).alias("_w"))
    return won.select("query_id", F.col("_w.p").alias("how"), F.col("_w._h.id").alias("id"), F.col("_w._h.common_name").alias("common_name"))


def object_class(id_="id", name="common_name", ratio="axis_ratio", diameter="diameter") -> Column:
    """Class from the designation tables, then name keywords, then shape."""
    i = F.coalesce(F.col(id_), F.lit(""))
    m = F.regexp_extract(i, r"(?i)^M\s*0*([0-9]{1,3})$", 1)
    cat = F.upper(F.regexp_extract(i, r"(?i)^(IC|NGC)\s*0*([0-9]{1,4})$", 1))
    num = F.regexp_extract(i, r"(?i)^(IC|NGC)\s*0*([0-9]{1,4})$", 2)
    table = {str(n): c for c, nums in MESSIER.items() for n in nums}
    as_map = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    known = {f"{k}{n}": c for c in ("emission", "reflection") for k, nums in NEBULAE[c].items() for n in nums}
    neb = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    cn = F.lower(F.coalesce(F.col(name), F.lit("")))
    words = (
        F.when(cn.contains("galaxy"), "galaxy").when(cn.contains("globular"), "globular").when(cn.contains("planetary"), "planetary")
        .when(cn.rlike(r"reflection|witch head|\biris\b"), "reflection").when(cn.contains("cluster"), "open").when(cn.contains("nebula"), "emission")
        .when((F.col(ratio) >= 2.2) & (F.col(diameter) < 15), "galaxy").otherwise("generic")
    )
    return F.coalesce(F.try_element_at(as_map, m), F.try_element_at(neb, F.concat(cat, num)), words)


def data_type(filter_name: Column, is_color: Column) -> Column:
    f = F.lower(filter_name)
    seen = F.coalesce(f, F.lit("")) != ""
    return (
        F.when(seen & f.rlike(r"(^|[^a-z])(ha|h[- ]?alpha|sii|s2|oiii|o3|nii|n2)([^a-z]|$)"), "narrowband")
        .when(seen & f.rlike(r"(lum|^l$|red|^r$|green|^g$|blue|^b$)"), "broadband")
        .when(seen & f.rlike(r"(rgb|color|osc|bayer)"), "osc").when(is_color, "osc").otherwise("broadband")
    )


def palettes_for(kind: Column) -> Column:
    lists = F.create_map(*[x for k, v in PALETTES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return F.coalesce(F.try_element_at(lists, kind), F.array(*[F.lit(p) for p in OTHER_PALETTES]))


def palette_key(p: Column) -> Column:
    return F.when(p.rlike("(?i)^SHO"), "SHO").when(p.rlike("(?i)^HOS"), "HOS").when(p.rlike("(?i)^(HOO|Bicolor)"), "HOO")


def object_label(id_: Column, name: Column) -> Column:
    return F.when(id_.isNull(), "(none)").otherwise(F.concat(id_, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" — "), name)).otherwise("")))


def preset_table(spark) -> DataFrame:
    import json

    rows = [(i.replace(" ", ""), name, json.dumps(s, sort_keys=True)) for ids, name, s in PRESETS for i in ids]
    return spark.createDataFrame(rows, "_qid string, preset string, settings string")


def curated_for(objects: DataFrame, id_="id") -> DataFrame:
    """Attach the curated preset of a designation, null where there is none."""
    t = preset_table(objects.sparkSession)
    return objects.withColumn("_qid", norm_id(F.col(id_))).join(t, "_qid", "left").drop("_qid")


def solve_header(frames: DataFrame, header="header") -> DataFrame:
    """Field centre, scale, diagonal and focal length from a tangent-plane header; unsolved rows give nulls."""
    from skyframe.sources.files import header_value

    def h(k):
        return F.expr("0").cast("double") if k is None else header_value(k, header).try_cast("double")

    d = frames.withColumns({f"_{k}": h(n) for k, n in {"a0": "CRVAL1", "d0": "CRVAL2", "p1": "CRPIX1", "p2": "CRPIX2", "c11": "CD1_1", "c12": "CD1_2", "c21": "CD2_1", "c22": "CD2_2"}.items()})
    px, py = F.col("width") / 2 + 1 - F.col("_p1"), F.col("height") / 2 + 1 - F.col("_p2")
    d = d.withColumns({"_xi": F.radians(F.col("_c11") * px + F.col("_c12") * py), "_eta": F.radians(F.col("_c21") * px + F.col("_c22") * py)})
    dec0 = F.radians("_d0")
    den = F.cos(dec0) - F.col("_eta") * F.sin(dec0)
    ra = F.pmod(F.col("_a0") + F.degrees(F.atan2(F.col("_xi"), den)), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin(dec0) + F.col("_eta") * F.cos(dec0), F.hypot(F.col("_xi"), den)))
    res = (F.hypot("_c11", "_c21") + F.hypot("_c12", "_c22")) / 2
    um = F.coalesce(*[F.when(header_value(k, header).try_cast("double") > 0, header_value(k, header).try_cast("double")) for k in ("XPIXSZ", "PIXSIZE", "PIXSIZE1")])
    ok = res > 0
    d = d.withColumns({"ra": F.when(ok, ra), "dec": F.when(ok, dec), "resolution": F.when(ok, res)})
    d = d.withColumn("pix_scale", F.col("resolution") * 3600).withColumn("fov_deg", F.hypot("width", "height") * F.col("resolution"))
    d = d.withColumn("focal", 206.265 * um / F.col("pix_scale")).withColumn("solved", F.col("ra").isNotNull() & F.col("dec").isNotNull())
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def identify(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """Header solution, cone search, top candidate, class and preset; unsolved keeps the given class."""
    solved = solve_header(frames)
    fields = solved.filter("solved").select(F.col("frame_id").alias("field_id"), "ra", "dec", (F.col("fov_deg") / 2).alias("fov_radius"))
    best = top_candidate(collapse_twins(prominence(cone_search(fields, catalog, twins=True))))
    named = curated_for(best.withColumn("_cls", object_class())).select(
        F.col("field_id").alias("frame_id"), F.col("id").alias("object_id"), object_label(F.col("id"), F.col("common_name")).alias("label"), "_cls", "preset"
    )
    return solved.select("frame_id", "solved", "given_class").join(named, "frame_id", "left").select(
        "frame_id", "solved", "object_id", "label", F.coalesce("_cls", "given_class").alias("object_class"), "preset"
    )


