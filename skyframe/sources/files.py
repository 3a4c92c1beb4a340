"""Frame listings, headers, identities, incremental reuse, and the sinks of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.lookups import FRAME_SUFFIXES, RAW_SUFFIXES, SET_ALIASES
from skyframe.functions.math import clip
from skyframe.operators.overlap import image_dims
from skyframe.session import cut


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """File listing of a folder as a frame table; file contents are never read."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def list_frames(files: DataFrame, folder: str | None = None, suffixes=FRAME_SUFFIXES) -> DataFrame:
    """Readable frames directly in ``folder`` (or in any), in path order."""
    d = files.filter(suffix(F.col("path")).isin(*suffixes))
    return (d.filter(parent(F.col("path")) == folder) if folder else d).orderBy("path")


def split_readable(files: DataFrame) -> DataFrame:
    """Each listed file as ``frame`` or ``raw``; other suffixes are dropped."""
    s = suffix(F.col("path"))
    kind = F.when(s.isin(*FRAME_SUFFIXES), "frame").when(s.isin(*RAW_SUFFIXES), "raw")
    return files.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def find_sets(files: DataFrame) -> DataFrame:
    """Classify frames under <root>/<folder>/ into sets; the first alias that exists wins per set.

    A root without a lights folder uses its own direct files as lights.
    """
    alias = F.create_map(*[x for name, al in SET_ALIASES.items() for i, a in enumerate(al) for x in (F.lit(a), F.struct(F.lit(name).alias("s"), F.lit(i).alias("o")))])
    here = parent(F.col("path"))
    d = files.withColumn("folder", here).withColumn("root", parent(here)).withColumn("_a", F.try_element_at(alias, F.lower(leaf(here))))
    d = d.withColumn("_ok", suffix(F.col("path")).isin(*FRAME_SUFFIXES))
    known = d.filter(F.col("_a").isNotNull()).select("root", "path", "_ok", F.col("_a.s").alias("set_name"), F.col("_a.o").alias("_o"))
    # existence of a folder counts even when none of its files is readable
    best = known.groupBy("root", "set_name").agg(F.min("_o").alias("_best"))
    picked = known.join(best, ["root", "set_name"]).filter((F.col("_o") == F.col("_best")) & F.col("_ok")).select("root", "set_name", "path")
    # one row per root: does any frame of its chosen lights folder exist?
    roots = cut(
        known.join(best, ["root", "set_name"]).groupBy("root")
        .agg(F.max((F.col("_ok") & (F.col("set_name") == "lights") & (F.col("_o") == F.col("_best"))).cast("int")).alias("_lit"))
    )
    own = d.filter("_ok").select(F.col("folder").alias("root"), F.lit("lights").alias("set_name"), "path")
    return picked.unionByName(own.join(roots.filter("_lit = 0").select("root"), "root", "left_semi"))


def resolve_sets(found: DataFrame, explicit: DataFrame, files: DataFrame) -> DataFrame:
    """Explicit (root, set_name, folder) rows replace the scanned frames of that set."""
    keep = found.join(explicit, ["root", "set_name"], "left_anti")
    listed = files.filter(suffix(F.col("path")).isin(*FRAME_SUFFIXES)).withColumn("folder", parent(F.col("path")))
    return keep.unionByName(listed.join(explicit, "folder").select("root", "set_name", "path"))


def output_root(runs: DataFrame) -> DataFrame:
    """Where a run writes: given folder, else the lights folder's parent, else the first light's folder, else '.'."""
    def known(c):
        return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)

    return runs.withColumn(
        "out_root",
        F.coalesce(known(F.col("folder")), known(parent(F.col("lights_dir"))), known(parent(F.col("first_light"))), F.lit(".")),
    )


# Full-scale value of each integer sample type.
TYPE_MAX = {"uint8": 255.0, "uint16": 65535.0, "int16": 32767.0, "uint32": 4294967295.0, "int32": 2147483647.0}


def normalise_samples(df: DataFrame, raw="raw", dtype="dtype") -> DataFrame:
    """Integers over their type's full scale, floats as they are, clipped to [0, 1]."""
    top = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_MAX.items() for x in kv]), F.col(dtype))
    return df.withColumn("v", clip(F.col(raw).cast("double") / F.coalesce(top, F.lit(1.0))))


def canonical_channels(df: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Drop channels beyond the third and state the channel count that is left."""
    n = df.groupBy(*keys).agg(F.least(F.max("c") + 1, F.lit(3)).cast("int").alias("channels"))
    return df.filter(F.col("c") < 3).join(n, list(keys))


def header_value(key: str, header="header") -> Column:
    """Case-insensitive header lookup; null when missing."""
    upper = F.transform_keys(header, lambda k, v: F.upper(k))
    return F.try_element_at(upper, F.lit(key.upper()))


def capture_time(header="header", mtime="mtime") -> Column:
    """DATE-OBS, else the EXIF original time, else the EXIF time, else the file time to the second."""
    def fits(v):
        return F.try_to_timestamp(F.regexp_replace(F.trim(v), "T", " "))

    def exif(v):
        return F.try_to_timestamp(F.trim(v), F.lit("yyyy:MM:dd HH:mm:ss"))

    return F.coalesce(
        fits(header_value("DATE-OBS", header)), exif(header_value("DateTimeOriginal", header)),
        exif(header_value("DateTime", header)), F.date_trunc("second", mtime),
    )


DECODER_VERSION = "1"


def frame_key(path="path", mtime="mtime", size="bytes", version=DECODER_VERSION) -> Column:
    """Twelve hex digits that change with path, time, size or decoder version."""
    ns = (F.unix_micros(F.col(mtime).cast("timestamp")) * 1000).cast("string")
    return F.substring(F.sha1(F.concat_ws("|", F.col(path), ns, F.col(size).cast("string"), F.lit(version))), 1, 12)


def unseen(arrivals: DataFrame, known: DataFrame, key="frame_key") -> DataFrame:
    """Arrivals whose key is not processed yet: the only rows to decode and measure."""
    return arrivals.join(known.select(key).distinct(), key, "left_anti")


def prune(staged: DataFrame, live: DataFrame, key="frame_key") -> DataFrame:
    """Staged artefacts this run did not produce."""
    return staged.join(live.select(key).distinct(), key, "left_anti")


# --- sinks and their companions


def write_master(master: DataFrame, meta: DataFrame, path: str) -> None:
    """Masters partitioned by target with their contract beside them.

    Rows are spread by (target, row band) first, so a huge target is written by many tasks.
    """
    master.repartition("target_id", F.floor(F.col("y") / 64)).write.mode("overwrite").partitionBy("target_id").parquet(f"{path}/master")
    meta.write.mode("overwrite").parquet(f"{path}/master_meta")


def read_master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/master"), spark.read.parquet(f"{path}/master_meta")


def load_companion(master: DataFrame, companion: DataFrame | None, value: str, keys=("target_id",)) -> DataFrame:
    """Attach a companion map; missing -> null, and a target whose map has another shape -> null."""
    keys = list(keys)
    if companion is None:
        return master.withColumn(value, F.lit(None).cast("double"))
    a = image_dims(master, keys)
    b = image_dims(companion, keys)
    same = a.join(b, [*keys, "_h", "_w"]).select(*keys)
    return master.join(companion.join(same, keys, "left_semi").select(*keys, "y", "x", value), [*keys, "y", "x"], "left")


def quantise(v: Column, bits: int = 16) -> Column:
    """Clip, scale to the integer range and round half to even."""
    return F.rint(clip(v) * float(2**bits - 1)).cast("int")


def read_catalog_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Sky catalog CSV: rows with fewer than eight fields or without a finite position are dropped."""
    schema = "id string, ra string, dec string, mag string, diameter string, axis_ratio string, pos_angle string, common_name string, ngc string, pgc string, _bad string"
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    enough = F.col("_bad").isNull() | (F.size(F.split("_bad", ",")) >= 8)

    def num(c):
        v = F.expr(f"try_cast({c} as double)")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    return raw.filter(enough).select(
        F.trim("id").alias("id"), num("ra").alias("ra"), num("dec").alias("dec"), num("mag").alias("mag"), num("diameter").alias("diameter"),
        num("axis_ratio").alias("axis_ratio"), F.trim(F.coalesce("common_name", F.lit(""))).alias("common_name"), F.lit(source).alias("source"),
    ).filter(F.col("ra").isNotNull() & F.col("dec").isNotNull())


def append_report(report: DataFrame, path: str) -> None:
    """Run reports only ever grow."""
    report.write.mode("append").parquet(path)
