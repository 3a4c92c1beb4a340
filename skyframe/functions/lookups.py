"""Lookup tables the operators join with, stated as plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Object classes and their profile
# (bkg, clip, sat, contrast, bgLevel, lc, scnr, localContrast, bxt, nr, hdr, hdrLayers, starReduce,
#  starLevel, chromaNR, haloTamer, structure, bgExtract, darkLaneGC, reduceCast).
CLASSES = ["galaxy", "emission", "reflection", "planetary", "globular", "open", "milkyway", "generic"]
PROFILE_FIELDS = [
    "bkg", "clip", "sat", "contrast", "bgLevel", "lc", "scnr", "localContrast", "bxt", "nr", "hdr", "hdrLayers", "starReduce", "starLevel",
    "chromaNR", "haloTamer", "structure", "bgExtract", "darkLaneGC", "reduceCast",
]
PROFILES = {
    "galaxy": (0.16, -1.30, 0.45, 0.12, 0.13, 0.10, True, True, True, True, True, 8, True, 0.60, 0.20, False, 0.60, True, False, False),
    "emission": (0.25, -1.05, 0.55, 0.12, 0.20, 0.15, True, True, True, True, True, None, True, 0.50, 0.30, True, 0.0, True, False, False),
    "reflection": (0.22, -1.15, 0.50, 0.16, 0.14, 0.12, True, True, True, True, False, None, True, 0.60, 0.30, True, 0.0, True, False, False),
    "planetary": (0.18, -1.50, 0.55, 0.14, 0.09, 0.10, True, False, True, True, True, None, False, 0.70, 0.0, True, 0.0, True, False, False),
    "globular": (0.18, -1.60, 0.30, 0.10, 0.10, 0.08, False, False, True, True, False, None, False, 1.00, 0.0, True, 0.0, True, False, False),
    "open": (0.20, -1.50, 0.35, 0.10, 0.10, 0.08, False, False, True, True, False, None, False, 1.00, 0.0, True, 0.0, True, False, False),
    "milkyway": (0.25, -0.95, 0.50, 0.20, 0.30, 0.15, True, True, True, True, True, None, False, 1.00, 0.40, False, 0.0, False, True, True),
    "generic": (0.25, -1.25, 0.40, 0.12, 0.13, 0.12, True, True, True, True, False, None, False, 0.70, 0.25, True, 0.0, True, False, False),
}
# Dial -> (profile field, effective clamp).
DIALS = {
    "satAdj": ("sat", 0.00, 1.50), "brightAdj": ("bkg", 0.05, 0.50), "bgAdj": ("bgLevel", 0.015, 0.40),
    "blackAdj": ("clip", -3.00, -0.20), "contrastAdj": ("contrast", 0.00, 0.40),
}
# Dial ranges clamped when a recipe is loaded; plain 0..1 dials; switches.
RECIPE_RANGES = {
    "satAdj": (-0.5, 0.5), "brightAdj": (-0.10, 0.10), "bgAdj": (-0.25, 0.15), "blackAdj": (-0.5, 0.5), "contrastAdj": (-0.15, 0.15),
    "cropPercent": (0.0, 10.0), "gradientCleanup": (0.0, 1.0), "dehaze": (0.0, 1.0), "smallStars": (0.0, 0.5), "chromaNR": (0.0, 1.0),
    "deepen": (0.0, 1.0), "starsAdj": (-0.3, 0.5),
}
UNIT_DIALS = [
    "highlights", "transparency", "dimCore", "starShrink", "snrProtect", "significance", "meteorStrength", "structure", "deepenBackground",
    "nightscapeBrightness",
]
SWITCHES = [
    "autoAssess", "doBgExtract", "useGradientCorrection", "darkLaneGC", "doColorCal", "preferSPCC", "doBXT", "doNR", "useNRMask", "doSCNR", "doHDR",
    "doStarReduce", "removeStars", "useMask", "adaptiveFloor", "starProtect", "doLocalContrast", "protectCores", "enhanceEmission", "reduceCast",
    "haloTamer", "useClassicalDeconv", "developForeground", "fixChromatic", "inputStretched", "debugBackground",
]
# Classes each predicate applies to.
PREDICATES = {
    "adaptive_floor": ("emission", "generic"),
    "masked_darken": ("emission", "reflection", "generic", "open"),
    "star_protect": ("emission", "reflection", "planetary", "generic"),
}
# Messier numbers by class, and designations of known reflection and emission nebulae.
MESSIER = {
    "galaxy": [31, 32, 33, 49, 51, 58, 59, 60, 61, 63, 64, 65, 66, 74, 77, 81, 82, 83, 84, 85, 86, 87, 88, 89, 90, 91, 94, 95, 96, 98, 99, 100, 101, 102, 104, 105, 106, 108, 109, 110],
    "globular": [2, 3, 4, 5, 9, 10, 12, 13, 14, 15, 19, 22, 28, 30, 53, 54, 55, 56, 62, 68, 69, 70, 71, 72, 75, 79, 80, 92, 107],
    "open": [6, 7, 11, 18, 21, 23, 25, 26, 29, 34, 35, 36, 37, 38, 39, 41, 44, 45, 46, 47, 48, 50, 52, 67, 93, 103],
    "emission": [8, 16, 17, 20, 42, 43, 1],
    "planetary": [27, 57, 76, 97],
    "reflection": [78],
}
NEBULAE = {
    "reflection": {"IC": [348, 349, 431, 435, 446, 447, 2118, 2631, 4592, 4601], "NGC": [1333, 1435, 1973, 1975, 1977, 2023, 2068, 2071, 2170, 6726, 6727, 6729, 7023, 7129]},
    "emission": {"IC": [405, 410, 417, 443, 1318, 1396, 1805, 1848, 2177, 5068, 5070, 5146], "NGC": [281, 896, 1491, 1499, 2024, 2174, 2237, 2264, 6334, 6357, 6820, 6888, 6960, 6992, 6995, 7000, 7538, 7635, 7822]},
}
# Curated settings by designation.
PRESETS = [
    (["M42", "M43"], "Orion Nebula", {"dehaze": 0.1, "gradientCleanup": 0.4}),
    (["IC434", "NGC2023", "NGC2024", "IC431", "IC432", "IC435"], "Horsehead / Flame region", {"satAdj": 0.18, "brightAdj": 0.01, "bgAdj": 0.08, "blackAdj": -0.19, "contrastAdj": 0.15, "gradientCleanup": 0.5, "dehaze": 0.79, "starsAdj": 0.5, "reduceCast": True}),
    (["IC1318", "NGC6910"], "Sadr region (wall-to-wall Ha)", {"autoAssess": False, "cropPercent": 10, "bgAdj": 0.12, "useMask": False, "adaptiveFloor": False, "darkLaneGC": True, "doSCNR": True, "gradientCleanup": 0.5, "dehaze": 0.15, "satAdj": 0.3, "reduceCast": False}),
    (["IC2118"], "Witch Head Nebula", {"satAdj": 0.4, "brightAdj": 0.02, "bgAdj": 0.15, "blackAdj": 0.08, "contrastAdj": 0.15, "gradientCleanup": 0.4, "dehaze": 0.4, "smallStars": 0.35, "starsAdj": 0.3, "useMask": False, "adaptiveFloor": False, "reduceCast": False, "enhanceEmission": True, "darkLaneGC": True}),
    (["NGC2237", "NGC2238", "NGC2239", "NGC2244", "NGC2246"], "Rosette Nebula", {"satAdj": 0.2, "contrastAdj": 0.12}),
]
# Palettes offered per data type.
PALETTES = {"narrowband": ["SHO (Hubble)", "HOO", "HOS"], "osc": ["Natural RGB", "SHO (Hubble)", "HOO"], "broadband": ["RGB", "LRGB"]}
OTHER_PALETTES = ["RGB", "LRGB", "SHO (Hubble)", "HOO", "HOS"]
# Frame sets, accepted folder names in order, readable and raw suffixes.
SET_ALIASES = {
    "lights": ["lights", "light"], "darks": ["darks", "dark"], "flats": ["flats", "flat"], "biases": ["biases", "bias", "offset", "offsets"],
    "dark_flats": ["dark_flats", "darkflats", "dark_flat", "darkflat", "flat_darks", "flatdarks", "flat_dark", "flatdark", "dark flats", "flat darks"],
}
FRAME_SUFFIXES = [".xisf", ".fits", ".fit", ".fts", ".tif", ".tiff", ".png"]
RAW_SUFFIXES = [".cr2", ".cr3", ".nef", ".arw", ".raf", ".dng", ".orf", ".rw2", ".pef", ".srw", ".raw"]
LOOKUP_VERSION = 1


def class_profiles(spark: SparkSession) -> DataFrame:
    """Eight rows, one per class."""
    kinds = {"hdrLayers": "int"}
    bools = {"scnr", "localContrast", "bxt", "nr", "hdr", "starReduce", "haloTamer", "bgExtract", "darkLaneGC", "reduceCast"}
    schema = "object_class string, " + ", ".join(f"{f} {kinds.get(f, 'boolean' if f in bools else 'double')}" for f in PROFILE_FIELDS)
    return spark.createDataFrame([(c, *PROFILES[c]) for c in CLASSES], schema)


def load_lookup(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One section of a versioned JSON lookup as (name, value) rows; other versions are refused."""
    doc = spark.read.option("multiLine", True).json(path)
    ok = F.when(F.col("schema_version") == LOOKUP_VERSION, F.col(section)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported lookup version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))))
    )
    as_map = F.from_json(F.to_json(ok), "map<string,string>")
    return doc.select(F.explode(as_map).alias("name", "value"))
