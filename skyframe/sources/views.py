"""Frame-archive tables derived from the given parquet tables, and their SQL twins.

Every view scales with its base table.  ``SQL`` holds the same definitions as text for the
engine the results are compared with.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES_PER_IMAGE = 200  # frames laid out as blocks of one mosaic image
BLOCKS_PER_ROW = 20


class Views:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def frame_tile(self) -> DataFrame:
        """One row per 8x8 frame: the stored vector is the frame's pixels in row order."""
        raw = self.table("embeddings")
        cores = self.spark.sparkContext.defaultParallelism
        if len(raw.inputFiles()) < cores:  # a file or two would keep every later explode in one task
            raw = raw.repartition(cores, "vec_id")
        return raw.select(F.col("label").alias("target_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("data"))

    @cached_property
    def px(self) -> DataFrame:
        return self.frame_tile.select(
            "target_id", "frame_id", F.posexplode("data").alias("pos", "e")
        ).select(
            "target_id",
            "frame_id",
            F.floor(F.col("pos") / 8).cast("int").alias("y"),
            (F.col("pos") % 8).cast("int").alias("x"),
            (F.lit(0.5) + F.col("e").cast("double") / 2).alias("v"),
        )

    @cached_property
    def px_nodata(self) -> DataFrame:
        gap = (F.col("frame_id") + F.col("y") * 3 + F.col("x")) % 17 == 0
        return self.px.withColumn("v", F.when(~gap, F.col("v")))

    def _blocks(self, per_image: int | None):
        f = F.col("frame_id")
        image = (F.floor(f / per_image) if per_image else F.lit(0)).cast("long")
        within = f % per_image if per_image else f
        return image, within

    def mosaic(self, per_image: int | None = FRAMES_PER_IMAGE) -> DataFrame:
        image, within = self._blocks(per_image)
        return self.px.select(
            image.alias("image_id"),
            (F.floor(within / BLOCKS_PER_ROW) * 8 + F.col("y")).cast("int").alias("y"),
            ((within % BLOCKS_PER_ROW) * 8 + F.col("x")).cast("int").alias("x"),
            "v",
        )

    @cached_property
    def mos(self) -> DataFrame:
        return self.mosaic()

    @cached_property
    def mos1(self) -> DataFrame:
        """All frames as one large image."""
        return self.mosaic(None)

    def colour(self, per_image: int | None = FRAMES_PER_IMAGE) -> DataFrame:
        image, within = self._blocks(per_image)

        def ch(shift):
            at = F.array(*[F.lit(p // 8 * 8 + (p + shift) % 8 + 1) for p in range(64)])
            return F.transform(at, lambda i: F.element_at("data", i))

        # the samples are looked up once a frame: as expressions of a pixel row they would be repeated by every column
        # made of them, in generated methods too long to be compiled
        samples = F.posexplode(F.arrays_zip(ch(0).alias("r"), ch(3).alias("g"), ch(5).alias("b"))).alias("pos", "e")
        value = lambda c: (F.lit(0.5) + F.col(f"e.{c}").cast("double") / 2).alias(c)
        return self.frame_tile.select("frame_id", samples).select(
            image.alias("image_id"),
            (F.floor(within / BLOCKS_PER_ROW) * 8 + F.floor(F.col("pos") / 8)).cast("int").alias("y"),
            ((within % BLOCKS_PER_ROW) * 8 + F.col("pos") % 8).cast("int").alias("x"),
            *[value(c) for c in "rgb"],
        )

    @cached_property
    def rgb(self) -> DataFrame:
        return self.colour()

    @cached_property
    def rgb1(self) -> DataFrame:
        return self.colour(None)

    def _sql(self, name: str, *tables: str) -> DataFrame:
        for t in tables:
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(SQL[name])

    @cached_property
    def frame_measure(self) -> DataFrame:
        return self._sql("frame_measure", "orders")

    @cached_property
    def catalog(self) -> DataFrame:
        return self._sql("catalog", "part")

    @cached_property
    def field(self) -> DataFrame:
        return self._sql("field", "supplier")

    @cached_property
    def frame_file(self) -> DataFrame:
        return self._sql("frame_file", "orders")

    @cached_property
    def arrival(self) -> DataFrame:
        return self._sql("arrival", "events")

    @cached_property
    def run_history(self) -> DataFrame:
        return self._sql("run_history", "events")

    @cached_property
    def recipe_json(self) -> DataFrame:
        return self._sql("recipe_json", "events")


# Definitions both engines read as they stand.
SQL = {
    "frame_measure": "select o_orderkey frame_id, o_custkey%50 session_id, cast(o_orderkey*7919%97 as int) stars, 2e0+o_totalprice/200000e0 fwhm, cast(o_orderkey*104729%1000 as double)/1250e0 ecc, cast(o_orderkey*1299709%1000 as double)/10000e0 bg, 0.001e0+cast(o_orderkey*15485863%1000 as double)/100000e0 noise from orders",
    "catalog": "select concat('NGC ',cast(p_partkey as string)) id, (cast(p_partkey as double)*137.507764e0)%360e0 ra, -80e0+cast(p_partkey*61%1600 as double)/10e0 dec, case when p_partkey%11=0 then null else 4e0+p_size/4e0 end mag, case when p_partkey%13=0 then null else p_retailprice/50e0 end diameter, 1e0+p_size/25e0 axis_ratio, p_name common_name, case when p_partkey%10=0 then 'M' else 'NGC/IC' end source from part",
    "field": "select s_suppkey field_id, (cast(s_suppkey as double)*47.3e0)%360e0 ra, -70e0+cast(s_suppkey*37%1400 as double)/10e0 dec, 1e0+cast(s_suppkey%5 as double) fov_radius from supplier",
    "frame_file": "select o_orderkey frame_id, concat('/arch/t',cast(o_custkey%20 as string),'/',case o_orderkey%7 when 0 then 'Lights' when 1 then 'darks' when 2 then 'Flat' when 3 then 'offset' when 4 then 'FlatDarks' when 5 then 'light' else 'misc' end,'/f',cast(o_orderkey as string),case o_orderkey%5 when 0 then '.fits' when 1 then '.TIF' when 2 then '.cr2' when 3 then '.txt' else '.png' end) path, o_orderdate mtime, cast(floor(o_totalprice) as bigint) bytes from orders",
    "arrival": "select event_id, ts, user_id rig_id, substring(sha1(concat(cast(user_id%20 as string),'|',cast(event_id%4000 as string))),1,12) frame_key, value from events",
    "run_history": "select user_id master_id, event_id item_id, case when event_type='purchase' then 1+event_id%5 else 0 end rating, case event_type when 'signup' then 'selected' when 'error' then 'discarded' else 'none' end status, ts from events",
    "recipe_json": "select event_id image_id, concat('{\"recipe\":1,\"satAdj\":',cast(event_id%9-4 as string),',\"cropPercent\":\"bad\",\"doHDR\":',case when event_id%2=0 then 'true' else '1' end,',\"objectClass\":\"',case event_id%4 when 0 then 'galaxy' when 1 then 'emission' when 2 then 'nope' else 'open' end,'\",\"zzz\":3}') j from events",
}

# The pixel views in the comparison engine's own dialect.
DUCK = {
    **SQL,
    "px": "select label target_id, vec_id frame_id, cast((i-1)//8 as int) y, cast((i-1)%8 as int) x, 0.5::double+embedding[i]::double/2 v from (select label,vec_id,embedding,unnest(range(1,65)) i from embeddings)",
    "px_nodata": "select target_id,frame_id,y,x,case when (frame_id+y*3+x)%17=0 then null else v end v from px",
    "mos": "select cast(frame_id//200 as bigint) image_id, cast(((frame_id%200)//20)*8+y as int) y, cast((frame_id%20)*8+x as int) x, v from px",
    "mos1": "select cast(0 as bigint) image_id, cast((frame_id//20)*8+y as int) y, cast((frame_id%20)*8+x as int) x, v from px",
    "rgb": "select a.image_id,a.y,a.x,a.v r,b.v g,c.v b from mos a join mos b on b.image_id=a.image_id and b.y=a.y and b.x=(a.x//8)*8+(a.x+3)%8 join mos c on c.image_id=a.image_id and c.y=a.y and c.x=(a.x//8)*8+(a.x+5)%8",
    "rgb1": "select a.image_id,a.y,a.x,a.v r,b.v g,c.v b from mos1 a join mos1 b on b.image_id=a.image_id and b.y=a.y and b.x=(a.x//8)*8+(a.x+3)%8 join mos1 c on c.image_id=a.image_id and c.y=a.y and c.x=(a.x//8)*8+(a.x+5)%8",
}
_NEEDS = {"px_nodata": ["px"], "mos": ["px"], "mos1": ["px"], "rgb": ["px", "mos"], "rgb1": ["px", "mos1"]}


def with_views(views: str, body: str, more: str = "") -> str:
    """``WITH`` text: the named views, then further CTEs, then the query body."""
    order: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in order:
                order.append(n)
    ctes = [f"{n} as materialized ({DUCK[n]})" for n in order]
    if more:
        ctes.append(more.strip().rstrip(","))
    return "with " + ",\n".join(ctes) + "\n" + body
