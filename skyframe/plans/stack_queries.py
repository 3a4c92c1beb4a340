"""Stacking, calibration and edge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators import calibrate as C
from skyframe.operators import stack as S
from skyframe.plans.catalogue import query, r6, rounded, s6
from skyframe.sources.views import DUCK, _NEEDS

DUCK["px_rgb"] = (
    "select a.target_id,a.frame_id,a.y,a.x,a.v r,b.v g,c.v b from px_nodata a "
    "join px_nodata b on b.target_id=a.target_id and b.frame_id=a.frame_id and b.y=a.y and b.x=(a.x+3)%8 "
    "join px_nodata c on c.target_id=a.target_id and c.frame_id=a.frame_id and c.y=a.y and c.x=(a.x+5)%8"
)
_NEEDS["px_rgb"] = ["px", "px_nodata"]


def px_rgb(v):
    def ch(shift):
        x = (F.col("pos") + shift) % 8
        y = F.floor(F.col("pos") / 8)
        val = F.lit(0.5) + F.element_at("data", (y * 8 + x + 1).cast("int")).cast("double") / 2
        return F.when((F.col("frame_id") + y * 3 + x) % 17 != 0, val)

    return v.frame_tile.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).select(
        "target_id", "frame_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        ch(0).alias("r"), ch(3).alias("g"), ch(5).alias("b"),
    )


def clip_ctes(src, tag="", v="v", low="4e0", high="3e0", floor="0e0", iters=3):
    """CTEs ending in b{tag}{iters}: clip bounds per pixel."""
    out, prev = [], None
    for i in range(1, iters + 1):
        s = (
            f"(select target_id,y,x,{v} v from {src} where {v} is not null)"
            if prev is None
            else f"(select p.target_id,p.y,p.x,p.{v} v from {src} p join {prev} q using(target_id,y,x) where p.{v}>=q.lo and p.{v}<=q.hi)"
        )
        out.append(f"m{tag}{i} as materialized (select target_id,y,x,median(v) m from {s} group by all)")
        out.append(
            f"b{tag}{i} as materialized (select target_id,y,x,m-{low}*s lo,m+{high}*s hi from (select target_id,y,x,m,greatest(1.4826e0*median(abs(v-m)),1e-4,{floor}) s from {s} join m{tag}{i} using(target_id,y,x) group by target_id,y,x,m))"
        )
        prev = f"b{tag}{i}"
    return ",\n".join(out)


CLIP = clip_ctes("px")


@query(
    "a01_sigma_clip_mean", "px",
    f"select target_id,y,x,{s6('least(greatest(avg(v),0e0),1e0)', 'v')},count(*) n_kept from px join b3 using(target_id,y,x) where v>=lo and v<=hi group by target_id,y,x", CLIP,
)
def a01(v):
    """Sigma-clipped master and its survivor counts."""
    return S.integrate(v.px, v.frame_tile).select("target_id", "y", "x", r6("mean_v").alias("v"), F.col("kept").alias("n_kept"))


W = "(1e0+frame_id%5)"
WH = "(1e0+frame_id%3)"


def weighted(v):
    return v.px.withColumn("w", F.lit(1.0) + F.col("frame_id") % 5).withColumn("wh", F.lit(1.0) + F.col("frame_id") % 3)


@query(
    "a02_weighted_clip_mean", "px",
    f"select target_id,y,x,{s6(f'least(greatest(sum(v*{W})/sum({W}),0e0),1e0)', 'v')} from px join b3 using(target_id,y,x) where v>=lo and v<=hi group by target_id,y,x", CLIP,
)
def a02(v):
    return S.integrate(weighted(v), v.frame_tile, weight="w").select("target_id", "y", "x", r6("mean_v").alias("v"))


@query(
    "a03_sharp_band_mean", "px",
    f"select target_id,y,x,{s6(f'least(greatest(sum(v*{W})/sum({W}),0e0),1e0)', 'v')},{s6(f'least(greatest(sum(v*{WH})/sum({WH}),0e0),1e0)', 'v_hi')} from px join b3 using(target_id,y,x) where v>=lo and v<=hi group by target_id,y,x", CLIP,
)
def a03(v):
    return S.integrate(weighted(v), v.frame_tile, weight="w", weight_hi="wh").select(
        "target_id", "y", "x", r6("mean_v").alias("v"), r6("mean_hi_v").alias("v_hi")
    )


@query(
    "a04_coverage", "px_rgb",
    "select target_id,y,x,count(*) filter (r is not null and g is not null and b is not null) coverage from px_rgb group by target_id,y,x",
)
def a04(v):
    return px_rgb(v).groupBy("target_id", "y", "x").agg(
        F.count_if(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()).alias("coverage")
    )


RGB_CLIP = ",\n".join(clip_ctes("px_rgb", t, t) for t in "rgb")
ALIVE = "p.r>=br3.lo and p.r<=br3.hi and p.g>=bg3.lo and p.g<=bg3.hi and p.b>=bb3.lo and p.b<=bb3.hi"
JOINED = "px_rgb p join br3 using(target_id,y,x) join bg3 using(target_id,y,x) join bb3 using(target_id,y,x)"


@query(
    "a05_noise_map", "px_rgb",
    f"select target_id,y,x,{s6(f'stddev_pop((p.r+p.g+p.b)/3e0) filter ({ALIVE})/sqrt(count(*) filter ({ALIVE}))', 'noise')} from {JOINED} group by target_id,y,x", RGB_CLIP,
)
def a05(v):
    return S.integrate(px_rgb(v), v.frame_tile, channels=["r", "g", "b"]).select("target_id", "y", "x", r6("noise").alias("noise"))


_MEANS = ",".join(f"least(greatest(avg(p.{c}) filter (p.{c}>=b{c}3.lo and p.{c}<=b{c}3.hi),0e0),1e0) m{c}" for c in "rgb")
_EX = ",".join(f"case when p.{c} is not null and not (p.{c}>=b{c}3.lo and p.{c}<=b{c}3.hi) and p.{c}>mm.m{c} then p.{c}-mm.m{c} else 0e0 end e{c}" for c in "rgb")


@query(
    "a06_transient", "px_rgb",
    f"select target_id,y,x,{','.join(s6(f'least(max(e{c}),1e0)', f't{c}') for c in 'rgb')},case when max((er+eg+eb)/3e0)>0 then arg_max(frame_id,((er+eg+eb)/3e0,-frame_id)) end frame from ex group by target_id,y,x",
    RGB_CLIP + f",mm as materialized (select target_id,y,x,{_MEANS} from {JOINED} group by target_id,y,x), ex as (select p.target_id,p.y,p.x,p.frame_id,{_EX} from {JOINED} join mm using(target_id,y,x))",
)
def a06(v):
    return S.integrate(px_rgb(v), v.frame_tile, channels=["r", "g", "b"]).select(
        "target_id", "y", "x", *[r6(f"transient_{c}").alias(f"t{c}") for c in "rgb"], F.col("transient_frame").alias("frame")
    )


@query(
    "a07_noise_model_clip", "px",
    f"select target_id,y,x,{s6('least(greatest(avg(v),0e0),1e0)', 'v')} from px join b3 using(target_id,y,x) where v>=lo and v<=hi group by target_id,y,x",
    clip_ctes("px", floor="case when m<=0.5e0 then 0.7e0*sqrt(greatest(0.02e0*m+0.001e0,0e0)) else 0e0 end"),
)
def a07(v):
    return S.integrate(v.px, v.frame_tile, model=(0.02, 0.001, 0.5)).select("target_id", "y", "x", r6("mean_v").alias("v"))


SETS = {"bias": "frame_id%5=0", "dark": "frame_id%5=1", "flat": "frame_id%5=2 and not (frame_id%10=7 and target_id%2=0)", "dark_flat": "frame_id%10=7 and target_id%2=0", "light": "frame_id%5>2"}


def calib_set(v, name):
    return v.px.filter(SETS[name]), v.frame_tile.filter(SETS[name]).select("target_id", "frame_id")


def master(v, name):
    return S.calibration_master(*calib_set(v, name))


def master_ctes(*names):
    out = []
    for n in names:
        out.append(f"s_{n} as materialized (select * from px where {SETS[n]})")
        out.append(clip_ctes(f"s_{n}", n, low="5e0", high="5e0"))
        out.append(f"k_{n} as (select target_id,count(distinct frame_id) nf from s_{n} group by all)")
        out.append(
            f"mst_{n} as materialized (select target_id,y,x,case when any_value(nf)=1 then any_value(v) else least(greatest(avg(v) filter (v>=lo and v<=hi),0e0),1e0) end v from s_{n} join b{n}3 using(target_id,y,x) join k_{n} using(target_id) group by target_id,y,x)"
        )
    return ",\n".join(out)


@query("a08_calibration_master", "px", " union all ".join(f"select '{n}' set_name,target_id,y,x,{s6('v')} from mst_{n}" for n in ("bias", "dark", "flat")), master_ctes("bias", "dark", "flat"))
def a08(v):
    out = None
    for n in ("bias", "dark", "flat"):
        m = master(v, n).select(F.lit(n).alias("set_name"), "target_id", "y", "x", r6("v").alias("v"))
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "j01_calibrate_light", "px",
    f"select l.target_id,frame_id,l.y,l.x,{s6('least(greatest(case when f.v/fm>1e-6 then (l.v-coalesce(d.v,b.v,0e0))/(f.v/fm) else 0e0 end,0e0),1e0)', 'v')} from px l left join mst_dark d using(target_id,y,x) left join mst_bias b using(target_id,y,x) join mst_flat f using(target_id,y,x) join (select target_id,avg(v) fm from mst_flat group by all) using(target_id) where {SETS['light']}",
    master_ctes("bias", "dark", "flat"),
)
def j01(v):
    # odd targets have no dark master, so their bias is used
    light, _ = calib_set(v, "light")
    return rounded(C.calibrate_light(light, bias=master(v, "bias"), dark=master(v, "dark"), flat=master(v, "flat")), "v")


@query(
    "j02_flat_pedestal", "px",
    f"select l.target_id,frame_id,l.y,l.x,{s6('least(greatest(l.v-coalesce(d.v,b.v,0e0),0e0),1e0)', 'v')} from s_flat l left join mst_dark_flat d using(target_id,y,x) left join mst_bias b using(target_id,y,x)",
    master_ctes("bias", "dark_flat") + f",s_flat as (select * from px where {SETS['flat']})",
)
def j02(v):
    return rounded(C.pedestal_flats(calib_set(v, "flat")[0], master(v, "dark_flat"), master(v, "bias")), "v")


@query(
    "j03_shape_guard", "px",
    "select l.target_id,l.frame_id,concat('master dark shape ',mh,'x',mw,' does not match the light frame ',lh,'x',lw) error from (select target_id,frame_id,max(y)+1 lh,max(x)+1 lw from px where not(frame_id%7=3 and y>5) group by all) l join (select target_id,max(y)+1 mh,max(x)+1 mw from px group by all) m using(target_id) where lh<>mh or lw<>mw",
)
def j03(v):
    # every seventh frame lacks its last rows
    return C.shape_guard(v.px.filter("not (frame_id % 7 = 3 and y > 5)"), v.px, "dark")


STATS = "st as materialized (select target_id,frame_id,coalesce(median(v),0e0) med,case when median(v) is null then 1e0 else greatest(1e-6,quantile_cont(v,0.9)-median(v)) end sig from px_nodata group by all)"


@query("a09_frame_stats", "px_nodata", f"select target_id,frame_id,{s6('med')},{s6('sig')} from st", STATS)
def a09(v):
    return rounded(S.frame_stats(v.px_nodata), "med", "sig")


@query(
    "j04_normalize_to_reference", "px_nodata",
    f"select p.target_id,p.frame_id,y,x,{s6('(v-st.med)*least(greatest(r.sig/st.sig,0.5e0),2e0)+r.med', 'v')} from px_nodata p join st using(target_id,frame_id) join (select target_id,min(frame_id) frame_id from px_nodata group by all) q on q.target_id=p.target_id join st r on r.target_id=q.target_id and r.frame_id=q.frame_id",
    STATS,
)
def j04(v):
    ref = v.frame_tile.groupBy("target_id").agg(F.min("frame_id").alias("frame_id"))
    return rounded(S.normalize_to_ref(v.px_nodata, S.frame_stats(v.px_nodata), ref), "v")


COV = "cov as materialized (select target_id,y,x,count(v) coverage from (select target_id,frame_id,y,x,case when (frame_id%3=0 and x=0) or (y=7 and frame_id%2=0) or (x=7 and frame_id%4=1) then null else v end v from px) group by all), ns as (select target_id,count(distinct frame_id) n from px group by all)"


def ragged(v):
    """Frames whose borders are partly uncovered."""
    return v.px.withColumn("v", F.when(~F.expr("(frame_id%3=0 and x=0) or (y=7 and frame_id%2=0) or (x=7 and frame_id%4=1)"), F.col("v")))


def edge_sql(rows, cols, rule):
    one = "select target_id,coalesce(min(line) filter (ok),max(line)+1) lead,max(line)-coalesce(max(line) filter (ok),-1) trail,max(line)+1 n from ({}) group by target_id"
    return (
        f"select t.target_id,{rule('c.lead', 'c.n')} crop_l,{rule('c.trail', 'c.n')} crop_r,{rule('t.lead', 't.n')} crop_t,{rule('t.trail', 't.n')} crop_b "
        f"from ({one.format(rows)}) t join ({one.format(cols)}) c using(target_id)"
    )


_COVLINE = "select target_id,{0} line,avg(case when coverage>=greatest(1,round_even(0.98e0*n,0)) then 1e0 else 0e0 end)>=0.9e0 ok from cov join ns using(target_id) group by target_id,{0}"
COVERAGE_EDGES = edge_sql(_COVLINE.format("y"), _COVLINE.format("x"), lambda r, n: f"cast(least({r},{n}//4) as int)")


def ragged_edges(v):
    cov = ragged(v).groupBy("target_id", "y", "x").agg(F.count("v").alias("coverage"))
    return S.coverage_edges(cov, v.frame_tile.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_sub")))


@query("a26_coverage_edges", "px", COVERAGE_EDGES, COV)
def a26(v):
    return ragged_edges(v)


_DARKLINE = "select target_id,{0} line,not(avg(v)<any_value(dark)) ok from mm join dk using(target_id) group by target_id,{0}"


@query(
    "a27_darkness_edges", "px",
    edge_sql(_DARKLINE.format("y"), _DARKLINE.format("x"), lambda r, n: f"cast(greatest(least({r},{n}//4),floor({n}*0.02e0)) as int)"),
    "mm as materialized (select target_id,y,x,avg(v)*case when (x<target_id%3) or (y>=8-target_id%4) then 1e-3 else 1e0 end v from px group by target_id,y,x), dk as (select target_id,greatest(1e-4,0.25e0*median(v)) dark from mm where y>=2 and y<6 and x>=2 and x<6 group by all)",
)
def a27(v):
    dim = F.expr("case when (x<target_id%3) or (y>=8-target_id%4) then 1e-3 else 1e0 end")
    m = v.px.groupBy("target_id", "y", "x").agg(F.avg("v").alias("v")).withColumn("v", F.col("v") * dim)
    return S.darkness_edges(m)


@query("a48_contract", "px", f"select e.*,n n_sub,{s6('ex', 'exposure')},'0.3.0' version from ({COVERAGE_EDGES}) e join ns using(target_id) join (select target_id,sum(30e0+frame_id%4) ex from (select distinct target_id,frame_id from px) group by all) using(target_id)", COV)
def a48(v):
    frames = v.frame_tile.select("target_id", "frame_id", (F.lit(30.0) + F.col("frame_id") % 4).alias("exposure"))
    return rounded(S.contract(frames, ragged_edges(v)), "exposure")


@query("a49_temporal_median", "px", f"select target_id,y,x,{s6('median(v)', 'v')} from px group by target_id,y,x")
def a49(v):
    return rounded(S.temporal_median(v.px, v.frame_tile), "v")


@query(
    "a31_band_weights", "frame_measure",
    f"select session_id,frame_id,{s6('w/wa', 'w_lo')},{s6('w*s/ha', 'w_hi')} from w join (select session_id,avg(w) wa,avg(w*s) ha from w group by all) using(session_id)",
    """m as (select * from frame_measure),
    k as (select session_id,median(noise) mn,quantile_cont(fwhm,0.1) fb,arg_min(noise,frame_id) rn from m group by all),
    w as (select session_id,frame_id,1e0/pow(greatest(noise*least(greatest(rn/noise,0.5e0),2e0),1e-6),2) w,least(greatest(exp(-0.89e0*(pow(fwhm/greatest(fb,1e-6),2)-1e0)),1e-4),1e0) s from m join k using(session_id))""",
)
def a31(v):
    ref = v.frame_measure.groupBy("session_id").agg(F.min("frame_id").alias("frame_id"))
    return rounded(S.band_weights(v.frame_measure, ref), "w_lo", "w_hi")


@query("a01_tile_stack", "px", f"select target_id,y,x,{s6('least(greatest(avg(v),0e0),1e0)', 'v')} from px join b3 using(target_id,y,x) where v>=lo and v<=hi group by target_id,y,x", CLIP)
def a01_tile(v):
    """The same master from stored tiles: no per-pixel rows are shuffled."""
    tiles = v.frame_tile.select(
        "target_id", F.lit(0).alias("ty"), F.lit(0).alias("tx"),
        F.transform("data", lambda e: F.lit(0.5) + e.cast("double") / 2).alias("data"),
    )
    return S.stack_tiles(tiles, v.frame_tile).select(
        "target_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), r6("v").alias("v")
    )


@query("w05_bad_runs", "frame_measure", "select session_id,coalesce(min(line) filter (ok),max(line)+1)::bigint lead,(max(line)-coalesce(max(line) filter (ok),-1))::bigint trail,(max(line)+1)::bigint n from (select session_id,frame_id%40 line,avg(fwhm)>3.2 ok from frame_measure group by all) group by session_id")
def w05(v):
    """Length of the bad run at each end of every session's 40-line profile."""
    lines = v.frame_measure.groupBy("session_id", (F.col("frame_id") % 40).alias("line")).agg((F.avg("fwhm") > 3.2).alias("ok"))
    return S.lead_trail(lines, ["session_id"], "line", "ok")
