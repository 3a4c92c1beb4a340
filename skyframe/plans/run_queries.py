"""Chains of operators: finishing runs, keyed folder runs, burst runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import math as M
from skyframe.operators import burst, finish, pixel, runs
from skyframe.plans.archive_queries import CULL, cull_sql
from skyframe.plans.catalogue import query, rounded, s6
from skyframe.plans.point_queries import clip_sql
from skyframe.plans.stack_queries import SETS, clip_ctes, master_ctes
from skyframe.session import scratch_path

RGB = ("r", "g", "b")

# images of twenty frames each
_STRIP = """m20 as materialized (select cast(frame_id//20 as bigint) image_id, y, cast((frame_id%20)*8+x as int) x, v from px),
c20 as materialized (select a.image_id,a.y,a.x,a.v r,b.v g,c.v b from m20 a join m20 b on b.image_id=a.image_id and b.y=a.y and b.x=(a.x//8)*8+(a.x+3)%8 join m20 c on c.image_id=a.image_id and c.y=a.y and c.x=(a.x//8)*8+(a.x+5)%8)"""
_GREEN = ",".join(f"case when image_id%3<>0 then {clip_sql(e)} else {c} end {c}" for c, e in zip(RGB, ("r*k", "gn*k", "b*k")))
_CURVE = ",".join(f"{clip_sql(M.piecewise_sql(M.contrast_pieces(0.3, 0.25), clip_sql(c)))} {c}" for c in RGB)


def spoil(d, s, w):
    """Halves the picture; some images cannot be read."""
    bad = F.col("image_id") % 7 == 3
    return d.withColumns({c: F.when(bad, F.raise_error(F.lit("unreadable row"))).otherwise(F.col(c) * 0.5) for c in RGB})


def thin(d, s, w):
    """Loses half of the pixels of some images."""
    return d.where("image_id % 5 <> 2 or x % 2 = 0")


@query(
    "r04_run", "px",
    f"select image_id,y,x,{','.join(s6(c) for c in RGB)},(2+(image_id%3<>0)::int+(image_id%7<>3)::int-(image_id%5=2)::int)::bigint n_run,"
    "concat_ws('; ',case when image_id%3=0 then 'scnr skipped: switched off' end,case when image_id%5=2 then 'thin failed: left 640 of 1280 valid pixels' end,case when image_id%7=3 then 'spoil failed: unreadable row' end) told "
    f"from (select image_id,y,x,{','.join(f'case when image_id%7=3 then {c} else {c}*0.5e0 end {c}' for c in RGB)} from cv)",
    f"{_STRIP}, gr as (select image_id,y,x,{_GREEN} from (select *,case when r+gn+b>0 then (r+g+b)/(r+gn+b) else 1e0 end k from (select *,least(g,0.5e0*(r+b)) gn from c20))), cv as (select image_id,y,x,{_CURVE} from gr)",
)
def r04_run(v):
    """A plan per image carried out: green removal for some, contrast, one step that drops pixels and one that raises."""
    px = v.colour(20)
    images = px.select("image_id").distinct()
    items = [("scnr", F.col("image_id") % 3 != 0, "{}"), ("thin", F.lit(True), "{}"), ("contrast", F.lit(True), '{"pivot":0.3,"contrast":0.25}'), ("spoil", F.lit(True), "{}")]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("step"), run.alias("run"), F.when(~run, "switched off").alias("reason"), F.lit(s).alias("settings")) for i, (n, run, s) in enumerate(items)]
    plan = images.select("image_id", F.explode(F.array(*rows)).alias("s")).select("image_id", "s.*")
    tools = finish.STEPS | {"thin": finish.Step(thin), "spoil": finish.Step(spoil), "contrast": finish.Step(lambda d, s, w: pixel.contrast(d, s["pivot"], s["contrast"]))}
    out, ledger = finish.run_plan(px, plan, steps=tools)
    told = F.when(F.col("outcome") != "run", F.concat("step", F.lit(" "), "outcome", F.lit(": "), "reason"))
    notes = ledger.groupBy("image_id").agg(F.count_if(F.col("outcome") == "run").alias("n_run"), F.array_sort(F.collect_list(F.struct("ord", told.alias("t")))).alias("t"))
    notes = notes.select("image_id", "n_run", F.array_join(F.col("t.t"), "; ").alias("told"))
    return rounded(out.join(notes, "image_id"), *RGB)


def moments_ctes(src, sigma):
    """CTE frame_measure: width, roundness, background and noise of every frame of ``src``, by target."""
    return f"""mq1 as materialized (select target_id,frame_id,median(v) bg from {src} group by all),
mq2 as materialized (select target_id,frame_id,bg,1.4826e0*median(abs(v-bg)) noise from {src} join mq1 using(target_id,frame_id) group by target_id,frame_id,bg),
mq3 as (select target_id,frame_id,bg,noise,count(*) filter (v>bg+noise*{sigma}) stars,sum(p) s,sum(p*y) my,sum(p*x) mx,sum(p*y*y) yy,sum(p*x*x) xx,sum(p*x*y) xy from (select *,greatest(v-bg,0e0) p from {src} join mq2 using(target_id,frame_id)) group by target_id,frame_id,bg,noise),
frame_measure as materialized (select target_id session_id,frame_id,stars,bg,noise,case when s>0 then round(sqrt(greatest((vy+vx)/2e0,0e0))*2.3548e0,6)+0e0 end fwhm,case when s>0 then round(sqrt(pow(vx-vy,2)+c*c*4e0)/greatest(vy+vx,1e-9),6)+0e0 end ecc
  from (select *,yy/s-pow(my/s,2) vy,xx/s-pow(mx/s,2) vx,xy/s-my/s*(mx/s) c from mq3))"""


def six_decimals(px):
    """Measures rounded, so that frames equally far from the median are so in both engines."""
    return rounded(runs.moment_quality(px, 1.5), "fwhm", "ecc")


@query("b05_measured_cull", "px", CULL.format(f",{s6('f.fwhm', 'fwhm')},{s6('f.ecc', 'ecc')},{s6('f.noise', 'noise')},f.stars", ""), moments_ctes("px", "1.5e0") + "," + cull_sql())
def b05_measured(v):
    """Every frame of every target measured from its pixels and judged among the target's frames."""
    told = runs.measure_only(v.px, six_decimals)
    return rounded(told.withColumnRenamed("target_id", "session_id"), "fwhm", "ecc", "noise").select("session_id", "frame_id", "status", "reason", "is_reference", "fwhm", "ecc", "noise", "stars")


_PEDESTAL = f"""s_flat as materialized (select l.target_id,frame_id,l.y,l.x,{clip_sql('l.v-coalesce(d.v,b.v,0e0)')} v from px l left join mst_dark_flat d using(target_id,y,x) left join mst_bias b using(target_id,y,x) where {SETS['flat']})"""
_FLAT = master_ctes("flat").replace(f"s_flat as materialized (select * from px where {SETS['flat']})", _PEDESTAL)
_CAL = f"""cal as materialized (select l.target_id,frame_id,l.y,l.x,{clip_sql('case when f.v is null then l.v-coalesce(d.v,b.v,0e0) when f.v/fm>1e-6 then (l.v-coalesce(d.v,b.v,0e0))/(f.v/fm) else 0e0 end')} v
  from px l left join mst_dark d using(target_id,y,x) left join mst_bias b using(target_id,y,x) left join mst_flat f using(target_id,y,x) left join (select target_id,avg(v) fm from mst_flat group by all) using(target_id) where {SETS['light']})"""
_NORM = f"""kept as materialized (select session_id target_id,frame_id,is_reference from ({CULL.format('', '')}) where status='keep'),
st as materialized (select target_id,frame_id,median(v) med,greatest(1e-6,quantile_cont(v,0.9)-median(v)) sig from cal semi join kept using(target_id,frame_id) group by all),
nm as materialized (select p.target_id,p.frame_id,y,x,(v-st.med)*least(greatest(r.sig/st.sig,0.5e0),2e0)+r.med v from cal p join st using(target_id,frame_id) join (select target_id,frame_id rf from kept where is_reference) q using(target_id) join st r on r.target_id=q.target_id and r.frame_id=q.rf)"""


@query(
    "s12_folder_to_master", "px",
    f"select m.target_id,y,x,{s6('least(greatest(avg(v),0e0),1e0)', 'v')},count(*) n,any_value(n_sub) n_sub,any_value(fresh) measured from nm m join b3 using(target_id,y,x) join (select target_id,count(*) n_sub from kept group by all) using(target_id) "
    f"cross join (select count(*) fresh from (select distinct target_id,frame_id from cal) where frame_id%10=9) where v>=lo and v<=hi group by m.target_id,y,x",
    ",\n".join([master_ctes("bias", "dark", "dark_flat"), _FLAT, _CAL, moments_ctes("cal", "1.5e0"), cull_sql(), _NORM, clip_ctes("nm")]),
)
def s12_folder(v):
    """Masters of every target after a second run with more lights: the first run's frames are not measured again."""
    role = F.lit(None).cast("string")
    for name, rule in SETS.items():
        role = F.when(F.expr(rule), name).otherwise(role)
    frames = v.frame_tile.select("target_id", "frame_id", role.alias("role"), F.sha1(F.concat(F.lit("f"), F.col("frame_id").cast("string"))).alias("frame_key"), F.lit(30.0).alias("exptime"))
    settings, measure = runs.Settings(register=False), six_decimals
    path = scratch_path(v.spark, "archive")
    early = frames.where("role <> 'light' or frame_id % 10 <> 9")
    runs.folder_to_master(early, v.px, runs.Stages(v.spark, path), settings, measure)
    stages = runs.Stages(v.spark, path)
    got = runs.folder_to_master(frames, v.px, stages, settings, measure)
    fresh = stages.counts().where("stage = 'measures'").select(F.col("computed").alias("measured"))
    out = got["master"].join(got["contract"].select("target_id", "n_sub"), "target_id").join(F.broadcast(fresh))
    return rounded(out, "v").select("target_id", "y", "x", "v", "n", "n_sub", "measured")


_GY = ((0.0007, 0.0052, 0.0370, 0.0052, 0.0007), (0.0037, 0.1187, 0.2589, 0.1187, 0.0037))
_KERNEL = [(dy, dx, sign * row[dx + 2]) for dy, sign, row in ((-2, 1, _GY[0]), (-1, 1, _GY[1]), (1, -1, _GY[1]), (2, -1, _GY[0])) for dx in range(-2, 3)]
_TAPS = "tp(dy,dx,ky) as (values " + ",".join(f"({-dy},{-dx},{k!r}::double)" for dy, dx, k in _KERNEL) + ")"
_FADE = lambda c: f"(case {c} when 0 then 0e0 when 3 then 0e0 else 0.5e0 end)"
_POINTS = f"""{_TAPS},
mq as (select target_id,frame_id,median(v) m from px group by all), pz as materialized (select target_id,frame_id,y,x,case when v=0 then m else v end v from px join mq using(target_id,frame_id)),
gy as (select p.target_id,p.frame_id,p.y,p.x,sum(q.v*ky) g from pz p, tp join pz q on q.target_id=p.target_id and q.frame_id=p.frame_id and q.y=least(greatest(p.y+tp.dy,0),7) and q.x=least(greatest(p.x+tp.dx,0),7) group by all),
gx as (select p.target_id,p.frame_id,p.y,p.x,sum(q.v*ky) g from pz p, tp join pz q on q.target_id=p.target_id and q.frame_id=p.frame_id and q.y=least(greatest(p.y+tp.dx,0),7) and q.x=least(greatest(p.x+tp.dy,0),7) group by all),
mg as materialized (select gy.target_id,gy.frame_id,gy.y,gy.x,sqrt(gy.g*gy.g+gx.g*gx.g) m from gy join gx using(target_id,frame_id,y,x)),
wr as (select target_id,frame_id,ay,ax,y-ay i,x-ax j,m,min(m) over w lo,max(m) over w hi from mg,(values (0),(2),(4)) a(ay),(values (0),(2),(4)) b(ax) where y>=ay and y<ay+4 and x>=ax and x<ax+4 window w as (partition by target_id,frame_id,ay,ax)),
wn as materialized (select target_id,frame_id,ay,ax,i,j,(case when hi>lo then (m-lo)/(hi-lo) else 0e0 end)*{_FADE('i')}*{_FADE('j')} t from wr),
rf as (select target_id,min(frame_id) rf from px group by all),
sh as (values (-2),(-1),(0),(1),(2)),
co as (select t.target_id,t.frame_id,t.ay,t.ax,d.col0 dy,e.col0 dx,coalesce(sum(r.t*t.t),0e0) s from wn t join rf on rf.target_id=t.target_id cross join sh d cross join sh e
  left join wn r on r.target_id=t.target_id and r.frame_id=rf.rf and r.ay=t.ay and r.ax=t.ax and r.i=t.i-d.col0 and r.j=t.j-e.col0 group by all),
pk as (select target_id,frame_id,ay,ax,least(min(s),0e0) lo,max(s) hi,arg_max(dy,(s>=mx-1e-9*mx,-(dy*dy+dx*dx),-dy,-dx)) py,arg_max(dx,(s>=mx-1e-9*mx,-(dy*dy+dx*dx),-dy,-dx)) qx from (select *,max(s) over (partition by target_id,frame_id,ay,ax) mx from co) group by target_id,frame_id,ay,ax),
cn as (select co.*,py,qx,case when hi>lo then (s-lo)/(hi-lo) else 0e0 end v from co join pk using(target_id,frame_id,ay,ax)),
c5 as (select target_id,frame_id,ay,ax,any_value(py) py,any_value(qx) qx,max(v) filter (dy=py and dx=qx) c,max(v) filter (dy=py-1 and dx=qx) u,max(v) filter (dy=py+1 and dx=qx) d,max(v) filter (dy=py and dx=qx-1) l,max(v) filter (dy=py and dx=qx+1) r from cn group by all)"""


def _fine(m, p):
    ln = lambda k: f"ln(greatest({k},1e-12))"
    den = f"({ln(m)}-2e0*{ln('c')}+{ln(p)})"
    return f"case when abs({den})>=1e-12 then least(greatest(0.5e0*({ln(m)}-{ln(p)})/{den},-0.5e0),0.5e0) else 0e0 end"


def frames_of(v):
    return v.frame_tile.select("target_id", "frame_id")


@query(
    "j20_point_offsets", "px",
    f"select target_id,frame_id,ay,ax,{s6('qx+' + _fine('l', 'r'), 'dx')},{s6('py+' + _fine('u', 'd'), 'dy')},{s6('q')} from c5 join (select target_id,frame_id,ay,ax,stddev_pop(t) q from wn group by all) using(target_id,frame_id,ay,ax)", _POINTS,
)
def j20_offsets(v):
    """The offset of nine alignment points in every frame, against the target's first frame."""
    reference = v.frame_tile.groupBy("target_id").agg(F.min("frame_id").alias("frame_id"))
    at = F.array(*[F.struct(F.lit(y).alias("ay"), F.lit(x).alias("ax")) for y in (0, 2, 4) for x in (0, 2, 4)])
    points = reference.select("target_id", F.explode(at).alias("p")).select("target_id", "p.ay", "p.ax")
    still = frames_of(v).withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
    return rounded(burst.measure_points(v.px, points, still, reference, 4), "dx", "dy", "q").select("target_id", "frame_id", "ay", "ax", "dx", "dy", "q")
