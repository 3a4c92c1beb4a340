"""Sensor repair, components, trails, stars and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators import calibrate as C
from skyframe.operators import stars as S
from skyframe.operators import trails as R
from skyframe.operators.components import label_components
from skyframe.operators.overlap import image_dims
from skyframe.operators.stats import mean_of
from skyframe.plans.catalogue import query, rounded, s6
from skyframe.plans.point_queries import clip_sql, per
from skyframe.plans.stencil_queries import LUM, gauss_sql, opening_sql, pix, rank_sql
from skyframe.functions.ranking import top_k
from skyframe.sources.views import with_views

RGB = ("r", "g", "b")

def components_sql(name, mask):
    """Component label (smallest y*2^31+x) of a sparse mask by flood fill."""
    return f"""{name}p as materialized (select *,y::bigint*2147483648+x id from {mask}),
    {name}e as materialized (select a.image_id,a.id a,b.id b from (select image_id,id,y+dy ny,x+dx nx from {name}p cross join (values (-1),(0),(1)) p(dy) cross join (values (-1),(0),(1)) q(dx)) a join {name}p b on b.image_id=a.image_id and b.y=a.ny and b.x=a.nx),
    {name}w(image_id,id,label) as (select image_id,id,id from {name}p union select e.image_id,e.b,w.label from {name}w w join {name}e e on e.image_id=w.image_id and e.a=w.id where w.label<e.b),
    {name} as materialized (select image_id,id//2147483648 y,id%2147483648 x,min(label) label from {name}w group by all)"""


# every frame as its own small image, its id packed into one key
FRM = "fr as materialized (select target_id*1000000+frame_id image_id,y,x,case when (y*8+x+target_id)%23=0 then 0.95e0 else v end v from px)"


def spiked(v):
    """Frames with the same few pixels of every target burnt in."""
    return v.px.withColumn("v", F.when((F.col("y") * 8 + F.col("x") + F.col("target_id")) % 23 == 0, F.lit(0.95)).otherwise(F.col("v")))


STATIC = FRM + "," + rank_sql("md", "fr", "v", 3, "median", "nearest") + """, rs as materialized (select image_id,y,x,fr.v-md.v r from fr join md using(image_id,y,x)),
sg as (select image_id,1.4826e0*median(abs(r-m))+1e-9 s from rs join (select image_id,median(r) m from rs group by all) using(image_id) group by image_id),
hc as (select image_id//1000000 target_id,y,x,count(*) filter (r>5e0*s) hot,count(*) filter (r<-5e0*s) cold,count(*) n from rs join sg using(image_id) group by all),
bad as materialized (select target_id,y,x,hot,cold from hc where n>=3 and (hot>=greatest(2,ceil(0.65e0*n)) or cold>=greatest(2,ceil(0.65e0*n))))"""


@query("a22_static_pixels", "px", "select target_id,y,x,hot,cold from bad", STATIC)
def a22(v):
    return C.static_pixels(spiked(v), v.frame_tile.select("target_id", "frame_id"))


@query("a22_static_repair", "px", f"select fr.image_id//1000000 target_id,fr.image_id%1000000 frame_id,fr.y,fr.x,{s6('case when bad.y is not null then md.v else fr.v end', 'v')} from fr join md using(image_id,y,x) left join bad on bad.target_id=fr.image_id//1000000 and bad.y=fr.y and bad.x=fr.x", STATIC)
def a22b(v):
    s = spiked(v)
    return rounded(C.repair_pixels(s, C.static_pixels(s, v.frame_tile.select("target_id", "frame_id"))), "v")




@query("g01_components", None, f"""with recursive px as (select label target_id, vec_id frame_id, cast((i-1)//8 as int) y, cast((i-1)%8 as int) x, 0.5::double+embedding[i]::double/2 v from (select label,vec_id,embedding,unnest(range(1,65)) i from embeddings)),
mos as materialized (select cast(frame_id//200 as bigint) image_id, cast(((frame_id%200)//20)*8+y as int) y, cast((frame_id%20)*8+x as int) x, v from px), mk as materialized (select image_id,y,x from mos where v>0.62),
{components_sql('cc', 'mk')} select image_id,cast(y as int) y,cast(x as int) x,label from cc""")
def g01(v):
    return label_components(v.mos.filter("v > 0.62"))


@query(
    "a23_cosmetic_repair", None,
    f"""with recursive px as (select label target_id, vec_id frame_id, cast((i-1)//8 as int) y, cast((i-1)%8 as int) x, 0.5::double+embedding[i]::double/2 v from (select label,vec_id,embedding,unnest(range(1,65)) i from embeddings)),
mos as materialized (select cast(frame_id//200 as bigint) image_id, cast(((frame_id%200)//20)*8+y as int) y, cast((frame_id%20)*8+x as int) x, v from px), {rank_sql('md', 'mos', 'v', 3, 'median', 'nearest')},
rs as materialized (select image_id,y,x,mos.v-md.v r from mos join md using(image_id,y,x)), sg as (select image_id,1.4826e0*median(abs(r-m))+1e-9 s from rs join (select image_id,median(r) m from rs group by all) using(image_id) group by image_id),
mk as materialized (select image_id,y,x from rs join sg using(image_id) where abs(r)>3e0*s and abs(r)>1e-6),
{components_sql('cc', 'mk')}, sm as (select image_id,label from cc group by all having count(*)<=12), fx as (select image_id,y,x from cc join sm using(image_id,label))
select mos.image_id,mos.y,mos.x,{s6(clip_sql('case when fx.y is not null then md.v else mos.v end'), 'v')} from mos join md using(image_id,y,x) left join fx on fx.image_id=mos.image_id and fx.y=mos.y and fx.x=mos.x""",
)
def a23(v):
    return pix(C.cosmetic_correct(v.mos), "v")


def band_sql(out, src, at):
    return f"""{out}p as (select image_id,{at} p,median(v) m from {src} group by all), {out}n as (select image_id,max(p) last from {out}p group by all),
    {out}k as materialized (select a.image_id,a.p,least(greatest(a.p+d,0),last) q from {out}p a join {out}n using(image_id) cross join (select d from range(-12,13) r(d))),
    {out}v as (select a.image_id,a.p,any_value(s.m)-avg(b.m) dev from {out}k a join {out}p b on b.image_id=a.image_id and b.p=a.q join {out}p s on s.image_id=a.image_id and s.p=a.p group by a.image_id,a.p),
    {out} as materialized (select s.image_id,s.y,s.x,s.v-dev v from {src} s join {out}v k on k.image_id=s.image_id and k.p=s.{at})"""


@query("a24_banding", "mos", f"select image_id,y,x,{s6(clip_sql('v'), 'v')} from b2", band_sql("b1", "mos", "x") + "," + band_sql("b2", "b1", "y"))
def a24(v):
    return pix(C.suppress_banding(v.mos), "v")


@query(
    "a25_periodic_grid", "mos", f"select mos.image_id,mos.y,mos.x,{s6(clip_sql('mos.v-g'), 'v')} from mos join cl on cl.image_id=mos.image_id and cl.cy=mos.y%6 and cl.cx=mos.x%6",
    rank_sql("av", "mos", "v", 7, "avg", "reflect") + ", cl as (select mos.image_id,mos.y%6 cy,mos.x%6 cx,median(mos.v-av.v) g from mos join av using(image_id,y,x) join avd using(image_id) where mos.y<(h//6)*6 and mos.x<(wd//6)*6 group by all)",
)
def a25(v):
    return pix(C.remove_grid(v.mos), "v")


# --- trails: frames whose light holds one streak each


def transient(v):
    """Transient map of every image: faint noise from mixed frames plus one bright thin streak."""
    on = (F.col("y") * 3 - F.col("x") + F.col("image_id") * 2).between(-32, -30) & (F.col("x") > 40) & (F.col("x") < 118)
    return v.mos.select(
        "image_id", "y", "x", F.when(on, 0.2 + F.col("v") * 0.05).otherwise(F.col("v") * 0.004).alias("v"),
        F.when(on, F.col("image_id") + 7).when((F.col("x") * 7 + F.col("y") * 3) % 50 == 0, F.col("y") % 11).cast("long").alias("frame"),
    )


def found(v):
    t = transient(v)
    return t, R.detect_trails(t, ["image_id"], max_frac=0.1)


def recursive(views, body, ctes):
    """Comparison SQL whose CTEs may refer to themselves."""
    return with_views(views, body, ctes).replace("with ", "with recursive ", 1)


def _shift(mask, out, cells, image="image_id"):
    """Sparse mask grown by offsets, kept inside the image."""
    offs = ",".join(f"({dy},{dx})" for dy, dx in cells)
    return f"{out} as materialized (select distinct {image},y+dy y,x+dx x from {mask} cross join (values {offs}) o(dy,dx) join dm using({image}) where y+dy>=0 and x+dx>=0 and y+dy<h and x+dx<wd)"


_DIAMOND = lambda r: [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a) + abs(b) <= r]
_STREAK = "(y*3-x+image_id*2 between -32 and -30 and x>40 and x<118)"
TRAILS = f"""tr as materialized (select image_id,y,x,case when {_STREAK} then 0.2e0+v*0.05e0 else v*0.004e0 end v,case when {_STREAK} then image_id+7 when (x*7+y*3)%50=0 then y%11 end frame from mos),
dm as materialized (select image_id,max(y)+1 h,max(x)+1 wd from tr group by all),
tm as (select image_id,median(v) m from tr group by all), th as (select image_id,greatest(0.006e0,median(abs(v-m))*(8e0*1.4826e0)) t from tr join tm using(image_id) group by image_id),
br as materialized (select image_id,y,x from tr join th using(image_id) where v>t),
{components_sql('ca', 'br')}, se as materialized (select image_id,y,x from ca where (image_id,label) in (select (image_id,label) from ca group by image_id,label having count(*)>=6)),
{_shift('se', 'gw', _DIAMOND(2))}, {components_sql('cb', 'gw')},
mo as (select image_id,label,count(*) area,min(y) y0,min(x) x0,max(y) y1,max(x) x1,avg(y) cy,avg(x) cx,var_pop(y) vy,var_pop(x) vx,covar_pop(y,x) c from cb group by image_id,label),
ev as (select *,sqrt(greatest((vy+vx)/2e0+sqrt(pow((vx-vy)/2e0,2)+c*c),1e-9)) ma,sqrt(greatest((vy+vx)/2e0-sqrt(pow((vx-vy)/2e0,2)+c*c),1e-9)) mi,atan2(c*2e0,vx-vy)/2e0 angle from mo),
sp as materialized (select *,case when area<3 then 1e0 else ma/greatest(mi,1e-6) end aspect,case when area<3 then 0e0 else ma*4e0 end length from ev),
so as (select sp.* from sp join dm using(image_id) where area>=20 and area<=floor(h*wd*0.1e0) and aspect>=4e0 and length>=40e0),
rw as materialized (select cb.image_id,cb.y,cb.x,label,v,frame from cb join so using(image_id,label) join tr on tr.image_id=cb.image_id and tr.y=cb.y and tr.x=cb.x),
fs as (select image_id,label,frame,count(*) n from rw where frame is not null group by all),
do_ as (select image_id,label,arg_max(frame,(n,-frame)) frame,max(n)*1e0/sum(n) share from fs group by image_id,label),
tl as materialized (select so.*,d.frame,share,peak,row_number() over (partition by so.image_id order by so.label) trail_id from so join do_ d using(image_id,label) join (select image_id,label,max(v) peak from rw group by all) using(image_id,label) where share>=0.6e0)"""
_TRAIL_PX = f"""tp as materialized (select rw.image_id,y,x,trail_id from rw join tl using(image_id,label)),
{_shift('tp', 'g3', _DIAMOND(3))}, on_ as materialized (select tr.image_id,tr.y,tr.x,case when g3.y is null then 0e0 else 1e0 end v from tr left join g3 using(image_id,y,x)),
{gauss_sql('sm', 'on_', 'v', 2.0)},
nr as (select image_id,y,x,max(trail_id) trail_id from (select tp.image_id,tp.y+a.i y,tp.x+b.i x,trail_id from tp,range(-3,4) a(i),range(-3,4) b(i)) group by all),
la as materialized (select tr.image_id,tr.y,tr.x,tr.v*{clip_sql('sm.v')} v,{clip_sql('sm.v')} mask,coalesce(nr.trail_id,0) trail_id from tr join sm using(image_id,y,x) left join nr using(image_id,y,x))"""


@query("g02_trails", None, recursive("mos", "select image_id,trail_id::int trail_id,frame,area,round(aspect,2) aspect,round(length,1) length,round(share,2) single_frame_frac,peak,y0::int y0,x0::int x0,y1::int y1,x1::int x1,cy,cx from tl", TRAILS))
def g02(v):
    """The planted streak of every image with its frame, shape and box."""
    return found(v)[1][0].drop("label", "angle")


@query("g03_trail_layer", None, recursive("mos", f"select image_id,y,x,{s6('v')},{s6('mask')},trail_id::int trail_id from la", TRAILS + "," + _TRAIL_PX))
def g03(v):
    t, (_, px) = found(v)
    return rounded(R.trail_layer(t, px, ["image_id"]), "v", "mask")


def layer(v):
    """A light layer with trail ids on diagonal bands."""
    band = F.floor((F.col("y") * 2 + F.col("x")) / 30)
    tid = F.when(band % 3 == 1, (band % 2 + 1).cast("int")).otherwise(0)
    return v.mos.select("image_id", "y", "x", (F.col("v") * 0.1).alias("v"), tid.alias("trail_id"))


LAY = "ly as materialized (select image_id,y,x,v*0.1e0 v,case when ((y*2+x)//30)%3=1 then ((y*2+x)//30)%2+1 else 0 end trail_id from mos)"


@query("p32_develop_trails", "mos", f"select image_id,y,x,{s6('case when l>1e-6 then ' + clip_sql('0.75e0*0.8e0*asinh(l/greatest(q,1e-4)*10e0)/asinh(10e0)') + ' else 0e0 end', 'v')} from s join (select image_id,quantile_cont(l,0.995) q from s where l>1e-6 group by all) using(image_id)", LAY + ", s as materialized (select *,case when trail_id=1 then v else 0e0 end l from ly)")
def p32(v):
    ids = v.mos.select("image_id").distinct().withColumn("trail_id", F.lit(1))
    return pix(R.develop_trails(R.select_trails(layer(v), ids, ["image_id"]), 0.8, keys=["image_id"]), "v")


_BORDER = lambda e: f"({e}.y<=3 or {e}.x<=3 or {e}.y>=h-4 or {e}.x>=wd-4)"
_RAMP = lambda d, f: f"(case when {f}<=0 then 1e0 else pow({clip_sql(f'({d})/({f}*k)')},2)*(3e0-2e0*{clip_sql(f'({d})/({f}*k)')}) end)"
TAPER = f"""de as materialized (select image_id,y,x,trail_id,case when l.v>1e-6 then {clip_sql('asinh(l.v/greatest(q,1e-4)*10e0)/asinh(10e0)*0.75e0')} else 0e0 end v from la l left join (select image_id,quantile_cont(v,0.995) q from la where v>1e-6 group by all) using(image_id)),
tmo as (select image_id,trail_id,count(*) area,avg(y) cy,avg(x) cx,var_pop(y) vy,var_pop(x) vx,covar_pop(y,x) c from de where trail_id>0 group by all having count(*)>=8),
tt as materialized (select de.*,(x-cx)*cos(a)+(y-cy)*sin(a) t from de join (select *,atan2(c*2e0,vx-vy)/2e0 a from tmo) using(image_id,trail_id)),
te as (select image_id,trail_id,min(t) t0,max(t) t1,arg_min({{'y':y,'x':x}},(t,y,x)) ea,arg_max({{'y':y,'x':x}},(t,y,x)) ez from tt group by all),
tq as (select image_id,trail_id,any_value(t0) t0,any_value(t1) t1,any_value(ea) ea,any_value(ez) ez,quantile_cont(v,0.5) filter (t<=t0+(t1-t0)/3e0) q0,quantile_cont(v,0.5) filter (t>=t1-(t1-t0)/3e0) q1 from tt join te using(image_id,trail_id) group by image_id,trail_id),
tf as (select *,least(least(greatest((t1-t0)*0.12e0,25e0),180e0),(t1-t0)*0.5e0) base,case when greatest(q0,q1)>1e-6 then (1e0-least(q0,q1)/greatest(q0,q1))*0.6e0 else 0e0 end skew from tq),
tg as (select tf.*,case when {_BORDER('ea')} then 0e0 else least(greatest(base*(case when q0<=q1 then skew+1e0 else 1e0-skew*0.6e0 end),8e0),180e0) end f0,case when {_BORDER('ez')} then 0e0 else least(greatest(base*(case when q0<=q1 then 1e0-skew*0.6e0 else skew+1e0 end),8e0),180e0) end f1 from tf join dm using(image_id)),
tk as (select *,case when f0+f1>t1-t0 then (t1-t0)/(f0+f1) else 1e0 end k from tg)"""


@query(
    "w14_trail_taper", None,
    recursive("mos", f"select de.image_id,de.y,de.x,{s6('de.v*coalesce(en,1e0)', 'v')} from de left join (select image_id,y,x,case when t1-t0<1 then 1e0 else {_RAMP('t-t0', 'f0')}*{_RAMP('t1-t', 'f1')} end en from tt join tk using(image_id,trail_id)) using(image_id,y,x)", TRAILS + "," + _TRAIL_PX + "," + TAPER),
)
def w14(v):
    t, (_, px) = found(v)
    lay = R.trail_layer(t, px, ["image_id"])
    return rounded(R.taper(R.develop_trails(lay, keys=["image_id"]), ["image_id"]).select("image_id", "y", "x", "v"), "v")


# --- stars

SHARP = "sh as materialized (select image_id,y,x," + ",".join(f"least(pow({c},16)*1000e0,1e0) {c}" for c in RGB) + " from rgb), lm as materialized (select image_id,y,x,(r+g+b)/3e0 v from sh)"


def sharp(v):
    """A colour image whose bright tail stands out like stars."""
    return v.rgb.withColumns({c: F.least(F.pow(c, 16) * 1000.0, F.lit(1.0)) for c in RGB})


PEAKS = SHARP + "," + opening_sql("op", "lm", "v", 7) + f", ht as materialized (select image_id,y,x,{clip_sql('lm.v-op.v')} v from lm join op using(image_id,y,x))," + rank_sql("mx", "ht", "v", 5, "max", "reflect") + """,
sm as (select image_id,median(v) m,quantile_cont(v,0.995) q from ht group by all), sn as (select image_id,any_value(q) q,1.4826e0*median(abs(v-m))+1e-6 nz from ht join sm using(image_id) group by image_id),
pk as materialized (select ht.image_id,ht.y,ht.x,ht.v flux from ht join mx using(image_id,y,x) join sn using(image_id) where ht.v>=mx.v and ht.v>greatest(6e0*nz,q))"""


@query("t06_star_peaks", "rgb", f"select image_id,y,x,{s6('flux')} from pk", PEAKS)
def t06(v):
    return pix(S.star_peaks(sharp(v), mean_of(RGB)), "flux")


GREEDY = PEAKS + """, sw as (select image_id,pow(sqrt(pow(max(y)+1,2)+pow(max(x)+1,2))*0.01e0,2) s2 from sh group by all),
po as materialized (select pk.*,row_number() over (partition by image_id order by flux desc,y,x) rn from pk),
gr(image_id,rn,kept) as (select distinct image_id,0::bigint,[]::struct(y int,x int)[] from po union all select gr.image_id,gr.rn+1,case when len(list_filter(kept,lambda k: (k.y-c.y)*(k.y-c.y)+(k.x-c.x)*(k.x-c.x)<s2))=0 then list_append(kept,{'y':c.y,'x':c.x}) else kept end from gr join po c on c.image_id=gr.image_id and c.rn=gr.rn+1 join sw on sw.image_id=gr.image_id),
ks as (select image_id,k.y y,k.x x from (select image_id,unnest(kept) k from gr where rn=(select max(rn) from po where po.image_id=gr.image_id))),
ds as (select ks.image_id,ks.y,ks.x,flux,r,g,b,row_number() over (partition by ks.image_id order by flux desc,ks.y,ks.x) star_id,max(flux) over (partition by ks.image_id) mx from ks join pk using(image_id,y,x) join sh using(image_id,y,x))"""


@query("t06_detect_stars", None, recursive("rgb", f"select image_id,y,x,{s6('flux')},{s6('r')},{s6('g')},{s6('b')},star_id::int star_id,{s6('flux/greatest(mx,1e-6)', 'rel_flux')} from ds where star_id<=40", GREEDY))
def t06b(v):
    """Separated, ranked stars, beside a sequential pass over the peaks."""
    return rounded(S.detect_stars(sharp(v)), "flux", "rel_flux", *RGB)


@query(
    "j19_min_separation", None,
    f"""with recursive px as (select label target_id, vec_id frame_id, cast((i-1)//8 as int) y, cast((i-1)%8 as int) x, 0.5::double+embedding[i]::double/2 v from (select label,vec_id,embedding,unnest(range(1,65)) i from embeddings)),
cand as materialized (select cast(frame_id//200 as bigint) image_id, cast(((frame_id%200)//20)*8+y as int) y, cast((frame_id%20)*8+x as int) x, v, row_number() over (partition by frame_id//200 order by v desc,((frame_id%200)//20)*8+y,(frame_id%20)*8+x) rn from px where v>0.6),
g(image_id,rn,kept) as (select distinct image_id,0::bigint,[]::struct(y int,x int,f double)[] from cand union all select g.image_id,g.rn+1,case when len(list_filter(kept,lambda k: (k.y-c.y)*(k.y-c.y)+(k.x-c.x)*(k.x-c.x)<36))=0 then list_append(kept,{{'y':c.y,'x':c.x,'f':c.v}}) else kept end from g join cand c on c.image_id=g.image_id and c.rn=g.rn+1)
select image_id,k.y y,k.x x,{s6('k.f', 'flux')} from (select image_id,unnest(kept) k from g where rn=(select max(rn) from cand c where c.image_id=g.image_id))""",
)
def j19(v):
    """Checked against a sequential pass over the candidates, brightest first."""
    p = v.mos.filter("v > 0.6").select("image_id", "y", "x", F.col("v").alias("flux"))
    sep = image_dims(v.mos, ["image_id"]).select("image_id", F.lit(6.0).alias("sep"))
    return rounded(S.suppress_close(p, sep), "flux")


_WINS = ",".join([rank_sql("wl", "lm", "v", 15, "max", "reflect")] + [rank_sql(f"w{c}", "rgb", c, 15, "max", "reflect") for c in RGB])
SEED = LUM + "," + _WINS + """, sq as (select image_id,quantile_cont(v,0.995) t from lm group by all),
sd as materialized (select image_id,y,x,flux,row_number() over (partition by image_id order by flux desc,y,x) star_id from (select lm.image_id,lm.y,lm.x,lm.v flux from lm join wl using(image_id,y,x) join wr using(image_id,y,x) join wg using(image_id,y,x) join wb using(image_id,y,x) join sq using(image_id) join wld using(image_id)
where lm.v=wl.v and lm.v>t and lm.y>7 and lm.y<h-7 and lm.x>7 and lm.x<wd-7 and wl.v<0.98e0 and least(wr.v,wg.v,wb.v)>=t*0.15e0))"""


@query("t06_seed_stars", "rgb", f"select image_id,y,x,{s6('flux')},star_id from sd where star_id<=400", SEED)
def t06c(v):
    return rounded(S.seed_stars(v.rgb).select("image_id", "y", "x", "flux", F.col("star_id").cast("long").alias("star_id")), "flux")


_CEN = "sum(({c}-n{c})*dy)/sum({c}-n{c}) y{c},sum(({c}-n{c})*dx)/sum({c}-n{c}) x{c},sum(({c}-n{c})*(dy*dy+dx*dx))/sum({c}-n{c}) q{c}"


@query(
    "j15_star_windows", "rgb",
    f"select image_id,star_id,{s6('yr-yb', 'dy_r')},{s6('xr-xb', 'dx_r')},{s6('yg-yb', 'dy_g')},{s6('xg-xb', 'dx_g')},{','.join(s6(f'sqrt(greatest(q{c}-y{c}*y{c}-x{c}*x{c},1e-6)/2e0)', f'sigma_{c}') for c in RGB)} from (select image_id,star_id,{','.join(_CEN.format(c=c) for c in RGB)} from wn group by all)",
    SEED + ", w0 as materialized (select sd.image_id,star_id,rgb.y-sd.y dy,rgb.x-sd.x dx,r,g,b from sd join rgb on rgb.image_id=sd.image_id and rgb.y between sd.y-7 and sd.y+7 and rgb.x between sd.x-7 and sd.x+7 where star_id<=400), wn as materialized (select w0.*,nr,ng,nb from w0 join (select image_id,star_id,min(r) nr,min(g) ng,min(b) nb from w0 group by all) using(image_id,star_id))",
)
def j15(v):
    d = S.measure_offsets(v.rgb, S.seed_stars(v.rgb))
    cols = ["dy_r", "dx_r", "dy_g", "dx_g", *[f"sigma_{c}" for c in RGB]]
    return rounded(d.select("image_id", F.col("star_id").cast("long").alias("star_id"), *cols), *cols)


@query("j16_chromatic_correction")
def j16(v):
    return pix(S.correct_offsets(v.rgb), *RGB)


@query("a14_frame_quality")
def a14(v):
    return rounded(S.frame_quality(sharp(v)), "fwhm", "ecc", "bg", "noise", "snr")


@query("a45_star_census")
def a45(v):
    return rounded(S.star_census(sharp(v)), "per_mpx", "median_diameter")


RMAX, NB = 48, 6
PICK = "st as materialized (select image_id,y sy,x sx,row_number() over (partition by image_id order by r desc,y,x) star_id from rgb)"


def picks(v, n=12):
    return top_k(v.rgb, ["image_id"], [F.col("r").desc(), F.col("y"), F.col("x")], n, "star_id").select("image_id", "y", "x", "star_id")


PROF = PICK + f""", pj as (select image_id,star_id,sy,sx,y-sy dy,x-sx dx,r,g,b from (select * from st where star_id<=12) join rgb using(image_id) where abs(y-sy)<={RMAX} and abs(x-sx)<={RMAX}),
pf as materialized (select image_id,star_id,sy,sx,bin,median((r+g+b)/3e0) lum,median(r) r,median(g) g,median(b) b from (select *,cast(floor((sqrt(dy*dy+dx*dx)-12)/6e0) as int) bin from pj) where bin>=0 and bin<{NB} group by all),
en as (select *,min(lum) over w env,lum-min(lum) over w excess from pf window w as (partition by image_id,star_id order by bin))"""


@query("j17_radial_profile", "rgb", f"select image_id,star_id,bin,{s6('lum')},{','.join(s6(c) for c in RGB)} from pf", PROF)
def j17(v):
    d = S.radial_profile(v.rgb, picks(v), RMAX)
    return rounded(d.select("image_id", F.col("star_id").cast("long").alias("star_id"), "bin", "lum", *RGB), "lum", *RGB)


@query("w04_running_envelope", "rgb", f"select image_id,star_id,bin,{s6('env')},{s6('excess')} from en", PROF)
def w04(v):
    d = S.envelope(S.radial_profile(v.rgb, picks(v), RMAX))
    return rounded(d.select("image_id", F.col("star_id").cast("long").alias("star_id"), "bin", "env", "excess"), "env", "excess")


@query(
    "w07_ring_runs", "frame_measure",
    f"select session_id image_id,{s6('amp')},i1,i2,{s6('bg')} from (select *,row_number() over (partition by session_id order by amp desc,i1) rr from (select session_id,run,min(bin) i1,max(bin)+1 i2,max(excess) amp,arg_max(lum,(excess,-bin)) pk,arg_max(coalesce(aft,1e9),bin) aft,any_value(bg) bg from o where onx group by all) where aft<pk-0.5e0*amp and (i2-1-i1)*6>=15) where rr=1",
    """pf as (select session_id,frame_id//12%48 bin,median(bg) lum from frame_measure group by all), e1 as (select *,min(lum) over (partition by session_id order by bin) env from pf),
    e2 as (select *,lum-env excess,median(lum) filter (bin>=36) over (partition by session_id) bg,min(lum) over (partition by session_id order by bin rows between 1 following and 10 following) aft from e1),
    o0 as (select *,excess>greatest(0.006e0,0.03e0*bg) and bin*6+15>32 onx from e2), o as (select *,sum(case when onx then 0 else 1 end) over (partition by session_id order by bin) run from o0)""",
)
def w07(v):
    """Run detection over 48-bin profiles of every session."""
    p = v.frame_measure.groupBy(F.col("session_id").alias("image_id"), (F.floor(F.col("frame_id") / 12) % 48).alias("bin")).agg(F.median("bg").alias("lum"))
    p = p.withColumns({"star_id": F.lit(1), "sy": F.lit(0), "sx": F.lit(0)})
    d = S.detect_rings(p, 48)
    return rounded(d.select("image_id", "amp", "i1", "i2", "bg"), "amp", "bg")


RINGS = "rg as (select image_id,star_id rank,sy,sx,14e0+star_id%4 r1,30e0+star_id%5*2 r2,0.02e0 amp,0.5e0 bg,0.02e0 amp_r,0.015e0 amp_g,0.01e0 amp_b from st where star_id<=3)"


def rings(v):
    i = F.col("star_id")
    return picks(v, 3).select(
        "image_id", "star_id", i.alias("rank"), F.col("y").alias("sy"), F.col("x").alias("sx"), (F.lit(14.0) + i % 4).alias("r1"), (F.lit(30.0) + i % 5 * 2).alias("r2"), F.lit(0.02).alias("amp"), F.lit(0.5).alias("bg"),
        F.lit(0.02).alias("amp_r"), F.lit(0.015).alias("amp_g"), F.lit(0.01).alias("amp_b"),
    )


def ring_step(n, src):
    w = f"({clip_sql(f'(d{n}-r1_{n})/greatest(6e0,0.3e0*(r2_{n}-r1_{n}))')}*{clip_sql(f'(r2_{n}-d{n})/greatest(6e0,0.3e0*(r2_{n}-r1_{n}))')})"
    amp = {"r": "0.02e0", "g": "0.015e0", "b": "0.01e0"}
    return f"(select p.* exclude (r,g,b),{','.join(f'case when {w}>0 and {c}<0.5e0+0.06e0 then greatest(0e0,{c}-{amp[c]}*{w}) else {c} end {c}' for c in RGB)} from {src} p)"


def _ring_sql():
    base = "(select rgb.*," + ",".join(f"sqrt(pow(x-g{n}.sx,2)+pow(y-g{n}.sy,2)) d{n},g{n}.r1 r1_{n},g{n}.r2 r2_{n}" for n in (1, 2, 3)) + " from rgb " + " ".join(f"join rg g{n} on g{n}.image_id=rgb.image_id and g{n}.rank={n}" for n in (1, 2, 3)) + ")"
    return ring_step(3, ring_step(2, ring_step(1, base)))


@query("j18_ring_subtraction", "rgb", per("$", _ring_sql()), PICK + "," + RINGS)
def j18(v):
    return pix(S.apply_rings(v.rgb, rings(v)), *RGB)


@query("j18_halo_tamer")
def j18b(v):
    return pix(S.halo_tamer(v.rgb, picks(v), RMAX), *RGB)


