"""Bursts, discs, surfaces, scenes, advice, registry and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.operators import advice as A
from skyframe.operators import burst as B
from skyframe.operators import disc as D
from skyframe.operators import quality
from skyframe.operators import registry as G
from skyframe.operators import scene as N
from skyframe.operators import surface as U
from skyframe.plans.catalogue import query, r6, rounded, s6
from skyframe.plans.point_queries import LG, LUMA, clip_sql, fin, mtf_sql, out3
from skyframe.plans.stencil_queries import KROON, gauss_sql, rank_sql
from skyframe.streaming import frames as X

RGB = ("r", "g", "b")
STATS = "st as materialized (select target_id,frame_id,median(v) med,greatest(1e-6,quantile_cont(v,0.9)-median(v)) sig from px group by all), rf as (select target_id,min(frame_id) frame_id from px group by all)"


def reference(v):
    return v.frame_tile.groupBy("target_id").agg(F.min("frame_id").alias("frame_id"))


def frames(v):
    return v.frame_tile.select("target_id", "frame_id")


CORR = """rf as (select target_id,min(frame_id) frame_id from px group by all), rp as materialized (select px.target_id,y,x,v from px join rf using(target_id,frame_id)),
nb as materialized (select p.target_id,p.frame_id,p.y-dy y,p.x-dx x,dy,dx,v from px p,(values (-2),(-1),(0),(1),(2)) a(dy),(values (-2),(-1),(0),(1),(2)) b(dx)),
cr as materialized (select n.target_id,n.frame_id,dy,dx,sum(n.v*r.v) s from nb n join rp r on r.target_id=n.target_id and r.y=n.y and r.x=n.x group by all),
pk as (select target_id,frame_id,min(s) lo,max(s) hi,arg_max(dy,(s,-dy,-dx)) py,arg_max(dx,(s,-dy,-dx)) qx from cr group by all),
cv as (select cr.*,py,qx,(s-lo)/(hi-lo) v from cr join pk using(target_id,frame_id)),
c5 as (select target_id,frame_id,any_value(py) py,any_value(qx) qx,max(v) filter (dy=py and dx=qx) c,max(v) filter (dy=py-1 and dx=qx) u,max(v) filter (dy=py+1 and dx=qx) d,max(v) filter (dy=py and dx=qx-1) l,max(v) filter (dy=py and dx=qx+1) r from cv group by all)"""


def para(m, p):
    ln = lambda k: f"ln(greatest({k},1e-12))"
    den = f"({ln(m)}-2e0*{ln('c')}+{ln(p)})"
    return f"case when {m} is not null and {p} is not null and abs({den})>=1e-12 then least(greatest(0.5e0*({ln(m)}-{ln(p)})/{den},-0.5e0),0.5e0) else 0e0 end"


@query("j12_shift_search", "px", f"select target_id,frame_id,{s6('qx+' + para('l', 'r'), 'dx')},{s6('py+' + para('u', 'd'), 'dy')} from c5", CORR)
def j12(v):
    return rounded(B.best_shift(B.correlate(B.pair_with_reference(v.px, reference(v)), 2)), "dx", "dy")


@query("j14_two_stage_registration")
def j14(v):
    """Coarse then fine offsets of every frame; accuracy is checked on planted shifts in the tests."""
    return rounded(B.register_burst(v.px, reference(v), fine_radius=2), "dx", "dy", "drift")


@query("j05_local_normalize", "px", f"select target_id,frame_id,y,x,{s6('v-gv', 'v')} from (select nz.*,g.v gv from nz join g on g.image_id=nz.target_id*1000000+nz.frame_id and g.y=nz.y and g.x=nz.x)",
       STATS + ", nz as materialized (select p.target_id,p.frame_id,y,x,(v-s.med)*least(greatest(r.sig/s.sig,0.5e0),2e0)+r.med v from px p join st s using(target_id,frame_id) join rf on rf.target_id=p.target_id join st r on r.target_id=rf.target_id and r.frame_id=rf.frame_id), df as materialized (select nz.target_id*1000000+nz.frame_id image_id,nz.y,nz.x,nz.v-q.v v from nz join (select px.target_id,y,x,v from px join rf using(target_id,frame_id)) q using(target_id,y,x))," + gauss_sql("g", "df", "v", 2.0, "nearest"))
def j05(v):
    return rounded(B.local_normalize(v.px, reference(v)), "v")


@query("j20_alignment_points", "px", f"select target_id,y,x,{s6('sum(w*v)/sum(w)', 'v')} from pj group by target_id,y,x having sum(w)>0.005",
       """ch as (select target_id,frame_id,ay,ax,(frame_id%3-1)*0.5e0 oy,(frame_id%5-2)*0.25e0 ox from (select distinct target_id,frame_id from px),(values (0),(2),(4)) a(ay),(values (0),(2),(4)) b(ax) where (frame_id+ay+ax)%4=0),
       wn as (select *,ay+i+oy py,ax+j+ox px,(0.5e0*(1e0-cos(2e0*pi()*(i+0.5e0)/4e0)))*(0.5e0*(1e0-cos(2e0*pi()*(j+0.5e0)/4e0))) wn from ch,range(4) a(i),range(4) b(j)),
       pj as (select c.target_id,c.ay+c.i y,c.ax+c.j x,p.v,c.wn*greatest(0e0,1e0-abs(c.py-p.y))*greatest(0e0,1e0-abs(c.px-p.x)) w from wn c join px p on p.target_id=c.target_id and p.frame_id=c.frame_id where abs(c.py-p.y)<1 and abs(c.px-p.x)<1)""")
def j20(v):
    f = F.col("frame_id")
    c = frames(v).withColumn("ay", F.explode(F.array(*[F.lit(i) for i in (0, 2, 4)]))).withColumn("ax", F.explode(F.array(*[F.lit(i) for i in (0, 2, 4)])))
    c = c.filter((f + F.col("ay") + F.col("ax")) % 4 == 0).withColumns({"oy": (f % 3 - 1) * 0.5, "ox": (f % 5 - 2) * 0.25})
    d = B.stack_points(v.px, c, 4)
    return d.select("target_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v").alias("v"))


@query("j21_fine_grid", "frame_measure", "select session_id,case when median(fwhm)<2.5 and count(*)>=8 then 2 else 1 end factor from (select session_id,stars,fwhm*case when session_id%2=0 then 0.6e0 else 1e0 end fwhm from frame_measure) where stars>0 group by session_id")
def j21(v):
    return B.fine_grid(v.frame_measure.withColumn("fwhm", F.col("fwhm") * F.when(F.col("session_id") % 2 == 0, 0.6).otherwise(1.0)))


OFF2 = "(frame_id%5-2)*0.2e0"


@query("j21_fine_resample", "px", f"select target_id,frame_id,y,x,case when sum(w)>1-1e-9 then {'round(sum(w*v),6)+0e0'} end v from (select p.target_id,p.frame_id,ty y,tx x,v,greatest(0e0,1e0-abs(ty/2e0-{OFF2}-p.y))*greatest(0e0,1e0-abs(tx/2e0-p.x)) w from px p,range(16) a(ty),range(16) b(tx) where abs(ty/2e0-{OFF2}-p.y)<1 and abs(tx/2e0-p.x)<1) where w>1e-12 group by target_id,frame_id,y,x")
def j21b(v):
    from skyframe.operators.stencil import shift

    off = frames(v).withColumns({"dy": (F.col("frame_id") % 5 - 2) * 0.2, "dx": F.lit(0.0)})
    return shift(v.px, off, scale=2).select("target_id", "frame_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v").alias("v"))


@query("a28_dither", "frame_measure", f"select session_id target_id,{s6('median(sqrt(dx*dx+dy*dy))', 'dither')},count(*) n_probes from (select *,row_number() over (partition by session_id order by frame_id)-1 i,greatest(1,count(*) over (partition by session_id)//9) s from (select session_id,frame_id,(fwhm-4e0)*2e0 dx,(ecc-0.4e0)*8e0 dy,min(frame_id) over (partition by session_id) rf from frame_measure) where frame_id<>rf) where i%s=0 and i//s<9 group by session_id")
def a28(v):
    o = v.frame_measure.select(F.col("session_id").alias("target_id"), "frame_id", ((F.col("fwhm") - 4.0) * 2.0).alias("dx"), ((F.col("ecc") - 0.4) * 8.0).alias("dy"))
    return rounded(B.measure_dither(o, o.groupBy("target_id").agg(F.min("frame_id").alias("frame_id"))), "dither")


PAT = """pp as materialized (select target_id,frame_id,y,x,v+case when (y*3+x*5)%7=0 then 0.2e0 else 0e0 end v from px), md as materialized (select target_id image_id,y,x,median(v) v from pp group by all),
tm as materialized (select p.target_id image_id,p.y,p.x,median(abs(p.v-m.v)) t from pp p join md m on m.image_id=p.target_id and m.y=p.y and m.x=p.x group by p.target_id,p.y,p.x),"""


@query("a29_static_pattern", "px", f"select image_id target_id,y,x,{s6('p')} from sp where image_id in (select image_id from sp group by image_id having sqrt(avg(p*p))>=0.25e0*any_value(sg))",
       PAT + gauss_sql("g", "md", "v", 2.0) + """, gz as materialized (select md.image_id,md.y,md.x,md.v-g.v p,t<2.5e0*(t0+1e-12) gd from md join g using(image_id,y,x) join tm using(image_id,y,x) join (select image_id,median(t) t0 from tm group by all) using(image_id)),
       s0 as (select image_id,median(p) m from gz where gd group by all), s1 as (select image_id,1.4826e0*median(abs(p-m))+1e-12 sg from gz join s0 using(image_id) where gd group by image_id),
       sp as (select gz.image_id,y,x,sg,case when gd then sign(p)*greatest(abs(p)-sg,0e0) else 0e0 end p from gz join s1 using(image_id))""")
def a29(v):
    px = v.px.withColumn("v", F.col("v") + F.when((F.col("y") * 3 + F.col("x") * 5) % 7 == 0, 0.2).otherwise(0.0))
    dith = frames(v).select("target_id").distinct().withColumns({"dither": F.lit(6.0), "fwhm": F.lit(2.0)})
    return rounded(B.static_pattern(px, frames(v), dith), "p")


_DB = ",".join(f"({d},{B.chi2_quantile(0.25, d) / d!r}::double)" for d in range(4, 301))


@query("a30_photon_transfer", "px", f"select target_id,{s6('a')},{s6('b')},{s6('m_cap')} from (select f.target_id,m_cap,case when u2>=4 and u2<u then a2 else a end a,greatest(0e0,case when u2>=4 and u2<u then b2 else b end) b from f left join f2 using(target_id) join q using(target_id)) where a>0",
       f"""ramp as materialized (select target_id,frame_id,y,x,(y*8+x)/100e0+(v-0.5e0)*sqrt(0.02e0+(y*8+x)/100e0) v from px), nf as (select target_id,count(distinct frame_id) nf from px group by all),
       p as materialized (select target_id,y,x,count(v) c,avg(v) m,var_samp(v) s2 from ramp group by all), po as (select p.* from p join nf using(target_id) where nf>=5 and c>=greatest(5,nf//2)),
       db(k,r) as (values {_DB}), q as materialized (select target_id,cap,m_cap,r from (select target_id,quantile_cont(m,0.8) cap,quantile_cont(m,0.85) m_cap,count(*) n,greatest(cast(floor(median(c)) as int)-1,4) k from po group by all) join db using(k) where n>=50),
       lw as materialized (select po.target_id,m,s2,r from po join q using(target_id) where m<=cap), eg as materialized (select target_id,i,quantile_cont(m,0.02+0.97*i/12.0) e from lw,range(13) t(i) group by target_id,i),
       bn as materialized (select l.target_id,a.i,m,s2,r from lw l join eg a on a.target_id=l.target_id join eg b on b.target_id=l.target_id and b.i=a.i+1 where m>=a.e and m<b.e),
       bb as materialized (select target_id,i,median(m) c,count(*) w,quantile_cont(s2,0.25)/any_value(r) e from bn group by all having count(*)>=3), bo as materialized (select * from bb where target_id in (select target_id from bb group by target_id having count(*)>=4 and max(c)-min(c)>=1e-4)),
       f as materialized (select target_id,(sum(w)*sum(w*c*e)-sum(w*c)*sum(w*e))/(sum(w)*sum(w*c*c)-sum(w*c)*sum(w*c)) a,(sum(w*e)-(sum(w)*sum(w*c*e)-sum(w*c)*sum(w*e))/(sum(w)*sum(w*c*c)-sum(w*c)*sum(w*c))*sum(w*c))/sum(w) b,count(*) u from bo group by all),
       b2 as (select bo.* from bo join f using(target_id) where e<=2.5e0*greatest(a*c+greatest(b,0e0),1e-12)),
       f2 as (select target_id,(sum(w)*sum(w*c*e)-sum(w*c)*sum(w*e))/(sum(w)*sum(w*c*c)-sum(w*c)*sum(w*c)) a2,(sum(w*e)-(sum(w)*sum(w*c*e)-sum(w*c)*sum(w*e))/(sum(w)*sum(w*c*c)-sum(w*c)*sum(w*c))*sum(w*c))/sum(w) b2,count(*) u2 from b2 group by all)""".replace("quantile_cont(m,0.02+0.97*i/12.0) e from lw,range(13) t(i) group by target_id,i", "e from (" + " union all ".join(f"select target_id,{i} i,quantile_cont(m,{0.02 + (0.99 - 0.02) * i / 12!r}) e from lw group by target_id" for i in range(13)) + ")"))
def a30(v):
    base = (F.col("y") * 8 + F.col("x")) / 100.0
    ramp = v.px.withColumn("v", base + (F.col("v") - 0.5) * F.sqrt(base + 0.02))
    return rounded(B.photon_transfer(ramp, frames(v), min_pixels=50, min_bin=3), "a", "b", "m_cap")


_T = "least(24,h//2,wd//2)"
_FD = lambda i: f"(case when {i}<{_T} then 0.5e0*(1e0-cos(pi()*({i})/{_T})) else 1e0 end)"


@query("a32_burst_grading", "mos", f"select image_id,{s6('stddev_pop(t)', 'sharp')},{s6('any_value(p9)', 'p999')} from (select image_id,(mag-lo)/(hi-lo)*{_FD('y')}*{_FD('h-1-y')}*{_FD('x')}*{_FD('wd-1-x')} t,p9 from (select image_id,y,x,sqrt(gy*gy+gx*gx) mag from kg) join (select image_id,min(sqrt(gy*gy+gx*gx)) lo,max(sqrt(gy*gy+gx*gx)) hi from kg group by all) using(image_id) join kd using(image_id) join (select image_id,quantile_cont(v,0.999) p9 from mos group by all) using(image_id)) group by image_id", KROON)
def a32(v):
    return rounded(B.grade_frames(v.mos), "sharp", "p999")


@query(
    "a34_burst_mean", "px_nodata",
    f"select target_id,y,x,{s6(clip_sql('avg(v)'), 'v')},count(v) n from px_nodata semi join k using(target_id,frame_id) group by target_id,y,x",
    "gd as (select target_id,frame_id,stddev_pop(v) s from px_nodata group by all), k as (select target_id,frame_id from (select *,row_number() over (partition by target_id order by s desc,frame_id) r,count(*) over (partition by target_id) m from gd) where r<=greatest(2,round_even(m*0.35e0,0)))",
)
def a34(v):
    """Mean of every target's sharpest frames, by the spread of their pixels."""
    graded = v.px_nodata.groupBy("target_id", "frame_id").agg(F.stddev_pop("v").alias("sharp"))
    return rounded(B.burst_mean(v.px_nodata, quality.keep_sharpest(graded, 0.35, ["target_id"])), "v")


@query("a36_point_features", "mos", f"select image_id,ay,ax,{s6('lit')},{s6('q')},{s6('ex')},{s6('ey')} from ap join (select image_id,list(q order by q)[count(*)//2+1] m from ap group by all) using(image_id) where least(ex,ey)/greatest(ex,ey,1e-12)>=0.15 and q>=0.3e0*m",
       KROON + ", wi as (select image_id,ay*16 ay,ax*16 ax from kd,range(200) a(ay),range(200) b(ax) where ay*16+32<=h and ax*16+32<=wd), ap as materialized (select w.image_id,ay,ax,avg(case when m.v>0.5e0*p9 then 1e0 else 0e0 end) lit,stddev_pop(sqrt(gy*gy+gx*gx)) q,sqrt(avg(gx*gx)) ex,sqrt(avg(gy*gy)) ey from wi w join mos m on m.image_id=w.image_id and m.y>=ay and m.y<ay+32 and m.x>=ax and m.x<ax+32 join kg g on g.image_id=m.image_id and g.y=m.y and g.x=m.x join (select image_id,quantile_cont(v,0.999) p9 from mos group by all) z on z.image_id=m.image_id group by w.image_id,ay,ax having lit>=0.4)")
def a36(v):
    d = B.point_features(v.mos, 32)
    return rounded(d.select("image_id", F.col("ay").cast("long").alias("ay"), F.col("ax").cast("long").alias("ax"), "lit", "q", "ex", "ey"), "lit", "q", "ex", "ey")


# --- discs: a limb-darkened disc in every image

DISC = "dc as materialized (select image_id,y,x,case when r2<=1 then 0.35e0+0.25e0*sqrt(1e0-r2)+(v-0.5e0)*0.1e0 else v*0.02e0 end v from (select *,(pow(y-hh/2e0,2)+pow(x-70e0,2))/pow(hh*0.4e0,2) r2 from mos join (select image_id,max(y)+1 hh from mos group by all) using(image_id)))"


def disc(v):
    h = v.mos.groupBy("image_id").agg((F.max("y") + 1).alias("hh"))
    d = v.mos.join(h, "image_id")
    r2 = (F.pow(F.col("y") - F.col("hh") / 2, 2) + F.pow(F.col("x") - 70.0, 2)) / F.pow(F.col("hh") * 0.4, 2)
    return d.select("image_id", "y", "x", F.when(r2 <= 1, F.sqrt(F.greatest(1.0 - r2, F.lit(0.0))) * 0.25 + 0.35 + (F.col("v") - 0.5) * 0.1).otherwise(F.col("v") * 0.02).alias("v"))


def disc_rgb(v):
    return disc(v).select("image_id", "y", "x", F.col("v").alias("r"), (F.col("v") * 0.9).alias("g"), (F.col("v") * 0.7).alias("b"))


GEO = DISC + """, lt as materialized (select image_id,y,x,v from dc join (select image_id,quantile_cont(v,0.999) p from dc group by all) using(image_id) where v>0.5e0*p),
ge as materialized (select image_id,avg(x) cx,avg(y) cy,count(*) n,sqrt(count(*)/pi()) radius from lt group by all having count(*)>=100),
rr as materialized (select lt.image_id,v,sqrt(pow(x-cx,2)+pow(y-cy,2)) r,radius from lt join ge using(image_id)), bn as (select image_id,bin,median(v) m from (select *,least(95,cast(floor(r/(radius*1.03e0)*96) as int)) bin from rr) group by all having count(*)>20),
pf as materialized (select g.image_id,g.bin,coalesce(last_value(m ignore nulls) over (partition by g.image_id order by g.bin rows unbounded preceding),first_value(m ignore nulls) over (partition by g.image_id order by g.bin rows between unbounded preceding and unbounded following)) m from (select image_id,bin from ge,range(96) t(bin)) g left join bn using(image_id,bin))"""


@query("a38_disc_geometry", "mos", f"select image_id,{s6('cx')},{s6('cy')},{s6('radius')},n,{s6('n/(pi()*mr*mr)', 'fill')},{s6('greatest(1e-6,m0,m1)', 'c0')} from ge join (select image_id,max(r) mr from rr group by all) using(image_id) join (select image_id,max(m) filter (bin=0) m0,max(m) filter (bin=1) m1 from pf group by all) using(image_id)", GEO)
def a38(v):
    return rounded(D.disc_geometry(disc(v)).select("image_id", "cx", "cy", "radius", "n", "fill", "c0"), "cx", "cy", "radius", "fill", "c0")


@query("w08_forward_fill", "mos", f"select image_id,bin,{s6('m')} from pf", GEO)
def w08(v):
    g = D.disc_geometry(disc(v))
    return g.select("image_id", F.posexplode("profile").alias("bin", "m")).select("image_id", F.col("bin").cast("long").alias("bin"), r6("m").alias("m"))


@query("w06_centred_median", "mos", f"select image_id,bin,{s6('median(m) over (partition by image_id order by bin rows between 6 preceding and 6 following)', 'ref')} from pf", GEO)
def w06(v):
    p = D.disc_geometry(disc(v)).select("image_id", F.posexplode("profile").alias("bin", "m"))
    return D.centred_median(p, 6, "m", "ref").select("image_id", F.col("bin").cast("long").alias("bin"), r6("ref").alias("ref"))


_OFF = ",".join(f"({a},{b})" for a, b in D.OFFSETS)


@query("a39_body_class", "mos", f"select image_id,ne n_edge,ni n_interior,{s6('r', 'ratio')},case when r<0.93 then 'sun' when r>1.03 then 'moon' else 'unknown' end body from (select *,case when ne>=50 and ni>=200 then e/i else 1e0 end r from (select image_id,count(*) filter (lit and nd) ne,count(*) filter (lit and not nd) ni,avg(v) filter (lit and nd) e,avg(v) filter (lit and not nd) i from ed group by all))",
       DISC + f""", th as (select image_id,0.5e0*quantile_cont(v,0.999) t,max(y)+1 h,max(x)+1 w from dc group by all), gr as materialized (select d.*,t from dc d join th using(image_id) where y>=6 and y<h-6 and x>=6 and x<w-6),
       gn as materialized (select image_id,y,x,y+dy ny,x+dx nx from gr cross join (values {_OFF}) o(dy,dx)), ed as (select g.image_id,g.y,g.x,any_value(g.v) v,any_value(g.v>g.t) lit,bool_or(n.v<=g.t) nd from gr g join gn k using(image_id,y,x) join dc n on n.image_id=k.image_id and n.y=k.ny and n.x=k.nx group by g.image_id,g.y,g.x)""")
def a39(v):
    return rounded(D.classify_body(disc(v)).select("image_id", "n_edge", "n_interior", "ratio", "body"), "ratio")


@query("a40_limb_flatten")
def a40(v):
    d = disc_rgb(v)
    mono = disc(v)
    g = D.disc_geometry(mono)
    from skyframe.session import cut

    g = cut(g)
    flat = cut(D.flatten_limb(d, g, D.disc_summary(d)))
    return fin(D.ring_detrend(flat, g))


@query("a41_lit_box", "mos", "select image_id,cast(greatest(0,y0-p) as int) y0,cast(least(h,y1+1+p) as int) y1,cast(greatest(0,x0-p) as int) x0,cast(least(w,x1+1+p) as int) x1 from (select *,round_even(greatest(y1-y0+1,x1-x0+1)*0.15e0,0) p from (select image_id,min(y) y0,max(y) y1,min(x) x0,max(x) x1 from dc join th using(image_id) where v*2.6e0/3e0>t group by all)) join (select image_id,max(y)+1 h,max(x)+1 w from dc group by all) using(image_id)", DISC + ", th as (select image_id,greatest(0.04e0,0.12e0*quantile_cont(v*2.6e0/3e0,0.999)) t from dc group by all)")
def a41(v):
    return D.lit_box(disc_rgb(v))


@query("a42_disc_summary", "mos", f"select image_id,{s6('dm', 'disc_r')},{s6('dm*0.9e0', 'disc_g')},{s6('0.9e0', 'gain_r')},{s6('0.9e0/0.7e0', 'gain_b')},{s6('bl', 'black')},{s6(mtf_sql('0.72e0', '(least(dm*0.9e0,0.98e0)-bl)/(1e0-bl)'), 'midtones')} from (select image_id,median(v) filter (v>0.5e0*p) dm,0.6e0*median(v) filter (v<0.1e0*p)*0.9e0 bl from dc join (select image_id,quantile_cont(v,0.999) p from dc group by all) using(image_id) group by image_id)", DISC)
def a42(v):
    return rounded(D.disc_summary(disc_rgb(v)).select("image_id", "disc_r", "disc_g", "gain_r", "gain_b", "black", "midtones"), "disc_r", "disc_g", "gain_r", "gain_b", "black", "midtones")


@query("a42_disc_finish")
def a42b(v):
    return fin(D.finish(disc_rgb(v)))


# --- surfaces


@query("a18_dark_lane_anchors", "rgb1", f"select image_id,zone,{s6('u')},{s6('v')},{s6('lum')} from (select *,row_number() over (partition by image_id,zone order by lum,patch) r from (select image_id,zone,patch,any_value(u) u,any_value(v) v,avg(m) lum from (select image_id,zone,patch,c,any_value(u) u,any_value(v) v,median(lg.v0) m from lg join bx using(image_id) where x>=x0 and x<x1 and y>=y0 and y<y1 group by all) group by all)) where r=1",
       "r3 as materialized (select image_id,y*3+k//3 y,x*3+k%3 x,r*(x/400e0+0.4e0) r,g*(x/400e0+0.4e0) g,b*(x/400e0+0.4e0) b from rgb1,range(9) t(k)), " + LG.replace("from rgb", "from r3").replace(" v from", " v0 from") + """, dm as (select image_id,max(y)+1 h,max(x)+1 w from r3 group by all), zz as (select image_id,h,w,j*8+i zone,(j*8+i)*9+b*3+a patch,floor(w*i/8) zx0,floor(w*(i+1)/8) zx1,floor(h*j/5) zy0,floor(h*(j+1)/5) zy1,a,b from dm,range(8) q(i),range(5) r(j),range(3) s(a),range(3) t(b)),
       bx as materialized (select image_id,zone,patch,x0,x1,y0,y1,(x0+x1)/2e0/w u,(y0+y1)/2e0/h v from (select *,floor(zx0+(zx1-zx0)/3e0*(a+0.25e0)+0.5e0) x0,floor(zx0+(zx1-zx0)/3e0*(a+0.75e0)+0.5e0) x1,floor(zy0+(zy1-zy0)/3e0*(b+0.25e0)+0.5e0) y0,floor(zy0+(zy1-zy0)/3e0*(b+0.75e0)+0.5e0) y1 from zz) where x1-x0>=8 and y1-y0>=8)""")
def a18(v):
    d = U.dark_lane_anchors(grown(v))
    return rounded(d.select("image_id", F.col("zone").cast("long").alias("zone"), "u", "v", "lum"), "u", "v", "lum")


def grown(v):
    """The large image with every pixel drawn three by three, so that all zones have candidates."""
    k = F.col("k")
    d = v.rgb1.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return d.select("image_id", (F.col("y") * 3 + F.floor(k / 3)).cast("int").alias("y"), (F.col("x") * 3 + k % 3).cast("int").alias("x"), *[(F.col(c) * (F.col("x") / 400.0 + 0.4)).alias(c) for c in RGB])


@query("a19_dark_lane_model")
def a19(v):
    d = U.dark_lane_model(grown(v))
    return rounded(d.select("image_id", "c", "lo", "hi", "kept", "total"), "lo", "hi")


@query("a19_dark_lane_subtract")
def a19b(v):
    return fin(U.dark_lane_gradient(grown(v)))


@query("a20_background_extract")
def a20(v):
    return fin(U.background_extract(v.rgb, grid=16))


def robust_plane(rounds=5, low=3.0, high=1.5):
    """CTEs ending in pl (image_id, c, k0, k1, k2): a plane per channel refitted within asymmetric limits of its binned residuals."""
    sums = "count(*) n,sum(u) su,sum(w) sw,sum(u*u) suu,sum(u*w) suw,sum(w*w) sww,sum(v) sv,sum(v*u) svu,sum(v*w) svw"
    names = ["n", "su", "sw", "suu", "suw", "sww", "sv", "svu", "svw"]

    def solved(source, more=""):
        det = "(n*(suu*sww-suw*suw)-su*(su*sww-suw*sw)+sw*(su*suw-suu*sw))"
        k0 = "(sv*(suu*sww-suw*suw)-su*(svu*sww-suw*svw)+sw*(svu*suw-suu*svw))"
        k1 = "(n*(svu*sww-suw*svw)-sv*(su*sww-suw*sw)+sw*(su*svw-svu*sw))"
        k2 = "(n*(suu*svw-svu*suw)-su*(su*svw-svu*sw)+sv*(su*suw-suu*sw))"
        return f"select image_id,c,{k0}/{det} k0,{k1}/{det} k1,{k2}/{det} k2{more} from {source}"

    lean = lambda e: f"(case when abs({e})<pow(2e0,-40) then 0 else sign({e})*(cast(floor((log2(greatest(abs({e}),pow(2e0,-40)))+40e0)*512e0) as int)+1) end)"
    value = "(case when b=0 then 0e0 else sign(b)*pow(2e0,(abs(b)-0.5e0)/512e0-40e0) end)"
    half = lambda of: f"(min({of}) filter (upto>(m-1)//2)+min({of}) filter (upto>m//2))/2e0"
    out = [
        "pd as (select image_id,max(y)+1 h,max(x)+1 wd from rgb group by all)",
        "pr as materialized (select image_id,c,v,x*1e0/greatest(wd-1,1) u,y*1e0/greatest(h-1,1) w from lg join pd using(image_id))",
        f"s0 as materialized (select *,null::double b0,null::double b1,null::double b2,0 lo,0 hi from ({solved(f'(select image_id,c,{sums} from pr group by all)')}))",
    ]
    for r in range(1, rounds):
        p = f"s{r - 1}"
        was = f"b0 is null or ({lean('(v-(b0+b1*u+b2*w))')} between lo and hi)"
        out += [
            f"n{r} as materialized (select image_id,c,b,{value} e,count(*) filter (was) i,{sums} from (select image_id,c,u,w,v,{lean('(v-(k0+k1*u+k2*w))')} b,({was}) was from pr join {p} using(image_id,c)) group by image_id,c,b)",
            f"m{r} as (select image_id,c,{half('e')} mid from (select image_id,c,e,sum(i) over (partition by image_id,c order by e) upto,sum(i) over (partition by image_id,c) m from n{r} where i>0) group by all)",
            f"d{r} as (select image_id,c,mid,{half('d')} mad from (select image_id,c,mid,abs(e-mid) d,sum(i) over (partition by image_id,c order by abs(e-mid)) upto,sum(i) over (partition by image_id,c) m from n{r} join m{r} using(image_id,c) where i>0) group by all)",
            f"t{r} as materialized (select image_id,c,min(b) nlo,max(b) nhi,{','.join(f'sum({x}) {x}' for x in names)} from n{r} join d{r} using(image_id,c) where e>=mid-(mad*1.4826e0+1e-12)*{low!r}::double and e<=mid+(mad*1.4826e0+1e-12)*{high!r}::double group by all)",
            f"s{r} as materialized (select image_id,c,coalesce(q.k0,p.k0) k0,coalesce(q.k1,p.k1) k1,coalesce(q.k2,p.k2) k2,case when q.k0 is null then b0 else p.k0 end b0,case when q.k0 is null then b1 else p.k1 end b1,case when q.k0 is null then b2 else p.k2 end b2,coalesce(nlo,lo) lo,coalesce(nhi,hi) hi from {p} p left join ({solved(f't{r} where n>=8', ',nlo,nhi')}) q using(image_id,c))",
        ]
    return ",\n".join([LG, *out, f"pl as (select * from s{rounds - 1})"])


_PLANES = "(select rgb.*," + ",".join(f"p{c}.k0+case when wd>1 then p{c}.k1*0.5e0 else 0e0 end+case when h>1 then p{c}.k2*0.5e0 else 0e0 end-(p{c}.k0+p{c}.k1*(rgb.x*1e0/greatest(wd-1,1))+p{c}.k2*(rgb.y*1e0/greatest(h-1,1))) g{c}" for c in RGB) + " from rgb join pd using(image_id) " + " ".join(f"join (select * from pl where c='{c}') p{c} using(image_id)" for c in RGB) + ")"


@query("a21_gradient_cleanup", "rgb", out3([clip_sql(f"{c}+g{c}*0.8e0") for c in RGB], _PLANES), robust_plane())
def a21(v):
    return fin(U.gradient_cleanup(v.rgb, 0.8))


@query("a21_deepen_background")
def a21b(v):
    return fin(U.deepen_background(v.rgb, 0.6))


@query("a21_plane_fit", "mos", f"select image_id,{s6('mz-b*mu-c*mv', 'a')},{s6('b')},{s6('c')} from (select *,(uz*vv-vz*uv)/(uu*vv-uv*uv) b,(vz*uu-uz*uv)/(uu*vv-uv*uv) c from (select image_id,avg(u) mu,avg(w) mv,avg(v) mz,var_pop(u) uu,var_pop(w) vv,covar_pop(u,w) uv,covar_pop(u,v) uz,covar_pop(w,v) vz from (select image_id,v,x*1e0/(max(x) over (partition by image_id)) u,y*1e0/(max(y) over (partition by image_id)) w from mos) group by image_id))")
def a21c(v):
    return rounded(U.plane_fit(v.mos), "a", "b", "c")


# --- scenes

MASKW = "case when y*8+x<40 then 1e0 else 0.25e0 end"


def half_mask(v):
    return frames(v).select("target_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("target_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), F.when(F.col("k") < 40, 1.0).otherwise(0.25).alias("w"))


@query("a47_foreground_sharpness", "px", f"select target_id,arg_max(frame_id,(s,-frame_id)) frame_id,{s6('max(s)', 'sharpness')} from (select target_id,frame_id,sum(l*l*w)/(sum(w)+1e-9) s from (select p.target_id,p.frame_id,p.y,p.x,sum(q.v)-4e0*any_value(p.v) l,any_value({MASKW.replace('y*8+x', 'p.y*8+p.x')}) w from px p join (select target_id,frame_id,(y+dy+8)%8 ny,(x+dx+8)%8 nx,v from px,(values (0,1),(0,-1),(1,0),(-1,0)) o(dy,dx)) q on q.target_id=p.target_id and q.frame_id=p.frame_id and q.ny=p.y and q.nx=p.x group by p.target_id,p.frame_id,p.y,p.x) group by all) group by target_id")
def a47(v):
    return rounded(N.pick_foreground(N.foreground_sharpness(v.px, half_mask(v))), "sharpness")


@query("p33_fill_masked", "px", f"select target_id,frame_id,y,x,{s6('case when y*8+x<40 then v else m end', 'v')} from px join (select target_id,frame_id,median(v) m from px where y*8+x<40 group by all) using(target_id,frame_id)")
def p33(v):
    return rounded(N.fill_masked(v.px, half_mask(v)), "v")


WEAK = "ln as (select session_id image_id,cast(row_number() over (partition by session_id order by frame_id)-1 as int) line,fwhm*0.7310585786300049::double col,ecc<0.5e0 ok from frame_measure)"


@query("w09_weak_line_fill", "frame_measure", f"select image_id,line,{s6('case when ok then col when pa is null then vb when pb is null then va else va+(vb-va)*(line-pa)/(pb-pa) end', 'col')} from (select *,last_value(case when ok then line end ignore nulls) over b pa,last_value(case when ok then col end ignore nulls) over b va,first_value(case when ok then line end ignore nulls) over f pb,first_value(case when ok then col end ignore nulls) over f vb from ln window b as (partition by image_id order by line rows between unbounded preceding and current row),f as (partition by image_id order by line rows between current row and unbounded following))", WEAK)
def w09(v):
    from skyframe.functions.ranking import ranked

    d = ranked(v.frame_measure, ["session_id"], [("frame_id", True)]).select(F.col("session_id").alias("image_id"), (F.col("rank") - 1).cast("int").alias("line"), (F.col("fwhm") * 0.7310585786300049).alias("col"), (F.col("ecc") < 0.5).alias("ok"))
    return rounded(N.fill_weak(d, "line", "col", "ok").select("image_id", "line", "col"), "col")


@query("w15_horizon_mask")
def w15(v):
    """Dark sky over a textured, brighter ground; the side is checked in the tests."""
    ground = F.col("y") > 20 + F.col("x") / 20
    d = v.mos.select("image_id", "y", "x", F.when(ground, F.col("v")).otherwise(F.col("v") * 0.05).alias("v"))
    return rounded(N.segment_sky(d), "w", "horizon_strength")


@query("p31_foreground_develop", "rgb", out3([f"case when l>1e-4 then {clip_sql(f'{c}1*pow(l,gm)/l')} else {c}1 end" for c in RGB], f"(select *,least(greatest(ln(0.115e0)/ln(greatest(md,1e-3)),0.35e0),0.9e0) gm from (select *,(r1+g1+b1)/3e0 l from gw) join (select image_id,median((r1+g1+b1)/3e0) md from gw where (r1+g1+b1)/3e0>1e-4 group by all) using(image_id))"),
       f"mn as (select image_id,avg(r*0.4e0) mr,avg(g*0.3e0) mg,avg(b*0.2e0) mb from rgb group by all), gw as materialized (select image_id,y,x,{','.join(clip_sql(f'{c}*{k}*((mr+mg+mb)/3e0)/m{c}') + f' {c}1' for c, k in zip(RGB, ('0.4e0', '0.3e0', '0.2e0')))} from rgb join mn using(image_id))")
def p31(v):
    return fin(N.develop_foreground(v.rgb.withColumns({"r": F.col("r") * 0.4, "g": F.col("g") * 0.3, "b": F.col("b") * 0.2})))


@query("p31_foreground_composite", "rgb", out3([clip_sql(f"{c}*w+(1e0-w)*(1e0-{c})") for c in RGB], f"(select rgb.*,{clip_sql('q.v')} w from rgb join q using(image_id,y,x))"), "m0 as (select image_id,y,x,case when y<20 then 1e0 else 0e0 end v from rgb)," + gauss_sql("q", "m0", "v", 0.64))
def p31b(v):
    m = v.rgb.select("image_id", "y", "x", F.when(F.col("y") < 20, 1.0).otherwise(0.0).alias("w"))
    return fin(N.composite(v.rgb, v.rgb.withColumns({c: 1.0 - F.col(c) for c in RGB}), m))


# --- advice


def box16_sql(out, src):
    return f"{out}d as materialized (select image_id,max(y)+1 h,max(x)+1 wd from {src} group by all)," + ",".join(
        f"{n}n as materialized (select a.image_id,a.y,a.x,least(greatest(a.{ax}+i,0),d.{dim}-1) p from {s} a join {out}d d using(image_id) cross join (select i from range(-8,8) q(i)) q),{n} as materialized (select a.image_id,a.y,a.x,avg(s.v) v from {n}n a join {s} s on s.image_id=a.image_id and s.{ot}=a.{ot} and s.{ax}=a.p group by a.image_id,a.y,a.x)"
        for n, s, ax, ot, dim in ((f"{out}y", src, "y", "x", "h"), (out, f"{out}y", "x", "y", "wd"))
    )


MET = f"lm as materialized (select image_id,y,x,{LUMA} v from rgb), d1 as materialized (select image_id,y,x,r-g v from rgb), d2 as materialized (select image_id,y,x,g-b v from rgb)," + ",".join(rank_sql(f"u{i}", s, "v", 3, "avg", "nearest") for i, s in enumerate(("lm", "d1", "d2"))) + "," + box16_sql("bx", "lm") + """,
mq as materialized (select image_id,median(v) bg,quantile_cont(v,0.8) p80,quantile_cont(v,0.995) p995 from lm group by all), mc as (select image_id,quantile_cont(r,0.35) bg_r,quantile_cont(g,0.35) bg_g,quantile_cont(b,0.35) bg_b from rgb group by all),
m1 as (select image_id,0.5e0*1.4826e0*(median(abs(d1.v-u1.v))+median(abs(d2.v-u2.v))) chroma_noise from d1 join u1 using(image_id,y,x) join d2 using(image_id,y,x) join u2 using(image_id,y,x) group by image_id),
m2 as materialized (select lm.image_id,lm.v l,lm.v-u0.v hp,lm.v-bx.v mid,greatest(r,g,b)-least(r,g,b) ch,bg,p80,count(*) filter (lm.v<bg+0.05e0) over (partition by lm.image_id) nd,count(*) filter (lm.v>bg+0.05e0) over (partition by lm.image_id) nb from lm join u0 using(image_id,y,x) join bx using(image_id,y,x) join rgb using(image_id,y,x) join mq using(image_id)),
m3 as (select image_id,1.4826e0*median(abs(hp)) noise from m2 where nd<=500 or l<bg+0.05e0 group by all), m4 as (select image_id,stddev_pop(mid) mid_spread,avg(case when l>0.98 then 1e0 else 0e0 end) blown,coalesce(avg(ch) filter (case when nb>=500 then l>bg+0.05e0 else l>p80 end),0e0) chroma from m2 group by all)"""
_MC = ["bg", "bg_r", "bg_g", "bg_b", "chroma_noise", "noise", "mid_spread", "spread", "chroma", "blown"]


@query("a46_advice_metrics", "rgb", f"select image_id,{','.join(s6('p995-bg', 'spread') if c == 'spread' else s6(c) for c in _MC)} from mq join mc using(image_id) join m1 using(image_id) join m3 using(image_id) join m4 using(image_id)", MET)
def a46(v):
    return rounded(A.metrics(v.rgb).select("image_id", *_MC), *_MC)


SUGM = "mt as (select frame_id image_id,bg*0.5e0 ptp,bg*2e0 bg,bg*2e0 bg_r,bg*2e0+noise bg_g,ecc*0.2e0 bg_b,noise chroma_noise,noise*0.8e0 noise,ecc*0.05e0 mid_spread,ecc spread,fwhm*0.03e0 chroma,noise*0.3e0 blown from frame_measure)"


@query("b01_suggested_steps", "frame_measure", """select image_id,name,count(*) over (partition by image_id) n from (
 select image_id,'gradient_cleanup' name from mt where ptp>0.02e0 union all select image_id,'bg_neutralize' from mt where greatest(bg_r,bg_g,bg_b)-least(bg_r,bg_g,bg_b)>0.008e0 union all select image_id,'scnr' from mt where bg_g-(bg_r+bg_b)*0.5e0>0.006e0 union all select image_id,'deveil' from mt where bg>0.08e0 and bg_r-bg_b>0.01e0
 union all select image_id,'chroma_nr' from mt where chroma_noise>0.01e0 union all select image_id,'noise_reduction' from mt where noise>0.006e0 union all select image_id,'local_contrast' from mt where mid_spread<0.02e0 union all select image_id,'contrast' from mt where spread<0.35e0 union all select image_id,'saturation' from mt where chroma<0.1e0 union all select image_id,'highlight_rolloff' from mt where blown>0.002e0)""", SUGM)
def b01(v):
    from pyspark.sql import Window

    v.frame_measure.createOrReplaceTempView("frame_measure")
    d = A.suggest(v.spark.sql(SUGM[7:-1]))
    return d.select("image_id", "name", F.count(F.lit(1)).over(Window.partitionBy("image_id")).alias("n"))


@query("b03_frame_report")
def b03(v):
    p = v.rgb1.select("image_id").distinct().select("image_id", F.lit("emission").alias("object_class"), F.lit(False).alias("inputStretched"), F.lit(0.0).alias("gradientCleanup"), F.lit(False).alias("reduceCast"), F.lit(False).alias("darkLaneGC"), F.lit(True).alias("useMask"), F.lit(0.0).alias("dehaze"), F.lit(0.0).alias("chromaNR"))
    tilt = v.rgb1.withColumns({c: F.col(c) * (F.col("x") / 400.0 + 0.3) for c in RGB})
    return A.frame_report(tilt, p)


# --- registry and replay

STEPS = [
    {"name": "levels", "params": {"black": 0.1, "white": 0.9, "gamma": "1.2"}}, {"name": "scnr", "params": {"amount": 1}, "opacity": 0.5},
    {"name": "contrast", "params": {"pivot": 0.3, "strength": 0.2}, "mask": "soft", "mask_invert": True}, {"name": "saturation", "params": {"amount": 0.3}, "mask": "missing"}, {"name": "edge_crop", "params": {"percent": 5.0}, "mask": "soft"},
]


_TOOLS = ",".join(f"('{n}')" for n in G.TOOLS)


@query(
    "r01_tool_registry", "rgb",
    f"select tool,image_id,case when tool='edge_crop' then inner_ when tool='crop' then left_ else n end n,case when tool='edge_crop' then inner_ when tool='crop' then left_ else n end n_valid from (values {_TOOLS}) t(tool) cross join "
    "(select image_id,count(*) n,count(*) filter (y>=round_even(h*0.1e0,0) and y<h-round_even(h*0.1e0,0) and x>=round_even(wd*0.1e0,0) and x<wd-round_even(wd*0.1e0,0)) inner_,count(*) filter (x<wd//2) left_ from rgb join (select image_id,max(y)+1 h,max(x)+1 wd from rgb group by all) using(image_id) group by image_id)",
)
def r01(v):
    """Every tool of the registry over all images: defaults, but for the two crops, which cut something off."""
    return G.contract_rows(v.rgb, {"edge_crop": {"percent": 10.0}, "crop": {"rect": {"x0": 0.0, "y0": 0.0, "x1": 0.5, "y1": 1.0}}})


from skyframe.functions import math as M  # noqa: E402

_CT = M.contrast_pieces(0.3, 0.2)


@query("r02_recipe_replay", "rgb", f"select image_id,cast(y-my as int) y,cast(x-mx as int) x,{','.join(s6(c) for c in RGB)} from s3 join (select image_id,round_even((max(y)+1)*0.05e0,0) my,round_even((max(x)+1)*0.05e0,0) mx,max(y)+1 h,max(x)+1 w from rgb group by all) using(image_id) where y>=my and y<h-my and x>=mx and x<w-mx",
       f"""s1 as (select image_id,y,x,{','.join(f"pow({clip_sql(f'({c}-0.1e0)/0.8e0')},1e0/1.2e0) {c}" for c in RGB)} from rgb), k1 as (select *,least(g,0.5e0*(r+b)) gn from s1), k2 as (select *,case when r+gn+b>0 then (r+g+b)/(r+gn+b) else 1e0 end k from k1),
       s2 as materialized (select image_id,y,x,r*0.5e0+0.5e0*{clip_sql('r*k')} r,g*0.5e0+0.5e0*{clip_sql('gn*k')} g,b*0.5e0+0.5e0*{clip_sql('b*k')} b from k2),
       s3 as materialized (select s2.image_id,s2.y,s2.x,{','.join(f"s2.{c}*m.b+(1e0-m.b)*{clip_sql(M.piecewise_sql(_CT, clip_sql(f's2.{c}')))} {c}" for c in RGB)} from s2 join rgb m using(image_id,y,x))""")
def r02(v):
    soft = v.rgb.select("image_id", "y", "x", F.col("b").alias("w"))
    return fin(G.replay(v.rgb, STEPS, {"soft": soft}))


@query("r03_edit_list", "frame_measure", "select frame_id,case frame_id%5 when 0 then 'a:m1|new:|b:m2|c:m1' when 1 then 'a:m1|new:|c:m1' when 2 then 'a:m1|c:m1' when 3 then 'a:mx|b:m2|c:mx' else 'a:m1|b:m2' end steps from frame_measure")
def r03(v):
    def s(n, m):
        return F.struct(F.lit(n).alias("name"), F.lit(m).cast("string").alias("mask"))

    base, k, new = F.array(s("a", "m1"), s("b", "m2"), s("c", "m1")), F.col("frame_id") % 5, s("new", None)
    d = v.frame_measure.select("frame_id", base.alias("s"))
    st = F.col("s")
    e = (
        F.when(k == 0, G.insert_step(st, F.lit(1), new)).when(k == 1, G.replace_step(st, F.lit(1), new)).when(k == 2, G.delete_step(st, F.lit(1)))
        .when(k == 3, G.rename_mask(st, F.lit("m1"), F.lit("mx"))).otherwise(G.active_steps(st, F.lit(2)))
    )
    return d.select("frame_id", F.array_join(F.transform(e, lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["mask"], F.lit("")))), "|").alias("steps"))


# --- streams


@query("x01_frame_ledger", "arrival", "select frame_key,count(*) n from (select distinct frame_key from arrival) group by frame_key")
def x01(v):
    """Arrivals read as a stream, each key processed once, into a table that is read back."""
    events = v.table("events")
    s = X.arrivals(v.spark, v.root, events.schema, "events.parquet")
    key = F.substring(F.sha1(F.concat_ws("|", (F.col("user_id") % 20).cast("string"), (F.col("event_id") % 4000).cast("string"))), 1, 12)
    out, state = X.fresh_paths(v.spark, "ledger")
    d = X.run_ledger(s.select("event_id", key.alias("frame_key")), out, state)
    return d.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n"))


@query("x02_running_mean", "px", f"select target_id,y,x,{s6('avg(v)', 'v')},count(*) n from px group by target_id,y,x")
def x02(v):
    emb = v.table("embeddings")
    s = X.arrivals(v.spark, v.root, emb.schema, "embeddings.parquet")
    px = s.select(F.col("label").alias("target_id"), F.posexplode("embedding").alias("pos", "e")).select("target_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), (F.lit(0.5) + F.col("e").cast("double") / 2).alias("v"))
    out, state = X.fresh_paths(v.spark, "means")
    return rounded(X.run_means(px, out, state).select("target_id", "y", "x", "v", "n"), "v")
