"""Neighbourhood, multi-scale and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import kernels as Kn
from skyframe.functions.quantiles import group_quantiles, linear
from skyframe.operators import masks as K
from skyframe.operators import pixel as P
from skyframe.operators import stencil as T
from skyframe.operators.stats import mean_of
from skyframe.plans.catalogue import query, r6, rounded, s6
from skyframe.plans.point_queries import LUMA, ST, bal_sql, clip_sql, fin, mtf_sql, out3, per

RGB = ("r", "g", "b")


def edge(mode, p, n):
    if mode == "reflect":
        return f"case when {p}<0 then -({p})-1 when {p}>={n} then 2*{n}-1-({p}) else {p} end"
    if mode == "mirror":
        return f"case when {p}<0 then -({p}) when {p}>={n} then 2*{n}-2-({p}) else {p} end"
    if mode == "wrap":
        return f"(({p})+{n})%{n}"
    return f"least(greatest({p},0),{n}-1)"


def folded(mode, p, n):
    """Reflection for kernels that may be longer than the image."""
    if mode == "nearest":
        return edge(mode, p, n)
    if mode == "mirror":
        m = f"(((({p})%(2*{n}-2))+2*{n}-2)%(2*{n}-2))"
        return f"case when {m}>={n} then 2*{n}-2-{m} else {m} end"
    m = f"(((({p})%(2*{n}))+2*{n})%(2*{n}))"
    return f"case when {m}>={n} then 2*{n}-1-{m} else {m} end"


def sep_sql(out, src, val, taps, step=1, mode="reflect", keep=""):
    """CTEs {out}: (image_id,y,x,v) separable filter of ``val``; taps are literals."""
    r = len(taps) // 2
    tp = f"(values {','.join(f'({(i - r) * step},{float(t)!r}::double)' for i, t in enumerate(taps))}) t(d,w)"

    def one(name, source, value, axis, n):
        oth = "x" if axis == "y" else "y"
        return (
            f"{name}n as materialized (select a.image_id,a.y,a.x,t.w k,{folded(mode, f'a.{axis}+t.d', f'q.{n}')} p from {source} a join {out}d q using(image_id) cross join {tp}),"
            f"{name} as materialized (select a.image_id,a.y,a.x,sum(a.k*s.{value}) v from {name}n a join {source} s on s.image_id=a.image_id and s.{oth}=a.{oth} and s.{axis}=a.p group by a.image_id,a.y,a.x)"
        )

    return f"{out}d as materialized (select image_id,max(y)+1 h,max(x)+1 wd from {src} group by all)," + one(f"{out}y", src, val, "y", "h") + "," + one(out, f"{out}y", "v", "x", "wd")


def gauss_sql(out, src, val, sigma, mode="reflect"):
    return sep_sql(out, src, val, Kn.gaussian_taps(sigma), 1, mode)


def rank_sql(out, src, val, k, fn, mode):
    """Separable min/max/avg, or a full-window median."""
    r = k // 2
    dim = f"{out}d as materialized (select image_id,max(y)+1 h,max(x)+1 wd from {src} group by all)"
    if fn == "median":
        return dim + (
            f",{out}n as materialized (select a.image_id,a.y,a.x,{edge(mode, 'a.y+p.i', 'd.h')} ny,{edge(mode, 'a.x+q.j', 'd.wd')} nx from {src} a join {out}d d using(image_id) cross join (select i from range({-r},{r + 1}) q(i)) p cross join (select j from range({-r},{r + 1}) q(j)) q),"
            f"{out} as materialized (select a.image_id,a.y,a.x,median(s.{val}) v from {out}n a join {src} s on s.image_id=a.image_id and s.y=a.ny and s.x=a.nx group by a.image_id,a.y,a.x)"
        )

    def one(name, source, value, axis, n):
        oth = "x" if axis == "y" else "y"
        return (
            f"{name}n as materialized (select a.image_id,a.y,a.x,{edge(mode, f'a.{axis}+p.i', f'd.{n}')} p from {source} a join {out}d d using(image_id) cross join (select i from range({-r},{r + 1}) q(i)) p),"
            f"{name} as materialized (select a.image_id,a.y,a.x,{fn}(s.{value}) v from {name}n a join {source} s on s.image_id=a.image_id and s.{oth}=a.{oth} and s.{axis}=a.p group by a.image_id,a.y,a.x)"
        )

    return dim + "," + one(f"{out}y", src, val, "y", "h") + "," + one(out, f"{out}y", "v", "x", "wd")


def opening_sql(out, src, val, k, mode="reflect"):
    return rank_sql(f"{out}e", src, val, k, "min", mode) + "," + rank_sql(out, f"{out}e", "v", k, "max", mode)


def step(lo, hi, x):
    t = clip_sql(f"(({x})-({lo}))/(({hi})-({lo}))")
    return f"({t}*{t}*(3e0-2e0*{t}))"


def pix(df, *cols):
    return rounded(df.select("image_id", "y", "x", *cols), *cols)


@query("t01_local_median", "mos", f"select image_id,y,x,{s6('v', 'out')} from m", rank_sql("m", "mos", "v", 3, "median", "nearest"))
def t01(v):
    return pix(T.neighbourhood(v.mos), "out")


@query("t01_local_extremes", "mos", f"select a.image_id,a.y,a.x,{s6('a.v', 'lo')},{s6('b.v', 'hi')},{s6('c.v', 'mean')} from mn a join mx b using(image_id,y,x) join av c using(image_id,y,x)", ",".join([rank_sql("mn", "mos", "v", 5, "min", "reflect"), rank_sql("mx", "mos", "v", 5, "max", "reflect"), rank_sql("av", "mos", "v", 5, "avg", "mirror")]))
def t01b(v):
    a = T.neighbourhood(v.mos, k=5, how="min", mode="reflect", out="lo").join(T.neighbourhood(v.mos, k=5, how="max", mode="reflect", out="hi"), T.PIX)
    return pix(a.join(T.neighbourhood(v.mos, k=5, how="mean", mode="mirror", out="mean"), T.PIX), "lo", "hi", "mean")


@query("t02_spline_smooth", "mos", f"select image_id,y,x,{s6('v', 'out')} from s", sep_sql("s", "mos", "v", Kn.B3_SPLINE, 2, "mirror"))
def t02(v):
    return pix(T.atrous(v.mos, step=2), "out")


_K = T.derivative_kernel()[::-1]
KROON = (
    "kd as (select image_id,max(y)+1 h,max(x)+1 wd from mos group by all), kk(i,j,wy,wx) as (values "
    + ",".join(f"({i - 2},{j - 2},{float(_K[i, j])!r}::double,{float(_K[j, i])!r}::double)" for i in range(5) for j in range(5))
    + f"), kn as materialized (select a.image_id,a.y,a.x,wy,wx,{edge('nearest', 'a.y+i', 'd.h')} ny,{edge('nearest', 'a.x+j', 'd.wd')} nx from mos a join kd d using(image_id) cross join kk), kg as (select a.image_id,a.y,a.x,sum(wy*s.v) gy,sum(wx*s.v) gx from kn a join mos s on s.image_id=a.image_id and s.y=a.ny and s.x=a.nx group by all)"
)


@query("t02_gradient", "mos", f"select image_id,y,x,{s6('gy')},{s6('gx')},{s6('sqrt(gy*gy+gx*gx)', 'mag')} from kg", KROON)
def t02b(v):
    return pix(T.gradient(v.mos), "gy", "gx", "mag")


@query("t03_gaussian", "mos", f"select image_id,y,x,{s6('v')} from g", gauss_sql("g", "mos", "v", 2.0))
def t03(v):
    return pix(T.smooth(v.mos), "v")


@query("t03_gaussian_wide", "mos", f"select image_id,y,x,{s6('v')} from g", gauss_sql("g", "mos", "v", 12.0, "nearest"))
def t03b(v):
    return pix(T.smooth(v.mos, "v", 12.0, "nearest"), "v")


def planes_sql(src, val, n, mode="mirror"):
    """c1..cn successive smooths of val."""
    out, prev, col = [], src, val
    for i in range(1, n + 1):
        out.append(sep_sql(f"c{i}", prev, col, Kn.B3_SPLINE, 2 ** (i - 1), mode))
        prev, col = f"c{i}", "v"
    return ",".join(out)


@query(
    "t04_starlet_planes", "mos",
    f"select a.image_id,a.y,a.x,{s6('a.v-c1.v', 'w1')},{s6('c1.v-c2.v', 'w2')},{s6('c2.v-c3.v', 'w3')},{s6('c3.v', 'resid')} from mos a join c1 using(image_id,y,x) join c2 using(image_id,y,x) join c3 using(image_id,y,x)", planes_sql("mos", "v", 3),
)
def t04(v):
    return pix(T.starlet(v.mos), "w1", "w2", "w3", "resid")


@query("t05_top_hat", "mos", f"select a.image_id,a.y,a.x,{s6(clip_sql('a.v-op.v'), 'tophat')} from mos a join op using(image_id,y,x)", opening_sql("op", "mos", "v", 7))
def t05(v):
    return pix(T.top_hat(v.mos), "tophat")


@query(
    "t07_band_merge", "px", f"select a.image_id target_id,a.y,a.x,{s6(clip_sql('ls.v+b.v-hs.v'), 'v')} from lo a join hi b using(image_id,y,x) join ls using(image_id,y,x) join hs using(image_id,y,x)",
    "lo as materialized (select target_id image_id,y,x,avg(v) v from px group by all), hi as materialized (select target_id image_id,y,x,avg(v) v from px where frame_id%3=0 group by all)," + gauss_sql("ls", "lo", "v", 1.5) + "," + gauss_sql("hs", "hi", "v", 1.5),
)
def t07(v):
    m = lambda d: d.groupBy("target_id", "y", "x").agg(F.avg("v").alias("v"))
    return rounded(T.band_merge(m(v.px), m(v.px.filter("frame_id % 3 = 0")), 1.5), "v")


LUM = "lm as materialized (select image_id,y,x,(r+g+b)/3e0 v from rgb)"
LUMB = f"lm as materialized (select image_id,y,x,{LUMA} v from rgb)"


def scaled(new, floor="1e-6", missing="1e0"):
    return [clip_sql(f"{c}*(case when l>{floor} then ({new})/l else {missing} end)") for c in RGB]


def joined(*tables, extra=""):
    cols = ",".join(["rgb.*", "lm.v l"] + [f"{t}.v {t}v" for t in tables])
    return f"(select {cols}{extra} from rgb join lm using(image_id,y,x) " + " ".join(f"join {t} using(image_id,y,x)" for t in tables) + ")"


@query("t08_structure_boost", "rgb", out3(scaled(clip_sql(f"l+0.6e0*(c2v-c5v)*{step('0.06e0', '0.22e0', 'c6v')}"), "1e-4", "0e0"), joined("c2", "c5", "c6")), LUM + "," + planes_sql("lm", "v", 6))
def t08(v):
    return fin(T.structure_boost(v.rgb))


_M = step("0.10e0", "0.55e0", "bs")
_HDR = clip_sql(f"l*(1e0-{_M})+{clip_sql('md+(bs-md)*0.85e0+(l-bs)')}*{_M}")


@query("t09_hdr_core", "rgb", out3(scaled(_HDR, "1e-4", "0e0"), "(select q.*," + clip_sql("c4v") + f" bs,md from {joined('c4')} q join (select image_id,median({clip_sql('v')}) md from c4 group by all) using(image_id))"), LUM + "," + planes_sql("lm", "v", 4))
def t09(v):
    return fin(T.hdr_core(v.rgb, 4))


def shrink_sql(name, src, col, thr, amt):
    return f"""{name}m as (select image_id,c,median({col}) m from {src} group by all), {name}s as (select image_id,c,1.4826e0*median(abs({col}-m)) s from {src} join {name}m using(image_id,c) group by image_id,c),
    {name} as materialized (select image_id,c,y,x,case when s>0 then {col}*(1e0-{amt}+{amt}*{clip_sql(f'abs({col})/({thr}*s)')}) else {col} end v from {src} join {name}s using(image_id,c))"""


def pyramid_sql(long, layers):
    """Denoise CTEs over a long (image_id,c,y,x,v) table by packing (image, channel) into one id."""
    ctes = [f"pk as materialized (select image_id*10+case c when 'r' then 0 when 'g' then 1 else 2 end image_id,y,x,v from {long})"]
    prev, sums = "pk", []
    for i, (k, thr, amt, rounds) in enumerate(layers):
        ctes.append(rank_sql(f"d{i}", prev, "v", k, "median", "mirror"))
        ctes.append(f"w{i} as materialized (select a.image_id,0 c,a.y,a.x,a.v-b.v v from {prev} a join d{i} b using(image_id,y,x))")
        src = f"w{i}"
        for j in range(rounds):
            ctes.append(shrink_sql(f"w{i}r{j}", src, "v", f"{thr!r}::double", f"{amt!r}::double"))
            src = f"w{i}r{j}"
        sums.append(src)
        prev = f"d{i}"
    ctes.append(f"dn as materialized (select {prev}.image_id//10 image_id,{prev}.image_id%10 c,y,x,{prev}.v+" + "+".join(f"{s}.v" for s in sums) + f" v from {prev} " + " ".join(f"join {s} using(image_id,y,x)" for s in sums) + ")")
    return ",".join(ctes)


LONG = "lg as (" + " union all ".join(f"select image_id,'{c}' c,y,x,{c} v from rgb" for c in RGB) + ")"
PIVOT = ",".join(f"max(v) filter (c={i}) {c}" for i, c in enumerate(RGB))


@query("t10_noise_reduction", "rgb", per(clip_sql("$"), f"(select image_id,y,x,{PIVOT} from dn group by all)"), LONG + "," + pyramid_sql("lg", [(3, 3.0, 0.6, 2), (5, 2.5, 0.4, 1)]))
def t10(v):
    return fin(T.noise_reduction(v.rgb))


@query(
    "t10_chroma_noise_reduction", "rgb", out3([clip_sql(f"l+d{c}") for c in RGB], f"(select image_id,y,x,(r+g+b)/3e0 l from rgb) join (select image_id,y,x,{PIVOT.replace('filter', 'filter').replace(') r', ') dr').replace(') g', ') dg').replace(') b', ') db')} from dn group by all) using(image_id,y,x)"),
    "lg as (" + " union all ".join(f"select image_id,'{c}' c,y,x,{c}-(r+g+b)/3e0 v from rgb" for c in RGB) + ")," + pyramid_sql("lg", [(3, 3.0, 0.65, 2), (5, 2.5, 0.45, 1), (9, 2.0, 0.15, 1)]),
)
def t10b(v):
    return fin(T.chroma_nr(v.rgb, 0.3))


_W = ["(l-c1v)", "(c1v-c2v)", "(c2v-c3v)", "(c3v-c4v)", "(c4v-c5v)", "(c5v-c6v)"]
_D1 = f"({_W[0]}+0.5e0*(sign({_W[0]})*greatest(abs({_W[0]})-3e0*sg,0e0)*(1e0-0.95e0*0.5e0)-{_W[0]}))"
_B = {1: 0.3**1.5 * 3, 2: 0.5**1.5 * 3}
_SH = clip_sql(f"c6v+{_D1}+" + "+".join(f"{w}*{1 + _B.get(i, 0.0)!r}::double" for i, w in enumerate(_W) if i > 0))


@query("t11_wavelet_sharpen", "rgb", out3(scaled(_SH), f"(select q.*,sg from {joined('c1', 'c2', 'c3', 'c4', 'c5', 'c6')} q join (select image_id,1.4826e0*median(abs(lm.v-c1.v))+1e-9 sg from lm join c1 using(image_id,y,x) group by image_id) using(image_id))"), LUMB + "," + planes_sql("lm", "v", 6))
def t11(v):
    return fin(T.wavelet_sharpen(v.rgb, [0, 30, 50], [50]))


_RS = ["(r-c1v)", "(c1v-c2v)", "(c2v-c3v)", "(c3v-c4v)"]
_AD = f"(0.18e0*{_RS[1]}+0.3e0*{_RS[2]}+0.18e0*{_RS[3]})"


@query("t11_disc_sharpen", "rgb", f"select image_id,y,x,{s6(clip_sql(f'r+{_AD}-0.95e0*greatest(0e0,r+{_AD}-1e0)+0.95e0*greatest(0e0,-(r+{_AD}))'), 'r')} from {joined('c1', 'c2', 'c3', 'c4')}", "lm as materialized (select image_id,y,x,r v from rgb)," + planes_sql("lm", "v", 4, "reflect"))
def t11b(v):
    return pix(T.disc_sharpen(v.rgb, 0.3), "r")


@query(
    "t12_local_contrast", "rgb", out3([clip_sql(f"{c}+0.12e0*(3e0*sc*tanh((l-gv)/(3e0*sc)))") for c in RGB], f"(select q.*,sc from {joined('g')} q join (select image_id,quantile_cont(abs(lm.v-g.v),0.9)+1e-6 sc from lm join g using(image_id,y,x) group by image_id) using(image_id))"),
    LUMB + "," + gauss_sql("g", "lm", "v", 32.0),
)
def t12(v):
    return fin(T.local_contrast(v.rgb))


@query("t12_disc_local_contrast", "rgb", out3([clip_sql(f"{c}+0.4e0*(l-gv)") for c in RGB], joined("g")), LUM + "," + gauss_sql("g", "lm", "v", 32.0, "nearest"))
def t12b(v):
    return fin(T.disc_local_contrast(v.rgb))


def knee_sql(x, k):
    return f"(case when {x}>{k} then {k}+(1e0-{k})*((({x}-{k})/(1e0-{k}))/(1e0+({x}-{k})/(1e0-{k}))) else {x} end)"


@query("t13_highlight_rolloff", "rgb", out3(scaled("hn"), f"(select *,{clip_sql(knee_sql('hc', '0.9e0'))} hn from (select *,{clip_sql(knee_sql('gv', '0.6e0') + '+l-gv')} hc from {joined('g')}))"), LUMB + "," + gauss_sql("g", "lm", "v", 2.0, "nearest"))
def t13(v):
    return fin(T.highlight_rolloff(v.rgb, 0.6))


@query("t13_core_transparency", "rgb", out3(scaled(clip_sql(f"l+0.9e0*(l-gv)*{step('0.12e0', '0.37e0', 'gv')}")), joined("g")), LUMB + "," + gauss_sql("g", "lm", "v", 4.0, "nearest"))
def t13b(v):
    return fin(T.core_transparency(v.rgb, 0.6))


@query("t13_dim_core", "rgb", out3(scaled(f"l*(1e0-0.4e0*{step('0.18e0', '0.42e0', 'gv')})"), joined("g")), LUMB + "," + gauss_sql("g", "lm", "v", 6.4, "nearest"))
def t13c(v):
    return fin(T.dim_core(v.rgb, 0.5))


_HT, _MD = "greatest(l-otv,0e0)", "greatest(otv-omv,0e0)"


@query(
    "t14_star_reduction", "rgb", out3(scaled(f"l-0.7e0*(1e0-{step('0.18e0', '0.45e0', 'pkv')})*({_HT}+0.35e0*{_MD})"), joined("ot", "om", "pk")),
    LUMB + "," + opening_sql("ot", "lm", "v", 3, "nearest") + "," + opening_sql("om", "ot", "v", 7, "nearest")
    + ",sm as materialized (select image_id,y,x,greatest(lm.v-ot.v,0e0)+greatest(ot.v-om.v,0e0) v from lm join ot using(image_id,y,x) join om using(image_id,y,x))," + rank_sql("pk", "sm", "v", 7, "max", "nearest"),
)
def t14(v):
    return fin(T.shrink_stars(v.rgb, 0.7, 0.0))


DARK = "dk as materialized (select image_id,y,x,pow(r,3)*0.6e0 r,pow(g,3)*0.5e0 g,pow(b,3)*0.5e0 b from rgb)"


def darkened(v):
    return v.rgb.withColumns({"r": F.pow("r", 3) * 0.6, "g": F.pow("g", 3) * 0.5, "b": F.pow("b", 3) * 0.5})


_SEG = {
    "Stars": "star", "Bright stars": f"star*{step('0.35e0', '0.75e0', 'pk')}", "Faint stars": f"star*(1e0-{step('0.35e0', '0.75e0', 'pk')})", "Nebulosity": "neb", "Bright nebulosity": f"neb*{step('0.1e0', '0.3e0', 'ns')}",
    "Faint nebulosity": f"neb*(1e0-{step('0.1e0', '0.3e0', 'ns')})", "Sky": "sky", "Dust": "dust", "Cores": step("0.9e0", "0.99e0", "l"), "Hα (red)": f"neb*{step('0.02e0', '0.12e0', clip_sql('r-greatest(g,b)'))}",
}


@query(
    "t15_semantic_masks", "rgb", " union all ".join(f"select image_id,y,x,'{n}' \"name\",{s6(clip_sql(e), 'w')} from sg" for n, e in _SEG.items()),
    DARK + f", lm as materialized (select image_id,y,x,{LUMA} v from dk)," + gauss_sql("g1", "lm", "v", 1.0) + "," + gauss_sql("g12", "lm", "v", 12.0) + "," + opening_sql("op", "lm", "v", 7) + "," + rank_sql("pk", "lm", "v", 5, "max", "reflect")
    + f""", sq as (select image_id,median(lm.v) bg,1.4826e0*median(abs(lm.v-g1.v))+1e-6 nz from lm join g1 using(image_id,y,x) group by image_id),
    s0 as materialized (select image_id,y,x,{step('4e0*nz', '10e0*nz', clip_sql('lm.v-op.v'))} v from lm join op using(image_id,y,x) join sq using(image_id)),""" + gauss_sql("s1", "s0", "v", 1.0)
    + f""", n0 as materialized (select image_id,y,x,{clip_sql(clip_sql('(lm.v-bg)/greatest(1e0-bg,1e-6)') + '*(1e0-' + clip_sql('s1.v') + ')')} v from lm join s1 using(image_id,y,x) join sq using(image_id)),""" + gauss_sql("n1", "n0", "v", 2.0)
    + f""", k0 as materialized (select image_id,y,x,{clip_sql('s1.v')} star,n1.v ns,{clip_sql('(1e0-' + step('0.015e0', '0.10e0', 'n1.v') + ')*(1e0-' + clip_sql('s1.v') + ')')} sky from s1 join n1 using(image_id,y,x)),
    u0 as materialized (select image_id,y,x,case when 0.08e0<=3e0*nz then case when {clip_sql('g12.v-lm.v')}>=0.08e0 then 1e0 else 0e0 end else {step('3e0*nz', '0.08e0', clip_sql('g12.v-lm.v'))} end*(1e0-sky)*(1e0-star) v from lm join g12 using(image_id,y,x) join k0 using(image_id,y,x) join sq using(image_id)),""" + gauss_sql("u1", "u0", "v", 1.0)
    + f""", sg as (select image_id,y,x,dk.r,dk.g,dk.b,lm.v l,star,ns,sky,pk.v pk,{clip_sql('u1.v')} dust,{step('0.015e0', '0.12e0', 'ns')} neb from dk join lm using(image_id,y,x) join k0 using(image_id,y,x) join u1 using(image_id,y,x) join pk using(image_id,y,x))""",
)
def t15(v):
    return rounded(T.segment(darkened(v)), "w")


@query(
    "t16_starless", "rgb", out3([f"{c}*(1e0-mv)+{c}o*mv" for c in RGB], "(select rgb.*,o0.v ro,o1.v go,o2.v bo,m1.v mv from rgb join o0 using(image_id,y,x) join o1 using(image_id,y,x) join o2 using(image_id,y,x) join m1 using(image_id,y,x))"),
    LUMB + "," + ",".join(opening_sql(f"o{i}", "rgb", c, 5) for i, c in enumerate(RGB)) + "," + opening_sql("ol", "lm", "v", 5)
    + f",hq as (select image_id,y,x,{clip_sql('lm.v-ol.v')} v from lm join ol using(image_id,y,x)), m0 as materialized (select image_id,y,x,{clip_sql('v/(q+1e-6)')} v from hq join (select image_id,quantile_cont(v,0.995) q from hq group by all) using(image_id))," + gauss_sql("m1", "m0", "v", 1.0),
)
def t16(v):
    return fin(T.starless(v.rgb, 2))


def fuzz_sql(l, lo, hi, f="0.15e0"):  # noqa: E741
    return f"({step(f'{lo}-{f}', lo, l)}*(1e0-{step(hi, f'{hi}+{f}', l)}))"


@query("p18_range_mask", "rgb", f"select image_id,y,x,{s6(clip_sql('v'), 'w')} from g", f"lm as materialized (select image_id,y,x,{fuzz_sql('((r+g+b)/3e0)', '0.45e0', '0.55e0')} v from rgb)," + gauss_sql("g", "lm", "v", 4.0))
def p18(v):
    return pix(T.range_mask(v.rgb, 0.45, 0.55), "w")


def ramp_sql(v, lo, hi, f="0.15e0"):
    return f"(case when {v}>{hi} and {v}<{hi}+{f} then ({hi}+{f}-{v})/{f} when {v}<{lo} and {v}>{lo}-{f} then ({v}-({lo}-{f}))/{f} when {v}>={lo} and {v}<={hi} then 1e0 else 0e0 end)"


@query("p18_range_ramp", "rgb", f"select image_id,y,x,{s6(clip_sql('v'), 'w')} from g", f"lm as materialized (select image_id,y,x,{ramp_sql('((r+g+b)/3e0)', '0.48e0', '0.52e0')} v from rgb)," + gauss_sql("g", "lm", "v", 3.0))
def p18b(v):
    return pix(T.ramp_mask(v.rgb, 0.48, 0.52, smoothing=3.0), "w")


from skyframe.plans.point_queries import DIM, LG, PATCH  # noqa: E402

_VK = "case when vv>0.001 then " + clip_sql("((${0}-vv)+sqrt((${0}-vv)*(${0}-vv)+greatest(0.002e0,0.15e0*vv)*greatest(0.002e0,0.15e0*vv)))/(2e0*(1e0-vv))".replace("${0}", "$")) + " else $ end"


@query(
    "p22_dehaze", "rgb", out3([clip_sql(f"{c}*(1e0-w)+w*({c}*(1e0-aw)+l*aw)") for c in RGB],
    "(select *,case when image_id=1 then 0e0 else 0.42e0 end*rt/sqrt(1e0+rt*rt) aw from (select *,(greatest(0e0,least(r-g,g-b))+case when image_id=0 then greatest(0e0,b-r) else 0e0 end)/(l+0.03e0)*6e0 rt from (select kn.*,(r+g+b)/3e0 l," + clip_sql("mk.v") + " w from kn join mk using(image_id,y,x))))"),
    ",".join([ST, DIM, PATCH]) + f", vl as (select image_id,0.6e0*greatest(0e0,case when clean_sky>0 then clean_sky else med end-0.05e0) vv from du join st using(image_id)), kn as materialized (select image_id,y,x,{','.join(_VK.replace('$', c) + ' ' + c for c in RGB)} from rgb join vl using(image_id)), m0 as materialized (select image_id,y,x,{ramp_sql('((r+g+b)/3e0)', '0e0', '0.7e0')} v from kn)," + gauss_sql("mk", "m0", "v", 12.0),
)
def p22(v):
    cls = v.rgb.select("image_id").distinct().selectExpr("image_id", "case image_id when 0 then 'emission' when 1 then 'milkyway' else 'open' end object_class")
    return fin(T.dehaze(v.rgb, 0.6, 0.05, cls))


@query("p23_reduce_cast", "rgb", out3([clip_sql(f"{c}*(1e0-w)+({c}*0.7e0+(r+g+b)/3e0*0.3e0)*w") for c in RGB], "(select rgb.*," + clip_sql("mk.v") + " w from rgb join mk using(image_id,y,x))"), ST + f", m0 as materialized (select image_id,y,x,{ramp_sql('((r+g+b)/3e0)', '0e0', 'med')} v from rgb join st using(image_id))," + gauss_sql("mk", "m0", "v", 12.0))
def p23(v):
    return fin(T.reduce_cast(v.rgb))


_BGK = clip_sql("(($-c)+sqrt(($-c)*($-c)+e*e))/(2e0*(1e0-c))")


@query(
    "p24_masked_background_level", "rgb", out3([f"case when med>0.305e0 then {c}*(1e0-w)+{mtf_sql('m', _BGK.replace('$', c))}*w else {c} end" for c in RGB], "(select rgb.*,med,c,e,m," + clip_sql("mk.v") + " w from rgb join mk using(image_id,y,x) join s2 using(image_id))"),
    ST + f", s1 as (select *,med-6e0*dev c,greatest(0.3e0*dev,1e-5) e from st), s2 as (select *,{bal_sql('0.3e0', '((med-c)+sqrt((med-c)*(med-c)+e*e))/(2e0*(1e0-c))')} m from s1), m0 as materialized (select image_id,y,x,{fuzz_sql('((r+g+b)/3e0)', '0e0', 'med')} v from rgb join st using(image_id))," + gauss_sql("mk", "m0", "v", 4.0),
)
def p24b(v):
    return fin(T.pull_background_masked(v.rgb, P.background_level(v.rgb, 0.3)))


@query("p26_deepen", "rgb", out3([clip_sql(f"{c}*w+{mtf_sql('(0.5e0-0.35e0*0.7e0*0.5e0)', c)}*(1e0-w)") for c in RGB], "(select a1.*," + clip_sql("mk.v") + " w from a1 join mk using(image_id,y,x))"), f"a1 as materialized (select image_id,y,x,{','.join(mtf_sql('(0.5e0-0.35e0*0.3e0*0.5e0)', c) + ' ' + c for c in RGB)} from rgb), m0 as materialized (select image_id,y,x,{fuzz_sql('((r+g+b)/3e0)', '0.35e0', '1e0', '0.4e0')} v from a1)," + gauss_sql("mk", "m0", "v", 20.0))
def p26(v):
    return fin(T.deepen(v.rgb, 0.5))


@query(
    "p26_restore_highlights", "rgb", out3([clip_sql(f"o{c}-k*(o{c}-s{c})") for c in RGB], f"(select *,{step('0.015e0', '0.065e0', '(ob-sb)-(orr-sr)')} k,orr \"or\" from (select *,t{RGB[0]}*(1e0-w)+sr*w orr,tg*(1e0-w)+sg*w og,tb*(1e0-w)+sb*w ob from t1))").replace("or-k*(or-sr)", "orr-k*(orr-sr)").replace(',orr "or"', ""),
    f"m0 as materialized (select image_id,y,x,{fuzz_sql('((r+g+b)/3e0)', '0.35e0', '1e0', '0.4e0')} v from rgb)," + gauss_sql("mk", "m0", "v", 20.0)
    + f", s1 as (select image_id,y,x,r*0.8e0 tr,g*0.8e0 tg,b*0.9e0 tb,{','.join(mtf_sql('(0.5e0-0.35e0*0.3e0*0.5e0)', c) + f' s{c}' for c in RGB)},{clip_sql('mk.v')} w0 from rgb join mk using(image_id,y,x)), t1 as (select *,greatest(w0,{step('0.05e0', '0.12e0', 'sb-sr')}*{clip_sql('((sr+sg+sb)/3e0-0.16e0)/0.12e0')}) w from s1)",
)
def p26b(v):
    target = v.rgb.withColumns({"r": F.col("r") * 0.8, "g": F.col("g") * 0.8, "b": F.col("b") * 0.9})
    return fin(T.restore_highlights(target, v.rgb, 0.5))


SNR = "sn as materialized (select image_id,y,x,greatest((r+g+b)/3e0,0e0)/(0.01e0+b*0.1e0+1e-6) snr,(y*3+x)%9+1 coverage from rgb)"


def snr_parts(v):
    noise = v.rgb.select(*T.PIX, (0.01 + F.col("b") * 0.1).alias("noise"))
    cov = v.rgb.select(*T.PIX, ((F.col("y") * 3 + F.col("x")) % 9 + 1).alias("coverage"))
    return noise, cov


@query("p28_snr_protect", "rgb", f"select image_id,y,x,{s6(clip_sql('v') + '*0.5e0', 'w')} from g", SNR + f", m0 as materialized (select image_id,y,x,greatest({clip_sql('(hi-snr)/(hi-lo+1e-9)')},1e0-coverage/9e0) v from sn join (select image_id,quantile_cont(snr,0.2) lo,quantile_cont(snr,0.7) hi from sn group by all) using(image_id))," + gauss_sql("g", "m0", "v", 8.0))
def p28(v):
    noise, cov = snr_parts(v)
    raw = K.snr_protect(K.snr_map(v.rgb, noise, mean_of(RGB)), cov)
    return T.smooth(raw, "w", 8.0).select(*T.PIX, r6(F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)) * 0.5).alias("w"))


SIG = LUM + "," + gauss_sql("dt", "lm", "v", 1.5) + f", sk as (select image_id,median(v) sky from dt group by all), m0 as materialized (select image_id,y,x,{step('1.5e0', '4e0', '(dt.v-sky)/(0.01e0+b*0.1e0+1e-9)')}*sqrt(((y*3+x)%9+1)/9e0) v from dt join sk using(image_id) join rgb using(image_id,y,x))," + gauss_sql("g", "m0", "v", 3.0)


def sig(v):
    noise, cov = snr_parts(v)
    return T.significance_weight(v.rgb, noise, cov)


@query("p29_significance_weight", "rgb", f"select image_id,y,x,{s6(clip_sql('v'), 'w')} from g", SIG)
def p29(v):
    return pix(sig(v), "w")


@query("p30_significance_display", "rgb", out3([clip_sql(f"fl+(1e0-0.7e0*(1e0-w))*({c}-fl)") for c in RGB], f"(select rgb.*,{clip_sql('g.v')} w,fl from rgb join g using(image_id,y,x) join (select image_id,median(v) fl from lm group by all) using(image_id))"), SIG)
def p30(v):
    return fin(T.significance_display(v.rgb, sig(v), 0.7))


@query("a15_noise_sigma", "rgb", " union all ".join(f"select image_id,'{c}' c,{s6('s', 'sigma')} from n{c}" for c in RGB), ",".join(f"{sep_sql(f's{c}', 'rgb', c, Kn.B3_SPLINE)},e{c} as materialized (select image_id,{c}-s{c}.v v from rgb join s{c} using(image_id,y,x)),n{c} as (select image_id,1.4826e0*median(abs(v-m))/0.8908e0 s from e{c} join (select image_id,median(v) m from e{c} group by all) using(image_id) group by image_id)" for c in RGB))
def a15(v):
    return rounded(T.noise_sigma(v.rgb), "sigma")


def grid_sql(n, m, axis):
    return f"(select t,case when {m}=1 then 0e0 else t*(select max({axis}) from px)/({m}-1e0) end pos from range({m}) r(t))"


@query(
    "j22_map_resize", "px",
    f"""select target_id,y,x,{s6('sum(wy*wx*v)', 'v')} from (select a.target_id,ty.t y,tx.t x,a.v,greatest(0e0,1e0-abs(ty.pos-a.y)) wy,greatest(0e0,1e0-abs(tx.pos-a.x)) wx from mm a,{grid_sql('h', 13, 'y')} ty,{grid_sql('w', 5, 'x')} tx) where wy*wx>0 group by target_id,y,x""",
    "mm as materialized (select target_id,y,x,avg(v) v from px group by all)",
)
def j22(v):
    m = v.px.groupBy("target_id", "y", "x").agg(F.avg("v").alias("v"))
    return T.resize(m, 13, 5, keys=["target_id"]).select("target_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v").alias("v"))


OFFS = "(frame_id%7-3)*0.3e0"


@query(
    "j13_shift_resample", "px",
    f"select target_id,frame_id,y,x,case when sum(w)>1-1e-9 then {'round(sum(w*v),6)+0e0'} end v from (select p.target_id,p.frame_id,ty y,tx x,v,greatest(0e0,1e0-abs(ty-{OFFS}-p.y))*greatest(0e0,1e0-abs(tx+{OFFS}*2-p.x)) w from px p,range(8) a(ty),range(8) b(tx) where abs(ty-{OFFS}-p.y)<1 and abs(tx+{OFFS}*2-p.x)<1) where w>1e-12 group by all".replace("group by all", "group by target_id,frame_id,y,x"),
)
def j13(v):
    k = (F.col("frame_id") % 7 - 3) * 0.3
    off = v.frame_tile.select("target_id", "frame_id", (k * -2).alias("dx"), k.alias("dy"))
    d = T.shift(v.px, off)
    return d.select("target_id", "frame_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("v").alias("v"))


@query("k04_star_threshold", "mos", f"select image_id,{s6('quantile_cont(v,0.995)', 'thr')} from mos group by image_id")
def k04b(v):
    return rounded(group_quantiles(v.mos, ["image_id"], "v", {"thr": linear(0.995)}), "thr")
