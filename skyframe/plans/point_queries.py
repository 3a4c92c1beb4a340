"""Image statistics and point transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import math as M
from skyframe.functions.quantiles import group_quantiles, kth_largest, linear, lower, upper_median
from skyframe.operators import masks as K
from skyframe.operators import pixel as P
from skyframe.operators import stats as S
from skyframe.plans.catalogue import query, r6, rounded, s6

RGB = ("r", "g", "b")
LG = "lg as materialized (" + " union all ".join(f"select image_id,y,x,'{c}' c,{c} v from rgb" for c in RGB) + ")"
ST = LG + ", cm as materialized (select image_id,c,median(v) med,avg(v) mean from lg group by all), cs as materialized (select lg.image_id,lg.c,med,mean,avg(abs(v-med)) dev from lg join cm using(image_id,c) group by all), st as materialized (select image_id,avg(med) med,avg(mean) mean,avg(dev) dev from cs group by all)"


def out3(exprs, src="rgb", extra=""):
    """select image, pixel and three rounded channels."""
    return f"select image_id,y,x,{','.join(s6(e, c) for e, c in zip(exprs, RGB))} from {src} {extra}"


def per(fmt, src="rgb", extra=""):
    return out3([fmt.replace("$", c) for c in RGB], src, extra)


def mtf_sql(m, x):
    return f"(case when ({x})<=0 then 0e0 when ({x})>=1 then 1e0 else (({m})-1e0)*({x})/((2e0*({m})-1e0)*({x})-({m})) end)"


def clip_sql(x):
    return f"least(greatest({x},0e0),1e0)"


def bal_sql(v0, v1):
    return f"(case when ({v1})<=0 then 0e0 when ({v1})>=1 then 1e0 else {mtf_sql(v0, v1)} end)"


def fin(df):
    return rounded(df.select("image_id", "y", "x", *RGB), *RGB)


LUMA = "(0.2126e0*r+0.7152e0*g+0.0722e0*b)"


@query("p01_luminance", "rgb", f"select image_id,y,x,{s6('(r+g+b)/3e0', 'mean_lum')},{s6(LUMA, 'luma')} from rgb")
def p01(v):
    return v.rgb.select("image_id", "y", "x", r6(S.mean_of(RGB)).alias("mean_lum"), r6(P.luma()).alias("luma"))


@query("p02_midtones_transfer", "rgb", per(mtf_sql("0.2e0", "$*1.4e0-0.3e0")))
def p02(v):
    return fin(P.midtones(P.each(v.rgb, lambda c: c * 1.4 - 0.3), 0.2))


@query("p03_midtones_solve", "rgb", f"select image_id,{s6(bal_sql('0.25e0', 'med'), 'm')} from st", ST)
def p03(v):
    return S.image_stats(v.rgb).select("image_id", r6(M.midtones_balance(0.25, F.col("med"))).alias("m"))


@query("p03_midtones_bisection")
def p03b(v):
    """Iterative solve beside the closed form; both reach the goal within 5e-5."""
    s = S.image_stats(v.rgb)
    m, c = M.midtones_bisect(0.25, F.col("med")), M.midtones_balance(0.25, F.col("med"))
    return s.select("image_id", m.alias("m_bisect"), c.alias("m_closed"), (F.abs(M.mtf(m, F.col("med")) - 0.25) < 5e-5).alias("ok"))


@query("p04_soft_knee", "rgb", per("(($-round(0.123456789e0,8))+sqrt(($-round(0.123456789e0,8))*($-round(0.123456789e0,8))+round(0.0312e0*0.0312e0,12)))/round(2e0*(1e0-0.123456789e0),8)"))
def p04(v):
    return fin(P.each(v.rgb, lambda c: M.soft_knee_fixed(c, F.lit(0.123456789), F.lit(0.0312))))


@query("p05_levels", "rgb", per(f"pow({clip_sql('($-0.3e0)/(0.8e0-0.3e0)')},1e0/1.5e0)"))
def p05(v):
    return fin(P.levels(v.rgb, 0.3, 0.8, 1.5))


@query("p05_tone_triple", "rgb", per(clip_sql(mtf_sql("0.4e0", clip_sql("($-0.2e0)/0.7e0")))))
def p05b(v):
    return fin(P.tone_triple(v.rgb, 0.2, 0.4, 0.9))


POINTS = [(0.0, 0.05), (0.3, 0.2), (0.6, 0.75), (1.0, 0.95)]


def lut_sql(v, lut="l"):
    return f"({lut}[cast(floor({clip_sql(v)}*1023e0) as int)+1]*(1e0-({clip_sql(v)}*1023e0-floor({clip_sql(v)}*1023e0)))+{lut}[least(cast(floor({clip_sql(v)}*1023e0) as int)+2,1024)]*({clip_sql(v)}*1023e0-floor({clip_sql(v)}*1023e0)))"


LUT = "lut as (select [" + ",".join(f"{t!r}::double" for t in M.curve_table(POINTS)) + "] l)"


@query("p06_curve_rgb", "rgb", per(lut_sql("$"), "rgb,lut"), LUT)
def p06(v):
    return fin(P.apply_curve(v.rgb, POINTS))


@query("p06_curve_luminance", "rgb", per(f"$*(case when lum>1e-6 then {lut_sql('lum')}/greatest(lum,1e-6) else 1e0 end)", f"(select *,{LUMA} lum from rgb),lut"), LUT)
def p06b(v):
    return fin(P.apply_curve(v.rgb, POINTS, "luminance"))


@query("p07_pivot_contrast", "rgb", per(clip_sql(M.piecewise_sql(M.contrast_pieces(0.3, 0.25), clip_sql("$")))))
def p07(v):
    return fin(P.contrast(v.rgb, 0.3, 0.25))


@query("p07_disc_contrast", "rgb", per(clip_sql(M.piecewise_sql(M.akima_pieces((0, 0.25, 0.8, 1), (0, 0.2, 0.84, 1)), clip_sql("$")))))
def p07b(v):
    return fin(P.disc_contrast(v.rgb, 0.2))


@query("p08_green_removal", "rgb", out3([clip_sql("r*k"), clip_sql("gn*k"), clip_sql("b*k")], "(select *,case when r+gn+b>0 then (r+g+b)/(r+gn+b) else 1e0 end k from (select *,0.2e0*g+0.8e0*least(g,0.5e0*(r+b)) gn from rgb))"))
def p08(v):
    return fin(P.remove_green(v.rgb, 0.8))


_LIN = lambda c: f"(case when {c}<=0.04045e0 then {c}/12.92e0 else pow(({c}+0.055e0)/1.055e0,2.4e0) end)"
_D = "(6e0/29e0)"
_F = lambda t: f"(case when {t}>pow({_D},3) then cbrt({t}) else {t}/(3e0*{_D}*{_D})+4e0/29e0 end)"
_FI = lambda t: f"(case when {t}>{_D} then pow({t},3) else 3e0*{_D}*{_D}*({t}-4e0/29e0) end)"
_SR = lambda c: f"(case when greatest({c},0e0)<=0.0031308e0 then greatest({c},0e0)*12.92e0 else 1.055e0*pow(greatest({c},0e0),1e0/2.4e0)-0.055e0 end)"
_INV = P._inverse3(P.RGB_TO_XYZ)


@query(
    "p09_lab_saturation", "rgb",
    out3([clip_sql(_SR(f"(x3*{r[0]!r}::double+y3*{r[1]!r}::double+z3*{r[2]!r}::double)")) for r in _INV], "d"),
    f"""a as (select image_id,y,x,{','.join(f'{_LIN(c)} l{c}' for c in RGB)} from rgb),
    b1 as (select image_id,y,x,{','.join(f'(lr*{m[0]}e0+lg*{m[1]}e0+lb*{m[2]}e0)/{w}e0 t{i}' for i, (m, w) in enumerate(zip(P.RGB_TO_XYZ, P.D65)))} from a),
    c1 as (select image_id,y,x,{','.join(f'{_F(f"t{i}")} f{i}' for i in range(3))} from b1),
    c2 as (select image_id,y,x,116e0*f1-16e0 ll,500e0*(f0-f1)*1.34e0 aa,200e0*(f1-f2)*1.34e0 bb from c1),
    d as (select image_id,y,x,{_FI('((ll+16e0)/116e0+aa/500e0)')}*0.95047e0 x3,{_FI('((ll+16e0)/116e0)')} y3,{_FI('((ll+16e0)/116e0-bb/200e0)')}*1.08883e0 z3 from c2)""",
)
def p09(v):
    return fin(P.saturation(v.rgb, 0.4))


@query("p10_mean_saturation", "rgb", per(clip_sql("(r+g+b)/3e0+($-(r+g+b)/3e0)*1.3e0")))
def p10(v):
    return fin(P.mean_saturation(v.rgb, 0.3))


_EM = M.akima_pieces(*P.EMISSION_S)


@query(
    "p10_emission_boost", "rgb", per(clip_sql(f"s$*(1e0-m)+{clip_sql(M.piecewise_sql(_EM, clip_sql('s$')))}*m"), "e2"),
    f"""e1 as (select *,(r+g+b)/3e0 l,{clip_sql('greatest(0e0,r-greatest(g,b))*5e0')} m from rgb),
    e2 as (select *,{','.join(clip_sql(f'{c}*(1e0-m)+{clip_sql(f"l+({c}-l)*1.35e0")}*m') + f' s{c}' for c in RGB)} from e1)""",
)
def p10b(v):
    return fin(P.emission_boost(v.rgb))


@query("p11_white_balance", "rgb", out3([clip_sql("r*1.15e0*k"), clip_sql("g*1.06e0*k"), clip_sql("b*0.85e0*k")], f"rgb join (select image_id,avg({LUMA})/avg(0.2126e0*r*1.15e0+0.7152e0*g*1.06e0+0.0722e0*b*0.85e0) k from rgb group by all) using(image_id)"))
def p11(v):
    return fin(P.white_balance(v.rgb, 0.5, -0.4))


@query("p12_duotone", "rgb", out3([clip_sql("pow((r+g+b)/3e0,0.85e0)*1.02e0"), clip_sql("pow((r+g+b)/3e0,1.15e0)*0.93e0"), clip_sql("pow((r+g+b)/3e0,1.9e0)*0.72e0")]))
def p12(v):
    return fin(P.golden_tone(v.rgb))


@query(
    "p13_narrowband_combine", "rgb",
    " union all ".join(
        f"select '{k}' palette,image_id,y,x,{','.join(s6(clip_sql(e), c) for e, c in zip(t, RGB))} from rgb"
        for k, t in {"SHO": ("case when x%5=0 then r else b end", "r", "g"), "HOS": ("r", "g", "case when x%5=0 then g else b end"), "HOO": ("r", "g", "g"), "OSC-SHO": ("r", "(r+(g+b)/2e0)/2e0", "(g+b)/2e0"), "OSC-HOO": ("r", "(g+b)/2e0", "(g+b)/2e0")}.items()
    ),
)
def p13(v):
    mono = lambda c: v.rgb.select("image_id", "y", "x", F.col(c).alias("v"))
    sii = mono("b").filter("x % 5 <> 0")
    tasks = P.pixel_tasks(mono("r"), mono("g"), sii)
    parts = [(k, P.narrowband(mono("r"), mono("g"), sii, k, tasks=tasks)) for k in ("SHO", "HOS", "HOO")]
    parts += [(f"OSC-{k}", P.osc_narrowband(v.rgb, k)) for k in ("SHO", "HOO")]
    out = None
    for k, d in parts:
        d = d.select(F.lit(k).alias("palette"), "image_id", "y", "x", *[r6(c).alias(c) for c in RGB])
        out = d if out is None else out.unionByName(d)
    return out


def _sc_sql(group, width=50.0, guard=5.0):
    import math

    _, kind, ua, ub, ch, tone = P.COLOUR_GROUPS[group]
    t = width / 100.0
    full = max(0.005, 0.30 - 0.24 * t)
    step = lambda lo, hi, x: f"({clip_sql(f'(({x})-({lo!r}::double))/({hi!r}::double-({lo!r}::double))')}*{clip_sql(f'(({x})-({lo!r}::double))/({hi!r}::double-({lo!r}::double))')}*(3e0-2e0*{clip_sql(f'(({x})-({lo!r}::double))/({hi!r}::double-({lo!r}::double))')}))"
    if kind == 0:
        hw = math.acos(ch) * (0.6 + 0.8 * t)
        f = f"{step(math.cos(hw), math.cos(hw / 2), 'cs')}*{clip_sql(f'ch/{full!r}::double')}*{step(0.01, 0.025, 'ch')}"
    elif tone > 0:
        f = step(0.6, 0.95, "kl")
    elif tone < 0:
        f = f"(1e0-{step(0.05, 0.4, 'kl')})"
    else:
        f = f"{clip_sql('1e0-abs(kl-0.5e0)/0.5e0')}*(1e0-{step(0.025, full, 'ch')})"
    g = guard / 100.0 * 0.6
    f = clip_sql(f"{f}*{step(g * 0.6, g, 'kl')}")
    row = lambda m, c: "+".join(f"({a!r}::double)*{b}" for a, b in zip(m, c))
    return f"""lm as (select *,{','.join(f'cbrt({row(m, RGB)}) c{i}' for i, m in enumerate(P.OKLAB_LMS))} from rgb),
    ok as (select *,{','.join(f'{row(m, ("c0", "c1", "c2"))} {n}' for n, m in zip(("kl", "ka", "kb"), P.OKLAB_OUT))} from lm),
    ok2 as (select *,sqrt(ka*ka+kb*kb) ch from ok), ok3 as (select *,case when ch>1e-6 then (({ua!r}::double)*ka+({ub!r}::double)*kb)/greatest(ch,1e-9) else -1e0 end cs from ok2),
    mb as materialized (select *,{f} f from ok3)"""


@query(
    "p14_selective_colour", "rgb",
    out3([clip_sql(f"{c}+f*(" + clip_sql(f"o_{c}*(case when lo>1e-6 then {LUMA}/greatest(lo,1e-6) else 1e0 end)") + f"-{c})") for c in RGB],
         "(select *,0.2126e0*o_r+0.7152e0*o_g+0.0722e0*o_b lo from (select *,"
         + ",".join(clip_sql(e) + f" o_{c}" for c, e in zip(RGB, ("(r*(1e0-0.3e0))*0.9e0", "(g+0.2e0*(1e0-g))*0.9e0", "(b*(1e0-0.1e0))*0.9e0"))) + " from mb))"),
    _sc_sql(0),
)
def p14(v):
    return fin(P.selective_color(v.rgb, 0, cyan=0.3, magenta=-0.2, yellow=0.1, black=0.1))


@query("p14_neutral_membership", "rgb", f"select image_id,y,x,{s6('f', 'w')} from mb", _sc_sql(7))
def p14b(v):
    return P.colour_membership(v.rgb, 7).select("image_id", "y", "x", r6("w").alias("w"))


def a_mask(v):
    """A soft mask that covers part of every image."""
    return v.rgb.filter("y % 5 <> 4").select("image_id", "y", "x", F.col("g").alias("w"))


@query("p15_masked_blend", "rgb", per("case when y%5=4 then $ else $*(1e0-(1e0-g)*0.7e0)+(1e0-$)*(1e0-g)*0.7e0 end"))
def p15(v):
    return fin(K.blend(v.rgb, P.each(v.rgb, lambda c: 1.0 - c), a_mask(v), invert=True, opacity=0.7))


_MB = "case when y%5=4 then 0e0 else g end"


@query(
    "p16_mask_algebra", "rgb",
    " union all ".join(f"select '{o}' op,image_id,y,x,{s6(e, 'w')} from rgb" for o, e in {"intersect": f"least({clip_sql('r')},{clip_sql(_MB)})", "union": f"greatest({clip_sql('r')},{clip_sql(_MB)})", "subtract": f"least({clip_sql('r')},1e0-{clip_sql(_MB)})", "invert": f"1e0-{clip_sql('r')}"}.items()),
)
def p16(v):
    a = v.rgb.select("image_id", "y", "x", F.col("r").alias("w"))
    out = None
    for op in ("intersect", "union", "subtract", "invert"):
        d = K.combine(a, a_mask(v), op).select(F.lit(op).alias("op"), "image_id", "y", "x", r6("w").alias("w"))
        out = d if out is None else out.unionByName(d)
    return out


@query("p17_luminosity_mask", "rgb", f"select 'lights' kind,image_id,y,x,{s6('pow(l/m,4)', 'w')} from q union all select 'darks' kind,image_id,y,x,{s6('pow(1e0-l/m,4)', 'w')} from q", f"q as (select *,{LUMA} l,max({LUMA}) over (partition by image_id) m from rgb)")
def p17(v):
    a, b = (K.luminosity_mask(v.rgb, k, 3).withColumn("kind", F.lit(k)) for k in ("lights", "darks"))
    return a.unionByName(b).select("kind", "image_id", "y", "x", r6("w").alias("w"))


@query("p19_scribble_mask", "rgb", f"select image_id,y,x,{s6('least(greatest(0.5e0+0.5e0*least(greatest(-(r*6e0-3e0),-1e0),1e0),0e0),1e0)', 'w')} from rgb")
def p19(v):
    return rounded(K.scribble_mask(v.rgb.withColumn("s", F.col("r") * 6.0 - 3.0), positive="earth"), "w")


DIM = "dim as (select image_id,max(y)+1 h,max(x)+1 w from rgb group by all)"


@query("p20_crop_fraction", "rgb", f"select image_id,cast(y-my as int) y,cast(x-mx as int) x,cast(mx as int) x0,cast(my as int) y0,{s6('r')} from rgb join (select *,floor(w*0.07e0) mx,floor(h*0.07e0) my from dim) using(image_id) where x>=mx and x<w-mx and y>=my and y<h-my", DIM)
def p20(v):
    return rounded(P.crop_fraction(v.rgb, 0.07).select("image_id", "y", "x", "x0", "y0", "r"), "r")


@query(
    "p20_crop_percent_rect", "rgb",
    f"""select 'percent' how,image_id,cast(y-my as int) y,cast(x-mx as int) x,{s6('g')} from rgb join (select *,round_even(w*0.0525e0,0) mx,round_even(h*0.0525e0,0) my from dim) using(image_id) where x>=mx and x<w-mx and y>=my and y<h-my
    union all select 'rect' how,image_id,cast(y-y0 as int) y,cast(x-x0 as int) x,{s6('g')} from rgb join (select *,round_even(w*0.11e0,0) x0,round_even(w*0.62e0,0) x1,round_even(h*0.2e0,0) y0,round_even(h*0.93e0,0) y1 from dim) using(image_id) where x>=x0 and x<x1 and y>=y0 and y<y1
    union all select 'edges' how,image_id,cast(y-image_id-2 as int) y,cast(x-1 as int) x,{s6('g')} from rgb join dim using(image_id) where x>=1 and x<w-image_id and y>=image_id+2 and y<h-3""", DIM,
)
def p20b(v):
    edges = v.rgb.select("image_id").distinct().select(
        "image_id", F.lit(1).alias("crop_l"), F.col("image_id").alias("crop_r"), (F.col("image_id") + 2).alias("crop_t"), F.lit(3).alias("crop_b")
    )
    a = P.crop_percent(v.rgb, 5.25).withColumn("how", F.lit("percent"))
    b = P.crop_rect(v.rgb, 0.11, 0.2, 0.62, 0.93).withColumn("how", F.lit("rect"))
    c = P.crop_edges(v.rgb, edges).withColumn("how", F.lit("edges"))
    return a.unionByName(b).unionByName(c).select("how", "image_id", "y", "x", r6("g").alias("g"))


@query("p21_orient", "rgb", f"select image_id,cast(w-1-x as int) y,cast(h-1-y as int) x,{s6('r')} from rgb join dim using(image_id)", DIM)
def p21(v):
    return rounded(P.orient(v.rgb, 1, flip_h=True).select("image_id", "y", "x", "r"), "r")


@query(
    "p24_background_level", "rgb",
    per(f"case when med>0.3e0+0.005e0 then {mtf_sql('m', clip_sql('(($-c)+sqrt(($-c)*($-c)+e*e))/(2e0*(1e0-c))'))} else $ end", "dk join s2 using(image_id)"),
    ST.replace("from rgb", "from dk").replace("lg as", "dk as (select image_id,y,x,0.35e0+r*0.1e0 r,0.33e0+g*0.1e0 g,0.36e0+b*0.1e0 b from rgb), lg as", 1)
    + f", s1 as (select *,med-6e0*dev c,greatest(0.3e0*dev,1e-5) e from st), s2 as (select *,{bal_sql('0.3e0', '((med-c)+sqrt((med-c)*(med-c)+e*e))/(2e0*(1e0-c))')} m from s1 where c>0)",
)
def p24(v):
    dim = v.rgb.withColumns({"r": 0.35 + F.col("r") * 0.1, "g": 0.33 + F.col("g") * 0.1, "b": 0.36 + F.col("b") * 0.1})
    return fin(P.background_level(dim, 0.3))


@query(
    "p25_shadow_anchor", "rgb",
    per("case when cls not in ('reflection','galaxy') and f>0.001 and blk<f and blk>0.65e0*f+0.001e0 and $<f then " + clip_sql("f-(f-$)*(1e0+((f-(blk-0.7e0*(blk-0.65e0*f)))/(f-blk)-1e0)*(f-$)/(f-blk))") + " else $ end",
        "dk join (select image_id,med f from st) using(image_id) join (select image_id,quantile_cont((r+g+b)/3e0,0.01) blk,case image_id%3 when 0 then 'emission' when 1 then 'galaxy' else 'open' end cls from dk group by all) using(image_id)"),
    ST.replace("from rgb", "from dk").replace("lg as", "dk as (select image_id,y,x,0.4e0+r*0.2e0 r,0.4e0+g*0.2e0 g,0.4e0+b*0.2e0 b from rgb), lg as", 1),
)
def p25(v):
    lifted = P.each(v.rgb, lambda c: 0.4 + c * 0.2)
    cls = v.rgb.select("image_id").distinct().selectExpr("image_id", "case image_id%3 when 0 then 'emission' when 1 then 'galaxy' else 'open' end object_class")
    return fin(P.shadow_anchor(lifted, cls))


@query("p27_snr_map", "rgb", f"select image_id,y,x,{s6('greatest((r+g+b)/3e0,0e0)/(0.01e0+b*0.1e0+1e-6)', 'snr')} from rgb")
def p27(v):
    noise = v.rgb.select("image_id", "y", "x", (0.01 + F.col("b") * 0.1).alias("noise"))
    return rounded(K.snr_map(v.rgb, noise, S.mean_of(RGB)), "snr")


@query("a10_average_deviation", "rgb", f"select image_id,c,{s6('med')},{s6('dev')} from cs", ST)
def a10(v):
    return S.channel_stats(v.rgb).select("image_id", "c", r6("med").alias("med"), r6("dev").alias("dev"))


@query("a11_channel_averages", "rgb", f"select image_id,{s6('med')},{s6('mean')},{s6('dev')} from st", ST)
def a11(v):
    return rounded(S.image_stats(v.rgb), "med", "mean", "dev")


@query("a12_region_median", "rgb", f"select image_id,{s6('avg(m)', 'med')} from (select image_id,c,median(v) m from lg where x>=20 and x<90 and y>=5 and y<33 group by all) group by image_id", LG)
def a12(v):
    return rounded(S.region_median(v.rgb, 20, 5, 90, 33), "med")


SOLVE = ST + f", s1 as (select *,{clip_sql('med-1.25e0*dev')} c0,greatest(0.3e0*dev,1e-5) e from st), s2 as (select *,c0>0 and c0<1 knee,{bal_sql('0.25e0', 'case when c0>0 and c0<1 then ((med-c0)+sqrt((med-c0)*(med-c0)+e*e))/(2e0*(1e0-c0)) else med end')} m from s1)"
_KN = clip_sql("(($-round(c0,8))+sqrt(($-round(c0,8))*($-round(c0,8))+round(e*e,12)))/round(2e0*(1e0-c0),8)")


@query("a13_auto_stretch", "rgb", per(f"case when m>0 and m<1 and m<>0.5 then {mtf_sql('m', f'(case when knee then {_KN} else $ end)')} else (case when knee then {_KN} else $ end) end", "rgb join s2 using(image_id)"), SOLVE)
def a13(v):
    return fin(S.auto_stretch(v.rgb))


@query("a13_scaled_mad", "mos", f"select image_id,{s6('1.4826e0*median(abs(v-m))+1e-12', 'mad')} from mos join (select image_id,median(v) m from mos group by all) using(image_id) group by image_id")
def a13b(v):
    return rounded(S.scaled_mad(v.mos, "v"), "mad")


PATCH = """g as (select *,0.08e0+0.84e0*(ix/5e0) cx,0.08e0+0.84e0*(iy/3e0) cy from range(6) a(ix),range(4) b(iy)),
pt as (select image_id,iy*6+ix patch,greatest(0,floor((cx-0.035e0)*w+0.5e0)) x0,greatest(0,floor((cy-0.035e0)*h+0.5e0)) y0,least(w,floor((cx+0.035e0)*w+0.5e0)) x1,least(h,floor((cy+0.035e0)*h+0.5e0)) y1 from g,dim),
pm as (select image_id,patch,avg(m) m from (select image_id,patch,c,median(v) m from lg join pt using(image_id) where x>=x0 and x<x1 and y>=y0 and y<y1 and x1-x0>=4 and y1-y0>=4 group by all) group by all),
ds as (select image_id,list(m order by m) s,count(*) n from pm group by all),
du as (select image_id,case when n>=4 then s[1+cast(floor(0.1e0*(n-1)) as int)] else 0e0 end clean_sky,case when n>=4 then s[1+cast(floor(0.45e0*(n-1)) as int)] else 0e0 end typical from (select distinct image_id from rgb) left join ds using(image_id))"""


@query("a16_dust_lift", "rgb", f"select image_id,{s6('coalesce(clean_sky,0e0)', 'clean_sky')},{s6('coalesce(typical,0e0)', 'typical')},{s6('greatest(0e0,typical-clean_sky)', 'lift')},{s6('least(greatest(typical-clean_sky,0e0),0.03e0)', 'floor_raise')} from du", ",".join([LG, DIM, PATCH]))
def a16(v):
    return rounded(S.measure_dust(v.rgb), "clean_sky", "typical", "lift", "floor_raise")


_E = [(0.02, 0.02, 0.11, 0.11), (0.89, 0.02, 0.98, 0.11), (0.02, 0.89, 0.11, 0.98), (0.89, 0.89, 0.98, 0.98), (0.455, 0.02, 0.545, 0.11), (0.455, 0.89, 0.545, 0.98), (0.02, 0.455, 0.11, 0.545), (0.89, 0.455, 0.98, 0.545)]


@query(
    "a17_gradient_assessment", "rgb1",
    f"select image_id,{s6('vmin')},{s6('vmax')},{s6('g', 'gradient')},case when g>=0.45 then 8 when g>=0.2 then 6 else 3 end crop_percent,g>=0.2 use_gradient_removal from fin",
    ST.replace("from rgb", "from tl").replace("lg as", "tl as (select image_id,y,x,r*(0.3e0+x/400e0) r,g*(0.3e0+x/400e0) g,b*(0.3e0+x/400e0) b from rgb1), lg as", 1)
    + ", dim as (select image_id,max(y)+1 h,max(x)+1 w from tl group by all), e(i,a0,b0,a1,b1) as (values " + ",".join(f"({i},{a}e0,{b}e0,{c}e0,{d}e0)" for i, (a, b, c, d) in enumerate(_E))
    + f"""), rt as (select image_id,i,greatest(0,floor(w*a0+0.5e0)) x0,greatest(0,floor(h*b0+0.5e0)) y0,least(w,floor(w*a1+0.5e0)) x1,least(h,floor(h*b1+0.5e0)) y1 from e,dim where w>=128 and h>=128),
    pq as (select image_id,i,c,median(v) pm from lg join rt using(image_id) where x>=x0 and x<x1 and y>=y0 and y<y1 group by all),
    k as (select image_id,c,c0,{bal_sql('0.25e0', 'med-c0')} m from (select *,{clip_sql('med-2.8e0*dev')} c0 from cs)),
    vl as (select image_id,i,avg({mtf_sql('m', clip_sql('case when 1e0-c0>1e-8 then (pm-c0)/(1e0-c0) else 0e0 end'))}) vv from pq join k using(image_id,c) group by all),
    f0 as (select image_id,list(vv order by vv) s from vl group by all), fin as (select image_id,s[1] vmin,s[7] vmax,greatest(0e0,case when s[7]>1e-4 then (s[7]-s[1])/s[7] else 0e0 end) g from f0)""",
)
def a17(v):
    tilt = P.each(v.rgb1, lambda c: c * (0.3 + F.col("x") / 400.0))
    return rounded(S.assess_gradient(tilt), "vmin", "vmax", "gradient")


def neutral_sql(src, tag, target="0.001e0"):
    return f"""q{tag} as materialized (select image_id,quantile_cont((r+g+b)/3e0,0.3) t from {src} group by all),
    n{tag} as (select image_id,case when count(*) filter ((r+g+b)/3e0<=t)>=64 then any_value(t) else 1e9 end t from {src} join q{tag} using(image_id) group by image_id),
    o{tag} as (select image_id,{','.join(f'median({c}) b{c}' for c in RGB)} from {src} join n{tag} using(image_id) where (r+g+b)/3e0<=t group by image_id),
    m{tag} as materialized (select image_id,y,x,{','.join(f'{c}-b{c}+{target} {c}' for c in RGB)} from {src} join o{tag} using(image_id)),
    s{tag} as (select image_id,min(least(r,g,b)) mn,max(greatest(r,g,b)) mx from m{tag} group by all),
    z{tag} as materialized (select image_id,y,x,{','.join(f'case when mn<0 or mx>1 then ({c}-mn)/(mx-mn) else {c} end {c}' for c in RGB)} from m{tag} join s{tag} using(image_id))"""


def balance_sql(src, tag):
    lum = "(r+g+b)/3e0"
    lifts = ",".join(f"w{c}-b{c}" for c in RGB)
    return f"""q{tag} as materialized (select image_id,quantile_cont({lum},0.3) t from {src} group by all),
    n{tag} as materialized (select image_id,case when count(*) filter ({lum}<=t)>=64 then any_value(t) else 1e9 end t from {src} join q{tag} using(image_id) group by image_id),
    h{tag} as materialized (select image_id,l thr from (select image_id,{lum} l,row_number() over (partition by image_id order by {lum} desc) rn,count(*) over (partition by image_id) n from {src} where {lum}<=0.9e0 and {lum}>=0) where rn=least(n,greatest(64,ceil(0.01e0*n)))),
    j{tag} as materialized (select s.*,{lum} lum,t,thr from {src} s join n{tag} using(image_id) left join h{tag} using(image_id)),
    c{tag} as materialized (select image_id,count(*) filter (lum>=thr and lum<=0.9e0) ns,count(*) filter (lum>=0 and lum<=0.3e0 and lum<=t) nb,count(*) filter (lum>=0 and lum<=0.3e0) nm,{','.join(f'avg({c}) filter (lum>=thr and lum<=0.9e0) w{c}' for c in RGB)} from j{tag} group by all),
    b{tag} as materialized (select image_id,any_value(ns) ns,{','.join(f'any_value(w{c}) w{c},median({c}) b{c}' for c in RGB)} from j{tag} join c{tag} using(image_id) where case when nb>=64 then lum>=0 and lum<=0.3e0 and lum<=t when nm>0 then lum>=0 and lum<=0.3e0 else true end group by image_id),
    z{tag} as materialized (select image_id,y,x,{','.join(f'case when ns>=64 and least({lifts})>0 then {clip_sql(f"b{c}+({c}-b{c})*least({lifts})/(w{c}-b{c})")} else {c} end {c}' for c in RGB)} from (select image_id,y,x,r,g,b from {src}) join b{tag} using(image_id))"""


TINT = "ti as materialized (select image_id,y,x,r*0.7e0 r,g*0.6e0 g,b*0.5e0 b from rgb)"


def tinted(v):
    return v.rgb.withColumns({"r": F.col("r") * 0.7, "g": F.col("g") * 0.6, "b": F.col("b") * 0.5})


@query("a43_background_neutralize", "rgb", per("$", "z1"), TINT + "," + neutral_sql("ti", "1", "0.05e0"))
def a43(v):
    return fin(S.background_neutralize(tinted(v), 0.05))


@query("a44_structure_white_balance", "rgb", per("$", "z1"), TINT + "," + balance_sql("ti", "1"))
def a44(v):
    return fin(S.white_balance_structure(tinted(v)))


@query("a44_color_calibrate", "rgb", per("$", "z3"), ",".join([TINT, neutral_sql("ti", "1"), balance_sql("z1", "2"), neutral_sql("z2", "3")]))
def a44b(v):
    return fin(S.color_calibrate(tinted(v)))


@query("k04_brightest_threshold", "mos", f"select image_id,{s6('v', 'thr')} from (select image_id,v,row_number() over (partition by image_id order by v desc) rn from mos) where rn=100")
def k04(v):
    return rounded(group_quantiles(v.mos, ["image_id"], "v", {"thr": kth_largest(100)}), "thr")


@query("f07_rounding", "frame_measure", "select frame_id,cast(floor(ecc*40e0+0.5e0) as bigint) half_up,round_even(ecc*40e0,0) half_even,cast(trunc(ecc*40e0) as bigint) trunc from frame_measure")
def f07(v):
    x = F.col("ecc") * 40.0
    return v.frame_measure.select("frame_id", M.half_up(x).alias("half_up"), M.half_even(x).alias("half_even"), x.cast("long").alias("trunc"))


@query(
    "f08_order_statistics", "frame_measure",
    f"select session_id,{s6('s[1+cast(floor(0.1e0*(n-1)) as int)]', 'low10')},{s6('s[n//2+1]', 'upper_median')},{s6('q', 'p90')},n from (select session_id,list(fwhm order by fwhm) s,count(*) n,quantile_cont(fwhm,0.9) q from frame_measure group by all)",
)
def f08(v):
    q = group_quantiles(v.frame_measure, ["session_id"], "fwhm", {"low10": lower(0.1), "upper_median": upper_median(), "p90": linear(0.9)}, "n")
    return rounded(q, "low10", "upper_median", "p90")


@query("f09_spherical_math", "catalog", f"select id,{s6('2e0*degrees(asin(least(1e0,sqrt(pow(sin(radians(dec-10e0)/2),2)+cos(radians(10e0))*cos(radians(dec))*pow(sin(radians(ra-100e0)/2),2)))))', 'sep')},{s6('sqrt(ra*ra+dec*dec)', 'hyp')},{s6('asinh(dec)', 'ash')},{s6(clip_sql('(axis_ratio-1.2e0)/0.8e0') + '*' + clip_sql('(axis_ratio-1.2e0)/0.8e0') + '*(3e0-2e0*' + clip_sql('(axis_ratio-1.2e0)/0.8e0') + ')', 'step')} from catalog")
def f09(v):
    d = M.haversine_deg(F.lit(100.0), F.lit(10.0), F.col("ra"), F.col("dec"))
    return v.catalog.select(
        "id", r6(d).alias("sep"), r6(F.hypot("ra", "dec")).alias("hyp"), r6(F.asinh("dec")).alias("ash"),
        r6(M.smoothstep(1.2, 2.0, F.col("axis_ratio"))).alias("step"),
    )


@query("f12_highlight_knee", "frame_measure", f"select frame_id,{s6('0.1e0+least(greatest(ecc*1.5e0-0.1e0,0e0),1e0)*0.8e0', 'knee')} from frame_measure")
def f12(v):
    return v.frame_measure.select("frame_id", r6(0.1 + M.clip(F.col("ecc") * 1.5 - 0.1) * (0.9 - 0.1)).alias("knee"))


@query("s10_strided_preview", "mos", f"select image_id,cast(y//s as int) y,cast(x//s as int) x,{s6('v')} from mos join (select image_id,ceil(greatest(max(y)+1,max(x)+1)/50e0)::int s from mos group by all) using(image_id) where y%s=0 and x%s=0")
def s10(v):
    return rounded(P.strided_preview(v.mos, 50).select("image_id", "y", "x", "v"), "v")
