"""Sky catalog, settings, recipes, pins and step plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import lookups as L
from skyframe.operators import catalog as C
from skyframe.operators import rules as R
from skyframe.plans.catalogue import query, r6, rounded, s6

HAV = "2e0*degrees(asin(least(1e0,sqrt(pow(sin(radians({d2}-{d1})/2),2)+cos(radians({d1}))*cos(radians({d2}))*pow(sin(radians({r2}-{r1})/2),2)))))"
SEP = HAV.format(r1="f.ra", d1="f.dec", r2="c.ra", d2="c.dec")
CAT = "c as (select *,cast(substring(id,5) as bigint) ord from catalog)"
CONE = CAT + f""",cone as materialized (select field_id,fov_radius,c.*,{SEP} sep from field f,c where {SEP}<=fov_radius+coalesce(diameter,0e0)/2/60),
sc as (select *,0.5e0*least(1e0,coalesce(diameter,0.5e0)/greatest(0.001e0,fov_radius*60e0))+0.28e0*greatest(0e0,(14e0-coalesce(mag,15e0))/14e0)+0.22e0*greatest(0e0,1e0-sep/(fov_radius+1e-6))+case when source='M' then 0.12e0 else 0e0 end score from cone),
tw as (select *,row_number() over (partition by field_id,round_even(ra*100e0,0),round_even(dec*100e0,0) order by score desc,ord) r from sc)"""


def cat(v):
    return v.catalog.withColumn("ord", F.col("id").substr(5, 20).cast("long"))


@query("j06_cone_search", "catalog field", f"select field_id,id,{s6('sep')} from cone", CONE)
def j06(v):
    return rounded(C.cone_search(v.field, cat(v)).select("field_id", "id", "sep"), "sep")


@query("w11_prominence", "catalog field", f"select field_id,id,{s6('score')},rank() over (partition by field_id order by score desc) rnk from sc", CONE)
def w11(v):
    from pyspark.sql import Window

    d = C.prominence(C.cone_search(v.field, cat(v)))
    # a field's candidates are bounded by the sky inside one field of view
    return rounded(d.withColumn("rnk", F.rank().over(Window.partitionBy("field_id").orderBy(F.col("score").desc()))).select("field_id", "id", "score", "rnk"), "score")


@query("w10_twin_collapse", "catalog field", f"select field_id,id,{s6('score')} from tw where r=1", CONE)
def w10(v):
    return rounded(C.collapse_twins(C.prominence(C.cone_search(v.field, cat(v), twins=True))).select("field_id", "id", "score"), "score")


@query("u01_catalog_union", "catalog", f"select source,count(*) n,{s6('sum(dec)', 'dec_sum')} from catalog group by source")
def u01(v):
    both = v.catalog.filter("source = 'M'").unionByName(v.catalog.filter("source = 'NGC/IC'"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("dec")).alias("dec_sum"))


NAMES = "q as (select p_partkey query_id,case p_partkey%5 when 0 then concat('ngc  ',cast(p_partkey as string)) when 1 then upper(p_name) when 2 then substring(p_name,3,length(p_name)-4) when 3 then concat('zz ',cast(p_partkey as string),' — ',p_name) else substring(p_name,1,2) end query from part)"


@query(
    "j07_find_by_name", "catalog",
    "select query_id,p how,id,common_name from (select *,row_number() over (partition by query_id order by p,ord) r from hits) where r=1",
    CAT + "," + NAMES + """,k as (select query_id,replace(upper(trim(split_part(query,'—',1))),' ','') qid,lower(trim(case when query like '%—%' then split_part(query,'—',2) else query end)) qn from q where trim(query)<>''),
    hits as (select query_id,1 p,ord,id,common_name from k join c on replace(upper(id),' ','')=qid union all select query_id,2,ord,id,common_name from k join c on lower(common_name)=qn and common_name<>'' union all select query_id,3,ord,id,common_name from k join c on length(qn)>=3 and contains(lower(common_name),qn))""",
)
def j07(v):
    v.table("part").createOrReplaceTempView("part")
    q = v.spark.sql(NAMES[6:-1])
    return C.find_by_name(q, cat(v))


IDS = "select p_partkey ord,case p_partkey%4 when 0 then concat('M ',cast(p_partkey%115 as string)) when 1 then concat('NGC 0',cast(p_partkey*7%8000 as string)) when 2 then concat('ic',cast(p_partkey*3%6000 as string)) else concat('X',cast(p_partkey as string)) end id, case p_partkey%9 when 0 then 'Some Galaxy' when 1 then 'Globular thing' when 2 then 'Planetary x' when 3 then 'Iris field' when 4 then 'A Cluster' when 5 then 'Big Nebula' when 6 then '' else p_name end common_name, 1e0+p_size/25e0 axis_ratio, case when p_partkey%13=0 then null else p_retailprice/80e0 end diameter from part"
_M = ",".join(f"({n},'{c}')" for c, ns in L.MESSIER.items() for n in ns)
_N = ",".join(f"('{k}{n}','{c}')" for c in ("emission", "reflection") for k, ns in L.NEBULAE[c].items() for n in ns)


def designations(v):
    v.table("part").createOrReplaceTempView("part")
    return v.spark.sql(IDS)


@query(
    "f01_object_class", None,
    f"""with i as ({IDS}), m(n,mc) as (values {_M}), nb(k,nc) as (values {_N}),
    d as (select *,try_cast(regexp_extract(id,'(?i)^M\\s*0*([0-9]{{1,3}})$',1) as int) mn,concat(upper(regexp_extract(id,'(?i)^(IC|NGC)\\s*0*([0-9]{{1,4}})$',1)),regexp_extract(id,'(?i)^(IC|NGC)\\s*0*([0-9]{{1,4}})$',2)) kk,lower(common_name) cn from i)
    select ord,id,coalesce(mc,nc,case when cn like '%galaxy%' then 'galaxy' when cn like '%globular%' then 'globular' when cn like '%planetary%' then 'planetary' when regexp_matches(cn,'reflection|witch head|\\biris\\b') then 'reflection' when cn like '%cluster%' then 'open' when cn like '%nebula%' then 'emission' when axis_ratio>=2.2 and diameter<15 then 'galaxy' else 'generic' end) object_class
    from d left join m on m.n=d.mn left join nb on nb.k=d.kk""",
)
def f01(v):
    return designations(v).select("ord", "id", C.object_class().alias("object_class"))


FILTERS = "select frame_id,case frame_id%8 when 0 then 'Ha 7nm' when 1 then 'OIII' when 2 then 'Lum' when 3 then 'Red' when 4 then 'osc-rgb' when 5 then 'shade' when 6 then '' else null end f,frame_id%3=0 is_color from frame_measure"
DT = "case when coalesce(f,'')<>'' and regexp_matches(lower(f),'(^|[^a-z])(ha|h[- ]?alpha|sii|s2|oiii|o3|nii|n2)([^a-z]|$)') then 'narrowband' when coalesce(f,'')<>'' and regexp_matches(lower(f),'(lum|^l$|red|^r$|green|^g$|blue|^b$)') then 'broadband' when coalesce(f,'')<>'' and regexp_matches(lower(f),'(rgb|color|osc|bayer)') then 'osc' when is_color then 'osc' else 'broadband' end"


def filters(v):
    v.frame_measure.createOrReplaceTempView("frame_measure")
    return v.spark.sql(FILTERS)


@query("f02_data_type", "frame_measure", f"select frame_id,{DT} data_type from ({FILTERS})")
def f02(v):
    return filters(v).select("frame_id", C.data_type(F.col("f"), F.col("is_color")).alias("data_type"))


@query("f03_palettes", "frame_measure", f"select frame_id,case {DT} when 'narrowband' then 'SHO (Hubble)|HOO|HOS' when 'osc' then 'Natural RGB|SHO (Hubble)|HOO' else 'RGB|LRGB' end palettes,case {DT} when 'narrowband' then 'HOS' when 'osc' then 'HOO' end last_key from ({FILTERS})")
def f03(v):
    d = filters(v).select("frame_id", C.palettes_for(C.data_type(F.col("f"), F.col("is_color"))).alias("p"))
    return d.select("frame_id", F.concat_ws("|", "p").alias("palettes"), C.palette_key(F.element_at("p", -1)).alias("last_key"))


@query("f04_object_label", None, f"select ord,case when common_name<>'' then concat(id,' — ',common_name) else id end label,replace(upper(trim(id)),' ','') norm from ({IDS})")
def f04(v):
    return designations(v).select("ord", C.object_label(F.col("id"), F.col("common_name")).alias("label"), C.norm_id(F.col("id")).alias("norm"))


_P = ",".join(f"('{i}','{n}')" for ids, n, _ in L.PRESETS for i in ids)


@query("j08_curated_preset", None, f"with p(k,preset) as (values {_P}) select ord,id,preset from ({IDS}) left join p on replace(upper(trim(id)),' ','')=k")
def j08(v):
    return C.curated_for(designations(v)).select("ord", "id", "preset")


HEAD = "select field_id frame_id,cast(1000+field_id%7*10 as int) width,cast(800+field_id%5*10 as int) height,ra,dec,0.001e0+field_id%4*0.0005e0 s,case when field_id%3=0 then 'open' else 'emission' end given_class from field"


def headed(v):
    """Frames with a tangent-plane header; every ninth lacks one."""
    v.field.createOrReplaceTempView("field")
    d = v.spark.sql(HEAD)
    text = lambda c: c.cast("string")
    h = F.create_map(
        *[x for k, e in {"crval1": F.col("ra"), "CRVAL2": F.col("dec"), "CRPIX1": F.lit(480.5), "CRPIX2": F.lit(390.0), "CD1_1": -F.col("s"), "CD1_2": F.col("s") * 0.1, "CD2_1": F.col("s") * 0.1, "CD2_2": F.col("s"), "XPIXSZ": F.lit(3.76)}.items() for x in (F.lit(k), text(e))]
    )
    return d.withColumn("header", F.when(F.col("frame_id") % 9 != 4, h)).drop("ra", "dec", "s")


WCS = f"""h as ({HEAD}), w as (select *,radians(-s*(width/2e0+1e0-480.5e0)+s*0.1e0*(height/2e0+1e0-390e0)) xi,radians(s*0.1e0*(width/2e0+1e0-480.5e0)+s*(height/2e0+1e0-390e0)) eta,radians(dec) d0 from h where frame_id%9<>4),
ws as materialized (select frame_id,width,height,given_class,(ra+degrees(atan2(xi,cos(d0)-eta*sin(d0)))+360e0)%360e0 ra,degrees(atan2(sin(d0)+eta*cos(d0),sqrt(xi*xi+pow(cos(d0)-eta*sin(d0),2)))) dec,(sqrt(s*s+s*s*0.01e0)+sqrt(s*s*0.01e0+s*s))/2e0 resolution from w)"""


@query("f10_header_solution", "field", f"select h.frame_id,ws.frame_id is not null solved,{s6('ws.ra', 'ra')},{s6('ws.dec', 'dec')},{s6('resolution*3600e0', 'pix_scale')},{s6('sqrt(1e0*ws.width*ws.width+ws.height*ws.height)*resolution', 'fov_deg')},{s6('206.265e0*3.76e0/(resolution*3600e0)', 'focal')} from h left join ws using(frame_id)", WCS)
def f10(v):
    return rounded(C.solve_header(headed(v)).select("frame_id", "solved", "ra", "dec", "pix_scale", "fov_deg", "focal"), "ra", "dec", "pix_scale", "fov_deg", "focal")


@query(
    "j23_identify_target", "catalog field",
    f"select h.frame_id,ws.frame_id is not null solved,b.id object_id,case when b.id is not null then case when coalesce(common_name,'')<>'' then concat(b.id,' — ',common_name) else b.id end end label,coalesce(case when b.id is null then null else coalesce(nc,case when cn like '%galaxy%' then 'galaxy' when cn like '%globular%' then 'globular' when cn like '%planetary%' then 'planetary' when regexp_matches(cn,'reflection|witch head|\\biris\\b') then 'reflection' when cn like '%cluster%' then 'open' when cn like '%nebula%' then 'emission' when axis_ratio>=2.2 and diameter<15 then 'galaxy' else 'generic' end) end,h.given_class) object_class,preset from h left join ws using(frame_id) left join best b on b.field_id=h.frame_id left join nb on nb.k=replace(b.id,' ','') left join pp on pp.k=replace(b.id,' ','')",
    WCS + "," + CONE.replace("field f,c", "(select frame_id field_id,ra,dec,sqrt(1e0*width*width+height*height)*resolution/2e0 fov_radius from ws) f,c")
    + f",best as (select *,lower(coalesce(common_name,'')) cn from (select *,row_number() over (partition by field_id order by score desc,ord) rr from tw where r=1) where rr=1), nb(k,nc) as (values {_N}), pp(k,preset) as (values {_P})",
)
def j23(v):
    return C.identify(headed(v), cat(v))


CLS = "case frame_id%9 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(L.CLASSES)) + " else 'mystery' end"


def settings(v):
    """Images with a class (one in nine unknown) and dials."""
    i = F.col("frame_id")
    return v.frame_measure.select(
        i.alias("image_id"), F.expr(CLS).alias("object_class"), (F.col("ecc") - 0.4).alias("satAdj"), ((F.col("fwhm") - 3.0) / 10).alias("brightAdj"),
        F.when(i % 5 != 0, F.col("bg") * 3 - 0.1).alias("bgAdj"), (F.col("ecc") * 2 - 0.8).alias("blackAdj"), (F.col("bg") - 0.05).alias("contrastAdj"),
        F.when(i % 4 == 0, i % 8 == 0).alias("doHDR"), F.when(i % 7 == 0, F.lit(0.55)).alias("chromaNR"), (i % 6 != 0).alias("adaptiveFloor"), (i % 10 == 0).alias("inputStretched"), F.col("frame_id"),
    )


def _prof_values():
    def lit(x):
        return "null::int" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else str(x)

    return "pr(" + "cls," + ",".join(f"p_{f}" for f in L.PROFILE_FIELDS) + ") as (values " + ",".join("('" + c + "'," + ",".join(lit(x) for x in L.PROFILES[c]) + ")" for c in L.CLASSES) + ")"


ST = f"""st as (select frame_id image_id,frame_id,{CLS} object_class,ecc-0.4e0 satadj,(fwhm-3e0)/10e0 brightadj,case when frame_id%5<>0 then bg*3e0-0.1e0 end bgadj,ecc*2e0-0.8e0 blackadj,bg-0.05e0 contrastadj,case when frame_id%4=0 then frame_id%8=0 end dohdr,case when frame_id%7=0 then 0.55e0 end chromanr,frame_id%6<>0 adaptivefloor,frame_id%10=0 inputstretched from frame_measure),
{_prof_values()}, sp as (select st.*,pr.* from st join pr on pr.cls=case when object_class='mystery' then 'generic' else object_class end)"""
EFF = {f: s6(f"least(greatest(p_{f}+coalesce({a.lower()},0e0),{lo!r}::double),{hi!r}::double)", f"eff_{f}") for a, (f, lo, hi) in L.DIALS.items()}


@query("j09_effective_settings", "frame_measure", f"select image_id,object_class,{','.join(EFF.values())} from sp", ST)
def j09(v):
    cols = [f"eff_{f}" for f, _, _ in L.DIALS.values()]
    return rounded(R.effective_settings(settings(v)).select("image_id", "object_class", *cols), *cols)


@query(
    "j10_class_switches", "frame_measure",
    "select image_id,coalesce(dohdr,p_hdr) \"doHDR\",coalesce(chromanr,p_chromaNR) \"chromaNR\",p_bxt \"doBXT\",p_scnr \"doSCNR\",p_starReduce \"doStarReduce\",p_haloTamer \"haloTamer\",p_darkLaneGC \"darkLaneGC\",p_reduceCast \"reduceCast\",p_structure structure,case frame_id%4 when 1 then 0.45e0 when 2 then 0.2e0 else 0.3e0 end sharp,case frame_id%4 when 1 then 'neutral' when 2 then 'neutral' else 'golden' end tone from sp", ST,
)
def j10(v):
    d = R.class_switches(settings(v)).withColumn("body", F.expr("case frame_id%4 when 1 then ' Moon' when 2 then 'neutral base' when 3 then 'sun' end"))
    return R.body_preset(d).select("image_id", "doHDR", "chromaNR", "doBXT", "doSCNR", "doStarReduce", "haloTamer", "darkLaneGC", "reduceCast", "structure", "sharp", "tone")


@query("f11_class_predicates", "frame_measure", f"select image_id,object_class in ('emission','generic') adaptive,object_class in ('emission','reflection','generic','open') masked,object_class in ('emission','reflection','planetary','generic') protect,{s6('least(greatest(p_bgLevel+least(greatest(satadj*0.1e0,0e0),0.03e0),0.015e0),0.4e0)', 'floor')} from sp", ST)
def f11(v):
    d = R.with_profile(settings(v))
    return d.select(
        "image_id", R.applies("adaptive_floor").alias("adaptive"), R.applies("masked_darken").alias("masked"), R.applies("star_protect").alias("protect"),
        r6(R.effective_floor(F.col("p_bgLevel"), F.col("satAdj") * 0.1)).alias("floor"),
    )


@query("b04_adaptive_floor", "frame_measure", f"select image_id,{s6('case when object_class in (' + chr(39) + 'emission' + chr(39) + ',' + chr(39) + 'generic' + chr(39) + ') and adaptivefloor and not inputstretched then least(greatest(e+least(greatest(satadj*0.1e0,0e0),0.03e0),0.015e0),0.4e0) else e end', 'floor')} from (select *,least(greatest(p_bgLevel+coalesce(bgadj,0e0),0.015e0),0.4e0) e from sp)", ST)
def b04(v):
    s = settings(v)
    return R.adaptive_floor(s, s.select("image_id", (F.col("satAdj") * 0.1).alias("lift"))).select("image_id", r6("floor").alias("floor"))


DEC = "select frame_id run_id,g \"group\",n name,kind,type,computed from frame_measure,(values ('Background','floor','decided','float','0.2'),('HDR','layers','decided','int','6'),('Halo','enabled','decided','bool','true'),('Run','mode','info','text','execute')) r(g,n,kind,type,computed)"


def decisions(v):
    rows = [("Background", "floor", "decided", "float", "0.2"), ("HDR", "layers", "decided", "int", "6"), ("Halo", "enabled", "decided", "bool", "true"), ("Run", "mode", "info", "text", "execute")]
    items = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("group", "name", "kind", "type", "computed"))]) for r in rows])
    d = v.frame_measure.select(F.col("frame_id").alias("run_id"), F.explode(items).alias("s")).select("run_id", "s.*")
    key = F.expr("case run_id%5 when 0 then 'Background|floor' when 1 then 'HDR|layers' when 2 then 'Halo|enabled' when 3 then 'Run|mode' else 'HDR|layers' end")
    pin = F.expr("case run_id%5 when 0 then '0.33' when 1 then '7.5' when 2 then 'No' when 3 then 'preview' else 'many' end")
    return R.record_decisions(d, v.frame_measure.select(F.col("frame_id").alias("run_id"), key.alias("key"), pin.alias("pin")))


PINS = "select *,case when name='floor' and run_id%5=0 then '0.33' when name='layers' and run_id%5=1 then '8' when name='enabled' and run_id%5=2 then 'false' end pv from (" + DEC + ")"


@query("j11_pin_override", "frame_measure", f"select run_id,\"group\",name,coalesce(pv,computed) \"value\",pv is not null pinned from ({PINS})")
def j11(v):
    return decisions(v).select("run_id", "group", "name", "value", "pinned")


@query("r05_decision_ledger", "frame_measure", f"select \"group\",name,kind,count(*) n,count(*) filter (pv is not null) n_pinned from ({PINS}) group by all")
def r05(v):
    return decisions(v).groupBy("group", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("pinned").alias("n_pinned"))


@query(
    "f05_tolerant_recipe", "recipe_json",
    f"select image_id,{s6('least(greatest(cast(image_id%9-4 as double),-0.5e0),0.5e0)', 'sat')},case when image_id%2=0 then 'true' end hdr,case image_id%4 when 0 then 'galaxy' when 1 then 'emission' when 3 then 'open' end cls,1+case when image_id%2=0 then 1 else 0 end+case when image_id%4<>2 then 1 else 0 end n from recipe_json",
)
def f05(v):
    d = R.apply_recipes(v.recipe_json)
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return d.groupBy("image_id").agg(
        r6(pick("satAdj").cast("double")).alias("sat"), pick("doHDR").alias("hdr"), pick("objectClass").alias("cls"), F.count(F.lit(1)).cast("int").alias("n")
    )


@query(
    "f05_recipe_round_trip", "recipe_json",
    "select image_id,'satAdj' as key,cast(least(greatest(cast(image_id%9-4 as double),-0.5e0),0.5e0) as varchar) as value from recipe_json union all select image_id,'doHDR','true' from recipe_json where image_id%2=0 "
    "union all select image_id,'objectClass',case image_id%4 when 0 then 'galaxy' when 1 then 'emission' else 'open' end from recipe_json where image_id%4<>2",
)
def f05b(v):
    """Accepted settings saved as recipes and read again: every key keeps its value."""
    return R.apply_recipes(R.save_recipes(R.apply_recipes(v.recipe_json))).select("image_id", "key", "value")


SUG = "select frame_id image_id,n name from frame_measure,(values ('saturation',0),('scnr',1),('contrast',2),('chroma_nr',3),('local_contrast',4)) s(n,i) where (frame_id+i)%3<>0"


def suggested(v):
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(("saturation", "scnr", "contrast", "chroma_nr", "local_contrast"))])
    return v.frame_measure.select(F.col("frame_id").alias("image_id"), F.explode(items).alias("s")).filter("(image_id + s.i) % 3 <> 0").select("image_id", "s.name")


def masks_of(v):
    items = F.array(F.lit("Star cores"), F.lit("Nebulosity"), F.lit("Detail (protect)"))
    return v.frame_measure.select(F.col("frame_id").alias("image_id"), F.posexplode(items).alias("i", "mask_name")).filter("(image_id + i) % 4 <> 0").select("image_id", "mask_name")


@query("k06_step_order", "frame_measure", f"select image_id,name,case name when 'scnr' then 2 when 'chroma_nr' then 4 when 'local_contrast' then 6 when 'contrast' then 7 else 8 end ord from ({SUG})")
def k06(v):
    return R.order_steps(suggested(v)).orderBy("image_id", "ord").select("image_id", "name", "ord")


GATED = f"select image_id,name,case when name='saturation' and image_id%4<>0 then 'Star cores' when name='chroma_nr' and (image_id+2)%4<>0 then 'Detail (protect)' when name='local_contrast' and (image_id+1)%4<>0 then 'Nebulosity' end mask from ({SUG})"


@query("b02_semantic_gates", "frame_measure", f"select image_id,name,mask,mask is not null and name<>'local_contrast' mask_invert from ({GATED})")
def b02(v):
    return R.gate_steps(suggested(v), masks_of(v)).select("image_id", "name", "mask", "mask_invert")


@query("u04_protect_masks", "frame_measure", f"select distinct image_id,mask mask_name from ({GATED}) where mask is not null and not (mask='Nebulosity' and image_id%2=0)")
def u04(v):
    g = R.gate_steps(suggested(v), masks_of(v))
    return R.needed_masks(g, masks_of(v).filter("mask_name = 'Nebulosity' and image_id % 2 = 0")).select("image_id", "mask_name")


BITS = {"is_color": "k%3<>0", "preview": "k%7=0", "inputStretched": "k%5=0", "narrowband": "k%11=0", "has_noise": "k%2=0", "has_trails": "k%4=0", "has_foreground": "k%9=0",
        "doBgExtract": "k%6<>0", "darkLaneGC": "k%8=1", "fixChromatic": "k%3=1", "doBXT": "true", "useClassicalDeconv": "k%4=2", "doColorCal": "k%13<>0", "doNR": "k%6<>1",
        "doSCNR": "k%4<>3", "doHDR": "k%5=1", "reduceCast": "k%6=2", "enhanceEmission": "k%7=3", "doLocalContrast": "k%8<>2", "removeStars": "k%9=1", "doStarReduce": "k%4=1", "haloTamer": "k%5<>2"}
NUMS = {"cropPercent": "k%4", "snrProtect": "k%3", "significance": "k%5", "deepen": "k%2", "structure": "k%6", "chromaNR": "k%4", "dehaze": "k%5", "gradientCleanup": "k%3",
        "starShrink": "k%2", "transparency": "k%7", "dimCore": "k%8", "deepenBackground": "k%3", "meteorStrength": "k%2"}
RUNS = [
    "cropPercent>0", "has_noise and snrProtect>0", "has_noise and significance>0", "doBgExtract", "darkLaneGC and not inputStretched", "fixChromatic and is_color and not inputStretched",
    "doBXT and useClassicalDeconv and not inputStretched and not preview", "doColorCal and is_color and not inputStretched and not narrowband", "not inputStretched", "deepen>0", "doNR and not preview",
    "doSCNR and is_color", "doHDR", "structure>0", "true", "true", "is_color and chromaNR>0", "is_color", "is_color and reduceCast", "is_color and enhanceEmission", "is_color and dehaze>0", "gradientCleanup>0",
    "doLocalContrast", "significance>0", "false", "false", "starShrink>0 and not (removeStars and not preview)", "haloTamer and not preview", "inputStretched and deepen>0 and not narrowband", "transparency>0",
    "dimCore>0", "true", "deepenBackground>0", "has_trails and meteorStrength>0 and is_color", "true", "has_foreground",
]


@query(
    "r04_step_plan", "frame_measure",
    " union all ".join(f"select k image_id,{i} ord,({e}) run from pm" for i, e in enumerate(RUNS)),
    "pm as materialized (select k," + ",".join([f"({e}) {n}" for n, e in BITS.items()] + [f"({e}) {n}" for n, e in NUMS.items()]) + " from (select frame_id k from frame_measure))",
)
def r04(v):
    p = v.frame_measure.select(F.col("frame_id").alias("k")).selectExpr("k as image_id", *[f"({e}) as {n}" for n, e in {**BITS, **NUMS}.items()])
    return R.step_plan(p).select("image_id", "ord", "run")
