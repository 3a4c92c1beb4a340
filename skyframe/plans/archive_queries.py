"""File listings, quality, selection, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.lookups import FRAME_SUFFIXES, RAW_SUFFIXES, SET_ALIASES
from skyframe.functions.ranking import top_k
from skyframe.operators import quality as Q
from skyframe.plans.catalogue import query, r6, rounded, s6
from skyframe.session import scratch_path
from skyframe.sources import files as S

EXT = "(" + ",".join(f"'{e}'" for e in FRAME_SUFFIXES) + ")"
RAW = "(" + ",".join(f"'{e}'" for e in RAW_SUFFIXES) + ")"
SUF = r"lower(regexp_extract(path,'(\.[^./]*)$',1))"
PAR = "regexp_extract({},'^(.*)/[^/]*$',1)"


@query("s01_list_frames", "frame_file", f"select frame_id,path,bytes from frame_file where {SUF} in {EXT}")
def s01(v):
    return S.list_frames(v.frame_file).select("frame_id", "path", "bytes")


ALIAS = "al(a,s,o) as (values " + ",".join(f"('{a}','{n}',{i})" for n, al in SET_ALIASES.items() for i, a in enumerate(al)) + ")"
SETS = f"""{ALIAS}, ff as (select path,{PAR.format('path')} folder,{SUF} in {EXT} ok from frame_file),
fr as (select *,{PAR.format('folder')} root,lower(regexp_extract(folder,'([^/]*)$',1)) leaf from ff),
kn as (select root,s set_name,o,path,ok from fr join al on leaf=a),
pk as (select root,set_name,path from kn join (select root,set_name,min(o) o from kn group by all) using(root,set_name,o) where ok),
st as (select * from pk union all select folder root,'lights',path from ff where ok and folder in (select root from kn) and folder not in (select root from pk where set_name='lights'))"""


@query("s02_frame_sets", "frame_file", "select root,set_name,path from st", SETS)
def s02(v):
    return S.find_sets(v.frame_file).select("root", "set_name", "path")


def explicit(v):
    """Every fourth root names its own darks folder."""
    roots = S.find_sets(v.frame_file).select("root").distinct().filter("try_cast(substring(root,8) as int) % 4 = 0")
    return roots.select("root", F.lit("darks").alias("set_name"), F.concat("root", F.lit("/misc")).alias("folder"))


@query(
    "s03_resolve_sets", "frame_file",
    f"select root,set_name,path from st where not (set_name='darks' and try_cast(substring(root,8) as int)%4=0) union all select {PAR.format('folder')} root,'darks',path from ff where ok and folder like '%/misc' and try_cast(substring({PAR.format('folder')},8) as int)%4=0 and {PAR.format('folder')} in (select root from st)",
    SETS,
)
def s03(v):
    return S.resolve_sets(S.find_sets(v.frame_file), explicit(v), v.frame_file)


@query(
    "s04_output_root", "frame_file",
    f"select frame_id,case frame_id%4 when 0 then {PAR.format('path')} when 1 then {PAR.format(PAR.format('path'))} when 2 then {PAR.format('path')} else '.' end out_root from frame_file",
)
def s04(v):
    i = F.col("frame_id") % 4
    runs = v.frame_file.select(
        "frame_id", F.when(i == 0, S.parent(F.col("path"))).otherwise("").alias("folder"),
        F.when(i == 1, S.parent(F.col("path"))).otherwise(" ").alias("lights_dir"), F.when(i == 2, F.col("path")).alias("first_light"),
    )
    return S.output_root(runs).select("frame_id", "out_root")


@query("s05_readable_split", "frame_file", f"select kind,count(*) n,sum(bytes)::bigint bytes from (select bytes,case when {SUF} in {EXT} then 'frame' when {SUF} in {RAW} then 'raw' end kind from frame_file) where kind is not null group by kind")
def s05(v):
    return S.split_readable(v.frame_file).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("s06_normalise_samples", "px", f"select target_id,frame_id,y,x,{s6('least(greatest(case frame_id%3 when 0 then floor(v*300e0)/255e0 when 1 then floor(v*65535e0)/65535e0 else v*1.2e0-0.1e0 end,0e0),1e0)', 'v')} from px")
def s06(v):
    i = F.col("frame_id") % 3
    d = v.px.withColumn("dtype", F.when(i == 0, "uint8").when(i == 1, "uint16").otherwise("float64")).withColumn(
        "raw", F.when(i == 0, F.floor(F.col("v") * 300).cast("double")).when(i == 1, F.floor(F.col("v") * 65535).cast("double")).otherwise(F.col("v") * 1.2 - 0.1)
    )
    return S.normalise_samples(d).select("target_id", "frame_id", "y", "x", r6("v").alias("v"))


@query("s07_canonical_channels", "px", "select frame_id,c,least(n,3)::int channels,count(*) n from (select frame_id,x%(1+frame_id%4)::int c,(1+frame_id%4) n from px) where c<3 group by all")
def s07(v):
    d = v.px.withColumn("c", (F.col("x") % (1 + F.col("frame_id") % 4)).cast("int"))
    return S.canonical_channels(d).groupBy("frame_id", "c", "channels").agg(F.count(F.lit(1)).alias("n"))


def headers(v):
    """Frame headers with varied key case and gaps."""
    k = F.col("frame_id") % 4
    obs = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss")
    exif = F.date_format(F.expr("mtime + interval 1 hour"), "yyyy:MM:dd HH:mm:ss")
    other = F.date_format(F.expr("mtime + interval 2 hour"), "yyyy:MM:dd HH:mm:ss")
    h = F.map_filter(
        F.create_map(F.lit("Date-Obs"), F.when(k == 0, obs), F.lit("datetimeoriginal"), F.when(k == 1, exif), F.lit("DATETIME"), F.when(k <= 2, other), F.lit("ExpTime"), F.when(k != 3, F.col("bytes").cast("string"))),
        lambda _, x: x.isNotNull(),
    )
    return v.frame_file.withColumn("header", h)


@query("s08_header_lookup", "frame_file", "select frame_id,case when frame_id%4<>3 then cast(bytes as string) end exptime,cast(null as string) gain from frame_file")
def s08(v):
    return headers(v).select("frame_id", S.header_value("exptime").alias("exptime"), S.header_value("GAIN").alias("gain"))


@query("s09_capture_time", "frame_file", "select frame_id,strftime(case frame_id%4 when 0 then mtime when 1 then mtime+interval 1 hour when 2 then mtime+interval 2 hour else date_trunc('second',mtime) end,'%Y-%m-%d %H:%M:%S') captured from frame_file")
def s09(v):
    return headers(v).select("frame_id", F.date_format(S.capture_time(), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("s11_frame_key", "frame_file", "select frame_id,substring(sha1(concat_ws('|',path,cast(epoch_us(mtime::timestamp)*1000 as string),cast(bytes as string),'1')),1,12) frame_key from frame_file")
def s11(v):
    return v.frame_file.select("frame_id", S.frame_key().alias("frame_key"))


@query("s12_incremental_reuse", "arrival", "select event_id,frame_key from arrival a where event_id%3=0 and not exists (select 1 from arrival b where b.event_id%3<>0 and b.frame_key=a.frame_key)")
def s12(v):
    return S.unseen(v.arrival.filter("event_id % 3 = 0"), v.arrival.filter("event_id % 3 <> 0")).select("event_id", "frame_key")


@query("s13_orphan_prune", "arrival", "select distinct frame_key from arrival where frame_key not in (select frame_key from arrival where event_id%2=0)")
def s13(v):
    staged = v.arrival.select("frame_key").distinct()
    return S.prune(staged, v.arrival.filter("event_id % 2 = 0"))


@query("s14_master_sink", "px", f"select target_id,y,x,{s6('avg(v)', 'v')},count(*) n_sub from px group by target_id,y,x")
def s14(v):
    """Masters written partitioned by target with their metadata, then read back."""
    path = scratch_path(v.spark, "master")
    master = v.px.groupBy("target_id", "y", "x").agg(F.avg("v").alias("v"))
    S.write_master(master, v.frame_tile.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_sub")), path)
    m, meta = S.read_master(v.spark, path)
    return rounded(m.withColumn("target_id", F.col("target_id").cast(dict(v.px.dtypes)["target_id"])).join(meta, "target_id"), "v").select("target_id", "y", "x", "v", "n_sub")


@query("s15_companion_load", "px", f"select target_id,y,x,{s6('avg(v)', 'v')},case when target_id%3<>0 then {'round(stddev_pop(v),6)+0e0'} end noise from px where target_id%4<>1 or x<8 group by target_id,y,x")
def s15(v):
    m = v.px.groupBy("target_id", "y", "x").agg(F.avg("v").alias("v"), F.stddev_pop("v").alias("noise"))
    # every third target's companion has lost a column
    return rounded(S.load_companion(m.drop("noise"), m.filter("target_id % 3 <> 0 or x < 7").select("target_id", "y", "x", "noise"), "noise"), "v", "noise")


@query("s16_quantised_export", "px", "select target_id,frame_id,y,x,cast(round_even(least(greatest(v*1.4e0-0.2e0,0e0),1e0)*65535e0,0) as int) q16,cast(round_even(least(greatest(v*1.4e0-0.2e0,0e0),1e0)*255e0,0) as int) q8 from px")
def s16(v):
    x = F.col("v") * 1.4 - 0.2
    return v.px.select("target_id", "frame_id", "y", "x", S.quantise(x, 16).alias("q16"), S.quantise(x, 8).alias("q8"))


@query("s17_catalog_csv", "catalog", f"select id,{s6('ra')},{s6('dec')},{s6('mag')},{s6('diameter')},{s6('axis_ratio')},trim(common_name) common_name,source from catalog where cast(substring(id,5) as int)%7<>0", "")
def s17(v):
    """The catalog written as CSV with some positions spoiled, then read with the typed source."""
    n = F.col("id").substr(5, 20).cast("int")
    out = None
    for src in ("M", "NGC/IC"):
        path = scratch_path(v.spark, "catalog-csv")
        v.catalog.filter(F.col("source") == src).select(
            "id", F.when(n % 7 == 0, "n/a").otherwise(F.col("ra").cast("string")).alias("ra"), "dec", "mag", "diameter", F.col("axis_ratio").alias("axisRatio"),
            F.lit("").alias("posAngle"), F.col("common_name").alias("Common name"), F.lit("x").alias("NGC/IC"), F.lit("y").alias("PGC"),
        ).write.option("header", True).csv(path)
        d = S.read_catalog_csv(v.spark, path, src)
        out = d if out is None else out.unionByName(d)
    return rounded(out, "ra", "dec", "mag", "diameter", "axis_ratio")


@query("s19_run_report", "frame_measure", f"select session_id,run,count(*) n,{s6('avg(fwhm)', 'fwhm')} from frame_measure,(values (1),(2)) r(run) group by session_id,run")
def s19(v):
    path = scratch_path(v.spark, "report")
    for run in (1, 2):
        S.append_report(v.frame_measure.groupBy("session_id").agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n"), F.avg("fwhm").alias("fwhm")), path)
    return rounded(v.spark.read.parquet(path), "fwhm")


def cull_sql(amplified=False):
    soft = "case when ecc>0.72e0 then 'trailed' " + ("" if amplified else "when fwhm>fm+3e0*(1.4826e0*fd+1e-12) then 'bloated' when bg>bm+6e0*(1.4826e0*bd+1e-12) then 'background surge' ") + "end"
    return f"""sn as (select * from frame_measure where stars>0),
    me as materialized (select session_id,median(fwhm) fm,median(bg) bm,count(*) n from sn group by all),
    md as materialized (select session_id,fm,bm,n,median(abs(fwhm-fm)) fd,median(abs(bg-bm)) bd from sn join me using(session_id) group by session_id,fm,bm,n),
    so as (select *,{soft} soft,case when {str(amplified).lower()} and ecc<=0.72e0 then case when fwhm>fm+3e0*(1.4826e0*fd+1e-12) then 'bloated' when bg>bm+6e0*(1.4826e0*bd+1e-12) then 'background surge' end end soft_kept from sn join md using(session_id)),
    rk as (select *,row_number() over (partition by session_id order by ecc,fwhm,frame_id) r from so where soft is not null),
    ct as (select session_id,frame_id,soft from rk where r<=floor(n*0.3e0)),
    kp as (select so.*,row_number() over (partition by so.session_id order by abs(fwhm-fm),bg,ecc,so.frame_id) rr from so left join ct using(session_id,frame_id) where ct.soft is null)"""


CULL = "select f.session_id,f.frame_id,case when f.stars=0 or ct.soft is not null then 'reject' else 'keep' end status,case when f.stars=0 then 'no stars' else ct.soft end reason,coalesce(kp.rr=1,false) is_reference{} from frame_measure f left join ct using(session_id,frame_id) left join kp using(session_id,frame_id){}"


@query("w01_cull", "frame_measure", CULL.format("", ""), cull_sql())
def w01(v):
    return Q.cull(v.frame_measure).drop("soft_kept")


@query("w01_cull_amplified", "frame_measure", CULL.format(",so.soft_kept", " left join so using(session_id,frame_id)"), cull_sql(True))
def w01b(v):
    return Q.cull(v.frame_measure, amplified=True)


@query("w02_cull_cap", "frame_measure", "select session_id,count(*) n_soft,count(*) filter (r<=floor(n*0.3e0)) n_rejected,floor(any_value(n)*0.3e0)::bigint cap from rk group by session_id", cull_sql())
def w02(v):
    d = Q.cull(v.frame_measure, max_frac=1.0)
    soft = d.filter("reason is not null and reason <> 'no stars'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_soft"))
    cut_ = Q.cull(v.frame_measure).filter("reason is not null and reason <> 'no stars'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    cap = v.frame_measure.filter("stars > 0").groupBy("session_id").agg(F.floor(F.count(F.lit(1)) * 0.3).alias("cap"))
    return soft.join(cut_, "session_id").join(cap, "session_id")


@query("w03_reference_frame", "frame_measure", f"select session_id,frame_id,{s6('fwhm')} from kp where rr=1", cull_sql())
def w03(v):
    ref = Q.cull(v.frame_measure).filter("is_reference").select("session_id", "frame_id")
    return rounded(ref.join(v.frame_measure.select("frame_id", "fwhm"), "frame_id").select("session_id", "frame_id", "fwhm"), "fwhm")


@query("b05_measure_only", "frame_measure", "select session_id,count(*) n_lights,count(*) filter (status='keep') n_keep,count(*) filter (reason='trailed') n_trailed from (" + CULL.format("", "") + ") group by session_id having count(*)>=2", cull_sql())
def b05(v):
    d = Q.cull(v.frame_measure).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_lights"), F.count_if(F.col("status") == "keep").alias("n_keep"), F.count_if(F.coalesce(F.col("reason") == "trailed", F.lit(False))).alias("n_trailed")
    )
    return d.filter("n_lights >= 2")


@query("k01_keep_sharpest", "frame_measure", "select burst_id,frame_id,rank from (select session_id burst_id,frame_id,row_number() over (partition by session_id order by fwhm desc,frame_id) rank,count(*) over (partition by session_id) n from frame_measure) where rank<=greatest(2,round_even(n*0.35e0,0))")
def k01(v):
    g = v.frame_measure.select(F.col("session_id").alias("burst_id"), "frame_id", F.col("fwhm").alias("sharp"))
    return Q.keep_sharpest(g, 0.35).select("burst_id", "frame_id", "rank")


@query("k02_top_stars", "frame_measure", "select session_id,frame_id,rank from (select session_id,frame_id,row_number() over (partition by session_id order by fwhm desc,frame_id) rank from frame_measure) where rank<=40")
def k02(v):
    return top_k(v.frame_measure, ["session_id"], [F.col("fwhm").desc(), F.col("frame_id")], 40).select("session_id", "frame_id", "rank")


@query("k03_top_rings", "frame_measure", "select session_id,frame_id,rank from (select session_id,frame_id,row_number() over (partition by session_id order by noise desc,frame_id) rank from frame_measure) where rank<=24")
def k03(v):
    return top_k(v.frame_measure, ["session_id"], [F.col("noise").desc(), F.col("frame_id")], 24).select("session_id", "frame_id", "rank")


@query("k05_even_probes", "frame_measure", "select session_id,frame_id from (select session_id,frame_id,row_number() over (partition by session_id order by frame_id)-1 i,greatest(1,count(*) over (partition by session_id)//9) s from frame_measure) where i%s=0 and i//s<9")
def k05(v):
    return Q.evenly_spaced(v.frame_measure.select("session_id", "frame_id"))


GATE = "select session_id burst_id,frame_id,bg*case when frame_id%13=0 then 0.05e0 else 1e0 end p999 from frame_measure"


@query("a33_dark_gate", "frame_measure", f"select burst_id,frame_id from g join (select burst_id,list(p999 order by p999)[count(*)//2+1] med from g group by all) using(burst_id) where not(p999<0.15e0*med or (p999<0.02e0 and p999<0.5e0*med))", f"g as ({GATE})")
def a33(v):
    g = v.frame_measure.select(F.col("session_id").alias("burst_id"), "frame_id", (F.col("bg") * F.when(F.col("frame_id") % 13 == 0, 0.05).otherwise(1.0)).alias("p999"))
    return Q.junk_gate(g).select("burst_id", "frame_id")


OFF = "select session_id burst_id,frame_id,row_number() over (partition by session_id order by frame_id) rank,(fwhm-4e0)*2e0+case when session_id%3=0 and frame_id%5<>0 then 300e0 else 0e0 end dx,(ecc-0.4e0)*8e0 dy from frame_measure"


@query(
    "a35_reference_rescue", "frame_measure",
    "select burst_id,any_value(ne) n_excluded,count(*) filter (nr) n_cluster,arg_min(frame_id,rank) filter (nr) frame_id from (select e.*,sqrt(pow(dx-mx,2)+pow(dy-my,2))<60 nr from e join k using(burst_id)) group by burst_id having count(*) filter (nr)>=0.6e0*any_value(ne)",
    f"o as ({OFF}), c as (select burst_id,count(*) filter (sqrt(dx*dx+dy*dy)>220) ne,count(*) filter (sqrt(dx*dx+dy*dy)<=220) ns from o group by all), e as (select o.*,ne from o join c using(burst_id) where sqrt(dx*dx+dy*dy)>220 and ne>=2 and ne>ns), k as (select burst_id,list(dx order by dx)[count(*)//2+1] mx,list(dy order by dy)[count(*)//2+1] my from e group by all)",
)
def a35(v):
    from skyframe.functions.ranking import ranked

    far = F.when((F.col("session_id") % 3 == 0) & (F.col("frame_id") % 5 != 0), 300.0).otherwise(0.0)
    o = ranked(v.frame_measure, ["session_id"], [("frame_id", True)]).select(
        F.col("session_id").alias("burst_id"), "frame_id", "rank", ((F.col("fwhm") - 4.0) * 2.0 + far).alias("dx"), ((F.col("ecc") - 0.4) * 8.0).alias("dy")
    )
    return Q.rescue_reference(o)


AP = "select session_id ap_id,frame_id,frame_id%40 shot,(fwhm-4e0)*2e0 dx,(ecc-0.4e0)*8e0 dy,bg q from frame_measure"


def ap_rows(v):
    return v.frame_measure.select(
        F.col("session_id").alias("ap_id"), "frame_id", (F.col("frame_id") % 40).alias("shot"), ((F.col("fwhm") - 4.0) * 2.0).alias("dx"), ((F.col("ecc") - 0.4) * 8.0).alias("dy"), F.col("bg").alias("q")
    )


@query("a37_field_spread", "frame_measure", f"select burst_id,{s6('avg(s)', 'spread_mean')},{s6('max(s)', 'spread_max')},count(*) n_frames from (select ap_id%5 burst_id,shot,sqrt(var_pop(dx)+var_pop(dy)) s from ({AP}) group by all having count(*)>3) group by burst_id")
def a37(v):
    d = ap_rows(v).withColumn("burst_id", F.col("ap_id") % 5)
    return rounded(Q.field_spread(d, frame="shot"), "spread_mean", "spread_max")


@query("w13_best_frames_per_point", "frame_measure", f"select ap_id,frame_id,rank from (select *,row_number() over (partition by ap_id order by q desc,frame_id) rank,count(*) over (partition by ap_id) n from ({AP}) where sqrt(dx*dx+dy*dy)<=8) where rank<=greatest(3,round_even(n*0.5e0,0))")
def w13(v):
    return Q.best_per_point(ap_rows(v)).select("ap_id", "frame_id", "rank")


@query("u02_frames_needed", "frame_measure", f"select distinct shot from (select *,row_number() over (partition by ap_id order by q desc,frame_id) rank,count(*) over (partition by ap_id) n from ({AP}) where sqrt(dx*dx+dy*dy)<=8) where rank<=greatest(3,round_even(n*0.02e0,0))")
def u02(v):
    return Q.best_per_point(ap_rows(v), keep=0.02).select("shot").distinct()


@query("u03_registered_kept", "frame_measure", "select session_id,frame_id,ecc>0.5e0 late from frame_measure where stars>10 and frame_id%3<>0")
def u03(v):
    kept = v.frame_measure.filter("stars > 10").select("session_id", "frame_id", (F.col("ecc") > 0.5).alias("late"))
    registered = v.frame_measure.filter("frame_id % 3 <> 0").select("session_id", "frame_id")
    return kept.join(registered, ["session_id", "frame_id"], "left_semi")


@query("w12_history_retention", "run_history", "select master_id,item_id from (select *,row_number() over (partition by master_id order by (rating<>0 or status='selected') desc,item_id desc) r from run_history) where r<=20")
def w12(v):
    return Q.evict(v.run_history).select("master_id", "item_id")


@query("f06_history_edits", "run_history", "select master_id,item_id,case when item_id%4=1 then least(greatest(item_id%9-2,0),5) else rating end::int rating,case when item_id%4=1 and item_id%3<>2 then case item_id%3 when 0 then 'selected' else 'discarded' end else status end status from run_history where item_id%4<>2")
def f06(v):
    k = F.col("item_id")
    edits = v.run_history.filter("item_id % 4 in (1,2)").select(
        "master_id", "item_id", F.when(k % 4 == 1, (k % 9 - 2).cast("int")).alias("rating"),
        F.when(k % 4 == 1, F.when(k % 3 == 0, "selected").when(k % 3 == 1, "discarded").otherwise("starred")).alias("status"), (k % 4 == 2).alias("drop"),
    )
    return Q.edit_history(v.run_history, edits).select("master_id", "item_id", F.col("rating").cast("int").alias("rating"), "status")


@query("s18_lookup_source", "frame_measure", "select cast(session_id as string) \"name\",cast(count(*) as string) \"value\" from frame_measure group by session_id")
def s18(v):
    """A versioned JSON lookup with one entry per session (fifty), written and read through the checked source."""
    from skyframe.functions.lookups import load_lookup

    path = scratch_path(v.spark, "lookup")
    n = v.frame_measure.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    n.agg(F.map_from_entries(F.collect_list(F.struct(F.col("session_id").cast("string"), "n"))).alias("sessions")).select(F.lit(1).alias("schema_version"), "sessions").write.json(path)
    return load_lookup(v.spark, path, "sessions")
