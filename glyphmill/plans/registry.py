"""All registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.geometry import box_angle, contains_point, with_box_gap
from glyphmill.operators import components, glyphs, layout, lexicon, network, pages, raster
from glyphmill.plans import fixtures as fx
from glyphmill.plans.fixtures import BX_SQL, CHARS_SQL, LEX_SQL, NN_SQL, PX_SQL, QW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


DARK = 100
COMP_SQL = f"""{PX_SQL},
d as (select page_id, x, y from px where gray <= {DARK}),
e as (select page_id, x, y, unnest([-1,0,1]) as ax from d),
n as (select page_id, x, y, x + ax as nx, y + ay as ny from (select *, unnest([-1,0,1]) as ay from e)),
adj as (select n.page_id, n.x, n.y, n.nx, n.ny from n join d on d.page_id = n.page_id and d.x = n.nx and d.y = n.ny),
r(page_id, x, y, seed) as (select page_id, x, y, y*1000 + x from d union
  select r.page_id, adj.nx, adj.ny, r.seed from r join adj on adj.page_id = r.page_id and adj.x = r.x and adj.y = r.y),
lab as (select page_id, x, y, min(seed) as comp_id from r group by all),
cc as (select page_id, comp_id, min(x) as x0, min(y) as y0, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h, count(*) as pixel_count from lab group by all)"""


# --- components -------------------------------------------------------------------------------------------------


@query(
    "components_boxes",
    f"""with recursive {COMP_SQL}, k as (select * from cc where pixel_count >= 8 and w < 90 and h < 90),
a as (select *, avg(w) over (partition by page_id) as aw, avg(h) over (partition by page_id) as ah from k),
s as (select * from a where w <= 10*aw and h <= 10*ah)
select page_id, comp_id, x0, y0, w, h, pixel_count, case when w*h > 25*avg(w*h) over (partition by page_id) then 'image' else 'character' end as type from s""",
)
def components_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.find_components(fx.pixels(spark, sf_dir), DARK, stride=fx.STRIDE).select("page_id", "comp_id", "x0", "y0", "w", "h", "pixel_count", "type")


@query("component_pixels", f"with recursive {COMP_SQL} select page_id, x, y, comp_id from lab")
def component_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(fx.pixels(spark, sf_dir).where(F.col("gray") <= DARK), fx.STRIDE)


@query(
    "component_clean",
    f"""with {BX_SQL}, a as (select *, avg(w) over (partition by page_id) as aw, avg(h) over (partition by page_id) as ah from bx)
select page_id, comp_id, x0, y0, w, h from a where w <= 1.5*aw and h <= 1.5*ah""",
)
def component_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.drop_outsized(fx.boxes(spark, sf_dir), 1.5).select("page_id", "comp_id", "x0", "y0", "w", "h")


@query("component_types", f"with {BX_SQL} select page_id, comp_id, case when w*h > 2*avg(w*h) over (partition by page_id) then 'image' else 'character' end as type from bx")
def component_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.classify(fx.boxes(spark, sf_dir), 2).select("page_id", "comp_id", "type")


@query("component_density", f"with recursive {COMP_SQL} select page_id, comp_id, w*h as area, x0 + w//2 as cx, y0 + h//2 as cy, round(pixel_count/(w*h), 6) as density from cc where pixel_count >= 8")
def component_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.density(components.boxes(_labelled(spark, sf_dir)).where("pixel_count >= 8")).select("page_id", "comp_id", "area", "cx", "cy", "density")


@query(
    "page_counters",
    f"""with {BX_SQL}, t as (select *, case when w*h > 2*avg(w*h) over (partition by page_id) then 'image' else 'character' end as type from bx)
select page_id, count(*) as n_components, count(*) filter (type = 'image') as n_images, count(*) filter (type = 'character') as n_characters,
 count(distinct (y0 + h//2)//200) as n_lines from t group by page_id""",
)
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = layout.with_line(components.classify(fx.boxes(spark, sf_dir), 2))
    return components.counters(t, t)


# --- rasters ----------------------------------------------------------------------------------------------------


@query("histogram", f"with {PX_SQL} select page_id, gray, count(*) as n from px where gray < 255 group by all")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(fx.pixels(spark, sf_dir))


@query(
    "gray_peaks",
    f"""with {PX_SQL}, h as (select page_id, gray, count(*) as n from px where gray < 255 group by all),
k as (select *, row_number() over (partition by page_id, gray < 170 order by n desc, gray) as rn from h)
select page_id, coalesce(max(gray) filter (rn = 1 and gray < 170), 0) as black, coalesce(max(gray) filter (rn = 1 and gray >= 170), 0) as white from k group by page_id""",
)
def gray_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.peaks(fx.pixels(spark, sf_dir))


@query(
    "otsu_threshold",
    f"""with {PX_SQL}, h as (select *, n*gray as s from (select page_id, gray, count(*) as n from px where gray < 255 group by page_id, gray)),
c as (select page_id, gray, sum(n) over w as n0, sum(s) over w as s0, sum(n) over p as nt, sum(s) over p as st from h
      window w as (partition by page_id order by gray), p as (partition by page_id)),
v as (select page_id, gray, (s0::double*(nt-n0)::double - (st-s0)::double*n0::double)*(s0::double*(nt-n0)::double - (st-s0)::double*n0::double)/(n0::double*(nt-n0)::double) as b from c where nt > n0)
select page_id, gray as threshold from (select *, row_number() over (partition by page_id order by b desc, gray) as rn from v) where rn = 1""",
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu(fx.pixels(spark, sf_dir))


@query("binarize_counts", f"with {PX_SQL} select page_id, case when gray > 170 then 255 else 0 end as bit, count(*) as n from px group by all")
def binarize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.binarise(fx.pixels(spark, sf_dir)).groupBy("page_id", "bit").agg(F.count(F.lit(1)).alias("n"))


@query("row_col_projection", f"with {PX_SQL} select page_id, 'x' as axis, x as at, count(*) as n from px where gray <= 170 group by all union all select page_id, 'y', y, count(*) from px where gray <= 170 group by all")
def row_col_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.projections(fx.pixels(spark, sf_dir))


@query(
    "pixel_types",
    f"""with {PX_SQL}, d as (select page_id, x, y from px where gray <= {DARK}),
o as (select * from (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) as o(dx, dy)),
c as (select d.page_id, d.x, d.y, count(e.x) as n from d cross join o left join d e on e.page_id = d.page_id and e.x = d.x + o.dx and e.y = d.y + o.dy group by all)
select page_id, x, y, n, case when n = 1 then 'End' when n >= 3 then 'Junction' else 'Regular' end as type from c""",
)
def pixel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixel_types(fx.pixels(spark, sf_dir).where(F.col("gray") <= DARK), ["page_id"]).select("page_id", "x", "y", "n", "type")


NORM_SQL = f"""{COMP_SQL}, big as (select * from cc where pixel_count >= 8),
s as (select *, least(32.0::double/w, 2*(32.0::double/h)) as sx, least(32.0::double/h, 2*(32.0::double/w)) as sy from big),
q as (select s.*, floor(w*sx)::int as tw, floor(h*sy)::int as th from s),
m as (select q.page_id, q.comp_id, tw, th, lab.x - x0 as x, lab.y - y0 as y, sx, sy from q join lab using (page_id, comp_id)),
i as (select *, unnest(range(ceil(x*sx)::int, least(ceil((x+1)*sx)::int, tw))) as i from m),
nrm as (select page_id, comp_id, i + (32-tw)//2 as x, unnest(range(ceil(y*sy)::int, least(ceil((y+1)*sy)::int, th))) + (32-th)//2 as y from i)"""


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = components.connected_components(fx.pixels(spark, sf_dir).where(F.col("gray") <= DARK), fx.STRIDE)
    keys = ["page_id", "comp_id"]
    big = lab.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n >= 8").drop("__n")
    return raster.normalise32(big, keys)


@query("normalize32", f"with recursive {NORM_SQL} select page_id, comp_id, count(*) as n, sum(x*37 + y*101)::bigint as checksum, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from nrm group by all")
def normalize32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).groupBy("page_id", "comp_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 37 + F.col("y") * 101).alias("checksum"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


@query(
    "junction_grid",
    f"""with recursive {NORM_SQL}, o as (select * from (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) as o(dx, dy)),
c as (select d.page_id, d.comp_id, d.x, d.y, count(e.x) as n from nrm d cross join o left join nrm e on e.page_id = d.page_id and e.comp_id = d.comp_id and e.x = d.x + o.dx and e.y = d.y + o.dy group by all)
select page_id, comp_id, x//11 as gx, y//11 as gy, bool_or(n = 1) as has_end, bool_or(n >= 3) as has_junction from c group by all""",
)
def junction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raster.pixel_types(_normalised(spark, sf_dir), ["page_id", "comp_id"])
    return t.groupBy("page_id", "comp_id", F.floor(F.col("x") / 11).alias("gx"), F.floor(F.col("y") / 11).alias("gy")).agg(F.bool_or(F.col("type") == "End").alias("has_end"), F.bool_or(F.col("type") == "Junction").alias("has_junction"))


@query(
    "projections32",
    f"""with recursive {NORM_SQL} select page_id, comp_id, 'x' as axis, x//4 as bucket, count(*) as n from nrm group by all union all select page_id, comp_id, 'y', y//4, count(*) from nrm group by all""",
)
def projections32(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normalised(spark, sf_dir)
    bucket = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.floor(F.col(a) / 4).alias("bucket")) for a in ("x", "y")]))
    return n.select("page_id", "comp_id", bucket.alias("b")).groupBy("page_id", "comp_id", "b.axis", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_variance",
    f"""with {PX_SQL}, d as (select page_id, x, y from px where gray <= {DARK}),
k as (select page_id, x, count(*) as runs from (select *, lag(y) over (partition by page_id, x order by y) as py from d) where py is null or py < y - 1 group by all),
f as (select page_id, abs(runs - lag(runs) over (partition by page_id order by x)) as diff from k)
select page_id, round(avg(diff), 6) as mean_diff, round(var_pop(diff), 6) as var_diff from f where diff is not null group by page_id""",
)
def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.pixels(spark, sf_dir).where(F.col("gray") <= DARK)
    starts = d.withColumn("py", F.lag("y").over(Window.partitionBy("page_id", "x").orderBy("y"))).where("py is null or py < y - 1")
    runs = starts.groupBy("page_id", "x").agg(F.count(F.lit(1)).alias("runs"))
    diff = runs.select("page_id", F.abs(F.col("runs") - F.lag("runs").over(Window.partitionBy("page_id").orderBy("x"))).alias("diff")).where("diff is not null")
    return diff.groupBy("page_id").agg(F.round(F.avg("diff"), 6).alias("mean_diff"), F.round(F.var_pop("diff"), 6).alias("var_diff"))


# --- boxes ------------------------------------------------------------------------------------------------------


@query(
    "grid_assign",
    f"""with {BX_SQL}, n as (select page_id, greatest(1, count(*)//20) as target from bx group by page_id),
k as (select page_id, min(d) as dx from (select page_id, target, unnest(range(0, target+1)) as d from n) where (d+1)*(d*2800//2000 + 1) >= target group by page_id),
c as (select page_id, dx + 2 as nx, 2000//(dx+1) as cw, 2800//(dx*2800//2000 + 1) as ch from k)
select page_id, comp_id, (x0 + w//2)//cw + nx*((y0 + h//2)//ch) as cell_id from bx join c using (page_id)""",
)
def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid(fx.boxes(spark, sf_dir), 2000, 2800).select("page_id", "comp_id", "cell_id")


@query(
    "box_contains_join",
    f"""with {BX_SQL} select o.page_id, o.comp_id as outer_id, i.comp_id as inner_id from bx o join bx i on o.page_id = i.page_id
 and i.x0 + 2 >= o.x0 and i.x0 + i.w - 2 <= o.x0 + o.w and i.y0 + 2 >= o.y0 and i.y0 + i.h - 2 <= o.y0 + o.h where o.comp_id <> i.comp_id and i.w > 4 and i.h > 4""",
)
def box_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.contained(fx.boxes(spark, sf_dir))


@query(
    "box_intersect_join",
    f"""with {BX_SQL} select a.page_id, a.comp_id as a_id, b.comp_id as b_id from bx a join bx b on a.page_id = b.page_id
 and a.x0 < b.x0 + b.w and b.x0 < a.x0 + a.w and a.y0 < b.y0 + b.h and b.y0 < a.y0 + a.h where a.comp_id < b.comp_id""",
)
def box_intersect_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting(fx.boxes(spark, sf_dir))


@query("point_in_box", f"with {BX_SQL} select page_id, comp_id from bx where 1000 >= x0 and 1000 < x0 + w and 1400 >= y0 - 300 and 1400 < y0 + h + 300")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.boxes(spark, sf_dir).where(contains_point(F.col("x0"), F.col("y0") - 300, F.col("w"), F.col("h") + 600, F.lit(1000), F.lit(1400))).select("page_id", "comp_id")


@query(
    "nearest_right_neighbor",
    f"""with {BX_SQL}, c as (select *, x0 + w//2 as cx, y0 + h//2 as cy from bx),
p as (select a.page_id, a.comp_id, b.comp_id as right_id, floor(sqrt(((b.cx-a.cx)*(b.cx-a.cx) + (b.cy-a.cy)*(b.cy-a.cy))::double))::bigint as distance from c a join c b on a.page_id = b.page_id
 and b.cx//100 - a.cx//100 between 0 and 1 and b.cy//100 - a.cy//100 between -1 and 1 and b.x0 > a.x0 and b.y0 < a.y0 + a.h and a.y0 < b.y0 + b.h where a.comp_id <> b.comp_id),
k as (select *, row_number() over (partition by page_id, comp_id order by distance, right_id) as rn from p where distance < 100)
select page_id, comp_id, right_id, distance from k where rn = 1""",
)
def nearest_right_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest_right(fx.boxes(spark, sf_dir))


PAIR_SQL = f"""{BX_SQL}, pr as (select page_id, comp_id as b_id, x0 as bx0, y0 as by0, w as bw, h as bh, lag(comp_id) over v as a_id, lag(x0) over v as ax0, lag(y0) over v as ay0, lag(w) over v as aw, lag(h) over v as ah
 from bx window v as (partition by page_id order by comp_id)), pairs as (select *, ax0 + aw//2 as acx, ay0 + ah//2 as acy, bx0 + bw//2 as bcx, by0 + bh//2 as bcy from pr where a_id is not null)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Window.partitionBy("page_id").orderBy("comp_id")
    b = fx.boxes(spark, sf_dir)
    return b.select("page_id", F.col("comp_id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "w", "h")], F.lag("comp_id").over(v).alias("a_id"), *[F.lag(c).over(v).alias(f"a{c}") for c in ("x0", "y0", "w", "h")]).where("a_id is not null")


def _sides() -> list:
    return [F.col(f"{p}{c}") for p in "ab" for c in ("x0", "y0", "w", "h")]


_STEPS = """(select count(*) from (select unnest(range(0, greatest({p}w, {p}h) + 1)) as k) where
 {p}cx + trunc(k*case when abs(dx) >= abs(dy) then sign(dx)::double else dx::double/greatest(abs(dx),abs(dy)) end{s}) >= {p}x0 and {p}cx + trunc(k*case when abs(dx) >= abs(dy) then sign(dx)::double else dx::double/greatest(abs(dx),abs(dy)) end{s}) < {p}x0 + {p}w
 and {p}cy + trunc(k*case when abs(dx) >= abs(dy) then dy::double/greatest(abs(dx),abs(dy)) else sign(dy)::double end{s}) >= {p}y0 and {p}cy + trunc(k*case when abs(dx) >= abs(dy) then dy::double/greatest(abs(dx),abs(dy)) else sign(dy)::double end{s}) < {p}y0 + {p}h)"""


@query(
    "box_gap_distance",
    f"""with {PAIR_SQL}, g as (select *, bcx - acx as dx, bcy - acy as dy from pairs)
select page_id, a_id, b_id, case when dx = 0 and dy = 0 then 0 else (floor(sqrt((dx*dx + dy*dy)::double)) + 1 - {_STEPS.format(p="a", s="")} - {_STEPS.format(p="b", s="*-1")})::bigint end as gap from g""",
)
def box_gap_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_box_gap(_pairs(spark, sf_dir), "gap", *[f"{p}{c}" for p in "ab" for c in ("x0", "y0", "w", "h")]).select("page_id", "a_id", "b_id", "gap")


_ANGLE = "case when {dx} = 0 then case when {dy} = 0 then 0.0 else 90.0 end else degrees(atan({dy}::double/{dx})) end"


@query(
    "box_angle",
    f"""with {PAIR_SQL}, g as (select *, case when ax0 < bx0 + bw and bx0 < ax0 + aw then 0 else abs(bcx - acx) end as dx, case when ay0 < by0 + bh and by0 < ay0 + ah then 0 else abs(bcy - acy) end as dy from pairs)
select page_id, a_id, b_id, round({_ANGLE.format(dx="dx", dy="dy")}, 6) as angle from g""",
)
def box_angle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("page_id", "a_id", "b_id", F.round(box_angle(*_sides()), 6).alias("angle"))


# --- lines and text ---------------------------------------------------------------------------------------------

LINE_SQL = f"""{BX_SQL}, ln as (select *, ((y0 + h//2)//200)::bigint as line_id from bx)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_line(fx.boxes(spark, sf_dir))


@query("small_lines", f"with {LINE_SQL}, c as (select *, count(*) over (partition by page_id, line_id) as n from ln) select page_id, line_id, comp_id from c where n >= 305")
def small_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.small_lines_dropped(_lines(spark, sf_dir), 305).select("page_id", "line_id", "comp_id")


@query(
    "space_insertion",
    f"""with {LINE_SQL}, t as (select *, floor(0.6*avg(w) over (partition by page_id, line_id)) as t, lag(x0) over v as px, lag(y0) over v as py, lag(w) over v as pw, lag(h) over v as ph from ln window v as (partition by page_id, line_id order by x0, comp_id)),
g as (select *, floor((x0 - (px + pw))/t)::bigint as n_spaces from t where px is not null and t > 0 and x0 - (px + pw) >= t)
select page_id, line_id, comp_id, n_spaces, (px + pw//2 + floor((x0 + w//2 - (px + pw//2))/n_spaces))::bigint as sx, (py + ph//2 + floor((y0 + h//2 - (py + ph//2))/n_spaces))::bigint as sy from g""",
)
def space_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spaces(_lines(spark, sf_dir))


METRIC_SQL = f"""{LINE_SQL}, o as (select *, row_number() over (partition by page_id, line_id order by x0, comp_id) as rn, count(*) over (partition by page_id, line_id) as n from ln),
m as (select page_id, line_id, count(*) as n, min(x0) as lx, min(y0) as ly, max(x0+w)-min(x0) as lw, max(y0+h)-min(y0) as lh, round(avg(w), 6) as avg_w, round(avg(h), 6) as avg_h,
 max(x0) filter (rn = 1) as ax0, max(y0) filter (rn = 1) as ay0, max(w) filter (rn = 1) as aw, max(h) filter (rn = 1) as ah,
 max(x0) filter (rn = n) as bx0, max(y0) filter (rn = n) as by0, max(w) filter (rn = n) as bw, max(h) filter (rn = n) as bh from o group by page_id, line_id),
d as (select *, case when ax0 < bx0 + bw and bx0 < ax0 + aw then 0 else abs(bx0 + bw//2 - (ax0 + aw//2)) end as dx, case when ay0 < by0 + bh and by0 < ay0 + ah then 0 else abs(by0 + bh//2 - (ay0 + ah//2)) end as dy from m)"""


@query("line_metrics", f"with {METRIC_SQL} select page_id, line_id, n, lx, ly, lw, lh, avg_w, avg_h, round({_ANGLE.format(dx='dx', dy='dy')}, 6) as angle from d")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_metrics(_lines(spark, sf_dir))


THRESHOLD_SQL = f"{METRIC_SQL}, th as (select page_id, line_id, (ly + floor(0.11*lh))::bigint as ascent, (ly + lh - floor(0.11*lh))::bigint as descent, (ly + lh//2)::bigint as centre from d)"


@query("line_thresholds", f"with {THRESHOLD_SQL} select * from th")
def line_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_thresholds(layout.line_metrics(_lines(spark, sf_dir)))


@query(
    "glyph_positions",
    f"""with {THRESHOLD_SQL} select page_id, line_id, comp_id, case when y0 < ascent then 'ascent' when y0 < centre then 'height' else 'center' end as top,
 case when y0 + h > descent then 'descent' when y0 + h > centre then 'base' else 'center' end as bottom from ln join th using (page_id, line_id)""",
)
def glyph_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.positions(lines, layout.line_thresholds(layout.line_metrics(lines)))


@query("page_overlays", f"with {METRIC_SQL} select page_id, 'component' as kind, x0, y0, x0 + w as x1, y0 + h as y1 from bx union all select page_id, 'line', lx, ly, lx + lw, ly + lh from d")
def page_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.overlays(lines, layout.line_metrics(lines))


@query(
    "word_islands",
    f"""with {CHARS_SQL}, k as (select *, sum((ch = ' ')::int) over (partition by conv_id, turn order by pos) as island from chars),
w as (select conv_id, turn, island, string_agg(ch, '' order by pos) as word from k where ch <> ' ' group by all)
select conv_id, turn, row_number() over (partition by conv_id, turn order by island) as word_no, word from w""",
)
def word_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.word_islands(fx.chars(spark, sf_dir))


@query("page_text", "select conv_id, string_agg(turn::varchar || ' ' || coalesce(text, '') || chr(10) || chr(13), '' order by turn) as page_text from conversations group by conv_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# --- dictionary -------------------------------------------------------------------------------------------------


@query("lexicon_distinct", f"with {LEX_SQL} select w, n from lex")
def lexicon_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.lexicon(spark, sf_dir)


@query("lexicon_member", f"with {LEX_SQL}, {QW_SQL} select w, lex.w as known from qw left join lex using (w)")
def lexicon_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.members(fx.query_words(spark, sf_dir), fx.lexicon(spark, sf_dir))


@query("lexicon_missing", f"with {LEX_SQL}, {QW_SQL} select w from qw where w not in (select w from lex)")
def lexicon_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.missing(fx.query_words(spark, sf_dir), fx.lexicon(spark, sf_dir))


@query(
    "fuzzy_suggest",
    f"""with {LEX_SQL}, {QW_SQL}, q as (select w from qw where w not in (select w from lex)),
p as (select q.w, lex.w as word, levenshtein(q.w, lex.w) as distance from q join lex on abs(length(q.w) - length(lex.w)) <= 2),
k as (select *, row_number() over (partition by w order by distance, word) as rn from p where distance <= 2)
select w, word as suggestion, distance from k where rn = 1""",
)
def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.fuzzy(fx.query_words(spark, sf_dir), fx.lexicon(spark, sf_dir))


@query(
    "confusion_expand",
    f"""with {LEX_SQL}, r as (select * from (values {', '.join(f"('{a}','{b}')" for a, b in lexicon.CONFUSIONS)}) as r(rd, mt)),
e as (select w, rd, mt, unnest(range(1, length(w) + 1)) as k from lex cross join r)
select w, k as "at", substring(w, 1, k::int - 1) || mt || substring(w, k::int + length(rd)::int) as candidate from e where substring(w, k::int, length(rd)::int) = rd""",
)
def confusion_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.confusions(fx.lexicon(spark, sf_dir))


PREFIX_SQL = f"{LEX_SQL}, pf as (select w, unnest(range(1, length(w) + 1)) as n from lex)"


@query("trie_node_count", f"with {PREFIX_SQL} select (select count(distinct substring(w, 1, n::int)) from pf) + (select count(*) from lex) + 1 as nodes")
def trie_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.trie_size(fx.lexicon(spark, sf_dir))


@query("dawg_node_count", f"with {PREFIX_SQL}, e as (select substring(w, 1, n::int) as p, string_agg(substring(w, n::int + 1), ',' order by substring(w, n::int + 1)) as rest from pf group by 1) select count(distinct (right(p, 1), rest)) + 2 as nodes from e")
def dawg_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.dawg_size(fx.lexicon(spark, sf_dir))


# --- network ----------------------------------------------------------------------------------------------------


def _layer(source: str, layer: int, n: int, m: int) -> str:
    sums = f"list_sum(list_transform(range(0, {n}), lambda i: ((i*7 + j*13 + {layer}*5) % 21 - 10)/10.0::double * f[i + 1]))"
    return f"select vec_id, label, list_transform(range(0, {m}), lambda j: 1/(1 + exp(((j*3 + {layer}) % 11 - 5)/10.0::double - {sums}))) as f from {source}"


MLP_SQL = f"{NN_SQL}, l1 as ({_layer('nnin', 1, 48, 8)}), l2 as ({_layer('l1', 2, 8, 8)}), out as ({_layer('l2', 3, 8, 10)})"
RANK_SQL = f"""{MLP_SQL}, each as (select vec_id, unnest(f) as prob, unnest(range(0, 10)) as lab from out),
rk as (select vec_id, lab as label, prob, row_number() over (partition by vec_id order by prob desc, lab) as rank from each where prob > 0.01)"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.network_inputs(spark, sf_dir).select("vec_id", "label", network.forward(F.col("f"), network.synthetic()).alias("outputs"))


@query("mlp_forward", f"with {MLP_SQL} select vec_id, unnest(range(0, 10)) as node, round(unnest(f), 6) as output from out")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir).select("vec_id", F.posexplode("outputs").alias("node", "output"))
    return out.select("vec_id", F.col("node").cast("long").alias("node"), F.round("output", 6).alias("output"))


@query("top4_labels", f"with {RANK_SQL} select vec_id, rank, label, round(prob, 6) as prob from rk where rank <= 4")
def top4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.ranked(_outputs(spark, sf_dir), "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("label").cast("long").alias("label"), F.round("prob", 6).alias("prob"))


@query("could_be_connected", f"with {RANK_SQL} select vec_id, max(prob) < 0.2 or bool_or(label = 9) as connected from rk where rank <= 4 group by vec_id")
def could_be_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.could_be_connected(network.ranked(_outputs(spark, sf_dir), "vec_id"), "vec_id", 9)


@query("success_pct", f"with {MLP_SQL}, s as (select list_bool_and(list_transform(range(0, 10), lambda i: abs(f[i + 1] - (i = label)::int) <= 0.6)) as good from out) select count(*) as total, count(*) filter (good) as good, (100*count(*) filter (good)) // count(*) as percent from s")
def success_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.success(_outputs(spark, sf_dir), tolerance=0.6)


@query("input_max", f"with {NN_SQL}, e as (select unnest(f) as v, unnest(range(0, 48)) as feature from nnin) select feature, greatest(1.0::double, max(v)) as most from e group by feature")
def input_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.input_max(fx.network_inputs(spark, sf_dir)).select(F.col("feature").cast("long").alias("feature"), "most")


BEST_SQL = f"{MLP_SQL}, b as (select vec_id, label, (list_position(f, list_max(f)) - 1)::int as predicted from out)"


@query("misclassified", f"with {BEST_SQL} select vec_id, label, predicted from b where label <> predicted")
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.misclassified(_outputs(spark, sf_dir), "vec_id")


@query("confusion_matrix", f"with {BEST_SQL} select label, predicted, count(*) as n from b group by all")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.confusion_matrix(_outputs(spark, sf_dir))


@query("sample_per_label", "select vec_id, label from (select vec_id, label, row_number() over (partition by label order by (vec_id*7919) % 10007, vec_id) as rn from embeddings) where rn <= 5")
def sample_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.sample_per_label(fx.table(spark, sf_dir, "embeddings"), "vec_id", "label", 5)


@query("one_hot_targets", "select vec_id, unnest(range(0, 10)) as node, (unnest(range(0, 10)) = label)::int as target from embeddings")
def one_hot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.one_hot(fx.table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", F.col("node").cast("long").alias("node"), "target")


@query(
    "otsu_as_written",
    f"""with {PX_SQL}, pg as (select distinct page_id from px), lv as (select page_id, unnest(range(1, 255)) as t from pg),
h as (select page_id, gray + 1 as t, count(*) as n from px where gray < 255 group by page_id, gray),
a as (select page_id, t, sum(n)::bigint as n, sum(n*(t-1))::bigint as s from (select page_id, t, n from h union all select page_id, t, 0 from lv) group by page_id, t),
c as (select page_id, t, n, sum(n) over w as nf, sum(s) over w as sf from a window w as (partition by page_id order by t)),
o as (select page_id, t, n, nf, t - 1 - (case when nf = 0 then 0 else sf::double/nf::double end) as d from c where t between 1 and 254),
v as (select page_id, t, case when nf = 0 then 0 else (nf::double/10000*(n*d*d))/nf::double end as v from o),
z as (select *, coalesce(max(t) filter (v = 0) over (partition by page_id), 0) as zero from v),
k as (select *, row_number() over (partition by page_id order by t <= zero, v, t) as rn from z)
select page_id, case when t > zero then t else zero end::int as threshold from k where rn = 1""",
)
def otsu_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu_as_written(fx.pixels(spark, sf_dir), 10_000).select("page_id", F.col("threshold").cast("int").alias("threshold"))


@query(
    "line_text",
    f"""with {CHARS_SQL}, k as (select *, sum((ch = ' ')::int) over (partition by conv_id, turn order by pos) as island from chars),
w as (select conv_id, turn, island, string_agg(ch, '' order by pos) as word from k where ch <> ' ' group by all)
select conv_id, turn, string_agg(word, ' ' order by island) as content from w group by all""",
)
def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_text(layout.word_islands(fx.chars(spark, sf_dir)))


@query(
    "trimmed_members",
    f"""with {LINE_SQL}, k as (select *, count(*) over (partition by page_id, line_id) as n, row_number() over (partition by page_id, line_id order by y0 + h//2, comp_id) as k from ln),
c as (select *, greatest(0, least(n//10, ceil((n-10)/2.0)::bigint)) as cut from k)
select page_id, line_id, comp_id from c where k > cut and k <= n - cut""",
)
def trimmed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.trimmed(_lines(spark, sf_dir)).select("page_id", "line_id", "comp_id")


@query("not_on_lines", f"with {LINE_SQL}, c as (select *, count(*) over (partition by page_id, line_id) as n from ln) select page_id, comp_id, x0, y0, w, h from c where n < 305")
def not_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.not_on_lines(fx.boxes(spark, sf_dir), layout.small_lines_dropped(_lines(spark, sf_dir), 305))


@query("padded_ids", f"with {BX_SQL} select comp_id, 'image_' || lpad((comp_id % 1000000)::varchar, 6, '0') || '_org.bmp' as file, lpad((comp_id % 100000000)::varchar, 8, '0') || '.bmp' as sample from bx")
def padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.padded_ids(fx.boxes(spark, sf_dir))


LABEL_SQL = "case label when 9 then 'connected' when 8 then 'garbage' else chr((97 + label)::int) end"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = network.ranked(_outputs(spark, sf_dir), "vec_id", top=1)
    label = F.when(F.col("label") == 9, "connected").when(F.col("label") == 8, "garbage").otherwise(F.char(97 + F.col("label")))
    kind = F.when(F.col("vec_id") % 7 == 0, "space").when(F.col("vec_id") % 11 == 0, "image").otherwise("character")
    return best.select("vec_id", "prob", label.alias("label"), kind.alias("kind"))


@query(
    "component_content",
    f"""with {RANK_SQL}, b as (select vec_id, {LABEL_SQL} as label, case when vec_id % 7 = 0 then 'space' when vec_id % 11 = 0 then 'image' else 'character' end as kind from rk where rank = 1)
select vec_id, case kind when 'space' then ' ' when 'character' then case label when 'connected' then '??' when 'garbage' then '?' else label end else '' end as content from b""",
)
def component_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("vec_id", layout.content(F.col("kind"), F.col("label")).alias("content"))


@query("split_score", f"with {RANK_SQL} select vec_id // 3 as glyph, round(avg(prob), 6) as score, string_agg({LABEL_SQL}, '' order by vec_id) as text from rk where rank = 1 group by 1")
def split_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.split_scores(_said(spark, sf_dir).withColumn("glyph", F.floor(F.col("vec_id") / 3)), "glyph", "vec_id")


@query(
    "gated_results",
    f"""with {MLP_SQL}, each as (select vec_id, unnest(f) as prob, unnest(range(0, 10)) as lab from out),
a as (select * from each where prob > 0.01),
g as (select x.vec_id, x.lab, x.prob, count(y.lab) as before from a x left join a y on x.vec_id = y.vec_id and y.lab < x.lab and y.prob >= x.prob group by all)
select vec_id, count(*) as n, round(max(prob), 6) as best from g where before < 4 group by vec_id""",
)
def gated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir).select("vec_id", network.ranked_as_inserted(F.col("outputs")).alias("r"))
    return out.select("vec_id", F.size("r").cast("long").alias("n"), F.round(F.element_at("r", 1)["prob"], 6).alias("best"))


# --- kernels: no SQL; tests hold them against small cases worked out by hand ------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(fx.pixels(spark, sf_dir).where(F.col("gray") <= DARK), fx.STRIDE)


def _thinning(kind: str) -> None:
    @query(f"thin_{kind}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.thinned(_labelled(spark, sf_dir), kind)


for _kind in ("condensed", "standard", "eroding", "midpoints", "staircases", "runs", "spurs"):
    _thinning(_kind)


@query("strokes")
def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.stroke_counts(_labelled(spark, sf_dir))


@query("features48")
def features48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.features(_labelled(spark, sf_dir))


@query("split_cuts")
def split_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_cuts(_labelled(spark, sf_dir))


@query("line_growth")
def line_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines(fx.boxes(spark, sf_dir), 2000, 2800, cleaned=False)


@query("line_cleanup")
def line_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines(fx.boxes(spark, sf_dir), 2000, 2800)


RULES = [(a, b) for a, b in lexicon.CONFUSIONS if b.isalpha()]


@query(
    "trie_suggest",
    f"""with recursive {LEX_SQL}, {QW_SQL}, q as (select w from qw where w not in (select w from lex)),
r as (select * from (values {', '.join(f"('{a}','{b}')" for a, b in RULES)}) as r(rd, mt)),
st(w, done, rest, undone) as (select w, '', w, false from q union
  select * from (select w, done || left(rest, 1), substring(rest, 2), false from st where rest <> ''
  union all select w, done, mt || substring(rest, length(rd)::int + 1), true from st join r on starts_with(rest, rd) where not undone)),
v as (select distinct w, done as v from st where rest = ''),
p as (select v.w, lex.w as word, levenshtein(v.v, lex.w) as distance from v join lex on abs(length(v.v) - length(lex.w)) <= 2),
k as (select *, row_number() over (partition by w order by distance, word) as rn from p where distance <= 2)
select w, word as suggestion, distance from k where rn = 1""",
)
def trie_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.trie_suggestions(lexicon.missing(fx.query_words(spark, sf_dir), fx.lexicon(spark, sf_dir)), fx.lexicon(spark, sf_dir))


@query("osa_distance")
def osa_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.lexicon(spark, sf_dir).select("w", F.reverse("w").alias("other"))
    return w.select("w", "other", lexicon.osa("w", "other").alias("distance"))


@query("train_eval")
def train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of a network trained on up to 20 examples of each label, over all rows."""
    import numpy as np

    nn = fx.network_inputs(spark, sf_dir)
    chosen = network.sample_per_label(nn, "vec_id", "label", 20)
    rows = chosen.join(nn.select("vec_id", "f"), "vec_id").orderBy("vec_id").collect()  # 20 of each label at most
    x, y = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows])
    layers = network.train(x, np.eye(10)[y], repetitions=10)
    return network.success(nn.select("label", network.forward_udf(layers)("f").alias("outputs")))


# --- the same operators at the thresholds that pages are read with ----------------------------------------------


@query("component_clean_default", f"with {BX_SQL}, a as (select *, avg(w) over (partition by page_id) as aw, avg(h) over (partition by page_id) as ah from bx) select page_id, comp_id, x0, y0, w, h from a where w <= 10*aw and h <= 10*ah")
def component_clean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.drop_outsized(fx.boxes(spark, sf_dir)).select("page_id", "comp_id", "x0", "y0", "w", "h")


@query("component_types_default", f"with {BX_SQL} select page_id, comp_id, case when w*h > 25*avg(w*h) over (partition by page_id) then 'image' else 'character' end as type from bx")
def component_types_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.classify(fx.boxes(spark, sf_dir)).select("page_id", "comp_id", "type")


FINE_SQL = f"{BX_SQL}, ln as (select *, ((y0 + h//2)//10)::bigint as line_id from bx)"


def _fine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten rows of pixels, some of which have few members."""
    return layout.with_line(fx.boxes(spark, sf_dir), 10)


@query("small_lines_default", f"with {FINE_SQL}, c as (select *, count(*) over (partition by page_id, line_id) as n from ln) select page_id, line_id, comp_id from c where n >= 3")
def small_lines_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.small_lines_dropped(_fine_lines(spark, sf_dir)).select("page_id", "line_id", "comp_id")


@query("success_pct_default", f"with {MLP_SQL}, s as (select list_bool_and(list_transform(range(0, 10), lambda i: abs(f[i + 1] - (i = label)::int) <= 0.2)) as good from out) select count(*) as total, count(*) filter (good) as good, (100*count(*) filter (good)) // count(*) as percent from s")
def success_pct_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.success(_outputs(spark, sf_dir))


@query("line_thresholds_as_written", f"with {METRIC_SQL} select page_id, line_id, (ly + floor(0.11*lh))::bigint as ascent, (ly + lh - floor(0.11*lh))::bigint as descent, lh::bigint as centre from d")
def line_thresholds_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_thresholds(layout.line_metrics(_lines(spark, sf_dir)), quirk=True)


# --- pixels of components ---------------------------------------------------------------------------------------

MESH = "y % 2 = 0 and (x + (y % 4)//2) % 2 = 0"


@query("mesh_components", f"with recursive {COMP_SQL} select page_id, x, y, comp_id from lab where (page_id, comp_id) in (select page_id, comp_id from lab where {MESH})")
def mesh_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.on_mesh(_labelled(spark, sf_dir))


BIG_SQL = f"{COMP_SQL}, bg as (select * from cc where pixel_count >= 8), bl as (select lab.* from lab join bg using (page_id, comp_id)), loc as (select bl.page_id, bl.comp_id, bl.x - x0 as x, bl.y - y0 as y, gray from bl join bg using (page_id, comp_id) join px on px.page_id = bl.page_id and px.x = bl.x and px.y = bl.y)"


def _big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the components of at least eight."""
    return _labelled(spark, sf_dir).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("page_id", "comp_id"))).where("__n >= 8").drop("__n")


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.local_rasters(_big(spark, sf_dir), fx.pixels(spark, sf_dir))


@query("component_rasters", f"with recursive {BIG_SQL} select * from loc")
def component_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rasters(spark, sf_dir)


@query("component_slices", f"with recursive {BIG_SQL} select page_id, comp_id, count(*) as pixel_count, sum(x*31 + y)::bigint as checksum from (select page_id, comp_id, x - 1 as x, y - 2 as y from loc where x >= 1 and x < 5 and y >= 2 and y < 8) group by all")
def component_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = glyphs.slices(_rasters(spark, sf_dir), F.lit(1), F.lit(2), F.lit(4), F.lit(6))
    return part.groupBy("page_id", "comp_id").agg(F.count(F.lit(1)).alias("pixel_count"), F.sum(F.col("x") * 31 + F.col("y")).alias("checksum"))


@query("component_crops", f"with recursive {BIG_SQL} select page_id, comp_id, min(x) as x0, min(y) as y0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as pixel_count from loc where gray <= 60 group by all")
def component_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.cropped(_rasters(spark, sf_dir), 60)


PAIRS_SQL = f"{BIG_SQL}, pairs as (select page_id, lag(comp_id) over (partition by page_id order by comp_id) as a_id, comp_id as b_id from bg)"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = components.boxes(_big(spark, sf_dir))
    return b.select("page_id", F.lag("comp_id").over(Window.partitionBy("page_id").orderBy("comp_id")).alias("a_id"), F.col("comp_id").alias("b_id")).where("a_id is not null")


@query(
    "united_boxes",
    f"""with recursive {PAIRS_SQL} select p.page_id, a_id, b_id, least(a.x0, b.x0) as x0, least(a.y0, b.y0) as y0, greatest(a.x0 + a.w, b.x0 + b.w) - least(a.x0, b.x0) as w,
 greatest(a.y0 + a.h, b.y0 + b.h) - least(a.y0, b.y0) as h, a.pixel_count + b.pixel_count as pixel_count
 from pairs p join bg a on a.page_id = p.page_id and a.comp_id = a_id join bg b on b.page_id = p.page_id and b.comp_id = b_id""",
)
def united_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.united_boxes(components.boxes(_big(spark, sf_dir)), _neighbours(spark, sf_dir))


@query(
    "united_rasters",
    f"""with recursive {PAIRS_SQL}, own as (select bl.page_id, comp_id, bl.x, bl.y, gray from bl join px on px.page_id = bl.page_id and px.x = bl.x and px.y = bl.y)
select p.page_id, a_id, b_id, count(*) as n, sum(o.x*37 + o.y*101 + o.gray)::bigint as checksum from pairs p join own o on o.page_id = p.page_id and o.comp_id in (a_id, b_id) where a_id is not null group by all""",
)
def united_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = glyphs.united(_big(spark, sf_dir), fx.pixels(spark, sf_dir), _neighbours(spark, sf_dir))
    return u.groupBy("page_id", "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 37 + F.col("y") * 101 + F.col("gray")).alias("checksum"))


PROFILE_SQL = f"{BIG_SQL}, cp as (select page_id, comp_id, l.x, count(*) as n, min(l.y) as top, max(b.h) - 1 - max(l.y) as bottom from loc l join bg b using (page_id, comp_id) group by page_id, comp_id, l.x)"


@query("column_profiles", f"with recursive {PROFILE_SQL} select * from cp")
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.column_profiles(_big(spark, sf_dir))


@query("row_counts", f"with recursive {BIG_SQL} select page_id, comp_id, y, count(*) as n from loc group by all")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.row_counts(_big(spark, sf_dir))


@query(
    "cut_candidates",
    f"""with recursive {PROFILE_SQL}, sd as (select page_id, comp_id, x, 'top' as side, top as depth from cp union all select page_id, comp_id, x, 'bottom', bottom from cp),
t as (select *, depth - lag(depth) over (partition by page_id, comp_id, side order by x desc) as turn from sd),
k as (select *, last_value(case when turn <> 0 then turn end ignore nulls) over (partition by page_id, comp_id, side order by x desc rows between unbounded preceding and 1 preceding) as before from t)
select page_id, comp_id, side, x + 1 as cut from k where turn < 0 and before > 0""",
)
def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.cut_candidates(glyphs.column_profiles(_big(spark, sf_dir)))


RUNS_SQL = f"""{BIG_SQL}, ax as (select page_id, comp_id, 'y' as axis, y as line, x as pos from bl union all select page_id, comp_id, 'x', x, y from bl),
rs as (select page_id, comp_id, axis, line, count(*) as runs from (select *, lag(pos) over (partition by page_id, comp_id, axis, line order by pos) as p from ax) where p is null or p < pos - 1 group by all),
df as (select *, abs(runs - lag(runs) over (partition by page_id, comp_id, axis order by line)) as diff from rs),
rv as (select page_id, comp_id, axis, round(coalesce(avg(diff), 0), 6) as mean_diff, round(coalesce(var_pop(diff), 0), 6) as var_diff from df group by all)"""


@query("run_statistics", f"with recursive {RUNS_SQL} select * from rv")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.run_statistics(_big(spark, sf_dir))


@query(
    "shape_classes",
    f"""with recursive {RUNS_SQL}, st as (select page_id, comp_id, max(var_diff) filter (axis = 'y') as r, max(var_diff) filter (axis = 'x') as c from rv group by all),
m as (select *, w*h as area, avg(w*h) over (partition by page_id) as mean from bg),
j as (select *, -1.09::double*r + 2.8::double <= c as busy, least(w, h)::double/greatest(w, h) <= 0.8::double as long from m join st using (page_id, comp_id))
select page_id, comp_id, case when area <= mean then 'character' when long then case when pixel_count::double/area >= 0.7::double or not busy then 'image' else 'inverted' end when busy then 'character' else 'image' end as class from j""",
)
def shape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = _big(spark, sf_dir)
    return glyphs.shape_classes(components.boxes(big), glyphs.run_statistics(big))


@query(
    "run_midpoints",
    f"""with recursive {BIG_SQL}, hr as (select page_id, comp_id, y, (min(x) + max(x))//2 as x from (select *, x - row_number() over (partition by page_id, comp_id, y order by x) as run from bl) group by page_id, comp_id, y, run),
vr as (select page_id, comp_id, x, (min(y) + max(y))//2 as y from (select *, y - row_number() over (partition by page_id, comp_id, x order by y) as run from bl) group by page_id, comp_id, x, run)
select page_id, comp_id, x, y from hr union select page_id, comp_id, x, y from vr""",
)
def run_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.run_midpoints(_big(spark, sf_dir))


AROUND_SQL = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(glyphs.AROUND))
BITS = [f"(mask & {1 << k} <> 0)" for k in range(8)]
TURNS = " + ".join(f"(not {BITS[k]} and {BITS[(k + 1) % 8]})::int" for k in range(8))


@query(
    "thinned_once",
    f"""with recursive {COMP_SQL}, bg as (select page_id, comp_id from cc where pixel_count >= 8), bl as (select lab.* from lab join bg using (page_id, comp_id)), o as (select * from (values {AROUND_SQL}) as o(k, dx, dy)),
m as (select d.page_id, d.comp_id, d.x, d.y, coalesce(sum(case when e.x is not null then 1 << o.k end), 0)::int as mask from bl d cross join o
 left join bl e on e.page_id = d.page_id and e.comp_id = d.comp_id and e.x = d.x + o.dx and e.y = d.y + o.dy group by all)
select page_id, comp_id, x, y from m where not (bit_count(mask) between 2 and 6 and ({TURNS}) = 1 and not ({BITS[0]} and {BITS[2]} and {BITS[4]}) and not ({BITS[2]} and {BITS[4]} and {BITS[6]}))""",
)
def thinned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.thinned_once(_big(spark, sf_dir), ["page_id", "comp_id"])


# --- lines ------------------------------------------------------------------------------------------------------


@query(
    "line_bases",
    f"""with {LINE_SQL}, p as (select page_id, line_id, (y0 + h)::bigint as b, row_number() over o - 1 as k, count(*) over (partition by page_id, line_id) as n,
 sum(y0 + h) over o as s, sum((y0 + h)*(y0 + h)) over o as q, sum(y0 + h) over (partition by page_id, line_id) as st, sum((y0 + h)*(y0 + h)) over (partition by page_id, line_id) as qt
 from ln window o as (partition by page_id, line_id order by y0 + h, comp_id rows unbounded preceding)),
c as (select p.*, case when n > 1 then k + 1 else 0 end as cut from p where k < n - 1 or n = 1),
j as (select c.*, a.b as base, d.b as descent from c join p a on a.page_id = c.page_id and a.line_id = c.line_id and a.k = c.cut//2 join p d on d.page_id = c.page_id and d.line_id = c.line_id and d.k = c.cut + (c.n - c.cut)//2),
r as (select *, row_number() over (partition by page_id, line_id order by q - 2*base*s + cut*base*base + (qt - q) - 2*descent*(st - s) + (n - cut)*descent*descent, cut desc) as rn from j)
select page_id, line_id, base, descent from r where rn = 1""",
)
def line_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_bases(_lines(spark, sf_dir))


@query("sequential_bases")
def sequential_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.sequential_bases(lines, layout.line_metrics(lines)).select("page_id", "line_id", F.size("base").alias("n_base"), F.size("descent").alias("n_descent"), F.element_at("base", -1)["y"].alias("base"), F.element_at("descent", -1)["y"].alias("descent"))


@query(
    "line_fit",
    f"""with {LINE_SQL}, f as (select page_id, line_id, min(x0)::bigint as px, min(y0 + h)::bigint as py from ln group by all),
d as (select page_id, line_id, floor(abs((x0 - px)*c - 1000*(y0 + h - py))::double/sqrt((1000*1000 + c*c)::double))::bigint as d from ln join f using (page_id, line_id), (select trunc(1000*sin(0.02::double))::bigint as c))
select page_id, line_id, sum(d*d)::bigint as squares, sum(xor(d, 2))::bigint as xors from d group by all""",
)
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    first = lines.groupBy("page_id", "line_id").agg(F.min("x0").cast("long").alias("px"), F.min(F.col("y0") + F.col("h")).cast("long").alias("py"))
    return layout.line_fit(lines.join(first, ["page_id", "line_id"]), ["page_id", "line_id"], F.col("x0"), F.col("y0") + F.col("h"), F.col("px"), F.col("py"), F.lit(0.02))


@query("sliding_means", f"with {LINE_SQL} select page_id, line_id, comp_id, round(avg(h) over (partition by page_id, line_id order by x0, comp_id rows between current row and 3 following), 6) as mean from ln")
def sliding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sliding_means(_lines(spark, sf_dir), ["page_id", "line_id"], ["x0", "comp_id"], "h").select("page_id", "line_id", "comp_id", "mean")


@query(
    "page_annotations",
    f"""with {THRESHOLD_SQL}, th2 as (select d.page_id, d.line_id, lx, lx + lw as rx, ascent, descent, centre from d join th using (page_id, line_id)),
t as (select *, floor(0.6*avg(w) over (partition by page_id, line_id)) as t, lag(x0) over v as px, lag(y0) over v as py, lag(w) over v as pw, lag(h) over v as ph from ln window v as (partition by page_id, line_id order by x0, comp_id)),
g as (select *, floor((x0 - (px + pw))/t)::bigint as ns from t where px is not null and t > 0 and x0 - (px + pw) >= t),
sp as (select page_id, (px + pw//2 + floor((x0 + w//2 - (px + pw//2))/ns))::bigint as sx, (py + ph//2 + floor((y0 + h//2 - (py + ph//2))/ns))::bigint as sy from g)
select page_id, 'centre' as kind, lx as x0, centre as y0, rx as x1, centre as y1 from th2 union all select page_id, 'ascent', lx, ascent, rx, ascent from th2 union all select page_id, 'descent', lx, descent, rx, descent from th2
union all select page_id, 'order', px + pw//2, py + ph//2, x0 + w//2, y0 + h//2 from t where px is not null union all select page_id, 'space', sx, sy, sx + 2, sy + 2 from sp""",
)
def page_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    metrics = layout.line_metrics(lines)
    return layout.annotations(lines, metrics, layout.line_thresholds(metrics), layout.spaces(lines))


# --- dictionaries as tables -------------------------------------------------------------------------------------


@query(
    "trie_nodes",
    f"""with {PREFIX_SQL}, e as (select substring(w, 1, n::int) as prefix, n as depth, substring(w, n::int + 1, 1) as f from pf)
select prefix, left(prefix, depth::int - 1) as parent, right(prefix, 1) as letter, depth, coalesce(string_agg(distinct nullif(f, ''), '' order by nullif(f, '')), '') as children, bool_or(f = '') as ends from e group by prefix, depth""",
)
def trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.trie_nodes(fx.lexicon(spark, sf_dir)).withColumn("children", F.array_join("children", ""))


@query(
    "automaton_states",
    f"""with {PREFIX_SQL}, e as (select substring(w, 1, n::int) as prefix, string_agg(substring(w, n::int + 1), ',' order by substring(w, n::int + 1)) as rest from pf group by 1)
select prefix, min(prefix) over (partition by right(prefix, 1), rest) as state from e""",
)
def automaton_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.automaton(fx.lexicon(spark, sf_dir))


CASED_SQL = f"{LEX_SQL}, cl as (select case when length(w) % 3 = 0 then upper(w) else w end as w from lex), {QW_SQL}, cw as (select case when length(w) % 2 = 0 then upper(w) else w end as w from qw)"


def _cased(words: DataFrame, every: int) -> DataFrame:
    return words.select(F.when(F.length("w") % every == 0, F.upper("w")).otherwise(F.col("w")).alias("w"))


@query("lexicon_spelling", f"with {CASED_SQL} select cw.w, cl.w as known, coalesce(cl.w = cw.w, false) as same from cw left join cl on lower(cl.w) = lower(cw.w)")
def lexicon_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.spelt_as_known(_cased(fx.query_words(spark, sf_dir), 2), _cased(fx.lexicon(spark, sf_dir), 3))


@query("lexicon_match_case", f"with {CASED_SQL} select cw.w, cl.w as known from cw left join cl on cl.w = cw.w")
def lexicon_match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.members(_cased(fx.query_words(spark, sf_dir), 2), _cased(fx.lexicon(spark, sf_dir), 3), match_case=True)


WILD_SQL = f"{LEX_SQL}, wl as (select substring(w, 1, 1) || '?' || substring(w, 3) as w from lex where length(w) >= 3)"


@query(
    "confusion_wildcard",
    f"""with {WILD_SQL}, r as (select * from (values {', '.join(f"('{a}','{b}')" for a, b in lexicon.CONFUSIONS)}) as r(rd, mt)),
e as (select w, rd, mt, unnest(range(1, length(w) + 1)) as k from (select distinct w from wl) cross join r)
select w, k as "at", substring(w, 1, k::int - 1) || mt || substring(w, k::int + length(rd)::int) as candidate from e
where length(substring(w, k::int, length(rd)::int)) = length(rd) and rd like replace(substring(w, k::int, length(rd)::int), '?', '_')""",
)
def confusion_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.lexicon(spark, sf_dir).where("length(w) >= 3").select(F.concat(F.substring("w", 1, 1), F.lit("?"), F.expr("substring(w, 3)")).alias("w"))
    return lexicon.confusions(words.distinct())


@query("glyph_shapes")
def glyph_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.shapes(_labelled(spark, sf_dir))


@query("page_run")
def page_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From page images to the text of their lines: components, types, lines, positions, recognition, words."""
    labels = [*"abcdefgh", "garbage", "connected"]
    return pages.read_text(fx.page_images(spark, sf_dir), 100, 100, network.synthetic(), labels, dictionary=fx.lexicon(spark, sf_dir), threshold=DARK)
