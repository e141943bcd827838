"""A query for each operator over the derived views, with SQL that another engine can run for comparison.

The SQL rounds by printing, which goes by a double's exact binary value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.geometry import corners, xywh_to_xyxy, xyxy_to_xywh
from boxwright.functions.media import frame_rate, jpeg_qscale, message_seconds
from boxwright.functions.names import canonical_category, frame_file_name
from boxwright.operators import dataset as ds
from boxwright.operators import evaluation as ev
from boxwright.operators import crowds, matching, review, revision, validate
from boxwright.operators.average_precision import average_precision
from boxwright.plans import fixtures as fx
from boxwright.sources import files, sinks
from boxwright.sources.scratch import drop_stored, shared_folder, stored, table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Confidence and overlap of the queries at one operating point.
AT, LEAST = 0.26, 0.5
#: Images of a label folder that is written and read back.
_FOLDER = 1 << 18


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = fx.oracle(sql)
        return f

    return add


def _images(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.IMAGES)


def _gt(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.GROUND_TRUTH)


def _pr(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.PREDICTIONS)


def _matches(s: SparkSession, d: str) -> DataFrame:
    return matching.match(_gt(s, d), _pr(s, d), fx.MODELS, AT, LEAST)


def _iou(a: str, b: str) -> str:
    inner = (
        f"(greatest(0::double, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
        f"*greatest(0::double, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    )
    areas = "+".join(f"greatest(0::double,{t}.x2-{t}.x1)*greatest(0::double,{t}.y2-{t}.y1)" for t in (a, b))
    return f"({inner}/({areas}-{inner}))"


_VIEWS = f"img as ({fx.IMAGES}), gt as ({fx.GROUND_TRUTH}), pr0 as ({fx.PREDICTIONS})"
_MODELS = "models as (select unnest(['baseline','candidate']) as model_name)"


def _fold(edges: str, by: str, a: str, b: str) -> str:
    """CTEs picks: of the ordered edges (rn in each group `by`), those that a greedy walk takes."""
    on = " and ".join(f"e.{c}=f.{c}" for c in by.split(","))
    f_by = ",".join(f"f.{c}" for c in by.split(","))
    ok = f"(not list_contains(f.ua,e.{a}) and not list_contains(f.ub,e.{b}))"
    return f"""e as ({edges}),
fold as (select distinct {by}, cast(0 as bigint) as rn, cast([] as bigint[]) as ua, cast([] as bigint[]) as ub, false as taken from e
 union all select {f_by}, e.rn, case when {ok} then list_append(f.ua,e.{a}) else f.ua end,
  case when {ok} then list_append(f.ub,e.{b}) else f.ub end, {ok}
 from fold f join e on {on} and e.rn=f.rn+1),
picks as (select e.* from fold f join e on {on} and e.rn=f.rn where f.taken)"""


_EDGES = f"""select *, row_number() over (partition by model_name,image_id order by phase, confidence desc, det_pos, iou desc, ann_ord) as rn
 from (select p.model_name, p.image_id, p.det_pos, g.ann_ord, p.confidence,
  case when p.category=g.category then 1 else 2 end as phase, {_iou("p", "g")} as iou from pr p join gt g using (image_id)) x
 where iou>={LEAST} and iou>0"""

MATCH_SQL = f"""with recursive {_VIEWS}, {_MODELS}, pr as (select * from pr0 where confidence>={AT}),
{_fold(_EDGES, "model_name,image_id", "det_pos", "ann_ord")},
matches as (
 select k.model_name, k.image_id, case k.phase when 1 then 'true_positive' else 'class_confusion' end as match_type,
  g.category, p.category as predicted_category, p.confidence, k.iou, p.det_pos, g.annotation_id,
  p.x1 as px1,p.y1 as py1,p.x2 as px2,p.y2 as py2,g.x1 as gx1,g.y1 as gy1,g.x2 as gx2,g.y2 as gy2
 from picks k join pr p using (model_name,image_id,det_pos) join gt g on g.image_id=k.image_id and g.ann_ord=k.ann_ord
 union all select p.model_name, p.image_id, 'false_positive', p.category, p.category, p.confidence, null, p.det_pos, null,
  p.x1,p.y1,p.x2,p.y2,null,null,null,null from pr p anti join picks k using (model_name,image_id,det_pos)
 union all select m.model_name, g.image_id, 'false_negative', g.category, null, null, null, null, g.annotation_id,
  null,null,null,null,g.x1,g.y1,g.x2,g.y2
 from gt g cross join models m left join picks k on k.model_name=m.model_name and k.image_id=g.image_id and k.ann_ord=g.ann_ord
 where k.ann_ord is null)
"""


# boxes and names


@query(f"with {_VIEWS} select annotation_id, image_id, split, file_name, category, x1, y1, x2, y2 from gt join img using (image_id)")
def ground_truth_boxes(s: SparkSession, d: str) -> DataFrame:
    return ds.ground_truth_boxes(_gt(s, d), _images(s, d)).select(
        "annotation_id", "image_id", "split", "file_name", "category", "x1", "y1", "x2", "y2"
    )


@query(
    f"""with {_VIEWS} select file_name, replace(file_name, regexp_extract(file_name,'_jpg[.]rf[.][^.]+[.]jpg$'), '.jpg') as image_key,
 split_part(file_name,'_frame',1) as recording, cast(regexp_extract(file_name,'_([0-9]{{10}})ms',1) as double)/1000 as timestamp_seconds
 from img"""
)
def image_provenance(s: SparkSession, d: str) -> DataFrame:
    return ds.image_provenance(_images(s, d))


@query(
    f"""with {_VIEWS} select * from (select p.model_name, p.image_id, p.det_pos, g.ann_ord, p.category=g.category as same,
 {_iou("p", "g")} as iou from pr0 p join gt g using (image_id)) where iou>={LEAST} and iou>0"""
)
def iou_pairs(s: SparkSession, d: str) -> DataFrame:
    return matching.iou_pairs(_gt(s, d), _pr(s, d), LEAST)


@query(f"with {_VIEWS} select model_name, image_id, det_pos, category, confidence from pr0 where confidence>={AT}")
def confidence_filter(s: SparkSession, d: str) -> DataFrame:
    return matching.confident(_pr(s, d), AT).select("model_name", "image_id", "det_pos", "category", "confidence")


@query(
    f"""with {_VIEWS} select model_name, image_id, det_pos, (printf('%.6f', confidence)::double + 0) as confidence, x1, y1, x2, y2 from (
 select model_name, image_id, det_pos, confidence, least(greatest(x1-40,0),200::double) as x1, least(greatest(y1,0),150::double) as y1,
 least(greatest(x2-40,0),200::double) as x2, least(greatest(y2,0),150::double) as y2 from pr0) where x2>x1 and y2>y1"""
)
def normalized_detections(s: SparkSession, d: str) -> DataFrame:
    raw = _pr(s, d).withColumns(
        {"x1": F.col("x1") - 40, "x2": F.col("x2") - 40, "width": F.lit(200), "height": F.lit(150)}
    )
    return ds.normalized_detections(raw).select("model_name", "image_id", "det_pos", "confidence", "x1", "y1", "x2", "y2")


@query(f"with {_VIEWS} select annotation_id, x1 as x, y1 as y, greatest(0::double,x2-x1) as w, greatest(0::double,y2-y1) as h from gt")
def boxes_as_xywh(s: SparkSession, d: str) -> DataFrame:
    x, y, w, h = xyxy_to_xywh(corners())
    return _gt(s, d).select("annotation_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query(
    f"""with {_VIEWS}, n as (select annotation_id % 12 as k, category from gt)
select distinct k, case when k<6 then ['left','LEFT hand','hand left',' Left_Hand ','Hand-Left','left-  hand'][k+1]
 else ['Right','right HAND','hand  right','RIGHT_hand',' hand-right','right_-hand'][k-5] end as raw,
 case when k<6 then 'left_hand' else 'right_hand' end as category from n"""
)
def canonical_categories(s: SparkSession, d: str) -> DataFrame:
    names = (
        "left", "LEFT hand", "hand left", " Left_Hand ", "Hand-Left", "left-  hand",
        "Right", "right HAND", "hand  right", "RIGHT_hand", " hand-right", "right_-hand",
    )
    k = (F.col("annotation_id") % 12).alias("k")
    rows = _gt(s, d).select(k).distinct().withColumn("raw", F.get(F.array(*map(F.lit, names)), F.col("k").cast("int")))
    return rows.withColumn("category", canonical_category(F.col("raw")))


@query(
    f"""with {_VIEWS} select image_id, printf('c_%d_frame%06d_%010dms.jpg', image_id, image_id, cast(image_id*250 as bigint)) as name,
 case when image_id%2=0 then 30000.0::double/1001 else 25.0::double end as fps,
 least(31, greatest(2, cast((printf('%.0f', 31-(image_id%100)*29::double/99)::double + 0) as int))) as qscale from img"""
)
def frame_names(s: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    return _images(s, d).select(
        "image_id",
        frame_file_name(F.concat(F.lit("_c/"), i.cast("string")), i, i * 0.25).alias("name"),
        frame_rate(F.when(i % 2 == 0, "30000/1001").otherwise("25")).alias("fps"),
        jpeg_qscale(i % 100 + 1).alias("qscale"),
    )


_AXIS = "case when {c}-{s}/2>=0 and {c}+{s}/2<=1 then {s} else (printf('%.6f', {s}-0.000001)::double + 0) end"


@query(
    f"""with {_VIEWS}, a as (select annotation_id, category, (printf('%.6f', (x1+x2)/2/640)::double + 0) as cx, (printf('%.6f', (y1+y2)/2/480)::double + 0) as cy,
 (printf('%.6f', (x2-x1)/640)::double + 0) as w, (printf('%.6f', (y2-y1)/480)::double + 0) as h from gt)
select annotation_id, printf('%d %.6f %.6f %.6f %.6f', case when category='left_hand' then 0 else 1 end, cx, cy,
 {_AXIS.format(c="cx", s="w")}, {_AXIS.format(c="cy", s="h")}) as line from a"""
)
def yolo_labels(s: SparkSession, d: str) -> DataFrame:
    return ds.yolo_lines(_gt(s, d), _images(s, d)).select("annotation_id", "line")


@query(
    f"""with {_VIEWS}, v as (select image_id, (image_id%7)+0.5::double as dur, 29.97::double as fps, cast(floor(((image_id%7)+0.5::double)*29.97::double) as bigint) as n from img),
 k as (select *, unnest(generate_series(0::bigint, greatest(1, cast(ceil(dur*2) as bigint))-1)) as k from v)
select image_id, cast(floor(k/2::double*fps) as bigint) as frame_index, floor(k/2::double*fps)/fps as timestamp_seconds from k
 where k/2::double<dur and floor(k/2::double*fps)<n"""
)
def sample_points(s: SparkSession, d: str) -> DataFrame:
    length = F.col("image_id") % 7 + F.lit(0.5)
    videos = _images(s, d).select(
        "image_id",
        length.alias("duration_seconds"),
        F.lit(29.97).alias("fps"),
        F.floor(length * F.lit(29.97)).alias("frame_count"),
    )
    return ds.sample_points(videos, 2).select("image_id", "frame_index", "timestamp_seconds")


# matching


@query(MATCH_SQL + "select model_name, image_id, match_type, category, predicted_category, confidence, iou, det_pos, annotation_id from matches")
def matches(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).drop("p", "g")


def _mosaic(df: DataFrame, place: str) -> DataFrame:
    """Every third image side by side in one, so that an image holds a third of all boxes."""
    shift = F.floor(F.col("image_id") / 3) * 1000
    moved = df.withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift, place: F.col("image_id") * 100 + F.col(place)})
    return moved.withColumn("image_id", F.col("image_id") % 3)


@query(
    MATCH_SQL
    + """select model_name, image_id%3 as image_id, match_type, category, predicted_category, confidence, iou, image_id*100+det_pos as det_pos, annotation_id
 from matches"""
)
def crowded_matches(s: SparkSession, d: str) -> DataFrame:
    """Three images with all boxes of the others, matched in a grid and in rounds."""
    truth, found = _mosaic(_gt(s, d), "ann_ord"), _mosaic(_pr(s, d), "det_pos")
    return crowds.match_crowds(truth, found, fx.MODELS, AT, LEAST).drop("p", "g")


@query(
    f"""with {_VIEWS} select * from (select p.model_name, p.image_id%3 as image_id, p.image_id*100+p.det_pos as det_pos,
 g.image_id*100+g.ann_ord as ann_ord, p.category=g.category as same, {_iou("p", "g")} as iou from pr0 p join gt g using (image_id)) where iou>=0.3"""
)
def crowded_pairs(s: SparkSession, d: str) -> DataFrame:
    box = ("image_id", "category", "x1", "y1", "x2", "y2")
    found, truth = _mosaic(_pr(s, d), "det_pos").select("model_name", "det_pos", *box), _mosaic(_gt(s, d), "ann_ord").select("ann_ord", *box)
    met = crowds.grid_pairs(found, truth, 0.3)
    same = (F.col("a.category") == F.col("b.category")).alias("same")
    return met.select("a.model_name", "image_id", "a.det_pos", "b.ann_ord", same, "iou")


@query(MATCH_SQL + "select model_name, image_id, det_pos, annotation_id, predicted_category, category, iou from matches where match_type='class_confusion'")
def class_confusions(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).where("match_type = 'class_confusion'").select(
        "model_name", "image_id", "det_pos", "annotation_id", "predicted_category", "category", "iou"
    )


@query(MATCH_SQL + "select model_name, image_id, annotation_id, category from matches where match_type='false_negative'")
def false_negatives(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).where("match_type = 'false_negative'").select("model_name", "image_id", "annotation_id", "category")


_COUNTS = """select {by}, category, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(c)::bigint as confusions from (
 select {by}, category, (match_type='true_positive')::int as tp, (match_type='false_positive')::int as fp, (match_type='false_negative')::int as fn, 0 as c from m
 where match_type<>'class_confusion'
 union all select {by}, 'overall_micro', (match_type='true_positive')::int, (match_type in ('false_positive','class_confusion'))::int,
  (match_type in ('false_negative','class_confusion'))::int, (match_type='class_confusion')::int from m
 union all select {by}, predicted_category, 0, 1, 0, 1 from m where match_type='class_confusion'
 union all select {by}, category, 0, 0, 1, 1 from m where match_type='class_confusion') group by all"""


@query(MATCH_SQL + ", m as (select * from matches) " + _COUNTS.format(by="model_name"))
def match_counts(s: SparkSession, d: str) -> DataFrame:
    return ev.match_counts(_matches(s, d))


# evaluation

_SWEEP_EDGES = _EDGES.replace("where iou>=", "where phase=1 and iou>=")
_SWEEP = f"""with recursive img as ({fx.IMAGES}), pr0 as ({fx.PREDICTIONS}),
gt as (select g.* from ({fx.GROUND_TRUTH}) g join img using (image_id) where split<>'test' or category='left_hand'),
{_MODELS}, pr as (select * from pr0),
{_fold(_SWEEP_EDGES, "model_name,image_id", "det_pos", "ann_ord")},
one as (select split, model_name, pr.category, pr.confidence, (k.det_pos is not null)::int as tp from pr join img using (image_id)
  left join picks k using (model_name,image_id,det_pos)),
two as (select * from one union all select split, model_name, 'overall_micro', confidence, tp from one),
total0 as (select split, category from gt join img using (image_id)),
total as (select split, category, count(*) as gt from (select * from total0 union all select split, 'overall_micro' from total0) group by all),
steps as (select split, model_name, category, confidence, sum(tp) as tp, sum(n) as n from (
  select split, model_name, category, confidence, tp, 1 as n from two
  union all select split, model_name, category, unnest([0::double,1::double]), 0, 0 from (select distinct split from img)
   cross join models cross join (select unnest(['overall_micro','left_hand','right_hand']) as category)) group by all),
sweep as (select split, model_name, category, confidence as threshold,
  (sum(tp) over w)::bigint as tp, (sum(n) over w - sum(tp) over w)::bigint as fp, (coalesce(gt,0) - sum(tp) over w)::bigint as fn
 from steps left join total using (split, category)
 window w as (partition by split, model_name, category order by confidence desc rows unbounded preceding)),
pr_ as (select *, case when tp+fp=0 then 0::double else tp::double/(tp+fp) end as p, case when tp+fn=0 then 0::double else tp::double/(tp+fn) end as r from sweep),
scored as (select split, model_name, category, threshold, tp, fp, fn, (printf('%.6f', p)::double + 0) as precision, (printf('%.6f', r)::double + 0) as recall,
  (printf('%.6f', case when p+r=0 then 0::double else 2.0::double*p*r/(p+r) end)::double + 0) as f1,
  (printf('%.6f', case when 4*p+r=0 then 0::double else 5.0::double*p*r/(4.0::double*p+r) end)::double + 0) as f2 from pr_)
"""


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """The test split has no boxes of one category, and still a sweep over its predictions."""
    images = _images(s, d)
    left = images.where("split = 'test'").select("image_id")
    truth = _gt(s, d)
    gone = truth.where("category <> 'left_hand'").join(left, "image_id", "left_semi").select("annotation_id")
    return ev.threshold_sweep(images, truth.join(gone, "annotation_id", "left_anti"), _pr(s, d), fx.MODELS, LEAST)


@query(_SWEEP + "select split, model_name, category, threshold, tp, fp, fn from scored")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return _sweep(s, d)


@query(_SWEEP + "select split, model_name, category, threshold, precision, recall, f1, f2 from scored")
def pr_curve_points(s: SparkSession, d: str) -> DataFrame:
    return ev.pr_curve_points(_sweep(s, d))


@query(
    _SWEEP
    + """select split, model_name, category, max(row(f1, (printf('%.6f', threshold)::double + 0)))[2] as f1_threshold, max(f1) as best_f1,
 max(row(f2, (printf('%.6f', threshold)::double + 0)))[2] as f2_threshold, max(f2) as best_f2 from scored group by all"""
)
def threshold_selection(s: SparkSession, d: str) -> DataFrame:
    return ev.select_thresholds(_sweep(s, d))


_ROWS = (
    MATCH_SQL
    + f""", m as (select split, matches.* from matches join img using (image_id)), counts as ({_COUNTS.format(by="split, model_name")}),
keys as (select distinct split, model_name, c as category from img cross join models cross join (select unnest(['overall_micro','left_hand','right_hand']) as c)),
ng0 as (select split, category from gt join img using (image_id)),
ng as (select split, category, count(*) as n from (select * from ng0 union all select split, 'overall_micro' from ng0) group by all),
np0 as (select split, model_name, category from pr join img using (image_id)),
np as (select split, model_name, category, count(*) as n from (select * from np0 union all select split, model_name, 'overall_micro' from np0) group by all),
ni as (select split, count(*) as image_count from img group by all),
r0 as (select split, model_name, category, image_count, coalesce(tp,0) as tp, coalesce(fp,0) as fp, coalesce(fn,0) as fn,
 coalesce(confusions,0) as confusions, coalesce(ng.n,0) as ground_truth_count, coalesce(np.n,0) as prediction_count
 from keys left join counts using (split, model_name, category) left join ng using (split, category)
 left join np using (split, model_name, category) join ni using (split)),
r1 as (select *, case when tp+fp=0 then 0::double else tp::double/(tp+fp) end as p, case when tp+fn=0 then 0::double else tp::double/(tp+fn) end as r from r0),
rows_ as (select split, model_name, category, image_count, tp, fp, fn, confusions, ground_truth_count, prediction_count,
  (printf('%.6f', p)::double + 0) as precision, (printf('%.6f', r)::double + 0) as recall,
  (printf('%.6f', case when p+r=0 then 0::double else 2.0::double*p*r/(p+r) end)::double + 0) as f1,
  (printf('%.6f', case when 4*p+r=0 then 0::double else 5.0::double*p*r/(4.0::double*p+r) end)::double + 0) as f2 from r1),
macro as (select split, model_name, 'macro_classes' as category, max(image_count) as image_count, sum(tp)::bigint as tp, sum(fp)::bigint as fp,
  sum(fn)::bigint as fn, max(confusions) as confusions, sum(ground_truth_count)::bigint as ground_truth_count, sum(prediction_count)::bigint as prediction_count,
  (printf('%.6f', avg(precision))::double + 0) as precision, (printf('%.6f', avg(recall))::double + 0) as recall, (printf('%.6f', avg(f1))::double + 0) as f1, (printf('%.6f', avg(f2))::double + 0) as f2
  from rows_ where category<>'overall_micro' group by split, model_name),
all_ as (select * from rows_ union all select * from macro)
"""
)
_ROW_COLUMNS = ["split", "model_name", "category", "image_count", "tp", "fp", "fn", "confusions", "ground_truth_count", "prediction_count", "precision", "recall", "f1", "f2"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    return ev.evaluation_rows(_images(s, d), _gt(s, d), _pr(s, d), fx.MODELS, AT, LEAST)


@query(_ROWS + "select * from all_")
def evaluation_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).select(_ROW_COLUMNS)


@query(_ROWS + "select * from macro")
def macro_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).where("category = 'macro_classes'").select(_ROW_COLUMNS)


@query(
    _ROWS
    + "select split, category, a.model_name as baseline_model, b.model_name as candidate_model, "
    + ", ".join(
        f"a.{m} as {m}_baseline, b.{m} as {m}_candidate, (printf('%.6f', b.{m}-a.{m})::double + 0) as {m}_absolute_delta, "
        f"case when a.{m}<>0 then (printf('%.3f', (b.{m}-a.{m})/a.{m}*100)::double + 0) end as {m}_relative_percent"
        for m in ("precision", "recall", "f1", "f2")
    )
    + " from all_ a join all_ b using (split, category) where a.model_name='baseline' and b.model_name='candidate'"
)
def metric_deltas(s: SparkSession, d: str) -> DataFrame:
    out = ev.metric_deltas(_rows(s, d), *fx.MODELS)
    return out.drop(*[c for c in out.columns if c.startswith(("ap", "map"))])


@query(
    _ROWS
    + """select model_name, category, 'equal_split_average' as aggregation, (printf('%.6f', avg(precision))::double + 0) as precision, (printf('%.6f', avg(recall))::double + 0) as recall,
 (printf('%.6f', avg(f1))::double + 0) as f1, (printf('%.6f', avg(f2))::double + 0) as f2 from all_ group by all
union all select model_name, category, 'pooled_counts', (printf('%.6f', p)::double + 0), (printf('%.6f', r)::double + 0),
 (printf('%.6f', case when p+r=0 then 0::double else 2.0::double*p*r/(p+r) end)::double + 0), (printf('%.6f', case when 4*p+r=0 then 0::double else 5.0::double*p*r/(4.0::double*p+r) end)::double + 0)
 from (select model_name, category, case when sum(tp+fp)=0 then 0::double else sum(tp)::double/sum(tp+fp) end as p,
  case when sum(tp+fn)=0 then 0::double else sum(tp)::double/sum(tp+fn) end as r from all_ group by all)"""
)
def diagnostic_aggregates(s: SparkSession, d: str) -> DataFrame:
    return ev.diagnostic_aggregates(_rows(s, d)).select("model_name", "category", "aggregation", "precision", "recall", "f1", "f2")


#: Annotations that are crowds in the queries of average precision.
_CROWD = "annotation_id % 17 = 3"
_AP_EDGES = f"""select *, row_number() over (partition by model_name,image_id,category,t order by confidence desc, det_pos, iou desc, ann_ord desc) as rn
 from (select p.model_name, p.image_id, p.category, p.det_pos, g.ann_ord, p.confidence, {_iou("p", "g")} as iou
  from pr p join gt g on g.image_id=p.image_id and g.category=p.category where not g.crowd) x
 join (select t, round(0.5+0.05*t,2)::double as lim from (select unnest(generate_series(0,9)) as t)) y on iou>=lim"""


def _ap_below(tp: str) -> str:
    """Recall points k * 0.01 at or below tp / n, counted one by one."""
    return f"len(list_filter(range(101), lambda k: k * 0.01::double <= ({tp})::double / n))"


_AP = f"""with recursive img as ({fx.IMAGES}), gt as (select *, {_CROWD} as crowd from ({fx.GROUND_TRUTH}) g), pr as ({fx.PREDICTIONS}), {_MODELS},
{_fold(_AP_EDGES, "model_name,image_id,category,t", "det_pos", "ann_ord")},
n as (select split, category, count(*) as n from gt join img using (image_id) where not crowd group by all),
ts as (select unnest(generate_series(0,9)) as t),
over_ as (select model_name, p.image_id, det_pos, max(greatest(0::double, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0::double, least(p.y2,g.y2)-greatest(p.y1,g.y1))
  /((p.x2-p.x1)*(p.y2-p.y1))) as cover from pr p join gt g on g.image_id=p.image_id and g.category=p.category where g.crowd group by all),
all_det as (select split, model_name, category, t, (k.det_pos is not null)::int as hit, pr.confidence, image_id, det_pos,
   k.det_pos is null and coalesce(cover,0)>=round(0.5+0.05*t,2)::double as out
  from pr join img using (image_id) cross join ts left join picks k using (model_name,image_id,category,t,det_pos) left join over_ using (model_name,image_id,det_pos)),
det as (select *, row_number() over (partition by split,model_name,category,t order by confidence desc, image_id, det_pos) as rank from all_det where not out),
hits as (select *, sum(hit) over (partition by split,model_name,category,t order by rank) as tp from det),
env as (select *, max(tp::double/rank) over (partition by split,model_name,category,t order by rank desc) as best from hits where hit=1),
ap as (select split, model_name, category, t, sum(best*({_ap_below("tp")} - case when tp=1 then 0 else {_ap_below("tp-1")} end))/101 as ap
  from env join n using (split, category) group by all),
each as (select split, m.model_name, category, t, coalesce(ap,0::double) as ap from n cross join models m cross join ts left join ap using (split,model_name,category,t))
select split, model_name, category, round(avg(ap) filter (where t=0),9) as ap50, round(avg(ap) filter (where t=5),9) as ap75, round(avg(ap),9) as map_50_95 from each group by all
union all select split, model_name, 'overall_micro', round(avg(ap) filter (where t=0),9), round(avg(ap) filter (where t=5),9), round(avg(ap),9) from each group by split, model_name
"""


@query(_AP)
def coco_ap(s: SparkSession, d: str) -> DataFrame:
    """Some boxes are crowds."""
    truth = _gt(s, d).withColumn("iscrowd", F.expr(_CROWD).cast("int"))
    out = average_precision(_images(s, d), truth, _pr(s, d), fx.MODELS)
    return out.withColumns({c: F.round(c, 9) for c in ("ap50", "ap75", "map_50_95")})


# validation and summaries


@query(
    f"""with {_VIEWS} select annotation_id, image_id, case when width is null then 'unknown image' when w<=0 or h<=0 then 'no extent' else 'outside the image' end as reason
 from (select annotation_id, gt.image_id, x1+500 as x, y1-10 as y, case when annotation_id%11=0 then 0 else x2-x1 end as w, y2-y1 as h, width, height
  from gt left join (select * from img where image_id%9<>0) i using (image_id))
 where width is null or w<=0 or h<=0 or x<0 or y<0 or x+w>width+1e-6 or y+h>height+1e-6"""
)
def bbox_violations(s: SparkSession, d: str) -> DataFrame:
    a = _gt(s, d).select(
        "annotation_id",
        "image_id",
        (F.col("x1") + 500).alias("x"),
        (F.col("y1") - 10).alias("y"),
        F.when(F.col("annotation_id") % 11 == 0, 0).otherwise(F.col("x2") - F.col("x1")).alias("w"),
        (F.col("y2") - F.col("y1")).alias("h"),
    )
    return validate.bbox_violations(a, _images(s, d).where("image_id % 9 <> 0"))


@query(f"with {_VIEWS} select split, name, count(*) as n from (select split, split_part(file_name,'_frame',1) as name from img) group by all having count(*)>1")
def duplicate_image_names(s: SparkSession, d: str) -> DataFrame:
    names = _images(s, d).select("split", F.substring_index("file_name", "_frame", 1).alias("name"))
    return validate.duplicates(names, "split", "name")


@query(
    f"""with {_VIEWS}, a as (select split, case when category='left_hand' and image_id%8<>0 then 'foot' else category end as category
  from gt join img using (image_id) where split='train' or category='left_hand'),
 c as (select distinct split, category from a where category<>'left_hand' union all select 'valid', 'left_hand')
select split, category, count(*) as n, 'unsupported' as reason from a where category='foot' group by all
union all select split, k, 0, 'missing' from (select distinct split from c) cross join (select unnest(['left_hand','right_hand']) as k)
 anti join (select split, category as k from c) x using (split, k)"""
)
def category_violations(s: SparkSession, d: str) -> DataFrame:
    """Documents whose lists have a category without annotations, lack one that has some, or name one that isn't supported."""
    rows = _gt(s, d).join(_images(s, d).select("image_id", "split"), "image_id").where("split = 'train' or category = 'left_hand'")
    named = F.when((F.col("category") == "left_hand") & (F.col("image_id") % 8 != 0), "foot").otherwise(F.col("category"))
    rows = rows.select("split", named.alias("category"))
    listed = rows.where("category <> 'left_hand'").distinct()
    listed = listed.unionByName(rows.sparkSession.createDataFrame([("valid", "left_hand")], "split string, category string"))
    return validate.category_violations(rows, listed)


@query(f"with {_VIEWS}, {_MODELS} select image_id, model_name, split, file_name from img cross join models anti join pr0 using (image_id, model_name)")
def coverage_missing(s: SparkSession, d: str) -> DataFrame:
    return validate.coverage_missing(_images(s, d), _pr(s, d), fx.MODELS).select("image_id", "model_name", "split", "file_name")


@query(f"with {_VIEWS} select model_name, image_id, det_pos from pr0 anti join (select * from img where split<>'test') i using (image_id)")
def coverage_extra(s: SparkSession, d: str) -> DataFrame:
    found = validate.coverage_extra(_images(s, d).where("split <> 'test'"), _pr(s, d))
    return found.select("model_name", "image_id", "det_pos")


@query(f"with {_VIEWS} select image_id, file_name, split from img anti join gt using (image_id)")
def negative_images(s: SparkSession, d: str) -> DataFrame:
    return validate.negative_images(_images(s, d), _gt(s, d)).select("image_id", "file_name", "split")


@query(
    f"""with {_VIEWS}, i as (select split_part(file_name,'_frame',1) as recording, case when image_id%90=0 then 'leak' else split end as split from img)
select recording, array_to_string(list_sort(list(distinct split)),',') as splits from i group by recording having count(distinct split)>1"""
)
def recording_leakage(s: SparkSession, d: str) -> DataFrame:
    moved = _images(s, d).withColumn("split", F.when(F.col("image_id") % 90 == 0, "leak").otherwise(F.col("split")))
    return validate.recording_leakage(moved).withColumn("splits", F.array_join("splits", ","))


@query(
    f"""with {_VIEWS}, c as (select image_id, count(*) as n, count(*) filter (where category='left_hand') as l, count(*) filter (where category='right_hand') as r from gt group by all)
select split, count(*) as images, coalesce(sum(n),0)::bigint as annotations, count(*) filter (where n is null) as negatives,
 count(distinct split_part(file_name,'_frame',1)) as recordings, coalesce(sum(l),0)::bigint as left_hand_annotations, coalesce(sum(r),0)::bigint as right_hand_annotations
from img left join c using (image_id) group by split"""
)
def split_summary(s: SparkSession, d: str) -> DataFrame:
    return ds.split_summary(_images(s, d), _gt(s, d))


@query(f"with {_VIEWS} select image_id, file_name, split from img order by file_name limit 50 offset 100")
def paged_images(s: SparkSession, d: str) -> DataFrame:
    return ds.paged_images(_images(s, d), 100, 50).select("image_id", "file_name", "split")


# review

_MANIFEST = (
    MATCH_SQL
    + """, c as (select image_id, model_name, count(*) filter (where match_type='true_positive') as tp, count(*) filter (where match_type='false_positive') as fp,
 count(*) filter (where match_type='false_negative') as fn, count(*) filter (where match_type='class_confusion') as cc,
 (printf('%.6f', min(iou) filter (where match_type='true_positive'))::double + 0) as lo, avg(iou) filter (where match_type='true_positive') as mean,
 (printf('%.6f', max(confidence) filter (where match_type='false_positive'))::double + 0) as hi from matches group by all),
manifest as (select split, file_name, split_part(file_name,'_frame',1) as source_recording, cast(regexp_extract(file_name,'_([0-9]{10})ms',1) as double)/1000 as timestamp_seconds,
 model_name, coalesce(tp,0) as true_positive_count, coalesce(fp,0) as false_positive_count, coalesce(fn,0) as false_negative_count, coalesce(cc,0) as class_confusion_count,
 lo as minimum_true_positive_iou, (printf('%.6f', mean)::double + 0) as mean_true_positive_iou, hi as maximum_false_positive_confidence
 from img cross join models left join c using (image_id, model_name))
"""
)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return review.image_manifest(_images(s, d), _matches(s, d), fx.MODELS)


@query(_MANIFEST + "select * from manifest")
def image_manifest(s: SparkSession, d: str) -> DataFrame:
    return _manifest(s, d)


@query(_MANIFEST + "select model_name, file_name, false_positive_count, maximum_false_positive_confidence from manifest where false_positive_count>0 order by 3 desc, 4 desc, 2")
def review_false_positives(s: SparkSession, d: str) -> DataFrame:
    return review.false_positive_page(_manifest(s, d)).select("model_name", "file_name", "false_positive_count", "maximum_false_positive_confidence")


@query(_MANIFEST + "select model_name, file_name, false_negative_count from manifest where false_negative_count>0 order by 3 desc, 2")
def review_false_negatives(s: SparkSession, d: str) -> DataFrame:
    return review.false_negative_page(_manifest(s, d)).select("model_name", "file_name", "false_negative_count")


@query(_MANIFEST + "select model_name, file_name, minimum_true_positive_iou from manifest where minimum_true_positive_iou is not null order by 3, 2")
def review_lowest_iou(s: SparkSession, d: str) -> DataFrame:
    return review.lowest_iou_page(_manifest(s, d)).select("model_name", "file_name", "minimum_true_positive_iou")


@query(_MANIFEST + "select model_name, file_name, class_confusion_count from manifest where class_confusion_count>0 order by 3 desc, 2")
def review_class_confusions(s: SparkSession, d: str) -> DataFrame:
    return review.confusion_page(_manifest(s, d)).select("model_name", "file_name", "class_confusion_count")




def _box_text(prefix: str) -> str:
    cells = " || ', ' || ".join(f"printf('%.1f', {prefix}{c})" for c in ("x1", "y1", "x2", "y2"))
    return f"'[' || {cells} || ']'"


@query(
    MATCH_SQL
    + f"""select split, file_name, split_part(file_name,'_frame',1) as source_recording, cast(regexp_extract(file_name,'_([0-9]{{10}})ms',1) as double)/1000 as timestamp_seconds,
 model_name, match_type, category, coalesce(predicted_category, category) as predicted_category, (printf('%.6f', confidence)::double + 0) as confidence, (printf('%.6f', iou)::double + 0) as iou,
 {_box_text("p")} as prediction_bbox_xyxy, {_box_text("g")} as ground_truth_bbox_xyxy from matches join img using (image_id)"""
)
def box_manifest(s: SparkSession, d: str) -> DataFrame:
    return review.box_manifest(_images(s, d), _matches(s, d))


@query(
    MATCH_SQL
    + """select annotation_id from matches where match_type='false_negative' group by annotation_id having count(distinct model_name)=2"""
)
def shared_false_negatives(s: SparkSession, d: str) -> DataFrame:
    return review.shared_false_negatives(_matches(s, d), *fx.MODELS)


_FP2 = f""", f as (select model_name, image_id, category, det_pos, px1 as x1, py1 as y1, px2 as x2, py2 as y2 from matches where match_type='false_positive'),
fp2 as (select * from (select a.image_id, a.category, a.det_pos as first_det_pos, b.det_pos as second_det_pos, {_iou("a", "b")} as iou
 from f a join f b on a.image_id=b.image_id and a.category=b.category where a.model_name='baseline' and b.model_name='candidate') where iou>=0.5)
"""


@query(MATCH_SQL + _FP2 + "select * from fp2")
def shared_false_positives(s: SparkSession, d: str) -> DataFrame:
    return review.shared_false_positives(_matches(s, d), *fx.MODELS)


_PRIORITY = (
    MATCH_SQL
    + _FP2
    + """, err as (select distinct image_id, model_name from matches where match_type<>'true_positive'),
sfn as (select annotation_id from matches where match_type='false_negative' group by 1 having count(distinct model_name)=2),
prio as (select image_id, model_name, max(rank) as rank from (
 select image_id, model_name, 0 as rank from err
 union all select image_id, model_name, 1 from matches join sfn using (annotation_id) where match_type='false_negative'
 union all select image_id, model_name, 2 from fp2 cross join models
 union all select image_id, max(model_name), 3 from err group by image_id having count(*)=1
 union all select image_id, model_name, 4 from matches where match_type='class_confusion') group by all),
priority as (select image_id, model_name, ['model_error','shared_missed_gt','shared_high_confidence_fp','model_only_error','left_right_disagreement'][rank+1] as review_priority from prio)
"""
)


@query(_PRIORITY + "select * from priority")
def review_priority(s: SparkSession, d: str) -> DataFrame:
    return review.review_priority(_matches(s, d), *fx.MODELS)


@query(
    _PRIORITY
    + f"""select split, model_name, file_name, split_part(file_name,'_frame',1) as source_recording, cast(regexp_extract(file_name,'_([0-9]{{10}})ms',1) as double)/1000 as timestamp_seconds,
 match_type as error_type, category, predicted_category, confidence, coalesce({_box_text("p")}, {_box_text("g")}) as bbox_xyxy, (printf('%.6f', iou)::double + 0) as iou, review_priority
 from matches join priority using (image_id, model_name) join img using (image_id) where match_type<>'true_positive'"""
)
def error_manifest(s: SparkSession, d: str) -> DataFrame:
    return review.error_manifest(_images(s, d), _matches(s, d), *fx.MODELS)


# revisions

_REV_EDGES = f"""select *, row_number() over (partition by image_id order by phase, old_ord, iou desc, new_ord) as rn from (
 select o.image_id, o.ann_ord as old_ord, n.ann_ord as new_ord, {_iou("o", "n")} as iou, unnest([1,2]) as phase, o.category=n.category as same
 from gt o join gt2 n using (image_id)) x where case phase when 1 then same and iou>=0.95 else iou>=0.5 end"""
_REVISION = f"""with recursive {_VIEWS}, img2 as ({fx.NEW_IMAGES}), gt2 as ({fx.NEW_GROUND_TRUTH}),
{_fold(_REV_EDGES, "image_id", "old_ord", "new_ord")},
pair as (select image_id, replace(file_name, regexp_extract(file_name,'_jpg[.]rf[.][^.]+[.]jpg$'), '.jpg') as stable_image_key, file_name as old_file_name, split as old_split from img),
both_ as (select image_id, stable_image_key, old_file_name, n.file_name as new_file_name, old_split, n.split as new_split from pair left join img2 n using (image_id)),
c as (
 select image_id, 'split_moved' as change_type, null as old_category, null as new_category, null::double as iou, null::double as ox1, null::double as oy1, null::double as ox2, null::double as oy2, null::double as nx1, null::double as ny1, null::double as nx2, null::double as ny2 from both_ where old_split<>new_split
 union all select k.image_id, case when o.category=n.category then 'bbox_adjusted' else 'relabeled' end, o.category, n.category, k.iou, o.x1 as ox1, o.y1 as oy1, o.x2 as ox2, o.y2 as oy2, n.x1 as nx1, n.y1 as ny1, n.x2 as nx2, n.y2 as ny2 from picks k
  join img2 using (image_id) join gt o on o.image_id=k.image_id and o.ann_ord=k.old_ord join gt2 n on n.image_id=k.image_id and n.ann_ord=k.new_ord where phase=2
 union all select o.image_id, 'annotation_removed', o.category, null, null, o.x1 as ox1, o.y1 as oy1, o.x2 as ox2, o.y2 as oy2, null::double as nx1, null::double as ny1, null::double as nx2, null::double as ny2 from gt o join img2 using (image_id) left join picks k on k.image_id=o.image_id and k.old_ord=o.ann_ord where k.rn is null
 union all select n.image_id, 'annotation_added', null, n.category, null, null::double as ox1, null::double as oy1, null::double as ox2, null::double as oy2, n.x1 as nx1, n.y1 as ny1, n.x2 as nx2, n.y2 as ny2 from gt2 n join img2 using (image_id) left join picks k on k.image_id=n.image_id and k.new_ord=n.ann_ord where k.rn is null
 union all select b.image_id, 'image_removed', o.category, null, null, o.x1 as ox1, o.y1 as oy1, o.x2 as ox2, o.y2 as oy2, null::double as nx1, null::double as ny1, null::double as nx2, null::double as ny2 from both_ b left join gt o using (image_id) where b.new_file_name is null),
changes as (select stable_image_key, old_file_name, new_file_name, old_split, new_split, change_type, old_category, new_category, (printf('%.6f', iou)::double + 0) as iou, ox1, oy1, ox2, oy2, nx1, ny1, nx2, ny2 from c join both_ using (image_id))
"""


def _changes(s: SparkSession, d: str) -> DataFrame:
    old = revision.revision_images(_images(s, d), _gt(s, d))
    new = revision.revision_images(fx.view(s, d, fx.NEW_IMAGES), fx.view(s, d, fx.NEW_GROUND_TRUTH))
    return revision.changes(old, new)


@query(_REVISION + "select * from changes")
def revision_changes(s: SparkSession, d: str) -> DataFrame:
    sides = {"o": "old_bbox_xyxy", "n": "new_bbox_xyxy"}
    out = _changes(s, d).withColumns(
        {f"{p}{c}": F.get(box, F.lit(k)) for p, box in sides.items() for k, c in enumerate(("x1", "y1", "x2", "y2"))}
    )
    return out.drop("old_bbox_xyxy", "new_bbox_xyxy")


@query(_REVISION + "select change_type, count(*) as n from changes group by all")
def revision_summary(s: SparkSession, d: str) -> DataFrame:
    return revision.summary(_changes(s, d))


@query(
    _REVISION
    + "select stable_image_key, old_split, new_split, old_file_name, new_file_name from both_ where new_file_name is null or old_split<>new_split"
)
def revision_image_diff(s: SparkSession, d: str) -> DataFrame:
    rows = _changes(s, d).where("change_type in ('image_removed', 'image_added', 'split_moved')")
    return rows.select("stable_image_key", "old_split", "new_split", "old_file_name", "new_file_name").distinct()


# export, media


def _export(s: SparkSession, d: str) -> DataFrame:
    detections = _pr(s, d).where("model_name = 'candidate'").withColumns(
        {"confidence_threshold": F.when(F.col("image_id") % 2 == 0, 0.3), "inference_floor": F.lit(0.05)}
    )
    return ds.export_manifest(_images(s, d), detections)


_EXPORT = f"""with {_VIEWS}, k as (select image_id, count(*) as n from pr0 where model_name='candidate' and confidence>=case when image_id%2=0 then 0.3::double else 0.05::double end group by all),
manifest as (select file_name, split_part(file_name,'_frame',1) as source_recording, coalesce(n,0) as detections, n is null as empty_label from img left join k using (image_id))
"""


@query(_EXPORT + "select * from manifest")
def export_manifest(s: SparkSession, d: str) -> DataFrame:
    return _export(s, d)


@query(_EXPORT + "select count(*) as images, sum(detections)::bigint as detections, count(*) filter (where empty_label) as empty_labels from manifest")
def export_totals(s: SparkSession, d: str) -> DataFrame:
    return ds.export_totals(_export(s, d))


_TIMES = f"{_VIEWS}, t as (select model_name, split, ((image_id*7919+det_pos)%1000)/10::double as ms from pr0 join img using (image_id))"


@query(
    f"""with {_TIMES} select model_name, split, count(ms) as images, round(avg(ms),6) as mean_ms, quantile_cont(ms,0.5) as median_ms, round(quantile_cont(ms,0.9),6) as p90_ms,
 min(ms) as min_ms, max(ms) as max_ms from t group by all"""
)
def latency_summary(s: SparkSession, d: str) -> DataFrame:
    ms = ((F.col("image_id") * 7919 + F.col("det_pos")) % 1000 / F.lit(10.0)).alias("ms")
    times = _pr(s, d).join(_images(s, d), "image_id").select("model_name", "split", ms)
    return ds.latency_summary(times, ["model_name", "split"]).withColumns(
        {"mean_ms": F.round("mean_ms", 6), "p90_ms": F.round("p90_ms", 6)}
    )


_PACKETS = f"{_VIEWS}, k as (select split_part(file_name,'_frame',1) as recording, image_id, image_id*1000000+(image_id%13)*40000 as t, image_id%5=1 as has_idr, image_id%15=1 as has_sps, image_id%5=0 as params_only from img)"


def _packets(s: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    return _images(s, d).select(
        F.substring_index("file_name", "_frame", 1).alias("recording"),
        "image_id",
        (i * 1000000 + (i % 13) * 40000).alias("t"),
        (i % 5 == 1).alias("has_idr"),
        (i % 15 == 1).alias("has_sps"),
        (i % 5 == 0).alias("params_only"),
    )


@query(
    f"""with {_PACKETS}, l as (select recording, t-lag(t) over (partition by recording order by image_id) as d from k)
select recording, coalesce(1e9/(median(d) filter (where d>0)), 30::double) as fps from l group by recording"""
)
def estimated_fps(s: SparkSession, d: str) -> DataFrame:
    return ds.estimated_fps(_packets(s, d), "recording", "t", ["image_id"])


@query(
    f"""with {_PACKETS}, s as (select k.recording, k.image_id, k.has_sps from k where k.has_idr and (k.has_sps or exists
  (select 1 from k q where q.recording=k.recording and q.image_id<k.image_id and q.params_only))),
 f as (select recording, min(image_id) as first_id, arg_min(has_sps, image_id) as own from s group by recording)
select recording, image_id, image_id < first_id as in_front from k join f using (recording)
 where image_id >= first_id or (params_only and not own)"""
)
def gop_gate(s: SparkSession, d: str) -> DataFrame:
    return ds.gop_gate(_packets(s, d), "recording", ["image_id"]).select("recording", "image_id", "in_front")


# records, label files and rules of sources and sinks


@query(f"with {_VIEWS} select annotation_id, x1, y1, x2, y2 from gt")
def boxes_from_xywh(s: SparkSession, d: str) -> DataFrame:
    x, y, w, h = xyxy_to_xywh(corners())
    sides = _gt(s, d).select("annotation_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    box = xywh_to_xyxy(*(F.col(c) for c in "xywh"))
    return sides.select("annotation_id", *[b.alias(c) for b, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])


@query(f"with {_VIEWS} select image_id, case when image_id%3=0 then image_id/8::double else image_id::double+(image_id%7)*1000/1e9 end as seconds from img")
def message_times(s: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    own = lambda c: F.when(i % 3 != 0, c).otherwise(0)
    return _images(s, d).select("image_id", message_seconds(own(i), own(i % 7 * 1000), i * 125000000).alias("seconds"))


@query(
    f"""with {_VIEWS} select file_name, model_name, row_number() over (partition by model_name, image_id order by det_pos)-1 as det_pos,
 category, confidence, x1, y1, x2, y2 from pr0 join img using (image_id)"""
)
def detection_records(s: SparkSession, d: str) -> DataFrame:
    """Detections written as JSON records, one for each image and model, and read back."""
    one = F.struct("det_pos", "category", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"))
    rows = _pr(s, d).join(_images(s, d).select("image_id", "file_name"), "image_id")
    rows = rows.groupBy("file_name", "model_name").agg(F.array_sort(F.collect_list(one)).alias("detections"))
    text = rows.select(F.to_json(F.struct("file_name", "model_name", "detections")).alias("line"))
    records = text.select(F.from_json("line", files.PREDICTION, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return files.exploded_detections(records).select("file_name", "model_name", F.col("det_pos").cast("long").alias("det_pos"), "category", "confidence", "x1", "y1", "x2", "y2")


@query(
    f"""with {_VIEWS}, a as (select image_id, ann_ord, category, (printf('%.6f', (x1+x2)/2/640)::double + 0) as cx, (printf('%.6f', (y1+y2)/2/480)::double + 0) as cy,
 (printf('%.6f', (x2-x1)/640)::double + 0) as w, (printf('%.6f', (y2-y1)/480)::double + 0) as h from gt),
 l as (select image_id, count(*) as n, string_agg(printf('%d %.6f %.6f %.6f %.6f', case when category='left_hand' then 0 else 1 end, cx, cy,
 {_AXIS.format(c="cx", s="w")}, {_AXIS.format(c="cy", s="h")}) || chr(10), '' order by ann_ord) as label from a group by image_id)
select file_name, coalesce(label, '') as label, coalesce(n, 0)::int as detections from img left join l using (image_id)"""
)
def label_files(s: SparkSession, d: str) -> DataFrame:
    """The text of each image's label file, empty for an image without boxes."""
    lines = ds.yolo_lines(_gt(s, d), _images(s, d)).select("file_name", F.col("ann_ord").cast("int").alias("det_pos"), "line")
    empty = validate.negative_images(_images(s, d), _gt(s, d)).select("file_name", F.lit(None).cast("int").alias("det_pos"), F.lit("").alias("line"))
    return sinks.label_texts(lines.unionByName(empty))


@query(
    f"""with {_VIEWS}, f as (select case when image_id%50=1 then 'same.jpg' else file_name end as file_name, case when image_id%40=2 then 0 else width end as width, image_id from img)
select distinct file_name, 'repeated name' as reason from f where file_name='same.jpg'
union all select file_name, 'no size' from f where width<=0
union all select file_name, 'no image' from f where image_id%30=3 and file_name<>'same.jpg'"""
)
def frame_violations(s: SparkSession, d: str) -> DataFrame:
    i = F.col("image_id")
    frames = _images(s, d).withColumn("file_name", F.when(i % 50 == 1, "same.jpg").otherwise(F.col("file_name")))
    listed = frames.where((i % 30 != 3) | (F.col("file_name") == "same.jpg")).select(F.concat(F.lit("frames/"), "file_name").alias("path"))
    frames = frames.withColumn("width", F.when(i % 40 == 2, 0).otherwise(F.col("width")))
    return validate.frame_violations(frames, listed)


@query(f"with {_VIEWS} select image_id, file_name, image_id%3=0 as known from img")
def incremental_records(s: SparkSession, d: str) -> DataFrame:
    """A second run over all images keeps the records of the first, and adds those of images that it hadn't."""
    rows = _images(s, d).select("image_id", "file_name")
    return ds.upsert(rows.where("image_id % 3 = 0").withColumn("known", F.lit(True)), rows.withColumn("known", F.lit(False)), "image_id")


@query(f"with {_VIEWS} select image_id, arg_min(annotation_id, ann_ord) as annotation_id from gt where category='right_hand' group by image_id")
def first_of_image(s: SparkSession, d: str) -> DataFrame:
    return ds.first_by(_gt(s, d).where("category = 'right_hand'"), ["image_id"], ["ann_ord"]).select("image_id", "annotation_id")


@query(f"with {_VIEWS} select split_part(file_name,'_frame',1) as base from img where image_id%4<>0 group by 1 having split_part(base,'rec',2)::int%3=0")
def missing_provenance(s: SparkSession, d: str) -> DataFrame:
    base = F.substring_index("file_name", "_frame", 1)
    names = _images(s, d).where("image_id % 4 <> 0").select(base.alias("base")).distinct()
    known = names.where(F.substring("base", 4, 9).cast("int") % 3 != 0).select(F.concat(F.lit("b/"), "base").alias("output_video_path"))
    return validate.missing_provenance(names.select(F.concat(F.lit("a/"), "base").alias("path")), known).select("base")


# files: written, read back, removed


def _through(s: SparkSession, name: str, write: Callable[[str], object], read: Callable[[str], DataFrame], to: str | None = None) -> DataFrame:
    """What `read` finds in the folder in which `write` has written, which is then removed. to: a table that it is added to."""
    folder = f"{shared_folder(s)}/boxwright-{name}-{uuid.uuid4().hex}"
    write(folder)
    found = stored(read(folder), to)
    where = s.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return found


@query(
    f"""with {_VIEWS} select row_number() over (order by annotation_id)-1 as place, annotation_id, image_id, file_name, category, x1 as x, y1 as y,
 x2-x1 as w, y2-y1 as h, (x2-x1)*(y2-y1) as area from gt join img using (image_id)"""
)
def coco_document(s: SparkSession, d: str) -> DataFrame:
    """The ground truth as one COCO document, read by ranges of its bytes."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    number = F.when(F.col("category") == "left_hand", 1).otherwise(2).alias("category_id")
    boxes = _gt(s, d).select(F.col("annotation_id").alias("id"), "image_id", number, F.array("x1", "y1", wide, high).alias("bbox"), (wide * high).alias("area"), F.lit(0).alias("iscrowd"))
    named = [(1, "left_hand"), (2, "right_hand")]
    images = _images(s, d).select(F.col("image_id").alias("id"), "file_name", "width", "height")

    def read(folder: str) -> DataFrame:
        i, a, _ = files.read_coco(s, folder, "train")
        rows = a.join(i.select("image_id", "file_name"), "image_id")
        return rows.select(F.col("ann_ord").cast("long").alias("place"), "annotation_id", "image_id", "file_name", "category", "x", "y", "w", "h", "area")

    return _through(s, "coco", lambda f: sinks.write_coco_file(images, boxes, named, f"{f}/train/_annotations.coco.json"), read)


@query(f"with {_VIEWS} select model_name, image_id, det_pos, category, confidence, x1, confidence*x1/3 as third, confidence>0.5 as sure from pr0")
def csv_report(s: SparkSession, d: str) -> DataFrame:
    """Predictions as one CSV file in order, read back."""
    rows = _pr(s, d).select("model_name", "image_id", "det_pos", "category", "confidence", "x1", (F.col("confidence") * F.col("x1") / 3).alias("third"), (F.col("confidence") > 0.5).alias("sure"))
    kinds = "model_name string, image_id bigint, det_pos bigint, category string, confidence double, x1 double, third double, sure boolean"
    read = lambda f: s.read.schema(kinds).option("mode", "FAILFAST").csv(f"{f}/report.csv", header=True)
    return _through(s, "csv", lambda f: sinks.write_csv_file([rows], f"{f}/report.csv", "model_name", "image_id", "det_pos"), read)


@query(
    f"""with {_VIEWS} select file_name, model_name, count(*) as n, max(confidence) as confidence, min(x1) as x1
 from pr0 join img using (image_id) group by file_name, model_name"""
)
def prediction_file(s: SparkSession, d: str) -> DataFrame:
    """Prediction records as one file of JSON lines in order, read back, and summed up by record."""
    one = F.struct("det_pos", "category", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"))
    rows = _pr(s, d).join(_images(s, d).select("image_id", "file_name"), "image_id")
    # a file's name has its image's id: by both, the detections of an image are where the join has put them
    records = rows.groupBy("image_id", "file_name", "model_name").agg(F.array_sort(F.collect_list(one)).alias("detections")).drop("image_id")

    def read(folder: str) -> DataFrame:
        found = files.exploded_detections(files.read_jsonl(s, f"{folder}/predictions.jsonl", files.PREDICTION))
        return found.groupBy("file_name", "model_name").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min("x1").alias("x1"))

    return _through(s, "jsonl", lambda f: sinks.write_jsonl_file(records, f"{f}/predictions.jsonl", "file_name", "model_name"), read)


@query(ORACLE_SQL["label_files"])
def label_folder(s: SparkSession, d: str) -> DataFrame:
    """Folders with a label file for each image (without the images), read back with their manifests.

    A label file takes a block of the file system, 4 KB as a rule, and so 20 to 30 times as much as its text. So a folder has about _FOLDER
    images, and the next one is written when it has been read and removed. Images whose label files would have one name are in one folder.
    """
    lines = ds.yolo_lines(_gt(s, d), _images(s, d))
    line = F.struct(F.col("ann_ord").cast("int").alias("det_pos"), "line")
    texts = lines.groupBy("image_id", "file_name").agg(F.collect_list(line).alias("lines")).select("file_name", "lines")
    none = F.array().cast(dict(texts.dtypes)["lines"]).alias("lines")
    texts = texts.unionByName(validate.negative_images(_images(s, d), _gt(s, d)).select("file_name", none))
    n = max(1, -(-_images(s, d).count() // _FOLDER))
    stem = F.regexp_replace("file_name", r"(?s)^(.+)\.[^.]+$", "$1")
    texts = texts.withColumn("folder", F.pmod(F.xxhash64(stem), F.lit(n)))
    # in order, so that a folder's rows are found without reading the others'
    texts = stored(texts.repartition("folder").sortWithinPartitions("folder"))
    place = table_path(s)
    for k in range(n):
        mine = texts.where(F.col("folder") == k)
        each = mine.select("file_name", F.explode_outer("lines").alias("l")).select("file_name", "l.*")
        write = lambda f: sinks.export_yolo(each, mine.select("file_name"), None, f, ("left_hand", "right_hand"))  # noqa: B023, E731
        found = _through(s, "labels", write, lambda f: files.read_label_folder(s, f), place)
    drop_stored(texts)
    return s.read.schema(found.schema).parquet(place)
