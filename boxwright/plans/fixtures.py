"""Images, ground truth and two models' predictions derived from the star-schema tables.

The SQL runs alike in Spark and DuckDB; {orders} and {lineitem} stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODELS = ("baseline", "candidate")

IMAGES = """select o_orderkey as image_id,
 printf('rec%05d_frame%06d_%010dms_jpg.rf.h%d.jpg', o_custkey, o_orderkey, o_orderkey*1000, o_orderkey%97) as file_name,
 case when o_custkey%10=0 then 'test' when o_custkey%10=1 then 'valid' else 'train' end as split,
 640 as width, 480 as height from {orders}"""

_BASE = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_linestatus,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord,
 cast(24*(l_partkey%5) as double) as x, cast(16*(l_suppkey%4) as double) as y,
 cast(60+l_suppkey%20 as double) as w, cast(50+l_partkey%30 as double) as h from {lineitem}"""

GROUND_TRUTH = f"""select l_orderkey as image_id, ord as ann_ord, l_orderkey*100+ord as annotation_id,
 case when l_linestatus='F' then 'left_hand' else 'right_hand' end as category, x as x1, y as y1, x+w as x2, y+h as y2
 from ({_BASE}) base where cast(round(l_tax*100) as int) <> 8"""

PREDICTIONS = f"""select m.model_name, l_orderkey as image_id, ord as det_pos,
 case when (l_linestatus='F') = (l_partkey % m.flip <> 0) then 'left_hand' else 'right_hand' end as category,
 case when cast(round(l_discount*100) as int) <= m.clutter then cast(l_quantity as double)/cast(125 as double)
      else cast(l_quantity+25 as double)/cast(100 as double) end as confidence,
 x+dx as x1, y+dy as y1, x+w+dx as x2, y+h+dy as y2
 from (select base.*, m.*,
   m.jit*l_linenumber + case when cast(round(l_discount*100) as int) <= m.clutter then 300 else 0 end as dx,
   2*m.jit*l_linenumber as dy
   from ({_BASE}) base cross join (select 'baseline' as model_name, 5 as flip, 2 as jit, 5 as clutter
     union all select 'candidate', 11, 1, 3) m
   where cast(round(l_discount*100) as int) <> 0) m"""

#: A second revision: some boxes moved, relabelled, left out or added, some images moved to another split or renamed.
NEW_IMAGES = f"""select image_id, replace(file_name, '_jpg.rf.h', '_jpg.rf.n') as file_name,
 case when image_id % 50 = 7 then 'train' else split end as split, width, height
 from ({IMAGES}) i where image_id % 40 <> 3"""

NEW_GROUND_TRUTH = f"""select image_id, ann_ord, annotation_id,
 case when annotation_id % 17 = 5 then 'left_hand' else category end as category,
 x1 + d as x1, y1, x2 + d as x2, y2
 from (select *, case when annotation_id % 7 = 2 then 4 when annotation_id % 19 = 4 then 200 else 0 end as d
   from ({GROUND_TRUTH}) g where annotation_id % 23 <> 6) g"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows over the tables in sf_dir."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "events") if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The same text for an engine where the tables are known by name."""
    for n in ("orders", "lineitem", "events"):
        sql = sql.replace(f"{{{n}}}", n)
    return sql
