"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5
from .bpe import op1
from .jaccard import op10
from .language import op6
from .linededup import op4
from .packing import op2
from .quality import op9
from .substrings import op7
from .topk import op8
from .toxicity import op3


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1, "op2_packing": op2, "op3_toxicity": op3, "op4_linededup": op4, "op5_ann": op5, "op6_language": op6, "op7_suffix": op7, "op8_topk": op8, "op9_quality": op9, "op10_jaccard": op10}


OP8 = """
with u as (
  select vec_id, min(list_transform(embedding, lambda x: cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id
), e as (select vec_id, list_transform(v, lambda x: cast(floor(256 * x) as bigint)) as v from u
), p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as s
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as n from p)
select query_id, cast(n as int) as rank, vec_id, cast(s as bigint) as score from r where n <= 5
"""

OP10 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), d as (
  select distinct doc_id, unnest(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from w
), n as (select doc_id, count(*) as n from d group by doc_id
), o as (select a.doc_id as x, b.doc_id as y, count(*) as o from d a join d b on a.g = b.g and a.doc_id <> b.doc_id group by all
), l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)
), r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, l.y from r join l on r.reach = l.x)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8, "op10_jaccard": OP10}
