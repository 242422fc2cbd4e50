"""The queries of the subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, licenses, lloyd, minhash, mixing, mtree, pii, quality, substrings, toxicity, vectors

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.best(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(table(spark, sf_dir, "embeddings"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), **alignment.public_files())


@query
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(turns.unionByName(more))


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL["op2_mixing"] = f"""with d as (select doc_id, source, coalesce(len({WORDS.format("text")}), 0) as size, substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 16) as mark from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as i from d group by source),
w as (select *, 1.0::double + i as weight, (i - 1) * 0.5::double as tilt, 3 * source_size as ceiling from s),
o as (select *, row_number() over r as nth, sum(source_size) over () as total, coalesce(sum(ceiling) over (r rows between unbounded preceding and 1 preceding), 0) as fixed,
 sum(weight) over (r rows between current row and unbounded following) as open from w window r as (order by ceiling / weight, source nulls last)),
l as (select *, cast(total - fixed as double) / open as level, cast(total - fixed as double) / open * weight >= ceiling as capped from o),
t as (select source, source_size, tilt, case when capped then cast(ceiling as double) else (select arg_min(level, nth) from l where not capped) * weight end as target from l),
q as (select source, source_size, tilt, target, cast(round(target) as bigint) as quota, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as passes from t),
b as (select doc_id, size, source_size, target, tilt, quota, passes, quota - passes * source_size as rest,
 cast(coalesce(sum(size) over (partition by d.source order by mark, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as begin from d join q on d.source is not distinct from q.source),
c as (select *, greatest(0, least(size, rest - begin)) as last from b),
e as (select *, passes * size + last as taken, case when size > 0 then passes + cast(last > 0 as bigint) else 0 end as copies, least(1.0::double, cast(begin as double) / cast(quota as double)) as x, 1 - tilt as f from c)
select doc_id, cast(size as bigint) as size, source_size, target, cast(taken as bigint) as taken, cast(copies as bigint) as copies,
 case when copies = 0 then 1 + coalesce(cast(begin as double) / nullif(source_size, 0), 0.0::double) when tilt = 0 or x = 0 then x else (sqrt(f * f + 4 * tilt * x) - f) / (2 * tilt) end as position from e"""

REACHED = """r as (select id, id as other from n union select r.id, l.b from r join l on r.other = l.a),
k as (select id, min(other) as component_id from r group by id)"""

SQL["op6_vectors"] = f"""with recursive n as (select vec_id as id, embedding::double[] as v from embeddings),
g as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from n where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
l as (select x.id as a, y.id as b from g x join g y on x.id <> y.id and len(x.v) = len(y.v) where x.size > 0 and y.size > 0 and list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.9),
c as (select a as id, count(*) as n_links from l group by a),
{REACHED} select n.id as vec_id, coalesce(n_links, 0) as n_links, component_id, n.id = component_id as kept from n join k on n.id = k.id left join c on n.id = c.id"""

SQL["op7_minhash"] = f"""with recursive w as materialized (select doc_id as id, coalesce({WORDS.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}, []) as w from documents),
s as materialized (select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w),
n as materialized (select w.id, count(s.id) as n from w left join s on w.id = s.id group by w.id),
p as (select x.id as a, y.id as b, count(*) as common from s x join s y on x.s = y.s and x.id <> y.id group by all),
l as materialized (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * common >= 85 * (x.n + y.n - common)),
{REACHED} select n.id as doc_id, n as n_shingles, component_id, n.id = component_id as kept from n join k on n.id = k.id"""

SQL["op10_mtree"] = """with g as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_inner_product(q.v, c.v) desc, c.vec_id) as integer) as rank, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
from g q join g c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0 qualify rank <= 5"""


_ROUND = """a{0} as materialized (select i, any_value(v) as v, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w), 'c': c}}) as b from e, c{0} group by i),
n{0} as (select c, list(x order by k) as u from (select c, k, floor(sum(x) / count(*)) as x from (select b.c as c, unnest(v) as x, generate_subscripts(v, 1) as k from a{0}) group by c, k) group by c),
c{1} as materialized (select c{0}.c, coalesce(u, w) as w from c{0} left join n{0} on c{0}.c = n{0}.c),
"""

SQL["op11_lloyd"] = f"""with e as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h nulls last, v) - 1 as c, v as w from (select sha256('2:' || vec_id) as h, v from e order by h nulls last, v limit 40)),
{"".join(_ROUND.format(i, i + 1) for i in range(lloyd.ROUNDS))}f as (select i, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w), 'c': c}}) as b from e, c{lloyd.ROUNDS} group by i),
g as (select vec_id, b.c as c, cast(b.d as bigint) as distance from f join e on e.i = f.i)
select vec_id, cast(g.c as integer) as cluster, distance, cast(sum(distance) over (partition by g.c) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
 sha256(array_to_string(list_transform(w, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256 from g join c{lloyd.ROUNDS} k on g.c = k.c"""

_ESCAPED = r"replace(replace(replace({}, '\', '\-'), '##', '#\#'), '</turn>', '<\/turn>')"
_BUDGET, _HISTORY, _CELL = chat.BUDGET, chat.HISTORY, max(chat.CELL, 4 * chat.BUDGET)

SQL["op13_chat"] = rf"""with recursive i as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations
 union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
r as (select *, coalesce(conv_id::varchar, '-') as k, row_number() over w - 1 as pos, len({WORDS.format("text")}) + {chat.MARKS} as tokens,
 len('### ' || replace({_ESCAPED.format("role")}, chr(10), '\+') || chr(10) || {_ESCAPED.format("text")} || chr(10) || '</turn>' || chr(10)) as chars from i window w as (partition by conv_id order by turn nulls first, md5(role || chr(10) || text))),
p as materialized (select *, cast(sum(tokens) over (partition by k order by pos) - tokens as bigint) as b, b // {_CELL} as cell from r),
s as (select k, tokens as s_tokens from p where pos = 0 and role = 'system'),
g as materialized (select p.*, greatest({_BUDGET // 4}, {_BUDGET - _HISTORY} - coalesce(s_tokens, 0)) as room from p left join s on p.k = s.k),
f as (select k, pos, cell, b + room as last, pos as first from g where pos = 0
 union all select g.k, g.pos, g.cell, case when g.cell <> f.cell or g.b + g.tokens > f.last then g.b + g.room else f.last end, case when g.cell <> f.cell or g.b + g.tokens > f.last then g.pos else f.first end from f join g on g.k = f.k and g.pos = f.pos + 1),
w as (select distinct k, first from f),
h as (select w.k, w.first, sum(o.chars) as again from w join g on g.k = w.k and g.pos = w.first join g o on o.k = w.k and o.pos < w.first and (o.b >= g.b - {_HISTORY} or (o.pos = 0 and o.role = 'system')) group by all),
x as (select w.k, count(*) as n_windows, coalesce(sum(again), 0) as again from w left join h on w.k = h.k and w.first = h.first group by w.k),
d as (select k, any_value(conv_id) as conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by pos) as told, coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') as learned, sum(chars) as chars from p group by k)
select conv_id, n_turns, sha256(told) as turns_sha256, len(learned) as loss_chars, sha256(learned) as loss_sha256, cast(chars + again as bigint) as formatted_chars, n_windows from d join x on d.k = x.k"""
