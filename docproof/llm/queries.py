"""One query per operator over its whole table, with production parameters, and SQL where it can be said."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docproof.llm.bpe import digests
from docproof.llm.clusters import cluster
from docproof.llm.cotraining import classify
from docproof.llm.embedding_dedup import near_vectors
from docproof.llm.hard_negatives import hard_negatives
from docproof.llm.html_text import extract_text
from docproof.llm.kneser_ney import score_held_out
from docproof.llm.minhash import near_duplicates
from docproof.llm.packing import placed
from docproof.llm.raking import AXES, BRIEF_TOKENS, KEEP, TEMPER, TOPIC_MARKS, mixture
from docproof.llm.sharding import shards
from docproof.llm.token_counts import token_counts
from docproof.llm.top_products import top_products


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


def op7_html_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op5_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), 24)


def op9_mixture_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), "vec_id % 100 = 0", positives=5, negatives=10, low=30, high=90)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"), vocabulary(), most=2048, end=0)


def op13_heap_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed=1)


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op4_top_k_search": op4_top_k_search,
    "op5_jump_hash_sharding": op5_jump_hash_sharding,
    "op6_kneser_ney_scoring": op6_kneser_ney_scoring,
    "op7_html_template_removal": op7_html_template_removal,
    "op8_quality_co_training": op8_quality_co_training,
    "op9_mixture_raking": op9_mixture_raking,
    "op10_token_counts": op10_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_heap_clustering": op13_heap_clustering,
}


def _raking_sql(rounds: int = 100) -> str:
    """The mixture in SQL: one recursion step rakes one axis, in turn."""
    marks = " ".join(
        f"when {' or '.join(f'contains(text, $${m}$$)' for m in marks)} then '{topic}'" for topic, marks in TOPIC_MARKS.items()
    )
    goals = ", ".join(f"g_{a}.share * (select sum(tokens) from cells) as goal_{a}" for a in AXES)
    shares = ", ".join(
        f"g_{a} as (select {a}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) over () as share from cells group by {a})"
        for a in AXES
    )
    joins = " ".join(f"join g_{a} on cells.{a} is not distinct from g_{a}.{a}" for a in AXES)
    turn = " ".join(f"when {i} then goal_{a} / nullif(sum(w) over (partition by {a}), 0)" for i, a in enumerate(AXES))
    same = " and ".join(f"d.{a} is not distinct from c.{a}" for a in AXES)
    cell = ", ".join(f"cells.{a}" for a in AXES)
    names = ", ".join(AXES)
    return rf"""
with recursive measured as (
  select doc_id, source, lang, text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens from documents
), placed as (
  select doc_id, source, lang, tokens,
    case {marks} when tokens < {BRIEF_TOKENS} then 'brief' else 'prose' end as topic from measured
), cells as (
  select {names}, sum(tokens)::bigint as tokens from placed group by all
), {shares}, raked as (
  select 0 as step, {cell}, cells.tokens, cells.tokens::double as w, {goals} from cells {joins}
  union all
  select step + 1, {names}, tokens, coalesce(w * case step % 3 {turn} end, 0), {", ".join(f"goal_{a}" for a in AXES)}
  from raked where step < {3 * rounds}
), ratios as (
  select {names}, case when tokens > 0 then w / tokens else 0 end as ratio from raked where step = {3 * rounds}
), chances as (
  select {names}, least(1.0, round(ratio * {KEEP}, 9)) as probability from ratios
)
select d.doc_id, d.source, d.lang, d.topic, d.tokens, round(probability, 6) as probability,
  ('0x' || substr(md5(d.doc_id::varchar), 1, 8))::bigint / 4294967296.0 < probability as kept
from placed d join chances c on {same}
"""


def _clustering_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Clustering in SQL: each round measures every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"

    def nearest(turn):
        return f"""a{turn} as (
  select rid, vec_id, v, cluster, distance from (
    select v.rid, v.vec_id, v.v, c.cluster, {square} as distance from kept v cross join c{turn} c
  ) qualify row_number() over (partition by rid order by distance, cluster) = 1
)"""

    def moved(turn):
        return f"""m{turn + 1} as (
  select cluster, i, floor_div(sum(v[i]), count(*)) as x from a{turn}, range(1, {dims + 1}) r(i) group by cluster, i
), c{turn + 1} as (
  select c.cluster, coalesce(n.v, c.v) as v from c{turn} c
  left join (select cluster, list(x::bigint order by i) as v from m{turn + 1} group by cluster) n on c.cluster = n.cluster
)"""

    steps = ", ".join(f"{nearest(t)}, {moved(t)}" for t in range(rounds))
    text = "array_to_string(list_transform(c.v, lambda x: x::varchar), ',')"
    return f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, v) - 1 as cluster, v from kept
  qualify cluster < {k}
), {steps}, {nearest(rounds)}, totals as (
  select cluster, sum(distance)::bigint as cluster_inertia from a{rounds} group by cluster
)
select a.vec_id, a.cluster::int as cluster, a.distance, t.cluster_inertia,
  (select sum(distance) from a{rounds})::bigint as inertia, sha256({text}) as centroid_sha256
from a{rounds} a join totals t using (cluster) join c{rounds} c using (cluster)
""".replace("floor_div(sum(v[i]), count(*))", "((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))")


# The two alphabets between which only A-Z are lower-cased.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_embedding_near_dedup": """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a as vec_id, min(b) as component_id from reach group by a
), counts as (
  select a as vec_id, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l using (vec_id) left join counts c using (vec_id)
""",
    "op3_minhash_near_dedup": rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[]
    when len(w) = 1 then w
    else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1]) end) as s from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
  where 100 * k >= 80 * (x.n + y.n - k)
), both_ways as (
  select a, b from links union select b, a from links
), reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join both_ways l on r.b = l.a
), least as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d join least l using (doc_id) left join sizes s using (doc_id)
""",
    "op4_top_k_search": """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
""",
    "op9_mixture_raking": _raking_sql(),
    "op11_hard_negatives": """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint)::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score
  from good a join good c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
""",
    "op13_heap_clustering": _clustering_sql(),
}
