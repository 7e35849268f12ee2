"""Queries of mining with both lists, of the gate, of answers in one call, and of gold and synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import answers as A
from lexspark.operators import evaluation as E
from lexspark.operators import goldset as G
from lexspark.operators import mining
from lexspark.operators import ranking as R
from lexspark.operators.pipeline import Pipeline
from lexspark.operators.search import Retriever
from lexspark.plans import retrieval
from lexspark.plans.registry import CORPUS, INDEXING_TEXT, QUESTIONS, query, sql_bm25, sql_dense, sql_tokens
from lexspark.session import stored, table

_BOTH = f"""
    with {CORPUS}, {retrieval._TRAIN}, {sql_bm25(INDEXING_TEXT, 'b_', 50)}, {sql_dense(INDEXING_TEXT)},
    positive as (select query_id, question, source_doc_id as doc_id, kanun_short from questions q join corpus c on c.doc_id = q.source_doc_id)
"""


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Training questions of the stated query set with their article, the corpus, and the 50 best by BM25
    and by vectors."""
    corpus = stored(retrieval.articles(spark, folder))
    asked = table(spark, folder, "synthetic_qa").where(F.col("qa_id") % retrieval.QUERY_EVERY == 0).select(F.col("qa_id").alias("query_id"), "question", F.col("source_doc_id").alias("doc_id"))
    retriever, queries = Retriever.build(corpus), asked.select("query_id", "question")
    lists = [stored(retriever.rank(queries, 50, mode)) for mode in ("bm25", "dense")]
    return mining.positives(asked, corpus)[0], corpus, *lists


@query(f"""
    {_BOTH}, m as (select 'b' as l, * from b_ranked union all select 'd', * from d_ranked),
    n as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-9 then 1.0 else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end as s from m window w as (partition by l, query_id)),
    s as (select query_id, doc_id, 0.5 * sum(s) as score from n group by 1, 2),
    x as (select s.query_id, s.doc_id, round(score * case when c.kanun_short = p.kanun_short then 1.2 else 1.0 end, 6) as score from s join positive p using (query_id) join corpus c on c.doc_id = s.doc_id where s.doc_id <> p.doc_id),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from x)
    select query_id, doc_id, place, false as is_padding from r where place <= 7
""")
def hybrid_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The best of both lists together, articles of the positive's law counting more."""
    positive, corpus, sparse, dense = _both(spark, folder)
    ranked = mining.hybrid_ranking(sparse, dense, positive, corpus)
    found = mining.padded(mining.from_ranking(ranked, positive, 7), positive, corpus, 7)
    return found.withColumn("place", F.col("place").cast("bigint"))


@query(f"""
    {_BOTH} select p.query_id, p.doc_id, b.rank as rank_bm25, d.rank as rank_dense, least(b.rank, d.rank) as rank
    from positive p left join b_ranked b on b.query_id = p.query_id and b.doc_id = p.doc_id left join d_ranked d on d.query_id = p.query_id and d.doc_id = p.doc_id
""")
def hybrid_positive_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Where each list has the positive, and the better of the two."""
    positive, _, sparse, dense = _both(spark, folder)
    ranks = mining.positive_ranks({"bm25": sparse, "dense": dense}, positive)
    return ranks.withColumns({c: F.col(c).cast("bigint") for c in ("rank_bm25", "rank_dense", "rank")})


_POOLS = f"""
    {retrieval._MINE}, every as (select distinct doc_id from (select doc_id from positive union all select doc_id from negatives)),
    placed as (select doc_id, row_number() over (order by md5('42:' || doc_id)) as rn, count(*) over () as size from every),
    tries as (select p.query_id, p.doc_id as positive_id, unnest(range(43)) as draw from positive p),
    taken as (select query_id, doc_id, row_number() over (partition by query_id order by draw) as n from tries join placed
        on draw < size and rn = (('0x' || substr(md5('42:' || query_id), 1, 8))::bigint + draw) % size + 1 where doc_id <> positive_id),
    pools as (select query_id, doc_id, true as relevant from positive union all
        select query_id, doc_id, false from (select query_id, doc_id from taken where n <= 42 union select query_id, doc_id from negatives) where (query_id, doc_id) not in (select (query_id, doc_id) from positive)),
    judged as (select query_id, doc_id, relevant, round(coalesce(len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('metin')}))) / nullif(len(list_distinct({sql_tokens('question')})), 0), 0.0), 6) as score
        from pools join questions using (query_id) join corpus using (doc_id)),
    ranks as (select relevant, row_number() over (partition by query_id order by score desc, doc_id) as rank from judged)
"""


def _scored_pools(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, doc_id, relevant, score): every question's pool as the stand-in reranker scores it."""
    positive, corpus, ranked = retrieval._positives(spark, folder)
    negatives = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    pools = mining.gate_pools(positive, stored(negatives))
    texts = pools.join(positive.select("query_id", "question"), "query_id").join(corpus.select("doc_id", "metin"), "doc_id")
    return texts.select("query_id", "doc_id", "relevant", A.overlap_score(F.col("question"), F.col("metin")).alias("score"))


@query(f"""{_POOLS} select {", ".join(f"round(avg((rank <= {k})::int), 6) as r_{k}" for k in (1, 5, 10))}, round(avg(1.0::double / rank), 6) as mrr, round(avg(rank), 6) as mean_rank from ranks where relevant""")
def rerank_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Where the stand-in reranker places each positive among its negatives and the distractors."""
    hits = _scored_pools(spark, folder).withColumnRenamed("score", "s")
    ranked = A.rerank(hits, lambda _, s: s, mining.DISTRACTORS + 9, "s", "s", ("doc_id",))
    return E.gate(ranked.where("relevant").select((F.col("rank") + 1).alias("rank")))


@query(f"""
    {_POOLS}, h as (select score as t, count(*) filter (relevant) as p, count(*) filter (not relevant) as q from judged group by 1),
    c as (select t, p, sum(p) over o as tp, sum(q) over o as fp, sum(p) over () as np, sum(q) over () as nq from h window o as (order by t desc rows unbounded preceding)),
    m as (select t, (tp + nq - fp)::double / (np + nq) as accuracy, tp::double / (tp + fp) as precision, tp::double / np as recall, 2.0::double * tp / (tp + fp + np) as f1, tp::double / (tp + fp) * p / np as gain from c),
    a as (select accuracy, t from m order by round(accuracy, 9) desc, t desc limit 1), b as (select f1, t, precision, recall from m order by round(f1, 9) desc, t desc limit 1)
    select round(a.accuracy, 6) as accuracy, round(a.t, 6) as accuracy_threshold, round(b.f1, 6) as f1, round(b.t, 6) as f1_threshold, round(b.precision, 6) as precision, round(b.recall, 6) as recall, round((select sum(gain) from m), 6) as average_precision from a, b
""")
def rerank_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """The thresholds at which the stand-in reranker tells positives from the rest best."""
    return E.threshold_metrics(_scored_pools(spark, folder))


@query(f"{retrieval._MINE}, l as (select query_id, 1 + count(*) as n from negatives group by 1) select count(*) as queries, min(n) as candidates from l")
def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    positive, corpus, ranked = retrieval._positives(spark, folder)
    negatives = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    return mining.candidate_count(mining.listwise(mining.triplets(positive.drop("kanun_short"), negatives, corpus)))


@query("select qa_id, case when row_number() over (order by md5('42:' || qa_id)) <= ceil(0.05::double * count(*) over ()) then 'test' else 'train' end as split from synthetic_qa")
def share_split(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_split(table(spark, folder, "synthetic_qa").select("qa_id"), F.col("qa_id"))


_CTX_BLOCK = "'[' || coalesce(kanun_short, '') || ' m.' || coalesce(madde_no, '') || ']' || case when baslik <> '' then ' (' || baslik || ')' else '' end || chr(10) || coalesce(metin, '')"


@query(f"""
    with {CORPUS}, {QUESTIONS}, {sql_bm25(INDEXING_TEXT, k=5)},
    b as (select query_id, rank, doc_id, {_CTX_BLOCK} as block from ranked join corpus using (doc_id)),
    c as (select *, sum(length(block) + 2) over (partition by query_id order by rank, doc_id rows unbounded preceding) - 2 <= 6000 as fits from b),
    ctx as (select query_id, coalesce(string_agg(block, chr(10) || chr(10) order by rank, doc_id) filter (fits), '') as context, string_agg(doc_id, ',' order by rank) as sources from c group by 1),
    p as (select query_id, question, coalesce(context, '') as context, coalesce(sources, '') as sources, 'Soru: ' || coalesce(question, '') || chr(10) || chr(10) || 'Kaynak Maddeler:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Cevap:' as prompt from questions left join ctx using (query_id)),
    s as (select *, string_split(substr(prompt, greatest(instr(prompt, 'Kaynak Maddeler:'), 1)), chr(10) || chr(10)) as parts from p)
    select query_id, question, '(DUMMY) Verilen kaynaklara göre: ' || left(parts[2], 300) || '...' as answer, sources, length(context) as context_chars from s
""")
def answered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline in one call, with BM25 and the dummy model."""
    retriever = Retriever.build(stored(retrieval.articles(spark, folder)), with_dense=False)
    answered = Pipeline(retriever, mode="bm25").answer(retrieval.questions(spark, folder))
    return answered.select("query_id", "question", "answer", F.array_join("sources.doc_id", ",").alias("sources"), F.col("context_chars").cast("bigint").alias("context_chars"))


@query(f"""
    with {CORPUS}, e as (select row_id, list_distinct([lower(translate(trim(x[1]), 'İI', 'iı')) || '|' || lower(trim(x[2])) for x in list_filter(coalesce(gold_citations, []), lambda x: x is not null and len(x) = 2)]) as listed, gold_doc_ids from dev_omer),
    d as (select g.row_id, list_distinct(list(lower(translate(trim(kanun_short), 'İI', 'iı')) || '|' || lower(trim(madde_no)))) as derived from (select row_id, unnest(gold_doc_ids) as doc_id from e where len(listed) = 0) g join corpus using (doc_id) group by 1)
    select row_id, array_to_string(list_sort(case when len(listed) > 0 then listed else coalesce(derived, []) end), ',') as citations from e left join d using (row_id)
""")
def derived_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Gold citations, those of the gold documents where none are listed."""
    found = G.citations(table(spark, folder, "dev_omer"), retrieval.articles(spark, folder), "row_id")
    return found.select("row_id", F.array_join("citations", ",").alias("citations"))


@query(f"""
    with {CORPUS}, r as (select row_id, unnest(gold_doc_ids) as doc_id, unnest(range(len(gold_doc_ids))) as rank from dev_omer),
    b as (select r.row_id, rank, doc_id, {_CTX_BLOCK} as block from r join corpus using (doc_id)),
    c as (select *, sum(length(block) + 2) over (partition by row_id order by rank, doc_id rows unbounded preceding) - 2 <= 6000 as fits from b)
    select row_id, md5(coalesce(string_agg(block, chr(10) || chr(10) order by rank, doc_id) filter (fits), '')) as digest, count(*) filter (fits) as used from c group by 1
""")
def gold_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The context that the gold documents of each question make."""
    rows = table(spark, folder, "dev_omer").select(F.col("row_id").alias("query_id"), F.col("gold_doc_ids").alias("doc_ids"))
    found = A.context_of_ids(rows, retrieval.articles(spark, folder))
    return found.select(F.col("query_id").alias("row_id"), F.md5("context").alias("digest"), "used")


@query("""
    with a as (select line_id, case when json_valid(line) and json_type(case when json_valid(line) then line end) = 'OBJECT' then line::json end as j from gold_lines)
    select line_id, array_to_string(case json_type(j, '$.gold_doc_ids') when 'ARRAY' then from_json(json_extract(j, '$.gold_doc_ids'), '["VARCHAR"]') when 'VARCHAR' then [json_extract_string(j, '$.gold_doc_ids')] else [] end, ',') as ids from a where j is not null
""")
def gold_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The gold ids of every line that is a record, be they an array or one bare string."""
    lines = table(spark, folder, "gold_lines").withColumn("v", G.record_of(F.col("line"))).where("v is not null")
    return lines.select("line_id", F.array_join(T.id_array(F.get_json_object("line", "$.gold_doc_ids")), ",").alias("ids"))


@query("""
    select qa_id, i as pos, case when i = 0 then question else answer end as question, answer, coalesce(difficulty, 'lookup') as difficulty from synthetic_qa, (values (0), (1)) v(i)
    where question is not null and answer is not null
""")
def synthesised_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Question-answer pairs found again in replies that wrap a JSON array in fences and talk; items
    without both parts are left out."""
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"), F.col("difficulty"))
    items = F.array(pair(F.col("question"), F.col("answer")), pair(F.col("answer"), F.col("answer")), pair(F.col("question"), F.lit(None).cast("string")))
    reply = F.concat(F.lit("Yanıt:\n```json\n"), F.to_json(items), F.lit("\n```"))
    return A.synthesised(table(spark, folder, "synthetic_qa").select("qa_id", reply.alias("reply")), "qa_id")
