"""Queries of retrieval: indexes, rankings, fusion, contexts, mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import answers as A
from lexspark.operators import corpus as C
from lexspark.operators import dense, fuse, mining
from lexspark.operators import evaluation as E
from lexspark.operators.search import Retriever
from lexspark.operators.sparse import SparseIndex
from lexspark.plans.registry import CORPUS, INDEXING_TEXT, QUESTIONS, query, sql_bm25, sql_dense, sql_tokens
from lexspark.session import stored, table

QUERY_EVERY = 50


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus(table(spark, folder, "madde"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every gold question whose row_id is divisible by 50."""
    parts = [
        table(spark, folder, t).where(F.col("row_id") % QUERY_EVERY == 0).select(F.concat(F.lit(f"{name}:"), F.col("row_id").cast("string")).alias("query_id"), "id", "question", "gold_doc_ids", "category")
        for name, t in (("dev", "dev_omer"), ("test", "test_full"))
    ]
    return parts[0].unionByName(parts[1])


def full_text_of() -> Column:
    """What is indexed of an article."""
    return T.indexing_text(F.col("kanun_full"), F.col("madde_no"), F.col("baslik"), F.col("metin"))


def full_text(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("doc_id", full_text_of().alias("text"))


def long(df: DataFrame) -> DataFrame:
    """Ranks as SQL counts them."""
    return df.withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 6))


_HEAD = f"with {CORPUS}, {QUESTIONS}, "


@query(f"{_HEAD} {sql_bm25(INDEXING_TEXT)} select term, df, round(idf, 6) as idf from terms")
def bm25_terms(spark: SparkSession, folder: str) -> DataFrame:
    return SparseIndex.build(full_text(spark, folder)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"{_HEAD} {sql_bm25(INDEXING_TEXT)} select query_id, doc_id, round(score, 6) as score, rank from ranked")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return long(SparseIndex.build(full_text(spark, folder)).search(questions(spark, folder)))


@query(f"""
    {_HEAD} {sql_bm25(INDEXING_TEXT, k=2000)},
    padded as (select q.query_id, d.doc_id, coalesce(r.score, 0.0) as score, r.rank as own from questions q cross join docs d left join ranked r using (query_id, doc_id)),
    placed as (select *, row_number() over (partition by query_id order by own nulls last, doc_id) as rank from padded)
    select query_id, doc_id, round(score, 6) as score, rank from placed where rank <= 10
""")
def bm25_topk_padded(spark: SparkSession, folder: str) -> DataFrame:
    return long(SparseIndex.build(full_text(spark, folder)).search(questions(spark, folder), pad=True))


@query(f"""
    {_HEAD} {sql_bm25(INDEXING_TEXT)},
    hits as (select query_id, list(doc_id order by rank) as ids from ranked group by 1),
    g as (select q.query_id, list_distinct(coalesce(gold_doc_ids, [])) as gold, coalesce(ids, []) as ids from questions q left join hits using (query_id))
    select query_id, {", ".join(f"round(case when len(gold) = 0 then 0.0 else len(list_intersect(ids[:{k}], gold)) / len(gold) end, 6) as recall_{k}" for k in (1, 3, 5, 10))},
        round(coalesce(list_max([case when list_contains(gold, ids[i]) then 1.0 / i end for i in range(1, 11)]), 0.0), 6)::double as mrr_10,
        round(case when len(gold) = 0 then 0.0 else list_sum([case when list_contains(gold, ids[i]) then 1.0 / log2(i + 1) else 0.0 end for i in range(1, 11)])
            / list_sum([1.0 / log2(i + 1) for i in range(1, least(len(gold), 10) + 1)]) end, 6)::double as ndcg_10 from g
""")
def bm25_metrics(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    return E.retrieval_metrics(SparseIndex.build(full_text(spark, folder)).search(asked), asked)


_DENSE = """
    with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0),
    s as (select query_id, vec_id as doc_id, round(list_dot_product(e, embedding::double[]), 6) as score, label from q, embeddings),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
"""


@query(f"{_DENSE} select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 10")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.where(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id")
    return long(dense.search(vectors, asked))


@query("""
    with q as (select vec_id as query_id, embedding::double[] as e, label as own from embeddings where vec_id % 50 = 0),
    s as (select query_id, own, label, row_number() over (partition by query_id order by round(list_dot_product(e, embedding::double[]), 6) desc, vec_id) as rank from q, embeddings where vec_id <> query_id)
    select query_id, count(*) filter (rank <= 10 and label = own) as same_in_10, round(coalesce(1.0 / min(rank) filter (label = own and rank <= 10), 0.0), 6)::double as mrr_10 from s group by 1
""")
def dense_label_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A vector is found if its neighbours, itself aside, bear its label."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    asked = vectors.where(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id")
    first = stored(dense.search(vectors, asked, 11))
    found = first.where("doc_id <> query_id")
    # without itself the later ranks move up by one, if it was among the first 11
    own = first.where("doc_id = query_id").select("query_id", F.col("rank").alias("own_rank"))
    moved = found.join(own, "query_id", "left").withColumn("rank", F.when(F.col("rank") > F.col("own_rank"), F.col("rank") - 1).otherwise(F.col("rank"))).where("rank <= 10")
    labels = vectors.select("doc_id", "label")
    joined = moved.join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    same = F.col("label") == F.col("own")
    counted = joined.groupBy("query_id").agg(F.count_if(same).alias("same_in_10"), F.round(F.coalesce(1.0 / F.min(F.when(same, F.col("rank"))), F.lit(0.0)), 6).alias("mrr_10"))
    return asked.select("query_id").join(counted, "query_id", "left").fillna({"same_in_10": 0, "mrr_10": 0.0})


@query()
def dense_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per query the share of the exact first ten that the index of cells finds, as many cells being
    probed as a sample of the queries needs. These vectors have little structure: it takes most cells."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.where(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id")
    centres = dense.fit_cells(vectors, 64)
    near = dense.search_index(dense.with_cells(vectors, centres), centres, asked)
    exact = dense.search(vectors, asked)
    found = exact.join(near.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


_TWO = f"{_HEAD} {sql_bm25('metin', 'a_', 50)}, {sql_bm25('baslik', 'b_', 50)}"


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rankings by body and by heading."""
    asked = questions(spark, folder)
    texts = stored(articles(spark, folder).select("doc_id", "metin", "baslik"))
    return SparseIndex.build(texts, "metin").search(asked, 50), SparseIndex.build(texts, "baslik").search(asked, 50)


@query(f"""
    {_TWO}, u as (select query_id, doc_id, 1.0::double / (60 + rank) as s, (0, rank) as place from a_ranked union all select query_id, doc_id, 1.0::double / (60 + rank), (1, rank) from b_ranked),
    f as (select query_id, doc_id, sum(s) as score, min(place) as place from u group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, place, doc_id) as rank from f)
    select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 20
""")
def rrf_fused(spark: SparkSession, folder: str) -> DataFrame:
    return long(fuse.reciprocal_ranks(list(_two(spark, folder)), 20))


@query(f"""
    {_TWO}, m as (select 'a' as l, * from a_ranked union all select 'b', * from b_ranked),
    n as (select query_id, doc_id, case when max(score) over w - min(score) over w < 1e-9 then 1.0 else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end as s from m window w as (partition by l, query_id)),
    s as (select query_id, doc_id, 0.5 * sum(s) as score from n group by 1, 2),
    gold as (select distinct query_id, c.kanun_short from (select query_id, unnest(gold_doc_ids) as doc_id from questions) g join corpus c using (doc_id)),
    x as (select s.query_id, s.doc_id, round(score * case when g.query_id is null then 1.0 else 1.2 end, 6) as score from s join corpus c using (doc_id) left join gold g on g.query_id = s.query_id and g.kanun_short = c.kanun_short),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from x)
    select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 20
""")
def hybrid_weighted_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled scores of two lists, documents of a gold document's law counting more."""
    from lexspark.operators.sparse import top

    a, b = _two(spark, folder)
    laws = articles(spark, folder).select("doc_id", "kanun_short")
    gold = questions(spark, folder).select("query_id", F.explode("gold_doc_ids").alias("doc_id")).join(laws, "doc_id").select("query_id", "kanun_short").distinct()
    pairs = a.select("query_id", "doc_id").unionByName(b.select("query_id", "doc_id")).distinct()
    boost = pairs.join(laws, "doc_id").join(gold, ["query_id", "kanun_short"], "left_semi").select("query_id", "doc_id")
    return long(top(fuse.weighted(a, b, boost), 20))


@query(f"""
    {_HEAD} {sql_bm25(INDEXING_TEXT, k=50)}, {sql_dense(INDEXING_TEXT)},
    u as (select query_id, doc_id, 1.0::double / (60 + rank) as s, (0, rank) as place from ranked union all select query_id, doc_id, 1.0::double / (60 + rank), (1, rank) from d_ranked),
    f as (select query_id, doc_id, sum(s) as score, min(place) as place from u group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, place, doc_id) - 1 as rank from f)
    select query_id, rank, doc_id, round(score, 6) as score, kanun_short, madde_no from r join corpus using (doc_id) where rank < 10
""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The whole retriever, sparse and dense, with the stand-in encoder."""
    corpus = stored(articles(spark, folder))
    hits = Retriever.build(corpus).search(questions(spark, folder), 10, "hybrid")
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "kanun_short", "madde_no")


_OVERLAP = f"round(coalesce(len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('text')}))) / nullif(len(list_distinct({sql_tokens('question')})), 0), 0.0), 6)"
_ASKED = "asked as (select id as question_id, min(question) as question from (select id, question from dev_omer union all select id, question from test_full) group by 1)"


def asked_hits(spark: SparkSession, folder: str) -> DataFrame:
    """All hits with their question; of ids reused for several questions the least text."""
    gold = table(spark, folder, "dev_omer").select("id", "question").unionByName(table(spark, folder, "test_full").select("id", "question"))
    return table(spark, folder, "hit").join(gold.groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("question")), "question_id")


@query(f"""
    with {_ASKED}, s as (select h.hit_id, h.question_id as query_id, {_OVERLAP} as score, h.rank as first_rank from hit h join asked using (question_id)),
    r as (select *, row_number() over (partition by query_id order by score desc, first_rank, hit_id) - 1 as rank from s)
    select query_id, hit_id, score, rank from r where rank < 5
""")
def rerank_overlap(spark: SparkSession, folder: str) -> DataFrame:
    hits = asked_hits(spark, folder).select("hit_id", F.col("question_id").alias("query_id"), "question", "text", F.col("rank").alias("first_rank"))
    ranked = A.rerank(hits.withColumn("rank", F.lit(0)), top_k=5, order=("first_rank", "hit_id"))
    return ranked.select("query_id", "hit_id", "score", F.col("rank").cast("bigint").alias("rank"))


#: Hits may be repeated; the first of each document and question stands.
_HITS = "h as (select * from (select *, row_number() over (partition by question_id, doc_id order by rank, hit_id) as rn from hit) where rn = 1)"
_BLOCK = "'[' || coalesce(kanun_short, '') || ' m.' || coalesce(madde_no, '') || ']' || case when baslik <> '' then ' (' || baslik || ')' else '' end || chr(10) || coalesce(text, '')"
_CONTEXT = f"""
    {_HITS}, b as (select question_id as query_id, rank, doc_id, {_BLOCK} as block from h),
    c as (select *, sum(length(block) + 2) over (partition by query_id order by rank, doc_id rows unbounded preceding) - 2 <= 6000 as fits from b),
    ctx as (select query_id, coalesce(string_agg(block, chr(10) || chr(10) order by rank, doc_id) filter (fits), '') as context, count(*) filter (fits) as used from c group by 1)
"""


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    hits = C.first_per_key(table(spark, folder, "hit"), ["question_id", "doc_id"], ["rank", "hit_id"])
    return A.context(hits.withColumnRenamed("question_id", "query_id"))


@query(f"with {_CONTEXT} select query_id, used, length(context) as n_chars, md5(context) as digest from ctx")
def contexts(spark: SparkSession, folder: str) -> DataFrame:
    return _contexts(spark, folder).select("query_id", "used", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("digest"))


@query(f"""
    with {_CONTEXT}, {_ASKED}, p as (select query_id, 'Soru: ' || question || chr(10) || chr(10) || 'Kaynak Maddeler:' || chr(10) || context || chr(10) || chr(10) || 'Cevap:' as prompt from ctx join asked on question_id = query_id),
    s as (select query_id, string_split(substr(prompt, greatest(instr(prompt, 'Kaynak Maddeler:'), 1)), chr(10) || chr(10)) as parts from p)
    select query_id, '(DUMMY) Verilen kaynaklara göre: ' || left(parts[2], 300) || '...' as answer from s
""")
def dummy_answers(spark: SparkSession, folder: str) -> DataFrame:
    gold = asked_hits(spark, folder).select(F.col("question_id").alias("query_id"), "question").distinct()
    prompts = _contexts(spark, folder).join(gold, "query_id").select("query_id", A.prompt(F.col("question"), F.col("context")).alias("prompt"))
    return prompts.select("query_id", A.dummy_answer(F.col("prompt")).alias("answer"))


@query("""
    select hit_id, md5('**' || (rank + 1) || '. [' || kanun_short || ' m.' || madde_no || ']** (score: ' || coalesce(round(score::decimal(18, 6), 3)::varchar, '—') || ')' || chr(10) || chr(10) || '> ' || replace(left(coalesce(text, ''), 300), chr(10), ' ') || '...') as line
    from hit
""")
def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = A.source_line(F.col("rank") + 1, F.col("kanun_short"), F.col("madde_no"), F.col("score"), F.col("text"))
    return table(spark, folder, "hit").select("hit_id", F.md5(line).alias("line"))


def _positives(spark: SparkSession, folder: str, depth: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training questions of the stated query set with their article, the corpus, and their BM25
    ranking."""
    corpus = stored(articles(spark, folder).select("doc_id", "kanun_short", "kanun_full", "madde_no", "baslik", "metin"))
    asked = table(spark, folder, "synthetic_qa").where(F.col("qa_id") % QUERY_EVERY == 0).select(F.col("qa_id").alias("query_id"), "question", F.col("source_doc_id").alias("doc_id"))
    positive, _ = mining.positives(asked, corpus)
    return positive, corpus, stored(SparseIndex.build(corpus.select("doc_id", full_text_of().alias("text"))).search(asked.select("query_id", "question"), depth))


_TRAIN = "questions as (select qa_id as query_id, question, source_doc_id from synthetic_qa where qa_id % 50 = 0)"
def _mine(depth: int) -> str:
    return f"""
    with {CORPUS}, {_TRAIN}, {sql_bm25(INDEXING_TEXT, k=depth)},
    positive as (select query_id, question, source_doc_id as doc_id, kanun_short from questions q join corpus c on c.doc_id = q.source_doc_id),
    neg as (select * from (select r.query_id, r.doc_id, row_number() over (partition by r.query_id order by r.rank, r.doc_id) as place from ranked r join positive p on p.query_id = r.query_id and p.doc_id <> r.doc_id) where place <= 8),
    have as (select p.query_id, p.doc_id as positive_id, p.kanun_short, count(n.query_id) as have from positive p left join neg n using (query_id) group by 1, 2, 3),
    pool as (select kanun_short, doc_id, row_number() over (partition by kanun_short order by md5('42:' || doc_id)) as rn, count(*) over (partition by kanun_short) as size from corpus),
    spots as (select *, unnest(range(9)) as draw from have where have < 8),
    drawn as (select s.*, p.doc_id from spots s join pool p on p.kanun_short = s.kanun_short and draw < size and rn = (('0x' || substr(md5('42:' || s.query_id), 1, 8))::bigint + draw) % size + 1),
    fresh as (select query_id, doc_id, have + row_number() over (partition by query_id order by draw) as place from drawn d where doc_id <> positive_id and not exists (select 1 from neg n where n.query_id = d.query_id and n.doc_id = d.doc_id)),
    negatives as (select query_id, doc_id, place, false as is_padding from neg union all select query_id, doc_id, place, true from fresh where place <= 8)
"""


_MINE = _mine(20)


@query(f"{_MINE} select query_id, doc_id, place, is_padding from negatives")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    positive, corpus, ranked = _positives(spark, folder)
    found = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    return found.withColumn("place", F.col("place").cast("bigint"))


@query(f"{_mine(4)} select query_id, doc_id, place, is_padding from negatives")
def padded_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The same from rankings so short that every question is filled up with articles of its law."""
    positive, corpus, ranked = _positives(spark, folder, 4)
    found = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    return found.withColumn("place", F.col("place").cast("bigint"))


@query(f"""
    {_MINE}, pr as (select p.query_id, r.rank, p.kanun_short from positive p left join ranked r on r.query_id = p.query_id and r.doc_id = p.doc_id),
    per as (select n.query_id, bool_or(is_padding) as padded, count(*) filter (c.kanun_short = p.kanun_short) as same_law from negatives n join corpus c using (doc_id) join positive p on p.query_id = n.query_id group by 1)
    select count(*) as questions, count(rank) as found, round(avg(rank), 4) as mean_rank, min(rank) as best_rank, max(rank) as worst_rank, count(*) filter (padded) as padded, round(avg(coalesce(same_law, 0)), 4) as mean_same_law
    from pr left join per using (query_id)
""")
def mining_statistics(spark: SparkSession, folder: str) -> DataFrame:
    positive, corpus, ranked = _positives(spark, folder)
    negatives = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    out = mining.statistics(mining.positive_ranks({"bm25": ranked}, positive), negatives, corpus, positive)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("best_rank", "worst_rank")})


@query(f"""
    {_MINE}, l as (select query_id, 0 as place, doc_id from positive where query_id in (select query_id from negatives) union all select query_id, place, doc_id from negatives)
    select query_id, (row_number() over (partition by query_id order by place) - 1)::int as position, doc_id, (place = 0)::int as label from l
""")
def listwise_examples(spark: SparkSession, folder: str) -> DataFrame:
    positive, corpus, ranked = _positives(spark, folder)
    negatives = mining.padded(mining.from_ranking(ranked, positive, 8), positive, corpus, 8)
    return mining.listwise(mining.triplets(positive.drop("kanun_short"), negatives, corpus))


@query(f"""
    {_MINE}, pr as (select r.rank from positive p left join ranked r on r.query_id = p.query_id and r.doc_id = p.doc_id)
    select {", ".join(f"round(avg((coalesce(rank, 1000000) <= {k})::int), 6) as r_{k}" for k in (1, 5, 10))}, round(avg(coalesce(1.0::double / rank, 0.0)), 6) as mrr, round(avg(rank), 6) as mean_rank from pr
""")
def gate_metrics(spark: SparkSession, folder: str) -> DataFrame:
    positive, _, ranked = _positives(spark, folder)
    return E.gate(mining.positive_ranks({"bm25": ranked}, positive))
