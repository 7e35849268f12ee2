"""Queries of evaluation: rankings against gold, answers, citations, faithfulness, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import scores as S
from lexspark.functions import text as T
from lexspark.operators import answers as A
from lexspark.operators import corpus as C
from lexspark.operators import evaluation as E
from lexspark.operators import judging as J
from lexspark.plans.registry import query, sql_tokens
from lexspark.session import spread, table

ORDERS = ["first", "score", "overlap"]
CONFIGS = [*ORDERS, "absent"]
ISOLATIONS = [("overlap", "first", "reranking"), ("score", "first", "sorting"), ("overlap", "absent", "missing")]


def training(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "synthetic_qa"), "qa_id")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold of each question id; of an id used again the first row, dev before test."""
    parts = [table(spark, folder, t).select(F.lit(i).alias("src"), "row_id", F.col("id").alias("query_id"), "question", "gold_doc_ids", "category") for i, t in enumerate(("dev_omer", "test_full"))]
    return C.first_per_key(parts[0].unionByName(parts[1]), ["query_id"], ["src", "row_id"]).drop("src", "row_id")


def ranked_hits(spark: SparkSession, folder: str) -> DataFrame:
    """(config, query_id, doc_id, rank): the hits of each question in three orders; the first hit of
    a document stands."""
    hits = C.first_per_key(table(spark, folder, "hit").select("hit_id", F.col("question_id").alias("query_id"), "doc_id", "score", "text", F.col("rank").alias("first_rank")), ["query_id", "doc_id"], ["first_rank", "hit_id"])
    asked = hits.join(gold(spark, folder).select("query_id", "question"), "query_id").withColumn("overlap", A.overlap_score(F.col("question"), F.col("text")))
    orders = {"first": [F.col("first_rank")], "score": [F.desc_nulls_last("score")], "overlap": [F.desc("overlap"), F.col("first_rank")]}
    ranks = [F.row_number().over(Window.partitionBy("query_id").orderBy(*o, "hit_id")).alias(c) for c, o in orders.items()]
    return asked.select("query_id", "doc_id", *ranks).unpivot(["query_id", "doc_id"], list(orders), "config", "rank")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(config, query_id, category, metric, value) of every gold question under each configuration
    that ran; a question without hits scores 0."""
    own, ranked = gold(spark, folder), ranked_hits(spark, folder)
    ran = F.explode(F.array(*[F.lit(c) for c in ORDERS])).alias("config")
    lists = ranked.where("rank <= 10").groupBy("config", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    joined = own.select("*", ran).join(lists, ["config", "query_id"], "left").withColumns({"ids": F.coalesce("ids", F.array()), "gold": F.coalesce("gold_doc_ids", F.array())})
    measured = joined.select("config", "query_id", "category", S.recall_at(F.col("ids"), F.col("gold"), 5).alias("recall_5"), S.mrr_at(F.col("ids"), F.col("gold"), 10).alias("mrr_10"))
    return E.long_form(measured, ["config", "query_id", "category"], ["recall_5", "mrr_10"])


_OVER = f"round(coalesce(len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('text')}))) / nullif(len(list_distinct({sql_tokens('question')})), 0), 0.0), 6)"
_GOLD = """
gold as (select * from (select *, row_number() over (partition by query_id order by src, row_id) as rn from (
    select 0 as src, row_id, id as query_id, question, gold_doc_ids, category from dev_omer union all select 1, row_id, id, question, gold_doc_ids, category from test_full)) where rn = 1)
"""
_FACTS = f"""
    with {_GOLD},
    h as (select * from (select hit_id, question_id as query_id, doc_id, score, text, rank as first_rank, row_number() over (partition by question_id, doc_id order by rank, hit_id) as rn from hit) where rn = 1),
    a as (select h.*, {_OVER} as overlap from h join gold using (query_id)),
    ranked as (select 'first' as config, query_id, doc_id, row_number() over (partition by query_id order by first_rank, hit_id) as rank from a
        union all select 'score', query_id, doc_id, row_number() over (partition by query_id order by score desc nulls last, hit_id) from a
        union all select 'overlap', query_id, doc_id, row_number() over (partition by query_id order by overlap desc, first_rank, hit_id) from a),
    lists as (select config, query_id, list(doc_id order by rank) as ids from ranked where rank <= 10 group by 1, 2),
    g as (select config, query_id, category, coalesce(ids, []) as ids, list_distinct(coalesce(gold_doc_ids, [])) as gold
        from gold cross join (select unnest(['first', 'score', 'overlap']) as config) left join lists using (config, query_id)),
    facts as (select config, query_id, category, 'recall_5' as metric, (case when len(gold) = 0 then 0.0 else len(list_intersect(ids[:5], gold)) / len(gold) end)::double as value from g
        union all select config, query_id, category, 'mrr_10', coalesce(list_max([case when list_contains(gold, ids[i]) then 1.0::double / i end for i in range(1, 11)]), 0.0)::double from g)
"""


@query(f"{_FACTS} select config, query_id, metric, round(value, 6) as value from facts")
def hit_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select("config", "query_id", "metric", F.round("value", 6).alias("value"))


@query(f"{_FACTS}, means as (select config, metric, round(avg(value), 6) as mean, count(value) as n from facts group by 1, 2) select c.config, metric, mean, coalesce(n, 0) as n, case when metric is null then 'missing' else 'ok' end as status from (select unnest(['first', 'score', 'overlap', 'absent']) as config) c left join means using (config)")
def ablation_table(spark: SparkSession, folder: str) -> DataFrame:
    return E.configurations(E.macro(facts(spark, folder), ["config"]), CONFIGS)


@query(f"""
    {_FACTS}, f as (select config, coalesce(nullif(category, ''), 'unknown') as category, metric, value from facts)
    select config, category, metric, round(avg(value), 6) as mean, count(value) as n from f group by grouping sets ((config, metric, category), (config, metric))
""")
def category_table(spark: SparkSession, folder: str) -> DataFrame:
    return E.by_category(facts(spark, folder))


@query(f"""
    {_FACTS}, means as (select config, metric, round(avg(value), 6) as mean from facts group by 1, 2)
    select label, m.metric, round(max(mean) filter (config = a) - max(mean) filter (config = b), 6) as delta
    from means m, (values ('overlap', 'first', 'reranking'), ('score', 'first', 'sorting'), ('overlap', 'absent', 'missing')) p(a, b, label) group by 1, 2
""")
def isolation_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return E.deltas(E.macro(facts(spark, folder), ["config"]), ISOLATIONS)


@query(f"""
    {_FACTS}, m as (select config, coalesce(nullif(category, ''), 'unknown') as category, round(avg(value), 6) as mean from facts where metric = 'recall_5' group by 1, 2)
    select category, max(mean) filter (config = 'first') as first, max(mean) filter (config = 'score') as score, max(mean) filter (config = 'overlap') as overlap from m group by 1
""")
def category_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return E.pivoted(E.by_category(facts(spark, folder)), ["first", "score", "overlap"], "recall_5")


@query(f"""
    {_FACTS}, r as (select config || ':' || query_id as query_id, rank, list_contains(coalesce(gold_doc_ids, []), doc_id) as relevant from ranked join gold using (query_id)),
    p as (select *, sum(relevant::int) over (partition by query_id order by rank rows unbounded preceding) as hits from r)
    select query_id, round(coalesce(sum(case when relevant then hits::double / rank end) / nullif(count(*) filter (relevant), 0), 0.0), 6)::double as ap from p group by 1
""")
def hit_average_precision(spark: SparkSession, folder: str) -> DataFrame:
    own = gold(spark, folder).select("query_id", F.coalesce("gold_doc_ids", F.array()).alias("gold"))
    scored = ranked_hits(spark, folder).join(own, "query_id").select(F.concat_ws(":", "config", "query_id").alias("query_id"), "rank", F.array_contains("gold", F.col("doc_id")).alias("relevant"))
    return E.average_precision(scored)


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_NBSP = "\u00a0\u2007\u2009\u202f\u3000²³"


def sql_normal(x: str) -> str:
    """Compatibility forms of the characters there are, lower case, white space."""
    folded = f"nfc_normalize(translate(replace(replace(coalesce({x}, ''), 'ﬁ', 'fi'), '…', '...'), '{_WIDE}{_NBSP}', '{_PLAIN}     23'))"
    return f"trim(regexp_replace(lower(translate({folded}, 'İI', 'iı')), '\\s+', ' ', 'g'))"


_PAIRS = f"""
    with n as (select qa_id, {sql_normal('answer')} as pn, {sql_normal('madde_text')} as gn from synthetic_qa),
    t as (select qa_id, pn = gn as same, regexp_extract_all(pn, '[\\p{{L}}\\p{{N}}_]+') as p, regexp_extract_all(gn, '[\\p{{L}}\\p{{N}}_]+') as g from n),
""" + ", ".join(
    f"p{n} as (select qa_id, w, count(*) as c from (select qa_id, unnest([array_to_string(p[i:i + {n - 1}], ' ') for i in range(1, len(p) - {n - 1} + 1)]) as w from t) group by 1, 2), "
    f"g{n} as (select qa_id, w, count(*) as c from (select qa_id, unnest([array_to_string(g[i:i + {n - 1}], ' ') for i in range(1, len(g) - {n - 1} + 1)]) as w from t) group by 1, 2), "
    f"o{n} as (select qa_id, sum(least(p{n}.c, g{n}.c)) as o from p{n} join g{n} using (qa_id, w) group by 1)"
    for n in range(1, 5)
)


@query(f"""
    {_PAIRS}
    select t.qa_id, same::int::double as em,
        round(case when len(p) > 0 and len(g) > 0 and coalesce(o1.o, 0) > 0 then 2.0::double * o1.o / (len(p) + len(g)) else 0.0 end, 6)::double as f1,
        round(case when len(p) >= 4 and len(g) > 0 then (case when len(p) < len(g) then exp(1 - len(g)::double / len(p)) else 1.0 end) * exp(
            ({" + ".join(f"ln((coalesce(o{n}.o, 0) + 1)::double / (len(p) - {n - 1} + 1))" for n in range(1, 5))}) / 4) else 0.0 end, 6)::double as bleu
    from t left join o1 using (qa_id) left join o2 using (qa_id) left join o3 using (qa_id) left join o4 using (qa_id)
""")
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers against the text they were made from."""
    return E.answer_metrics(training(spark, folder), ["qa_id"], "answer", "madde_text", rouge=False)


# the table of the longest common subsequence by rows: only gold tokens that the answer has can count
@query(f"""
    with recursive n as (select qa_id, {sql_normal('answer')} as pn, {sql_normal('madde_text')} as gn from synthetic_qa),
    t as (select qa_id, regexp_extract_all(pn, '[\\p{{L}}\\p{{N}}_]+') as p, regexp_extract_all(gn, '[\\p{{L}}\\p{{N}}_]+') as g from n),
    both_ as (select qa_id, p, len(g) as ng, list_filter(g, lambda w: list_contains(p, w)) as g from t),
    cells as (select qa_id, p, unnest(range(1, len(g) + 1)) as j, unnest(g) as w from both_),
    rows_ as (
        select 0 as i, qa_id, j, 0 as best from cells
        union all
        select i, qa_id, j, max(own) over (partition by qa_id order by j) as best from (
            select r.i + 1 as i, r.qa_id, r.j, greatest(r.best, case when c.p[r.i + 1] = c.w then 1 + coalesce(lag(r.best) over (partition by r.qa_id order by r.j), 0) else 0 end) as own
            from rows_ r join cells c on c.qa_id = r.qa_id and c.j = r.j where r.i < len(c.p))
    ),
    common as (select qa_id, max(best) as c from rows_ group by 1)
    select qa_id, round(case when coalesce(c, 0) > 0 then 2.0::double * (c::double / len(p)) * (c::double / ng) / (c::double / ng + c::double / len(p)) else 0.0 end, 6)::double as rouge_l
    from both_ left join common using (qa_id)
""")
def answer_rouge(spark: SparkSession, folder: str) -> DataFrame:
    pairs = training(spark, folder).select("qa_id", T.tokens(F.col("answer")).alias("p"), T.tokens(F.col("madde_text")).alias("g"))
    return pairs.select("qa_id", F.round(S.rouge_l(F.col("p"), F.col("g")), 6).alias("rouge_l"))


_CITED = r"'\[\s*([A-Za-zÇĞİÖŞÜçğıöşü0-9]+)\s+m\.?\s*([0-9A-Za-zçğıöşü/\-]+)\s*\]'"


def sql_cited(x: str) -> str:
    laws, numbers = (f"regexp_extract_all(coalesce({x}, ''), {_CITED}, {i})" for i in (1, 2))
    return f"list_distinct([lower(translate({laws}[i], 'İI', 'iı')) || '|' || lower({numbers}[i]) for i in range(1, len({laws}) + 1)])"


_CIT = """
    select {key}, round(case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) = 0 then 0.0 else c / len(p) end, 6)::double as cit_p,
        round(case when len(p) = 0 and len(g) = 0 then 1.0 when len(g) = 0 then 0.0 else c / len(g) end, 6)::double as cit_r,
        round(case when len(p) = 0 and len(g) = 0 then 1.0 when c > 0 then 2.0 * c / (len(p) + len(g)) else 0.0 end, 6)::double as cit_f1, len(p) as n_pred, len(g) as n_gold
    from (select *, len(list_intersect(p, g)) as c from k)
"""


def _citation_rows(keyed: DataFrame, key: str) -> DataFrame:
    x = keyed.select(key, S.citation_scores(F.col("p"), F.col("g")).alias("x"))
    rounded = [F.round(f"x.{n}", 6).alias(f"cit_{n}") for n in ("p", "r", "f1")]
    return x.select(key, *rounded, *[F.col(f"x.{n}").cast("bigint").alias(n) for n in ("n_pred", "n_gold")])


@query(f"with k as (select qa_id, {sql_cited('answer')} as p, [lower(translate(kanun_short, 'İI', 'iı')) || '|' || lower(madde_no)] as g from synthetic_qa) {_CIT.format(key='qa_id')}")
def training_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations in training answers against the article they were made from."""
    own = F.array(F.concat(T.tr_lower(F.col("kanun_short")), F.lit("|"), F.lower("madde_no")))
    return _citation_rows(table(spark, folder, "synthetic_qa").select("qa_id", T.citations(F.col("answer")).alias("p"), own.alias("g")), "qa_id")


_PAIR = "list_filter(coalesce(gold_citations, []), lambda x: x is not null and len(x) = 2)"


@query(f"with k as (select row_id, {sql_cited('answer')} as p, list_distinct([lower(translate(trim(x[1]), 'İI', 'iı')) || '|' || lower(trim(x[2])) for x in {_PAIR}]) as g from dev_omer) {_CIT.format(key='row_id')}")
def gold_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations in gold answers against the listed ones."""
    return _citation_rows(table(spark, folder, "dev_omer").select("row_id", T.citations(F.col("answer")).alias("p"), T.citation_keys(F.col("gold_citations")).alias("g")), "row_id")


@query(f"with k as (select row_id, {sql_cited('answer')} as p, list_distinct([lower(translate(trim(x[1]), 'İI', 'iı')) || '|' || lower(string_split(trim(x[2]), '/')[1]) for x in {_PAIR}]) as g from dev_omer) {_CIT.format(key='row_id')}")
def gold_citations_by_article(spark: SparkSession, folder: str) -> DataFrame:
    """The same with paragraph numbers of the gold side cut off."""
    return _citation_rows(table(spark, folder, "dev_omer").select("row_id", T.citations(F.col("answer")).alias("p"), T.citation_keys(F.col("gold_citations"), article_level=True).alias("g")), "row_id")


@query(f"with k as (select row_id, {sql_cited('answer')} as p, list_distinct([lower(translate(x[1], 'İ', 'i')) || '|' || lower(x[2]) for x in {_PAIR}]) as g from dev_omer) {_CIT.format(key='row_id')}")
def gold_citations_compat(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the gold side lower-cased the plain way, as published figures have it."""
    return _citation_rows(table(spark, folder, "dev_omer").select("row_id", T.citations(F.col("answer")).alias("p"), T.citation_keys_compat(F.col("gold_citations")).alias("g")), "row_id")


_CLAIMS = f"""
    c as (select qa_id, kanun_short, list_distinct({sql_tokens('madde_text')}) as have, list_filter([trim(x) for x in string_split_regex(regexp_replace(coalesce(answer, ''), '\\[[^\\]]*\\]', '', 'g'), '[.!?]+\\s*')], lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as claims from synthetic_qa),
    v as (select qa_id, kanun_short, claims, [list_distinct({sql_tokens('x')}) for x in claims] as own, have from c),
    s as (select qa_id, kanun_short, [coalesce(len(list_intersect(o, have)) / nullif(len(o), 0), 0.0) for o in own] as shares from v),
    f as (select qa_id, kanun_short, len(shares) as claims, case when len(shares) > 0 then round(list_sum([case when x >= 0.8 then 1.0 when x >= 0.4 then 0.5 else 0.0 end for x in shares])::double / len(shares), 6) end as faithfulness from s)
"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The answers with verdicts of the overlap judge, by way of the JSON a judge would reply."""
    verdicts = training(spark, folder).select("qa_id", "kanun_short", J.overlap_verdicts(F.col("answer"), F.col("madde_text")).alias("claims"))
    reply = F.concat(F.lit("Değerlendirme:\n```json\n"), F.to_json(F.struct("claims")), F.lit("\n```"))
    judged = verdicts.select("qa_id", "kanun_short", J.judged(reply).alias("j"))
    return judged.select("qa_id", "kanun_short", F.size("j.claims").cast("bigint").alias("claims"), F.round("j.faithfulness", 6).alias("faithfulness"))


@query(f"with {_CLAIMS} select qa_id, claims, faithfulness from f")
def faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).drop("kanun_short")


@query(f"with {_CLAIMS} select kanun_short, count(*) as n_rows, count(faithfulness) as n_scored, count(*) filter (faithfulness is null) as n_unscored, round(avg(faithfulness), 6) as mean_faithfulness from f group by 1")
def faithfulness_by_law(spark: SparkSession, folder: str) -> DataFrame:
    return J.summary(_judged(spark, folder), ["kanun_short"])


@query("select qa_id, len(answer) as n_chars, length('Soru: ' || question || chr(10) || chr(10) || 'Kaynak Maddeler:' || chr(10) || left(madde_text, 1500) || chr(10) || chr(10) || 'Cevap:') as prompt_chars, md5('Soru: ' || question || chr(10) || chr(10) || 'Kaynak Maddeler:' || chr(10) || left(madde_text, 1500) || chr(10) || chr(10) || 'Cevap:') as prompt from synthetic_qa where answer is not null")
def chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    turns = A.chat_example(F.col("question"), F.col("answer"), F.col("madde_text"))
    made = table(spark, folder, "synthetic_qa").where("answer is not null").select("qa_id", turns.alias("t"))
    prompt = F.element_at("t", 2)["content"]
    return made.select("qa_id", F.length(F.element_at("t", 3)["content"]).cast("bigint").alias("n_chars"), F.length(prompt).cast("bigint").alias("prompt_chars"), F.md5(prompt).alias("prompt"))


@query(f"select qa_id, len({sql_tokens('question')}) + len({sql_tokens('answer')}) + len({sql_tokens('madde_text')}) as n_tokens from synthetic_qa where len({sql_tokens('question')}) + len({sql_tokens('answer')}) + len({sql_tokens('madde_text')}) <= 512")
def length_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    n = sum(F.size(T.tokenize(F.col(c))) for c in ("question", "answer", "madde_text"))
    return table(spark, folder, "synthetic_qa").select("qa_id", n.cast("bigint").alias("n_tokens")).where("n_tokens <= 512")


@query("select qa_id from synthetic_qa where source_doc_id not in (select doc_id from hit where doc_id is not null)")
def resumed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows whose article no hit has yet."""
    return J.resumed(table(spark, folder, "synthetic_qa").withColumnRenamed("source_doc_id", "doc_id"), table(spark, folder, "hit").where("doc_id is not null"), "doc_id").select("qa_id")
