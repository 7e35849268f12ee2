"""The queries of the core library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Parts of the SQL, shared between queries.


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(translate(coalesce({x}, ''), 'İI', 'iı')), '[a-zçğıöşüâîû0-9]+')"


CORPUS = "corpus as (select * exclude (rn) from (select *, row_number() over (partition by doc_id order by loaded_at, row_id) as rn from madde) where rn = 1)"

QUESTIONS = """
questions as (
    select 'dev:' || row_id as query_id, id, question, gold_doc_ids, category from dev_omer where row_id % 50 = 0
    union all select 'test:' || row_id, id, question, gold_doc_ids, category from test_full where row_id % 50 = 0)
"""


def sql_bm25(text: str, prefix: str = "", k: int = 10) -> str:
    """CTEs that end in <prefix>ranked(query_id, doc_id, score, rank) over corpus and questions."""
    p = prefix
    return f"""
{p}toks as (select doc_id, {sql_tokens(text)} as t from corpus),
{p}docs as (select doc_id, len(t) as len from {p}toks),
{p}tot as (select count(*) as n, avg(len) as a from {p}docs),
{p}post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(t) as term from {p}toks) group by 1, 2),
{p}raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from {p}post, {p}tot group by 1),
{p}terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from {p}raw) else raw end as idf from {p}raw),
{p}qt as (select query_id, term, count(*) as qf from (select query_id, unnest({sql_tokens("question")}) as term from questions) group by 1, 2),
{p}scored as (select query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) as score
    from {p}qt join {p}terms using (term) join {p}post using (term) join {p}docs using (doc_id), {p}tot group by 1, 2),
{p}ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {p}scored) where rank <= {k})
"""


def sql_dense(text: str, prefix: str = "d_", k: int = 50) -> str:
    """CTEs that end in <prefix>ranked(query_id, doc_id, score, rank) by the stand-in encoder's vectors."""
    p = prefix
    vectors = "select {0}, h % 64 as dim, sum(case when h >= 2147483648 then -1.0::double else 1.0 end) as v from (select {0}, ('0x' || substr(md5(t), 1, 8))::bigint as h from (select {0}, unnest({1}) as t from {2})) group by 1, 2"
    unit = "select {0}, dim, v / greatest(sqrt(sum(v * v) over (partition by {0})), 1e-12) as v from ({1})"
    return f"""
{p}docs as ({unit.format('doc_id', vectors.format('doc_id', sql_tokens(text), 'corpus'))}),
{p}asked as ({unit.format('query_id', vectors.format('query_id', sql_tokens('question'), 'questions'))}),
{p}dots as (select query_id, doc_id, sum(q.v * d.v) as s from {p}asked q join {p}docs d using (dim) group by 1, 2),
{p}scored as (select q.query_id, c.doc_id, round(coalesce(s, 0.0), 6) as score from questions q cross join corpus c left join {p}dots using (query_id, doc_id)),
{p}ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {p}scored) where rank <= {k})
"""


INDEXING_TEXT = "trim(concat_ws(' ', nullif(kanun_full, ''), 'Madde ' || coalesce(madde_no, ''), nullif(baslik, ''), nullif(metin, '')))"
