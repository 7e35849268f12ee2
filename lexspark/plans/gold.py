"""Queries over gold questions: parsing, validation, merging, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import goldset as G
from lexspark.operators.corpus import repeated
from lexspark.plans.registry import query
from lexspark.session import cut, table


def checked(spark: SparkSession, folder: str) -> DataFrame:
    return G.parsed(table(spark, folder, "gold_lines"))


def corpus_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").select("doc_id")


_TEXT = "coalesce(json_type(j, '$.{0}') = 'VARCHAR', false)"
_VALUE = "json_extract_string(j, '$.{0}')"
_REQUIRED = ", ".join(f"case when not list_contains(json_keys(j), '{f}') then 'missing:{f}' end" for f in G.REQUIRED)
_WRONG = f"""
    case when not coalesce(json_type(j, '$.gold_doc_ids') = 'ARRAY', false) then 'list:gold_doc_ids' when json_array_length(j, '$.gold_doc_ids') = 0 and {_VALUE.format('difficulty')} is distinct from 'no_answer' then 'empty:gold_doc_ids' end,
    case when not coalesce(json_type(j, '$.gold_citations') = 'ARRAY', false) then 'list:gold_citations' end,
    case when not coalesce({_VALUE.format('difficulty')} in ('lookup', 'reasoning', 'edge', 'multi_hop', 'no_answer'), false) then 'invalid:difficulty' end,
    case when not {_TEXT.format('id')} or trim({_VALUE.format('id')}) = '' then 'empty:id' end,
    case when not {_TEXT.format('question')} or length({_VALUE.format('question')}) < 5 then 'short:question' end,
    case when not {_TEXT.format('answer')} or length({_VALUE.format('answer')}) < 5 then 'short:answer' end
"""
_NONE = "lambda x: x is not null"
_CHECKED = f"""
    with l as (select line_id, file_name, line_no, case when json_valid(line) and json_type(case when json_valid(line) then line end) = 'OBJECT' then line::json end as j from gold_lines where trim(regexp_replace(line, '\\s', ' ', 'g')) <> ''),
    e as (select *, case when j is null then ['parse'] else list_filter([{_REQUIRED}], {_NONE}) end as absent, list_filter([{_WRONG}], {_NONE}) as wrong from l),
    checked as (select *, case when j is null or len(absent) > 0 then absent else wrong end as errors from e),
    rows as (select file_name, line_no, {_VALUE.format('id')} as id, {_VALUE.format('question')} as question, {_VALUE.format('difficulty')} as difficulty, {_VALUE.format('category')} as category, {_VALUE.format('author')} as author,
        from_json(json_extract(j, '$.gold_doc_ids'), '["VARCHAR"]') as gold_doc_ids from checked where len(errors) = 0),
    uniq as (select * from (select *, row_number() over (partition by id order by file_name, line_no) as rn from rows) where rn = 1),
    missing as (select id, list_sort(list_distinct(list(d))) as missing from (select id, unnest(gold_doc_ids) as d from uniq) where d not in (select doc_id from madde) group by 1),
    usable as (select * from uniq where difficulty = 'no_answer' or id in (select id from (select id, unnest(gold_doc_ids) as d from uniq) where d in (select doc_id from madde)))
"""


@query(f"{_CHECKED} select line_id, array_to_string(errors, ',') as errors from checked")
def gold_validation(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder).select("line_id", F.array_join("errors", ",").alias("errors"))


@query(f"{_CHECKED} select file_name, count(*) filter (len(errors) = 0) as valid_rows, count(*) filter (len(errors) > 0) as error_rows from checked group by 1")
def gold_file_counts(spark: SparkSession, folder: str) -> DataFrame:
    return G.file_counts(checked(spark, folder))


@query(f"{_CHECKED} select id, file_name, line_no, question, difficulty from uniq")
def gold_merged(spark: SparkSession, folder: str) -> DataFrame:
    return G.merged(G.valid(checked(spark, folder))).select("id", "file_name", "line_no", "question", "difficulty")


@query(f"{_CHECKED} select id, array_to_string(missing, ',') as missing from missing")
def gold_missing_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = G.missing_documents(G.merged(G.valid(checked(spark, folder))), corpus_ids(spark, folder))
    return found.select("id", F.array_join("missing", ",").alias("missing"))


@query(f"{_CHECKED} select id, difficulty from usable")
def gold_splittable(spark: SparkSession, folder: str) -> DataFrame:
    return G.splittable(G.merged(G.valid(checked(spark, folder))), corpus_ids(spark, folder)).select("id", "difficulty")


@query(f"""
    {_CHECKED}, r as (select id, difficulty, row_number() over (partition by difficulty order by md5('42:' || id)) as rn, count(*) over (partition by difficulty) as n from usable)
    select id, difficulty, case when n >= 5 and rn <= greatest(1, floor(n * 0.2)) then 'test' else 'dev' end as split from r
""")
def gold_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.splittable(G.merged(G.valid(checked(spark, folder))), corpus_ids(spark, folder)).select("id", "difficulty")
    return G.split(rows)


@query(f"{_CHECKED}, c as (select unnest([{{'field': 'author', 'value': author}}, {{'field': 'difficulty', 'value': difficulty}}, {{'field': 'category', 'value': category}}]) as x from uniq) select x.field as field, x.value as value, count(*) as n from c group by 1, 2")
def gold_counts(spark: SparkSession, folder: str) -> DataFrame:
    return G.counts_by(G.merged(G.valid(checked(spark, folder))), ["author", "difficulty", "category"])


@query(f"""
    {_CHECKED} select (select count(*) from rows) as total_raw, (select count(*) filter (len(errors) > 0) from checked) as total_errors, (select count(*) from uniq) as unique_by_id,
    (select count(*) from (select id from rows group by 1 having count(*) > 1)) as duplicate_ids, (select count(*) from (select lower(translate(trim(question), 'İI', 'iı')) from rows group by 1 having count(*) > 1)) as duplicate_questions,
    (select count(*) from missing) as rows_with_missing_doc_ids, (select count(*) from usable) as splittable
""")
def gold_report(spark: SparkSession, folder: str) -> DataFrame:
    return G.report(cut(checked(spark, folder)), corpus_ids(spark, folder))


@query("select lower(translate(trim(question), 'İI', 'iı')) as key, count(*) as copies from dev_omer where question is not null group by 1 having count(*) > 1")
def duplicate_questions(spark: SparkSession, folder: str) -> DataFrame:
    return repeated(table(spark, folder, "dev_omer").where("question is not null"), T.tr_lower(F.trim("question")))


@query("""
    with r as (select line_id, 'Yanıt:' || chr(10) || '```json' || chr(10) || line || chr(10) || '```' as reply from gold_lines where line is not null),
    p as (select line_id, regexp_extract(regexp_replace(reply, '```(?:json)?', '', 'g'), '(?s)\\{.*\\}') as part from r)
    select line_id, json_extract_string(case when part <> '' and json_valid(part) then part end, '$.id') as id from p
""")
def json_recovered(spark: SparkSession, folder: str) -> DataFrame:
    """Objects found again in replies that wrap them in fences and talk."""
    reply = F.concat(F.lit("Yanıt:\n```json\n"), F.col("line"), F.lit("\n```"))
    part = T.json_part(reply, array=False)
    return table(spark, folder, "gold_lines").where("line is not null").select("line_id", F.get_json_object(part, "$.id").alias("id"))


@query("select event_type, count(*) as n, round(avg(json_extract_string(props, '$.k')::double), 6) as mean_k, round(sum(value), 4) as total from events group by 1")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    parsed = table(spark, folder, "events").select("event_type", "value", F.from_json("props", "k double").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("p.k"), 6).alias("mean_k"), F.round(F.sum("value"), 4).alias("total"))
