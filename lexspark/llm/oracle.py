"""SQL of the numbered problems that plain SQL can state exactly, by brute force."""

from __future__ import annotations


def sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower(translate(coalesce({x}, ''), 'İIı', 'iii')), '[\p{{L}}\p{{N}}]+')"


def sql_folded(x: str) -> str:
    return rf"regexp_replace(lower(translate(coalesce({x}, ''), 'İIı', 'iii')), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_GRAMS = "select distinct {keys}, array_to_string(w[i:i + 7], ' ') as g from (select {keys}, w, unnest(range(1, len(w) - 6)) as i from {source} where len(w) >= 8)"

_ITEMS = """
    select 'metin' as src, row_id, 0 as pos, metin as text from madde
    union all select 'fikralar', row_id, (i - 1)::int, fikralar[i] from (select row_id, fikralar, unnest(range(1, len(fikralar) + 1)) as i from madde)
    union all select 'hit', hit_id, 0, text from hit
"""
_OVERLAPS = f"""
        with e as (select split, eval_id, coalesce(gold_doc_ids, []) as gold, list_distinct({sql_words('question')}) as a from (
            select 'dev' as split, row_id as eval_id, question, gold_doc_ids from dev_omer union all select 'test', row_id, question, gold_doc_ids from test_full)),
        t as (select qa_id as train_id, source_doc_id, kanun_short, list_distinct({sql_words('question')}) as b from synthetic_qa),
        found as (select split, eval_id, train_id, kanun_short from e join t on len(gold) = 0 or list_contains(gold, source_doc_id)
            where len(a) > 0 and len(b) > 0 and 10 * len(list_intersect(a, b)) >= 7 * (len(a) + len(b) - len(list_intersect(a, b))))
"""
_RECORDS = """
        with r as (select 'dev_omer' as src, row_id as row, id, question from dev_omer
            union all select 'gold_lines', line_id, json_extract_string(line, '$.id'), json_extract_string(line, '$.question') from gold_lines
                where json_valid(line) and json_type(case when json_valid(line) then line end) = 'OBJECT')
"""

ORACLE: dict[str, str] = {
    "p1_found": """
        select 'metin' as src, row_id, 0 as pos from madde where length(metin) > 1500
        union all
        select 'fikralar', row_id, (i - 1)::int from (select row_id, fikralar, unnest(range(1, len(fikralar) + 1)) as i from madde) where length(fikralar[i]) > 1500
        union all
        select 'hit', hit_id, 0 from hit where length(text) > 1500
    """,
    "p1_check": f"select src, row_id, pos, md5(text) as digest, true as within, true as overlapping from ({_ITEMS}) where text is not null",
    "p2_report": f"{_OVERLAPS} select split, kanun_short, count(*) as pairs, count(distinct eval_id) as questions, count(distinct train_id) as training_rows from found group by 1, 2",
    "p6_records": f"{_RECORDS} select src, min(row) as first_id, count(*) as copies from r group by src, {sql_folded('id')}, {sql_folded('question')}",
    "p9_check": "select doc_id, true as whole, true as fits from documents where text is not null",
    "p2_found": f"""
        with e as (select split, eval_id, coalesce(gold_doc_ids, []) as gold, list_distinct({sql_words('question')}) as a from (
            select 'dev' as split, row_id as eval_id, question, gold_doc_ids from dev_omer union all select 'test', row_id, question, gold_doc_ids from test_full)),
        t as (select qa_id as train_id, source_doc_id, list_distinct({sql_words('question')}) as b from synthetic_qa)
        select split, eval_id, train_id from e join t on len(gold) = 0 or list_contains(gold, source_doc_id)
        where len(a) > 0 and len(b) > 0 and 10 * len(list_intersect(a, b)) >= 7 * (len(a) + len(b) - len(list_intersect(a, b)))
    """,
    "p4_found": f"""
        with items as (select row_id as item_id, {sql_words('t')} as w from (select row_id, unnest([question, regexp_replace(answer, '\\[[^\\[\\]]*\\]', ' ', 'g')]) as t from test_full)),
        texts as (select 'documents' as src, doc_id as text_id, {sql_words('text')} as w from documents
            union all select 'synthetic_qa', qa_id, {sql_words('t')} from (select qa_id, unnest([question, answer]) as t from synthetic_qa)),
        ig as ({_GRAMS.format(keys='item_id', source='items')}), tg as ({_GRAMS.format(keys='src, text_id', source='texts')})
        select distinct item_id, src, text_id from ig join tg using (g)
    """,
    "p4_passages": f"""
        with items as (select item_id, w, row_number() over () as p from (select distinct row_id as item_id, {sql_words('t')} as w
            from (select row_id, unnest([question, regexp_replace(answer, '\\[[^\\[\\]]*\\]', ' ', 'g')]) as t from test_full)) where len(w) >= 8),
        texts as (select *, {sql_words('text')} as w, row_number() over () as t from (select 'documents' as src, doc_id as text_id, text from documents
            union all select 'synthetic_qa', qa_id, unnest([question, answer]) from synthetic_qa)),
        gaps as (select t, unnest(range(1, len(w) + 1)) as k, unnest(w) as word, unnest(regexp_split_to_array(lower(translate(text, 'İIı', 'iii')), '[\\p{{L}}\\p{{N}}]+')[:len(w)]) as gap from texts where len(w) >= 8),
        places as (select t, k, (sum(length(gap) + length(word)) over (partition by t order by k))::int as upto, length(word) as n from gaps),
        ig as (select p, i, array_to_string(w[i:i + 7], ' ') as g from (select p, w, unnest(range(1, len(w) - 6)) as i from items)),
        tg as (select t, a, array_to_string(w[a:a + 7], ' ') as g from (select t, w, unnest(range(1, len(w) - 6)) as a from texts where len(w) >= 8)),
        met as (select t, p, a, a - i as shift, a - row_number() over (partition by t, p, a - i order by a) as run from ig join tg using (g)),
        runs as (select t, p, min(a) as a, max(a) + 7 as b from met group by t, p, shift, run)
        select src, text_id, item_id, (x.upto - x.n)::int as start, y.upto as "end" from runs join items using (p) join texts using (t)
            join places x on x.t = runs.t and x.k = runs.a join places y on y.t = runs.t and y.k = runs.b
    """,
    "p6_found": f"""
        with r as (select 'dev_omer' as src, row_id as row, id, question from dev_omer
            union all select 'gold_lines', line_id, json_extract_string(line, '$.id'), json_extract_string(line, '$.question') from gold_lines
                where json_valid(line) and json_type(case when json_valid(line) then line end) = 'OBJECT'),
        k as (select src, row, min(row) over (partition by src, {sql_folded('id')}, {sql_folded('question')}) as first_id from r)
        select src, first_id, row as copy_id from k where row <> first_id
    """,
}
