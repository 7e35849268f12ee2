"""Queries over the articles: text functions, keys, codes, duplicates, segmentation, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import corpus as C
from lexspark.operators import ranking as R
from lexspark.plans.registry import CORPUS, INDEXING_TEXT, query, sql_tokens
from lexspark.session import spread, table


@query(f"select row_id, len({sql_tokens('metin')}) as n_tokens, len(list_distinct({sql_tokens('metin')})) as n_distinct from madde")
def tokenize_stats(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "madde").select("row_id", T.tokenize(F.col("metin")).alias("t"))
    return tokens.select("row_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"select term, count(*) as n, count(distinct row_id) as articles from (select row_id, unnest({sql_tokens('metin')}) as term from madde) group by 1")
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    terms = spread(table(spark, folder, "madde").select("row_id", "metin"), "row_id").select("row_id", F.explode(T.tokenize(F.col("metin"))).alias("term"))
    per_row = terms.groupBy("term", "row_id").agg(F.count("*").alias("n"))
    return per_row.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("articles"))


@query(f"select row_id, length({INDEXING_TEXT}) as n_chars, md5({INDEXING_TEXT}) as digest from madde")
def indexing_text(spark: SparkSession, folder: str) -> DataFrame:
    text = T.indexing_text(F.col("kanun_full"), F.col("madde_no"), F.col("baslik"), F.col("metin"))
    return table(spark, folder, "madde").select("row_id", text.alias("t")).select("row_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("select row_id, replace(kanun_short || '_m' || madde_no, ' ', '_') as built, replace(kanun_short || '_m' || madde_no, ' ', '_') = doc_id as same from madde")
def article_ids(spark: SparkSession, folder: str) -> DataFrame:
    madde = table(spark, folder, "madde").withColumn("built", T.article_id(F.col("kanun_short"), F.col("madde_no")))
    return madde.select("row_id", "built", (F.col("built") == F.col("doc_id")).alias("same"))


@query(f"with {CORPUS} select row_id, doc_id, kanun_short, madde_no, madde_type from corpus")
def corpus_first(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus(table(spark, folder, "madde")).select("row_id", "doc_id", "kanun_short", "madde_no", "madde_type")


@query("select doc_id as key, count(*) as copies from madde group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return C.repeated(table(spark, folder, "madde"), F.col("doc_id"))


@query("select md5(metin) as key, count(*) as copies from madde where metin is not null group by 1 having count(*) > 1")
def duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    return C.repeated(table(spark, folder, "madde").where("metin is not null"), F.md5("metin"))


@query("""
    select row_id, coalesce(l.short_name, m.kanun_short) as kanun_short,
        case when l.short_name is not null and m.kanun_short <> '' and starts_with(doc_id, m.kanun_short || '_') then l.short_name || substr(doc_id, length(m.kanun_short) + 1) else doc_id end as doc_id,
        l.short_name is not null as normalised
    from madde m left join law_metadata l on m.kanun_no = l.kanun_no
""")
def law_codes(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_law_codes(table(spark, folder, "madde"), table(spark, folder, "law_metadata")).select("row_id", "kanun_short", "doc_id", "normalised")


@query("select kanun_short, count(*) as articles, count(distinct doc_id) as ids, count(*) filter (kanun_no is null) as without_number, count(*) filter (baslik is null) as without_heading from madde group by 1")
def law_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").groupBy("kanun_short").agg(
        F.count("*").alias("articles"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("kanun_no").isNull()).alias("without_number"), F.count_if(F.col("baslik").isNull()).alias("without_heading")
    )


@query("""
    select l.short_name, l.madde_count, count(m.row_id) as rows, l.madde_count - count(distinct m.doc_id) as difference
    from law_metadata l left join madde m on m.kanun_short = l.short_name group by 1, 2
""")
def law_coverage(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "madde").groupBy(F.col("kanun_short").alias("short_name")).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))
    laws = table(spark, folder, "law_metadata").select("short_name", "madde_count")
    joined = laws.join(own, "short_name", "left")
    return joined.select("short_name", "madde_count", F.coalesce("rows", F.lit(0)).alias("rows"), (F.col("madde_count") - F.coalesce("ids", F.lit(0))).alias("difference"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(metin, '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]*\\d+[ \\t]*$', '', 'g'), '(?mi)^.{0,80}Sayfa[ \\t]*:[ \\t]*\\d+.*$', '', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(f"select row_id, length(t) as n_chars, md5(t) as digest from (select row_id, {_CLEAN} as t from madde)")
def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = table(spark, folder, "madde").select("row_id", T.clean_text(F.col("metin")).alias("t"))
    return cleaned.select("row_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))




_TAILS = [
    "(?i)(^|\\n)[ \\t]*\\(?[ \\t]*[IVX\\d]+[ \\t]*\\)?[ \\t]+SAYILI\\s+(CETVEL|L[İI]STE)",
    "(?m)^[ \\t]*Nokta No [yY] [xX][ \\t]*$",
    "(?i)KOORD[İI]NAT\\s+L[İI]STES[İI]",
    "(?i)\\d+\\s+SAYILI\\s+KANUNA\\s+EK\\s+VE\\s+DE[ĞG]İ[ŞS]İKLİK\\s+GETİREN",
    "(?i)Y[ÜU]R[ÜU]RL[ÜU][ĞG]E\\s+G[İI]R[İI][ŞS]\\s+TAR[İI]HLER[İI]N[İI]\\s+G[ÖO]STER[İI]R",
]


@query(f"""
    with cut as (select row_id, metin, least({", ".join(f"length(string_split(regexp_replace(metin, '{x}', chr(30), 'g'), chr(30))[1])" for x in _TAILS)}) as n from madde)
    select row_id, length(rtrim(left(metin, n), ' ' || chr(10))) as kept from cut
""")
def trimmed_tails(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").select("row_id", F.length(T.trim_tail(F.col("metin"))).cast("bigint").alias("kept"))


_PARTS = "string_split(regexp_replace(metin, '(?m)^[ \\t]*\\(\\d+\\)[ \\t]*', chr(30), 'g'), chr(30))"


@query(f"""
    with p as (select row_id, {_PARTS} as s from madde where metin is not null),
    q as (select row_id, list_filter([trim(x, ' ' || chr(10) || chr(9)) for x in case when len(s) > 1 then s[2:] else s end], lambda x: x <> '') as f from p)
    select row_id, len(f) as n, md5(array_to_string(f, '|')) as digest from q
""")
def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "madde").where("metin is not null").select("row_id", T.paragraphs(F.col("metin")).alias("f"))
    return own.select("row_id", F.size("f").cast("bigint").alias("n"), F.md5(F.array_join("f", "|")).alias("digest"))


_FIRST = "string_split(metin, chr(10))[1]"
_REST = f"trim(substr(metin, length({_FIRST}) + 2), ' ' || chr(10))"
_HEADED = f"{_FIRST} <> '' and length({_FIRST}) < 120 and not regexp_matches({_FIRST}, '^[ \\t]*\\(\\d+\\)')"


@query(f"""
    select row_id, case when {_HEADED} then trim({_FIRST}) end as heading,
        md5(case when {_HEADED} then case when {_REST} <> '' then {_REST} else trim({_FIRST}) end else metin end) as body
    from madde where metin is not null
""")
def headings(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "madde").where("metin is not null").select("row_id", T.heading_and_body(F.col("metin")).alias("x"))
    return own.select("row_id", "x.heading", F.md5("x.body").alias("body"))


_KIND = "lower(translate(trim({0}), 'İI', 'iı'))"


@query(f"""
    with m as (select row_id, case madde_type when 'gecici' then 'GEÇİCİ MADDE ' when 'ek' then 'EK MADDE ' else 'MADDE ' end || regexp_extract(madde_no, '(\\d+)', 1) as marker, madde_type, madde_no from madde)
    select row_id, case when {_KIND.format('marker')} like '%geçici%' then 'gecici' when {_KIND.format('marker')} like 'ek %' then 'ek' else 'normal' end as kind,
        case when {_KIND.format('marker')} like '%geçici%' then 'Geçici ' when {_KIND.format('marker')} like 'ek %' then 'Ek ' else '' end || regexp_extract(madde_no, '(\\d+)', 1) as label,
        madde_type as stored from m
""")
def marker_kinds(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("madde_no", r"(\d+)", 1)
    marker = F.concat(F.when(F.col("madde_type") == "gecici", "GEÇİCİ MADDE ").when(F.col("madde_type") == "ek", "EK MADDE ").otherwise("MADDE "), number)
    kinds = table(spark, folder, "madde").withColumn("kind", T.article_kind(marker))
    return kinds.select("row_id", "kind", T.number_label(F.col("kind"), number).alias("label"), F.col("madde_type").alias("stored"))


_MARKER = "(?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \\t]+)?(?:MADDE|Madde)[ \\t]+"
_NORMAL = "lower(translate(trim(marker), 'İI', 'iı'))"
_LINE = "string_split(kept, chr(10))[1]"
_AFTER = f"trim(substr(kept, length({_LINE}) + 2), ' ' || chr(10))"
_TITLED = f"{_LINE} <> '' and length({_LINE}) < 120 and not regexp_matches({_LINE}, '^[ \\t]*\\(\\d+\\)')"
_SEGMENTED = f"""
    with printed as (select row_id, case madde_type when 'gecici' then 'Geçici Madde ' when 'ek' then 'Ek Madde ' else 'Madde ' end || regexp_extract(madde_no, '(\\d+)', 1) || ' – ' || case when baslik <> '' then baslik || chr(10) else '' end || metin as metin from madde where metin <> ''),
    cleaned as (select row_id, string_split(regexp_replace({_CLEAN}, '(?m)^[ \\t]*({_MARKER}\\d+)', chr(30) || '\\1', 'g'), chr(30)) as parts from printed),
    parted as (select row_id, i - 2 as pos, parts[i] as part from (select row_id, parts, unnest(range(2, len(parts) + 1)) as i from cleaned)),
    marked as (select row_id, pos, regexp_extract(part, '^[ \\t]*({_MARKER}\\d+)', 1) as marker, regexp_extract(part, '^[ \\t]*{_MARKER}(\\d+)', 1) as no, trim(regexp_replace(part, '^[ \\t]*{_MARKER}\\d+[ \\t\\n.–-]*', ''), ' ' || chr(10)) as metin from parted),
    cut as (select *, rtrim(left(metin, least({", ".join(f"length(string_split(regexp_replace(metin, '{x}', chr(30), 'g'), chr(30))[1])" for x in _TAILS)})), ' ' || chr(10)) as kept from marked),
    segmented as (select row_id, pos::int as pos, case when {_NORMAL} like '%geçici%' or {_NORMAL} like '%gecici%' then 'gecici' when {_NORMAL} like 'ek %' then 'ek' else 'normal' end as madde_type, no,
        case when {_TITLED} then trim({_LINE}) end as baslik, case when {_TITLED} then case when {_AFTER} <> '' then {_AFTER} else trim({_LINE}) end else kept end as metin from cut)
"""
_LABEL = "case madde_type when 'gecici' then 'Geçici ' when 'ek' then 'Ek ' else '' end || no as madde_no"


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    """Every article with a text, printed as a law prints it and parsed: page furniture, tables,
    markers within the text, long and missing headings included."""
    madde = spread(table(spark, folder, "madde").where("metin <> ''"), "row_id")
    return C.segment(madde.withColumn("law", C.render(madde)).select("row_id", "law"), "row_id", "law")


@query(f"{_SEGMENTED} select row_id, pos, {_LABEL}, madde_type, baslik, md5(metin) as metin from segmented where metin <> ''")
def segment_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _segmented(spark, folder).select("row_id", "pos", "madde_no", "madde_type", "baslik", F.md5("metin").alias("metin"))


@query(f"""
    {_SEGMENTED}, s as (select *, {_PARTS} as s from segmented where metin <> ''),
    q as (select *, list_filter([trim(x, ' ' || chr(10) || chr(9)) for x in case when len(s) > 1 then s[2:] else s end], lambda x: x <> '') as f from s)
    select row_id, pos, {_LABEL}, madde_type, baslik, md5(metin) as metin, len(f) as n_fikra, md5(array_to_string(f, '|')) as fikralar from q
""")
def segment_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the numbered paragraphs of each article."""
    return _segmented(spark, folder).select("row_id", "pos", "madde_no", "madde_type", "baslik", F.md5("metin").alias("metin"), F.size("fikralar").cast("bigint").alias("n_fikra"), F.md5(F.array_join("fikralar", "|")).alias("fikralar"))


@query("""
    with c as (select doc_id, string_split(regexp_replace(text, '(?m)^[ \\t]*((?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \\t]+)?(?:MADDE|Madde)[ \\t]+\\d+)', chr(30) || '\\1', 'g'), chr(30)) as s from documents where text is not null),
    u as (select doc_id, s, unnest(range(2, len(s) + 1)) as i from c)
    select doc_id, (i - 2)::int as pos, regexp_extract(s[i], '^[ \\t]*(?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \\t]+)?(?:MADDE|Madde)[ \\t]+(\\d+)', 1) as number from u
""")
def document_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles quoted in documents: every line that begins with an article marker."""
    parts = F.split(F.regexp_replace("text", T.ARTICLE_START, "\x1e$1"), "\x1e")
    marked = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).alias("pos", "part"))
    return marked.select("doc_id", "pos", F.regexp_extract("part", T.ARTICLE_MARKER, 2).alias("number"))


@query("select length(metin) as n_chars, count(*) as articles from madde where metin is not null group by 1")
def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").where("metin is not null").groupBy(F.length("metin").cast("bigint").alias("n_chars")).agg(F.count("*").alias("articles"))


@query("""
    with s as (select length(metin) as v, row_number() over (order by length(metin)) - 1 as i, count(*) over () as n from madde where metin is not null)
    select share, v as value from s, (select unnest([0.5, 0.9, 0.95, 0.99])::double as share) where i = floor(n * share)
""")
def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    found = R.nearest_rank(table(spark, folder, "madde"), F.length("metin").cast("bigint"), [0.5, 0.9, 0.95, 0.99])
    return found.select("share", "value")


@query("select kanun_short, count(*) as n, round(avg(length(metin)), 4) as mean_chars, round(quantile_cont(length(metin), 0.5), 4) as median_chars, round(quantile_cont(length(metin), 0.9), 4) as p90_chars, max(length(metin)) as most_chars from madde group by 1")
def length_by_law(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("metin")
    return table(spark, folder, "madde").groupBy("kanun_short").agg(
        F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(F.percentile(n, 0.5), 4).alias("median_chars"), F.round(F.percentile(n, 0.9), 4).alias("p90_chars"), F.max(n).cast("bigint").alias("most_chars")
    )


@query("select row_id, kanun_short, length(metin) as n_chars from madde where length(metin) between 100 and 4000")
def length_range(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").where(F.length("metin").between(100, 4000)).select("row_id", "kanun_short", F.length("metin").cast("bigint").alias("n_chars"))


_FOLD = "((((('0x' || substr(md5(doc_id), 1, 8))::bigint % 7 * 4294967296 + ('0x' || substr(md5(doc_id), 9, 8))::bigint) % 7 * 4294967296 + ('0x' || substr(md5(doc_id), 17, 8))::bigint) % 7 * 4294967296 + ('0x' || substr(md5(doc_id), 25, 8))::bigint) % 7)"


@query(f"select row_id, {_FOLD} as shard from madde")
def md5_shards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "madde").select("row_id", T.md5_bucket(F.col("doc_id"), 7).alias("shard"))


@query("select row_id, doc_id from madde order by md5('42:' || row_id), row_id limit 500")
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return R.hash_sample(table(spark, folder, "madde").select("row_id", "doc_id"), F.col("row_id"), 500)


@query("""
    with r as (select row_id, kanun_short, row_number() over (partition by kanun_short order by md5('42:' || row_id)) as rn, 800 // (select count(distinct kanun_short) from madde) as each from madde),
    first as (select * from r where rn <= each), rest as (select * from r where rn > each)
    select row_id, kanun_short from first union all
    (select row_id, kanun_short from rest order by md5('42:' || row_id), row_id limit (800 - (select count(*) from first)))
""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return R.stratified_sample(table(spark, folder, "madde").select("row_id", "kanun_short"), "kanun_short", F.col("row_id"), 800)


@query("""
    with r as (select qa_id, difficulty, row_number() over (partition by difficulty order by md5('42:' || qa_id)) as rn, count(*) over (partition by difficulty) as n from synthetic_qa)
    select qa_id, difficulty, case when n >= 5 and rn <= greatest(1, floor(n * 0.2)) then 'test' else 'dev' end as split from r
""")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return R.stratified_split(table(spark, folder, "synthetic_qa").select("qa_id", "difficulty"), "difficulty", F.col("qa_id"))


@query("""
    with r as (select qa_id, kanun_short, row_number() over (partition by kanun_short order by md5('7:' || qa_id)) as rn, count(*) over (partition by kanun_short) as n from synthetic_qa)
    select qa_id, kanun_short, case when rn <= greatest(1, floor(n * 0.1)) then 'test' else 'dev' end as split from r
""")
def law_split(spark: SparkSession, folder: str) -> DataFrame:
    return R.stratified_split(table(spark, folder, "synthetic_qa").select("qa_id", "kanun_short"), "kanun_short", F.col("qa_id"), 0.1, 1, 7)


@query("select doc_id, kanun_short, lang, source from documents where kanun_short is null or kanun_short not in (select short_name from law_metadata)")
def documents_without_law(spark: SparkSession, folder: str) -> DataFrame:
    laws = table(spark, folder, "law_metadata").select(F.col("short_name").alias("kanun_short"))
    return table(spark, folder, "documents").join(laws, "kanun_short", "left_anti").select("doc_id", "kanun_short", "lang", "source")
