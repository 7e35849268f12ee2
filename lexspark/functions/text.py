"""Column functions over Turkish statute text. All stay in the JVM but normalize_tr on text that
needs Unicode compatibility forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the retrieval tokenizer, and the class of the metric tokenizer.
RETRIEVAL_TOKEN = "([a-zçğıöşüâîû0-9]+)"
METRIC_TOKEN = r"([\p{L}\p{N}_]+)"

# Article and paragraph markers at the start of a line.
ARTICLE_START = r"(?m)^[ \t]*((?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \t]+)?(?:MADDE|Madde)[ \t]+\d+)"
ARTICLE_MARKER = r"^[ \t]*((?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \t]+)?(?:MADDE|Madde)[ \t]+(\d+))[ \t\n.–-]*"
PARAGRAPH_START = r"(?m)^[ \t]*\(\d+\)[ \t]*"
# Lines of page furniture that plain cleaning drops.
PAGE_LINE = r"(?m)^[ \t]*\d+[ \t]*$"
PAGE_LABEL = r"(?mi)^.{0,80}Sayfa[ \t]*:[ \t]*\d+.*$"
# Headings of tables that hang on after the last article of a law. Blanks at a line's begin
# are spaces and tabs alone, so that a match starts on the line it is found on and no empty line goes with it.
TAIL_MARKERS = [
    r"(?i)\d+\s+SAYILI\s+KANUNA\s+EK\s+VE\s+DE[ĞG]İ[ŞS]İKLİK\s+GETİREN",
    r"(?i)(^|\n)[ \t]*\(?[ \t]*[IVX\d]+[ \t]*\)?[ \t]+SAYILI\s+(CETVEL|L[İI]STE)",
    r"(?i)KOORD[İI]NAT\s+L[İI]STES[İI]",
    r"(?m)^[ \t]*Nokta No [yY] [xX][ \t]*$",
    r"(?i)Y[ÜU]R[ÜU]RL[ÜU][ĞG]E\s+G[İI]R[İI][ŞS]\s+TAR[İI]HLER[İI]N[İI]\s+G[ÖO]STER[İI]R",
]
# Fixed value: a citation, law and article in brackets.
CITATION = r"\[\s*([A-Za-zÇĞİÖŞÜçğıöşü0-9]+)\s+m\.?\s*([0-9A-Za-zçğıöşü/\-]+)\s*\]"

HEADING_LIMIT = 120


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def tr_lower(text: Column) -> Column:
    """Lower case with İ to i and I to ı."""
    return F.lower(F.translate(text, "İI", "iı"))


def tokenize(text: Column) -> Column:
    """Tokens of the retrieval index; empty for null."""
    return F.regexp_extract_all(tr_lower(F.coalesce(text, F.lit(""))), F.lit(RETRIEVAL_TOKEN), 1)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, outer space gone."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _nfkc(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())

    return run(text)


#: Text of these characters alone is its own compatibility form.
SETTLED = r"^[\x00-\x7eçğıöşüÇĞİÖŞÜâîûÂÎÛ“”‘’–—§°«»]*$"


def normalize_tr(text: Column) -> Column:
    """Compatibility form, Turkish lower case, white space collapsed; null gives the empty text."""
    value = F.coalesce(text, F.lit(""))
    settled = F.when(value.rlike(SETTLED), value).otherwise(_nfkc(F.when(~value.rlike(SETTLED), value)))
    return collapse(tr_lower(settled))


def tokens(text: Column) -> Column:
    """Tokens of the answer metrics."""
    return F.regexp_extract_all(normalize_tr(text), F.lit(METRIC_TOKEN), 1)


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by a space."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def term_frequencies(words: Column) -> Column:
    """array<struct<term,tf>> of the distinct words, counted within the row."""

    def runs(w: Column) -> Column:
        first = F.filter(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
        return let(first, lambda starts: F.transform(starts, lambda s, k: F.struct(F.element_at(w, s).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(w) + 1) - s).alias("tf"))))

    return let(F.sort_array(words), runs)


def indexing_text(title: Column, number: Column, heading: Column, body: Column) -> Column:
    """What is indexed of an article: law, number, heading, body, empty parts left out."""
    parts = [title, F.concat(F.lit("Madde "), F.coalesce(number, F.lit(""))), heading, body]
    return F.trim(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def prefixed(text: Column, role: str, model: str) -> Column:
    """With the role an asymmetric encoder expects, for models named e5."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model else text


def article_id(law: Column, number: Column) -> Column:
    return F.replace(F.concat(law, F.lit("_m"), number), F.lit(" "), F.lit("_"))


def clean_text(text: Column) -> Column:
    """Without page numbers and page labels; line ends, blanks and empty lines evened out."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern in (PAGE_LINE, PAGE_LABEL):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n"))


def trim_tail(text: Column) -> Column:
    """Cut at the earliest heading of a table that hangs on after the last article."""

    def cut(x: Column) -> Column:
        at = [F.nullif(F.regexp_instr(x, F.lit(p)), F.lit(0)) for p in TAIL_MARKERS]
        return F.rtrim(F.coalesce(F.left(x, F.least(*at) - 1), x), F.lit(" \n"))

    return let(text, cut)


def paragraphs(text: Column) -> Column:
    """The numbered paragraphs of an article; the whole text if it has no number; empties dropped."""
    marked = F.split(F.regexp_replace(text, PARAGRAPH_START, "\x1e"), "\x1e")
    parts = let(marked, lambda m: F.when(F.size(m) > 1, F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(m))
    return F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(" \n\t"))), lambda p: p != "")


def article_kind(marker: Column) -> Column:
    """gecici, ek or normal. Upper case is lowered the Turkish way, so GEÇİCİ counts."""
    low = tr_lower(F.trim(marker))
    return F.when(low.contains("geçici") | low.contains("gecici"), "gecici").when(low.startswith("ek "), "ek").otherwise("normal")


def article_kind_compat(marker: Column) -> Column:
    """As published code has it: plain lower case, which misses GEÇİCİ in capitals."""
    dotted = F.replace(F.lower(F.replace(F.trim(marker), F.lit("İ"), F.lit("\x01"))), F.lit("\x01"), F.lit("i̇"))
    return F.when(dotted.contains("geçici") | dotted.contains("gecici"), "gecici").when(dotted.startswith("ek "), "ek").otherwise("normal")


def number_label(kind: Column, number: Column) -> Column:
    return F.concat(F.when(kind == "gecici", "Geçici ").when(kind == "ek", "Ek ").otherwise(""), number)


def heading_and_body(text: Column) -> Column:
    """struct(heading, body): a short first line that is no paragraph is the heading; if nothing
    follows it is the body as well."""

    def parts(x: Column) -> Column:
        first = F.substring_index(x, "\n", 1)
        rest = F.trim(F.substr(x, F.length(first) + 2), F.lit(" \n"))
        is_heading = (first != "") & (F.length(first) < HEADING_LIMIT) & ~first.rlike(r"^[ \t]*\(\d+\)")
        heading = F.trim(first)
        body = F.when(is_heading, F.when(rest != "", rest).otherwise(heading)).otherwise(x)
        return F.struct(F.when(is_heading, heading).alias("heading"), body.alias("body"))

    return let(text, parts)


def citations(text: Column) -> Column:
    """Distinct law|article pairs cited in a text, normalised."""
    value = F.coalesce(text, F.lit(""))
    laws, numbers = (F.regexp_extract_all(value, F.lit(CITATION), i) for i in (1, 2))
    return F.array_distinct(F.zip_with(laws, numbers, lambda a, b: F.concat(tr_lower(a), F.lit("|"), F.lower(b))))


def citation_keys(pairs: Column, article_level: bool = False) -> Column:
    """Gold pairs (law, article) in the form of citations(); article_level cuts paragraph numbers.
    Pairs of other lengths and null pairs are left out."""
    usable = F.filter(F.coalesce(pairs, F.array()), lambda p: p.isNotNull() & (F.size(p) == 2))
    number = lambda p: F.substring_index(p[1], "/", 1) if article_level else p[1]
    return F.array_distinct(F.transform(usable, lambda p: F.concat(tr_lower(F.trim(p[0])), F.lit("|"), F.lower(F.trim(number(p))))))


def citation_keys_compat(pairs: Column) -> Column:
    """Gold pairs lower-cased the plain way first, as published code does: I becomes i there and ı
    in predictions."""
    usable = F.filter(F.coalesce(pairs, F.array()), lambda p: p.isNotNull() & (F.size(p) == 2))
    return F.array_distinct(F.transform(usable, lambda p: F.concat(F.lower(F.translate(p[0], "İ", "i")), F.lit("|"), F.lower(p[1]))))


def id_array(value: Column) -> Column:
    """An array of ids from JSON text that is an array of strings or one bare string; empty for null
    and for the empty text."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    return F.when(bare.startswith("["), F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>"))).when(bare == "", F.array().cast("array<string>")).otherwise(F.array(bare))


def json_part(text: Column, array: bool) -> Column:
    """The JSON array or object in a model's reply, without fences and talk; null if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    part = F.regexp_extract(bare, r"(?s)\[.*\]" if array else r"(?s)\{.*\}", 0)
    return F.when((part != "") & F.try_parse_json(part).isNotNull(), part)


def md5_bucket(key: Column, n: int) -> Column:
    """md5(key) modulo n, folded over four parts so that nothing overflows; n below 2^31."""
    digest = F.md5(key)
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda h, v: (h * 4294967296 + v) % n)


def number_or_dash(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise(F.lit("—"))
