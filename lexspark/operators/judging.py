"""Faithfulness of answers to their sources: parsing of verdicts, scores, and a judge to test with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import scores as S
from lexspark.functions import text as T

CLAIMS = "struct<claims:array<struct<claim:string,verdict:string,reason:string>>,faithfulness:double>"
SUPPORTED, PARTIAL = 0.8, 0.4


#: What a judge is told, before the question, the answer and the sources, and at the end.
JUDGE_PROMPT = (
    "Cevaptaki her iddiayı yalnızca kaynaklara göre SUPPORTED, PARTIAL veya UNSUPPORTED olarak değerlendir.\n\nSoru: ",
    "\n\nCevap:\n",
    "\n\nKaynaklar:\n",
    '\n\nYalnızca JSON döndür: {"claims": [{"claim": "", "verdict": "", "reason": ""}]}',
)
JUDGE_CHARS = 6000


def judge_prompt(question: Column, answer: Column, sources: Column, limit: int = JUDGE_CHARS) -> Column:
    """What a judge is asked; the sources are cut, null parts are empty."""
    a, b, c, d = map(F.lit, JUDGE_PROMPT)
    text = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(a, text(question), b, text(answer), c, F.left(text(sources), F.lit(limit)), d)


def judged(reply: Column) -> Column:
    """struct(faithfulness, claims, error) of a judge's reply. The score is computed from the
    verdicts, never taken from the reply; a reply without JSON or claims has a null score."""
    parsed = F.from_json(T.json_part(reply, array=False), CLAIMS)
    claims = parsed["claims"]
    error = F.when(parsed.isNull() | claims.isNull(), "parse_failed").when(F.size(claims) == 0, "no_claims")
    return F.struct(S.claim_score(claims).alias("faithfulness"), claims.alias("claims"), error.alias("error"))


def claims_of(answer: Column) -> Column:
    """The sentences of an answer without its citations."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[[^\]]*\]", "")
    return F.filter(F.transform(F.split(bare, r"[.!?]+\s*"), lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def overlap_verdicts(answer: Column, source: Column) -> Column:
    """A judge to test with: a claim is supported by the share of its tokens that the source has."""

    def verdict(claim: Column, have: Column) -> Column:
        share = T.let(F.array_distinct(T.tokenize(claim)), lambda own: F.coalesce(F.size(F.array_intersect(own, have)) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0)))
        return T.let(share, lambda s: F.struct(claim.alias("claim"), F.when(s >= SUPPORTED, "SUPPORTED").when(s >= PARTIAL, "PARTIAL").otherwise("UNSUPPORTED").alias("verdict")))

    return T.let(F.array_distinct(T.tokenize(source)), lambda have: F.transform(claims_of(answer), lambda claim: verdict(claim, have)))


def summary(scored: DataFrame, by: list[str], score: str = "faithfulness") -> DataFrame:
    """Rows, scored rows, rows without a score, and the mean."""
    return scored.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count(score).alias("n_scored"), F.count_if(F.col(score).isNull()).alias("n_unscored"), F.round(F.avg(score), 6).alias("mean_faithfulness"))


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
