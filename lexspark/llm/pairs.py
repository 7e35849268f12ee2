"""Answers that are no proper answers to their questions (problem 5).

Each response is compressed with its prompt as a raw-content zstandard dictionary. What it takes
beyond the prompt repeated is what the response says of its own: next to nothing makes a copy, much
makes none, and in between the words decide. Refusals are found by a dictionary of phrases and of
first-person refusing verb endings, other languages by the per-language dictionaries of problem 10.
Whether the last sentence of an answer is finished is told by a model of terminal contexts counted
over all answers: how often a word, or else its ending, stands at the end of a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.characters import consistent
from lexspark.llm.languages import ODD, _classifier, prepared
from lexspark.llm.words import CITATION, fold, words_of
from lexspark.operators.ranking import join_groups
from lexspark.session import stored

CITED = re.compile(CITATION)
COPY_LEVEL = 3
OWN_BYTES, NEAR_SHARE = 2, 0.3  # a copy has no more bytes, a near copy no greater share of its bytes, of its own
LEAD_WORDS, LEAD_BYTES = 6, 8  # a lead-in, and what coding it takes beyond its letters
LEAST_COPIED = 5  # words of a question of which one may be exchanged in a near copy
LEAST_WORDS, LEAST_ENDINGS, ENDING = 5, 20, 4
# Words that ask; all i are one letter.
ASKING = re.compile(r"(?:m[iuü](?:dir|dür|dur|yim|yiz|sin|siniz)?|ne(?:dir|ler|lerdir|den|rede|reye|yi|ye|yin)?|niçin|niye|kim(?:dir|ler|e|i|in)?|hangi(?:si|leri)?|kaç|nasil(?:dir)?)$")

def plain(text: str) -> str:
    """Folded and without Turkish accents, as the phrases are written."""
    return text.translate(str.maketrans("çğöşüâîûéèñ", "cgosuaiueen"))


# Phrases of declining; all i are one letter here, as in the texts they are held against.
REFUSALS = """
cevabim yok; yanitim yok; yanlis yerdesiniz; yorum beklemeyin; cevap beklemeyin; kapsamiyor; kapsamim disinda; yetkim disinda; uzmanlik alanim disinda
dogru olur; uygun olmaz; mumkun degil; bilgi sahibi degilim; bilgim yok; bilgiye sahip degilim; fikrim yok; emin degilim; durumda degilim; yetkili degilim
kacinmak zorundayim; reddetmek zorundayim; ele almayacagim; yanitlamayacagim; cevaplamayacagim; girmeyecegim; cevap uretemedim; yanit uretemedim; bulamadim; cevaplayamiyorum
cevap veremem; yanit veremem; yardimci olamam; yardimci olamiyorum; bir sey soyleyemem; bir sey yazamiyorum; bilemiyorum; bilmiyorum; ilgilenmiyorum; yorum yapamam; gorus bildiremem
""".replace("\n", ";").split(";")  # fmt: skip
# The same in the other languages.
REFUSALS += """
i cannot answer; i can't; i can not; i am unable; i'm unable; i'm sorry; i am sorry; i do not know; as an ai; as a language model
es tut mir leid; ich weiss es nicht; ich kann diese frage nicht beantworten; ich kann dazu nichts sagen; ich kann ihnen dabei nicht helfen; als sprachmodell; als ki
je suis désolé; je ne sais pas; je ne peux pas répondre; je ne suis pas en mesure de répondre; en tant que modèle de langage; en tant qu'ia
lo siento; no lo sé; no puedo responder; no puedo contestar; no puedo ayudarle; como modelo de lenguaje; como ia
üzr istəyirəm; bilmirəm; cavab verə bilmirəm; cavab verə bilmərəm; kömək edə bilmirəm; kömək edə bilmərəm; dil modeli olaraq
""".replace("\n", ";").split(";")  # fmt: skip
#: Phrases that decline only where the speaker speaks of itself.
WEAK = {"dogru olur", "uygun olmaz", "mumkun degil", "kapsamiyor", "yorum beklemeyin", "cevap beklemeyin"}
REFUSAL = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(plain(x.strip())) for x in REFUSALS if x.strip() and x.strip() not in WEAK) + r")(?!\w)")
# Endings of first-person verbs that decline, and openings of apology.
FIRST_PERSON = re.compile(r"\w(?:[ae]m[ae]m|m[iuü]yorum|m[ae]yaca[ğg]im|m[ae]yece[ğg]im|[ae]m[ae]dim|m[ae]m|mesem|masam)(?!\w)|(?<!\w)(?:değilim|degilim|zorundayim|benden|yetkim)(?!\w)")
APOLOGY = re.compile(r"(?<!\w)(?:üzgünüm|özür dilerim|kusura bakmayin|maalesef|ne yazik ki|bir dil modeli|yapay zek[âa]|olduğum için)(?!\w)")
WEAK_PHRASE = re.compile("|".join(sorted(WEAK)))
LEADING = re.compile(r"^\W*(?:evet|hayir|yes|no|ja|nein|oui|non|sí|si|bəli|xeyr)(?!\w)[\s.,;:!–-]*")
# An answer that is a span of time alone, and abbreviations that end no sentence.
SPAN = re.compile(r"^\W*(?:\d+|(?:[^\W\d]+ ){0,2}[^\W\d]+)\s+(?:iş günü|gün|hafta|ay|yil|saat|dakika)\W*$")
ABBREVIATION = re.compile(r"(?<!\w)(?:m|no|s|vb|bkz|md)\.$")
TOKEN = re.compile(r"[^\W_]+(?:[/.][^\W_]+)*")
END = re.compile(r"[.!?…]+[\"”’)]*(?:\s+(?=[^\W\da-zçğıöşü_]|[\"“(\[])|\s*$)")
REMARK = re.compile(r"\s*\([^()]*\)\s*$")
LAST_CITATIONS = re.compile(rf"(?:\s*{CITATION}[\s.,;:!?]*)+$")


def refuses(folded: str) -> bool:
    bare = plain(folded)
    if REFUSAL.search(bare):
        return True
    speaks = FIRST_PERSON.search(folded) or APOLOGY.search(folded)
    return bool(speaks and (APOLOGY.search(folded) or WEAK_PHRASE.search(bare) or re.search(r"soru|cevap|yanit|yorum|görüş|bilgi|konu|istek|talep", folded)))


def packed_size(text: bytes, prompt: bytes) -> int:
    """Bytes of a text compressed with the prompt as its dictionary."""
    d = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=COPY_LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(text))


def as_bytes(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "replace")


def copies(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question, once or more, formatting, citations and a
    lead-in aside. An answer with a few letters of its own is one too if it still asks all the
    question asks: a word exchanged for another is no answer unless it stands for what was asked."""
    question, answer = (consistent(t) if ODD.search(t) else t for t in (question, answer))
    q, a = words_of(question), words_of(CITED.sub(" ", answer))
    if not q or 2 * len(a) < len(q):
        return False
    prompt, times = as_bytes(q), max(1, len(a) // len(q))
    lead = min(LEAD_WORDS, len(q) - 1, max(0, len(a) - times * len(q)))
    own = packed_size(as_bytes(a), prompt) - packed_size(as_bytes(q * times), prompt)
    if own > max(NEAR_SHARE * len(as_bytes(a)), len(as_bytes(a[:lead])) + LEAD_BYTES):
        return False
    if own <= OWN_BYTES and packed_size(prompt, as_bytes(a)) - packed_size(as_bytes(a), as_bytes(a)) <= OWN_BYTES:
        return True
    if len(a) >= len(q) and len(a) % len(q) <= lead and a[len(a) % len(q) :] == q * times:
        return True
    body = a[lead:] if len(a) - lead >= len(q) else a
    changed = sum((Counter(body) - Counter(q * times)).values())
    return len(body) == len(q) * times and len(q) >= LEAST_COPIED and changed <= times and all(w in body for w in q if ASKING.match(w)) and any(ASKING.match(w) for w in q)


def token_key(before: str, word: str) -> str:
    """A word as a terminal context; a number counts with the word before it."""
    return f"{before} #" if word[0].isdigit() else word


def contexts(answer: str) -> Iterator[tuple[str, bool | None]]:
    """(context, whether a sentence ends there) of every word; None before a citation and at the
    end of the answer where no sign says so."""
    ends = [m.start() for m in END.finditer(answer)]
    folded, k, before = fold(answer), 0, ""
    hidden = [m.span() for m in CITED.finditer(answer)]
    tokens = [m for m in TOKEN.finditer(folded) if not any(a <= m.start() < b for a, b in hidden)]
    for m, after in zip(tokens, [*tokens[1:], None]):
        upto = after.start() if after else len(answer)
        while k < len(ends) and ends[k] < m.end():
            k += 1
        ended = k < len(ends) and ends[k] < upto and "[" not in folded[m.end() : ends[k]] and not ABBREVIATION.search(folded[max(0, m.end() - 4) : m.end() + 1])
        yield token_key(before, m.group()), True if ended else None if after is None or "[" in folded[m.end() : upto] else False
        before = m.group()


def body_of(answer: str) -> str:
    """Without citations and a bracketed remark at the end."""
    return REMARK.sub("", CITED.sub("", LAST_CITATIONS.sub("", answer)))


def unfinished_shape(answer: str) -> bool | None:
    """True and False if the signs at the end tell, else None: the last word decides."""
    body = body_of(answer)
    if "[" in body or body.count("(") > body.count(")") or body.count("“") > body.count("”"):
        return True
    tail = body.rstrip("\"”’)*_ \t\r\n\u00a0")
    if tail.endswith(("...", "…")):
        return None
    if tail.endswith((",", ";", ":", "-", "–", "(", "“")):
        return True
    if tail.endswith((".", "!", "?")):
        return bool(ABBREVIATION.search(fold(tail)[-5:]))
    return None


def judged(qa: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(qa_id, defect, last): the defect, or the terminal context that has to decide."""
    shared = qa.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _classifier(shared.value)
        turkish = classifier.langs.index("tr") if "tr" in classifier.langs else None
        for batch in batches:
            questions, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            defect: list[str | None] = [None] * len(answers)
            last: list[str | None] = [None] * len(answers)
            bodies: list[tuple[int, bytes]] = []
            for i, (q, a) in enumerate(zip(questions, answers)):
                body = CITED.sub(" ", a) if a else ""
                if not words_of(re.sub(r"\[[^\[\]]*$", " ", body)):
                    # an answer that is the begin of a citation alone is unfinished
                    defect[i] = "truncated" if words_of(body) else "empty"
                    continue
                folded = fold(body)
                if q and copies(q, a):
                    defect[i] = "copies_question"
                elif refuses(folded):
                    defect[i] = "refusal"
                else:
                    rest = LEADING.sub("", folded)
                    if turkish is not None and len(words_of(rest)) >= 3:
                        bodies.append((i, prepared(rest)))
                    shape = unfinished_shape(a)
                    if shape:
                        defect[i] = "truncated"
                    elif shape is None and not SPAN.match(folded):
                        for last[i], _ in contexts(body_of(a)):
                            pass
            if bodies:
                sizes = classifier.sizes([b for _, b in bodies])
                for (i, _), row in zip(bodies, sizes):
                    if row[turkish] > row.min() + 6:
                        defect[i], last[i] = "other_language", None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defect, pa.string()), pa.array(last, pa.string())], ["qa_id", "defect", "last"])

    return qa.select("qa_id", "question", "answer").mapInArrow(run, "qa_id bigint, defect string, last string")


def terminal_counts(qa: DataFrame) -> DataFrame:
    """(context, ends, others) over all answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for answer in batch.column(0).to_pylist():
                seen.update(x for x in contexts(answer) if x[1] is not None)
            keys = list({k for k, _ in seen})
            yield pa.RecordBatch.from_pydict({"context": pa.array(keys, pa.string()), "ends": pa.array([seen[k, True] for k in keys], pa.int64()), "others": pa.array([seen[k, False] for k in keys], pa.int64())})

    counted = qa.where("answer is not null").select("answer").mapInArrow(run, "context string, ends bigint, others bigint")
    return counted.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("others").alias("others"))


def defects(qa: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(qa_id, defect) of each defective row of qa(qa_id, question, answer): 'empty', 'truncated',
    'refusal', 'copies_question' or 'other_language', the first that holds in the order empty, copy,
    refusal, language, truncated. A null question copies nothing; without dictionaries no language
    is judged; repeated rows give a row each."""
    seen, counts = stored(judged(qa, dictionaries)), stored(terminal_counts(qa))
    ending = F.right("context", F.lit(ENDING))
    endings = counts.groupBy(ending.alias("ending")).agg(F.sum("ends").alias("e2"), F.sum("others").alias("o2"))
    # answers end in few words: each is decided once, then its rows
    last = seen.where("defect is null and last is not null").groupBy("last").agg(F.count("*").alias("n")).withColumn("ending", F.right("last", F.lit(ENDING)))
    known = last.join(counts.withColumnRenamed("context", "last"), "last", "left").join(endings, "ending", "left")
    n1, n2 = F.coalesce(F.col("ends") + F.col("others"), F.lit(0)), F.coalesce(F.col("e2") + F.col("o2"), F.lit(0))
    finished = F.when(n1 >= LEAST_WORDS, F.col("ends") * 2 >= n1).when(n2 >= LEAST_ENDINGS, F.col("e2") * 2 >= n2).otherwise(False)
    open_ = stored(known.where(~finished).select("last", "n"))
    truncated = join_groups(seen.where("defect is null and last is not null").select("qa_id", "last"), open_, ["last"], "n").select("qa_id", F.lit("truncated").alias("defect"))
    return seen.where("defect is not null").select("qa_id", "defect").unionByName(truncated)
