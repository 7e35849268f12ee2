"""Languages of documents and of their segments by compression (problem 10).

A bounded sample of labelled documents gives a raw-content zstandard dictionary for each
language. Every sentence is compressed with each dictionary; the smallest result names its
language, a change of language within a document costs some bytes, so that a narrow margin does
not make one. A segment whose margin is still narrow is rejected: it goes to the neighbour that
fits it better, and a whole text to the language of its label, if that is as near, marked unsure. Labels of the sample may be wrong: sentences that another dictionary compresses
better leave the sample, and the dictionaries are built again.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.characters import consistent
from lexspark.llm.words import fold

LANGUAGES = ("tr", "en", "de", "fr", "es", "az")
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 3000
DICTIONARY_BYTES = 64_000
LEVEL = 3
SWITCH_BYTES = 12
LABEL_BYTES = 6
NARROW = 0.05  # the second dictionary needs no more than such a share of bytes more
LEAST_SENTENCES, SENTENCE_WORDS = 2, 3

# Names of the languages that labels use, besides codes with a region.
NAMES = {
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce", "türkisch", "turc", "turco"],
    "en": ["en", "eng", "english", "ingilizce", "englisch", "anglais", "inglés"],
    "de": ["de", "deu", "ger", "german", "deutsch", "almanca", "allemand", "alemán"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "fransızca", "französisch", "francés"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "ispanyolca", "spanisch", "espagnol"],
    "az": ["az", "aze", "azerbaijani", "azeri", "azerice", "azərbaycanca", "azərbaycan dili", "azerbaycanca", "azeri türkçesi"],
}
# Labels that name no language.
NO_LANGUAGE = ["", "-", "–", "—", "?", ".", "und", "unknown", "unk", "unspecified", "undefined", "undetermined", "n/a", "na", "none", "null", "nan", "xx", "xxx", "zxx", "mul", "mis", "other", "bilinmiyor", "belirsiz", "yok", "diğer"]

SENTENCE = re.compile(r"[^\n.!?…]*(?:[.!?…](?!\s|$)[^\n.!?…]*)*[.!?…]*[\"”’)]*\s*")
ODD = re.compile("[\u00ad\u0300-\u036f\u0370-\u04ff\u2000-\u200f\u202f\u2060\u3000\ufb00-\ufb06\ufeff\uff01-\uffee]")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]{2,}")


def bare(text: str) -> str:
    """Without accents, as text typed on a plain keyboard."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines that hold a letter; others join what stands before them."""
    spans: list[tuple[int, int]] = []
    for m in SENTENCE.finditer(text):
        if m.end() == m.start():
            continue
        if LETTER.search(m.group()):
            spans.append((m.start(), m.end()))
        elif spans:
            spans[-1] = (spans[-1][0], m.end())
    return spans


def prepared(text: str) -> bytes:
    text = consistent(text) if ODD.search(text) else text
    return " ".join(fold(text).split()).encode("utf-8", "replace")


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, parts: list[bytes]) -> np.ndarray:
        """Compressed bytes of each part by each dictionary."""
        out = np.zeros((len(parts), len(self.langs)), dtype=np.int32)
        if parts:
            for k, c in enumerate(self.compressors):
                out[:, k] = [len(x) for x in c.multi_compress_to_buffer(parts, threads=1)]
        return out

    def path(self, sizes: np.ndarray, label: str) -> list[int]:
        """The cheapest sequence of languages over the sentences of a document; the language of
        its label is believed where the margin is narrow."""
        if label in self.langs:
            sizes = sizes.copy()
            sizes[0, self.langs.index(label)] -= LABEL_BYTES
        first = sizes.argmin(axis=1)
        if (first == first[0]).all():
            return first.tolist()
        cost, back = sizes[0].astype(float), []
        for row in sizes[1:]:
            best = int(cost.argmin())
            stay = cost <= cost[best] + SWITCH_BYTES
            back.append(np.where(stay, np.arange(len(cost)), best))
            cost = np.where(stay, cost, cost[best] + SWITCH_BYTES) + row
        path = [int(cost.argmin())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def accepted(self, path: list[int], rows: np.ndarray, label: str) -> list[tuple[int, int, int, float, bool]]:
        """(language, first sentence, end, confidence, sure) of each segment of a path, narrow ones
        rejected."""
        while True:
            edges = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
            out = []
            for begin, end in zip(edges, edges[1:]):
                total, lang = rows[begin:end].sum(axis=0), path[begin]
                rest = np.delete(total, lang)
                second = int(rest.min()) if len(rest) else int(total[lang])
                margin = max(0.0, (second - int(total[lang])) / max(second, 1))
                if margin < NARROW and len(edges) > 2:
                    beside = [path[k] for k in (begin - 1, end) if 0 <= k < len(path)]
                    path = [*path[:begin], *[min(beside, key=lambda k: int(total[k]))] * (end - begin), *path[end:]]
                    break
                if margin < NARROW and label in self.langs and total[self.langs.index(label)] <= second:
                    lang = self.langs.index(label)
                out.append((lang, begin, end, margin, margin >= NARROW))
            else:
                return out

    def documents(self, texts: list[str | None], labels: list[str]) -> list[list[dict]]:
        """Segments of each text: lang, start, end, sentences, confidence, sure."""
        spans = [sentences(t) if t else [] for t in texts]
        parts = [prepared(t[a:b]) for t, own in zip(texts, spans) for a, b in own]
        sizes, out, at = self.sizes(parts), [], 0
        for text, own, label in zip(texts, spans, labels):
            rows, segments = sizes[at : at + len(own)], []
            at += len(own)
            for lang, begin, end, confidence, sure in self.accepted(self.path(rows, label), rows, label) if own else []:
                full = sum(len(WORD.findall(text, *own[k])) >= SENTENCE_WORDS for k in range(begin, end))
                segments.append({"lang": self.langs[lang], "start": 0 if begin == 0 else own[begin][0], "end": len(text) if end == len(own) else own[end][0], "sentences": full, "confidence": confidence, "sure": sure})
            out.append(segments)
        return out


def dictionary(parts: list[str]) -> bytes:
    """Distinct sentences up to the size, as they are and without accents."""
    half, kept, n = DICTIONARY_BYTES // 2, [], 0
    for part in dict.fromkeys(parts):
        n += len(part.encode()) + 1
        if n > half and kept:
            break
        kept.append(part)
    text = " ".join(kept)
    return (bare(text) + " " + text).encode()


def build(parts: list[tuple[str, bytes]]) -> dict[str, bytes]:
    by: dict[str, list[str]] = {}
    for lang, part in parts:
        by.setdefault(lang, []).append(part.decode())
    return {lang: dictionary(by[lang]) for lang in LANGUAGES if lang in by}


def train(rows: list[tuple[str, str]], rounds: int = 2) -> dict[str, bytes]:
    """Dictionaries from labelled texts, some labels being wrong. Each half of the texts is held
    against the dictionaries of the other half, never against its own, and loses the sentences
    that another language explains better."""
    halves = [[(lang, prepared(text[a:b])) for lang, text in rows[k::2] for a, b in sentences(text)] for k in range(2)]
    for half in halves:
        random.Random(7).shuffle(half)
    for _ in range(rounds):
        kept = []
        for k, half in enumerate(halves):
            built = build(halves[1 - k])
            classifier = Classifier(built)
            best = classifier.sizes([p for _, p in half]).argmin(axis=1) if built else []
            kept.append([x for x, i in zip(half, best) if classifier.langs[i] == x[0]])
        halves = kept if all(kept) else halves
    parts = halves[0] + halves[1]
    random.Random(8).shuffle(parts)
    return build(parts)


def label_language(label: Column) -> Column:
    """The language a label names: one of the six codes, '' for no language, 'other' else."""
    plain = F.lower(F.translate(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\s\u00a0\u200b\ufeff]+", " ")), "İI", "iı"))
    dotted = F.translate(plain, "ı", "i")
    names = {n: code for code, own in NAMES.items() for n in own}
    names |= {n.replace("ı", "i"): code for n, code in names.items()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    none = F.array(*[F.lit(x) for x in NO_LANGUAGE])
    stem = F.regexp_extract(dotted, r"^([a-z]{2,3})[-_]", 1)
    # ANSI maps give null for a key that isn't there only by try_element_at
    return F.when(F.array_contains(none, plain) | F.array_contains(none, dotted), F.lit("")).otherwise(F.coalesce(F.try_element_at(known, dotted), F.try_element_at(known, stem), F.lit("other")))


@functools.lru_cache(maxsize=4)
def _classifier(items: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(items))


def fit(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Dictionaries from at most SAMPLE_ROWS labelled texts of at most SAMPLE_CHARS characters,
    chosen by the hash of their id; the hash thins the table first, so that no more than some
    times the sample is sent to the driver."""
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, documents.count()))
    h = F.xxhash64(id_col)
    drawn = documents.where(F.pmod(h, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    labelled = drawn.select(h.alias("h"), F.col(text_col).alias("t"), label_language(F.col(lang_col)).alias("l"))
    usable = labelled.where(F.col("l").isin(*LANGUAGES) & F.length("t").between(100, SAMPLE_CHARS))
    rows = usable.orderBy("h", "t").limit(SAMPLE_ROWS).collect()
    return train([(r["l"], r["t"]) for r in rows])


SEGMENTS = "array<struct<lang:string,start:int,end:int,sentences:int,confidence:double,sure:boolean>>"


def segments(documents: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, label, segments): the language the label names and the segments of the text in
    order, with lang, start, end, sentences, confidence and sure; none for a null text or one without letters. Repeated ids give a row each."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))
    fields = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32()), ("confidence", pa.float64()), ("sure", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _classifier(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = classifier.documents(batch.column(2).to_pylist(), batch.column(1).to_pylist()) if classifier.langs else [[]] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, fields)], ["doc_id", "label", "segments"])

    return documents.select(F.col(id_col).alias("doc_id"), label_language(F.col(lang_col)).alias("label"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id bigint, label string, segments {SEGMENTS}")


def languages(segmented: DataFrame) -> DataFrame:
    """(doc_id, label, state, lang, confidence): 'mixed' with a row per language that has at least
    two full sentences, if several have; else one row with the main language, and as state
    'missing', 'wrong' or 'right'. Texts without letters have no row."""
    out = segmented.where(F.size("segments") > 0)
    per = F.transform(F.array_distinct(F.col("segments.lang")), lambda lang: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0), lambda n, s: n + s["sentences"]).alias("sentences"),
        F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("chars"),
        F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0.0), lambda n, s: n + s["confidence"] * (s["end"] - s["start"])).alias("weight"),
        lang.alias("lang"),
    ))
    out = out.withColumn("per", per).withColumn("full", F.filter("per", lambda x: x["sentences"] >= LEAST_SENTENCES))
    main = F.slice(F.sort_array("per", asc=False), 1, 1)
    out = out.withColumn("mixed", F.size("full") > 1).withColumn("x", F.explode(F.when(F.col("mixed"), F.col("full")).otherwise(main)))
    state = F.when(F.col("mixed"), "mixed").when(F.col("label") == "", "missing").when(F.col("label") == F.col("x.lang"), "right").otherwise("wrong")
    return out.select("doc_id", "label", state.alias("state"), F.col("x.lang").alias("lang"), (F.col("x.weight") / F.greatest(F.col("x.chars"), F.lit(1))).alias("confidence"))
