"""Repair of text from scanned pages (problem 3).

Lines are labelled as body, paragraph end, running header, page number or both by a hidden
Markov model over layout features; its tables are counted on a bounded sample of articles whose
lines weak rules label. Paragraphs are put together from the body lines, divided words joined.
Misrecognised words are found with a lexicon counted over the whole corpus: a rare word that a
known confusion of letters turns into a word at least so many times as frequent.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.characters import consistent
from lexspark.llm.languages import ODD
from lexspark.session import stored

SAMPLE_ROWS, SAMPLE_CHARS = 2000, 4000
TIMES, LEAST_COUNT = 10, 3
COMMON_WORDS = 50_000

# What recognition reads, and what stood there.
CONFUSIONS = {"4": ["a"], "1": ["l", "i", "ı"], "5": ["s"], "0": ["o"], "6": ["b"], "9": ["g"], "8": ["b"], "3": ["e"], "ri": ["n"], "rn": ["m"], "c": ["e"], "lc": ["k"], "l": ["ı"], "ıı": ["u"], "ii": ["ü"], "cl": ["d"], "li": ["h"], "vv": ["v"], "|": ["l", "ı"], "s,": ["ş"], "c,": ["ç"]}

#: The signs among them that are no letters, and what each may stand for alone; all that are alike.
SIGNS = {sign: rights for sign, rights in CONFUSIONS.items() if len(sign) == 1 and not sign.isalpha()}
ALIKE = ["1|liı", "4a", "5s", "0o", "68b", "9g", "3e"]

STATES = ("body", "end", "header", "page", "both")
PAGE = r"(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|s\.\s*\d{1,4}|S\.\s*\d{1,4}|[Ss]ayfa\s*:?\s*\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|\d{1,4})"
PAGE_ONLY = re.compile(rf"\s*{PAGE}\s*$")
BESIDE = re.compile(rf"(?P<left>^\s*{PAGE}\s{{2,}})|(?P<right>\s{{2,}}{PAGE}\s*$)")
# Words of running heads of publications.
PUBLICATION = re.compile(r"(?<!\w)(?:bülten\w*|resm[iî] gazete|derlemesi|külliyatı|mecmuası|düstur|cilt|tertip|sayılı kanun)(?!\w)")
DATED = re.compile(r"\d")
MARKER = re.compile(r"\s*(?:\(\d+\)|[a-zçğıöşü]{1,2}\)|\([IVX]+\)|MADDE\s|Madde\s|\d+[.)]\s)")
ROW = re.compile(r"\s*\d+\s.*\d[,.]\d+\s*$|.*[|;].*\d|\s*\w+ [XY] [XY]\s*$|\s*\d+(?:[.,]\d+)?(?:\s+\d+[.,]\d+)+\s*$")
WORD = re.compile(r"[^\W_]+(?:(?<=[^\W\d_])\|(?=[^\W\d_])[^\W_]+)*")
DIVIDERS = ("-", "¬", "\u00ad", "\u2010")
SPLIT = re.compile(r"(?<=[^\W\d_])[-¬\u00ad\u2010][ \t]*\n\s*(?=[^\W\d_])")
BROKEN = re.compile(r"[^\s.;:,!?)]\s*\n\s*[a-zçğıöşü](?!\))")
COMMA = re.compile(r"(?<=[^\W\d_])([sc]),(?=[^\W\d_])")
LEXICAL = re.compile(r"[^\W\d_]")


def lower(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def text_form(text: str) -> str:
    return consistent(text) if ODD.search(text) else text


def title_share(line: str, title: frozenset[str]) -> float:
    words = [w for w in WORD.findall(lower(line)) if not w.isdigit()]
    return sum(w in title for w in words) / len(words) if len(words) > 2 else 0.0


def capital_share(line: str) -> float:
    words = [w for w in WORD.findall(line) if w[0].isalpha()]
    return sum(w[0].isupper() for w in words) / max(1, len(words))


def form(line: str, title: frozenset[str]) -> str:
    """What a line looks like."""
    if PAGE_ONLY.match(line):
        return "number"
    head = BESIDE.sub("", line)
    beside = "+number" if head != line else ""
    bare = head.strip()
    if MARKER.match(bare):
        return "marker"
    if ROW.match(bare):
        return "row"
    if len(bare) <= 120 and bare[-1:] not in ".;,:":
        low = lower(bare)
        if title_share(bare, title) >= 0.6 and ("kanun" in low or bare.isupper() or len(title) < 3):
            return "title" + beside
        if PUBLICATION.search(low) and DATED.search(bare) and capital_share(bare) >= 0.6:
            return "publication" + beside
        if bare.isupper() and len(bare) > 8:
            return "capitals" + beside
    return "lower" if bare[:1].islower() else "upper"


def features(lines: list[str], title: frozenset[str]) -> list[tuple[str, ...]]:
    """Layout features of each line: form, its end, the end before, the form after, its width."""
    forms = [form(x, title) for x in lines]
    widths = sorted(map(len, lines))
    usual = max(1, widths[(3 * len(widths)) // 4])

    def end(line: str) -> str:
        tail = line.rstrip()[-1:]
        return "stop" if tail in ".!?" else "hyphen" if tail in "-¬­" else "comma" if tail in ",;:" else "open"

    ends = [end(x) for x in lines]
    # lines of a scan end at the same width, often within a sentence
    layout = "w" if any(a in ("open", "hyphen") and f == "lower" for a, f in zip(ends, forms[1:])) else "p"
    out = []
    for i, line in enumerate(lines):
        before = ends[i - 1] if i else "begin"
        after = forms[i + 1].split("+")[0] if i + 1 < len(lines) else "none"
        out.append((forms[i], "e" + ends[i], "b" + before, "a" + after, layout + str(min(6, 7 * len(line) // (usual + 1)))))
    return out


def weak_labels(rows: list[tuple[str, ...]]) -> list[str]:
    """Labels by rule, to count the model's tables from."""
    out = []
    for row in rows:
        f, beside = row[0].split("+")[0], "+" in row[0]
        if f == "number":
            out.append("page")
        elif f in ("title", "publication") or f == "capitals" and row[3] != "arow":
            out.append("both" if beside else "header")
        elif row[3] in ("amarker", "arow", "anone") or f == "row" or row[1] == "estop" and row[4] not in ("w5", "w6"):
            out.append("end")
        else:
            out.append("body")
    return out


class LineModel:
    """Start, transition and emission log probabilities, counted with one added to each, of articles
    labelled by the weak rules or, to learn from what follows what, by an earlier model."""

    def __init__(self, articles: list[tuple[list[str], frozenset[str]]], earlier: LineModel | None = None):
        start, step, emit, total = Counter(), Counter(), Counter(), Counter()
        values: dict[int, set[str]] = {}
        for lines, title in articles:
            rows = features(lines, title)
            labels = earlier.labels(lines, title) if earlier else weak_labels(rows)
            start[labels[0]] += 1
            step.update(zip(labels, labels[1:]))
            for row, label in zip(rows, labels):
                for k, v in enumerate(row):
                    # page furniture differs in form; where it stands is counted for all of it
                    emit[self.group(label, k), k, v] += 1
                    total[self.group(label, k), k] += 1
                    values.setdefault(k, set()).add(v)
        n, out_of = sum(start.values()), Counter()
        for (a, _), c in step.items():
            out_of[a] += c
        self.start = [math.log((start[s] + 1) / (n + len(STATES))) for s in STATES]
        self.step = [[math.log((step[a, b] + 1) / (out_of[a] + len(STATES))) for b in STATES] for a in STATES]
        prior = {(s, k): max(1.0, sum(self.prior(s, k, v) for v in vs)) for s in STATES for k, vs in values.items()}
        self.emit = {
            (k, v): [math.log((emit[self.group(s, k), k, v] + self.prior(s, k, v)) / (total[self.group(s, k), k] + prior[s, k] + 1e-9)) for s in STATES] for k, vs in values.items() for v in vs
        }

    @staticmethod
    def prior(state: str, k: int, v: str) -> float:
        """What is added to a count: a state that the sample lacks expects the forms it is for."""
        if k:
            return 0.1
        fits = {"both": "+" in v, "page": v == "number", "header": v in ("title", "publication", "capitals")}
        return 0.5 if fits.get(state, v in ("lower", "upper", "marker", "row")) else 0.01

    def seen(self, k: int, v: str) -> list[float]:
        """Log probabilities of a feature; a form the sample lacks counts as plain text."""
        return self.emit.get((k, v)) or (self.emit.get((0, "upper")) if k == 0 else None) or [0.0] * len(STATES)

    @staticmethod
    def group(state: str, k: int) -> str:
        return "furniture" if k and state in ("header", "page", "both") else state

    def labels(self, lines: list[str], title: frozenset[str]) -> list[str]:
        """The likeliest labels of the lines of an article."""
        rows = features(lines, title)
        scores, back = self.start, []
        states = range(len(STATES))
        into = list(zip(*self.step))  # into[b][a]: from a to b
        for i, row in enumerate(rows):
            own = [sum(x) for x in zip(*(self.seen(k, v) for k, v in enumerate(row)))]
            if i:
                sums = [[s + t for s, t in zip(scores, into[b])] for b in states]
                best = [max(x) for x in sums]
                back.append([x.index(m) for x, m in zip(sums, best)])
                scores = [m + o for m, o in zip(best, own)]
            else:
                scores = [a + b for a, b in zip(scores, own)]
        path = [max(range(len(STATES)), key=scores.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return [STATES[s] for s in reversed(path)]


def repaired(text: str, title: str | None, model: LineModel) -> tuple[str, set[str]]:
    """The paragraphs of a text without page furniture and divided words, and the kinds of noise
    found: hyphen, header, page_no."""
    text = text_form(text)
    kinds: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        labels = model.labels(lines, frozenset(WORD.findall(lower(title or ""))))
        if any(s in ("header", "both") for s in labels):
            kinds.add("header")
        if any(s in ("page", "both") for s in labels):
            kinds.add("page_no")
        kept = [(x, s) for x, s in zip(lines, labels) if s in ("body", "end")]
    else:
        kept = [(x, "end") for x in lines]
    out: list[str] = []
    for i, (line, state) in enumerate(kept):
        out.append(line)
        after = kept[i + 1][0] if i + 1 < len(kept) else ""
        divided = line.rstrip()[-1:] in DIVIDERS and after.lstrip()[:1].islower() and SPLIT.search(line.rstrip() + "\n" + after.lstrip()) is not None
        if divided:
            kinds.add("hyphen")
            out[-1] = line.rstrip()[:-1] + "\x00"
        else:
            broken = state == "body" or (after[:1].islower() and not MARKER.match(after) and line.rstrip()[-1:] not in ".!?:;,")
            out[-1] = line.rstrip() + (" " if broken and after and not MARKER.match(after) else "\n")
    joined = re.sub("\x00\\s*", "", "".join(out)).strip()
    return joined, kinds


def candidates(word: str) -> set[str]:
    """Words that one confusion, at one place or at all its places, may have turned into this one."""
    found: set[str] = set()
    for wrong, rights in CONFUSIONS.items():
        if wrong in word:
            for right in rights:
                found.add(word.replace(wrong, right))
                at = word.find(wrong)
                while at >= 0:
                    found.add(word[:at] + right + word[at + len(wrong) :])
                    at = word.find(wrong, at + 1)
    return found - {word}


def skeleton(word: Column) -> Column:
    """The word with all signs and letters that recognition confuses as one sign each, so that a
    word whose every digit stands for a letter has the skeleton of the word that it was."""
    return F.translate(word, "".join(c for own in ALIKE for c in own), "".join(own[0] * len(own) for own in ALIKE))


def letters_for(word: Column) -> Column:
    """A pattern of the words that this one may have been, each sign that is no letter read as one."""
    out = word
    for sign, letters in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit("[" + "".join(letters) + "]"))
    return F.concat(F.lit("^"), out, F.lit("$"))


def words(text: str) -> list[str]:
    """Words in lower case, with the commas that stand for a cedilla as part of them."""
    return WORD.findall(lower(uncomma(text)))


def uncomma(text: str) -> str:
    return COMMA.sub(lambda m: "ş" if m.group(1) == "s" else "ç", text) if "s," in text or "c," in text else text


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n, plain) over all texts(text), words divided at line ends joined; plain counts the
    occurrences in texts of some length without broken lines, which come from no scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, unbroken = Counter(), Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    lines = "\n" in text
                    own = words(SPLIT.sub("", text_form(text)) if lines else text_form(text))
                    seen.update(own)
                    if len(text) >= 200 and not (lines and BROKEN.search(text)):
                        unbroken.update(own)
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64()), "plain": pa.array([unbroken[w] for w in seen], pa.int64())})

    return texts.select("text").mapInArrow(run, "word string, n bigint, plain bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, right): words that are misread, and what they should be, of counts(word, n, plain):
    words that one confusion, or reading all signs that are no letters as letters, turns into a word
    of so many times their count. A word that is usual in text from no scan is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, c) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if LEXICAL.search(w) for c in candidates(w)]
            w, n, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"word": pa.array(w, pa.string()), "n": pa.array(n, pa.int64()), "right": pa.array(c, pa.string())})

    doubtful = counts.where("plain < 3 or plain * 2 < n").select("word", "n")
    tried = doubtful.mapInArrow(run, "word string, n bigint, right string")
    known = counts.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("right"), F.col("n").alias("m"))
    signed = doubtful.where(F.col("word").rlike(f"[{''.join(SIGNS)}]") & F.col("word").rlike(r"\p{L}"))
    whole = signed.withColumns({"_s": skeleton(F.col("word")), "_p": letters_for(F.col("word"))}).join(known.withColumn("_s", skeleton(F.col("right"))), "_s").where(F.expr("right rlike _p"))
    columns = ["word", "n", "right", "m"]
    good = tried.join(known, "right").select(*columns).unionByName(whole.select(*columns)).where(F.col("m") >= TIMES * F.col("n"))
    return good.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def fit(texts: DataFrame) -> LineModel:
    """The line model from at most SAMPLE_ROWS texts of several lines and at most SAMPLE_CHARS
    characters; the hash of the id thins the table before anything is collected."""
    share = min(1.0, 3 * SAMPLE_ROWS / max(1, texts.count()))
    drawn = texts.withColumn("h", F.xxhash64("row_id", "field")).where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    several = drawn.where(F.contains("text", F.lit("\n")) & (F.length("text") <= SAMPLE_CHARS))
    rows = several.orderBy("h", "text").limit(SAMPLE_ROWS).select("text", "title").collect()
    articles = [([x for x in text_form(r["text"]).split("\n") if x.strip()] or [" "], frozenset(WORD.findall(lower(r["title"] or "")))) for r in rows]
    return LineModel(articles, LineModel(articles))


@dataclass
class Repair:
    """Texts read with the line model and the common words: done(row_id, field, text, kinds, rare), the
    text put together, the kinds of noise, and the words that are not common; and wrong(word, right)."""

    done: DataFrame
    wrong: DataFrame

    @classmethod
    def of(cls, texts: DataFrame) -> Repair:
        """Of texts(row_id, field, text, title). Null texts are left out, empty ones stay empty;
        repeated and null ids give a row each, columns of other names are ignored. title is the law's name, for its running heads."""
        plain = texts.select("row_id", "field", "text", "title").where("text is not null")
        counts = stored(lexicon(plain))
        total = counts.agg(F.sum("n")).collect()[0][0] or 0
        wrong = stored(misread_words(counts))
        # at most COMMON_WORDS words can each make up that share of all; a common word may be a misread one too
        usual = counts.where((F.col("n") * COMMON_WORDS >= max(total, 1)) & (F.col("n") > 1)).join(wrong, "word", "left_anti")
        shared = texts.sparkSession.sparkContext.broadcast((fit(plain), frozenset(r["word"] for r in usual.select("word").toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, common = shared.value
            for batch in batches:
                texts_, kinds_, rare_ = [], [], []
                for text, title in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    fixed, kinds = repaired(text, title, model)
                    if uncomma(fixed) != fixed:
                        kinds.add("misread")
                    own = set(words(fixed)) - common
                    if any(strange(w) for w in own):
                        kinds.add("misread")
                    texts_.append(fixed)
                    kinds_.append(sorted(kinds))
                    rare_.append(sorted(w for w in own if LEXICAL.search(w)))
                lists = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts_, pa.string()), pa.array(kinds_, lists), pa.array(rare_, lists)], ["row_id", "field", "text", "kinds", "rare"])

        return cls(plain.mapInArrow(run, "row_id bigint, field string, text string, kinds array<string>, rare array<string>"), wrong)

    def noise(self) -> DataFrame:
        """(row_id, field, kind) with a row per kind present."""
        # a kind goes through the join under a key of its own, so that both come from one reading
        found = F.concat(F.transform("kinds", lambda k: F.struct(F.concat(F.lit(" "), F.col("row_id").cast("string")).alias("word"), k.alias("kind"))), F.transform("rare", lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("kind"))))
        rows = self.done.select("row_id", "field", F.explode(found).alias("x")).select("row_id", "field", "x.*").join(self.wrong, "word", "left")
        kind = F.coalesce("kind", F.when(F.col("right").isNotNull(), "misread"))
        return rows.select("row_id", "field", kind.alias("kind")).where("kind is not null").distinct()

    def texts(self) -> DataFrame:
        """(row_id, field, text), misread words put right."""
        done = stored(self.done.drop("kinds"))
        read = done.select("row_id", "field", F.explode("rare").alias("word")).join(self.wrong, "word")
        # rows of the same key share their words, each of which has one correction
        fixes = read.groupBy("row_id", "field").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fixes"))

        @F.arrow_udf("string")
        def mend(text: pa.Array, fixes_: pa.Array) -> pa.Array:
            return pa.array([mended(t, dict(f or ())) for t, f in zip(text.to_pylist(), fixes_.to_pylist())], pa.string())

        same = F.col("d.row_id").eqNullSafe(F.col("f.row_id")) & F.col("d.field").eqNullSafe(F.col("f.field"))
        return done.alias("d").join(fixes.alias("f"), same, "left").select("d.row_id", "d.field", mend("text", "fixes").alias("text"))


def repair(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The noise of texts(row_id, field, text, title) and the repaired texts."""
    read = Repair.of(texts)
    return read.noise(), read.texts()


def strange(word: str) -> bool:
    """Whether letters and a digit that is read for a letter stand in one word of small letters."""
    letters = sum(c.isalpha() for c in word)
    return letters >= 3 and sum(c in CONFUSIONS for c in word if not c.isalpha()) in (1, 2) and word[0].isalpha() and all(c.isalpha() or c in CONFUSIONS for c in word)


def mended(text: str, fixes: dict[str, str]) -> str:
    """The text with its misread words put right, capitals kept."""

    def right(m: re.Match) -> str:
        found = fixes.get(lower(m.group()))
        if not found:
            return m.group()
        return found.upper() if m.group().isupper() and len(found) > 1 else ("İ" if found[0] == "i" else found[0].upper()) + found[1:] if m.group()[0].isupper() else found

    return WORD.sub(right, uncomma(text))
