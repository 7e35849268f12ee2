"""One consistent spelling for text that looks the same (problem 7).

A mapping from grapheme clusters to their consistent form is computed once from the Unicode
tables and a list of look-alikes, checked for conflicts, and compiled into a trie. One pass over
a text follows the trie from each position where a cluster can begin and takes the longest
match. Look-alikes apply only in words that also hold Latin letters (or letters of several
scripts), so words wholly in another script stay as they are; in codes they always apply, as do
all compatibility forms of letters and digits. Words and what stands between them are walked once.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Һ": "H", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T",
}
# Characters without width, and spaces that are not the space.
ZERO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Text of these characters alone needs no change; it is told apart without leaving the JVM.
PLAIN = r"[^\t\n\r\x20-\x7eçğıöşüÇĞİÖŞÜâîûÂÎÛäÄßéèñ²³°§€«»¬•·“”„‘’–—…]"

#: The same for codes, in which no typographic sign belongs.
PLAIN_CODE = r"[^\x21-\x7eçğıöşüÇĞİÖŞÜ ]|^ | $"

JOINER, SELECTOR = "\u200d", "\ufe0f"
# Cedilla, circumflex, breve, dot and diaeresis above.
MARKS = "\u0327\u0302\u0306\u0307\u0308"


@functools.lru_cache(maxsize=1)
def cluster_map() -> dict[str, str]:
    """Grapheme clusters and their consistent forms, without the look-alikes."""
    found: dict[str, str] = {c: "" for c in ZERO_WIDTH} | {c: " " for c in SPACES}
    wide: dict[str, str] = {}
    for code in (*range(0xFF01, 0xFF5F), *range(0xFF66, 0xFF9E), *range(0xFFE0, 0xFFE3), *range(0xFFE4, 0xFFE7), *range(0xFB00, 0xFB07)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and unicodedata.category(c) != "Cn":
            found[c] = wide[c] = plain
    narrow: dict[str, list[str]] = {}
    for c, plain in wide.items():
        narrow.setdefault(plain, []).append(c)
    for code in range(0xC0, 0x2000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and all(unicodedata.combining(m) for m in parts[1:]):
            forms = {parts, parts[0] + parts[:0:-1]} | {unicodedata.normalize("NFC", parts[:k]) + parts[k:] for k in range(2, len(parts))}
            for form in forms:
                if unicodedata.normalize("NFC", form) == c:
                    found |= {base + form[1:]: c for base in (form[0], *narrow.get(form[0], ()))}
    for base in ("i", *narrow["i"]):
        found[base + "\u0307"] = "i"  # lower case of a dotted capital
    return found


def checked(mapping: dict[str, str]) -> dict[str, str]:
    """The mapping, if no consistent form holds a cluster that is itself changed."""
    longest = max(map(len, mapping))
    for source, form in mapping.items():
        parts = {form[i:j] for i in range(len(form)) for j in range(i + 1, min(len(form), i + longest) + 1)}
        if clash := parts & mapping.keys():
            raise ValueError(f"{source!r} becomes {form!r}, in which {clash} would change again")
    return mapping


class Transducer:
    """Longest-match replacement by a trie compiled from the mapping."""

    END = ""

    def __init__(self, mapping: dict[str, str]):
        self.trie: dict = {}
        for source, form in checked(mapping).items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[self.END] = form
        single = "".join(re.escape(c) for c in mapping if len(c) == 1)
        marks = "".join(sorted({re.escape(s[1]) for s in mapping if len(s) > 1}))
        self.begins = re.compile(f"[{single}]|.(?=[{marks}])", re.DOTALL)

    def __call__(self, text: str) -> str:
        out, done, at = [], 0, 0
        while hit := self.begins.search(text, at):
            i = j = hit.start()
            node, form, end = self.trie, None, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if self.END in node:
                    form, end = node[self.END], j
            if form is None or (text[i] == JOINER and in_emoji(text, i)):
                at = i + 1
                continue
            out += text[done:i], form
            done = at = end
        return "".join((*out, text[done:])) if done else text


def in_emoji(text: str, i: int) -> bool:
    """Whether the joiner at i holds two pictures together."""
    before = text[:i].rstrip(SELECTOR + "🏻🏼🏽🏾🏿")[-1:]
    return bool(before) and unicodedata.category(before) == "So" and unicodedata.category(text[i + 1 : i + 2] or " ") == "So"


def code_map(known: dict[str, str]) -> dict[str, str]:
    """Further letters and digits with a compatibility form of letters and digits: superscripts,
    enclosed and mathematical ones."""
    found = {}
    for code in (*range(0xA0, 0x3400), *range(0xA640, 0xD7A4), *range(0xF900, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F190)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if c not in known and plain != c and plain.isalnum() and not any(x in known for x in plain) and all(x.isascii() or x in "çğıöşüÇĞİÖŞÜ" for x in plain):
            found[c] = plain
    return found


@functools.lru_cache(maxsize=1)
def transducers() -> tuple[Transducer, Transducer, Transducer]:
    """Without and with the look-alikes, and the one for codes; an accent on a look-alike goes to the
    Latin letter."""
    mapping = dict(cluster_map())
    accented = {other + m: unicodedata.normalize("NFC", latin + m) for other, latin in LOOK_ALIKES.items() for m in MARKS}
    accented |= {unicodedata.normalize("NFC", k): v for k, v in accented.items()}
    accented = {k: "i" if v == "i\u0307" else v for k, v in accented.items() if len(v) == 1 or v == "i\u0307"}
    full = mapping | accented | LOOK_ALIKES
    return Transducer(mapping), Transducer(full), Transducer(full | code_map(full))


WORD = re.compile(rf"\w[\w\u0300-\u036f{ZERO_WIDTH}]*")
UNUSUAL = re.compile(r"[^\x00-\x7fçğıöşüÇĞİÖŞÜâîû]")


@functools.lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """The script of a letter, as its Unicode name begins; fullwidth Latin counts as Latin."""
    name = unicodedata.name(c, "")
    return "LATIN" if "LATIN" in name else name.split(" ")[0]


def has_look_alikes(word: str) -> bool:
    """Whether letters of other scripts in a word stand for Latin ones."""
    letters = [c for c in word if c.isalpha()]
    scripts = {script(c) for c in letters}
    foreign = [c for c in letters if script(c) != "LATIN"]
    return bool(foreign) and ("LATIN" in scripts or (len(scripts) > 1 and all(c in LOOK_ALIKES for c in foreign)))


def consistent(text: str | None, code: bool = False) -> str | None:
    """The consistent form of a text, or of a code, whose letters are all Latin and whose outer
    spaces go. Null stays null."""
    if text is None:
        return None
    plain, full, codes = transducers()
    if code:
        return codes(text).strip()
    out, done = [], 0
    for m in WORD.finditer(text):
        word = m.group()
        if UNUSUAL.search(word):
            # one letter before a bracket marks a list, whatever its script seems to be
            marker = len(word.rstrip(MARKS)) == 1 and text[m.end() : m.end() + 1] == ")"
            out += plain(text[done : m.start()]), (full if marker or has_look_alikes(word) else plain)(word)
            done = m.end()
    return "".join((*out, plain(text[done:])))


def consistent_form(column: Column, code: bool = False) -> Column:
    """The column in its consistent form. Plain values stay in the JVM."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([consistent(v, code) for v in values.to_pylist()], pa.string())

    suspect = F.when(column.rlike(PLAIN_CODE if code else PLAIN), column)
    return F.when(column.isNotNull(), F.coalesce(run(suspect), column))


def changed(df: DataFrame, id_col: str, text_col: str, src: str, code: bool = False) -> DataFrame:
    """(src, row_id) of the rows whose value changes when brought to the consistent form; null
    and empty values never do, repeated ids give a row each."""
    suspects = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("value")).where(F.col("value").rlike(PLAIN_CODE if code else PLAIN))
    return suspects.where(consistent_form(F.col("value"), code) != F.col("value")).select(F.lit(src).alias("src"), "row_id")
