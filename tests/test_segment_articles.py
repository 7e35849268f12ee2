import hashlib
import re

import __spark_entry__ as entry

LONG = "Uzun başlık " * 11
#: (madde_no, madde_type, baslik, metin): the forms that a scan or a page layout leaves in a text
DIRTY = [
    ("1", "normal", None, "Başlıksız metin.\nİkinci satır."),
    ("2", "normal", "", "(1) Bir.\n(2) İki.\n  (3)  Üç."),
    ("3", "normal", LONG, "Gövde."),
    ("4", "normal", "x" * 119, "Gövde."),
    ("5", "normal", "x" * 120, "Gövde."),
    ("6", "normal", "Amaç", "Bir.\n 17 \nİki."),
    ("7", "normal", "Amaç", "Bir.\nResmî Gazete Sayfa : 12 son\nİki.\n" + "y" * 81 + "sayfa:3"),
    ("8", "normal", "Amaç", "Çift  boşluk\tve\t\tsekme.\r\nSatır.\rSon."),
    ("9", "normal", "Amaç", "Bir.\n\n\n\n\nİki."),
    ("10", "normal", "Amaç", "Bir.\nMadde 11 – Kapsam\nİki.\n GEÇİCİ MADDE 2- Geçiş\nÜç.\nEk Madde 3\nDört."),
    ("12", "normal", "Amaç", "Bir.\nMADDE beş\nbu Madde 6 ile."),
    ("Geçici 4", "gecici", "Geçiş", "Bir.\n(I) SAYILI CETVEL\n1 Ada 12,5"),
    ("Ek 5", "ek", "Ek", "Bir.\nKOORDİNAT LİSTESİ\n1 2"),
    ("14", "normal", "Amaç", "Bir.\nNokta No y X\n1 2 3"),
    ("15", "normal", "Amaç", "Bir.\n5 SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN\nx"),
    ("16", "normal", "Amaç", "Bir.\nYÜRÜRLÜĞE GİRİŞ TARİHLERİNİ GÖSTERİR\nx\n(II) SAYILI LİSTE"),
    ("17", "normal", None, "(I) SAYILI CETVEL\n1 2"),
    ("18", "normal", " Dış ", "  \n dış boşluk \n\n"),
    ("19", "normal", "– . - Tire", "Bir."),
    ("20", "normal", "Amaç", "33"),
    ("21", "normal", "İki\nsatır", "Bir."),
    ("22", "normal", "(1) Numaralı", "Bir.\n(2) İki."),
    ("23", "normal", None, "\n44\n"),
    ("24", "normal", "Amaç", ""),
    ("25", "normal", "Amaç", None),
]
MARKER = re.compile(r"[ \t]*((?:(?:GEÇİCİ|Geçici|GECICI|Gecici|EK|Ek)[ \t]+)?(?:MADDE|Madde)[ \t]+)([0-9]+)")
TABLES = [r"\d+\s+SAYILI\s+KANUNA\s+EK\s+VE\s+DEĞİŞİKLİK\s+GETİREN", r"(?:^|\n)[ \t]*\(?[ \t]*[IVX\d]+[ \t]*\)?[ \t]+SAYILI\s+(?:CETVEL|LİSTE)", r"KOORDİNAT\s+LİSTESİ", r"(?m)^[ \t]*Nokta No [yY] [xX][ \t]*$", r"YÜRÜRLÜĞE\s+GİRİŞ\s+TARİHLERİNİ\s+GÖSTERİR"]


def brute(no, kind, heading, text):
    """(pos, madde_no, madde_type, baslik, metin, fikralar) of one printed article, line by line."""
    printed = {"gecici": "Geçici Madde ", "ek": "Ek Madde "}.get(kind, "Madde ") + re.search(r"\d+", no)[0] + " – " + (f"{heading}\n" if heading else "") + text
    lines = []
    for line in printed.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        label = re.match(r"(?i).{0,80}sayfa[ \t]*:[ \t]*[0-9]", line)
        lines.append("" if line.strip(" \t").isdigit() or label else re.sub("[ \t]+", " ", line))
    text = "\n".join(lines).strip(" \n")
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    articles = []
    for line in text.split("\n"):
        found = MARKER.match(line)
        if found:
            articles.append([found[1].strip(), found[2], line[found.end() :]])
        elif articles:
            articles[-1][2] += "\n" + line
    out = []
    for pos, (marker, number, body) in enumerate(articles):
        body = body.lstrip(" \t\n.–-").strip(" \n")
        body = body[: min([m.start() for m in (re.search(t, body) for t in TABLES) if m], default=len(body))].rstrip(" \n")
        first, _, rest = body.partition("\n")
        named = first != "" and len(first) < 120 and not re.match(r"[ \t]*\([0-9]+\)", first)
        text = (rest.strip(" \n") or first.strip(" ")) if named else body
        if text:
            parts = re.split(r"(?m)^[ \t]*\([0-9]+\)[ \t]*", text)
            paragraphs = [p.strip(" \n\t") for p in (parts[1:] or parts)]
            low = marker.replace("İ", "i").replace("I", "ı").lower()
            sort = "gecici" if low.startswith(("geçici", "gecici")) else "ek" if low.startswith("ek") else "normal"
            out.append((pos, {"gecici": "Geçici ", "ek": "Ek "}.get(sort, "") + number, sort, first.strip(" ") if named else None, text, [p for p in paragraphs if p]))
    return out


def digests(row_id, found):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    return [(row_id, pos, no, kind, heading, md5(text), len(parts), md5("|".join(parts))) for pos, no, kind, heading, text, parts in found]


def test_every_article_with_a_text_is_segmented(spark, tmp_path):
    rows = [(i, *r) for i, r in enumerate(DIRTY)]
    spark.createDataFrame(rows, "row_id long, madde_no string, madde_type string, baslik string, metin string").write.parquet(str(tmp_path / "madde.parquet"))
    want = [x for i, *r in rows if r[3] for x in digests(i, brute(*r))]
    got = sorted(map(tuple, entry.queries()["segment_articles"](spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert got == want
    assert {r[0] for r in want} == set(range(len(DIRTY))) - {16, 22, 23, 24} and sum(r[0] == 9 for r in want) == 4
