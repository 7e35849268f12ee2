import random
import textwrap

from lexspark.llm import scans

VOCABULARY = "mahkeme karar taraf kiracı sözleşme ödeme bildirim süre kanun başvuru denetim komisyon istasyon nakliye arazi belediye okul sınav liman depo yönetim tarife kefil senet".split()
ENDS = ["verilir", "bildirilir", "yapılır", "kaldırılır", "uygulanır"]
TITLE = "Limanlar ve Depolar Düzenlemesi Hakkında Kanun"


def paragraph(rng):
    return " ".join(" ".join(rng.choices(VOCABULARY, k=rng.randint(5, 9))).capitalize() + f" {rng.choice(ENDS)}." for _ in range(rng.randint(2, 4)))


def scanned(rng, paragraphs):
    """The paragraphs as a scan has them, and the kinds of noise put in."""
    kinds, lines = set(), []
    for p in paragraphs:
        own = textwrap.wrap(p, 60)
        for i in range(len(own) - 1):
            head, _, word = own[i].rpartition(" ")
            if head and len(word) > 7 and word.isalpha() and rng.random() < 0.3:
                own[i], own[i + 1] = f"{head} {word[:4]}{rng.choice(['-', '¬', '- '])}", word[4:] + " " + own[i + 1]
                kinds.add("hyphen")
        lines += own
    for kind, made in (("page_no", lambda: rng.choice(["– 12 –", "[34]", "Sayfa : 7", "      56", "7/90"])), ("header", lambda: rng.choice([TITLE.upper().replace("I", "I"), TITLE + " (21000)", "RESMÎ BÜLTEN – 3 Mart 2030"]))):
        if rng.random() < 0.4:
            lines.insert(rng.randint(1, len(lines) - 1), made())
            kinds.add(kind)
    text = "\n".join(lines)
    if rng.random() < 0.4:
        for right, wrong in rng.sample([("kanun", "k4nun"), ("mahkeme", "rnahkeme"), ("sınav", "slnav"), ("okul", "okııl"), ("başvuru", "bas,vuru"), ("depo", "clepo")], 4):
            if right in text:
                text = text.replace(right, wrong, 1)
                kinds.add("misread")
                break
    return text, kinds


def test_kinds_and_text(spark):
    rng = random.Random(12)
    rows, truth, clean = [], {}, {}
    for i in range(400):
        paragraphs = [f"({k + 1}) {paragraph(rng)}" for k in range(rng.randint(1, 3))]
        clean[i] = "\n".join(paragraphs)
        text, truth[i] = scanned(rng, paragraphs) if i % 2 else (clean[i], set())
        rows.append((i, "metin", text, TITLE))
    rows += [(900, "metin", None, TITLE), (901, "metin", "", None), (902, "metin", "(I) SAYILI CETVEL\n1 Depo ve liman 12,50\n2 Okul 13,75\n3 Senet 8,00", TITLE), (903, "metin", "x" * 100_000, TITLE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, field string, text string, title string, kind string")
    noise, texts = scans.repair(df)
    got = {}
    for r in noise.collect():
        got.setdefault(r["row_id"], set()).add(r["kind"])
    wrong = [i for i in truth if got.get(i, set()) != truth[i]]
    assert len(wrong) <= 6, [(rows[i][2], got.get(i), truth[i]) for i in wrong[:3]]
    assert {i: got[i] for i in (900, 901, 902, 903) if i in got} == {}
    fixed = {r["row_id"]: r["text"] for r in texts.collect()}
    assert sum(fixed[i] == clean[i] for i in clean) >= 0.95 * len(clean), next((fixed[i], clean[i]) for i in clean if fixed[i] != clean[i])
    assert 900 not in fixed and fixed[901] == ""


def test_empty_table(spark):
    noise, texts = scans.repair(spark.createDataFrame([], "row_id bigint, field string, text string, title string"))
    assert noise.count() == 0 and texts.count() == 0


def test_words_of_many_misread_letters(spark):
    counts = [("karılılıkı", 90, 90), ("alblci", 40, 40), ("allbblci", 40, 40), ("okul", 50, 50), ("a1b1c1", 2, 0), ("k4r1l1l1k1", 1, 0), ("a11bb1c1", 1, 0), ("0ku1", 1, 0), ("madde1", 1, 0), ("k4r1l1l1k1" * 50, 1, 0)]
    df = spark.createDataFrame(counts + [("karılılıkı" * 50, 30, 30)], "word string, n bigint, plain bigint")
    found = {r["word"]: r["right"] for r in scans.misread_words(df).collect()}
    assert found == {"a1b1c1": "alblci", "k4r1l1l1k1": "karılılıkı", "a11bb1c1": "allbblci", "0ku1": "okul", "k4r1l1l1k1" * 50: "karılılıkı" * 50}
