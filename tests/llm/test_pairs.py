import random

from lexspark.llm import languages, pairs
from test_languages import STOCK, sentence


def test_copies():
    q = "Kira sözleşmesi hangi süre içinde hangi şekilde yenilenir ve kime bildirilir?"
    for answer in (q, q.upper(), f"Sormuş olduğunuz soru aşağıdaki gibidir: {q}", f"{q} {q} [A m.1]", q.replace("sözleşmesi", "sözleşmeleri"), q.replace("sözleşmesi", "söz­leş­mesi"), "Kirа" + q[4:]):
        assert pairs.copies(q, answer), answer
    for answer in (q + " Otuz gün içinde yazılı olarak yenilenir.", q.replace("hangi süre", "otuz gün"), "Kira sözleşmesi yenilenir.", q[: len(q) // 2], "", "Otuz gün.", q.replace("kime", "kiracıya").replace("hangi", "bu")):
        assert not pairs.copies(q, answer), answer
    assert not pairs.copies("Kira sözleşmesi yazılı olarak yapılır mı?", "Kira sözleşmesi yazılı olarak yapılır.")
    assert pairs.copies("söz " * 5000, "söz " * 5000) and not pairs.copies("?", "?")


def test_rows(spark):
    rng = random.Random(11)
    dictionaries = languages.train([(lang, " ".join(sentence(rng, lang) for _ in range(5))) for lang in STOCK for _ in range(40)])
    ends = ["verilir", "bildirilir", "yapılır", "belirlenir"]
    words = [w for w in STOCK["tr"] if w not in ends]

    def sound():
        return " ".join(rng.choices(words, k=8)).capitalize() + f" {rng.choice(ends)}"

    question = "Mahkeme kararı hangi süre içinde bildirilir mi?"
    good = [sound() + ". [TLDTK m.5]" for _ in range(200)] + [sound() for _ in range(10)] + [sound() + " [X m.Geçici 1]." for _ in range(5)] + ["Evet.", "Hayır. " + sound() + ".", "On beş gün.", "30 iş günü", "Taraf kiracıya yardımcı olamaz.", question + " " + sound() + ".", sound() + " (yeni karar) [A m.3]"]
    bad = {
        "empty": [None, "", " ", "—", "[TLDTK m.5]", " [A m.1] [B m.2]. "],
        "truncated": [sound() + ". Mahkeme yeni karar", "Taraflar hakkında süre içi", "Mahkeme karar için,", sound() + " [TLDTK m", "Taraflar süre (kiracı", "Mahkeme yeni karar için [A m.2]", sound() + "; karar m."],
        "refusal": ["Üzgünüm, bu konuda yardımcı olamam.", "Bir dil modeli olarak bu soruya cevap veremiyorum; başka bir sorunuz varsa sorabilirsiniz.", "Kusura bakmayın, benden böyle bir yorum beklemeyin. [A m.1]"],
        "copies_question": [question, question.upper(), f"Soru: {question}", f"{question} {question}", f"  {question.replace(' ', '  ')[:-1]} [A m.1]"],
        "other_language": [sentence(rng, x) for x in ("en", "de", "fr", "es", "az")] + ["Evet. " + sentence(rng, "fr") + " [A m.1]"],
    }
    rows = [(g, None) for g in good] + [(a, kind) for kind, own in bad.items() for a in own]
    df = spark.createDataFrame([(i, question, a, "x") for i, (a, _) in enumerate(rows)] + [(900, None, "x" * 50_000 + ".", "x")], "qa_id bigint, question string, answer string, defect string").repartition(3)
    got = {r["qa_id"]: r["defect"] for r in pairs.defects(df, dictionaries).collect()}
    got.pop(900, None)
    assert {i: (rows[i][0], got.get(i), rows[i][1]) for i in range(len(rows)) if got.get(i) != rows[i][1]} == {}
    assert pairs.defects(df.limit(0), dictionaries).count() == 0
    assert pairs.defects(df.limit(3), {}).count() >= 0
