import random

import pytest
from lexspark.llm import languages as L
from pyspark.sql import functions as F

STOCK = {
    "tr": "mahkeme karar dava için süre içinde verilir bildirilir taraflar hakkında kanun uyarınca ödeme yapılır kiracı sözleşme ile belirlenir gün sonra yeni başvuru kabul edilir".split(),
    "en": "the court shall decide that every party of this contract must pay within thirty days and where notice is given by tenant no claim may follow after such decision".split(),
    "de": "das gericht entscheidet dass jede partei dieses vertrages innerhalb von dreißig tagen zahlen muss und der mieter nicht ohne bescheid durch den vermieter gebunden wird".split(),
    "fr": "le tribunal décide que chaque partie du contrat doit payer dans un délai de trente jours et aucun locataire ne sera lié sans avis par le bailleur régional".split(),
    "es": "el tribunal decide que cada parte del contrato debe pagar dentro de treinta días y ningún inquilino queda obligado sin aviso por el arrendador después del plazo".split(),
    "az": "məhkəmə hər bir müqavilə üzrə qərar verir və otuz gün ərzində ödəniş edilir bu barədə icarəçi əlavə məlumat alır belə hallarda vərəsə qanun əsasında gözləyir".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choices(STOCK[lang], k=rng.randint(8, 14))).capitalize() + "."


@pytest.fixture(scope="module")
def made():
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(600):
        lang = rng.choice(L.LANGUAGES)
        text = " ".join(sentence(rng, lang) for _ in range(rng.randint(2, 8)))
        state, label, langs = "right", rng.choice([lang, lang.upper(), f"{lang}-XX"]), {lang}
        if i % 10 == 0:
            state, label = "wrong", rng.choice([x for x in L.LANGUAGES if x != lang])
        elif i % 10 == 1:
            state, label = "missing", rng.choice([None, " ", "und", "-"])
        elif i % 10 == 2:
            other = rng.choice([x for x in L.LANGUAGES if x != lang])
            text += rng.choice([" ", "\n\n"]) + " ".join(sentence(rng, other) for _ in range(3))
            state, langs = "mixed", {lang, other}
        elif i % 10 == 3:
            text += " " + " ".join(STOCK["en" if lang != "en" else "tr"][:4]) + "."
        rows.append((i, text, label, "x"))
        truth[i] = {(state, x) for x in langs}
    return rows + [(700, None, "tr", "x"), (701, "", None, "x"), (702, "12 ; 34", "tr", "x"), (703, "x" * 50_000, "tr", "x")], truth


def test_documents_and_segments(spark, made):
    rows, truth = made
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, state string")
    found = L.segments(df, L.fit(df, "doc_id", "text", "lang"))
    got = {}
    for r in L.languages(found).collect():
        got.setdefault(r["doc_id"], set()).add((r["state"], r["lang"]))
        assert 0 <= r["confidence"] <= 1
    assert not {700, 701, 702} & got.keys()
    wrong = [i for i in truth if got.get(i) != truth[i]]
    assert len(wrong) <= 0.02 * len(truth), [(i, got.get(i), truth[i]) for i in wrong[:5]]
    text = {r[0]: r[1] for r in rows}
    for r in found.collect():
        own = r["segments"]
        assert "".join(text[r["doc_id"]][s["start"] : s["end"]] for s in own) == (text[r["doc_id"]] if own else "")
    assert L.segments(df.limit(0), L.fit(df.limit(0), "doc_id", "text", "lang")).count() == 0


def test_labels(spark):
    names = {"tr": "tr", "TR": "tr", "tr_TR": "tr", "Türkçe": "tr", "İngilizce": "en", "es-ES": "es", " Deutsch ": "de", "AZ": "az", "it": "other", "und": "", "UNKNOWN": "", None: "", "  ": "", "-": ""}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "a string, b string")
    assert [r for r in df.withColumn("c", L.label_language(F.col("a"))).collect() if r["b"] != r["c"]] == []


def test_narrow_margins_are_rejected():
    rng = random.Random(5)
    dictionaries = L.train([(lang, " ".join(sentence(rng, lang) for _ in range(5))) for lang in STOCK for _ in range(40)])
    c = L.Classifier(dictionaries)
    import numpy as np

    tr, en, de = (c.langs.index(x) for x in ("tr", "en", "de"))
    near = np.full((5, len(c.langs)), 90)
    near[:2, tr], near[2, en], near[2, tr], near[3:, tr] = 40, 60, 61, 40
    assert [(x[0], x[1], x[2], x[4]) for x in c.accepted([tr, tr, en, tr, tr], near, "")] == [(tr, 0, 5, True)]
    alone = np.full((1, len(c.langs)), 90)
    alone[0, tr], alone[0, de] = 60, 61
    assert [(x[0], x[4]) for x in c.accepted([tr], alone, "")] == [(tr, False)]
    assert [(x[0], x[4]) for x in c.accepted([tr], alone, "de")] == [(de, False)]
    assert [(x[0], x[4]) for x in c.accepted([tr], alone, "fr")] == [(tr, False)]
    found = c.documents([sentence(rng, "tr"), "Qwx 1."], ["", ""])
    assert found[0][0]["sure"] and not found[1][0]["sure"]
