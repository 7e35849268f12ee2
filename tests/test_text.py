from pyspark.sql import functions as F

from lexspark.functions import text as T


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lower_and_tokens(spark):
    assert one(spark, T.tr_lower, "İIĞÜ", None, "") == ["iığü", None, ""]
    assert one(spark, T.tokenize, "Madde 5 – IŞIK, âdil!", None, "…") == [["madde", "5", "ışık", "âdil"], [], []]
    assert one(spark, T.normalize_tr, "ＡＢ  ﬁ\n x ", None, "Ğ") == ["ab fi x", "", "ğ"]
    assert one(spark, T.tokens, "Straße m² ok_1") == [["straße", "m2", "ok_1"]]


def test_ngrams(spark):
    words = lambda n: lambda x: T.ngrams(F.split(x, " "), n)
    assert one(spark, words(2), "a b c", "a") == [["a b", "b c"], []]


def test_cleaning(spark):
    raw = "Bir\r\n 12 \nİki   üç\nResmî Sayfa : 7 metin\n\n\n\nDört\n"
    assert one(spark, T.clean_text, raw, "", None) == ["Bir\n\nİki üç\n\nDört", "", None]
    tail = "Madde metni.\n(II) SAYILI CETVEL\n1 Ada 2,5"
    assert one(spark, T.trim_tail, tail, "KOORDİNAT LİSTESİ", "Düz metin", None) == ["Madde metni.", "", "Düz metin", None]


def test_paragraphs_and_headings(spark):
    assert one(spark, T.paragraphs, "giriş\n(1) Bir.\n(2) İki.\n a) alt", "Tek metin", "", "(1) ") == [["Bir.", "İki.\n a) alt"], ["Tek metin"], [], []]
    got = one(spark, T.heading_and_body, "Amaç\n(1) Metin.", "(1) Metin.\nDevam", "Yalnız", "x" * 130 + "\nson")
    assert [(r["heading"], r["body"][:10]) for r in got] == [("Amaç", "(1) Metin."), (None, "(1) Metin."), ("Yalnız", "Yalnız"), (None, "x" * 10)]


def test_kinds(spark):
    markers = ["GEÇİCİ MADDE 1", "Geçici Madde 2", "EK MADDE 3", "Madde 4"]
    assert one(spark, T.article_kind, *markers) == ["gecici", "gecici", "ek", "normal"]
    assert one(spark, T.article_kind_compat, *markers) == ["normal", "gecici", "ek", "normal"]


def test_citations(spark):
    assert one(spark, T.citations, "Bkz. [TCK m.299] ve [İIK m 12/1], [TCK m.299]", None) == [["tck|299", "iık|12/1"], []]
    pairs = [[["IIK", "12/1"], ["TCK"], None], None, []]
    kind = "array<array<string>>"
    assert one(spark, T.citation_keys, *pairs, kind=kind) == [["ıık|12/1"], [], []]
    assert one(spark, lambda x: T.citation_keys(x, True), *pairs, kind=kind)[0] == ["ıık|12"]
    assert one(spark, T.citation_keys_compat, *pairs, kind=kind)[0] == ["iik|12/1"]


def test_json_and_numbers(spark):
    replies = ['Tabii:\n```json\n{"a": 1}\n```', "yok", "{bozuk", None]
    assert one(spark, lambda x: T.json_part(x, array=False), *replies) == ['{"a": 1}', None, None, None]
    assert one(spark, lambda x: T.json_part(x, array=True), 'x [1, {"b": 2}] y') == ['[1, {"b": 2}]']
    import hashlib

    assert one(spark, lambda x: T.md5_bucket(x, 7), "TCK_m1", "") == [int(hashlib.md5(b).hexdigest(), 16) % 7 for b in (b"TCK_m1", b"")]
    assert one(spark, T.number_or_dash, 0.5, None, kind="double") == ["0.5000", "—"]
