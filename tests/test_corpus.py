import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import corpus as C
from lexspark.operators import ranking as R

LAW = """Sayfa : 1
KANUN

MADDE 1 – Amaç
(1) Bu Kanunun amacı düzenlemektir.
(2) Kapsam geniştir.
 7
Madde 2- (1) Tanımlar şunlardır.
GEÇİCİ MADDE 1 – Geçiş
Eski hükümler uygulanır.
Ek Madde 3
Ek hüküm burada.
(I) SAYILI CETVEL
1 Ada 12,5
"""


def test_segment(spark):
    df = spark.createDataFrame([("K", LAW, 1), ("none", "Başlıksız metin", 2), ("null", None, 3), ("empty", "", 4)], "law string, text string, pos int")
    rows = C.segment(df, "law", "text").orderBy("pos").collect()
    assert [(r["madde_no"], r["madde_type"], r["baslik"]) for r in rows] == [("1", "normal", "Amaç"), ("2", "normal", None), ("Geçici 1", "gecici", "Geçiş"), ("Ek 3", "ek", "Ek hüküm burada.")]
    assert rows[0]["fikralar"] == ["Bu Kanunun amacı düzenlemektir.", "Kapsam geniştir."] and rows[3]["metin"] == "Ek hüküm burada."
    compat = C.segment(df, "law", "text", kind=T.article_kind_compat)
    assert [r["madde_no"] for r in compat.orderBy("pos").collect()] == ["1", "2", "1", "Ek 3"]
    assert C.segment(df.limit(0), "law", "text").count() == 0


def test_first_per_key_and_codes(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")] + [("hot", i, "h") for i in range(200)], "k string, o int, v string").repartition(5)
    assert sorted((r["k"], r["v"], r["o"]) for r in C.first_per_key(df, ["k"], ["o"]).collect()) == [("a", "y", 1), ("b", "z", 1), ("hot", "h", 0)]
    madde = spark.createDataFrame([(1, "T1_5", 5, "T1_5_m1"), (2, "X", None, "X_m2"), (3, "Y", 7, "Z_m3"), (4, None, 5, "q")], "row_id int, kanun_short string, kanun_no int, doc_id string")
    laws = spark.createDataFrame([(5, "ABC"), (None, "no")], "kanun_no int, short_name string")
    got = {r["row_id"]: (r["kanun_short"], r["doc_id"], r["normalised"]) for r in C.with_law_codes(madde, laws).collect()}
    assert got == {1: ("ABC", "ABC_m1", True), 2: ("X", "X_m2", False), 3: ("Y", "Z_m3", False), 4: ("ABC", "q", True)}


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_ranks_do_not_depend_on_partitions(spark, parts):
    rows = [(i, "hot" if i % 3 else ["a", None, "c"][i % 5 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string").repartition(parts)
    import hashlib

    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, x in rows if x == g)
        want |= {i: (k + 1, len(own)) for k, (_, i) in enumerate(own)}
    got = {r["id"]: (r["rank"], r["group_size"]) for r in R.hash_rank(df, ["g"], F.col("id")).collect()}
    assert got == want
    whole = R.hash_rank(df, [], F.col("id")).collect()
    assert sorted(r["rank"] for r in whole) == list(range(1, 401))


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 97 else "c") for i in range(100)], "id int, g string")
    taken = R.stratified_sample(df, "g", F.col("id"), 30).groupBy("g").count().collect()
    assert sum(r["count"] for r in taken) == 30 and {r["g"]: r["count"] for r in taken}["c"] == 3
    split = {(r["g"], r["split"]): r["count"] for r in R.stratified_split(df, "g", F.col("id")).groupBy("g", "split").count().collect()}
    assert split == {("a", "test"): 18, ("a", "dev"): 72, ("b", "test"): 1, ("b", "dev"): 6, ("c", "dev"): 3}
    assert {r["share"]: r["value"] for r in R.nearest_rank(df, F.col("id"), [0.0, 0.5, 0.99]).collect()} == {0.0: 0, 0.5: 50, 0.99: 99}
    assert R.stratified_sample(df.limit(0), "g", F.col("id"), 5).count() == 0
