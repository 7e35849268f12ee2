import pytest

from lexspark.llm import characters as C

CASES = {
    "ｄｅｒｇｉｌｉｇ̆ｉ": "dergiliği",
    "önce bu": "önce bu",
    "kаnаllı": "kanallı",
    "νе": "ve",
    "\nс) Kum, ӧnce": "\nc) Kum, önce",
    "a­b​c": "abc",
    "ﬁdan": "fidan",
    "i̇yi": "iyi",
    "İGUHK": "İGUHK",
    "Buradaki “μέρος” ve “закон”, 45 m² – …": None,
    "👩‍⚖️": None,
    "ığüşöç İĞÜŞÖÇ hâl": None,
    "": None,
}


@pytest.mark.parametrize("text", CASES)
def test_text(text):
    want = text if CASES[text] is None else CASES[text]
    assert C.consistent(text) == want
    assert C.consistent(want) == want


def test_code_and_conflicts():
    assert C.consistent("ТLDTК ", code=True) == "TLDTK"
    assert C.consistent("T\u00a0LD²𝐓\U0001f13a", code=True) == "T LD2TK"
    assert C.consistent(None) is None
    with pytest.raises(ValueError):
        C.checked({"a": "b", "b": "c"})


def test_changed(spark):
    rows = [(i, t, "x") for i, t in enumerate([*CASES, None, " TLDTK", "x" * 100_000 + "​"])]
    df = spark.createDataFrame(rows, "row_id bigint, t string, src string")
    got = {r["row_id"] for r in C.changed(df, "row_id", "t", "madde").collect()}
    assert got == {i for i, t, _ in rows if t is not None and C.consistent(t) != t}
    codes = spark.createDataFrame([(1, " TLDTK"), (2, "TLDTK"), (3, None)], "row_id bigint, t string")
    assert [r["row_id"] for r in C.changed(codes, "row_id", "t", "hit", code=True).collect()] == [1]
    assert C.changed(codes.limit(0), "row_id", "t", "hit").count() == 0
