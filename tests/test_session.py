from lexspark.operators.ranking import join_groups
from lexspark.session import part_of, shared_folder, stored, written


def test_written_tables_and_their_parts(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "", 1)], "id bigint, t string, part int")
    assert sorted(stored(df, "part").collect()) == sorted(df.collect())
    path = written(df, "part")
    assert path.startswith(shared_folder(spark))
    assert part_of(path, "part", 1).sort_by("id").to_pydict() == {"id": [2, 3], "t": [None, ""]}
    assert part_of(path, "part", 7) is None
    assert stored(df.limit(0)).count() == 0


def test_join_groups_with_a_large_group(spark):
    members = spark.range(1000).selectExpr("if(id < 700, 'hot', concat('k', id % 50)) as k", "id")
    sizes = members.groupBy("k").count()
    joined = join_groups(members, sizes, ["k"], "count", rows=40).collect()
    assert sorted(r["id"] for r in joined) == list(range(1000))
    assert {r["count"] for r in joined if r["k"] == "hot"} == {700}
    assert join_groups(members.limit(0), sizes.limit(0), ["k"], "count").count() == 0
