"""Members are numbered only where their place is used."""

from cairnway.sources.tables import Tables


def test_listed_members_are_the_members(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    columns = ["relation_id", "member_type", "ref"]
    assert sorted(map(tuple, t.listed().collect())) == sorted(map(tuple, t.members().select(*columns).collect()))
    assert "Window" not in t.listed()._jdf.queryExecution().optimizedPlan().toString()
