"""Names and tags that many rows share are looked up once and still count for every row."""

from cairnway.operators import pages


def test_every_listing_of_a_mentioning_page_counts(spark):
    candidates = spark.createDataFrame([(1, "Lake Path"), (2, "Lake Path"), (3, "Hill Path")], "candidate_id long, name string")
    url = "https://a.example/x"
    listed = spark.createDataFrame([(1, url), (1, url), (2, url), (3, url)], "candidate_id long, url string")
    results = spark.createDataFrame(
        [(url, "one", "the Lake Path today"), (url, "one", "the Lake Path today"), (url, "two", "nothing")],
        "canonical_url string, title string, content string",
    )
    found = pages.supported(candidates, listed, results)
    assert sorted((r["candidate_id"], r["sources"]) for r in found.collect()) == [(1, 4), (2, 2)]
    # A name is tested against an address once: the pair is reduced before pages are met.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [canonical_url" in plan and "name_key" in plan.split("Contains")[0]
