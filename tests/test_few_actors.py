"""Fewer people than clusters."""

from tendermill.plans import clusters


def test_few_people_are_clusters_of_their_own(spark):
    rows = [("a", "p", "w1", 10.0), ("a", "q", "w2", 10.0), ("b", "p", "w1", 10.0), ("b", None, "w1", 900.0)]
    lots = spark.createDataFrame(rows, "discipline string, actor_name string, winner_name string, total_price_eur double")
    got = {(r.discipline, r.actor_name): r.cluster for r in clusters.actor_clusters(lots).collect()}
    assert len(got) == 4 and set(got.values()) == {0, 1, 2}
    assert got["a", "p"] == got["b", "p"]
    alone = clusters.actor_clusters(lots.limit(1)).collect()
    assert [r.cluster for r in alone] == [0]
    assert clusters.actor_clusters(lots.where("false")).count() == 0
