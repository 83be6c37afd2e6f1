"""What grows with the rows is not sent through the driver, whatever Spark would broadcast by itself."""

from __future__ import annotations

from newsloom.llm.common import staging
from newsloom.llm.simhash import drop_near, near_duplicates


def _broadcast_rows(spark, since: int) -> tuple[int, int]:
    """The most rows of a broadcast in the executions from ``since`` on, and the next execution."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    found = store.executionsList()
    ids = [found.apply(i).executionId() for i in range(found.size())]
    for at in ids:
        if at >= since:
            values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
            for node in map(nodes.apply, range(nodes.size())):
                for metric in map(node.metrics().apply, range(node.metrics().size())) if node.name() == "BroadcastExchange" else ():
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.get(metric.accumulatorId()).get().replace(",", "")))
    return most, max(ids, default=-1) + 1


def test_near_copies_broadcast_hot_keys_only(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[(i * 31 + j * (i % 97 + 1)) % 400] for j in range(12)) + f" only{i}") for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    _, since = _broadcast_rows(spark, 0)
    with staging():
        assert near_duplicates(docs).count() == 3000
        kept = drop_near(docs).count()
    assert 0 < kept <= 3000
    assert _broadcast_rows(spark, since)[0] < 1000  # the hot keys' bound
