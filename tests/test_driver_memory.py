"""What the queries over combinations send through the driver: rows of images, never of pixels or stars."""

import os

import pytest

from pixelrel.plans import catalog

SF = "/root/testdata/sf0.001"


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    listed = store.executionsList()
    return store, {listed.apply(i).executionId() for i in range(listed.size())}


def broadcast_rows(spark, run):
    """Rows of each broadcast that was made while run() ran, the tables written on the way included."""
    before = executions(spark)[1]
    run()
    store, after = executions(spark)
    found = []
    for execution in after - before:
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                counts = (node.metrics().apply(i) for i in range(node.metrics().size()))
                found += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in counts if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return found


@pytest.mark.parametrize("name", ["combo_union", "alignment_check", "merged_crops"])
def test_no_pixels_are_broadcast(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    frame = catalog.raw(spark, SF).groupBy("image_id").count().collect()
    sent = broadcast_rows(spark, lambda: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert sent and max(sent) < min(r["count"] for r in frame) / 3, sorted(sent)
