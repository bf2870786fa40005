"""Nodes of pages are given out in pieces, however many pages a batch holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from loamworks.operators import rendering


def test_nodes_come_in_pieces_and_are_whole(spark):
    page = "<body><p>" + "word " * 20 + "<a href=x>go</a></p>" * 3 + "<script>no</script></body>"
    pages = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 7 > 0, F.lit(page)).alias("html"))
    nodes = rendering.page_nodes(pages)
    assert nodes.count() == 4 * sum(i % 7 > 0 for i in range(30_000))

    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array([page] * 20_000)], ["page_id", "html"])
    parts = [b.num_rows for b in rendering._node_batches(True)(iter([batch]))]
    assert sum(parts) == 80_000 and max(parts) <= 4 * (rendering.PAGE_PIECE // len(page) + 1)
    assert rendering.page_text(pages, 20_000).count() == sum(i % 7 > 0 for i in range(30_000))
    no = rendering.page_nodes(pages.limit(5), ancestors=False).collect()
    assert [r[:2] + r[3:] for r in no] == [r[:2] + r[3:] for r in rendering.page_nodes(pages.limit(5)).collect()] and not any(r.ancestors for r in no)
