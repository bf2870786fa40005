"""Documents of few files are spread over the cores before their shingles are made."""

import pytest

from loamworks.plans import audits


def test_documents_of_a_fresh_slice_are_spread(spark, monkeypatch):
    class Seen(Exception):
        pass

    def cover(docs, items):
        raise Seen(docs.rdd.getNumPartitions())

    monkeypatch.setattr(audits.contamination, "shingle_cover", cover)
    with pytest.raises(Seen) as seen:
        audits.so_fresh_slice(spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] >= spark.sparkContext.defaultParallelism
