"""The corpus pipeline: five of the training-data operators, each stage on all that its predecessor kept.

A stage is written as Parquet and read back as the next one's documents. All but the last return the columns of documents, and
others that the table has, whatever their names. In every stage a null id is a document as any other, very long texts are
worked on whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamworks.llm import common, decontaminate, mixing, ngram_join, quality_rules, sharding


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of lines that their host repeats go; such lines go from the rest.

    Null and empty texts go (no words). A null source is a host of its own. Repeated rows share their verdict; no ties arise.
    """
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest doc_id, then the smallest text hash.

    Null, empty and wordless texts link with nothing and stay. Of rows alike in doc_id and text one stays.
    """
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more go; repeated rows go or stay together.

    Null and empty texts hold nothing and stay; null and empty items are in no document.
    """
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Null and empty texts have no words; they follow the whole repetitions of their source. A null source is one of its own. Rows
    alike in everything are dealt what the plan takes of them evenly; ties of the order go by doc_id and size.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document row.

    Null texts are one group, of size 1 each. Repeated rows are rows of their own, in one shard if it has room; ties between
    shards are broken by a seeded hash.
    """
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]
#: Components of similar documents and label propagation aren't expressible in SQL; tests/llm holds the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = common.materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
