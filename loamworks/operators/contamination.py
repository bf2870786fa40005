"""Screening documents against a denylist of evaluation texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.stages import staged

#: Entries up to which a denylist is broadcast; beyond, candidates come from a shuffled join on an anchor.
BROADCAST_ENTRIES = 100_000
#: Characters of all entries up to which one automaton holds them (about 100 MB a worker).
AUTOMATON_CHARS = 1_000_000
_automata: dict[str, object] = {}


def _grams(text: Column, size: int) -> Column:
    """Distinct character n-grams of a text; a shorter text has none."""
    c = F.split(text, "")
    n = F.greatest(F.size(c) - (size - 1), F.lit(0))
    out = F.slice(c, F.lit(1), n)
    for j in range(2, size + 1):
        out = F.zip_with(out, F.slice(c, F.lit(j), n), lambda x, y: F.concat(x, y))
    return F.array_distinct(out)


def _automaton(key: str, entries: list[str]):
    """All entries as one automaton (goto and failure links), built once a worker."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            made.add_word(entry, i)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def _matches(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            found = _automaton(key, entries) if entries else None
            rows, which = [], []
            for i, text in enumerate(batch.column("_t").to_pylist()):
                hits = {j for _, j in found.iter(text)} if text and found else ()
                rows += [i] * len(hits)
                which += [entries[j] for j in hits]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(which, pa.string())], ["doc_id", "entry"])

    return run


def contained(docs: DataFrame, entries: DataFrame, text: str = "t", most: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, entry) for entries that occur in a document's text as a substring, each pair once.

    Entries of at most `most` characters in all are one automaton, which every text passes once, whole. More of them meet the texts in joins on
    anchors. Null and empty texts and entries match nothing.
    """
    entries = staged(entries.select(F.col("entry").cast("string").alias("entry")).distinct().filter("entry <> ''"), "denied")
    if (entries.agg(F.sum(F.length("entry")).alias("n")).first()["n"] or 0) > most:
        return _by_anchors(docs, entries, text)
    shared = docs.sparkSession.sparkContext.broadcast(sorted(r.entry for r in entries.collect()))  # `most` characters
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.select("doc_id", F.col(text).alias("_t")).mapInArrow(_matches(uuid.uuid4().hex, shared), f"doc_id {kind}, entry string")
    return staged(hits.distinct(), "denied-hits")


def _by_anchors(docs: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """contained() for entries of any number.

    Candidates share the longest of the entry's inner words (whole words even inside a document), as an equi-join of ids and
    words; an entry of fewer than three words has its first characters, three at most, as anchor instead. Texts are
    brought back to the candidates only.
    """
    words = F.split("entry", " ")
    inner = F.slice(words, 2, F.size(words) - 2)
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    entries = staged(entries.withColumn("anchor", F.when(F.size(words) >= 3, longest)).withColumn("size", F.when(F.col("anchor").isNull(), F.least(F.length("entry"), F.lit(3)))), "entries")
    d = docs.select("doc_id", F.col(text).alias("_t"))
    hint = "broadcast" if entries.count() <= BROADCAST_ENTRIES else "merge"
    tokens = d.select("doc_id", F.explode(F.array_distinct(F.split("_t", " "))).alias("anchor"))
    found = tokens.join(entries.filter("anchor IS NOT NULL").select("anchor", "entry").hint(hint), "anchor").select("doc_id", "entry")
    for (size,) in sorted(entries.filter("anchor IS NULL").select("size").distinct().collect()):  # three sizes at most
        few = entries.filter(F.col("size") == size).select(F.substring("entry", 1, size).alias("anchor"), "entry").hint(hint)
        found = found.union(d.select("doc_id", F.explode(_grams(F.col("_t"), size)).alias("anchor")).join(few, "anchor").select("doc_id", "entry"))
    found = staged(found.distinct(), "anchored")
    both = found.withColumnRenamed("doc_id", "_id").hint("merge").join(d, F.col("_id").eqNullSafe(F.col("doc_id"))).filter(F.contains("_t", "entry"))
    return both.select("doc_id", "entry").distinct()


def without_contained(docs: DataFrame, entries: DataFrame, text: str = "t") -> DataFrame:
    bad = staged(contained(docs, entries, text).select(F.col("doc_id").alias("_id")).distinct(), "containing")
    return docs.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def cover_candidates(docs: DataFrame, entries: DataFrame, size: int = 5, min_cover: float = 0.9) -> DataFrame:
    """(doc_id, item_id, cover) of documents and entries that share an anchor; entries without a shingle have none.

    A document may lack a share of 1 - min_cover of an entry's shingles. An entry's anchors are one more than that, those
    with the smallest hashes, so that every covering document has one. Only for candidates all shingles are intersected.
    """
    e = tx.with_shingles(entries.select("item_id", "text"), size).drop("text").filter(F.size("s") > 0)
    ordered = F.transform(F.array_sort(F.transform("s", lambda x: F.struct(tx.hash60(x).alias("h"), x.alias("x")))), lambda y: F.xxhash64(y["x"]))
    e = staged(e.select("item_id", ordered.alias("hashes")), "cover-entries")
    lacking = F.floor(F.size("hashes") * F.lit(round(1 - min_cover, 9)) + 1e-9).cast("int")
    a = e.select("item_id", F.explode(F.slice("hashes", F.lit(1), lacking + 1)).alias("h"))
    d = staged(tx.with_shingles(docs.select("doc_id", "text"), size).select("doc_id", F.transform("s", lambda x: F.xxhash64(x)).alias("ds")), "cover")
    hint = "broadcast" if a.limit(8 * BROADCAST_ENTRIES + 1).count() <= 8 * BROADCAST_ENTRIES else "merge"
    hits = staged(d.select("doc_id", F.explode("ds").alias("h")).join(a.hint(hint), "h").select("doc_id", "item_id").distinct(), "cover-hits")
    full = hits.join(d.hint("merge"), "doc_id").join(e.hint("merge"), "item_id")
    return full.select("doc_id", "item_id", (F.size(F.array_intersect("ds", "hashes")) / F.size("hashes")).alias("cover"))


def shingle_cover(docs: DataFrame, entries: DataFrame, size: int = 5, min_cover: float = 0.9) -> DataFrame:
    """(doc_id, item_id, cover): documents that hold at least min_cover of an entry's shingles."""
    return cover_candidates(docs, entries, size, min_cover).filter(F.col("cover") >= min_cover)


def normalised(text: Column) -> Column:
    """Lower-cased tokens joined by single spaces."""
    return F.array_join(tx.tokens(text), " ")


def screen(docs: DataFrame, entries: DataFrame, size: int = 5, min_shingles: int = 8, min_cover: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text), entries(text) -> (doc_id, kind, entry) of the contaminated documents, and the audit of one row.

    Entries are compared in normal form. One of fewer than min_shingles shingles must occur exactly, as a substring; short
    entries come first, then long ones, each in the order of the forms, and the first match is recorded.
    """
    forms = entries.select(normalised(F.col("text")).alias("text")).filter("text <> ''").distinct()
    forms = tx.with_shingles(forms, size).select("text", (F.size("s") < min_shingles).alias("short"))
    forms = staged(forms, "screen-entries")
    short = contained(docs.select("doc_id", normalised(F.col("text")).alias("t")), forms.filter("short").select(F.col("text").alias("entry")))
    long = staged(cover_candidates(docs, forms.filter(~F.col("short")).select(F.col("text").alias("item_id"), "text"), size, min_cover), "screen-long")
    hits = short.select("doc_id", F.lit(0).alias("order"), "entry").union(long.filter(F.col("cover") >= min_cover).select("doc_id", F.lit(1), F.col("item_id")))
    first = hits.groupBy("doc_id").agg(F.min(F.struct("order", "entry")).alias("m"))
    first = staged(first.select("doc_id", F.when(F.col("m.order") == 0, "short").otherwise("long").alias("kind"), F.col("m.entry").alias("entry")), "screened")
    n = docs.agg(F.count("*").alias("input_documents"))
    e = forms.agg(F.count("*").alias("entries"), F.count_if("short").alias("short_entries"))
    m = first.agg(F.count("*").alias("removed_documents"), F.count_distinct("entry").alias("matched_entries"))
    c = long.agg(F.count("*").alias("candidate_checks"))
    audit = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(m)).crossJoin(F.broadcast(c))  # one row each
    return first, audit.withColumn("retained_documents", F.col("input_documents") - F.col("removed_documents"))
