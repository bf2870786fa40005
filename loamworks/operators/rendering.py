"""Rendering, packing, masking and parsing of texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged

from ..functions.ranks import global_rank

MARK = "<|{}|>"


def render(conversations: DataFrame) -> DataFrame:
    """One role-marked string per conversation, turns in order."""
    m = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>"), x["text"])), "\n").alias("rendered"))


def pack(docs: DataFrame, order: list[str], length: Column, row_tokens: int) -> DataFrame:
    """Fixed rows of a token stream in which every document is followed by one end token.

    -> per document and row it touches: the ids in `order`, row, start in the row, tokens. Offsets come from a distributed
    running sum, and a long document is cut where rows end, so nothing is gathered.
    """
    d = global_rank(docs.withColumn("_n", (length + 1).cast("long")), order, "_from", F.col("_n"))
    first, last = F.expr(f"_from div {row_tokens}"), F.expr(f"(_from + _n - 1) div {row_tokens}")
    rows = d.withColumn("row", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_from"), F.col("row") * row_tokens)
    end = F.least(F.col("_from") + F.col("_n"), (F.col("row") + 1) * row_tokens)
    return rows.select(*order, "row", (start - F.col("row") * row_tokens).alias("start"), (end - start).alias("tokens"))


def aliases(names: DataFrame, group: str, name: str, prefix: str) -> DataFrame:
    """(group, name, alias): each group's distinct names numbered in hash order."""
    distinct = names.select(group, name).distinct()
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", group, name), 256), name))
    return distinct.withColumn("alias", F.concat(F.lit(prefix), k.cast("string")))


class _Nodes(HTMLParser):
    """Elements of a page with their depth, own text and ancestors' text place."""

    SKIP = frozenset(["script", "style", "head", "noscript", "template"])

    def __init__(self, ancestors: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.ancestors = ancestors
        self.open: list[int] = []
        self.nodes: list[list] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.hidden += 1
        self.nodes.append([tag, list(self.open) if self.ancestors else [], [], bool(self.hidden)])
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][0] == tag:
                for j in self.open[i:]:
                    self.hidden -= self.nodes[j][0] in self.SKIP
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.nodes[self.open[-1]][2].append(data)


def _parse(page: str | None, ancestors: bool = True) -> list[list]:
    p = _Nodes(ancestors)
    p.feed(page or "")
    p.close()
    return p.nodes


#: Characters of pages whose nodes a task holds at a time.
PAGE_PIECE = 1 << 20


def _node_batches(ancestors: bool):
    names = ["page_id", "node", "ancestors", "tag", "text"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, page in zip(batch.column("page_id"), batch.column("html")):
                i, page = i.as_py(), page.as_py()
                for k, (tag, above, text, hidden) in enumerate(_parse(page, ancestors)):
                    t = " ".join("".join(text).split())
                    if not hidden and (t or tag in ("a", "button", "input", "select", "textarea")):
                        rows.append((i, k, above, tag, t))
                held += len(page or "")
                if held >= PAGE_PIECE:
                    yield packed(rows)
                    rows, held = [], 0
            yield packed(rows)

    return run


def page_nodes(pages: DataFrame, ancestors: bool = True) -> DataFrame:
    """pages(page_id, html) -> page_id, node, ancestors, tag, text: one row per element with text of its own or an interactive tag, numbered in page order.

    Nodes are given out after about PAGE_PIECE characters of pages, whatever a batch holds. Without `ancestors` theirs are empty.
    """
    return pages.select("page_id", "html").mapInArrow(_node_batches(ancestors), "page_id long, node long, ancestors array<long>, tag string, text string")


def page_text(pages: DataFrame, limit: int) -> DataFrame:
    """Visible text of a page, squeezed and bounded to `limit` characters."""
    n = page_nodes(pages, ancestors=False).filter("text <> ''").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("n"))
    return n.select("page_id", F.substring(F.array_join("n.text", " "), 1, limit).alias("text"))


def rank_nodes(nodes: DataFrame, tasks: DataFrame, budget: int) -> DataFrame:
    """Nodes of each page within a byte budget, best first by (phrase hit, own overlap, overlap of all ancestors, interactive), and their place in page order.

    tasks(page_id, task). Overlap counts the task's distinct words. The budget is filled by a running sum over the ranking; a node that doesn't
    fit ends it. A page without a task has no rows; ties go by page order.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != ""))
    both = nodes.join(tasks.hint("merge"), "page_id").withColumn("hits", F.array_intersect(words(F.col("text")), words(F.col("task"))))
    both = staged(both, "nodes")  # pages are parsed once
    # What the ancestors say of the task: only those that say something meet their descendants.
    said = both.filter(F.size("hits") > 0).select("page_id", F.col("node").alias("over"), F.col("hits").alias("up"))
    under = both.select("page_id", "node", F.explode("ancestors").alias("over")).join(said.hint("merge"), ["page_id", "over"])
    above = under.groupBy("page_id", "node").agg(F.size(F.array_distinct(F.flatten(F.collect_list("up")))).alias("above"))
    j = both.join(above.hint("merge"), ["page_id", "node"], "left")
    j = j.select(
        "page_id", "node", "tag", "text", F.contains(F.lower("text"), F.lower("task")).cast("int").alias("phrase"), F.size("hits").alias("own"), F.coalesce("above", F.lit(0)).alias("above"),
        F.col("tag").isin("a", "button", "input", "select", "textarea").cast("int").alias("acts"),
    )
    w = Window.partitionBy("page_id").orderBy(F.desc("phrase"), F.desc("own"), F.desc("above"), F.desc("acts"), "node")
    j = j.withColumns({"rank": F.row_number().over(w), "used": F.sum(F.octet_length("text") + 1).over(w)}).filter(F.col("used") <= budget)
    return j.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("node"))).select("page_id", "node", "tag", "rank", "own", "above", "place")
