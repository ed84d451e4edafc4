"""Problem 7 over tables: test items whose passages stand in the documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.arrow import map_batches

BLOCK_ITEMS = 2000
BLOCK_CHARS = 1_000_000
MOST_TABLES = 4  # compiled blocks that a worker keeps


def _search(blocks: list):
    from functools import lru_cache

    from siltstone.llm.wumanber import Leaks, symbols_of

    tables = lru_cache(maxsize=MOST_TABLES)(lambda k: Leaks(blocks[k].value))

    def batch(cols):
        read = [symbols_of(t) for t in cols["text"]]  # once, however many blocks there are
        for k in range(len(blocks)):
            t = tables(k)
            for doc_id, x in zip(cols["doc_id"], read):
                for item_id, (n, edits) in t.find_in(*x).items():
                    yield doc_id, item_id, n, edits

    return batch


def _blocks(bench_item: DataFrame):
    """The test set, in blocks of bounded size (read through an iterator, never as a whole)."""
    block, chars = [], 0
    for r in bench_item.select("item_id", "lang", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        block.append(tuple(r))
        chars += len(r.text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, bench_item: DataFrame) -> DataFrame:
    """``doc_id, item_id, length, edits``: documents that hold a passage of a test item.

    The items are a stated query set, broadcast in blocks (at most
    ``BLOCK_ITEMS`` items or about ``BLOCK_CHARS`` characters each). Every task
    reads its own documents once, a piece at a time, and puts each piece to one
    block after the other, compiled into Wu-Manber tables: one scan for any
    number of items, no shuffle. ``length`` counts the item's words (English) or
    characters (Chinese) in the longest such passage. Null and empty texts hold
    nothing; repeated documents count on their own; without items there are no rows.
    """
    sc = documents.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(bench_item)]
    src = documents.select("doc_id", "text").where("text IS NOT NULL")
    return map_batches(src if blocks else src.where("false"), partial(_search, blocks), "doc_id long, item_id long, length int, edits int")


def leaked_items(found: DataFrame) -> DataFrame:
    """``item_id, n_docs, longest``: which test items leaked, and how widely."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("length").alias("longest"))
