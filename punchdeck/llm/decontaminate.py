"""Benchmark decontamination with spaced seeds, in DataFrame expressions alone.

Texts become sequences of hashed tokens. A seed is the hash of the tokens that a fixed mask selects from a window;
the positions that the mask leaves out may hold anything, so a hit survives substitutions there. Seeds of the
documents meet those of the benchmark in a hash join; each hit fixes a diagonal (document position less item
position), along which the tokens of text and item are compared. A document overlaps an item if on some diagonal a
window of ``WINDOW`` tokens (of the whole item if it is shorter) has at least ``LEAST`` of its tokens equal.

The masks find every such overlap with an item of ``LONG`` tokens or more: wherever the tokens that differ lie in a
window of 16 (three at most) or in a whole item of 7 to 15 (a fifth at most), one of the masks has a place in it that
meets none of them (the test enumerates all cases). Items that are shorter have masks of their own length: the whole
item, or for 5 and 6 tokens, where one may differ, the item without one of its tokens. Such masks are laid on the
documents only if the benchmark holds items of that length.

The benchmark's seeds are broadcast while they are at most ``BROADCAST_SEEDS`` (about 100 bytes each); a larger
benchmark is joined by a shuffle.

Cases: null texts count as empty and overlap nothing, as do items without a token; rows with equal ids are compared
each for itself and reported once; of diagonals that are equally good the first in the text is reported; null ids are
not reported; empty tables give an empty result; other columns are not read; a very long text is one row of seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import text_or_empty, written

MASKS = ("11111", "110111", "1110011", "11010011")
WINDOW, LEAST, LONG = 16, 0.8, 7
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def short_masks(size: int, least: float) -> tuple[str, ...]:
    """Masks as long as an item of ``size`` tokens, one for each set of places that may differ."""
    differ = int((1 - least) * size + 1e-9)
    return tuple("".join("0" if j in gone else "1" for j in range(size)) for gone in combinations(range(size), differ))


def seeds(h: Column, masks: Sequence[str], first: int) -> Column:
    """Seeds of all masks and places, those of a mask together, by place. The masks are numbered from ``first``."""

    def of(k: int, mask: str) -> Column:
        picked = [j for j, x in enumerate(mask) if x == "1"]
        seed = F.transform(h, lambda x, i: F.xxhash64(F.lit(k), *(F.get(h, i + j) if j else x for j in picked)))
        return F.slice(seed, 1, F.greatest(F.size(h) - (len(mask) - 1), F.lit(0)))

    return F.concat(*(of(k, m) for k, m in enumerate(masks, first)))


def place(at: Column, n: Column, masks: Sequence[str]) -> Column:
    """Place in the text of the seed with number ``at``."""
    sizes = [F.greatest(n - (len(m) - 1), F.lit(0)) for m in masks]
    out, before = at, F.lit(0)
    for size in sizes[:-1]:
        before = before + size
        out = F.when(at >= before, at - before).otherwise(out)
    return out


def planted(table: DataFrame, id_: str, masks: Sequence[str], first: int = 0) -> DataFrame:
    """``(id, place, seed)`` of all seeds of ``table(id, text)``."""
    # the token array is bound as a lambda's variable: as a column it could be computed anew for each use of it
    made = F.transform(F.array(tokens(F.col("text"))), lambda h: F.struct(F.size(h).alias("n"), seeds(h, masks, first).alias("seeds")))
    rows = table.select(id_, F.inline(made)).select(id_, "n", F.posexplode("seeds").alias("at", "seed"))
    return rows.select(id_, place(F.col("at"), F.col("n"), masks).alias("place"), "seed")


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, masks: Sequence[str] = MASKS, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, n_equal, doc_start)`` of each document and item that overlap.

    ``similarity``: share of equal tokens in the best window; ``n_equal``: equal tokens on its diagonal;
    ``doc_start``: token of the document where that diagonal enters the item.
    """
    docs = documents.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).filter("doc_id is not null")
    items = benchmark.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text"))
    size = F.size(tokens(F.col("text")))
    theirs, laid = planted(items.filter(size >= LONG), "item_id", masks), list(masks)
    for r in items.select(size.alias("n")).filter((F.col("n") > 0) & (F.col("n") < LONG)).distinct().orderBy("n").collect():  # lengths under ``LONG``
        own = short_masks(r.n, least)
        theirs = theirs.union(planted(items.filter(size == r.n), "item_id", own, len(laid)))
        laid += own
    theirs = theirs.withColumnRenamed("place", "item_place")
    if theirs.count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    hits = planted(docs, "doc_id", laid).join(theirs, "seed").select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    hits = written(hits, "hits")

    met = hits.join(docs, "doc_id").select("item_id", "doc_id", "diagonal", tokens(F.col("text")).alias("h"))
    met = met.join(items.select("item_id", tokens(F.col("text")).alias("t")), "item_id")
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    size = F.least(F.size("t"), F.size("h") - F.col("diagonal")) - low
    equal = F.zip_with(F.slice("h", F.col("diagonal") + low + 1, size), F.slice("t", low + 1, size), lambda a, b: a == b)
    met = met.filter(size > 0).select("doc_id", "item_id", "diagonal", F.least(F.lit(window), F.size("t")).alias("w"), (F.col("diagonal") + low).alias("doc_start"), equal.alias("equal"))
    met = met.filter(F.size("equal") >= F.col("w"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("w") + 1), lambda i: F.size(F.filter(F.slice("equal", i, F.col("w")), lambda x: x))))
    met = met.select("doc_id", "item_id", "doc_start", (best / F.col("w")).alias("similarity"), F.size(F.filter("equal", lambda x: x)).alias("n_equal"))
    met = met.filter(F.col("similarity") >= least)
    top = F.max(F.struct("similarity", "n_equal", (-F.col("doc_start")).alias("first"))).alias("top")
    out = met.groupBy("doc_id", "item_id").agg(top)
    return out.select(F.col("doc_id").alias(id_column), F.col("item_id"), "top.similarity", F.col("top.n_equal").cast("long").alias("n_equal"), (-F.col("top.first")).cast("long").alias("doc_start"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without those that overlap an item; rows with a null id stay."""
    id_column = options.get("id_column", "doc_id")
    found = written(overlaps(documents, benchmark, **options).select(id_column).distinct(), "contaminated")
    return documents.join(found, id_column, "left_anti")
