"""Near-duplicate documents by order MinHash, verified by banded alignment.

Sketch (Marcais et al., Locality-sensitive hashing for the edit distance, 2019): each shingle of five words is
labelled with its occurrence number, each of ``SKETCHES`` hash functions picks the ``PICKED`` smallest labelled
shingles, and these are kept in the order in which they stand in the text. Two texts share such a sketch with a
probability that follows their edit similarity.

Similarity of two texts: 1 - d / n, where d is the edit distance of their shingle sequences and n the longer
length; near duplicates have 0.8 or more. (0.8 here is a Jaccard similarity of shingles of about 0.67, and every
pair with a Jaccard similarity of 0.8 and few moves is above it.) A band of 0.2 n diagonals is aligned.

Texts that are equal word for word are one class from the start and the smallest id stands for it. Classes that
share a sketch meet in buckets: in a bucket of up to ``SMALL`` classes all pairs are candidates; in a larger one all
classes are compared with its smallest id, so a large group of copies costs a number of pairs in proportion to it.
Where a large bucket then holds more than one component, its classes go through an exact join by prefixes
(``rest``): texts that are similar share one of the first fifth of their labelled shingles, under any order of all
shingles, so no link between components of a bucket is lost and none within one is tried again. Shingles that one
component alone has come first in that order, then the rarer ones.

``links_found`` counts the links that were verified; inside a large group that is one component not all are sought.

Cases: null texts count as empty; texts without a word link with nothing; texts of one to four words have one
shingle; ties of hashes go to the earlier shingle; repeated ids are merged (smallest text); null ids are left
out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, components, cut, lean, small_batches, text_or_empty, written

SHINGLE, LEAST, SKETCHES, PICKED, SMALL = 5, 0.8, 16, 2, 24
WORD = re.compile(r"\w+")
PLACE_BITS = 24
#: A shingle that more than one in so many rows has is in a table that each task holds: 8 bytes each, fewer than that many.
COMMON = 1 << 16
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BATCH_BYTES = 1 << 20


class Hashes(dict):
    """Hash of each word that a task has met; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def times(k: int, m: np.uint64) -> np.uint64:
    return np.uint64(k * int(m) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, hashes: Hashes) -> np.ndarray:
    found = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; one of all words if there are fewer."""
    k = min(SHINGLE, len(words))
    if not k:
        return words
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * M1 + words[j : len(words) - k + 1 + j]
    return mixed(out)


def labelled(flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers: within equal (document, shingle), in text order."""
    tagged = flat ^ mixed(doc.astype(np.uint64) + M1)
    order = np.argsort(tagged, kind="stable")
    ranked = tagged[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(flat))
    label = np.empty(len(flat), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return flat + label * M3


def sketches(parts: list[np.ndarray], n: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """A row of ``n`` sketches for each sequence of shingles, none of which is empty."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(flat))
    base = labelled(flat, doc)
    place = (at - np.repeat(starts, sizes)).astype(np.uint64)
    # a hash's low bits give way to the place; a longer text, which is a batch of its own, needs more of them
    bits = max(PLACE_BITS, int(sizes.max()).bit_length())
    top = np.uint64(~((1 << bits) - 1) & 0xFFFFFFFFFFFFFFFF)
    low = np.uint64((1 << bits) - 1)
    out = np.empty((len(parts), n), np.uint64)
    for j in range(n):
        key = (mixed(base ^ (times(j + 1, M1))) & top) | place
        places = np.empty((len(parts), picked), np.int64)
        for i in range(picked):
            least = np.minimum.reduceat(key, starts)
            spot = (least & low).astype(np.int64)
            if i:
                spot = np.where(sizes > i, spot, places[:, 0])  # fewer shingles than picks
            places[:, i] = spot
            key[starts + spot] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places.sort(axis=1)
        sketch = np.full(len(parts), times(j + 1, M2), np.uint64)
        for i in range(picked):
            sketch = mixed(sketch * M1 + flat[starts + places[:, i]])
        out[:, j] = sketch
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most + 1``.

    Bit-parallel alignment over a band of diagonals: bit i of a column stands for the row of the band, the band
    moves down by one row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    same = a[:m] == b
    start = m if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    n, m = len(a), len(b)
    if m:
        same = a[n - m :][::-1] == b[::-1]
        end = m if same.all() else int(same.argmin())
        a, b = a[: n - end], b[: m - end]
    n, m = len(a), len(b)
    if not m:
        return n
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    # rows j - most .. j + most of column j; row i is bit i - (j - most)
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full ^ ((1 << most) - 1), 0  # vertical +1 below the diagonal; rows above the first have no difference
    score = most  # value at the lowest row of the band in column 0: row ``most``
    for j, x in enumerate(b.tolist()):
        shift = j - most
        hit = where.get(x, 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        diagonal = ((((hit & up) + up) ^ up) | hit | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        score += not diagonal >> (width - 1) & 1
        if score > 2 * most + m - n:
            return most + 1
        moved = diagonal >> 1
        up = left | (full & ~(moved | right))
        down = moved & right
    # up from row m + most, which is below the end of the longer sequence, to its last row n
    rest = ((1 << (width - 1)) - 1) & ~((1 << (n - m + most)) - 1)
    score += (down & rest).bit_count() - (up & rest).bit_count()
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(cx[i], cy[j]).sum() < n - most:  # equal shingles are at most that many
        return False
    return edit_distance(a, b, most) <= most


def sketched(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, digest, keys)``: digest of the words, and the sketches; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            words = [word_hashes(t, hashes) for t in batch.column("text").to_pylist()]
            some = [k for k, w in enumerate(words) if len(w)]
            rows = sketches([shingles(words[k]) for k in some]).view(np.int64).tolist() if some else []
            digest, keys = [None] * len(words), [None] * len(words)
            for k, row in zip(some, rows, strict=True):
                digest[k], keys[k] = xxhash.xxh3_128_digest(words[k].tobytes()), row
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "keys"])

    rows = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text")).filter("id is not null")
    return rows.mapInArrow(lean(run), "id long, digest binary, keys array<long>")


def candidates(classes: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(a, b)``, a < b, of ``classes(class, keys)``, and the large buckets ``(key, class, first)``."""
    rows = classes.select("class", F.posexplode("keys").alias("j", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("first")).filter("n > 1")
    met = written(rows.select("class", "key").join(sizes, "key"), "buckets")
    held = met.filter(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list("class")).alias("c"))  # at most ``small``
    every = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    large = met.filter(F.col("n") > small).select("key", "class", "first")
    stars = large.filter(F.col("class") > F.col("first")).select(F.col("first").alias("a"), F.col("class").alias("b"))
    return held.select(F.explode(every).alias("p")).select("p.a", "p.b").union(stars).distinct(), large


def texts_of(documents: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    texts = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return texts.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def contested(large: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, component, outside)`` of the classes in large buckets that hold more than one component.

    ``outside``: in some bucket it isn't in the component of the bucket's smallest id. Of two classes of one
    bucket and different components, at least one is outside.
    """
    rows = large.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = rows.groupBy("key").agg(F.min_by("component", "class").alias("star"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return rows.join(split, "key").groupBy(F.col("class").alias("id")).agg(F.min("component").alias("component"), F.max(F.col("component") != F.col("star")).alias("outside"))


def held_shingles(texts: DataFrame) -> DataFrame:
    """``texts(id, component, outside, text)`` with ``(n, hs)`` for the text: its labelled shingles and how many they are."""
    kept = ("id", "component", "outside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            flat = [shingles(word_hashes(t, hashes)) for t in batch.column("text").to_pylist()]
            some = [k for k, x in enumerate(flat) if len(x)]
            if some:
                sizes = np.array([len(flat[k]) for k in some])
                base = labelled(np.concatenate([flat[k] for k in some]), np.repeat(np.arange(len(some)), sizes))
                hs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(base.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in kept), pa.array(sizes.astype(np.int64)), hs], names=[*kept, "n", "hs"])

    return texts.mapInArrow(lean(run), "id long, component long, outside boolean, n long, hs array<long>")


def may_differ(n, least: float):
    """How many shingles of a text of ``n`` may differ in a similar one."""
    return F.floor(F.lit(1 - least) * n + F.lit(1e-9))


def without_common(held: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """``held`` with ``hs`` less those of ``common``, ``often``: how many these were, and ``first``: those of its prefix.

    ``common``: shingles by the order of prefixes, of which they are the last.
    """
    kept, order = ("id", "component", "outside", "n"), np.argsort(common)
    ranked = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("hs")).to_numpy().astype(np.int64)
            flat = batch.column("hs").flatten().to_numpy(zero_copy_only=False)
            spot = np.minimum(np.searchsorted(ranked, flat), len(ranked) - 1)
            hit = ranked[spot] == flat if len(ranked) else np.zeros(len(flat), bool)
            ends, seen = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(hit)])
            often = seen[ends[1:]] - seen[ends[:-1]]
            places = order[spot[hit]] if len(ranked) else spot[hit]
            first = [[]] * len(sizes)
            for k in np.flatnonzero(often):
                room = int((1 - least) * int(sizes[k]) + 1e-9) + 1 - int(sizes[k] - often[k])
                if room > 0:
                    first[k] = common[np.sort(places[seen[ends[k]] : seen[ends[k + 1]]])[:room]]
            hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes - often)]).astype(np.int32)), pa.array(flat[~hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(often, pa.int64()), hs, pa.array(first, pa.list_(pa.int64()))], names=[*kept, "often", "hs", "first"])

    return held.select(*kept, "hs").mapInArrow(lean(run), "id long, component long, outside boolean, n long, often long, hs array<long>, first array<long>")


def prefixes(held: DataFrame, least: float) -> DataFrame:
    """``(h, id, component, outside, n, at)``: the shingles of each text, ``at`` places from its rarest, that it may share first.

    Shingles of one component alone come first, as none of them is shared with another one, then those of fewer texts.
    A similar text of another component shares one of the first that are one more than may differ; those of one
    component need no row, and a text that has too many of them is left out.

    The most common shingles, each with more than one in ``COMMON`` of all rows and so fewer than ``COMMON`` of them,
    come last: the texts of a large group have most of theirs in common, and a table of them stands for their rows.
    """
    joint = held.select("component", F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high"))
    joint = written(joint.filter("low <> high").select("h", "k"), "joint")
    most = max(SMALL, (held.agg(F.sum("n")).first()[0] or 0) // COMMON)
    common = np.array([r.h for r in joint.filter(F.col("k") > most).orderBy("k", "h").collect()], np.int64)
    apart = written(without_common(held, common, least), "apart")
    of_text = ("id", "component", "outside", "n")
    own = Window.partitionBy("id")
    at = F.col("n") - F.col("often") - F.count("*").over(own) + F.row_number().over(own.orderBy("k", "h")) - 1
    rows = apart.select(*of_text, "often", F.explode("hs").alias("h")).join(joint.filter(F.col("k") <= most), "h").withColumn("at", at)
    rows = rows.filter(F.col("at") <= may_differ(F.col("n"), least)).select("h", *of_text, "at")
    return rows.union(apart.select(*of_text, "often", F.posexplode("first").alias("j", "h")).select("h", *of_text, (F.col("n") - F.col("often") + F.col("j")).alias("at")))


def between(rows: DataFrame) -> DataFrame:
    """``rows(h, id, component, n)`` of the shingles that texts of several components have, with ``(low, most)``.

    ``low``: the smallest id, with its length, of the lowest component that has the shingle; ``most``: the component
    with most rows of it.
    """
    each = rows.groupBy("h", "component").agg(F.count("*").alias("k"), F.min(F.struct("id", "n")).alias("first"))
    low = F.min(F.struct("component", "first.id", "first.n")).alias("low")
    shared = each.groupBy("h").agg(low, F.max(F.struct("k", "component"))["component"].alias("most"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return rows.join(shared, "h")


def fits(n1, n2, least: float):
    """Lengths that similar texts may have."""
    return F.least(n1, n2) + F.lit(1e-6) >= F.lit(least) * F.greatest(n1, n2)


def sharing(rows: DataFrame, least: float) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``between``'s texts of different components that share a shingle and may be similar.

    Texts of the component with most rows of a shingle meet only those of others, so a large component costs rows in
    proportion to it; where the shared one is the first, those before it in either text are among its different ones.
    """
    one, other = (r.select("h", *(F.col(c).alias(c + k) for c in ("id", "n", "component", "outside", "at")), *more) for k, r, more in (("1", rows, ["most"]), ("2", rows.filter("component <> most"), [])))
    longer = F.greatest("n1", "n2")
    alike = longer - may_differ(longer, least)
    met = one.join(other, "h").filter(
        (F.col("component1") != F.col("component2")) & (F.col("outside1") | F.col("outside2")) & ((F.col("component1") == F.col("most")) | (F.col("id1") < F.col("id2")))
        & fits(F.col("n1"), F.col("n2"), least) & (F.col("n1") - F.col("at1") >= alike) & (F.col("n2") - F.col("at2") >= alike)
    )
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def rest(large: DataFrame, links: DataFrame, found: DataFrame, documents: DataFrame, id_column: str, text_column: str, least: float) -> DataFrame | None:
    """Links between components of large buckets; ``found(class, component)``: the components of ``links``.

    Each text is first tried with one text of the lowest component that it shares a shingle with, which joins most
    of what belongs together; what then still is apart is joined pair by pair, without the texts that shared none.
    """
    members = written(contested(large, found), "contested")
    if members.isEmpty():
        return None
    held = written(held_shingles(texts_of(documents, members, id_column, text_column).join(members, "id")), "shingles")
    rows = written(between(prefixes(held, least)), "shared")
    near = rows.filter((F.col("component") != F.col("low.component")) & fits(F.col("n"), F.col("low.n"), least))
    tried = near.select(F.least("id", "low.id").alias("a"), F.greatest("id", "low.id").alias("b")).distinct()
    new = cut(linked(cut(tried), documents, id_column, text_column, least))
    now = held.join(rows.select("id"), "id", "left_semi").join(merged(found, new).toDF("id", "now"), "id", "left")
    now = written(now.withColumn("component", F.coalesce("now", "component")).drop("now"), "shingles")
    pairs = cut(sharing(written(between(prefixes(now, least)), "shared"), least))
    return cut(new.union(linked(pairs, documents, id_column, text_column, least)).distinct().join(links, ["a", "b"], "left_anti"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``(class, component)`` after ``links(a, b)`` have joined components of ``found``; a class that is in neither is left out."""
    side = lambda c: found.select(F.col("class").alias(c), F.col("component").alias("c" + c))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends).toDF("node", "to")
    old = found.join(joined, F.col("component") == F.col("node"), "left").select("class", F.coalesce("to", "component").alias("component"))
    return cut(old.union(joined.toDF("class", "component")).distinct())


def linked(pairs: DataFrame, documents: DataFrame, id_column: str, text_column: str, least: float) -> DataFrame:
    """The pairs whose texts are similar; texts of candidates alone are shuffled."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("id")
    texts = written(texts_of(documents, wanted, id_column, text_column), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, one, hashes = None, None, Hashes()
        for b in by_bytes(batches, "ta", BATCH_BYTES):
            keep = []
            for ia, ta, tb in zip(b.column("a").to_pylist(), b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                if ia != before:
                    before, one = ia, shingles(word_hashes(ta, hashes))
                keep.append(similar(one, shingles(word_hashes(tb, hashes)), least))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return both.mapInArrow(lean(run), "a long, b long")


def near_duplicates(documents: DataFrame, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text", small: int = SMALL) -> DataFrame:
    """``(doc_id, class_id, links_found, component_id, kept)`` for each document.

    ``class_id``: smallest id with the same words. ``links_found``: verified links of the class with other classes.
    ``component_id``: smallest id reachable; ``kept`` holds for that document alone.
    """
    small_batches(documents.sparkSession)
    rows = written(sketched(documents, id_column, text_column).groupBy("id").agg(F.min_by("digest", F.struct("digest")).alias("digest"), F.min_by("keys", F.struct("digest")).alias("keys")), "sketches")
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("class"), F.min("keys").alias("keys"))
    classes = written(classes, "classes")
    pairs, large = candidates(classes.select("class", "keys"), small)
    links = cut(linked(cut(pairs), documents, id_column, text_column, least))
    found = cut(components(links).toDF("class", "component"))
    more = None if large.isEmpty() else rest(large, links, found, documents, id_column, text_column, least)
    if more is not None and not more.isEmpty():
        links, found = links.union(more), merged(found, more)
    degree = links.select("a").union(links.select("b")).toDF("class").groupBy("class").agg(F.count("*").alias("links"))
    of_class = classes.select("digest", "class").join(found, "class", "left").join(degree, "class", "left")
    out = rows.select("id", "digest").join(of_class, "digest", "left")
    own = F.coalesce("class", "id")
    return out.select(
        F.col("id").alias(id_column), own.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links_found"),
        F.coalesce("component", own).alias("component_id"), (F.coalesce("component", own) == F.col("id")).alias("kept"),
    )
