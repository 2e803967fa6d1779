"""Removal of long byte strings that repeat, by suffix arrays of shards.

Every start of a string of ``length`` bytes is owned by the smallest hash among the string's ``GRAM``-byte grams,
and consecutive starts with one owner form a segment. Equal strings have equal owners, so the segments of one
owner hold all that can be equal. Segments whose owner is met once are dropped; the others
go, with their bytes, to shards by owner. A shard's segments are set one after the other and suffix-sorted by
induced sorting (``suffix_array``); its permuted common prefixes (``common_prefixes``) tell the starts whose
string starts anywhere else. Equal texts are one class from the start and take part once. A segment none of whose windows
around its owner stands elsewhere in the shard is left out before the sort (``worth_sorting``).

Shards are cut from a partition sorted by owner at ``SHARD_BYTES``; equal segments are merged before sorting, so a
passage that many texts share costs its distinct segments only.

An owner with more than ``HOT`` segments, such as a gram at the edge of a passage that very many texts go on from, is
cut a second time: its strings are owned by their next smallest hash as well, so its segments go to several shards.

Strings are counted in units: bytes, or words (``WordUnits``). A word is a run of bytes between ASCII whitespace, and
any whitespace between words is as good as another; the suffix array of a shard is then one of numbered words.

Cases: null texts count as empty; texts under ``length`` bytes lose nothing; repeated rows are occurrences of their
own (a text of ``length`` bytes or more that stands twice is removed in both places); strings overlap freely;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, lean, small_batches, text_or_empty, written

LENGTH, GRAM, WORD_GRAM = 400, 64, 8
SHARD_BYTES = 1 << 20
BATCH_BYTES = 1 << 20
#: Segments of one owner beyond which it is cut a second time.
HOT = 256
#: Symbols up to which a suffix sort goes bucket by bucket in numpy; beyond that buckets are too small for it.
FEW = 1024
WORD = re.compile(rb"[^ \t\n\r\f\v]+")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_HASH = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes, a power of two, by doubling."""
    return run_hashes(BYTE_HASH[data], gram)


def run_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` hashes, a power of two, by doubling."""
    k, factor = 1, np.uint64(0x9E3779B97F4A7C15)
    while k < gram:
        h = h[:-k] * factor + h[k:]
        factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
        k *= 2
    h ^= h >> np.uint64(31)
    h *= M1
    h ^= h >> np.uint64(29)
    h *= M2
    return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values: suffix minima of a block and prefix minima of the next one."""
    n = len(h) - width + 1
    blocks = np.full((-(-len(h) // width), width), np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks.ravel()[: len(h)] = h
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def met_again(owners: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which owners are the hash of more than one gram: such a segment can hold a string twice by itself."""
    bits = np.uint64((1 << 22) - 1)
    marked = np.zeros(1 << 22, bool)
    marked[owners & bits] = True
    values, counts = np.unique(h[marked[h & bits]], return_counts=True)
    return counts[np.searchsorted(values, owners)] > 1


class ByteUnits:
    """Texts as bytes."""

    gram = GRAM

    def parts(self, text: bytes) -> bytes:
        return text

    def joined(self, parts: bytes) -> bytes:
        return parts

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the units of all texts and the number of units of each."""
        return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)

    def symbols(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(p, np.uint8) for p in pieces]

    def found(self, parts: bytes, gram: bytes) -> list[int]:
        """All places of a run of units."""
        out, at = [], parts.find(gram)
        while at >= 0:
            out.append(at)
            at = parts.find(gram, at + 1)
        return out

    def places(self, text: bytes, starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        """The bytes that strings of ``length`` units cover whose starts are the given intervals of units."""
        return [(a, z - 1 + length) for a, z in starts]


class WordUnits:
    """Texts as words between ASCII whitespace."""

    gram = WORD_GRAM

    def parts(self, text: bytes) -> list[bytes]:
        return text.split()

    def joined(self, parts: list[bytes]) -> bytes:
        return b" ".join(parts)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if not len(data):
            return BYTE_HASH[data], np.zeros(len(texts), np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.flatnonzero(~space & np.append(True, space[:-1]))
        last = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(first, ends)
        inside = np.arange(len(data)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(data)]])))
        value = np.where(space, np.uint64(0), BYTE_HASH[data] * (BYTE_HASH[inside & 255] + inside.astype(np.uint64) * np.uint64(2)))
        h = np.add.reduceat(value, first) if len(first) else value[:0]
        h = (h + (last - first).astype(np.uint64)) * M1
        h ^= h >> np.uint64(31)
        return h, np.diff(np.append(0, upto))

    def symbols(self, pieces: list[bytes]) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        return [np.array([number.setdefault(w, len(number)) for w in p.split(b" ")], np.int64) for p in pieces]

    def found(self, parts: list[bytes], gram: list[bytes]) -> list[int]:
        return [k for k, w in enumerate(parts) if w == gram[0] and parts[k : k + len(gram)] == gram]

    def places(self, text: bytes, starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        at = [m.span() for m in WORD.finditer(text)] if starts else []
        return [(at[a][0], at[z - 2 + length][1]) for a, z in starts]


Units = ByteUnits | WordUnits


def segments(texts: list[bytes], length: int, units: Units, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, text, first start, end of starts, owner met again) of the segments of some texts."""
    h, sizes = units.hashes(texts)
    none = np.empty(0, np.int64)
    if len(h) < length:
        return none.view(np.uint64), none, none, none, none.astype(bool)
    grams = run_hashes(h, gram)
    owner = window_minima(grams, length - gram + 1)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
    valid = np.arange(len(owner)) <= (begin + sizes - length)[doc]
    edge = np.empty(len(owner), bool)
    edge[0] = True
    edge[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(owner))
    keep = valid[first]
    first, last = first[keep], last[keep]
    d = doc[first]
    return owner[first], d, first - begin[d], last - begin[d], met_again(owner[first], grams)


def cut_again(piece: bytes, owner: int, length: int, units: Units, gram: int) -> list[tuple[int, int, int]]:
    """(owner, first start, end of starts) of one segment, by the smallest hash of each string that isn't the owner's."""
    h, _ = units.hashes([piece])
    grams = run_hashes(h, gram)
    grams = np.where(grams == np.uint64(owner & 0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF), grams)
    second = window_minima(grams, length - gram + 1)
    first = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
    mixed = (second[first] * M1 ^ np.uint64(owner & 0xFFFFFFFFFFFFFFFF)) * M2
    return list(zip(mixed.view(np.int64).tolist(), first.tolist(), np.append(first[1:], len(second)).tolist(), strict=True))


# ---- suffix sorting -------------------------------------------------------------------------------------------


def _run_lengths(s: np.ndarray) -> np.ndarray:
    """How many symbols directly before each place equal the one there."""
    at = np.arange(len(s))
    change = np.concatenate([[True], s[1:] != s[:-1]])
    return at - np.maximum.accumulate(np.where(change, at, 0))


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them. The last symbol is a unique smallest end."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    smaller = np.append(s[:-1] < s[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


def _chain(entries: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The suffixes that ``entries`` of one bucket induce in that same bucket, in order of the scan."""
    length = runs[entries]
    total = int(length.sum())
    if not total:
        return entries[:0]
    which = np.repeat(np.arange(len(entries)), length)
    depth = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + 1
    order = np.argsort(depth, kind="stable")
    return entries[which[order]] - depth[order]


def _induce(s: np.ndarray, small: np.ndarray, runs: np.ndarray, sorted_lms: np.ndarray, k: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order, in one scan up and one down, bucket by bucket.

    Within a bucket a suffix induces only suffixes of its own run of equal symbols, which come in one step; what it
    induces in other buckets is dealt there by a stable sort of the symbols. So each suffix is touched once.
    """
    n = len(s)
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    n_large = np.bincount(s[~small], minlength=k)
    # the sorted leftmost-smaller suffixes by bucket
    by = s[sorted_lms]
    lms_counts = np.bincount(by, minlength=k)
    lms_start = np.cumsum(lms_counts) - lms_counts
    sa = np.empty(n, np.int32)
    narrow = s.dtype
    used = np.flatnonzero(counts)

    fill = starts.copy()
    for c in used.tolist():
        a, b = int(starts[c]), int(fill[c])
        more = _chain(sa[a:b], np.minimum(runs, n)) if b > a and n_large[c] > b - a else sa[:0]
        sa[b : b + len(more)] = more
        sources = np.concatenate([sa[a : b + len(more)], sorted_lms[lms_start[c] : lms_start[c] + lms_counts[c]]])
        before = sources[sources > 0] - 1
        symbol = s[before]
        up = symbol > c
        before, symbol = before[up], symbol[up]
        _deal(sa, before, symbol.astype(narrow), fill, 1, k)
    fill = ends.copy()
    for c in used[::-1].tolist():
        a, b = int(fill[c]), int(ends[c])  # smaller suffixes that are in place, in ascending order
        n_small = int(counts[c] - n_large[c])
        more = _chain(sa[a:b][::-1], runs) if n_small > b - a and b > a else sa[:0]
        sa[a - len(more) : a] = more[::-1]
        sources = sa[int(starts[c]) : b][::-1] if n_small == b - a + len(more) else np.concatenate([sa[a - len(more) : b][::-1], sa[int(starts[c]) : int(starts[c] + n_large[c])][::-1]])
        before = sources[sources > 0] - 1
        symbol = s[before]
        down = symbol < c
        before, symbol = before[down], symbol[down]
        _deal(sa, before, symbol.astype(narrow), fill, -1, k)
        if c == int(s[-1]):
            sa[starts[c]] = n - 1
    return sa


def _deal(sa, places, symbols, fill, way, k):
    """Append places to the buckets of their symbols, upwards or downwards."""
    if not len(places):
        return
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    counts = np.bincount(symbols, minlength=k)
    rank = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = fill[symbols] + rank if way > 0 else fill[symbols] - 1 - rank
    sa[spot] = places
    fill += way * counts


def _induce_plain(s: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, k: int) -> np.ndarray:
    """As ``_induce``, suffix by suffix, for many symbols."""
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    text, is_small, sa = s.tolist(), small.tolist(), [-1] * len(s)
    tail = ends.tolist()
    for j in reversed(sorted_lms.tolist()):
        c = text[j]
        tail[c] -= 1
        sa[tail[c]] = j
    head = (ends - counts).tolist()
    for j in sa:  # entries are set ahead of the loop
        if j > 0 and not is_small[j - 1]:
            c = text[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for j in reversed(sa):
        if j > 0 and is_small[j - 1]:
            c = text[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    sa[0] = len(s) - 1
    return np.array(sa, np.int32)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small unsigned symbols whose last one is a unique smallest 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    k = int(s.max()) + 1
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if k <= FEW:
        runs = _run_lengths(s)
        induce = lambda order: _induce(s, small, runs, order, k)
    else:
        induce = lambda order: _induce_plain(s, small, order, k)
    # sort the leftmost-smaller substrings: induce from them in any order within a bucket
    rough = induce(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names = _named(s, small, lms, ordered)
    if names.max() + 1 < len(lms):  # some are equal: the order of the suffixes of their names tells
        ordered = lms[suffix_array(names)]
    return induce(ordered)


def _named(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in text order: equal ones get equal names, names follow the order."""
    n = len(s)
    index = np.empty(n, np.int32)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1)
    x, y = ordered[1:], ordered[:-1]
    size_x, size_y = (ends[index[v]] - v for v in (x, y))
    equal = size_x == size_y
    active = np.flatnonzero(equal)
    step = 0
    while len(active):
        px, py = x[active] + step, y[active] + step
        same = (s[px] == s[py]) & (small[px] == small[py])
        equal[active[~same]] = False
        active = active[same & (size_x[active] > step)]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[index[ordered]] = np.concatenate([[0], np.cumsum(~equal)])
    return names


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each place, the length shared with the suffix before it in the array, and that
    suffix. They are compared at irreducible places only; elsewhere one less than at the place before."""
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    other = phi
    reducible = np.zeros(n, bool)
    ok = (at > 0) & (other > 0)
    reducible[ok] = s[at[ok] - 1] == s[other[ok] - 1]
    reducible[at[ok]] &= phi[at[ok] - 1] == other[ok] - 1
    start = np.flatnonzero(~reducible & (other >= 0))
    padded = np.concatenate([s.astype(np.uint8) if s.max() < 256 else s, np.zeros(8, s.dtype if s.max() >= 256 else np.uint8)])
    length = np.zeros(n, np.int64)
    active, step = start, 0
    while len(active):
        p, q = active + step, other[active] + step
        inside = np.maximum(p, q) < n
        active, p, q = active[inside], p[inside], q[inside]
        same = padded[p] == padded[q]
        length[active[same]] = step + 1
        active = active[same]
        step += 1
    base = np.maximum.accumulate(np.where(reducible, -1, at))
    return np.maximum(length[base] - (at - base), 0) * (other >= 0), phi


def repeated_starts(pieces: list[bytes], length: int, units: Units = ByteUnits()) -> list[np.ndarray]:
    """For each of some distinct strings, the starts whose ``length`` units stand at another place too."""
    parts = units.symbols(pieces)
    sizes = np.array([len(p) for p in parts])
    top = max((int(p.max()) for p in parts if len(p)), default=0)
    stop = np.cumsum(sizes + 1) - 1
    flat = np.ones(int(stop[-1]) + 2, np.uint16 if top < 60_000 else np.int64)  # 1: between the strings
    for p, z, n in zip(parts, stop.tolist(), sizes.tolist(), strict=True):
        flat[z - n : z] = p
        flat[z - n : z] += 2
    flat[-1] = 0
    sa = suffix_array(flat)
    shared, phi = common_prefixes(flat, sa)
    hit = np.flatnonzero(shared >= length)
    marked = np.zeros(len(flat), bool)
    marked[hit] = True
    marked[phi[hit]] = True
    left = np.repeat(stop, sizes + 1) - np.arange(len(flat) - 1)
    marked[:-1] &= left >= length  # no string runs past the end of its own
    begin = stop - sizes
    return [np.flatnonzero(marked[a:b]) for a, b in zip(begin, stop, strict=True)]


def owner_places(texts: list[bytes], doc: np.ndarray, first: np.ndarray, owner: np.ndarray, length: int, units: Units, gram: int, step: int = 4_096) -> np.ndarray:
    """Where in its segment the gram stands that owns it: for each segment the first place in its first string."""
    h, sizes = units.hashes(texts)
    grams = run_hashes(h, gram)
    start = (np.cumsum(sizes) - sizes)[doc] + first
    out, inside = np.empty(len(start), np.int64), np.arange(length - gram + 1)
    for k in range(0, len(start), step):
        out[k : k + step] = (grams[start[k : k + step, None] + inside] == owner[k : k + step, None]).argmax(axis=1)
    return out


def worth_sorting(pieces: list[tuple[bytes, int]], length: int, units: Units, gram: int) -> list[bool]:
    """Which of the distinct segments of some owners, each with a place of its owner, can hold a string that stands elsewhere.

    A string of ``length`` holds its owner, so it holds one of a few windows that start a multiple of ``step`` before
    the owner and are ``step`` shorter than the string. A segment none of whose windows another segment or another place
    of its own has holds no string that repeats.
    """
    step = max(1, (length - gram) // 6)
    size, met, held = length - step, Counter(), []
    for data, at in pieces:
        parts = units.parts(data)
        mine = [(k, units.joined(parts[q : q + size])) for p in units.found(parts, parts[at : at + gram]) for k, q in enumerate(range(p, max(-1, p - length + gram - 1), -step)) if q + size <= len(parts)]
        met.update(mine)
        held.append(mine)
    return [any(met[w] > 1 for w in mine) for mine in held]


# ---- the distributed part ---------------------------------------------------------------------------------------


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs [a, b) of consecutive numbers."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + 1).tolist(), strict=True))


def distinct_texts(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """``(key, n, text)`` of the distinct texts. Key: 128 bits of a SHA-256."""
    text = text_or_empty(text_column)
    return documents.select(text_key(text_column).alias("key"), text.alias("text")).groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text"))


def text_key(text_column: str):
    return F.unhex(F.substring(F.sha2(text_or_empty(text_column), 256), 1, 32))


def spans(texts: DataFrame, length: int, units: Units, gram: int | None = None) -> DataFrame:
    """``(key, a, z)`` of ``texts(key, text)``: starts, counted in units, of strings of ``length`` units that repeat."""
    gram = gram or units.gram
    if length < gram:
        gram = 1 << (length.bit_length() - 1)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            owner, doc, a, z, again = segments([t.encode() for t in b.column("text").to_pylist()], length, units, gram)
            yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), b.column("key").take(pa.array(doc)), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(again)], names=["owner", "key", "a", "z", "again"])

    # all columns of ``texts``, so that one exchange of them serves both passes
    found = texts.mapInArrow(lean(cut_up), "owner long, key binary, a int, z int, again boolean")
    shared = found.groupBy("owner").agg(F.count("*").alias("m"), F.max("again").alias("again")).filter("m > 1 or again").select("owner", (F.col("m") > HOT).alias("hot"))
    wanted = found.join(shared, "owner").groupBy("key").agg(F.collect_list(F.struct("owner", "a", "z", "hot")).alias("cuts"))  # of one text

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            texts, cuts = [t.encode() for t in b.column("text").to_pylist()], b.column("cuts").to_pylist()
            flat = [(k, c) for k, some in enumerate(cuts) for c in some]
            at = owner_places(texts, np.array([k for k, _ in flat], np.int64), np.array([c["a"] for _, c in flat], np.int64), np.array([c["owner"] for _, c in flat], np.int64).view(np.uint64), length, units, gram).tolist()
            keys, out, k, data = b.column("key").to_pylist(), [], -1, b""
            for (i, c), p in zip(flat, at, strict=True):
                if i != k:
                    k, data = i, units.parts(texts[i])
                piece = data[c["a"] : c["z"] - 1 + length]
                if c["hot"]:
                    for o, x, y in cut_again(units.joined(piece), c["owner"], length, units, gram):
                        part = piece[x : y - 1 + length]
                        out.append((o, keys[i], c["a"] + x, units.joined(part), units.found(part, piece[p : p + gram])[0]))
                else:
                    out.append((c["owner"], keys[i], c["a"], units.joined(piece), p))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["owner", "key", "a", "bytes", "at"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict[bytes, tuple]) -> pa.RecordBatch:
            rows: list[tuple] = []
            worth = worth_sorting([(data, at) for data, (at, _) in held.items()], length, units, gram)
            sorted_ = [data for data, x in zip(held, worth, strict=True) if x]
            runs = dict(zip(sorted_, map(intervals, repeated_starts(sorted_, length, units)), strict=True)) if sorted_ else {}
            for data, (_, places) in held.items():
                # a segment that stands twice repeats whole
                some = runs.get(data, ()) if len(places) == 1 else [(0, len(units.parts(data)) - length + 1)]
                rows += [(key, a + p, a + q) for key, a in places for p, q in some]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["key", "a", "z"])

        held: dict[bytes, tuple] = {}
        size, before = 0, None
        for b in batches:
            for owner, key, a, data, at in zip(*(b.column(c).to_pylist() for c in ("owner", "key", "a", "bytes", "at")), strict=True):
                if size >= SHARD_BYTES and owner != before:
                    yield flush(held)
                    held, size = {}, 0
                before = owner
                _, places = held.setdefault(data, (at, []))
                size += 0 if places else len(data)
                places.append((key, a))
        if held:
            yield flush(held)

    cut = texts.join(wanted, "key").select("key", "n", "text", "cuts").mapInArrow(lean(take), "owner long, key binary, a int, bytes binary, at int")
    return cut.repartition("owner").sortWithinPartitions("owner").mapInArrow(lean(sort), "key binary, a int, z int")


def kept_texts(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, text_column: str = "text", words: int | None = None) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of each distinct text; ``kept``: the bytes left, null if all are."""
    small_batches(documents.sparkSession)
    texts = distinct_texts(documents, text_column)
    in_bytes, in_words = ByteUnits(), WordUnits()
    starts = spans(texts, length, in_bytes, gram).withColumn("by_word", F.lit(False))
    if words:
        # each is written by itself, so the shuffle files of one are gone before the other's are made
        by_byte = written(starts, "starts")
        starts = by_byte.union(written(spans(texts, words, in_words).withColumn("by_word", F.lit(True)), "word-starts"))
    by_text = starts.groupBy("key").agg(F.collect_list(F.struct("a", "z", "by_word")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", BATCH_BYTES):
            rows = []
            for text, n, found in zip(b.column("text").to_pylist(), b.column("n").to_pylist(), b.column("starts").to_pylist(), strict=True):
                data = text.encode()
                cover = in_bytes.places(data, [(f["a"], f["z"]) for f in found or () if not f["by_word"]], length)
                if words:
                    cover += in_words.places(data, [(f["a"], f["z"]) for f in found or () if f["by_word"]], words)
                if n > 1 and (len(data) >= length or words and len(data.split(None, words - 1)) == words):
                    cover = [(0, len(data))]
                left, at, removed, n_spans, edge = [], 0, 0, 0, -1
                for a, z in sorted(cover):
                    if a > edge:
                        n_spans += 1
                        left.append(data[at:a])
                        at = a
                    if z > at:
                        removed += z - at
                        at = z
                    edge = max(edge, z)
                left.append(data[at:])
                kept = b"".join(left)
                rows.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if removed else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(by_text, "key", "left").select("key", "n", "text", "starts")
    return joined.mapInArrow(lean(run), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row."""
    kept = kept_texts(documents, length, gram, text_column).drop("kept")
    return documents.select(F.col(id_column), text_key(text_column).alias("key")).join(kept, "key").drop("key")


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, text_column: str = "text", words: int | None = None) -> DataFrame:
    """``documents`` with the repeated strings cut out of the text; characters that a cut goes through are dropped.

    Texts that change are joined by key; all others pass as they are.
    """
    changed = kept_texts(documents, length, gram, text_column, words).filter("n_removed > 0").select("key", "kept")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())], names=["key", "kept"])

    changed = changed.mapInArrow(decode, "key binary, kept string").select(F.struct("key", "kept").alias("cut"))
    # rows are carried in one column, so no name of theirs can clash
    rows = documents.select(F.struct("*").alias("row"), text_key(text_column).alias("key"))
    out = rows.join(changed, F.col("key") == F.col("cut.key"), "left")
    text = F.when(F.col("cut").isNotNull(), F.col("cut.kept")).otherwise(F.col("row")[text_column])
    return out.select(*(text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in documents.columns))
