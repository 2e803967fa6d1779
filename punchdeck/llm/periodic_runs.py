"""Periodic runs of words by a dictionary of basic factors.

For each power of two ``L`` the dictionary names the stretches of ``L`` words that repeat in their text; names of
length ``2 L`` are numbers of pairs of names of length ``L``. Where the next occurrence of a stretch lies within twice its
length, the occurrences form arithmetic progressions, whose difference is a period. A difference ``q`` is taken at the
one ``L`` with ``L / 2 < q <= L``: there a run of smallest period ``q`` has the next occurrence of each of its stretches
at exactly ``q`` words, so neighbouring places with one difference extend to the run. What another word extends has a
smaller period and is proposed there; runs found twice are one, with the smallest period.

Texts of a batch are searched together: words are numbered for each text apart, so no stretch repeats across texts.
Only stretches that repeat in their text are carried to the next length. One narrow stage, no shuffle; memory is a
small multiple of a batch, which is ``BATCH_BYTES`` or a single longer text.

Cases: a null text counts as empty (no words, no runs, nothing kept); a text of separators alone has no words; a very
long text is a batch of its own, searched whole; repeated rows and ids are each judged for themselves; among runs of
the greatest exponent the first, then that of the smallest period, is shown; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import by_bytes, lean, small_batches, text_or_empty

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
BATCH_BYTES = 2 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as bytes, and the number of the first word of each text (and of none)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = data.slice(ends[0], ends[-1] - ends[0]) if data and ends[-1] > ends[0] else pa.py_buffer(b"")
    ends = ends - ends[0]
    inside = ~SEPARATOR[np.frombuffer(raw, np.uint8)]
    cut = np.zeros(len(inside) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | cut[:-1])) if len(inside) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.append(~inside[1:], True) | cut[1:])) + 1 if len(inside) else starts
    # words and what lies between them, one after the other, over the bytes as they are
    spans = np.stack([starts, stops], axis=1).astype(np.int32).ravel()
    every = pa.Array.from_buffers(pa.binary(), max(0, len(spans) - 1), [None, pa.py_buffer(spans if len(spans) else np.zeros(1, np.int32)), raw])
    return every.take(pa.array(np.arange(0, len(spans), 2))), np.searchsorted(starts, ends)


def find_runs(words: np.ndarray, most: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in ``words``, by start, then period. ``most``: the longest period to look for."""
    n, found = len(words), []
    places, names, span = np.arange(n), words, 1
    while len(places) and span < 2 * most:
        order = np.argsort(names, kind="stable")
        here, name = places[order], names[order]
        same = name[1:] == name[:-1]
        gap = here[1:] - here[:-1]
        near = same & (gap <= span) & (2 * gap > span)
        order = np.argsort(here[:-1][near], kind="stable")
        at, gap = here[:-1][near][order], gap[near][order]
        if len(at):
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])))
            last = np.append(first[1:], len(at)) - 1
            start, period = at[first], gap[first]
            end = at[last] + span + period
            whole = end - start >= np.maximum(least, times * period)
            start, end, period = start[whole], end[whole], period[whole]
            before = (start > 0) & (words[start - 1] == words[start - 1 + period])
            after = (end < n) & (words[np.minimum(end, n - 1)] == words[end - period])
            found.append(np.stack([start, period, end], axis=1)[~before & ~after])
        # on to twice the length, with the stretches of which both halves repeat
        repeats = np.append(same, False) | np.append(False, same)
        number = np.full(n + span, -1, np.int64)
        number[here[repeats]] = np.cumsum(np.append(True, ~same))[repeats]
        places = np.sort(here[repeats])
        places = places[number[places + span] >= 0]
        names = number[places] * (n + 1) + number[places + span]
        span *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    one = np.append(True, (rows[1:, [0, 2]] != rows[:-1, [0, 2]]).any(axis=1))[: len(rows)]
    rows = rows[one]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 2] - rows[:, 0], rows[:, 1]


class Found(NamedTuple):
    """Runs ``(start, length, period)`` of each text, words counted in the text, and the kept words of each."""

    runs: list[list[tuple[int, int, int]]]
    n_words: np.ndarray
    n_kept: np.ndarray
    collapsed: pa.Array


Rewrite = Callable[[int | None, int], np.ndarray | None]


def searched(ids: list, texts: pa.Array, rewrite: Rewrite | None = None) -> Found:
    """Runs of a batch of texts. ``rewrite``: for an id and a number of words the numbers of the words to read in their place."""
    words, firsts = split(texts)
    n_words = np.diff(firsts)
    source = np.arange(len(words))
    if rewrite:
        for i, (key, a, n) in enumerate(zip(ids, firsts, n_words)):  # noqa: B007
            other = rewrite(key, int(n))
            if other is not None:
                source[a : a + n] = a + other
    text = np.repeat(np.arange(len(n_words)), n_words)
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)[source] + text * len(coded.dictionary)
    starts, lengths, periods = find_runs(codes, int(n_words.max(initial=0)) // TIMES)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    ends = np.searchsorted(kept, firsts)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(source[kept])))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in n_words]
    for i, s, m, p in zip(text[starts].tolist(), starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
        runs[i].append((s - int(firsts[i]), m, p))
    return Found(runs, n_words, np.diff(ends), pc.binary_join(lists, pa.scalar(b" ", pa.binary())))


def over_texts(documents: DataFrame, run: Callable[[pa.Array, Found], pa.RecordBatch], schema: str, id_column: str, text_column: str, rewrite: Rewrite | None = None) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids = batch.column("id")
            yield run(ids, searched(ids.to_pylist(), batch.column("text"), rewrite))

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(lean(task), schema)


def runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, start, length, period)``: the runs of each text; ``start`` is a word number."""

    def out(ids: pa.Array, found: Found) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(ids)), [len(r) for r in found.runs])
        columns = np.array([x for r in found.runs for x in r], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *(pa.array(c) for c in columns.T)], names=[id_column, "start", "length", "period"])

    return over_texts(documents, out, f"`{id_column}` long, start long, length long, period long", id_column, text_column)


def collapsed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_dropped, text)``: each text without the words of runs after their first period, joined by spaces."""

    def out(ids: pa.Array, found: Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(found.n_words), pa.array(found.n_words - found.n_kept), found.collapsed.cast(pa.string())], names=[id_column, "n_words", "n_dropped", "text"])

    return over_texts(documents, out, f"`{id_column}` long, n_words long, n_dropped long, text string", id_column, text_column)


def digest(documents: DataFrame, rewrite: Rewrite | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each text the number of its runs, that of the greatest exponent, and hashes of all runs and of what is kept."""

    def out(ids: pa.Array, found: Found) -> pa.RecordBatch:
        best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else (None, None, None) for r in found.runs]
        lines = ["".join(f"{s},{m},{p}\n" for s, m, p in r) for r in found.runs]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([len(r) for r in found.runs], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*best)),
                pa.array([None if m is None else 1000 * m // p for _, m, p in best], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in found.collapsed]),
            ],
            names=[id_column, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        )

    schema = f"`{id_column}` long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return over_texts(documents, out, schema, id_column, text_column, rewrite)
