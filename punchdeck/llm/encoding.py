"""Encoding of whole texts with public tokenizers, each distinct unit of text only once.

A text is split at boundaries that no pre-tokenizer pattern crosses, so the ids of the text are the ids of its
units one after the other. Units that a worker has not met go to the library in batches balanced by bytes; the
others come from a bounded table. Equality with the library over whole texts is tested on random Unicode.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

from punchdeck.llm.common import HELD

# Texts of these characters alone are split at the ends of letter runs too: there Python's idea of letters, digits
# and white space is the tokenizers' for certain. U+0130 is left out as its lower case has a combining mark.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
UNSURE = re.compile(rf"[^\x00-\x1b\x20-\x7f\u00a0-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7{LETTERS}]")
RUN = rf"[{LETTERS}]+|[^\s{LETTERS}]+(?=\s|\Z)|[^\s{LETTERS}]+[{LETTERS}]+"
RUNS, SPACED_RUNS = re.compile(RUN), re.compile(rf"\s*(?:{RUN})|\s+")
# Python counts these as white space and the tokenizers' patterns do not: such texts are not split.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACED_UNIT = re.compile(r"\s*\S+|\s+$")


def words(text: str) -> list[str]:
    """Units for patterns that drop white space."""
    if not UNSURE.search(text):
        return RUNS.findall(text) if "<|" not in text else text.split()
    return [text] if ODD_SPACE.search(text) else text.split()


def lower_words(text: str) -> list[str]:
    """``words`` for tokenizers that lower-case: spellings of a word are one unit."""
    low = text.lower()
    if "<|" in text or UNSURE.search(low) or not text.isascii() and UNSURE.search(text):
        return words(text)
    return RUNS.findall(low)


def spaced_words(text: str) -> list[str]:
    """Units for byte-level patterns: white space goes with what comes after it."""
    if not UNSURE.search(text):
        return SPACED_RUNS.findall(text) if "<|" not in text else SPACED_UNIT.findall(text)
    return [text] if ODD_SPACE.search(text) else SPACED_UNIT.findall(text)


#: Units that no normalizer changes and that a pattern for runs of letters takes whole.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Plain units go to the library so many at a time: the last id of each, and no other, is a token with this end.
JOINED, WORD_END = 200, "</w>"
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def lowers(path: str) -> bool:
    """Whether a tokenizer lower-cases and then takes runs of letters, without white space."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    parts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and (
        (steps[1]["pattern"], steps[1]["content"], parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": r"\s+"}, " ", {"Regex": LETTER_RUNS}, "Removed", True)
        and held["model"].get("end_of_word_suffix") == WORD_END and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    )


#: Units of at most so many characters stay when the table is full.
SHORT = 8


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if sys.byteorder != "little":
        held.byteswap()
    return held.tobytes()


class UnitEncoder:
    """``kept``: what is kept of a unit's ids (``len`` or ``id_bytes``). ``room``: units the table holds at most."""

    def __init__(self, path: str, split: Callable[[str], list[str]], kept: Callable, room: int = 600_000, batch_bytes: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.plain = None
        if split is words and lowers(path):
            # the same model, for units on which normalizer and pattern do nothing: they take most of the library's time
            split, self.plain = lower_words, Tokenizer.from_file(path)
            self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = {i for t, i in self.plain.get_vocab(with_added_tokens=False).items() if t.endswith(WORD_END)}
        self.library, self.split, self.kept, self.room, self.batch_bytes = Tokenizer.from_file(path), split, kept, room, batch_bytes
        self.table: dict[str, object] = {}

    def _learn(self, units: Iterable[str]) -> None:
        batch, held = [], 0
        for unit in units:
            batch.append(unit)
            held += len(unit)
            if held >= self.batch_bytes:
                self._encode(batch)
                batch, held = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        plain = [u for u in batch if PLAIN.fullmatch(u)] if self.plain else []
        other = [u for u in batch if not PLAIN.fullmatch(u)] if self.plain else batch
        for k in range(0, len(plain), JOINED):
            units = plain[k : k + JOINED]
            ids = self.plain.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids
            stops = [j for j, i in enumerate(ids, 1) if i in self.ends]
            if len(stops) == len(units) and stops[-1] == len(ids):
                self.table.update(zip(units, (self.kept(ids[a:b]) for a, b in zip([0, *stops], stops))))
            else:  # a word without an end of its own
                other += units
        if other:
            for unit, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
                self.table[unit] = self.kept(e.ids)

    def __call__(self, texts: list[str], fold: Callable = list) -> list:
        """For each text its units' kept values in order, put together by ``fold`` (``b"".join`` or ``sum``)."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.table)
        if len(self.table) + len(new) > self.room:
            # long units seldom come again
            self.table = {u: v for u, v in self.table.items() if len(u) <= SHORT}
            if len(self.table) > self.room // 2:
                self.table = {}
            new = set().union(*split).difference(self.table)
        self._learn(new)
        get = self.table.__getitem__
        return [fold(map(get, units)) for units in split]


def encoder(path: str, split: Callable, kept: Callable, room: int = 600_000) -> UnitEncoder:
    """One at a time for each worker process; functions that use it are ``lean`` with ``keeps``."""
    key = (path, split.__name__, kept.__name__, room)
    if key not in HELD:
        HELD.clear()
        HELD[key] = UnitEncoder(path, split, kept, room)
    return HELD[key]
