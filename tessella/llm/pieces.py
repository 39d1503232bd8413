"""Cutting text where a byte-level BPE's pattern surely cuts, and keeping the encodings of the pieces.

The pattern is the public one of byte-level BPE: contractions, letters, numbers or marks with an optional blank before them, white space. A single blank
between two non-blanks starts a match, whatever stands around it, and a single line feed between two is a match. A full stop or comma between a letter and
a blank is a match too, so that a word is one unit whether it ends a clause or not.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before what begins a text, and before a mark that stands right behind a word.
START, TAIL = "\0", "\1"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def units(text: str) -> list[str]:
    """Parts of text whose encodings, joined, are the text's. A unit stands for its text_of: a word goes without the blank before it."""
    if not text:
        return []
    parts = (START + text.replace("\n", " \n")).split(" ")
    if "" not in parts and "\n" not in parts and parts[0] != START and START not in text and TAIL not in text and not _OTHER_SPACE.search(text):
        return parts
    first, *rest = _CUT.split(text)
    return [START + first, *[START + " " + p if p[0] in (START, TAIL) else p for p in rest]]


def text_of(unit: str) -> str:
    return unit[1:] if unit[0] in (START, TAIL) else unit if unit[0] == "\n" else " " + unit


#: White space but for the blank and the line feed.
_ODD = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


#: Fixed ranges of letters: Latin, Greek, Cyrillic, kana, Han, Hangul. What is not here is cut more slowly, not otherwise.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0400-\u0481\u048a-\u0527\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]$"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of a column of texts (null: empty), all their units as numbers of those, and each text's number of units."""
    texts = pc.fill_null(texts, "")
    cut = pc.replace_substring(texts, "\n", " \n")
    for mark in ".,":
        cut = pc.replace_substring(cut, f"{mark} ", f" {TAIL}{mark} ")
    lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(START), cut, pa.scalar("")), " ")
    coded = lists.flatten().dictionary_encode()
    known, seq = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    as_mask = lambda x: x.to_numpy(zero_copy_only=False)
    # Texts that must be cut by the pattern's own rules: with other white space, or more of it than one; with a mark that isn't behind a letter.
    bad = as_mask(pc.or_(pc.match_substring(texts, START), pc.match_substring(texts, TAIL)))
    wrong = as_mask(pc.or_(pc.is_in(known, pa.array(["", "\n"])), pc.match_substring_regex(known, _ODD)))[seq]
    wrong[1:] |= as_mask(pc.starts_with(known, TAIL))[seq[1:]] & ~as_mask(pc.match_substring_regex(known, _LETTER))[seq[:-1]]
    owner = np.repeat(np.arange(len(texts)), lengths)
    bad[owner[wrong]] = True
    if bad.any():
        slow = [units(t) for t in texts.filter(pa.array(bad)).to_pylist()]
        more = pa.array([u for x in slow for u in x], pa.string()).dictionary_encode()
        lengths[bad] = [len(x) for x in slow]
        good = ~bad[owner]
        order = np.argsort(np.concatenate([owner[good], np.repeat(np.flatnonzero(bad), lengths[bad])]), kind="stable")
        seq = np.concatenate([seq[good], more.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(known)])[order]
        known = pa.concat_arrays([known, more.dictionary])
        used = np.zeros(len(known), bool)
        used[seq] = True
        known, seq = known.filter(pa.array(used)), (np.cumsum(used) - 1)[seq]
    return known, seq, lengths


class Memo(dict):
    """unit -> its encoding, for units that come more than once in a batch, up to a bound; others are encoded for each batch that has them.
    encode gets the new units and what is known already."""

    def __init__(self, encode: Callable[[list, dict], list[bytes]], bound: int = 300_000):
        super().__init__()
        self.encode, self.bound = encode, bound

    def of(self, wanted: list, times: np.ndarray | None = None) -> list[bytes]:
        """The encodings of distinct units, in their order; times: how often each occurs."""
        found = list(map(self.get, wanted))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        made = self.encode([wanted[i] for i in missing], self)
        for i, x in zip(missing, made, strict=True):
            found[i] = x
        again = np.arange(len(missing)) if times is None else np.flatnonzero(times[missing] > 1)
        for j in again[: max(0, self.bound - len(self))].tolist():
            self[wanted[missing[j]]] = made[j]
        return found
