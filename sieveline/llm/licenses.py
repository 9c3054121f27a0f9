"""License scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

Units of a text are each line, each paragraph, the whole text, and, for each template, each run of as many words as the
template has that begins with one of its bigrams, so that a notice in the middle of a line, wrapped over lines or followed by
other text is found as well. Templates whose number of bigrams can't reach the threshold with a unit's are pruned before any
comparison; runs are compared only where enough of the template's bigrams stand close by; texts without a bigram of any
template are passed over in bulk.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_table, hash_words, map_arrow, mix64, text_buffer

#: Notices by which works state their licence.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
PERCENT = 80


def templates_of(folder: Path = Path(__file__).parent / "license_texts") -> list[tuple[str, str]]:
    """(licence, text) of the notices and of the whole licences in the folder."""
    return sorted([*NOTICES.items(), *((p.stem, p.read_text(encoding="utf-8")) for p in folder.glob("*.txt"))])


LOWER = ascii_lower_table()
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = True
_WORDS = re.compile(r"[a-z0-9]+", re.ASCII)
_PARAGRAPHS = re.compile(r"\n[ \t\r]*\n")


def words(text: str) -> list[str]:
    """Normalised words: runs of ASCII letters and digits, in lower case."""
    return _WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower())


def bigrams(text: str) -> set[tuple[str, str]]:
    w = words(text)
    return set(zip(w, w[1:]))


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """Least and most bigrams of a set that can reach the threshold with one of n: 2 * min / (n + m) >= percent / 100."""
    return -(-percent * n // (200 - percent)), (200 - percent) * n // percent


class Scanner:
    """templates: (name, text); several texts may have a name."""

    def __init__(self, templates: list[tuple[str, str]], percent: int):
        self.percent = percent
        self.templates = []
        for name, text in sorted(templates):
            w = words(text)
            if len(w) > 1:
                own = set(zip(w, w[1:]))
                self.templates.append((name, len(w), own, *size_bounds(len(own), percent)))
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self._hashes(pa.array([text]))[0] for _, text in templates)]))
        self.least = min((low for *_, low, _ in self.templates), default=0)
        self.most = max((high for *_, high in self.templates), default=0)

    @staticmethod
    def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_buffer(column)
        h, firsts = hash_words(LOWER[raw], WORD, offsets)
        if len(h) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        return mix64(h[:-1] * np.uint64(3) + h[1:]), np.where(text[1:] == text[:-1], text[1:], -1)

    def possible(self, column: pa.Array) -> np.ndarray:
        """Texts with as many bigrams of templates as the smallest unit that reaches the threshold shares with one."""
        pairs, text = self._hashes(column)
        if not len(pairs) or not len(self.hashes):
            return np.zeros(len(column), bool)
        at = np.minimum(np.searchsorted(self.hashes, pairs), len(self.hashes) - 1)
        own = text[(self.hashes[at] == pairs) & (text >= 0)]
        return np.bincount(own, minlength=len(column)) >= max(self.least, 1)

    def _runs(self, found: list[tuple[str, str]], length: int, template: set, low: int, high: int):
        """(bigrams, shared bigrams) of each run of `length` words that begins with a bigram of the template and may reach the threshold."""
        match = np.fromiter((g in template for g in found), bool, len(found))
        starts = np.flatnonzero(match)
        # a run shares no more bigrams than stand in it
        near = np.concatenate([[0], np.cumsum(match)])
        starts = starts[near[np.minimum(starts + length - 1, len(found))] - near[starts] >= low]
        seen: Counter = Counter()
        a = b = shared = 0
        for start in starts.tolist():
            if start >= b:
                seen.clear()
                a, b, shared = start, start, 0
            while a < start:
                g = found[a]
                seen[g] -= 1
                if not seen[g]:
                    del seen[g]
                    shared -= g in template
                a += 1
            while b < min(start + length - 1, len(found)):
                g = found[b]
                if not seen[g]:
                    shared += g in template
                seen[g] += 1
                b += 1
            if low <= len(seen) <= high:
                yield len(seen), shared

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(template, 2 * shared bigrams, sum of both sizes) of each template's best unit that reaches the threshold."""
        best: dict[str, tuple[int, int]] = {}

        def offer(name: str, size: int, shared: int, of: int) -> None:
            twice, total = 2 * shared, size + of
            if 100 * twice >= self.percent * total:
                before = best.get(name)
                if before is None or twice * before[1] > before[0] * total:
                    best[name] = (twice, total)

        for unit in {*text.split("\n"), *_PARAGRAPHS.split(text), text}:
            own = bigrams(unit)
            if not self.least <= len(own) <= self.most or not own:
                continue
            for name, _, template, low, high in self.templates:
                if low <= len(own) <= high:
                    offer(name, len(own), len(own & template), len(template))
        w = words(text)
        found = list(zip(w, w[1:]))
        held = set(found)
        for name, length, template, low, high in self.templates:
            if len(template & held) >= low:
                for size, shared in self._runs(found, length, template, low, high):
                    offer(name, size, shared, len(template))
        return sorted((name, *v) for name, v in best.items())


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: key, licenses (names of the templates with a unit of a Dice coefficient of at least percent / 100, in order), best (the closest, of equals the first name) and dice (its coefficient, rounded to 6 places; 0 without one).

    Null, empty and blank texts, and templates of fewer than two words, match nothing. Very long texts are scanned whole.
    Repeated rows and keys are each scanned; templates that repeat a name count as one licence, by the closest of them. Other
    columns of docs don't matter, whatever they are called; an empty table has no result. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates_of() if templates is None else templates, percent))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        names, best, dice = [], [], []
        possible = shared.value.possible(batch.column(1))
        for k, value in enumerate(batch.column(1)):
            found = shared.value.scan(value.as_py()) if possible[k] else []
            names.append([name for name, *_ in found])
            top = max(found, key=lambda f: f[1] / f[2], default=None)
            best.append(top[0] if top else None)
            dice.append(round(top[1] / top[2], 6) if top else 0.0)
        yield pa.record_batch([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(best, pa.string()), pa.array(dice, pa.float64())], names=["key", "licenses", "best", "dice"])

    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, licenses array<string>, best string, dice double").withColumnRenamed("key", key)
