"""Byte-pair encoding on token compatibility: exact merges without running the merges.

Two facts carry both operators of this module. A sequence of tokens is what the merges give exactly when each adjacent
pair is what the merges give for the pair alone ("compatible"). And the last token of each prefix is unique: of the tokens
that end there, just one is compatible with the last token of the prefix before it.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, groupby, islice, repeat
from operator import itemgetter, sub

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, map_arrow, worker_table

GPT_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LETTERS, OTHERS = regex.compile(r"[\p{L}]*"), regex.compile(r"[^\s\p{L}\p{N}]*")
#: Where splitting at single blanks could differ from the pattern above.
RUNS = regex.compile(r"\s\s|\s\Z|[\x1c-\x1f]")
#: Blanks of that pattern that are neither the usual one nor a line's end.
RARE_BLANKS = [c for c in map(chr, range(0x3001)) if c not in " \n" and regex.match(r"[\s\x1c-\x1f]", c)]
#: Runs without the blanks at which the word vocabulary splits; control characters are no blanks.
CHUNKS = regex.compile("[^\t-\r \x85\xa0  -     　]+")
BLANKS = np.array([i for i in range(0x3001) if not CHUNKS.match(chr(i))], np.uint32)
#: Whether a character is none of these, by its number; all further ones have the last entry.
LETTER = np.ones(0x3002, bool)
LETTER[BLANKS] = False
#: Characters at which str.split() splits, but not the vocabulary.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that are a word of their own before and after letters; an apostrophe can begin a contraction.
MARKS = string.punctuation.replace("'", "")
#: A blank leaves the count as it is.
BLANK_STEP = bytes(4)
#: Entries of a worker's memo of pieces, and characters of the longest that it keeps; when full it starts afresh, so memory is bounded for any corpus.
MEMO, MEMO_CHARS = 400_000, 64
#: The same for the encoder, which has three of them.
CODEC_MEMO = 250_000
#: Words that are programmed together, and binary logarithm of the pairs whose fit is remembered for that, in 8 bytes each.
TOGETHER, FITS_BITS = 1 << 15, 21
#: Bytes of the lower-case letters of Latin-1.
LETTER_BYTES = sorted({b for c in range(256) if chr(c).isalpha() for b in chr(c).lower().encode()})
#: Bytes of all letters and digits of Latin-1 and of the blank before them.
PIECE_BYTES = sorted({ord(" "), *(b for c in range(256) if chr(c).isalnum() for b in chr(c).encode())})
#: Characters of the texts that are split at a time, so that their new pieces are encoded together.
TOGETHER_CHARS = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes, as character to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens of a byte-level BPE file as strings of one character a byte; a trailing end mark is kept as a flag.

    vocab: text of a tokenizers .json file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]

        def plain(token: str) -> tuple[str, bool]:
            ended = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ended else token
            return "".join(chr(alphabet[c]) for c in body), ended

        size = max([*ids.values(), *self.specials.values()]) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, whole = ids[a], ids[b], ids[a + b]
            self.merge[i, j] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, i, j
        self.inner: dict[str, int] = {}
        self.ending: dict[str, int] = {}
        self.bytes = [b""] * size
        for token, i in ids.items():
            if token in self.specials:
                continue
            body, ended = plain(token)
            (self.ending if ended else self.inner)[body] = i
            self.bytes[i] = body.encode("latin-1")
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.length = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for body, i in self.inner.items():
            self.automaton.add_word(body, (len(body), i))
        self.automaton.make_automaton()
        # tokens with and without the end mark in one automaton: (length, token, token with the mark)
        self.either = ahocorasick.Automaton()
        for body in {**self.inner, **self.ending}:
            self.either.add_word(body, (len(body), self.inner.get(body, -1), self.ending.get(body, -1)))
        self.either.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between tokens a and b alone. Remembered in a pair table."""
        key = a * len(self.rank) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the youngest of the two merges next to the boundary again and again. Two neighbours that lived side by
        # side until the time `until` would have merged across if a merge of theirs came before; at equal rank the merge
        # further left comes first.
        until = len(self.merge) + 1.0
        rank, merge = self.rank, self.merge
        while True:
            across = merge.get((a, b))
            if across is not None and across < until:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, self.right[a]
            else:
                until, b = rb + 0.5, self.left[b]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, or -1."""
        known = self.shorter.get(token)
        if known is None:
            body = self.bytes[token].decode("latin-1")
            known = -1
            for n in range(len(body) - 1, 0, -1):
                if (t := self.inner.get(body[:n])) is not None:
                    known = t
                    break
            self.shorter[token] = known
        return known

    def encode(self, piece: str) -> list[int]:
        """Tokens of a piece (a character a byte, no end mark): at each place the longest match, a shorter one or a step back if a pair doesn't fit."""
        if (whole := self.inner.get(piece)) is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (n, token) in self.automaton.iter(piece):
            start = end - n + 1
            if longest[start] < 0 or n > self.length[longest[start]]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token, size = 0, longest[0], len(piece)
        while at < size:
            while token >= 0 and (dead[at + self.length[token]] or (out and not self.compatible(out[-1], token))):
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < size else -1
            else:
                if not out:
                    raise ValueError("a byte of the text isn't in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.next_shorter(token)
        return out

    def prefix_tokens(self, piece: str) -> tuple[list[int], list[int], list[int], list[int]]:
        """Dynamic programming over all prefixes of a piece: for each length from 0 the count and the last token, without and with the end mark.

        Without an end mark in the vocabulary both are the same."""
        size = len(piece)
        count, last = [0] * (size + 1), [-1] * (size + 1)
        ends, final = [0] * (size + 1), [-1] * (size + 1)
        known, tokens = self.pairs.get, len(self.rank)
        for end, (n, token, closing) in self.either.iter(piece):
            end += 1
            at = end - n
            # of the tokens that end here one is compatible with the last token before it
            before = last[at]
            if at and before < 0:
                continue
            if token >= 0 and last[end] < 0:
                fits = known(before * tokens + token) if at else True
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    count[end], last[end] = count[at] + 1, token
            if closing >= 0 and final[end] < 0:
                fits = known(before * tokens + closing) if at else True
                if fits is None:
                    fits = self.compatible(before, closing)
                if fits:
                    ends[end], final[end] = count[at] + 1, closing
        return (count, last, ends, final) if self.ending else (count, last, count, last)

    def resumed(self, piece: str, count: list[int], last: list[int]) -> int:
        """The count of a whole word, with the end mark, whose programming is known up to a place inside it.

        piece: the word's end, from at least the longest token before that place on; count and last: what prefix_tokens() has for its known
        places, the first one being piece's beginning. So a word that goes on in another way isn't counted from its start."""
        known = len(count) - 1
        count, last = count + [0] * (len(piece) - known), last + [-1] * (len(piece) - known)
        out = 0
        for end, (n, token, closing) in self.either.iter(piece):
            end += 1
            at = end - n
            if end <= known or (before := last[at]) < 0:
                continue
            if token >= 0 and last[end] < 0 and self.compatible(before, token):
                count[end], last[end] = count[at] + 1, token
            if closing >= 0 and end == len(piece) and not out and self.compatible(before, closing):
                out = count[at] + 1
        return out if self.ending else count[-1]


def composing() -> set[str]:
    """Characters that can join with one before them: second halves of canonical pairs, and vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    return {chr(int(d[1], 16)) for d in pairs if len(d) == 2 and d[0][0] != "<"} | {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}


class Memo(dict):
    """Function results by argument, bounded."""

    def __init__(self, function, most: int = MEMO):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Together:
    """The automaton (Aho-Corasick) of tokens as a table of its moves by state and byte, for many strings at a time, and the pairs of tokens that fit.

    The tokens that end in a state are a chain of states. Only bytes of an alphabet are held, and tokens made of these."""

    def __init__(self, vocab: Vocabulary, bodies: list[str], alphabet: list[int]):
        self.vocab = vocab
        letters, moves = {chr(b): n for n, b in enumerate(alphabet)}, {}
        parent, letter, depth = [0], [0], [0]
        self.state: dict[str, int] = {}
        for body in bodies:
            if not all(c in letters for c in body):
                continue
            state = 0
            for c in body:
                known = moves.get((state, c))
                if known is None:
                    known = moves[state, c] = len(parent)
                    parent.append(state)
                    letter.append(letters[c])
                    depth.append(depth[state] + 1)
                state = known
            self.state[body] = state
        parents, by = np.array(parent), np.array(letter)
        self.depth = np.array(depth)
        self.moves = np.zeros((len(parent), len(letters)), np.int32)
        ending, shorter = np.zeros(len(parent), bool), np.zeros(len(parent), np.int64)
        ending[list(self.state.values())] = True
        #: for each state the longest token that ends there, as a state, and the next shorter one; 0: none
        self.first, self.next = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        for n in range(self.depth.max() + 1):
            states, below = np.flatnonzero(self.depth == n), np.flatnonzero(self.depth == n + 1)
            if n > 1:
                shorter[states] = self.moves[shorter[parents[states]], by[states]]
            if n:
                self.moves[states] = self.moves[shorter[states]]
                self.next[states] = self.first[shorter[states]]
                self.first[states] = np.where(ending[states], states, self.next[states])
            self.moves[parents[below], by[below]] = below
        self.number = np.zeros(256, np.int64)
        self.number[alphabet] = np.arange(len(alphabet))
        self.known = np.full(1 << FITS_BITS, -1)

    def by_state(self, ids: dict[str, int]) -> np.ndarray:
        """The token of each state, -1 where none is."""
        out = np.full(len(self.depth), -1)
        for body, state in self.state.items():
            out[state] = ids.get(body, -1)
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.compatible() for pairs; nothing (-2) before a word's beginning fits all. A place of the table holds the last pair that fell there."""
        tokens = len(self.vocab.rank)
        keys = a * tokens + b
        places = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FITS_BITS)).astype(np.int64)
        found = self.known[places]
        out = (found & 1).astype(bool)
        out[a < 0] = True
        unknown = np.flatnonzero((found >> 1 != keys) & (a >= 0))
        if len(unknown):
            new, which = np.unique(keys[unknown], return_inverse=True)
            fit = np.array([self.vocab.compatible(*divmod(k, tokens)) for k in new.tolist()])
            out[unknown] = fit[which]
            self.known[places[unknown]] = keys[unknown] << 1 | out[unknown]
        return out


class ManyWords(Together):
    """The dynamic programming of Vocabulary.prefix_tokens() for many words of Latin-1 letters, all of them a byte further at a time."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab, [*{**vocab.inner, **vocab.ending}], LETTER_BYTES)
        self.token, self.closing = self.by_state(vocab.inner), self.by_state(vocab.ending)

    def steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By how much the count (with the end mark) changes with each character of the words, end to end, and where each word ends there."""
        raws = [w.encode() for w in words]
        raw, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws])
        begins, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        starts, most = begins[order], int(sizes.max())
        left = np.searchsorted(-sizes[order], -np.arange(most + 1), side="right")
        # by number of bytes and word, the longest words first
        count, last, ends = (np.full((most + 1, len(words)), value, np.int64) for value in (0, -1, 0))
        last[0] = -2
        state = np.zeros(len(words), np.int64)
        for n in range(1, most + 1):
            state = self.moves[state[: left[n]], self.number[raw[starts[: left[n]] + n - 1]]]
            who, match = np.arange(left[n]), self.first[state]
            while len(some := np.flatnonzero(match)):
                who, match = who[some], match[some]
                at = n - self.depth[match]
                before, behind = last[at, who], count[at, who] + 1
                for tokens, counts, open_ in ((self.token[match], count, last[n, who] == -1), (self.closing[match], ends, ends[n, who] == 0)):
                    tried = np.flatnonzero(open_ & (tokens >= 0) & (before != -1))
                    fit = tried[self.fits(before[tried], tokens[tried])]
                    counts[n, who[fit]] = behind[fit]
                    if counts is count:
                        last[n, who[fit]] = tokens[fit]
                match = self.next[match]
        # the last byte of each character
        whole = np.append(raw[1:] & 0xC0 != 0x80, True)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        table = (ends if self.vocab.ending else count)[np.arange(len(raw)) - np.repeat(begins, sizes) + 1, np.repeat(rank, sizes)][whole]
        to = np.cumsum(np.add.reduceat(whole, begins))
        out = np.diff(table, prepend=0)
        out[np.append(0, to[:-1])] = table[np.append(0, to[:-1])]
        return out.astype(np.int32), to


class ManyPieces(Together):
    """Vocabulary.encode() for many pieces of Latin-1 letters or digits, all of them a step further at a time.

    The automaton is one of the tokens from behind and goes over the pieces from behind: its state at a place has the longest token that begins there."""

    def __init__(self, vocab: Vocabulary):
        behind = {body[::-1]: i for body, i in vocab.inner.items()}
        super().__init__(vocab, [*behind], PIECE_BYTES)
        self.longest = self.by_state(behind)[self.first]
        # the last entries are those of no token (-1)
        self.length, self.shorter = np.array([*vocab.length, 0]), np.full(len(vocab.length) + 1, -1)
        for i in vocab.inner.values():
            self.shorter[i] = vocab.next_shorter(i)

    def encode(self, pieces: list[str], blank: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the pieces, each behind the blank if one is given, end to end, and where each piece ends there."""
        raw = np.frombuffer("".join(chain.from_iterable(zip(repeat(blank), pieces, repeat("\n")))).encode(), np.uint8)
        ends = np.flatnonzero(raw == ord("\n"))
        starts = np.append(0, ends[:-1] + 1)
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        left = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right")
        longest, state, places = np.empty(len(raw), np.int64), np.zeros(len(pieces), np.int64), ends[order]
        letters = self.number[raw]
        for n in left.tolist():
            places = places[:n] - 1
            state = self.moves[state[:n], letters[places]]
            longest[places] = self.longest[state]
        # the last token of what is encoded up to each place, whether it is one of the result, and places from where nothing leads on
        last, taken, dead = np.full(len(raw), -1), np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        begin, end = starts, ends
        at, token = begin, longest[begin]
        while len(at):
            back = np.flatnonzero(token < 0)
            if len(back):
                # a step back, to the next shorter one of the last token
                here = at[back]
                if (here == begin[back]).any():
                    raise ValueError("a byte of the text isn't in the vocabulary")
                dead[here], taken[here - 1] = True, False
                at[back] -= self.length[last[here - 1]]
                token[back] = self.shorter[last[here - 1]]
            to = at + self.length[token]
            fit = (token >= 0) & ~dead[to]
            tried = np.flatnonzero(fit)
            fit[tried] = self.fits(np.where(at[tried] == begin[tried], -2, last[at[tried] - 1]), token[tried])
            on = np.flatnonzero(fit)
            last[to[on] - 1], taken[to[on] - 1] = token[on], True
            at = np.where(fit, to, at)
            open_ = np.flatnonzero(at < end)
            token = np.where(fit, longest[at], self.shorter[token])[open_]
            at, begin, end = at[open_], begin[open_], end[open_]
        return last[taken].astype(np.uint32), np.cumsum(np.add.reduceat(taken, starts, dtype=np.int64))


class WordCounter:
    """Token counts at every prefix of a text, under a vocabulary of lower-cased words with end marks.

    Dynamic programming over the prefixes of a word gives the counts at all of them at once; those of a text follow from its
    words'. Whole texts, truncation and budgets are answered from the stored counts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.of_word = Memo(self._word)
        self.of_chunk = Memo(self._steps)
        self.together: ManyWords | None = None
        self.longest = max(vocab.length)
        self.joining: set[str] | None = None
        self.open_word: tuple | None = None

    def _words(self, chunk: str) -> int:
        """Tokens of a chunk, its words taken one by one: for the few prefixes that split in another way than the whole."""
        chunk = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
        return sum(self.of_word[w][-1] for w in WORD_SPLIT.findall(chunk))

    def _word(self, word: str) -> list[int]:
        """Counts at each prefix of a lower-cased word, by character."""
        return self._places(word)[1:]

    def _places(self, word: str) -> list[int]:
        """Counts at each prefix of a lower-cased word, by character, from the empty one on."""
        raw = word.encode()
        counts = self.vocab.prefix_tokens(raw.decode("latin-1"))[2]
        if len(raw) == len(word):
            return counts
        return [counts[i] for i in range(len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def learn(self, texts: list[str]) -> None:
        """Program the new words of many texts together. What isn't learned here is programmed word by word when it is met."""
        met: set[str] = set()
        for text in texts:
            met.update(text.lower().split())
        memo = self.of_chunk
        new = [c for c in met if c not in memo]
        if len(memo) + 2 * len(new) > memo.most:
            memo.clear()
            new = list(met)
        cores = {c.strip(MARKS) for c in new}
        words = [w for w in cores if w not in memo and w.isalpha() and len(w) <= MEMO_CHARS and (w.isascii() or max(w) <= "\xff")][: memo.most // 2]
        if self.together is None and words:
            self.together = ManyWords(self.vocab)
        for n in range(0, len(words), TOGETHER):
            some = words[n : n + TOGETHER]
            steps, ends = self.together.steps(some)
            steps, start = steps.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist()):
                memo[word] = steps[start:end]
                start = end

    def _steps(self, chunk: str) -> bytes:
        """By how much the count changes with each character of a chunk without blanks and special strings.

        Such steps are those of the chunk's words one after the other, and sums of a text's steps are the counts at its prefixes."""
        if chunk.isascii() or max(chunk) <= "\xff":
            low = chunk.lower()
            if low != chunk:
                return self.of_chunk[low]
            if low.isalpha():
                counts = self._places(low)
                return array("i", map(sub, counts[1:], counts)).tobytes()
            core = low.strip(MARKS)
            if core.isalpha():
                before, after = low[: low.index(core)], low[low.index(core) + len(core) :]
                return (self.of_chunk[before] if before else b"") + self.of_chunk[core] + (self.of_chunk[after] if after else b"")
        counts = [0, *self._chunk(chunk)]
        return array("i", map(sub, counts[1:], counts)).tobytes()

    def _chunk(self, chunk: str) -> list[int]:
        """Counts at each prefix of a chunk without blanks and special strings, from the first character on."""
        if chunk.isascii():
            low, ends = chunk.lower(), None
            if low.isalpha():
                return self.of_word[low]
        elif unicodedata.is_normalized("NFC", chunk):
            # so is each prefix; a letter can become several
            lows = [c.lower() for c in chunk]
            low, ends = "".join(lows), accumulate(map(len, lows))
        else:
            return self._uncomposed(chunk)
        out: list[int] = []
        before = 0
        for m in WORD_SPLIT.finditer(low):
            word = m.group()
            if m.start() > len(out):
                out += [before] * (m.start() - len(out))
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                # a cut contraction is split otherwise
                inside = [self._words(word[: n + 1]) for n in range(len(word))]
            else:
                inside = self.of_word[word]
            out += [n + before for n in inside] if before else inside
            before = out[-1]
        out += [before] * (len(low) - len(out))
        return out if ends is None else [out[n - 1] for n in ends]

    def _uncomposed(self, chunk: str) -> list[int]:
        """Counts at each prefix of a chunk whose letters join with marks after them.

        Where a character begins that joins with nothing before it, what comes before is composed for good. So the composed chunk has the
        counts at these places and wherever a prefix is composed to a part of it. Elsewhere (a letter whose mark is still to come) the last
        word goes on in another way, from the place up to which its programming is known."""
        if self.joining is None:
            self.joining = composing()
        starts = [i for i, c in enumerate(chunk) if not i or not unicodedata.combining(head := unicodedata.normalize("NFD", c)[0]) and head not in self.joining]
        parts = [chunk[a:b] for a, b in zip(starts, [*starts[1:], len(chunk)])]
        whole = [unicodedata.normalize("NFC", p) for p in parts]
        full = "".join(whole)
        table = [0, *self._chunk(full)]
        lows = [c.lower() for c in full]
        low, places = "".join(lows), [0, *accumulate(map(len, lows))]
        words = [m.span() for m in WORD_SPLIT.finditer(low)]
        out: list[int] = []
        at = word = 0  # where the part begins in the composed chunk, and the last word that begins before it
        for part, composed in zip(parts, whole):
            while word + 1 < len(words) and words[word + 1][0] < places[at]:
                word += 1
            for n in range(1, len(part) + 1):
                own = composed if n == len(part) else unicodedata.normalize("NFC", part[:n])
                if composed.startswith(own):
                    out.append(table[at + len(own)])
                else:
                    out.append(self._continued(full, low, places, table, words, word, at, "".join(c.lower() for c in own)))
            at += len(composed)
        return out

    def _continued(self, full: str, low: str, places: list[int], table: list[int], words: list[tuple[int, int]], word: int, at: int, own: str) -> int:
        """Tokens of the composed text up to a place, with other characters behind it."""
        place = places[at]
        if not at or not words or words[word][0] >= place:
            return self._split(low[:place] + own)
        start, end = words[word]
        if end < place:
            # the last word is closed
            return table[at] + self._split(own)
        if place - start <= 2 * self.longest:
            # an apostrophe before the word can belong to it after all
            word -= word > 0 and low[slice(*words[word - 1])] == "'" and words[word - 1][1] == start
            # nor does a word have to begin with a character: one can become several in lower case
            while word and places[bisect_left(places, words[word][0])] != words[word][0]:
                word -= 1
            start = words[word][0]
            return table[bisect_left(places, start)] + self._split(low[start:place] + own)
        kind = LETTERS if LETTERS.match(low[start]).end() else OTHERS
        more = kind.match(own).end()
        if not more:
            return table[at] + self._split(own)
        if self.open_word is None or self.open_word[0] is not low or self.open_word[1] != start:
            raw = low[start:end].encode()
            count, last, _, _ = self.vocab.prefix_tokens(raw.decode("latin-1"))
            sizes = [0, *accumulate(len(c.encode()) for c in low[start:end])]
            self.open_word = (low, start, self._split(low[:start]), raw, count, last, sizes)
        _, _, before, raw, count, last, sizes = self.open_word
        to = sizes[place - start]
        since = to - self.longest
        piece = (raw[since:to] + own[:more].encode()).decode("latin-1")
        return before + self.vocab.resumed(piece, count[since : to + 1], last[since : to + 1]) + self._split(own[more:])

    def _split(self, low: str) -> int:
        return sum(self.of_word[w][-1] for w in WORD_SPLIT.findall(low))

    def segments(self, text: str):
        """Pieces of the text between special strings, and the special strings."""
        if self.vocab.special_split is None or "<|" not in text:
            return [(text, False)]
        return [(s, s in self.vocab.specials) for s in self.vocab.special_split.split(text) if s]

    def prefix_table(self, text: str) -> np.ndarray:
        """The exact token count of text[:n] for each n from 0 to len(text): the stored table that answers all questions about prefixes."""
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        run = (0, 0)  # where the run of characters without a blank begins that ends here, and the count up to there
        for segment, special in self.segments(text):
            size = len(segment)
            if special:
                for n in range(1, size):
                    out[at + n] = run[1] + self._words(text[run[0] : at + n])
                total += 1
                out[at + size] = total
                run = (at + size, total)
            elif size:
                found, steps = self._segment(segment)
                counts = out[at + 1 : at + 1 + size]
                np.cumsum(steps, out=counts)
                if total:
                    counts += total
                total = int(counts[-1])
                start = at + size - len(found[-1]) if found and CHUNKS.match(segment[-1]) else at + size
                run = (start, int(out[start]))
            at += size
        return out

    def _segment(self, segment: str) -> tuple[list[str], np.ndarray]:
        """The chunks of a text without special strings, and by how much the count changes with each of its characters."""
        try:
            # here lower case is taken at once: each character stays one, and nothing joins
            codes = np.frombuffer(segment.encode("latin-1"), np.uint8)
            segment = segment.lower()
        except UnicodeEncodeError:
            codes = None
        found = CHUNKS.findall(segment) if any(c in segment for c in SEPARATORS) else segment.split()
        steps = itemgetter(*found)(self.of_chunk) if len(found) > 1 else [self.of_chunk[c] for c in found]
        joined = BLANK_STEP.join(steps)
        if len(joined) == 4 * len(segment):
            # one blank between chunks, none elsewhere
            return found, np.frombuffer(joined, np.int32)
        if codes is None:
            codes = np.minimum(np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32), len(LETTER) - 1)
        out = np.zeros(len(segment), np.int32)
        out[LETTER[codes]] = np.frombuffer(b"".join(steps), np.int32)
        return found, out

    def count(self, text: str) -> int:
        """The count at the last prefix."""
        return int(self.prefix_table(text)[-1])

    def prefix_count(self, text: str, end: int, table: np.ndarray | None = None) -> int:
        """Tokens of text[:end] as a text of its own: a lookup."""
        return int((self.prefix_table(text) if table is None else table)[end])

    def truncate(self, text: str, budget: int) -> int:
        """The largest end such that text[:end] has at most budget tokens."""
        return cut_at(self.prefix_table(text), budget)


def cut_at(counts: np.ndarray, budget: int) -> int:
    """The longest prefix within a budget, from the counts at all prefixes (which can fall as a word grows)."""
    return int(np.flatnonzero(counts <= budget)[-1])


def has_runs(text: str) -> bool:
    """Whether splitting at single blanks could differ from the pattern; texts with the usual blanks and line ends alone are told sooner."""
    if any(map(text.__contains__, RARE_BLANKS)):
        return RUNS.search(text) is not None
    return text.endswith((" ", "\n")) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text


class Codec:
    """Encoder and decoder for a byte-level vocabulary without end marks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.of_first, self.of_next = Memo(self._word, CODEC_MEMO), Memo(lambda w: self._word(w, " "), CODEC_MEMO)
        self.of_token = Memo(self._piece, CODEC_MEMO)
        self.together: ManyPieces | None = None
        sizes = np.array(vocab.length, np.int64)
        self.table = (np.frombuffer(b"".join(vocab.bytes), np.uint8), np.cumsum(sizes) - sizes, sizes)
        names = [f"{i},".encode() for i in range(len(vocab.bytes))]
        sizes = np.array([len(x) for x in names], np.int64)
        self.decimal = (np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.vocab.encode(piece.encode().decode("latin-1")), np.uint32).tobytes()

    def _word(self, word: str, blank: str = "") -> bytes:
        """Tokens of a word between blanks, behind the blank if one is given."""
        if word.isalpha():
            return self._piece(blank + word)
        core = word.strip(MARKS)
        if core.isalpha():
            start = word.index(core)
            before, after = word[:start], word[start + len(core) :]
            out = self.of_token[blank + before] + self.of_first[core] if before else (self.of_next if blank else self.of_first)[core]
            return out + self.of_token[after] if after else out
        return b"".join(map(self.of_token.__getitem__, GPT_SPLIT.findall(blank + word)))

    def _parts(self, text: str) -> list[tuple[list[str], bool | None]]:
        """A text's words between single blanks (True) or, where splitting at these could differ, its pieces (False); special strings (None) stand alone."""
        if self.vocab.special_split is None or "<|" not in text:
            segments = [text]
        else:
            segments = [s for s in self.vocab.special_split.split(text) if s]
        return [([s], None) if s in self.vocab.specials else (GPT_SPLIT.findall(s), False) if has_runs(s) else (s.split(" "), True) for s in segments]

    def _joined(self, parts: list[tuple[list[str], bool | None]]) -> np.ndarray:
        out: list[bytes] = []
        for strings, words in parts:
            if words:
                out.append(self.of_first[strings[0]])
                out += map(self.of_next.__getitem__, islice(strings, 1, None))
            elif words is None:
                out.append(np.uint32(self.vocab.specials[strings[0]]).tobytes())
            else:
                out += map(self.of_token.__getitem__, strings)
        return np.frombuffer(b"".join(out), np.uint32)

    def _learn(self, texts: list[list[tuple[list[str], bool | None]]]) -> None:
        """Encode the new words of many texts together. What isn't learned here is encoded one by one when it is met."""
        first, following, loose = set(), set(), set()
        for parts in texts:
            for strings, words in parts:
                if words:
                    first.add(strings[0])
                    following.update(islice(strings, 1, None))
                elif words is False:
                    loose.update(strings)
        for memo, met, blank in ((self.of_next, following, " "), (self.of_first, first, "")):
            cores = {w.rstrip(MARKS) for w in self._new(memo, met)}
            plain = set(filter(str.isalpha, cores))
            self._together(memo, plain, blank)
            others = [w for w in cores - plain if w]
            # behind marks a word has no blank of its own
            inside = {w.lstrip(MARKS) for w in others if w[0] in MARKS}
            if blank:
                first |= inside
            else:
                self._together(memo, filter(str.isalpha, inside))
            loose.update(GPT_SPLIT.findall(blank + " ".join(w for w in others if not w.lstrip(MARKS).isalpha())))
        self._together(self.of_token, [p for p in self._new(self.of_token, loose) if p.strip(" ").isalnum()])

    def _new(self, memo: Memo, met: set[str]) -> list[str]:
        """What a memo doesn't hold. If this and as many parts of words don't go in, only what is met again stays, or nothing if that is too much."""
        new = [w for w in met if w not in memo]
        if len(memo) + 2 * len(new) > memo.most:
            again = {w: memo[w] for w in met.difference(new)}
            memo.clear()
            if len(again) + 2 * len(new) <= memo.most:
                memo.update(again)
            else:
                new = list(met)[: memo.most // 2]
        return new

    def _together(self, memo: Memo, strings: Iterable[str], blank: str = "") -> None:
        new = [s for s in strings if s not in memo and len(s) <= MEMO_CHARS and (s.isascii() or max(s) <= "\xff")]
        if self.together is None and new:
            self.together = ManyPieces(self.vocab)
        for n in range(0, len(new), TOGETHER):
            some = new[n : n + TOGETHER]
            ids, ends = self.together.encode(some, blank)
            ids, ends = ids.tobytes(), (4 * ends).tolist()
            memo.update(zip(some, (ids[a:b] for a, b in zip(chain((0,), ends), ends))))

    def encode(self, text: str) -> np.ndarray:
        return self._joined(self._parts(text))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; texts of a bounded number of characters are split and learned at a time."""
        sizes = list(accumulate(map(len, texts)))
        for _, group in groupby(range(len(texts)), lambda i: sizes[i] // TOGETHER_CHARS):
            some = [self._parts(texts[i]) for i in group]
            self._learn(some)
            yield from map(self._joined, some)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids by the offset table; bytes that are no UTF-8 become U+FFFD."""
        data, starts, sizes = self.table
        return gather(data, starts[ids], sizes[ids]).tobytes().decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        data, starts, sizes = self.decimal
        return gather(data, starts[ids], sizes[ids]).tobytes()[:-1]


def _loaded(text: str, kind: type):
    """A worker builds its tables once for each vocabulary."""
    return worker_table((hashlib.sha1(text.encode()).hexdigest(), kind.__name__), lambda: kind(Vocabulary(text)))


def _vocabulary_text(path: str, limit: int = 32 << 20) -> str:
    """A vocabulary file has a fixed size, which is checked before it goes to all executors."""
    with open(path, encoding="utf-8") as f:
        text = f.read(limit + 1)
    if len(text) > limit:
        raise ValueError("the vocabulary file is larger than its bound")
    return text


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id", limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_tokens of the whole text, over_limit, and cut, the number of characters that hold at most `limit` tokens; with prefixes also prefix_counts, the count at each prefix by character, from the empty one on.

    Null and empty texts have 0 bytes and 0 tokens. Very long texts are counted whole, in time proportional to their length
    (only marks behind one and the same letter take the square of their number, if they aren't in Unicode's order). Any key goes
    through, null and repeated ones too; other columns don't matter; an empty table has no result. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary_text(vocab_path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        counter = _loaded(shared.value, WordCounter)
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        counts, cuts, tables = [], [], []
        texts = [s or "" for s in batch.column(1).to_pylist()]
        counter.learn(texts)
        for s in texts:
            table = counter.prefix_table(s)
            n = int(table[-1])
            counts.append(n)
            cuts.append(len(s) if n <= limit else cut_at(table, limit))
            if prefixes:
                tables.append(table.astype(np.int32))
        out = [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(cuts, pa.int64())]
        names = [key, "n_bytes", "n_tokens", "over_limit", "cut"]
        if prefixes:
            out, names = [*out, pa.array(tables, pa.list_(pa.int32()))], [*names, "prefix_counts"]
        yield pa.record_batch(out, names=names)

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut long" + ", prefix_counts array<int>" * prefixes, tables=True)


def tokens_at(counts: Column, end: Column) -> Column:
    """Tokens of the first `end` characters, from a stored column prefix_counts (see count_tokens): nothing is encoded again.

    Ends beyond the text stand for the whole text, those below 0 for the empty one; null where either is null."""
    return F.when(end.isNotNull(), F.get(counts, F.least(F.greatest(end, F.lit(0)), F.size(counts) - 1)))


def cut_within(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from a stored column prefix_counts; null where either is null or the budget below 0.

    The count can fall as a word grows, so the last place within the budget is taken, not the first one beyond it."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def truncated(rows: DataFrame, budget: Column | int, text: str = "text", counts: str = "prefix_counts") -> DataFrame:
    """rows with the text cut to a budget of tokens, that of a row or the same for all, by its stored counts. Null texts, and negative or null budgets, give null."""
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), cut_within(F.col(counts), budget)))


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids); with keep_ids also ids and decoded.

    Null counts as the empty text, which has no ids. Very long texts are encoded whole, in time proportional to their length. Any key goes
    through: repeated rows and null keys give a row each; columns beside key and text don't matter, whatever their names; an empty
    table has no result. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary_text(vocab_path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        codec = _loaded(shared.value, Codec)
        counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
        for ids in codec.encode_all([s or "" for s in batch.column(1).to_pylist()]):
            decoded = codec.decode(ids)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(codec.decimals(ids)).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            if keep_ids:
                all_ids.append(ids.astype(np.int32))
                texts.append(decoded)
        out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            out, names = [*out, pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts)], [*names, "ids", "decoded"]
        yield pa.record_batch(out, names=names)

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids, tables=True)
