"""Personal data, prefix trie and spelling variants against plain loops, on planted and random cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, pii, spelling, trie

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": lambda: 10 <= len(digits) <= 15}
            if ok[kind]():
                out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(3)
    for alphabet in ("a1.@+ -(5)é%4", "0123456789 -+.", "ab@.-é\n1"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            buf = text.encode()
            raw = np.frombuffer(buf, np.uint8)
            digits = np.flatnonzero((raw >= 48) & (raw <= 57))
            found = pii.base_spans(buf, 0, len(buf), np.flatnonzero(raw == 64).tolist(), (int(digits[0]), int(digits[-1])) if len(digits) else None)
            assert sorted((len(buf[:a].decode()), k, len(buf[:e].decode())) for a, e, k in found) == plain_spans(text), text


def pii_rows(spark, rows, schema="doc_id long, text string", **how):
    return sorted(pii.digest(pii.find_personal_data(spark.createDataFrame(rows, schema), **how)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.spans))


def test_patterns_find_identifiers_of_other_forms(spark):
    rng = random.Random(5)
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = [(i, f"Prose é {i}. Call the helpdesk at +1 ({num(3)}) {num(3)}-{num(4)} now.\nOr mail: u{num(3)}@m{i}.example.com") for i in range(40)]
    rows += [(i, f"Prose. Call the helpdesk at 0{num(3)}/{num(6)} now.\nOr mail: root{i}@localhost and the isbn {num(10)} of {num(4)}") for i in range(40, 50)]
    # The extension stands behind a word of its own; only identifiers found in the first round lead to it.
    rows += [(i, f"Direct line 0{num(3)}/{num(6)}") for i in range(50, 53)]
    for r in pii_rows(spark, rows, confidence=0.5)[:50]:
        text = dict(rows)[r.doc_id]
        found = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(","))}
        assert len(found) == 2, (r, found)
        if r.doc_id >= 40:
            assert r.n_phone == r.n_email == 0 and f"root{r.doc_id}@localhost" in found
    copies = [(i, "Dial now +1 (555) 123-4567 or dial now 0555/123456") for i in range(30)]
    assert all(r.spans.count("phone") == 1 for r in pii_rows(spark, copies)), "copies of one value prove no pattern"


def test_personal_data_of_odd_rows(spark):
    long = "@@@" + "a" * 200_000 + "@" + "1" * 200_000 + ".1.2.3.4.5.6.7.8 +1 " + "(" * 50_000
    rows = [(1, None, "x"), (1, "", "x"), (None, "mail: a@b.c", "x"), (2, long, "x"), (2, "same", "y"), (2, "same", "y")]
    got = pii_rows(spark, rows, "doc_id long, text string, kind string")
    assert len(got) == 6 and [r.n_email for r in got] == [0, 0, 0, 0, 1, 1]
    for r in got:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert pii_rows(spark, []) == []


def plain_trie(rows, group=100, most=6):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(turns.get(c - c % group, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, below = set(), {}
    for k in sorted(members, key=len, reverse=True):
        saved = sum(below[x][1] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        below[k] = sum(below[x][0] for x in children[k]) or 1, saved
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        out.add((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize(("partitions", "run_bytes"), [(1, 1 << 20), (7, 300), (16, 1)])
def test_trie_equals_plain_loops(spark, partitions, run_bytes):
    rng = random.Random(partitions)
    texts = ["Hi", "é" * 9, None, "", "Why?", "Thanks"]
    rows = []
    for c in [*range(230), 5005, 77007]:
        hot = rng.random() < 0.4
        for t in range(3 if hot else rng.randint(1, 9)):
            rows.append((c, None if rng.random() < 0.05 else t, "user" if hot or rng.random() < 0.9 else None, "Hello" if hot else rng.choice(texts), "x"))
    rows += rows[:20] + [(None, 1, "user", "lost", "x")]
    df = spark.createDataFrame(rows, TURNS)
    got = trie.conversation_trie(df, partitions=partitions, run_bytes=run_bytes, fan_in=3).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_trie([r[:4] for r in rows])


def test_trie_of_few_or_long_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(c, t, "user", f"turn {t}" if t < 3000 else f"{c} {t}", "x") for c in (1, 2) for t in range(3300)] + [(3, 0, "a", "z" * 100_000, "x")]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS), partitions=3).collect()
    assert {tuple(r) for r in got} == plain_trie([r[:4] for r in rows])


def test_loser_tree_compares_shared_turns_once():
    rng = random.Random(1)
    symbol = lambda x: bytes([x]) * trie.SYMBOL
    items = [(b"".join(symbol(1) for _ in range(200)) + b"".join(symbol(rng.randint(0, 3)) for _ in range(rng.randint(0, 6))), i) for i in range(600)]
    tree = trie.LoserTree([trie._Run(items[i::8]) for i in range(8)])
    merged = list(tree)
    assert [(k, c) for _, k, c in merged] == sorted(items)
    for (_, a, _), (lcp, b, _) in zip(merged, merged[1:]):
        assert lcp == trie.common(a, b, 0)
    # Without LCPs each of some 1,800 comparisons would go through 200 turns.
    assert tree.compared < 20_000


def plain_variants(counts, times=5):
    counts = {w: n for w, n in counts.items()}
    near, left = defaultdict(set), defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            left[rest, i].append(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for same in left.values():
        for w in same:
            near[w].update(set(same) - {w})
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def variants_of(spark, counts):
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(rows) == len(counts)
    return {r.word: tuple(r)[1:] for r in rows}


def test_variants_equal_plain_loops(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))): rng.choice((1, 2, 5, 10, 25, 130, 700)) for _ in range(900)}
    counts |= {"a" * n: n for n in range(1, 40)} | {"ab" * 300: 5, "ab" * 300 + "a": 60, "ab" * 150 + "x" + "ab" * 150: 300}
    assert variants_of(spark, counts) == plain_variants(counts)


def test_keys_that_collide_are_told_apart():
    rows = [(1, "abcdef", 9, 0, 0), (2, "xbcdef", 50, 0, 0), (3, "qrstuv", 70, 0, 0), (4, "bcdef", 8, -1, -1)]
    got = defaultdict(list)
    for wid, near, n, word, _ in spelling.near_in_group(rows):
        got[wid].append((near, n, word))
    assert got == {1: [(1, 50, "xbcdef"), (1, 8, "bcdef")], 2: [(1, 9, "abcdef"), (1, 8, "bcdef")], 4: [(2, 50, "xbcdef")]}


def test_words_of_documents(spark):
    rng = random.Random(4)
    vocabulary = ["Retions", "retions", "retiöns", "ÀÉretions", "house", "houses", "thousand", "x" * 3000]
    rows = [(i if i else None, " ".join(rng.choice(vocabulary) for _ in range(40)) + "×÷9", "z") for i in range(60)] + [(7, None, "z"), (8, "", "z"), (8, "", "z")]
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            counts[run] += len(run) >= 6
    got = spelling.group_spellings(spark.createDataFrame(rows, "doc_id long, text string, word string")).collect()
    assert {r.word: tuple(r)[1:] for r in got} == plain_variants({w: n for w, n in counts.items() if n >= 5})
    assert spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(None, 3), ("", 4), ("word", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(odd).collect()] == [("word", None, "word", 5, 0, None)]


def test_word_hash_tells_patterns_of_swaps_apart():
    letters = np.zeros(256, bool)
    letters[97:123] = True
    for n in (8, 64, 1024, 4096):
        word = bytes(97 + (bin(i).count("1") & 1) for i in range(n))
        raw = np.frombuffer(word + b" " + bytes(195 - c for c in word) + b" " + word, np.uint8)
        hashes, _ = common.hash_words(raw, letters, np.array([0, len(raw)]))
        assert hashes[0] == hashes[2] != hashes[1]
