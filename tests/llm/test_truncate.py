"""Truncation of long runs without blanks: the same ends as counting each prefix anew, without counting them anew."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_truncate_reads_the_counts_at_prefixes():
    counter = bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    r = random.Random(3)
    texts = ["".join(r.choices("abcDEtheing019+/='!. \n", k=r.randint(1, 60))) for _ in range(300)]
    texts += ["we're they'll I'd 'r 'l ''s !!'ve x'm", "don't'll've", "a" * 80, "naïve café déjà", "  x", "\n\nab cd"]
    for t in texts:
        table = counter.prefix_table(t)
        for budget in range(12):
            assert counter.truncate(t, budget) == max(e for e in range(len(t) + 1) if counter.prefix_count(t, e, table) <= budget), (t, budget)
    calls = []
    count = counter.count
    counter.count = lambda t: calls.append(len(t)) or count(t)
    counter.truncate("".join(r.choices("ABCDEFGHabcdefgh0123+/", k=3000)), 100)
    assert sum(calls) < 3000


def test_runs_that_are_not_composed_are_counted_as_their_prefixes_are():
    """Letters with marks of their own, vowels and finals of Hangul, singletons, apostrophes before what a mark changes, letters that become two."""
    counter = bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    r = random.Random(5)
    letters = ["a", "e", "s", "r", "l", "m", "'", "!", "7", "\u0130", "\u304b", "\u306f", "\u3099", "\u309a", "\u0301", "\u0323", "\u0308", "\u1100", "\u1161", "\u11a8", "\uac00", "\uf900", "\u4e2d", "\u212b", "\u0958", "\u1e69", "\x1f", "\U0001d15e"]
    texts = ["".join(r.choices(r.sample(letters, r.randint(2, 8)), k=r.randint(1, 40))) for _ in range(500)]
    texts += [c * n + "\u304b\u3099" * 9 + "e\u0301" for c in ("\u4e2d", "!", "a", "\u0130") for n in (40, 400)]
    texts += ["'re\u0301", "'r\u0301e", "'s\u0301", "x'l" + "l\u0323", "!" * 400 + "'" + "s\u0301" * 3, "a" * 400 + "\u0323\u0301" * 30, "\u0130" + "\u0301" * 400 + "\u0323"]
    for t in texts:
        assert counter.prefix_table(t).tolist() == [counter._words(t[:n]) for n in range(len(t) + 1)], ascii(t)


def test_a_long_run_that_is_not_composed_takes_its_length():
    import time

    counter = bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    text = "\u4e2d\u6587" * 10_000 + "\uf900" + "\u304b\u3099" * 10_000
    began = time.time()
    table = counter.prefix_table(text)
    assert time.time() - began < 30  # by prefixes: over an hour
    for n in (19_999, 20_001, 20_002, 30_000, 30_001, len(text)):
        assert table[n] == counter._words(text[:n])


def test_stored_counts_answer_budgets(spark):
    texts = ["The token\u0301s of a prefix, don't count twice", "", "abcdefgh" * 30, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    stored = bpe.count_tokens(rows, path, prefixes=True).select("doc_id", "prefix_counts").join(rows, "doc_id")
    counter = bpe.WordCounter(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    for budget in (0, 1, 3, 7, 1000):
        got = {x.doc_id: x.text for x in bpe.truncated(stored, budget).collect()}
        assert got == {i: None if t is None else t[: counter.truncate(t, budget)] for i, t in enumerate(texts)}
    ends = stored.select("doc_id", *[bpe.tokens_at(F.col("prefix_counts"), F.lit(n)).alias(f"n{n}") for n in (0, 5, 9, 10**6)], bpe.cut_within(F.col("prefix_counts"), -1).alias("none"))
    for x in ends.collect():
        t = texts[x.doc_id] or ""
        assert [x.n0, x.n5, x.n9, x["n1000000"], x.none] == [counter.count(t[:n]) for n in (0, 5, 9, 10**6)] + [None]


def test_new_words_of_many_texts_are_programmed_together():
    """By the automaton's table all words of a batch go on a byte at a time; the counts at their prefixes are those of each word alone."""
    vocab = bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    r = random.Random(7)
    parts = ["the", "tion", "ed", "re", "qu", "sch", "ß", "é", "ñ", "ü", "ÿ", "º", "x", "ing", "aaaa", "or"]
    words = list({"".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(3000)})
    steps, ends = bpe.ManyWords(vocab).steps(words)
    start = 0
    for word, end in zip(words, ends.tolist()):
        raw = word.encode()
        counts = vocab.prefix_tokens(raw.decode("latin-1"))[2]
        assert steps[start:end].cumsum().tolist() == [counts[len(word[:n].encode())] for n in range(1, len(word) + 1)], word
        start = end
    texts = [" ".join(r.choice((w, w.title(), f"({w},", f"{w}***")) for w in words[n : n + 30]) for n in range(0, len(words), 30)]
    counter, calls = bpe.WordCounter(vocab), []
    alone = vocab.prefix_tokens
    vocab.prefix_tokens = lambda piece: calls.append(piece) or alone(piece)
    counter.learn(texts)
    tables = [counter.prefix_table(t) for t in texts]
    assert len(calls) < 50  # before: one for each of the words
    for t, table in zip(texts[::10], tables[::10]):
        assert table.tolist() == [counter._words(t[:n]) for n in range(len(t) + 1)], t


def test_what_is_learned_together_changes_no_count():
    """Texts of several alphabets, blanks of all kinds, separators, special strings and empty ones: with and without learning, and as the library counts."""
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    text = open(path, encoding="utf-8").read()
    r = random.Random(11)
    pieces = ["The", "théâtre", "ÀÉ", "don't", "'s", "(x)", "--", "a1b2", "—", "İI", "中文", "é", "µ", "ﬁ", "<|endoftext|>", "<|", "\x1c", "a" * 70, "\xd7", "ǅ"]
    blanks = [" ", " ", " ", "  ", "\n", "\t", "\xa0", "　", "\x85", ""]
    texts = ["".join(r.choice(pieces) + r.choice(blanks) for _ in range(r.randint(0, 30))) for _ in range(400)] + ["", " ", "\n\n", " a", "a ", "\x1f"]
    together, alone = bpe.WordCounter(bpe.Vocabulary(text)), bpe.WordCounter(bpe.Vocabulary(text))
    together.learn(texts)
    for t in texts:
        assert (table := together.prefix_table(t)).tolist() == alone.prefix_table(t).tolist(), ascii(t)
        assert table[-1] == len(library.encode(t, add_special_tokens=False).ids), ascii(t)
    few = bpe.WordCounter(bpe.Vocabulary(text))
    few.of_chunk.most = 8  # a memo that is cleared all the time
    few.learn(texts)
    assert [few.count(t) for t in texts] == [alone.count(t) for t in texts]
