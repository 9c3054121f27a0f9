"""The encoder of many texts: new words of a batch together, as the tokenizers library and each piece alone have them."""

import random

import public_tokenizers
import pytest
import regex

from sieveline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def test_pieces_are_encoded_together_as_alone(vocab):
    """Steps back and dead places included: letters of few kinds, all letters and digits of Latin-1, up to 64 characters."""
    r = random.Random(5)
    latin = [chr(c) for c in range(256) if chr(c).isalnum()]
    pieces = {"".join(r.choices(latin, k=r.randint(1, 20))) for _ in range(2000)} | {"".join(r.choices("ab", k=r.randint(1, 64))) for _ in range(1000)}
    pieces = [*pieces | {"".join(r.choices("aeinrst", k=r.randint(30, 64))) for _ in range(1000)} | {"a" * n for n in range(1, 65)}]
    many = bpe.ManyPieces(vocab)
    for blank in ("", " "):
        ids, ends = many.encode(pieces, blank)
        start = 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            assert ids[start:end].tolist() == vocab.encode((blank + piece).encode().decode("latin-1")), piece
            start = end
        assert start == len(ids)


def test_new_words_of_many_texts_are_encoded_together():
    vocab = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    r = random.Random(7)
    parts = ["the", "tion", "ed", "re", "qu", "sch", "ß", "é", "x", "ing", "or"]
    words = list({"".join(r.choices(parts, k=r.randint(2, 9))) for _ in range(3000)})
    texts = [" ".join(r.choice((w, w.title(), f"({w},", f"{w}***", f"{w}\n{w}x")) for w in words[n : n + 30]) for n in range(0, len(words), 30)]
    codec, calls = bpe.Codec(vocab), []
    alone = vocab.encode
    vocab.encode = lambda piece: calls.append(piece) or alone(piece)
    got = [ids.tolist() for ids in codec.encode_all(texts)]
    assert len(calls) < 50  # before: one for each of the words
    vocab.encode = alone
    for text, ids in zip(texts, got, strict=True):
        assert ids == [i for p in bpe.GPT_SPLIT.findall(text) for i in alone(p.encode().decode("latin-1"))], text


@pytest.mark.parametrize("most", [bpe.CODEC_MEMO, 60, 8])
def test_what_is_learned_together_changes_no_ids(vocab, most):
    """Marks, contractions, other alphabets, special strings and all kinds of blanks; memos that are cleared all the time, texts in several groups."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    r = random.Random(11)
    parts = ["the", "THE", "tion", "Ed", "ß", "é", "º", "²", "½", "12", "a" * 70, "'s", "'t", "(", ")", "--", ".", "中", "İ", "<|endoftext|>", "<|", "\x1c", "é", "\xad", "\x00", "ǅ", "😀"]
    rare = ["", "", "\n", "\t", "  ", "\n\n", " \n", "\xa0", "　", "\x85", "\r\n"]
    texts = ["", " ", "\n", " a", "a ", "\na"]
    for blanks in ([" ", " ", ""], [" "] * 6 + rare):
        texts += ["".join(r.choice(parts) + r.choice(parts + [""] * 20) + r.choice(blanks) for _ in range(r.randint(0, 30))) for _ in range(400)]
    codec = bpe.Codec(vocab)
    for memo in (codec.of_first, codec.of_next, codec.of_token):
        memo.most = most
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids == codec.encode(text).tolist(), ascii(text)
        assert len(codec.of_next) <= most and len(codec.of_first) <= most and len(codec.of_token) <= most


def test_texts_with_runs_of_blanks_are_told_as_the_pattern_tells_them():
    blanks = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and regex.match(r"\s", c)]
    assert {*blanks} - {" ", "\n"} <= {*bpe.RARE_BLANKS}
    for a in [*blanks, "x", "\x1c", ""]:
        for b in [*blanks, "x", ""]:
            for text in (a + b, f"x{a}{b}", f"x{a}{b}x", f"{a}x{b}"):
                assert bpe.has_runs(text) == (bpe.RUNS.search(text) is not None), ascii(text)
