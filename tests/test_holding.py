"""A round of merges looks again only at the words that hold one of its pairs, and changes counts as all words would."""

import numpy as np

from sieveline.operators.bpe_train import _summed, holding, merged, pairs_of


def test_words_that_hold_a_pair_change_counts_as_all_words_do():
    r = np.random.default_rng(3)
    for _ in range(300):
        words = [r.integers(0, 5, r.integers(1, 8)) for _ in range(r.integers(1, 30))]
        symbols = np.concatenate([np.r_[w, -1] for w in words]).astype(np.int32)
        counts = r.integers(1, 9, len(words))
        batch = [(0, 1, 5), (0, 2, 6)] if r.random() < 0.5 else [(3, 3, 5)]
        some, often = holding(symbols, counts, batch)
        then, touched = merged(symbols, batch, len(counts))
        assert len(often) == touched.sum() == (some < 0).sum() and often.tolist() == counts[touched].tolist()
        change = lambda old, new: _summed(np.r_[old[0], new[0]], np.r_[-old[1], new[1]])
        few = change(pairs_of(some, often, 10), pairs_of(merged(some, batch, len(often))[0], often, 10))
        all_ = change(pairs_of(symbols, counts, 10), pairs_of(then, counts, 10))
        plain = lambda c: {int(k): int(n) for k, n in zip(*c) if n}
        assert plain(few) == plain(all_)
