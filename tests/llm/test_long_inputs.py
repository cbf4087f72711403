"""Words, items and tables that are long or repetitive."""

import tracemalloc

import numpy as np

from fieldloom.llm import lattice_lm
from fieldloom.llm.lattice_lm import Pieces
from fieldloom.llm.substrings import tuned
from tests.llm.test_operators import PIECES


def test_long_words_pass_slab_by_slab(monkeypatch):
    """The recursion of long words gives what the lattice of short ones does, whatever the slab."""
    rng = np.random.default_rng(5)
    p = Pieces(PIECES, {k: float(k % 97) for k in range(32_000)}, 100.0)
    letters = np.frombuffer(b"abcdefghijklmnop0123/+", np.uint8)
    words = [b"a", b"\xff\xfe" * 300, "日本語テキスト".encode() * 60, *(bytes(rng.choice(letters, n)) for n in (5, 77, 1000))]
    times = np.arange(1.0, len(words) + 1)
    want, uses = p.words(words), p.expected(words, times)
    monkeypatch.setattr(lattice_lm, "_LONG", 0)
    for slab in (1, 7, 64, 1 << 13):
        monkeypatch.setattr(lattice_lm._LongWord.__init__, "__defaults__", (slab,))
        assert np.allclose(p.words(words), want, rtol=1e-12)
        assert np.allclose(p.expected(words, times), uses, rtol=1e-8, atol=1e-8)


def test_long_words_take_little_memory():
    p = Pieces(PIECES, {}, 10.0)
    word = bytes(np.random.default_rng(6).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 400_000))
    tracemalloc.start()
    score = p.words([word])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(score) and most < 40 * len(word) + (8 << 20)


def test_bands_follow_from_similarity_and_recall():
    assert tuned(0.8, 0.99) == (5, 2)
    for similarity in (0.3, 0.5, 0.7, 0.8, 0.9, 0.99):
        for recall in (0.9, 0.99, 0.999):
            bands, rows = tuned(similarity, recall)
            assert 1 - (1 - similarity**rows) ** bands >= recall > 1 - (1 - similarity**rows) ** (bands - 1)
    assert tuned(1.0, 0.99)[0] == 1


def test_repetitive_items_are_few_places():
    """2,000 times one word is a handful of places, and the windows found are those of brute force."""
    from fieldloom.llm.decontamination import Items, words

    items = [("a", b"a " * 2000), ("b", b"x " + b"a " * 40 + b"y"), ("c", b"a a a"), ("d", b"q " * 4 + b"a " * 6), ("e", b"")]
    at = Items(items, 10)
    assert max(len(of) for _, of in at.found.values()) < 16
    for doc in (b"a " * 30, b"z q q q q a a a a a a z", b"x " + b"a " * 9, b"y a a a y", b"a a", b"a " * 9 + b"y q"):
        w = words(doc)
        text = b" ".join([b"", *w, b""])
        ranges, names = at.scan(w, text.decode("latin-1"), np.flatnonzero(np.frombuffer(text, np.uint8) == 32))
        hit, found = set(), set()
        for name, data in items:
            own = words(data)
            size = min(10, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(w) - size + 1) if own else ():
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found.add(name)
        assert ({k for a, b in ranges for k in range(a, b)}, names) == (hit, found), doc
