from __future__ import annotations

import itertools

import numpy as np

from uptakelens.llm import ragged


def hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return ragged.span_hashes(data, end - [len(w) for w in words], end)


def test_span_hashes_tell_words_apart():
    words = [bytes(w) for n in range(5) for w in itertools.product(b"abc", repeat=n)]
    words += [b"x" * n for n in range(5, 200)] + [b"\0" * n for n in range(1, 80)]
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    words += [bytes(97 + (b ^ k) for b in bits[:n]) for n in (64, 128, 1024, 4096) for k in (0, 1)]
    found = hashes(words)
    assert len(set(found.tolist())) == len(set(words)) == len(words)


def test_span_hashes_depend_on_the_span_only():
    words = [b"one", b"two", b"seventeen letters", b"z" * 90, b"one", b""]
    alone = [hashes([w])[0] for w in words]
    assert hashes(words).tolist() == alone and alone[0] == alone[4]


def test_one_thing_is_held():
    made = []
    for key in ("a", "a", "b", "a"):
        ragged.held(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"]
