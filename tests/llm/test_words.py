import re

import pyarrow as pa
import pytest

from loopweave.llm import words


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
@pytest.mark.parametrize("kind,pattern", [(words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                                          (words.BLACK, r"[^\x20\x09-\x0D]+")])
def test_words_are_those_of_the_pattern(monkeypatch, rnd, piece, kind, pattern):
    monkeypatch.setattr(words, "PIECE", piece)
    monkeypatch.setattr(words, "_POWERS", {})
    known = {}
    for _ in range(60):
        texts = [rnd.choice([None, "".join(rnd.choice("abAZé09 .\n-ßñ語 \x1c") for _ in range(
            rnd.choice([0, 1, 3, 30, 200])))]) for _ in range(rnd.randrange(8))]
        hashes, first = words.words_of(pa.array(texts, pa.string()), kind)
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert [b - a for a, b in zip(first[:-1], first[1:])] == [len(w) for w in want]
        for word, h in zip([w for t in want for w in t], hashes.tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
