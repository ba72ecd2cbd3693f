import random

import numpy as np

from civicflow.llm.tokens import WordEncoder, vocabulary


def test_cached_words_equal_whole_texts():
    e = WordEncoder(vocabulary())
    rng = random.Random(3)
    letters = list("abcXYZé́ .,!?'sIİΣσß \x1c\x1f\x85 \t\n1２½ªµſ日本#　ﬁÅÅ") + ["<|endoftext|>", "'re", "n't", "  ", "..", "word,"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "x" * 500]
    for _ in range(2):  # the second time from the cache
        assert e.encode(texts) == e._direct(texts)


def test_words_beyond_the_kept_number(monkeypatch):
    import civicflow.llm.tokens as tokens
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    e = WordEncoder(vocabulary())
    texts = [f"alpha beta{i} gamma delta{i} alpha" for i in range(50)]
    for t in texts:
        assert e.encode([t]) == e._direct([t])
    assert len(e.kept) < 20
    assert np.frombuffer(e.encode(["a b"])[0], "<u4").size == 2


def test_words_met_once_are_not_kept():
    e = WordEncoder(vocabulary())
    for i in range(30):  # numbers and names that never come again leave the worker's memory to the others
        texts = [f"alpha{'xyz'[i % 3]} once{i}q{j} beta" for j in range(20)]
        assert e.encode(texts) == e._direct(texts)
    assert {"alphax", "beta"} <= set(e.kept) and sum(w.startswith("once") for w in e.kept) < 30


def test_every_character_of_the_fast_paths():
    e = WordEncoder(vocabulary())
    space = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = [f for c in [*map(chr, range(0x250)), *space, "​", "﻿", "́", "ﬁ", "한"]
             for f in (c, f"a{c}b", f"Xy{c}", f"{c}Xy", f"Xy{c}.", f"a {c} b", f"don{c}t{c}s", f"a{c}<|endoftext|>{c}")]
    assert e.encode(texts) == e._direct(texts)
    assert e.encode([]) == [] and e.encode(["", "a\x1cb", "a"]) == e._direct(["", "a\x1cb", "a"])


def test_letters_are_tokenised_once_whatever_their_case_and_marks():
    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, letters):
            self.seen.append(letters)
            return self.model.tokenize(letters)

    e = WordEncoder(vocabulary())
    e.model = Counted(e.model)
    for _ in range(3):
        texts = ["Übergang übergang, ÜBERGANG! (Evening) evening evening: EVENING&&& evening=evening"] * 4
        assert e.encode(texts) == e._direct(texts)
    assert e.model.seen.count("evening") == 1 and len(e.model.seen) <= 12


def test_later_words_come_to_be_kept(monkeypatch):
    import civicflow.llm.tokens as tokens
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    e = WordEncoder(vocabulary())
    for part in "abcdef":  # each part of a table has words of its own
        texts = [" ".join(f"{part}{x}{y}" for x in "kmp" for y in "rstv")] * 2
        for _ in range(3):
            assert e.encode(texts) == e._direct(texts)
    assert "fkr" in e.kept and len(e.kept) + len(e.kept.before) + len(e.kept.once) <= 60
