"""Token ids by the tokenizers library, with a bounded cache of words.

The vocabulary drops white space and never joins characters across it, so the
ids of a text are those of its white-space separated words in order.  Arrow
finds the distinct words of a batch and cuts closing punctuation from them, each
distinct rest is looked up once, and numpy puts the ids together.  A worker keeps
the ids of words that it met twice and lately (a bounded number); a word that is
not kept is encoded again in each batch.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation, of which a worker keeps two, and words met once that it remembers; together about 30 MB.
KEPT_WORDS = 60_000
#: Longer words are not kept.
KEPT_CHARS = 48
#: Python counts these as white space, the vocabulary doesn't.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_TAIL = string.punctuation
#: Latin letters that no other character changes, with closing punctuation.
_LATIN = f"^[A-Za-zÀ-ÖØ-öø-įı-ſ]+[{re.escape(_TAIL)}]*$"
#: What comes before the closing punctuation.
_BEFORE = f"^.*[^{re.escape(_TAIL)}]"
#: What the vocabulary's own pattern finds in lower-case ASCII.
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Words met twice.  A full generation becomes the one before, from which words that are met again come back."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.before: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.once.pop(word, None)
        if ids is None:
            ids = self.encode(word)
            if len(word) <= KEPT_CHARS:
                if len(self.once) >= KEPT_WORDS:
                    self.once.clear()
                self.once[word] = ids
            return ids
        if len(self) >= KEPT_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _joined(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and how many are of each."""
    return np.frombuffer(b"".join(lists), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists)) // 4


def _gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the lists at ``at`` one after the other, and where each begins (and the last one ends)."""
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)
    index += np.arange(ends[-1])
    return ids[index], ends


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = _Kept(self._word)
        self.tails: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _one(self, word: str) -> bytes:
        return b"".join([self.four[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _plain(self, letters: str) -> bytes:
        return b"".join([self.four[t.id] for t in self.model.tokenize(letters)])

    def _tail(self, marks: str) -> bytes:
        ids = self._plain(marks)
        if len(self.tails) < 10_000 and len(marks) <= KEPT_CHARS:
            self.tails[marks] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Latin letters with closing punctuation are two BPE pieces, other ASCII a few, and need no normaliser; the rest goes to it."""
        core = word.rstrip(_TAIL)
        if not core:
            ids = b""
        elif not core.isalpha():
            return self._ascii(word) if word.isascii() and word.isprintable() and "<|" not in word else self._one(word)
        elif core.isascii():
            low = core.lower()
            ids = self._plain(low) if low == word else self.kept[low]
        elif max(core) < "ƀ" and "İ" not in core and unicodedata.is_normalized("NFC", core):
            low = core.lower()
            ids = self._plain(low.encode().decode("latin-1").translate(self.letters)) if low == word else self.kept[low]
        else:
            return self._one(word)
        if len(core) == len(word):
            return ids
        marks = word[len(core):]
        return ids + (self.tails.get(marks) or self._tail(marks))

    def _ascii(self, word: str) -> bytes:
        return b"".join([self.kept[p] if p.isalpha() else self.tails.get(p) or self._tail(p) for p in _PIECES.findall(word.lower())])

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, text in enumerate(texts) if any(c in text for c in _NOT_SPACE)]
        if odd:
            out = np.empty(len(texts), object)
            plain = np.setdiff1d(np.arange(len(texts)), odd)
            out[odd] = self._direct([texts[i] for i in odd])
            out[plain] = self.encode([texts[i] for i in plain])
            return out.tolist()
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        found = split.flatten().dictionary_encode()
        ids, sizes = self._distinct(found.dictionary)
        every, ends = _gather(ids, sizes, found.indices.to_numpy())
        every = every.tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [every[a:b] for a, b in zip(bounds, bounds[1:])]

    def _distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many are of each; those of a Latin word are its letters' and its closing marks'."""
        latin = pc.match_substring_regex(words, _LATIN)
        letters = pc.utf8_rtrim(words, _TAIL)
        marked = pc.and_(latin, pc.not_equal(pc.binary_length(words), pc.binary_length(letters)))
        rest = pc.if_else(latin, pc.utf8_lower(letters), words).dictionary_encode()
        marks = pc.replace_substring_regex(words.filter(marked), _BEFORE, "").dictionary_encode()
        own = list(map(self.kept.__getitem__, rest.dictionary.to_numpy(zero_copy_only=False)))
        own += [self.tails.get(m) or self._tail(m) for m in marks.dictionary.to_pylist()]
        parts = np.full((len(words), 2), len(own))  # the last list is empty: no marks
        parts[:, 0] = rest.indices.to_numpy()
        parts[marked.to_numpy(zero_copy_only=False), 1] = len(rest.dictionary) + marks.indices.to_numpy()
        ids, ends = _gather(*_joined([*own, b""]), parts.ravel())
        return ids, np.diff(ends[::2])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; Python workers are reused, so it is built once each."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
