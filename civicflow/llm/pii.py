"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is.  For disguised ones the text
passes through small transducers that keep, for each output character, the
source range it came from: (1) characters: look-alikes, full-width and other
digits, dashes and spaces to ASCII, invisible characters to nothing; (2) marks:
``(at)``, ``[dot]``, spaced or spelled "at" and "dot"; (3) spelled digits.
Identifiers found in the output are mapped back to source ranges and added
unless they overlap a plain one of their kind.

Spans count code points, ends are exclusive.  Defined cases: a null text has no
spans; repeated rows are searched each; null ids and other columns are kept as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from civicflow.llm.common import slices, with_fields

KINDS = ("email", "ip", "card", "phone")

# The patterns of the plain identifiers.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters and their ASCII forms.
_LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "İ": "I", "ɡ": "g", "ɑ": "a",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".",
}
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
            "eight": "8", "nine": "9"}
_NAMES = "|".join(_SPELLED)
_BETWEEN = r"(?:[\s,-]+|\s*\.\s*)"
_RUN = re.compile(rf"\b(?:{_NAMES}|[0-9]+)(?:{_BETWEEN}(?:{_NAMES}|[0-9]+))+\b", re.I)
_NAME = re.compile(rf"\b(?:{_NAMES})\b", re.I)
_PLUS = re.compile(rf"\bplus\s+(?=(?:{_NAMES}|[0-9]))", re.I)
_BRACKET_AT = re.compile(r"(?<!\s)\s*[\[({<]\s*(?:at|@|a)\s*[\])}>]\s*", re.I)
_BRACKET_DOT = re.compile(r"(?<!\s)\s*[\[({<]\s*(?:dot|punkt|\.)\s*[\])}>]\s*", re.I)
_SPELLED_AT = re.compile(r"(?<=[A-Za-z0-9_])(?:\s+at\s+|\s*@\s*|_at_)(?=[A-Za-z0-9-]+(?:\s+dot\s+|_dot_|\.)[A-Za-z0-9-]+)", re.I)
_SPELLED_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s+dot\s+|_dot_)(?=[A-Za-z0-9])", re.I)
#: What follows a spelled "at": a domain with a spelled "dot" before the last part.  A last part of five letters or
#: more does not count where "dot" is a noun by the word before it ("at the dot matrix") or after it ("at sparse dot products").
_SPELLED_DOMAIN = re.compile(
    r"(?:[A-Za-z0-9-]+(?:\s+dot\s+|_dot_|\.))*(?:[A-Za-z0-9-]+(?:\s+dot\s+|_dot_)[A-Za-z]{2,4}"
    r"|(?!(?:the|an?|this|that|these|those|each|every|any|some|no|one|my|your|his|her|its|our|their|polka)\s)"
    r"[A-Za-z0-9-]+(?:\s+dot\s+|_dot_)(?!(?:matrix|matrices|products?|notation|patterns?|plots?|printers?)\b)[A-Za-z]{5,})(?:\b|(?=_))", re.I)
# What every match of the patterns above that changes a text contains, in small letters.
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|a|dot|punkt|\.)\s*[\])}>]")
_LOOSE_AT = re.compile(r"\s@|@\s")
_LOOSE_DOT = re.compile(r"\sdot\s|_dot_")
_THREE_NAMES = re.compile(rf"\b(?:{_NAMES})(?:{_BETWEEN}(?:[0-9]+{_BETWEEN})*(?:{_NAMES})){{2}}\b")


class _Characters(dict):
    """Translation of single characters: look-alikes, and by rule any digit, space or compatibility form of ASCII."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        out = _LOOK_ALIKES.get(c, c)
        if out == c and code > 127:
            plain = unicodedata.normalize("NFKC", c)
            if unicodedata.decimal(c, None) is not None:
                out = str(unicodedata.decimal(c))
            elif len(plain) == 1 and plain.isascii() and unicodedata.category(c) not in ("Lo", "No"):
                out = plain
            elif c.isspace():
                out = " "
        self[code] = ord(out)
        return self[code]


_CHARACTERS = _Characters()
#: Characters that the first step changes or drops, with all from U+0250 on.
_WIDE = re.compile("[\u0250-\U0010ffff" + "".join(c for c in map(chr, range(128, 0x250)) if _CHARACTERS[ord(c)] != ord(c) or _INVISIBLE.match(c)) + "]")


class Mapped:
    """A text with the source range of each of its characters (None: the characters are the source's)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.start is None else (int(self.start[start]), int(self.end[end - 1]))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """Replace ranges (in order, apart) by at most one character each, which stands for the whole range."""
        if not edits:
            return self
        own = np.arange(len(self.text)) if self.start is None else self.start
        past = np.arange(1, len(self.text) + 1) if self.end is None else self.end
        text, starts, ends, at = [], [], [], 0
        for a, b, by in edits:
            text += [self.text[at:a], by]
            starts += [own[at:a], own[a:a + len(by)]]
            ends += [past[at:a], past[b - 1:b] if by else past[:0]]
            at = b
        return Mapped("".join([*text, self.text[at:]]), np.concatenate([*starts, own[at:]]), np.concatenate([*ends, past[at:]]))


def _wide(text: str) -> bool:
    return not text.isascii() and _WIDE.search(text) is not None


def has_sign(text: str) -> bool:
    """False only if no step of ``rewritten`` changes the text: the first step that does finds its pattern in the text as it is."""
    if _wide(text):
        return True
    low = text.lower()
    return bool("@" in low and _LOOSE_AT.search(low) or "dot" in low and _LOOSE_DOT.search(low) or _BRACKETED.search(low)
                or "plus" in low and _PLUS.search(low) or _THREE_NAMES.search(low))


def deobfuscate(text: str) -> Mapped | None:
    """The text in plain characters; None if it has no sign of a disguise."""
    return rewritten(text) if has_sign(text) else None


def rewritten(text: str) -> Mapped:
    """The text after all steps."""
    out = Mapped(text.translate(_CHARACTERS) if _wide(text) else text)
    out = out.rewrite([(*m.span(), "") for m in _INVISIBLE.finditer(out.text)])
    out = out.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(out.text)])
    out = out.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(out.text)])
    out = out.rewrite([(*m.span(), "@") for m in _SPELLED_AT.finditer(out.text)
                       if "@" in m[0] or _SPELLED_DOMAIN.match(out.text, m.end())])
    out = out.rewrite([(*m.span(), ".") for m in _SPELLED_DOT.finditer(out.text)])
    out = out.rewrite([(*m.span(), "+") for m in _PLUS.finditer(out.text)])
    runs = [m.span() for m in _RUN.finditer(out.text) if len(_NAME.findall(m[0])) >= 3]
    edits = []
    for a, b in runs:
        names = [(a + m.start(), a + m.end(), _SPELLED[m[0].lower()]) for m in _NAME.finditer(out.text[a:b])]
        for (x, y, digit), nxt in zip(names, [*names[1:], None], strict=True):
            edits.append((x, y, digit))
            if nxt and re.fullmatch(r"[\s,-]+", out.text[y:nxt[0]]):
                edits.append((y, nxt[0], ""))
    return out.rewrite(edits)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Equal to scanning for local part, ``@`` and domain from the left, but starting from each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(done, at + 1))


def find_plain(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the identifiers as written."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        if _LONG_NUMBER.search(text):
            for m in _CARD.finditer(text):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_added(text: str, plain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Source ranges of disguised identifiers."""
    out = deobfuscate(text)
    if out is None or out.text == text:
        return []
    found = []
    for a, b, kind in find_plain(out.text):
        start, end = out.source(a, b)
        if kind == "email" and not re.search(r"\.[A-Za-z]{2,}$", out.text[a:b]):
            continue
        if out.text[a:b] == text[start:end] or any(k == kind and s < end and start < e for s, e, k in plain):
            continue
        found.append((start, end, kind))
    return found


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
    for batch in slices(batches):
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            plain = find_plain(text) if text else []
            spans = [(*s, True) for s in plain] + [(*s, False) for s in (find_added(text, plain) if text else [])]
            out.append([dict(kind=k, start=a, end=b, plain=p) for a, b, k, p in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(kind))], names=[*batch.schema.names, "pii"])


def detect(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column ``text``) and ``pii``: kind, range and whether it is written plainly."""
    return rows.mapInArrow(_detect, with_fields(rows, "pii array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>"))


def mask_text(text: str | None) -> str | None:
    """The text with each identifier (overlapping ones together) replaced by its kind in brackets."""
    if not text:
        return text
    plain = find_plain(text)
    out, done = [], 0
    for a, b, kind in sorted([*plain, *find_added(text, plain)]):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at = batch.schema.get_field_index("text")
        texts = pa.array([mask_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1:]], names=batch.schema.names)


def mask(rows: DataFrame) -> DataFrame:
    """``rows`` with identifiers in ``text`` masked."""
    return rows.mapInArrow(_mask, rows.schema)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            every = [(s["start"], s["end"], s["kind"]) for s in spans]
            plain = [e for e, s in zip(every, spans, strict=True) if s["plain"]]
            out.append([*(sum(k == kind for _, _, k in plain) for kind in KINDS),
                        hashlib.sha256(_digest(plain).encode()).hexdigest(), _digest(every), len(every) - len(plain)])
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                         names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def summarise(found: DataFrame) -> DataFrame:
    """Counts and digests of ``detect``'s ``pii``: the ``n_`` columns and ``base_sha256`` are of the plain spans."""
    return found.select("doc_id", "pii").mapInArrow(
        _summary, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
