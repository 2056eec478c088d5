"""Personal data with offset-preserving deobfuscation."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like ASCII letters, and other forms of "@" and ".".
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅԌαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwABEKMHOPCTYXIJSGaopvikABEZHIKMNOPTYX")) | {"。": ".", "․": ".", "﹫": "@", "﹒": ".", "‐": "-", "‑": "-", "–": "-"}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that starts inside a run of digits exists only where one from the run's start does: look-behinds keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_DOT = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the pattern, found from each "@" outwards: long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: per kind leftmost and non-overlapping; failing matches are dropped."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text) if _DIGIT_DOT.search(text) else ():
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return found


class Rewritten:
    """A text after edits (start, end, replacement), with the way back from its offsets to those before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.n0, self.n1, self.s0, self.s1 = [], [], [], []
        parts, at, now = [], 0, 0
        for s, e, new in edits:
            parts += (text[at:s], new)
            now += s - at
            self.n0.append(now), self.n1.append(now + len(new)), self.s0.append(s), self.s1.append(e)
            at, now = e, now + len(new)
        self.text = "".join(parts) + text[at:]

    def start(self, i: int) -> int:
        """Source offset of the character at ``i``; inside a replacement, where its source begins."""
        k = bisect_right(self.n0, i) - 1
        return i if k < 0 else self.s0[k] if i < self.n1[k] else i - self.n1[k] + self.s1[k]

    def end(self, i: int) -> int:
        """Source offset behind the character before ``i``; inside a replacement, where its source ends."""
        i -= 1
        k = bisect_right(self.n0, i) - 1
        while k >= 0 and self.n0[k] == self.n1[k] and self.n0[k] == i + 1:
            k -= 1
        return i + 1 if k < 0 else self.s1[k] if i < self.n1[k] else i - self.n1[k] + self.s1[k] + 1

    def edited(self, a: int, b: int) -> bool:
        """Whether an edit lies inside or reaches into [a, b) of the new text."""
        k = bisect_right(self.n0, b - 1) - 1
        while k >= 0 and self.n0[k] == self.n1[k] and not a < self.n0[k] < b:
            k -= 1
        return k >= 0 and (self.n1[k] > a or a < self.n0[k] < b)


@lru_cache(1)
def _characters() -> tuple[re.Pattern, dict[str, str]]:
    """Characters that a transducer rewrites: homoglyphs, full-width forms, other scripts' digits, invisible ones."""
    to = {c: "" for c in INVISIBLE} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    to |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0x1D400, 0x1D800), *range(0x1F130, 0x1F150))}
    to |= {c: p for c, p in plain.items() if len(p) == 1 and p.isascii() and p.isalnum()}  # compatibility forms of letters and digits
    to |= HOMOGLYPHS
    return re.compile("[" + "".join(map(re.escape, to)) + "]"), to


_DIGIT = "(?:" + "|".join(DIGITS) + ")"
# A run of spelled digits and digit groups. Every token ends at a word boundary of its own and nothing is given back, so a run is read once.
_RUN = re.compile(rf"\b(?:plus[ -]+)?(?:{_DIGIT}|[0-9]++)\b(?:[ -]{{1,2}}(?:{_DIGIT}|[0-9]++)\b)*+", re.I)
_TOKEN = re.compile(rf"plus|{_DIGIT}|[0-9]+", re.I)
_BRACKET = re.compile(r"\s{0,3}[\[({<]\s{0,3}(at|dot|punkt|punto|point|arroba|@|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
# An address in words is bounded by what mail allows: 64 characters before the @, labels of 63; other disguises have no bound.
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?P<at>\s{1,3}at\s{1,3}|@)[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
_MARK = re.compile(r"\s*\b(at|dot)\b\s*", re.I)
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s{0,3}\bdot\b\s{0,3}|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_NAMED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(\s{1,3}at\s{1,3})(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,6}(?![A-Za-z0-9-])", re.I)


def _digits_of(m: re.Match) -> str | None:
    """A run with its spelled digits written out, or nothing if it spells none or is short. Separators beside a spelled digit and between
    single digits go; those between groups of digits stay."""
    tokens = list(_TOKEN.finditer(m[0]))
    values = ["+" if t[0].lower() == "plus" else DIGITS.get(t[0].lower(), t[0]) for t in tokens]
    if all(t[0].isdigit() for t in tokens) or sum(map(len, values)) < 3:
        return None
    out = [values[0]]
    for a, b, value in zip(tokens, tokens[1:], values[1:]):
        groups = a[0].isdigit() and b[0].isdigit() and len(a[0]) + len(b[0]) > 2
        out.append((m[0][a.end():b.start()] if groups else "") + value)
    return "".join(out)


@lru_cache(1)
def _words(text: str) -> set[str]:
    return set((text.replace("-", " ") if "-" in text else text).lower().split())


def _edits(text: str, step: int) -> list[tuple[int, int, str]]:
    out = []
    if step == 0:
        pattern, to = _characters()
        if not text.isascii() and not to.keys().isdisjoint(set(text)):
            out = [(m.start(), m.end(), to[m[0]]) for m in pattern.finditer(text)]
    elif step == 1:
        # spelled digits in a row, or beside groups of digits, leave one that is a word of its own
        for m in _RUN.finditer(text) if not DIGITS.keys().isdisjoint(_words(text)) else ():
            new = _digits_of(m)
            if new is not None:
                out.append((m.start(), m.end(), new))
    elif step == 2:
        out = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@", "arroba") else ".") for m in _BRACKET.finditer(text)]
    elif step == 3 and "at" in _words(text):
        out = [(m.start(1), m.end(1), "@") for m in _NAMED.finditer(text)]
    elif step == 4 and "dot" in _words(text):
        for m in sorted((*_SPACED.finditer(text), *_DOTTED.finditer(text)), key=lambda m: m.start()):
            marks = [(k.start() + m.start(), k.end() + m.start(), "@" if k[1].lower() == "at" else ".") for k in _MARK.finditer(m[0])]
            marks = [k for k in marks if m.start() < k[0] and k[1] < m.end()]
            if any(k[2] == "." for k in marks) and (not out or marks[0][0] >= out[-1][1]):
                out += marks
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added) spans. Added ones are found in the rewritten text, touch an edit, and are no base span of their kind.

    A disguise on one side leaves a shorter base span of the rest: it stays, and the added span overlaps it.

    Transducers run one after another: look-alike and invisible characters, spelled digits, bracketed and spelled at and
    dot; each keeps its offsets, and a found span goes back through all of them to the source.
    """
    base = sorted(base_spans(text))
    steps, now = [], text
    for step in range(5):
        edits = _edits(now, step)
        if edits:
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    added, known = [], set(base)
    for s, kind, e in sorted(base_spans(now)) if steps else ():
        touched = False
        for r in reversed(steps):
            touched |= r.edited(s, e)
            s, e = r.start(s), r.end(e)
        if touched and (s, kind, e) not in known:
            known.add((s, kind, e))
            added.append((s, kind, e))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and spans (kind:start:end, comma-joined), counts of base spans by kind and n_added.

    Offsets are code points of the whole text, end exclusive; null text is empty. Each row is scanned for itself, so null
    or repeated doc_ids are rows like any other. Time is linear in the text: every pattern is anchored or possessive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                base, added = all_spans(t or "")
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(4)), len(added), _joined(base), _joined(base + added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_added; see ``find_pii``."""
    return find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def mask_pii(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every span, base and added, replaced by its kind; spans that overlap go as one, by the first one's kind."""
    if text is None:
        return None
    out, at = [], 0
    base, added = all_spans(text)
    for s, k, e in sorted(base + added, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            out += (text[at:s], mark.format(KINDS[k]))
        at = max(at, e)
    return "".join(out) + text[at:]
