"""The sentences of a page's own body as arrays of term codes."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np

ENDS = ".!?…;\"”»“`"  # terminal marks of sentences and statements, closing quotation marks and back-ticks
_DROP = re.compile("[\u00ad\u200b-\u200d\ufeff]+")
_SPLIT = re.compile(r"(?<=[.!?…`])[”»“\"’)]?\s+")
_SHORT = re.compile(r"(?:^|[\s(])[^\W\d_]{1,3}\.$")  # an abbreviation, if a number follows
_TERM = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*|\d[\d.,:/–-]*|[^\w\s]")
_MARKS = re.compile("[\u0300-\u036f]+")
_DIGITS = re.compile(r"\d+")
_MOJIBAKE = re.compile("[ÃÂâÐÑ][\x80-\xbf‘-›€ŒœŠšŽžŸˆ˜…‰]")


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte charset, read again; other texts as they are."""
    if not _MOJIBAKE.search(text):
        return text
    out = []
    for line in text.split("\n"):
        if _MOJIBAKE.search(line):
            for charset in ("cp1252", "latin-1"):
                try:
                    raw = b"".join(c.encode(charset) if c < "\u0080" or not "\x80" <= c <= "\x9f" else c.encode("latin-1") for c in line)
                except UnicodeEncodeError:
                    continue
                line = raw.decode("utf-8", "ignore")
                break
        out.append(line)
    return "\n".join(out)


def plain(text: str) -> str:
    """Lower case, without accents, soft hyphens and invisible characters."""
    if not text.isascii():
        text = _DROP.sub("", text)
        if not unicodedata.is_normalized("NFKD", text):
            text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text)
    return text.lower()


def body_sentences(text: str) -> list[str]:
    """Sentences of the lines that end in a terminal punctuation mark.

    That is the rule of the C4 corpus (Raffel et al. 2020), with closing back-ticks, for telling
    running text from menus, headings, notices with buttons and footers.
    """
    out: list[str] = []
    for line in plain(repaired(text)).split("\n"):
        line = line.strip()
        if not line or line[-1] not in ENDS:
            continue
        last = ""
        for s in _SPLIT.split(line):
            if last and s[:1].isdigit() and _SHORT.search(last):
                out[-1] = last = f"{last} {s}"
            elif s:
                out.append(s)
                last = s
    return out


_CODES: dict[str, int] = {}


def _code(term: str) -> int:
    """A 31-bit code of a term; equal everywhere. Short-lived cache of common terms."""
    c = _CODES.get(term)
    if c is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        c = _CODES[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
    return c


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the terms of all body sentences, and where each sentence ends.

    Terms are words, numbers as one sign each, and other signs, once a sentence.
    """
    codes: list[int] = []
    ends: list[int] = []
    known = _CODES
    for s in body_sentences(text):
        s = _DIGITS.sub("0", s)
        terms = list(dict.fromkeys(_TERM.findall(s)))
        codes += [known.get(t) or _code(t) for t in terms]
        ends.append(len(codes))
    return np.array(codes, np.int32), np.array(ends, np.int32)
