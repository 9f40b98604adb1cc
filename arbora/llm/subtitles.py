"""Subtitle text: cues, spoken letters and words, robust against misread and wrongly decoded letters."""

from __future__ import annotations

import re

# Letters that character recognition takes for one another, each mapped to one of its class.
CONFUSED = {"0": "o", "1": "i", "l": "i", "c": "e", "f": "t", "b": "h"}
#: Letter pairs read for one letter, applied after the above.
MERGED = [(b"u", b"ii"), (b"rn", b"m"), (b"vv", b"w")]

#: Numbering and time lines, with {start}{end} frames.
SEPARATOR = r"^[ \t]*\d+[ \t]*$|^[^\n]*-->[^\n]*$|^WEBVTT[^\n]*$|^[ \t]*\{\d+\}\{\d+\}"
#: Markup, bracketed sound descriptions and entities; none reaches over CUE. Every alternative starts with a
#: character of its own, which lets the engine skip to the next candidate.
CUE = "\0"
_MARKS = r"<(?!a\s)[^<>\0]*>|\{[^{}\0]*\}|\[(?!dot\])[^\[\]\0]*\](?!\()|\((?<!\]\()[^()\0]*\)|\*[^*\n\0]*\*|&#?\w{1,8};"
#: Speaker names.
_SPEAKER = re.compile(r"[A-Z]{3,}:(?=[ \t])")
_SEPARATORS = re.compile(SEPARATOR, re.M)
_SPLIT = re.compile(rf"(?:(?:{SEPARATOR})\n?|\n[ \t]*\n)", re.M)
_MARK = re.compile(_MARKS)
_HAS_CUES = re.compile(r"-->|^[ \t]*\{\d+\}\{\d+\}", re.M)

_LETTERS = {x: CONFUSED.get(chr(x).lower(), chr(x).lower()) for x in range(128) if chr(x).isalpha() or chr(x) in "01"}
_TO = bytes(ord(_LETTERS.get(x, " ")) for x in range(256))
_NOT_LETTERS = bytes(x for x in range(256) if x not in _LETTERS)
_DIGIT = re.compile(r"\d")
_NUMBERS = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def _merge(b: bytes) -> bytes:
    for a, to in MERGED:
        b = b.replace(a, to)
    return b


#: Letters of other scripts than Latin, which wrong decodings of Latin text don't give.
OTHER = r"\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2c5f\u2c80-\u2dff\u2e80-\u2fff\u3005-\u3007\u3040-\ua71f\ua800-\ufaff\ufb13-\ufdff\ufe70-\ufefe\uff66-\uffdc\U00010000-\U0001efff\U00020000-\U0003ffff"
_OTHER = re.compile(f"[{OTHER}]")


class _Letters(dict):
    """For str.translate: a character's canonical letter, or nothing."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        low = c.lower()
        self[code] = _LETTERS.get(code) if code < 128 else low if c.isalpha() and _OTHER.match(c) and len(low) == 1 else None
        return self[code]


_ANY_LETTERS = _Letters()


def plain(text: str) -> str:
    return text.replace("\r", "").replace("\ufeff", "")


def raw_letters(text: str) -> str:
    """Canonical letters without spaces, punctuation and digits, before pairs are merged.

    Latin letters outside ASCII are left out on both sides of a comparison, so it doesn't matter how they were decoded;
    letters of other scripts stay."""
    if _OTHER.search(text):
        return text.translate(_ANY_LETTERS)
    return text.encode("ascii", "ignore").translate(_TO, _NOT_LETTERS).decode("ascii")


def merged(letters: str) -> str:
    """Pairs that are read for one letter become that letter, also across words; a pair that a quotation's end cuts costs an edit there."""
    for a, to in MERGED:
        letters = letters.replace(a.decode(), to.decode())
    return letters


def spoken(text: str) -> str:
    """The text without numbering, times, markup and sounds."""
    return unmarked(_SEPARATORS.sub(" ", plain(text)))


def spoken_letters(text: str) -> str:
    """The spoken text as one run of canonical letters: no spaces, punctuation, times, markup or sounds."""
    return merged(raw_letters(spoken(text)))


def cut(text: str) -> str:
    """The text with CUE between cues, or between lines where there are no cues."""
    text = plain(text).replace(CUE, " ")
    return _SPLIT.sub(CUE, text) if _HAS_CUES.search(text) else text.replace("\n", CUE)


def cues(text: str) -> list[str]:
    """Cue texts, or lines where there are no cues; empty ones are left out."""
    return [x for x in cut(text).split(CUE) if x.strip()]


def unmarked(text: str) -> str:
    text = _MARK.sub(" ", text)
    return _SPEAKER.sub(" ", text) if ": " in text else text


#: For canonical(): cues stay apart by line breaks; LINK and LISTING keep their places.
LINK, LISTING = "\1", "\2"
#: Signs that separate the items of a list, besides | / ; , and >.
BULLETS = "\u2022\u2023\u25aa\u25ab\u25b8\u25ba\u25cf\u25cb\u25e6\u2605\u2606\u3001\uff0c\uff1b\uff5c"
_TO_WORDS = bytes({0: 10, 1: 1, **dict.fromkeys(map(ord, "|/;,>"), 2)}.get(x, ord(_LETTERS.get(x, " "))) for x in range(256))
_BULLETS = re.compile(f"[{BULLETS}]")


class _Words(dict):
    """For str.translate: as _TO_WORDS, with the letters of other scripts."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = (None if c in "'?" else chr(_TO_WORDS[code])) if code < 128 else _ANY_LETTERS[code] or (" " if c.isspace() else None)
        return self[code]


_ANY_WORDS = _Words()


def canonical(text: str) -> str:
    """Canonical words, one line per cue; apostrophes and question marks (which stand for lost letters) vanish."""
    if _DIGIT.search(text):
        text = _NUMBERS.sub(" ", text)
    if not text.isascii():
        text = _BULLETS.sub(";", text)
        if _OTHER.search(text):
            return merged(text.translate(_ANY_WORDS))
    b = text.encode("ascii", "ignore")
    return _merge(b.translate(_TO_WORDS, b"'?")).decode("ascii")
