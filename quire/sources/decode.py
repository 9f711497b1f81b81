"""Bytes to text: byte-order marks, UTF-8, Western code page, a guess, Latin-1. Never fails, never drops bytes."""

from __future__ import annotations

import codecs

MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
#: What Western text in code page 1252 holds besides ASCII and Latin-1 letters (fixed values).
WESTERN_SIGNS = frozenset("€‚ƒ„…†‡ˆ‰‹›‘’“”•–—˜™¡¢£¤¥¦§¨©ª«¬\xad®¯°±²³´µ¶·¸¹º»¼½¾¿×÷\xa0")
WESTERN_LETTERS = frozenset("ŠšŒœŽžŸƒ") | frozenset(map(chr, range(0xC0, 0x100)))


def western(text: str) -> bool:
    """Whether text reads like a Western language: known signs and letters, never three letters beyond ASCII in a row."""
    row = 0
    for c in text:
        letter = not c.isascii() and c.isalpha()
        row = row + 1 if letter else 0
        if row == 3 or (letter and c not in WESTERN_LETTERS) or (not c.isascii() and not letter and c not in WESTERN_SIGNS):
            return False
    return True


def attempt(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding)"""
    marked = next((e for mark, e in MARKS if data.startswith(mark)), None)
    for encoding in filter(None, (marked, "utf-8")):
        text = attempt(data, encoding)
        if text is not None:
            return text, encoding
    text = attempt(data, "cp1252")
    if text is not None and western(text):
        return text, "cp1252"
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
    except ImportError:
        best = None
    return (str(best), best.encoding) if best is not None else (data.decode("latin-1"), "latin-1")
