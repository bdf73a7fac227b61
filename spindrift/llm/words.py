"""Words of whole texts in bounded blocks, for operators that hash them in Python."""

from __future__ import annotations

from collections.abc import Iterator

BLOCK = 1 << 20


def word_blocks(text: str | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of the words of `text`: runs without space and tab to carriage return, A-Z lower-cased, as UTF-8.

    bytes.lower() and bytes.split() know ASCII only, which is the definition. A text is cut into
    blocks of so many characters at most, never inside a word.
    """
    if not text:
        return
    held: list[bytes] = []
    for at in range(0, len(text), block):
        piece = text[at : at + block].encode("utf-8", "replace").lower()
        if at + block >= len(text):
            yield (b"".join(held) + piece).split()
            return
        cut = max(piece.rfind(c) for c in b" \t\n\x0b\x0c\r")
        if cut < 0:
            held.append(piece)
            continue
        yield (b"".join(held) + piece[:cut]).split()
        held = [piece[cut + 1 :]]


def shingles(text: str | None, width: int, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of the space-joined runs of `width` words; a shorter text gives all its words as one."""
    last: list[bytes] = []
    some = False
    for words in word_blocks(text, block):
        words = last + words
        if len(words) >= width:
            some = True
            joined = memoryview(b" ".join(words))
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *(e + 1 for e in ends[: len(words) - width])]
            yield [joined[s:e] for s, e in zip(starts, ends[width - 1 :], strict=True)]
        last = words[-(width - 1) :] if width > 1 and len(words) >= width else [] if len(words) >= width else words
    if not some and last:
        yield [memoryview(b" ".join(last))]
