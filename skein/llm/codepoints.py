"""Unicode classes of the characters in a byte buffer of many texts."""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

OTHER_SPACE, SPACE, LETTER, NUMBER, SIGN, END = range(6)
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, SIGN, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                table[low + m.start() : low + m.end()] = kind
    table[[ord(c) for c in WHITE_SPACE]] = OTHER_SPACE
    table[32] = SPACE
    return table


def sealed(texts: list[bytes]) -> np.ndarray:
    """Texts, each followed by the byte 0xFF, which no UTF-8 text holds."""
    return np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte position, code point and class of each character; 0xFF has the class END."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    code = lead.astype(np.int32)
    long = np.flatnonzero((lead >= 0xC0) & (lead < 0xFF))
    if len(long):
        p, b = at[long], lead[long].astype(np.int32)
        tail = [data[np.minimum(p + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two = (b & 0x1F) << 6 | tail[0]
        three = (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        code[long] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, np.minimum(four, 0x10FFFF)))
    kind = class_table()[code]
    kind[lead == 0xFF] = END
    return at, code, kind
