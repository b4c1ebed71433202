"""Terms of a text: runs of digits, ASCII letters and characters beyond ASCII, only A-Z lower-cased, as UTF-8 bytes."""

from __future__ import annotations

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Each byte as a term holds it; what is no part of a term is a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()
