"""The split of texts to pre-tokens that byte-level BPE merges work in, and the byte alphabet of such vocabularies."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex
from public_tokenizers import PATTERN

_EXACT = regex.compile(PATTERN)
#: For texts of these characters only, the same split by the faster module: ASCII without the separators 1C-1F, and
#: Latin letters up to U+024F.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{_LATIN[6:]}]*")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    return _FAST.findall(text) if _PLAIN.fullmatch(text) else _EXACT.findall(text)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from U+0100 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


#: A pre-token of more characters isn't remembered.
LONGEST = 256


class Memo(dict):
    """Answers for pre-tokens, computed when they are first asked for; emptied when they take over ``most`` bytes.

    An entry counts with ENTRY bytes and those of its pre-token; what one call adds may go beyond.
    """

    ENTRY = 250

    def __init__(self, compute: Callable[[list[str]], list], most: int) -> None:
        super().__init__()
        self.compute, self.most, self.held = compute, most, 0

    def of(self, tokens: list[str]) -> list:
        if self.held > self.most:
            self.clear()
            self.held = 0
        ask = [t for t in set(tokens) if t not in self]
        once = {}
        for t, answer in zip(ask, self.compute(ask), strict=True) if ask else ():
            if len(t) > LONGEST:
                once[t] = answer
            else:
                self[t] = answer
                self.held += self.ENTRY + 2 * len(t)
        return [once[t] if t in once else self[t] for t in tokens] if once else list(map(self.__getitem__, tokens))
