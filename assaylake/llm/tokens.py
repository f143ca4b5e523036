"""Token ids of whole texts from a tokenizer file of the ``tokenizers`` library.

Splitting is exact at white space, so ids of a unit (a word, with the space before it where the vocabulary keeps spaces) are looked up
once and remembered; a text in which that isn't certain is encoded as a whole. A unit of plain letters, with punctuation after
it or without, goes to the library's model directly, past the normalising and splitting that leave it as it is.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

from assaylake.llm.common import KEPT

#: White space other than ASCII's, and what only Python takes for it, as UTF-8. A text that has any is encoded whole.
FOREIGN = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: A blank after other white space: such a text is cut before every run of white space, not at single blanks.
UNEVEN = [b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c "]
RUNS = re.compile(rb"[ \t-\r]*+[^ \t-\r]++|[ \t-\r]++")
FIRST = b"\xff"
BLANKS = {b"", b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"}
#: Letters of ASCII or Latin-1 (as UTF-8), then punctuation without an apostrophe, which could begin a contraction.
MARKS = rb"([!-&(-/:-@\[-`{-~]*+)"
ASCII = re.compile(rb"([A-Za-z]++)" + MARKS)
PLAIN = re.compile(rb"((?:[A-Za-z]++|(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)++)" + MARKS)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids as little-endian integers of ``width`` bytes. ``spaces``: "dropped" or "kept" by the vocabulary.

    Two generations of at most ``remembered`` units each are kept, the older one is dropped when the newer one is full.
    """

    def __init__(self, path: str, spaces: str, width: int, remembered: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces, self.kind, self.remembered = spaces, {2: "H", 4: "I"}[width], remembered
        if self.tokenizer.get_vocab_size() > 1 << (8 * width):
            raise ValueError("the vocabulary needs wider ids")
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.letters = byte_letters()
        self.ends: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids)

    def _units(self, text: bytes) -> list[bytes] | None:
        if self.spaces == "dropped":
            return text.split()
        if any(x in text for x in FOREIGN):
            return None
        if any(x in text for x in UNEVEN):
            return [u[1:] if u[:1] == b" " and u[1:2] not in BLANKS else FIRST + u for u in RUNS.findall(text)]
        units = text.split(b" ")
        units[0] = FIRST + units[0]
        return units

    def _string(self, unit: bytes) -> str:
        if self.spaces == "dropped":
            return unit.decode(errors="replace")
        return unit[1:].decode(errors="replace") if unit[:1] == FIRST else " " + unit.decode(errors="replace")

    def _piece(self, piece: bytes) -> bytes:
        letters = self.letters
        return self._bytes([t.id for t in self.model.tokenize("".join([letters[b] for b in piece]))])

    def _ending(self, piece: bytes) -> bytes:
        if piece not in self.ends:
            if len(self.ends) > 10_000:
                self.ends = {}
            self.ends[piece] = self._piece(piece)
        return self.ends[piece]

    def _plain_line(self, found: re.Match, space: bool) -> bytes:
        word, end = found.groups()
        if self.spaces == "dropped":
            word = word.lower() if word.isascii() else word.decode().lower().encode()
        if word.isascii():
            ids = self._bytes([t.id for t in self.model.tokenize(self.letters[32] + word.decode() if space else word.decode())])
        else:
            ids = self._piece(b" " + word if space else word)
        return ids + self._ending(end) if end else ids

    def _plain(self, unit: bytes) -> bytes | None:
        """Ids of a unit that is plain letters and punctuation, or several such lines, else None."""
        first = unit[:1] == FIRST
        space = self.spaces == "kept" and not first
        found = ASCII.fullmatch(unit, at := 1 if first else 0) or PLAIN.fullmatch(unit, at)
        if found is not None:
            return self._plain_line(found, space)
        if b"\n" not in unit:
            return None
        out = []
        for line in (unit[1:] if first else unit).split(b"\n"):
            found = ASCII.fullmatch(line) or PLAIN.fullmatch(line)
            if found is None:
                return None
            out.append(self._plain_line(found, space))
            space = False
        return self._ending(b"\n").join(out)

    def _ids(self, unit: bytes) -> bytes:
        """Ids of a unit, from now on remembered."""
        ids = self.now.get(unit) or self.before.get(unit) or self._plain(unit)
        if ids is None:
            ids = self._bytes(self.tokenizer.encode(self._string(unit), add_special_tokens=False).ids)
        self.now[unit] = ids
        return ids

    def rest(self) -> None:
        """Between tasks only the newer generation stays."""
        self.before = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as bytes."""
        running = gc.isenabled()
        gc.disable()  # the many small objects made here are in no cycles
        try:
            return [self._text(t) for t in texts]
        finally:
            if running:
                gc.enable()

    def _text(self, text: bytes) -> bytes:
        units = self._units(text)
        if units is None:
            return self._whole(text)
        if len(self.now) > self.remembered:
            self.before, self.now = self.now, {}
        found = list(map(self.now.get, units))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._ids(units[i])
        return b"".join(found)


_ENCODERS: dict[tuple, Encoder] = KEPT.setdefault("tokens", {})


def encoder(path: str, spaces: str, width: int) -> Encoder:
    """One per worker process: what it remembers serves all tasks there."""
    key = (path, spaces, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaces, width)
    return _ENCODERS[key]
