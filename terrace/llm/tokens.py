"""Byte-level BPE ids of whole texts with a public tokenizer file.

The `tokenizers` library encodes; equal pieces are encoded once. A piece is what lies between two cuts, and a cut is
made only where the pre-tokenizer always has a boundary: before a single space or at a single line feed that stands
between two characters that aren't white space. Texts with other white space are encoded whole. A piece of Latin letters
alone is one word to the pre-tokenizer, so it goes to the library's model directly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

#: Bytes of a worker's piece table, about; beyond it the table starts anew, so its memory is bounded.
TABLE_BYTES = 64 << 20
#: Of an entry, as measured: a piece and its ids, most of them short.
ENTRY_BYTES = 110
#: Texts are cut and looked up in groups of about so many characters.
GROUP_CHARS = 300_000
#: Characters on whose class Unicode versions differ; texts with one are encoded whole.
_DOUBTFUL = "\u180e\u200b\u2060\ufeff\0"
#: Letters below this code are the same in all Unicode versions in use: Latin ones.
_LATIN = "\u0250"
_KEPT: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies use for each byte: its own if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, those that the library gives with add_special_tokens=False.

    So a special token's string in a text (<|endoftext|>) becomes that token.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings that the library takes for tokens of their own; a text with one is encoded whole.
        self.special = [str(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}
        self.size = 0
        ids = self.library.encode("\n", add_special_tokens=False).ids
        self.line = np.array(ids, "<u4").tobytes() if len(ids) == 1 else None
        self.line_id = ids[0]
        probe = self.library.encode("ab cd\nef", add_special_tokens=False)
        #: One-id marks that never join the letters before them.
        self.stops = {x: np.array(y, "<u4").tobytes() for x in ".," if len(y := self.library.encode(x, add_special_tokens=False).ids) == 1}
        self.pieces = self.line is not None and probe.offsets[0][0] == 0 and any(o[0] == 5 for o in probe.offsets)
        self.model = self.library.model
        self.letters = byte_letters()
        self.direct = self.library.normalizer is None and self._agrees()

    def _agrees(self) -> bool:
        """Whether the model alone gives the library's ids for words with each Latin letter."""
        words = [f" {x}{x}b" for x in map(chr, range(ord(_LATIN))) if x.isalpha()]
        return all(self._word(x) == self.whole(x) and self._word(x[1:]) == self.whole(x[1:]) for x in words)

    def _word(self, x: str) -> bytes:
        """Ids of letters, or of a space and letters, by the model."""
        space, rest = x[:1] == " ", x[x[:1] == " " :]
        if not rest.isascii():
            rest = rest.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(self.letters[32] + rest if space else rest)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def kept(path: str) -> Encoder:
        if path not in _KEPT:
            _KEPT[path] = Encoder(path)
        return _KEPT[path]

    def _learn(self, missing: list[str]) -> None:
        """Encodes pieces, many in one call, parted by line feeds."""
        step = 200
        for i in range(0, len(missing), step):
            some = missing[i : i + step]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")  # no offsets
            cuts = np.flatnonzero(ids == self.line_id)
            if len(cuts) != len(some) - 1:
                for x in some:
                    self.table[x] = np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            data, at = ids.tobytes(), 0
            for x, cut in zip(some, [*cuts.tolist(), len(ids)]):
                self.table[x] = data[4 * at : 4 * cut]
                at = cut + 1

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str] | None:
        """Pieces, each with the space or line feed before it (" \\n" for the latter); None if the text must stay whole."""
        if not self.pieces or not text.isascii() and any(x in text for x in _DOUBTFUL) or "\0" in text or any(x in text for x in self.special):
            return None
        found = text.replace("\n", " \n").replace(" ", "\0 ").split("\0")
        words = text.split()
        # So many words, parted by one character each, and as many spaces and line feeds: no other white space is there.
        return found if len(found) == len(words) and len("".join(words)) + len(words) - 1 == len(text) else None

    def learn(self, missing: set[str]) -> None:
        """Adds the ids of pieces. What follows a line feed, or stands before a last stop or comma, is encoded alone."""
        self.size += ENTRY_BYTES * len(missing)
        table, stops, line, word, direct = self.table, self.stops, self.line, self._word, self.direct
        made, alone = [], set()
        for x in missing:
            y = x[2:] if x[:2] == " \n" else x
            z = y[:-1] if y[-1:] in stops and y[-2:-1].isalpha() else y
            ids = table.get(z)
            if ids is None and direct and (z[1:] if z[:1] == " " else z).isalpha() and (z.isascii() or max(z) < _LATIN):
                ids = table[z] = word(z)
            if ids is None:
                alone.add(z)
                made.append((x, y, z))
            elif x != z:
                ids = ids + stops[y[-1]] if y != z else ids
                table[x] = line + ids if x != y else ids
        self._learn(list(alone))
        for x, y, z in made:
            ids = table[z] + stops[y[-1]] if y != z else table[z]
            table[x] = line + ids if x != y else ids

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                out += self._group(some)
                some, size = [], 0
        return out + self._group(some)

    def _group(self, texts: list[str]) -> list[bytes]:
        """Learns the new pieces of several texts in one go."""
        cuts = [self.cut(text) if text else [] for text in texts]
        every: set[str] = set().union(*[found for found in cuts if found])
        if self.size > TABLE_BYTES:  # starts anew with what these texts use
            self.table = {x: self.table[x] for x in every if x in self.table}
            self.size = ENTRY_BYTES * len(self.table)
        table = self.table
        missing = every.difference(table)
        if missing:
            self.learn(missing)
        return [self.whole(text) if found is None else b"".join(map(table.__getitem__, found)) for text, found in zip(texts, cuts)]


def crc(ids: bytes) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids) & 0xFFFFFFFF
