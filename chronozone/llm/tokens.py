"""Encoding with public tokenizers, word by word through a bounded cache.

Texts of a common alphabet (``_COMMON``: Latin letters that lower-case to one letter, digits, ASCII marks and white space) are
split as the tokenizer's own pattern splits them, since on that alphabet its classes are plain character ranges; each piece is
then one run of the model.  Other texts are cut at spaces:

a byte-level tokenizer never merges over a single space between two other characters, and a tokenizer that drops white space
never over a space or line feed; so a text's ids are those of its pieces between such spaces, which repeat a lot.  Pieces
come from a table that a Python worker keeps between tasks, in two generations of at most ``CACHE`` entries (frequent pieces move
to the young one); a piece that is missing is encoded by the ``tokenizers`` library.  ``tests/llm`` compare the ids with those of whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct

CACHE = 300_000
#: Letters whose lower case is one letter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
_COMMON = re.compile(rf"[{_LETTERS}\t\n\x0b\x0c\r -~]*\Z")
_BYTE_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_LETTERS}0-9\t\n\x0b\x0c\r ]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\t\n\x0b\x0c\r ]+")
_MARKED = re.compile(rf"( ?[{_LETTERS}]+)([.,!%*$&#;:?|]+)\Z")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+\Z")
_FEEDS = re.compile(r"(?<=\S)\n(?=\S)")
_BESIDE = re.compile(r"\s | \s|\A | \Z|\x00")
_LOWER = re.compile(r"[a-zß-öø-ÿ]+\Z")
_made: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Young(dict):
    """A table that makes what is missing, in two generations of at most ``CACHE`` entries."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > 64:
                return ids
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def make(self, piece: str) -> bytes:
        raise NotImplementedError


class Encoder(Young):
    """Maps a piece between spaces to its ids as little-endian 32-bit integers."""

    def __init__(self, path: str, added: bool = False):
        """With ``added``, strings of added tokens in a text are those tokens, as the library does by default; else ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # pieces have no added tokens, and lower-casing makes none
        self.tokenize = self.tok.model.tokenize
        self.common = Common(self)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        steps = str(spec.get("normalizer")), str(kind)
        self.byte_level = spec.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.spaceless = "Lowercase" in steps[0] and "[^\\\\s" in steps[1] and "Removed" in steps[1]
        tokens = spec.get("added_tokens") or []
        self.added = {x["content"]: _packed([x["id"]]) for x in tokens} if added else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        if not all(x["special"] for x in tokens) or added and any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in tokens):
            # their matches hang on what is beside them: whole texts for the library
            self.byte_level = self.spaceless = False
            self.cut, self.tok.encode_special_tokens = None, not added
        elif added and not (self.byte_level or self.spaceless):
            self.cut, self.tok.encode_special_tokens = None, False
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})

    def _ids(self, piece: str) -> bytes:
        return _packed(self.tok.encode(piece, add_special_tokens=False).ids)

    def _model(self, piece: str) -> bytes:
        """Ids of one run of letters, past the splitting that would give it back whole."""
        if not piece.isalpha() or not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return _packed([x.id for x in self.tokenize(piece)])

    def make(self, piece: str) -> bytes:
        if m := _MARKED.match(piece):  # letters end a token, marks start the next
            return self[m[1]] + self[m[2]]
        if self.byte_level and len(lines := _FEEDS.split(piece)) > 1:  # a line feed between two other characters is a token
            return self["\n"].join(map(self.__getitem__, lines))
        if self.byte_level and _PLAIN.match(piece):
            return self._model(piece)
        if self.spaceless:
            low = piece.lower() if _PLAIN.match(piece) else piece
            if low != piece:
                return self[low]
            return self._model(piece) if _LOWER.match(piece) else self._ids(piece)
        return self._ids(piece)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; no special tokens are added to it."""
        text = text or ""
        if self.cut and len(parts := self.cut.split(text)) > 1:  # odd parts are added tokens
            return b"".join(self.added[x] if k % 2 else self._between(x) for k, x in enumerate(parts))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if (self.byte_level or self.spaceless) and _COMMON.match(text):
            pieces = _BYTE_PIECES.findall(text) if self.byte_level else _WORD_PIECES.findall(text.lower())
            return b"".join(map(self.common.__getitem__, pieces))
        if self.spaceless:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""
        if not self.byte_level:
            return self._ids(text)
        if not _BESIDE.search(text):
            return b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").split("\x00"))) if text else b""
        out, joined = [], None
        for part in text.split(" "):
            # a cut only between two characters that aren't white space
            if joined is None:
                joined = [part]
            elif part and joined[-1] and not part[0].isspace() and not joined[-1][-1].isspace():
                out.append(" ".join(joined))
                joined = ["", part]
            else:
                joined.append(part)
        out.append(" ".join(joined))
        return b"".join(map(self.__getitem__, out))


class Common(Young):
    """Maps a piece of a text of the common alphabet to its ids."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def make(self, piece: str) -> bytes:
        return self.owner._model(piece)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _made:
        _made[path] = Encoder(path, added=True)
    return _made[path]
