"""Token ids by a public tokenizer, through a cache of space-delimited pieces.

Both pre-tokenizers used here never join what stands on two sides of a single space followed
by a non-space: the byte-level one starts a token at that space, the word-level one drops it.
So the ids of a text are those of its pieces in a row, and equal pieces are encoded once.

A special mark in a text (such as <|endoftext|>) gets its special id, as by the library with its
defaults: the text is cut at the marks first, and what lies between is encoded by itself.
"""

from __future__ import annotations

import re
import struct

#: A space after other white space: there the plain split at spaces could cut a run of white
#: space in the wrong place.
_HARD = tuple(f"{c} " for c in map(chr, range(0x3001)) if c.isspace())
_HARD_ASCII = tuple(x for x in _HARD if x.isascii())
_SAFE_CUT = re.compile(r"(?= \S)")
#: ASCII marks that form one pre-token with their like (no apostrophe, which starts contractions).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies have for each byte: itself where it
    is printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


_PACK = [struct.Struct(f"<{k}I").pack for k in range(17)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < 17 else struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids by piece; a new piece is encoded, with `lead` before it, when it is first asked for. What
    isn't asked for between two turns is forgotten."""

    def __init__(self, learn, lead: str):
        self.learn, self.lead = learn, lead
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece, self.lead, self)
        self[piece] = ids
        return ids

    def turn(self) -> None:
        self.old = self.copy()
        self.clear()


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of whole texts. `limit` bounds the cached pieces."""

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {mark: packed([k]) for mark, k in special.items()}
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: Cuts that leave the space before a mark with what precedes it.
        self.safe_cut = re.compile(r"(?= (?!" + "|".join(map(re.escape, special)) + r")\S)") if special else _SAFE_CUT
        self.spaced = '"</w>"' not in str(self.tokenizer.model)[:400]
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.limit = limit
        self.first = _Pieces(self._learn, "")
        self.rest = _Pieces(self._learn, " ") if self.spaced else self.first
        self.marks = _Pieces(lambda piece, lead, cache: self._ids(piece), "")
        self.newline = self._ids("\n") if self.spaced else b""
        self.first[""] = b""

    def _ids(self, word: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model alone."""
        return packed([t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def _learn(self, piece: str, lead: str, cache: _Pieces) -> bytes:
        stem = piece.rstrip(_MARKS)
        # Letters below U+0250 are one pre-token, and lower-casing them needs no context.
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250") and (self.spaced or stem.lower().isalpha()):
            if len(stem) < len(piece):
                return cache[stem] + self.marks[piece[len(stem) :]]
            return self._ids(lead + stem if self.spaced else stem.lower())
        if "\n" in piece and self.spaced and piece.split() == (lines := piece.split("\n")):
            # A single line end between non-spaces is a pre-token; the next has no space before it.
            return self.newline.join([cache[lines[0]], *(self.first[x] for x in lines[1:])])
        return packed(self.tokenizer.encode(lead + piece, add_special_tokens=False).ids)

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without the space before them."""
        return self.cut(text) if self.spaced else ("", text.replace("\n", " ").split(" "))

    def cut(self, text: str) -> tuple[str, list[str]]:
        """As pieces(), for either tokenizer without changing a character."""
        if text.endswith(" ") or any(run in text for run in (_HARD_ASCII if text.isascii() else _HARD)):
            head, *tail = self.safe_cut.split(text)
            return head, [p[1:] for p in tail]
        head, *tail = text.split(" ")
        return head, tail

    def lookup(self, head: str, tail: list[str]) -> list[bytes]:
        """The ids of each piece, the first included."""
        caches = (self.first, self.marks) if self.rest is self.first else (self.first, self.rest, self.marks)
        if sum(map(len, caches)) > self.limit // 2:
            for cache in caches:
                cache.turn()
            self.first[""] = b""
        return [self.first[head], *map(self.rest.__getitem__, tail)]

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.special):
            return b"".join(self.special.get(x) or b"".join(self.lookup(*self.pieces(x))) for x in self.at_marks.split(text))
        return b"".join(self.lookup(*self.pieces(text)))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, limit: int = 800_000) -> PieceEncoder:
    """One encoder for each file and worker process, with the largest limit asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, limit)
    _ENCODERS[path].limit = max(_ENCODERS[path].limit, limit)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def largest_id(path: str) -> int:
    """The largest id that a tokenizer gives, special ones too."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
