"""Exact tokenisation of whole texts with a public byte-level vocabulary, for use inside Spark tasks.

A byte-level pre-token never runs across a space that follows a non-space, so a text may be cut before every such
space and its pieces encoded apart. Pieces repeat, so each task keeps the ids of those it has seen (a bounded number
of characters; the store is emptied when full). The ids themselves always come from the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Characters of pieces kept by a task before its store is emptied.
STORE_CHARS = 10_000_000

#: Marks that make a pre-token of their own after letters.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_space_before_space = re.compile(r"\s ")
_cut = re.compile(r"(?<=\S)(?= )")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte.

    Printable Latin-1 bytes stand for themselves; the others are numbered from 256 on in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], list[tuple[bytes, bytes]], dict[str, int]]:
    """Bytes of each id, the merges in order, and the added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    plain = lambda s: bytes(letters[c] for c in s)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = 1 + max([*spec["model"]["vocab"].values(), *added.values()])
    table = [b""] * size
    for token, k in spec["model"]["vocab"].items():
        if token not in added:
            table[k] = plain(token)
    for token, k in added.items():
        table[k] = token.encode()
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return table, [(plain(a), plain(b)) for a, b in pairs], added


@lru_cache(maxsize=4)
def tokenizer(path: str, all_plain: bool = False):
    """The library's tokenizer of a file, without truncation, padding or threads of its own.

    all_plain takes the strings of special tokens in a text as ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = all_plain
    return t


def pieces(text: str) -> list[str]:
    """The text cut before spaces that follow a non-space; every piece but the first lacks its leading space."""
    if _space_before_space.search(text):
        first, *rest = _cut.split(text)
        return [first, *(x[1:] for x in rest)]
    return text.split(" ")


class PieceStore(dict):
    """What encode() gives for lead + piece, by piece, kept for a bounded number of characters."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.chars = encode, lead, 0

    def __missing__(self, piece: str):
        if self.chars > STORE_CHARS:
            self.clear()
            self.chars = 0
        got = self[piece] = self.encode(self.lead + piece)
        self.chars += len(piece)
        return got


class PieceEncoder:
    """Looks up the pieces of texts in two stores: for those that begin a text, and for those after a space."""

    def __init__(self, encode):
        self.first, self.rest = PieceStore(encode, ""), PieceStore(encode, " ")

    def look_up(self, text: str | None) -> list:
        """What encode() gives for each piece of the text, in order; a null counts as empty."""
        cut = pieces(text or "")
        first = self.first[cut[0]]
        del cut[0]
        return [first, *map(self.rest.__getitem__, cut)]


class LibraryEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from the tokenizers library.

    New pieces go to the library's model by pre-tokens; pieces with an added token's string go to its encode(). Pieces of
    several lines are put together from those of each line.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.library = tokenizer(path)
        self.model = self.library.model.tokenize
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        self.space = chr(self.letters[32])
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.added = re.compile("|".join(map(re.escape, vocabulary(path)[2])) or r"(?!)").search
        self.marks = PieceStore(lambda x: array("I", [t.id for t in self.model(x)]).tobytes(), "")
        self.line_end = array("I", [self.model(self.lettered("\n"))[0].id]).tobytes()
        self.store = PieceEncoder(self._encode)

    def _encode(self, x: str) -> bytes:
        word = x[1:]
        if x[:1] == " " and word:
            if word.isalpha():  # with its space one pre-token, and never an added token
                ids = [t.id for t in self.model(self.space + (word if word.isascii() else self.lettered(word)))]
                return array("I", ids).tobytes()
            bare = word.rstrip(MARKS)
            if bare.isalpha():  # marks after letters are one pre-token
                return self.store.rest[bare] + self.marks[word[len(bare) :]]
            if "\n" in word and (lines := word.split("\n")) == x.split():  # a line end between others is a pre-token of its own
                head, *others = lines
                return self.line_end.join([self.store.rest[head], *map(self.store.first.__getitem__, others)])
        if self.added(x):
            ids = self.library.encode(x, add_special_tokens=False).ids
        else:
            ids = [t.id for y in self.split(x) for t in self.model(y if y.isascii() and y.isprintable() and " " not in y else self.lettered(y))]
        return array("I", ids).tobytes()

    def lettered(self, x: str) -> str:
        """The bytes of x, each as the letter that the vocabulary writes for it."""
        return x.encode().decode("latin-1").translate(self.letters)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(self.store.look_up(x)) for x in texts]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder for each task process, whatever number of tasks it runs."""
    return LibraryEncoder(path)
