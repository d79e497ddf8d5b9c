"""Token ids of whole texts, cached by blank-separated chunk.

Byte-level pre-tokenisers never join what stands before a single blank with what
follows it, so the ids of a text are the ids of its chunks in order, each chunk
taken with its leading blank.  That fails only where a blank follows other white
space (a run may then be one token); such texts are encoded in one call.
Word vocabularies with word ends drop white space, so it always holds for them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable


#: Chunks of a generation; a full one becomes the old one, and the old one goes (bounded memory per worker).
CACHE_CHUNKS = 250_000
#: Longer chunks are rare and seldom come again; they are not kept.
CACHE_CHARS = 256
PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def as_bytes(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


#: Marks that end a run of letters; an apostrophe may start a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkCache(dict):
    """chunk → its ids as little-endian unsigned 32-bit bytes; None: white space at its end.

    Letters followed by marks, or by one line feed and more, are always separate
    pre-tokens, so those chunks are put together from cached parts.
    """

    def __init__(self, encode: Callable[[str], bytes], blank: str, heads: "ChunkCache | None" = None):
        self.encode, self.blank, self.old, self.marks = encode, blank, {}, {}
        self.heads = self if heads is None else heads  # for what follows a line feed
        self.feed = encode("\n")

    def __missing__(self, chunk: str):
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.encode(self.blank + chunk)
            else:
                head, feed, tail = chunk.partition("\n")
                if "\n" in tail and not tail[-1].isspace():
                    return self.lines(chunk)
                if feed and head and tail and not head[-1].isspace() and not tail[0].isspace() and not tail[-1].isspace():
                    return self[head] + self.feed + self.heads[tail]
                ids = self.made(chunk)
        return self.kept(chunk, ids)

    def kept(self, chunk: str, ids):
        if len(chunk) > CACHE_CHARS:
            return ids
        if len(self) > CACHE_CHUNKS:
            self.old = self.copy()
            self.clear()
        self[chunk] = ids
        return ids

    def lines(self, chunk: str) -> bytes:
        """Ids of a chunk cut at its line feeds between other characters than white space."""
        parts, at, cut = [], 0, chunk.find("\n")
        while cut >= 0:
            if cut > at and not chunk[cut - 1].isspace() and not chunk[cut + 1].isspace():
                parts.append((self.heads if parts else self)[chunk[at:cut]])
                at = cut + 1
            cut = chunk.find("\n", cut + 1)
        if not parts:
            return self.kept(chunk, self.made(chunk))
        parts.append(self.heads[chunk[at:]])
        return self.feed.join(parts)

    def made(self, chunk: str):
        if self.blank and (not chunk or chunk[-1].isspace()):
            return None
        word = chunk.rstrip(MARKS)
        if 0 < len(chunk) - len(word) <= CACHE_CHARS and word[-1:].isalpha() and word[-1] != "İ":  # its small form ends in a mark of its own
            marks = chunk[len(word):]
            if marks not in self.marks:
                if len(self.marks) > CACHE_CHUNKS // 8:
                    self.marks.clear()
                self.marks[marks] = self.encode(marks)
            return self[word] + self.marks[marks]
        return self.encode(self.blank + chunk)


class TextEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, whole: Callable[[str], bytes], chunk: Callable[[str], bytes], keeps_blanks: bool, undivided: tuple[str, ...] = ()):
        self.whole = whole
        self.undivided = undivided  # a text that holds one of these is encoded in one call
        self.first = ChunkCache(chunk, "")
        self.rest = ChunkCache(chunk, " ", self.first) if keeps_blanks else self.first
        self.keeps_blanks = keeps_blanks

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        for s in self.undivided:
            if s in text:
                return self.whole(text)
        first, *rest = text.split(" ")
        if self.keeps_blanks and (not first or first[-1].isspace()):
            return self.whole(text)
        try:
            return self.first[first] + b"".join(map(self.rest.__getitem__, rest))
        except TypeError:  # a chunk is None
            return self.whole(text)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte 0 to 255.

    Printable Latin-1 bytes stand for themselves, the others for the code points
    from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def library_encoder(vocab_path: str, added_tokens: bool = False) -> TextEncoder:
    """Encoder of a tokenizers JSON file, loaded once per worker process.

    ``added_tokens``: the strings of added tokens (``<|endoftext|>``) get their own ids, as
    by the library's default; else they are ordinary text.

    A chunk of letters alone is one pre-token, so the library's BPE model takes it
    directly; everything else goes through the library's whole chain.
    """
    if (vocab_path, added_tokens) in _encoders:
        return _encoders[vocab_path, added_tokens]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import unicodedata

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path)
    t.encode_special_tokens = not added_tokens
    undivided = tuple(a.content for a in t.get_added_tokens_decoder().values()) if added_tokens else ()
    keeps = t.encode(" ", add_special_tokens=False).ids != []
    model, letters = t.model, {i: c for i, c in enumerate(byte_letters())}

    tokenize = model.tokenize

    def encode(s: str) -> bytes:
        return as_bytes(t.encode(s, add_special_tokens=False).ids)

    def blank_chunk(s: str) -> bytes:
        word = s[1:] if s[:1] == " " else s
        if not word.isalpha():
            return encode(s)
        # ASCII letters are written as themselves, a blank as its byte's letter
        piece = s.replace(" ", letters[32]) if s.isascii() else s.encode().decode("latin-1").translate(letters)
        return as_bytes([x.id for x in tokenize(piece)])

    def word_chunk(s: str) -> bytes:
        if not s.isalpha():
            return encode(s)
        piece = s.lower()
        if not piece.isascii():  # these vocabularies normalise and lower each letter by itself
            if "Σ" in s or not unicodedata.is_normalized("NFC", s) or not piece.isalpha():
                return encode(s)
            piece = piece.encode().decode("latin-1").translate(letters)
        return as_bytes([x.id for x in tokenize(piece)])

    chunk = blank_chunk if keeps else word_chunk
    _encoders[vocab_path, added_tokens] = TextEncoder(encode, chunk, keeps, undivided)
    return _encoders[vocab_path, added_tokens]
