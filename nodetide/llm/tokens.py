"""Token ids of whole texts with the tokenizers library, piece by piece with a bounded cache.

The ids are those of the library for the whole text, without the tokens it would add around it; strings of special tokens
in a text become their ids, as the library has it. A byte-level vocabulary never merges across the border between a character
and white space after it, so a text is cut there and equal pieces are encoded once, and no long text is handed over at once.
Vocabularies of another build, and texts with tokens that look beyond their own string, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core

#: Pieces remembered by a worker (about 200 bytes each), and the longest that is.
CACHED, CACHED_LENGTH = 1_000_000, 48
#: Characters encoded at a time.
SLICE = 1 << 19

PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
ODD_SPACE = re.compile(r"\s (?:\s|\Z)")
BORDER = re.compile(r"(?<=\S)(?=[ \n])")
#: Signs at a piece's end; after a letter they are merged among themselves only. The apostrophe is none: it begins endings.
SIGNS = re.compile(r"[!-&(-/:-@\[-`{-~]+\Z")


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as they are and the others as the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


ALPHABET = _alphabet()


def _parts(text: str) -> list[str]:
    """A piece cut where the vocabulary cannot merge: before white space, after a lone line break, between a letter and signs."""
    parts = []
    for piece in [text] if OTHER_SPACE.search(text) else PLAIN.findall(text):
        if piece[0] == "\n" and piece[1:2].strip():
            parts.append("\n")
            piece = piece[1:]
        signs = SIGNS.search(piece)
        if signs and signs.start() and piece[signs.start() - 1].isalpha():
            parts.append(piece[:signs.start()])
            piece = signs[0]
        parts.append(piece)
    return parts


class _Known(dict):
    """Ids of pieces that stand after `lead`; new ones are put together from words, signs and line breaks, which recur more often."""

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.merge, self.lead = tokenizer, tokenizer.model.tokenize, lead
        self.bare = self.spaced = self

    def __missing__(self, piece: str) -> bytes:
        whole = self.lead + piece
        if piece.isalpha():  # one word, with or without its blank: nothing to cut before the merges
            ids = [t.id for t in self.merge(whole.encode().decode("latin-1").translate(ALPHABET))]
            data = struct.pack(f"<{len(ids)}I", *ids)
        elif len(parts := _parts(whole)) > 1:
            data = b"".join([self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in parts])
        else:
            ids = self.tokenizer.encode(whole, add_special_tokens=False).ids
            data = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = data
        return data


def _cuttable(tokenizer) -> bool:
    """Whether a vocabulary is built so that texts may be cut before white space: byte-level BPE on the texts as they are."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    pre, model = tokenizer.pre_tokenizer, tokenizer.model
    return (
        tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and isinstance(model, BPE)
        and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix and not model.ignore_merges
        and tokenizer.truncation is None and tokenizer.padding is None)


class Encoder:
    """Encodes texts by the vocabulary file `path`; ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        self.tokenizer, self.cuttable = tokenizer, _cuttable(tokenizer)
        self.whole = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word]
        self.alone = {t.content: struct.pack("<I", i) for i, t in added.items()}
        longest_first = sorted(self.alone, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.bare, self.spaced = _Known(tokenizer, ""), _Known(tokenizer, " ")
        self.bare.spaced, self.spaced.bare = self.spaced, self.bare

    def _slices(self, text: str) -> Iterator[str]:
        """The text in slices that end before white space which follows another character."""
        at = 0
        while len(text) - at > SLICE:
            border = BORDER.search(text, at + SLICE)
            if not border:
                break
            yield text[at:border.start()]
            at = border.start()
        yield text[at:]

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.cuttable or any(t in text for t in self.whole):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not self.marks or not self.marks.search(text):
            return self._between(text)
        return b"".join([self.alone[part] if i % 2 else self._between(part) for i, part in enumerate(self.marks.split(text)) if part])

    def _between(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        out = []
        for part in self._slices(text):
            if ODD_SPACE.search(part):
                out += [self.bare[p] for p in BORDER.split(part)]
            else:  # every blank is the first or the last of its run of white space: cuts there change nothing
                first, *rest = part.split(" ")
                out.append(self.bare[first])
                out.append(b"".join(map(self.spaced.__getitem__, rest)))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
