"""Token ids of texts, as the tokenizers library gives them, through caches.

A text is cut at white space; a piece that has been met before costs one look-up of
the bytes of its ids.  New pieces are cut into words by the tokenizer's own rule, and
words are encoded by the library's model, or by another encoder of words.
Texts with characters outside Latin script and common punctuation, or with special
tokens, take the library's own normaliser and splitter, so ids are the same for any
text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Cached pieces of a worker, about; beyond that the cache starts anew.
CACHED = 600_000
END = 1

_RANGE = [chr(i) for i in range(0x250)]
_LETTERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "N"))
#: For these characters normalisation but for case changes nothing, and str.split() cuts where the tokenizer does.
_OTHER = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]|<\|")
#: Where a stop or comma before white space does not end a letter's or number's word.
_JOINED = re.compile(rf"(?<![{_LETTERS}{_NUMBERS}])[.,](?=\s|\Z)")
_SPLIT = [(". ", " . "), (", ", " , "), (".\n", " .\n"), (",\n", " ,\n")]
#: The tokenizer's rule for words, for such characters.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is visible, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class LibraryWords:
    """Encodes a word with the library's model."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.characters = byte_characters()
        self.two = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def __call__(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else "".join([self.characters[b] for b in word.encode()])
        two = self.two
        return b"".join([two[t.id] for t in self.model.tokenize(shown)])


class Pieces(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, encode_word: Callable[[str], bytes]):
        self.encode_word = encode_word

    def __missing__(self, piece: str) -> bytes:
        words = _WORD.findall(piece)
        found = self.encode_word(words[0]) if len(words) == 1 else b"".join([self.encode_word(w) for w in words])
        self[piece] = found
        return found


class Encoder:
    """encode(texts): for each text the bytes of its ids, little-endian, two bytes an id."""

    def __init__(self, path: str, words: Callable[[object], Callable[[str], bytes]] = LibraryWords):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.encode_word = words(self.tokenizer)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Pieces(self.encode_word)

    def _whole(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(2, "little"))
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [self.encode_word(normal[a:b]) for _, (a, b) in splitter(self.tokenizer).pre_tokenize_str(normal)]
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Of a text that the tokenizer cuts as str.split() does; most pieces are words."""
        text = text.lower()
        if not _JOINED.search(text):
            for mark, apart in _SPLIT:
                text = text.replace(mark, apart)
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._whole(t) if _OTHER.search(t) else self._plain(t) for t in texts]


_ENCODERS: dict[tuple, Encoder] = {}


def shared_encoder(path: str, words=LibraryWords) -> Encoder:
    """The encoder of this Python worker: its tokenizer and what it has met serve all tasks."""
    if (path, words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


def splitter(tokenizer):
    """The tokenizer's first splitter, whose spans are those of words in the normalised text."""
    return tokenizer.pre_tokenizer[0] if hasattr(tokenizer.pre_tokenizer, "__getitem__") else tokenizer.pre_tokenizer


def in_batches(texts: list[str], characters: int = 1 << 20):
    """Slices of about so many characters, a text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= characters:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
