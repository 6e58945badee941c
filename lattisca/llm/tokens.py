"""Whole texts to token ids, with the ids of recurring pieces kept as bytes."""

from __future__ import annotations

from array import array

from lattisca.llm.common import hold

#: Pieces whose ids a worker keeps, and as many of the time before. Speed only: the ids are the same.
KEPT_PIECES = 400_000


#: How byte-level vocabularies write bytes: printable ones as they are, the others as characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip(_PLAIN, _PLAIN, strict=True)) | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class TextEncoder:
    """Ids of texts by the tokenizers library, as bytes of little-endian unsigned 32-bit integers.

    A text is cut where the tokenizer's own pre-tokenization always cuts: before a single space, and on both sides of a
    single line end, that stand between other characters. A text with any other white space is encoded as one.
    A piece of letters alone is one pre-token and goes to the tokenizer's model; others go to the whole tokenizer.
    ``spaced`` tells that a space belongs to the word after it (byte-level vocabularies); otherwise white space is dropped.
    A mark like ``<|endoftext|>`` in a text gets the id that the library gives it; with ``plain_marks`` it is text.
    """

    def __init__(self, path: str, spaced: bool, plain_marks: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_marks
        # Marks are looked for before a text is cut, and may stand inside of what would be a piece.
        self.found_whole = [] if plain_marks else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.tokenize, self.normalizer = self.tokenizer.model.tokenize, self.tokenizer.normalizer
        self.line_end = self._whole("\n") if spaced else b""
        # Pieces that begin a line, and pieces after a space; None: the text must be encoded as one. Older ones are kept
        # for another while, so that common pieces stay.
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.older: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.marks = {m: self._whole(m) for m in ".,"}

    def _letters(self, word: str, before: str) -> bytes | None:
        """The ids of a word of letters alone; None if it is not one."""
        if self.normalizer is not None:
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
        if not word.isalpha():
            return None
        written = before + word if word.isascii() else before + word.encode().decode("latin-1").translate(_WRITTEN)
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def _learn(self, kept: dict[str, bytes | None], old: dict[str, bytes | None], pieces: set[str], before: str) -> None:
        mark = "\u0120" if before else ""
        for piece in pieces.difference(kept):
            if piece in old:
                kept[piece] = old[piece]
                continue
            ids = None
            if piece.isalpha():
                ids = self._letters(piece, mark)
            elif piece[-1:] in self.marks and piece[:-1].isalpha():
                word = piece[:-1]
                ids = kept.get(word)
                if ids is None:
                    ids = kept[word] = self._letters(word, mark)
                if ids is not None:
                    ids += self.marks[piece[-1]]
                else:
                    del kept[word]
            if ids is None and piece.split() == [piece]:
                ids = self._whole(before + piece)
            kept[piece] = ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        if len(self.first) + len(self.later) > KEPT_PIECES:
            self.older, self.first, self.later = (self.first, self.later), {}, {}
        cut: list[list[list[str]] | None] = []
        heads: set[str] = set()
        rest: set[str] = set()
        for text in texts:
            if not text or any(mark in text for mark in self.found_whole):
                cut.append(None)
                continue
            lines = [line.split(" ") for line in text.split("\n")]
            for words in lines:
                heads.add(words[0])
                rest.update(words[1:])
            cut.append(lines)
        self._learn(self.first, self.older[0], heads, "")
        self._learn(self.later, self.older[1], rest, " " if self.spaced else "")
        out, first, later = [], self.first, self.later
        for text, lines in zip(texts, cut, strict=True):
            if lines is None:
                out.append(self._whole(text) if text else b"")
                continue
            try:
                out.append(self.line_end.join([first[w[0]] + b"".join([later[x] for x in w[1:]]) for w in lines]))
            except TypeError:  # a piece is None
                out.append(self._whole(text))
        return out


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, spaced: bool) -> TextEncoder:
    """One per worker process."""
    hold("tokens", _ENCODERS.clear)
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = TextEncoder(path, spaced)
    return _ENCODERS[path, spaced]
