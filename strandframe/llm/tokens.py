"""Token ids as little-endian unsigned 32-bit bytes, by public tokenizers, with a bounded cache per worker.

Texts are cut only where the tokenizer surely begins a new word, so the ids of the cuts in turn are the ids of the
text. Each distinct cut is encoded once while it is in the cache; new ones are encoded together, in lines of many cuts
with a separator between them whose one id no cut can have.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from unicodedata import is_normalized

import numpy as np

from .common import CACHES

#: Cuts in each of the two generations of a worker's cache, by kind of tokenizer (that of words runs after other stages in
#: one worker, so it has less room), cuts in a line that is encoded, characters taken together.
CACHE, LINE, TOGETHER = {"byte": 700_000, "word": 400_000}, 50, 2_000_000
#: Before the string of a special token among cuts: no text has it.
SPECIAL = "\ud800"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """cut: a text's cuts. plain: whether a cut may be encoded between separators. one: whether a cut is surely one word of
    the tokenizer; such cuts are encoded by the same model without the search for words, split at ``split``."""

    def __init__(self, room: int, path: str, separator: str, cut: Callable[[str], list[str]], plain: Callable[[str], bool], one: Callable[[str], bool], split: tuple[str, str]):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # as in a plain call, the strings of special tokens in a text are those tokens; cuts, which may have become such
        # a string by lower case, are ordinary text
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.fixed = {SPECIAL + x: i.to_bytes(4, "little") for x, i in special.items()}
        self.tokenizer.encode_special_tokens = True
        self.room, self.separator, self.cut, self.plain = room, separator, cut, plain
        (self.between,) = self.ids(separator)
        self.forget()
        self.one = one
        self.simple = Tokenizer.from_file(path)
        self.simple.encode_special_tokens = True
        if self.simple.normalizer is not None:
            self.simple.normalizer = None
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(*split), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def forget(self) -> None:
        self.new: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}

    def cuts(self, text: str) -> list[str]:
        if not self.special.search(text):
            return self.cut(text)
        return [c for i, x in enumerate(self.special.split(text)) if x for c in ([SPECIAL + x] if i % 2 else self.cut(x))]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, missing: set[str], all_cuts: Callable[[], set[str]]) -> None:
        """Have ``missing`` in the cache, and forget what was not used for a generation."""
        if len(self.new) + len(missing) > self.room:
            self.old, self.new = self.new, dict(self.fixed)
            missing = all_cuts() - self.fixed.keys()
        if known := missing & self.old.keys():
            self.new |= {c: self.old[c] for c in known}
            missing = missing - known
        one, other, hard = [], [], []
        for c in missing:
            (one if self.one(c) else other if self.plain(c) else hard).append(c)
        for tokenizer, cuts in ((self.simple, one), (self.tokenizer, other)):
            lines = [self.separator.join(cuts[at: at + LINE]) for at in range(0, len(cuts), LINE)]
            for i, line in enumerate(tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                part = cuts[i * LINE: (i + 1) * LINE]
                ids = np.array(line.ids, dtype="<u4")
                ends = [*(4 * np.flatnonzero(ids == self.between)).tolist(), 4 * len(ids)]
                if len(ends) != len(part):
                    raise ValueError("a separator's id is in a cut")
                data, at = ids.tobytes(), 0
                for c, end in zip(part, ends, strict=True):
                    self.new[c] = data[at:end]
                    at = end + 4
        for c in hard:
            self.new[c] = np.array(self.ids(c), dtype="<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.cuts(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[list[str]]) -> Iterator[bytes]:
        found = [list(map(self.new.get, cuts)) for cuts in held]
        holes = [[i for i, x in enumerate(ids) if x is None] if None in ids else [] for ids in found]
        if any(holes):
            self.learn({cuts[i] for cuts, at in zip(held, holes, strict=True) for i in at}, lambda: set().union(*held))
        get = self.new.__getitem__
        for cuts, ids, at in zip(held, found, holes, strict=True):
            for i in at:
                ids[i] = get(cuts[i])
            yield b"".join(ids)


#: A comma or full stop after a letter and before a blank or the end is a word of its own to both tokenizers. A mark goes
#: before every one that a blank follows, then those go that no letter is before.
_ENDS = [(c + e, "\x00" + c + e) for c in ",." for e in " \n"]
_NOT_AFTER_LETTER = re.compile(r"\x00(?:(?<=[\W\d_]\x00)|(?<=^\x00))")
_MARKED = re.compile(r" ?\S+")
_CUT = re.compile(r"(?<=\S)(?= )")
_BLANKS = re.compile(r"\s ")


def _marked(text: str) -> str:
    """``text``, which has no zero character, with one before each comma or full stop that is a word of its own."""
    for end, marked in _ENDS:
        text = text.replace(end, marked)
    if text.endswith((",", ".")):
        text = text[:-1] + "\x00" + text[-1]
    return _NOT_AFTER_LETTER.sub("", text) if _NOT_AFTER_LETTER.search(text) else text


def _word_cuts(text: str) -> list[str]:
    if "Σ" not in text:  # else lower case depends on the place in a word
        text = text.lower()
    if "\x00" not in text:
        text = _marked(text).replace("\x00", " ")
    return text.replace("\n", " ").split(" ")


def _one_word(c: str) -> bool:
    return c.isalpha() and c.islower() and (c.isascii() or is_normalized("NFC", c))


def _byte_cuts(text: str) -> list[str]:
    if "\x00" in text:
        return _CUT.split(text)
    marked = _marked(text)
    if text.startswith(" ") or _BLANKS.search(text):
        return [y for x in _CUT.split(marked) for y in x.split("\x00")]
    return marked.replace(" ", "\x00 ").split("\x00")


_encoders: dict[tuple[str, str], Encoder] = {}


def word_encoder(path: str) -> Encoder:
    """For a tokenizer that lower-cases, drops white space and whose words never cross it."""
    if ("word", path) not in _encoders:
        _encoders["word", path] = Encoder(CACHE["word"], path, " 0 ", _word_cuts, lambda c: "0" not in c, _one_word, (" ", "removed"))
    return _encoders["word", path]


def byte_encoder(path: str) -> Encoder:
    """For a byte-level tokenizer whose words begin with at most one blank: cuts are before a blank that follows no blank."""
    if ("byte", path) not in _encoders:
        _encoders["byte", path] = Encoder(CACHE["byte"], path, "\n", _byte_cuts, lambda c: _MARKED.fullmatch(c) is not None, lambda c: c[c[:1] == " ":].isalpha(), ("\n", "isolated"))
    return _encoders["byte", path]


def forget() -> None:
    """Empty the caches of this worker."""
    for encoder in _encoders.values():
        encoder.forget()


CACHES["tokens"] = forget
