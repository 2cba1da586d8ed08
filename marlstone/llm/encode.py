"""Token ids of whole texts by a public tokenizer, through its library."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from marlstone.llm import tokens

#: Characters on which all definitions of letters, digits, white space and lower case agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ſ"
UNSURE = re.compile(f"[^\x00-\x1b\x20-\x7f{LETTERS}]")
SEPARATORS = "\x1c\x1d\x1e\x1f"
# How the two tokenizers split a text before their merges.
SPACED = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+", re.A)
WORDS = re.compile(rf"[{LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LETTERS}0-9]+", re.A)
#: Units kept at once; with spaces and capitals there are more of them.
MOST = {True: 800_000, False: 400_000}
#: Characters of texts that are encoded together, and distinct splits that a process knows by hash (some 90 bytes each).
TOGETHER, MOST_SPLITS = 500_000, {True: 1_600_000, False: 800_000}
#: Classes of the bytes of texts without unsure characters: every byte beyond ASCII is of a letter.
LETTER, DIGIT, OTHER, BLANK = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASSES[48:58], CLASSES[[10, 31, 32]] = DIGIT, BLANK
#: The same for lower-cased texts whose white space is dropped.
WORD_CLASSES = CLASSES.copy()
WORD_CLASSES[9:14] = BLANK
WORD_END = "</w>"
VALUES = tokens.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * tokens.BASE)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Units(dict):
    """The number of each unit of text; a new one is cut into splits, and those are encoded by the library's model."""

    def __init__(self, model, find):
        super().__init__()
        self.tokenize, self.find, self.bytes = model.tokenize, find, byte_characters()
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def ids(self, split: str) -> list[int]:
        plain = split.isascii() and split.isprintable() and " " not in split  # such bytes stand for themselves
        return [t.id for t in self.tokenize(split if plain else split.encode().decode("latin-1").translate(self.bytes))]

    def __missing__(self, unit: str) -> int:
        splits = self.find(unit)
        if len(splits) == 1:
            ids = self.ids(unit)
        else:
            ids = []
            for at in map(self.__getitem__, splits):
                ids += self.flat[self.start[at] : self.start[at] + self.size[at]]
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        number = self[unit] = len(self)
        return number


ODD = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\v", "\f")


def odd(text: str) -> bool:
    """Whether a text has white space that splits otherwise than before a word and as line breaks."""
    return any(x in text for x in ODD) or text.endswith("\n\n")


def spaced_units(text: str) -> list[str] | None:
    """Words with the space before them, and line breaks, if a text has no white space that splits otherwise."""
    if odd(text):
        return None
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")


def spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of flat in a row."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def word_splits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where splits without white space begin and end in the bytes of lower-cased texts; each digit and 31 is one.

    What begins with an apostrophe and a letter stays with it, as with spaces.
    """
    kind = WORD_CLASSES[data]
    at = np.ones(len(data), bool)
    at[1:] = ((kind[1:] != kind[:-1]) & ~((data[:-1] == 39) & (kind[1:] == LETTER))) | (kind[1:] == DIGIT) | (data[1:] == 31)
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], len(data))
    words = (kind[starts] != BLANK) | (data[starts] == 31)
    return starts[words], ends[words]


def split_starts(data: np.ndarray) -> np.ndarray:
    """Where splits with the space before them begin in the bytes of texts that aren't odd; each line break and 31 is one.

    What begins with an apostrophe and a letter stays with it, so a span with an apostrophe may be several splits.
    """
    kind = CLASSES[data]
    at = np.ones(len(data), bool)
    at[1:] = ((kind[1:] != kind[:-1]) & (data[:-1] != 32) & ~((data[:-1] == 39) & (kind[1:] == LETTER))) | (kind[1:] == BLANK) | (kind[:-1] == BLANK) & (data[:-1] != 32)
    return np.flatnonzero(at)


class Splits:
    """The ids of splits by the hash of their bytes, in an open table that numpy looks many up in at once."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.mask = np.uint64((1 << (2 * most).bit_length()) - 1)
        self.key, self.number = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int32)
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        out, left, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(left):
            number, same = self.number[slot], self.key[slot] == hashes[left]
            out[left] = np.where(same, number, -1)
            on = (number >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Distinct hashes that are not there, each with size ids from its start in flat."""
        numbers, slot = np.arange(self.n, self.n + len(hashes)), (hashes & self.mask).astype(np.int64)
        self.n += len(hashes)
        self.start.frombytes((start + len(self.flat)).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.uint32).tobytes())
        while len(numbers):
            free = self.number[slot] < 0
            self.number[slot[free]] = numbers[free]
            won = free & (self.number[slot] == numbers)
            self.key[slot[won]] = hashes[won]
            numbers, hashes, slot = numbers[~won], hashes[~won], (slot[~won] + 1) & int(self.mask)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered splits in a row, and how many each has."""
        size = np.frombuffer(self.size, np.int64)[numbers]
        return spans(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64)[numbers], size), size


class Encoder:
    """Encodes texts by units that no split crosses, each distinct one once by the library's model.

    spaced: splits keep the white space before them; else texts are lower-cased and white space is dropped.
    Texts with characters on which definitions may differ go to the library whole. Special tokens' strings
    are ordinary text, or, with special, the tokens' ids, as the library has them: texts that may hold one go to
    the library whole, too. Beyond MOST units (some 200 bytes each) it starts anew.
    """

    def __init__(self, path: str, spaced: bool, most: int | None = None, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        # By what they begin with before the first letter, a text without them is passed over quickly.
        self.added, self.marks = added, sorted({re.match("[^a-z]*", t)[0] for t in added})
        self.spaced, self.most = spaced, most or MOST[spaced]
        self.find = (SPACED if spaced else WORDS).findall
        self.known = Units(self.tokenizer.model, self.find)

    def may_hold_added(self, text: str) -> bool:
        return any(m in text for m in self.marks) and any(t in text.lower() for t in self.added)

    def whole(self, text: str) -> bool:
        """Whether the library has to split the text."""
        return self.may_hold_added(text) or (any(c in text for c in SEPARATORS) if text.isascii() else bool(UNSURE.search(text)))

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.whole(text):
            return self.by_library(text)
        if len(self.known) > self.most:
            self.known = Units(self.tokenizer.model, self.find)
        known = self.known
        units = (spaced_units(text) or self.find(text)) if self.spaced else text.lower().split()
        if not units:
            return np.empty(0, np.uint32)
        at = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        size = np.frombuffer(known.size, np.int64)[at]
        ends = np.cumsum(size)
        begin = np.frombuffer(known.start, np.int64)[at] - (ends - size)
        return np.frombuffer(known.flat, np.uint32)[np.repeat(begin, size) + np.arange(ends[-1])]


class BatchEncoder(Encoder):
    """An encoder that takes many texts at once: their splits are cut, hashed and looked up by numpy.

    Distinct new splits go to the library's model in one call, behind a pre-tokenizer that only parts them. Ids are dealt
    to them by the bytes that a token stands for, and all ids are read back as bytes and compared with the texts, so that
    splits of one hash can't be confused: the texts are then encoded one by one, as are very long ones.
    """

    def __init__(self, path: str, spaced: bool, most: int | None = None, together: int = TOGETHER, special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, spaced, MOST[spaced] // 4, special)
        self.model, self.splits, self.together = Tokenizer(self.tokenizer.model), Splits(most or MOST_SPLITS[spaced]), together
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        characters = byte_characters()
        self.characters, byte_of = characters, {c: b for b, c in characters.items()}
        vocabulary = sorted((i, t) for t, i in self.tokenizer.get_vocab().items())
        plain = [t if spaced else t.removesuffix(WORD_END) for _, t in vocabulary]
        token = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else b"" for t in plain]
        self.length = np.zeros(vocabulary[-1][0] + 1, np.int64)
        self.length[[i for i, _ in vocabulary]] = [len(t) for t in token]
        self.first, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(token), np.uint8)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.together:
                yield from self._together(some)
                some, size = [], 0
        yield from self._together(some)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        apart = [not t or len(t) > 8 * self.together or (self.spaced and odd(t)) or self.whole(t) for t in texts]
        plain = [t for t, a in zip(texts, apart, strict=True) if not a]
        found = iter((self._plain(plain) or [self.encode(t) for t in plain]) if plain else [])
        return [self.encode(t) if a else next(found) for t, a in zip(texts, apart, strict=True)]

    def _plain(self, texts: list[str]) -> list[np.ndarray] | None:
        """None if the ids don't stand for the texts."""
        joined = "\x1f".join(texts) + "\x1f"
        data = np.frombuffer((joined if self.spaced else joined.lower()).encode(), np.uint8)
        if self.spaced:
            starts = split_starts(data)
            ends = np.append(starts[1:], len(data))
            dropped = data == 31
        else:
            starts, ends = word_splits(data)
            dropped = WORD_CLASSES[data] == BLANK
        last = np.flatnonzero(data[starts] == 31)
        hashes = tokens.span_hashes(data, starts, ends, VALUES)
        if self.splits.n + len(starts) > self.splits.most:
            self.splits = Splits(max(self.splits.most, len(starts)))
        numbers = self.splits.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            distinct, one = np.unique(hashes[new], return_index=True)
            if not self._learn(data, distinct, starts[new[one]], ends[new[one]]):
                return None
            numbers[new] = self.splits.find(hashes[new])
        ids, size = self.splits.ids(numbers)
        if not np.array_equal(spans(self.bytes, self.first[ids], self.length[ids]), data[~dropped]):
            return None
        bounds = np.concatenate([[0], np.cumsum(size)[last]])
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        quoted = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 39, out=quoted[1:])
        apart = (quoted[ends] > quoted[starts]) | (data[starts] == 31)
        for h, a, b in zip(hashes[apart], starts[apart], ends[apart], strict=True):
            text = data[a:b].tobytes().decode()
            ids = np.empty(0, np.uint32) if text == "\x1f" else self.by_library(text)
            self.splits.add(np.array([h]), ids, np.zeros(1, np.int64), np.array([len(ids)]))
        hashes, starts, size = hashes[~apart], starts[~apart], (ends - starts)[~apart]
        if not len(hashes):
            return True
        # The line break after each parts it from the next; one that is a split itself has its printable character.
        text = spans(data, starts, size).tobytes().decode("latin-1").translate(self.characters)
        stops = np.cumsum(size)
        joined = "\n".join([text[a:b] for a, b in zip((stops - size).tolist(), stops.tolist(), strict=True)])
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        place = np.concatenate([[0], np.cumsum(self.length[ids])])
        first, last = np.searchsorted(place, stops - size), np.searchsorted(place, stops)
        if place[-1] != stops[-1] or (place[first] != stops - size).any():
            return False
        self.splits.add(hashes, ids, first, last - first)
        return True


class SpacedEncoder(BatchEncoder):
    """Of splits with the space before them."""

    def __init__(self, path: str, most: int | None = None, together: int = TOGETHER, special: bool = False):
        super().__init__(path, True, most, together, special)


_encoders: dict[tuple[str, bool], BatchEncoder] = {}


def encoder(path: str, spaced: bool) -> BatchEncoder:
    """The process's encoder: what one task has learned serves the next."""
    if (path, spaced) not in _encoders:
        _encoders.clear()
        _encoders[path, spaced] = BatchEncoder(path, spaced, special=True)
    return _encoders[path, spaced]
