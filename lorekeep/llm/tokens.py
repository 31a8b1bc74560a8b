"""Exact and fast token ids from a public tokenizer file, for use inside tasks.

The tokenizers library spends most of its time on merging the same words again and again. Its pre-tokenizer cuts a text
into words that are encoded independently, so a worker keeps the ids of the words it has met and joins them; words it
has not met go to the library. Texts for which the cut is not trivially the library's own (characters from U+0250 on,
strings of special tokens, contractions) go to the library whole, and so do all texts if the file normalises or cuts texts
in another way than is known here. Either way the ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
Words are looked up by 64-bit hashes and then compared letter by letter; a text with a word that only shares a hash
goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Words kept by a worker (about 80 bytes each); when full, the table starts anew, so memory is bounded.
WORDS_KEPT = 600_000
#: Longer words are encoded, but not kept.
WORD_KEPT = 40
#: Characters handled at once. Longer texts are cut where white space is, which no word and no special token crosses.
CHARS_AT_ONCE = 400_000

# Fixed values of the tokenizer file: how it normalises and cuts texts, and what it makes of characters below U+0250.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
_WORD_ENDS = "</w>"
_BETWEEN = re.compile("[ \\n\\t\\r]")

_TOP = 0x250
_CHARS = [chr(i) for i in range(_TOP)]
_LOW = np.array([ord(c.lower()) if len(c.lower()) == 1 else 0 for c in _CHARS] + [0], dtype=np.uint16)
_KIND = np.array([0 if c.isspace() else 1 if re.match(f"[{_LETTERS}]", c) else 2 if re.match(f"[{_NUMBERS}]", c) else 3 for c in _CHARS] + [3], dtype=np.uint8)
_STRANGE = np.array([not 0 < ord(c.lower()[0]) < _TOP or len(c.lower()) > 1 or 0x1C <= ord(c) <= 0x1F for c in _CHARS] + [True])
_AFTER_MARK = np.array([c in "strvmld" for c in _CHARS] + [False])
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(1, 2**63, _TOP + 1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


class WordTable:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cuts = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cut = cuts[0].get("pattern", {}).get("Regex") == _SPLIT and len(cuts) == 2 and cuts[1].get("use_regex") is False
        self.cut &= (said["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith(_WORD_ENDS) for i in range(size)])
        self.powers = self.backs = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros((0, 4), dtype=np.int64)  # of each key: where its ids start in flat, how many; the same of its letters
        self.flat = np.zeros(0, dtype="<u4")
        self.letters = np.zeros(0, dtype=np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in one call, parted by spaces: their ids, and how many of them each has, by the tokens that end words."""
        ids = self.whole(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            return ids, np.diff(stops, prepend=0)
        each = [self.whole(w) for w in words]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """keys: sorted, none of them known yet."""
        ids, counts = self.encode(words)
        starts = len(self.flat) + np.cumsum(counts) - counts
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.rows = np.insert(self.rows, at, np.stack([starts, counts, len(self.letters) + np.cumsum(sizes) - sizes, sizes], 1), axis=0)
        self.flat = np.concatenate([self.flat, ids])
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)])

    def unlike(self, low: np.ndarray, starts: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words, stretches of low, aren't letter by letter those of their rows."""
        other = sizes != rows[:, 3]
        sizes = np.where(other, 0, sizes)
        before = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum())
        differ = low[np.repeat(starts - before, sizes) + place] != self.letters[np.repeat(rows[:, 2] - before, sizes) + place]
        if differ.any():
            other[np.repeat(np.arange(len(sizes)), sizes)[differ]] = True
        return np.flatnonzero(other)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, CHARS_AT_ONCE + 1000)
            step = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.powers, self.backs = step(_BASE), step(_BACK)

    def cut_up(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that are of at most CHARS_AT_ONCE together, or a single one."""
        joined = "\n".join(texts)
        units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        if len(units) != len(joined):  # characters beyond U+FFFF; keep places equal
            units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        units = np.minimum(units, _TOP).astype(np.uint16)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        low, kind = _LOW[units], _KIND[units]
        odd = _STRANGE[units]
        odd[:-1] |= (units[:-1] == 60) & (units[1:] == 124)  # <|
        odd[:-1] |= (units[:-1] == 39) & _AFTER_MARK[low[1:]]
        own = np.zeros(len(texts), dtype=bool)
        own[np.searchsorted(begins, np.flatnonzero(odd), side="right") - 1] = True
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        after = np.concatenate([kind[1:], np.zeros(1, np.uint8)])
        starts = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 2)))
        stops = np.flatnonzero((kind > 0) & ((kind != after) | (kind == 2))) + 1
        sizes = stops - starts
        self.grow(len(units) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[low] * self.powers[: len(low)])])
        hashes = (sums[stops] - sums[starts]) * self.backs[starts]
        hashes ^= (hashes >> np.uint64(29)) + sizes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        long = sizes > WORD_KEPT
        if long.any():
            for i in np.unique(np.searchsorted(begins, starts[long], side="right") - 1):
                own[i] = True
        of = np.searchsorted(starts, begins)  # a text's first word
        if own.any():
            keep = ~np.repeat(own, np.diff(of))
            hashes, starts, stops = hashes[keep], starts[keep], stops[keep]
            of = np.searchsorted(starts, begins)
        unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > WORDS_KEPT:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), dtype=bool)
        if new.any():
            text = low.tobytes().decode("utf-16-le", "surrogatepass")
            self.learn(unique[new], [text[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
        rows = self.rows[np.searchsorted(self.keys, unique)[place]] if len(unique) else np.zeros((0, 4), np.int64)
        own[np.searchsorted(of, self.unlike(low, starts, rows, stops - starts), side="right") - 1] = True
        ends = np.cumsum(rows[:, 1])
        ids = self.flat[np.repeat(rows[:, 0] - (ends - rows[:, 1]), rows[:, 1]) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[of].tolist()
        return [self.whole(x) if own[i] else ids[edges[i] : edges[i + 1]] for i, x in enumerate(texts)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids (little-endian, 32 bits) of each whole text in turn; none for a null or empty text."""
        if not self.cut:
            yield from (self.whole(x or "") for x in texts)
            return
        held: list[str] = []
        chars = 0
        for x in texts:
            if held and chars + len(x or "") > CHARS_AT_ONCE:
                yield from self.cut_up(held)
                held, chars = [], 0
            if len(x or "") > CHARS_AT_ONCE:
                yield np.concatenate([ids for part in _stretches(x) for ids in self.cut_up([part])])
                continue
            held.append(x or "")
            chars += len(x or "") + 1
        if held:
            yield from self.cut_up(held)


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        space = _BETWEEN.search(text, at + CHARS_AT_ONCE)
        stop = space.start() if space else len(text)
        yield text[at:stop]
        at = stop


_TABLES: dict[str, WordTable] = {}


def table(path: str) -> WordTable:
    """The worker's table for a tokenizer file; workers live longer than tasks and keep it."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
