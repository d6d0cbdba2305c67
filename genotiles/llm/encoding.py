"""Token ids of texts by a public byte-level tokenizer, with a bounded memory of words met before."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from genotiles.llm.tokens import run_hashes, text_bytes

#: Words of a generation, and length of words, that a worker remembers. Two generations of words after a blank and two of
#: words after a line end are some 50 MB.
_ENTRIES = 100_000
_LETTERS = 64
#: Words that a worker remembers as hashes and ids in arrays: some 40 MB.
_REMEMBERED = 1 << 20


#: Letters and marks of words that need no look at the tokenizer's pattern.
_PLAIN = "\u0250"
_MARKS = ".,;:!?"


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of a word after a blank (or after nothing), from the tokenizer when first met.

    Letters alone are one piece of the pattern, and a mark after them another, so such words go to the
    tokenizer's model without its pattern, offsets and settings. The pattern never joins a line end that stands alone to
    what is beside it, so words with line ends between other characters are put together from their parts.
    All others take the whole way. When a generation of words is full, those of it that are met again move to the next.
    """

    def __init__(self, tokenizer, blank: str = " "):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.blank = tokenizer, blank
        spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: spelling.pre_tokenize_str(chr(c))[0][0] for c in range(32, ord(_PLAIN))}
        self.marks = {m: tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
        self.line_end = array("I", tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.bare = _Words(tokenizer, "") if blank else self
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        known = self.before.get(word)
        if known is not None:
            return self._keep(word, known)
        if "\n" in word:
            parts = word.split("\n")
            if all(part and part.strip() == part for part in parts):
                return self.line_end.join([self[parts[0]], *(self.bare[part] for part in parts[1:])])
        mark = word[-1] in self.marks
        letters = word[:-1] if mark else word
        if letters.isalpha() and max(letters) < _PLAIN:
            found = [token.id for token in self.tokenizer.model.tokenize((self.blank + letters).translate(self.spelled))]
            if mark:
                found += self.marks[word[-1]]
        else:
            found = self.tokenizer.encode(self.blank + word, add_special_tokens=False).ids
        ids = array("I", found).tobytes()
        return self._keep(word, ids) if len(word) <= _LETTERS else ids

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= _ENTRIES:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class _Memory:
    """Ids of words met before, found by the words' 64-bit hashes; when it is full only the words of the last call stay."""

    def __init__(self, words: _Words):
        self.words = words
        self.hash, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, "<u4")

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: a table of ids, where each word's start in it, and how many they are."""
        data, starts = text_bytes(words)
        full = np.flatnonzero(np.diff(starts))
        h = run_hashes(data, starts[:-1][full], starts[1:][full])
        at = np.searchsorted(self.hash, h)
        known = np.append(self.hash, np.uint64(0))[at] == h
        known &= at < len(self.hash)
        old, new = at[known], full[~known]
        found = [self.words[word] for word in words.take(pa.array(new)).to_pylist()]
        size = np.zeros(len(words), np.int64)
        size[full[known]] = self.size[old]
        size[new] = [len(ids) // 4 for ids in found]
        order = np.concatenate([full[known], new])
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        table = np.concatenate([self._of(old), np.frombuffer(b"".join(found), "<u4")])
        if len(self.hash) + len(new) > _REMEMBERED:
            old = np.sort(old)
            self.hash, self.size, self.ids = self.hash[old], self.size[old], self._of(old)
            self.first = np.cumsum(self.size, dtype=np.int64) - self.size
        short = np.diff(starts)[new] <= _LETTERS
        self._add(h[~known][short], [ids for ids, use in zip(found, short, strict=True) if use])
        return table, first, size

    def _of(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        size = self.size[at].astype(np.int64)
        return self.ids[np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def _add(self, h: np.ndarray, found: list[bytes]) -> None:
        order = np.argsort(h, kind="stable")
        size = np.array([len(ids) // 4 for ids in found], np.int32)
        first = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        at = np.searchsorted(self.hash, h[order])
        self.hash, self.size = np.insert(self.hash, at, h[order]), np.insert(self.size, at, size[order])
        self.first = np.insert(self.first, at, first[order])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])


class Encoder:
    """Ids of whole texts.

    The tokenizer's pattern never joins letters across a blank, and a single blank belongs to the word after
    it. So a text whose blanks (U+0020) all stand alone between other characters is the sequence of its words, each
    with its blank, and a word's ids do not depend on its neighbours. Other texts go to the tokenizer whole.

    A special token's string in a text is that token, as the tokenizer's file has it; with ``special_as_text`` it is text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.path, self.special_as_text = path, special_as_text
        self.memory = _Memory(_Words(self.tokenizer))

    def __reduce__(self):
        # A tokenizer that travels forgets its settings; the other side reads the file.
        return Encoder, (self.path, self.special_as_text)

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, as the tokenizer gives them."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's start (one more entry than texts).

        Equal words of a batch are looked up once.
        """
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        start = split.offsets.to_numpy().astype(np.int64)
        first, start = start[:-1] - start[0], start - start[0]
        words = split.flatten().dictionary_encode()
        place = words.indices.to_numpy().astype(np.int64)
        table, at, size = self.memory.look_up(words.dictionary)
        # A first word has no blank before it, and a text with other blanks is one long word.
        odd = np.zeros(len(texts), dtype=bool)
        blank = words.dictionary.index("").as_py()
        if blank >= 0:
            odd[np.searchsorted(start, np.flatnonzero(place == blank), side="right") - 1] = True
            place[np.repeat(odd, np.diff(start))] = blank
        alone = [
            self.ids((texts[row] if odd[row] else words.dictionary[int(place[first[row]])]).as_py()) for row in range(len(texts))
        ]
        place[first] = len(size) + np.arange(len(texts))
        own = np.array([len(ids) for ids in alone], np.int64)
        at = np.concatenate([at, len(table) + np.cumsum(own) - own])
        table = np.concatenate([table, *alone])
        count = np.concatenate([size, own])[place]
        ends = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(at[place] - ends[:-1], count) + np.arange(ends[-1])
        return table[source], ends[start]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per worker, path and reading of special tokens."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]
