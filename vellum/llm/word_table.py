"""Ids of words, worked out by a tokenizer library once for each distinct word of a task.

A tokenizer that never merges across a cut gives a text the ids of its pieces one after another, so the library needs to
see each distinct piece once. `whole_words` says at which blanks a cut is such a cut.
"""

from __future__ import annotations

import array
import collections
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any definition that the libraries use (fixed values: Unicode White_Space and U+001C to U+001F).
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0  -     　"
#: A text in which some blank isn't between two other characters; RE2 syntax.
UNEVEN = f"^ | $|[{SPACES}] | [{SPACES}]"
#: Distinct words that a task keeps; later ones are worked out anew in each batch, so memory stays bounded.
MOST_WORDS = 700_000
#: Marks that every pre-tokenizer here parts from the letters before them; none of them begins a special token.
MARKS = ".,;:!?$%&*#"
#: Letters below this one have no other composed form and one lower-case letter.
LATIN = "\u0130"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTable:
    """Piece -> ids as bytes of 32-bit integers, filled by encode_many(list of pieces) -> list of id lists.

    lead is put before each piece. A piece that is letters and then MARKS has the ids of the letters and those of the
    marks, so the library sees words without their punctuation. encode_letters, if given, encodes lead and a word of
    letters by the library's model itself, past its splitting; fold maps letters to others with the same ids."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], lead: str = "", fold: Callable[[str], str] = str, encode_letters: Callable[[str], list[int]] | None = None, marks: str = MARKS):
        self.encode_many, self.lead, self.fold, self.encode_letters, self.marks = encode_many, lead, fold, encode_letters, marks
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(ids, dtype="<u4").tobytes() for ids in self.encode_many(pieces)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        letters = {w for w in words if self.encode_letters and w.isalpha() and max(w) < LATIN}
        rest = [w for w in words if w not in letters]
        out = dict(zip(rest, self._encoded([self.lead + w for w in rest]), strict=True))
        for w in letters:
            out[w] = array.array("I", self.encode_letters(self.lead + w)).tobytes()
        return out

    def get(self, words: list[str]) -> list[bytes]:
        parts = []
        for w in words:
            core = w.rstrip(self.marks) if self.marks else w
            # Beyond LATIN, lower case may end in a mark that the pre-tokenizer keeps with the one behind it.
            parts.append((self.fold(core), w[len(core) :]) if core.isalpha() and max(core) < LATIN else (w, ""))
        words_known, tails = self.words, self.tails
        if new := list({c for c, _ in parts if c not in words_known}):
            own = self._words(new)
            if len(words_known) + len(new) <= MOST_WORDS:
                words_known.update(own)
            else:
                words_known = collections.ChainMap(own, words_known)
        if new := list({t for _, t in parts if t not in tails}):
            own = dict(zip(new, self._encoded(new), strict=True))
            if len(tails) + len(new) <= MOST_WORDS:
                tails.update(own)
            else:
                tails = collections.ChainMap(own, tails)
        return [words_known[c] + tails[t] if t else words_known[c] for c, t in parts]

    def lengths(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Of an array of words: the place of each among the distinct ones, their numbers of ids, their ids end to end."""
        coded = words.dictionary_encode()
        ids = self.get(coded.dictionary.to_pylist())
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return coded.indices.to_numpy(), n, b"".join(ids)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[k] .. starts[k] + lengths[k] - 1 of all k, end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def split_blanks(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the pieces between blanks."""
    parts = pc.split_pattern(texts, " ")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    return parts.offsets.to_numpy().astype(np.int64), parts.values


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones; 64-bit offsets, so that no batch is too large."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each stretch of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
