"""Token counts by overlap resynchronisation.

A huge text is cut into chunks that overlap. Each chunk is encoded with offsets; two neighbouring encodings are spliced
at the first place in their overlap where both start a token and which is proven stable: a single blank between two
characters that aren't white space. Every pre-tokenizer here starts a new piece at such a blank whatever stands before
it, and no merge crosses pieces, so from there on both encodings agree with that of the whole text. If an overlap has no
such place, it is widened, at last to the whole text. Counts before and after the splices add up to the exact count.

Texts that aren't huge are cut at all such blanks instead, and the library sees each distinct piece once a task
(`word_table`). The same places are stable for the same reason.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellum.llm.common import by_batch
from vellum.llm.word_table import MARKS, SPACES, UNEVEN, WordTable, byte_letters, filled, split_blanks, sums

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
STABLE = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


class Library:
    """A tokenizer file with its library's defaults: ids of many texts, and token starts (code points) of one."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: self.model.encode(texts, num_threads=1)
            self.starts = self._piece_starts
            #: This library puts a blank before a text by itself.
            self.lead, self.letters, self.marks = "", None, ""
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.many = lambda texts: [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            self.starts = lambda text: [a for a, _ in self.model.encode(text, add_special_tokens=False).offsets]
            self.lead, self.marks, shown, model = " ", MARKS, byte_letters(), self.model.model
            self.letters = lambda word: [t.id for t in model.tokenize(word if word.isascii() and word.isalpha() else "".join(shown[b] for b in word.encode()))]

    def _piece_starts(self, text: str) -> list[int]:
        return [p.begin for p in self.model.encode_as_immutable_proto(text).pieces]


def spliced_count(text: str, starts: Callable[[str], list[int]], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of text from encodings of chunks that overlap.

    The tokens of a chunk count from the splice before it up to the splice behind it. A splice is the first place in the
    overlap that is proven stable and starts a token in both chunks. Without one the overlap is widened; if it reaches both
    the last splice and the text's end, the chunk takes in the rest of the text."""
    total, cut, n = 0, 0, len(text)
    ahead = None  # where the chunk at hand begins, and its token starts
    for planned in range(chunk, n, chunk):
        wide = overlap
        while planned > cut:
            low, high, beyond = max(cut, planned - wide), min(n, planned + wide), min(n, planned + chunk + overlap)
            stable = np.array([m.start() for m in STABLE.finditer(text, low + 1, high - 1)], dtype=np.int64)
            if len(stable):
                if ahead is None or ahead[0] < high:
                    begin = 0 if ahead is None else ahead[2]
                    ahead = high, np.asarray(starts(text[begin:high]), dtype=np.int64) + begin, begin
                left, right = ahead[1], np.asarray(starts(text[low:beyond]), dtype=np.int64) + low
                common = np.intersect1d(np.intersect1d(left[left < high], right), stable)
                if len(common):
                    total += int(((left >= cut) & (left < common[0])).sum())
                    cut, ahead = int(common[0]), (beyond, right, low)
                    break
            if low == cut and high == n:
                break
            wide *= 4
    if ahead is None or ahead[0] < n:
        begin = 0 if ahead is None else ahead[2]
        ahead = n, np.asarray(starts(text[begin:]), dtype=np.int64) + begin, begin
    return total + int((ahead[1] >= cut).sum())


class Counter:
    def __init__(self, path: str, chunk: int, overlap: int):
        self.library, self.chunk, self.overlap = Library(path), chunk, overlap
        self.first = WordTable(self.library.many, encode_letters=self.library.letters, marks=self.library.marks)
        self.rest = WordTable(self.library.many, self.library.lead, encode_letters=self.library.letters, marks=self.library.marks)

    def _even(self, texts: pa.Array, begins: np.ndarray) -> np.ndarray:
        """Of texts that aren't uneven; begins: where the first piece has no blank before it."""
        offsets, words = split_blanks(texts)
        is_first = np.zeros(len(words), dtype=bool)
        is_first[offsets[:-1][begins]] = True
        per = np.empty(len(words), dtype=np.int64)
        for table, mask in ((self.first, is_first), (self.rest, ~is_first)):
            if mask.any():
                place, n, _ = table.lengths(words.filter(pa.array(mask)))
                per[mask] = n[place]
        return sums(per, offsets)

    def count(self, texts: pa.Array) -> np.ndarray:
        huge = pc.utf8_length(texts).to_numpy() > self.chunk
        parts, begins = texts.filter(pa.array(~huge)), np.ones(int((~huge).sum()), dtype=bool)
        n = np.zeros(len(parts), dtype=np.int64)
        uneven = pc.match_substring_regex(parts, UNEVEN).to_numpy(zero_copy_only=False)
        even = ~uneven & (pc.binary_length(parts).to_numpy() > 0)
        if even.any():
            n[even] = self._even(parts.filter(pa.array(even)), begins[even])
        for k in np.flatnonzero(uneven):
            head, *tail = STABLE.split(parts[k].as_py())
            n[k] = sum(map(len, (self.first if begins[k] else self.rest).get([head]))) // 4 + sum(map(len, self.rest.get(tail))) // 4
        out = np.empty(len(texts), dtype=np.int64)
        out[~huge] = n
        for k in np.flatnonzero(huge):
            out[k] = spliced_count(texts[k].as_py(), self.library.starts, self.chunk, self.overlap)
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text; other columns are left out).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an empty one. No
    shuffle: each row stays where it was read."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(counter: Counter, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = filled(batch.column(1))
        n = counter.count(texts)
        return pa.record_batch([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", make=lambda: Counter(path, chunk, overlap))
