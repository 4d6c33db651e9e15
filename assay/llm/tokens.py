"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text up to `chunk_chars` is counted at once. A longer one is encoded in overlapping chunks with
offsets, and neighbouring chunks are spliced at a boundary that both found.

Why a splice is exact: the byte-level pre-tokenizer reads left to right, and a match depends only on
the text from its start (plus one character after a run of white space). So once two chunks agree on
one pre-token boundary, everything after it is the same in the later chunk as in the whole text. The
earlier chunk is right up to `margin` characters before its end, which is longer than a special token
and the one character looked ahead. BPE merges never cross pre-tokens. Where the overlap holds no
common boundary (one word longer than the overlap), the overlap is doubled, at last to the whole text
so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import sliced

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
MARGIN = 64
# Words remembered per worker; the memory is emptied when full, which changes no count.
CACHED_WORDS = 1_000_000
UNKNOWN = -(1 << 60)


class Counter:
    """Counts tokens as `tokenizers` gives them, without added special tokens."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A special token that holds white space would cross the words that `count_short` cuts at.
        self.splits_at_spaces = not any(re.search(r"\s", s) for s in specials)
        self.chunk, self.overlap = chunk, overlap
        self.margin = max([margin, *(len(s) + 2 for s in specials)])
        self.marks = {mark: self.count_plain(mark) for mark in ".,"}
        self.known: dict[str, int] = {}

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count_plain(self, text: str) -> int:
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    def count_short(self, texts: list[str]) -> list[int]:
        """Counts of texts by the counts of their words.

        A single space or line feed between two characters that are no white space always starts a
        pre-token, so a text is cut there and each piece, that character included, is counted once
        and remembered. A text with other white space beside these is counted as a whole.
        """
        if not self.splits_at_spaces:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        get, out, missing = self.known.get, [], []
        for text in texts:
            first, *words = text.replace("\n", " \n").split(" ")
            counts = list(map(get, words))
            absent = [w for w, n in zip(words, counts) if n is None] if None in counts else []
            missing.append((first, absent))
            out.append(sum(filter(None, counts)))
        self._learn({word for _, absent in missing for word in absent})
        for n, (first, absent) in enumerate(missing):
            out[n] += sum(map(get, absent))
            if out[n] < 0 or first[-1:].isspace() or (not first and texts[n]):
                out[n] = self.count_plain(texts[n])
            elif first:
                out[n] += self.count_plain(first)
        return out

    def _learn(self, words: set[str]) -> None:
        """Count the pieces that are not known yet. A piece stands for itself after a space, or as
        it is where it begins with a line feed; one beside other white space gets a count that turns
        every sum negative."""
        plain, marked = [], {}
        for word in words:
            inner = word[1:] if word[:1] == "\n" else word
            if not inner or inner[0].isspace() or inner[-1].isspace():
                self.known[word] = UNKNOWN
            elif inner[-1] in self.marks and inner[-2:-1].isalpha() and inner.isascii():
                marked[word] = word[:-1]  # the mark is a pre-token of its own
                plain.append(word[:-1])
            else:
                plain.append(word)
        plain = [w for w in dict.fromkeys(plain) if w not in self.known]
        encoded = self.tokenizer.encode_batch_fast(
            [w if w[0] == "\n" else " " + w for w in plain], add_special_tokens=False
        )
        self.known.update(zip(plain, map(len, encoded)))
        self.known.update({word: self.known[base] + self.marks[word[-1]] for word, base in marked.items()})

    def _boundaries(self, text: str, start: int) -> dict[int, int]:
        """Pre-token boundaries of a chunk, as places in the whole text → tokens before them.

        A place inside a word with no token boundary of its own is left out, and so is the start.
        """
        encoding = self._encode(text)
        # Pieces of one split (between special tokens) number their words anew, so a change of the
        # word or of the kind marks a boundary; a boundary must also not lie within a character.
        out, before, last_end = {}, None, 0
        specials = encoding.special_tokens_mask
        for n, (word, special, (begin, end)) in enumerate(zip(encoding.word_ids, specials, encoding.offsets)):
            mark = (word, special)
            if before is not None and mark != before and begin >= last_end:
                out[start + begin] = n
            before, last_end = mark, end
        out[start + len(text)] = len(encoding.ids)
        return out

    def count_long(self, text: str) -> int:
        """Tokens of a text in chunks; equal to encoding it whole."""
        if len(text) <= self.chunk:
            return self.count_plain(text)
        total, begin, end = 0, 0, self.chunk
        left, at, used = self._boundaries(text[:end], 0), 0, 0
        # Invariant: `left` is exact from `at` (where it has counted `used` tokens) to its end less margin.
        while end < len(text):
            overlap, step = self.overlap, self.chunk
            while True:
                start = max(at, end - overlap)
                stop = min(len(text), max(start + step, end + 1))
                right = self._boundaries(text[start:stop], start)
                if start == at:  # as wide as what is exact: the new chunk replaces the old one
                    left, used = right, 0
                    break
                common = [p for p in left if start < p <= end - self.margin and p > at and p in right]
                if common:
                    splice = max(common)
                    total += left[splice] - used
                    left, at, used = right, splice, right[splice]
                    break
                overlap *= 2
                step = max(step, overlap * 2)
            end = stop
        return total + left[len(text)] - used

    def count(self, texts: list[str]) -> list[int]:
        short = iter(self.count_short([t for t in texts if len(t) <= self.chunk]))
        return [next(short) if len(t) <= self.chunk else self.count_long(t) for t in texts]


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512,
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """`key`, `n_bytes`, `n_tokens`, `over_limit` of every text, one row per row of `docs`.

    Null texts count as empty: 0 bytes, 0 tokens. Rows that repeat are counted each. An empty table
    gives an empty one. Other columns are not read. `path` names the tokenizer file on the workers.
    """
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path, chunk, overlap)
        for batch in sliced(batches, "text"):
            texts = batch.column(1).to_pylist()
            tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), F.octet_length(whole).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("key", key)
