"""Order-preserving packing of documents into training windows.

Documents are laid out one behind the other, in their order within a partition,
and cut into windows of at most ``WINDOW`` tokens. Where to cut is a dynamic
program over the admissible places: behind a document (free), behind a sentence
(``SENTENCE_CUT``) and, only in a stretch of a window or more without either,
every ``STRIDE`` tokens (``BLIND_CUT``). A window costs its padding, a cut its
penalty. Among the
places one window back, the best start minimises cost + position, so the
transition is a sliding-window minimum held in a monotone queue: every place
enters and leaves it once.

A window whose length is a power of two needs no padding. What is left at the
end of a partition is cut into such windows, the largest first.

The layout of a partition is computed in one stream of Arrow batches. Tokens of
at most a few batches and one open window are held, so memory is bounded, and a
lost executor's partitions are laid out again, alike. Token numbers of a text
are those of the tokenizer file; each distinct word is encoded once per task.

Defined cases: null and empty texts are a single end token; a very long text
runs over many windows; repeated rows are packed one by one; an empty table
gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import slices, small_batches, table, text_of
from litspark.llm.words import ALPHANUMERIC, BLANK_SEPARATED, Words, split_words

WINDOW = 4096
SENTENCE_CUT = 4
BLIND_CUT = 16
STRIDE = 32
END = 2
#: Distinct words whose tokens a task remembers.
CACHED_WORDS = 2_000_000
#: The letters that byte-level merges write for bytes: printable Latin-1 stands
#: for itself, the rest for the letters from U+0100 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_POINT = np.isin(np.arange(256), list(b",.!?;:"))
_ASCII_WORD = ALPHANUMERIC & (np.arange(256) < 128)


class WordTokenizer:
    """Token numbers of whole texts by the tokenizer in ``path``. Its rule drops
    white space and never joins what white space separates, so a text's tokens
    are those of its words, one after the other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()
        tokens = self.tokenizer.get_vocab()
        self.stop = np.zeros(max(tokens.values(), default=0) + 1, bool)  # tokens that end a sentence
        self.stop[[i for text, i in tokens.items() if any(c in text for c in ".!?")]] = True

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)   # hashes of known words, sorted
        self.number = np.zeros(0, np.int64)   # and the number of each
        self.ids = np.zeros(0, np.uint32)     # tokens of all known words
        self.at = np.zeros(1, np.int64)       # where word i's tokens begin

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new words. A word of Latin letters is a single piece to the
        rule, so its merges can be asked for directly; any other takes the
        whole way."""
        merges, found = self.tokenizer.model.tokenize, []
        for x in texts:
            if x.isalpha() and max(x) < "\u0250" and "\u0130" not in x:
                if not x.isascii():
                    x = unicodedata.normalize("NFC", x)
                found.append([t.id for t in merges(x.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                found.append(self.tokenizer.encode(x, add_special_tokens=False).ids)
        number = len(self.at) - 1 + np.arange(len(texts))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
        into = np.searchsorted(self.known, hashes)
        self.known, self.number = np.insert(self.known, into, hashes), np.insert(self.number, into, number)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts, each with END behind, and where each begins."""
        # The rule lower-cases; only the names of special tokens keep their case.
        words = _points_apart(split_words(data, offsets, BLANK_SEPARATED, lower=b"<|" not in data.tobytes()), offsets)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        unique, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        into = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        new[into < len(self.known)] = self.known[into[into < len(self.known)]] != unique[into < len(self.known)]
        if new.any():
            self._learn(unique[new], [words.text(i) for i in first[new].tolist()])
        number = self.number[np.searchsorted(self.known, unique)][inverse] if len(unique) else np.zeros(0, np.int64)
        size = self.at[number + 1] - self.at[number]
        total = np.concatenate([[0], np.cumsum(size)])
        begin = total[words.first] + np.arange(len(offsets))  # one END per earlier text
        out = np.full(int(begin[-1]), END, np.uint32)
        source = np.repeat(self.at[number] - total[:-1], size) + np.arange(int(total[-1]))
        target = np.arange(int(total[-1])) + np.repeat(np.arange(len(offsets) - 1), np.diff(total[words.first]))
        out[target] = self.ids[source]
        return out, begin


def _points_apart(words: Words, offsets: np.ndarray) -> Words:
    """A point or comma behind an ASCII letter or digit at a word's end is a
    token of its own by the rule; apart, far fewer words are distinct."""
    last, before = words.data[words.end - 1], words.data[np.maximum(words.end - 2, 0)]
    cut = np.flatnonzero(_POINT[last] & _ASCII_WORD[before] & (words.end - words.start > 1))
    start, end = np.concatenate([words.start, words.end[cut] - 1]), np.concatenate([words.end, words.end[cut]])
    end[cut] -= 1
    order = np.argsort(start, kind="stable")
    return Words(words.data, start[order], end[order], np.searchsorted(start[order], offsets))


@functools.cache
def tokenizer_at(path: str) -> WordTokenizer:
    """One per Python worker, so later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def cut_places(ids: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Admissible cuts (positions behind a token, increasing) with penalties;
    ``ends``: positions behind the documents."""
    sentence = np.flatnonzero(stop[np.minimum(ids, len(stop) - 1)]) + 1
    sentence = sentence[~np.isin(sentence, sentence - 1)]  # "..." is one end
    natural = np.union1d(sentence, ends)
    edges = np.concatenate([[0], natural, [len(ids)]])
    wide = np.flatnonzero(np.diff(edges) >= WINDOW)  # a window can lie in there without a boundary
    blind = [np.arange(a + STRIDE, b, STRIDE) for a, b in zip(edges[wide].tolist(), edges[wide + 1].tolist())]
    at = np.union1d(natural, np.concatenate([*blind, np.zeros(0, np.int64)])).astype(np.int64)
    cost = np.where(np.isin(at, ends), 0, np.where(np.isin(at, sentence), SENTENCE_CUT, BLIND_CUT))
    return at, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For every place: least cost of windows ending there (padding of each
    window plus penalty of its cut), and the place before (-1: the beginning)."""
    at, pen = [0, *places.tolist()], [0, *cost.tolist()]
    best, back = [0] * len(at), [-1] * len(at)
    queue: deque[int] = deque([0])  # best[i] + at[i] increasing
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best[j] = best[i] + window - (p - at[i]) + pen[j]
        back[j] = i
        value = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    return best, back


def cut_windows(ids: np.ndarray, ends: np.ndarray, stop: np.ndarray, last: bool) -> list[int]:
    """Cut positions over the tokens laid out so far. Not at the end of the
    stream, the open rest stays for the next call; at the end it becomes windows
    of powers of two."""
    places, cost = cut_places(ids, ends, stop)
    n, cuts = len(ids), []
    if n >= WINDOW:
        best, back = best_cuts(places, cost)
        at = [0, *places.tolist()]
        # the last cut: the cheapest among the places within a window of the end
        tail = [j for j in range(len(at) - 1, -1, -1) if at[j] > n - WINDOW]
        j = min(tail, key=lambda j: best[j])
        while j > 0:
            cuts.append(at[j])
            j = back[j]
        cuts.reverse()
    if last:
        at, rest = (cuts[-1] if cuts else 0), n - (cuts[-1] if cuts else 0)
        while rest:
            size = min(WINDOW, 1 << (rest.bit_length() - 1))
            at, rest = at + size, rest - size
            cuts.append(at)
    return cuts


class _Layout:
    """The open stream of one partition: tokens, and which document each run of
    them belongs to."""

    def __init__(self, tokenizer: WordTokenizer, partition: int):
        self.tokenizer, self.sequence = tokenizer, partition << 40
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[list] = []  # doc_id, tokens of it before the stream, tokens in it, tokens in all

    def add(self, doc_ids: list, ids: np.ndarray, begin: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        for d, size in zip(doc_ids, np.diff(begin).tolist()):
            self.docs.append([d, 0, size, size])

    def pieces(self, last: bool) -> pa.RecordBatch:
        ends = np.cumsum([d[2] for d in self.docs], dtype=np.int64) if self.docs else np.zeros(0, np.int64)
        cuts = cut_windows(self.ids, ends, self.tokenizer.stop, last)
        rows: list[tuple] = []
        at, doc = 0, 0
        for cut in cuts:
            begin = at
            while at < cut:
                d = self.docs[doc]
                size = min(d[2], cut - at)
                rows.append((d[0], d[1], size, zlib.crc32(self.ids[at:at + size].tobytes()), d[3], self.sequence, at - begin))
                d[1], d[2], at = d[1] + size, d[2] - size, at + size
                doc += d[2] == 0
            self.sequence += 1
        self.ids, self.docs = self.ids[at:], self.docs[doc:]
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_NAMES))


_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _Layout(tokenizer_at(path), TaskContext.get().partitionId())
        for batch, data, offsets in slices(batches, "text"):
            layout.add(batch.column(0).to_pylist(), *layout.tokenizer.encode(data, offsets))
            yield layout.pieces(False)
        yield layout.pieces(True)
    return run


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of a document in a window: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(_packer(tokenizer_path), ", ".join(f"{n} bigint" for n in _NAMES)))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())


SQL = None
