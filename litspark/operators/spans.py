"""Candidate spans of sentences as numbers, batch by batch (TXT1-TXT3).

A span runs from a token to the next one that is no connector (no connectors:
its neighbour). The words of a batch are numbered, a span is a number made of
its words' and a batch's spans are counted or looked up at once. What travels
between tasks are packed pieces: a batch's distinct spans of one part, sorted and
compressed, at a fifth of the bytes of a row each. Texts are compared, not hashes;
a hash only tells which part a span belongs to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Tokens that are looked at in one go; a longer sentence stands alone.
SPAN_TOKENS = 1 << 20


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(piece) -> pa.Table:
    return pa.ipc.open_stream(piece.as_buffer() if isinstance(piece, pa.Scalar) else piece).read_all()


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(lengths: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], toks: str, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` tokens."""
    held, n = [], 0
    for batch in batches:
        upto = np.cumsum(_lengths(batch.column(toks)))
        lo = 0
        while lo < batch.num_rows:
            before = upto[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(upto, before + most - n, side="right"))), batch.num_rows)
            held.append(batch.slice(lo, hi - lo))
            n += int(upto[hi - 1] - before)
            lo = hi
            if n >= most or lo < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _each(tables: Iterator[pa.Table], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on one table after the other. A worker gives its memory back after
    each: workers wait for their next task beside those that work."""
    for table in tables:
        yield from work(table)
        del table
        pa.default_memory_pool().release_unused()


# --- sentences kept in few bytes ---------------------------------------------------

def packed(sents: DataFrame, toks: str = "toks") -> DataFrame:
    """(piece): the rows of ``sents``, SPAN_TOKENS tokens to a piece, their words
    numbered by frequency and compressed."""
    def pack(table):
        lists = _whole(table[toks])
        words = lists.flatten().dictionary_encode()
        code = words.indices
        order = np.argsort(-np.bincount(code.drop_null().to_numpy(), minlength=len(words.dictionary)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        values = pa.DictionaryArray.from_arrays(pa.array(place).take(code), words.dictionary.take(pa.array(order)))
        column = _lists(_lengths(lists), values, lists.is_null())
        yield pa.RecordBatch.from_arrays([pa.array([_packed(table.set_column(table.column_names.index(toks), toks, column))], pa.binary())], ["piece"])

    return sents.mapInArrow(lambda batches: _each(gathered(batches, toks, SPAN_TOKENS), pack), "piece binary")


def _sentences(piece, toks: str) -> pa.Table:
    table = _unpacked(piece)
    lists = _whole(table[toks])
    column = _lists(_lengths(lists), lists.flatten().dictionary_decode(), lists.is_null())
    return table.set_column(table.column_names.index(toks), toks, column)


def unpacked(pieces: DataFrame, schema: StructType, toks: str = "toks") -> DataFrame:
    """The rows of ``packed``."""
    def pieces_of(batches):
        return (_sentences(piece, toks) for batch in batches for piece in batch.column(0))

    return pieces.mapInArrow(lambda batches: _each(pieces_of(batches), lambda table: table.to_batches(max_chunksize=10_000)), schema)


# --- the spans of a batch ------------------------------------------------------------

class Spans:
    """The spans of a batch of sentences in their order: token positions ``i`` to
    ``j`` and the number ``key``. A null token is no word: between connectors it
    counts as one, and a span's text leaves it out."""

    def __init__(self, lists: pa.Array, connectors: list[str] | None, ranked: bool = False):
        words = lists.flatten().dictionary_encode()
        self.words, self.lengths, n = words.dictionary, _lengths(lists), len(words.dictionary)
        self.code = words.indices.fill_null(n).to_numpy(zero_copy_only=False)
        if ranked:  # numbered in the order of the words: neighbours in a piece are alike
            order = pc.sort_indices(self.words).to_numpy()
            place = np.full(n + 1, n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            self.words, self.code = self.words.take(pa.array(order)), place[self.code]
        self.words = pa.concat_arrays([self.words, pa.nulls(1, self.words.type)])
        self.sentence = np.repeat(np.arange(len(lists), dtype=np.int32), self.lengths)
        if connectors:
            free = ~pc.is_in(self.words, value_set=pa.array(connectors, self.words.type)).to_numpy(zero_copy_only=False)
            free[n] = False
            at = np.flatnonzero(free[self.code]).astype(np.int32)
        else:
            at = np.arange(len(self.code), dtype=np.int32)
        i, j = at[:-1], at[1:]
        same = self.sentence[i] == self.sentence[j]
        self.i, self.j = i[same], j[same]
        mid = np.zeros(len(self.i), np.int32)
        self.between = pa.nulls(1, pa.string())  # number 0: neighbours
        far = np.flatnonzero(self.j > self.i + 1)
        if len(far):
            size = self.j[far] - self.i[far] - 1
            span = np.repeat(np.arange(len(far)), size)
            tokens = self.code[np.arange(len(span)) + np.repeat(self.i[far] + 1 - (np.cumsum(size) - size), size)]
            span, tokens = span[tokens < n], tokens[tokens < n]
            texts = pc.binary_join(_lists(np.bincount(span, minlength=len(far)), self.words.take(pa.array(tokens))), "_").dictionary_encode()
            mid[far] = texts.indices.to_numpy() + 1
            self.between = pa.concat_arrays([self.between, texts.dictionary.cast(pa.string())])
        # at most 4/27 of SPAN_TOKENS cubed: every word and every text in between has a token of its own
        if float(n + 1) ** 2 * len(self.between) >= 2.0 ** 63:
            raise ValueError("a sentence has too many different words for its spans to be numbered")
        self.key = (self.code[self.i].astype(np.int64) * len(self.between) + mid) * (n + 1) + self.code[self.j]

    def parts_of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text in between and last word of a span, as numbers."""
        left, b = np.divmod(key, len(self.words))
        a, mid = np.divmod(left, len(self.between))
        return a, mid, b

    def texts(self, key: np.ndarray) -> pa.Array:
        a, mid, b = self.parts_of(key)
        between = pc.if_else(pc.equal(self.between, ""), pa.scalar(None, pa.string()), self.between)
        return pc.binary_join_element_wise(self.words.take(pa.array(a)), between.take(pa.array(mid)), self.words.take(pa.array(b)), "_", null_handling="skip")


def _hash(texts: pa.Array) -> np.ndarray:
    return np.fromiter(map(crc32, texts.fill_null("").cast(pa.binary()).to_pylist()), np.uint64, len(texts))


#: Numbers a piece begins with: its counted words, spans, words, texts in between,
#: bytes of either, bytes before compression.
_HEAD = 7


class _Numbers:
    """Numbers things anew among those that a piece holds."""

    def __init__(self, most: int):
        self.there, self.place = np.zeros(most, bool), np.zeros(most, np.int32)

    def among(self, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        for x in columns:
            self.there[x] = True
        used = np.flatnonzero(self.there)
        self.there[used] = False
        self.place[used] = np.arange(len(used), dtype=np.int32)
        return used, [self.place[x] for x in columns]


def _characters(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of the texts, where each begins, and its length plus one; 0 is null."""
    size = pc.add(pc.binary_length(texts.cast(pa.binary())), 1).fill_null(0).to_numpy()
    begin = np.append(0, np.cumsum(np.maximum(size.astype(np.int64) - 1, 0)))
    data = pa.concat_arrays([texts.fill_null("")]).buffers()[2]
    return data.to_pybytes() if data is not None else b"", begin, size


def _count_pieces(spans: Spans, word: np.ndarray, n_word: np.ndarray, part_of_word: np.ndarray,
                  key: np.ndarray, n: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, piece): the counts of a batch's words and spans of that part. Words
    are numbered within the piece, first words are in order and written as steps,
    numbers as planes of bytes: a span takes few of them."""
    a, mid, b = spans.parts_of(key)
    part, part_of_word = (x.astype(np.uint16 if parts < 1 << 16 else np.int64) for x in (part, part_of_word))  # sorted by radix
    by, by_word = np.argsort(part, kind="stable"), np.argsort(part_of_word, kind="stable")
    pair_at, alone_at = np.searchsorted(part[by], np.arange(parts + 1)), np.searchsorted(part_of_word[by_word], np.arange(parts + 1))
    of_words, of_mids = _Numbers(len(spans.words)), _Numbers(len(spans.between))
    numbered = []
    for p in range(parts):
        w, s = by_word[alone_at[p]:alone_at[p + 1]], by[pair_at[p]:pair_at[p + 1]]
        if len(w) or len(s):
            used, (alone, first, last) = of_words.among(word[w], a[s], b[s])
            texts, (between,) = of_mids.among(mid[s])
            numbered.append((p, used, texts, [alone, n_word[w], np.diff(first, prepend=0), between, last, n[s]]))
    written = [_characters(of.take(pa.array(np.concatenate([x[k] for x in numbered])))) if numbered else None for k, of in ((1, spans.words), (2, spans.between))]
    codec = pa.Codec("zstd", compression_level=1)
    at = [0, 0]
    for p, used, texts, columns in numbered:
        data = []
        for k, some in enumerate((used, texts)):
            whole, begin, size = written[k]
            lo, hi = at[k], at[k] + len(some)
            columns.append(size[lo:hi])
            data.append(whole[begin[lo]:begin[hi]])
            at[k] = hi
        body = np.concatenate(columns).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + data[0] + data[1]
        head = np.array([len(columns[0]), len(columns[2]), len(used), len(texts), len(data[0]), len(data[1]), len(body)], "<i8")
        yield p, head.tobytes() + codec.compress(body, asbytes=True)


def _texts(size: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(np.maximum(size - 1, 0), out=offsets[1:])
    texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))
    return texts if size.all() else pc.if_else(pa.array(size == 0), pa.scalar(None, pa.string()), texts)


def _counts_of(piece: bytes) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """Of a piece the words, the texts in between, and by their numbers the counted
    words, their counts, the spans' first words, texts in between, last words, counts."""
    n_words, n_spans, n_texts, n_mids, size, mid_size, whole = np.frombuffer(piece, "<i8", _HEAD).tolist()
    body = pa.Codec("zstd").decompress(piece[8 * _HEAD:], whole, asbytes=True)
    total = 2 * n_words + 4 * n_spans + n_texts + n_mids
    numbers = np.frombuffer(body, np.uint8, 4 * total).reshape(4, total).T.copy().view("<i4").ravel()
    *columns, length, mid_length = np.split(numbers, np.cumsum([n_words, n_words, n_spans, n_spans, n_spans, n_spans, n_texts]))
    columns[2] = np.cumsum(columns[2], dtype=np.int32)
    return _texts(length, body[4 * total:4 * total + size]), _texts(mid_length, body[4 * total + size:]), columns


def _numbered(texts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct texts of all pieces, and every piece's by their numbers."""
    coded = pa.chunked_array(texts, pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in texts])[:-1])


def _sums(pieces: Iterator[bytes]) -> tuple[pa.Array, np.ndarray, pa.Array, list[np.ndarray]]:
    """Of all pieces of a part the words and how often they are counted, the texts
    in between, and the distinct spans: first words, texts, last words, counts."""
    words, between, columns = zip(*map(_counts_of, pieces))
    words, places = _numbered(words)
    between, mid_places = _numbered(between)
    seen = np.zeros(len(words), np.int64)
    for place, x in zip(places, columns):
        seen[place[x[0]]] += x[1]
    a, mid, b = (np.concatenate([place[x[k]] for place, x in zip(at, columns)]) for k, at in ((2, places), (3, mid_places), (4, places)))
    n = np.concatenate([x[5] for x in columns])
    del columns, places, mid_places
    key = a.astype(np.int64) * len(between) + mid
    if len(words) * len(between) * len(words) >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(words) + b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    first = order[first]
    return words, seen, between, [a[first], mid[first], b[first], total]


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of a part's entries, in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(part[some[0]]), some


def parts_for(df: DataFrame) -> int:
    """Parts of the spans, as many as shuffle partitions: those bound what a task holds."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- counting --------------------------------------------------------------------------

#: What a row of ``counted`` tells: a word's count, a span's count, or how many
#: distinct words and spans a part has.
WORD, SPAN, DISTINCT = 0, 1, 2


def counted(sents: DataFrame, toks: str, connectors: list[str] | None, above: int) -> DataFrame:
    """(kind, a, mid, b, count): every word (as a), the spans counted more than
    ``above`` times (first word, text in between or null, last word), and a row a
    part with the number of its distinct words and spans, whatever their count."""
    parts = parts_for(sents)

    def count(table):
        spans = Spans(_whole(table[toks]), connectors, ranked=True)
        hashed, mids = _hash(spans.words), _hash(spans.between)
        key, n = np.unique(spans.key, return_counts=True)
        a, mid, b = spans.parts_of(key)
        seen = np.bincount(spans.code, minlength=len(spans.words))
        word = np.flatnonzero(seen)
        with np.errstate(over="ignore"):
            mixed = (hashed[a] * np.uint64(0x9E3779B97F4A7C15) + mids[mid]) * np.uint64(0xBF58476D1CE4E5B9) + hashed[b]
        part, part_of_word = ((((x ^ (x >> np.uint64(29))) >> np.uint64(8)) % np.uint64(parts)).astype(np.int32) for x in (mixed, hashed[word] << np.uint64(20)))
        for p, piece in _count_pieces(spans, word, seen[word], part_of_word, key, n, part, parts):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([piece], pa.binary())], ["part", "piece"])

    def merge(pieces: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        words, seen, between, (a, mid, b, n) = _sums(x.as_py() for x in pieces["piece"])
        word, kept = np.flatnonzero(seen), np.flatnonzero(n > above)
        nulls = lambda size: pa.nulls(size, pa.string())
        return pa.table({
            "kind": np.repeat(np.array([WORD, SPAN, DISTINCT], np.int32), [len(word), len(kept), 1]),
            "a": pa.concat_arrays([words.take(pa.array(np.concatenate([word, a[kept]]))), nulls(1)]),
            "mid": pa.concat_arrays([nulls(len(word)), between.take(pa.array(mid[kept])), nulls(1)]),
            "b": pa.concat_arrays([nulls(len(word)), words.take(pa.array(b[kept])), nulls(1)]),
            "count": np.concatenate([seen[word], n[kept], [len(word) + len(n)]])})

    pieces = sents.select(toks).mapInArrow(lambda batches: _each(gathered(batches, toks, SPAN_TOKENS), count), "part int, piece binary")
    return pieces.groupBy("part").applyInArrow(merge, "kind int, a string, mid string, b string, count long")


# --- merging ---------------------------------------------------------------------------

def _with_phrased(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("phrased", ArrayType(StringType()))


def _merged(table: pa.Table, toks: str, spans: Spans, distinct: np.ndarray, which: np.ndarray, hit: np.ndarray) -> pa.Table:
    """The sentences with ``phrased``: of hits in a row that share a token every
    second one is left, as a scan from the left leaves them. ``hit`` belongs to
    the ``distinct`` spans, ``which`` tells a span's."""
    found = hit[which]
    follows = np.zeros(len(found), bool)
    follows[1:] = found[1:] & found[:-1] & (spans.i[1:] == spans.j[:-1])
    at = np.arange(len(found))
    first = np.maximum.accumulate(np.where(follows, 0, at)) if len(at) else at
    taken = np.flatnonzero(found & ((at - first) % 2 == 0))
    i, size = spans.i[taken], spans.j[taken] - spans.i[taken]
    used, phrase = np.unique(which[taken], return_inverse=True)
    code, keep = spans.code.copy(), np.ones(len(spans.code), bool)
    code[i] = len(spans.words) + phrase
    keep[np.repeat(i + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = False
    pool = pa.concat_arrays([spans.words, spans.texts(distinct[used])])
    lists = _whole(table[toks])
    lengths = spans.lengths - np.bincount(spans.sentence[i], weights=size, minlength=len(lists)).astype(np.int64)
    return table.append_column("phrased", _lists(lengths, pool.take(pa.array(code[keep])), lists.is_null()))


def merged(sents: DataFrame, toks: str, connectors: list[str] | None, accepted: pa.Array) -> DataFrame:
    """``sents`` with ``phrased``; the accepted phrases go to every task."""
    sent = sents.sparkSession.sparkContext.broadcast(_packed(pa.table({"phrase": accepted})))

    def merge(batches):
        phrases = _whole(_unpacked(sent.value)["phrase"])

        def work(table):
            spans = Spans(_whole(table[toks]), connectors)
            distinct, which = np.unique(spans.key, return_inverse=True)
            hit = pc.is_in(spans.texts(distinct), value_set=phrases).to_numpy(zero_copy_only=False)
            yield from _merged(table, toks, spans, distinct, which, hit).to_batches(max_chunksize=10_000)
        return _each(gathered(batches, toks, max(1, SPAN_TOKENS // 2)), work)
    return sents.mapInArrow(merge, _with_phrased(sents.schema))


def merged_by_parts(sents: DataFrame, toks: str, connectors: list[str] | None, accepted: DataFrame) -> DataFrame:
    """``merged`` with any number of phrases: a part's phrases meet the distinct
    spans of every piece there, and a bit for each span comes back."""
    from litspark.session import cut_lineage
    parts = parts_for(sents)
    schema = sents.schema
    # fixed by the checkpoint: a piece must list the same spans twice
    pieces = cut_lineage(packed(sents, toks).withColumn("_at", F.monotonically_increasing_id()))

    def listed(table: pa.Table):
        spans = Spans(_whole(table[toks]), connectors, ranked=True)
        distinct, which = np.unique(spans.key, return_inverse=True)
        texts = spans.texts(distinct)
        return spans, distinct, which, texts, list(_by_part((_hash(texts) % np.uint64(parts)).astype(np.int32)))

    def row(part, at, texts):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([_packed(pa.table({"t": texts}))], pa.binary())], ["part", "_at", "piece"])

    def candidates(batches):
        for batch in batches:
            for piece, at in zip(batch.column("piece"), batch.column("_at").to_pylist()):
                *_, texts, chosen = listed(_sentences(piece, toks))
                for part, some in chosen:
                    yield row(part, at, texts.take(pa.array(some)))

    def phrases(batches):
        for batch in batches:
            texts = batch.column(0).drop_null()
            for part, some in _by_part((_hash(texts) % np.uint64(parts)).astype(np.int32)):
                yield row(part, None, texts.take(pa.array(some)))

    def meet(rows: pa.Table) -> pa.Table:
        known = [_unpacked(x)["t"] for x, at in zip(rows["piece"], rows["_at"].to_pylist()) if at is None]
        known = pa.chunked_array([c for x in known for c in x.chunks], pa.string())
        rows = rows.filter(pc.is_valid(rows["_at"]))
        bits = [np.packbits(pc.is_in(_whole(_unpacked(x)["t"]), value_set=known).to_numpy(zero_copy_only=False)).tobytes() for x in rows["piece"]] if len(known) else []
        rows = rows if len(known) else rows.slice(0, 0)
        return pa.table({"_at": rows["_at"], "part": rows["part"], "bits": pa.array(bits, pa.binary())})

    def merge(batches):
        for batch in batches:
            for piece, found in zip(batch.column("piece"), batch.column("_found").to_pylist()):
                table = _sentences(piece, toks)
                spans, distinct, which, _, chosen = listed(table)
                hit = np.zeros(len(distinct), bool)
                known = {x["part"]: x["bits"] for x in found or []}
                for part, some in chosen:
                    if part in known:
                        hit[some] = np.unpackbits(np.frombuffer(known[part], np.uint8), count=len(some)).astype(bool)
                yield from _merged(table, toks, spans, distinct, which, hit).to_batches(max_chunksize=10_000)

    kind = "part int, _at long, piece binary"
    both = pieces.mapInArrow(candidates, kind).unionByName(accepted.select(F.col("phrase").cast("string")).mapInArrow(phrases, kind))
    bits = both.groupBy("part").applyInArrow(meet, "_at long, part int, bits binary")
    found = bits.groupBy("_at").agg(F.collect_list(F.struct("part", "bits")).alias("_found"))  # a bit for each span of a piece
    return pieces.join(found, "_at", "left").select("piece", "_found").mapInArrow(merge, _with_phrased(schema))
