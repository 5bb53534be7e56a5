"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``window`` words. A window is a set of shingles,
each with its place; a document contains the window only if it contains all of
them, so any one shingle is a sufficient prefix, and the rarest is the cheapest.

1. One pass counts in how many documents each shingle of the items occurs.
2. Each window keeps its rarest shingle as its prefix token.
3. A second pass joins the shingles of documents to the prefix tokens, drops matches
   whose window would begin or end outside the document, and verifies the window
   word by word.

The items are a stated query set. They are taken in blocks of about ``block_words``
words (a block is what is sent to the tasks, some 50 bytes a word), and every block
runs against all documents; documents are never shuffled. Words and shingles are
compared by hashes of 64 bits, so neither depends on how many there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, in_pieces, lean, limit_batches, word_hashes, written

SPANS = "array<struct<start:long,end:long>>"
#: Bytes of words: 0-9, a-z and all beyond ASCII, with A-Z lower-cased; others stand between words.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def sequence_codes(stream: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words that follow one another."""
    size = max(0, len(stream) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(size, n, np.uint64)
        for i in range(n):
            out = (out ^ stream[i : i + size]) * ODD[i % len(ODD)]
            out ^= out >> np.uint64(29)
    return out


def joined(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` that are among the sorted ``keys``, and their places there."""
    if not len(keys) or not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


class Block:
    """Windows of some items, as parallel arrays: begin (in ``stream``), length, and items by window."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.stream, ends = word_hashes(pa.array([t for _, t in items], pa.string()), BYTES)
        sizes = np.diff(ends)
        length = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - length + 1, 0)
        owner = np.repeat(np.array([number[name] for name, _ in items], np.int64), count)
        begin = np.repeat(ends[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.repeat(length, count)
        codes = np.empty(len(begin), np.uint64)
        for n in np.unique(length).tolist():
            codes[length == n] = sequence_codes(self.stream, n)[begin[length == n]]
        # windows of equal words are one
        _, first, same = np.unique(codes, return_index=True, return_inverse=True)
        self.begin, self.length = begin[first], length[first]
        held = np.unique(same * max(1, len(self.names)) + owner)
        self.items = held % max(1, len(self.names))
        self.item_ends = np.searchsorted(held // max(1, len(self.names)), np.arange(len(first) + 1))
        #: the shingles of windows by length: a window of few words is its own shingle
        self.size = np.minimum(self.length, shingle)
        self.sizes = np.unique(self.size).tolist()
        self.known = {}
        for n in self.sizes:
            places = np.unique(np.concatenate([self.begin[(self.size == n) & (self.length >= n + i)] + i for i in range(max(1, window - n + 1))]))
            self.known[n] = np.unique(sequence_codes(self.stream, n)[places])

    def present(self, stream: np.ndarray, ends: np.ndarray, n: int, keys: np.ndarray):
        """Places of the known shingles of n words, their places in ``keys``, and their documents."""
        at, k = joined(keys, sequence_codes(stream, n))
        doc = np.searchsorted(ends, at, "right") - 1
        inside = at + n <= ends[doc + 1]
        return at[inside], k[inside], doc[inside]


def shingle_frequencies(block: Block):
    """Rows (length, place in the sorted shingles, documents)."""

    def run(batches):
        counts = {n: np.zeros(len(known), np.int64) for n, known in block.known.items()}
        for batch in batches:
            stream, ends = word_hashes(batch.column(1), BYTES)
            for n, known in block.known.items():
                _, k, doc = block.present(stream, ends, n, known)
                counts[n] += np.bincount(np.unique(doc * max(1, len(known)) + k) % max(1, len(known)), minlength=len(known))
        for n, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch({"n": pa.array(np.full(len(at), n, np.int32)), "k": pa.array(at.astype(np.int64)), "docs": pa.array(c[at])})

    return run


def prefixes(block: Block, frequency: dict[int, np.ndarray]) -> dict:
    """By shingle length: the sorted prefix tokens, and for each its windows with the token's place in them."""
    found = {}
    for n in block.sizes:
        windows = np.flatnonzero(block.size == n)
        codes, rarest = sequence_codes(block.stream, n), np.full(len(windows), np.iinfo(np.int64).max)
        token, place = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
        for i in range(int(block.length[windows].max(initial=n)) - n + 1):
            at = block.begin[windows] + np.minimum(i, block.length[windows] - n)
            docs = frequency[n][np.searchsorted(block.known[n], codes[at])]
            less = docs < rarest
            rarest[less], token[less], place[less] = docs[less], codes[at][less], (at - block.begin[windows])[less]
        order = np.argsort(token, kind="stable")
        keys, first = np.unique(token[order], return_index=True)
        found[n] = (keys, np.append(first, len(order)), windows[order], place[order])
    return found


def hits(block: Block, tokens: dict):
    """Rows (doc_id, row_id, n_words, spans of hit words, items)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))

    def matches(stream, ends):
        """(document, begin, window) of all windows that documents contain."""
        for n, (keys, edges, windows, places) in tokens.items():
            at, k, doc = block.present(stream, ends, n, keys)
            several = edges[k + 1] - edges[k]
            each = np.repeat(np.arange(len(at)), several)
            w = np.repeat(edges[k], several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
            begin, doc, window = at[each] - places[w], doc[each], windows[w]
            size = block.length[window]
            sound = (begin >= ends[doc]) & (begin + size <= ends[doc + 1])  # the window must lie within the document
            for i in range(int(size.max(initial=0))):
                on = np.flatnonzero(sound & (i < size))
                sound[on] = stream[begin[on] + i] == block.stream[block.begin[window[on]] + i]
            yield doc[sound], begin[sound], window[sound]

    def run(batches):
        for batch in batches:
            stream, ends = word_hashes(batch.column(1), BYTES)
            doc, begin, window = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 3, *matches(stream, ends)))
            order = np.lexsort((begin, doc))
            doc, begin, window = doc[order], begin[order], window[order]
            spans, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for d in np.unique(doc).tolist():
                of = slice(*np.searchsorted(doc, [d, d + 1]))
                start, end = begin[of] - ends[d], np.maximum.accumulate(begin[of] + block.length[window[of]] - ends[d])
                apart = np.flatnonzero(start[1:] > end[:-1])
                spans[d] = [{"start": s, "end": e} for s, e in zip(start[np.append(0, apart + 1)].tolist(), end[np.append(apart, len(end) - 1)].tolist())]
                own = np.unique(np.concatenate([block.items[block.item_ends[w] : block.item_ends[w + 1]] for w in np.unique(window[of])]))
                items[d] = [block.names[i] for i in own.tolist()]
            columns = (batch.column(0), batch.column(2), pa.array(np.diff(ends)), pa.array(spans, kinds[3]), pa.array(items, kinds[4]))
            yield pa.record_batch(dict(zip(("doc_id", "row_id", "n_words", "spans", "items"), columns)))

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int, block_words: int):
    """The items in blocks of bounded size, and how many blocks there are."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    # a text of n characters has at most (n + 1) / 2 words; equal items share a block
    total = items.agg(F.coalesce(F.sum((F.char_length("text") + 1) / 2), F.lit(0.0))).first()[0]
    count = max(1, -(-int(total) // block_words))
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
    return count, (Block([(r.item, r.text) for r in items.where(F.col("block") == i).select("item", "text").collect()], window, shingle) for i in range(count))


def tokens_of(block: Block, rows: DataFrame) -> dict:
    """The block's prefix tokens, rarest by the documents of the corpus that hold them."""
    frequency = {n: np.zeros(len(known), np.int64) for n, known in block.known.items()}
    counted = rows.mapInArrow(lean(bounded(shingle_frequencies(block), size=4 << 20)), "n int, k long, docs long").groupBy("n", "k").agg(F.sum("docs").alias("docs"))
    for r in counted.collect():  # at most a row for each shingle of the block
        frequency[r.n][r.k] = r.docs
    return prefixes(block, frequency)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, block_words: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items, n_items, contaminated.

    ``spans``: start and end (exclusive) of each run of hit words;
    ``items``: ids, as sorted strings, of the items with a window in the document.
    Null texts have no words; items without words have no window, items without
    id are left out. Rows that repeat a document are each judged; repeated items
    count once. An empty table gives no rows, an empty benchmark no hits. Other
    columns are not read.
    """
    limit_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.lit(0).cast("long"))
    blocks, made = blocks_of(benchmark, item_col, item_text_col, window, shingle, block_words)
    schema = f"doc_id long, row_id long, n_words long, spans {SPANS}, items array<string>"
    if blocks > 1:
        rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "documents")
    found = [rows.mapInArrow(lean(bounded(hits(block, tokens_of(block, rows)), size=4 << 20)), schema) for block in made]
    out = found[0]
    if blocks > 1:
        for other in found[1:]:
            out = out.unionAll(other.where(F.size("spans") > 0))
        every = F.array_sort(F.flatten(F.collect_list("spans")))
        out = out.groupBy("doc_id", "row_id").agg(F.max("n_words").alias("n_words"), every.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.withColumn("spans", joined_spans(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", n_hit).select("doc_id", "n_words", "n_hit", "spans", "items", F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


def joined_spans(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s["start"] <= last["end"], F.concat(before, F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS), add)


def is_clean(judge):
    """A function of a text column: whether no text run of it is hit."""

    def clean(texts: pa.Array) -> pa.Array:
        none = pa.nulls(len(texts), pa.int64())
        batch = pa.record_batch({"doc_id": none, "text": texts, "row_id": none})
        return pa.array([not s for out in judge([batch]) for s in out.column("spans").to_pylist()], pa.bool_())

    return in_pieces(clean)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item; judged where they are read."""
    limit_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    out = docs
    for block in blocks_of(benchmark, item_col, item_text_col, window, shingle, block_words)[1]:
        clean = F.arrow_udf(is_clean(hits(block, tokens_of(block, rows))), "boolean")
        out = out.where(clean(docs[text_col].cast("string")))
    return out
