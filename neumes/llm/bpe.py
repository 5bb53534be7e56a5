"""BPE encoding and decoding through a table of distinct words.

1. Each input split counts its distinct words (pre-tokens); the counts by split
   are written once.
2. Their sum is the distinct-word table; every distinct word is encoded once.
3. Words at least as frequent as a threshold, at most ``hot_words`` of them and
   short, are broadcast. The other words, rare by choice of the threshold, are
   joined to the splits that hold them.
4. Documents travel as compressed blobs to the rare words of their split, one task for
   each split, and ids are put back by position with whole arrays.
5. Decoding joins each id to its piece: the vocabulary, a table of bounded size, is held
   by every task and joined by position.

The splitting of texts into words is that of ``SUPPORTED``; other tokenizers are refused.
"""

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, lean, limit_batches, written

#: Longer words are never broadcast; this and ``hot_words`` bound what is.
HOT_BYTES = 32
#: The parts of a tokenizer's file that ``Words`` and ``decoded`` stand for.
SUPPORTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}


def supported(tokenizer_json: str) -> str:
    """The file's content; raises where its model, splitting or decoding is another than this module's."""
    parts = json.loads(tokenizer_json)
    other = [k for k, v in SUPPORTED.items() if parts.get(k) != v]
    model = parts.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
        other.append("model")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in parts.get("added_tokens") or ()):
        other.append("added_tokens")
    if other:
        raise ValueError(f"this tokenizer is not supported: its {', '.join(other)} differ from what is built here")
    return tokenizer_json


class Words:
    """Splits texts into the words that the tokenizer's model sees, in its byte alphabet.

    Chunks between ASCII white space are split apart: no word crosses it. Chunks
    of letters are one word; other ASCII ones are split by a plain expression; the
    tokenizer itself splits the rest, and special tokens stay whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self.marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
        # the byte alphabet: visible characters stand for themselves, other bytes for code points from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.bytes = {b: 256 + i for i, b in enumerate(hidden)}

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk.isprintable() and "<|" not in chunk:
                return self.ascii.findall(chunk.lower())
        elif "Σ" not in chunk:  # the final form of that letter depends on its place in lower()
            core = chunk.rstrip(self.marks)
            word = unicodedata.normalize("NFC", core).lower()
            if core.isalpha() and word.isalpha():
                word = word.encode().decode("latin-1").translate(self.bytes)
                return [word, chunk[len(core) :]] if len(core) < len(chunk) else [word]
        if not self.apart:
            return self.plain(chunk)
        out = []
        for i, part in enumerate(self.apart.split(chunk)):
            if part:
                out += [part] if i % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def pieces(self) -> list[str]:
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(i) or "" for i in range(n)]


class Split:
    """The words of a batch of texts: numbers of distinct words by position."""

    def __init__(self, texts: pa.Array, splitter: Words):
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        self.doc_offsets = offsets(chunks)
        chunks = coded.dictionary
        plain = pc.ascii_is_alpha(chunks).to_numpy(zero_copy_only=False)  # such a chunk is one word
        lengths = np.ones(len(chunks), np.int64)
        other, others = [], np.flatnonzero(~plain)
        for i, chunk in zip(others.tolist(), chunks.filter(pa.array(~plain)).to_pylist()):
            found = splitter.split(chunk) if chunk else ()
            lengths[i] = len(found)
            other += found
        self.chunk_offsets = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.concat_arrays([pc.ascii_lower(chunks.filter(pa.array(plain))), pa.array(other, pa.string())]).dictionary_encode()
        self.words = words.dictionary
        numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        one = int(plain.sum())
        places = np.repeat(plain, lengths)
        self.chunk_words = np.empty(len(numbers), np.int64)
        self.chunk_words[places], self.chunk_words[~places] = numbers[:one], numbers[one:]
        self.chunk = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def counts(self) -> np.ndarray:
        by_chunk = np.bincount(self.chunk, minlength=len(self.chunk_offsets) - 1)
        weights = np.repeat(by_chunk, np.diff(self.chunk_offsets))
        return np.bincount(self.chunk_words, weights, minlength=len(self.words)).astype(np.int64)

    def ids(self, word_offsets: np.ndarray, word_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin and end."""
        ids, sizes = gathered(word_offsets, word_ids, self.chunk_words)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids, sizes = gathered(ends[self.chunk_offsets], ids, self.chunk)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[self.doc_offsets]


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Where lists begin and end in their flattened values; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def gathered(begin: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated runs values[begin[i]:begin[i + 1]] for i in ``at``, and the runs' lengths."""
    sizes = (begin[1:] - begin[:-1])[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin[at] - (ends - sizes), sizes) + np.arange(total)], sizes


def split_counts(tokenizer):
    """Rows (split, word, n): the distinct words of each split."""

    def run(batches):
        splitter, total, split = Words(tokenizer.value), {}, None
        for batch in batches:
            split = batch.column(2)[0].as_py() if batch.num_rows else split
            found = Split(batch.column(1), splitter)
            for w, n in zip(found.words.to_pylist(), found.counts().tolist()):
                total[w] = total.get(w, 0) + n
            if len(total) > 600_000:  # bounded; the sums are the same
                yield rows(split, total)
                total = {}
        if total:
            yield rows(split, total)

    def rows(split, total):
        return pa.record_batch({"split": pa.array([split] * len(total), pa.int32()), "word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def encoded(tokenizer):
    def run(batches):
        splitter = Words(tokenizer.value)
        for batch in batches:
            ids = [splitter.encode(w) for w in batch.column(0).to_pylist()]
            yield pa.record_batch({"word": batch.column(0), "n": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def rare(hot):
    """Rows (split, word) of words that are not broadcast."""

    def run(batches):
        words = frozenset(hot.value["word"].to_pylist())
        for batch in batches:
            away = np.fromiter((w not in words for w in batch.column("word").to_pylist()), bool, batch.num_rows)
            yield batch.select(["split", "word"]).filter(pa.array(away))

    return run


def blobs(batches):
    """Documents of a split as compressed Arrow streams."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_batch(batch)
        yield pa.record_batch({"split": pa.array([batch.column(2)[0].as_py()], pa.int32()), "kind": pa.array([1], pa.int32()), "word": pa.nulls(1, pa.string()), "ids": pa.nulls(1, pa.list_(pa.int32())), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def positioned(tokenizer, hot):
    """Rows sorted by split, its rare words before its blobs; one row for each document."""

    def run(batches):
        splitter = Words(tokenizer.value)
        common, common_ids = hot.value["word"], hot.value["ids"]
        common_ids, common_offsets = common_ids.flatten().to_numpy(), offsets(common_ids)
        pieces = pa.array(splitter.pieces(), pa.string())
        split, own = None, {}
        for batch in batches:
            splits, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((splits[1:] != splits[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(splits)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if splits[begin] != split:
                    split, own = splits[begin], {}
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    own.update(zip(part.column("word").to_pylist(), part.column("ids").to_pylist()))
                    continue
                for blob in part.column("blob"):
                    for docs in pa.ipc.open_stream(blob.as_py()):
                        yield documents(docs, splitter, common, common_offsets, common_ids, own, pieces)

    def documents(docs, splitter, common, common_offsets, common_ids, own, pieces):
        found = Split(docs.column(1), splitter)
        at = pc.index_in(found.words, value_set=common)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        # a word is missing here only if the input's splits have changed since they were counted
        extra = [own.get(w) or splitter.encode(w) for w in found.words.take(pa.array(missing)).to_pylist()]
        at[missing] = len(common_offsets) - 1 + np.arange(len(missing))
        begins = np.concatenate([common_offsets, common_offsets[-1] + np.cumsum(np.array([len(x) for x in extra], np.int64))]).astype(np.int64)
        values = np.concatenate([common_ids, np.array([i for x in extra for i in x], common_ids.dtype)])
        word_ids, sizes = gathered(begins, values, at)
        ids, ends = found.ids(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), word_ids)
        ids = ids.astype("<u4")
        raw = pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
        texts = decoded(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pieces)
        return pa.record_batch({"doc_id": docs.column(0), "n_tokens": np.diff(ends).astype(np.int64), "ids": raw, "decoded": texts})

    return run


def decoded(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Each id joined to its piece; the pieces of a list, with a blank between."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.flatten())), " ")


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 300_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Equal to the tokenizer's encoding without special tokens of its own, and to its
    decoding with them kept. Null counts as empty: no ids, and decoded is empty.
    Repeated rows are each encoded. An empty table gives no rows. Other columns of
    ``docs`` are not read. The tokenizer's file is read on the driver only; one that
    splits or decodes otherwise than ``SUPPORTED`` raises an error.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(supported(f.read()))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("split"))
    counts = written(rows.mapInArrow(lean(bounded(split_counts(tokenizer), size=4 << 20)), "split int, word string, n long"), "split-words")
    words = written(counts.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(lean(bounded(encoded(tokenizer))), "word string, n long, ids array<int>"), "words")
    level = F.floor(F.log2("n") * 8).cast("int")
    short = F.octet_length("word") <= HOT_BYTES
    least = None
    held = 0
    for r in words.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # a few hundred levels at most
        held += r.words
        if held > hot_words:
            break
        least = r.level
    common = words.where(short & (level >= (least if least is not None else 1 << 30))).select("word", "ids").toArrow().combine_chunks()
    hot = spark.sparkContext.broadcast({c: (common[c].chunk(0) if common[c].num_chunks else pa.array([], common[c].type)) for c in ("word", "ids")})
    own = counts.mapInArrow(lean(bounded(rare(hot))), "split int, word string").join(words.select("word", "ids"), "word")
    columns = "split int, kind int, word string, ids array<int>, blob binary"
    answers = own.select("split", F.lit(0).alias("kind"), "word", "ids", F.lit(None).cast("binary").alias("blob"))
    # a task for each split, as large as the split: hashing whole splits would give some tasks several
    together = answers.unionAll(rows.mapInArrow(lean(bounded(blobs, size=4 << 20)), columns)).repartitionById(max(1, rows.rdd.getNumPartitions()), "split").sortWithinPartitions("split", "kind")
    return together.mapInArrow(lean(bounded(positioned(tokenizer, hot), size=4 << 20)), "doc_id long, n_tokens long, ids binary, decoded string")
