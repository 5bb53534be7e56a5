"""Line deduplication over a sharded minimal perfect hash.

1. Documents give the 128-bit hashes of their line keys, combined within a batch
   and then by an ordinary aggregation: documents, smallest and largest doc_id.
2. All distinct keys are dealt to shards. Each shard becomes a minimal perfect hash
   that indexes arrays of fingerprints, counts of documents and first documents. A
   shard holds about ``shard_lines`` keys, whatever the input.
3. Hashes of all lines travel to their shard and probe its arrays: a line goes where
   the count is 2 or more and the first document is another.
4. Lines that more than 1/(4 shards) of the probes would ask for number less than
   4 x shards; these few are broadcast and answered where the document is.
5. The hashes to drop go back to their documents by doc_id, which are cut there. That
   is the one shuffle of whole texts; lines by themselves never travel.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, limit_batches, shuffle_partitions, utf8, written
from .perfect_hash import LineIndex


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has under ``least`` code points. Bytes: lower() and strip() know ASCII only."""
    key = line.strip().lower()
    n = len(key)
    if n < least or n < 4 * least and n - sum(0x80 <= c < 0xC0 for c in key) < least:
        return None
    return key


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def count_lines(least: int):
    def run(batches):
        for batch in batches:
            seen: dict = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if doc_id is None:
                    continue
                for key in {line_key(x, least) for x in text.split(b"\n")} - {None}:
                    old = seen.get(key)
                    seen[key] = (1, doc_id, doc_id) if old is None else (old[0] + 1, min(old[1], doc_id), max(old[2], doc_id))
            a, b = halves([xxhash.xxh3_128_digest(k) for k in seen])
            n, first, last = np.array(list(seen.values()), np.int64).reshape(-1, 3).T
            yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64), "n": n.copy(), "first": first.copy(), "last": last.copy()})

    return run


def build_shards(batches):
    """Rows sorted by shard; one row (shard, index) for each."""
    shard, parts = None, []

    def index():
        a, b, n, first = (np.concatenate(x) for x in zip(*parts))
        return pa.record_batch({"shard": pa.array([shard], pa.int32()), "kind": pa.array([0], pa.int32()), "index": pa.array([LineIndex.build(a.view(np.uint64), b.view(np.uint64), n, first).to_bytes()], pa.binary()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), "doc_id": pa.array([None], pa.int64())})

    for batch in batches:
        shards = batch.column(0).to_numpy()
        columns = [batch.column(i).to_numpy() for i in range(1, 5)]
        for s in np.unique(shards):
            if s != shard and parts:
                yield index()
                parts = []
            shard = int(s)
            parts.append([x[shards == s] for x in columns])
    if parts:
        yield index()


def probes(least: int, shards: int, hot: set):
    def run(batches):
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if doc_id is not None:
                    found = {xxhash.xxh3_128_digest(k) for k in {line_key(x, least) for x in text.split(b"\n")} - {None}} - hot
                    digests += found
                    ids += [doc_id] * len(found)
            a, b = halves(digests)
            shard = pa.array((a % np.uint64(shards)).astype(np.int32))
            yield pa.record_batch({"shard": shard, "kind": pa.array(np.ones(len(ids), np.int32)), "index": pa.nulls(len(ids), pa.binary()), "a": a.view(np.int64), "b": b.view(np.int64), "doc_id": pa.array(ids, pa.int64())})

    return run


def answer(batches):
    """Rows sorted by shard, its index before its probes; the lines to drop as (doc_id, line)."""
    shard, index = None, None
    for batch in batches:
        shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for s in np.unique(shards):
            rows = np.flatnonzero(shards == s)
            if s != shard:
                shard, index = s, None
            if kinds[rows[0]] == 0:
                index, rows = LineIndex.from_bytes(batch.column(2)[int(rows[0])].as_py()), rows[1:]
            if index is None or not len(rows):
                continue
            a, b, ids = (batch.column(i).take(pa.array(rows)).to_numpy() for i in (3, 4, 5))
            held, count, first = index.probe(a.view(np.uint64), b.view(np.uint64))
            drop = held & (count >= 2) & (first != ids)
            lines = np.stack([a[drop], b[drop]], axis=1)
            yield pa.record_batch({"doc_id": ids[drop], "line": pa.array([x.tobytes() for x in lines], pa.binary())})


def cut(least: int, hot: dict):
    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for doc_id, text, drop in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                lines, drop = text.split(b"\n"), set(drop or ())
                keep = []
                for x in lines:
                    key = line_key(x, least) if doc_id is not None else None
                    digest = xxhash.xxh3_128_digest(key) if key is not None else None
                    if digest is None or digest not in drop and hot.get(digest, doc_id) == doc_id:
                        keep.append(x)
                texts.append(b"\n".join(keep))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, shard_lines: int = 500_000) -> DataFrame:
    """One row per document: doc_id, text (the lines that stay), n_lines, n_dropped.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z
    lower-cased. Keys of at least ``least`` code points found in two documents or
    more lose all their lines except in the smallest doc_id that holds them.
    Null and empty texts count as one empty line. Rows that repeat a doc_id are
    one document; rows without doc_id hold no line and lose none. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    lines = rows.mapInArrow(bounded(count_lines(least)), "a long, b long, n long, first long, last long")
    # rows that repeat a doc_id are one document
    documents = F.when(F.col("first") < F.col("last"), F.col("n")).otherwise(1).alias("n")
    counted = written(lines.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).select("a", "b", documents, "first"), "line-counts")
    keys, asked = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(shuffle_partitions(spark), -(-keys // shard_lines))
    often = max(1000, asked // (4 * shards))
    # fewer than 4 x shards rows, as each has more than 1/(4 shards) of all
    hot = {np.array([r.a, r.b], np.int64).tobytes(): r.first for r in counted.where(F.col("n") > often).select("a", "b", F.col("first").alias("first")).collect()}
    # the remainder of an unsigned number, as numpy takes it
    shard = F.pmod(F.pmod(F.shiftrightunsigned("a", 1), F.lit(shards)) * 2 + F.col("a").bitwiseAND(1), F.lit(shards)).cast("int").alias("shard")
    schema = "shard int, kind int, index binary, a long, b long, doc_id long"
    index = written(counted.select(shard, "a", "b", "n", "first").repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(build_shards, schema), "line-index")
    drops = (
        index.unionAll(rows.mapInArrow(bounded(probes(least, shards, set(hot))), schema))
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(answer, "doc_id long, line binary")
        .groupBy("doc_id")
        .agg(F.collect_set("line").alias("drop"))  # at most a document's own lines
    )
    return rows.join(drops, "doc_id", "left").select("doc_id", "text", "drop").mapInArrow(bounded(cut(least, hot)), "doc_id long, text string, n_lines long, n_dropped long")
