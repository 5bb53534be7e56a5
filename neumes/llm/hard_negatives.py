"""Operator 13: hard negatives by product quantisation with stored residual norms.

Vectors become whole numbers. A codebook for each pair of components, fitted on a
bounded sample, turns a vector into one byte a pair; beside the codes stands the
norm of what each code leaves over. Rows are packed into blocks of some thousand.
Anchors, in blocks of their own, meet every block of rows once in each of two passes.
For that, rows are dealt to shares and anchors to groups of bounded size; a task has a
share and a group: it holds the group's anchors and takes the share's blocks one by one.
So anchors are copied once a share, rows once a group, by a shuffle and never by way of
the driver. The passes look for

1. positives: the best rows of an anchor's label;
2. negatives: for each positive, the best rows of other labels within a window of scores.

In a block, tables of products of the anchor with the code words give a score for
each row, which is off by no more than sum |anchor part| * |left over part| (Cauchy-
Schwarz in each pair). A row whose upper bound is below the lower bounds of as many
sure rows as are wanted, or below as many scores met before, or whose bounds miss the
window, can't be among those asked for; all others are scored exactly, in whole numbers.
So the codebook, and the sample that it was fitted on, decide how many rows are scored
twice but never the result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, limit_batches, written

#: Components beyond this would overflow exact scores.
LARGEST = 1 << 22
_PAIR = 2
_PACKED = "slot long, ids binary, labels binary, vectors binary, codes binary, left binary"


def whole_vectors(rows: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, x (array of int) of the rows that take part, one for each vec_id.

    Rows without id, label or vector, or with a null or non-finite component, take no
    part. The label of a row whose id ``every`` divides is moved on by one, modulo
    ``labels``. Of rows that repeat a vec_id, the smallest (label, vector) takes part.
    Vectors of unequal length count as followed by zeros. A component beyond 2**22
    after scaling raises an error, as its scores would not be exact.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    scaled = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    bound = F.when(F.forall(scaled, lambda x: F.abs(x) <= LARGEST), scaled).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>"))
    known = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].alias("label"), rows["embedding"].alias("embedding"))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(sound)
    whole = known.select("vec_id", F.struct(moved.alias("label"), bound.cast("array<int>").alias("x")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.x")


def fit_codebook(sample: np.ndarray, words: int = 256, rounds: int = 6) -> np.ndarray:
    """(pairs, words, 2) code words of a sample of vectors, by k-means from evenly spaced rows; the same for the same sample."""
    books = []
    for at in range(0, sample.shape[1], _PAIR):
        part = sample[:, at : at + _PAIR].astype(np.float64)
        known = np.unique(part, axis=0)
        book = known[np.linspace(0, len(known) - 1, words).astype(int)]
        for _ in range(rounds):
            near = _nearest(part, book)
            count = np.bincount(near, minlength=words)
            for k in range(part.shape[1]):
                book[:, k] = np.where(count > 0, np.bincount(near, part[:, k], words) / np.maximum(count, 1), book[:, k])
        books.append(book)
    return np.stack(books)


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, followed by zeros up to ``width``."""
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _packer(book: np.ndarray, width: int):
    """Packs the rows of one slot: ids, labels, vectors, codes and the norms that the codes leave over."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = _matrix(table["x"].combine_chunks(), width)
        codes, left = np.empty((len(vectors), len(book)), np.uint8), np.empty((len(vectors), len(book)), np.float32)
        for s, words in enumerate(book):
            part = vectors[:, s * _PAIR : s * _PAIR + _PAIR].astype(np.float64)
            codes[:, s] = _nearest(part, words)
            norm = np.sqrt(((part - words[codes[:, s]]) ** 2).sum(1))
            left[:, s] = np.nextafter(norm.astype(np.float32), np.float32(np.inf))  # never below the norm itself
        columns = [np.asarray(table["vec_id"]), np.asarray(table["label"]), vectors.astype(np.int32), codes, left]
        return pa.table([table["slot"][:1], *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], schema=_PACKED_ARROW)

    return run


_PACKED_ARROW = pa.schema([("slot", pa.int64()), *((n, pa.binary()) for n in ("ids", "labels", "vectors", "codes", "left"))])


class Block:
    """The packed rows of a slot."""

    def __init__(self, row: dict, width: int):
        pairs = (width + _PAIR - 1) // _PAIR
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, width).astype(np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, pairs)
        self.left = np.frombuffer(row["left"], np.float32).reshape(-1, pairs).astype(np.float64)

    def bounds(self, anchors: np.ndarray, book: np.ndarray, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, (anchors, rows)."""
        near, off = np.empty((len(anchors), len(self.ids))), np.empty((len(anchors), len(book)))
        tables = []  # for each pair the products of all anchors, a row for each word
        for s, words in enumerate(book):
            part = anchors[:, s * _PAIR : s * _PAIR + _PAIR].astype(np.float64)
            tables.append(words @ part.T)
            off[:, s] = np.sqrt((part * part).sum(1))
        for at in range(0, len(self.ids), tile):  # sums of a tile stay in the processor's cache
            codes = self.codes[at : at + tile]
            sums, looked = np.zeros((len(codes), len(anchors))), np.empty((len(codes), len(anchors)))
            for s, products in enumerate(tables):
                np.take(products, codes[:, s], axis=0, out=looked, mode="clip")
                sums += looked
            near[:, at : at + tile] = sums.T
        slack = (1 + 1e-9) * (off @ self.left.T)
        slack += 1e-9 * (off @ np.sqrt((book * book).sum(2)).max(1))[:, None] + 1e-6  # rounding of the sums
        return near - slack, near + slack


_NONE = np.iinfo(np.int64).min


class Asked:
    """A block of anchors, and for each question about them the first ``most`` rows so far, by score and then id.

    A question is a place of an anchor and the least and the largest score that count. Without
    ``percents``, there is one for each anchor, about other rows of its label; with them, one for
    each different positive score of an anchor, about rows of other labels within these of it.
    """

    def __init__(self, row: dict, width: int, most: int, percents: tuple[int, int] | None):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, width)
        self.same, self.positives, asked = percents is None, [], {}
        if self.same:
            asked = {(k, _NONE, -_NONE - 1): k for k in range(len(self.ids))}
        else:
            for k, found in enumerate(row["positives"]):
                for place, p in enumerate(found):
                    least, largest = -(-percents[0] * p["score"] // 100), percents[1] * p["score"] // 100
                    if least <= largest:  # below zero no score is between
                        self.positives.append((k, place, p["id"], p["score"], asked.setdefault((k, least, largest), len(asked))))
            self.positives = np.array(self.positives, np.int64).reshape(-1, 5)
        self.of, self.least, self.largest = np.array(list(asked), np.int64).reshape(-1, 3).T
        self.found, self.scores = np.zeros((len(asked), most), np.int64), np.full((len(asked), most), _NONE)
        self.count = np.zeros(len(asked), np.int64)

    def meet(self, block: Block, book: np.ndarray) -> None:
        """Takes the rows of a block into account."""
        anchors, most = self.vectors.astype(np.int64), self.scores.shape[1]
        low, high = block.bounds(anchors, book)
        for q, (k, least, largest) in enumerate(zip(self.of, self.least, self.largest)):
            may = high[k] >= max(least, self.scores[q, -1])
            if not self.same:
                may &= low[k] <= largest
            rows = np.flatnonzero(may)
            rows = rows[(block.labels[rows] == self.labels[k]) == self.same]
            rows = rows[block.ids[rows] != self.ids[k]]
            sure = rows if self.same else rows[(low[k, rows] >= least) & (high[k, rows] <= largest)]
            if len(sure) > most:
                bar = np.partition(low[k, sure], len(sure) - most)[len(sure) - most]
                rows = rows[high[k, rows] >= bar]
            if not len(rows):
                continue
            scores = block.vectors[rows] @ anchors[k]
            inside = (scores >= least) & (scores <= largest)
            n = self.count[q]
            ids, scores = np.concatenate([self.found[q, :n], block.ids[rows[inside]]]), np.concatenate([self.scores[q, :n], scores[inside]])
            first = np.lexsort((ids, -scores))[:most]
            self.count[q] = n = len(first)
            self.found[q, :n], self.scores[q, :n] = ids[first], scores[first]

    def answers(self) -> list[np.ndarray]:
        """Columns: of positives the anchor's id, id and score; of negatives the anchor's id, the positive's place, id and score, id and score."""
        there = np.arange(self.scores.shape[1]) < self.count[:, None]
        if self.same:
            q, n = np.nonzero(there)
            return [self.ids[self.of[q]], self.found[q, n], self.scores[q, n]]
        k, place, ids, scores, q = self.positives.T
        p, n = np.nonzero(there[q])
        return [self.ids[k[p]], place[p], ids[p], scores[p], self.found[q[p], n], self.scores[q[p], n]]


def _meeting(book: np.ndarray, width: int, most: int, names: list[str], percents: tuple[int, int] | None = None):
    """Of each cell, whose blocks of anchors come before those of rows, the first ``most`` rows for each question."""

    def run(batches):
        cell, asked = None, []

        def ended():
            for a in asked:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in a.answers()], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from ended()
                    cell, asked = row["cell"], []
                if row["slot"] is None:
                    asked.append(Asked(row, width, most, percents))
                else:
                    block = Block(row, width)
                    for a in asked:
                        a.meet(block, book)
        yield from ended()

    return lean(run)


def _anchor_blocks(anchors: DataFrame, blocks: int, width: int, *more: str) -> DataFrame:
    """Blocks of anchors: ids, labels and vectors as bytes, and further columns as arrays, in the same order.

    Rows are dealt by hash, so a block holds its bounded size but for chance.
    """
    dealt = anchors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.struct("vec_id", "label", "x", *more).alias("a"))
    lists = dealt.groupBy("block").agg(F.sort_array(F.collect_list("a")).alias("a"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a = batch.column(1)[k].values
                part = lambda name: a.field(name)
                vectors = _matrix(part("x"), width).astype(np.int32).tobytes()
                columns = [np.asarray(part("vec_id")).tobytes(), np.asarray(part("label")).tobytes(), vectors]
                yield pa.record_batch([batch.column(0)[k : k + 1], *(pa.array([c], pa.binary()) for c in columns), *(pa.array([part(f).to_pylist()], pa.list_(part(f).type)) for f in more)],
                                      names=["block", "ids", "labels", "vectors", *more])

    kinds = "".join(f", {f} array<{anchors.schema[f].dataType.simpleString()}>" for f in more)
    return lists.mapInArrow(run, f"block long, ids binary, labels binary, vectors binary{kinds}")


def hard_negatives(
    rows: DataFrame, anchors_of: int = 50, positives: int = 5, negatives: int = 3, low_share: int = 50, high_share: int = 95,
    block_rows: int = 4096, block_anchors: int = 256, group_bytes: int = 32 << 20, sample: int = 4096, scale: int = 256, relabel_every: int = 7, labels: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``anchors_of`` divides: a stated query set, which in
    blocks meets all rows in blocks; a task holds some ``group_bytes`` of them and of
    what they have met. ``sample`` bounds the rows on which the codebook is fitted; every
    row is indexed. An anchor without another row of its label, or whose
    windows are empty, has no rows; ties go to the smaller vec_id; equal vectors are
    rows of their own. ``whole_vectors`` says which rows take part. Empty tables give
    an empty result.
    """
    spark = rows.sparkSession
    limit_batches(spark)
    known = written(whole_vectors(rows, scale, relabel_every, labels), "vectors")
    n, width, n_anchors = known.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count_if(F.col("vec_id") % anchors_of == 0)).first()
    width += -width % _PAIR or _PAIR * (width == 0)
    slots, blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_anchors / block_anchors))
    fitted = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()["x"].combine_chunks()
    fitted = fitted.combine_chunks() if isinstance(fitted, pa.ChunkedArray) else fitted
    book = fit_codebook(_matrix(fitted, width) if len(fitted) else np.zeros((1, width), np.int64))
    slotted = known.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(slots)))
    packed = written(slotted.select("slot", "vec_id", "label", "x").groupBy("slot").applyInArrow(_packer(book, width), _PACKED), "blocks")
    anchors = known.filter(F.col("vec_id") % anchors_of == 0)

    held = block_anchors * (4 * width + positives * (80 + 16 * negatives))  # bytes of a block of anchors
    groups = math.ceil(blocks / max(1, group_bytes // held))
    shares = min(slots, max(16, 4 * spark.sparkContext.defaultParallelism))
    cell = lambda share, group: (share * groups + group).cast("int").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(anchor_blocks: DataFrame) -> DataFrame:
        """A cell for each share of the rows and group of anchors: first its blocks of anchors, without slot, then its blocks of rows."""
        asking = anchor_blocks.withColumn("share", every(shares)).withColumn("cell", cell(F.col("share"), F.pmod("block", F.lit(groups)))).drop("block", "share")
        there = packed.withColumn("group", every(groups)).withColumn("cell", cell(F.pmod("slot", F.lit(shares)), F.col("group"))).drop("group")
        together = there.unionByName(asking, allowMissingColumns=True).repartitionById(shares * groups, "cell")
        return together.sortWithinPartitions("cell", F.asc_nulls_first("slot"))

    names = ["anchor_id", "positive_id", "positive_score"]
    near = met(_anchor_blocks(anchors, blocks, width)).mapInArrow(_meeting(book, width, positives, names), "anchor_id long, positive_id long, positive_score long")
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= positives)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asked = written(anchors.join(lists.hint("merge"), F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors")
    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    names = [x.split()[0] for x in schema.split(", ")]
    far = met(_anchor_blocks(asked, blocks, width, "positives")).mapInArrow(_meeting(book, width, negatives, names, (low_share, high_share)), schema)
    ranked = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
