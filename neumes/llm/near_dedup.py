"""Near-duplicate detection by circulant MinHash, with exact verification.

1. A set of shingles is hashed to 64 bits each. A first permutation spreads it
   over 32 bits; coordinate k of the signature is the least value of a second
   permutation applied to the spread value shifted circularly by k. Two
   permutations make all coordinates.
2. Documents with equal sets form a class, held by its smallest doc_id; only
   class holders go on.
3. ``bands`` bands of ``rows`` coordinates give buckets. Every member is paired
   with the smallest of the first members of its buckets, so pairs grow with
   members, not their square.
4. Pairs are verified on full sets, which stream past the set of their centre; a
   centre with many partners is dealt to several tasks.
5. Links give components. In buckets that still hold several components, members
   are left out that cannot match any other: a set shares at most those of its
   shingles that some other member holds. The others, chained by their buckets to
   families, are compared all with all, exactly, in blocks: block pairs are dealt
   to tasks, which count intersections with matrices and give only links that
   join two components. No pair of a bucket that could do so is left out.

At the default 32 bands of 4 rows two documents at the threshold of 0.75 share no
bucket with a chance of 6e-6; of a larger similarity, with less.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, lean, limit_batches, shuffle_partitions, written

#: Odd multipliers: of the words of a shingle, of the two permutations, of the bands.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
SPREAD, FIRST, SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
BLOCK = 1 << 15


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the hash of the whole sequence."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    split = pc.ascii_split_whitespace(trimmed)
    values = split.flatten()
    coded = values.filter(pc.not_equal(values, "")).dictionary_encode()  # a text without words gives one empty part
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    counts = pc.if_else(pc.equal(trimmed, ""), 0, pc.list_value_length(split)).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    words = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(hashed) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        runs = np.zeros(n, np.uint64)
        for i in range(size):
            runs += words[i : i + n] * PLACES[i % len(PLACES)] * np.uint64(2 * (i // len(PLACES)) + 1)
        runs = (runs ^ (runs >> np.uint64(29))) * SPREAD
        runs ^= runs >> np.uint64(32)
    out = []
    for begin, end in zip(ends, ends[1:]):
        if end - begin >= size:
            out.append(np.unique(runs[begin : end - size + 1]))
        elif end > begin:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[begin:end].tobytes(), seed=int(end - begin))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def spread(hashes: np.ndarray) -> np.ndarray:
    """The first permutation, cut to the 32 bits over which the second one is shifted."""
    with np.errstate(over="ignore"):
        x = hashes * SPREAD
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(16)).astype(np.uint32)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row for each set that is not empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= BLOCK):
            total += len(sets[last])
            last += 1
        base = spread(np.concatenate(sets[first:last]))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.int64)
        x, y = np.empty_like(base), np.empty_like(base)
        with np.errstate(over="ignore"):
            for k in range(coordinates):
                np.add(base, np.uint32(k), out=x)  # the circular shift
                np.multiply(x, FIRST, out=x)
                np.right_shift(x, np.uint32(15), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, SECOND, out=x)
                out[first:last, k] = np.minimum.reduceat(x, starts)
        first = last
    return out


def buckets(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = np.arange(bands, dtype=np.uint64)[None, :] * PLACES[0]
        for i in range(rows):
            x = (x ^ parts[:, :, i]) * PLACES[1 + i % 4]
            x ^= x >> np.uint64(31)
    return x.view(np.int64)


def signed(size: int, bands: int, rows: int):
    """Rows (doc_id, n, a, b, buckets); a and b identify the set."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            n = np.array([len(s) for s in sets], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            a, b = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            full = np.flatnonzero(n)
            values = buckets(signatures([sets[i] for i in full], bands * rows), bands, rows)
            ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
            yield pa.record_batch({"doc_id": batch.column(0), "n": n, "a": a.copy(), "b": b.copy(), "buckets": pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))})

    return run


def set_rows(size: int):
    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "items": pa.array([s.tobytes() for s in shingle_sets(batch.column(1), size)], pa.binary())})

    return run


def linked(percent: int):
    """Rows (x, salt, kind, y, items) sorted by these: the centre's sets, then those of its partners; the links."""

    def run(batches):
        key, centre = None, []
        for batch in batches:
            x, salt, kind, y = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for i, items in enumerate(batch.column(4)):
                if (x[i], salt[i]) != key:
                    key, centre = (x[i], salt[i]), []
                items = np.frombuffer(items.as_buffer(), np.uint64)
                if kind[i] == 0:
                    centre.append(items)
                elif any(similar(c, items, percent) for c in centre):
                    found.append((x[i], y[i]))
            yield pa.record_batch({"x": pa.array([p for p, _ in found], pa.int64()), "y": pa.array([q for _, q in found], pa.int64())})

    return run


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, exactly."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough, written."""
    spark = pairs.sparkSession
    salts = pairs.groupBy("x").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    dealt = pairs.join(salts, "x").select("x", F.pmod(F.xxhash64("y"), F.col("salts")).alias("salt"), "y")
    partners = dealt.join(sets, dealt.y == sets.doc_id).select("x", "salt", F.lit(1).alias("kind"), "y", "items")
    centres = salts.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(sets, F.col("x") == sets.doc_id).select("x", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("y"), "items")
    together = centres.unionAll(partners).repartition(shuffle_partitions(spark), "x", "salt").sortWithinPartitions("x", "salt", "kind")
    return written(together.mapInArrow(lean(bounded(linked(percent))), "x long, y long").distinct(), "links")


def items_of(batches):
    """Rows (item, doc_id) of sets."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.record_batch({"item": np.concatenate([*sets, np.empty(0, np.int64)]), "doc_id": ids})


def shareable(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(member, n, cap): the size of a member's set, and how many of its shingles some other member holds too."""
    own = sets.join(members.select(F.col("member").alias("doc_id")).distinct(), "doc_id", "left_semi")
    unique = own.mapInArrow(lean(bounded(items_of)), "item long, doc_id long").groupBy("item").agg(F.count("*").alias("holders"), F.min("doc_id").alias("doc_id")).where("holders = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
    sizes = own.groupBy("doc_id").agg(F.min(F.octet_length("items") / 8).cast("long").alias("n"), F.max(F.octet_length("items") / 8).cast("long").alias("most"))
    return sizes.join(unique, "doc_id", "left").select(F.col("doc_id").alias("member"), "n", F.when(F.col("n") == F.col("most"), F.col("n") - F.coalesce("own", F.lit(0))).otherwise(F.col("most")).alias("cap"))


def possible(n, cap, other_n, other_cap, percent: int) -> "F.Column":
    """Whether sets of these sizes, with so many shingles that others hold, can be similar enough."""
    both = F.least(cap, other_cap)
    return 100 * both >= percent * (n + F.greatest(other_n, both) - both)


def common_counts(sets: list[np.ndarray], dense: int = 16, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of some hundred sets, exactly.

    Items of few sets are counted pair by pair, the others by products of 0/1 matrices.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    items, at, held = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    owner, held_by = owner[order], np.repeat(held, held)
    out = np.zeros((m, m), np.int64)
    for h in range(1, dense + 1):  # an item's owners stand side by side
        group = owner[held_by == h].reshape(-1, h)
        for i in range(h):
            for j in range(h):
                out += np.bincount(group[:, i] * m + group[:, j], minlength=m * m).reshape(m, m)
    many = held_by > dense
    column, owner = np.unique(at[order][many], return_inverse=True)[1], owner[many]
    for first in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        part = (column >= first) & (column < first + columns)
        table = np.zeros((m, columns), np.float32)
        table[owner[part], column[part] - first] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def joining(percent: int):
    """Rows (family, p, q, member, block, component, items) sorted by the first three; links that join components.

    Each key holds two blocks of a family, or one with itself. Of its links, one is
    given for each two components that it joins.
    """

    def run(batches):
        key, rows = None, []

        def links():
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            n = np.array([len(x) for x in sets])
            both = common_counts(sets)
            near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            block, component = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            near &= component[:, None] != component[None, :]
            if key[1] != key[2]:
                near &= block[:, None] != block[None, :]
            root = {c: c for c in component.tolist()}

            def top(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            found = []
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
                a, b = top(rows[i][2]), top(rows[j][2])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((rows[i][0], rows[j][0]))
            return pa.record_batch({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            family, p, q, member, block, component = (batch.column(i).to_pylist() for i in range(6))
            for i, items in enumerate(batch.column(6).to_pylist()):
                if (family[i], p[i], q[i]) != key:
                    if rows:
                        yield links()
                    key, rows = (family[i], p[i], q[i]), []
                rows.append((member[i], block[i], component[i], items))
        if rows:
            yield links()

    return run


def within_families(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join components among members that buckets chain together, written.

    A family is cut into blocks of about ``block`` members, and each pair of blocks is
    one task's work, so no task holds more than two blocks and no pair is shipped.
    """
    spark = rows.sparkSession
    firsts = written(rows.groupBy("bucket").agg(F.min("member").alias("first")), "firsts")
    chained = rows.join(firsts, "bucket").where("member > first").select(F.col("first").alias("x"), F.col("member").alias("y")).distinct()
    family = components(chained, None).select(F.col("doc_id").alias("member"), F.col("component").alias("family"))
    members = rows.select("member", "component").distinct().join(family, "member")
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    keyed = dealt.withColumn("other", other).select("family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "member", "block", "component")
    full = keyed.join(sets, F.col("member") == F.col("doc_id")).select("family", "p", "q", "member", "block", "component", "items")
    together = full.repartition(shuffle_partitions(spark), "family", "p", "q").sortWithinPartitions("family", "p", "q")
    return written(together.mapInArrow(lean(bounded(joining(percent))), "x long, y long"), "joins")


def components(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, component) of all linked documents: the smallest doc_id that each one reaches.

    Each step takes the least label of the neighbours and then the label of the
    label; steps end when none changes. ``labels``: those of an earlier subset of
    the links, to begin with.
    """
    edges = written(links.select("x", "y").unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    now = edges.groupBy(F.col("x").alias("doc_id")).agg(F.least(F.min("y"), F.col("doc_id")).alias("component"))
    if labels is not None:
        now = now.join(labels.withColumnRenamed("component", "before"), "doc_id", "left").select("doc_id", F.least("component", "before").alias("component"))
    now = written(now, "labels")
    while True:
        near = edges.join(now, edges.y == now.doc_id).groupBy(F.col("x").alias("doc_id")).agg(F.min("component").alias("near"))
        step = now.join(near, "doc_id").select("doc_id", "component", F.least("component", "near").alias("next"))
        target = step.select(F.col("doc_id").alias("next"), F.col("next").alias("jump"))
        after = written(step.join(target, "next").select("doc_id", F.least("next", "jump").alias("component"), (F.least("next", "jump") != F.col("component")).alias("changed")), "labels")
        now = after.select("doc_id", "component")
        if after.where("changed").isEmpty():
            return now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, block: int = 512, per_task: int = 256) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but [\\x20\\x09-\\x0D], with A-Z lower-cased. A set
    holds the distinct shingles of ``size`` words; of fewer words, the whole
    sequence as one; without words it is empty and linked with nothing. Documents
    are linked when 100 * intersection >= percent * union, and component_id is the
    smallest doc_id reachable over links. Rows without doc_id are linked with
    nothing: their component_id is null and they are kept. Rows that repeat a
    doc_id are one document, linked if one of its texts is. An empty table gives
    no rows. Other columns of ``docs`` are not read. Shingles are compared by hashes
    of 64 bits.
    """
    limit_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    signs = written(texts.mapInArrow(lean(bounded(signed(size, bands, rows), size=4 << 20)), "doc_id long, n long, a long, b long, buckets array<long>"), "signatures")
    classes = written(signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("holder"), F.min_by("buckets", "doc_id").alias("buckets")), "classes")
    members = classes.select(F.explode("buckets").alias("bucket"), F.col("holder").alias("member"))
    texts = texts.where("doc_id IS NOT NULL")

    def star(rows: DataFrame) -> DataFrame:
        # a table of its own: the engine can then deal the members of a large bucket to several tasks
        centres = written(rows.groupBy("bucket").agg(F.min("member").alias("centre"), F.max("member").alias("last")).where("centre < last").select("bucket", "centre"), "centres")
        return rows.join(centres, "bucket").where("member > centre").select(F.col("centre").alias("x"), F.col("member").alias("y"), "bucket")

    starred = written(star(members), "starred")
    needed = starred.select(F.col("x").alias("doc_id")).unionAll(starred.select(F.col("y").alias("doc_id"))).distinct()
    sets = written(texts.join(needed, "doc_id", "left_semi").mapInArrow(lean(bounded(set_rows(size), size=4 << 20)), "doc_id long, items binary"), "sets")
    # first one centre for each member: most members of a large group are linked by then
    links = verified(starred.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), sets, percent, per_task)
    labels = components(links, None)

    def still_open(rows: DataFrame, caps: DataFrame | None) -> DataFrame:
        """Rows (bucket, member, component) of buckets with several components, without those that can match no other."""
        rows = rows.join(labels, F.col("member") == F.col("doc_id"), "left").select("bucket", "member", F.coalesce("component", "member").alias("component"), *(() if caps is None else ("n", "cap")))
        for _ in range(1 if caps is None else 2):
            bounds = () if caps is None else (F.min("n").alias("least"), F.max("cap").alias("most"))
            sizes = written(rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), *bounds).where("low < high"), "sizes")
            rows = rows.join(sizes, "bucket")
            if caps is not None:
                rows = rows.where(possible(F.col("n"), F.col("cap"), F.col("least"), F.col("most"), percent))
            rows = written(rows.drop("low", "high", "least", "most"), "open")
        return rows

    # members of a bucket are still to be paired with those of another component
    rest = still_open(starred.select("bucket", F.col("y").alias("member")).unionAll(starred.select("bucket", F.col("x").alias("member")).distinct()), None)
    if not rest.isEmpty():
        caps = written(shareable(sets, rest), "shareable")
        rest = still_open(rest.select("bucket", "member").join(caps, "member"), caps)
    if not rest.isEmpty():
        found = within_families(rest.select("bucket", "member", "component"), sets, percent, block)
        labels = components(links.unionAll(found), labels)
    holders = classes.select("a", "b", "holder").join(labels, F.col("holder") == F.col("doc_id"), "left").select("a", "b", F.coalesce("component", "holder").alias("component_id"))
    own = signs.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "a", "b").join(holders, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signs.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: the smallest doc_id of each component."""
    away = near_dedup(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__away")).distinct()
    return docs.join(away, docs[id_col] == away["__away"], "left_anti")
