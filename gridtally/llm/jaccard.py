"""N-gram Jaccard join by signature trees.

Texts with equal shingle sets are one class; the classes are joined. Two sets that reach
the threshold share a shingle among the first n - ceil(t n) + 1 of each in any common order.
The order here puts shingles of many documents last, the others by hash, so passages that
many documents share bring nobody together who has enough other shingles. All that meet
the smallest class at some shingle are its group.

A signature tree over a group has sets at its leaves, as a bitmap of hashed shingles, and
above them nodes with the OR of their bitmaps and the range of their sizes. Traversing the tree
against itself drops a pair of nodes when the bits they share, and the shingles that may
hide behind one bit, cannot reach the overlap that their smallest sizes need; pairs that are
linked already by others are dropped as well. What is left of all groups falls into
families, and a second traversal over each family checks pairs on the texts' shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import shielded, written
from gridtally.llm.graph import components
from gridtally.llm.words import dealt, split_words, windows, word_hashes

SHINGLE = 5
THRESHOLD = 80
#: A shingle in more than this share of documents comes last in the order. Which ones do
#: decides how much work there is, never a result; the number of them has this bound too.
FREQUENT = 0.001
MOST_FREQUENT = 2_000_000
#: Shingles that a task sorts at once, that a task of the index holds, and that a task of
#: the last step holds; sets that a task of the tree holds.
CHUNK = 2_000_000
INDEX = 500_000
FAMILY = 4_000_000
GROUP = 4_096
LEAF = FANOUT = 8
PAIRS = 16_384


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a text; of fewer words, all of them are one."""
    h = word_hashes(split_words(text, lower=True))
    return np.unique(windows(h, min(size, len(h)) or 1))


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - (threshold * n + 99) // 100 + 1


def node_of(found: np.ndarray) -> int:
    digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


class Tree:
    """Nodes of every level over sets in order of size: bitmaps, size ranges, hidden counts,
    and whether one of them has a narrow bitmap."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, narrow: np.ndarray):
        self.order = np.lexsort([*bits.T[:2], sizes])
        bits, sizes, narrow = bits[self.order], sizes[self.order], narrow[self.order]
        hidden = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, hidden, narrow)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below[1]), width)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(below[0], at, axis=0),
                    np.minimum.reduceat(below[1], at),
                    np.maximum.reduceat(below[2], at),
                    np.maximum.reduceat(below[3], at),
                    np.logical_or.reduceat(below[4], at),
                )
            )
            width = FANOUT

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
        """Whether a set below i and one below j may reach the threshold."""
        bits, least, most, hidden, narrow = self.levels[level]
        shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
        overlap = shared + np.minimum(hidden[i], hidden[j])
        overlap = np.minimum(overlap, np.minimum(most[i], most[j]))
        return ((100 + threshold) * overlap >= threshold * (least[i] + least[j])) & (narrow[i] | narrow[j])


class Forest:
    """Which sets are linked so far, each labelled by the smallest of its part."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped


def linked_labels(
    sizes: np.ndarray,
    bitmaps: list[bytes],
    side: np.ndarray,
    threshold: int,
    check: Callable[[int, int], bool] | None,
) -> np.ndarray:
    """Labels of linked sets: by their bounds alone, or where ``check`` also agrees.

    ``side`` is -1 throughout, or the two halves of which only pairs across are asked for.
    Bitmaps grow with their sets, and two sets that reach the threshold differ by one doubling
    at most: there is a tree for each width, over its bitmaps and the next wider ones, folded.
    """
    forest = Forest(len(sizes))
    widths = np.array([len(b) for b in bitmaps])
    for width in np.unique(widths):
        chosen = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(chosen) > 1:
            raw = [bitmaps[k] for k in chosen.tolist()]
            bits = np.stack([folded(np.frombuffer(b, np.uint64), width // 8) for b in raw])
            tree = Tree(sizes[chosen], bits, widths[chosen] == width)
            dual_traversal(tree, chosen[tree.order], forest, side, threshold, check)
    return forest.label


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return bits if len(bits) == words else bits[:words] | bits[words:]


def dual_traversal(
    tree: Tree,
    sets: np.ndarray,
    forest: Forest,
    side: np.ndarray,
    threshold: int,
    check: Callable[[int, int], bool] | None,
) -> None:
    """Links in the forest what the tree against itself finds; ``sets`` are its leaves."""
    across = side[sets]
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(level, i[at : at + PAIRS], j[at : at + PAIRS]) for at in range(0, len(i), PAIRS)][::-1]
            continue
        label = forest.label[sets]
        if level == 0:
            apart = (i < j) & (label[i] != label[j]) & ((across[i] < 0) | (across[i] != across[j]))
            i, j = i[apart], j[apart]
            good = tree.possible(0, i, j, threshold)
            i, j = sets[i[good]], sets[j[good]]
            if check is None:
                forest.link(i, j)
                continue
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if forest.label[a] != forest.label[b] and check(a, b):
                    forest.link(np.array([a]), np.array([b]))
            continue
        good = tree.possible(level, i, j, threshold)
        width = LEAF if level == 1 else FANOUT
        at = np.arange(0, len(sets), LEAF * FANOUT ** (level - 1))
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        good &= ~((low[i] == high[i]) & (low[i] == low[j]) & (low[j] == high[j]))
        i, j = i[good], j[good]
        below = len(tree.levels[level - 1][1])
        step = np.arange(width)
        x = (i[:, None] * width + step)[:, :, None]
        y = (j[:, None] * width + step)[:, None, :]
        x, y = (c.ravel() for c in np.broadcast_arrays(x, y))
        ok = (x < below) & (y < below) & (x <= y)
        if ok.any():
            stack.append((level - 1, x[ok], y[ok]))


def stars(nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node of the part, node) for all others of each part."""
    order = np.lexsort([nodes, labels])
    nodes, labels = nodes[order], labels[order]
    first = np.ones(len(nodes), dtype=bool)
    first[1:] = labels[1:] != labels[:-1]
    root = nodes[first][np.cumsum(first) - 1]
    return root[~first], nodes[~first]


def bitmap(found: np.ndarray) -> bytes:
    """Two bits to four for each shingle, 256 at least; the width is a power of two."""
    width = max(256, 1 << (2 * len(found) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def digests(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, node) of documents, and (shingle, times): frequent ones of a chunk."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        n: list[int] = []
        node: list[int | None] = []
        found: list[np.ndarray] = []

        def chunk() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            often = np.asarray(times) >= max(4, FREQUENT * len(n))
            values, times = np.asarray(values, np.uint64)[often], np.asarray(times, np.int64)[often]
            rest = [None] * len(values)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([*ids, pa.nulls(len(values), ids[0].type)]),
                    pa.concat_arrays([*texts, pa.nulls(len(values), pa.int64())]),
                    pa.array([*n, *rest], pa.int64()),
                    pa.array([*node, *rest], pa.int64()),
                    pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(values.view(np.int64))]),
                    pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(times)]),
                ],
                names=["doc_id", "text_hash", "n", "node", "shingle", "times"],
            )
            for part in (ids, texts, n, node, found):
                part.clear()
            return out

        total = 0
        for batch in batches:
            start = 0
            for row, text in enumerate(batch.column(1)):
                mine = shingles(text.as_py(), size)
                n.append(len(mine))
                node.append(node_of(mine) if len(mine) else None)
                found.append(mine)
                total += len(mine)
                if total >= CHUNK:
                    ids.append(batch.column(0).slice(start, row + 1 - start))
                    texts.append(batch.column(2).slice(start, row + 1 - start))
                    start, total = row + 1, 0
                    yield chunk()
            ids.append(batch.column(0).slice(start))
            texts.append(batch.column(2).slice(start))
        if n:
            yield chunk()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        of, f"doc_id {kind}, text_hash long, n long, node long, shingle long, times long"
    )


def frequent_shingles(rows: DataFrame, documents: int) -> np.ndarray:
    """Sorted shingles that count as frequent, at most MOST_FREQUENT of them."""
    counted = (
        rows.where(F.col("shingle").isNotNull())
        .groupBy("shingle")
        .agg(F.sum("times").alias("times"))
        .where(F.col("times") >= FREQUENT * documents / 2)
        .orderBy(F.desc("times"), "shingle")
        .limit(MOST_FREQUENT)
        .select("shingle")
        .toArrow()
    )
    return np.sort(counted.column(0).to_numpy().view(np.uint64))


def features(docs: DataFrame, frequent: np.ndarray, size: int, threshold: int) -> DataFrame:
    """doc_id, text_hash, node, n, bits and prefix of every document with words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1)):
                found = shingles(text.as_py(), size)
                if not len(found):
                    continue
                if len(late):
                    often = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
                    ordered = np.concatenate([found[~often], found[often]])
                else:
                    ordered = found
                prefix = ordered[: prefix_length(len(found), threshold)]
                rows.append((at, node_of(found), len(found), bitmap(found), prefix.tobytes()))
            at, *columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(pa.array(at, pa.int64())) for c in (batch.column(0), batch.column(2))],
                    *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ],
                names=["doc_id", "text_hash", "node", "n", "bits", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        of, f"doc_id {kind}, text_hash long, node long, n long, bits binary, prefix binary"
    )


def meetings(sets: DataFrame, postings: int) -> DataFrame:
    """(leader, node): nodes that share a prefix shingle with a leader, the smallest there.

    The index goes to its tasks as one blob for each batch and bucket of shingles.
    """
    buckets = max(64, postings // INDEX)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p.as_py(), np.uint64) for p in batch.column(1)]
            if not prefixes:
                continue
            keys = np.concatenate(prefixes)
            owner = np.repeat(batch.column(0).to_numpy(), [len(p) for p in prefixes])
            order, edges = dealt(keys, buckets)
            keys, owner = keys[order], owner[order]
            used = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int64()),
                    pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
                    pa.array([owner[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
                ],
                names=["bucket", "keys", "nodes"],
            )

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
        order = np.lexsort([nodes, keys])
        keys, nodes = keys[order], nodes[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        leader = nodes[first][np.cumsum(first) - 1]
        other = leader != nodes
        pairs = np.unique(np.stack([leader[other], nodes[other]], axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "node"])

    blobs = sets.select("node", "prefix").mapInArrow(deal, "bucket long, keys binary, nodes binary")
    met = blobs.groupBy("bucket").applyInArrow(meet, "leader long, node long")
    return met.distinct()


def split_groups(rows: DataFrame, key: str, weight: str, room: int) -> DataFrame:
    """Adds task, half and twice to rows (key, node, ...): groups that fit share tasks, others are cut.

    A group beyond ``room`` is cut into blocks; every two blocks meet in a task, and each
    block meets itself. half is -1 where all pairs of a task are asked for.
    """
    sums = written(rows.groupBy(key).agg(F.sum(weight).alias("_sum")), "groups")
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    tasks = max(64, total // room)
    cut = F.ceil(F.col("_sum") / room).cast("int")
    joined = rows.join(sums.select(key, cut.alias("_cut")), key)
    fits = joined.where(F.col("_cut") <= 1).select(
        *rows.columns,
        F.pmod(F.xxhash64(key), F.lit(tasks)).alias("task"),
        F.lit(0).alias("one"),
        F.lit(0).alias("two"),
        F.lit(-1).alias("half"),
    )
    mine = F.pmod(F.xxhash64("node"), F.col("_cut")).cast("int")
    large = joined.where(F.col("_cut") > 1).withColumn("_mine", mine)
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1))).select(
        *rows.columns,
        F.col(key).alias("task"),
        (F.least("_mine", "_other") + 1).alias("one"),
        (F.greatest("_mine", "_other") + 1).alias("two"),
        F.when(F.col("_mine") == F.col("_other"), -1).otherwise((F.col("_mine") > F.col("_other")).cast("int")).alias("half"),
    )
    return fits.unionByName(large)


def by_key(table: pa.Table, key: str) -> Iterator[pa.Table]:
    table = table.combine_chunks()
    values = table.column(key).to_numpy()
    order = np.argsort(values, kind="stable")
    table, values = table.take(pa.array(order)), values[order]
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(a, b - a)


def edge_table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def possible_links(met: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that span what the trees of all groups cannot rule out."""
    own = met.select("leader").distinct().select("leader", F.col("leader").alias("node"))
    rows = met.unionByName(own).join(sets.select("node", "n", "bits"), "node")
    rows = rows.withColumn("one_set", F.lit(1))

    def traverse(table: pa.Table) -> pa.Table:
        found = []
        for group in by_key(table, "leader"):
            sizes = group.column("n").to_numpy()
            labels = linked_labels(
                sizes, group.column("bits").to_pylist(), group.column("half").to_numpy(), threshold, None
            )
            found.append(stars(group.column("node").to_numpy(), labels))
        return edge_table(found)

    dealt_rows = split_groups(rows, "leader", "one_set", GROUP)
    return dealt_rows.groupBy("task", "one", "two").applyInArrow(traverse, "a long, b long")


def true_links(families: DataFrame, docs: DataFrame, sets: DataFrame, size: int, threshold: int) -> DataFrame:
    """Edges (a, b) that span the pairs which reach the threshold, within each family.

    A set's text is found by its doc_id, or where that is NULL by its hash, once for all copies.
    """
    members = families.join(sets.select("node", "doc_id", "text_hash", "n"), "node").withColumnRenamed("root", "family")
    dealt_rows = split_groups(members, "family", "n", FAMILY)
    named = docs.select("doc_id", "text").join(dealt_rows.drop("text_hash"), "doc_id").drop("doc_id")
    hashed = docs.where(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("text_hash"), "text")
    nameless = dealt_rows.where(F.col("doc_id").isNull()).drop("doc_id")
    texts = named.unionByName(hashed.dropDuplicates(["text_hash"]).join(nameless, "text_hash").drop("text_hash"))

    def traverse(table: pa.Table) -> pa.Table:
        found = []
        for group in by_key(table, "family"):
            # An id may stand for several texts; only that of the node is meant here.
            known: dict[tuple[int, int], np.ndarray] = {}
            halves = group.column("half").to_numpy()
            nodes = group.column("node").to_numpy()
            for node, half, text in zip(nodes.tolist(), halves.tolist(), group.column("text"), strict=True):
                if (node, half) not in known:
                    mine = shingles(text.as_py(), size)
                    if len(mine) and node_of(mine) == node:
                        known[node, half] = mine
            if len(known) < 2:
                continue
            names = np.array([k[0] for k in known], np.int64)
            half = np.array([k[1] for k in known], np.int64)
            values = list(known.values())
            sizes = np.array([len(v) for v in values])
            bits = list(map(bitmap, values))

            def check(a: int, b: int) -> bool:
                x, y = values[a], values[b]
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                return 100 * shared >= threshold * (len(x) + len(y) - shared)

            found.append(stars(names, linked_labels(sizes, bits, half, threshold, check)))
        return edge_table(found)

    return texts.groupBy("task", "one", "two").applyInArrow(traverse, "a long, b long")


def linked_documents(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, text_hash, n and root (of its component; NULL without shingles) of every row."""
    rows = written(digests(docs, size), "digests")
    own = rows.where(F.col("shingle").isNull()).select("doc_id", "text_hash", "n", "node")
    documents = own.where(F.col("n") > 0).count()
    frequent = frequent_shingles(rows, documents)
    sets = written(features(docs, frequent, size, threshold).dropDuplicates(["node"]), "sets")
    postings = (sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    met = written(meetings(sets, postings), "meetings")
    families = components(possible_links(met, sets, threshold))
    linked = components(true_links(families, docs, sets, size, threshold))
    return own.join(linked, "node", "left").select(
        "doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root")
    )


#: Tasks over which the rows of one component are spread when they meet its row.
SALTS = 16


def with_root(placed: DataFrame, per_root: DataFrame) -> DataFrame:
    """Rows that have a root, each with its root's row of ``per_root``; others are left out.

    A component may hold a third of all rows, so its one row is repeated for ``SALTS`` tasks.
    """
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    spread = per_root.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.where(F.col("root").isNotNull()).withColumn("_salt", salt).join(spread, ["root", "_salt"]).drop("_salt")


def jaccard_components(docs: DataFrame, *, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each row of ``docs``.

    Two documents link when ``100 * intersection >= threshold * union`` of their distinct
    shingles of ``size`` words (lower-cased A-Z; fewer words are one shingle). component_id is
    the smallest doc_id that links reach, its own included. A NULL or empty text has no
    shingles, links with nothing and keeps its own doc_id. Repeated rows link with each
    other. A NULL doc_id is a document like others, but never the smallest; a component of
    NULLs alone has a NULL component_id. Other columns are not read. An empty table gives an
    empty result.
    """
    placed = linked_documents(docs, size, threshold)
    placed = written(placed, "linked")
    least = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    alone = placed.where(F.col("root").isNull()).withColumn("component_id", F.col("doc_id"))
    return with_root(placed, least).select(*columns).unionByName(alone.select(*columns))


#: Names beside those of the documents, which are shielded.
HASH = "_llm_text_hash"
MARK = "_llm_mark"
#: Marks that every task may have: about a hundred bytes each as a hash table. More are joined by shuffle.
FEW_MARKS = 500_000


def one_of_each(docs: DataFrame, *, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows, with all columns, of one document for each component: the smallest doc_id's.

    Of equal doc_ids with different texts the one with the smaller text hash stays. Of rows
    equal in both one stays, the first by its other columns as JSON. Rows without shingles
    (a NULL or empty text, one of white space) all stay, repeated or not. NULL ids come after
    all others. Names of other columns do not matter. An empty table gives an empty result.

    Only rows of linked or repeated documents are marked; the marks are narrow.
    """
    rows = shielded(docs, ["doc_id", "text"])
    columns = rows.columns
    placed = written(linked_documents(rows, size, threshold).where(F.col("n") > 0), "linked")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # A row is linked if its component has another row; its root is its own node otherwise.
    least = placed.groupBy("root").agg(F.min(key).alias("first"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    kept = key.eqNullSafe(F.col("first"))
    marks = written(
        with_root(placed, least).select("doc_id", "text_hash", kept.alias("kept")).groupBy("doc_id", "text_hash", "kept").count(),
        "marks",
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct("kept", "count").alias(MARK))
    if marks.count() <= FEW_MARKS:
        marks = F.broadcast(marks)
    hashed = rows.withColumn(HASH, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(HASH) == F.col("_hash"))
    marked = hashed.join(marks, same, "left").where(F.col(MARK).isNull() | F.col(f"{MARK}.kept"))
    alone = F.col(MARK).isNull() | (F.col(f"{MARK}.count") == 1)
    others = F.to_json(F.struct(*[c for c in columns if c not in ("doc_id", "text")], F.lit(0)))
    turn = F.row_number().over(W.partitionBy("doc_id", HASH).orderBy(others))
    repeated = marked.where(~alone).withColumn(MARK, turn).where(F.col(MARK) == 1)
    return marked.where(alone).select(*columns).unionByName(repeated.select(*columns)).toDF(*docs.columns)
