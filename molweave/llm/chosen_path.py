"""Jaccard join of documents on runs of five words, by chosen paths.

1. Texts with the same words in the same order form a class; one node stands for it, so copies are never compared.
2. A node's set of word runs is embedded by min-wise hashing: SIGNATURE tokens, each (coordinate, value), of which two sets share
   a fraction equal to their similarity.
3. Chosen paths. A run samples a token and puts nodes that share it in one bucket. A bucket of more than BUCKET nodes is split on
   BRANCHES further tokens, sampled by a hash of the bucket's path, and so on down to DEPTH, or until parts are hardly smaller
   than the bucket, which then holds near copies. Two sets of the threshold's similarity
   share a bucket of a run with probability of at least p, so runs are repeated until 1 - (1 - p) ** runs reaches RECALL.
4. Buckets are compared by brute force on the embedding, with a margin of several deviations below the threshold. What is found
   links nodes into groups of candidates; only links to a common neighbour are given out, never all pairs.
5. Groups of candidates are read again and compared in full, by exact similarities of the sets of word runs, so what is returned
   holds no false link. A large bucket or group is cut into tiles and compared tile by tile, so no task holds it whole.
6. A group of more than one tile is compared without its texts. The runs that most of its nodes hold are its core; of each node only
   what it lacks of the core, and what it holds beside it, goes to the tiles: with c runs in the core, two nodes that lack l and m
   of them and share s of what either lists have c - l - m + s runs in common, exactly, whatever the core is. Near copies
   differ from their core in little, so each text is shuffled once and only differences are copied.

Words are those of ``words``: lower-cased letters and digits. A text of one to four words is one run; a text without words (null,
empty) is similar to nothing. Long texts are one set of runs in the task that compares them. Rows that repeat an id are rows of their own, and the smallest id of a
group represents it; of rows that share it, one does. An empty table gives an empty result. Extra columns
are ignored (``jaccard_join``) or passed through (``keep_representatives``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molweave.llm.components import components
from molweave.llm.words import Words, mix, pieces, shingles
from molweave.sources.scratch import stored

SHINGLE = 5
THRESHOLD = 0.8
SIGNATURE = 128
RECALL = 0.9999
BUCKET = 128
BRANCHES = 2
DEPTH = 5
# A part with this share of its bucket makes the bucket dense.
DENSE = 0.5
# Deviations of the embedding's estimate below the threshold that still make a candidate.
MARGIN = 4.5
# Nodes, and words, of a tile.
TILE = 512
TILE_WORDS = 2_000_000
# Nodes of a tile where differences are compared, and rows of a tile that are compared at a time.
WIDE_TILE = 2048
STRIPE = 256
COLUMNS = 4096
SEED = 11

_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FIRST_TOKENS = [int(x) for x in _random.permutation(SIGNATURE)]


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall, if its buckets are split to DEPTH."""
    p = threshold * (1 - (1 - threshold) ** BRANCHES) ** (DEPTH - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    first = words.first_of_row()
    place = np.arange(len(words.hash)) - first[words.row]
    out = []
    for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        spread = mix(words.hash * np.uint64(odd) + mix(place.astype(np.uint64) + np.uint64(odd)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
        out.append(sums[first[1:]] - sums[first[:-1]])
    return out[0], out[1]


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Min-wise hashes of each row's runs of words; rows must all have one."""
    first = np.searchsorted(row, np.arange(rows))
    short = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((rows, SIGNATURE), np.uint32)
    scratch = np.empty_like(short)
    for j in range(SIGNATURE):
        np.bitwise_xor(short, FLIPS[j], out=scratch)
        np.multiply(scratch, FACTORS[j], out=scratch)
        out[:, j] = np.minimum.reduceat(scratch, first)
    return out


def embed(batches):
    """(doc_id, key, high, low, n_words, signature, sketch) of every row that has words; the sketch keeps a byte a token."""
    for piece in pieces(batches, "text"):
        whole = Words(piece.column("text"))
        n = whole.counts()
        some = np.flatnonzero(n)
        if not len(some):
            continue
        high, low = fingerprints(whole)
        row, value = shingles(whole, SHINGLE)
        signature = signatures(np.searchsorted(some, row), value, len(some))
        sketch = signature.astype(np.uint8)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(signature.view(np.int32).ravel()), SIGNATURE)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id").take(pa.array(some)),
                piece.column("key").take(pa.array(some)),
                pa.array(high[some].view(np.int64)),
                pa.array(low[some].view(np.int64)),
                pa.array(n[some].astype(np.int64)),
                lists.cast(pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
            ],
            names=["doc_id", "key", "high", "low", "n_words", "signature", "sketch"],
        )


def embedded(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    schema = "doc_id long, key long, high long, low long, n_words long, signature array<int>, sketch binary"
    return rows.mapInArrow(embed, schema)


def leaf_buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(bucket, node, tiles): buckets of two nodes at least; more than one tile where splitting leaves a bucket large."""
    firsts = [F.struct(F.lit(r).alias("run"), F.get("signature", F.lit(FIRST_TOKENS[r])).alias("value")) for r in range(runs)]
    rooted = nodes.select("node", F.explode(F.array(*firsts)).alias("t"))
    none = F.lit(None).cast("long")
    rows = rooted.select("node", F.xxhash64(F.lit("run"), "t.run", "t.value").alias("path"), none.alias("parent"), none.alias("parent_size"))
    leaves, above, deep = [], None, None

    def leaf(of: DataFrame, buckets: DataFrame) -> None:
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        leaves.append(of.select("node", "path").join(buckets, "path").select(F.col("path").alias("bucket"), "node", tiles.alias("tiles")))

    for depth in range(1, DEPTH + 1):
        rows = stored(rows, "paths")
        counted = rows.groupBy("path").agg(
            F.count("*").alias("size"), F.first("parent").alias("parent"), F.first("parent_size").alias("parent_size")
        )
        sizes = stored(counted.filter("size > 1"), "sizes")
        if above is not None:
            # A bucket that hardly shrinks holds near copies: it is compared as it is, and its parts are not followed.
            dense = sizes.filter((F.col("size") > BUCKET) & (F.col("size") >= DENSE * F.col("parent_size")))
            dense = dense.select(F.col("parent").alias("path"), F.col("parent_size").alias("size")).distinct()
            leaf(above, dense)
            sizes = sizes.join(dense.select(F.col("path").alias("parent")), "parent", "left_anti")
        last = depth == DEPTH
        leaf(rows, (sizes if last else sizes.filter(F.col("size") <= BUCKET)).select("path", "size"))
        large = sizes.filter(F.col("size") > BUCKET).select("path", "size")
        if last or large.isEmpty():
            break
        followed = rows.select("node", "path").join(large, "path")
        if deep is None:
            # The nodes of large buckets are few; deeper levels only read their signatures.
            deep = stored(followed.select("node").distinct().join(nodes.select("node", "signature"), "node"), "deep")
        split = followed.join(deep, "node")
        at = [F.pmod(F.xxhash64("path", F.lit(b)), F.lit(SIGNATURE)).cast("int") for b in range(BRANCHES)]
        tokens = F.array(*[F.struct(a.alias("at"), F.get("signature", a).alias("value")) for a in at])
        above = rows
        rows = split.select("node", "path", "size", F.explode(tokens).alias("t")).select(
            "node",
            F.xxhash64("path", "t.at", "t.value").alias("path"),
            F.col("path").alias("parent"),
            F.col("size").alias("parent_size"),
        )
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def tiled(rows: DataFrame, group: str, node: str, tiles: str = "tiles") -> DataFrame:
    """Rows with a key ``cell`` and a ``side``: every two rows of a group meet in exactly one cell where their sides say so.

    A group of t tiles has a cell for every two tiles; in a cell of two tiles, rows of side 0 meet those of side 1, and in
    the cell of one tile (side 2) all meet.
    """
    own = F.pmod(F.xxhash64(F.lit("tile"), F.col(node)), F.col(tiles)).cast("int")
    placed = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(tiles) - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    cell = F.xxhash64(F.col(group), F.least("_own", "_other"), F.greatest("_own", "_other"))
    return placed.withColumn("cell", cell).withColumn("side", side).drop("_own", "_other", tiles)


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by cell, in tables that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        same = np.flatnonzero(cell != cell[-1])
        cut = int(same[-1]) + 1 if len(same) else 0
        if held and (cut or held[-1].column("cell")[-1].as_py() != cell[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of n things is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def meets(side_left: np.ndarray, side_right: np.ndarray) -> np.ndarray:
    return ((side_left == 2) & (side_right == 2)) | (side_left + side_right == 1)


def sketch_links(batches):
    """(a, b): nodes of a cell whose sketches agree often enough, each linked to the smallest of its like.

    In a cell of two tiles the nodes of one tile are not linked again: only the groups that each tile has by itself are, so a
    large bucket of near copies gives a link for each node and one for each two tiles.
    """
    deviation = math.sqrt(THRESHOLD * (1 - THRESHOLD) / SIGNATURE)
    enough = (THRESHOLD - MARGIN * deviation) * SIGNATURE
    for table in whole_cells(batches):
        table = table.sort_by([("cell", "ascending"), ("node", "ascending")]).combine_chunks()
        cell, node, side = (table.column(c).to_numpy() for c in ("cell", "node", "side"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        lefts, rights = [], []
        left = np.arange(len(cell))
        for distance in range(1, len(cell)):
            left = left[left + distance < len(cell)]
            left = left[cell[left] == cell[left + distance]]
            if not len(left):
                break
            # Compared in parts, so that memory stays small.
            for begin in range(0, len(left), 1 << 15):
                some = left[begin : begin + (1 << 15)]
                alike = some[(sketch[some] == sketch[some + distance]).sum(axis=1) >= enough]
                lefts.append(alike)
                rights.append(alike + distance)
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
        across = side[left] != side[right]
        root = roots_of(len(cell), left[~across], right[~across])
        linked = np.flatnonzero((root != np.arange(len(cell))) & (side == 2))
        pairs = np.unique(np.sort(np.stack([root[left[across]], root[right[across]]], axis=1), axis=1), axis=0)
        pairs = pairs[node[pairs[:, 0]] != node[pairs[:, 1]]]
        first = np.concatenate([root[linked], pairs[:, 0]])
        second = np.concatenate([linked, pairs[:, 1]])
        yield pa.record_batch([pa.array(node[second]), pa.array(node[first])], names=["a", "b"])


def common_runs(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the rows' sets, sizes of the intersections of every two rows)"""
    order = np.lexsort((row, value))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    row, value = row[new], value[new]
    sizes = np.bincount(row, minlength=rows)
    first = np.ones(len(row), bool)
    first[1:] = value[1:] != value[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    row, column = row[shared], np.cumsum(first[shared]) - 1
    common = np.zeros((rows, rows), np.float32)
    # Sorted by value, so each part of the columns is a slice.
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        held = np.zeros((rows, int(column[high - 1]) - begin + 1), np.float32)
        held[row[low:high], column[low:high] - begin] = 1
        common += held @ held.T
    return sizes, common


def exact_links(batches):
    """(node, n_links, root) of the nodes of a cell that have a link in it."""
    for table in whole_cells(batches):
        cell = table.column("cell").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(start, stop - start).combine_chunks().to_batches()[0]
            rows, values, right_text = [], [], []
            done = 0
            for piece in pieces([part], "text"):
                whole = Words(piece.column("text"))
                high, low = fingerprints(whole)
                right_text.append((high.view(np.int64) == piece.column("high").to_numpy()) & (low.view(np.int64) == piece.column("low").to_numpy()))
                row, value = shingles(whole, SHINGLE)
                rows.append(row + done)
                values.append(value)
                done += piece.num_rows
            # A repeated id may bring other texts along, or the same one twice.
            node = part.column("node").to_numpy()
            candidates = np.flatnonzero(np.concatenate(right_text))
            kept = candidates[np.unique(node[candidates], return_index=True)[1]]
            place = np.full(done, -1)
            place[kept] = np.arange(len(kept))
            row, value = place[np.concatenate(rows)], np.concatenate(values)
            sizes, common = common_runs(row[row >= 0], value[row >= 0], len(kept))
            node, side = node[kept], part.column("side").to_numpy()[kept]
            left, right = np.nonzero(np.triu(common, 1) > 0)
            # Whole numbers: common / union >= threshold without rounding.
            union = sizes[left] + sizes[right] - common[left, right].astype(np.int64)
            alike = (10 * common[left, right].astype(np.int64) >= round(10 * THRESHOLD) * union) & meets(side[left], side[right])
            left, right = left[alike], right[alike]
            root = roots_of(len(node), left, right)
            links = np.bincount(left, minlength=len(node)) + np.bincount(right, minlength=len(node))
            some = np.flatnonzero(links)
            yield pa.record_batch(
                [pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[root[some]])], names=["node", "n_links", "root"]
            )


def read_runs(batches):
    """Rows of groups of one tile with their texts; of larger groups with their sets of word runs, where the text is the node's."""
    for piece in pieces(batches, "text"):
        large = piece.column("tiles").to_numpy() > 1
        names = ["node", "root", "tiles", "wide", "members", "high", "low"]
        few = piece.filter(pa.array(~large))
        if few.num_rows:
            columns = [few.column(c) for c in [*names, "text"]]
            yield pa.record_batch([*columns, pa.nulls(few.num_rows, pa.list_(pa.int64()))], names=[*names, "text", "runs"])
        many = piece.filter(pa.array(large))
        if not many.num_rows:
            continue
        whole = Words(many.column("text"))
        high, low = fingerprints(whole)
        row, value = shingles(whole, SHINGLE)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        offsets = np.searchsorted(row[new], np.arange(many.num_rows + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[new].view(np.int64)))
        right = (high.view(np.int64) == many.column("high").to_numpy()) & (low.view(np.int64) == many.column("low").to_numpy())
        columns = [*(many.column(c) for c in names), pa.nulls(many.num_rows, pa.string()), runs]
        yield pa.record_batch(columns, names=[*names, "text", "runs"]).filter(pa.array(right))


def differences(sets: DataFrame) -> DataFrame:
    """(node, root, wide, core, lacking, delta): the size of the group's core, how many of its runs the node lacks, and the
    runs that only one of node and core holds. The core goes to each tile, so no group is joined in one task."""
    runs = sets.select("root", "tiles", "members", F.explode("runs").alias("run"))
    counted = runs.groupBy("root", "run").agg(F.count("*").alias("n"), F.first("tiles").alias("tiles"), F.first("members").alias("members"))
    most = counted.filter("2 * n > members").groupBy("root").agg(F.collect_list("run").alias("core"), F.first("tiles").alias("tiles"))
    spread = most.select("root", "core", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("own"))
    own = F.pmod(F.xxhash64(F.lit("core"), "node"), F.col("tiles")).cast("int")
    met = sets.withColumn("own", own).hint("merge").join(spread, ["root", "own"], "left")
    core = F.coalesce("core", F.array().cast("array<bigint>"))
    parts = met.select(
        "node", "root", "wide", F.size(core).alias("core"), F.array_except(core, "runs").alias("lacks"), F.array_except("runs", core).alias("has")
    )
    return parts.select("node", "root", "wide", "core", F.size("lacks").alias("lacking"), F.concat("lacks", "has").alias("delta"))


def delta_links(batches):
    """(node, n_links, root) of the nodes of a cell that have a link in it, from the differences to their group's core."""
    for table in whole_cells(batches):
        cell = table.column("cell").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(start, stop - start).combine_chunks().to_batches()[0]
            # A repeated id may bring the same text twice.
            part = part.take(pa.array(np.unique(part.column("node").to_numpy(), return_index=True)[1]))
            node, root, side, core, lacking = (part.column(c).to_numpy() for c in ("node", "root", "side", "core", "lacking"))
            n, delta = len(node), part.column("delta")
            listed = delta.value_lengths().to_numpy()
            value = delta.flatten().to_numpy()
            _, common = common_runs(np.repeat(np.arange(n), listed), value, n)
            lacking, core = lacking.astype(np.int64), core.astype(np.int64)
            size = core - lacking + (listed - lacking)
            links, label, place = np.zeros(n, np.int64), np.arange(n), np.arange(n)
            for begin in range(0, n, STRIPE):
                of = slice(begin, min(n, begin + STRIPE))
                both = (core - lacking)[of, None] - lacking[None, :] + common[of].astype(np.int64)
                union = size[of, None] + size[None, :] - both
                alike = 10 * both >= round(10 * THRESHOLD) * union
                alike &= meets(side[of, None], side[None, :]) & (root[of, None] == root[None, :]) & (place[of, None] < place[None, :])
                links[of] += alike.sum(axis=1)
                links += alike.sum(axis=0)
                left, right = np.nonzero(alike)
                label = roots_of(n, np.concatenate([place, left + begin]), np.concatenate([label, right]))
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], names=["node", "n_links", "root"])


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, root, tiles, wide, members): nodes that may be similar to another, by group, with the tiles of a group of texts and
    of a group of differences, and its number of nodes."""
    leaves = tiled(leaf_buckets(nodes, runs_needed()), "bucket", "node")
    sketched = by_cell(leaves.join(nodes.select("node", "sketch"), "node").select("cell", "side", "node", "sketch"))
    candidates = components(sketched.mapInArrow(sketch_links, "a long, b long"))
    grouped = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    sizes = grouped.join(nodes.select("node", "n_words"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    tiles, wide = (F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("w") / TILE_WORDS)).cast("int") for size in (TILE, WIDE_TILE))
    return grouped.join(sizes.select("root", tiles.alias("tiles"), wide.alias("wide"), F.col("n").alias("members")), "root")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, key, root, class_id, n_links, n_copies) of every document; root is null for texts without words."""
    rows = stored(embedded(documents), "embedded")
    same = rows.groupBy("high", "low").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"),
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
    )
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "nodes")

    described = candidate_groups(nodes).join(nodes.select("node", "rep", "high", "low"), "node")
    texts = documents.select(F.col("doc_id").cast("long").alias("_own"), "text")
    # Both sides grow with the corpus, so neither is broadcast at any size.
    read = described.hint("merge").join(texts, described["rep"].eqNullSafe(texts["_own"]))
    columns = "node long, root long, tiles int, wide int, members long, high long, low long"
    held = read.select("node", "root", "tiles", "wide", "members", "high", "low", "text")
    held = stored(held.mapInArrow(read_runs, columns + ", text string, runs array<long>"), "held")
    cells = by_cell(tiled(held.filter("tiles = 1"), "root", "node").select("cell", "side", "node", "high", "low", "text"))
    apart = differences(held.filter("tiles > 1").select("node", "root", "tiles", "wide", "members", "runs"))
    wide = by_cell(tiled(apart, "root", "node", "wide").select("cell", "side", "node", "root", "core", "lacking", "delta"))
    found = "node long, n_links long, root long"
    exact = stored(cells.mapInArrow(exact_links, found).unionByName(wide.mapInArrow(delta_links, found)), "exact")

    degrees = exact.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    hung = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = (
        nodes.select("node", "high", "low", "rep", "n_copies")
        .join(degrees, "node", "left")
        .join(hung, "node", "left")
        .select("high", "low", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    least = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = placed.join(least, "root").select("high", "low", "root", "class_id", "n_links", "n_copies")
    with_words = rows.select("doc_id", "key", "high", "low").join(known, ["high", "low"]).drop("high", "low")
    own = F.col("doc_id").cast("long")
    alone = documents.filter(~has_words(F.col("text"))).select(
        own.alias("doc_id"),
        F.xxhash64("text").alias("key"),
        F.lit(None).cast("long").alias("root"),
        own.alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"),
    )
    return with_words.select(alone.columns).unionByName(alone)


def jaccard_join(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document.

    class_id is the smallest id among all documents linked to it, directly or not; n_links counts the other texts of a
    similarity of THRESHOLD or more, and n_copies the documents with its own words.
    """
    return classes(documents).select("doc_id", "class_id", "n_links", "n_copies")


def keep_representatives(documents: DataFrame) -> DataFrame:
    """The document of the smallest id of each class, with its own columns; texts without words all stay."""
    first = F.min(F.struct("doc_id", "key")).alias("f")
    kept = classes(documents).filter("root IS NOT NULL").groupBy("root").agg(first).select(F.col("f.doc_id").alias("_id"), F.col("f.key").alias("_key"))
    packed = documents.select(
        F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_own_key"), has_words(F.col("text")).alias("_words")
    )
    same = packed["_own"].eqNullSafe(kept["_id"]) & (packed["_own_key"] == kept["_key"])
    # Rows with the same id and text are the same to the choice above; one of them stays.
    order = Window.partitionBy("_own", "_own_key").orderBy("_own")
    chosen = packed.filter("_words").join(kept, same).withColumn("_no", F.row_number().over(order)).filter("_no = 1")
    columns = [F.col(f"_doc.`{c}`").alias(c) for c in documents.columns]
    return chosen.select(*columns).unionByName(packed.filter("NOT _words").select(*columns))
