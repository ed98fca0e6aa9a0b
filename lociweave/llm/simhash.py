"""SimHash near-dedup with BK-trees over shards of the fingerprints.

Texts become 64-bit fingerprints; equal fingerprints are one node.  The nodes
are dealt into shards so that any two within the radius meet in one: with m
blocks of bits, two codes that differ in at most r places agree on m - r whole
blocks, so on any part of their bits; there is a shard for every choice of m - r
blocks and every value of as many of their bits as make shards of about
``SHARD_NODES`` nodes.  Inside a shard, nodes go into BK-trees (children keyed by
their Hamming distance to the parent), and all of a shard's queries go down a
tree together: each follows only edges whose key is within the radius of its own
distance.  A shard of more than ``TREE_NODES`` nodes is several trees, and every
tree is sent to each block of the shard's queries, so a tree and its queries are
bounded whatever the shard holds.  (Sending every tree to every executor would
put the fingerprints of all documents on the driver, which nothing bounds; a
shard's tree goes only to the queries that can match it.)

A tree search gives links; what leaves the task is a spanning forest of them
(node, root), never all pairs.  Star contraction in the shared folder then joins the
forests to components; where they have BROADCAST_ROWS links or fewer, one task does.

Texts that share 0.8 of their five-word shingles differ in up to 16 bits, and no
blocks of 64 bits hold those apart.  ``drop_similar`` deals its shards by content
instead: a text is in the shard of each of its ``ANCHORS`` least shingle hashes, and
two texts of similarity s share none of them with probability (1 - s)^ANCHORS at
most.  The trees give the shortest spanning forest of a shard, and the sets of
shingles of each of its edges are compared before it is a link.  Where an edge
failed, the shard is searched again without it and for what is still apart, ROUNDS
times at most.

That leaves out links: by the radius, by the anchors, and behind failed edges.  The
rest is exact.  In one order of all hashes, texts of similarity s have a hash in common
among the first n - ceil(s n) + 1 of each, n being the size of its set (the prefix).  Of
every two texts that share a hash of their prefixes and aren't in one component yet, the
sizes, the places of that hash and the parities of their sets' bits bound what they can
share; where that is enough, their sets are compared.  The order may be any; hashes that
come often in a sample of the texts are last, so few texts share one of a prefix.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, fresh, looked_up, row_key, small_batches, stash

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_NODES = 2048
#: Nodes that a shard should hold, about.
SHARD_NODES = 768
_BITS_AT_ONCE = 1 << 15
_PAIRS_AT_ONCE = 4096

#: Of drop_similar(): words of a shingle, least share in common, bits, shards of a text, searches.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
SIMILAR_RADIUS = 16
ANCHORS = 8
ROUNDS = 3
_FEW = 16
#: Texts that the order of the hashes is taken from, about; how many of them have a hash that
#: comes often, and most such hashes.  Any order gives the same links.
ORDER_TEXTS, OFTEN, MOST_OFTEN = 4096, 4, 50_000
#: Bits of a set's parities: about as many as it has hashes, within these.
_LEAST_BITS, _MOST_BITS = 64, 1 << 14
#: Most of them that go to each shard of a text.
_SHARD_BITS = 256
#: Texts whose sets a worker holds at once.
PIECE_ROWS = 512
#: For rounding, in a comparison of a whole number with a share of others.
_EPS = 1e-6


def shingle_hashes(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of the shingles of a UTF-8 text, in order; none without words."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z and ASCII whitespace only
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text, as an unsigned integer."""
    return _majority(np.array(shingle_hashes(raw, shingle, seed), "<u8"))


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _BITS_AT_ONCE):
        counts += np.unpackbits(h[at : at + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in rows.column(2)), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


class BKTree:
    """Nodes with children by distance; a search visits only edges in the radius."""

    __slots__ = ("codes", "edges")

    def __init__(self, codes: Iterator[int] = ()):
        self.codes: list[int] = []
        self.edges: list[dict[int, int]] = []
        for code in codes:
            self.add(code)

    def add(self, code: int) -> None:
        codes, edges = self.codes, self.edges
        codes.append(code)
        edges.append({})
        new, at = len(codes) - 1, 0
        while at != new:
            d = (codes[at] ^ code).bit_count()
            at = edges[at].setdefault(d, new)

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of a node, places of the queries within the radius of it, their
        distances), for every node that has any.  The queries that reach a node are
        one array."""
        todo = [(0, np.arange(len(queries)))] if self.codes and len(queries) else []
        while todo:
            at, reach = todo.pop()
            d = np.bitwise_count(queries[reach] ^ np.uint64(self.codes[at])).astype(np.int16)
            if (close := d <= radius).any():
                yield at, reach[close], d[close]
            for key, child in self.edges[at].items():
                if len(down := reach[np.abs(d - key) <= radius]):
                    todo.append((child, down))


def _forest(tree: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """(code, root) of the links between a tree and queries, or within the tree.
    Codes that are connected already aren't linked again."""
    bk = BKTree(tree)
    codes = np.array(tree if queries is None else [*tree, *queries], np.uint64)
    asked = codes if queries is None else codes[len(tree) :]
    first = 0 if queries is None else len(tree)
    label = np.arange(len(codes))  # of a code's component: the place of one of it
    for at, hit, _ in bk.near(asked, radius):
        others = np.unique(label[hit + first])
        if len(others) > 1 or others[0] != label[at]:
            label[np.isin(label, others)] = label[at]
    least = codes.copy()
    np.minimum.at(least, label, codes)
    moved = np.flatnonzero(np.bincount(label, minlength=len(codes))[label] > 1)
    return list(zip(codes[moved].tolist(), least[label[moved]].tolist(), strict=True))


def _shortest(tree: list[tuple], queries: list[tuple] | None, radius: int, least: float) -> list[tuple[int, int]]:
    """Of nodes (code, name, component, names it isn't linked to, size of its set), the
    names of the ends of the edges of a shortest spanning forest: of what may be
    linked between a tree and queries, or within the tree.  Sets of which one is below
    ``least`` times the other can't share that much."""
    every = tree if queries is None else [*tree, *queries]
    n, first = len(every), 0 if queries is None else len(tree)
    out = []
    if n <= _FEW:  # few enough to be looked at one by one
        label = [v[2] for v in every]
        fit = lambda i, j: every[i][1] not in (every[j][3] or ()) and min(every[i][4], every[j][4]) >= least * max(every[i][4], every[j][4])
        near = sorted((d, i, j) for i in range(len(tree)) for j in range(max(first, i + 1), n) if (d := (every[i][0] ^ every[j][0]).bit_count()) <= radius and fit(i, j))
        for _, i, j in near:
            if (x := label[i]) != (y := label[j]):
                label = [x if v == y else v for v in label]
                out.append((every[i][1], every[j][1]))
        return out
    far = 255
    between = np.full((len(tree), n - first), far, np.uint8)
    for at, hit, d in BKTree(v[0] for v in tree).near(np.array([v[0] for v in every[first:]], np.uint64), radius):
        between[at, hit] = d
    at_name = {v[1]: j for j, v in enumerate(every[first:])}
    for i, v in enumerate(tree):
        between[i, [at_name[x] for x in v[3] or () if x in at_name]] = far
    sizes = np.array([v[4] for v in every[first:]])
    for at, v in enumerate(tree):  # a row at a time: sizes in 8 bytes for every pair would take several times the distances
        between[at, np.minimum(v[4], sizes) < least * np.maximum(v[4], sizes)] = far
    label = np.unique(np.array([v[2] for v in every], np.int64), return_inverse=True)[1]
    rows, cols = np.arange(len(tree)), np.arange(first, n)
    while True:  # every component takes its shortest edge to another
        between[label[rows][:, None] == label[cols][None, :]] = far
        ends = np.concatenate([rows, between.argmin(axis=0)]), np.concatenate([first + between.argmin(axis=1), cols])
        length = between[ends[0], ends[1] - first]
        order = np.argsort(length, kind="stable")
        order = order[: np.searchsorted(length[order], far)]
        if not len(order):
            return out
        whose = np.concatenate([label[rows], label[cols]])[order]
        for k in np.sort(np.unique(whose, return_index=True)[1]).tolist():  # each component's first, the shortest first
            i, j = int(ends[0][order[k]]), int(ends[1][order[k]])
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((every[i][1], every[j][1]))


def _parities(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: whether their number is odd.  Two sets
    differ in as many hashes at least as these differ in bits."""
    width = min(_MOST_BITS, max(_LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> bytes:
    """The parities that fewer remainders have."""
    if 8 * len(bits) <= width:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width // 8), axis=0).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Least number of hashes that two sets of these parities differ in."""
    if len(x) != len(y):
        x, y = _folded(x, 8 * len(y)), _folded(y, 8 * len(x))
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def _may_share(x: bytes, y: bytes, both: int, least: float) -> bool:
    """Whether two sets of these parities, of ``both`` hashes in sum, may share ``least``."""
    return _differ(x, y) <= both * (1 - least) / (1 + least) + _EPS


def _across(tree: list[tuple], queries: list[tuple] | None, least: float) -> Iterator[tuple[int, int]]:
    """Of nodes (name, component, size of its set, place of the shared hash in its
    order, parities), the names of every two of different components, between a tree
    and queries or within the tree, that may share ``least``, if that hash is the first
    they have in common.  One at a time: they may be the square of the nodes."""
    every = [(v, 0) for v in tree] + [(v, 1) for v in queries or ()]
    every.sort(key=lambda v: v[0][2])
    within, share = queries is None, least / (1 + least)

    def may(i: int, j: int) -> bool:
        (x, _), (y, _) = every[i], every[j]
        return _may_share(x[4], y[4], x[2] + y[2], least)

    if len(every) <= _FEW:
        for i, (x, side) in enumerate(every):
            for j in range(i + 1, len(every)):
                y, other = every[j]
                if x[2] + _EPS < least * y[2]:
                    break
                if (within or side != other) and x[1] != y[1] and min(x[2] - x[3], y[2] - y[3]) + _EPS >= share * (x[2] + y[2]) and may(i, j):
                    yield x[0], y[0]
        return
    component, n, at = (np.array([v[k] for v, _ in every], np.int64) for k in (1, 2, 3))
    side, left = np.array([v[1] for v in every]), n - at
    ends = np.searchsorted(least * n, n + _EPS, "right")
    for i in range(len(every)):
        to = slice(i + 1, ends[i])
        fit = (component[to] != component[i]) & (np.minimum(left[to], left[i]) + _EPS >= share * (n[to] + n[i]))
        if not within:
            fit &= side[to] != side[i]
        for j in np.flatnonzero(fit).tolist():
            if may(i, i + 1 + j):
                yield every[i][0][0], every[i + 1 + j][0][0]


def _search(grow: Callable, columns: int):
    """Over rows (combo, part, i, j, sub, ...) sorted by the first four: of each tree and
    its queries the pairs that ``grow`` gives.  A node is what follows ``sub``, a tuple
    of so many ``columns``, or the fingerprint alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, queries, out = None, [], [], []

        def end() -> Iterator[pa.RecordBatch]:
            if key is None or len(tree) + len(queries) < 2 or not tree:
                return
            if key[2] != key[3] and not queries:
                return
            for pair in grow(tree, None if key[2] == key[3] else queries):
                out.append(pair)
                if len(out) >= _PAIRS_AT_ONCE:
                    yield batch()

        def batch() -> pa.RecordBatch:
            pairs = np.array(out, np.int64 if columns > 1 else np.uint64).view(np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for rows in batches:
            cols = [rows.column(i).to_pylist() for i in range(5)]
            own = [rows.column(5 + i) for i in range(columns)]
            read = [c.to_numpy(zero_copy_only=False).view(np.uint64).tolist() if rows.schema.names[5 + i] == "fp" else c.to_pylist() for i, c in enumerate(own)]
            for c, p, i, j, sub, node in zip(*cols, zip(*read, strict=True) if columns > 1 else read[0], strict=True):
                if key != (c, p, i, j):
                    yield from end()
                    key, tree, queries = (c, p, i, j), [], []
                (tree if sub == i else queries).append(node)
        yield from end()
        if out:
            yield batch()

    return run


def _in_shards(rows: DataFrame, tree_nodes: int, grow: Callable, own: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(a, b) links of rows (combo, part and the columns ``own``) by ``grow``: each shard
    (combo, part) is searched by trees of ``tree_nodes`` nodes at most."""
    counts = rows.groupBy("combo", "part").count().filter(F.col("count") > tree_nodes)
    large = stash(counts.select("combo", "part", F.ceil(F.col("count") / tree_nodes).cast("int").alias("trees")), "large-shards")
    side = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = rows.join(side, ["combo", "part"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("name" if "name" in own else "fp"), F.col("trees")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    rows = rows.select("combo", "part", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", *own)
    dealt = rows.repartition("combo", "part", "i", "j").sortWithinPartitions("combo", "part", "i", "j")
    return dealt.mapInArrow(_search(grow, len(own)), "a long, b long")


def forest(nodes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, blocks: int | None = None) -> DataFrame:
    """(a, b) links that connect the same nodes as all links within the radius.

    nodes: distinct ``fp``.  ``blocks`` (more than the radius) are as few as have
    the bits that the number of nodes asks for, where they aren't given; every
    choice finds every link.
    """
    wanted = max(0, (max(1, nodes.count()) // SHARD_NODES).bit_length())
    if blocks is None:
        blocks = next(m for m in range(radius + 1, 65) if 64 * (m - radius) // m >= wanted)
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits in the radius")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        bits = [b for i in kept for b in range(edges[i], edges[i + 1])]
        masks.append(sum(1 << b for b in bits[:wanted]))
    signed = [m - (1 << 64) if m >> 63 else m for m in dict.fromkeys(masks)]
    parts = F.array(*[F.struct(F.lit(c).alias("combo"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for c, m in enumerate(signed)])
    rows = nodes.select("fp", F.explode(parts).alias("s")).select("s.combo", "s.part", "fp")
    return _in_shards(rows, tree_nodes, partial(_forest, radius=radius))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node that links reach) of links (u, v), for nodes that aren't least."""
    ends = [np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()]) for rows in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    place = place.reshape(2, -1)
    label = np.arange(len(nodes))  # places are in the order of the nodes
    while True:
        x, y = label[place]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["node", "root"])


def components(links: DataFrame, at_once: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node with a link that isn't its root, the least node that
    links reach.  ``at_once`` links or fewer (counted) are closed in one task, which saves
    several shuffles a round; more by alternating large and small stars until nothing
    changes, each round written to the shared folder."""
    edges = stash(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= at_once:
        return stash(edges.coalesce(1).mapInArrow(_closed, "node long, root long"), "closed")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        hooked = big.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.select("u", F.col("m").alias("v")).unionByName(hooked).filter("u <> v").distinct(), "stars")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)


def _classes(docs: DataFrame, shingle: int, radius: int, seed: int) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row."""
    marked = stash(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(forest(nodes.select("fp"), radius))
    owner = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = stash(owner, "owners")
    ids = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    final = owner.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(final, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and are linked like any other; long
    texts count whole.  Null doc_ids are never smallest unless a component has no other.  Rows that
    repeat a doc_id are nodes of their own.  Only doc_id and text are read.  No
    rows give no rows.
    """
    out = _classes(docs, shingle, radius, seed)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest
    doc_id.  All columns are kept.

    A row is found again by doc_id and a hash of its text, so rows that share a
    doc_id or have none are told apart; of a component with only null doc_ids,
    all rows stay, as do equal rows that repeat a doc_id.
    """
    return without(docs, _classes(docs, shingle, radius, seed))


def without(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, text_hash) of ``classes`` that aren't their
    component's smallest.  Other rows aren't shuffled."""
    id_, key = fresh(docs, "gone_id", "gone_key")
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(key))
    return looked_up(docs, stash(gone.distinct(), "near"), "left_anti")


def shingle_set(raw: bytes, shingle: int = SIMILAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of the shingles of a UTF-8 text, sorted."""
    return np.unique(np.array(shingle_hashes(raw, shingle, seed), "<u8"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PIECE_ROWS rows, so that few sets are held at once."""
    for rows in batches:
        for at in range(0, rows.num_rows, PIECE_ROWS):
            yield rows.slice(at, PIECE_ROWS)


def _often(docs: DataFrame, count: int, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that come often in a sample of about ORDER_TEXTS texts, sorted, and in how many."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit("order"), row_key()), F.lit(max(1, round(count / ORDER_TEXTS)))) == 0)
    each = _sets(some, shingle, seed).select(F.explode("hashes").alias("h")).groupBy("h").count()
    top = each.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(MOST_OFTEN).toArrow()
    hashes, counts = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefix(hashes: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set, sorted, the first hashes in the common order: of any other that shares
    ``least`` with it, one is in that set's prefix too."""
    known, counts = often
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: len(hashes) - math.ceil(least * len(hashes) - _EPS) + 1]


def _sketches(docs: DataFrame, shingle: int, seed: int, anchors: int, least: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, fp, the least shingle hashes, their number, the prefix and the
    parities of the rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            fps, first, sizes, prefixes, few, bits = [], [], [], [], [], []
            for t in rows.column(2):
                h = np.array(shingle_hashes(t.as_py() or b"", shingle, seed), "<u8")
                fps.append(_majority(h))
                h = np.unique(h)
                first.append(h[:anchors].view(np.int64))
                sizes.append(len(h))
                prefixes.append(_prefix(h, least, often).view(np.int64) if len(h) else h.view(np.int64))
                bits.append(_parities(h) if len(h) else b"")
                few.append(_folded(bits[-1], _SHARD_BITS))
            longs = pa.list_(pa.int64())
            cols = pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(first, longs), pa.array(sizes, pa.int64()), pa.array(prefixes, longs), pa.array(few, pa.binary()), pa.array(bits, pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *cols], ["doc_id", "text_hash", "fp", "anchors", "n", "prefix", "few", "bits"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, anchors array<long>, n long, prefix array<long>, few binary, bits binary").filter(F.size("anchors") > 0)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those that aren't alone with its value."""
    before, last = None, None  # the value that came last, and its row while it's alone
    for rows in batches:
        if not rows.num_rows:
            continue
        part = rows.column(0).to_numpy()
        same = np.append(part[1:] == part[:-1], False)
        keep = same | np.insert(same[:-1], 0, part[0] == before)
        if last is not None and part[0] == before:
            yield last
        alone = not keep[-1]
        if keep.any():
            yield rows.filter(pa.array(keep))
        before, last = part[-1], rows.slice(rows.num_rows - 1) if alone else None


def _rest(marked: DataFrame, joined: DataFrame, tree_nodes: int, least: float) -> DataFrame:
    """(a, b), a < b, of texts in different components that may share ``least``; every
    such pair that does is among them."""
    each = marked.select(F.col("text_hash").alias("name"), "n", F.posexplode("prefix").alias("at", "part")).select("part", "name", "n", F.col("at").cast("long").alias("at"))
    shared = each.repartition("part").sortWithinPartitions("part").mapInArrow(_together, "part long, name long, n long, at long")
    side = joined.select(F.col("node").alias("name"), "root")
    side = F.broadcast(side) if joined.count() <= BROADCAST_ROWS else side
    shared = stash(shared.join(side, "name", "left").select(F.lit(0).alias("combo"), "part", "name", F.coalesce("root", "name").alias("component"), "n", "at"), "prefixes")
    open_ = shared.groupBy("part").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("part")
    bits = stash(marked.select(F.col("text_hash").alias("name"), "n", "few", "bits").dropDuplicates(["name"]), "parities")
    rows = stash(shared.join(stash(open_, "open"), "part", "left_semi").join(bits.select("name", "few"), "name"), "apart")
    found = _in_shards(rows, tree_nodes, partial(_across, least=least), ("name", "component", "n", "at", "few"))
    found = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "may-share")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            keep = [_may_share(x, y, n, least) for n, x, y in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield rows.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        found = found.join(bits.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    return found.select("a", "b", F.col("n_a") + F.col("n_b"), "bits_a", "bits_b").mapInArrow(look, "a long, b long")


def _sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(name, hashes) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            sets = [shingle_set(t.as_py() or b"", shingle, seed).view(np.int64) for t in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], ["name", "hashes"])

    small_batches(docs.sparkSession)
    return docs.select(row_key().alias("name"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "name long, hashes array<long>")


def _compared(links: DataFrame, docs: DataFrame, nodes: DataFrame, least: float, shingle: int, seed: int) -> DataFrame:
    """a, b and whether the two texts are alike, by their whole sets of shingles."""
    ends = links.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    few = nodes.join(ends, F.col("text_hash") == F.col("end"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key"))
    texts = looked_up(docs.select("doc_id", "text"), stash(few, "ends"), "inner")
    sets = stash(_sets(texts, shingle, seed).dropDuplicates(["name"]), "sets")
    both = links.join(sets.select(F.col("name").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common >= F.lit(least) * (F.size("x") + F.size("y") - common)).alias("alike"))


def similar_texts(docs: DataFrame, least: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS, seed: int = SEED, anchors: int = ANCHORS, tree_nodes: int = TREE_NODES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id that links reach) of the
    rows whose text is like another's: ``least`` of their shingles or more.  ``radius``,
    ``anchors`` and ``rounds`` say what the trees find; no link depends on them."""
    often = _often(docs, docs.count(), shingle, seed)
    marked = stash(_sketches(docs, shingle, seed, anchors, least, often), "sketches")
    nodes = marked.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("anchors").alias("anchors"), F.first("n").alias("n"))
    each = nodes.select(F.lit(0).alias("combo"), F.explode("anchors").alias("part"), "fp", F.col("text_hash").alias("name"), "n")
    # written, so that the joins by shard deal both sides themselves and can split a large shard
    shared = stash(each.groupBy("part").count().filter("count > 1").select("part"), "shared")
    anchored = stash(each.join(shared, "part", "left_semi"), "anchored")
    rows = anchored.withColumns({"component": F.col("name"), "apart": F.lit(None).cast("array<long>")})
    alike, apart, joined = None, None, None
    for turn in range(rounds):
        found = _in_shards(rows, tree_nodes, partial(_shortest, radius=radius, least=least), ("fp", "name", "component", "apart", "n")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = stash(_compared(stash(found.distinct(), "nominated"), docs, nodes, least, shingle, seed), "compared")
        good, bad = found.filter("alike").select("a", "b"), found.filter(~F.col("alike")).select("a", "b")
        if joined is not None and good.isEmpty():
            break
        alike, apart = (good, bad) if alike is None else (alike.unionByName(good), apart.unionByName(bad))
        joined = components(alike)
        if turn + 1 == rounds or bad.isEmpty():
            break
        both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        not_linked = both.groupBy(F.col("a").alias("name")).agg(F.collect_list("b").alias("apart"))
        again = stash(anchored.join(not_linked.select("name"), "name", "left_semi").select("part").distinct(), "again")  # shards where an edge failed
        rows = anchored.join(again, "part", "left_semi").join(joined.withColumnRenamed("node", "name"), "name", "left").join(not_linked, "name", "left")
        rows = stash(rows.select("combo", "part", "fp", "name", F.coalesce("root", "name").alias("component"), "apart", "n"), "once-more")
    rest = stash(_rest(marked, joined, tree_nodes, least).join(apart, ["a", "b"], "left_anti"), "rest")
    late = stash(_compared(rest, docs, nodes, least, shingle, seed).filter("alike").select("a", "b"), "late")
    if not late.isEmpty():
        joined = components(alike.unionByName(late))
    member = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    found = stash(marked.join(member, F.col("text_hash") == F.col("node")).select("doc_id", "text_hash", "root"), "members")
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(stash(ids, "least"), "root").select("doc_id", "text_hash", "component_id")


def drop_similar(docs: DataFrame, least: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS, seed: int = SEED, anchors: int = ANCHORS, tree_nodes: int = TREE_NODES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with one document of each component of similar texts: that with the
    smallest doc_id.  All columns are kept.  Texts without words, and components with
    only null doc_ids, stay, as do equal rows that repeat a doc_id; long texts are
    compared whole.  No rows give no rows."""
    return without(docs, similar_texts(docs, least, shingle, radius, seed, anchors, tree_nodes, rounds))
