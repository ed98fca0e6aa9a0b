"""Pairwise distances between nodes.

Nodes are cut into blocks of BLOCK; each pair of blocks is one unit of work that
NumPy does on bit planes of the codes, so the work spreads over n^2/BLOCK^2 units and a unit's
memory doesn't depend on n.  Where all codes together are small (checked), every
task gets them and makes whole strips of the matrix; else blocks meet by a shuffle
in tiles of TILE x TILE units, so a block travels n/(BLOCK TILE) times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import BROADCAST_BYTES
from ..plans.params import Matrix, Missing

BLOCK = 256
TILE = 8
#: Cells of a strip of whole rows.
STRIP_CELLS = 1 << 22


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes in the smallest unsigned type that also leaves its largest value free."""
    top = int(codes.max(initial=0))
    return codes.astype(np.uint8 if top < 255 else np.uint16 if top < 65535 else np.uint32)


class Bits:
    """Codes as bit planes, 64 loci a word: ``planes[word, bit]`` and ``present[word]`` (the
    loci that aren't missing) have an element a row, so that a few operations on words compare 64 loci."""

    def __init__(self, codes: np.ndarray, depth: int | None = None):
        self.codes = codes
        self.depth = depth or max(1, int(codes.max(initial=0)).bit_length())
        self.loci = codes.shape[1]
        self.present = _words(codes > 0)
        self.planes = np.stack([_words((codes >> codes.dtype.type(k)) & codes.dtype.type(1)) for k in range(self.depth)], axis=1)

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, at) -> Bits:
        out = object.__new__(Bits)
        out.codes, out.depth, out.loci = self.codes[at], self.depth, self.loci
        out.present, out.planes = np.ascontiguousarray(self.present[:, at]), np.ascontiguousarray(self.planes[:, :, at])
        return out


def _words(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as words of 64: an array (word, row)."""
    padded = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    padded[:, : flags.shape[1]] = flags
    return np.ascontiguousarray(np.packbits(padded, axis=1).view(np.uint64).T)


def _shared(a: Bits, b: Bits, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``a`` and of ``b``: at how many loci both aren't missing, and at how many they
    are equal as well; with ``counted`` (words of loci), at how many of those they are equal, whether missing or not."""
    both, same = np.zeros((2, len(a), len(b)), np.int32)
    depth = max(a.depth, b.depth)
    zero_a, zero_b = np.zeros((len(a), 1), np.uint64), np.zeros((1, len(b)), np.uint64)
    shape = (len(a), len(b))
    differ, other = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
    for w in range(len(a.present)):
        differ[:] = 0
        for k in range(depth):
            np.bitwise_xor(a.planes[w, k][:, None] if k < a.depth else zero_a, b.planes[w, k][None] if k < b.depth else zero_b, out=other)
            np.bitwise_or(differ, other, out=differ)
        np.invert(differ, out=differ)
        if counted is None:
            np.bitwise_and(a.present[w][:, None], b.present[w][None], out=other)
            both += np.bitwise_count(other)
            np.bitwise_and(differ, other, out=differ)
        else:
            np.bitwise_and(differ, counted[w], out=differ)
        same += np.bitwise_count(differ)
    return both, same


def kernel(a: np.ndarray | Bits, b: np.ndarray | Bits, matrix: Matrix, missing: Missing, n_loci: int, penalty: float, everywhere: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Distances (float32) from the rows of ``a`` to the rows of ``b``.

    everywhere: loci present in all rows (for complete deletion).  rarity: by
    locus, the chance that two other rows both have it.
    """
    a, b = (x if isinstance(x, Bits) else Bits(x) for x in (a, b))
    if matrix is Matrix.BLOCKWISE:
        out, wide = np.empty((len(a), len(b)), np.float32), b.codes.astype(np.int64)
        for i, row in enumerate(a.codes.astype(np.int64)):
            delta = row - wide
            run = delta != 0
            starts = run.copy()
            starts[:, 1:] &= delta[:, 1:] != delta[:, :-1]
            d1 = starts.sum(1)
            out[i] = (d1 + (run.sum(1) - d1) * penalty).astype(np.float32)
        return out
    if matrix is Matrix.SYMMETRIC and missing in (Missing.AS_ALLELE, Missing.COMPLETE_DELETE):
        held = np.ones(a.loci, bool) if missing is Missing.AS_ALLELE else everywhere.astype(bool)
        of = n_loci if missing is Missing.AS_ALLELE else np.count_nonzero(held)
        return (of - _shared(a, b, _words(held[None]))[1]).astype(np.float32)
    both, same = _shared(a, b)
    differ = both - same
    if matrix is Matrix.SYMMETRIC:
        if missing is Missing.PAIR_DELETE:
            return (((differ + 0.01) * n_loci) / (both + 0.01)).astype(np.float32)
        return differ.astype(np.float32)
    present = np.bitwise_count(b.present).sum(axis=0, dtype=np.int64)
    gone = present[None, :] - same
    if missing is Missing.ABSOLUTE_DISTANCE:
        return gone.astype(np.float32)
    if matrix is Matrix.ASYMMETRIC_WGMLST:
        gone = differ + (a.codes == 0).astype(np.float64) @ ((b.codes > 0) * rarity).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return (gone * float(n_loci) / present[None, :]).astype(np.float32)


class Made:
    """The matrix of all nodes, made from their codes where it is asked for: ``m[i]`` (a row), ``m[i, j]``,
    ``m[:, j]`` or ``m[:, [j...]]``, and m.block(rows, columns).  It holds the codes alone."""

    def __init__(self, bits: Bits, *rule):
        self.bits, self.rule = bits, rule
        self._numbers: dict[int, tuple[int, list[int]]] = {}

    def __len__(self) -> int:
        return len(self.bits)

    def _whole(self, v: int) -> tuple[int, list[int]]:
        """The words of a node as whole numbers: the loci that it has, and its bit planes."""
        if v not in self._numbers:
            as_int = lambda words: int.from_bytes(words.tobytes(), "little")
            self._numbers[v] = as_int(self.bits.present[:, v]), [as_int(self.bits.planes[:, k, v]) for k in range(self.bits.depth)]
        return self._numbers[v]

    def _cell(self, i: int, j: int) -> np.float32:
        """One asymmetric distance, as kernel() gives it."""
        if i == j:
            return np.float32(0)
        (has_i, a), (has_j, b) = self._whole(i), self._whole(j)
        differ = 0
        for x, y in zip(a, b, strict=True):
            differ |= x ^ y
        present = has_j.bit_count()
        gone = present - (has_i & has_j & ~differ).bit_count()
        if self.rule[1] is Missing.ABSOLUTE_DISTANCE or not present:
            return np.float32(gone if present or self.rule[1] is Missing.ABSOLUTE_DISTANCE else np.nan)
        return np.float32(gone * float(self.rule[2]) / present)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self)

    def column(self, t: int) -> np.ndarray:
        """Asymmetric distances from all nodes to one, as kernel() gives them: they depend on the number of equal loci alone."""
        same, has = None, self.bits.present[:, t]
        for w in range(len(has)):
            differ = self.bits.planes[w, 0] ^ self.bits.planes[w, 0, t]
            other = np.empty_like(differ)
            for k in range(1, self.bits.depth):
                np.bitwise_xor(self.bits.planes[w, k], self.bits.planes[w, k, t], out=other)
                np.bitwise_or(differ, other, out=differ)
            np.invert(differ, out=differ)
            np.bitwise_and(differ, has[w], out=differ)  # what equals a locus that isn't missing isn't missing
            part = np.bitwise_count(differ)
            same = part.astype(np.intp) if same is None else same + part
        present = np.bitwise_count(has).sum(dtype=np.int64)
        gone = present - np.arange(self.bits.loci + 1)
        if self.rule[1] is not Missing.ABSOLUTE_DISTANCE:
            with np.errstate(divide="ignore", invalid="ignore"):
                gone = gone * float(self.rule[2]) / present
        out = gone.astype(np.float32).take(same, mode="clip")
        out[t] = 0
        return out

    def block(self, rows: np.ndarray, cols: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distances from ``rows`` to ``cols`` (places or a slice), 0 for a node and itself."""
        a, b, width = self.bits[rows], self.bits if isinstance(cols, slice) and cols == slice(None) else self.bits[cols], 1 << 16
        step = max(1, min(len(a), width // max(1, len(b))))
        parts = [kernel(a[x : x + step], b[y : y + width], *self.rule) for x in range(0, len(a), step) for y in range(0, len(b), width)]
        across = -(-len(b) // width)
        out = np.vstack([np.hstack(parts[k : k + across]) if across > 1 else parts[k] for k in range(0, len(parts), across)]) if parts else np.zeros((len(a), len(b)), np.float32)
        every = np.arange(len(self))
        out[np.asarray(every[rows])[:, None] == every[cols][None, :]] = 0
        return out

    def __getitem__(self, at) -> np.ndarray:
        one = lambda x: np.array([x]) if isinstance(x, int | np.integer) else x
        i, j = at if isinstance(at, tuple) else (at, slice(None))
        if isinstance(i, int | np.integer) and isinstance(j, int | np.integer) and self.rule[0] is Matrix.ASYMMETRIC:
            return self._cell(int(i), int(j))
        if isinstance(j, int | np.integer) and isinstance(i, slice) and i == slice(None) and self.rule[0] is Matrix.ASYMMETRIC:
            return self.column(int(j))
        out = self.block(one(i), one(j))
        if isinstance(j, int | np.integer):
            out = out[:, 0]
        return out[0] if isinstance(i, int | np.integer) else out


def locus_facts(nodes: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(rows, loci, present in all rows, chance that two rows both have the locus);
    a row a locus reaches the driver."""
    n = nodes.count()
    each = nodes.select(F.posexplode("codes").alias("locus", "code")).groupBy("locus").agg(F.sum((F.col("code") > 0).cast("int")).alias("p")).orderBy("locus").collect()
    p = np.array([r["p"] for r in each], float)
    return n, len(p), p == n, p * (p - 1) / (n * (n - 1)) if n > 1 else np.zeros(len(p))


def _codes(held: pa.Table, n: int, loci: int) -> np.ndarray:
    return packed(held.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, loci) if n else np.zeros((0, loci), np.int32))


def made(nodes: DataFrame, matrix: Matrix = Matrix.SYMMETRIC, missing: Missing = Missing.PAIR_DELETE, penalty: float = 0.5) -> Callable[[], Made] | None:
    """What makes the matrix in a task, or None where all codes take more than BROADCAST_BYTES.
    Nodes are numbered from 0."""
    n, loci, everywhere, rarity = locus_facts(nodes)
    if n * loci * 4 > BROADCAST_BYTES:
        return None
    codes = _codes(nodes.select("node_id", "codes").orderBy("node_id").toArrow(), n, loci)  # BROADCAST_BYTES at most
    return lambda: Made(Bits(codes), matrix, missing, loci, penalty, everywhere, rarity)


def one_task(spark: SparkSession) -> DataFrame:
    """A row in a partition, for a kernel that is one task."""
    return spark.range(0, 1, 1, 1)


def by_strips(spark: SparkSession, n: int, make: Callable[[], Made], each: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, columns: bool = False) -> DataFrame:
    """The rows that ``each`` gives for (ids, their whole rows of the matrix, or columns as rows), over all
    nodes: strips of STRIP_CELLS that are made in place, so the matrix is neither written nor shuffled."""
    step = max(1, min(BLOCK, STRIP_CELLS // max(1, n)))
    count = -(-n // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = make()
        for rows in batches:
            for k in rows.column(0).to_pylist():
                ids = np.arange(k * step, min(n, (k + 1) * step))
                yield each(ids, np.ascontiguousarray(m[:, ids].T) if columns else m.block(ids))

    return spark.range(0, count, 1, max(1, min(count, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """float32 values as doubles, rounded as Spark's round() does (half up, of the shortest text); equal ones once."""
    place = Decimal(1).scaleb(-digits)
    kinds, at = np.unique(values, return_inverse=True)
    told = [x if x != x else float(Decimal(repr(x)).quantize(place, ROUND_HALF_UP)) for x in kinds.astype(np.float64).tolist()]
    return np.array(told, np.float64)[at]


def cheapest_sources(spark: SparkSession, n: int, cost: Callable[[], object]) -> np.ndarray:
    """By node, the first of the sources whose edge to it costs least, by all tasks; ``cost`` makes what has into(target)."""
    count = -(-n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cost()
        for rows in batches:
            for k in rows.column(0).to_pylist():
                ids, found = np.arange(k * BLOCK, min(n, (k + 1) * BLOCK)), []
                for t in ids.tolist():
                    w = c.into(t)
                    w[t] = np.inf
                    found.append(int(np.argmin(w)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.int64())], ["t", "s"])

    made = spark.range(0, count, 1, max(1, min(count, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "t long, s long").toArrow()  # a number a node of one matrix
    out = np.zeros(n, np.int64)
    out[made.column("t").to_numpy()] = made.column("s").to_numpy()
    return out


#: A rectangle of the matrix: first row and column, ids and float32 values by row.
RECTANGLES = "i binary, j binary, d binary"


def rectangles(nodes: DataFrame, matrix: Matrix = Matrix.SYMMETRIC, missing: Missing = Missing.PAIR_DELETE, penalty: float = 0.5, block: int = BLOCK, cells: bool = False, digits: int | None = None) -> DataFrame:
    """The matrix in rectangles (ids of the rows and of the columns, int64, and the
    values, float32, as bytes); with ``cells`` as (i, j, d) rows, and with ``digits`` these
    rounded as Spark's round() does, without those of a node and itself.  Every pair of nodes
    is in one rectangle, each way; no rectangle has more than block x block cells."""
    n, loci, everywhere, rarity = locus_facts(nodes)
    half = matrix in (Matrix.SYMMETRIC, Matrix.BLOCKWISE)
    spark, count = nodes.sparkSession, -(-n // block)

    def unit(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = kernel(a, b, matrix, missing, loci, penalty, everywhere, rarity)
        d[ia[:, None] == ib[None, :]] = 0
        for x, y, z in ((ia, ib, d), (ib, ia, d.T))[: 2 if half and ia[0] != ib[0] else 1]:
            if cells:
                cols = [np.repeat(x, len(y)), np.tile(y, len(x)), np.ascontiguousarray(z).reshape(-1)]
                if digits is not None and x[0] == y[0]:
                    cols = [c[cols[0] != cols[1]] for c in (*cols[:2], cols[2])]
                cols[2] = cols[2].astype(np.float64) if digits is None else rounded(cols[2], digits)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "d"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, np.ascontiguousarray(z))], ["i", "j", "d"])

    schema = "i long, j long, d double" if cells else RECTANGLES
    if n * loci * 4 <= BROADCAST_BYTES:
        held = nodes.select("node_id", "codes").orderBy("node_id").toArrow()  # BROADCAST_BYTES at most
        ids = held.column("node_id").to_numpy()
        codes = _codes(held, n, loci)

        def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = Bits(codes)
            for rows in batches:
                for k in rows.column(0).to_pylist():
                    a = slice(k * block, (k + 1) * block)
                    for m in range(k if half else 0, count):
                        b = slice(m * block, (m + 1) * block)
                        yield from unit(ids[a], bits[a], ids[b], bits[b])

        tasks = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
        turn = F.expr(f"if(id % 2 = 0, id div 2, {count} - 1 - id div 2)")  # long strips of a half matrix beside short ones
        return spark.range(0, count, 1, tasks).select(turn.alias("k")).mapInArrow(strips, schema)

    rows = nodes.groupBy(F.expr(f"cast(node_id div {block} as int)").alias("block"))
    blocks = rows.agg(F.array_sort(F.collect_list(F.struct("node_id", "codes"))).alias("body"))
    tiles = F.sequence(F.lit(0), F.lit(max(0, (count - 1) // TILE)))
    own = F.expr(f"block div {TILE}").cast("int")
    left = blocks.select(own.alias("ta"), F.explode(tiles).alias("tb"), F.lit(0).alias("side"), "block", "body")
    right = blocks.select(F.explode(tiles).alias("ta"), own.alias("tb"), F.lit(1).alias("side"), "block", "body")
    met = left.unionByName(right).filter(F.col("ta") <= F.col("tb") if half else F.lit(True))

    def tile(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for side, k, body in zip(table.column("side").to_pylist(), table.column("block").to_pylist(), table.column("body"), strict=True):
            ids, codes = body.values.flatten()
            sides[side].append((k, ids.to_numpy(zero_copy_only=False), codes.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
        out = [x for ka, ia, a in sides[0] for kb, ib, b in sides[1] if not half or ka <= kb for x in unit(ia, a, ib, b)]
        kinds = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())]) if cells else pa.schema([(c, pa.binary()) for c in "ijd"])
        return pa.Table.from_batches(out, kinds)

    return met.groupBy("ta", "tb").applyInArrow(tile, schema)


def distances(nodes: DataFrame, matrix: Matrix = Matrix.SYMMETRIC, missing: Missing = Missing.PAIR_DELETE, penalty: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(i, j, d) for every ordered pair; d is a float32 value as a double.

    i is the source and j the reference of asymmetric distances.  The diagonal is
    0.  ``complete`` deletion compares loci that all rows have, of those that have
    a gap somewhere.  No nodes give no rows.
    """
    return rectangles(nodes, matrix, missing, penalty, block, cells=True)


def cells_of(rects: DataFrame) -> DataFrame:
    """(i, j, d) rows of rectangles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, d in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                i, j = np.frombuffer(i, np.int64), np.frombuffer(j, np.int64)
                cols = [np.repeat(i, len(j)), np.tile(j, len(i)), np.frombuffer(d, np.float32).astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "d"])

    return rects.mapInArrow(run, "i long, j long, d double")


def row_strip(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of the rows of all rectangles with the same rows, by column."""
    ids = np.frombuffer(table.column("i")[0].as_py(), np.int64)
    parts = sorted((int(np.frombuffer(j, np.int64)[0]), d) for j, d in zip(table.column("j").to_pylist(), table.column("d").to_pylist(), strict=True))
    return ids, np.hstack([np.frombuffer(d, np.float32).reshape(len(ids), -1) for _, d in parts])


def as_matrix(batches: Iterator[pa.RecordBatch], n: int, kind: type = np.float32) -> np.ndarray:
    """The whole matrix (n x n) of rectangles over nodes 0 to n - 1, filled in as they come."""
    out = np.zeros((n, n), kind)
    for rows in batches:
        for i, j, d in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            i, j = np.frombuffer(i, np.int64), np.frombuffer(j, np.int64)
            out[i[0] : i[-1] + 1, j[0] : j[-1] + 1] = np.frombuffer(d, np.float32).reshape(len(i), len(j))
    return out


def distances_sql(nodes: DataFrame, missing: Missing = Missing.PAIR_DELETE) -> DataFrame:
    """Symmetric distances in Spark expressions alone, the plain form that the
    kernel is tested against; it reads each pair's codes cell by cell."""
    n, loci, _, _ = locus_facts(nodes)
    a = nodes.select(F.col("node_id").alias("i"), F.col("codes").alias("x"))
    b = nodes.select(F.col("node_id").alias("j"), F.col("codes").alias("y"))
    cells = F.zip_with("x", "y", lambda x, y: F.struct(((x > 0) & (y > 0)).cast("int").alias("both"), (x != y).cast("int").alias("neq")))
    pair = a.join(b, F.col("i") != F.col("j")).withColumn("z", cells)
    both = F.aggregate("z", F.lit(0), lambda s, c: s + c["both"])
    differ = F.aggregate("z", F.lit(0), lambda s, c: s + c["both"] * c["neq"])
    neq = F.aggregate("z", F.lit(0), lambda s, c: s + c["neq"])
    d = {
        Missing.PAIR_DELETE: ((differ + F.lit(0.01)) * F.lit(float(loci))) / (both + F.lit(0.01)),
        Missing.AS_ALLELE: neq.cast("double"),
        Missing.ABSOLUTE_DISTANCE: differ.cast("double"),
    }[missing]
    out = pair.select("i", "j", d.cast("float").cast("double").alias("d"))
    return out.unionByName(nodes.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0.0).alias("d")))
