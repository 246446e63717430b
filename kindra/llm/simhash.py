"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majority hashes of word shingles. Two of them within ``limit`` bits fall into one class, classes
are closed under that relation. With the bits cut into m partitions and thresholds t_1..t_m that sum to limit - m + 1,
two such fingerprints differ by t_i bits or fewer in some partition i (a threshold of -1 leaves a partition out). The
bits are grouped by correlation, counted over all fingerprints; the thresholds are allocated by dynamic programming on
the candidate counts that those statistics predict; the cheapest number of partitions is taken.

Each distinct fingerprint is indexed once a partition, and probes the lower neighbours of its key. Rows that share a
(partition, key) are verified there in numpy, and each task gives back a spanning forest of the links it found, not the
links themselves: classes need no more. A bucket with over ``BLOCK`` indexed fingerprints is cut into blocks, and each pair
of blocks is a task's own work. Classes come from rounds of large-star and small-star steps on the forests.

Defined results: null, empty or wordless texts have fingerprint zero, which is linked like any other; a bit that is set in
exactly half of the hashes is 0; rows with a null doc_id get a fingerprint and the class of other rows with that
fingerprint, else null, and link nothing; repeated rows share a class; texts of any length are hashed whole; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindra.llm.common import Scratch, blob_list, bounded_batches, chunks, column_of, heads_of, holding, shuffle_width, whole_groups

SHINGLE, SEED, LIMIT, BITS = 4, 42, 4, 64
PARTITION_COUNTS = (2, 3, 4, 5)
#: Fingerprints of a bucket that one task takes; those compared with one another at once; the longest table sent to all tasks.
BLOCK, TILE, SENT_ROWS = 8192, 2048, 100_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        grams = [line]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        grams = [line[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    raw, n = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), len(hashes)
    ones = np.concatenate([np.unpackbits(raw[:, j][:, None], axis=1, bitorder="little").sum(0, dtype=np.int64) for j in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(shingle: int, seed: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            known: dict[bytes | None, int] = {}
            out = []
            for text in blob_list(column_of(batch, "text")):
                if text not in known:
                    known[text] = fingerprint(text, shingle, seed)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return emit


# --------------------------------------------------------------------------- partitions and thresholds


@dataclass(frozen=True)
class Plan:
    """Bits of each partition with its threshold."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints set both bit i and bit j, over all of them: a 64 x 64 sum, whatever the input."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = column_of(batch, "fp").to_numpy()
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), pa.array([n] * BITS, pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["bit", "n", "both"])

    rows = fps.select("fp").mapInArrow(emit, "bit long, n long, both array<double>").select("bit", "n", F.posexplode("both").alias("other", "both"))
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows.groupBy("bit", "other").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect():
        both[r.bit, r.other], n = r.both, r.n
    return n, both


def _grouped_bits(n: int, both: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Correlated bits share a partition: each partition starts from the lowest free bit and takes the bits that correlate most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    linked = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros_like(both), where=spread > 1e-9))
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [free.pop(0)]
        while len(own) < width:
            best = max(free, key=lambda b: (round(float(linked[b, own].sum()), 9), -b))
            free.remove(best)
            own.append(best)
        out.append(tuple(sorted(own)))
    return tuple(out)


def _lower_neighbours(width: int, threshold: int) -> int:
    """Upper bound of the keys that one fingerprint probes."""
    from math import comb

    return sum(comb(width, d) for d in range(1, threshold + 1))


def _expected(n: int, both: np.ndarray, bits: tuple[int, ...], threshold: int) -> float:
    """Estimated cost of a threshold: half of the neighbours are probed, and pairs within the threshold are verified. The
    chance of a difference at each bit comes from the counts; correlated bits are credited with their effective number."""
    if threshold < 0:
        return 0.0
    p = np.diag(both)[list(bits)] / max(n, 1)
    cov = both[np.ix_(bits, bits)] / max(n, 1) - np.outer(p, p)
    var = np.diag(cov)
    effective = float(var.sum() ** 2 / max((cov**2).sum(), 1e-12)) if var.sum() > 0 else 0.0
    differ, share = 2 * p * (1 - p), min(1.0, max(effective, 1e-9) / max(len(bits), 1))
    dist = np.array([1.0])
    for q in differ:
        dist = np.convolve(dist, [1 - q * share, q * share])
    pairs = n * n / 2 * float(dist[: threshold + 1].sum())
    return n * (1 + _lower_neighbours(len(bits), threshold) / 2) * 20 + pairs


def allocate(n: int, both: np.ndarray, limit: int = LIMIT) -> Plan:
    """The cheapest thresholds by dynamic programming over the partitions, for each number of partitions; the cheapest of all."""
    best: tuple[float, Plan] | None = None
    for parts in PARTITION_COUNTS:
        bits, budget = _grouped_bits(n, both, parts), limit - parts + 1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in bits:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, limit + 1):
                    new = (cost + _expected(n, both, own, t), (*chosen, t))
                    if used + t not in step or new < step[used + t]:
                        step[used + t] = new
            table = step
        cost, thresholds = table[budget]
        if best is None or cost < best[0]:
            best = (cost, Plan(bits, thresholds))
    return best[1]


# --------------------------------------------------------------------------- candidates


def _packed(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _probes(plan: Plan, index_only: bool = False):
    """(bucket, fp, node, own): own rows are indexed, the others look for partners whose key is the given one."""
    from itertools import combinations

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fps, nodes = column_of(batch, "fp").to_numpy().view(np.uint64), column_of(batch, "node").to_numpy()
                for part, (bits, threshold) in enumerate(zip(plan.partitions, plan.thresholds, strict=True)):
                    if threshold < 0:
                        continue
                    key = _packed(fps, bits)
                    yield _probe_rows(part, key, fps, nodes, True)
                    for distance in range(1, 0 if index_only else threshold + 1):
                        for flips in combinations(range(len(bits)), distance):
                            top = (key >> np.uint64(flips[-1])) & np.uint64(1) == 1  # the partner's key is the lower one
                            mask = np.uint64(sum(1 << f for f in flips))
                            if top.any():
                                yield _probe_rows(part, key[top] ^ mask, fps[top], nodes[top], False)

    return emit


def _probe_rows(part: int, key: np.ndarray, fps: np.ndarray, nodes: np.ndarray, own: bool) -> pa.RecordBatch:
    tagged = (key << np.uint64(4) | np.uint64(part)) if part < 16 else key
    return pa.RecordBatch.from_arrays([pa.array(_spread(tagged).view(np.int64)), pa.array(fps.view(np.int64)), pa.array(nodes), pa.array(np.full(len(key), own))], ["bucket", "fp", "node", "own"])


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers; keys have 60 bits at most, so different buckets stay different."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Forest:
    """Union-find that remembers only the links that joined two classes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def _join_tiles(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], limit: int, forest: Forest) -> None:
    """Joins every pair within the limit of two lists of (fingerprint, node)."""
    for at in range(0, len(left[0]), TILE):
        some, nodes = left[0][at : at + TILE, None], left[1][at : at + TILE]
        for to in range(0, len(right[0]), TILE):
            _join_near(np.bitwise_count(some ^ right[0][None, to : to + TILE]) <= limit, nodes, right[1][to : to + TILE], forest)


def _join_near(near: np.ndarray, left_nodes: np.ndarray, right_nodes: np.ndarray, forest: Forest) -> None:
    """Joins the pairs of a block. In a dense block the least label spreads over the matrix first, so that the slow part takes a link a row, not a link a pair."""
    if near.sum() <= 4 * sum(near.shape):
        left, right = np.nonzero(near)
        pairs = zip(left_nodes[left].tolist(), right_nodes[right].tolist(), strict=True)
    else:
        far, rows, cols = len(left_nodes) + 1, np.arange(len(left_nodes)), np.full(len(right_nodes), len(left_nodes) + 1)
        while True:
            cols = np.minimum(cols, np.where(near, rows[:, None], far).min(0))
            new = np.minimum(rows, np.where(near, cols[None, :], far).min(1))
            if (new == rows).all():
                break
            rows = new
        reached = np.flatnonzero(cols < far)
        pairs = [*zip(left_nodes.tolist(), left_nodes[rows].tolist(), strict=True), *zip(right_nodes[reached].tolist(), left_nodes[cols[reached]].tolist(), strict=True)]
    for x, y in pairs:
        if x != y:
            forest.join(x, y)


_ROW = ("bucket", "low", "high", "fp", "node", "own", "block")


def _verify(limit: int):
    """Over rows sorted by bucket and pair of blocks. Small buckets are compared all at once by their place within the bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for rows in whole_groups(batches, _ROW[:3], _ROW):
            _verify_run(rows, limit, forest)
        links = forest.links()
        x, y = np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    return emit


def _verify_run(rows: list[np.ndarray], limit: int, forest: Forest) -> None:
    bucket, low, high, fp, node, own, block = rows
    fp, heads = fp.view(np.uint64), heads_of(rows[:3])
    sizes = np.diff(heads)
    easy = (sizes <= 64) & (low[heads[:-1]] == high[heads[:-1]])
    small, group = np.repeat(easy, sizes), np.repeat(np.arange(len(sizes)), sizes)
    for gap in range(1, int(sizes[easy].max(initial=1))):
        i = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:]))
        if len(i) == 0:
            break
        i = i[own[i] | own[i + gap]]
        i = i[np.bitwise_count(fp[i] ^ fp[i + gap]) <= limit]
        for x, y in zip(node[i].tolist(), node[i + gap].tolist(), strict=True):
            if x != y:
                forest.join(x, y)
    for k in np.flatnonzero(~easy):
        part = slice(heads[k], heads[k + 1])
        f, n, o, b = fp[part], node[part], own[part], block[part]
        first, last = low[heads[k]], high[heads[k]]
        of = lambda keep: (f[keep], n[keep])  # noqa: B023, E731
        _join_tiles(of(o & (b == first)), of(b == last), limit, forest)
        if first != last:
            _join_tiles(of(o & (b == last)), of(~o & (b == first)), limit, forest)


def _dealt(rows: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Rows at their bucket, sorted; those of buckets with over BLOCK indexed fingerprints once for each pair of blocks that
    theirs is in."""
    hot = index.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    hot = Scratch(hot, "hotbuckets").keep()
    n = hot.count()
    if n:
        rows = rows.join(F.broadcast(hot) if n <= SENT_ROWS else hot.hint("shuffle_hash"), "bucket", "left")
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    else:
        rows = rows.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    return rows.select(*_ROW).repartition(width, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


# --------------------------------------------------------------------------- classes


def connected(links: DataFrame) -> tuple[DataFrame, list[Scratch]]:
    """(node, root) for every node that is not the least of its class. Alternating large-star and small-star steps; the
    least neighbour is an aggregate and is joined back, so a hub's links are never gathered in one task."""
    kept: list[Scratch] = []
    now = Scratch(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "links")
    while True:
        edges = now.read()
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.where("x <> y").distinct()
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        new = Scratch(small.where("x <> y").distinct(), "links")
        a, b = (t.read().agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first() for t in (now, new))
        now.drop()
        now = new
        if a == b:
            kept.append(now)
            return now.read().select(F.col("x").alias("node"), F.col("y").alias("root")), kept


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) of every row."""
    spark: SparkSession = bounded_batches(documents).sparkSession
    marked = Scratch(documents.select("doc_id", "text").mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "fingerprints")
    nodes = Scratch(marked.read().groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    distinct = nodes.read().where("node IS NOT NULL")
    n, both = _bit_statistics(distinct)
    plan = allocate(n, both, limit)
    width = max(shuffle_width(spark), n // 20_000)
    probed = "bucket long, fp long, node long, own boolean"
    dealt = _dealt(distinct.mapInArrow(_probes(plan), probed), distinct.mapInArrow(_probes(plan, True), probed), width)
    found = dealt.mapInArrow(_verify(limit), "x long, y long")
    roots, kept = connected(found)
    known = nodes.read().join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = marked.read().join(known, "fp", "left").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
    return holding(out, marked, nodes, *kept)
