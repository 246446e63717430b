"""Near-duplicates by exact Jaccard similarity of the sets of five-word shingles.

Texts whose sets have similarity 0.8 or more are linked, classes are closed under links. Fingerprints of 64 bits of such
pairs differ by up to 14 bits, where no cut of the bits selects anything, so the SimHash classes (4 bits) come first as
cheap candidates, each set with the least of its class, and a prefix filter, which misses none, gives the rest: under any
common order of the shingles, two similar sets share one of the first n - ceil(0.8 n) + 1 of each. The order takes shingles
from crowded places of a table of counts last, so that common passages make few candidates; the counts only decide the
order, never what is found. Before their first shared shingle two sets share nothing, so they can share no more than what
both have left from there on: a pair is a candidate where a shared shingle leaves enough. A sketch of each set, its numbers of
shingles by ranges of hashes, bounds the difference of two sets from below: pairs that it shows to differ too much are dropped
where they are made, so texts that share a passage by chance make no rows. The rest is verified on the whole texts.

Rows that share a prefix shingle form a bucket. In the first round a bucket of up to ``SMALL`` sets gives all its pairs, a
larger one the pairs of each set with the ``PIVOTS`` least ones. When the classes of those links are known, the second round gives the
pairs of different classes in large buckets, so a large group of near copies makes no square of pairs; buckets over ``BLOCK``
sets are cut into blocks, whose pairs go to different tasks.

Defined results: words are split at ASCII white space and compared without ASCII case; a text of one to four words is one
shingle, texts without words (null ones too) are equal; rows with a null doc_id are left out; rows that repeat a doc_id with
other texts link that doc_id to the classes of all of them; texts of any length are compared whole; other columns are
ignored. Sets and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindra.llm.common import Scratch, blob_list, bounded_batches, chunks, column_of, free_shuffles, gram_hash, gram_places, heads_of, holding, shuffle_width, whole_groups, words_of
from kindra.llm.simhash import connected, near_duplicates

SHINGLE = 5
#: Places of the table of counts, how many of them a task reports, and the least count that moves a place back.
PLACES, REPORTED, CROWDED = 1 << 20, 4096, 16
SMALL, PIVOTS, BLOCK = 32, 4, 4096
#: Pairs that a task holds before it gives them on.
HELD_PAIRS = 1 << 19
#: Logarithms of the least and the largest number of counters of a sketch, and counters that are compared at a time.
LEAST_BITS, MOST_BITS, COMPARED = 4, 10, 1 << 22


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    texts = [(t or b"").lower() for t in texts]
    words = words_of(texts)
    at = gram_places(words, SHINGLE)
    grams = gram_hash(words.hashes[0], SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(at, words.first)
    sets = [np.unique(grams[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for i, n in enumerate(words.counts().tolist()):
        if 0 < n < SHINGLE:
            sets[i] = np.array([xxhash.xxh64_intdigest(b" ".join(texts[i].split()))], np.uint64)
    return sets


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def similar(overlap, n, m):
    """overlap / (n + m - overlap) >= 0.8, in whole numbers."""
    return 9 * overlap >= 4 * (n + m)


def _sketch(s: np.ndarray) -> bytes:
    """Numbers of shingles in equal ranges of hashes, modulo 16, two to a byte; four to eight to a range, up to 8192 shingles."""
    bits = min(max((len(s) // 4).bit_length() - 1, LEAST_BITS), MOST_BITS)
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 15
    return (n[::2] | n[1::2] << 4).tobytes()


def _counters(sketch: bytes, n: int) -> np.ndarray:
    """A sketch folded to ``n`` counters."""
    pairs = np.frombuffer(sketch, np.uint8)
    return np.stack([pairs & 15, pairs >> 4], axis=1).reshape(n, -1).sum(1, dtype=np.uint8) & 15


def _close(sketches: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of the rows ``x`` and ``y`` leave room for similar sets: those differ by a ninth of their sizes' sum at
    most, and a counter by no more than the sets do in its range."""
    wide = np.array([2 * len(b) for b in sketches.tolist()], np.int64)
    common, keep = np.minimum(wide[x], wide[y]), np.zeros(len(x), np.bool_)
    for n in np.unique(common).tolist():
        of = np.flatnonzero(common == n)
        rows = np.unique(np.concatenate([x[of], y[of]]))
        folded = np.stack([_counters(sketches[r], n) for r in rows.tolist()])
        step = max(1, COMPARED // n)
        for at in range(0, len(of), step):
            some = of[at : at + step]
            apart = (folded[np.searchsorted(rows, x[some])] - folded[np.searchsorted(rows, y[some])]) & 15
            keep[some] = 9 * np.minimum(apart, 16 - apart).sum(1, dtype=np.int64) <= size[x[some]] + size[y[some]]
    return keep


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, name of its set, sketch); rows without doc_id tell the task's crowded places and their counts."""
    counts = np.zeros(PLACES, np.int64)
    for batch in chunks(batches):
        sets = shingle_sets(blob_list(column_of(batch, "text")))
        counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=PLACES)
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), _signed([_name(s) for s in sets]), pa.nulls(len(sets), pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary())], ["doc_id", "name", "n", "sketch"])
    top = np.argpartition(counts, -REPORTED)[-REPORTED:]
    top = top[counts[top] >= CROWDED]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int64()), pa.array(top), pa.array(counts[top]), pa.nulls(len(top), pa.binary())], ["doc_id", "name", "n", "sketch"])


def _levels(marked: DataFrame) -> np.ndarray:
    """A level for each place: 0, or the logarithm of its count."""
    out = np.zeros(PLACES, np.uint8)
    for r in marked.where("doc_id IS NULL").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(16 * REPORTED).collect():
        out[r.name] = int(r.n).bit_length()
    return out


def _prefixes(levels: np.ndarray):
    """(shingle, name, size, place) of the prefix of each set, once a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches):
            parts: list[list[np.ndarray]] = []
            for s in shingle_sets(blob_list(column_of(batch, "text"))):
                name = _name(s)
                if len(s) and name not in seen:
                    seen.add(name)
                    k = prefix_length(len(s))
                    first = s[np.argsort(levels[(s >> np.uint64(44)).astype(np.int64)], kind="stable")[:k]]
                    parts.append([first.view(np.int64), np.full(k, np.uint64(name)).view(np.int64), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["shingle", "name", "size", "place"])

    return emit


def _sizes(sorted_: np.ndarray) -> np.ndarray:
    """Of each value, how many there are of it."""
    sizes = np.diff(heads_of([sorted_]))
    return np.repeat(sizes, sizes)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the buckets of two sets or more, each set once, with the bucket's number of sets. Rows of a small bucket that
    fit no other one are left out, as no pair would come of them."""
    for rows in whole_groups(batches, ("shingle",), ("shingle", "name", "size", "place")):
        rows = [r[heads_of(rows[:2])[:-1]] for r in rows]
        n = _sizes(rows[0])
        size, place = (r.astype(np.int64) for r in rows[2:])
        fits = n > SMALL
        for gap in range(1, SMALL):
            x = np.flatnonzero((n[:-gap] <= SMALL) & (rows[0][:-gap] == rows[0][gap:])) if gap < len(n) else np.zeros(0, np.int64)
            if len(x) == 0:
                break
            x = x[_fit(size[x], place[x], size[x + gap], place[x + gap])]
            fits[x] = fits[x + gap] = True
        rows = [r[fits] for r in rows]
        n = np.where((own := _sizes(rows[0])) > SMALL, n[fits], own)
        yield pa.RecordBatch.from_arrays([*(pa.array(r[n > 1]) for r in rows), pa.array(n[n > 1].astype(np.int64))], ["shingle", "name", "size", "place", "n"])


def _fit(size_x, place_x, size_y, place_y):
    """Whether sets whose first shared shingle is at these places can be similar."""
    return similar(np.minimum(size_x - place_x, size_y - place_y), size_x, size_y)


def _paired(star: bool):
    """Candidate pairs of the buckets, x before y by name: with ``star``, large ones pair each set with the pivots; without,
    all pairs of different roots, of two blocks where the bucket is cut."""

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(found, axis=1)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = heads_of([x, y])[:-1]
        return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["x", "y"])

    def close(fit: list[np.ndarray], name: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        x, y = np.concatenate(fit, axis=1)
        near = _close(sketch, size, x, y)
        return np.stack([name[x[near]], name[y[near]]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for shingle, low, high, name, size, place, root, block, sketch in whole_groups(batches, ("shingle", "low", "high"), ("shingle", "low", "high", "name", "size", "place", "root", "block", "sketch")):
            heads = heads_of([shingle, low, high]).tolist()
            size, place = size.astype(np.int64), place.astype(np.int64)
            fit: list[np.ndarray] = []
            fitting = 0
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                cut = low[a] != high[a]
                for i in range(a, min(b - 1, a + PIVOTS) if star and b - a > SMALL else b - 1):
                    rest = slice(i + 1, b)
                    fits = (root[i] != root[rest]) & _fit(size[i], place[i], size[rest], place[rest])
                    if cut:
                        fits &= block[i] != block[rest]
                    if fits.any():
                        y = np.flatnonzero(fits) + i + 1
                        fit.append(np.stack([np.full(len(y), i), y]))
                        fitting += len(y)
                    if fitting > HELD_PAIRS:
                        found.append(close(fit, name, size, sketch))
                        fit, fitting = [], 0
                    if sum(f.shape[1] for f in found) > HELD_PAIRS:
                        yield distinct(found)
                        found = []
            if fit:
                found.append(close(fit, name, size, sketch))
        if found:
            yield distinct(found)

    return emit


def _bucket_pairs(rows: DataFrame, star: bool, width: int) -> DataFrame:
    """Distinct candidate pairs of (shingle, name, size, place, n, root, sketch). In the first round pairs of large buckets can be
    missing; they come in the second."""
    if star:
        rows = rows.withColumns({"low": F.lit(0), "high": F.lit(0), "block": F.lit(0)})
    else:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("name"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = rows.select("shingle", "low", "high", "name", "size", "place", "root", "block", "sketch").repartition(width, "shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "name")
    return dealt.mapInArrow(_paired(star), "x long, y long").distinct()


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in chunks(batches):
        texts = [t or b"" for t in blob_list(column_of(batch, "text"))]
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "pressed", "bytes"])


def _unpressed(blobs: list[bytes], sizes: list[int]) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(b, n, asbytes=True) for b, n in zip(blobs, sizes, strict=True)]


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has the set that is asked for, each set once a task."""
    seen: set[int] = set()
    for batch in batches:
        names, sizes = column_of(batch, "name").to_pylist(), column_of(batch, "bytes").to_pylist()
        keep = np.zeros(len(names), np.bool_)
        for i, blob in enumerate(column_of(batch, "pressed").to_pylist()):
            if names[i] not in seen:
                own = np.uint64(_name(shingle_sets(_unpressed([blob], sizes[i : i + 1]))[0])).view(np.int64)
                if own == names[i]:
                    seen.add(names[i])
                    keep[i] = True
        yield pa.RecordBatch.from_arrays([column_of(batch, c).filter(pa.array(keep)) for c in ("name", "pressed", "bytes")], ["name", "pressed", "bytes"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, np.bool_)
        for i, (a, n, b, m) in enumerate(zip(*(column_of(batch, c).to_pylist() for c in ("x_text", "x_bytes", "y_text", "y_bytes")), strict=True)):
            x, y = shingle_sets(_unpressed([a, b], [n, m]))
            keep[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.RecordBatch.from_arrays([column_of(batch, c).filter(pa.array(keep)) for c in ("x", "y")], ["x", "y"])


def _texts(docs: DataFrame, nodes: DataFrame, names: DataFrame) -> Scratch:
    """A compressed text of each of ``names``."""
    ids = nodes.join(names.distinct().hint("shuffle_hash"), "name", "left_semi").select("doc_id", "name")
    pressed = docs.mapInArrow(_pressed, "doc_id long, pressed binary, bytes long")
    return Scratch(pressed.join(ids.hint("shuffle_hash"), "doc_id").mapInArrow(_wanted, "name long, pressed binary, bytes long"), "texts")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole texts are similar."""
    side = lambda c: texts.select(F.col("name").alias(c), F.col("pressed").alias(f"{c}_text"), F.col("bytes").alias(f"{c}_bytes"))
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_compared, "x long, y long")


def _class_stars(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Each set with the least set of its SimHash class."""
    own = nodes.join(classes.select("doc_id", "component_id").dropDuplicates(["doc_id"]), "doc_id").select("name", "doc_id", "component_id")
    least = own.groupBy("component_id").agg(F.min_by("name", "doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("component_id", "least")
    pair = own.join(least, "component_id").where("name <> least")
    return pair.select(F.least("name", "least").alias("x"), F.greatest("name", "least").alias("y"))


def jaccard_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and component_id (the least doc_id that links reach) of every row with a doc_id."""
    spark: SparkSession = bounded_batches(documents).sparkSession
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    marked = Scratch(docs.mapInArrow(_marked, "doc_id long, name long, n long, sketch binary"), "marked")
    rows = marked.read().where("doc_id IS NOT NULL")
    nodes = Scratch(rows.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "nodes")
    width = max(shuffle_width(spark), nodes.read().count() // 5_000)
    prefixes = docs.mapInArrow(_prefixes(_levels(marked.read())), "shingle long, name long, size int, place int")
    dealt = prefixes.repartition(width, "shingle").sortWithinPartitions("shingle", "name")
    buckets = Scratch(dealt.mapInArrow(_shared, "shingle long, name long, size int, place int, n long"), "buckets")
    sketches = nodes.read().select("name", "sketch").hint("shuffle_hash")
    stars = _class_stars(nodes.read(), near_duplicates(docs, SHINGLE))
    first = _bucket_pairs(buckets.read().withColumn("root", F.col("name")).join(sketches, "name"), True, width)
    pairs = Scratch(first.unionByName(stars).distinct(), "pairs")
    free_shuffles(spark)
    large = buckets.read().where(F.col("n") > SMALL)
    # Only texts of candidates go on, once for both rounds.
    texts = _texts(docs, nodes.read(), pairs.read().select(F.explode(F.array("x", "y")).alias("name")).unionByName(large.select("name")))
    links = Scratch(_verified(texts.read(), pairs.read()), "similar")
    free_shuffles(spark)
    roots, kept = connected(links.read())
    used = [buckets, pairs, texts, links]
    if not large.isEmpty():
        known = roots.withColumnRenamed("node", "name")
        placed = large.join(known.hint("shuffle_hash"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        more = Scratch(_bucket_pairs(placed.join(sketches, "name"), False, width).join(pairs.read(), ["x", "y"], "left_anti"), "pairs")
        found = Scratch(_verified(texts.read(), more.read()), "similar")
        used += [*kept, more, found]
        roots, kept = connected(links.read().unionByName(found.read()))
    for scratch in used:
        scratch.drop()
    free_shuffles(spark)
    # A doc_id that is repeated with other texts joins their classes.
    several = rows.groupBy("doc_id").agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least <> most").select("doc_id", "least")
    if not several.isEmpty():
        same = rows.join(several, "doc_id").select(F.col("name").alias("x"), F.col("least").alias("y"))
        roots, last = connected(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(same))
        kept = [*kept, *last]
    of_name = nodes.read().drop("sketch").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = of_name.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_name = of_name.select("name", "root").join(least, "root").select("name", "component_id")
    return holding(rows.select("doc_id", "name").join(by_name, "name").select("doc_id", "component_id"), marked, nodes, *kept)
