"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). Every window is a
set of shingles, its neighbouring word pairs (a one-word window: the word). Containment of a whole window needs every
one of its shingles, so a prefix of one suffices: the rarest, by the number of documents that hold it. Documents emit
only the places of such shingles with the few words around them; a place and a window that share the shingle are held
against length and position, then compared word by word.

How documents find their places depends on the checked number of shingles: few are written into the expression itself,
more are a table sent to all tasks, to which the places are joined before anything is shuffled; of a table that outgrows
its bound, each part takes another pass over the documents. All three find the same.

Defined results: null or wordless texts have no words and no hits; a null item_id is never listed; of equally rare shingles
the one with the lower hash, then the earlier one, is the prefix; texts and items of any length are compared whole; repeated
rows are judged each on its own; extra columns are carried along (``columns``) or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindra.llm.common import Scratch, holding

#: Everything but ASCII letters and digits and non-ASCII characters cuts words; A-Z is lower-cased afterwards.
WORD_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Shingles that an expression holds, and rows of a table of them that is sent to all tasks (eight bytes each).
INLINE_SHINGLES, SENT_SHINGLES = 60_000, 4_000_000


def words_column(text: Column) -> Column:
    """Words of a text. Only words that hold a capital pay for the translation."""
    raw = F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_CUT), "")
    return F.transform(raw, lambda w: F.when(w == F.lower(w), w).otherwise(F.translate(w, UPPER, LOWER)))


def _listed(values: list[int]) -> str:
    return ", ".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values)


def _with_pairs(df: DataFrame, text: str) -> DataFrame:
    """Adds words, n_words and pairs: the hash of each word with its successor."""
    df = df.withColumn("words", words_column(F.col(text))).withColumn("n_words", F.size("words").cast("long"))
    return df.withColumn("pairs", F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: key (its words joined), win (array), len, items (ids of the items that hold it)."""
    items = benchmark.select("item_id", words_column(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    cut = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("win"))
    return cut.groupBy("win").agg(F.collect_set("item_id").alias("items")).select("win", "items", F.size("win").alias("len"))


def _shingles(windows: DataFrame) -> DataFrame:
    """A row for each shingle of a window: h, off (place in the window), and whether it is a single word."""
    pair = F.transform(F.sequence(F.lit(0), F.col("len") - 2), lambda i: F.struct(F.xxhash64(F.get("win", i), F.get("win", i + 1)).alias("h"), i.alias("off")))
    one = F.array(F.struct(F.xxhash64(F.get("win", F.lit(0))).alias("h"), F.lit(0).alias("off")))
    return windows.select("win", "items", "len", F.inline(F.when(F.col("len") >= 2, pair).otherwise(one))).withColumn("single", F.col("len") == 1)


def _found(single: list[int], double: list[int]) -> Column:
    """Array of (h, p) for the places p (from 1) at which a listed shingle starts."""
    parts = []
    if double:
        parts.append(f"filter(transform(pairs, (h, i) -> if(h IN ({_listed(double)}), struct(h AS h, i + 1 AS p), null)), x -> x IS NOT NULL)")
    if single:
        parts.append(f"filter(transform(transform(words, w -> xxhash64(w)), (h, i) -> if(h IN ({_listed(single)}), struct(h AS h, i + 1 AS p), null)), x -> x IS NOT NULL)")
    if not parts:
        return F.expr("cast(array() as array<struct<h: bigint, p: int>>)")
    return F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")


def _occurrences(rows: DataFrame, values: DataFrame, piece: Callable[[Column], Column], distinct: bool = False) -> DataFrame:
    """``rows`` (with words and pairs) once for each place of a shingle among ``values`` (h, single), with ``at``: its hash h, its
    place p from 1, and what ``piece`` makes of the place. Rows without a place come once, ``at`` null. With ``distinct`` a
    row has each shingle once, p null."""
    values = Scratch(values.select("single", "h").distinct(), "shingles").keep()
    single, n = values.agg(F.max("single"), F.count("*")).first()
    kept = [c for c in rows.columns if c not in ("words", "pairs")]
    made = lambda h, p: F.struct(h.alias("h"), p.alias("p"), piece(p).alias("piece"))
    once = lambda places: F.transform(F.array_distinct(F.transform(places, lambda x: x["h"])), lambda h: made(h, F.lit(None).cast("int"))) if distinct else F.transform(places, lambda x: made(x["h"], x["p"]))
    if n <= INLINE_SHINGLES:
        listed = values.collect()
        found = _found([r.h for r in listed if r.single], [r.h for r in listed if not r.single])
        return rows.select(*kept, F.explode_outer(once(found)).alias("at"))
    places = F.transform("pairs", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))
    if single:
        places = F.concat(places, F.transform("words", lambda w, i: F.struct(F.xxhash64(w).alias("h"), (i + 1).alias("p"))))
    parts, out = -(-n // SENT_SHINGLES), None
    for part in range(parts):
        sent = F.broadcast(values.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part).select(F.col("h").alias("known")).distinct())
        # A place without hash stands for the row itself; it comes with the first part alone.
        own = F.filter(once(places), lambda x: x["h"].isNotNull())
        row = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("p"), piece(F.lit(None).cast("int")).alias("piece")))
        some = rows.select(*kept, F.explode(F.concat(row, own) if part == 0 else own).alias("at"))
        some = some.withColumn("h", F.col("at.h")).join(sent, F.col("h") == F.col("known"), "left").where("known IS NOT NULL OR h IS NULL").drop("h", "known")
        out = some if out is None else out.unionByName(some)
    return out.withColumn("at", F.when(F.col("at.h").isNotNull(), F.col("at")))


def rarest_shingles(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its shingle that the fewest documents hold; windows with a shingle that none holds can't occur and go."""
    shingles = _shingles(windows)
    held = _occurrences(_with_pairs(documents.select("text"), "text").select("words", "pairs"), shingles, lambda p: F.lit(0), distinct=True).where("at IS NOT NULL")
    counts = held.groupBy(F.col("at.h").alias("h")).agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, "h", "left").groupBy("win").agg(F.first("items").alias("items"), F.first("len").alias("len"), F.first("single").alias("single"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("best"))
    return ranked.where("best.df > 0").select("win", "items", "len", "single", "best.h", "best.off")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``documents``: ``columns``, n_words, n_hit (words inside an occurring window), n_items, item_ids
    (sorted as strings), contaminated, spans (start from 1 and length of each occurring window)."""
    kept = Scratch(rarest_shingles(documents, item_windows(benchmark, window)), "windows")
    prefix = kept.read()
    carried = F.struct(*[F.col(c).alias(c) for c in columns])
    base = documents.select(F.monotonically_increasing_id().alias("rid"), carried.alias("row"), F.col("text"))
    rows = _with_pairs(base, "text").select("rid", "row", "n_words", "words", "pairs")
    around = lambda p: F.slice("words", F.greatest(p - (window - 2), F.lit(1)), 2 * window - 2)
    rows = _occurrences(rows, prefix, around)
    rows = rows.select("rid", "row", "n_words", F.coalesce("at.h", "rid").alias("h"), F.col("at.p").alias("p"), F.col("at.piece").alias("ctx"))
    w = prefix.select(F.col("h").alias("wh"), "off", "len", "win", "items")
    start = F.col("p") - F.col("off")
    fits = (F.col("h") == F.col("wh")) & F.col("p").isNotNull() & (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    same = F.slice("ctx", F.greatest(start - F.greatest(F.col("p") - (window - 2), F.lit(1)) + 1, F.lit(1)), F.col("len")) == F.col("win")
    out = rows.join(w, fits & same, "left").select("rid", "row", "n_words", F.when(F.col("len").isNotNull(), F.struct(start.alias("start"), F.col("len").alias("len"))).alias("span"), "items")
    total = out.groupBy("rid").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    total = total.select("row.*", "n_words", covered.alias("n_hit"), ids.alias("item_ids"), "spans")
    return holding(total.select(*columns, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"), "spans"), kept)
