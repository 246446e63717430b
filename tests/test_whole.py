"""Queries over all rows of their tables: what a filter on ids or a cut text would lose."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindra.functions import vectors
from kindra.operators import context, features, retrieval
from kindra.plans.registry import ORACLES, QUERIES


def test_dense_topk_searches_all_other_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label") % 2, "embedding").orderBy("vec_id").collect()
    ids, source, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64)
    got = {}
    for r in QUERIES["dense_topk"](spark, sf_dir).collect():
        got.setdefault((r.s1_id, r.source), {})[r["rank"]] = r.c_id
    assert {s for s, _ in got} == {int(i) for i in ids if i % 50 == 0} and any(c % 10 == 0 for found in got.values() for c in found.values())
    for i in np.flatnonzero(ids % 50 == 0):
        for k in (0, 1):
            others = np.flatnonzero((source == k) & (ids != ids[i]))
            order = others[np.lexsort((ids[others], -np.round(v[others] @ v[i], 6)))][:10]
            assert [got[ids[i], k][n] for n in range(1, len(order) + 1)] == ids[order].tolist()


def test_block_pairs_leaves_large_blocks_to_the_fallback(spark, tmp_path):
    """A part whose only shared key has over 4000 pairs: the SQL has no pair of it."""
    large = [(i, f"name {i}", f"brand {i}", i, "one type") for i in range(128)]
    parts = [*large, (200, "same", "x", 1, "other"), (201, "same", "y", 2, "rest")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in QUERIES["block_pairs"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == con.sql(ORACLES["block_pairs"]).fetchall() == [(200, 201, 1)]


def test_listed_postings_stay_where_their_rows_are(spark):
    """No exchange below the weights, and those of ``tfidf_spaces``; a repeated id is one document."""
    q = spark.createDataFrame([(1, "a b b c"), (2, "d e"), (3, None)], "s1_id long, text string")
    once = [(1, "x", "a b c d"), (2, "y", "b b b e f"), (3, "x", "z"), (4, "y", None)]
    for rows in (once, [*once, (2, "y", "a e")]):
        d = spark.createDataFrame(rows, "c_id long, source string, text string")
        listed, plain = (f(q, d, F.col("text"), vectors.word_terms, 2) for f in (features.listed_spaces, features.tfidf_spaces))
        if rows is once:
            assert "Exchange" not in listed.documents._jdf.queryExecution().executedPlan().toString()
            own = {(r.c_id, r.source, r.term): round(r.w, 9) for r in vectors.exploded(listed.documents, ["c_id", "source"]).where("term IS NOT NULL").collect()}
            asked = plain.documents.join(plain.queries.select("term").distinct(), "term").select("c_id", "source", F.xxhash64("term").alias("term"), "w")
            assert own and own == {(r.c_id, r.source, r.term): round(r.w, 9) for r in asked.collect()}
        else:
            assert sorted(r.c_id for r in listed.documents.collect()) == [1, 2]


def test_name_frequency_joins_pairs_last(spark, sf_dir):
    plan = QUERIES["name_frequency"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" in next(line for line in plan.splitlines() if "Join" in line)


def test_alike_records_are_searched_and_scored_once(spark):
    """Copies cost no pairs of their own until the end, and change nothing: held against records that each stand for themselves."""
    from kindra.functions.normalize import normalize_records
    from kindra.plans import methods
    from kindra.sources.tables import Split

    names = [(f"Oak {w} Ltd", f"{n} High Street 110{n:02d}", "India") for n, w in enumerate(("Mills", "Mill", "Bank", "Banks"), 1)]
    s1 = [(f"S1-{i}", *names[i % 2], "S1") for i in range(6)]
    s23 = [(f"S{2 + i % 2}-{i}", *names[i % 4 if i % 5 else 0], f"S{2 + i % 2}") for i in range(90)] + [("S2-90", None, None, "India", "S2"), ("S2-91", "", None, "India", "S2")]
    split = Split("copies", *(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, source string") for rows in (s1, s23)), None)
    once, own = methods.alike(split), [normalize_records(s).withColumn("copies", F.lit(1)) for s in (split.s1, split.s23)]
    plain = Split("plain", split.s1, split.s23, None)
    single = [s.withColumnRenamed("entity_id", c) for s, c in zip(own, ("s1_id", "c_id"), strict=True)]
    plain.notes["alike"] = features.Alike(*single, single[0].select("s1_id", F.col("s1_id").alias("s1_rep")), single[1].select("c_id", F.col("c_id").alias("c_rep"), F.lit(1).alias("place")))
    assert once.s1.count() == 2 and once.s23.count() == 6 and once.c_ids.count() == 92
    for method in (methods.ScoreMethod(),):
        got, want = (sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in p.select("s1_id", "c_id", *features.feature_names(p)).collect()) for p in (method.build_pairs(s) for s in (split, plain)))
        assert len(got) > 6 * 25 and got == want and method.kinds(split).count() * 3 == len(got)


def test_context_of_rows_that_stand_for_several(spark):
    pairs = spark.createDataFrame([(s, c, n, x, None if x == 0.5 else x) for s, n in (("a", 1), ("b", 3), ("c", 1)) for c, x in (("p", 0.95), ("q", 0.5), ("r", 0.1 * n)) if (s, c) != ("c", "q")], "s1_id string, c_id string, copies long, n double, d double")
    pairs = pairs.withColumn("combo", F.round(context.combo(F.col("n"), F.col("d")), 9))
    each = pairs.withColumn("i", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("s1_id", F.concat("s1_id", "i"))
    want = each.select("s1_id", "c_id", *[c.alias(k) for k, c in context.context_features(F.col("n"), F.col("d"), F.col("combo")).items()])
    got = context.with_context(pairs, "n", "d", "combo").join(pairs.select("s1_id", "c_id", "copies"), ["s1_id", "c_id"]).withColumn("i", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("s1_id", F.concat("s1_id", "i"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 14


def test_postal_channel_without_all_pairs_of_a_nation(spark, tmp_path):
    """Ties by rounding and by equal balances, far and missing balances, nations of one side; no join of suppliers with customers."""
    rng = np.random.default_rng(3)
    near = lambda n, wide: [round(float(x), 2) for x in rng.uniform(-wide / 4, wide, n)]
    suppliers = [(i, i % 4, x) for i, x in enumerate([*near(30, 300), 5e3, 9e6, -9e6, 0.0, None, 12.5, 12.5])]
    customers = [(i, i % 3, x, "AB"[i % 2] if i % 7 else None) for i, x in enumerate([*near(300, 200), *[12.5] * 40, *near(60, 2e4), None, 0.0, -3.0])]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for held in (retrieval.TIED_ROWS, 8):
        retrieval.TIED_ROWS = held
        got = QUERIES["postal_channel"](spark, str(tmp_path))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(ORACLES["postal_channel"]).fetchall()))
    retrieval.TIED_ROWS = 4096
    assert all("c_id" not in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_tri_state_exchanges_no_pairs_side_by_region(spark, sf_dir):
    """Five regions would make five tasks, which spill all customers of a region."""
    plan = QUERIES["tri_state"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in next(line for line in plan.splitlines() if "Join" in line) and "Repartition" in plan


def written_as_sql_says(spark, folder, name, **tables):
    """Bytes and rows of a query's result as files, which are the rows of its SQL."""
    con = duckdb.connect()
    for t, (rows, spec) in tables.items():
        spark.createDataFrame(rows, spec).repartition(2).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    QUERIES[name](spark, str(folder)).write.parquet(f"{folder}/out")
    con.sql(f"CREATE VIEW got AS SELECT * FROM '{folder}/out/*.parquet'")
    columns = ", ".join(r[0] for r in con.sql("DESCRIBE got").fetchall())
    got, want = (con.sql(f"SELECT count(*), sum(hash({columns})::HUGEINT), bit_xor(hash({columns})) FROM {t}").fetchall()[0] for t in ("got", f"({ORACLES[name]})"))
    assert got == want
    return sum(f.stat().st_size for f in folder.glob("out/*.parquet")), got[0]


def test_tri_state_pairs_take_little_space(spark, tmp_path):
    """Tiles of more and of fewer ids than a tile holds, ids and nations that are null; all pairs, in an order that files hold well."""
    nations = [(i, f"NATION_{i}" if i else None, i % 2) for i in range(5)]
    size, n = written_as_sql_says(
        spark, tmp_path, "tri_state", nation=(nations, "n_nationkey int, n_name string, n_regionkey int"),
        supplier=([(i if i != 7 else None, i % 6 if i % 50 else None) for i in range(1500)], "s_suppkey long, s_nationkey int"), customer=([(i if i % 900 else None, i % 5 if i > 1400 else 1) for i in range(2300)], "c_custkey long, c_nationkey int"),
    )
    assert n > 1_000_000 and size < n / 2


def test_name_frequency_rounds_before_pairs(spark, tmp_path):
    """Names, brands, types and sizes that are null, a name of its own for each of some parts; no work is left for each pair."""
    rows = [(i if i != 3 else None, f"name {i % 3}" if i % 9 else (None if i % 2 else f"own {i}"), "ab"[i % 2] if i % 70 else None, "one" if i % 80 else None, i // 2 % 50 if i % 90 else None) for i in range(3600)]
    size, n = written_as_sql_says(spark, tmp_path, "name_frequency", part=(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"))
    plan = QUERIES["name_frequency"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert n > 1_000_000 and size < n / 2 and not any("round(" in line for line in plan[: next(i for i, line in enumerate(plan) if "Join" in line)])


def test_searches_multiply_common_terms_and_pass_over_the_rest(spark, monkeypatch):
    """Scores by matrices, by postings and by both; many ties by rounding, in parts that are given on early, against a sort of all."""
    rng = np.random.default_rng(5)
    n, lists = 400, [np.sort(rng.choice(60, 8, replace=False)) for _ in range(400)]
    chunk = {"lengths": np.full(n, 8).tobytes(), "terms": np.concatenate(lists).astype(np.int64).tobytes(), "weights": np.round(rng.random(8 * n), 1).tobytes()}
    asked = [(q, t, float(w)) for q in range(30) for t, w in zip(rng.choice(70, 6, replace=False).tolist(), np.round(rng.random(6), 1).tolist(), strict=True)]
    table = pa.table({"s1_id": [a[0] for a in asked], "h": [a[1] for a in asked], "w": [a[2] for a in asked]})
    block = retrieval._invert((pa.scalar(0),), table, pa.int64()).to_pylist()[0]
    full = np.zeros((n, 70))
    full[np.repeat(np.arange(n), 8), np.concatenate(lists)] = np.frombuffer(chunk["weights"])
    want = full @ np.array([[sum(w for q, t, w in asked if (q, t) == (i, j)) for i in range(30)] for j in range(70)])
    for common, terms in ((0.0, 7), (0.01, 512), (2.0, 512)):
        monkeypatch.setattr(retrieval, "COMMON", common)
        monkeypatch.setattr(retrieval, "DENSE_TERMS", terms)
        assert np.allclose(retrieval._sparse_scores(chunk, block), want)
    names, k = [f"d{i}" for i in rng.permutation(n)], 5
    best, found = retrieval.Best(k), {}
    for lo in range(0, n, 50):
        best.offer(list(range(30)), "x", names[lo : lo + 50], want[lo : lo + 50], 0.0)
        if lo % 100 == 0:
            for q, i, _, s in best.batch(pa.schema([("q", pa.int64()), ("i", pa.string()), ("source", pa.string()), ("s", pa.float64())])).to_pandas().itertuples(index=False):
                found.setdefault(q, []).append((-np.floor(s * 1e6 + 0.5), i))
    for (q, _), held in best.found.items():
        found.setdefault(q, []).extend(x[:2] for x in held)
    for q in range(30):
        assert sorted(found[q])[:k] == sorted((-np.floor(s * 1e6 + 0.5), i) for s, i in zip(want[:, q], names, strict=True) if s > 0)[:k]


def test_dear_work_is_dealt_out(spark):
    """Few bytes that are much work (string scores of some thousand pairs) would be one task; ids that stand for others are sent."""
    from kindra.plans import methods
    from kindra.sources.tables import Split

    s = [spark.createDataFrame([(f"{p}-{i}", f"Oak {i % 3} Ltd", f"{i} High Street", "India", p) for i in range(12)], "entity_id string, business_name string, business_address string, country string, source string") for p in ("S1", "S2")]
    once = methods.alike(Split("few", *s, None))
    found, spaces = features.retrieve(once)
    kinds = features.with_records(found.select("s1_id", F.col("c_rep").alias("c_id")).distinct(), once.s1, once.s23)
    assert features.score_features(kinds, once.s1, once.s23, spaces).rdd.getNumPartitions() >= 4
    plan = features.of_all_members(found, once)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Repartition" in plan
