"""Each operator against a brute-force version, on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kindra.llm import decontaminate, jaccard, language_id, line_dedup, packing, quality_model, quality_rules, simhash, substring_dedup, token_counts, url_filter
from kindra.llm.common import held_out, labelled_texts, words_of
from kindra.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60):
    """Rows with copies, near copies, shared lines and passages, and odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    shared, passage = line(9), " ".join(rng.choice(vocab) for _ in range(30))
    texts = []
    for i in range(n):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), shared if i % 8 else "  " + shared.upper() + "\t")
        if i % 5 == 0:
            lines.append(passage[: rng.randint(60, len(passage))])
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], texts[3] + " x", None, "", " \n\t", "a", "one two three", "\n", "x " * 5000, texts[7].replace("a", "A"), "É " * 20, "the the the the the the the the the the the the the the the the"]
    rows = [(i if i != 5 else 500, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[9], None, None, None), (rows[2][0], rows[2][1], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).fillna(-1, ["doc_id"]).collect())


# --------------------------------------------------------------------------- lines


def brute_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    held = {}
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, set()).add(-1 if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_rows_of_one_document_count_once(spark):
    """A line in two rows of document 1 and in document 2 is in two documents; in three rows without doc_id and 1 and 2, in three."""
    a, b = "a line of over twenty letters", "another line of over twenty letters"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1), *[(None, b, "en", "s", 1)] * 3, (1, b, "en", "s", 1), (2, b, "en", "s", 1)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == brute_lines(rows) and [r[2] for r in got] == [1, 1, 1, 0, 0, 1, 0, 0]


@pytest.mark.parametrize("gathered", [7, 1 << 18])
def test_the_index_holds_all_distinct_lines(spark, docs, monkeypatch, gathered):
    """Also lines that one document holds: the count array tells them from the shared ones."""
    monkeypatch.setattr(line_dedup, "GATHERED", gathered)
    refs = docs.select("doc_id", "text").mapInArrow(line_dedup._references(20), "a long, b long, doc long")
    blob = lambda names: ", ".join(f"{c} binary" for c in names)
    known = refs.mapInArrow(line_dedup._aggregated(5, 3), f"shard int, {blob(line_dedup._KEYS)}")
    rows = known.groupBy("shard").applyInArrow(line_dedup._indexed(3, 10), f"shard int, {blob((*line_dedup._INDEX, *line_dedup._HOT))}").collect()
    shards = {r.shard: line_dedup.LineShard.unpacked([bytes(r[c]) for c in line_dedup._INDEX]) for r in rows}
    want = {}
    for r in refs.collect():
        want.setdefault((r.a % (1 << 64), r.b % (1 << 64)), set()).add(r.doc)
    assert sum(len(s.mph) for s in shards.values()) == len(want)
    for (a, b), held in want.items():
        s = shards[a % 5]
        at = s.mph.lookup(np.array([a], np.uint64), np.array([b], np.uint64))[0]
        assert s.count[at] == min(3, len(held)) and s.keeper[at] == max(held)


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")).withColumn("a", F.lit(1)))
    want = brute_lines(corpus())
    assert by_id(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert "a" in out.columns and sum(w[2] for w in want) > 5
    assert by_id(line_dedup.dedup_lines(docs, keep_text=False), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_hot_lines_are_probed_in_place(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(line_dedup, "HOT_FLOOR", 5)
    assert by_id(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(corpus())


def test_minimal_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a[:10] = a[10]
    mph = line_dedup.MinimalPerfectHash.build(a, b)
    assert sorted(mph.lookup(a, b).tolist()) == list(range(5000))


# --------------------------------------------------------------------------- packing


def packed_documents(spark, rows, length):
    """Pieces by document and sequence, held against the tokenizer: every id of every row lies in exactly one piece."""
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = packing.Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3).withColumn("ids", F.lit("clash"))
    by_doc, by_sequence = {}, {}
    for p in packing.pack(frame, path, length=length).collect():
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    sizes = []
    for k in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    full = sum(len(x) for x in ids.values()) // length
    assert sorted(by_sequence) == list(range(len(sizes))) and sizes[:full] == [length] * full
    assert all(n < length and n & (n - 1) == 0 for n in sizes[full:]) and len(set(sizes[full:])) == len(sizes) - full
    return by_doc


def test_packing_is_exact_and_gapless(spark):
    """Cut pieces too, with every power of two in the rest: a long document's end is longer than the last pieces."""
    rows = [(k, t) for k, (_, t, *_) in enumerate(corpus()) if t is not None]
    rows += [(500, None), (501, "word " * 3000), *[(600 + i, "a" * (i % 3)) for i in range(20)]]
    assert any(len(x) > 1 for x in packed_documents(spark, rows, 256).values())
    packed_documents(spark, [(1, "one two three " * 85)], 256)


def test_packing_follows_the_curve(spark):
    """Texts of two vocabularies: pieces of one kind mostly follow another of the same kind."""
    rng = random.Random(6)
    kinds = [[f"alpha{i}" for i in range(30)], [f"omega{i}" for i in range(30)]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(120)]
    pieces = sorted((p for own in packed_documents(spark, rows, 4096).values() for p in own), key=lambda p: (p.sequence_id, p.offset))
    same = [a.doc_id % 2 == b.doc_id % 2 for a, b in zip(pieces, pieces[1:], strict=False)]
    assert np.mean(same) > 0.8


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="pieces"):
        packing.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_piece_encoder_equals_the_tokenizer():
    path = tokenizer_path("word_bpe_49k.json")
    encoder, rng = packing.PieceEncoder(path), random.Random(2)
    alphabet = "abéÉ 1.!?'s<|>endoftext\n日́İΣ-"
    texts = ["", "x<|endoftext|>y!", "It's", "don't!!", "…..", "ﬁ ﬂ", "a.b.c...", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000))]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in texts])] == [w.ids for w in want]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_index(cells, 3))
    assert sorted(packing.hilbert_index(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


# --------------------------------------------------------------------------- near duplicates


def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, limit=4):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    fps = {i: brute_fingerprint(t) for i, t, *_ in corpus() if i is not None}
    classes = brute_classes(fps)
    rows = simhash.near_duplicates(docs.withColumn("fp", F.lit(1))).collect()
    assert len(rows) == docs.count() and any(i != c for i, c in classes.items())
    for r in rows:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], classes[r.doc_id])


@pytest.mark.parametrize("block", [8, 8192])
def test_every_link_is_found(spark, monkeypatch, block):
    """Random fingerprints with chains of up to 4 bits, under every number of partitions."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "TILE", 32)
    rng, fps = random.Random(5), {}
    for i in range(300):
        base = rng.getrandbits(64) if i % 3 == 0 or not fps else fps[rng.choice(list(fps))]
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        fps[i] = base
    values = np.array([fps[i] for i in range(300)], np.uint64)
    bits = np.array([[v >> b & 1 for b in range(64)] for v in fps.values()], float)
    want = brute_classes(fps)
    for parts in simhash.PARTITION_COUNTS:
        monkeypatch.setattr(simhash, "PARTITION_COUNTS", (parts,))
        plan = simhash.allocate(300, bits.T @ bits)
        assert sum(plan.thresholds) == 4 - parts + 1 and sorted(b for p in plan.partitions for b in p) == list(range(64))
        source = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp long, node long")
        rows, index = (source.mapInArrow(simhash._probes(plan, only), "bucket long, fp long, node long, own boolean") for only in (False, True))
        found = simhash._dealt(rows, index, 3).mapInArrow(simhash._verify(4), "x long, y long")
        frame, kept = simhash.connected(found)
        roots = {r.node: r.root for r in frame.collect()}
        assert kept
        assert {i: roots.get(i, i) for i in range(300)} == want


def test_a_bucket_of_100_000_fingerprints_goes_to_many_tasks(spark):
    """All in one bucket of one partition: each pair of blocks is a key of its own, and none is much larger than two blocks."""
    plan = simhash.Plan((tuple(range(32)), tuple(range(32, 64))), (4, -1))
    index = spark.range(100_000).selectExpr("shiftleft(id, 32) AS fp", "id AS node").mapInArrow(simhash._probes(plan, True), "bucket long, fp long, node long, own boolean")
    dealt = simhash._dealt(index, index, 64)
    keys = dealt.groupBy("bucket", "low", "high").count().collect()
    blocks = -(-100_000 // simhash.BLOCK)
    assert len({k.bucket for k in keys}) == 1 and len(keys) == blocks * (blocks + 1) // 2 and max(k["count"] for k in keys) < 2.5 * simhash.BLOCK


def brute_jaccard(texts, least=0.8):
    """Classes of the documents by five-word Jaccard similarity, all pairs compared."""
    grams = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both, either = len(grams[i] & grams[j]), len(grams[i] | grams[j])
            if not either or 10 * both >= 10 * least * either:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [1, 32])
def test_near_duplicate_stage_drops_all_similar_texts(spark, docs, monkeypatch, small):
    """Copies with 1 to 30 edits of 300 words, some over and some under 0.8; many of them are further apart than 4 bits."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 3 * small)
    rng, texts = random.Random(3), {}
    for base in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for copy in range(6):
            own = list(words)
            for _ in range(0 if copy == 0 else rng.choice([1, 3, 5, 7, 9, 30])):
                own[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
            texts[base * 10 + copy] = " ".join(own)
    texts |= {1000 + i: t for i, t, *_ in corpus() if i is not None}
    classes = brute_jaccard(texts)
    fps = {i: brute_fingerprint(t) for i, t in texts.items() if i < 1000}
    assert any(classes[i] != i and (fps[i] ^ fps[classes[i]]).bit_count() > 4 for i in fps) and any(classes[i] == i and i % 10 for i in fps)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in texts if classes[i] == i)


def test_sketches_drop_chance_pairs_and_no_similar_one():
    """One bucket of 40 texts that share a passage, four of them near copies: only pairs of those are given on."""
    rng = random.Random(8)
    for words in (12, 60, 400, 9000):
        copies = [[f"w{rng.randrange(10**6)}" for _ in range(words)]]
        for k in (1, 2, words // 60):
            copies.append([w if i >= k else f"e{rng.randrange(10**6)}" for i, w in enumerate(copies[0])])
        others = [[f"o{rng.randrange(10**6)}" for _ in range(words)] for _ in range(36)]
        sets = jaccard.shingle_sets([" ".join(w).encode() for w in copies + others])
        x, y = np.triu_indices(40, 1)
        size = np.array([len(s) for s in sets])
        sketches = np.empty(40, object)
        sketches[:] = [jaccard._sketch(s) for s in sets]
        kept = jaccard._close(sketches, size, x, y)
        similar = np.array([bool(jaccard.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))) for i, j in zip(x, y, strict=True)])
        assert not (similar & ~kept).any() and (words == 12 or similar.sum() == 6) and kept[x >= 4].mean() < (0.3 if words == 12 else 0.02)


# --------------------------------------------------------------------------- quality rules


def brute_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs):
    out = quality_rules.quality_rules(docs.withColumn("kept", F.lit("clash")), quality_rules.LineField.all_content())
    rows = by_id(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for i, text, *_ in corpus():
        s = brute_stats(text)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want.append((-1 if i is None else i, *s, failed, not failed))
    assert rows == sorted(want)


def thue_morse(n):
    """A word over a and b and its complement: their difference cancels in every polynomial modulo a power of two."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 16, 64, 512, 1024])
def test_different_words_have_different_hashes(n):
    words = [w.encode() for w in (*thue_morse(n), "a" * n, "a" * (n - 1), "a" * (n + 1), "a" * (n - 1) + "b")]
    for hashes in words_of(words, 2).hashes:
        assert len(set(hashes.tolist())) == len(words)
    a, b = thue_morse(n)
    repeated = quality_rules.examine([f"{a} x y z w {b} x y z w".encode()]).n_repeat_words
    assert repeated.tolist() == [0]


def all_paths(field, x):
    import itertools

    score = lambda y: sum(np.array(y) * (x @ field.weights)) + field.start * y[0] + sum(field.transitions[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
    return {y: score(y) for y in itertools.product((0, 1), repeat=len(x))}


def test_line_field_decodes_the_best_path():
    rng = np.random.default_rng(1)
    field = quality_rules.LineField(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)), 0.3)
    x = rng.normal(size=(6, len(quality_rules.FEATURES)))
    scores = all_paths(field, x)
    assert field.decode(x).astype(int).tolist() == list(max(scores, key=scores.get))


def test_line_field_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood summed over all paths, for sequences of several lengths."""
    rng = np.random.default_rng(2)
    lines = [rng.normal(size=(n, len(quality_rules.FEATURES))).astype(np.float32) for n in (1, 3, 5)]
    labels = [rng.integers(0, 2, len(f)) for f in lines]
    theta = rng.normal(size=len(quality_rules.FEATURES) + 5) * 0.5

    def likelihood(theta):
        field, total = quality_rules.LineField(theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]), 0.0
        for x, y in zip(lines, labels, strict=True):
            scores = all_paths(field, x)
            total += scores[tuple(y.tolist())] - np.logaddexp.reduce(list(scores.values()))
        return total

    grad, step = quality_rules.LineField.gradient(theta, *quality_rules.LineField.padded(lines, labels)), 1e-5
    for i in range(len(theta)):
        e = np.eye(len(theta))[i] * step
        assert grad[i] == pytest.approx((likelihood(theta + e) - likelihood(theta - e)) / (2 * step), abs=1e-3)


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_field_labels_lines_of_unseen_documents(spark, labelled):
    """Lines of held-out documents, spliced; and in the documents themselves some have lines of both kinds."""
    field = quality_rules.fit_line_field(*labelled)
    texts, marks = quality_rules.sequences(labelled_texts(*labelled, 600, 20_000, "lines", unseen=True), 600, seed=3)
    stats = quality_rules.examine(texts)
    found = [field.decode(stats.features[a:b]) for a, b in zip(stats.first_line[:-1], stats.first_line[1:], strict=True)]
    assert np.mean(np.concatenate(found) == (np.concatenate(marks) == 1)) >= 0.9
    rows = quality_rules.quality_rules(labelled[0], field, ["doc_id"]).collect()
    assert np.mean([0.02 < r.content_share < 0.98 for r in rows]) > 0.005


def test_quality_field_separates_held_out_documents(spark, labelled):
    kept = quality_rules.quality_rules(labelled[0], quality_rules.fit_line_field(*labelled), ["doc_id"])
    rows = kept.join(labelled[1], "doc_id").where(held_out()).collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2


def test_quality_field_without_labelled_texts_warns(spark, labelled, empty):
    for documents, labels in ((empty, labelled[1]), (labelled[0], labelled[1].where("quality = 1"))):
        with pytest.warns(UserWarning, match="both kinds"):
            assert quality_rules.fit_line_field(documents, labels).weights[0] == 1


# --------------------------------------------------------------------------- classifiers


def test_language_id(spark, docs):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_languages(documents)
    rows = language_id.identify_languages(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify_languages(docs.withColumn("held_out", F.lit(0)), model).collect()}
    odd_ids = {i for i, t, *_ in corpus() if t is None or not any(c.isalpha() for c in t)}
    assert all((pred == "und") == (i in odd_ids) for i, pred, _ in odd) and all(0 <= s <= 1 for *_, s in odd)


def test_numerals_are_no_letters(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = ["½", "²", "Ⅷ", "12 _ !", "é", "日"]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(frame, language_id.fit_languages(documents)).collect()}
    assert [rows[i][0] == "und" for i in range(6)] == [True] * 4 + [False] * 2 and all(rows[i][1] == 0 for i in range(4))


def test_ridge_regression_and_prediction_are_those_of_the_definition():
    """Nyström features by the root of the landmarks' kernel, weighted ridge solved in full, one language against the rest."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc " if i % 2 else "xyz ") for _ in range(30)) for i in range(24)]
    labels = ["p" if i % 2 else "q" for i in range(24)]
    model = language_id.KernelClassifier.fit(texts, labels, per_language=5)
    grams = lambda t: set(language_id.codes(t).tolist())
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    marks = [i for lang in ("p", "q") for i in [j for j in range(24) if labels[j] == lang][:5]]
    k_mm = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    k_nm = np.array([[kernel(t, texts[j]) for j in marks] for t in texts])
    values, vectors = np.linalg.eigh(k_mm)
    z = np.column_stack([k_nm @ vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))), np.ones(24)])
    for c, lang in enumerate(model.languages):
        y = np.array([1.0 if x == lang else -1.0 for x in labels])
        w = np.linalg.lstsq(np.vstack([z / np.sqrt(12), np.sqrt(language_id.RIDGE) * np.eye(z.shape[1])]), np.concatenate([y / np.sqrt(12), np.zeros(z.shape[1])]), rcond=None)[0]
        assert np.allclose(model.scores(texts)[:, c], z @ w, atol=1e-5)


def test_language_id_without_labels(spark, docs, empty):
    assert language_id.identify_languages(empty, None).count() == 0
    assert language_id.fit_languages(empty) is None
    assert {r.lang_pred for r in language_id.identify_languages(docs, None).collect()} == {"und"}


def test_string_kernel_counts_shared_grams():
    a, b = "ab ba", "abc"
    grams = lambda t: {(" " + t + " ")[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    model = language_id.KernelClassifier.fit([a, b], ["x", "y"])
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert model.kernel([a])[0, 1] == pytest.approx(want)


def test_quality_network(spark, docs):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    network = quality_model.fit_quality(documents, labels)
    rows = quality_model.score_quality(documents, network).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    odd = quality_model.score_quality(docs, network).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)


def test_pair_tables_equal_the_plain_convolution():
    rng = np.random.default_rng(0)
    network = quality_model.ByteNetwork(rng.normal(size=(6, 256, 12)).astype(np.float32), rng.normal(size=12).astype(np.float32), rng.normal(size=24), 0.1)
    raw = rng.integers(0, 256, 100_000).astype(np.uint8)
    assert np.allclose(network.responses(raw), network.responses_plain(raw), atol=1e-4)
    half = quality_model.CHUNK // 2
    plain = network.responses_plain(raw)
    chunk = np.array([plain[i : i + 2 * half].max(0) for i in range(0, len(plain) - half, half)]).clip(0)
    z = np.concatenate([chunk.mean(0), chunk.max(0)]) @ network.out + network.offset
    assert network.score(raw.tobytes()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_network_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    network = quality_model.ByteNetwork(rng.normal(0, 0.3, (6, 256, 12)), rng.normal(0, 0.3, 12), rng.normal(size=24), 0.1)
    raw, label = network.padded(bytes(rng.integers(97, 105, 700).astype(np.uint8))), 1
    grads = [np.zeros_like(network.tables), np.zeros(12), np.zeros(24), np.zeros(1)]
    network._backward(raw, label, grads, 1)

    def loss():
        r, half = network.responses_plain(raw), quality_model.CHUNK // 2
        chunk = np.array([r[i : i + 2 * half].max(0) for i in range(0, len(r) - half, half)]).clip(0)
        z = np.concatenate([chunk.mean(0), chunk.max(0)]) @ network.out + network.offset
        return np.logaddexp(0, z) - label * z

    step = 1e-6
    for values, grad in ((network.tables, grads[0]), (network.bias, grads[1]), (network.out, grads[2])):
        flat, wanted = values.reshape(-1), grad.reshape(-1)
        for i in [*np.argsort(-np.abs(wanted))[:20].tolist(), 0, len(flat) - 1]:
            old = flat[i]
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert wanted[i] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_quality_model_on_odd_tables(spark, docs, empty, labelled):
    network = quality_model.fit_quality(empty, labelled[1])
    assert quality_model.score_quality(empty, network).count() == 0
    clash = docs.withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(7)).withColumn("predicted", F.lit("x"))
    rows = quality_model.score_quality(clash, network).collect()
    assert len(rows) == docs.count() and {type(r.held_out) for r in rows} == {bool}


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.score_quality(docs, quality_model.fit_quality(docs, none)).collect()} == {0.5}


# --------------------------------------------------------------------------- substrings


def brute_repeats(rows, window=13):
    order = lambda i: (1 << 63) - 1 if i is None else i
    least = {}
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - window + 1):
            g = tuple(words[k : k + window])
            least[g] = min(least.get(g, order(None)), order(i))
    out = []
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = {j for k in range(len(words) - window + 1) if least[tuple(words[k : k + window])] < order(i) for j in range(k, k + window)}
        out.append((-1 if i is None else i, len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("gathered", [50, 400_000])
def test_substring_dedup(docs, monkeypatch, gathered):
    monkeypatch.setattr(substring_dedup, "GATHERED", gathered)
    want = brute_repeats(corpus())
    out = substring_dedup.remove_repeats(docs.withColumn("marks", F.lit(1)).withColumn("n_words", F.lit("clash")))
    assert by_id(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want and sum(w[2] for w in want) > 100
    assert by_id(substring_dedup.remove_repeats(docs, keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_windows_of_cancelling_words_differ(spark):
    """Two documents of 13 words that differ in one word of 512 letters."""
    a, b = thue_morse(512)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}", "en", "s", 1), (2, f"{b} {rest}", "en", "s", 1), (3, f"{a} {rest}", "en", "s", 1)]
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats(rows) and [r[2] for r in got] == [0, 0, 13]


def test_representatives_depend_on_the_window_alone():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dd", "e"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))).encode() for _ in range(300)] + [b"a " * 60]
    words = substring_dedup.words_of(texts)
    at, keys = substring_dedup.representatives(words)
    tokens = [w for t in texts for w in t.split()]
    seen = {}
    for place, key in zip(at.tolist(), keys.tolist(), strict=True):
        assert seen.setdefault(tuple(tokens[place : place + 13]), key) == key


# --------------------------------------------------------------------------- tokens, benchmark, urls


def test_token_counts(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = token_counts.Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in corpus())
    assert by_id(token_counts.count_tokens(docs.withColumn("n_tokens", F.lit(1)), path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counter_on_odd_texts():
    counter, rng = token_counts.TokenCounter(tokenizer_path("byte_bpe_50k.json")), random.Random(1)
    texts = ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", " lead", "trail ", "a\u0085b", *("".join(rng.choice("ab C1 \n\t'sé!<|>endoftext　") for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    assert [counter.count(t) for t in texts] == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def words9(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.mark.parametrize(("inline", "sent"), [(60_000, 9), (3, 10_000), (3, 11)])
def test_decontamination(spark, docs, monkeypatch, inline, sent):
    """Shingles in the expression, in a table that is sent, and in parts of one."""
    monkeypatch.setattr(decontaminate, "INLINE_SHINGLES", inline)
    monkeypatch.setattr(decontaminate, "SENT_SHINGLES", sent)
    rows = corpus()
    some = words9(rows[6][1])
    long = words9(max((r[1] or "" for r in rows), key=lambda t: len(set(t.split()))))
    items = [(1, " ".join(long[2:20]).upper()), (20, " ".join(some[:3])), (3, some[0]), (4, None), (5, "!?"), (6, "zzz qqq"), (7, " ".join(long[2:20])), (8, "é, É")]
    windows = {}
    for item, text in items:
        w = words9(text)
        for k in range(len(w) - min(len(w), 10) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    want = []
    for i, text, *_ in rows:
        w, hit, found = words9(text), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        want.append((-1 if i is None else i, len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs.withColumn("words", F.lit(1)), benchmark).withColumn("items", F.array_join("item_ids", ","))
    assert by_id(out, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == sorted(want) and any(x[2] for x in want)


def test_many_shingles_take_one_pass(spark, docs):
    """A benchmark of 200 000 shingles: the documents are scanned once for the counts and once for the hits."""
    rng = random.Random(7)
    items = [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(2000))) for i in range(100)]
    items.append((500, " ".join(words9(corpus()[6][1])[:12])))
    scanned = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text")
    rows = decontaminate.decontaminate(source.mapInArrow(counted, source.schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.contaminated} >= {corpus()[6][0]} and all(set(r.item_ids) <= {"500"} for r in rows)
    assert scanned.value == 2 * len(corpus())


def test_urls(spark):
    urls = {
        1: None, 2: "no scheme", 3: "http://Example.NET/en/1", 4: "https://a.example.net", 5: "http://x.example.com/de/5?q", 6: "http://x.example.org/fr/", 7: "http://x.example.org/fr", 8: "ftp://net", 9: "http://notexample.net/en/",
        10: "http://plain.example.org/a#b", 11: "http://", 12: "http://" + "y" * 300 + ".org/z", 13: "http://plain.example.org/a",
    }
    pages = spark.createDataFrame([*urls.items(), (13, urls[13])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11)] == [
        ("", "", None), ("", "", None), ("example.net", "/en/1", "example.net/en/"), ("a.example.net", "", None), ("x.example.com", "/de/5", "example.com/de/"), ("x.example.org", "/fr/", "org/fr/"), ("x.example.org", "/fr", None),
        ("net", "", None), ("notexample.net", "/en/", "net/"), ("", "", None),
    ]
    assert {rows[i].verdict for i in (1, 2, 3, 6, 11)} == {"allow"} and {rows[i].verdict for i in (5, 9)} == {"block"}
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def brute_verdicts(urls):
    """Rules, and naive Bayes over tokens, from the definitions; the words of a host are given by the operator's segmentation."""
    import math

    def host_path(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule_of(host, path):
        fits = [(len(h + p), h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    places = {i: host_path(u) for i, u in urls}
    labels = {i: [x for x in re.split(r"[^a-z0-9]+", h) if x] for i, (h, _) in places.items()}
    counts = Counter(x for h in {h for h, _ in places.values()} for x in re.split(r"[^a-z0-9]+", h) if 3 <= len(x) <= 20)
    counts.update(x for _, p in places.values() for x in re.split(r"[^a-z0-9]+", lower(p)) if 3 <= len(x) <= 20)
    total = sum(counts.values()) or 1

    def split(label):
        """The likeliest of all cuts, by trying them from the left; unknown letters cost as in the operator."""
        known = lambda a, b: counts[label[a:b]] - (label[a:b] == label)
        best = {0: (0.0, [])}
        for end in range(1, len(label) + 1):
            options = [(best[a][0] + math.log(known(a, end) / total), a, True) for a in range(max(0, end - 20), end - 2) if known(a, end) > 0]
            options.append((best[end - 1][0] - math.log(total) - 12, end - 1, False))
            score, a, real = max(options, key=lambda o: (o[0], -o[1]))
            best[end] = score, [*best[a][1], (a, end, real)]
        out = []
        for a, b, real in best[len(label)][1]:
            if out and not real and not out[-1][2]:
                out[-1] = (out[-1][0], b, False)
            else:
                out.append((a, b, real))
        return [label[a:b] for a, b, _ in out]

    words = {i: [split(x) for x in labels[i]] for i in places}
    seen = {"block": Counter(), "allow": Counter()}
    pages = Counter()
    for i, (h, p) in places.items():
        if r := rule_of(h, p):
            skip, parts = len(re.findall(r"[^.-]+", r[0])), url_filter.path_tokens(r[1])
            tokens = ["h:" + w for own in words[i][: len(words[i]) - skip] for w in own] + ["p:" + t for t in url_filter.path_tokens(p)[len(parts) :]]
            seen[r[2]].update(tokens)
            pages[r[2]] += 1
    size = len(set(seen["block"]) | set(seen["allow"]))
    share = lambda v, t: (seen[v][t] + url_filter.SMOOTHING) / (sum(seen[v].values()) + url_filter.SMOOTHING * size)
    out = {}
    for i, (h, p) in places.items():
        tokens = [t for t in [*("h:" + w for own in words[i] for w in own), *("p:" + t for t in url_filter.path_tokens(p))] if seen["block"][t] + seen["allow"][t]]
        score = math.log(pages["block"] / pages["allow"]) + sum(math.log(share("block", t) / share("allow", t)) for t in tokens)
        method = "block" if labels[i] and tokens and score > 1e-9 else "allow"
        r = rule_of(h, p)
        out[i] = ([w for own in words[i] for w in own], r[0] + r[1] if r else None, r[2] if r else method, method)
    return out


def test_verdicts_equal_a_plain_naive_bayes(spark):
    rng = random.Random(12)
    parts = ["shop", "news", "pills", "farm", "cats", "win", "blog"]
    host = lambda: rng.choice(["", "www.", "m."]) + "".join(rng.sample(parts, rng.randint(1, 3))) + rng.choice(["", "-" + rng.choice(parts)])
    urls = [(i, f"http://{host()}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(parts)}/{rng.randrange(99)}") for i in range(400)]
    urls += [(1000, None), (1001, "http://shop/"), (1002, "http://" + "q" * 60 + "pillsfarm.org/a"), (1003, "x://farm-news.org")]
    want = brute_verdicts(urls)
    rows = {r.page_id: (r.host_words, r.rule, r.verdict, r.method_verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert rows == want
    free = [v for v in want.values() if v[1] is None]
    assert {v[2] for v in free} == {"block", "allow"}


def test_naive_bayes_carries_verdicts_to_hosts_that_no_rule_names(spark):
    """Words of blocked and of allowed hosts on pages of rules decide pages of .com, whose order of words is new; a list of
    known hosts adds to them."""
    urls = [(i, f"http://cheap{w}.net/a/{i}") for i, w in enumerate(["pills", "loans", "bets"] * 8)] + [(100 + i, f"http://calm{w}.org/fr/a/{i}") for i, w in enumerate(["books", "maps", "songs"] * 8)]
    urls += [(200, "http://pills-loans.com/a/1"), (201, "http://books-maps.com/a/1"), (202, "http://odd.com/a/1"), *[(300 + i, f"http://w{i}.com/{w}") for i, w in enumerate(["cheap", "calm", "pills", "loans", "bets", "books", "maps", "songs"])]]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert rows[0].host_words == ["cheap", "pills", "net"] and rows[200].verdict == "block" and rows[201].verdict == "allow"
    known = spark.createDataFrame([("odd.com", True), ("w0.com", True)], "host string, block boolean")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, known).collect()}[202] == "block"


def test_url_tokens_do_not_share_counts(spark):
    """Two path tokens with equal 16-bit hashes: one on blocked pages, the other on allowed ones."""
    seen, word = {}, 0
    while (other := seen.setdefault(xxhash.xxh64_intdigest(f"p:w{word}x") & 0xFFFF, f"w{word}x")) == f"w{word}x":
        word += 1
    urls = [(i, f"http://spot.net/{other}") for i in range(50)] + [(100 + i, f"http://spot.org/fr/w{word}x") for i in range(60)] + [(200, f"http://spot.com/{other}"), (201, f"http://spot.com/w{word}x")]
    rows = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert rows[200] == rows[0] == "block" and rows[100] == rows[201] == "allow"


def test_segmentation_is_the_likeliest():
    assert url_filter.segment(9, [(0, 5, 9), (5, 9, 9), (0, 2, 1)], 100.0) == [(0, 5), (5, 9)]
    assert url_filter.segment(3, [], 100.0) == [(0, 3)]


# --------------------------------------------------------------------------- empty tables and the pipeline


def test_empty_tables(spark, docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert packing.pack(empty, path).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert quality_rules.quality_rules(empty, quality_rules.LineField.all_content()).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert {r.contaminated for r in decontaminate.decontaminate(docs, benchmark).collect()} == {False}


def brute_pipeline(spark, documents, labels, benchmark):
    """doc_id and the number of ids of every document that the stages leave, each stage from its definition; what the line
    field keeps is taken from it."""
    rows = quality_rules.quality_rules(documents, quality_rules.fit_line_field(documents, labels)).where("kept").select("doc_id", "text").collect()
    held, key = {}, lambda x: lower(x.strip(" \t\n\v\f\r"))
    for r in rows:
        for k in {key(x) for x in r.text.split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, set()).add(-1 if r.doc_id is None else r.doc_id)
    texts = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == (-1 if r.doc_id is None else r.doc_id))) for r in rows]
    classes = brute_jaccard({i: t for i, t in texts if i is not None})
    texts = [(i, t) for i, t in texts if i is None or classes[i] == i]
    windows = set()
    for r in benchmark.collect():
        w = words9(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - min(len(w), 10) + 1)} if w else set()
    sizes, out = {len(g) for g in windows}, Counter()
    tokenizer = packing.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, t in texts:
        w = words9(t)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            out[i] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    return out


def tokens_by_document(pieces):
    out = Counter()
    for p in pieces.collect():
        out[p.doc_id] += p.length
    return out


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    documents, labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    assert tokens_by_document(corpus_pipeline.run(spark, folder)) == brute_pipeline(spark, documents, labels, benchmark)


def test_pipeline_on_odd_rows(spark, tmp_path, labelled):
    """Null ids, null, empty and long texts, repeated rows, copies, and columns named like results."""
    passage = " ".join(f"item{i}" for i in range(12))
    rng = random.Random(2)
    body = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(n)).capitalize() + "."
    clean = body(40)
    rows = [(1, clean), (2, clean), (3, None), (4, ""), (None, f"{body(30)} {passage}"), (None, body(30)), (None, f"{body(20)}\n{body(10)}"), (5, f"{passage} {body(30)}"), (6, body(50)), (6, rows_text := body(50)), (7, body(60_000))]
    rows.append((6, rows_text))
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 5, "mark") for i, t in rows], SCHEMA + ", kept string, n_lines int, _marks string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labelled[1].where("false").write.parquet(f"{tmp_path}/labels.parquet")
    documents, labels, benchmark = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kept = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == documents.columns, name
        assert {(r.kept, r.n_lines, r._marks) for r in kept.collect()} == {("own", 5, "mark")}, name
    # Of the rows without doc_id only the one with the passage goes.
    assert sum(r.doc_id is None for r in kept.collect()) == 2 and not any(passage in r.text for r in kept.collect())
    assert tokens_by_document(corpus_pipeline.run(spark, str(tmp_path))) == brute_pipeline(spark, documents, labels, benchmark)


def test_stages_take_empty_tables(spark, tmp_path, empty, labelled):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labelled[1].where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_over_a_chunk_are_read_whole(spark):
    """One text of over 2 MiB forms a chunk of its own in every operator that works on chunks."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(330_000)]
    long = "\n".join(" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, " ".join(words[-30:]), "en", "s", 1)]
    assert len(long) > 2 << 20
    frame = spark.createDataFrame(rows, SCHEMA)
    assert by_id(line_dedup.dedup_lines(frame), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)
    assert by_id(substring_dedup.remove_repeats(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    stats = quality_rules.quality_rules(frame, quality_rules.LineField.all_content(), ["doc_id"])
    assert by_id(stats, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted((i, *brute_stats(t)) for i, t, *_ in rows)
    tokenizer = token_counts.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert by_id(token_counts.count_tokens(frame, tokenizer_path("byte_bpe_50k.json")), "doc_id", "n_tokens") == [(i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(frame).collect()} == {i: brute_fingerprint(t) for i, t, *_ in rows}
    model = language_id.fit_languages(frame.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in language_id.identify_languages(frame, model).collect()} == {"xx"}
    assert len({round(r.score, 9) for r in quality_model.score_quality(frame, quality_model.ByteNetwork.constant(0.4)).collect()}) == 1
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}


def test_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
