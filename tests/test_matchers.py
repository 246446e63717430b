"""The matchers end to end on small generated data."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from kindra.operators import decisions
from kindra.plans import cli, methods
from kindra.sources.synthetic import write_dataset

SMALL = {"rules": {"n_random": 40, "n_rounds": 1}, "retrieval": {"n_random": 40, "n_rounds": 1}, "boosted": {"inner_folds": 2, "boost": {"max_rounds": 30}}}


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    write_dataset(str(folder), 120, 60, 11)
    return folder


@pytest.mark.parametrize("method", sorted(SMALL))
def test_matcher(spark, data, tmp_path, method):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(SMALL[method]))
    out = tmp_path / "out"
    results = cli.main([method, "all", "--data-dir", str(data), "--out-dir", str(out), "--config", str(config), "--folds", "2", "--test-gt", f"{data}/test/hidden_test_ground_truth.tsv"], spark)
    assert results["predict"]["test"]["f05"] > 0.5
    ids = [x.split("\t")[0] for x in (data / "test/test_source1.tsv").read_text().splitlines()[1:]]
    matches, candidates = ([x.split("\t") for x in (out / f).read_text().splitlines()[1:]] for f in ("matching_results.tsv", "candidate_pairs.tsv"))
    assert [m[0] for m in matches] == [c[0] for c in candidates] == ids
    known = {c[0]: set(c[1].split(",")) for c in candidates}
    assert all(set(m[1].split(",")) - {""} <= known[m[0]] for m in matches)
    report = json.loads((out / "report.json").read_text())
    assert report["cv"]["f05"] > 0.5 and report["candidates"]["pair_recall"] > 0.9 and report["max_owners"] >= 1
    if method == "boosted":
        assert set(report["ablations"]) >= {"p >= 0.5", "auto"} and report["ablations"]["auto"] == pytest.approx(report["cv"]["f05"])
        assert all(set(x) == {"without", "in_distribution"} for x in report.get("leave_one_country_out", {}).values())


def test_predict_alone_equals_all(spark, data, tmp_path):
    """A fit reuses what validation left only where that is the same."""
    config = tmp_path / "config.json"
    config.write_text(json.dumps(SMALL["boosted"]))
    lists = []
    for command in ("all", "predict"):
        cli.main(["boosted", command, "--data-dir", str(data), "--out-dir", str(tmp_path / command), "--config", str(config), "--folds", "2"], spark)
        lists.append((tmp_path / command / "matching_results.tsv").read_text())
    assert lists[0] == lists[1]


def test_array_policies_equal_those_of_frames(spark):
    """The fit on sampled arrays and that over frames choose alike and decide alike."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(f"s{i}", f"c{int(c)}", bool(rng.random() < p), float(p)) for i in range(40) for c, p in zip(rng.choice(60, 4, replace=False), rng.random(4).round(3), strict=True)], columns=["s1_id", "c_id", "label", "prob"])
    truth = rows.groupby("s1_id")["label"].sum().rename("n_true").reset_index()
    block = methods.PolicyBlock(rows, truth)
    prob = block.pairs["prob"].to_numpy()
    frame, counts = spark.createDataFrame(rows), spark.createDataFrame(truth)
    for kinds, strategies in ((("none",), ("threshold",)), (("soft",), ("expected_f",)), (("none", "hard", "soft"), ("expected_f", "threshold"))):
        got, f = block.chosen(block.candidates(prob, np.full(40, True)), kinds, strategies)
        want, g = decisions.fit_policy(frame, "prob", counts, kinds, strategies)
        assert f == pytest.approx(g) and (got.exclusivity, got.strategy, got.tau, got.delta) == (want.exclusivity, want.strategy, want.tau, want.delta) and got.calib_a == pytest.approx(want.calib_a, abs=1e-6)
        picked, q = block.decide(got, prob)
        chosen = {(r.s1_id, r.c_id): (r.selected, r.q) for r in decisions.apply_policy(frame, "prob", want).collect()}
        keys = list(zip(block.pairs["s1_id"], block.pairs["c_id"], strict=True))
        assert {keys[i] for i in picked} == {k for k, (s, _) in chosen.items() if s} and all(chosen[k][1] == pytest.approx(x, abs=1e-6) for k, x in zip(keys, q, strict=True))


@pytest.mark.parametrize("kind", ["rules", "retrieval"])
def test_array_decisions_equal_those_of_frames(spark, kind):
    rng = np.random.default_rng(9)
    state = lambda: rng.choice([0.0, 1.0, np.nan])
    rows = pd.DataFrame([(f"s{i}", f"c{int(c)}", True, round(float(rng.random()), 2), state() if rng.random() < 0.2 else round(float(rng.random()), 2), state(), state(), state()) for i in range(60) for c in rng.choice(50, 5, replace=False)], columns=["s1_id", "c_id", "label", "name_sim", "addr_sim", "postal", "house", "country"])
    truth = pd.DataFrame({"s1_id": [f"s{i}" for i in range(60)], "n_true": 5})
    block = methods.TunedBlock(rows, truth)
    frame = spark.createDataFrame(pa.Table.from_pandas(rows.astype(object).where(rows.notna(), None), preserve_index=False))
    for seed in range(3):
        space = {k: np.random.default_rng(seed).uniform(d.low, d.high) for k, d in methods.METHODS[kind].space.items()}
        params = methods.METHODS[kind].params(**space)
        decided = (decisions.decide_rules if kind == "rules" else decisions.decide_score)(frame, params)
        want = {(r.s1_id, r.c_id) for r in decided.where("selected").collect()}
        assert {(rows.s1_id[i], rows.c_id[i]) for i in block.decide(params)} == want


def test_compact_features(spark, data):
    """Fifty columns, whole-name acronyms, and a matcher that runs on them."""
    from kindra.operators.features import feature_names
    from kindra.sources import tables

    method = methods.configured("boosted", {"feature_set": "compact", "inner_folds": 2, "boost": {"max_rounds": 10}, "calibrate_once": True, "strategies": ["threshold"], "average_folds": True})
    split = tables.read_split(spark, str(data), "train")
    pairs, truth, _ = cli.labelled(method, split)
    assert len(feature_names(pairs)) == 50
    model = method.fit(pairs, truth)
    assert len(model.models) == 2 and model.policy.strategy == "threshold" and method.predict(model, pairs).where("selected").count() > 50


def test_generated_data_repeats(tmp_path):
    for k in ("a", "b"):
        write_dataset(str(tmp_path / k), 30, 20, 5)
    for f in ("train/train_source2.tsv", "test/hidden_test_ground_truth.tsv"):
        assert (tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes()
    assert "France" in (tmp_path / "a/test/test_source1.tsv").read_text() and "France" not in (tmp_path / "a/train/train_source1.tsv").read_text()
