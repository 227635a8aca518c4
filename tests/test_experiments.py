import pytest

from tollgate.plans import experiments


def test_unknown_name_exits_with_2(capsys):
    assert experiments.main(["nothing"]) == 2


@pytest.mark.parametrize("name", ["mechanism", "online", "incidents", "replay", "feature_parity"])
def test_small(spark, monkeypatch, name):
    for k, v in (("ROWS", 300), ("ATTEMPTS", 40), ("WIDTH", 3), ("DEPTH", 1), ("EPOCHS", 2)):
        monkeypatch.setattr(experiments, k, v)
    assert experiments.EXPERIMENTS[name](spark).count() > 0


def test_one_experiment_of_each_shape(spark, monkeypatch):
    monkeypatch.setattr(experiments, "ROWS", 600)
    monkeypatch.setattr(experiments, "ATTEMPTS", 60)
    monkeypatch.setattr(experiments, "SHARDS", (1, 4))
    for k, v in (("WIDTH", 3), ("DEPTH", 1), ("EPOCHS", 2)):
        monkeypatch.setattr(experiments, k, v)
    assert experiments.ablation(spark).count() == 5
    got = {r.routing: r for r in experiments.sharding(spark).collect()}
    assert all(got[f"{k}/1"].edges_kept == 1.0 for k in ("random", "bin_id", "device_id")) and got["random/4"].edges_kept < 0.5 and got["random/4"].largest_shard_share < 0.5
    faults = {r.fault: r.quarantined for r in experiments.resilience(spark).collect()}
    assert faults["clean"] == 0 and faults["nan_amount"] > 0 and faults["dropped_approved"] > 0
