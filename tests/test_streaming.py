import os
import shutil
import threading
import time

import pytest

from tableinsight.streaming.gate import ArrivalGate


def _drop(folder, name, n, age=0):
    """Write a CSV elsewhere, then move it in; ``age`` orders arrivals by modification time."""
    staged = folder.parent / name
    staged.write_text("customer_id,platform\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(n)))
    os.utime(staged, (1_700_000_000 + age, 1_700_000_000 + age))
    shutil.move(staged, folder / name)


@pytest.fixture
def watch(tmp_path):
    folder = tmp_path / "watch"
    folder.mkdir()
    return folder


def _gate(spark, watch, **options):
    state = watch.parent / "state"
    return ArrivalGate(spark, str(watch), str(state), **options)


def test_spike_triggers_and_state_survives_restart(spark, watch):
    seen = []
    options = {"max_files": 3, "analysis": lambda s, path, folder: seen.append(path.rsplit("/", 1)[1])}
    for i in range(4):
        _drop(watch, f"f{i}.csv", 100, i)
    _gate(spark, watch, **options).run_available()
    assert seen == ["f0.csv", "f1.csv"]
    # A new gate object continues from the checkpointed history.
    _drop(watch, "f4.csv", 100, 4)
    _drop(watch, "f5.csv", 5000, 5)
    gate = _gate(spark, watch, **options)
    gate.run_available()
    assert seen == ["f0.csv", "f1.csv", "f5.csv"]
    last = gate.decisions().orderBy("modified").collect()[-1]
    assert (last.n, last.z_score, last.direction) == (5000, 2.2361, "hausse")
    gate.run_available()
    assert gate.decisions().count() == 6


def test_what_counts_as_an_arrival(spark, watch):
    _drop(watch, "HEADER.CSV", 0)
    _drop(watch, "été 100% (a).csv", 4)
    (watch / "empty.csv").write_text("")
    (watch / "broken.parquet").write_text("not parquet")
    (watch / "notes.txt").write_text("a\nb\n")
    (watch / "data.json").write_text('{"a": 1}\n{"a": 2}\n')
    (watch / "sub").mkdir()
    _drop(watch / "sub", "deep.csv", 3)
    gate = _gate(spark, watch, max_files=10, analysis=lambda *_: None)
    gate.run_available()
    arrivals = {r.path.rsplit("/", 1)[1]: (r.n, r.status) for r in gate.arrivals().collect()}
    assert arrivals == {
        "HEADER.CSV": (0, "counted"), "data.json": (2, "counted"),
        "été 100% (a).csv": (4, "counted"),
        "broken.parquet": (None, "unreadable"),
    }  # a file without a byte is no arrival
    assert {r.n for r in gate.decisions().collect()} == {0, 2, 4}


def test_approval(spark, watch):
    seen = []
    gate = _gate(spark, watch, max_files=5, require_approval=True,
                 analysis=lambda s, path, folder: seen.append(folder))
    _drop(watch, "a.csv", 10)
    _drop(watch, "b.csv", 10, 1)
    gate.run_available()
    runs = {r.run_id.rsplit("-", 1)[0]: r for r in gate.runs().collect()}
    assert set(runs) == {"stream-a", "stream-b"} and not seen
    gate.approve(runs["stream-a"].run_id)
    gate.reject(runs["stream-b"].run_id)
    assert len(seen) == 1 and "/a_" in seen[0]
    assert {r.run_id.rsplit("-", 1)[0]: r.status for r in gate.runs().collect()} == {
        "stream-a": "approved", "stream-b": "rejected",
    }
    with pytest.raises(KeyError):
        gate.approve(runs["stream-a"].run_id)
    with pytest.raises(KeyError):
        gate.reject("stream-none-00000000")


def test_automatic_run_writes_deliverables(spark, watch):
    gate = _gate(spark, watch)
    _drop(watch, "sales.csv", 30)
    gate.run_available()
    (folder,) = (watch.parent / "state" / "deliverables").iterdir()
    assert folder.name.startswith("sales_")
    assert spark.read.parquet(f"{folder}/driver_tests").first().dimension == "platform"
    report = [r.value for r in spark.read.text(f"{folder}/report").collect()]
    assert any("30 lignes" in line for line in report)


def test_a_failing_run_leaves_the_others(spark, watch):
    """Runs go side by side; a bad file has its error as outcome and can be tried again."""
    together, most, failing = set(), [], {"b.csv"}
    lock = threading.Lock()

    def analysis(session, path, folder):
        name = path.rsplit("/", 1)[1]
        with lock:
            together.add(name)
            most.append(len(together))
        time.sleep(0.5)
        with lock:
            together.discard(name)
        if name in failing:
            session.table("no_such_table")
        session.range(3).write.mode("overwrite").parquet(folder)

    for i, name in enumerate(["a.csv", "b.csv"]):
        _drop(watch, name, 10, i)
    gate = _gate(spark, watch, max_files=5, width=2, analysis=analysis)
    gate.run_available()
    outcomes = {r.path.rsplit("/", 1)[1]: r for r in gate.outcomes().collect()}
    assert outcomes["a.csv"].status == "done" and spark.read.parquet(outcomes["a.csv"].folder).count() == 3
    assert outcomes["b.csv"].status == "failed" and "TABLE_OR_VIEW_NOT_FOUND" in outcomes["b.csv"].error
    assert max(most) == 2
    with pytest.raises(RuntimeError, match="TABLE_OR_VIEW_NOT_FOUND"):
        gate.retry(outcomes["b.csv"].run_id)
    failing.clear()
    gate.retry(outcomes["b.csv"].run_id)
    assert {r.status for r in gate.outcomes().collect()} == {"done"} and gate.outcomes().count() == 2
    with pytest.raises(KeyError):
        gate.retry(outcomes["b.csv"].run_id)


def test_history_gives_the_state_a_start(spark, watch):
    """Earlier counts are no arrivals: nothing is decided on them, and only a first start takes them."""
    history = spark.createDataFrame(
        [(f"2020-01-0{i + 1} 00:00:00", 100) for i in range(5)], "modified string, n int"
    ).selectExpr("to_timestamp(modified) AS modified", "n")
    options = {"max_files": 5, "require_approval": True, "history": history}
    _drop(watch, "f0.csv", 100, 0)
    _gate(spark, watch, **options).run_available()
    gate = _gate(spark, watch, **options)
    _drop(watch, "f1.csv", 5000, 1)
    gate.run_available()
    found = [(r.n, r.reason, r.anomaly, r.z_score) for r in gate.decisions().orderBy("modified").collect()]
    assert found == [(100, "pas_de_variance", False, None), (5000, None, True, 2.4495)]


def test_unreadable_files_have_a_table(spark, watch):
    _drop(watch, "good.csv", 5)
    (watch / "broken.parquet").write_text("not parquet")
    gate = _gate(spark, watch, max_files=10, require_approval=True)
    gate.run_available()
    (row,) = gate.unreadable().collect()
    assert row.path.endswith("/broken.parquet") and row.error and "\n" not in row.error
    assert gate.decisions().count() == 1
