import json

import pytest

from folioscope.streaming.lease import Lease, LeaseLost, _create, committed
from folioscope.workers import children


def test_one_of_two_writers_wins_and_an_ended_lease_passes_on(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    a = Lease.acquire(spark, path, "a", 100.0, 60)
    assert a.number == 1 and Lease.acquire(spark, path, "b", 159.0, 60) is None
    assert a.commit({"day": 1}) == 1
    b = Lease.acquire(spark, path, "b", 161.0, 60)
    assert b.number == 2 and not a.holds() and b.holds()
    with pytest.raises(LeaseLost):
        a.commit({"day": 2})
    assert b.commit({"day": 3}) == 2
    assert committed(spark, path) == [{"day": 1}, {"day": 3}]


def test_release_races_and_dead_writers(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    a = Lease.acquire(spark, path, "a", 0.0, 1000)
    a.release()
    a.release()
    b = Lease.acquire(spark, path, "b", 1.0, 1000)
    assert b.number == 2
    # Two that saw the same last lease reach for the same number.
    assert not _create(spark, f"{path}/leases/2", {}) and _create(spark, f"{path}/leases/3", {"owner": "c", "ends": 9})
    (tmp_path / "lock/leases/4").write_text('{"owner": "d", "en')  # died while it wrote
    e = Lease.acquire(spark, path, "e", 2.0, 1000)
    assert e.number == 5 and children(spark, f"{path}/leases") == ["1", "2", "3", "4", "5"]
    assert committed(spark, path) == []


def test_a_stale_commit_that_slips_in_is_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    a = Lease.acquire(spark, path, "a", 0.0, 10)
    b = Lease.acquire(spark, path, "b", 20.0, 10)
    b.commit({"n": 1})
    (tmp_path / "lock/commits/2").write_text(json.dumps({"lease": a.number, "owner": "a", "what": {"n": 2}}))  # written after its check, before b's next
    assert b.commit({"n": 3}) == 3
    assert committed(spark, path) == [{"n": 1}, {"n": 3}]
    assert committed(spark, f"file://{tmp_path}/none") == []
