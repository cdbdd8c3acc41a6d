"""Orphan state in batches against one look at everything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quakeweave.operators import orphans as O

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def refs(spark, rows):
    return spark.createDataFrame([(r, t, k, day(n)) for r, t, k, n in rows], O.REFERENCE)


def parents(spark, rows):
    return spark.createDataFrame([(t, k, day(a), day(b)) for t, k, a, b in rows], O.PARENT)


def kinds(t):
    return {r["row_id"]: r["orphan_kind"] for r in t.snapshot().collect()}


@pytest.mark.parametrize("bound", [0, 1_000])
def test_lifecycle(spark, bound):
    t = O.OrphanTracker(spark, broadcast_keys=bound)
    first = [(1, "e", "a", 1), (2, "e", "b", 1), (3, "e", None, 1), (4, "e", "c", None), (5, "e", "a", None)]
    t.advance(refs(spark, first), parents(spark, [("e", "a", 0, None), ("e", "a", 2, None)]))
    assert kinds(t) == {2: "missing", 4: "missing"}
    t.advance(refs(spark, [(6, "e", "a", 30)]), parents(spark, [("e", "b", 5, None), ("e", "a", None, 20)]))
    assert kinds(t) == {2: "late", 4: "missing", 6: "deleted"}  # resolved late, deleted
    # A deletion that becomes known only now reopens a reference that had been fine.
    t.advance(refs(spark, []), parents(spark, [("e", "a", None, 1)]), history=refs(spark, first + [(6, "e", "a", 30)]))
    assert kinds(t) == {1: "deleted", 2: "late", 4: "missing", 6: "deleted"}
    t.advance(refs(spark, []), parents(spark, []))
    assert kinds(t)[1] == "deleted" and t.snapshot().count() == 4
    # A waiting reference whose parent turns out to have been there in time is resolved, a late one too.
    t.advance(refs(spark, []), parents(spark, [("e", "b", 0, None)]))
    assert kinds(t) == {1: "deleted", 4: "missing", 6: "deleted"}
    steps = {(r["row_id"], r["was"], r["orphan_kind"]) for r in t.transitions().collect()}
    assert steps == {(2, None, "missing"), (4, None, "missing"), (2, "missing", "late"), (6, None, "deleted"), (1, None, "deleted"), (2, "late", None)}
    assert {tuple(r) for r in t.counts().collect()} == {("e", "deleted", "2024-01", 2), ("e", "missing", None, 1)}
    by_batch = {b: t.count_history().where(F.col("batch") <= b).agg(F.sum("change")).first()[0] for b in range(5)}
    assert by_batch == {0: 2, 1: 3, 2: 4, 3: 4, 4: 3}


def test_empty(spark):
    t = O.OrphanTracker(spark)
    assert t.snapshot().count() == 0
    t.advance(refs(spark, []), parents(spark, []))
    assert t.snapshot().count() == 0 and t.counts().count() == 0


def test_months_equal_one_look(spark):
    r = random.Random(3)
    ref = [(k, r.choice(["e", "s"]), "hot" if k % 3 == 0 else f"k{r.randrange(30)}", r.randrange(200)) for k in range(800)]
    par = [(t, k, r.randrange(-20, 120), r.choice([None, r.randrange(120, 220)])) for t in ("e", "s") for k in ["hot", *[f"k{n}" for n in range(0, 30, 2)]] for _ in range(2)]
    rows = spark.createDataFrame([(t, k, day(a), day(b)) for t, k, a, b in par], "t string, k string, loaded_at timestamp, deleted_at timestamp")
    changes = O.parent_changes(rows.where("t = 'e'"), "e", F.col("k")).unionByName(O.parent_changes(rows.where("t = 's'"), "s", F.col("k")))
    t = O.track_by_month(refs(spark, ref), changes, O.OrphanTracker(spark))
    live = {}
    for kind, k, a, b in par:
        s, u = live.get((kind, k), (a, None))
        live[kind, k] = (min(s, a), b if u is None else u if b is None else min(u, b))
    want = {}
    for row, kind, k, at in ref:
        s, u = live.get((kind, k), (None, None))
        if s is None:
            want[row] = "missing"
        elif at < s:
            want[row] = "late"
        elif u is not None and at >= u:
            want[row] = "deleted"
    assert kinds(t) == want and t.batch > 5
    assert t.counts().agg(F.sum("orphans")).first()[0] == len(want)


def test_hot_keys_are_few_and_joined_apart(spark):
    ref = [(k, "e", "hot" if k % 3 else f"k{k}", 5) for k in range(900)]
    par = [("e", "hot", 0, 3), *[("e", f"k{k}", 0, None) for k in range(0, 900, 6)]]
    assert O.hot_keys(refs(spark, ref), 0.1) == [("e", "hot")]
    t = O.OrphanTracker(spark, broadcast_keys=0)
    t.advance(refs(spark, ref), parents(spark, par))
    got = kinds(t)
    assert all(got.get(k) == ("deleted" if k % 3 else None if k % 6 == 0 else "missing") for k in range(900))


def history(spark):
    """Deletions and arrivals of which the rows tell only months later."""
    ref = [(1, "e", "a", 10), (2, "e", "a", 40), (3, "e", "b", 45), (4, "e", "c", 70), (5, "e", "d", 100)]
    rows = [("a", 0, None), ("a", 95, 30), ("b", 93, None), ("b", 94, 44), ("c", 0, 200), ("d", 99, 100)]
    df = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "k string, loaded_at timestamp, deleted_at timestamp")
    return refs(spark, ref), O.parent_changes(df, "e", F.col("k"))


def test_months_reopen_and_resolve(spark):
    t = O.track_by_month(*history(spark), O.OrphanTracker(spark, broadcast_keys=0))
    assert kinds(t) == {2: "deleted", 3: "late", 5: "deleted"}
    steps = {(r["row_id"], r["was"], r["orphan_kind"], r["batch"]) for r in t.transitions().collect()}
    # In April (batch 3) row 2 is reopened and row 3 no longer missing.
    assert steps == {(2, None, "deleted", 3), (3, None, "missing", 1), (3, "missing", "late", 3), (5, None, "deleted", 3)}
    assert dict((r["seen"], r["row_id"]) for r in t.transitions().where("was IS NULL AND row_id = 2").collect()) == {1: 2}


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["changed", "log", "counts"])
def test_kill_and_resume(spark, when, monkeypatch):
    """A process that dies in the middle of a batch leaves a folder from which another one goes on."""
    t = O.OrphanTracker(spark, broadcast_keys=0)
    real = O.OrphanTracker._write

    def dying(self, df, name, schema, *args):
        out = real(self, df, name, schema, *args)
        if name == when and (args[0] if args else self.batch) == 2:
            raise Killed
        return out

    monkeypatch.setattr(O.OrphanTracker, "_write", dying)
    with pytest.raises(Killed):
        O.track_by_month(*history(spark), t)
    monkeypatch.setattr(O.OrphanTracker, "_write", real)
    again = O.OrphanTracker(spark, t.folder, broadcast_keys=0)
    assert again.batch == 2
    O.track_by_month(*history(spark), again)
    assert kinds(again) == {2: "deleted", 3: "late", 5: "deleted"} and again.counts().agg(F.sum("orphans")).first()[0] == 3
    done = O.OrphanTracker(spark, t.folder)
    assert done.batch == again.batch and kinds(done) == kinds(again)


def test_index_is_merged_after_some_batches(spark, monkeypatch):
    monkeypatch.setattr(O, "MERGE_AFTER", 2)
    t = O.OrphanTracker(spark)
    for k in range(5):
        t.advance(refs(spark, [(k, "e", f"k{k - 1}", k)]), parents(spark, [("e", f"k{k}", k, None)]))
    t.settle()
    assert t.base == 3 and kinds(t) == {0: "missing"} and t.index.count() == 5
    again = O.OrphanTracker(spark, t.folder)
    assert (again.base, again.batch, again.index_keys) == (3, 5, 5) and again.index.count() == 5
