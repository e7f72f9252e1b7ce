"""Watching a library: listings, failures, replays, quiet, turns."""

import os
import shutil
import threading
import time
import uuid

import pytest

from galleon.sources import watched as wa
from galleon.sources.keyed import Conflict, KeyedTable
from galleon.sources.lease import SingleFlight
from galleon.streaming import sync as sy

OLD = time.time() - 3600


def lay(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")


def age(root):
    """Directories look as if nothing had happened for an hour."""
    for here, _, _ in os.walk(root):
        os.utime(here, (OLD, OLD))


def known(spark, root, state):
    df = wa.known_files(spark, str(root), str(state), 4)
    return sorted(tuple(r)[:3] for r in df.where("NOT failed").collect()), sorted(r[0] for r in df.where("failed").collect())


def keeper(spark, tmp_path):
    def keep(df):
        path = f"{tmp_path}/kept/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "root"
    lay(root, "a.jpg", ".dot.jpg", "b.part", ".hidden/x.jpg", "s/.c.png", "s/t/u/d.webp", "s/t/u/noext", "v/e.jpg")
    (root / "empty/below").mkdir(parents=True)
    age(root)
    return root, tmp_path / "state", str(tmp_path / "cp")


FIRST = [(".", "a", "jpg"), ("s", ".c", "png"), ("s/t/u", "d", "webp"), ("s/t/u", "noext", ""), ("v", "e", "jpg")]


def test_only_what_changed_is_listed(spark, place):
    root, state, cp = place
    n = sy.settle(spark, str(root), str(state), cp, 4)
    assert known(spark, root, state) == (FIRST, [])
    assert n["listed"] == n["found"] == 7 and n["added"] == 5 and n["polls"] >= 5
    n = sy.settle(spark, str(root), str(state), cp, 4)
    assert n["listed"] == 0 and n["polls"] == 2  # directories that are as they were are only asked for their time
    lay(root, "s/new.jpg", "s/w/f.jpg")
    shutil.rmtree(root / "v")
    os.unlink(root / "s/t/u/noext")
    age(root)
    for d in (".", "s", "s/t/u"):
        os.utime(root / d, (OLD + 5, OLD + 5))
    n = sy.settle(spark, str(root), str(state), cp, 4)
    assert (n["listed"], n["found"], n["added"], n["removed"]) == (4, 1, 2, 2)
    assert known(spark, root, state)[0] == [(".", "a", "jpg"), ("s", ".c", "png"), ("s", "new", "jpg"), ("s/t/u", "d", "webp"), ("s/w", "f", "jpg")]
    os.utime(root / "s")  # changed this instant: asked again until its time is sure
    n = sy.settle(spark, str(root), str(state), cp, 4)
    assert n["listed"] >= 1 and n["added"] == n["removed"] == 0


def test_unreadable_folders_keep_what_was_known(spark, place, monkeypatch):
    root, state, _ = place
    k = wa.Known(str(root), str(state), 2)
    for poll in range(1, 6):
        for i in (0, 1):
            k.poll(i, poll)
    files = lambda: sorted((d, f) for i in (0, 1) for d, (_, fs, _) in k.load(i, 99)[1].items() for f in fs)
    before = files()
    assert len(before) == 5
    os.utime(root / "s/t/u")
    real = wa.entries
    monkeypatch.setattr(wa, "entries", lambda p, top: (_ for _ in ()).throw(PermissionError(p)) if p.endswith("s/t/u") else real(p, top))
    n = [k.poll(i, 6) for i in (0, 1)]
    assert sum(x["failed"] for x in n) == 1 and sum(x["removed"] for x in n) == 0 and files() == before
    assert known_failed(k) == ["s/t/u"]
    monkeypatch.undo()
    for i in (0, 1):
        k.poll(i, 7)
    assert known_failed(k) == [] and files() == before
    os.rename(root, str(root) + "-away")  # an unmounted library loses nothing
    n = [k.poll(i, 8) for i in (0, 1)]
    assert files() == before and all(k.load(i, 99)[2] for i in (0, 1)) and not any(x["removed"] for x in n)
    os.rename(str(root) + "-away", root)
    assert [k.poll(i, 9)["removed"] for i in (0, 1)] == [0, 0] and not k.load(0, 99)[2]


def known_failed(k):
    return [d for i in (0, 1) for d, (_, _, bad) in k.load(i, 99)[1].items() if bad]


def test_a_poll_that_runs_again_gives_the_same(spark, place):
    root, state, _ = place
    k = wa.Known(str(root), str(state), 1)
    first = k.poll(0, 1)
    lay(root, "late.jpg")
    assert k.poll(0, 1) == first  # made once
    for poll in (2, 3, 4, 5):
        k.poll(0, poll)
    assert k.poll(0, 2)["found"] == 3
    k.forget(5)
    assert 5 in k.polls(0) and 2 not in k.polls(0) and not any(k.poll(0, 2).values())  # an older batch makes nothing
    shutil.rmtree(root / "s")
    (root / "s").write_text("now a file")
    os.utime(root)
    assert k.poll(0, 6)["removed"] == 3
    assert sorted(k.load(0, 6)[1]) == [".", "empty", "empty/below", "v"]


def test_a_folder_made_again_between_polls(place):
    root, state, _ = place
    k = wa.Known(str(root), str(state), 3)
    poll = 0

    def run(only=range(3)):
        nonlocal poll
        poll += 1
        return [k.poll(i, poll) for i in only]

    for _ in range(5):
        run()
    shutil.rmtree(root / "v")
    v = wa.owner("v", 3)
    poll += 1
    k.poll(v, poll)  # its own slice finds it gone, before the others look
    lay(root, "v/again.jpg")
    for i in range(3):
        k.poll(i, poll)
    run()
    run()
    assert "again.jpg" in k.load(v, 99)[1]["v"][1]


def test_sync_posts(spark, place, tmp_path):
    root, state, cp = place
    keep = keeper(spark, tmp_path)
    posts = KeyedTable(spark, f"file://{tmp_path}/posts", sy.KEY, buckets=4)
    posts.create(spark.createDataFrame([(7, ".", "a", "jpg"), (9, "gone", "x", "jpg")], "id long, file_path string, file_name string, extension string"))
    sy.settle(spark, str(root), str(state), cp, 4)
    files = lambda: wa.known_files(spark, str(root), str(state), 4)
    assert sy.sync_posts(files(), posts, keep) == {"added": 4, "removed": 1, "held": False}
    got = {tuple(r)[1:]: r.id for r in posts.read().select("id", *sy.KEY).collect()}
    assert sorted(got) == FIRST and got[FIRST[0]] == 7 and len(set(got.values())) == 5 and min(got.values()) == 7
    assert sy.sync_posts(files(), posts, keep)["added"] == 0 and posts.version() == 1  # nothing to do, no version
    bad = files().where("file_path <> 's/t/u'").unionByName(spark.createDataFrame([("s/t", None, None, True)], wa.FILES))
    assert sy.sync_posts(bad, posts, keep) == {"added": 0, "removed": 0, "held": False}  # below a folder that failed
    more = spark.range(200).selectExpr("id + 100 AS id", "'m' AS file_path", "string(id) AS file_name", "'jpg' AS extension")
    posts.upsert(more)
    assert sy.sync_posts(files(), posts, keep) == {"added": 0, "removed": 0, "held": True}
    assert sy.sync_posts(files(), posts, keep, True)["removed"] == 200


def test_quiet_and_auto_sync(spark, place, tmp_path):
    """A burst of changes in several polls is one reconciliation, after the quiet that follows it."""
    root, _, _ = place
    posts = KeyedTable(spark, f"file://{tmp_path}/posts", sy.KEY, buckets=2)
    posts.create(spark.createDataFrame([], "id long, file_path string, file_name string, extension string"))
    done = []
    query = sy.auto_sync(spark, str(root), str(tmp_path / "shared"), posts, keeper(spark, tmp_path), "200 milliseconds", 5.0, 2, done.append)
    try:
        assert [d["added"] for d in done] == [5]  # at the start
        for k in range(4):
            lay(root, f"burst/{k}.jpg")
            time.sleep(0.7)
        until = time.time() + 60
        while sum(d["added"] for d in done) < 9 and time.time() < until:
            assert query.exception() is None
            time.sleep(0.2)
        assert sum(d["added"] for d in done) == 9 and posts.read().count() == 9
        assert len(done) < 5  # not one for each file, however slow the machine is
    finally:
        query.stop()


def test_single_flight(spark, tmp_path):
    """Of three callers one runs, one rerun follows."""
    folder, began, go, ran = f"file://{tmp_path}/flight", threading.Event(), threading.Event(), []

    def work(turn, rerun):
        ran.append((turn, rerun))
        began.set()
        go.wait(60)

    out = []
    first = threading.Thread(target=lambda: out.append(SingleFlight(spark, folder).run(work)))
    first.start()
    assert began.wait(60)
    assert [SingleFlight(spark, folder).run(work) for _ in range(2)] == [0, 0]
    go.set()
    first.join(60)
    assert out == [2] and ran == [(1, False), (1, True)]
    assert SingleFlight(spark, folder).run(work) == 1 and ran[-1] == (2, False)  # nothing is left over


def test_lost_holders_and_failing_work(spark, tmp_path):
    folder, ran = f"file://{tmp_path}/flight", []
    lost = SingleFlight(spark, folder, 1.0)
    assert lost._claim() == 1 and lost.open()  # and never heard of again
    late = SingleFlight(spark, folder, 1.0)
    assert late.run(lambda *a: ran.append(a)) == 0
    time.sleep(1.3)
    assert late.run(lambda *a: ran.append(a)) == 1 and ran == [(2, False)]  # the mark is taken by the run itself

    def fails(*_):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        late.run(fails)
    assert not late.open() and late.run(lambda *a: None) == 1

    def slow(turn, rerun):  # another one takes the turn over meanwhile
        (tmp_path / f"flight/turns/{turn + 1:012d}").write_text("")

    with pytest.raises(Conflict):
        late.run(slow)
    slow_beats = SingleFlight(spark, f"file://{tmp_path}/other", 1.2)
    held = []
    slow_beats.run(lambda *_: (time.sleep(2.5), held.append(slow_beats.open())))
    assert held == [True]  # beats keep a long run alive
