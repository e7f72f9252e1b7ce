"""Keyed tables, figures kept beside them, exact quantiles: whatever comes in whatever order, equal to making them anew."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from galleon.operators import annotations as an, kept
from galleon.operators.graph import connected_components
from galleon.sources.keyed import Conflict, KeyedTable, removed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def keep(df):
    return df.checkpoint()


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    t.create(spark.range(100).withColumn("v", F.lit(0)))
    return t


def test_merges_share_what_they_do_not_touch(spark, table, tmp_path):
    first = table.manifest()["folders"]
    v = table.upsert(spark.createDataFrame([(3, 7)], "id long, v int"))
    second = table.manifest()["folders"]
    assert sum(first[b] != second[b] for b in first) == 1 and table.differing(0, v) == {int(b) for b in first if first[b] != second[b]}
    assert rows(table.read().where("v <> 0")) == [(3, 7)] and table.read().count() == 100
    assert table.read(0).where("v <> 0").count() == 0  # readers of the old version keep it
    written = {d for d in os.listdir(f"{tmp_path}/t/files")}
    assert len(written) == 2
    table.delete(spark.range(50, 100))
    table.delete(spark.range(0, 50))
    assert table.read().count() == 0 and table.read().columns == ["id", "v"]
    table.upsert(spark.createDataFrame([], "id long, v int"))
    table.upsert(spark.createDataFrame([(1, 1), (1000, 2)], "id long, v int"))
    assert rows(table.read()) == [(1, 1), (1000, 2)]
    with pytest.raises(Conflict):
        table.create(spark.range(1).withColumn("v", F.lit(0)))


def test_two_writers_at_once_lose_nothing(spark, table):
    """Each adds 1 to every row, five times; one of them adds rows of its own as well."""
    add = lambda old, new: old.join(new.withColumnRenamed("v", "d"), "id", "full").select("id", (F.coalesce("v", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("int").alias("v"))
    failed = []

    def write(k):
        try:
            for n in range(5):
                more = spark.createDataFrame([(1000 * k + n, 0)], "id long, v int")
                table.merge(spark.range(100).withColumn("v", F.lit(1)).unionByName(more), add)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    both = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert not failed and table.version() == 10
    assert rows(table.read().where("id < 100").groupBy("v").count()) == [(10, 100)] and table.read().count() == 110


def test_work_is_taken_over_when_its_buckets_are_as_they_were(spark, table, monkeypatch):
    """The other writer commits in between, elsewhere: what was written counts, and isn't written again."""
    place = {r["id"]: r["_bucket"] for r in table._placed(spark.range(100)).collect()}
    mine, elsewhere = 1, next(i for i in range(100) if place[i] != place[1])
    other, stored, calls = KeyedTable(spark, table.path, ["id"], buckets=8), table._stored, []

    def slow(df):
        calls.append(1)
        found = stored(df)
        other.upsert(spark.createDataFrame([(elsewhere, 5)], "id long, v int"))
        return found

    monkeypatch.setattr(table, "_stored", slow)
    table.upsert(spark.createDataFrame([(mine, 9)], "id long, v int"))
    assert len(calls) == 1 and rows(table.read().where("v > 0")) == sorted([(mine, 9), (elsewhere, 5)])
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(mine, 1)], "id long, v int"), expect=0)


def test_tag_counts_follow_any_changes(spark, tmp_path):
    """Random links, groups and deletes: after each refresh the counts are those made anew; a lost refresh is made up for."""
    r = random.Random(6)
    new = lambda name, keys, by=None: KeyedTable(spark, f"file://{tmp_path}/{name}", keys, by, 4)
    links, posts, counts = new("links", ["post_id", "tag_name"], ["post_id"]), new("posts", ["id"]), new("counts", ["name"])
    feed = kept.TagCounts(links, posts, counts)
    links.create(spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)], "post_id long, tag_name string"))
    posts.create(spark.createDataFrame([(i, i - 1 if i % 4 == 1 else None) for i in range(40)], "id long, canonical_post_id long"))
    for step in range(5):
        some = r.sample(range(50), 8)
        match step:
            case 0 | 3:
                links.upsert(spark.createDataFrame([(i, f"t{r.randrange(7)}") for i in some], "post_id long, tag_name string").distinct())
                posts.upsert(spark.createDataFrame([(i, r.choice([None, 0])) for i in some], "id long, canonical_post_id long"))
            case 1:
                links.delete(spark.createDataFrame([(i, f"t{i % 5}") for i in some], "post_id long, tag_name string"))
                continue  # this refresh is lost
            case 2:
                posts.delete(spark.createDataFrame([(i,) for i in some], "id long"))
        first, second = feed.refresh(), feed.refresh()
        assert second == 0 and (first > 0 or step == 4)
        want = links.read().join(posts.read().where("canonical_post_id IS NULL").select(F.col("id").alias("post_id")), "post_id", "left_semi").groupBy("tag_name").count()
        assert rows(counts.read()) == rows(want)
    with pytest.raises(ValueError):
        kept.TagCounts(links, KeyedTable(spark, f"file://{tmp_path}/x", ["id"], buckets=3), counts)


def test_comparison_graph_follows_batches(spark, tmp_path):
    r = random.Random(8)
    nodes = KeyedTable(spark, f"file://{tmp_path}/nodes", ["id"], buckets=4)
    graph, seen = kept.ComparisonGraph(nodes, keep), []
    kind = "post_a long, post_b long, winner string"
    for batch, size in enumerate((6, 10, 0, 12, 25)):
        new = [(r.randrange(40), r.randrange(40), r.choice(["a", "b", "tie", "skip"])) for _ in range(size)]
        seen += new
        assert graph.add(spark.createDataFrame(new, kind), batch) and not graph.add(spark.createDataFrame(new, kind), batch)
        every = spark.createDataFrame(seen, kind).where("winner <> 'skip'")
        parts = connected_components(every.select(F.col("post_a").alias("a"), F.col("post_b").alias("b")))
        got = nodes.read()
        assert rows(got.select("id", "degree", "wins", "losses")) == rows(an.win_loss(spark.createDataFrame(seen, kind), None))
        alone = got.join(parts.select("id"), "id", "left_anti").where("id <> component").count()
        assert rows(got.join(parts.select("id"), "id", "left_semi").select("id", "component")) == rows(parts) and alone == 0


def test_deleting_with_a_function(spark, table):
    table.merge(spark.range(0, 100, 2), removed(["id"]))
    assert rows(table.read().agg(F.count("*"), F.min("id"))) == [(50, 1)]


@pytest.mark.parametrize("rounds", [12, 1])
def test_groups_of_new_vectors_like_a_rebuild(spark, tmp_path, monkeypatch, rounds):
    """Batches in any order of ids, with copies of vectors that are there, chains and an empty batch."""
    import numpy as np

    from galleon.operators import regroup
    from galleon.operators.dedup import grouped_vectors

    monkeypatch.setattr(regroup, "ROUNDS", rounds)
    g, kind = np.random.default_rng(5), "post_id long, embedding array<double>"
    turn = [[float(np.cos(t)), float(np.sin(t)), 0.0, 0.0] for t in np.linspace(0, 1.5, 25)]  # a chain of near ones
    v = turn + [(x + g.normal(size=4) * 0.01).tolist() for x in np.repeat(g.normal(size=(4, 4)), 5, 0)]
    v += [v[i] for i in (3, 7, 30, 31)] + [[0.0] * 4]
    ids = g.permutation(len(v)).tolist()
    groups = regroup.NearGroups(spark, f"file://{tmp_path}/near", 0.01, keep, buckets=4, block=8)
    assert groups.groups().count() == 0
    have = []
    for n, part in enumerate((range(0, 30), range(0), range(30, len(v)))):
        new = [(ids[i], v[i]) for i in part]
        have += new
        assert groups.add(spark.createDataFrame(new, kind)) == n + 1
        want = rows(grouped_vectors(spark.createDataFrame(have, kind), 0.01, keep).select("member", "canonical"))
        assert rows(groups.groups()) == want and want


@pytest.mark.parametrize("small", [1, 20, 100_000])
def test_quantiles_like_the_aggregate(spark, monkeypatch, small):
    """Skewed, tied, huge and few values: what `percentile` gives, however small the ranges are made."""
    from galleon.operators import stats

    monkeypatch.setattr(stats, "SMALL", small)
    monkeypatch.setattr(stats, "PARTS", 4)
    r, shares = random.Random(9), (0.0, 0.05, 0.5, 0.731, 0.95, 1.0)
    for values in ([r.gauss(0, 1) for _ in range(300)], [float(r.randrange(3)) for _ in range(200)] + [1e300, -1e300, 5e-324], [2.0] * 50, [1.0, None, 4.0], [None], [-(10.0 ** r.randrange(-9, 9)) for _ in range(150)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = list(df.agg(*[F.percentile("x", F.lit(s)) for s in shares]).first())
        assert stats.quantiles(df, "x", shares) == pytest.approx(want, rel=1e-12) if want[0] is not None else stats.quantiles(df, "x", shares) == want


def test_tasks_expire_like_a_batch_at_several_times(spark, tmp_path):
    """After each part, with a restart between parts: kept is what is younger than its time at the newest update."""
    from galleon.streaming import tasks

    r, hour = random.Random(10), 3_600_000_000
    updates, t = [], 1_700_000_000_000_000
    for seq in range(120):
        t += r.choice([0, hour // 7, hour // 2, 5 * hour])
        updates.append((r.randrange(12), seq, r.choice(["done", "running", "failed"]), t))
    top = f"file://{tmp_path}"
    for part in (updates[:40], updates[40:41], updates[41:]):
        df = spark.createDataFrame(part, "task_id long, seq long, state string, us long")
        df.select("task_id", "seq", "state", F.timestamp_micros("us").alias("updated_at")).coalesce(1).write.mode("append").parquet(f"{top}/in")
        tasks.retain_tasks(spark, f"{top}/in", f"{top}/out", f"{top}/state")
        seen = updates[: updates.index(part[-1]) + 1]
        last = {u[0]: u for u in seen}
        want = sorted(((k, u[2]) for k, u in last.items() if u[3] // 1000 + tasks.kept_for(u[2]) >= seen[-1][3] // 1000), key=repr)
        assert rows(tasks.shown_tasks(spark, f"{top}/out").select("task_id", "state")) == want
    assert want and len(want) < len(last)


def test_timeline_head_after_any_changes(spark, tmp_path):
    r = random.Random(11)
    new = lambda name, buckets: KeyedTable(spark, f"file://{tmp_path}/{name}", ["kind", "id"], buckets=buckets)
    events, head = new("events", 4), new("head", 1)
    kind = "kind string, id long, created_at timestamp, verdict string"
    frame = lambda some: spark.createDataFrame(some, "kind string, id long, s long, verdict string").select("kind", "id", F.timestamp_seconds("s").alias("created_at"), "verdict")
    state = {(r.choice("ab"), i): (r.randrange(1000), "x") for i in range(40)}
    events.create(frame([(*k, *v) for k, v in state.items()]))
    top, how = kept.TimelineHead(events, head, 5, reserve=3), []
    assert events.read().dtypes == spark.createDataFrame([], kind).dtypes
    how.append(top.refresh())
    newest = lambda n: sorted(((v[0], *k, v[1]) for k, v in state.items()), reverse=True)[:n]
    for step in range(6):
        match step % 3:
            case 0:
                some = {(r.choice("ab"), 100 + 10 * step + i): (r.randrange(1100), "new") for i in range(3)}
                some |= {(x[1], x[2]): (x[0], "edit") for x in newest(2)}
                state |= some
                events.upsert(frame([(*k, *v) for k, v in some.items()]))
            case 1:
                gone = [(x[1], x[2]) for x in newest(2 if step < 3 else 7)]
                state = {k: v for k, v in state.items() if k not in gone}
                events.delete(spark.createDataFrame(gone, "kind string, id long"))
            case 2 if step > 3:
                events.delete(events.read().where("id >= 3"))
                state = {k: v for k, v in state.items() if k[1] < 3}
        how.append(top.refresh())
        got = [(r_["kind"], r_["id"], r_["verdict"]) for r_ in top.page().collect()]
        assert got == [(x[1], x[2], x[3]) for x in newest(5)]
    assert {"same", "kept", "filled"} <= set(how)
    events.delete(events.read())
    top.refresh()
    assert top.page().count() == 0


def test_workers_wake_and_idle(spark, tmp_path):
    from galleon.streaming.workers import Chain, Worker

    table = lambda name, keys: KeyedTable(spark, f"file://{tmp_path}/{name}", keys, buckets=2)
    scores = lambda name: (t := table(name, ["post_id"])).create(spark.createDataFrame([], "post_id long, score double")) or t
    posts, failures = table("posts", ["id"]), table("failures", ["post_id", "worker"])
    posts.create(spark.range(6).select("id"))
    failures.create(spark.createDataFrame([], "post_id long, worker string, error string"))

    def first(ids):
        if 3 in ids:
            raise ValueError("three")
        return [float(i) for i in ids]

    tables = {"posts": posts, "failures": failures, "one": scores("one"), "two": scores("two")}
    chain = Chain(tables, [Worker("one", ("posts",), lambda p: p, first), Worker("two", ("one",), lambda o: o.select(F.col("post_id").alias("id")), lambda ids: [i + 0.5 for i in ids])], keep)
    assert chain.drain() == {"one": 6, "two": 5} and chain.drain() == {"one": 0, "two": 0}
    assert rows(failures.read()) == [(3, "one", "ValueError: three")] and rows(tables["two"].read())[-1] == (5, 5.5)
    assert all(chain.pending(w).isEmpty() for w in chain.workers)
    posts.upsert(spark.range(6, 8).select("id"))
    failures.delete(spark.createDataFrame([(3, "one")], "post_id long, worker string"))
    assert chain.drain() == {"one": 3, "two": 2}  # three is tried again, and fails again
