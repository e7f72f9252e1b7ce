"""Sources, imports, versioned state and streams."""

import json
import os

from pyspark.sql import functions as F

from galleon.sources import imports as im, library_files as lf, snapshots as sn
from galleon.streaming import pipelines as sp


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_library_scan(spark, tmp_path):
    for name in ("a.jpg", "_b.jpg", ".c.jpg", "d.png.part", "sub/_e.jpg", "sub/.f.jpg", ".hidden/g.jpg", "sub/deep/noext"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = rows(lf.scan_library(spark, str(tmp_path)).select("file_path", "file_name", "extension"))
    assert got == [(".", "_b", "jpg"), (".", "a", "jpg"), ("sub", ".f", "jpg"), ("sub", "_e", "jpg"), ("sub/deep", "noext", "")]
    assert os.path.exists(tmp_path / ".hidden/g.jpg")


def test_listing(spark, tmp_path):
    posts = [{"id": i, "file_ext": "jpg", "file_url": "u" if i % 3 else None, "rating": "general", "tag_string_artist": "x", "tag_string_general": "y x", "tag_string_meta": ""} for i in range(1, 451)]
    (tmp_path / "l.json").write_text(json.dumps([*posts, {"id": "broken"}][:450]))
    got = im.listing(spark, str(tmp_path / "l.json"))
    assert got.count() == 450
    assert im.importable(got).count() == 300
    tags = im.listing_tags(got.where("id = 1")).first()["tags"]
    assert [(t["name"], t["group_id"]) for t in tags] == [("x", 1), ("y", 4)]
    assert im.settled([(5, 5), (5, 4), (5, 5), (5, 5), (5, 5)]) == 4 and im.settled([(5, 4)]) is None


def test_site_entries(spark, tmp_path):
    meta = {"category": "site", "id": 9, "num": 2, "extension": "PNG", "rating": "e", "tags": ["a b", "c"], "username": "Some One", "date": "2024-01-02 03:04:05"}
    (tmp_path / "m.json").write_text(json.dumps([[2, {}], [3, "http://u", meta], [3, "http://v", {"category": "site", "id": 10, "rating": "safe", "tags_artist": "q", "tags_general": "z q"}], [6, "w", {}]]))
    (tmp_path / "bad.json").write_text("not json")
    got = im.parse_entries(im.site_entries(spark, str(tmp_path / "m.json"))).orderBy("id").collect()
    assert [(r["id"], r["file_name"], r["rating"], r["source"]) for r in got] == [(9, "site_9_2", 4, "http://u"), (10, "site_10", 1, "http://v")]
    assert ("Some_One", 1) in [(t["name"], t["group_id"]) for t in got[0]["tags"]]
    assert [(t["name"], t["group_id"]) for t in got[1]["tags"]] == [("q", 1), ("z", 4)]
    assert im.site_entries(spark, str(tmp_path / "bad.json")).count() == 0
    assert spark.range(1).select(im.rating_of(F.lit("g"), False), im.rating_of(F.lit("g"), True)).first()[:] == (0, 1)


def test_layers(spark):
    one = spark.createDataFrame([("a b", "1"), ("c", "1")], "name string, display string")
    two = spark.createDataFrame([("a_b", "2"), ("z", "2")], "name string, display string")
    auth = spark.createDataFrame([("a_b",), ("c",)], "name string")
    assert rows(im.layered([one, two], auth)) == [("a_b", "2"), ("c", "1")]


def test_versions_and_manifests(spark, tmp_path):
    t = sn.VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(3))
    old = t.read()
    t.write(spark.range(5))
    assert (old.count(), t.read().count()) == (3, 5)
    local = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 9.0)], "key string, size long, mtime double")
    remote = spark.createDataFrame([("a", 1, 1.0), ("b", 3, 1.0), ("c", 1, 1.0)], "key string, size long, mtime double")
    assert rows(sn.to_upload(local, remote).select("key")) == [("b",)]
    fetch, drop = sn.to_download(local.union(spark.createDataFrame([("x", 1, 1.0)], local.schema)), remote, mirror=True)
    assert rows(fetch.select("key")) == [("b",), ("c",)] and rows(drop.select("key")) == [("x",)]


def test_ladder():
    ok, bad = sp.ladder(lambda xs: [1 / x for x in xs], [1, 2, 0, 4, 5, 8])
    assert ok == [1, 0.5, 0.25, 0.2, 0.125] and [b[0] for b in bad] == [0]


def test_backfill_is_idempotent(spark, tmp_path):
    def fails_on_seven(ids):
        if any(i % 7 == 0 for i in ids):
            raise ValueError("seven")
        return [float(i) for i in ids]

    top, drained = f"file://{tmp_path}", []
    spark.range(1, 30).write.parquet(f"{top}/in/a")
    args = (spark, f"{top}/in/*", "id long", f"{top}/out", f"{top}/state", fails_on_seven, lambda: drained.append(1))
    assert sp.run_backfill(*args) == 1
    spark.range(20, 40).write.parquet(f"{top}/in/b")
    assert sp.run_backfill(*args) == 1 and len(drained) == 2
    out = spark.read.parquet(f"{top}/out")
    assert out.count() == 39 == out.select("post_id").distinct().count()
    assert rows(out.where("error IS NOT NULL").select("post_id")) == [(7,), (14,), (21,), (28,), (35,)]
    assert not sp.progressed([1, 2], [2, 1]) and sp.progressed([1], [2]) and not sp.progressed(None, [])


def test_timeline_view():
    v = sp.TimelineView([{"kind": "flag", "id": 1, "x": 1}])
    v.prepend({"kind": "flag", "id": 2})
    v.patch("flag", 1, x=5)
    v.remove({("flag", 2)})
    assert v.entries == [{"kind": "flag", "id": 1, "x": 5}]


def test_translations(spark, tmp_path):
    from galleon.sources import translations as tr

    (tmp_path / "de.json").write_text(json.dumps({"cat": "Katze", "dog": "Hund", "tomcat": "KATER"}))
    (tmp_path / "bad.json").write_text("[1")
    top = f"file://{tmp_path}"
    assert tr.languages(spark, top) == ["bad", "de"] and tr.languages(spark, f"{top}/none") == []
    assert rows(tr.names_like(tr.table(spark, top, "de"), "kat")) == [("cat",), ("tomcat",)]
    assert tr.table(spark, top, "../de").count() == 0 and tr.table(spark, top, "bad").count() == 0


def test_import_runs(spark):
    """Where paging ends against a plain loop; limits, malformed rows, empty listings, nothing known."""
    import random

    from galleon.operators import imports as ir

    draw = random.Random(5)
    for _ in range(4):
        pages = [(p, draw.choice([0, 0, 0, 2]), draw.choice([0, 1, 3])) for p in range(draw.randint(1, 60))]
        run, stop = 0, None
        for p, pending, known in pages:
            run = 0 if pending else run + (known > 0)
            if run >= 3:
                stop = p
                break
        df = spark.createDataFrame(pages, "page long, pending long, known long")
        assert ir.last_page(df, cells=8).first()[0] == stop, pages
    assert rows(ir.numbered(spark.range(1, 100, 7), "id", "n", 4)) == sorted((i, k) for k, i in enumerate(range(99, 0, -7)))
    cols = [f.split()[0] for f in im.LISTING.split(", ")[:-1]]
    every = spark.range(1, 11).selectExpr("id", *[f"'{v}' AS {c}" for c, v in zip(cols[1:], ["2024", "", "s", "jpg", "u", "a", "", "", "b b", ""], strict=True)], "id = 8 AS malformed")
    none = spark.createDataFrame([], "id long")
    fetch = lambda w: w.selectExpr("id", "CASE WHEN id = 9 THEN 'failed' ELSE 'downloaded' END AS outcome")
    keep = lambda df: df
    got, stats = ir.import_run(every, none, fetch, keep, "f", "https://x/", limit=5, page=2)
    assert rows(got.select("id", "file_name", "source", "rating")) == [(6, "6", "https://x/6", 0), (7, "7", "https://x/7", 0), (10, "10", "https://x/10", 0)]
    assert tuple(stats.first()) == (4, 4, 4, 3, 0, 1, False)
    _, stats = ir.import_run(every, every.select("id"), fetch, keep, "f", "https://x/", page=2)
    assert tuple(stats.first()) == (5, 5, 5, 0, 5, 0, True)  # three pages of two, one row malformed
    got, stats = ir.import_run(every.limit(0), none, fetch, keep, "f", "https://x/")
    assert got.count() == 0 and tuple(stats.first()) == (0, 0, 0, 0, 0, 0, False)
