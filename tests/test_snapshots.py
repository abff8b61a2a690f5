"""Versioned tables: what a load touches, what a reader sees, and loads that die."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from chatterscope import schemas
from chatterscope.operators.merge import upsert_users
from chatterscope.plans import ingest
from chatterscope.sources import landing, snapshots
from chatterscope.sources.snapshots import Snapshots, Updates


def comments(spark, rows):
    """rows: (comment_id, body)."""
    return spark.createDataFrame([(i, "a", 1, body, 1, False, False, "s") for i, body in rows], schemas.COMMENTS)


def users(spark, rows):
    return spark.createDataFrame([(i, name, 1, 1, 1, 2, False, False, False, 0, False, False, False) for i, name in rows], schemas.USERS)


def bodies(store, version=None):
    return {r.comment_id: r.body for r in store.read("comments", version).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "tables"), buckets=8)


def test_only_touched_buckets_are_read_and_written(spark, store, tmp_path):
    assert store.versions() == [] and store.read("comments").count() == 0 == store.read("users").count()
    first = {str(k): f"b{k}" for k in range(200)}
    assert store.load({"comments": Updates(comments(spark, first.items()))}) == 1
    assert bodies(store) == first and store.rows() == {"comments": 200}
    before = store._named(1)["tables"]["comments"]["files"]
    batch = comments(spark, [("5", "old"), ("5", "new"), ("x", "added")])
    touched = {r[0] for r in batch.select(store._bucket("comments", 8).cast("string")).collect()}
    untouched = [f"{store.root}/{f}" for b, files in before.items() if b not in touched for f in files]
    kept = {f: open(f, "rb").read() for f in untouched}
    for f in untouched:  # a load that read them would fail
        with open(f, "wb") as out:
            out.write(b"no parquet")
    assert store.load({"comments": Updates(batch, [F.col("body").asc()])}) == 2
    after = store._named(2)["tables"]["comments"]["files"]
    assert 0 < len(touched) < 3 and untouched
    assert all((after[b] == before[b]) == (b not in touched) for b in before)
    for f, content in kept.items():
        with open(f, "wb") as out:
            out.write(content)
    assert bodies(store) == first | {"5": "new", "x": "added"} and bodies(store, 1) == first
    assert store.rows() == {"comments": 201} and store.versions() == [1, 2]
    assert not os.listdir(tmp_path / "tables" / "staged")


def test_a_load_that_dies_changes_nothing(spark, store, monkeypatch):
    store.load({"users": Updates(users(spark, [("1", "a")])), "comments": Updates(comments(spark, [("1", "x")]))})
    update = {"comments": Updates(comments(spark, [("1", "y"), ("2", "z")])), "users": Updates(users(spark, [("2", "b")]))}
    merged = Snapshots._merged

    def dies(self, before, name, rows, made):
        if name == "users":
            raise OSError("the driver is gone")
        return merged(self, before, name, rows, made)

    monkeypatch.setattr(Snapshots, "_merged", dies)
    with pytest.raises(OSError, match="gone"):
        store.load(update)
    assert bodies(store) == {"1": "x"} and store.versions() == [1]
    # A manifest that was cut off is no version, and its number is not given twice.
    store.folder.create("manifests/000000000002.json", '{"version": 2, "tab')
    assert store.versions() == [1] and bodies(store) == {"1": "x"}
    monkeypatch.setattr(Snapshots, "_merged", merged)
    assert store.load(update) == 3
    assert bodies(store) == {"1": "y", "2": "z"} and store.read("users").count() == 2 and bodies(store, 1) == {"1": "x"}
    with pytest.raises(ValueError, match="no version 2"):
        store.read("comments", 2)


def test_of_two_loads_from_one_version_the_second_fails(spark, store, monkeypatch):
    store.load({"comments": Updates(comments(spark, [("1", "x")]))})
    merged, other = Snapshots._merged, Snapshots(spark, store.root)
    raced = []

    def late(self, *args):
        if not raced:
            raced.append(0)  # the other load gets here too
            raced[0] = other.load({"comments": Updates(comments(spark, [("2", "first")]))})
        return merged(self, *args)

    monkeypatch.setattr(Snapshots, "_merged", late)
    with pytest.raises(Exception, match="(?i)exist"):
        store.load({"comments": Updates(comments(spark, [("3", "second")]))})
    assert raced == [2] and bodies(store) == {"1": "x", "2": "first"}
    assert store.load({"comments": Updates(comments(spark, [("3", "second")]))}) == 3 and len(bodies(store)) == 3


def test_names_stay_unique(spark, store):
    store.load({"users": Updates(users(spark, [("1", "a"), ("2", "b"), ("3", None), ("4", None)]))})
    with pytest.raises(ValueError, match="redditor is not unique"):
        store.load({"users": Updates(users(spark, [("5", "a")])), "comments": Updates(comments(spark, [("1", "x")]))})
    assert store.versions() == [1] and store.read("comments").count() == 0
    store.load({"users": Updates(users(spark, [("1", "b"), ("2", "a"), ("6", None)]))})
    assert {r.redditor_id: r.redditor for r in store.read("users").collect()}["1"] == "b"


def test_clear_null_keys_and_none(spark, store):
    rows = comments(spark, [("1", "x"), ("2", "y")]).unionByName(
        comments(spark, [("3", "z")]).withColumn("comment_id", F.lit(None).cast("string"))
    )
    store.load({"comments": Updates(rows), "users": Updates(users(spark, [("1", "a")]))})
    assert bodies(store) == {"1": "x", "2": "y"}
    assert store.load({"comments": Updates(comments(spark, []))}) == 2 and bodies(store) == {"1": "x", "2": "y"}
    assert store.clear(["comments"]) == 3 and bodies(store) == {} and store.read("users").count() == 1
    assert store.clear() == 4 and store.read("users").count() == 0 and bodies(store, 2) == {"1": "x", "2": "y"}
    assert glob.glob(f"{store.root}/data/comments/*/*/*.parquet")


def test_merge_of_users_checks_names_within_its_plan(spark):
    merged = upsert_users(users(spark, [("1", "a"), ("3", None)]), users(spark, [("2", "b"), ("4", None)]), [F.lit(1)])
    assert sorted(r.redditor_id for r in merged.collect()) == ["1", "2", "3", "4"]
    clash = upsert_users(users(spark, [("1", "a")]), users(spark, [("2", "a")]), [F.lit(1)])
    with pytest.raises(Exception, match="redditor is not unique: a"):
        clash.select("redditor_id").collect()


def test_bucket_sizes_follow_the_folder(spark, store):
    store.load({"comments": Updates(comments(spark, [(str(k), "x") for k in range(50)]))})
    again = Snapshots(spark, store.root, buckets=3)
    again.load({"comments": Updates(comments(spark, [(str(k), "y") for k in range(50)]))})
    assert again._named(2)["buckets"] == 8 and set(bodies(again).values()) == {"y"} and len(bodies(again)) == 50
    assert snapshots.Snapshots(spark, store.root).rows() == {"comments": 50}


def test_a_load_counts_what_it_stores(spark, store, tmp_path):
    """The counts equal those of a grouping, tables those of a load, and records are parsed once."""
    lands = tmp_path / "users.txt", tmp_path / "posts.txt"
    people = [{"redditor_id": i, "redditorname": n, "created_utc": 1.0} for i, n in (("t1", "a"), ("t2", "b"), ("", "c"), (None, "d"))]
    said = [
        {**dict.fromkeys(schemas.COMMENT_KEYS), "comment_id": i, "comment_author": n, "link_id": "t3_s1"}
        for i, n in (("1", "a"), ("2", None), ("3", "AutoModerator"), ("4", "b"))
    ]
    posts = [{"submission_id": "s1", "author": "a", "comments": said}, {"submission_id": "s2", "author": "b", "comments": None}]
    lands[0].write_text("\n".join([*map(json.dumps, people), "[1]"]))
    lands[1].write_text("\n".join([*map(json.dumps, posts), '{"submission_id": "s3"']))
    parsed = spark.sparkContext.accumulator(0)

    def records(path):
        read = landing.read_lines(spark, [str(path)])

        def seen(batches):
            for batch in batches:
                parsed.add(batch.num_rows)
                yield batch

        return read.mapInArrow(seen, read.schema)

    version = ingest.load_counted(*map(records, lands), store)
    assert parsed.value == 8 and version == 1 and not os.listdir(tmp_path / "tables" / "staged")
    landed = ingest.read_landing(spark, [str(lands[0])], [str(lands[1])], "lines")
    counts = {r.what: r.n for r in store.counters().where("version = 1").collect()}
    assert counts == {r.what: r.n for r in ingest.load_counts(landed).collect()}
    assert counts == {"users found": 4, "users accepted": 2, "submissions found": 2, "comments kept": 2, "records rejected": 2}
    plain = Snapshots(spark, str(tmp_path / "plain"), buckets=8)
    ingest.load(landed, plain)
    for name in schemas.TABLES:
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, plain.read(name).collect()))
    assert store.read("users").count() == 2 and plain.counters().count() == 0
    lands[0].write_text("")
    with pytest.raises(ValueError, match="no users"):
        ingest.load_counted(*map(records, lands), store)
    assert store.versions() == [1] and not os.listdir(tmp_path / "tables" / "staged")


def test_a_big_bucket_is_merged_by_many_tasks(spark, store, monkeypatch):
    """No task takes a whole bucket that holds more than a share; rows are those of whole buckets."""
    monkeypatch.setattr(snapshots, "SHARE_BYTES", 500)
    first = {str(k): f"b{k}" for k in range(2000)}
    store.load({"comments": Updates(comments(spark, first.items()))})
    files = store._named(None)["tables"]["comments"]["files"]
    assert len(files) == 8 and all(len(f) > 1 for f in files.values())
    again = {str(k): "new" for k in range(1000, 3000)}
    store.load({"comments": Updates(comments(spark, again.items()))})
    assert bodies(store) == first | again and store.rows() == {"comments": 3000}


def test_a_load_parses_and_flattens_once(spark, store, tmp_path):
    """Each landed record is parsed once, however often the gates look, and nothing of it is left behind."""
    said = [{**dict.fromkeys(schemas.COMMENT_KEYS), "comment_id": str(k), "comment_author": "a", "link_id": "t3_s1"} for k in range(3)]
    lands = tmp_path / "users.txt", tmp_path / "posts.txt"
    lands[0].write_text(json.dumps({"redditor_id": "t1", "redditorname": "a"}))
    lands[1].write_text("\n".join(json.dumps({"submission_id": f"s{k}", "author": "a", "comments": said[k : k + 1]}) for k in range(4)))
    seen = spark.sparkContext.accumulator(0)

    def records(path):
        read = landing.read_lines(spark, [str(path)])

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return read.mapInArrow(count, read.schema)

    for gate in ("row", "group"):
        seen.value = 0
        ingest.load(ingest.parse_landing(*map(records, lands)), store, gate)
        assert seen.value == 5
    assert store.rows() == {"users": 1, "submissions": 4, "comments": 3}
    assert not os.listdir(tmp_path / "tables" / "staged")
