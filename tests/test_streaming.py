"""Streams against the batch operators over the same rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope import schemas
from chatterscope.operators import activity as act
from chatterscope.operators.keyed import latest
from chatterscope.params import DAY
from chatterscope.sources.snapshots import Snapshots, Updates
from chatterscope.streaming import activity as astream
from chatterscope.streaming import comments as cstream


def rows(df):
    return sorted(map(tuple, df.collect()))


def land(spark, data, schema, folder, name):
    """One file under a name that sorts by it."""
    folder.mkdir(exist_ok=True)
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(folder / name))


def bursty(rng, users, n):
    events = []
    for user in users:
        t = rng.randint(5 * DAY, 10 * DAY)
        for _ in range(n):
            t += rng.choice([0, 1, 3600, DAY, 3 * DAY - 1, 3 * DAY, 3 * DAY + 1, 20 * DAY])
            events.append((user, t, "comment", str(len(events))))
    return sorted(events, key=lambda e: e[1])


@pytest.mark.parametrize("files", [1, 1000])
def test_bursts_of_a_stream(spark, tmp_path, files):
    """However files fall into batches and events into files, within the delay."""
    events = bursty(random.Random(7), "abcde", 60)
    # Each file holds a stretch of time, and some events of the one before.
    cuts = [events[i : i + 75] for i in range(0, len(events), 75)]
    for a, b in zip(cuts, cuts[1:]):
        newest = max(t for _, t, *_ in a)
        held = [e for e in a if newest - e[1] < 10 * DAY and int(e[3]) % 3 == 0]
        b.extend(held)
        a[:] = [e for e in a if e not in held]
    odd = [(None, cuts[0][0][1], "comment", "x"), ("a", None, "comment", "y")]
    feed, root, check = tmp_path / "feed", str(tmp_path / "starts"), str(tmp_path / "check")
    chosen = spark.conf.get(astream._PROVIDER)

    def run():
        stream = astream.activity_stream(spark, str(feed / "*"), files)
        query = astream.burst_stream(stream, root, check, 3, 1, "30 days")
        query.awaitTermination()
        assert cstream.late_rows(query) == 0

    for i, part in enumerate(cuts):
        land(spark, part + (odd if i == 1 else []), astream.ACTIVITY, feed, f"{i}")
        if files == 1 or i in (1, len(cuts) - 1):
            run()
    assert spark.conf.get(astream._PROVIDER) == chosen
    # An event far ahead moves the watermark over all that is open.
    land(spark, [("zz", events[-1][1] + 100 * DAY, "comment", "z")], astream.ACTIVITY, feed, "9")
    run()
    want = rows(act.bursts(spark.createDataFrame(events, astream.ACTIVITY), 3, 1))
    assert len(want) == 5 and rows(astream.closed_bursts(spark, root)) == want


def test_late_and_open(spark, tmp_path):
    feed, root, check = tmp_path / "feed", str(tmp_path / "starts"), str(tmp_path / "check")

    def run(name, *events):
        data = [(u, t * DAY, "comment", str(i)) for i, (u, t) in enumerate(events)]
        land(spark, data, astream.ACTIVITY, feed, name)
        query = astream.burst_stream(astream.activity_stream(spark, str(feed / "*")), root, check, 3, 1, "2 days")
        query.awaitTermination()
        return cstream.late_rows(query), rows(astream.closed_bursts(spark, root))

    # a's burst starts on day 20 and is over after day 21, which the watermark must pass.
    assert run("0", ("a", 10), ("a", 20), ("b", 20)) == (0, [])
    assert run("1", ("a", 21), ("b", 21)) == (0, [])  # watermark: day 19
    assert run("2", ("c", 23)) == (0, [("a", 1, 2)])  # day 21: closed, with the event of that day
    # Of a day long passed: left out, and counted.
    late, found = run("3", ("a", 15), ("a", 40), ("a", 40), ("c", 60))
    assert (late, found) == (1, [("a", 2, 2)])


def comment(key, day, body="text", author="a"):
    return (key, author, day * DAY, body, 1, False, False, "s")


@pytest.mark.parametrize("files", [1, 1000])
def test_comments_of_a_stream(spark, tmp_path, files):
    """Repetitions, edits and repeated batches leave what one merge of the whole feed would."""
    feed = tmp_path / "feed"
    store = Snapshots(spark, str(tmp_path / "store"), buckets=4)
    store.load({"comments": Updates(spark.createDataFrame([comment("old", 1), comment("1", 1, "before")], schemas.COMMENTS))})
    parts = [
        [comment("1", 10), comment("2", 11), comment("2", 11), comment("3", 11, None, None)],
        [comment("1", 10), comment("2", 11, "edited"), comment("4", 12), comment(None, 12)],
        [comment("5", 13), comment("4", 12), comment("4", 12, "edited"), ("6", "a", None, "", None, None, None, None)],
    ]
    name = f"comments-{uuid.uuid4()}"

    def run(checkpoint="check"):
        stream = cstream.comment_stream(spark, str(feed / "*"), files)
        query = cstream.merge_stream(stream, store, name, str(tmp_path / checkpoint), "5 days")
        query.awaitTermination()
        return cstream.late_rows(query)

    for i, part in enumerate(parts):
        land(spark, part, schemas.COMMENTS, feed, str(i))
        if files == 1 or i == 2:
            assert run() == 0
    order = [F.col("n").desc()]
    every = [(*row, n) for n, row in enumerate([comment("old", 1)] + sum(parts, [])) if row[0]]
    known = spark.createDataFrame(every, T.StructType([*schemas.COMMENTS, T.StructField("n", T.IntegerType())]))
    want = {r.comment_id: tuple(r)[:-1] for r in latest(known, ["comment_id"], order).collect()}
    assert {r.comment_id: tuple(r) for r in store.read("comments").collect()} == want
    assert want["2"][3] == want["4"][3] == "edited" and want["1"][3] == "text"
    # Batches that run again, as after a failure, make no version.
    versions = store.versions()
    run("lost")
    assert store.versions() == versions
    # What is older than the newest time less the delay is not merged.
    land(spark, [comment("7", 30)], schemas.COMMENTS, feed, "3")
    assert run() == 0
    land(spark, [comment("8", 20), comment("9", 26)], schemas.COMMENTS, feed, "4")
    assert run() == 1
    assert {"7", "9"} <= {r.comment_id for r in store.read("comments").collect()}
    assert not store.read("comments").where("comment_id = '8'").count()


def test_a_batch_without_rows_makes_no_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"), buckets=4)
    none = {"comments": Updates(spark.createDataFrame([], schemas.COMMENTS))}
    assert store.load(none, ("feed", 0)) == 0 and store.versions() == []
    some = {"comments": Updates(spark.createDataFrame([comment("1", 1)], schemas.COMMENTS))}
    assert store.load(some, ("feed", 1)) == store.load(some, ("feed", 1)) == store.load(none, ("feed", 2)) == 1
    assert store.clear() == 2 and store.holds(("feed", 1)) and not store.holds(("feed", 2))
    assert store.load(some, ("feed", 2)) == 3 and store.read("comments").count() == 1


def test_repetitions_do_not_reach_the_merge(spark, tmp_path):
    feed, check = tmp_path / "feed", str(tmp_path / "check")
    land(spark, [comment("1", 10), comment("2", 11)], schemas.COMMENTS, feed, "0")
    land(spark, [comment("1", 10), comment("2", 11), comment("2", 11, "edited")], schemas.COMMENTS, feed, "1")
    left = []
    stream = cstream.without_repetitions(cstream.comment_stream(spark, str(feed / "*"), 1), "5 days")
    stream.writeStream.foreachBatch(lambda df, _: left.append(rows(df.select("comment_id", "body")))).option(
        "checkpointLocation", check
    ).trigger(availableNow=True).start().awaitTermination()
    assert [b for b in left if b] == [[("1", "text"), ("2", "text")], [("2", "edited")]]
