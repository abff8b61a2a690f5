"""Landed files to tables to reports, end to end."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from chatterscope import schemas
from chatterscope.operators import gates
from chatterscope.operators.sentiment import Rules
from chatterscope.params import REPORT_PRESET
from chatterscope.plans.comments import comment_analysis, comment_analysis_per_text
from chatterscope.plans.ingest import Landed, Tables, accepted_names, ingest, landed_comments, load_counts, read_landing
from chatterscope.plans.submissions import submission_report, submissions_of_known_users
from chatterscope.plans.users import user_analysis
from chatterscope.sources import landing, reports, tables
from chatterscope.streaming import load


def user(name, uid, **more):
    record = {
        "redditor_id": uid, "redditorname": name, "created_utc": 1.6e9, "link_karma": 10, "comment_karma": 20,
        "total_karma": 30, "is_employee": False, "is_mod": False, "is_gold": True, "dormant_days": 12.0,
        "has_verified_email": True, "accept_followers": False, "redditor_is_subscriber": True,
    }
    return {**record, **more}


def comment(cid, author, **more):
    record = {
        "comment_id": cid, "comment_author": author, "comment_created_utc": 1.7e9, "body": f"body {cid}",
        "comment_score": 3, "is_submitter": False, "edited": False, "link_id": "t3_s1",
    }
    return {**record, **more}


def post(sid, author, comments=None, **more):
    record = {
        "submission_id": sid, "author": author, "title": "A \"title\"\n    }, with {marks} and é", "submission_score": 5,
        "url": "http://x", "submission_created_utc": 1.7e9, "over_18": False,
    }
    if comments is not None:
        record["comments"] = comments
    return {**record, **more}


USERS = {"a": user("a", "t2_a"), "b": user("b", "t2_b"), "ü\"x": user("ü\"x", "t2_u"), "noid": user("noid", ""), "nokey": user("nokey", None)}
POSTS = {
    "s1": post("s1", "a", [comment("1", "a", edited=1700000000.0, body="x\n    }\n y"), comment("2", "zz")]),
    "s2": post("s2", "zz", [comment("3", "zz", link_id="s2", edited=0)]),
    "s3": post("s3", "Deleted", [comment("4", "b", edited=True), comment("5", "AutoModerator"), comment("6", None, edited=None)]),
    "s4": post("s4", "b", []),
    "s5": post("s5", "b"),
}


@pytest.fixture
def landed(spark, tmp_path):
    """The harvest's own layout: one object per file, indented by four."""
    for name, data in (("users", USERS), ("posts", POSTS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False, indent=4), encoding="utf-8")
    return read_landing(spark, [str(tmp_path / "users.json")], [str(tmp_path / "posts.json")])


def nothing(spark):
    return Tables(*(tables.empty_table(spark, t) for t in ("users", "submissions", "comments")))


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_indented_objects_are_split(landed):
    assert ids(landed.users, "key") == sorted(USERS)
    got = {r.submission_id: r for r in landed.submissions.collect()}
    assert set(got) == set(POSTS)
    assert got["s1"].title == POSTS["s1"]["title"]
    assert got["s1"].comments[0]["body"] == "x\n    }\n y"


def test_ingest_row_gate(spark, landed):
    stored = ingest(landed, nothing(spark))
    assert ids(stored.users, "redditor") == ["a", "b", "ü\"x"]
    assert ids(stored.submissions, "submission_id") == ["s1", "s4", "s5"]
    got = {r.comment_id: (r.edited, r.link_id) for r in stored.comments.collect()}
    assert got == {"1": (True, "s1"), "4": (True, "s1")}
    assert [f.dataType for f in stored.comments.schema] == [f.dataType for f in schemas.COMMENTS]


def test_jobs_while_planning(spark, landed):
    """The two checks that there is something to load, and nothing else, run before the result is asked for."""
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    names = landed.users.select(F.col("key").alias("redditor"))

    def jobs(build):
        group = f"planning-{uuid.uuid4()}"
        context.setJobGroup(group, "planning")
        try:
            build()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    flat = landed_comments(landed.submissions, [F.col("place").desc()])
    stored = nothing(spark)
    for gate in ("row", "group"):
        assert jobs(lambda: gates.admit_submissions(landed.submissions, names, gate)) == 0
        assert jobs(lambda: gates.admit_comments(flat, names, stored.comments, gate)) == 0
        assert jobs(lambda: ingest(landed, stored, gate)) == 2


def test_ingest_group_gate_and_rerun(spark, landed, tmp_path):
    first = ingest(landed, nothing(spark), gate="group")
    assert ids(first.submissions, "submission_id") == sorted(POSTS)
    assert ids(first.comments, "comment_id") == ["1", "2", "4"]
    root = str(tmp_path / "v1")
    first.publish(root)
    kept = Tables(*(tables.read_table(spark, root, t) for t in ("users", "submissions", "comments")))
    again = ingest(landed, kept)
    for name in ("users", "submissions", "comments"):
        assert sorted(map(tuple, getattr(again, name).collect()), key=str) == sorted(map(tuple, getattr(kept, name).collect()), key=str)
    with pytest.raises(Exception, match="(?i)exists"):
        first.publish(root)


def test_truthiness(spark):
    rows = spark.createDataFrame([(v,) for v in ("false", "1.7E9", "0", "0.0", None, "true", "")], "e string")
    assert [r[0] for r in rows.select(landing.truthy(F.col("e"))).collect()] == [False, True, False, False, False, True, False]


def test_missing_comment_key_fails(spark, tmp_path):
    broken = comment("1", "a")
    del broken["body"]
    (tmp_path / "p.json").write_text(json.dumps(post("s1", "a", [broken])))
    posts = landing.parse_submissions(landing.read_lines(spark, [str(tmp_path / "p.json")]))
    with pytest.raises(Exception, match="landed comment lacks body"):
        landing.flatten_comments(posts).collect()


def test_profile_filters(spark, tmp_path):
    profiles = [
        user("mod", "1", is_mod=True, user_is_moderator=True), user("own", "2", is_mod=True, user_is_moderator=False),
        user("Deleted", "3"), user("new", "4", created_utc=None), user("nokarma", "5", link_karma=None),
        {k: v for k, v in user("bare", "6").items() if k != "has_verified_email"},
    ]
    (tmp_path / "u.json").write_text("\n".join(map(json.dumps, profiles)))
    parsed = landing.parse_users(landing.read_lines(spark, [str(tmp_path / "u.json")]))
    kept = landing.to_user_rows(landing.with_flag_defaults(landing.harvestable(parsed)))
    assert {r.redditor: r.has_verified_email for r in kept.collect()} == {"own": True, "bare": False}


def words(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    gazetteer = spark.createDataFrame([("Ann Lee", "PERSON")], "phrase string, label string")
    return lexicon, gazetteer


BODIES = ["Good Ann Lee", " good ann lee ", "bad", "", " \t", None, "Good Ann Lee"]


def test_comment_reports(spark, tmp_path):
    rows = [(str(i), "a", 1, b, 1, False, False, "s") for i, b in enumerate(BODIES)]
    comments = spark.createDataFrame(rows, schemas.COMMENTS)
    analysis = comment_analysis(comments, *words(spark), Rules())
    got = {r.comment_id: (r.sentiment, r.named_entities, r.lexical_diversity, r.common_bigrams, r.is_duplicate) for r in analysis.collect()}
    blank = ("0.000 (Neutral)", "", "0.00 (No text)", "")
    assert got["0"] == ("0.440 (Positive)", "Ann Lee", "1.00 (Highly diverse)", "Good Ann, Ann Lee", "Yes")
    assert got["1"] == ("0.440 (Positive)", "", "1.00 (Highly diverse)", "good ann, ann lee", "Yes")
    assert got["2"] == ("-0.542 (Negative)", "", "1.00 (Highly diverse)", "", "No")
    assert got["3"] == (*blank, "Yes") and got["4"] == (*blank, "Yes")
    assert got["5"] == (None, None, None, None, "No")
    per_text = comment_analysis_per_text(comments, *words(spark), Rules())
    both = [reports.sheet(x, reports.COMMENT_HEADERS) for x in (analysis, per_text)]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))
    reports.write_report(analysis, reports.COMMENT_HEADERS, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(reports.COMMENT_HEADERS) and back.count() == len(BODIES)
    with pytest.raises(ValueError, match="missing columns"):
        reports.sheet(analysis.drop("sentiment"), reports.COMMENT_HEADERS)
    with pytest.raises(ValueError, match="no rows"):
        reports.write_report(analysis.limit(0), reports.COMMENT_HEADERS, str(tmp_path / "none"))


def test_submission_and_user_reports(spark):
    posts = spark.createDataFrame(
        [("1", "a", "Good Ann Lee", 1, "u", 5, False), ("2", "a", "good ann lee\t", 1, " U", 5, False), ("3", "q", "Good", 1, "u", 5, False)],
        schemas.SUBMISSIONS,
    )
    users = spark.createDataFrame([("t2", "a", 0, 1, 2, 3, False, False, False, 4, True, True, True)], schemas.USERS)
    sheet = reports.sheet(submission_report(posts, users, *words(spark)), reports.SUBMISSION_HEADERS)
    got = {r["Submission ID"]: (r["Named Entities"], r["Lexical Diversity"], r["Is Duplicate"]) for r in sheet.collect()}
    assert got == {"1": ("(PERSON Ann Lee)", 1.0, True), "2": ("", 1.0, True)}
    inner = posts.join(users, posts.author == users.redditor, "inner")
    assert ids(submissions_of_known_users(posts, users), "submission_id") == ids(inner, "submission_id")
    activity = spark.createDataFrame([("a", 0, "comment", "x"), ("a", 300000, "comment", "y"), ("a", 300001, "comment", "z")], "redditor string, created_utc bigint, kind string, item_id string")
    report = reports.sheet(user_analysis(users, activity, REPORT_PRESET, 1000 * 86400), reports.USER_HEADERS)
    row = report.first().asDict()
    assert list(row) == list(reports.USER_HEADERS)
    assert (row["Low Karma"], row["Young Account"], row["Burst Activity"]) == (True, False, True)


def test_bucketed_comments_need_no_wide_shuffle(spark, tmp_path):
    rows = [(str(i), "a", 1, f"good body {i % 3}", 1, False, False, "s") for i in range(50)]
    tables.write_bucketed(spark.createDataFrame(rows, schemas.COMMENTS), "comments_bucketed", "comments", 8, str(tmp_path / "b"))
    stored = spark.table("comments_bucketed")
    analysis = comment_analysis(stored, *words(spark), Rules())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = analysis._jdf.queryExecution().executedPlan().toString()
        assert analysis.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(comment_id" in line]
    wide = [line for line in plan.splitlines() if "Exchange" in line and "body" in line]
    assert not wide and len(exchanges) <= 1, plan


def read_all(spark, tmp_path, texts):
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    return landing.read_indented(spark, [str(tmp_path / f"{k}.json") for k in range(len(texts))])


RECORDS = {"a": {"x": 1, "t": "one\n    }, {"}, "b": {}, "c": None, "d\"é": {"x": {"y": [1, {"z": 2}]}}, "e": {"x": 5}}


@pytest.mark.parametrize("layout", [{"indent": 4}, {"indent": 2}, {"indent": 1}, {}, {"separators": (",", ":")}])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_every_entry_of_every_layout_is_read(spark, tmp_path, layout, ends):
    text = json.dumps(RECORDS, ensure_ascii=False, **layout)
    (tmp_path / "o.json").write_bytes(text.replace("\n", ends).encode())
    read = lambda f: {r.key: json.loads(r.json) for r in f(spark, [str(tmp_path / "o.json")]).collect() if r.key is not None}
    assert read(landing.read_objects) == RECORDS
    split = landing.read_indented(spark, [str(tmp_path / "o.json")])
    if layout.get("indent") in (1, 2):
        # The separator stands inside records: nothing is taken for a record, and nothing vanishes.
        rejects = landing.rejected_records(split, schemas.LANDED_USER).collect()
        assert read(landing.read_indented).items() <= RECORDS.items() and "unreadable stretch" in {r.reason for r in rejects}
    else:
        assert read(landing.read_indented) == RECORDS


def test_entries_that_stand_first_last_or_alone(spark, tmp_path):
    objects = [{}, {"a": None}, {"a": {}, "b": {"x": 1}}, {"a": None, "b": {"x": 1}}, {"b": {"x": 1}, "a": {}}, {"b": {"x": 1}, "a": None}]
    texts = [json.dumps(o, indent=4) + tail for o in objects for tail in ("", "\n", " \n\n")] + ["", "\n", "\ufeff" + json.dumps({"a": {}}, indent=4)]
    got = sorted((r.file.rsplit("/")[-1], r.key, r.json) for r in read_all(spark, tmp_path, texts).collect())
    want = sorted((f"{k}.json", key, json.dumps(v, separators=(",", ":"))) for k, t in enumerate(texts) for key, v in (json.loads(t.lstrip("\ufeff")) if t.strip() else {}).items())
    assert got == want


def test_what_is_no_record_is_rejected(spark, tmp_path):
    whole = json.dumps(USERS, ensure_ascii=False, indent=4)
    texts = [
        whole[: whole.index('"redditorname": "b"')],  # cut short
        '{"a": {"redditor_id": "1"}}{"b": {}}', "no json", '{"n": 5, "t": "text", "l": [], "z": null}',
        json.dumps({"ok": user("ok", "9"), "bad": {"created_utc": "soon"}}, indent=4),
    ]
    records = read_all(spark, tmp_path, texts)
    kept = landing.parse_users(records).collect()
    rejects = [(r.file.rsplit("/")[-1], r.reason) for r in landing.rejected_records(records, schemas.LANDED_USER).collect()]
    assert sorted(r.key for r in kept) == ["a", "ok"]
    assert sorted(rejects) == sorted(
        [("0.json", "unreadable stretch"), ("1.json", "unreadable stretch"), ("2.json", "unreadable stretch")]
        + [("3.json", "not an object")] * 4 + [("4.json", "malformed")]
    )
    (tmp_path / "l.txt").write_text("\n".join([json.dumps(POSTS["s1"]), "", '{"submission_id": "s', "[1]", json.dumps(POSTS["s2"])]))
    lines = landing.read_lines(spark, [str(tmp_path / "l.txt")])
    assert ids(landing.parse_submissions(lines), "submission_id") == ["s1", "s2"]
    assert ids(landing.rejected_records(lines, schemas.LANDED_SUBMISSION), "reason") == ["malformed", "not an object"]


def test_the_last_record_of_a_key_stands(spark, tmp_path):
    """Twice in one object, and in a later file."""
    users = json.dumps({"a": user("a", "t2_a")}, indent=4)
    first = json.dumps({"s1": post("s1", "a", [comment("1", "a", body="first")])}, indent=4)
    twice = first[:-2] + "," + first.replace("first", "second")[1:]
    (tmp_path / "u.json").write_text(users)
    (tmp_path / "p1.json").write_text(twice)
    read = lambda *names: ingest(read_landing(spark, [str(tmp_path / "u.json")], [str(tmp_path / n) for n in names]), nothing(spark)).comments
    assert [r.body for r in read("p1.json").collect()] == ["second"]
    (tmp_path / "p0.json").write_text(first.replace("first", "early"))
    assert [r.body for r in read("p1.json", "p0.json").collect()] == ["second"]
    (tmp_path / "p2.json").write_text(json.dumps({"s1": post("s1", "a", [comment("1", "a", body="later")])}))
    assert [r.body for r in read("p2.json", "p1.json").collect()] == ["later"]


def test_nothing_landed_is_an_error_and_counts(spark, landed, tmp_path):
    with pytest.raises(ValueError, match="no users"):
        ingest(Landed(landed.users.limit(0), landed.submissions, landed.rejects), nothing(spark))
    with pytest.raises(ValueError, match="no submissions"):
        ingest(Landed(landed.users, landed.submissions.limit(0), landed.rejects), nothing(spark))
    assert ingest(landed, nothing(spark)).publish(str(tmp_path / "v")) == {"users": 3, "submissions": 3, "comments": 2}
    counts = {r.what: r.n for r in load_counts(landed).collect()}
    assert counts["users found"] == len(USERS) and counts["users accepted"] == 3 and counts["submissions found"] == len(POSTS)


def test_a_report_runs_once(spark, tmp_path):
    rows = [(str(i), "a", 1, f"b{i}", 1, False, False, "s") for i in range(9)]
    analysis = comment_analysis(spark.createDataFrame(rows, schemas.COMMENTS), *words(spark), Rules())
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    reports.write_report(analysis.mapInArrow(count, analysis.schema), reports.COMMENT_HEADERS, str(tmp_path / "r"))
    assert made.value == 9


@pytest.mark.parametrize("gate", ["row", "group"])
@pytest.mark.parametrize("files", [1, 1000])
def test_stream_equals_batch(spark, tmp_path, gate, files):
    """However files fall into batches, the stream leaves what `ingest` makes of the same files."""
    landing_dir, root = tmp_path / "landing", tmp_path / "stored"
    landing_dir.mkdir(), root.mkdir()
    (tmp_path / "users.txt").write_text("\n".join(map(json.dumps, USERS.values())))
    check = load.checkpoint_folder(spark, f"load-{uuid.uuid4()}", str(tmp_path / "check"))

    def land(name, posts):
        (landing_dir / name).write_text("\n".join([*map(json.dumps, posts), "not json"]))

    land("1.json", [POSTS["s1"], POSTS["s2"]])
    land("2.json", [POSTS["s3"], post("s1", "a", [comment("1", "a", body="later"), comment("8", "zz")])])
    load.load_stream(spark, str(landing_dir), str(root), check, files).awaitTermination()
    land("3.json", [post("s9", "zz", [comment("9", "b"), comment("10", "zz")])])
    load.load_stream(spark, str(landing_dir), str(root), check, files).awaitTermination()
    landed = read_landing(spark, [str(tmp_path / "users.txt")], [str(landing_dir)], layout="lines")
    stored = nothing(spark)
    before = Tables(stored.users, stored.submissions, spark.createDataFrame([("9", "b", 1, "old", 1, False, False, "x")], schemas.COMMENTS))
    for tables_before in (stored, before):
        want = sorted(map(tuple, ingest(landed, tables_before, gate).comments.collect()))
        got = load.loaded(spark, str(root), accepted_names(landed.users), tables_before.comments, gate)
        assert sorted(map(tuple, got.collect())) == want and any("later" in r for r in want)
    assert load.rejects(spark, str(root)).count() == 3
