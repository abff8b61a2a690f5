"""Objects in any layout, cut by many tasks, against the JSON library."""

import json
import random
from pathlib import Path

import pytest

from chatterscope.sources import landing, objects, reports

SPLITS = (40, 300, 1 << 20)
TEXTS = ['plain', 'a } b', '{"not": "a record"}', 'quote " here', 'back\\slash', '\\"}', 'ü}é{', '[', ']]}', '', '\\', '"', 'line\nbreak', ' }']


@pytest.fixture
def split(spark):
    def reader(path, size, read=landing.read_objects):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            return read(spark, [path]).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    return reader


def _record(draw, depth=0):
    value = {draw.choice(TEXTS) + str(i): draw.choice(TEXTS) for i in range(draw.randint(0, 3))}
    if depth < 2:
        value["nested"] = [_record(draw, depth + 1) for _ in range(draw.randint(0, 2))]
    value["n"] = draw.choice([None, True, 1.5, -3])
    return value


def _object(draw, n):
    found = {f"k{i}{draw.choice(TEXTS)}": _record(draw) if draw.random() < 0.9 else draw.choice([None, 7]) for i in range(n)}
    return found


LAYOUTS = [
    {"separators": (",", ":")}, {}, {"indent": 1}, {"indent": 4}, {"indent": "\t"}, {"indent": 4, "ensure_ascii": False},
    {"separators": (" ,\n\n", " : "), "ensure_ascii": False},
]


def _in_order(rows):
    return [r for r in sorted(rows, key=lambda r: tuple(r["place"]))]


@pytest.mark.parametrize("size", SPLITS)
def test_any_layout_with_any_splits(split, tmp_path, size):
    draw = random.Random(size)
    wanted = {}
    for i, layout in enumerate(LAYOUTS):
        value = _object(draw, 6)
        text = json.dumps(value, **layout) + draw.choice(["", "\n", "  \n\n"])
        path = tmp_path / f"part-{i}.json"
        path.write_bytes((b"\xef\xbb\xbf" if i == 2 else b"") + text.encode())
        wanted[path.name] = list(value.items())
    for name, text in {"empty.json": "", "blank.json": "\n", "none.json": "{}", "flat.json": '{"a": 1, "b": null}'}.items():
        (tmp_path / name).write_text(text)
        wanted[name] = list(json.loads(text or "{}").items()) if text.strip() else []
    found = {name: [] for name in wanted}
    for row in _in_order(split(str(tmp_path), size)):
        assert row["key"] is not None, row
        found[row["file"].rsplit("/", 1)[1]].append((row["key"], json.loads(row["json"])))
    assert found == wanted


@pytest.mark.parametrize("size", (25, 1 << 20))
def test_cut_short_at_every_place(split, tmp_path, size):
    """Whole entries before the end are read, and what is left comes back as one stretch without key."""
    text = json.dumps({"a": {"x": "}{"}, "b": {"y": [{"z": 1}, {}]}, "c": {"q": '"'}})
    ends = {i + 1: key for key, i in (("a", text.index('}, "b"')), ("b", text.index('}, "c"')), ("c", len(text) - 2))}
    for n in range(len(text)):
        (tmp_path / f"{n:03}.json").write_text(text[:n])
    rows = split(str(tmp_path), size)
    for n in range(len(text)):
        of_file = _in_order([r for r in rows if r["file"].endswith(f"{n:03}.json")])
        assert [r["key"] for r in of_file if r["key"] is not None] == [k for end, k in ends.items() if end <= n]
        left = text[max([0, *(end for end in ends if end <= n)]) : n]
        lost = [r["json"] for r in of_file if r["key"] is None]
        assert len(lost) == (left.strip(" {,") != "") and all(left.startswith(x) for x in lost)


def test_the_splits_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({f"k{i}": {"x": "y" * 50} for i in range(100)}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        pieces = objects._pieces(spark, [str(tmp_path)])
        assert pieces.select("start").distinct().count() >= 10
        plan = landing.read_objects(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_blocks_that_may_not_be_broadcast(split, tmp_path, monkeypatch):
    value = _object(random.Random(1), 30)
    (tmp_path / "one.json").write_text(json.dumps(value))
    monkeypatch.setattr(objects, "BROADCAST_ROW_LIMIT", 0)
    found = _in_order(split(str(tmp_path), 100))
    assert [(r["key"], json.loads(r["json"])) for r in found] == list(value.items())


def test_a_record_without_end_is_not_put_together(split, tmp_path, monkeypatch):
    """It comes back in parts of a block, whatever it holds; what stands before it is read."""
    text = '{"a": {"x": 1}, "b": {"y": "' + "[}" * 1000
    (tmp_path / "one.json").write_text(text)
    monkeypatch.setattr(objects, "LONGEST", 400)
    found = _in_order(split(str(tmp_path), 100))
    assert [(r["key"], r["json"]) for r in found if r["key"]] == [("a", '{"x":1}')]
    lost = [r["json"] for r in found if r["key"] is None]
    assert len(lost) > 5 and max(map(len, lost)) < 300 and sum(x.count("[") for x in lost) == 1000


def _written(root):
    """The text of all parts, folders and files by name."""
    parts = [p for folder in reports.indented_parts(str(root)) for p in sorted(Path(folder).glob("part-*.txt"))]
    return "".join(p.read_text() for p in parts)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", (0, 1, 500))
def test_an_object_is_written_by_many_tasks(spark, tmp_path, uncoalesced, n):
    """It is one JSON text, and each reader gives its records back."""
    draw = random.Random(n)
    rows = [(f"{i:04} {draw.choice(TEXTS)}", draw.choice(TEXTS), [(draw.choice(TEXTS) + ' : "', None)] * draw.randint(0, 3), None) for i in range(n)]
    schema = "id string, `te\"x : t` string, comments array<struct<body: string, score: int>>, none double"
    root = tmp_path / "object"
    reports.write_indented(spark.createDataFrame(rows, schema).repartition(7), "id", str(root))
    wanted = {r[0]: {'te"x : t': r[1], "comments": [{"body": b, "score": s} for b, s in r[2]], "none": None} for r in rows}
    assert list(json.loads(_written(root)).items()) == list(wanted.items())
    assert n < 2 or len(list(Path(reports.indented_parts(str(root))[0]).glob("part-*.txt"))) > 1
    for read in (landing.read_indented, landing.read_objects):
        found = read(spark, reports.indented_parts(str(root))).collect()
        assert {r["key"]: json.loads(r["json"]) for r in found} == wanted and len(found) == n
    ends = [line for line in _written(root).splitlines() if line == "    }"]
    assert len(ends) == n


def test_a_record_without_key_is_not_written(spark, tmp_path):
    with pytest.raises(Exception, match="id is null"):
        reports.write_indented(spark.createDataFrame([(None, 1)], "id string, x int"), "id", str(tmp_path / "object"))
    assert not (tmp_path / "object" / "2-end").exists()


def test_small_blocks_share_tasks(spark, split, tmp_path, monkeypatch):
    """Blocks do not need a task each, however small they are."""
    draw = random.Random(31)
    wanted = _object(draw, 60)
    (tmp_path / "one.json").write_text(json.dumps(wanted))
    blocks, tasks = objects._blocks, []

    def counted(pieces):
        tasks.append((pieces.select("start").distinct().count(), pieces.rdd.getNumPartitions()))
        return blocks(pieces)

    monkeypatch.setattr(objects, "_blocks", counted)
    rows = split(str(tmp_path), 100)
    assert tasks[0][0] > 5 * tasks[0][1] and tasks[0][1] <= spark.sparkContext.defaultParallelism
    assert [(r.key, json.loads(r.json)) for r in _in_order(rows)] == [(k, v) for k, v in wanted.items()]
