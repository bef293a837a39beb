from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.validate import issue_report, validate
from spanloom.plans.verification import verify_folder
from spanloom.shared import stash
from spanloom.sources import (
    find_video_inventory,
    read_annotations,
    read_raw_annotations,
    read_video_categories,
    read_video_inventory,
    to_json_lines,
    to_json_objects,
    write_results,
    write_samples,
)

OBJECT = """{
 "Abuse001_x264": {"duration": 30, "timestamps": [[0, 5.3], ["4", 8.5]], "sentences": ["A", "B } ,"]},
 "Arson002_x264": {"timestamps": [[1.0, 2.0]], "sentences": ["first"]},
 "Normal_Videos_003_x264": {"duration": 9.5, "timestamps": [[3.5, 3.5], [-1, 2], [1, 2]], "sentences": ["x", "y"]},
 "Arson002_x264": {"timestamps": [[1.0, 2.0]], "sentences": ["second"]},
 "Empty004_x264": {"duration": null, "timestamps": [], "sentences": []}
}"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Train.json").write_text(OBJECT)
    for name in ("Abuse/Abuse001_x264", "Abuse/Abuse002_x264", "Arson/Arson002_x264"):
        path = tmp_path / "videos" / f"{name}.mp4"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    (tmp_path / "videos" / "Arson" / "notes.txt").write_text("x")
    return tmp_path


def test_annotation_file(spark, folder):
    rows = read_annotations(spark, str(folder / "Train.json"), "Train").orderBy("pos").collect()
    assert [r["video_id"] for r in rows] == list(json.loads(OBJECT))
    assert rows[0]["duration"] == 30.0 and rows[0]["timestamps"] == [[0.0, 5.3], [4.0, 8.5]]
    assert rows[0]["sentences"] == ["A", "B } ,"]
    assert rows[1]["duration"] is None and rows[1]["sentences"] == ["second"] and rows[1]["pos"] == 1
    assert rows[3]["duration"] is None and rows[3]["timestamps"] == []


def test_annotation_lines(spark, folder, tmp_path):
    records = read_annotations(spark, str(folder / "Train.json"), "Train")
    to_json_lines(records).write.text(str(tmp_path / "lines"))
    again = read_annotations(spark, str(tmp_path / "lines"), "Train", layout="lines").drop("pos")
    assert sorted(map(str, again.collect())) == sorted(map(str, records.drop("pos").collect()))
    (tmp_path / "dup.jsonl").write_text(OBJECT.replace("\n", " "))
    rows = read_raw_annotations(spark, str(tmp_path / "dup.jsonl"), "Train", layout="lines").orderBy("pos").collect()
    assert [r["video_id"] for r in rows] == list(json.loads(OBJECT))
    assert "second" in rows[1]["raw"]
    several = '{"a": {"v": 1}, "b": {"v": 1}}\n{"b": {"v": 2}}\n{"c": {"v": 1}, "a": {"v": 3}}\n'
    (tmp_path / "several.jsonl").write_text(several)
    rows = read_raw_annotations(spark, str(tmp_path / "several.jsonl"), "Train", layout="lines").orderBy("pos").collect()
    assert [(r["video_id"], r["raw"]) for r in rows] == [("a", '{"v":3}'), ("b", '{"v":2}'), ("c", '{"v":1}')]
    with pytest.raises(ValueError):
        read_raw_annotations(spark, "x", "Train", layout="other")


@pytest.fixture
def tiny_blocks(spark):
    """Sessions settings that cut files into blocks of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        for name, value in zip(names, (size, 1)):
            spark.conf.set(name, value)

    yield cut
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def hostile(seed, n):
    """JSON text of an object whose keys and values are full of what JSON is made of."""
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice('a"\\{}[],:\n\té\u2028 ') for _ in range(rng.randrange(25)))

    def value(depth):
        kind = rng.randrange(6)
        if kind == 0 and depth < 3:
            return {text(): value(depth + 1) for _ in range(rng.randrange(3))}
        if kind == 1 and depth < 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return rng.choice([1, 2.5, None, True]) if kind == 2 else text()

    items = [(text(), value(0)) for _ in range(n)]
    items += [(items[3][0], "again"), (items[4][0], {"x": [{}]})]
    parts = [json.dumps(k, ensure_ascii=rng.random() < 0.5) + rng.choice([":", " : "]) + json.dumps(v, ensure_ascii=False, indent=rng.choice([None, 1])) for k, v in items]
    return "{" + rng.choice(["", "\n "]) + rng.choice([",", " ,\r\n"]).join(parts) + " }\n"


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_objects_are_read_block_by_block(spark, tmp_path, tiny_blocks, size):
    texts = {f"f{i}.json": hostile(i, 60) for i in range(2)}
    for name, body in texts.items():
        (tmp_path / name).write_text(body)
    tiny_blocks(size)
    for name, body in texts.items():
        rows = read_raw_annotations(spark, str(tmp_path / name), "Train").orderBy("pos").collect()
        data = json.loads(body)
        assert [r["video_id"] for r in rows] == list(data)
        for r in rows:
            want = data[r["video_id"]]
            assert r["raw"] == want if isinstance(want, str) else (None if r["raw"] is None else json.loads(r["raw"])) == want
    both = read_raw_annotations(spark, str(tmp_path), "Train")
    assert both.count() == sum(len(json.loads(b)) for b in texts.values())
    if size == 150:
        assert spark.read.option("lineSep", '"').text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_places_go_on_over_blocks(spark, tmp_path, tiny_blocks):
    data = {f"v{i}": {"duration": i, "timestamps": [[0, i]], "sentences": ["x" * (i % 50)]} for i in range(400)}
    (tmp_path / "a.json").write_text(json.dumps(data))
    tiny_blocks(300)
    rows = read_annotations(spark, str(tmp_path / "a.json"), "Train").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(400))
    assert [(r["video_id"], r["duration"], r["sentences"]) for r in rows] == [(k, float(v["duration"]), v["sentences"]) for k, v in data.items()]


def test_objects_and_what_is_none(spark, tmp_path):
    for text, n in (("{}", 0), (" { } \n", 0), ('{"a": 1}', 1), ('{"": {}}', 1), ('{"a":{"b":"c"}, "d": "e, \\"f\\": {"}', 2)):
        (tmp_path / "one.json").write_text(text)
        assert read_raw_annotations(spark, str(tmp_path / "one.json"), "Train").count() == n
    for text in ('{"a": 1', '{"a": "b}', '{"a": [1}}}'):
        (tmp_path / "one.json").write_text(text)
        with pytest.raises(ValueError, match="not one whole JSON object"):
            read_raw_annotations(spark, str(tmp_path / "one.json"), "Train")


def test_objects_written_by_spark(spark, tmp_path):
    data = spark.createDataFrame([(f"v{i}", float(i), [[0.0, 1.0]], [f"s {i}"]) for i in range(30)], "video_id string, duration double, timestamps array<array<double>>, sentences array<string>")
    to_json_objects(data.repartition(3)).write.text(str(tmp_path / "out"))
    again = read_annotations(spark, str(tmp_path / "out"), "Train").select(*data.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, data.collect()))


def test_inventory(spark, folder):
    df = read_video_inventory(spark, str(folder / "videos"))
    rows = sorted((r["category"], r["video_id"], r["length"]) for r in df.collect())
    assert rows == [("Abuse", "Abuse001_x264", 5), ("Abuse", "Abuse002_x264", 5), ("Arson", "Arson002_x264", 5)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert find_video_inventory(spark, str(folder / "nowhere")) is None


def test_issues(spark, folder):
    raw = read_raw_annotations(spark, str(folder / "Train.json"), "Train")
    issues = validate(raw).orderBy("pos", "kind_no", "item").collect()
    assert [i["message"] for i in issues] == [
        "Arson002_x264: missing required fields",
        "Normal_Videos_003_x264: timestamps/sentences length mismatch",
        "Normal_Videos_003_x264: invalid timestamp [3.5, 3.5]",
        "Normal_Videos_003_x264: invalid timestamp [-1, 2]",
    ]
    shown = issue_report(validate(raw), k=3).orderBy("line").collect()
    assert len(shown) == 3 and {(r["n_issues"], r["n_more"]) for r in shown} == {(4, 1)}


def test_verify_folder(spark, folder):
    files = {"Train": str(folder / "Train.json"), "Val": str(folder / "Val.json")}
    expected = {"Train": {"videos": 4, "annotations": 5}, "Val": {"videos": 1, "annotations": 1}}
    result = verify_folder(spark, files, str(folder / "videos"), expected)
    status = {r["split"]: r for r in result.status.collect()}
    assert status["Train"]["videos_ok"] and status["Train"]["annotations_ok"] and status["Train"]["status"] == "WARN"
    assert status["Val"]["status"] == "MISSING"
    final = result.verdict.first()
    assert not final["is_valid"] and final["videos_present"] and final["n_missing"] == 1
    assert {r["category"]: r["videos"] for r in result.categories.collect()} == {"Abuse": 2, "Arson": 1}
    (folder / "Good.json").write_text('{"a": {"duration": 1, "timestamps": [[0, 1]], "sentences": ["x"]}}')
    fine = verify_folder(spark, {"Good": str(folder / "Good.json")}, str(folder / "videos"), {"Good": {"videos": 1, "annotations": 1}})
    assert fine.verdict.first()["is_valid"]
    gone = verify_folder(spark, {"Good": str(folder / "Good.json")}, str(folder / "no"), {"Good": {"videos": 1, "annotations": 1}})
    assert not gone.verdict.first()["is_valid"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 3.0)], "sample_id int, pred_start double")
    write_results(rows, rows.agg(F.count("*").alias("n_samples")), str(tmp_path / "out"))
    lines = [json.loads(line) for p in (tmp_path / "out" / "rows").glob("*.json") for line in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["sample_id"]) == [{"sample_id": 1, "pred_start": None}, {"sample_id": 2, "pred_start": 3.0}]
    samples = rows.withColumn("split", F.when(F.col("sample_id") == 1, "Train").otherwise("Val"))
    write_samples(samples, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).filter("split = 'Val'").count() == 1


def test_stash_uses_the_shared_folder(spark):
    df = stash(spark.range(3), "check")
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(root in f for f in df.inputFiles()) and df.count() == 3


def test_malformed_fields_are_reported(spark):
    raw = [
        '{"duration": 1, "timestamps": null, "sentences": ["a"]}',
        '{"duration": 1, "timestamps": "x", "sentences": 3}',
        '{"duration": 1, "timestamps": [[1], [1, 2, 3], ["abc", 2], 4, null, ["1", 2], [2, 1]], "sentences": ["a"]}',
        "no json",
        '{"duration": 1, "timestamps": [], "sentences": []}',
    ]
    df = spark.createDataFrame([("s", i, f"v{i}", r) for i, r in enumerate(raw)], "split string, pos bigint, video_id string, raw string")
    rows = validate(df).orderBy("pos", "kind_no", "item").collect()
    assert [r["message"] for r in rows] == [
        "v0: malformed timestamps",
        "v1: malformed timestamps",
        "v1: malformed sentences",
        "v2: timestamps/sentences length mismatch",
        "v2: malformed timestamp [1]",
        "v2: malformed timestamp [1,2,3]",
        'v2: malformed timestamp ["abc",2]',
        "v2: malformed timestamp 4",
        "v2: malformed timestamp null",
        "v2: invalid timestamp [2, 1]",
        "v3: missing required fields",
    ]


def test_results_are_published_together_or_not_at_all(spark, tmp_path):
    rows = spark.range(3)
    bad = rows.select(F.raise_error(F.lit("broken summary")).cast("int").alias("n"))
    out = tmp_path / "results"
    with pytest.raises(Exception, match="broken summary"):
        write_results(rows, bad, str(out))
    assert list(tmp_path.iterdir()) == []
    write_results(rows, rows.limit(1), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["rows", "summary"]
    with pytest.raises(FileExistsError):
        write_results(rows, rows.limit(1), str(out))
    with pytest.raises(Exception, match="broken summary"):
        write_results(spark.range(9), bad, str(out), "overwrite")
    assert spark.read.json(str(out / "rows")).count() == 3  # the older result is still whole
    write_results(spark.range(9), rows.limit(1), str(out), "overwrite")
    assert spark.read.json(str(out / "rows")).count() == 9
    assert [p.name for p in tmp_path.iterdir()] == ["results"]
    with pytest.raises(ValueError):
        write_results(rows, rows, str(out), "append")


def test_totals_are_counted_on_the_way(spark, tmp_path):
    samples = spark.createDataFrame([("a", [1, 2]), ("b", []), ("b", [3])], "split string, annotations array<int>")
    totals = write_samples(samples, str(tmp_path / "s"), array="annotations")
    assert [tuple(r) for r in totals.collect()] == [(3, 3)]
    assert [tuple(r) for r in write_samples(samples.limit(0), str(tmp_path / "none"), array="annotations").collect()] == [(0, 0)]


def test_empty_category_folders_are_seen(spark, folder):
    (folder / "videos" / "Vandalism").mkdir()
    found = verify_folder(spark, {"Train": str(folder / "Train.json")}, str(folder / "videos"))
    assert {r["category"]: r["videos"] for r in found.categories.collect()} == {"Abuse": 2, "Arson": 1, "Vandalism": 0}
    names = read_video_categories(spark, str(folder / "videos"))
    assert [r["category"] for r in names.orderBy("category").collect()] == ["Abuse", "Arson", "Vandalism"]


def test_verification_reads_records_once(spark, folder):
    found = verify_folder(spark, {"Train": str(folder / "Train.json"), "Val": str(folder / "none.json")}, str(folder / "videos"))
    status = {r["split"]: r for r in found.status.collect()}
    assert status["Train"]["n_issues"] == found.issues.count() == 4
    assert (status["Train"]["videos"], status["Train"]["annotations"]) == (4, 5)
    assert [status[s]["status"] for s in ("Train", "Val", "Test")] == ["WARN", "MISSING", "MISSING"]
    assert "FileScan" not in found.status._jdf.queryExecution().executedPlan().toString()


def test_folders_and_videos_are_made_by_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from workload.validation_queries import make_files

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)  # paths do not pass through the driver
    paths = [f"P{n % 3}/{n}_x264.mp4" for n in range(200)] + ["P 4", "P5"]
    make_files(spark.createDataFrame([(p,) for p in paths], "path string"), f"{tmp_path}/videos")
    root = Path(tmp_path, "videos")
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*.mp4")) == sorted(paths[:200])
    assert {p.name for p in root.iterdir()} == {"P0", "P1", "P2", "P 4", "P5"} and all(p.stat().st_size == 1 for p in root.rglob("*.mp4"))
