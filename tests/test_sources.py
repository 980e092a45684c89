"""Readers: formats, malformed input, positions, backlash, sidecars, tiles."""

import json
import struct

import numpy as np
import pytest

from stagelog.sources import logs as L
from stagelog.sources.sinks import write_positions, write_steps
from stagelog.sources.tiles import decode_bmp, read_tiles


def record(i, step=None):
    return {"timestamp": 1700000000.5 + i, "experiment_name": "walk", "iteration": 1, "step": i if step is None else step,
            "x_target_abs": 100 * i, "y_target_abs": -i, "x_actual_abs": 100 * i + 3, "y_actual_abs": -i,
            "confidence": "0.9911", "img_path": f"temp\\a_{i:03d}.bmp"}


RECORDS = [record(0), record(1), record(2, "end")]
LINES = "\n".join(json.dumps(r) for r in RECORDS)
FILES = {
    "array_pretty.json": json.dumps(RECORDS, indent=2), "array_line.jsonl": json.dumps(RECORDS), "lines.jsonl": LINES,
    "bom.jsonl": "﻿" + LINES + "\n", "blank.jsonl": "\n" + LINES.replace("\n", "\n\n   \n") + "\n\n",
    "mixed_array.json": "[" + json.dumps(RECORDS[0]) + ",\n" + json.dumps(RECORDS[1]) + ", " + json.dumps(RECORDS[2]) + "]"}


@pytest.mark.parametrize("name", FILES)
def test_same_rows_in_every_format(spark, tmp_path, name):
    (tmp_path / name).write_text(FILES[name], encoding="utf-8")
    rows = sorted(L.read_steps(spark, str(tmp_path / name)).collect(), key=lambda r: r.source_index)
    assert [r.source_index for r in rows] == [0, 1, 2]
    assert [(r.step, r.is_final) for r in rows] == [(0, False), (1, False), (None, True)]
    assert rows[1].filename == "a_001.bmp" and rows[1].confidence == 0.9911 and rows[1].confidence_text == "0.9911"
    assert rows[0].run_id == name.rsplit(".", 1)[0] and rows[2].x_actual_abs == 203


def test_layouts(spark, tmp_path):
    texts = {"a": FILES["array_pretty.json"], "b": LINES, "c": json.dumps(RECORDS[0], indent=2), "d": json.dumps(RECORDS[0]),
             "e": "", "f": "[]", "g": " \n\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file[-6]: r.layout for r in L.detect_layout(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k != "e"} == {
        "a": "json-array", "b": "jsonl", "c": "json-object", "d": "json-object", "f": "json-array", "g": "empty"}
    counts = {r.run_id: r["count"] for r in L.read_steps(spark, str(tmp_path)).groupBy("run_id").count().collect()}
    assert counts == {"a": 3, "b": 3, "c": 1, "d": 1}


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(LINES.replace("\n", '\n{"timestamp": 1, oops\n[1, 2]\n', 1))
    with pytest.raises(Exception, match="malformed record"):
        L.read_steps(spark, str(path)).collect()
    rows = L.read_steps(spark, str(path), "permissive")
    assert sorted(r.source_index for r in rows.collect()) == [0, 1, 2]
    assert L.skipped_records(spark, str(path)).count() == 2


def test_positions(spark, tmp_path):
    entries = {f"a_{i:03d}.bmp": {"x": i, "y": 2 * i, "w": 1280, "h": 900, "confidence": 0.5 + i / 100} for i in range(5)}
    for name, indent in (("p", 2), ("q", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(entries, indent=indent))
    rows = L.read_positions(spark, str(tmp_path / "*.json")).collect()
    for run in "pq":
        mine = sorted((r for r in rows if r.run_id == run), key=lambda r: r.entry)
        assert [r.filename for r in mine] == list(entries) and [r.entry for r in mine] == list(range(5))
        assert [r.confidence for r in mine] == [e["confidence"] for e in entries.values()]
    (tmp_path / "bad.txt").write_text('[{"x": 1}]')
    with pytest.raises(Exception, match="not a positions object"):
        L.read_positions(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "text.txt").write_text('{"a.bmp": {"x": 1, "confidence": "high"}}')
    with pytest.raises(Exception, match="no numeric confidence"):
        L.read_positions(spark, str(tmp_path / "text.txt")).collect()


def test_written_forms_read_back(spark, frame, tmp_path):
    pos = frame([("r", f'odd "name" \\ {i}.bmp', i, i, -i, 10, 20, 0.5) for i in range(50)],
                "run_id string, filename string, entry bigint, x bigint, y bigint, w bigint, h bigint, confidence double")
    write_positions(pos, str(tmp_path / "p"))
    back = L.read_positions(spark, str(tmp_path / "p/*/*.txt"), run_from="folder")
    assert sorted(map(tuple, back.select(pos.columns).collect())) == sorted(map(tuple, pos.collect()))
    text = "".join(f.read_text() for f in sorted((tmp_path / "p" / "run_id=r").glob("*.txt")))
    assert len(json.loads(text)) == 50
    (tmp_path / "a.jsonl").write_text(LINES)
    steps = L.read_steps(spark, str(tmp_path / "a.jsonl"))
    write_steps(steps, str(tmp_path / "s"))
    again = L.read_steps(spark, str(tmp_path / "s/*/*.json"), run_from="folder")
    assert sorted(map(str, again.select(steps.columns).collect())) == sorted(map(str, steps.collect()))


def test_backlash(spark, tmp_path):
    sub = [{"step": s, "r_target": 0.0, "x_target": 1, "y_target": 0, "x_move": 1, "y_move": 0, "dx_measured": 5,
            "dy_measured": 6, "conf": "0.9000", "img_path": "a", "meta_path": "b"} for s in (0, 1, "final")]
    task = {"task_id": 1, "total_tasks": 2, "x_target": 0, "y_target": -900000, "r_target": 0.0, "move": 100, "steps": 1, "sub_history": sub}
    (tmp_path / "n.json").write_text("".join(json.dumps({**task, "task_id": k}, indent=2) + "\n" for k in (1, 2)))
    rows = L.read_backlash(spark, str(tmp_path / "n.json"), "nested").collect()
    assert len(rows) == 6 and sum(r.is_final for r in rows) == 2
    assert sorted(r.seq for r in rows if r.task_id == 2) == [0, 1, 2] and rows[0].conf == 0.9
    flat = {"task": 1, "x_target": 0, "y_target": 0, "r_target": 45.0, "move": 1500, "dx_measured": 3, "dy_measured": 4,
            "conf": "0.8000", "img_path": "a", "meta_path": "b"}
    (tmp_path / "f.json").write_text(json.dumps(flat) + "\n" + json.dumps(flat) + "\n")
    assert [r.conf for r in L.read_backlash(spark, str(tmp_path / "f.json")).collect()] == [0.8, 0.8]


def test_image_meta(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("[SemImageFile]\r\nPixelSize=12.40234\r\nDataSize=1280x960\r\n".encode("utf-16"))
    row = L.read_image_meta(spark, str(tmp_path)).first()
    assert (row.pixel_size, row.width, row.height) == (12.40234, 1280, 960)


def bmp(image):
    h, w = image.shape
    stride = (w + 3) // 4 * 4
    table = b"".join(bytes([v, v, v, 0]) for v in range(256))
    body = b"".join(bytes(row) + b"\0" * (stride - w) for row in image[::-1])
    start = 54 + len(table)
    return (b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start)
            + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(body), 0, 0, 256, 0) + table + body)


def test_tiles(spark, tmp_path):
    image = np.arange(70 * 6, dtype=np.uint8).reshape(70, 6)
    (tmp_path / "run1").mkdir()
    for name in ("b.bmp", "a.bmp"):
        (tmp_path / "run1" / name).write_bytes(bmp(image))
    (tmp_path / "run1" / "c.bmp").write_bytes(b"not an image")
    (tmp_path / "run1" / "d.bmp").write_bytes(bmp(image[:60]))
    assert (decode_bmp(bmp(image)) == image).all()
    tiles, bad = read_tiles(spark, str(tmp_path))
    rows = sorted(tiles.collect(), key=lambda r: r.tile_id)
    assert [(r.run_id, r.filename, r.tile_id, r.w, r.h) for r in rows] == [("run1", "a.bmp", 0, 6, 10), ("run1", "b.bmp", 1, 6, 10)]
    assert bytes(rows[0].pixels) == image[:10].tobytes()
    assert sorted(r.filename for r in bad.collect()) == ["c.bmp", "d.bmp"]


def test_folders_are_written_and_listed_by_tasks(spark, tmp_path):
    """Names, files and pieces are those of Spark's writer and reader, which go through the driver."""
    from stagelog.sources import folders

    keys = ["a b%c=d", "e:1", "", None, "x"]
    rows = spark.createDataFrame([(k, f"p{i % 3}", i, f'{{"n": {i}}}') for k in keys for i in range(9)], "run_id string, part string, n int, value string")
    rows = rows.repartition(3).sortWithinPartitions("run_id", "part", "n")
    rows.drop("n").where("run_id IS NULL OR run_id != ''").write.partitionBy("run_id", "part").json(str(tmp_path / "spark"))
    folders.write_folders(rows.select("run_id", "part", "value"), str(tmp_path / "own"), ["run_id", "part"], ".json")
    names = [sorted(str(p.relative_to(tmp_path / x)) for p in (tmp_path / x).glob("*/*")) for x in ("spark", "own")]
    assert names[0] == names[1] and len(names[0]) == 12
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.name[0] == "." and not p.name.endswith(".crc")]
    path = str(tmp_path / "own") + "/*/*/*.json"
    for separator in "\n}":
        lines = folders.folder_pieces(spark, path, separator, ("run_id", "part"))
        read = spark.read.option("lineSep", separator).text(path).selectExpr("value", "_metadata.file_path AS file")
        assert sorted(lines.select("value", "file").collect()) == sorted(read.collect())
    lines = folders.folder_pieces(spark, path, "\n", ("run_id", "part"))
    want = [(k or None, f"p{i % 3}", f'{{"n": {i}}}') for k in keys for i in range(9)]
    assert sorted(map(str, lines.select("run_id", "part", "value").collect())) == sorted(map(str, spark.createDataFrame(want, "run_id string, part string, value string").collect()))
    assert folders.folder_pieces(spark, str(tmp_path / "own/*/*.json"), "\n") is None and folders.folder_pieces(spark, str(tmp_path / "none/*/*.json"), "\n") is None


def test_pieces_over_ranges_of_a_file(tmp_path):
    from stagelog.sources.folders import _cut

    rng = np.random.default_rng(2)
    for text in (b"", b"}", b"ab", b"}}a}", *[bytes(rng.choice(list(b"ab}\n"), n)) for n in (5, 17, 40) for _ in range(20)], b"x" * 30 + b"}y"):
        (tmp_path / "f").write_bytes(text)
        for step in (1, 3, 8, 100):
            got = []
            with open(tmp_path / "f", "rb") as file:
                for begin in range(0, len(text), step):
                    at, pieces = _cut(file, begin, min(begin + step, len(text)), len(text), b"}")
                    for p in pieces:
                        got.append((at, p))
                        at += len(p) + 1
            whole = text.split(b"}")
            whole = whole[:-1] if not whole[-1] else whole
            assert [p for _, p in got] == whole and all(text[at:at + len(p)] == p for at, p in got)


def test_a_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from stagelog.sources import folders

    monkeypatch.setattr(folders, "RANGE", 300)
    (tmp_path / "r" / "run_id=1").mkdir(parents=True)
    (tmp_path / "r" / "run_id=1" / "a.json").write_text("\n".join(json.dumps(record(i)) for i in range(50)))
    (tmp_path / "r" / "run_id=1" / "b.json").write_text("\n".join(json.dumps(record(i)) for i in range(50, 70)) + "\n")
    rows = L.read_steps(spark, str(tmp_path / "r") + "/*/*.json", layout="jsonl", run_from="folder").collect()
    assert sorted((r.source_index, r.step) for r in rows) == [(i, i) for i in range(70)]


def test_written_folders_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """The driver neither lists the folders nor makes a task of every few files."""
    schema = "run_id string, filename string, entry bigint, x bigint, y bigint, w bigint, h bigint, confidence double"
    pos = spark.createDataFrame([(f"r{i // 2}", f"{i}.bmp", i, i, i, 1, 1, 0.5) for i in range(600)], schema)
    write_positions(pos, str(tmp_path / "p"))
    back = L.read_positions(spark, str(tmp_path / "p/*/*.txt"), run_from="folder")
    pieces = L._pieces(spark, str(tmp_path / "p/*/*.txt"), "}")
    assert pieces.inputFiles() == [] and pieces.rdd.getNumPartitions() == 8
    assert sorted(map(tuple, back.select(pos.columns).drop("entry").collect())) == sorted(map(tuple, pos.drop("entry").collect()))


def _plans(monkeypatch):
    seen, cut = [], L.cut_lineage

    def watched(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(L, "cut_lineage", watched)
    return seen


def test_positions_are_parsed_once(spark, tmp_path, monkeypatch):
    names = ["a.bmp", 'q"b', "tab\\t", "ü x", "", "x" * 3000]
    pos = spark.createDataFrame([("r=1", n, i, i, -i, 10, 20, 0.5) for i, n in enumerate(names)],
                                "run_id string, filename string, entry bigint, x bigint, y bigint, w bigint, h bigint, confidence double")
    write_positions(pos, str(tmp_path / "p"))
    seen = _plans(monkeypatch)
    back = L.read_positions(spark, str(tmp_path / "p/*/*.txt"), run_from="folder").collect()
    assert {(r.run_id, r.entry, r.filename, r.y) for r in back} == {("r%3D1".replace("%", "%25"), i, n, -i) for i, n in enumerate(names)}
    assert len(seen) == 1 and seen[0].count("from_json(StructField(x,") == 1


def test_records_are_parsed_once(spark, tmp_path, monkeypatch):
    steps = spark.createDataFrame([("a", i, i, 5 * i) for i in range(20)], "run_id string, source_index bigint, step bigint, x_target_abs bigint")
    write_steps(steps, str(tmp_path / "s"))
    seen = _plans(monkeypatch)
    path = str(tmp_path / "s") + "/*/*.json"
    back = L.read_steps(spark, path, layout="jsonl", run_from="folder")
    assert sorted(map(tuple, back.select(*steps.columns).collect())) == sorted(map(tuple, steps.collect()))
    assert len(seen) == 1 and seen[0].count("from_json(StructField(timestamp,") == 1
    some = sorted((tmp_path / "s" / "run_id=a").glob("*.json"))[0]
    some.write_text(some.read_text() + " \n{oops\n")
    with pytest.raises(Exception, match="malformed record"):
        L.read_steps(spark, path, layout="jsonl", run_from="folder").collect()
