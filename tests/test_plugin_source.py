"""A data source of one's own, as a table and as a stream."""

from __future__ import annotations

from pathlib import Path

import pytest

from trainscore import load_source
from trainscore.spec import SourceSpec
from trainscore.plans.jobs import add_plugin_code

EXAMPLE = str(Path(__file__).resolve().parent.parent / "examples" / "segments_plugin.py")
FORMAT = "segments_plugin.Segments"


def segments(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_every_line_is_in_one_range(spark, tmp_path):
    add_plugin_code(spark, EXAMPLE)
    lines = [(i, "é" * (i % 7) + "x\ty") for i in range(50)]
    path = segments(tmp_path / "s", a="\n".join(f"{i}\t{d}" for i, d in lines), b="7\n\nx\tz\n-3\t\n", c="")
    expected = sorted([*lines, (7, None), (None, "z"), (-3, "")], key=str)
    for size in ("1", "10", "64", "100000"):
        rows = load_source(spark, {"source": path, "type": "plugin", "inputFormat": FORMAT, "options": {"bytesPerPartition": size}})
        assert sorted(map(tuple, rows.collect()), key=str) == expected
    empty = segments(tmp_path / "none")
    assert load_source(spark, {"source": empty, "type": "PLUGIN", "inputFormat": FORMAT}).count() == 0


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    add_plugin_code(spark, EXAMPLE)
    path = segments(tmp_path / "s", **{f"p{i}": f"{i}\tone\n" for i in range(3)})
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        load_source(spark, {"source": path, "type": "plugin", "inputFormat": FORMAT})  # registers it
        rows = spark.readStream.format("segments").load(path)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.request_id for r in spark.read.parquet(out).collect())

    assert run() == [0, 1, 2]
    segments(tmp_path / "s", p3="3\ttwo\n", p4="4\ttwo\n")
    assert run() == [0, 1, 2, 3, 4]


def test_a_later_session_reads_it_too(spark, tmp_path):
    add_plugin_code(spark, EXAMPLE)
    path = segments(tmp_path / "s", a="1\tone\n")
    for session in (spark, spark.newSession(), spark.newSession()):
        assert load_source(session, {"source": path, "type": "plugin", "inputFormat": FORMAT}).collect() == [(1, "one")]


def test_settings_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="inputFormat"):
        load_source(spark, SourceSpec.parse({"source": str(tmp_path), "type": "plugin"}))
    with pytest.raises(ValueError, match="is not a DataSource"):
        load_source(spark, {"source": str(tmp_path), "type": "plugin", "inputFormat": "pathlib.Path"})
