"""Logs in splits, workbooks of points, lines that change under a running stream."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from flowspark.operators.crossing import Device, Line, Rules, run_device
from flowspark.sources import tables, workbooks
from flowspark.streaming import streams

from .test_crossing import ANCHOR, LINE, line, observed
from .test_streams import drain, put


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_log_lines_across_splits(spark, tmp_path, size):
    """Line breaks of all kinds at the edges of splits, empty lines, several files, a last line without an end."""
    rng = random.Random(size)
    want = []
    for f in range(3):
        rows = ["".join(rng.choice("abü ") for _ in range(rng.choice((0, 1, 5, 6, 40)))) for _ in range(120)]
        text = "".join(r + rng.choice(("\n", "\r\n", "\r\n", "\n\n")) for r in rows) + ("" if f else "last")
        (tmp_path / f"{f}.log").write_bytes(text.encode())
        want += [(i, x) for i, x in enumerate(text.replace("\r\n", "\n").split("\n"), 1) if x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = tables.read_log(spark, str(tmp_path))
        assert sorted(tuple(r) for r in df.collect()) == sorted(want)
        assert size > 64 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def workbook(path, rows, sheet="Sheet1"):
    """A workbook as spreadsheet programs write it: shared and inline strings, rich text, numbers, cells left out."""
    shared, out = [], []
    for r, cells in enumerate(rows, 1):
        xml = ""
        for i, v in enumerate(cells):
            ref = f"{chr(65 + i)}{r}"
            if isinstance(v, float):
                xml += f'<c r="{ref}"><v>{v!r}</v></c>'
            elif isinstance(v, tuple):
                xml += f'<c r="{ref}" t="inlineStr"><is><t>{v[0]}</t></is></c>'
            elif v is not None:
                shared.append(f"<si><r><t>{v[:1]}</t></r><r><t xml:space='preserve'>{v[1:]}</t></r><rPh><t>no</t></rPh></si>" if len(shared) % 2 else f"<si><t xml:space='preserve'>{v}</t></si>")
                xml += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        out.append(f'<row r="{r}">{xml}</row>')
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Other" sheetId="1" r:id="rId1"/><sheet name="{sheet}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(out)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(shared)}</sst>')


def test_workbook_of_points(spark, tmp_path):
    def row(point=None, category=None, old=None, new=None, x=None, y=None, status=None):
        return [None, None, None, None, point, category, old, new, None, x, y, status]

    rows = [
        row("点位编号", "类别", "名称", "新名", None, None, "状态"),
        row(" P1 ", "北门出入口", "old 1", None, 116.5, 40.25),
        row("P2", "卡口-入口", "old 2", " new 2 ", 1.0, 2.0, "正常"),
        row(("P3",), "便道", "old 3"),
        row(None, "x", "no id", None, None, None, "停用"),
        row("", "x", "blank id", None, None, None, "停用"),
        row("P4", None, None, None, None, None, "停用"),
        row("P5", "卡口出口", "gone", None, None, None, "停用"),
        row("P6", None, "old 6", "", None, None, " "),
        row("P7", "入口", "old 1", None, 7.0, 8.0, "维修"),
    ]
    workbook(tmp_path / "b.xlsx", rows)
    got = workbooks.points(workbooks.read_workbook(spark, str(tmp_path / "b.xlsx")), F.col("name") == "gone").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        str(t)
        for t in (
            ("old 1", "P7", "入口", 7.0, 8.0, "维修", "入口", None),
            ("new 2", "P2", "卡口-入口", 1.0, 2.0, "正常", "入口", "车辆卡口"),
            ("old 3", "P3", "便道", None, None, "正常", None, "便道"),
            ("old 6", "P6", None, None, None, "正常", None, None),
        )
    )
    first = workbooks.points(workbooks.read_workbook(spark, str(tmp_path / "b.xlsx")).where("row_no <= 2")).first()
    assert first["status"] == workbooks.UNVERIFIED and first["entrance_type"] == "出入口"
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_workbook(spark, str(tmp_path / "b.xlsx"), "Elsewhere").collect()


def test_a_line_that_changes_between_micro_batches(spark, tmp_path):
    rows = observed(5, 2, 40)
    early, late = rows[rows.t_mono < 3.0], rows[rows.t_mono >= 3.0]
    rules = Rules(hold_frames=1, min_motion=0.5)
    moved = [(0.1, 0.45), (0.9, 0.55)]
    versions = [("cam-0", 0.0, 1, LINE), ("cam-1", 0.0, 1, LINE), ("cam-0", 3.0, 2, moved), ("cam-0", 3.5, 1, LINE), ("cam-1", 9.0, 1, moved)]
    table = spark.createDataFrame([(d, s, v, [list(map(float, p)) for p in ln], list(ANCHOR), 1280, 720, None, None) for d, s, v, ln in versions], streams.GEOMETRY)
    for name in ("obs", "geo"):
        (tmp_path / name).mkdir()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame(rows).schema)
    for k, part in enumerate((early, late)):  # each a run of the query, with what is new
        for name, df in (("obs", spark.createDataFrame(part)), ("geo", table.where("since = 0" if k == 0 else "since > 0"))):
            put(spark, f"{tmp_path}/{name}", [df])
            for f in (tmp_path / name).glob("0-*"):
                f.rename(tmp_path / name / f"run{k}-{f.name}")
        found = streams.crossings_of_versions(streams.read(spark, f"{tmp_path}/obs", schema), streams.read(spark, f"{tmp_path}/geo", streams.GEOMETRY), rules)
        drain(found, f"{tmp_path}/c", sink=lambda batch, n, k=k: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}-{n}"))
    got = sorted((r["device_id"], r["track_id"], r["event_type"], round(r["t_cross"], 6), r["version"]) for r in spark.read.parquet(*map(str, (tmp_path / "out").iterdir())).collect())
    want = []
    for device, cuts in (("cam-0", [(early, line(), 1), (late, Line(moved, ANCHOR, 1280, 720), 2)]), ("cam-1", [(rows, line(), 1)])):
        for part, ln, version in cuts:
            want += [(e[0], e[1], e[2], round(e[4], 6), version) for e in run_device(Device(), part[part.device_id == device], ln, rules)[0]]
    assert got == sorted(want) and {v for *_, v in got} == {1, 2}
