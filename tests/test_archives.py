"""Members of archives as partitions, and exports of ticks against hand-counted rows."""

import zipfile

import pytest

from tidemill.sources import archives as A

ROWS = [
    ("2024.01.01", "00:00:00.100", "100.0", "", "", "", "2"),  # no ask yet
    ("2024.01.01", "00:00:01.000", "", "100.5", "", "", "4"),
    ("2024.01.01", "00:00:01.000", "", "100.5", "", "", "4"),  # the same row again
    ("2024.01.01", "00:00:01.000", "100.1", "100.6", "", "", "6"),  # the same time
    ("2024.01.01", "00:14:59", "", "", "", "", ""),  # neither side
    ("2024.01.01", "00:15:00.000", "-1", "", "", "", "2"),  # no price
    ("2024.01.01", "00:16:00.000", "101.0", "", "", "", "2"),  # crosses the ask
    ("2024.01.01", "00:17:00.000", "", "102.0", "", "", "4"),
    ("2024.01.01", "01:00:00.000", "103.0", "", "", "", "2"),  # after two quarters without rows: the ask is unknown
    ("2024.01.01", "01:00:01.000", "", "103.5", "", "", "4"),
    ("not a date", "01:00:02.000", "103.0", "104.0", "", "", "6"),
]


def text(delimiter, rows=ROWS):
    return "\n".join(delimiter.join(r) for r in [A.EXPORT, *rows]) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("ticks")
    (path / "plain.csv").write_text("﻿" + text("\t"), encoding="utf-8")
    with zipfile.ZipFile(path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", text(";"))
        z.writestr("b/b.csv", text("\t"))
        z.writestr("c.CSV", text(",", ROWS[:2]))
        z.writestr("readme.txt", "no ticks")
    return path


def test_members_are_partitions(spark, folder):
    found = {(r["file"].rsplit("/", 1)[-1], r["member"]): r for r in A.inspected(spark, str(folder)).collect()}
    assert set(found) == {("plain.csv", None), ("many.zip", "a.csv"), ("many.zip", "b/b.csv"), ("many.zip", "c.CSV")}
    assert found["plain.csv", None]["delimiter"] == "\t" and found["many.zip", "a.csv"]["delimiter"] == ";"
    assert all(r["columns"] == A.EXPORT for r in found.values()) and found["many.zip", "a.csv"]["sample"] == [list(r) for r in ROWS[:3]]
    rows = A.read_ticks(spark, str(folder))
    assert rows.rdd.getNumPartitions() == 4
    by = {}
    for r in rows.collect():
        by.setdefault(r["sample"].rsplit("/", 1)[-1] if "!" not in r["sample"] else r["sample"].split("!")[1], []).append((r["source_row"], *[r[c] for c in A.EXPORT]))
    whole = [(i + 2, *r) for i, r in enumerate(ROWS)]
    assert sorted(by["plain.csv"]) == sorted(by["a.csv"]) == sorted(by["b/b.csv"]) == whole and sorted(by["c.CSV"]) == whole[:2]


def test_ticks_and_counters(spark, folder):
    rows = A.read_ticks(spark, str(folder / "plain.csv"))
    found = [(r["source_row"], r["bid"], r["ask"], r["bid_carried"], r["ask_carried"], r["update_type"], r["segment_id"]) for r in A.sample_ticks(rows).orderBy("source_row").collect()]
    assert found == [
        (3, 100.0, 100.5, True, False, "ask_only", 1), (5, 100.1, 100.6, False, False, "both", 1),
        (9, 101.0, 102.0, True, False, "ask_only", 1), (11, 103.0, 103.5, True, False, "ask_only", 2),
    ]
    (c,) = A.sample_counters(rows).collect()
    assert (c["rows"], c["ticks"], c["both"], c["bid_only"], c["ask_only"]) == (11, 4, 1, 3, 3)
    assert (c["malformed"], c["repeated"], c["out_of_order"], c["repeated_times"], c["missing_quarters"]) == (3, 1, 0, 2, 2)
    assert A.sample_counters(A.read_ticks(spark, str(folder))).count() == 4


def test_disorder_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text(text(",", [ROWS[7], ROWS[0]]))
    rows = A.read_ticks(spark, str(tmp_path / "x.csv"))
    assert A.sample_counters(rows).first()["out_of_order"] == 1
    with pytest.raises(Exception, match="a time falls in .* at row 3"):
        A.refuse_disorder(rows).collect()


@pytest.mark.parametrize(("name", "content"), [("x.csv", "abc\n1\n"), ("x.csv", "a,a\n1,2\n"), ("x.csv", b"\xff\xfe,b\n"), ("x.zip", "no zip"), ("x.txt", "a,b\n")])
def test_files_that_are_no_ticks(spark, tmp_path, name, content):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    with pytest.raises(A.TickImportError):
        A.inspected(spark, str(tmp_path / name))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("a.txt", "")
    with pytest.raises(A.TickImportError, match="no CSV"):
        A.inspected(spark, str(tmp_path / "empty.zip"))
