"""Files, captures as a source, versions and archives: what is opened, what a run that dies leaves, and odd bytes."""

import datetime as dt
import gzip
import io
import json
import zipfile

import pytest
from harborlight.sources import captures, files


def capture(folder, t, stations, broken=False):
    path = folder / "status" / f"{t:%Y/%m/%d}" / f"status_{t:%Y%m%dT%H%M%S}Z.json.gz"
    path.parent.mkdir(parents=True, exist_ok=True)
    body = {"last_updated": 5, "data": {"stations": stations}, "more": 1}
    path.write_bytes(b"not gzip" if broken else gzip.compress(json.dumps(body).encode()))
    return path


def test_files_outside_the_window_are_not_opened(spark, tmp_path):
    day = dt.datetime(2024, 3, 31, 23, 0)
    for n in range(-6, 9):
        t = day + dt.timedelta(minutes=20 * n)
        capture(tmp_path, t, [{"station_id": str(n), "num_docks_available": n}, {"station_id": "x", "odd": [1]}], broken=not -1 <= n <= 5)
    for t in (dt.datetime(2023, 12, 1), dt.datetime(2025, 1, 1), dt.datetime(2024, 5, 5)):
        capture(tmp_path, t, [], broken=True)
    (tmp_path / "status/2024/04/01/notes.txt").write_text("no capture")
    folder = f"{tmp_path}/status"
    minutes = lambda n: day + dt.timedelta(minutes=n)
    got = captures.read(spark, folder, minutes(-40), minutes(100))
    assert sorted((r.station_id, r.num_docks_available) for r in got.where("station_id <> 'x'").collect()) == [(str(n), n) for n in range(-1, 6)]
    assert got.where("station_id = 'x' and num_docks_available is null and last_reported is null").count() == 7
    assert captures.read(spark, folder, minutes(-21), minutes(99)).select("file").distinct().count() == 6
    assert got.where("captured_at > timestamp'2024-04-01'").count() == 4 and got.count() == 14
    with pytest.raises(Exception, match="gzip|Gzip"):
        captures.read(spark, folder).count()
    assert captures.read(spark, folder, dt.datetime(2030, 1, 1)).count() == 0


def test_folders_of_a_window(tmp_path):
    for path in ("2023/12/31", "2024/01/01", "2024/01/15", "2024/02/01", "2024/11/30", "2025/01/01", "x/01/01"):
        (tmp_path / path).mkdir(parents=True)
    found = list(captures.folders(str(tmp_path), dt.datetime(2023, 12, 31, 5), dt.datetime(2024, 1, 15)))
    assert [f[-10:] for f in found] == ["2023/12/31", "2024/01/01", "2024/01/15"]
    assert len(list(captures.folders(str(tmp_path), *captures.FOREVER))) == 6 and list(captures.folders(f"{tmp_path}/none", *captures.FOREVER)) == []


def test_a_run_that_dies_leaves_readers_on_the_old_version(spark, tmp_path):
    folder = str(tmp_path)
    files.publish(spark.range(3), folder)
    with pytest.raises(RuntimeError):
        files.publish(spark.range(9), folder, stop_before_pointer=True)
    assert files.current(spark, folder).count() == 3
    assert len(files.recovered(folder)) == 1 and files.recovered(folder) == [] and files.current(spark, folder).count() == 3
    files.publish(spark.range(4), folder)
    assert files.current(spark, folder).count() == 4 and not list(tmp_path.glob("*.tmp"))


def test_sync_copies_what_differs(spark, tmp_path):
    source, target = tmp_path / "a", tmp_path / "b"
    for d, size in ((1, 3), (2, 4), (3, 5)):
        (source / f"f/2024/01/0{d}").mkdir(parents=True)
        (source / f"f/2024/01/0{d}/x y.bin").write_bytes(b"a" * size)
    window = dt.date(2024, 1, 2), dt.date(2024, 1, 9)
    run = lambda **more: files.synced(spark, str(source), str(target), **more)
    assert run(feed="f", days=window) == ["f/2024/01/02/x y.bin", "f/2024/01/03/x y.bin"] and run(feed="f", days=window) == []
    (source / "f/2024/01/03/x y.bin").write_bytes(b"changed")
    assert run(feed="f", days=window) == ["f/2024/01/03/x y.bin"] and run() == ["f/2024/01/01/x y.bin"]
    assert (target / "f/2024/01/03/x y.bin").read_bytes() == b"changed" and not list(target.rglob("*.tmp"))
    assert files.synced(spark, f"{tmp_path}/none", str(target)) == []


def test_archives_in_windows_1252(spark, tmp_path):
    every = bytes(b for b in range(0x80, 0xA0))
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("x/one.csv", b'id,name\r\n1,"' + every + b', q"\r\n2,\r\n')
        archive.writestr("x/two.CSV", io.BytesIO(b"name,other,id\n" + b"".join(b"n%d,z,%d\n" % (i, i) for i in range(25_000))).getvalue())
        archive.writestr("read.me", b"id,name\n9,no\n")
    found = files.members(spark.createDataFrame([(str(path),)], "path string"))
    assert found.count() == 2
    rows = files.unzipped(found, ["id", "name", "none"])
    assert rows.where("id = '1' and member = 'x/one.csv'").first().name == every.decode("cp1252", "replace") + ", q"
    assert rows.where("member = 'x/two.CSV' and name = concat('n', id) and none is null").count() == 25_000 and rows.where("id = '2' and name = ''").count() == 1
