from __future__ import annotations

import io
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.sources import scans


def plain(**more):
    return {"rows": 2, "columns": 2, "frames": 1, "values": [1, 2, 3, 4]} | more


def pixels(row, **kind):
    return scans.decode(scans.scan_bytes(row, **kind)).get("pixels")


@pytest.mark.parametrize("explicit", [True, False])
def test_samples(explicit):
    assert pixels(plain(), explicit=explicit).tolist() == [1, 2, 3, 4]
    # inversion comes before slope and intercept; a slope of 0 counts as 1
    assert pixels(plain(photometric="MONOCHROME1", slope=2.0, intercept=-1.0), explicit=explicit).tolist() == [5, 3, 1, -1]
    assert pixels(plain(slope=0.0, intercept=3.0), explicit=explicit).tolist() == [4, 5, 6, 7]
    for frames, middle in ((2, 1), (3, 1), (4, 2), (5, 2)):
        assert pixels(plain(frames=frames, values=list(range(4 * frames))), explicit=explicit).tolist() == list(range(4 * middle, 4 * middle + 4))


def test_headers():
    row = scans.decode(scans.scan_bytes(plain(description="sag T2", side="L", position=[1.5, -2.0, 3.25], orientation=[1, 0, 0, 0, 1, 0], instance=7)), with_pixels=False)
    assert row == {"readable": True, "description": "sag T2", "body_part": None, "image_side": None, "side": "L", "position": [1.5, -2.0, 3.25], "orientation": [1, 0, 0, 0, 1, 0], "instance": 7.0, "rows": 2, "columns": 2, "frames": 1}


def test_damage_is_null():
    whole = scans.scan_bytes(plain())
    assert scans.decode(b"")["readable"] is False and scans.decode(b"no scan at all, only text")["readable"] is False
    assert scans.decode(whole[:150])["readable"] is False
    assert scans.decode(whole[:-2])["readable"] is False  # the last element is cut
    assert pixels(plain(values=[1, 2, 3])) is None and pixels(plain(values=None)) is None
    short = scans.decode(scans.scan_bytes(plain(values=[1])))
    assert short["readable"] and short["rows"] == 2 and short["pixels"] is None
    # compressed frames, colours and a slope that is no number
    assert scans.decode(whole.replace(b"1.2.840.10008.1.2.1\0", b"1.2.840.10008.1.2.5\0")).get("pixels") is None
    assert scans.decode(whole.replace(b"\x28\0\x02\0US\x02\0\x01\0", b"\x28\0\x02\0US\x02\0\x03\0")).get("pixels") is None
    assert scans.decode(scans.scan_bytes(plain(slope=1.5)).replace(b"1.5 ", b"x.5 ")).get("pixels") is None
    empty = scans.scan_bytes(plain(slope=1.5)).replace(b"\x28\0\x53\x10DS\x04\x001.5 ", b"\x28\0\x53\x10DS\0\0")
    assert scans.decode(empty)["pixels"].tolist() == [1, 2, 3, 4]


def element(group, number, kind, value):
    return struct.pack("<HH2sH", group, number, kind, len(value)) + value


def test_sequences_are_stepped_over():
    inner = struct.pack("<HH2s2xI", 0x40, 0x0275, b"SQ", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x40, 0x7, b"LO", b"ab") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    outer = struct.pack("<HH2s2xI", 0x8, 0x1140, b"SQ", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + inner + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    rest = element(0x20, 0x13, b"IS", b"12") + element(0x20, 0x60, b"CS", b"R ")
    # without the preamble too
    for whole in (outer + rest, b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + outer + rest):
        row = scans.decode(whole, with_pixels=False)
        assert (row["readable"], row["instance"], row["side"]) == (True, 12.0, "R")


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_headers_stop_before_the_pixels():
    f = Counted(scans.scan_bytes({"rows": 1000, "columns": 1000, "frames": 1, "values": np.zeros(10**6, "<u2")}))
    assert scans.header_of(scans.parse(f, False))["rows"] == 1000 and f.taken <= 2 * scans.CHUNK


def test_files_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/scans"
    rows = spark.range(70).select(F.concat(F.lit("s"), F.col("id") % 5, F.lit("/"), F.col("id"), F.lit(".scan")).alias("path"), F.lit(1).alias("rows"), F.lit(2).alias("columns"), F.col("id").cast("double").alias("instance"), F.array("id", F.col("id") * 2).alias("values"))
    scans.write_scans(rows, folder)
    scans.write_scans(rows.where("id < 9"), folder)  # again, by the same names
    (tmp_path / "scans" / "s0" / ".hidden").write_bytes(b"x")
    (tmp_path / "scans" / "broken.scan").write_bytes(b"not a scan")
    back = scans.read_scans(spark, folder)
    got = {r.path: r for r in back.collect()}
    assert len(got) == 71 and not got[f"{folder}/broken.scan"].readable
    assert all(got[f"{folder}/s{k % 5}/{k}.scan"].pixels == [k, 2 * k] and got[f"{folder}/s{k % 5}/{k}.scan"].instance == k for k in range(70))
    headers = scans.read_scans(spark, folder, "path", "instance")
    assert headers.columns == ["path", "instance"] and headers.agg(F.sum("instance")).first()[0] == sum(range(70))
    assert scans.read_scans(spark, f"{folder}/none").count() == 0


def test_archives_read_as_their_files(spark, tmp_path, monkeypatch):
    """Packed files give the rows of single ones, in as few files as their number asks for; damage inside an archive stays with its file."""
    rows = spark.range(50).selectExpr("concat('s', id % 7, '/', id, '.scan') AS path", "2 AS `rows`", "3 AS `columns`", "1 AS frames", "CASE WHEN id % 5 = 1 THEN array(1, 2) ELSE transform(sequence(0, 5), j -> cast(id + j AS int)) END AS values", "'MONOCHROME2' AS photometric", "'left' AS side").repartition(3)
    one, packed = (f"file://{tmp_path}/{n}" for n in ("one", "packed"))
    scans.write_scans(rows, one)
    monkeypatch.setattr(scans, "PACKED", 10)
    scans.write_scans(rows, packed, packed=True)
    assert 3 <= len(list((tmp_path / "packed").iterdir())) <= 9 and all(p.name.endswith(".tar") and not p.name.startswith(".") for p in (tmp_path / "packed").iterdir())
    for columns in (("path", "side", "frames"), ("path", "rows", "readable", "pixels")):
        want, got = ({r.path.removeprefix(f): tuple(r)[1:] for r in scans.read_scans(spark, f, *columns).collect()} for f in (one, packed))
        assert got == want and len(want) == 50
    assert sum(r.pixels is None for r in scans.read_scans(spark, packed, "path", "pixels").collect()) == 10


def test_scan_queries_write_few_files(spark, monkeypatch):
    from tallow.plans import registry
    from tallow.sources import shared

    listed = []
    remove = shared.remove
    monkeypatch.setattr(shared, "remove", lambda s, path: (listed.append(sum(p.is_file() for p in Path(path.removeprefix("file://")).rglob("*"))), remove(s, path)))
    n = registry.QUERIES["scan_pixels"](spark, "/root/testdata/sf0.001").count()
    assert n > 500 and max(listed) < 50
