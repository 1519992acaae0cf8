"""Capture files that are read in stretches: every frame once, whatever the frames hold."""

import random
import struct

import pytest

from netloom.sources import pcap


def capture(order, frames):
    head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "IIII", 1_700_000_000 + i // 1000, i % 1000, len(f), len(f) + i % 3) + f for i, f in enumerate(frames))


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_long_file_is_many_tasks(spark, tmp_path, order):
    rnd = random.Random(3)
    frames = [struct.pack(">I", i) + rnd.randbytes(rnd.randrange(0, 60)) for i in range(100_000)]
    (tmp_path / "a.pcap").write_bytes(capture(order, frames))
    found = pcap.read(spark, f"file://{tmp_path}/a.pcap", split=300_000)
    assert pcap.spans(spark, f"file://{tmp_path}/a.pcap", 300_000).where("frames > 0").count() > 10
    rows = sorted((r.record, r.timestamp, r.length, bytes(r.bytes)) for r in found.collect())
    assert rows == [(i + 1, 1_700_000_000 + i // 1000 + i % 1000 / 1e6, len(f) + i % 3, f) for i, f in enumerate(frames)]


@pytest.mark.parametrize("split", [400, 1 << 20])
def test_frames_that_hold_records(spark, tmp_path, split):
    """Captures within frames look like records; frames longer than a stretch, empty ones, and a record that is cut off."""
    rnd = random.Random(5)
    inner = capture("<", [rnd.randbytes(20) for _ in range(30)])
    frames = [rnd.choice([inner, inner[24:], b"", bytes(40), rnd.randbytes(3000)]) for _ in range(40)]
    whole = capture("<", frames)
    (tmp_path / "a.pcap").write_bytes(whole)
    (tmp_path / "b.pcap").write_bytes(whole + struct.pack("<IIII", 1, 1, 100, 100) + b"short")
    (tmp_path / "c.pcap").write_bytes(whole[:24])
    rows = pcap.read(spark, f"file://{tmp_path}/*.pcap", split=split).collect()
    for name in "ab":
        assert [bytes(r.bytes) for r in sorted((r for r in rows if r.path.endswith(f"{name}.pcap")), key=lambda r: r.record)] == frames
    assert len(rows) == 80


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but of some length")
    with pytest.raises(Exception, match="not a capture file"):
        pcap.read(spark, f"file://{tmp_path}/x.pcap").collect()
