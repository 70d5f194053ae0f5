"""Raw log: metadata contract, damaged tails, indexed ranges; archives: row order across blocks."""

import io

import pytest
from pyspark.sql import functions as F

from strandline.sources import archives, rawlog

META = {"schema_version": 1, "source_id": "s", "recv_wall_ns": 10, "recv_mono_ns": 20, "host_id": "h", "boot_id": "b", "connection_id": "c", "ingest_seq": 0, "channel_hint": None, "capture_flags": ["A", "B"]}


def record(seq=0, payload=b"payload", **meta):
    return rawlog.encode(META | {"ingest_seq": seq} | meta, payload)


def states(data):
    return [x[3] for x in rawlog.records(io.BytesIO(data))]


@pytest.mark.parametrize(
    "change",
    [
        {"schema_version": 2}, {"schema_version": True}, {"source_id": " "}, {"host_id": None}, {"boot_id": 5}, {"recv_wall_ns": -1}, {"recv_mono_ns": 1.0}, {"ingest_seq": True}, {"ingest_seq": 1 << 63},
        {"channel_hint": ""}, {"channel_hint": 3}, {"capture_flags": ["B", "A"]}, {"capture_flags": ["A", "A"]}, {"capture_flags": [""]}, {"capture_flags": "A"}, {"capture_flags": None}, {"extra": 1},
    ],
)
def test_metadata_contract(change):
    assert states(record(1) + record(**change) + record(2)) == ["CLEAN", "CORRUPT"]


@pytest.mark.parametrize("field", sorted(META))
def test_missing_fields_and_other_json(field):
    assert states(rawlog.encode({k: v for k, v in META.items() if k != field}, b"x")) == ["CORRUPT"]
    assert states(rawlog.encode([1], b"x")) == ["CORRUPT"] and states(record(channel_hint="book", capture_flags=[])) == ["CLEAN"] and states(b"") == []


@pytest.mark.parametrize(("region", "cut"), [("magic", 2), ("lengths", rawlog.HEAD.size - 1), ("metadata", rawlog.HEAD.size + 9), ("payload", -36), ("checksum", -16), ("whole", 0)])
def test_torn_tails_are_cut_and_nothing_else(tmp_path, region, cut):
    first, second = record(1, b"first"), record(2, b"second-payload")
    path = tmp_path / "x.rawlog"
    path.write_bytes(first + (second[:cut] if cut else second))
    if region == "whole":
        assert rawlog.recover(str(path)) == "CLEAN" == rawlog.scan(str(path))[0] and rawlog.scan(str(path))[1] == 2
        return
    assert rawlog.scan(str(path)) == ("INCOMPLETE", 1, len(first))
    assert rawlog.recover(str(path)) == "INCOMPLETE" and path.read_bytes() == first and rawlog.scan(str(path)) == ("CLEAN", 1, len(first))


@pytest.mark.parametrize("damage", ["middle", "garbage"])
def test_corruption_is_never_cut(tmp_path, damage):
    a, b, c = (record(k) for k in range(3))
    data = a + (b[:-1] + bytes([b[-1] ^ 1]) + c if damage == "middle" else b"GARBAGE-GARBAGE!")
    path = tmp_path / "x.rawlog"
    path.write_bytes(data)
    assert rawlog.scan(str(path)) == ("CORRUPT", 1, len(a)) and rawlog.recover(str(path)) == "CORRUPT" and path.read_bytes() == data
    with pytest.raises(ValueError, match="CORRUPT"):
        rawlog.index_segment(str(path))


def test_one_record_is_held_at_a_time():
    class Endless(io.RawIOBase):
        """Ten thousand records, of which none is there before it is read."""

        def __init__(self):
            self.seq, self.left, self.most = 0, b"", 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            while len(self.left) < n and self.seq < 10_000:
                self.left += record(self.seq)
                self.seq += 1
            out, self.left = self.left[:n], self.left[n:]
            return out

    stream = Endless()
    assert sum(x[3] == "CLEAN" for x in rawlog.records(stream)) == 10_000 and stream.most < 1_000


def test_indexed_segments_are_read_in_ranges(spark, tmp_path):
    spark.dataSource.register(rawlog.RawLog)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rawlog").write_bytes(b"".join(record(k, b"p" * (k % 50)) for k in range(400)))
    frames = rawlog.raw_frames(spark, str(tmp_path / "in"))
    assert frames.rdd.getNumPartitions() == 1
    folder = tmp_path / "log"
    frames.coalesce(1).write.format("rawlog").option("stride", "5000").mode("append").save(str(folder))
    back = rawlog.raw_frames(spark, str(folder))
    same = ["ingest_seq", "frame_offset", "raw_sha256"]
    assert back.rdd.getNumPartitions() > 10 and sorted(back.select(*same).collect()) == sorted(frames.select(*same).collect())
    (segment,) = folder.glob("*.rawlog")
    index = folder / f"{segment.name}.index"
    whole = index.read_bytes()
    # Ranges after a bad record are read, but do not count.
    offsets = rawlog.read_index(whole, segment.stat().st_size)
    data = bytearray(segment.read_bytes())
    data[offsets[3] + 30] ^= 1
    segment.write_bytes(bytes(data))
    audited = rawlog.audit(rawlog.raw_frames(spark, str(folder), audit=True)).first()
    before = frames.where(F.col("frame_offset") < offsets[3]).count()
    assert (audited.tail_state, audited.first_bad_offset, audited.valid_frames, audited.last_seq) == ("CORRUPT", offsets[3], before, before - 1)
    data[offsets[3] + 30] ^= 1
    segment.write_bytes(bytes(data))
    for torn in (whole[:-1], whole[:20], b"", whole[:12] + b"\1" + whole[13:]):
        index.write_bytes(torn)
        assert rawlog.raw_frames(spark, str(folder)).rdd.getNumPartitions() == 1 and rawlog.raw_frames(spark, str(folder)).count() == 400
    assert rawlog.index_segment(str(segment), 5000) == offsets and index.read_bytes() == whole
    # A segment that was cut after the seal: its index is for another size.
    segment.write_bytes(bytes(data[:-3]))
    assert rawlog.recover(str(segment)) == "INCOMPLETE" and rawlog.raw_frames(spark, str(folder)).count() == 399


def test_writer_refuses_what_no_reader_takes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rawlog").write_bytes(record(1))
    bad = rawlog.raw_frames(spark, str(tmp_path / "in")).withColumn("ingest_seq", F.lit(-1).cast("long"))
    with pytest.raises(Exception, match="metadata contract"):
        bad.write.format("rawlog").mode("append").save(str(tmp_path / "log"))
    assert rawlog.sealed(str(tmp_path / "log")) == []


@pytest.mark.parametrize("at", [1, 1_000_000, 1_000_001])
def test_reversals_at_the_edge_of_a_block(spark, at):
    k = F.col("id")
    rows = spark.range(1_000_003).select(k.alias("source_row_number"), F.lit("S").alias("symbol"), (F.lit(1_704_067_200_000_000) + k - F.when(k >= at, 5).otherwise(0)).alias("local_timestamp_us"))
    s = archives.archive_stats(rows, "2024-01-01").first()
    assert (s.n, s.reversals) == (1_000_003, 1)


def test_a_plain_file_has_no_row_numbers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("exchange,symbol,timestamp,local_timestamp,id,side,price,amount\nv,S,1,2,a,buy,100.5,2\n")
    with pytest.raises(Exception, match="not gzipped"):
        archives.read_archive(spark, str(tmp_path / "t.csv"), "trades").collect()
