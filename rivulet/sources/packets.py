"""Packet sources: the events table as packets, capture files, and 13-byte key records."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rivulet.functions.keys import KEY

PACKET = "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, size int, flags int, has_fin_rst boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    """Events as packets: a user and kind of event make a flow, the event's number the order."""
    kind = F.col("event_type")
    protocol = F.when(kind == "error", 1).when(kind == "signup", 17).otherwise(6)
    port = F.when(kind == "view", 80).when(kind == "click", 443).when(kind == "purchase", 8443).when(kind == "signup", 53).otherwise(0)
    flags = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.col("user_id") + 167772160).alias("src_ip"),
        (F.col("user_id") % 16 + 3232235520).alias("dst_ip"),
        F.when(kind == "error", 0).otherwise(F.col("user_id") % 60000 + 1024).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        (F.floor("value").cast("int") + 40).alias("size"),
        flags.alias("flags"),
        ((protocol == 6) & (flags.bitwiseAND(F.lit(5)) != 0)).alias("has_fin_rst"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


# Fixed values of the capture file format and of the headers in it.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_PCAPNG = b"\x0a\x0d\x0d\x0a"
ETHERNET, RAW_IP, VLAN, IPV4 = 1, (12, 14, 101, 228), 0x8100, 0x0800


def decode_capture(data: bytes, tcp_only: bool = False, keep_icmp: bool = False, seq_from: int = 0) -> Iterator[tuple]:
    """Rows of PACKET. Frames that are not IPv4 with TCP or UDP (or ICMP, if kept) are passed over, as are UDP
    datagrams with under eight bytes; 802.1Q tags are taken off. Files of the newer block format hold no packets here.
    """
    if data[:4] == _PCAPNG or len(data) < 24:
        return
    if data[:4] not in _MAGIC:
        raise ValueError("not a capture file")
    order, per_us = _MAGIC[data[:4]]
    (link,) = struct.unpack_from(order + "I", data, 20)
    at, seq = 24, seq_from
    while at + 16 <= len(data):
        sec, frac, held, _ = struct.unpack_from(order + "IIII", data, at)
        frame, at = data[at + 16 : at + 16 + held], at + 16 + held
        if link == ETHERNET:
            kind, body = struct.unpack_from(">H", frame, 12)[0] if len(frame) >= 14 else 0, 14
            while kind == VLAN and len(frame) >= body + 4:
                (kind,) = struct.unpack_from(">H", frame, body + 2)
                body += 4
            if kind != IPV4:
                continue
            ip = frame[body:]
        elif link in RAW_IP:
            ip = frame
        else:
            continue
        if len(ip) < 20 or ip[0] >> 4 != 4:
            continue
        head = (ip[0] & 15) * 4
        total, protocol = struct.unpack_from(">H", ip, 2)[0], ip[9]
        src, dst = struct.unpack_from(">II", ip, 12)
        sport = dport = 0
        flags = None
        if protocol == 6 and len(ip) >= head + 14:
            sport, dport = struct.unpack_from(">HH", ip, head)
            flags = ip[head + 13]
        elif protocol == 17 and not tcp_only and len(ip) >= head + 8:
            sport, dport = struct.unpack_from(">HH", ip, head)
        elif not (protocol == 1 and keep_icmp and not tcp_only and len(ip) > head):
            continue
        yield seq, sec * 1_000_000 + frac // per_us, src, dst, sport, dport, protocol, total, flags, bool(flags and flags & 5)
        seq += 1


class CaptureSource(DataSource):
    """`spark.read.format("capture").option("path", ...)`: a partition for each file. Options: protocols (tcp, tcp_udp, all)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET + ", file string"

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.protocols = options["path"], options.get("protocols", "tcp_udp")

    def partitions(self) -> list[InputPartition]:
        """A partition for each file below the path, in order of their names; the path may have * and ? in its last part."""
        from fnmatch import fnmatch

        from pyarrow import fs

        store, path = _store(self.path)
        top, _, last = path.rpartition("/")
        if any(c in last for c in "*?["):
            found = [f.path for f in store.get_file_info(fs.FileSelector(top or ".")) if f.type == fs.FileType.File and fnmatch(f.base_name, last)]
        elif store.get_file_info(path).type == fs.FileType.Directory:
            found = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File]
        else:
            found = [path]
        return [InputPartition((k, f)) for k, f in enumerate(sorted(found))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, file = partition.value
        with _store(self.path)[0].open_input_file(file) as f:
            data = f.read()
        for row in decode_capture(data, self.protocols == "tcp", self.protocols == "all"):
            yield (at << FILE_BITS | row[0], *row[1:], file)


#: A packet's seq is its file's place in the order of names, then its place in the file, of so many bits.
FILE_BITS = 40


def _store(path: str):
    """File system and path in it, in any store that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def captures(spark: SparkSession, path: str, tcp_only: bool = False, keep_icmp: bool = False) -> DataFrame:
    """Packets of capture files in any store that Spark reads: a file is a row of `binaryFile`, decoded in place.

    Files follow each other by name, so flows that go on in the next file keep their order.
    """
    files = spark.read.format("binaryFile").load(path)
    place = {f: k for k, f in enumerate(sorted(r["path"] for r in files.select("path").collect()))}  # names alone

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKET.split(", ")]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(decode_capture(content, tcp_only, keep_icmp), columns=names)
                out["flags"] = out["flags"].astype("Int32")
                out["seq"] = out["seq"].astype("int64") + (place[file] << FILE_BITS)
                yield out.assign(file=file)

    return files.select("path", "content").mapInPandas(run, PACKET + ", file string")


#: Bytes of a key record: addresses, ports and protocol, high byte first.
RECORD = struct.Struct(">IIHHB")


def key_records(packets: DataFrame) -> DataFrame:
    """(seq, record): each packet's key as 13 bytes."""
    part = lambda c, n: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2 * n, "0"))
    return packets.select("seq", F.concat(part("src_ip", 4), part("dst_ip", 4), part("src_port", 2), part("dst_port", 2), part("protocol", 1)).alias("record"))


def read_key_records(data: bytes) -> list[tuple]:
    return [RECORD.unpack_from(data, k) for k in range(0, len(data) - RECORD.size + 1, RECORD.size)]


def write_minutes(packets: DataFrame, path: str) -> None:
    """Packets as Parquet, a folder for each minute."""
    packets.withColumn("minute", F.floor(F.col("ts_us") / 60_000_000)).repartition("minute").write.partitionBy("minute").parquet(path)


def union_captures(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["KEY", "PACKET", "CaptureSource", "captures", "decode_capture", "key_records", "packets", "packets_from_events", "read_key_records", "table", "union_captures", "write_minutes"]
