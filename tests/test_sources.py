import struct

from rivulet.functions import keys
from rivulet.sources import packets as P
from rivulet.sources import relations


def ipv4(protocol, body, src=0x0A000001, dst=0xC0A80001):
    return struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0, src, dst) + body


def tcp(sport, dport, flags):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def capture(frames, link=1, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + k, 7, len(f), len(f)) + f
    return out


ETH = b"\0" * 12 + b"\x08\x00"
VLAN = b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00"


def test_decode_kinds():
    udp = struct.pack(">HHHH", 5, 53, 8, 0)
    frames = [ETH + ipv4(6, tcp(1, 80, 2)), VLAN + ipv4(6, tcp(2, 80, 1)), ETH + ipv4(17, udp), ETH + ipv4(17, b"\0\0"), ETH + ipv4(1, b"\x08\0"), b"\0" * 12 + b"\x86\xdd" + b"\0" * 40, ETH + b"\x45"]
    for order in "<>":
        got = list(P.decode_capture(capture(frames, order=order)))
        assert [(r[4], r[6], r[8], r[9]) for r in got] == [(1, 6, 2, False), (2, 6, 1, True), (5, 17, None, False)]
        assert [r[0] for r in got] == [0, 1, 2]
        assert got[0][1] == 100_000_007
    assert [r[6] for r in P.decode_capture(capture(frames), tcp_only=True)] == [6, 6]
    assert [r[6] for r in P.decode_capture(capture(frames), keep_icmp=True)] == [6, 6, 17, 1]
    raw = [f[len(ETH) :] for f in frames[:1]]
    assert len(list(P.decode_capture(capture(raw, link=101)))) == 1
    assert len(list(P.decode_capture(capture(raw, link=999)))) == 0
    assert list(P.decode_capture(b"\x0a\x0d\x0d\x0a" + b"\0" * 100)) == []
    assert list(P.decode_capture(capture(frames)[:-3]))[-1][6] == 17


def test_capture_readers_agree(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([ETH + ipv4(6, tcp(1, 80, 2)), ETH + ipv4(17, struct.pack(">HHHH", 5, 53, 8, 0))]))
    (tmp_path / "b.pcap").write_bytes(capture([ETH + ipv4(6, tcp(3, 80, 16))]))
    rows = P.captures(spark, str(tmp_path)).drop("file").collect()
    assert sorted(r["src_port"] for r in rows) == [1, 3, 5]
    spark.dataSource.register(P.CaptureSource)
    again = spark.read.format("capture").option("path", str(tmp_path)).load().drop("file").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert P.union_captures(P.captures(spark, str(tmp_path)), P.captures(spark, str(tmp_path))).count() == 6


def test_flows_go_on_over_capture_files(spark, tmp_path):
    from rivulet.operators import flow_manager, flows

    frames = [ETH + ipv4(6, tcp(1, 80, f)) for f in (2, 16, 16, 16)]
    (tmp_path / "a.pcap").write_bytes(capture(frames[:3]))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:2]))
    p = P.captures(spark, str(tmp_path)).drop("file")
    rn = sorted((r["seq"], r["rn"]) for r in flows.ordered(p).collect())
    assert [n for _, n in rn] == [1, 2, 3, 4, 5] and len({s for s, _ in rn}) == 5 and rn[3][0] == 1 << P.FILE_BITS
    assert flow_manager.infinite(p, 5).first()["outcome"] == "collected"


def test_key_records_round_trip(spark):
    row = (0, 0, 0x0A0000FF, 0xFFFFFFFF, 65535, 53, 17, 40, None, False)
    df = spark.createDataFrame([row], P.PACKET)
    record = bytes(P.key_records(df).first()["record"])
    assert P.read_key_records(record) == [(0x0A0000FF, 0xFFFFFFFF, 65535, 53, 17)]
    back = df.select(keys.packed_high().alias("h"), keys.packed_low().alias("x")).select(*keys.unpacked("h", "x")).first()
    assert tuple(back) == (0x0A0000FF, 0xFFFFFFFF, 65535, 53, 17)


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1.2.3.4,5.6.7.8,1,2,6,-1,-1,0,0,1,,7,,40,\n")
    got = relations.concat_csv(spark, [str(tmp_path / "x.csv")], relations.oracle_schema(2)).first()
    assert got["iat_1"] is None and got["flags_1"] == 7 and got["pk_size_2"] is None
    (tmp_path / "t.csv").write_text("ip_src,ip_dst,port_src,port_dst,proto,size,heavy_hitter\n1.2.3.4,5.6.7.8,1,2,6,9,1\n")
    assert tuple(relations.read_truth(spark, str(tmp_path / "t.csv")).first()) == ("1.2.3.4,5.6.7.8,1,2,6", 9, 1)
    (tmp_path / "c.csv").write_text("1.2.3.4,5.6.7.8,1,2,6,0.5\n")
    assert relations.read_cache(spark, str(tmp_path / "c.csv")).first()["proba"] == 0.5
    df = spark.createDataFrame([("a", 1)], "flow_id string, size long")
    relations.write_relations({"gt": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/gt")).count() == 1
    cdf = spark.createDataFrame([(1, 2, 0.5)], "size long, n_flows long, cdf double")
    relations.write_cdf(cdf, str(tmp_path / "cdf"))
    assert spark.read.text(str(tmp_path / "cdf")).where("value = '1 1 0.5'").count() == 1
    files = spark.createDataFrame([("/x/trace-17.pcap",)], "file string")
    assert files.select(relations.minute_of().alias("m")).first()["m"] == 17


def test_minute_folders(spark, tmp_path):
    rows = [(k, k * 30_000_000, 1, 2, 3, 4, 6, 40, 0, False) for k in range(4)]
    P.write_minutes(spark.createDataFrame(rows, P.PACKET), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("minute = 1").count() == 2
