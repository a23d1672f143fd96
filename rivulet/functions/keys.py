"""Flow keys: 5-tuples as columns, as text and packed; addresses and ports as bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
#: Columns of coarser keys: source, address pair, addresses and ports, all.
GRANULARITY = {1: KEY[:1], 2: KEY[:2], 4: KEY[:4], 5: KEY}
TCP, UDP, ICMP = 6, 17, 1


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ip_text(ip: str | Column) -> Column:
    """Dotted quad of an address held as a number."""
    return F.concat_ws(".", *(F.shiftright(_c(ip), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def ip_number(text: str | Column) -> Column:
    """The number of a dotted quad, first octet highest."""
    part = F.split(_c(text), r"\.")
    return sum((part[k].cast("long") * (1 << s) for k, s in enumerate((24, 16, 8, 0))), F.lit(0).cast("long"))


def flow_id(granularity: int = 5) -> Column:
    """Key as text, parts joined by commas."""
    return F.concat_ws(",", *(ip_text(c) if c.endswith("_ip") else F.col(c).cast("string") for c in GRANULARITY[granularity]))


def packed_high() -> Column:
    """The 64 high bits of the 104-bit key: both addresses. As a signed long."""
    return F.shiftleft(_c("src_ip"), 32).bitwiseOR(_c("dst_ip"))


def packed_low() -> Column:
    """The 40 low bits: ports and protocol."""
    return F.shiftleft(_c("src_port").cast("long"), 24).bitwiseOR(F.shiftleft(_c("dst_port").cast("long"), 8)).bitwiseOR(_c("protocol").cast("long"))


def unpacked(high: str | Column, low: str | Column) -> list[Column]:
    """The five columns of a packed key."""
    h, x = _c(high), _c(low)
    return [
        F.shiftrightunsigned(h, 32).alias("src_ip"),
        h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("dst_ip"),
        F.shiftright(x, 24).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("src_port"),
        F.shiftright(x, 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("dst_port"),
        x.bitwiseAND(F.lit(0xFF)).cast("int").alias("protocol"),
    ]


def bits(x: str, n: int) -> list[Column]:
    """Columns x_0 .. x_{n-1}: the bits of x, highest first."""
    return [F.shiftright(F.col(x), n - 1 - k).bitwiseAND(F.lit(1)).cast("int").alias(f"{x}_{k}") for k in range(n)]


def bit_text(x: str | Column, n: int) -> Column:
    """The bits of x as n characters."""
    return F.lpad(F.bin(_c(x).cast("long")), n, "0")


def one_hot_protocol() -> list[Column]:
    return [(F.col("protocol") == p).cast("int").alias(f"protocol_{name}") for name, p in (("icmp", ICMP), ("udp", UDP), ("tcp", TCP))]


def model_input(features: list[Column], key_only: bool = False) -> Column:
    """Vector of a classifier: 96 bits of addresses and ports, then one-hot tcp, udp, icmp and features, or a 1 alone."""
    wide = [b.cast("double") for c, n in (("src_ip", 32), ("dst_ip", 32), ("src_port", 16), ("dst_port", 16)) for b in bits(c, n)]
    hot = [(F.col("protocol") == p).cast("double") for p in (TCP, UDP, ICMP)]
    return F.array(*wide, *([F.lit(1.0)] if key_only else [*hot, *features]))


def flag_set(flags: str | Column, bit: int) -> Column:
    """Whether a TCP flag counts as set: values of 64 and above count as all six."""
    f = _c(flags)
    return F.when((f >= 64) | (f.bitwiseAND(F.lit(bit)) != 0), 1).otherwise(0)


FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32


def bucket(text: str | Column, n: int, salt: str | int = "") -> Column:
    """0..n-1 by the first 32 bits of MD5 of `salt#text`: the same in any engine."""
    t = F.concat(F.lit(f"{salt}#"), _c(text)) if not isinstance(salt, Column) else F.concat(salt.cast("string"), F.lit("#"), _c(text))
    return (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % n).cast("long")


def uniform(text: str | Column, salt: str = "") -> Column:
    """A number in [0, 1) by the first 32 bits of SHA-256 of `salt` and text."""
    t = F.concat(F.lit(salt), _c(text)) if salt else _c(text)
    return F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
