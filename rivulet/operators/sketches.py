"""Count-min sketch, Bloom filter, bounded hash table and logarithmic quantile sketch, as relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.keys import bucket

# -- count-min sketch: (row, col, cnt) -------------------------------------------------------------------------------


def _rows(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def cms_cells(counts: DataFrame, rows: int, cols: int, bits: int = 16, bits_first: int = 24) -> DataFrame:
    """Cells of a sketch of (flow_id, size): sums, held at the largest number that the cell's bits can show."""
    hit = counts.select("flow_id", "size", _rows(rows).alias("row")).withColumn("col", bucket("flow_id", cols, F.col("row")))
    cap = F.when(F.col("row") == 0, (1 << bits_first) - 1).otherwise((1 << bits) - 1)
    return hit.groupBy("row", "col").agg(F.sum("size").alias("cnt")).select("row", "col", F.least("cnt", cap.cast("long")).alias("cnt"))


def cms_estimates(flows: DataFrame, cells: DataFrame, rows: int, cols: int, bits: int = 16) -> DataFrame:
    """(flow_id, estimate): the least cell, full ones passed over but in row 0; a cell that isn't there is 0."""
    ask = flows.select("flow_id", _rows(rows).alias("row")).withColumn("col", bucket("flow_id", cols, F.col("row")))
    got = ask.join(cells, ["row", "col"], "left")
    usable = (F.col("row") == 0) | (F.coalesce("cnt", F.lit(0)) < (1 << bits) - 1)
    return got.groupBy("flow_id").agg(F.min(F.when(usable, F.coalesce("cnt", F.lit(0)))).alias("estimate"))


def cms_load(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    used = F.count(F.when(F.col("cnt") > 0, 1))
    return cells.agg((used / (rows * cols)).alias("load"), F.countDistinct(F.when(F.col("cnt") > 0, F.col("col"))).alias("used_cols"))


def cms_member(flows: DataFrame, cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """(flow_id, present): the sketch as a Bloom filter, present if no cell is 0."""
    ask = flows.select("flow_id", _rows(rows).alias("row")).withColumn("col", bucket("flow_id", cols, F.col("row")))
    return ask.join(cells, ["row", "col"], "left").groupBy("flow_id").agg(F.bool_and(F.coalesce("cnt", F.lit(0)) > 0).alias("present"))


# -- Bloom filter: (part, idx) ----------------------------------------------------------------------------------------


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, parts) for n keys at false-positive rate p."""
    m = math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2)))
    return m, round(m / n * math.log(2))


def bloom_bits(keys: DataFrame, m: int, k: int) -> DataFrame:
    """Set bits of a filter of k parts of m // k bits, one bit of each part for a key."""
    return keys.select(_rows(k).alias("part"), "flow_id").select("part", bucket("flow_id", m // k, F.concat(F.lit("b"), F.col("part"))).alias("idx")).distinct()


def bloom_probe(keys: DataFrame, bits: DataFrame, m: int, k: int) -> DataFrame:
    """(flow_id, hit): whether the bit of each part is set."""
    ask = keys.select("flow_id", _rows(k).alias("part")).withColumn("idx", bucket("flow_id", m // k, F.concat(F.lit("b"), F.col("part"))))
    got = ask.join(bits.withColumn("on", F.lit(True)), ["part", "idx"], "left")
    return got.groupBy("flow_id").agg(F.bool_and(F.coalesce("on", F.lit(False))).alias("hit"))


def bloom_false_positives(probes: DataFrame, members: DataFrame) -> DataFrame:
    outside = probes.join(members.select("flow_id").distinct(), "flow_id", "left_anti")
    return outside.agg(F.count("*").alias("probed"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("false_hits"))


# -- bounded hash table -----------------------------------------------------------------------------------------------


def admit(flows: DataFrame, tables: int, rows: int, slots: int) -> DataFrame:
    """(flow_id, seq, table_idx, bucket): flows come in order of seq; each takes a free slot of its bucket in the first
    table that has one, else none, and table_idx is null. Nothing is taken out, so a round for each table is enough:
    of a bucket, the first `slots` arrivals stay and the others go on.
    """
    left = flows.select("flow_id", "seq")
    out = None
    for t in range(tables):
        at = left.withColumn("bucket", bucket("flow_id", rows, f"t{t}"))
        at = at.withColumn("slot", F.row_number().over(Window.partitionBy("bucket").orderBy("seq")))
        got = at.where(F.col("slot") <= slots).select("flow_id", "seq", F.lit(t).alias("table_idx"), "bucket")
        out = got if out is None else out.unionByName(got)
        left = at.where(F.col("slot") > slots).select("flow_id", "seq")
    return out.unionByName(left.withColumns({"table_idx": F.lit(None).cast("int"), "bucket": F.lit(None).cast("long")}))


def table_load(admitted: DataFrame, tables: int, rows: int, slots: int) -> DataFrame:
    return admitted.agg((F.count("table_idx") / (tables * rows * slots)).alias("load"), F.sum(F.col("table_idx").isNull().cast("long")).alias("discarded"))


def delete_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys, "flow_id", "left_anti")


def new_epoch(entries: DataFrame, packets: DataFrame, arrivals: DataFrame, tables: int, rows: int, slots: int) -> DataFrame:
    """Tables (flow_id, table_idx, bucket, slot, size), slots from 1 in order, after an epoch of packets (flow_id, seq)
    and of flows that are let in (flow_id, seq). Adds live.

    All entries lose their live bit as the epoch starts. A flow's next packet sets it, and its count starts anew. Who
    comes to a full bucket takes the place of its first entry, if that isn't live, and stands last. So beyond the free
    slots the r-th arrival takes the r-th old entry, as long as that one hasn't been met and all before did so: a running
    minimum decides, and nothing is replayed. Others go on to the next table.
    """
    met = packets.groupBy("flow_id").agg(F.min("seq").alias("first"), F.count("*").alias("hits"))
    # Of a newcomer only packets from its arrival on count.
    came = arrivals.select("flow_id", F.col("seq").alias("__at")).join(packets, "flow_id").where("seq >= __at").groupBy("flow_id").agg(F.count("*").alias("size"))
    e = entries.join(met, "flow_id", "left")
    w = Window.partitionBy("bucket").orderBy("seq")
    left, out = arrivals.select("flow_id", "seq"), None
    for t in range(tables):
        here = e.where(F.col("table_idx") == t)
        used = here.groupBy("bucket").agg(F.count("*").alias("used"))
        at = left.withColumn("bucket", bucket("flow_id", rows, f"t{t}")).withColumn("nth", F.row_number().over(w))
        at = at.join(used, "bucket", "left").fillna(0, ["used"]).withColumn("place", F.col("nth") - (slots - F.col("used")))
        old = here.select("bucket", F.col("slot").alias("place"), F.coalesce("first", F.lit(1 << 62)).alias("met"))
        free = ((F.col("place") <= 0) | F.coalesce(F.col("met") > F.col("seq"), F.lit(False))).cast("int")
        pair = at.join(old, ["bucket", "place"], "left").withColumn("takes", F.min(free).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
        new = pair.where("takes")
        stay = here.join(new.select("bucket", F.col("place").alias("slot")), ["bucket", "slot"], "left_anti")
        stay = stay.select("flow_id", "table_idx", "bucket", "slot", F.coalesce("hits", "size").alias("size"), F.col("hits").isNotNull().alias("live"))
        put = new.join(came, "flow_id", "left").select("flow_id", F.lit(t).alias("table_idx"), "bucket", (F.col("used") + F.col("nth")).cast("int").alias("slot"), F.coalesce("size", F.lit(1)).alias("size"), F.lit(True).alias("live"))
        out = stay.unionByName(put) if out is None else out.unionByName(stay).unionByName(put)
        left = pair.where(~F.col("takes")).select("flow_id", "seq")
    return out


def dump_live(entries: DataFrame) -> DataFrame:
    """(flow_id, size) of entries with the live bit."""
    return entries.where("live").select("flow_id", "size")


# -- logarithmic quantile sketch ---------------------------------------------------------------------------------------


class LogBins:
    """Bins of a value range by powers of gamma, `n` of them; gamma is moved until the bounds are n - 1 bins apart."""

    def __init__(self, most: float, least: float, n: int) -> None:
        gamma, step, up = (most / least) ** (1 / (n - 1)), 0.01, None
        for _ in range(100):
            low, high = self._key(least, gamma), self._key(most, gamma)
            have = high - low + 1
            if have == n:
                break
            more = have > n
            if up is not None and more != up:
                step /= 2
            gamma, up = gamma * (1 + step if more else 1 - step), more
        else:
            raise ValueError(f"no gamma found that gives {n} bins from {least} to {most}")
        self.gamma, self.low, self.high, self.least = gamma, self._key(least, gamma), self._key(most, gamma), least

    @staticmethod
    def _key(x: float, gamma: float) -> int:
        return math.ceil(math.log2(x) / math.log2(gamma))

    def bin(self, x: Column) -> Column:
        return F.greatest(F.least(F.ceil(F.log2(x) / math.log2(self.gamma)), F.lit(self.high)), F.lit(self.low)).cast("int")

    def value(self, key: Column) -> Column:
        return 2 * F.pow(F.lit(self.gamma), key) / (self.gamma + 1)

    def edges(self) -> list[float]:
        return [self.gamma**k for k in range(self.low, self.high + 1)]


ZERO = -1_000_000  # the bin of values below the range


class MarginBins:
    """Bins of a central range, with bins of their own for the margins of a wider range. A margin without bins or
    without width has none, and its values go to the outermost bin of the centre. Bounds of the centre are margin values.
    """

    def __init__(self, most: float, least: float, n: int, widest: float, narrowest: float, left: int = 0, right: int = 0) -> None:
        self.most, self.least, self.widest, self.narrowest = most, least, widest, narrowest
        self.center = LogBins(most, least, n)
        self.left = LogBins(least, narrowest, left) if left > 0 and least > narrowest else None
        self.right = LogBins(widest, most, right) if right > 0 and widest > most else None

    def part(self, x: Column) -> Column:
        """zero, left, right or center."""
        part = F.when(x < self.narrowest, "zero")
        if self.left:
            part = part.when(x <= self.least, "left")
        if self.right:
            part = part.when((x >= self.most) & (x <= self.widest), "right")
        return part.otherwise("center")

    def bin(self, x: Column) -> Column:
        out = F.when(x < self.narrowest, ZERO)
        if self.left:
            out = out.when(x <= self.least, self.left.bin(x))
        if self.right:
            out = out.when((x >= self.most) & (x <= self.widest), self.right.bin(x))
        return out.otherwise(self.center.bin(x)).cast("int")


def freeze_seq(values: DataFrame, bins: LogBins, bits: int) -> DataFrame:
    """Adds bin, and froze: the seq at which the flow's sketch froze, one bin being full; later values don't count."""
    v = values.withColumn("bin", F.when(F.col("x") < bins.least, ZERO).otherwise(bins.bin(F.col("x"))))
    nth = F.row_number().over(Window.partitionBy("flow_id", "bin").orderBy("seq"))
    full = F.when((F.col("bin") != ZERO) & (F.col("nth") == (1 << bits) - 1), F.col("seq"))
    return v.withColumn("nth", nth).withColumn("froze", F.min(full).over(Window.partitionBy("flow_id")))


def quantile_bins(values: DataFrame, bins: LogBins, bits: int = 16) -> DataFrame:
    """(flow_id, bin, cnt) of values (flow_id, seq, x)."""
    return freeze_seq(values, bins, bits).where(F.col("froze").isNull() | (F.col("seq") <= F.col("froze"))).groupBy("flow_id", "bin").agg(F.count("*").alias("cnt"))


def quantiles(cells: DataFrame, bins: LogBins, qs: list[float]) -> DataFrame:
    """(flow_id, q, value): the first bin at which more than q * (n - 1) values are met; 0 in the bin of zeros."""
    run = F.sum("cnt").over(Window.partitionBy("flow_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("cnt").over(Window.partitionBy("flow_id"))
    c = cells.withColumn("run", run).withColumn("n", n).select("*", F.explode(F.array(*(F.lit(q) for q in qs))).alias("q"))
    first = c.where(F.col("run") > F.col("q") * (F.col("n") - 1)).groupBy("flow_id", "q").agg(F.min("bin").alias("bin"))
    return first.select("flow_id", "q", F.when(F.col("bin") == ZERO, 0.0).otherwise(bins.value(F.col("bin"))).alias("value"))


def sparsity(cells: DataFrame, n_bins: int) -> DataFrame:
    """(flow_id, used, share, bins): non-zero bins of the range."""
    inside = F.when(F.col("bin") != ZERO, F.col("bin"))
    return cells.groupBy("flow_id").agg(F.count(inside).alias("used"), (F.count(inside) / n_bins).alias("share"), F.array_sort(F.collect_list(inside)).alias("bins"))
