"""URL filters: explicit host/path rules first, then association rules over URL tokens.

FP-growth mines token combinations from labelled URLs. Tokens that come with just the same URLs count as one item, so
what always comes together doesn't multiply. Confidence is balanced: the label and all others weigh the same, however
rare the label is, and a rule without tokens would have 0.5. Of the rules `tokens => label` those are kept that reach
the stated support and confidence, whose share of the label is above its base rate by more than chance, and of which no
more general rule with the same label is at least as confident. They match through an inverted index: each rule is filed
under its rarest token, so a URL meets only rules that share a token with it, and then needs all of the rule's tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, table

#: (verdict, rule) as stated for `pages`; a rule is a host, then the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are sent to every executor; beyond it Spark joins them as a table.
BROADCAST_RULES = 20_000


def host(url: Column) -> Column:
    """What is after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct lower-case tokens: maximal runs of letters and digits, numbers as `#`; those of the host with `@`."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    cut_ = lambda x: F.array_remove(F.split(x, r"[^\p{L}\p{N}]+"), "")
    shown = lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(x)
    in_host = F.transform(cut_(host(url)), lambda x: F.concat(F.lit("@"), shown(x)))
    after = F.transform(cut_(F.regexp_replace(low, r"^.*?://[^/?#]*", "")), shown)
    return F.array_distinct(F.concat(in_host, after))


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.004
    #: Of the label against all others, each weighed to the same total.
    min_confidence: float = 0.6
    #: Standard errors by which the share of a label must be above its base rate (Wilson's lower bound).
    z: float = 3.0


RULES_SCHEMA = "rule_id string, tokens array<array<string>>, anchor array<string>, label string, confidence double, balanced double, support double"


def mine(labelled: DataFrame, settings: Mining = Mining()) -> DataFrame:
    """RULES_SCHEMA from rows of (url, label); other columns are of no effect.

    tokens: a list for each item of the rule, of which a URL needs one token each; anchor: the rarest of these.
    confidence: share of the label among URLs that match. Rows with null url or label teach nothing; repeated rows
    count as often as they come; without rows, or with one label alone, there are no rules.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("t"), F.col("label").cast("string").alias("label")), "labelled")
    per_label = cut(rows.groupBy("label").agg(F.count("*").alias("in_label")), "labels")
    total = per_label.agg(F.sum("in_label")).first()[0] or 0
    if per_label.limit(2).count() < 2:
        return spark.createDataFrame([], RULES_SCHEMA)
    single = rows.select("row", F.explode("t").alias("token"))
    alike = single.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("g")).where(F.col("n") >= settings.min_support * total)
    items = cut(alike.groupBy("n", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("item"), "members", "n"), "items")
    has = single.join(items.select("item", F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("item").alias("items"))
    bags = rows.select("row", "label").join(has, "row").select(F.array_append("items", F.concat(F.lit("="), F.col("label"))).alias("items"))
    # Rows whose tokens are all rare are in no bag, so the support is given by the number of all rows.
    bags = cut(bags, "bags")
    support = min(1.0, settings.min_support * total / max(1, bags.count()))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(bags).freqItemsets
    labels = F.filter("items", lambda x: x.startswith("="))
    parted = cut(found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("items"), F.substring(F.get(labels, 0), 2, 1 << 30).alias("label"), "freq", F.size(labels).alias("k")).where("size(items) > 0"), "itemsets")
    of = parted.where("k = 0").select("items", F.col("freq").alias("of"))
    rules = parted.where("k = 1").join(of, "items").join(per_label, "label")
    confidence, base = F.col("freq") / F.col("of"), F.col("in_label") / total
    here, other = F.col("freq") / F.col("in_label"), (F.col("of") - F.col("freq")) / (total - F.col("in_label"))
    z2 = settings.z**2
    lower = (confidence + z2 / (2 * F.col("of")) - settings.z * F.sqrt(confidence * (1 - confidence) / F.col("of") + z2 / (4 * F.col("of") * F.col("of")))) / (1 + z2 / F.col("of"))
    rules = cut(rules.select("items", "label", confidence.alias("confidence"), (here / (here + other)).alias("balanced"), (F.col("freq") / total).alias("support"), lower.alias("lower"), base.alias("base")), "all-rules")
    kept = rules.where((F.col("balanced") >= settings.min_confidence) & (F.col("lower") > F.col("base"))).join(_needless(rules), ["items", "label"], "left_anti")
    full = kept.select("*", F.explode("items").alias("item")).join(items, "item").groupBy("items", "label").agg(F.collect_list(F.struct("n", "item", "members")).alias("m"), *(F.first(c).alias(c) for c in ("confidence", "balanced", "support")))
    full = full.withColumn("m", F.array_sort("m"))
    sets = F.transform(F.array_sort(F.transform("m", lambda x: F.struct(x["item"], x["members"]))), lambda x: x["members"])
    return full.select(F.array_join(F.transform(sets, lambda x: F.array_join(x, "|")), " ").alias("rule_id"), sets.alias("tokens"), F.col("m")[0]["members"].alias("anchor"), "label", "confidence", "balanced", "support")


def _needless(rules: DataFrame) -> DataFrame:
    """(items, label) of which some non-empty proper subset of the items gives the label at least as confidently.

    Sets are met by size: each takes the best of those with one item less, which know the best of their own subsets.
    All of these are among the frequent sets, as they are at least as frequent.
    """
    sets = rules.select("items", "label", F.col("confidence").alias("c"), F.size("items").alias("n"))
    best, out = sets.where("n = 1").select("items", "label", F.col("c").alias("best")), None
    for n in range(2, (sets.agg(F.max("n")).first()[0] or 1) + 1):
        less = sets.where(F.col("n") == n).select("items", "label", "c", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("less"))
        below = less.join(best.withColumnRenamed("items", "less"), ["less", "label"]).groupBy("items", "label").agg(F.max("best").alias("below"), F.max("c").alias("c"))
        level = cut(below.select("items", "label", F.greatest("below", "c").alias("best"), (F.col("below") >= F.col("c")).alias("needless")), "level")
        best, these = level.select("items", "label", "best"), level.where("needless").select("items", "label")
        out = these if out is None else out.union(these)
    return sets.limit(0).select("items", "label") if out is None else out


def classify(urls: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """(row's key, url, mined, mined_rule): the verdict of the best rule that matches, else `default` and null.

    The rule with the highest balanced confidence wins; ties go to more support, then more tokens, then the rule that
    sorts first. Null and repeated keys and urls stay; null urls take the default. The inverted index is sent to the
    executors only while it has at most BROADCAST_RULES rows.
    """
    r = F.struct("balanced", "support", F.size("tokens").alias("n"), F.col("rule_id"), F.col("label"), "tokens").alias("r")
    index = cut(rules.select(F.explode("anchor").alias("anchor"), r), "index")
    small = index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    rank = F.struct(F.col("r.balanced"), F.col("r.support"), F.col("r.n"), F.transform(F.split("r.rule_id", ""), lambda c: -F.ascii(c)))
    met = urls.select(tokens(F.col("url")).alias("t"), "url").where(F.size("t") > 0).groupBy("url").agg(F.first("t").alias("t"))
    met = met.select("url", "t", F.explode("t").alias("anchor")).join(F.broadcast(index) if small else index, "anchor")
    met = met.where(F.forall("r.tokens", lambda some: F.arrays_overlap(some, F.col("t")))).groupBy("url").agg(F.max_by("r", rank).alias("r"))
    met = cut(met.select(F.col("url").alias("__url"), F.col("r.label").alias("mined"), F.col("r.rule_id").alias("mined_rule")), "mined")
    # Null urls match nothing: they needn't all meet in one task.
    rows = urls.select(F.col(key), "url")
    some = rows.where(F.col("url").isNotNull()).join(met, F.col("url") == F.col("__url"), "left").select(key, "url", F.coalesce("mined", F.lit(default)).alias("mined"), "mined_rule")
    return some.unionByName(rows.where(F.col("url").isNull()).select(key, "url", F.lit(default).alias("mined"), F.lit(None).cast("string").alias("mined_rule")))


def held_out(labelled: DataFrame, settings: Mining = Mining(), default: str = "allow") -> DataFrame:
    """(label, mined, n) of the fifth of the rows whose crc32(url) mod 5 is 0, by rules mined from the others."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("string").alias("page_id"))
    out = F.crc32("url") % 5 == 0
    rules = cut(mine(rows.where(~out).select("url", F.col("page_id").alias("label")), settings), "rules")
    return classify(rows.where(out), rules, default).groupBy(F.col("page_id").alias("label"), "mined").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, settings: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of each row of `pages`; columns besides page_id, url are ignored.

    Null urls and urls without `://` have empty host and path and no explicit rule. Repeated rows are judged each; an
    empty table gives an empty result.
    """
    mined = classify(pages.select("page_id", "url"), cut(mine(labelled, settings), "rules"))
    h, p = host(F.col("url")), path(F.col("url"))
    out = mined.select("page_id", h.alias("host"), p.alias("path"), "mined", "mined_rule").withColumn("x", explicit(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", "mined").alias("verdict"), F.when(F.col("x").isNull(), F.col("mined_rule")).alias("mined_rule"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label): a page is `block` where the document its URL numbers is of quality 0 or toxic, else `allow`."""
    kinds = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label"))
    numbered = pages.select("url", F.regexp_extract(path(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1).alias("d")).where("d <> ''").select("url", F.col("d").cast("long").alias("doc_id"))
    return numbered.join(kinds, "doc_id").select("url", "label")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op10_url_filter": op10_url_filter}
