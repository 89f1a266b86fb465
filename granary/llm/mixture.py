"""Problem 6: a mix in which each source has its target share of the tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.tokens import DEFAULT, FOLDER, language, token_counts
from granary.session import materialize

SEED = 60
#: Records that a hash range of a leaf's order has at most, or nearly: only the range where a leaf's prefix ends is sorted.
RANGE_ROWS = 20_000
#: Leaves of the tree (sources times languages) that may be read to the driver.
MAX_LEAVES = 100_000
LEAF = ["domain", "lang", "source"]


@dataclass
class Node:
    """A node of the tree: its weight, the tokens it can give with all repeats, and what it was given."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0


def give(node: Node, budget: float) -> None:
    """Divides a budget among a node's children by weight. A child that can't use its part takes its capacity; what it leaves
    goes to its siblings by weight. A node's capacity is that of its children together, so that a shortage leaves a node only
    when all below it are full, and then goes to the node's own siblings."""
    node.budget = min(budget, node.capacity)
    open_, left = [c for c in node.children.values() if c.weight > 0 and c.capacity > 0], node.budget
    while open_ and left > 0:
        total = sum(c.weight for c in open_)
        full = [c for c in open_ if left * c.weight / total >= c.capacity]
        if not full:
            for c in open_:
                give(c, left * c.weight / total)
            return
        for c in full:
            give(c, c.capacity)
        left -= sum(c.capacity for c in full)
        open_ = [c for c in open_ if c not in full]


def plan(leaves: list[dict], total: float | None = None) -> list[dict]:
    """Adds `budget` (tokens) to the leaves (domain, lang, source, share, repeats, tokens).

    A source's weight is divided among its languages by the tokens there are. `total` is by default the tokens of all leaves."""
    have: dict[str, float] = {}
    for x in leaves:
        have[x["source"]] = have.get(x["source"], 0) + x["tokens"]
    root = Node()
    for x in leaves:
        weight = x["share"] * x["tokens"] / have[x["source"]] if have[x["source"]] else 0
        capacity = x["tokens"] * x["repeats"] if x["share"] > 0 else 0
        node = root
        for name in [None, *(x[c] for c in LEAF)]:
            node = node if name is None else node.children.setdefault(name, Node())
            node.weight += weight
            node.capacity += capacity
        x["node"] = node
    give(root, sum(have.values()) if total is None else total)
    return [{k: v for k, v in x.items() if k != "node"} | {"budget": x["node"].budget} for x in leaves]


def _sized(records: DataFrame, targets: DataFrame, key: str, text: str, name: str, folder: str) -> DataFrame:
    """(key, source, lang, domain, share, repeats, n_tokens) of the records whose source has a target."""
    known = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats"))).alias("t"))
    r = records.select(F.struct(key, "source", language(F.col("lang")).alias("lang")).alias("k"), F.col(text).alias("text"))
    counted = token_counts(r, "k", "text", name, folder).select("k.*", "n_tokens")
    if known.limit(MAX_LEAVES + 1).count() > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} targets")
    return counted.join(F.broadcast(known.select("source", "t.*")), "source")


def _part(order: str, bits: int) -> Column:
    """The hash range of a record, one of 2 ** bits: the upper bits of its place in the seeded order."""
    return F.shiftright(F.col(order), 64 - bits) + F.lit(1 << (bits - 1))


def mix(records: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_ord", text: str = "text", seed: int = SEED, name: str = DEFAULT, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: (doc_ord, source, lang, domain, n_tokens, times), one row per record that is used, with how often.
    shares: (source, domain, target_share, max_repeats, n_records, own_tokens, mix_tokens, most_times, actual_share, largest_total), the last
    being the largest total at which each source that has tokens meets its target.

    Method: the target shares flow down a tree of domains, languages and sources; what a leaf can't give (its tokens times
    max_repeats) is taken over by its siblings, and only then by other languages and domains. A leaf gives its whole set as
    often as its budget holds it, and of one more epoch the prefix, in the order of a seeded hash, that comes nearest to the
    rest. The prefix is found by sums over hash ranges, then within the one range where it ends, so that a leaf with a third
    of all rows is sorted nowhere as a whole. `total` is by default the tokens of all records that have a target.
    Records of sources without a target, of null source or without tokens are never chosen; sources without records have
    0 in shares; a record delivered twice under another key is another record; equal hashes go by key."""
    sized = materialize(_sized(records, targets, key, text, name, folder), "sized")
    stats = sized.groupBy(*LEAF, "share", "repeats").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    spark = records.sparkSession
    bits = max(4, (max((r["rows"] for r in stats), default=0) // RANGE_ROWS).bit_length())
    rows = []
    for x in plan([r.asDict() for r in stats], total):
        whole = min(int(x["budget"] // x["tokens"]), x["repeats"]) if x["tokens"] else 0
        rows.append((x["domain"], x["lang"], x["source"], whole, float(x["budget"] - whole * x["tokens"]) if whole < x["repeats"] else 0.0))
    leaves = F.broadcast(spark.createDataFrame(rows, "domain string, lang string, source string, whole int, rest double"))
    # an epoch's order depends on its number; the last, partial one of each leaf is number `whole`
    r = sized.filter("n_tokens > 0").join(leaves, LEAF).withColumn("_at", F.xxhash64(F.lit(seed), "whole", key)).withColumn("_range", _part("_at", bits).cast("int"))
    ranges = r.groupBy(*LEAF, "_range").agg(F.sum("n_tokens").alias("n"))  # at most a row per leaf and range
    before = Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranges")
    ends = ranges.join(leaves, LEAF).filter("_before < rest").groupBy(*LEAF).agg(F.max("_range").alias("_end"), F.max("_before").alias("_before"))
    r = r.join(F.broadcast(ends), LEAF, "left")  # at most one row per leaf
    inside = Window.partitionBy(*LEAF).orderBy("_at", key).rowsBetween(Window.unboundedPreceding, -1)
    last = r.filter("_range = _end").withColumn("_sum", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    last = last.withColumn("times", F.col("whole") + (F.col("_sum") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    other = r.filter("_end is null or _range <> _end").withColumn("times", F.col("whole") + F.coalesce(F.col("_range") < F.col("_end"), F.lit(False)).cast("int"))
    cols = [key, "source", "lang", "domain", "n_tokens", "times"]
    chosen = materialize(last.select(*cols).unionByName(other.select(*cols)).filter("times > 0"), "chosen")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mix_tokens"), F.max("times").alias("most_times"))
    own = sized.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("own_tokens"))
    all_ = targets.join(F.broadcast(own), "source", "left").join(F.broadcast(used), "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = all_.select("source", "domain", "target_share", "max_repeats", zero("n_records"), zero("own_tokens"), zero("mix_tokens"), zero("most_times"))
    mass = used.agg(F.sum("mix_tokens")).scalar()
    have: dict[str, float] = {}
    for x in stats:
        if x["share"] > 0 and x["tokens"]:
            have[x["source"]] = have.get(x["source"], 0) + x["tokens"] * x["repeats"] / x["share"]
    largest = F.lit(int(min(have.values(), default=0))).cast("bigint").alias("largest_total")
    return chosen, shares.withColumn("actual_share", F.round(F.coalesce(F.col("mix_tokens") / mass, F.lit(0.0)), 9)).select("*", largest)
