"""From banded keys to verified links and classes; shared by the MinHash operators.

No step needs all members of a bucket in one place. A bucket's members meet its smallest member only,
and verified links connect them. What shares a bucket with another class after that goes to an exact
similarity join (``across``), whose rows are tokens: it finds every link between different classes, and
no bound in it is a guess.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontolith.llm import text as T
from ontolith.plans.components import components
from ontolith.plans.shared import discard, release, written


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, so that long texts don't meet ten thousand others in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class _Bags:
    """Bags of texts, the least recently used of which go when all hold more than ``most`` bytes."""

    def __init__(self, most: int = 32 << 20) -> None:
        self.bags: OrderedDict[str, np.ndarray] = OrderedDict()
        self.held, self.most = 0, most

    def of(self, texts: list[str]) -> list[np.ndarray]:
        more = [t for t in dict.fromkeys(texts) if t not in self.bags]
        for t, bag in zip(more, T.text_bags(more), strict=True):
            self.bags[t] = bag.copy()
            self.held += bag.nbytes
        out = []
        for t in texts:
            self.bags.move_to_end(t)
            out.append(self.bags[t])
        while self.held > self.most and len(self.bags) > 1:
            self.held -= self.bags.popitem(last=False)[1].nbytes
        return out


def _similarity() -> Callable[[Column | str, Column | str], Column]:
    held: list[_Bags] = []

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        if not held:
            held.append(_Bags())
        bags = held[0].of([*a, *b])
        return pd.Series([T.similarity(x, y) for x, y in zip(bags[: len(a)], bags[len(a) :], strict=True)], dtype=float)

    return similarity


def _bag(text: str) -> Column:
    """The tokens of a text: its bag of shingles, each once (see ``text.bag``), and the parities of 128 classes of them."""

    @F.pandas_udf("bag array<long>, m1 long, m2 long")
    def bag(texts: pd.Series) -> pd.DataFrame:
        bags = T.text_bags(list(texts))
        odd = np.array([np.bincount((b & np.uint64(127)).astype(np.int64), minlength=128) & 1 for b in bags], np.uint8).reshape(-1, 128)
        marks = np.packbits(odd, axis=1).view(np.int64)
        return pd.DataFrame({"bag": pd.Series([b.view(np.int64) for b in bags], dtype=object), "m1": marks[:, 0], "m2": marks[:, 1]})

    return bag(text)


def _band(size: Column) -> Column:
    """Sizes by their logarithm; a larger size is never in a lower band."""
    return F.floor(F.log(size) / F.log(F.lit(1.05))).cast("int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) distinct pairs and (id, text) -> (a, b, sim), by the whole texts, written out.

    A text in very many pairs makes a skewed join, which AQE splits; nothing gathers its pairs.
    """
    a, b = texts.toDF("a", "a_text"), texts.toDF("b", "b_text")
    both = pairs.join(a, "a").join(b, "b")
    return written(both.select("a", "b", _similarity()("a_text", "b_text").alias("sim")), "verified")


def across(ids: DataFrame, texts: DataFrame, least: float, apart: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, component) and (id, text) -> (a, b, sim): every link between texts of different components.

    An exact similarity join by prefixes. Tokens of one component only can't be shared across; they come
    first, the others by their frequency. Two texts that are alike share a token among the first of both, and behind the
    first one that they share there are still enough in either. So a token's place bounds the sizes that a text can meet at
    it, and rows meet by token and band of sizes: what remains is few even where a token is in every text of a large group.
    Tokens of either text alone are at least as many as the parities in which the two differ (``_bag``). Of the texts with
    such a token at least one lies outside the component that has most of them, so only those meet the others.
    """
    bags = texts.join(ids, "id").select("id", "component", _bag("text").alias("b"))
    bags = written(bags.select("id", "component", F.size("b.bag").alias("size"), "b.*"), "bags")
    tokens = bags.select("id", "component", "size", F.explode("bag").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("f"), F.min("component").alias("x"), F.max("component").alias("y"))
    # Written, as a join right after an aggregation by its key can't be split where the key is hot.
    shared = written(shared.where("x <> y").select("t", "f"), "shared")
    rows = tokens.join(shared, "t").groupBy("id", "component", "size")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    fewest = F.ceil(F.col("size") * least - 1e-9).cast("int")  # tokens shared with any text that is alike
    rows = rows.where(F.size("s") >= fewest).join(bags.select("id", "component", "size", "m1", "m2"), ["id", "component", "size"])
    own = F.col("size") - F.size("s")
    rows = rows.select("id", "component", "size", "m1", "m2", own.alias("own"), F.posexplode(F.slice("s", 1, F.size("s") - fewest + 1)).alias("i", "u"))
    prefix = written(rows.select("id", "component", "size", "m1", "m2", "u.t", (F.col("own") + F.col("i")).alias("place")), "prefix")
    most = prefix.groupBy("t", "component").agg(F.count("*").alias("n"))
    most = most.groupBy("t").agg(F.max(F.struct("n", "component"))["component"].alias("host"), F.count("*").alias("k")).where("k > 1").select("t", "host")
    most = written(most, "hosts")
    busy = written(prefix.join(most, "t"), "busy")
    share = least / (1 + least)  # of both sizes, what texts that are alike have in common
    low = F.ceil(F.col("size") * least - 1e-9)
    high = F.floor(F.least(F.col("size") / least, (F.col("size") - F.col("place")) / share - F.col("size")) + 1e-6)
    met = busy.where((F.col("component") != F.col("host")) & (high >= low))
    met = met.withColumn("band", F.explode(F.sequence(_band(low), _band(high)))).withColumnRenamed("host", "host1")
    columns = ("id", "component", "size", "place", "m1", "m2")
    one = met.select("t", "band", "host1", *[F.col(c).alias(f"{c}_1") for c in columns])
    two = busy.select("t", _band(F.col("size")).alias("band"), *[F.col(c).alias(f"{c}_2") for c in columns])
    size = F.col("size_1") + F.col("size_2")
    both = F.ceil(share * size - 1e-9)
    once = (F.col("component_2") == F.col("host1")) | (F.col("id_1") < F.col("id_2"))
    behind = F.least(F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2"))
    alone = F.bit_count(F.col("m1_1").bitwiseXOR(F.col("m1_2"))) + F.bit_count(F.col("m2_1").bitwiseXOR(F.col("m2_2")))
    met = one.join(two, ["t", "band"]).where((F.col("component_1") != F.col("component_2")) & once & (behind >= both))
    met = met.where((alone <= size - 2 * both) & apart(F.col("id_1"), F.col("id_2")))
    pairs = met.select(F.greatest("id_1", "id_2").alias("a"), F.least("id_1", "id_2").alias("b")).distinct()
    pairs = written(pairs, "candidates")
    found = verified(pairs, texts)
    discard(bags, shared, prefix, most, busy, pairs)
    return found


def first_of(by: list[str], *order: str) -> tuple[Column, Column]:
    """Whether a row is the first of its group, and whether it is the only one.

    They look at the rows before and behind only: a group is sorted, never held, and no row is joined to an aggregate.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.lag(F.lit(1)).over(w).isNull()
    return first, first & F.lead(F.lit(1)).over(w).isNull()


def _differ(a: Column, b: Column) -> Column:
    return a != b


def classes(bands: list[DataFrame], fetch: Callable[[DataFrame], DataFrame], least: float, apart: Callable[[Column, Column], Column] = _differ) -> tuple[DataFrame, DataFrame]:
    """(key, id) bucket entries, in one table or one for each band -> (v, component) and links (a, b, sim) that connect them.

    Ids are of any one orderable type and stand for distinct texts. ``fetch`` gets a table of distinct
    ids and returns their (id, text), each id once. Two texts are linked if their similarity is ``least`` or
    more and their ids are ``apart``, a symmetric condition; of every pair in one bucket that is
    linked, both ends get into one class.
    """
    spark, several = bands[0].sparkSession, []
    for keys in bands:  # most keys have one entry; one table's shuffle is over before the next
        _, alone = first_of(["key"], "id")
        several.append(written(keys.select("key", "id", (~alone).alias("several")).where("several").drop("several"), "several"))
        release(spark)
    keys = reduce(DataFrame.unionByName, several)
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where(apart(F.col("head"), F.col("tail"))).drop("tail")
    heads = written(heads, "heads")
    entries = written(keys.join(heads, "key").select("key", "id", "head"), "buckets")
    discard(heads, *several)
    release(spark)
    first = written(entries.where(apart(F.col("id"), F.col("head"))).select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    texts = written(fetch(entries.select("id").distinct()).select("id", "text"), "texts")
    told = verified(first, texts)
    links = told.where(F.col("sim") >= least)
    at = components(links)
    # All members have met the head; only the others can still lack a link between them.
    known = entries.where("id <> head").select("key", "id").join(at.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ids = written(known.join(mixed, "key").select("id", "component").distinct(), "unsettled")
    more = None
    if open_ids.isEmpty():
        links = written(links, "links")
    else:
        more = across(open_ids, texts, least, apart)
        links = written(links.unionByName(more.where(F.col("sim") >= least)), "links")
        discard(at)
        at = components(links)
    discard(entries, first, texts, told, open_ids, more)
    return at, links
