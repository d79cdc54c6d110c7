"""Deduplication.

Keep-first on a key is ``groupBy(key).agg(min(order))`` followed by a
semi-join on the unique row id: the aggregate is combined map-side, so a key
holding a third of all rows costs one small partial row per task, and the
semi-join is on a unique id, so nothing is skewed.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir
from . import graph as G


def keep_first(df: DataFrame, key: list, id_col: str) -> DataFrame:
    """Rows whose ``id_col`` is the smallest within their key."""
    key_cols = [F.col(k) if isinstance(k, str) else k for k in key]
    firsts = df.groupBy(*key_cols).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(firsts, id_col, "left_semi")


def exact_dedup(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """keep the first row of each normalised-text hash (C14)."""
    return keep_first(df.withColumn("__h", T.normalized_hash(text_col)), ["__h"], id_col).drop("__h")


def triple_dedup(df: DataFrame, id_col: str, cols=("prompt", "chosen", "rejected")) -> DataFrame:
    """keep the first row of each exact (prompt, chosen, rejected)."""
    return keep_first(df, list(cols), id_col)


#: Row numbers (8 bytes each) up to which they are broadcast, to take rows out of the sets without a shuffle.
BROADCAST_ROWS = 2_000_000


def shingle_hashes(c, n: int) -> Column:
    """The hashes of C15's shingles, sorted: words are hashed first, so n-grams are joined and compared as numbers."""
    def ngrams(h):
        last = F.greatest(F.size(h) - n + 1, F.lit(0))
        acc = F.slice(h, 1, last)
        for k in range(1, n):
            acc = F.zip_with(acc, F.slice(h, k + 1, last), lambda a, b: F.xxhash64(a, b))
        return acc
    words = F.transform(T.py_words(F.lower(F.col(c) if isinstance(c, str) else c)), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(T.once(words, lambda h: F.when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(ngrams(h)))))


def shingle_sets(df: DataFrame, text_col: str, id_col: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(sets, firsts)``. sets is (row, id, sz, hs, d1, d2): each row's distinct shingles
    as sorted 64-bit hashes; firsts is (sz, d1, d2, id, row, n): of each different set the
    smallest id, one row of that id, and how many rows have both.

    Texts are tokenised once, into a checkpointed table from which digests,
    frequencies, prefixes and verification are all read. Rows without a text
    have no set and rows without an id no links; both are left out. Two 64-bit
    hashes and the size stand for a set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sets = df.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), shingle_hashes(text_col, n).alias("hs"))
    sets = sets.select("row", "id", F.size("hs").cast("long").alias("sz"), "hs", F.xxhash64("hs").alias("d1"),
                       F.xxhash64(F.lit(1), F.reverse("hs")).alias("d2")).checkpoint()
    firsts = sets.groupBy("sz", "d1", "d2", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")) \
        .groupBy("sz", "d1", "d2").agg(F.min(F.struct("id", "row", "n")).alias("first")) \
        .select("sz", "d1", "d2", "first.*").checkpoint()
    return sets, firsts


def different_sets(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row of each different set. The others are taken out by their numbers, so sets need no shuffle if those are few."""
    others = sets.select("row").join(firsts.select("row"), "row", "left_anti").checkpoint()
    few = others.count() <= BROADCAST_ROWS
    return sets.join(F.broadcast(others) if few else others, "row", "left_anti").select("row", "id", "sz", "hs")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(row, sz, sh, rest): the shared shingles of each set's prefix, and how many of the set stand from there on.

    Shingles stand in one global order and a prefix is the first
    ``|s| - ceil(threshold * |s|) + 1`` of a set; two sets that reach the
    threshold share one of them. The lower hashes come first, of them those in
    fewest sets (ties by the hash): as many are lower as give a set twice its
    prefix on average, and only these are counted. A set with too few of them
    also gives its other shingles, which come after, by their number in such
    sets. A shingle of one set alone meets nothing and goes no further than
    its count. All bounds are in integers.
    """
    share = Fraction(str(threshold))
    need = F.col("sz") * share.numerator + (share.denominator - 1)
    plen = F.greatest(F.col("sz") - (need - F.pmod(need, F.lit(share.denominator))) / share.denominator + 1, F.lit(1)).cast("long")
    bound = F.lit(int(min(2 * (1 - share), 1) * (2 ** 64 - 1)) - 2 ** 63)
    sized = sets.select("row", "sz", "hs", plen.alias("plen"), F.size(F.filter("hs", lambda h: h <= bound)).alias("low"))
    ex = sized.select("row", "sz", "plen", "low", F.explode(
        F.when(F.col("low") >= F.col("plen"), F.slice("hs", 1, F.col("low"))).otherwise(F.col("hs"))).alias("sh"))
    shared = ex.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("sh"))).filter("df > 1").withColumn("late", F.col("sh") > bound)
    part = Window.partitionBy("row", "late")
    # all of the set, less its single shingles and the shared ones before this one
    return shared.withColumn("k", F.row_number().over(part.orderBy("df", "sh"))).withColumn("of", F.count(F.lit(1)).over(part)) \
        .withColumn("rest", F.when(F.col("late"), F.lit(0)).otherwise(F.col("sz") - F.col("low")) + F.col("of") - F.col("k") + 1) \
        .filter(F.col("sz") - F.col("rest") < F.col("plen")).select("row", "sz", "sh", "rest")


def similar_sets(sets: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(i, j, jaccard, row_i, row_j): the pairs of ids i < j of :func:`different_sets`
    whose Jaccard similarity is ``threshold`` or more.

    Candidates share a shingle of their :func:`prefixes`. They also pass the
    size filter, and a shared shingle counts only where the shingles after it
    could still make up the overlap asked for (the first shared one of a true
    pair always does).
    """
    ensure_checkpoint_dir(sets.sparkSession)
    share = Fraction(str(threshold))
    num, den = F.lit(share.numerator).cast("long"), F.lit(share.denominator).cast("long")
    prefix = prefixes(sets, threshold)
    a = prefix.select(F.col("row").alias("row_a"), F.col("sz").alias("sza"), F.col("rest").alias("ra"), "sh")
    b = prefix.select(F.col("row").alias("row_b"), F.col("sz").alias("szb"), F.col("rest").alias("rb"), "sh")
    both = F.col("sza") + F.col("szb")
    cand = a.join(b, "sh").filter((F.col("row_a") < F.col("row_b")) & (F.least("sza", "szb") * den >= F.greatest("sza", "szb") * num)
                                  & (F.least("ra", "rb") * (den + num) >= both * num)).select("row_a", "row_b").distinct().checkpoint()
    rows = cand.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct()
    if rows.count() <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(rows), "row", "left_semi")
    sa, sb = (sets.select(F.col("row").alias(f"row_{x}"), F.struct("id", "row").alias(x), F.col("sz").alias(f"sz{x}"),
                          F.col("hs").alias(f"h{x}")) for x in "ab")
    # explode, so that the overlap is computed once, for the test and for the result
    scored = cand.join(sa, "row_a").join(sb, "row_b") \
        .select("a", "b", both.alias("both"), F.size(F.array_intersect("ha", "hb")).cast("long").alias("common")) \
        .select("a", "b", "both", F.explode(F.filter(F.array("common"), lambda c: c * den >= (F.col("both") - c) * num)).alias("common"))
    return scored.filter("a.id <> b.id").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("common") / (F.col("both") - F.col("common"))).alias("jaccard")) \
        .select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), "jaccard", F.col("a.row").alias("row_i"), F.col("b.row").alias("row_j"))


def near_dup_edges(df: DataFrame, text_col: str, id_col: str, threshold: float = 0.95, n: int = 3) -> DataFrame:
    """Similar pairs (i < j, Jaccard of shingle sets >= threshold), copies folded.

    Rows with equal sets are linked with the first of them only, as (first,
    row, 1.0), and the other pairs are between first rows: k copies give
    k - 1 links, and every similar pair follows from them. First rows that
    repeat an id have each their pairs.
    """
    sets, firsts = shingle_sets(df, text_col, id_col, n)
    pairs = similar_sets(different_sets(sets, firsts), threshold)
    again = firsts.filter("n > 1")
    if not again.isEmpty():
        for end in ("i", "j"):
            pairs = pairs.join(again.select(F.col("row").alias(f"row_{end}"), F.col("n").alias(f"n_{end}")), f"row_{end}", "left")
        times = F.coalesce("n_i", F.lit(1)) * F.coalesce("n_j", F.lit(1))
        pairs = pairs.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    key = ["sz", "d1", "d2"]
    copies = sets.select(*key, F.col("id").alias("j")).join(firsts.select(*key, F.col("id").alias("i")), key).filter("i < j") \
        .select("i", "j", F.lit(1.0).alias("jaccard"))
    return pairs.select("i", "j", "jaccard").unionByName(copies)


#: Links up to which a component of similar texts is resolved in one task (24 bytes a link, streamed).
TASK_LINKS = 20_000_000


def _dropped_in_rounds(edges: DataFrame) -> DataFrame:
    """The same for components too large for one task, all their nodes at once.

    A round keeps the nodes without an open smaller neighbour and drops their
    neighbours; the links left between open nodes go on. Each round's dropped
    nodes are a part of one table, read once at the end.
    """
    import uuid
    spark = edges.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dropped-{uuid.uuid4().hex}"
    left, k = edges.select("i", "j").checkpoint(), 0
    while not left.isEmpty():
        first = left.select("i").distinct().join(left.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        left.join(first, "i", "left_semi").select(F.col("j").alias("id")).distinct().write.parquet(f"{path}/round={k}")
        gone = spark.read.parquet(f"{path}/round={k}")
        left = left.join(gone.withColumnRenamed("id", "i"), "i", "left_anti") \
            .join(gone.withColumnRenamed("id", "j"), "j", "left_anti").select("i", "j").checkpoint()
        k += 1
    return spark.read.parquet(path).select("id") if k else edges.select(F.col("j").alias("id")).limit(0)


def greedy_keep_first(nodes: DataFrame, edges: DataFrame, id_col: str = "id", task_links: int = TASK_LINKS) -> DataFrame:
    """Lexicographically-first maximal independent set of the similarity graph.

    A node is kept when no kept smaller neighbour exists, the greedy rule
    that scans rows in id order. The rule acts inside components of the
    graph: each is scanned in one task, however long its chains; components
    with more than ``task_links`` links go through rounds instead. A graph
    with fewer links than a tenth of that needs no components: one task scans
    it. Returns ``(id, kept)`` for every node.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    links = edges.select("i", "j").checkpoint()
    if links.count() * 10 <= task_links:
        tagged = links.withColumn("root", F.lit(0))
    else:
        of = G.components(links, "i", "j")
        tagged = links.join(of.withColumnRenamed("node", "i"), "i").checkpoint()
    large = tagged.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_links).select("root").checkpoint()
    if large.isEmpty():
        dropped = G.dropped_in_order(tagged)
    else:
        dropped = G.dropped_in_order(tagged.join(large, "root", "left_anti")).unionByName(
            _dropped_in_rounds(tagged.join(large, "root", "left_semi")))
    return nodes.select(F.col(id_col).alias("id")).join(dropped.withColumn("__gone", F.lit(True)), "id", "left") \
        .select(F.col("id").alias(id_col), F.col("__gone").isNull().alias("kept"))


def near_dedup(df: DataFrame, text_col: str, id_col: str, threshold: float = 0.95, n: int = 3) -> DataFrame:
    """greedy first-kept near-duplicate removal at Jaccard >= threshold.

    Equal shingle sets share the fate of their first row, so the similarity
    graph is built only over first rows. Rows without a text stay.
    """
    sets, firsts = shingle_sets(df, text_col, id_col, n)
    status = greedy_keep_first(firsts.select("id"), similar_sets(different_sets(sets, firsts), threshold))
    none = df.filter(F.col(text_col).isNull()).select(F.col(id_col).alias("id"))
    stay = status.filter("kept").select("id").unionByName(none)
    return df.join(stay.withColumnRenamed("id", id_col), id_col, "left_semi")
