"""Negative mining and set operations over preference data.

Hard-negative mining is a band join: for each sample, the first ``k`` other
responses (in data order) whose quality lies in an interval that depends on
the sample. It is answered without pairing samples with the rows of a band:

* the first ``k`` rows of each of the first ``k + 1`` prompts (by first
  appearance) of any set of rows always hold the first ``k`` rows of any other
  prompt, so ``k * (k + 1)`` rows stand for the set;
* such rows are kept, cut map-side by ``WindowGroupLimit``, for each quality
  and for each dyadic cell of the quality axis, from the whole axis down to
  cells of 2^-26;
* an interval is at most two cells a level, and a few cells of the finest
  level at its ends, where the exact predicate decides by quality;
* samples of equal quality have one interval and share its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Levels of dyadic cells: the finest are 2^-LEVELS wide, far above the rounding of a quality.
LEVELS = 26


def _prelimit(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """Per group, the rows any 'first k rows of another prompt' query can need: k * (k + 1) at most."""
    first = rows.groupBy(*group, "oprompt").agg(F.min("order").alias("first_order"))
    wp = Window.partitionBy(*group).orderBy("first_order", "oprompt")
    top_prompts = first.withColumn("__pr", F.row_number().over(wp)).filter(F.col("__pr") <= k + 1).select(*group, "oprompt")
    wr = Window.partitionBy(*group, "oprompt").orderBy("order")
    top_rows = rows.withColumn("__r", F.row_number().over(wr)).filter(F.col("__r") <= k).drop("__r")
    return top_rows.join(top_prompts, [*group, "oprompt"], "left_semi")


def _cell(q):
    # a product with a power of two is exact, so cells keep the order of qualities
    return F.floor(q * float(1 << LEVELS)).cast("long")


def band_candidates(samples: DataFrame, others: DataFrame, lo, hi, pred, k: int, q_max: float) -> DataFrame:
    """(sq, order, oprompt, payload...): per distinct sample quality, the k * (k + 1) rows at most that its samples need."""
    leaf = _prelimit(others.filter(F.col("oprompt").isNotNull()), ["oq"], k)
    levels = F.sequence(F.lit(0), F.lit(LEVELS + int(q_max + 1).bit_length()))  # the last: one cell for all
    cells = _prelimit(leaf.withColumn("level", F.explode(levels)).withColumn(
        "cell", F.expr("shiftright(cast(floor(oq * %d) as bigint), level)" % (1 << LEVELS))), ["level", "cell"], k)
    q = samples.filter(F.col("sprompt").isNotNull() & F.col("sq").isNotNull()).select("sq").distinct()
    sq = F.col("sq")
    end = F.lit(int(q_max * (1 << LEVELS)) + 4).cast("long")
    q = q.withColumn("a", _cell(lo(sq)) if lo is not None else F.lit(-4).cast("long")) \
        .withColumn("b", _cell(hi(sq)) if hi is not None else end)
    # the finest cells at both ends, with every quality in them
    ends = q.select("sq", F.explode(F.array_distinct(F.concat(
        F.sequence(F.col("a") - 1, F.col("a") + 1), F.sequence(F.col("b") - 1, F.col("b") + 1)))).alias("cell"))
    at_ends = ends.join(leaf.withColumn("cell", _cell(F.col("oq"))), "cell").filter(pred(sq, F.col("oq"))).drop("cell")
    # the cells between them: on each level the first if its number is odd, and the last if its number is even
    span = q.withColumn("level", F.explode(levels)) \
        .withColumn("first", F.expr("-shiftright(-(a + 2), level)")).withColumn("end", F.expr("shiftright(b - 1, level)")) \
        .filter(F.col("first") < F.col("end"))
    inner = span.select("sq", "level", F.explode(F.array_compact(F.array(
        F.when(F.pmod("first", F.lit(2)) == 1, F.col("first")),
        F.when(F.pmod("end", F.lit(2)) == 1, F.col("end") - 1)))).alias("cell"))
    within = inner.join(cells, ["level", "cell"]).drop("level", "cell")
    return _prelimit(at_ends.unionByName(within), ["sq"], k)


def first_k_in_band(samples: DataFrame, others: DataFrame, lo, hi, pred, k: int = 3, q_max: float = 1.0) -> DataFrame:
    """For each sample row (``sid, sprompt, sq``), the first ``k`` rows of
    ``others`` (``order, oprompt, oq, payload...``) with ``pred(sq, oq)`` and
    ``oprompt != sprompt``. ``lo``/``hi`` (Column -> Column, ``None`` =
    unbounded) bound the band ``pred`` admits, up to rounding; qualities are
    at most ``q_max``. Null prompts and qualities match nothing."""
    cand = samples.join(band_candidates(samples, others, lo, hi, pred, k, q_max), "sq") \
        .filter(F.col("oprompt") != F.col("sprompt"))
    w = Window.partitionBy("sid").orderBy("order")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(pairs: DataFrame, id_col: str = "id", k: int = 3) -> DataFrame:
    """for each sample, other samples' chosen responses with
    |q - q_o| < 0.2 and q_o < q, and other samples' negatives with
    q_neg > 0.8 q, in data order (other id, chosen before negatives); first k.
    Quality is the shared ``quality`` score; negatives are ``rejected``.

    The band join runs on a narrow (id, prompt, qualities) table computed
    once and checkpointed; response texts are joined back by id for the
    k winners only."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(pairs.sparkSession)
    # prompts are only told apart: their digests do
    base = pairs.select(F.col(id_col).alias("sid"), F.md5("prompt").alias("sprompt"), T.quality("chosen").alias("sq"),
                        T.quality("rejected").alias("rq")).checkpoint()
    samples = base.select("sid", "sprompt", "sq")
    chosen_o = base.select((F.col("sid") * 2).alias("order"), F.col("sid").alias("other_id"), F.lit("chosen").alias("kind"),
                           F.col("sprompt").alias("oprompt"), F.col("sq").alias("oq"))
    neg_o = base.select((F.col("sid") * 2 + 1).alias("order"), F.col("sid").alias("other_id"), F.lit("negative").alias("kind"),
                        F.col("sprompt").alias("oprompt"), F.col("rq").alias("oq"))
    a = first_k_in_band(samples, chosen_o, lambda q: q - 0.2, lambda q: q,
                        lambda q, o: (F.abs(q - o) < 0.2) & (o < q), k)
    b = first_k_in_band(samples, neg_o, lambda q: q * 0.8, None, lambda q, o: o > q * 0.8, k)
    both = a.drop("rank").unionByName(b.drop("rank"))
    w = Window.partitionBy("sid").orderBy("order")
    top = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    texts = pairs.select(F.col(id_col).alias("other_id"), "chosen", "rejected")
    return top.join(texts, "other_id").select(
        F.col("sid").alias(id_col), "rank", "other_id", "kind",
        F.when(F.col("kind") == "chosen", F.col("chosen")).otherwise(F.col("rejected")).alias("negative"))


def group_negatives(df: DataFrame, group_col: str, id_col: str, text_col: str) -> DataFrame:
    """for each row, the texts of the other rows of its (bounded-size)
    group, in id order: equi self-join on the group, id != id."""
    a = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("sid"))
    b = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("oid"), F.col(text_col).alias("negative"))
    return a.join(b, "g").filter(F.col("sid") != F.col("oid")).select(
        F.col("g").alias(group_col), F.col("sid").alias(id_col), "oid", "negative")


# fixed values: negation words and the generic answer
NEGATIONS = ["لا", "ليس", "غير"]
GENERIC_ANSWER = "لا أعرف الإجابة على هذا السؤال."


def synthetic_negatives(text: str = "chosen", key: str = "id", seed: int = 42):
    """the first half of the words (over 3 words), the words shuffled (over
    2), the first absent negation word in front, a generic answer: the first 3."""
    t = F.col(text)
    words = T.py_words(t)
    half = F.array_join(F.slice(words, 1, F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))), " ")
    shuffled = F.array_join(F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct(
        T.u(seed, F.concat(F.col(key).cast("string"), F.lit("|"), i.cast("string"))).alias("r"), w.alias("w")))),
        lambda s: s["w"]), " ")
    negated = None
    for word in reversed(NEGATIONS):
        prefixed = F.when(~F.contains(t, F.lit(word)), F.concat(F.lit(f"{word} "), t))
        negated = prefixed if negated is None else prefixed.otherwise(negated)
    n = F.size(words)
    return F.slice(F.array_compact(F.array(F.when(n > 3, half), F.when(n > 2, shuffled), negated, F.lit(GENERIC_ANSWER))), 1, 3)


def negative_diversity(df: DataFrame, id_col: str, negs_col: str) -> DataFrame:
    """mean pairwise similarity of a row's negatives (i < j) via
    posexplode + self-join on the row id; diversity = 1 - mean, and 0 for
    rows with fewer than two negatives."""
    e = df.select(F.col(id_col).alias("rid"), F.posexplode(negs_col).alias("pos", "neg"))
    a = e.select("rid", F.col("pos").alias("i"), F.col("neg").alias("ni"))
    b = e.select("rid", F.col("pos").alias("j"), F.col("neg").alias("nj"))
    p = a.join(b, "rid").filter(F.col("i") < F.col("j"))
    mean = p.groupBy("rid").agg(F.avg(T.sim("ni", "nj")).alias("mean_similarity"))
    return df.select(F.col(id_col).alias("rid")).join(mean, "rid", "left") \
        .select(F.col("rid").alias(id_col), "mean_similarity",
                F.coalesce(1 - F.col("mean_similarity"), F.lit(0.0)).alias("diversity"))


def negative_hardness(chosen: str | Column, negs: str | Column) -> Column:
    """how hard a row's negatives are, at most 1: a tenth of 1 / (mean
    quality gap + 0.1), the gap being the chosen text's quality less a
    negative's. Without negatives the gap is 0; a gap of exactly -0.1 gives
    null."""
    chosen, negs = (F.col(c) if isinstance(c, str) else c for c in (chosen, negs))
    gaps = T.once(T.quality(chosen), lambda q: F.aggregate(
        F.transform(negs, T.quality), F.lit(0.0).cast("double"), lambda a, x: a + (q - x)))
    mean = F.when(F.size(negs) > 0, gaps / F.size(negs)).otherwise(0.0)
    return T.once(mean + 0.1, lambda m: F.least(F.try_divide(F.lit(1.0), m) / 10.0, F.lit(1.0)))
