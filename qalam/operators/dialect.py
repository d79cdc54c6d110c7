"""Dialect operators.

Detection is a pure projection: the different lexicon terms are looked for
once each, in a copy of the normalised text with one byte a letter, and the
weights of those found are summed natively. No Python per row, no join, no
shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def _literals(pattern: str) -> list[str] | None:
    """The strings that a normalised text, whose only white space are spaces, holds one behind the other if and only
    if it matches ``pattern``; none if the pattern is no such row of strings."""
    parts = pattern.replace(r"\s+", " ").split(".*")
    return parts if all(p and not set(p) & set(r"\.*+?[](){}|^$") for p in parts) else None


_CODES = string.ascii_letters + string.digits


def contained_terms(text: Column, terms) -> Column:
    """Those of ``terms`` that the text holds, once each; null for null.

    A search compares bytes, and half the bytes of Arabic text are one of two
    lead bytes. So the terms' letters are first written as one byte each, and
    what had that byte before as a byte of no term: one pass, after which each
    term is found several times as fast.
    """
    terms = sorted(set(terms))
    letters = "".join(sorted(set("".join(terms)) - {" "}))
    if len(letters) > len(_CODES):
        raise ValueError(f"terms of more than {len(_CODES)} different characters")
    codes = str.maketrans(letters, _CODES[:len(letters)])
    others = "".join(c for c in _CODES if c not in letters)
    coded = F.translate(text, letters + others, _CODES[:len(letters)] + "\x01" * len(others))
    return T.once(coded, lambda c: F.when(c.isNotNull(), F.array_compact(F.array(
        *[F.when(F.contains(c, F.lit(t.translate(codes))), F.lit(t)) for t in terms]))))


def _features(dialect: str):
    """(weight, strings) of each feature of a dialect: the text must hold the strings one behind the other."""
    for kind, weight in L.FEATURE_WEIGHTS.items():
        for term in L.DIALECT_FEATURES[dialect][kind]:
            yield weight, _literals(term) if kind == "patterns" else [term]


def _in_order(norm: Column, first: str, then: str) -> Column:
    at = F.locate(first, norm)
    return (at > 0) & (F.call_function("locate", F.lit(then), norm, at + len(first)) > 0)


def with_dialect_scores(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``__s_<dialect>``: sum of matched feature weights / number of features.

    The text is normalised once and searched once for each different string (:func:`contained_terms`); the
    weights of those it holds are then added up.
    """
    norm, held = F.col("__norm"), F.col("__held")
    singles = sorted({parts[0] for d in L.DIALECT_ORDER for _, parts in _features(d) if len(parts) == 1})
    scores = []
    for d in L.DIALECT_ORDER:
        features = list(_features(d))
        weights = dict.fromkeys(singles, 0.0)
        score = F.lit(0.0)
        for weight, parts in features:
            if len(parts) == 1:
                weights[parts[0]] += weight
            else:
                score = score + F.when(_in_order(norm, *parts), F.lit(weight)).otherwise(F.lit(0.0))
        of = F.create_map(*[x for term, weight in weights.items() if weight for x in (F.lit(term), F.lit(weight))])
        score = score + F.coalesce(F.aggregate(held, F.lit(0.0), lambda acc, term: acc + F.coalesce(
            F.try_element_at(of, term), F.lit(0.0))), F.lit(0.0))
        scores.append((score / float(len(features))).alias(f"__s_{d}"))
    return df.withColumn("__norm", T.normalize_dialect(F.lower(F.col(text_col)))) \
        .withColumn("__held", contained_terms(norm, singles)).select(*df.columns, *scores)


def detect_dialect(df: DataFrame, text_col: str = "text", threshold: float = L.DETECT_THRESHOLD,
                   dialect_col: str = "dialect", confidence_col: str = "confidence") -> DataFrame:
    """Add (dialect, confidence). Non-Arabic text -> ('unknown', 0.0).

    Highest normalised score wins; ties go to the earlier dialect in
    ``DIALECT_ORDER``; a best score under ``threshold`` gives 'unknown'
    with that score.
    """
    staged = with_dialect_scores(df, text_col)
    score_cols = {d: f"__s_{d}" for d in L.DIALECT_ORDER}
    best = F.greatest(*[F.col(score_cols[d]) for d in L.DIALECT_ORDER])
    winner = None
    for d in reversed(L.DIALECT_ORDER):
        winner = F.when(F.col(score_cols[d]) == best, F.lit(d)).otherwise(winner if winner is not None else F.lit("unknown"))
    arabic = T.has_arabic(F.col(text_col))
    dialect = F.when(~arabic, F.lit("unknown")).when(best < threshold, F.lit("unknown")).otherwise(winner)
    confidence = F.when(~arabic, F.lit(0.0)).otherwise(best)
    return evaluate_once(staged, {dialect_col: dialect, confidence_col: confidence}) \
        .drop(*score_cols.values())


def evaluate_once(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Add columns computed exactly once per row.

    A later filter on a plain projected column would be rewritten by the
    optimizer into the full expression and evaluated twice (once in the
    filter, once in the projection). Emitting the values through a
    one-element ``inline`` generator keeps them opaque to predicate
    pushdown: the filter stays above and reads the computed values.
    """
    keep = [c for c in df.columns if c not in named]
    row = F.struct(*[e.alias(n) for n, e in named.items()])
    return df.select(*keep, F.inline(F.array(row)))


def dialect_probabilities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """D3: normalised score per dialect (scores / their sum; all zero -> zeros)."""
    staged = with_dialect_scores(df, text_col)
    total = sum(F.col(f"__s_{d}") for d in L.DIALECT_ORDER)
    arabic = T.has_arabic(F.col(text_col))
    return staged.select(*df.columns, *[
        F.when(arabic & (total > 0), F.col(f"__s_{d}") / total).otherwise(F.lit(0.0)).alias(f"p_{d}")
        for d in L.DIALECT_ORDER])


#: Terms of the evaluator's vote.
EVAL_TERMS = L.EVAL_FORMAL_INDICATORS + [t for d in L.EVAL_DIALECT_ORDER for t in L.EVAL_DIALECT_MARKERS[d]]


def held_count(held: Column, terms) -> Column:
    """How many of the distinct ``terms`` are among the terms found (:func:`contained_terms`); null for null."""
    return F.when(held.isNotNull(), F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in terms]))))


def evaluator_vote(held: Column) -> Column:
    """D2 from the terms found in a lower-cased text."""
    order = ["msa"] + L.EVAL_DIALECT_ORDER
    scores = F.array(held_count(held, L.EVAL_FORMAL_INDICATORS) * 2,
                     *[held_count(held, L.EVAL_DIALECT_MARKERS[d]) for d in L.EVAL_DIALECT_ORDER])
    first = T.once(scores, lambda s: F.array_position(s, F.array_max(s)).cast("int"))
    return F.when(held.isNull(), F.lit("msa")).otherwise(F.element_at(F.array(*[F.lit(d) for d in order]), first))


def evaluator_dialect(text: Column) -> Column:
    """The evaluator's marker vote. msa = 2 x formal hits; ties -> msa,
    egyptian, gulf, levantine, maghrebi."""
    return T.once(contained_terms(F.lower(text), EVAL_TERMS), evaluator_vote)


def analyze_dialects(tagged: DataFrame, text_col: str = "text") -> DataFrame:
    """Per dialect count and percent of *all* rows (blank rows count in the
    denominator, not in the numerator), plus mean and population std of the
    confidence over non-blank rows. One row per dialect.

    One pass: a partial aggregate per (dialect, blank) with count, sum and
    sum of squares, then totals as a window over that tiny result.
    """
    from pyspark.sql import Window as W
    nonblank = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    g = tagged.groupBy("dialect", nonblank.alias("nb")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("confidence").alias("s"),
        F.sum(F.col("confidence") * F.col("confidence")).alias("ss"))
    everything = W.partitionBy()
    nb = F.col("nb")
    g = g.select("*",
                 F.sum("c").over(everything).alias("total_samples"),
                 F.sum(F.when(nb, F.col("c"))).over(everything).alias("m"),
                 F.sum(F.when(nb, F.col("s"))).over(everything).alias("sm"),
                 F.sum(F.when(nb, F.col("ss"))).over(everything).alias("ssm"))
    mean = F.col("sm") / F.col("m")
    std = F.sqrt(F.greatest(F.col("ssm") / F.col("m") - mean * mean, F.lit(0.0)))
    return g.filter(nb).select(
        "dialect", F.col("c").alias("n"), "total_samples",
        (F.col("c") / F.col("total_samples") * 100.0).alias("pct"),
        F.coalesce(mean, F.lit(0.0)).alias("average_confidence"),
        F.coalesce(std, F.lit(0.0)).alias("confidence_std"))


def dialect_examples(tagged: DataFrame, order_col: str = "doc_id", k: int = 5, text_col: str = "text") -> DataFrame:
    """First ``k`` non-blank examples per dialect, text cut to 100 chars
    plus '...'. ``row_number <= k`` plans as a WindowGroupLimit, so each map
    task keeps only k rows per dialect before the shuffle."""
    from pyspark.sql import Window as W
    nonblank = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    w = W.partitionBy("dialect").orderBy(order_col)
    ex = F.when(F.length(text_col) > 100, F.concat(F.substring(text_col, 1, 100), F.lit("..."))) \
        .otherwise(F.col(text_col))
    return tagged.filter(nonblank).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("dialect", "rank", order_col, ex.alias("example"), "confidence")


# ----------------------------------------------------------------- augmentation

WORD = r"\p{L}\p{N}_"   # Python's Unicode \w, for \b word boundaries


def _boundary(word: str) -> str:
    # the word first: what stands before it is looked at where it was found, not at every character
    return f"{word}(?<![{WORD}]{word})(?![{WORD}])"


def _key(key: Column, tag: str) -> Column:
    return F.concat(key.cast("string"), F.lit(tag))


def augment_text(text: Column, dialect: str, key: Column, seed: int = 42,
                 ratio: float = L.AUGMENT_RATIO) -> Column:
    """D4 for one target dialect, deterministic in (seed, key).

    Each transformation rule fires when u(seed, key|dialect|r<i>) < ratio
    (whole-word replace); then each word that has synonyms is swapped when
    u(seed, key|dialect|w<pos>) < ratio, the synonym picked by a second
    draw; words are re-joined with single spaces. Dialects without rules
    return the text unchanged.
    """
    rules = L.AUGMENT_RULES.get(dialect)
    if rules is None:
        return text
    t = text
    for i, (src, dst) in enumerate(rules["transformations"]):
        fire = T.u_below(seed, _key(key, f"|{dialect}|r{i}"), ratio)
        # a rule that does not fire puts each match back: the expression names t once, so it grows by one step a rule
        t = F.regexp_replace(t, F.lit(_boundary(src)), F.when(fire, F.lit(dst)).otherwise(F.lit("$0")))
    syn = rules["synonyms"]

    def swap(w, i):
        expr = w
        for word, choices in reversed(list(syn.items())):
            k = F.concat(key.cast("string"), F.lit(f"|{dialect}|w"), i.cast("string"))
            pick = F.element_at(F.array(*[F.lit(c) for c in choices]),
                                (F.floor(T.u(seed, F.concat(k, F.lit("c"))) * len(choices)) + 1).cast("int"))
            expr = F.when((w == word) & T.u_below(seed, k, ratio), pick).otherwise(expr)
        return F.when(w.isin(*syn), expr).otherwise(w)
    return F.array_join(F.transform(T.py_words(t), swap), " ")


def augment_for(text: Column, dialect_col: Column, key: Column, seed: int = 42,
                ratio: float = L.AUGMENT_RATIO) -> Column:
    """D4 with the target dialect taken from a column."""
    out = text
    for d in reversed(L.AUGMENT_DIALECTS):
        out = F.when(dialect_col == d, augment_text(text, d, key, seed, ratio)).otherwise(out)
    return out


def dialect_variants(df: DataFrame, text_col: str, key_col: str, dialects=None, seed: int = 42,
                     ratio: float = L.AUGMENT_RATIO) -> DataFrame:
    """One augmented text per target dialect (row -> len(dialects) rows)."""
    dialects = dialects or L.AUGMENT_DIALECTS
    v = F.explode(F.array(*[F.struct(F.lit(d).alias("target_dialect"),
                                     augment_text(F.col(text_col), d, F.col(key_col), seed, ratio).alias("variant"))
                            for d in dialects]))
    return df.select("*", v.alias("__v")).select(*df.columns, "__v.target_dialect", "__v.variant")


#: Augmented copies that one row expands into.
COPY_BLOCK = 65_536


def balance_by_dialect(tagged: DataFrame, key_col: str, text_col: str = "text", target: int = 1000,
                       augment_minority: bool = True, seed: int = 42, min_confidence: float = 0.3,
                       quotas: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Per-dialect quota with exact counts, skew-proof.

    Rows with confidence > ``min_confidence`` are grouped by dialect. A group
    at or above its target keeps ``target`` rows with the smallest
    u(seed, key); a smaller group keeps all rows and gains ``target - n``
    augmented copies, copy j drawing row ``1 + floor(u(seed, dialect|j) * n)``
    of that group (sampling with replacement) and rewriting it into the
    dialect. ``quotas(dialect, target)`` overrides the single target (D18).

    Only the narrow (key, dialect) table of eligible rows is ranked; it is
    checkpointed once to the cluster checkpoint folder, so detection runs a
    single time however many branches read it. Texts are joined back by the
    unique key for the selected rows only (from ``texts`` when given, which
    avoids re-running detection; else from ``tagged``).
    """
    from .ranking import grouped_row_number
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(tagged.sparkSession)
    nonblank = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    keep = tagged.filter(nonblank & (F.col("confidence") > min_confidence)) \
        .select(key_col, "dialect", "confidence").checkpoint()
    counts = keep.groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))
    if quotas is None:
        counts = counts.withColumn("target", F.lit(target).cast("long"))
    else:
        counts = counts.join(F.broadcast(quotas.select("dialect", F.col("target").cast("long"))), "dialect")
    # At most one row per dialect: a broadcast of a proven-size table.
    counts = F.broadcast(counts)
    ranked = grouped_row_number(keep.withColumn("__u", T.u(seed, F.col(key_col))), ["dialect"],
                                ["__u", key_col], "__rn", max_groups=len(L.DIALECT_ORDER) + 1)
    ranked = ranked.join(counts, "dialect")
    src = (texts if texts is not None else tagged).select(key_col, *[c for c in tagged.columns
                                                                    if c not in (key_col, "dialect", "confidence")])
    originals = ranked.filter((F.col("__rn") <= F.col("target")) | (F.col("n") < F.col("target"))) \
        .select(key_col, "dialect", "confidence").join(src, key_col) \
        .select(*tagged.columns, F.lit(False).alias("augmented"), F.lit(0).cast("long").alias("copy_id"))
    if not augment_minority:
        return originals
    # the missing copies in two steps, so that no task makes all of a dialect's
    short = F.col("target") - F.col("n")
    blocks = counts.filter((short > 0) & (F.col("n") > 0)).select(
        "dialect", "n", short.alias("__short"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((short - 1) / COPY_BLOCK))).alias("__block")) \
        .repartition("dialect", "__block")
    need = blocks.select("dialect", "n", F.explode(F.sequence(
        F.col("__block") * COPY_BLOCK + 1, F.least((F.col("__block") + 1) * COPY_BLOCK, F.col("__short")))).alias("copy_id"))
    pick = (F.floor(T.u(seed, F.concat(F.col("dialect"), F.lit("|"), F.col("copy_id").cast("string")))
                    * F.col("n")) + 1).cast("long")
    need = need.select("dialect", "copy_id", pick.alias("__rn"))
    copies = ranked.select(key_col, "dialect", "confidence", "__rn").join(need, ["dialect", "__rn"]).join(src, key_col)
    ckey = F.concat(F.col(key_col).cast("string"), F.lit("|c"), F.col("copy_id").cast("string"))
    copies = copies.withColumn(text_col, augment_for(F.col(text_col), F.col("dialect"), ckey, seed)) \
        .select(*tagged.columns, F.lit(True).alias("augmented"), "copy_id")
    return originals.unionByName(copies)


def split_by_dialect(tagged: DataFrame, min_confidence: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows whose confidence reaches ``min_confidence``; written with
    ``partitionBy('dialect')`` (A5) they become one folder per dialect."""
    nonblank = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    return tagged.filter(nonblank & (F.col("confidence") >= min_confidence))


def augment_with_dialects(df: DataFrame, text_col: str, key_col: str, dialects=None, factor: int = 2,
                          seed: int = 42) -> DataFrame:
    """Arabic rows only; each row plus dialects x factor augmented copies
    (source_dialect, augmented, augmentation_id). Row-local explode, no shuffle."""
    dialects = dialects or L.AUGMENT_DIALECTS
    src = df.filter(T.has_arabic(F.col(text_col)) & (F.col(text_col) != ""))
    entries = [F.struct(F.lit(None).cast("string").alias("source_dialect"), F.lit(False).alias("augmented"),
                        F.lit(None).cast("int").alias("augmentation_id"), F.col(text_col).alias("__t"))]
    for d in dialects:
        for i in range(factor):
            key = F.concat(F.col(key_col).cast("string"), F.lit(f"|a{i}"))
            entries.append(F.struct(F.lit(d).alias("source_dialect"), F.lit(True).alias("augmented"),
                                    F.lit(i).alias("augmentation_id"),
                                    augment_text(F.col(text_col), d, key, seed).alias("__t")))
    others = [c for c in df.columns if c != text_col]
    return src.select(*others, F.explode(F.array(*entries)).alias("__e")) \
        .select(*others, F.col("__e.__t").alias(text_col), "__e.source_dialect", "__e.augmented",
                "__e.augmentation_id")


def validation_issues(tagged: DataFrame, text_col: str = "text", min_confidence: float = 0.5) -> DataFrame:
    """D12 (issues): the tagged rows that are not Arabic, or whose dialect is uncertain, with ``issue``."""
    arabic = T.has_arabic(text_col)
    issue = F.when(~arabic, F.lit("non_arabic")).when(F.col("confidence") < min_confidence, F.lit("low_confidence"))
    return tagged.withColumn("issue", issue).filter(F.col("issue").isNotNull())


def validation_summary(tagged: DataFrame, text_col: str = "text") -> DataFrame:
    """D12 (statistics) as (section, key, n): all samples, Arabic samples, and
    the dialects of the Arabic ones. One aggregate by (Arabic, dialect)."""
    g = tagged.groupBy(T.has_arabic(text_col).alias("ar"), "dialect").agg(F.count(F.lit(1)).alias("c"))
    totals = g.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total_samples"),
                   F.coalesce(F.sum(F.when(F.col("ar"), F.col("c"))), F.lit(0)).alias("arabic_samples")) \
        .unpivot([], ["total_samples", "arabic_samples"], "key", "n").select(F.lit("samples").alias("section"), "key", "n")
    return totals.unionByName(g.filter("ar").select(F.lit("dialect").alias("section"), F.col("dialect").alias("key"),
                                                    F.col("c").alias("n")))


def augmented_gate(df: DataFrame, original_col: str, augmented_col: str, target: str, min_similarity: float = 0.8,
                   min_confidence: float = 0.7) -> DataFrame:
    """(similarity, reason) of augmented texts; a null reason means valid.

    First the similarity with the original, then the dialect of the augmented
    text: it must be the target, at the confidence asked for. The third test
    of the rule, naturalness, needs a language model.
    """
    keep = [c for c in df.columns]
    t = detect_dialect(df.withColumn("similarity", T.sim(original_col, augmented_col)), augmented_col)
    reason = (F.when(F.col("similarity") < min_similarity, F.lit("low_similarity"))
              .when((F.col("dialect") != target) | (F.col("confidence") < min_confidence), F.lit("inconsistent_dialect")))
    return t.select(*keep, "similarity", "dialect", "confidence", reason.alias("reason"))


def label_check(tagged: DataFrame, expected_col: str, min_confidence: float = 0.7) -> DataFrame:
    """Reason per row: low confidence, mismatch, or null when fine."""
    reason = (F.when(F.col("confidence") < min_confidence, F.lit("low_confidence"))
              .when(F.col("dialect") != F.col(expected_col), F.lit("label_mismatch")))
    return tagged.withColumn("issue", reason)


def dialect_vote(*cols: str) -> Column:
    """Majority label over several label columns; ties -> earliest column.
    A row-local array expression: no explode, no shuffle."""
    votes = F.array(*[F.col(c) for c in cols])
    counts = F.transform(votes, lambda v: F.size(F.filter(votes, lambda x: x == v)))
    return F.element_at(votes, F.array_position(counts, F.array_max(counts)).cast("int"))


def gated_convert(tagged: DataFrame, text_col: str, key_col: str, target: str, min_confidence: float = 0.8,
                  seed: int = 42) -> DataFrame:
    """Confident rows (> min) are converted to ``target``; others tagged unknown."""
    ok = F.col("confidence") > min_confidence
    return tagged.withColumn("converted", F.when(ok, augment_text(F.col(text_col), target, F.col(key_col), seed))) \
        .withColumn("convert_status", F.when(ok, F.lit(target)).otherwise(F.lit("unknown")))


def general_augment(df: DataFrame, text_col: str, key_col: str, seed: int = 42,
                    synonym_prob: float = L.SYNONYM_PROB, paraphrase_prob: float = L.PARAPHRASE_PROB,
                    noise_prob: float = L.NOISE_PROB, noise: bool = True) -> DataFrame:
    """Synonym swap, paraphrase prefix and character noise; emits the
    original plus every variant that differs from it."""
    key = F.col(key_col).cast("string")
    text = F.col(text_col)

    def swap(w, i):
        expr = w
        k = F.concat(key, F.lit("|s"), i.cast("string"))
        for word, choices in reversed(list(L.GENERAL_SYNONYMS.items())):
            pick = F.element_at(F.array(*[F.lit(c) for c in choices]),
                                (F.floor(T.u(seed, F.concat(k, F.lit("c"))) * len(choices)) + 1).cast("int"))
            expr = F.when((w == word) & T.u_below(seed, k, synonym_prob), pick).otherwise(expr)
        return F.when(w.isin(*L.GENERAL_SYNONYMS), expr).otherwise(w)
    synonym = F.array_join(F.transform(T.py_words(text), swap), " ")
    tpl = F.element_at(F.array(*[F.lit(t) for t in L.PARAPHRASE_TEMPLATES]),
                       (F.floor(T.u(seed, F.concat(key, F.lit("|pt"))) * len(L.PARAPHRASE_TEMPLATES)) + 1).cast("int"))
    paraphrase = F.when(T.u(seed, F.concat(key, F.lit("|p"))) < paraphrase_prob,
                        F.replace(tpl, F.lit("{x}"), text)).otherwise(text)

    def noisy(ch, i, front):
        at = F.concat(front, i.cast("string"))
        dup = F.when(T.u_below(seed, F.concat(at, F.lit("d")), 0.5), F.concat(ch, ch)).otherwise(F.lit(""))
        return F.when(T.u_below(seed, at, noise_prob), dup).otherwise(ch)
    chars = F.array_remove(F.split(text, ""), "")
    noised = T.once(F.concat(key, F.lit("|n")), lambda front: F.array_join(F.transform(chars, lambda ch, i: noisy(ch, i, front)), ""))
    variants = [F.struct(F.lit("original").alias("variant"), text.alias("__t"))]
    variants.append(F.struct(F.lit("synonym").alias("variant"), synonym.alias("__t")))
    variants.append(F.struct(F.lit("paraphrase").alias("variant"), paraphrase.alias("__t")))
    if noise:
        variants.append(F.struct(F.lit("noise").alias("variant"), noised.alias("__t")))
    others = [c for c in df.columns if c != text_col]
    out = df.select(*others, text.alias("__orig"), F.explode(F.array(*variants)).alias("__e")) \
        .select(*others, "__orig", F.col("__e.variant").alias("variant"), F.col("__e.__t").alias(text_col))
    return out.filter((F.col("variant") == "original") | (F.col(text_col) != F.col("__orig"))).drop("__orig")
