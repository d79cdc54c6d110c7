"""Text scalar function queries (C*): one projection per function family."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as L
from ..functions import text as T
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register

VIEW_FNS = {"ar_docs": TB.ar_docs, "pairs": TB.pairs, "sft": TB.sft, "kto": TB.kto}
KEYS = {"ar_docs": ["doc_id"], "pairs": ["id"], "sft": ["conv_id", "turn"], "kto": ["id"]}


def r6(c):
    return F.round(c, 6)


def proj(name: str, view: str, spark_cols: dict, sql_cols: dict, where_spark=None, where_sql: str | None = None,
         rounded: tuple = ()):
    """Register a per-row projection query over a view, with its SQL twin."""
    keys = KEYS[view]

    def spark_fn(spark, sf):
        df = VIEW_FNS[view](spark, sf)
        if where_spark is not None:
            df = df.filter(where_spark())
        cols = {k: v() for k, v in spark_cols.items()}
        return df.select(*keys, *[(r6(c) if k in rounded else c).alias(k) for k, c in cols.items()])

    def sql_fn():
        cols = ", ".join(f"{S.rnd(v) if k in rounded else v} AS {k}" for k, v in sql_cols.items())
        where = f" WHERE {where_sql}" if where_sql else ""
        return S.with_views(f"SELECT {', '.join(keys)}, {cols} FROM {view}{where}", view)

    register(name, sql_fn)(spark_fn)




# C1 --------------------------------------------------------------------------
proj("c1_has_arabic", "ar_docs", {"has_arabic": lambda: T.has_arabic("text")},
     {"has_arabic": S.has_arabic("text")})

# C2 --------------------------------------------------------------------------
proj("c2_clean_text", "ar_docs",
     {"default_md5": lambda: F.md5(T.clean_text("text")),
      "all_flags_md5": lambda: F.md5(T.clean_text("text", True, True, True, True)),
      "no_ws_md5": lambda: F.md5(T.clean_text("text", False, False, True, False))},
     {"default_md5": f"md5({S.clean_text('text')})",
      "all_flags_md5": f"md5({S.clean_text('text', True, True, True, True)})",
      "no_ws_md5": f"md5({S.clean_text('text', False, False, True, False)})"})

# C3 --------------------------------------------------------------------------
proj("c3_normalize_dialect", "ar_docs", {"normalized_md5": lambda: F.md5(T.normalize_dialect(F.lower(F.col("text")))),
                                         "normalized_len": lambda: F.length(T.normalize_dialect(F.lower(F.col("text")))).cast("long")},
     {"normalized_md5": f"md5({S.normalize_dialect('lower(text)')})",
      "normalized_len": f"CAST(length({S.normalize_dialect('lower(text)')}) AS BIGINT)"})


# C4 --------------------------------------------------------------------------
def _norm_ar_sql(x):
    y = S.rr(x, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]")
    y = S.rr(y, r"\x{0640}")
    y = f"translate({y}, 'إآا', 'أأأ')"
    y = f"translate({y}, {S.q(L.TEH_MARBUTA)}, {S.q(L.TEH)})"
    y = f"translate({y}, {S.q(L.ALEF_MAKSURA)}, {S.q(L.YEH)})"
    return S.strip(S.rr(y, S.WS_RUN, " "))


proj("c4_normalize_arabic", "ar_docs", {"normalized_md5": lambda: F.md5(T.normalize_arabic("text"))},
     {"normalized_md5": f"md5({_norm_ar_sql('text')})"})

# C6 --------------------------------------------------------------------------
proj("c6_encoding_issues", "ar_docs",
     {"question_marks_with_arabic": lambda: F.array_contains(T.encoding_issues("text"), "question_marks_with_arabic"),
      "rtl_ltr_override": lambda: F.array_contains(T.encoding_issues("text"), "rtl_ltr_override"),
      "unicode_encode_error": lambda: F.array_contains(T.encoding_issues("text"), "unicode_encode_error"),
      "fixed_md5": lambda: F.md5(T.fix_encoding("text"))},
     {"unicode_encode_error": "false",
      "question_marks_with_arabic": f"(contains(text, '?') AND regexp_matches(text, {S.q('[' + L.AR5 + ']')}))",
      "rtl_ltr_override": r"regexp_matches(text, '[\x{202D}\x{202E}]')",
      "fixed_md5": f"md5(replace(replace({S.rr('text', r'[\x{202D}\x{202E}\x{200B}-\x{200D}]')}, chr(216) || chr(167), chr(1575)), "
                   "chr(217) || chr(8230), chr(1605)))"})

# C7 --------------------------------------------------------------------------
proj("c7_fix_common_issues", "ar_docs",
     {"fixed_md5": lambda: F.md5(T.fix_common_issues("text"))},
     {"fixed_md5": f"md5({S.strip(S.rr(S.rr('text', r'\x{0000}'), S.WS_RUN, ' '))})"},
     where_spark=lambda: F.coalesce(F.length(T.py_strip("text")), F.lit(0)) > 0,
     where_sql=f"coalesce(length({S.strip('text')}), 0) > 0")

# C8 --------------------------------------------------------------------------
proj("c8_truncate_text", "ar_docs",
     {"short": lambda: T.truncate_text("text", 20), "medium": lambda: T.truncate_text("text", 100)},
     {"short": "CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 17) || '...' END",
      "medium": "CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END"})

# C9 --------------------------------------------------------------------------
proj("c9_arabic_ratio", "ar_docs",
     {"ratio_alpha": lambda: T.arabic_ratio_alpha("text"), "ratio_nonspace": lambda: T.arabic_ratio_nonspace("text"),
      "ratio_block_alpha": lambda: T.arabic_ratio_block_alpha("text")},
     {"ratio_alpha": S.arabic_ratio_alpha("text"), "ratio_nonspace": S.arabic_ratio_nonspace("text"),
      "ratio_block_alpha": S.arabic_ratio_block_alpha("text")},
     rounded=("ratio_alpha", "ratio_nonspace", "ratio_block_alpha"))


# C10 -------------------------------------------------------------------------
def _c10_sql():
    letters = S.letter_count("text")
    ratio = f"CAST({S.arabic_letter_count('text', L.AR1)} AS DOUBLE) / {letters}"
    reason = (f"CASE WHEN {S.lenx('text')} = 0 THEN 'empty' WHEN {letters} = 0 THEN 'no_letters' "
              f"WHEN {ratio} < 0.5 THEN 'low_arabic' ELSE 'valid' END")
    return S.with_views(f"SELECT doc_id, {reason} = 'valid' AS valid, {reason} AS reason, "
                        f"{S.rnd(f'CASE WHEN {letters} > 0 THEN {ratio} ELSE 0.0 END')} AS ratio FROM ar_docs",
                        "ar_docs")


@register("c10_content_validity", _c10_sql)
def c10_content_validity(spark, sf):
    v = TB.ar_docs(spark, sf).select("doc_id", T.content_validity("text").alias("v"))
    return v.select("doc_id", "v.valid", "v.reason", r6(F.col("v.ratio")).alias("ratio"))


# C11-C16 ---------------------------------------------------------------------
proj("c11_special_char_ratio", "ar_docs", {"special_ratio": lambda: T.special_char_ratio("text")},
     {"special_ratio": S.special_char_ratio("text")}, rounded=("special_ratio",))
proj("c12_word_repetition", "ar_docs", {"repetition": lambda: T.word_repetition_ratio("text")},
     {"repetition": S.word_repetition_ratio("text")}, rounded=("repetition",))
proj("c13_trigram_repetition", "ar_docs", {"trigram_repetition": lambda: T.trigram_repetition("text")},
     {"trigram_repetition": S.trigram_repetition("text")}, rounded=("trigram_repetition",))
proj("c14_normalized_hash", "ar_docs", {"norm_hash": lambda: T.normalized_hash("text")},
     {"norm_hash": S.normalized_hash("text")})
proj("c15_shingles", "ar_docs",
     {"n_shingles": lambda: F.size(T.shingles("text")).cast("long"),
      "shingle_digest": lambda: F.md5(F.array_join(F.array_sort(T.shingles("text")), "\u0001"))},
     {"n_shingles": f"CAST(len({S.shingles('text')}) AS BIGINT)",
      "shingle_digest": f"md5(array_to_string(list_sort({S.shingles('text')}), chr(1)))"})
proj("c16_jaccard", "pairs",
     {"word_jaccard": lambda: T.sim("chosen", "rejected"),
      "shingle_jaccard": lambda: T.jaccard(T.shingles("chosen"), T.shingles("rejected"), 0.0)},
     {"word_jaccard": S.sim("chosen", "rejected"),
      "shingle_jaccard": S.jaccard(S.shingles("chosen"), S.shingles("rejected"), 0.0)},
     rounded=("word_jaccard", "shingle_jaccard"))

# C17-C21 ---------------------------------------------------------------------
proj("c17_classify_instruction", "sft", {"instruction_type": lambda: T.classify_instruction("instruction")},
     {"instruction_type": S.classify_instruction("instruction")})
proj("c18_format_compliance", "sft", {"compliance": lambda: T.format_compliance("instruction", "response")},
     {"compliance": S.format_compliance("instruction", "response")}, rounded=("compliance",))
proj("c19_response_quality", "sft", {"quality_score": lambda: T.response_quality("response")},
     {"quality_score": S.response_quality("response")}, rounded=("quality_score",))
proj("c20_quality", "pairs", {"q_chosen": lambda: T.quality("chosen"), "q_rejected": lambda: T.quality("rejected")},
     {"q_chosen": S.quality("chosen"), "q_rejected": S.quality("rejected")}, rounded=("q_chosen", "q_rejected"))
proj("c21_arabic_quality", "ar_docs", {"arabic_quality": lambda: T.arabic_quality("text")},
     {"arabic_quality": S.arabic_quality("text")}, rounded=("arabic_quality",))


# C22 -------------------------------------------------------------------------
def _c22_sql():
    feats = S.feature_list("chosen")
    mx = "greatest(" + ", ".join(feats) + ")"
    cols = ", ".join(f"{S.rnd(f'CASE WHEN {mx} = 0 THEN 0.0 ELSE CAST({f} AS DOUBLE) / {mx} END')} AS f{i + 1}"
                     for i, f in enumerate(feats))
    return S.with_views(f"SELECT id, {cols}, CAST(128 AS BIGINT) AS dim FROM pairs", "pairs")


@register("c22_feature_vector", _c22_sql)
def c22_feature_vector(spark, sf):
    v = TB.pairs(spark, sf).select("id", T.feature_vector("chosen").alias("v"))
    return v.select("id", *[r6(F.element_at("v", i + 1)).alias(f"f{i + 1}") for i in range(8)],
                    F.size("v").cast("long").alias("dim"))


# C23 -------------------------------------------------------------------------
def _vec_pairs(spark, sf):
    e = TB.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    return a.join(b, "vec_id")


def _c23_sql():
    dot = "list_reduce(list_transform(list_zip(a, b), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0)"
    na = "sqrt(list_reduce(list_transform(a, lambda x: x * x), lambda x, y: x + y, 0.0))"
    nb = "sqrt(list_reduce(list_transform(b, lambda x: x * x), lambda x, y: x + y, 0.0))"
    eu = "sqrt(list_reduce(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y, 0.0))"
    man = "list_reduce(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])), lambda x, y: x + y, 0.0)"
    cos = f"CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE {dot} / ({na} * {nb}) END"
    body = (f"SELECT vec_id, {S.rnd(cos)} AS cosine, {S.rnd(eu)} AS euclidean, {S.rnd(man)} AS manhattan, "
            f"{S.rnd(f'(({cos}) - ({eu}) / 10.0 + ({man}) / 100.0) / 0.5')} AS combined FROM "
            "(SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b "
            "FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) z")
    return body


@register("c23_vector_similarity", _c23_sql)
def c23_vector_similarity(spark, sf):
    p = _vec_pairs(spark, sf)
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", r6(T.cosine(a, b)).alias("cosine"), r6(T.euclidean(a, b)).alias("euclidean"),
                    r6(T.manhattan(a, b)).alias("manhattan"),
                    r6(T.combined_similarity(a, b, 0.5)).alias("combined"))


# C24 -------------------------------------------------------------------------
proj("c24_length_normalization", "pairs",
     {f"q_{m}": (lambda m=m: T.length_normalized_quality(T.quality("chosen"), F.length("chosen"), m))
      for m in ("none", "sqrt", "log", "linear")},
     {f"q_{m}": S.length_normalized_quality(S.quality("chosen"), "length(chosen)", m)
      for m in ("none", "sqrt", "log", "linear")},
     rounded=("q_none", "q_sqrt", "q_log", "q_linear"))


# C25 -------------------------------------------------------------------------
def _c25_sql():
    body = (f"SELECT id, {S.rnd(S.length_normalized_quality('qc', 'lc', 'adaptive', 'mean_len', 'std_len'))} AS q_adaptive, "
            f"{S.rnd('qc / (CASE WHEN lc <= p25 THEN 1.0 WHEN lc <= p50 THEN 1.0 + (lc - p25) / (p50 - p25) * 0.1 '
                     'WHEN lc <= p75 THEN 1.1 + (lc - p50) / (p75 - p50) * 0.2 ELSE 1.3 + (lc - p75) / greatest(p75, 1.0) * 0.3 END)')} "
            "AS q_percentile, "
            f"{S.rnd('qc / (CASE WHEN pr > 80 THEN 1.0 + (pr - 80) / 20.0 * 0.5 WHEN pr < 20 THEN 1.0 - (20 - pr) / 20.0 * 0.2 ELSE 1.0 END)')} "
            "AS q_rank FROM (SELECT id, qc, CAST(lc AS DOUBLE) AS lc, "
            "(SELECT count(*) FROM lens l2 WHERE l2.len < p.lc) * 100.0 / (SELECT count(*) FROM lens) AS pr "
            "FROM (SELECT id, " + S.quality("chosen") + " AS qc, length(chosen) AS lc FROM pairs) p) x, "
            "(SELECT avg(len) AS mean_len, stddev_pop(len) AS std_len, quantile_cont(len, 0.25) AS p25, "
            "quantile_cont(len, 0.5) AS p50, quantile_cont(len, 0.75) AS p75 FROM lens) st")
    return S.with_views(body, "pairs", extra=[("lens", "SELECT CAST(length(chosen) AS DOUBLE) AS len FROM pairs "
                                                       "UNION ALL SELECT CAST(length(rejected) AS DOUBLE) FROM pairs")])


@register("c25_adaptive_normalization", _c25_sql)
def c25_adaptive_normalization(spark, sf):
    """Dataset length statistics are one aggregate row (broadcast); the
    percentile rank of each length is count(len < x) / n, computed from the
    length histogram with a running sum instead of a per-row scan."""
    p = TB.pairs(spark, sf)
    lens = p.select(F.length("chosen").cast("double").alias("len")).unionByName(
        p.select(F.length("rejected").cast("double").alias("len")))
    st = lens.agg(F.avg("len").alias("mean_len"), F.stddev_pop("len").alias("std_len"),
                  F.percentile("len", 0.25).alias("p25"), F.percentile("len", 0.5).alias("p50"),
                  F.percentile("len", 0.75).alias("p75"), F.count(F.lit(1)).alias("n"))
    hist = lens.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    below = hist.select(F.col("len").alias("lc"),
                        F.coalesce(F.sum("c").over(W.orderBy("len").rowsBetween(W.unboundedPreceding, -1)),
                                   F.lit(0)).alias("below"))
    base = p.select("id", T.quality("chosen").alias("qc"), F.length("chosen").cast("double").alias("lc"))
    j = base.join(below, "lc").crossJoin(F.broadcast(st))
    pr = F.col("below") * 100.0 / F.col("n")
    return j.select(
        "id",
        r6(T.length_normalized_quality(F.col("qc"), F.col("lc"), "adaptive", F.col("mean_len"), F.col("std_len")))
        .alias("q_adaptive"),
        r6(F.col("qc") / T.percentile_factor(F.col("lc"), F.col("p25"), F.col("p50"), F.col("p75"))).alias("q_percentile"),
        r6(F.col("qc") / T.rank_factor(pr)).alias("q_rank"))


# C26-C29 ---------------------------------------------------------------------
proj("c26_length_bias", "pairs", {"length_bias": lambda: T.length_bias("chosen", "rejected")},
     {"length_bias": S.length_bias("chosen", "rejected")}, rounded=("length_bias",))
proj("c27_kto_utility", "kto",
     {"utility": lambda: T.kto_utility(T.quality("completion"), F.col("label") == 1)},
     {"utility": f"CASE WHEN label = 1 THEN pow({S.quality('completion')}, 0.88) "
                 f"ELSE -2.25 * pow(1.0 - {S.quality('completion')}, 0.88) END"}, rounded=("utility",))
proj("c28_preference_strength", "pairs",
     {"dpo_strength": lambda: T.dpo_strength("chosen", "rejected"),
      "ipo_strength": lambda: T.ipo_strength("chosen", "rejected")},
     {"dpo_strength": S.dpo_strength("chosen", "rejected"), "ipo_strength": S.ipo_strength("chosen", "rejected")},
     rounded=("dpo_strength", "ipo_strength"))


def _c29_sql():
    s = "CAST(len AS DOUBLE)"
    dur = (f"CASE WHEN {s} < 60 THEN printf('%.2fs', {s}) WHEN {s} < 3600 THEN printf('%dm %.1fs', "
           f"CAST(floor({s} / 60) AS BIGINT), fmod({s}, 60)) ELSE printf('%dh %dm %.1fs', CAST(floor({s} / 3600) AS BIGINT), "
           f"CAST(floor(fmod({s}, 3600) / 60) AS BIGINT), fmod({s}, 60)) END")
    units = ["B", "KB", "MB", "GB", "TB"]
    byt = "CASE " + " ".join(f"WHEN {s} / {1024.0 ** i} < 1024.0 THEN printf('%.2f {u}', {s} / {1024.0 ** i})"
                             for i, u in enumerate(units)) + f" ELSE printf('%.2f PB', {s} / {1024.0 ** 5}) END"
    return S.with_views(f"SELECT doc_id, {dur} AS duration, {byt} AS size, "
                        "CASE WHEN n_words = 0 THEN 0.0 ELSE round(len / n_words, 6) END AS chars_per_word, "
                        "lower(replace(source, '-', '_')) || '_' || lower(replace(lang, '-', '_')) AS experiment "
                        f"FROM (SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) * 7 AS len, {S.nwords('text')} AS n_words "
                        "FROM documents) d")


@register("c29_formatting_helpers", _c29_sql)
def c29_formatting_helpers(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", "source", "lang",
                                                (F.col("n_chars").cast("long") * 7).alias("len"),
                                                T.word_count("text").alias("n_words"))
    return d.select("doc_id", T.format_duration(F.col("len")).alias("duration"), T.format_bytes(F.col("len")).alias("size"),
                    r6(T.safe_divide(F.col("len"), F.col("n_words"))).alias("chars_per_word"),
                    F.concat_ws("_", F.lower(F.replace("source", F.lit("-"), F.lit("_"))),
                                F.lower(F.replace("lang", F.lit("-"), F.lit("_")))).alias("experiment"))


# C30-C31 ---------------------------------------------------------------------
proj("c30_diacritic_counts", "ar_docs",
     {"diacritics": lambda: T.diacritic_count("text").cast("long"),
      "diacritized_words": lambda: F.size(F.filter(T.diacritized_word_flags("text"), lambda x: x)).cast("long")},
     {"diacritics": f"CAST({S.char_count('text', L.HARAKAT)} AS BIGINT)",
      "diacritized_words": f"CAST(len(list_filter({S.words('text')}, lambda w: regexp_matches(w, {S.q('[' + L.HARAKAT + ']')}))) AS BIGINT)"})
proj("c31_numeral_conversion", "ar_docs",
     {"eastern_md5": lambda: F.md5(T.western_to_arabic_digits(F.col("text"))),
      "roundtrip_ok": lambda: T.arabic_to_western_digits(T.western_to_arabic_digits(F.col("text"))) == F.col("text")},
     {"eastern_md5": f"md5(translate(text, '0123456789', {S.q(T.ARABIC_DIGITS)}))",
      "roundtrip_ok": f"translate(translate(text, '0123456789', {S.q(T.ARABIC_DIGITS)}), {S.q(T.ARABIC_DIGITS)}, '0123456789') = text"})
