"""Dialect queries (D*) over the Arabised documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialect as D
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def tagged_docs(spark, sf):
    return D.detect_dialect(TB.ar_docs(spark, sf))


def _tagged_sql():
    return S.detect_dialect_select("ar_docs", keep="doc_id, text, lang, source")


# D1 ------------------------------------------------------------------------
def _d1_sql():
    return S.with_views(f"SELECT doc_id, dialect, {S.rnd('confidence')} AS confidence FROM tagged",
                        "ar_docs", extra=[("tagged", _tagged_sql())])


@register("d1_detect_dialect", _d1_sql)
def d1_detect_dialect(spark, sf):
    return tagged_docs(spark, sf).select("doc_id", "dialect", _r("confidence").alias("confidence"))


# D6 ------------------------------------------------------------------------
def _d6_sql():
    body = (
        "SELECT dialect, n, total_samples, "
        f"{S.rnd('n / total_samples * 100.0')} AS pct, {S.rnd('average_confidence')} AS average_confidence, "
        f"{S.rnd('confidence_std')} AS confidence_std FROM "
        "(SELECT dialect, count(*) AS n FROM tagged WHERE text IS NOT NULL AND text <> '' GROUP BY dialect) p "
        "CROSS JOIN (SELECT count(*) AS total_samples, "
        "coalesce(avg(CASE WHEN text IS NOT NULL AND text <> '' THEN confidence END), 0.0) AS average_confidence, "
        "coalesce(stddev_pop(CASE WHEN text IS NOT NULL AND text <> '' THEN confidence END), 0.0) AS confidence_std "
        "FROM tagged) t")
    return S.with_views(body, "ar_docs", extra=[("tagged", _tagged_sql())])


@register("d6_analyze_dialects", _d6_sql)
def d6_analyze_dialects(spark, sf):
    a = D.analyze_dialects(tagged_docs(spark, sf))
    return a.select("dialect", "n", "total_samples", _r("pct").alias("pct"),
                    _r("average_confidence").alias("average_confidence"),
                    _r("confidence_std").alias("confidence_std"))


def _tagged_full_sql():
    return S.detect_dialect_select("ar_docs", keep="doc_id, text, lang, source, kind")


def _views(body, *extra):
    return S.with_views(body, "ar_docs", extra=[("tagged", _tagged_full_sql()), *extra])


NB = "text IS NOT NULL AND text <> ''"


# D2 ------------------------------------------------------------------------
def _d2_sql():
    low = "lower(text)"

    def hits(terms):
        return "(" + " + ".join(f"CAST(contains({low}, {S.q(t)}) AS INTEGER)" for t in terms) + ")"
    from ..functions import lexicon as L
    sc = {"msa": hits(L.EVAL_FORMAL_INDICATORS) + " * 2"}
    for d in L.EVAL_DIALECT_ORDER:
        sc[d] = hits(L.EVAL_DIALECT_MARKERS[d])
    order = ["msa"] + L.EVAL_DIALECT_ORDER
    best = "greatest(" + ", ".join(f"s_{d}" for d in order) + ")"
    case = "CASE " + " ".join(f"WHEN s_{d} = {best} THEN '{d}'" for d in order) + " ELSE 'msa' END"
    inner = "SELECT doc_id, " + ", ".join(f"{sc[d]} AS s_{d}" for d in order) + " FROM ar_docs"
    return S.with_views(f"SELECT doc_id, {case} AS eval_dialect FROM ({inner}) x", "ar_docs")


@register("d2_evaluator_dialect", _d2_sql)
def d2_evaluator_dialect(spark, sf):
    return TB.ar_docs(spark, sf).select("doc_id", D.evaluator_dialect(F.col("text")).alias("eval_dialect"))


# D3 ------------------------------------------------------------------------
def _d3_sql():
    from ..functions import lexicon as L
    sc = S.dialect_score_sql("__norm")
    total = "(" + " + ".join(f"s_{d}" for d in L.DIALECT_ORDER) + ")"
    inner = ("SELECT doc_id, text, " + ", ".join(f"{sc[d]} AS s_{d}" for d in L.DIALECT_ORDER) +
             f" FROM (SELECT doc_id, text, {S.normalize_dialect('lower(text)')} AS __norm FROM ar_docs) n")
    cols = ", ".join(
        f"{S.rnd(f'CASE WHEN {S.has_arabic('text')} AND {total} > 0 THEN s_{d} / {total} ELSE 0.0 END')} AS p_{d}"
        for d in L.DIALECT_ORDER)
    return S.with_views(f"SELECT doc_id, {cols} FROM ({inner}) x", "ar_docs")


@register("d3_dialect_probabilities", _d3_sql)
def d3_dialect_probabilities(spark, sf):
    from ..functions import lexicon as L
    p = D.dialect_probabilities(TB.ar_docs(spark, sf).select("doc_id", "text"))
    return p.select("doc_id", *[_r(f"p_{d}").alias(f"p_{d}") for d in L.DIALECT_ORDER])


# D4 / D5 -------------------------------------------------------------------
def _d4_sql():
    body = ("SELECT doc_id, " + ", ".join(
        f"{S.augment_text('text', d, 'doc_id', 42, r)} AS {d}_{tag}"
        for d in ("egyptian", "levantine", "gulf") for r, tag in ((0.3, "r30"), (1.0, "all"))) +
        f" FROM ar_docs WHERE {S.has_arabic('text')}")
    return S.with_views(body, "ar_docs")


@register("d4_augment_text", _d4_sql)
def d4_augment_text(spark, sf):
    a = TB.ar_docs(spark, sf).filter(T.has_arabic("text"))
    return a.select("doc_id", *[D.augment_text(F.col("text"), d, F.col("doc_id"), 42, r).alias(f"{d}_{tag}")
                                for d in ("egyptian", "levantine", "gulf")
                                for r, tag in ((0.3, "r30"), (1.0, "all"))])


def _d5_sql():
    from ..functions import lexicon as L
    parts = [f"SELECT doc_id, {S.q(d)} AS target_dialect, {S.augment_text('text', d, 'doc_id')} AS variant "
             f"FROM ar_docs WHERE {S.has_arabic('text')}" for d in L.AUGMENT_DIALECTS]
    return S.with_views(" UNION ALL ".join(parts), "ar_docs")


@register("d5_dialect_variants", _d5_sql)
def d5_dialect_variants(spark, sf):
    a = TB.ar_docs(spark, sf).filter(T.has_arabic("text")).select("doc_id", "text")
    return D.dialect_variants(a, "text", "doc_id").select("doc_id", "target_dialect", "variant")


# D6 examples (G12) ---------------------------------------------------------
def _d6x_sql():
    ex = "CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END"
    return _views(f"SELECT dialect, rank, doc_id, example, {S.rnd('confidence')} AS confidence FROM ("
                  f"SELECT dialect, row_number() OVER (PARTITION BY dialect ORDER BY doc_id) AS rank, doc_id, "
                  f"{ex} AS example, confidence FROM tagged WHERE {NB}) x WHERE rank <= 5")


@register("d6_dialect_examples", _d6x_sql)
def d6_dialect_examples(spark, sf):
    ex = D.dialect_examples(tagged_docs(spark, sf))
    return ex.select("dialect", F.col("rank").cast("long").alias("rank"), "doc_id", "example",
                     _r("confidence").alias("confidence"))


# D7 ------------------------------------------------------------------------
BAL_TARGET = 60


def _balance_sql(target_sql: str, counts_from: str = "keep") -> list[tuple[str, str]]:
    return [
        ("keep", f"SELECT *, {S.u(42, 'doc_id')} AS __u FROM tagged WHERE {NB} AND confidence > 0.3"),
        ("counts", f"SELECT dialect, count(*) AS n, {target_sql} AS target FROM {counts_from} GROUP BY dialect"),
        ("ranked", "SELECT k.*, row_number() OVER (PARTITION BY k.dialect ORDER BY __u, doc_id) AS __rn, c.n, c.target "
                   "FROM keep k JOIN counts c USING (dialect)"),
        ("need", f"SELECT dialect, copy_id, CAST(floor({S.u(42, 'concat(dialect, ' + S.q('|') + ', CAST(copy_id AS VARCHAR))')}"
                 " * n) + 1 AS BIGINT) AS __rn FROM (SELECT dialect, n, unnest(range(1, target - n + 1)) AS copy_id "
                 "FROM counts WHERE n < target AND n > 0) z"),
    ]


def _balance_body():
    key = "concat(CAST(r.doc_id AS VARCHAR), '|c', CAST(n.copy_id AS VARCHAR))"
    aug = S.augment_for("r.text", "r.dialect", key)
    return ("SELECT doc_id, dialect, false AS augmented, CAST(0 AS BIGINT) AS copy_id, md5(text) AS text_md5 "
            "FROM ranked WHERE __rn <= target OR n < target UNION ALL "
            f"SELECT r.doc_id, r.dialect, true AS augmented, n.copy_id, md5({aug}) AS text_md5 "
            "FROM ranked r JOIN need n ON r.dialect = n.dialect AND r.__rn = n.__rn")


@register("d7_balance_by_dialect", lambda: _views(_balance_body(), *_balance_sql(str(BAL_TARGET))))
def d7_balance_by_dialect(spark, sf):
    b = D.balance_by_dialect(tagged_docs(spark, sf), "doc_id", target=BAL_TARGET, texts=TB.ar_docs(spark, sf))
    return b.select("doc_id", "dialect", "augmented", "copy_id", F.md5("text").alias("text_md5"))


# D8 / D19 ------------------------------------------------------------------
@register("d8_split_by_dialect",
          lambda: _views(f"SELECT doc_id, dialect, {S.rnd('confidence')} AS confidence FROM tagged "
                         f"WHERE {NB} AND confidence >= 0.5"))
def d8_split_by_dialect(spark, sf):
    return D.split_by_dialect(tagged_docs(spark, sf)).select("doc_id", "dialect", _r("confidence").alias("confidence"))


MIN_SPLIT = 20


@register("d19_min_size_splits",
          lambda: _views(f"SELECT dialect, count(*) AS n FROM tagged WHERE {NB} AND confidence >= 0.5 "
                         f"GROUP BY dialect HAVING count(*) >= {MIN_SPLIT}"))
def d19_min_size_splits(spark, sf):
    s = D.split_by_dialect(tagged_docs(spark, sf))
    return s.groupBy("dialect").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SPLIT)


# D9 ------------------------------------------------------------------------
def _d9_sql():
    from ..functions import lexicon as L
    parts = [f"SELECT doc_id, CAST(NULL AS VARCHAR) AS source_dialect, false AS augmented, "
             f"CAST(NULL AS INTEGER) AS augmentation_id, md5(text) AS text_md5 FROM src"]
    for d in L.AUGMENT_DIALECTS:
        for i in range(2):
            key = f"concat(CAST(doc_id AS VARCHAR), '|a{i}')"
            parts.append(f"SELECT doc_id, {S.q(d)}, true, {i}, md5({S.augment_text('text', d, key)}) FROM src")
    return S.with_views(" UNION ALL ".join(parts), "ar_docs",
                        extra=[("src", f"SELECT * FROM ar_docs WHERE {S.has_arabic('text')} AND text <> ''")])


@register("d9_augment_with_dialects", _d9_sql)
def d9_augment_with_dialects(spark, sf):
    a = TB.ar_docs(spark, sf).select("doc_id", "text")
    out = D.augment_with_dialects(a, "text", "doc_id", factor=2)
    return out.select("doc_id", "source_dialect", "augmented", "augmentation_id", F.md5("text").alias("text_md5"))


# D11 -----------------------------------------------------------------------
@register("d11_label_check",
          lambda: _views("SELECT doc_id, kind, dialect, CASE WHEN confidence < 0.7 THEN 'low_confidence' "
                         "WHEN dialect <> kind THEN 'label_mismatch' END AS issue FROM tagged "
                         "WHERE kind IN ('egyptian','levantine','gulf','maghrebi','iraqi','msa')"))
def d11_label_check(spark, sf):
    t = tagged_docs(spark, sf).filter(F.col("kind").isin("egyptian", "levantine", "gulf", "maghrebi", "iraqi", "msa"))
    return D.label_check(t, "kind").select("doc_id", "kind", "dialect", "issue")


# D12 -----------------------------------------------------------------------
@register("d12_arabic_validator",
          lambda: _views(f"SELECT doc_id, CASE WHEN NOT {S.has_arabic('text')} THEN 'non_arabic' "
                         "ELSE 'low_confidence' END AS issue, " + S.rnd("confidence") + " AS confidence, "
                         "md5(substr(text, 1, 50)) AS head_md5 FROM tagged "
                         f"WHERE NOT {S.has_arabic('text')} OR confidence < 0.5"))
def d12_arabic_validator(spark, sf):
    return D.validation_issues(tagged_docs(spark, sf)).select(
        "doc_id", "issue", _r("confidence").alias("confidence"), F.md5(F.substring("text", 1, 50)).alias("head_md5"))


@register("d12_validator_summary",
          lambda: _views("SELECT 'samples' AS section, 'total_samples' AS key, count(*) AS n FROM tagged UNION ALL "
                         f"SELECT 'samples', 'arabic_samples', count_if({S.has_arabic('text')}) FROM tagged UNION ALL "
                         f"SELECT 'dialect', dialect, count(*) FROM tagged WHERE {S.has_arabic('text')} GROUP BY dialect"))
def d12_validator_summary(spark, sf):
    return D.validation_summary(tagged_docs(spark, sf))


# D13 -----------------------------------------------------------------------
def _d13_sql():
    inner = _d2_sql().split("\n", 1)
    body = ("SELECT count(*) AS n, "
            f"{S.rnd('avg(CASE WHEN eval_dialect = ' + S.q('msa') + ' THEN 1.0 ELSE 0.0 END)')} AS dialect_accuracy, "
            f"{S.rnd('(SELECT max(c) FROM (SELECT count(*) AS c FROM ev GROUP BY eval_dialect)) / count(*)')} "
            "AS dialect_consistency FROM ev")
    ev = _d2_sql()
    return S.with_views(body, "ar_docs", extra=[("ev", ev.split("\n", 1)[1])])


@register("d13_dialect_accuracy", _d13_sql)
def d13_dialect_accuracy(spark, sf):
    ev = d2_evaluator_dialect(spark, sf)
    per = ev.groupBy("eval_dialect").agg(F.count(F.lit(1)).alias("c"))
    agg = per.agg(F.sum("c").alias("n"), F.max("c").alias("top"),
                  F.sum(F.when(F.col("eval_dialect") == "msa", F.col("c")).otherwise(0)).alias("hits"))
    return agg.select("n", _r(F.col("hits") / F.col("n")).alias("dialect_accuracy"),
                      _r(F.col("top") / F.col("n")).alias("dialect_consistency"))


# D14 -----------------------------------------------------------------------
@register("d14_augmentation_plan",
          lambda: _views("SELECT dialect, n, CAST(greatest(" + str(BAL_TARGET) + " - n, 0) AS BIGINT) AS need, "
                         "CAST(CASE WHEN n < " + str(BAL_TARGET) + " THEN (" + str(BAL_TARGET) +
                         " - n) // n + 1 ELSE 0 END AS BIGINT) AS variations FROM "
                         f"(SELECT dialect, count(*) AS n FROM tagged WHERE {NB} AND confidence > 0.3 GROUP BY dialect) c"))
def d14_augmentation_plan(spark, sf):
    t = tagged_docs(spark, sf)
    nonblank = F.col("text").isNotNull() & (F.col("text") != "")
    c = t.filter(nonblank & (F.col("confidence") > 0.3)).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(BAL_TARGET) - F.col("n"), F.lit(0))
    return c.select("dialect", "n", need.cast("long").alias("need"),
                    F.when(F.col("n") < BAL_TARGET, F.floor((BAL_TARGET - F.col("n")) / F.col("n")) + 1)
                    .otherwise(0).cast("long").alias("variations"))


# D16 -----------------------------------------------------------------------
def _d16_sql():
    tagged = _tagged_full_sql()
    d2 = _d2_sql().split("\n", 1)[1]
    body = ("SELECT t.doc_id, CASE WHEN t.dialect = e.eval_dialect OR t.dialect = t.kind THEN t.dialect "
            "WHEN e.eval_dialect = t.kind THEN e.eval_dialect ELSE t.dialect END AS voted "
            "FROM tagged t JOIN ev e USING (doc_id)")
    return S.with_views(body, "ar_docs", extra=[("tagged", tagged), ("ev", d2)])


@register("d16_dialect_vote", _d16_sql)
def d16_dialect_vote(spark, sf):
    t = tagged_docs(spark, sf).withColumn("eval_dialect", D.evaluator_dialect(F.col("text")))
    return t.select("doc_id", D.dialect_vote("dialect", "eval_dialect", "kind").alias("voted"))


# D17 -----------------------------------------------------------------------
@register("d17_gated_convert",
          lambda: _views("SELECT doc_id, CASE WHEN confidence > 0.8 THEN 'gulf' ELSE 'unknown' END AS convert_status, "
                         f"md5(CASE WHEN confidence > 0.8 THEN {S.augment_text('text', 'gulf', 'doc_id')} END) "
                         "AS converted_md5 FROM tagged"))
def d17_gated_convert(spark, sf):
    g = D.gated_convert(tagged_docs(spark, sf), "text", "doc_id", "gulf")
    return g.select("doc_id", "convert_status", F.md5("converted").alias("converted_md5"))


# D18 -----------------------------------------------------------------------
def _d18_sql():
    ctes = _balance_sql("CAST(floor((SELECT count(*) FROM keep) / (SELECT count(DISTINCT dialect) FROM keep)) AS BIGINT)")
    return _views(_balance_body(), *ctes)


@register("d18_balance_to_distribution", _d18_sql)
def d18_balance_to_distribution(spark, sf):
    """Uniform target distribution: each dialect's quota is floor(total / k)."""
    t = tagged_docs(spark, sf)
    nonblank = F.col("text").isNotNull() & (F.col("text") != "")
    keep = t.filter(nonblank & (F.col("confidence") > 0.3))
    per = keep.groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    quotas = per.select("dialect", F.floor(F.sum("n").over(every) / F.count(F.lit(1)).over(every)).cast("long").alias("target"))
    b = D.balance_by_dialect(t, "doc_id", quotas=quotas, texts=TB.ar_docs(spark, sf))
    return b.select("doc_id", "dialect", "augmented", "copy_id", F.md5("text").alias("text_md5"))


# D20 -----------------------------------------------------------------------
def _d20_sql():
    from ..functions import lexicon as L
    key = "CAST(doc_id AS VARCHAR)"
    k = f"concat({key}, '|s', CAST(i - 1 AS VARCHAR))"
    cases = []
    for word, choices in L.GENERAL_SYNONYMS.items():
        pick = f"{S.lst(choices)}[CAST(floor({S.u(42, f'concat({k}, {S.q(chr(99))})')} * {len(choices)}) + 1 AS INTEGER)]"
        cases.append(f"WHEN w = {S.q(word)} AND {S.u(42, k)} < {L.SYNONYM_PROB} THEN {pick}")
    synonym = f"array_to_string(list_transform({S.words('text')}, lambda w, i: CASE {' '.join(cases)} ELSE w END), ' ')"
    tpl = (f"{S.lst(L.PARAPHRASE_TEMPLATES)}[CAST(floor({S.u(42, f'concat({key}, {S.q(chr(124) + 'pt')})')} * "
           f"{len(L.PARAPHRASE_TEMPLATES)}) + 1 AS INTEGER)]")
    para = f"CASE WHEN {S.u(42, f'concat({key}, {S.q(chr(124) + chr(112))})')} < {L.PARAPHRASE_PROB} THEN replace({tpl}, '{{x}}', text) ELSE text END"
    nk = f"concat({key}, '|n', CAST(i - 1 AS VARCHAR))"
    noise = (f"array_to_string(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda ch, i: "
             f"CASE WHEN {S.u(42, nk)} < {L.NOISE_PROB} AND {S.u(42, f'concat({nk}, {S.q(chr(100))})')} < 0.5 THEN ch || ch "
             f"WHEN {S.u(42, nk)} < {L.NOISE_PROB} THEN '' ELSE ch END), '')")
    body = ("SELECT doc_id, variant, md5(t) AS text_md5 FROM (SELECT doc_id, text, 'original' AS variant, text AS t FROM src "
            f"UNION ALL SELECT doc_id, text, 'synonym', {synonym} FROM src "
            f"UNION ALL SELECT doc_id, text, 'paraphrase', {para} FROM src "
            f"UNION ALL SELECT doc_id, text, 'noise', {noise} FROM src) x WHERE variant = 'original' OR t <> text")
    return S.with_views(body, "ar_docs", extra=[("src", "SELECT doc_id, text FROM ar_docs")])


@register("d20_general_augment", _d20_sql)
def d20_general_augment(spark, sf):
    a = TB.ar_docs(spark, sf).select("doc_id", "text")
    g = D.general_augment(a, "text", "doc_id")
    return g.select("doc_id", "variant", F.md5("text").alias("text_md5"))
