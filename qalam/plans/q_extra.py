"""Remaining registered queries: NFKC (C5), dialect pipeline (D10),
augmented-text filter (D15), overlap metrics (I14), utilisation (I26) and
the corpus readers (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialect as D
from ..operators import hooks as H
from ..operators import metrics as M
from ..sources import io as IO
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


@register("c5_nfkc_clean")
def c5_nfkc_clean(spark, sf):
    """NFKC (Arrow UDF) + Arabic punctuation fold + whitespace clean."""
    from ..functions.udfs import nfkc
    a = TB.ar_docs(spark, sf)
    t = T.clean_text(T.fold_arabic_punctuation(nfkc(F.col("text"))), True, False, False, False)
    return a.select("doc_id", F.md5(t).alias("clean_md5"))


@register("d10_dialect_pipeline")
def d10_dialect_pipeline(spark, sf):
    """Analyse -> balance -> split -> augment -> analyse, with the tagging done
    once per stage input and the per-dialect split counts as the manifest."""
    tagged = D.detect_dialect(TB.ar_docs(spark, sf)).checkpoint()
    balanced = D.balance_by_dialect(tagged, "doc_id", target=60).checkpoint()
    retag = D.detect_dialect(balanced.drop("dialect", "confidence"))
    splits = D.split_by_dialect(retag).groupBy("dialect").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("split").alias("stage"), "dialect", "n")
    aug = D.augment_with_dialects(balanced.select("doc_id", "text"), "text", "doc_id", factor=1)
    after = D.analyze_dialects(D.detect_dialect(aug)).select(F.lit("augmented").alias("stage"), "dialect", "n")
    before = D.analyze_dialects(tagged).select(F.lit("original").alias("stage"), "dialect", "n")
    return before.unionByName(splits).unionByName(after)


def _d15_sql():
    aug = S.augment_text("text", "egyptian", "doc_id", 42, 1.0)
    gated = S.detect_dialect_select("g", "aug", "doc_id, similarity")
    return S.with_views(
        f"SELECT doc_id, {S.rnd('similarity')} AS similarity, dialect, {S.rnd('confidence')} AS confidence, CASE WHEN similarity < "
        "0.8 THEN 'low_similarity' WHEN dialect <> 'egyptian' OR confidence < 0.7 THEN 'inconsistent_dialect' END AS reason FROM gated",
        "ar_docs", extra=[("g", f"SELECT doc_id, aug, {S.sim('text', 'aug')} AS similarity FROM (SELECT doc_id, text, {aug} AS aug "
                                f"FROM ar_docs WHERE {S.has_arabic('text')}) x"), ("gated", gated)])


@register("d15_augmented_filter", _d15_sql)
def d15_augmented_filter(spark, sf):
    """Augmented texts with the reason that rejects them: similarity, then dialect and confidence."""
    a = TB.ar_docs(spark, sf).filter(T.has_arabic("text"))
    g = a.select("doc_id", "text", D.augment_text(F.col("text"), "egyptian", F.col("doc_id"), 42, 1.0).alias("aug"))
    return D.augmented_gate(g, "text", "aug", "egyptian").select(
        "doc_id", F.round("similarity", 6).alias("similarity"), "dialect", F.round("confidence", 6).alias("confidence"), "reason")


def _i14_sql():
    """N-gram counts by group, clipped by the smaller side; BLEU with the brevity penalty of the whole corpus."""
    words = f"SELECT row_number() OVER () AS rid, {S.words('lower(response)')} AS p, {S.words('lower(instruction)')} AS r, " \
            f"CAST({S.strip('lower(response)')} = {S.strip('lower(instruction)')} AS DOUBLE) AS em FROM sft"
    gram = "unnest(list_transform(range(1, len({c}) - n + 2), lambda i: array_to_string({c}[i:i + n - 1], chr(1))))"
    side = "SELECT rid, n, g, count(*) AS c FROM (SELECT rid, n, " + gram + " AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) k) x GROUP BY ALL"
    logs = "sum(ln(greatest(m / greatest(np, 1), 1e-300))) OVER (ORDER BY n) / n"
    return S.with_views(
        "SELECT round(a.em, 6) AS exact_match, round(f.f1, 6) AS token_f1, "
        + ", ".join(f"round(max(CASE WHEN n = {n} THEN bleu END), 6) AS bleu_{n}" for n in (1, 2, 3, 4))
        + ", round(max(CASE WHEN n = 1 THEN rouge END), 6) AS rouge_1, round(max(CASE WHEN n = 2 THEN rouge END), 6) AS rouge_2 FROM ("
        f"SELECT n, m / greatest(nr, 1) AS rouge, CASE WHEN min(m) OVER (ORDER BY n) = 0 THEN 0.0 ELSE CASE WHEN c > r THEN 1.0 ELSE "
        f"exp(1 - r / greatest(c, 1)) END * exp({logs}) END AS bleu FROM t, a) b, a, f GROUP BY a.em, f.f1", "sft",
        extra=[("w", words), ("gp", side.format(c="p")), ("gr", side.format(c="r")),
               ("both_", "SELECT coalesce(gp.rid, gr.rid) AS rid, coalesce(gp.n, gr.n) AS n, coalesce(gp.c, 0) AS cp, coalesce(gr.c, 0) AS cr "
                         "FROM gp FULL JOIN gr ON gp.rid = gr.rid AND gp.n = gr.n AND gp.g = gr.g"),
               ("t", "SELECT n, sum(least(cp, cr))::DOUBLE AS m, sum(cp)::DOUBLE AS np, sum(cr)::DOUBLE AS nr FROM both_ GROUP BY n"),
               ("a", "SELECT avg(em) AS em, sum(len(p))::DOUBLE AS c, sum(len(r))::DOUBLE AS r FROM w"),
               ("f", "SELECT avg(CASE WHEN coalesce(m, 0) = 0 THEN 0.0 ELSE 2 * m / (len(p) + len(r)) END) AS f1 FROM w LEFT JOIN "
                     "(SELECT rid, sum(least(cp, cr))::DOUBLE AS m FROM both_ WHERE n = 1 GROUP BY rid) x USING (rid)")])


@register("i14_overlap_metrics", _i14_sql)
def i14_overlap_metrics(spark, sf):
    s = TB.sft(spark, sf).select(F.concat_ws("_", "conv_id", "turn").alias("rid"), "instruction", "response")
    m = M.overlap_metrics(s, "rid", "response", "instruction")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def _rouge_sql():
    """The plain table of common subsequences, a row of it for each word of the answer."""
    cand = ("list_transform(range(1, len(r) + 2), lambda k: CASE WHEN k > 1 AND p[i + 1] = r[k - 1] THEN row[k - 1] + 1 ELSE row[k] END)")
    return S.with_views(
        "SELECT round(avg(CASE WHEN l > 0 THEN 2 * (l / np) * (l / nr) / (l / np + l / nr) ELSE 0.0 END), 6) AS rouge_l FROM ("
        "SELECT list_max(row)::DOUBLE AS l, greatest(len(p), 1) AS np, greatest(len(r), 1) AS nr FROM dp WHERE i = len(p)) x", "sft",
        extra=[("w", f"SELECT {S.words('lower(response)')} AS p, {S.words('lower(instruction)')} AS r FROM sft"),
               ("dp", "SELECT p, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda k: 0) AS row FROM w UNION ALL SELECT p, r, i + 1, "
                      f"list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (SELECT p, r, i, {cand} AS c FROM dp "
                      "WHERE i < len(p)) y")]).replace("WITH ", "WITH RECURSIVE ", 1)


@register("i14_rouge_l", _rouge_sql)
def i14_rouge_l(spark, sf):
    s = TB.sft(spark, sf)
    return M.rouge_l(s, "response", "instruction").select(F.round("rouge_l", 6).alias("rouge_l"))


def _i26_sql():
    k = "CAST(json_extract(props, '$.k') AS DOUBLE)"
    return ("SELECT event_type, count(*) AS n, round(avg(g.gpu_utilization), 6) AS avg_gpu, round(avg(g.memory_utilization), 6) AS "
            "avg_memory, avg(g.gpu_utilization) < 70 AS low_gpu, avg(g.memory_utilization) < 80 AS low_memory FROM (SELECT "
            f"event_type, unnest([struct_pack(gpu_utilization := {k}, memory_utilization := value), "
            f"struct_pack(gpu_utilization := 100 - {k} / 4, memory_utilization := value / 2)]) AS g FROM events) x GROUP BY event_type")


@register("i26_utilisation_summary", _i26_sql)
def i26_utilisation_summary(spark, sf):
    """Monitoring records with a list of devices each, by event type."""
    k = F.get_json_object("props", "$.k").cast("double")
    dev = lambda g, m: F.struct(g.alias("gpu_utilization"), m.alias("memory_utilization"))
    e = TB.table(spark, sf, "events").select("event_type", F.array(
        dev(k, F.col("value")), dev(100 - k / 4, F.col("value") / 2)).alias("gpus"))
    g = M.utilisation_summary(e, "gpus", ["event_type"])
    return g.select("event_type", "n", F.round("avg_gpu", 6).alias("avg_gpu"), F.round("avg_memory", 6).alias("avg_memory"),
                    "low_gpu", "low_memory")


@register("a1_read_corpus", lambda: "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def a1_read_corpus(spark, sf):
    d = IO.read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _split_sizes():
    return ("SELECT split, n FROM (SELECT n - held AS train, held - CAST(ceil(0.5 * held) AS BIGINT) AS validation, "
            "CAST(ceil(0.5 * held) AS BIGINT) AS test FROM (SELECT count(*) AS n, CAST(ceil(CAST(0.1 + 0.1 AS DOUBLE) * count(*)) AS BIGINT) "
            "AS held FROM documents) x) y UNPIVOT (n FOR split IN (train, validation, test))")


@register("a4_write_split_roundtrip", _split_sizes)
def a4_write_split_roundtrip(spark, sf):
    """G2 split written with partitionBy('split') (A4/A5) and read back."""
    from ..operators.sampling import split
    from ..streaming.jobs import work_dir
    path = work_dir(spark, "splits")
    s = split(TB.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    IO.write_corpus(s, path, "parquet", split_col="split")
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("a6_manifest_roundtrip",
          lambda: "SELECT count(*) AS n, count(*) AS manifest_size, 'labels' AS source, true AS dated FROM labels")
def a6_manifest_roundtrip(spark, sf):
    from ..streaming.jobs import work_dir
    path = work_dir(spark, "manifest")
    d = TB.table(spark, sf, "labels")
    IO.write_with_manifest(d, path, "parquet", source="labels")
    back, manifest = IO.read_with_manifest(spark, path)
    dated = F.current_timestamp() - F.lit(manifest["created_at"]).cast("timestamp") >= F.expr("INTERVAL 0 SECOND")
    return back.agg(F.count(F.lit(1)).alias("n"), F.lit(manifest["size"]).cast("long").alias("manifest_size")).select(
        "n", "manifest_size", F.lit(manifest["flags"]["source"]).alias("source"), dated.alias("dated"))


_INVENTORY = {"documents": "doc_id,text,lang,source,n_chars", "labels": "doc_id,quality,toxic",
              "conversations": "conv_id,turn,role,text"}


def _a10_sql():
    one = ("SELECT '{n}' AS dataset, (SELECT count(*) FROM {n}) AS num_rows, '{c}' AS columns, to_json(struct_pack({f}))::VARCHAR "
           "AS first_row FROM (SELECT * FROM {n} ORDER BY {c} LIMIT 1) x")
    return " UNION ALL ".join(one.format(n=n, c=c, f=", ".join(f"{k} := {k}" for k in c.split(","))) for n, c in _INVENTORY.items())


@register("a10_dataset_inventory", _a10_sql)
def a10_dataset_inventory(spark, sf):
    """Rows, columns and the first row as JSON of three sets."""
    frames = {n: TB.table(spark, sf, n).select(*c.split(",")) for n, c in _INVENTORY.items()}
    return IO.inventory(frames).select("dataset", "num_rows", "columns", "first_row")


def _a11_sql():
    from .q_metrics import _i12_table_sql
    return ("SELECT 'arabic_metrics' AS section, metric, '- **' || metric || '**: ' || CAST(value AS VARCHAR) AS line FROM ("
            + _i12_table_sql() + ") x")


@register("a11_report_lines", _a11_sql)
def a11_report_lines(spark, sf):
    rep = M.unpivot_report(M.arabic_metrics(TB.ar_docs(spark, sf))).withColumn("value", F.round("value", 6)) \
        .withColumn("section", F.lit("arabic_metrics"))
    return IO.report_lines(rep)


def _a11_nested_sql():
    langs = "(SELECT lang, row_number() OVER (ORDER BY lang) AS k, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY lang)"
    line = lambda n, text: f"SELECT {n} AS o, {text} AS line"
    count = lambda c: f"(SELECT CAST({c} AS VARCHAR) FROM documents)"
    parts = [line("0.0", "'## Dataset Analysis'"), line("1.0", f"'- **num_examples**: ' || {count('count(*)')}"),
             line("2.0", "'### text_char_stats'"), line("2.1", f"'- **min_length**: ' || {count('min(length(text))')}"),
             line("2.2", f"'- **max_length**: ' || {count('max(length(text))')}"), line("2.3", "''"), line("3.0", "'### by_language'"),
             f"SELECT 3 + k / 100.0, '#### ' || lang FROM {langs}", f"SELECT 3 + k / 100.0 + 0.001, '- **docs**: ' || docs FROM {langs}",
             f"SELECT 3 + k / 100.0 + 0.002, '- **chars**: ' || chars FROM {langs}", f"SELECT 3 + k / 100.0 + 0.003, '' FROM {langs}",
             line("3.99", "''"), line("4.0", "'- **sources**: ' || (SELECT '[' || string_agg(source, ', ' ORDER BY source) || ']' FROM "
                                             "(SELECT DISTINCT source FROM documents))"), line("5.0", "''")]
    return f"SELECT row_number() OVER (ORDER BY o) AS number, line FROM ({' UNION ALL '.join(parts)}) x"


@register("a11_nested_report", _a11_nested_sql)
def a11_nested_report(spark, sf):
    """A report of values, a section, a section by language with sections of its own, and a list; lines numbered by place."""
    from ..operators.ranking import global_row_number
    d = TB.table(spark, sf, "documents")
    per = d.groupBy("lang").agg(F.struct(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")).alias("s"))
    langs = per.agg(F.map_from_entries(F.collect_list(F.struct("lang", "s"))).alias("by_language"))  # a row per language
    rep = d.agg(F.count(F.lit(1)).alias("num_examples"), F.struct(F.min(F.length("text")).alias("min_length"),
                                                                  F.max(F.length("text")).alias("max_length")).alias("text_char_stats"),
                F.array_sort(F.collect_set("source")).alias("sources"))
    lines = IO.nested_report_lines(rep.crossJoin(langs).select("num_examples", "text_char_stats", "by_language", "sources"))
    return global_row_number(lines, ["place"], "number").select("number", "line")


@register("a12_file_hashes")
def a12_file_hashes(spark, sf):
    return IO.file_hashes(spark, f"{sf.rstrip('/')}/*.parquet").select("path", "length", "md5", "sha256")


def _work(spark, name):
    from ..streaming.jobs import work_dir
    return work_dir(spark, name)


@register("a2_tsv_scan", lambda: "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def a2_tsv_scan(spark, sf):
    """Conversations written as TSV and read back through the suffix rule."""
    path = _work(spark, "tsv") + "/turns.tsv"
    c = TB.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"[\t\n]", " ").alias("text"))
    c.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return IO.read_corpus(spark, path).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@register("a3_train_val_read",
          lambda: "SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def a3_train_val_read(spark, sf):
    """``<stem>.parquet`` plus sibling ``<stem>_val.parquet`` as validation."""
    base = _work(spark, "trainval")
    d = TB.table(spark, sf, "documents").select("doc_id", "lang", "text")
    d.filter(F.col("doc_id") % 10 != 0).write.mode("overwrite").parquet(f"{base}/docs.parquet")
    d.filter(F.col("doc_id") % 10 == 0).write.mode("overwrite").parquet(f"{base}/docs_val.parquet")
    return IO.read_with_validation(spark, f"{base}/docs.parquet").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("a5_per_dialect_sink",
          lambda: S.with_views("SELECT dialect, count(*) AS n FROM tagged GROUP BY dialect", "ar_docs",
                               extra=[("tagged", S.detect_dialect_select("ar_docs", keep="doc_id, text"))]))
def a5_per_dialect_sink(spark, sf):
    """Tagged documents written one folder per dialect; manifest of counts."""
    path = _work(spark, "dialects")
    tagged = D.detect_dialect(TB.ar_docs(spark, sf)).select("doc_id", "text", "dialect", "confidence")
    IO.write_corpus(tagged, path, "parquet", split_col="dialect")
    return spark.read.parquet(path).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))


@register("a9_custom_source_builder")
def a9_custom_source_builder(spark, sf):
    """Two sources of different formats and key names -> instruction/output
    rows -> union -> NFKC-free clean -> quality filter (E4 score >= 0.6)."""
    from ..operators.quality import filter_by_quality
    base = _work(spark, "sources")
    s = TB.sft(spark, sf)
    s.select(F.col("instruction").alias("question"), F.col("response").alias("answer")).write.mode("overwrite").json(f"{base}/qa.jsonl")
    s.select(F.col("instruction").alias("prompt"), F.col("response").alias("completion")) \
        .write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base}/pc.csv")
    specs = [(f"{base}/qa.jsonl", {"question": "instruction", "answer": "output"}),
             (f"{base}/pc.csv", {"prompt": "instruction", "completion": "output"})]
    parts = []
    for path, keys in specs:
        df = IO.read_corpus(spark, path, multiline_csv=True)
        parts.append(df.select(*[F.col(k).alias(v) for k, v in keys.items()]).withColumn("source", F.lit(path.rsplit("/", 1)[1])))
    u = parts[0].unionByName(parts[1])
    u = u.select("source", T.clean_text("instruction").alias("instruction"), T.clean_text("output").alias("text"))
    return filter_by_quality(u, "text", 0.6).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("a13_processed_cache",
          lambda: S.with_views("SELECT dialect, count(*) AS n FROM tagged GROUP BY dialect", "ar_docs",
                               extra=[("tagged", S.detect_dialect_select("ar_docs", keep="doc_id, text"))]))
def a13_processed_cache(spark, sf):
    """Processed-data cache keyed by sha256(source + config): the second call
    reads the cached parquet instead of recomputing."""
    root = _work(spark, "cache")
    cfg = {"threshold": 0.3, "op": "detect_dialect"}

    def compute():
        return D.detect_dialect(TB.ar_docs(spark, sf)).select("doc_id", "dialect", "confidence")
    IO.cached_processed(compute, spark, root, f"{sf}/documents.parquet", cfg)
    again = IO.cached_processed(compute, spark, root, f"{sf}/documents.parquet", cfg)
    return again.groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))


@register("e8_split_column_check",
          lambda: "SELECT split, CAST(n AS BIGINT) AS rows, n > 0 AS non_empty, true AS has_train, 'label' AS missing_columns FROM ("
                  + _split_sizes() + " UNION ALL SELECT 'holdout', 0) s")
def e8_split_column_check(spark, sf):
    from ..operators.quality import split_checks
    from ..operators.sampling import split
    s = split(TB.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return split_checks(s, ["doc_id", "text", "label"], ("train", "validation", "test", "holdout"))


@register("e20_fail_fast_preference", lambda: S.with_views("SELECT count(*) AS checked_pairs FROM pairs", "pairs"))
def e20_fail_fast_preference(spark, sf):
    """Raises on a missing column or an empty chosen/rejected; else the pairs pass."""
    from ..operators.quality import fail_fast_preference
    p = TB.pairs(spark, sf)
    fail_fast_preference(p)
    return p.agg(F.count(F.lit(1)).alias("checked_pairs"))


def _u2_sql():
    t = S.clean_text("text")
    rows = f"SELECT lang, {t} AS text FROM ar_docs WHERE coalesce(text, '') <> ''"
    kept = f"SELECT * FROM c WHERE {S.nwords('text')} >= 20"
    arabic = f"SELECT * FROM k WHERE {S.arabic_ratio_block_alpha('text')} > 0.5"
    one = lambda i, name, a, b: (f"SELECT {i} AS idx, '{name}' AS stage, {a} AS processed, {a} - {b} AS filtered, "  # noqa: E731
                                 f"round(({a} - {b}) / greatest({a}, 1), 6) AS filter_rate")
    n = {x: f"(SELECT count(*) FROM {x})" for x in ("ar_docs", "c", "k", "a")}
    body = " UNION ALL ".join([one(0, "not_empty", n["ar_docs"], n["c"]), one(1, "clean", n["c"], n["c"]),
                               one(2, "min_words", n["c"], n["k"]), one(3, "mostly_arabic", n["k"], n["a"])])
    return S.with_views(body, "ar_docs", extra=[("c", rows), ("k", kept), ("a", arabic)])


@register("u2_named_stages", _u2_sql)
def u2_named_stages(spark, sf):
    """Filters, a transform and a predicate of the caller in one pass, counted beside the write."""
    rows = H.preprocess(TB.ar_docs(spark, sf), ["lang", "text"], lambda d: d.select("lang", "text"))
    stages = [("not_empty", F.col("text") != ""), ("clean", lambda d: d.withColumn("text", T.clean_text("text"))),
              ("min_words", T.word_count("text") >= 20), ("mostly_arabic", T.arabic_ratio_block_alpha("text") > 0.5)]
    _, counts = H.run_stages(rows, stages, _work(spark, "named-stages"))
    return counts.withColumn("filter_rate", F.round("filter_rate", 6))


H.register_template("dialogue", "[{role}] {text} <{conv_id}/{turn}>")


@register("u5_template_registry",
          lambda: "SELECT conv_id, turn, md5('[' || role || '] ' || text || ' <' || conv_id || '/' || turn || '>') AS line_md5 FROM conversations")
def u5_template_registry(spark, sf):
    c = TB.table(spark, sf, "conversations")
    line = H.render("dialogue", **{k: F.col(k).cast("string") for k in ("role", "text", "conv_id", "turn")})
    return c.select("conv_id", "turn", F.md5(line).alias("line_md5"))
