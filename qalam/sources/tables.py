"""Driver tables and the views derived from them (FIXTURES.md §2).

The supplied corpus is en/fr/de/es only, so the Arabic operators run on a
deterministic Arabised view of ``documents``. Every derivation here is a
plain DataFrame expression over the given tables: its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Session setting for benches on tables of one row group: deal the rows of the
# text tables to so many partitions. Unset, as on a cluster, a scan is a scan.
SPREAD = "qalam.spread.text.tables"
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df


# ---------------------------------------------------------------------------
# FIXED VALUES: the Arabised fixture. Latin letters a..z map to the first 26
# Arabic letters in alphabetical order; each document is prefixed by the
# phrase at position doc_id % 12 of this list. Kinds: a dialect phrase, a
# diacritised phrase, a mixed-script phrase, 'latin' (untranslated text),
# 'blank' (empty text), 'plain' (no prefix).
# ---------------------------------------------------------------------------
LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC26 = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
PHRASES = [
    ("egyptian", "ازيك يا صاحبي؟ ايه اخبارك؟"),
    ("levantine", "كيفك؟ شو اخبارك؟ بدي روح هيك شوي"),
    ("gulf", "شلونك؟ وين رايح؟ ابغى اشوفك زين كذا"),
    ("maghrebi", "كيفاش راك؟ واش اخبارك؟ بزاف مزيان"),
    ("iraqi", "شلونك؟ شنو اخبارك؟"),
    ("msa", "كيف حالك؟ ماذا تريد أن تفعل؟ مع السلامة يا صديقي العزيز"),
    ("diacritised", "مَرْحَبًا بِكُمْ فِي الدَّرْسِ الأَوَّلِ"),
    ("mixed", "Hello مرحبا world، هذه جملة قصيرة."),
    ("latin", ""),
    ("blank", ""),
    ("unknown", "مش عارف ايه اللي حصل"),
    ("plain", ""),
]
N_PHRASES = len(PHRASES)


def ar_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ar_docs(doc_id, text, lang, source, kind)``: Arabised documents;
    ``kind`` names the fixture phrase (the expected dialect for dialect rows)."""
    d = table(spark, sf_dir, "documents")
    k = (F.col("doc_id") % N_PHRASES).cast("int")
    kinds = F.array(*[F.lit(kind) for kind, _ in PHRASES])
    phrases = F.array(*[F.lit(p) for _, p in PHRASES])
    kind = F.element_at(kinds, k + 1)
    translated = F.translate(F.lower(F.col("text")), LATIN, ARABIC26)
    text = (F.when(kind == "blank", F.lit(""))
            .when(kind == "latin", F.col("text"))
            .when(kind == "plain", translated)
            .otherwise(F.concat(F.element_at(phrases, k + 1), F.lit("\n"), translated)))
    return d.select("doc_id", text.alias("text"), "lang", "source", kind.alias("kind"))


def sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sft(conv_id, turn, instruction, response)``: a user turn and the next
    turn when that one is an assistant turn (W5)."""
    from ..operators.windows import pair_turns
    return pair_turns(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs(id, prompt, chosen, rejected)``: every document of the larger
    quality class, ordered by doc_id, is paired with the document of the
    smaller class that has its number modulo that class's size; the prompt is
    the first line of the chosen text."""
    from ..operators.ranking import grouped_row_number
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = grouped_row_number(lab, ["quality"], ["doc_id"], "rn", max_groups=2)
    sizes = lab.agg(F.count_if(F.col("quality") == 1).alias("ng"), F.count_if(F.col("quality") == 0).alias("nb"))
    larger = F.when(F.col("ng") >= F.col("nb"), 1).otherwise(0)
    ids = ranked.crossJoin(sizes).filter((F.col("quality") == larger) & (F.col("ng") > 0) & (F.col("nb") > 0)).select(
        F.col("rn").alias("id"), (F.pmod(F.col("rn") - 1, "ng") + 1).alias("g"), (F.pmod(F.col("rn") - 1, "nb") + 1).alias("b"))
    good = ranked.filter("quality = 1").join(docs, "doc_id").select(
        F.col("rn").alias("g"), F.col("doc_id").alias("chosen_id"), F.col("text").alias("chosen_text"))
    bad = ranked.filter("quality = 0").join(docs, "doc_id").select(
        F.col("rn").alias("b"), F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    j = ids.join(good, "g").join(bad, "b")
    prompt = F.substring_index(F.col("chosen_text"), "\n", 1)
    return j.select("id", prompt.alias("prompt"),
                    F.col("chosen_text").alias("chosen"), "rejected", "chosen_id", "rejected_id")


def with_next(p: DataFrame) -> DataFrame:
    """``pairs`` with ``other`` and ``other_prompt``: the rejected text and the
    prompt of the pair after it (the first one's for the last)."""
    n = p.agg(F.count(F.lit(1)).alias("n"))
    after = p.select(F.col("id").alias("_next"), F.col("rejected").alias("other"), F.col("prompt").alias("other_prompt"))
    return p.crossJoin(n).withColumn("_next", F.pmod(F.col("id"), "n") + 1).join(after, "_next").drop("_next", "n")


def kto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kto(id, prompt, completion, label)``: labelled documents; label = quality."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = docs.join(lab, "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("prompt"),
                    F.col("text").alias("completion"), F.col("quality").alias("label"), "toxic")


def scores(spark: SparkSession, sf_dir: str, seed: int = 7) -> DataFrame:
    """``scores``: per-pair policy / reference log-probabilities and token
    counts, derived deterministically from the pair id and the texts."""
    p = pairs(spark, sf_dir)
    nc = T.word_count("chosen")
    nr = T.word_count("rejected")
    return p.select(
        "id",
        (-(T.u(seed, F.concat(F.lit("pc"), F.col("id"))) * 2.0 + 0.1) * nc).alias("lp_chosen"),
        (-(T.u(seed, F.concat(F.lit("pr"), F.col("id"))) * 2.0 + 0.1) * nr).alias("lp_rejected"),
        (-(T.u(seed, F.concat(F.lit("rc"), F.col("id"))) * 2.0 + 0.1) * nc).alias("ref_chosen"),
        (-(T.u(seed, F.concat(F.lit("rr"), F.col("id"))) * 2.0 + 0.1) * nr).alias("ref_rejected"),
        nc.cast("long").alias("n_chosen"), nr.cast("long").alias("n_rejected"))


RUN_DATASETS = ["arabic_sft", "arabic_preference", "arabic_eval"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs``: a run log with the reference's shape, aggregated from ``events``:
    one run per (event_type, user_id % 3); method = event_type."""
    e = table(spark, sf_dir, "events")
    ds = F.element_at(F.array(*[F.lit(x) for x in RUN_DATASETS]), (F.col("user_id") % 3).cast("int") + 1)
    g = e.groupBy(F.col("event_type").alias("method"), ds.alias("dataset")).agg(
        F.count("*").alias("samples_trained"),
        F.sum("value").alias("total_value"),
        F.avg("value").alias("avg_value"),
        F.count_distinct("user_id").alias("epochs"),
        F.max("ts").alias("last_ts"))
    return g.select(
        "method", "dataset",
        F.when(F.col("avg_value") > 50.0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.concat(F.round(F.col("total_value")).cast("long").cast("string"), F.lit("s")).alias("training_time"),
        F.col("epochs").cast("int").alias("epochs"),
        F.round(F.col("avg_value") / 10.0, 6).alias("final_loss"),
        F.round(F.col("samples_trained") / F.greatest(F.col("total_value"), F.lit(0.001)), 6)
        .alias("samples_per_second"),
        "samples_trained",
        F.concat(F.lit("models/"), F.col("method"), F.lit("_"), F.col("dataset")).alias("checkpoint_path"),
        F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric_log(run, step, ts, value)``: events as per-run metric series;
    step = row number by (ts, event_id) within the run."""
    from ..operators.ranking import grouped_row_number
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    # skew-proof: a run holding most events is still numbered by many tasks
    return grouped_row_number(e, ["run"], ["ts", "event_id"], "step").select("run", "step", "ts", "value", "event_id")
