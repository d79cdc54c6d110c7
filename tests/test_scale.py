"""Text steps that read a text once; against plain Python, and by their work."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from qalam.functions import lexicon as L
from qalam.functions import text as T
from qalam.operators import dialect as D
from qalam.operators import joins as J
from qalam.operators import metrics as M
from qalam.operators import quality as Q
from qalam.sources import io as IO


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts():
    rng = random.Random(3)
    terms = [t for kinds in L.DIALECT_FEATURES.values() for k, ts in kinds.items() if k != "patterns" for t in ts]
    pieces = terms + ["ش ", "ما ", "abc", "Z9", "\x01", " ", "  ", "\u00a0", "😀", "كي", "ف", "و"]
    return ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(300)] + ["", None]


def test_contained_terms_are_those_the_text_holds(spark):
    terms = sorted({t for kinds in L.DIALECT_FEATURES.values() for k, ts in kinds.items() if k != "patterns" for t in ts})
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    for r in df.select("t", D.contained_terms(F.col("t"), terms).alias("found")).collect():
        assert r.found == (None if r.t is None else [x for x in terms if x in r.t])


def test_dialect_features_are_not_one_search_each_in_the_plan(spark):
    df = spark.createDataFrame([("مش عارف ايه اللي حصل",)], "text string")
    tagged = D.detect_dialect(df)
    assert (tagged.first().dialect, round(tagged.first().confidence, 4)) == ("unknown", 0.2917)
    assert plan(tagged).count("Contains(") < 144


def test_order_pattern_of_long_texts(spark):
    rows = {"ما كتب ش": 1.5, "ش ما كتب": 0.0, "ما " * 20_000: 0.0}
    df = spark.createDataFrame([(t,) for t in rows], "n string")
    assert {r.n: r.h for r in df.select("n", F.when(D._in_order(F.col("n"), "ما ", "ش"), 1.5).otherwise(0.0).alias("h")).collect()} == rows


def test_lexicon_rows_without_a_nested_loop(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id long, n string")
    got = sorted(tuple(r) for r in J.lexicon_match(df, "n").select("id", "dialect", "kind", "term").collect())
    assert got == sorted((i, d, k, t) for i, n in enumerate(texts()) if n is not None for d, kinds in L.DIALECT_FEATURES.items()
                         for k, ts in kinds.items() if k != "patterns" for t in ts if t in n)
    assert "BroadcastNestedLoopJoin" not in plan(J.lexicon_match(df, "n"))


@pytest.mark.parametrize("fn", [T.trigram_repetition, lambda c: Q.quality_check(c), T.shingles, T.quality, T.distinct_ratio],
                         ids=["trigrams", "quality check", "shingles", "quality", "distinct"])
def test_a_text_is_split_into_words_once(spark, fn):
    df = spark.range(1).select(F.concat(F.lit("a b"), F.col("id").cast("string")).alias("t")).select(fn("t").alias("x"))
    assert plan(df).count("split(") == 1


def test_quality_filter_computes_the_score_once(spark):
    df = spark.range(3).select(F.concat(F.lit("كلمة "), F.col("id").cast("string")).alias("text"))
    assert plan(Q.filter_by_quality(df).select("quality_score")).count("split(") == 1
    assert [r.quality_score for r in Q.filter_by_quality(df).collect()] == [0.8] * 3


@pytest.mark.parametrize("p", [0.0, 0.02, 0.3, 0.5, 1.0])
def test_u_below_is_u_less_than(spark, p):
    df = spark.range(3000).select(T.u_below(7, F.col("id"), p).alias("a"), (T.u(7, F.col("id")) < p).alias("b"))
    assert df.filter("a <> b").count() == 0
    assert spark.range(1).select(T.u_below(7, F.lit(None).cast("string"), p).alias("a")).first().a is None


def test_noise_of_each_character(spark):
    def u(key):
        return int(hashlib.md5(f"42|{key}".encode()).hexdigest()[:8], 16) / 4294967296

    text = "نص طويل " * 60
    out = ""
    for i, c in enumerate(text):
        hit, dup = u(f"5|n{i}") < L.NOISE_PROB, u(f"5|n{i}d") < 0.5
        out += c + c if hit and dup else "" if hit else c
    g = D.general_augment(spark.createDataFrame([(5, text)], "id long, text string"), "text", "id")
    assert [r.text for r in g.filter("variant = 'noise'").collect()] == [out]


def test_augmentation_looks_behind_a_word_only_where_it_stands(spark):
    assert D._boundary("كيف").startswith("كيف")
    df = spark.createDataFrame([("كيف كيفك وكيف كيف_ (كيف)",)], "t string")
    assert df.select(F.regexp_replace("t", D._boundary("كيف"), "x").alias("x")).first().x == "x كيفك وكيف كيف_ (x)"


def test_diacritization_of_unequal_lengths_and_missing_texts(spark):
    rows = [("a b\u00a0c", "abd"), ("", "x"), ("xyz😀", "xy"), (None, None)]
    df = spark.createDataFrame(rows, "p string, r string")
    r = M.diacritization_accuracy(df, "p", "r").first()
    assert (r.diacritization_accuracy, r.chars_compared) == (4 / 5, 5)
    assert plan(M.diacritization_accuracy(df, "p", "r")).count("split(") <= 4


def test_evaluator_vote_of_missing_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "شو وين"), (4, "إن شو")], "id long, text string")
    assert [r.d for r in df.orderBy("id").select(D.evaluator_dialect(F.col("text")).alias("d")).collect()] == \
        ["msa", "msa", "levantine", "msa"]
    assert [r.dialect for r in M.arabic_counts(df.orderBy("id")).collect()] == ["msa", "msa", "levantine", "msa"]


def test_large_files_are_hashed_one_a_task(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * (i + 2))
    df = IO.file_hashes(spark, f"{tmp_path}/*.bin", cell_bytes=1)
    assert {r.md5 for r in df.collect()} == {hashlib.md5(bytes([i]) * (i + 2)).hexdigest() for i in range(8)}
    large = df.withColumn("task", F.spark_partition_id())
    assert large.select("task").distinct().count() == 8


def digests_of(data):
    return tuple(hashlib.new(n, data).hexdigest() for n in ("md5", "sha1", "sha256"))


def test_files_are_hashed_without_becoming_a_cell(spark, tmp_path):
    data = {"one.bin": b"x", "a b%20c.bin": b"x" * 5000, "z.gz": bytes(i * 7 % 256 for i in range(3 << 20))}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # Spark refuses to read more than this into a cell
    try:
        for df in (IO.file_hashes(spark, str(tmp_path)), IO.file_hashes(spark, str(tmp_path), cell_bytes=4000)):
            assert {r.path.rsplit("/", 1)[1]: (r.length, r.md5, r.sha1, r.sha256) for r in df.collect()} == \
                {name: (len(b), *digests_of(b)) for name, b in data.items()}
            assert df.columns == ["path", "length", "md5", "sha1", "sha256"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_files_are_hashed_in_a_store_that_only_hadoop_reads(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 100)
    spark.conf.set("fs.viewfs.mounttable.digests.link./in", f"file://{tmp_path}")
    try:
        for most in (10, 1 << 30):
            r = IO.file_hashes(spark, "viewfs://digests/in/*.bin", cell_bytes=most).first()
            assert (r.path, r.length, r.md5, r.sha1, r.sha256) == ("viewfs://digests/in/f.bin", 300, *digests_of(b"abc" * 100))
    finally:
        spark.conf.unset("fs.viewfs.mounttable.digests.link./in")


def test_a_file_is_read_once_for_all_its_digests(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    df = IO.file_hashes(spark, str(tmp_path)).select("md5", "sha256").filter("md5 != sha256")
    assert plan(df).count("file_digests(") == 1
    assert df.count() == 1


def test_files_that_the_session_skips_are_not_hashed(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.bin").write_bytes(b"abc")
    (tmp_path / ".a.bin.crc").write_bytes(b"crc\0" + bytes([0, 0, 2, 0]) + b"none")  # a.bin fails its checksum
    with pytest.raises(Exception, match="(?i)checksum"):
        IO.file_hashes(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", True)
    try:
        for most in (1, 1 << 30):
            assert [(r.path[-5:], r.md5) for r in IO.file_hashes(spark, str(tmp_path), cell_bytes=most).collect()] == [("b.bin", digests_of(b"abc")[0])]
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
