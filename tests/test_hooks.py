"""Components, stages, metrics of the caller, sketches, busy time, reports and hashes against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from qalam.functions import text as T
from qalam.operators import dedup as DD
from qalam.operators import graph as GR
from qalam.operators import hooks as H
from qalam.operators import metrics as M
from qalam.operators import negatives as N
from qalam.operators import quality as Q
from qalam.sources import io as IO
from qalam.sources import tables as TB

from conftest import SF_MED, SF_SMALL


def jobs_of(spark, run):
    sc, group = spark.sparkContext, f"g{random.random()}"
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setJobGroup("", "")
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_long_chain_ends_in_few_jobs(spark):
    n = 10_000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "i long, j long")
    got, jobs = jobs_of(spark, lambda: DD.greedy_keep_first(spark.range(n), edges, task_links=50_000).collect())
    assert {r.id: r.kept for r in got} == {i: i % 2 == 0 for i in range(n)} and jobs < 50
    root = {r.node: r.root for r in GR.components(edges, "i", "j").collect()}
    assert set(root) == set(range(n)) and set(root.values()) == {0}


@pytest.mark.parametrize("task_links", [10 ** 9, 4000, 30])
def test_greedy_choice_by_one_task_components_and_rounds(spark, task_links):
    rng = random.Random(task_links)
    edges = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(420)}
    smaller = {}
    for i, j in edges:
        smaller.setdefault(j, []).append(i)
    kept = {}
    for x in range(400):
        kept[x] = not any(kept[i] for i in smaller.get(x, []))
    links = spark.createDataFrame(list(edges), "i long, j long").repartition(5)
    assert {r.id: r.kept for r in DD.greedy_keep_first(spark.range(400), links, task_links=task_links).collect()} == kept
    assert GR.components(links.limit(0), "i", "j").collect() == []


def test_stages_run_once_and_are_counted(spark, tmp_path):
    d = TB.table(spark, SF_SMALL, "documents").select("doc_id", "lang", "text")
    stages = [("english", F.col("lang") == "en"), ("lower", lambda x: x.withColumn("text", F.lower("text"))),
              ("twice", lambda x: x.unionAll(x)), ("own", F.col("doc_id") % 3 != 0), ("none", F.col("doc_id") < -1)]
    (rows, counts), jobs = jobs_of(spark, lambda: H.run_stages(d, stages, str(tmp_path / "out")))
    assert jobs == 1
    n = d.filter("lang = 'en'").count()
    own = 2 * d.filter("lang = 'en' and doc_id % 3 <> 0").count()
    assert [(r.stage, r.processed, r.filtered) for r in counts.orderBy("idx").collect()] == [
        ("english", d.count(), d.count() - n), ("lower", n, 0), ("twice", n, -n), ("own", 2 * n, 2 * n - own), ("none", own, own)]
    assert rows.count() == 0
    with pytest.raises(ValueError, match="missing columns: answer"):
        H.preprocess(d, ["text", "answer"])
    with pytest.raises(ValueError, match="lacks fields: b"):
        H.register_template("t", "{a}-{b}")
        H.render("t", a=F.lit("x"))


def own_metrics():
    """A caller's metrics, as functions that travel to the workers by value."""
    def longest(state, pdf):
        return max([state, *(len(t) for t in pdf["text"] if t)])

    H.register_metric(H.Metric("longest", ("text",), lambda: 0, longest, max, float))
    H.register_metric(H.Metric("missing", ("text",), lambda: 0, lambda s, pdf: s + int(pdf["text"].isna().sum()), lambda a, b: a + b,
                               lambda s: None if s == 0 else s))


@pytest.mark.parametrize("parts", [1, 23])
def test_metrics_of_the_caller(spark, parts):
    own_metrics()
    rows = [("a", "x" * i) for i in range(300)] + [("b", None), ("b", "yy"), (None, "zzz")]
    df = spark.createDataFrame(rows, "g string, text string").repartition(parts)
    got = {(r.g, r.metric): r.value for r in H.evaluate(df, ["longest", "missing"], ["g"]).collect()}
    assert got == {("a", "longest"): 299, ("b", "longest"): 2, (None, "longest"): 3, ("a", "missing"): None, ("b", "missing"): 1,
                   (None, "missing"): None}
    assert {r.metric: r.value for r in H.evaluate(df.limit(0), ["longest", "missing"]).collect()} == {"longest": 0, "missing": None}
    d = df.filter("g is not null").withColumn("n", F.lit(2.0))
    roll = {r.g: (r.n, r.longest, r.missing) for r in M.dialect_rollup(d.select("g", "text", F.col("n").alias("v")), "g", ["v"],
                                                                       ["longest", "missing"]).collect()}
    assert roll == {"a": (300, 299, None), "b": (2, 2, 1), "overall": (302, 299, 1)}
    one = M.arabic_metrics(spark.createDataFrame([("abc",), ("de",)], "text string"), plugins=["longest"]).collect()
    assert len(one) == 1 and one[0].longest == 3 and one[0].n_texts == 2


def test_sketched_percentiles_are_near_the_exact_ranks(spark):
    e = TB.table(spark, SF_MED, "events")
    values = {}
    for r in e.select("event_type", "value").collect():
        values.setdefault(r.event_type, []).append(r.value)
    for r in M.latency_sketch(e.repartition(13), "value", ["event_type"]).collect():
        vs = sorted(values[r.event_type])
        assert r.n == len(vs)
        for p, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            low, high = sum(x < v for x in vs) / len(vs), sum(x <= v for x in vs) / len(vs)
            assert low - 0.01 <= p <= high + 0.01


@pytest.mark.parametrize("parts", [1, 19])
def test_busy_time_is_the_union_of_intervals(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", rng.randrange(0, 10_000_000), rng.randrange(0, 40_000)) for _ in range(700)]
    rows += [("one", 5, 10), ("none", 7, 0), ("nested", 0, 100), ("nested", 10, 5), ("nested", 50, 100), ("nested", 0, 100)]
    want = {}
    for g in {g for g, _, _ in rows}:
        busy, until = 0, None
        for _, s, d in sorted(r for r in rows if r[0] == g):
            busy += max(0, s + d - max(s, until if until is not None else s))
            until = max(s + d, until or 0)
        want[g] = (sum(r[0] == g for r in rows), busy / 1e6)
    df = spark.createDataFrame(rows, "g string, s long, d long")
    got = {r.g: (r.requests, r.busy_seconds) for r in M.throughput(df, ["g"], F.col("s"), F.col("d"), num_partitions=parts).collect()}
    assert {k: (a, round(b, 9)) for k, (a, b) in got.items()} == {k: (a, round(b, 9)) for k, (a, b) in want.items()}


def test_nested_reports(spark):
    rep = spark.range(1).select(
        F.lit(3).alias("n"), F.lit(None).cast("string").alias("nothing"), F.array(F.lit(1), F.lit(None).cast("int")).alias("list"),
        F.struct(F.lit(1.5).alias("mean"), F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)).alias("by")).alias("stats"),
        F.create_map().cast("map<string,struct<x:int>>").alias("empty"), F.lit(None).cast("struct<y:int>").alias("gone"))
    lines = [r.line for r in IO.nested_report_lines(rep, "Report").orderBy("place").collect()]
    assert lines == ["## Report", "- **n**: 3", "- **nothing**: null", "- **list**: [1, null]", "### stats", "- **mean**: 1.5", "#### by",
                     "- **a**: 1", "- **b**: 2", "", "", "### empty", "", "### gone", "- **y**: null", "", ""]


def test_lines_are_written_in_order(spark, tmp_path):
    rep = spark.range(1).select(*[F.lit(i).alias(f"k{i:03d}") for i in range(200)])
    path = str(tmp_path / "report")
    IO.write_lines(IO.nested_report_lines(rep), path)
    got = [r.value for r in spark.read.text(path).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    assert got == ["## Dataset Analysis", *(f"- **k{i:03d}**: {i}" for i in range(200)), ""]


def test_hashes_of_cells_and_of_streamed_files(spark, tmp_path):
    for name, size in (("a.bin", 10), ("b.bin", 100_000)):
        (tmp_path / name).write_bytes(bytes(i * 7 % 256 for i in range(size)))
    got = {r.path.rsplit("/", 1)[1]: r for r in IO.file_hashes(spark, str(tmp_path / "*.bin"), cell_bytes=1000).collect()}
    for name, r in got.items():
        data = (tmp_path / name).read_bytes()
        assert (r.length, r.md5, r.sha1, r.sha256) == (len(data), hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest(),
                                                       hashlib.sha256(data).hexdigest())
    assert len(got) == 2


def test_manifest_tells_of_missing_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    made = IO.write_with_manifest(spark.range(5), path, flags_of="x")
    _, manifest = IO.read_with_manifest(spark, path)
    assert manifest == made and manifest["created_at"] and manifest["flags"] == {"flags_of": "x"}
    spark.range(3).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="5 rows"):
        IO.read_with_manifest(spark, path)


def test_method_checks_by_hand(spark):
    df = spark.createDataFrame([("i", "r"), (" ", ""), ("", "r"), (None, "r")], "instruction string, response string")
    r = Q.method_checks(df, "sft").first()
    assert (r.rows, r.missing_fields, r.empty_texts, r.empty_instruction, r.passed) == (4, 1, 1, 2, False)
    df = spark.createDataFrame([("p", "c", 1), ("p", " ", 0), ("p", "c", None)], "prompt string, completion string, label int")
    r = Q.method_checks(df, "kto").first()
    assert (r.missing_fields, r.empty_texts, r.passed) == (1, 1, False)
    assert Q.method_checks(df.limit(1), "kto").first().passed


def test_filters_by_hand(spark):
    text = "كيف الحال؟ هذا نص جيد وطويل."
    rows = [(1, "p" * 2000, text, "x" * 20), (2, "", text, "x" * 20), (3, "p", "c" * 10, "x" * 20)]
    got = [r.filter_reason for r in Q.dpo_filter(spark.createDataFrame(rows, "id int, prompt string, chosen string, rejected string"))
           .orderBy("id").collect()]
    assert got[:2] == ["prompt_length", "prompt_length"] and got[2] == "quality_diff"
    df = spark.createDataFrame([("p", "a b c", ["d e", "f"]), ("p", "a b c", ["C b a", "f"]), ("p", "a b c", ["d"]), (" ", "a", ["d", "e"]),
                                ("p", "a b c", ["d", " "])], "prompt string, chosen string, negatives array<string>")
    assert [r.ok for r in df.select(Q.cpo_valid().alias("ok")).collect()] == [True, False, False, False, False]
    splits = Q.split_checks(spark.createDataFrame([("train",), ("extra",)], "split string"), ["split"]).collect()
    assert {r.split: (r.rows, r.non_empty, r.has_train) for r in splits} == {
        "train": (1, True, True), "extra": (1, True, True), "validation": (0, False, True), "test": (0, False, True)}
    v = Q.validate_rules(spark.createDataFrame([(2,), (3,), (None,)], "n int"), {"n": {"check": lambda c: c % 2 == 0, "message": "odd"}})
    assert [r.errors for r in v.collect()] == [[], ["n: odd"], ["n: odd"]]


def test_hardness_of_negatives(spark):
    df = spark.createDataFrame([("a b c", ["a b c"]), ("a", [])], "chosen string, negs array<string>")
    assert [r.h for r in df.select(N.negative_hardness("chosen", "negs").alias("h")).collect()] == [1.0, 1.0]
    q = df.select(T.quality(F.lit("a b c")).alias("x"), T.quality(F.lit("كيف الحال؟ نعم.")).alias("y")).first()
    far = df.limit(1).select(N.negative_hardness(F.lit("كيف الحال؟ نعم."), F.array(F.lit("a b c"))).alias("h")).first().h
    assert far == pytest.approx(min(1 / (q.y - q.x + 0.1) / 10, 1))


def test_mojibake_is_mended(spark):
    broken = "مرحبا".encode().decode("cp1252", "replace")
    r = spark.createDataFrame([("Ø§Ù…​",)], "t string").select(T.fix_encoding("t").alias("f")).first()
    assert r.f == "ام" and broken
    bad = spark.range(1).select(T.encoding_issues(F.unhex(F.lit("41FF42")).cast("string")).alias("i")).first()
    assert bad.i == ["unicode_encode_error"]
