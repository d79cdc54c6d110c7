"""Rules worked by hand, and operators on inputs that earlier versions cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

from qalam.functions import text as T
from qalam.operators import dedup as DD
from qalam.operators import formats as B
from qalam.operators import joins as J
from qalam.operators import metrics as M
from qalam.operators import negatives as N
from qalam.operators import quality as Q
from qalam.operators import dialect as D
from qalam.sources import tables as TB
from qalam.streaming import jobs as K

from conftest import SF_SMALL


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_detector_normaliser_against_plain_python(spark):
    rng = random.Random(5)
    letters = "اأإآةىيبهش" + "\u064b\u0652\u0653\u0670\u0640" + " \t\n\u00a0\u3000\x1c" + "aZ9\u0750\u08a0\ufb50\ufe70\u05d0😀؟،"
    rows = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(4000)] + [None]

    def plain(t):
        t = re.sub("[\u064b-\u0652\u0670\u0640]", "", t.strip())
        t = t.translate(str.maketrans("إأآىة", "ااايه"))
        t = re.sub(r"\s+", " ", t)
        return re.sub("[^\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff ]", "", t).strip()

    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.normalize_dialect("t").alias("n"))
    assert [(r.t, r.n) for r in df.collect() if r.n != (None if r.t is None else plain(r.t))] == []


def test_greedy_decides_every_node_of_a_long_chain(spark):
    nodes = spark.range(30).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)], "i long, j long")
    got = {r.id: r.kept for r in DD.greedy_keep_first(nodes, edges).collect()}
    assert got == {i: i % 2 == 0 for i in range(30)}


def test_near_dedup_of_copies_empty_and_missing_texts(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, ""), (4, None), (5, " "), (6, None), (7, "a b"), (8, "x y z")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted(r.id for r in DD.near_dedup(df, "text", "id", 0.8).collect()) == [1, 3, 4, 6, 7, 8]
    assert sorted(map(tuple, DD.near_dup_edges(df, "text", "id", 0.8).collect())) == [(1, 2, 1.0), (3, 5, 1.0)]
    assert DD.near_dedup(df.limit(0), "text", "id").count() == 0


@pytest.mark.parametrize("threshold", [0.55, 0.95])
def test_near_dup_edges_are_exact(spark, threshold):
    ws = [[f"w{(i * 7 + k) % 40}" if k < i % 25 else f"x{k}" for k in range(22)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {r.id: set(r.s) for r in df.select("id", T.shingles("text", 3).alias("s")).collect()}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(i, j) for i in sets for j in sets if i < j and rep[i] == i and rep[j] == j
            and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12} | {(rep[i], i) for i in sets if rep[i] < i}
    assert len(set(rep.values())) < len(rep) and want
    assert {(r.i, r.j) for r in DD.near_dup_edges(df, "text", "id", threshold).collect()} == want


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_similar_pairs_of_small_sets_are_exact(spark, threshold):
    """Small sets have few lower hashes, often none; a common line makes many shingles frequent. Ids repeat or are null."""
    rng = random.Random(5)
    texts = ["all rows hold this one line " + " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    texts += [t.rsplit(" ", 1)[0] for t in texts] + [t + " end" for t in texts] + ["a b", "a  b", "b a", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[30]), (None, texts[3])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    sets = [(r.id, frozenset(r.s)) for r in df.select("id", T.shingles("text", 3).alias("s")).collect() if r.id is not None and r.s is not None]
    rep = {}
    for i, s in sets:
        rep[s] = min(i, rep.get(s, i))
    firsts = [(i, s) for i, s in sets if rep[s] == i]
    want = [(i, j) for i, s in firsts for j, t in firsts if i < j and len(s & t) >= threshold * len(s | t) - 1e-12]
    want += [(rep[s], i) for i, s in sets if rep[s] < i]
    got = [(r.i, r.j) for r in DD.near_dup_edges(df, "text", "id", threshold).collect()]
    assert sorted(got) == sorted(want) and len(want) > len(set(want)) > 50


def test_prefixes_hold_shared_shingles_and_deal_shingles_once(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(50)], "id long, text string")
    sets = DD.different_sets(*DD.shingle_sets(df, "text", "id"))
    assert sets.count() == 50 and DD.prefixes(sets, 0.8).count() == 0
    sets = DD.different_sets(*DD.shingle_sets(df.unionAll(df.selectExpr("id + 50", "text || ' end'")), "text", "id"))
    got = DD.prefixes(sets, 0.8)
    per_row = got.groupBy("row", "sz").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("most")).collect()
    assert len(per_row) == 100 and all(r.n <= r.sz - -(-r.sz * 4 // 5) + 1 and r.most <= r.sz for r in per_row)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_every_labelled_row_is_paired(spark):
    lab = {r.doc_id: r.quality for r in TB.table(spark, SF_SMALL, "labels").collect()}
    p = TB.pairs(spark, SF_SMALL).select("id", "chosen_id", "rejected_id").collect()
    assert {r.chosen_id for r in p} | {r.rejected_id for r in p} == set(lab)
    assert sorted(r.id for r in p) == list(range(1, len(p) + 1))
    assert len(p) == max(sum(q == 1 for q in lab.values()), sum(q == 0 for q in lab.values()))


def test_label_words(spark):
    rows = [("accept", "good"), (" Preferred ", "good"), ("ممتاز", "good"), ("not_preferred", "bad"), ("ضعيف", "bad"),
            ("0.5", "good"), ("0.4", "bad"), ("desirable", None), ("نعم", None)]
    df = spark.createDataFrame(rows, "w string, want string")
    assert [r.got for r in df.select(B.normalize_label(F.col("w")).alias("got")).collect()] == [w for _, w in rows]


def test_conversation_prompts(spark):
    def turns(*xs):
        return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in xs])
    r = one(spark, a=B.to_standard(turns(("system", "s"), ("human", "a"), ("user", "b"), ("bot", "c"), ("user", "d"))),
            b=B.to_standard(turns(("user", "a"), ("user", "b"))),
            c=B.prompt_from_conversation(turns(("system", " x "), ("tool", " "), ("assistant", "y"), ("tool", "z"))),
            d=B.prompt_from_conversation(turns(("user", "a"), ("user", " b"), ("assistant", "c"))))
    assert tuple(r.a) == ("a b", "c") and tuple(r.b) == ("a b", "") and r.c == "x z" and r.d == " b"


def test_arabic_rules(spark):
    r = one(spark, n=T.normalize_arabic(F.lit("مٕرـحٰبا")), q=T.arabic_quality(F.lit("كيف. الحال")),
            none=T.arabic_quality(F.lit("abc!")))
    assert r.n == "مرحبأ" and r.q == pytest.approx(0.8) and r.none == 0


def test_adaptive_band_is_signed(spark):
    q = lambda t: one(spark, q=T.quality(F.lit(t))).q
    low, high = "x", "كيف الحال؟ هذا نص جيد. وهو طويل بما يكفي لكي يكون جوابا مقبولا في كل شيء تقريبا."
    r = one(spark, up=F.size(J.adaptive_negatives(F.lit(q(low)), F.array(F.lit(high)), 1.0)),
            down=F.size(J.adaptive_negatives(F.lit(q(high)), F.array(F.lit(low)), 1.0)))
    assert r.up == 0 and r.down == int(0.1 <= q(high) - q(low) <= 0.5)


def test_synthetic_negatives_follow_the_word_count(spark):
    df = spark.createDataFrame([(1, "one"), (2, "a b c"), (3, "a b c d e"), (4, "لا ليس")], "id long, chosen string")
    got = {r.id: r.n for r in df.select("id", N.synthetic_negatives("chosen", "id").alias("n")).collect()}
    assert got[1] == ["لا one", N.GENERIC_ANSWER]
    assert sorted(got[2][0].split()) == ["a", "b", "c"] and got[2][1:] == ["لا a b c", N.GENERIC_ANSWER]
    assert got[3][0] == "a b" and len(got[3]) == 3 and got[3][2] == "لا a b c d e"
    assert got[4] == ["غير لا ليس", N.GENERIC_ANSWER]


def test_diversity_of_fewer_than_two_negatives_is_zero(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a b", "a b"]), (4, None)], "id long, negs array<string>")
    assert {r.id: r.diversity for r in N.negative_diversity(df, "id", "negs").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_filters_and_issues(spark):
    rows = [(1, "a" * 100, "b" * 20), (2, "a" * 20, "b" * 100), (3, "a" * 40, "b" * 30)]
    got = {r.id: r.filter_reason for r in Q.ipo_filter(spark.createDataFrame(rows, "id long, chosen string, rejected string")).collect()}
    assert got == {1: "length_ratio", 2: "length_ratio", 3: "length_difference"}
    df = spark.createDataFrame([(1, " ", "x"), (2, "do", None)], "id long, instruction string, output string")
    assert sorted(map(tuple, Q.sample_format_issues(df, "id", "instruction").collect())) == [
        (1, "Empty or missing instruction"), (2, "Empty or missing output")]
    df = spark.createDataFrame([(1, ""), (2, "short"), (3, "long enough")], "id long, text string")
    assert sorted(map(tuple, Q.sample_format_issues(df, "id", "text").collect())) == [
        (1, "Empty or missing text"), (2, "Text too short")]


def test_cluster_without_shared_folder_is_refused():
    from qalam import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small tables as folders of six files, read one file a micro-batch."""
    folder = str(tmp_path_factory.mktemp("many"))
    for t in ("documents", "events"):
        TB.table(spark, SF_SMALL, t).repartition(6).write.parquet(f"{folder}/{t}.parquet")
    spark.conf.set(K.FILES_PER_TRIGGER, "1")
    yield folder
    spark.conf.unset(K.FILES_PER_TRIGGER)


def test_streams_over_many_micro_batches_equal_their_batch_twins(spark, many_files):
    tagged = D.detect_dialect(TB.ar_docs(spark, SF_SMALL))
    want = {r.dialect: r.n for r in D.analyze_dialects(tagged).collect()}
    assert {r.dialect: r.n for r in K.running_dialect_counts(spark, many_files).collect()} == want
    assert K.ingest(spark, many_files).count() == K.ingest(spark, SF_SMALL).count() > 0
    trend = sorted(map(tuple, K.live_loss_trend(spark, many_files).collect()), key=str)
    assert trend == sorted(map(tuple, K.live_loss_trend(spark, SF_SMALL).collect()), key=str) and trend
    capped = {r.dialect: r.n for r in K.capped_balanced_sink(spark, many_files, cap=7).groupBy("dialect").agg(
        F.count("*").alias("n")).collect()}
    have = {r.dialect: r.n for r in tagged.filter("confidence > 0.3").groupBy("dialect").agg(F.count("*").alias("n")).collect()}
    assert capped == {d: min(7, n) for d, n in have.items()}


def test_mixed_rows_become_standard(spark):
    turns = "messages array<struct<role string, content string>>"
    rows = [(1, "do", "this", "done", None, None, None, None, None), (2, "do", "", "done", None, None, None, None, None),
            (3, "do", None, "done", None, None, None, None, None), (4, None, None, None, "p", "r", None, None, None),
            (5, None, None, None, "p", "r", "c", "x", None), (6, None, None, None, "p", None, "c", None, None),
            (7, "do", "i", "o", None, None, None, None, [("user", "a"), ("ai", "b")])]
    df = spark.createDataFrame(rows, "id int, instruction string, input string, output string, prompt string, response string, "
                                     f"chosen string, rejected string, {turns}")
    got = {r.id: tuple(r)[1:] for r in B.standardize(df).collect()}
    assert got == {1: ("instruction", "do\n\nthis", "done", None, None), 2: ("instruction", "do", "done", None, None),
                   3: ("unknown", None, None, None, None), 4: ("chat", "p", "r", None, None),
                   5: ("preference", "p", None, "c", "x"), 6: ("unknown", None, None, None, None),
                   7: ("conversation", "a", "b", None, None)}
    assert [B.detect_format(df.select(*c)) for c in (["messages"], ["instruction", "output"], ["prompt", "chosen", "rejected"],
                                                    ["prompt", "response"])] == ["conversation", "unknown", "preference", "chat"]


def test_dataset_gate_bounds(spark):
    short = spark.createDataFrame([("كلمة abc",)] * 99, "text string")
    r = Q.dataset_gate(short).first()
    assert r.issues == ["too_small"] and r.warnings == ["short_texts"] and not r.passed
    assert (r.avg_words, r.min_words, r.max_words) == (2, 2, 2) and r.avg_arabic_ratio == pytest.approx(4 / 7)
    long = spark.createDataFrame([("word " * 1001,)] * 100, "text string")
    r = Q.dataset_gate(long, max_size=99).first()
    assert r.issues == [] and r.warnings == ["very_large", "long_texts", "low_arabic_content"] and r.passed
    r = Q.dataset_gate(long.select(F.col("text").alias("body"))).first()
    assert r.issues == ["missing_column:text"] and r.warnings == [] and r.avg_words is None


def test_augmented_gate_and_validator(spark):
    df = spark.createDataFrame([(1, "ازيك يا صاحبي", "شلونك وين رايح"), (2, "ازيك يا صاحبي", "ازيك يا صاحبي")],
                               "id int, a string, b string")
    got = {r.id: (r.reason, r.confidence >= 0.7) for r in D.augmented_gate(df, "a", "b", "egyptian").collect()}
    assert got[1][0] == "low_similarity" and got[2][0] == (None if got[2][1] else "inconsistent_dialect")
    tagged = spark.createDataFrame([("ازيك", "egyptian", 0.4), ("شلونك", "gulf", 0.9), ("abc", "unknown", 0.0)],
                                   "text string, dialect string, confidence double")
    assert sorted(map(tuple, D.validation_summary(tagged).collect())) == [
        ("dialect", "egyptian", 1), ("dialect", "gulf", 1), ("samples", "arabic_samples", 2), ("samples", "total_samples", 3)]
    assert [r.issue for r in D.validation_issues(tagged).orderBy("text").collect()] == ["non_arabic", "low_confidence"]


def test_utilisation_counts_every_device(spark):
    df = spark.createDataFrame([([(60.0, 90.0), (70.0, 60.0)],), ([(86.0, 95.0)],), ([],)],
                               "gpus array<struct<gpu_utilization double, memory_utilization double>>")
    r = M.utilisation_summary(df).first()
    assert (r.n, r.avg_gpu, r.low_gpu, r.low_memory) == (3, 72, False, False)
    assert r.avg_memory == pytest.approx(245 / 3)


@pytest.mark.parametrize("kind", ["ties", "grid", "wide"])
def test_band_join_matches_all_pairs_with_few_candidates(spark, kind):
    n = 240
    q = {"ties": lambda i: 0.5, "grid": lambda i: (i * 7 % 11) / 10, "wide": lambda i: (i * 0.6180339887) % 1 * 6.5}[kind]
    rows = [(i, f"p{i % 3 if i % 4 else i}", q(i)) for i in range(n)]
    s = spark.createDataFrame(rows, "sid long, sprompt string, sq double")
    o = s.select(F.col("sid").alias("order"), F.col("sprompt").alias("oprompt"), F.col("sq").alias("oq"))
    bands = [(lambda x: x - 0.2, lambda x: x, lambda x, y: (F.abs(x - y) < 0.2) & (y < x), lambda x, y: abs(x - y) < 0.2 and y < x),
             (lambda x: x * 0.8, None, lambda x, y: y > x * 0.8, lambda x, y: y > x * 0.8)]
    for lo, hi, pred, plain in bands:
        want = {(i, r + 1, j) for i, p, x in rows
                for r, j in enumerate([j for j, p2, y in rows if p2 != p and plain(x, y)][:3])}
        got = N.first_k_in_band(s, o, lo, hi, pred, 3, 6.5).select("sid", "rank", "order").collect()
        assert {tuple(r) for r in got} == want
        per = N.band_candidates(s, o, lo, hi, pred, 3, 6.5).groupBy("sq").count().agg(F.max("count")).first()[0]
        assert (per or 0) <= 12


def test_arabic_counts(spark):
    text = "كتاب كتاب مدرسة\u00a0مدرسة مدرسة. الالكتاب abc!  مَن  هذا كلام طويل؟ جدا\nabcdefghijk مدرسة.\t. x"
    r = M.arabic_counts(spark.createDataFrame([(text,), ("",), (None,)], "text string")).collect()
    got = r[0].asDict()
    words, sents = text.split(), [x.split() for x in text.replace("!", ".").split(".")]
    assert (got["words"], got["word_chars"], got["distinct"]) == (len(words), sum(map(len, words)), len(set(words)))
    assert got["long_words"] == 1 and got["double_article"] == 1 and got["diac_words"] == 1 and got["marks"] == 4
    assert got["ar_words"] == sum(any("\u0600" <= c <= "\u06ff" for c in w) for w in words)
    assert (got["sentence_words"], got["full_sentences"], got["long_sentences"]) == (
        sum(map(len, sents)), sum(len(x) > 0 for x in sents), sum(len(x) > 2 for x in sents))
    keys = [w for w in words if len(w) > 4 and "\u0600" <= w[0] <= "\u06ff"]
    assert got["repeated"] == sum(keys.count(w) > 1 for w in set(keys)) == 2
    assert r[1].words == r[1].distinct == r[1].repeated == r[1].full_sentences == 0 and r[2].words is None
    scores = M.arabic_metrics(spark.createDataFrame([(text,), ("a bad word",)], "text string"), blocked_terms=["bad"]).first()
    assert scores.cultural_appropriateness == 0.5 and scores.n_texts == 2
