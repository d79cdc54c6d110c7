"""Vector codes, language identification and the filter audit against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from qalam.llm import filter_audit, language, queries, tries, vector_codes
from qalam.llm.common import table

from llm_fixtures import *  # noqa: F403  fixtures
from llm_fixtures import SCHEMA, SF


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


# --- vector codes ------------------------------------------------------------

def slow_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, label, integer components), sorted; plain k-means steps with Python integers."""
    cut = lambda x: [x[p * len(x) // parts:(p + 1) * len(x) // parts] for p in range(parts)]
    xs = [cut(x) for _, _, x in rows]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    def assign():
        return [[nearest(p, x[p]) for p in range(parts)] for x in xs]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [x[p] for x, f in zip(xs, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = Counter()
    for (_, label, _), f in zip(rows, found):
        errors[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, bytes(k for _, k in f).hex(), sum(d for d, _ in f), errors[label], sha)
                   for (i, label, _), f in zip(rows, found)), key=str)


def coded(df):
    return sorted(map(tuple, vector_codes.code_table(df).collect()), key=str)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, i % 3 if i % 5 else None, [float(v) for v in rng.normal(0, 0.3, 32)]) for i in range(150)]
    good += [(200 + i, 7, good[i][2]) for i in range(40)]  # copies
    good += [(300 + i, 7, [0.5] * 32) for i in range(30)] + [(300, 7, [0.5] * 32)]  # ties, a repeated row
    good += [(400, None, [-0.0] * 32), (401, 1, [1e-3] * 32), (None, 1, [0.25] * 32), (402, 2, [-0.125] * 31 + [3.0])]
    bad = [(5000, 1, None), (5001, 1, []), (-1, 1, [None] + [0.1] * 31), (-2, 1, [float("nan")] * 32),
           (-3, 1, [float("inf")] + [0.0] * 31), (5002, 1, [0.1] * 16), (5003, 1, [0.1] * 5)]
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in [*good, *bad]],
                               "vec_id long, label int, embedding array<double>, _id string, _x int, _label string")
    rows = [(i, lab, [int(np.floor(256 * c)) for c in x])
            for i, lab, x in sorted(good, key=lambda r: (r[0] is None, r[0] or 0))]
    assert coded(df.repartition(7)) == slow_codes(rows)
    few = df.where("vec_id between 0 and 9")
    assert coded(few) == slow_codes([r for r in rows if r[0] is not None and r[0] < 10])
    assert coded(df.where("vec_id = 3")) == slow_codes([r for r in rows if r[0] == 3])
    assert coded(df.limit(0)) == [] and coded(df.where("embedding is null")) == []


def test_codes_with_a_salted_label_join(spark, monkeypatch):
    df = table(spark, SF, "embeddings")
    want = coded(df)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(df) == want


def test_components_saturate_where_squares_stay_exact(spark):
    top = vector_codes.limit(64)
    assert top == 1 << 24
    df = spark.createDataFrame([(i, 0, [1e300 * (-1) ** i] * 64) for i in range(3)], "vec_id long, label int, embedding array<double>")
    assert coded(df) == slow_codes([(i, 0, [top if i % 2 == 0 else -top] * 64) for i in range(3)])


@pytest.mark.parametrize("seed", range(6))
def test_refined_codes_equal_a_full_search(seed):
    rng = np.random.default_rng(seed)
    k, b = [(64, 8), (64, 1), (5, 8), (2, 1), (1, 8), (40, 3)][seed]
    x = rng.integers(-60, 60, (400, 4))
    book = x[rng.choice(400, k, replace=False)].copy()
    code, near, low, square = vector_codes.search(x, book, b)
    for step in range(5):
        true = np.sqrt(vector_codes._squares(x, book))
        bound = np.repeat(low[:, -1:], k, axis=1)  # an entry's bound: the least of its places in the list, else the outer one
        for j in reversed(range(near.shape[1])):
            bound[np.arange(len(x)), near[:, j]] = low[:, j]
        bound[np.arange(len(x)), code] = 0
        assert (bound <= true * (1 + 1e-9)).all()
        low = vector_codes._half(low).astype(float)  # as persisted
        if step == 2 and near.shape[1]:
            near, low = (a[:, 0] for a in vector_codes._pack(near[:, None], low[:, None], near.shape[1] + 2))
        moved = book + rng.integers(-3, 4, book.shape) * (rng.random((k, 1)) < 0.5)
        code, near, low, square, needed = vector_codes.refine(x, code, near, low, book, moved)
        book = moved
        true = vector_codes._squares(x, book)
        assert (code == true.argmin(axis=1)).all() and (square == true.min(axis=1)).all()
    assert k < 64 or b < 8 or (needed <= b).mean() > 0.5  # most parts are decided by their lists


def test_b_follows_the_bounds_that_were_needed():
    assert vector_codes._next_b(np.array([0] * 99 + [3]), 8, 64) == 3
    assert vector_codes._next_b(np.zeros(10, int), 8, 64) == 1
    assert vector_codes._next_b(np.full(10, 9), 8, 64) == 16
    assert vector_codes._next_b(np.full(10, 4), 3, 5) == 4


def test_decoded_vectors_are_near(spark):
    df = table(spark, SF, "embeddings")
    rows, books = vector_codes.compress(df)
    near = vector_codes.decode(rows, books).join(df, F.col("_id") == F.col("vec_id")).collect()
    for r in near[:50]:
        got = sum((np.floor(256 * np.float64(a)) - 256 * b) ** 2 for a, b in zip(r.embedding, r.approx))
        assert got == r._error


# --- language identification ---------------------------------------------------

def test_windows_show_every_position():
    data = bytes(range(1, 256)) * 5
    rows = language.windows(data)
    assert rows.shape == (-(-len(data) // language.WINDOW), language._REACH)
    for t in (0, 255, 256, 511, 1000, len(data) - 1):
        i, j = divmod(t, language.WINDOW)
        assert bytes(rows[i, j:j + 5]) == (data + bytes(5))[t:t + 5]
    assert not language.windows(b"").any()


def test_gradients_agree_with_differences():
    net = language.new_net(["a", "b", "c"], seed=4)
    for k in ("vectors", "filters", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(5)
    rows, y = rng.integers(97, 117, (6, language._REACH)).astype(np.uint8), rng.integers(0, 3, 6)
    _, grads = language.gradients(net, rows, y)
    for k, g in grads.items():
        a = getattr(net, k)
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(12)]:
            if k == "filters" and not language._mask()[at]:
                assert g[at] == 0
                continue
            kept, e = a[at], 1e-6
            a[at] = kept + e
            up, _ = language.gradients(net, rows, y)
            a[at] = kept - e
            down, _ = language.gradients(net, rows, y)
            a[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-5


def slow_share(net, text):
    data = text.encode()
    total = np.zeros(len(net.langs))
    for start in range(0, len(data), language.WINDOW):
        size = min(language.WINDOW, len(data) - start)
        seen = (data[start:start + language._REACH] + bytes(language._REACH))[:language._REACH]
        best = np.full(net.filters.shape[1], -np.inf)
        for t in range(language.WINDOW):
            patch = np.concatenate([net.vectors[c] for c in seen[t:t + max(language.WIDTHS)]])
            best = np.maximum(best, patch @ net.filters)
        z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(z - z.max())
        total += size * e / e.sum()
    return total / len(data)


def test_predictions_equal_a_plain_network():
    net = language.new_net(["x", "y", "z"], seed=1)
    long = "Ein kurzer Satz, then another one. " * 60
    texts = ["Hola", long, None, "", "12 34 ...", "ß", long + "und mehr", "日本"]
    langs, scores = net.predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        want = slow_share(net, t)
        assert lang == net.langs[int(want.argmax())] and abs(score - want.max()) < 1e-4


def test_very_long_texts_are_read_whole():
    net = language.new_net(["x", "y"], seed=2)
    text = "abc def " * 300_000
    assert abs(net.predict([text])[1][0] - net.predict([text[:51_200]])[1][0]) < 1e-3
    assert net.predict([text + "é" * 3_000_000]) != net.predict([text])


def test_held_out_languages_are_found(spark):
    sf = SF.replace("0.001", "0.01")
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    got = queries.op12_language(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_language_edge_rows(spark, edge_docs, no_docs):
    got = language.identify_documents(edge_docs).collect()  # no row has a language
    assert len(got) == edge_docs.count() and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify_documents(no_docs).collect() == []
    named = edge_docs.withColumn("lang", F.when(F.col("doc_id") < 6, "one"))
    got = language.identify_documents(named).select("doc_id", "lang_pred", "score", "held_out").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("one", 1.0), ("und", 0.0)}
    assert all(r.held_out for r in got if r.doc_id is None)


def test_held_out_rows_teach_nothing(spark):
    docs = table(spark, SF, "documents")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit_documents(changed, steps=1).langs


# --- filter audit -----------------------------------------------------------

def slow_masks(rows):
    """rows: (id, text, part)."""
    found = Counter()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        found[i, part or "", sum(f << k for k, f in enumerate(fails))] += 1
    return found


def slow_audit(found, good, toxic):
    out, removed_by = {}, Counter()
    parts = {p for _, p, _ in found}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = [(i, m, n) for (i, p, m), n in found.items() if p == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                count = lambda xs: sum(n for _, _, n in xs)
                out[part, order, step] = [
                    count(left), count(gone), count(x for x in everyone if x[1] & bit) - count(gone),
                    count(x for x in everyone if x[1] == bit), count(x for x in gone if x[0] in good),
                    count(x for x in gone if x[0] in toxic)]
                removed_by[part, f] += count(gone)
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def counted(df):
    got = Counter()
    for r in df.collect():
        got[r._id, r.part, r.mask] += r.n
    return got


def odd_documents():
    deep = "the same beginning " * 160  # 3,040 characters in common
    rows = [(i, f"{deep}{i % 40}", "en") for i in range(120)]
    rows += [(1000 + i, "a hot text " * 30, ["en", "de", None][i % 3]) for i in range(500)]
    rows += [(2000 + i, "x" * i, "fr") for i in range(60)] + [(2100 + i, "x" * (i // 2), "de") for i in range(60)]
    rows += [(3000, None, "en"), (3001, "", "en"), (3002, None, None), (3003, "", "")]
    rows += [(4000, "twice", "en"), (4000, "twice", "en"), (4000, "twice", "de"), (4001, "twice", "en"), (None, "twice", "en"),
             (None, None, None), (None, "alone", "fr"), (None, "alone", "fr"), (4002, "alone", "fr")]
    rows += [(5000 + i, "Wörter $ " * i + "ÄÖ AB", "es") for i in range(30)] + [(6000, "\x00\x0b\x1c\x85   \U0001f600", "es")]
    return rows


@pytest.mark.parametrize("least, block", [(1 << 20, 16 << 20), (20_000, 30_000), (2000, 1)])
def test_masks_equal_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", block)
    rows = odd_documents()
    df = spark.createDataFrame([(i, t, p, None, None, 1, "c") for i, t, p in rows], SCHEMA + ", n int, part string")
    df = df.repartition(5)
    ranges = tries.prefix_ranges(df, F.coalesce("text", F.lit("")), least=least, share=1 << 30)
    if least == 2000:
        assert len(ranges.starts) > 40 and max(ranges.salts) > 1
    assert ranges.starts == sorted(set(ranges.starts)) and ranges.starts[0] == b""
    assert counted(filter_audit.masks(df, ranges=ranges)) == slow_masks(rows)


def test_audit_equals_brute_force(spark, no_docs):
    rows = odd_documents()
    df = spark.createDataFrame([(i, t, p, None, None) for i, t, p in rows], SCHEMA)
    marks = [(i, i % 2, i % 3 == 0) for i in range(0, 6001, 7)] + [(4000, None, None), (4000, 1, 1), (4000, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame([(i, q if q is None else int(q), t if t is None else int(t)) for i, q, t in marks],
                                   "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    got = {tuple(r) for r in filter_audit.audit(df, labels).collect()}
    assert got == slow_audit(slow_masks(rows), good, toxic)
    assert filter_audit.audit(no_docs, labels).collect() == []
    nothing = {tuple(r) for r in filter_audit.audit(df, labels.limit(0)).collect()}
    assert nothing == slow_audit(slow_masks(rows), set(), set())


def test_string_ids_are_ordered_as_text(spark):
    df = spark.createDataFrame([("b", "t", "x"), ("a", "t", "x"), ("ä", "t", "x"), ("B", "u", None)],
                               "doc_id string, text string, lang string")
    assert {(r._id, r.mask >> 4) for r in filter_audit.masks(df).collect()} == {("b", 1), ("a", 0), ("ä", 1), ("B", 0)}


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_what_a_dictionary_holds(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 97 + 1 + seed, rng.integers(0, 60)).tolist()) for _ in range(600)]
    texts += [b"z" * 5000 + t for t in texts[:100]]
    trie, want = tries.Trie(), {}
    for i, t in enumerate(texts):
        node = trie.terminal(t)
        node.rows = min(i, node.rows) if node.rows is not None else i
        want.setdefault(t, i)
    assert [(t, n.rows) for t, n in trie.terminals()] == sorted(want.items())
