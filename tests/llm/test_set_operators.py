"""SimHash, embeddings, substrings, sharding, packing and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from qalam.llm import embeddings, packing, queries, sharding, simhash, substrings, suffixes
from qalam.llm.common import table
from qalam.llm.components import components

from llm_fixtures import *  # noqa: F403  fixtures
from llm_fixtures import SCHEMA, SF, Sets


def test_components_chains_hubs_and_copies(spark):
    chain = [(i, i + 1) for i in range(0, 150)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    edges = spark.createDataFrame([*chain, *hub, (5, 4), (5, 5), (3, 4)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(151)} | {1000 + i: 1000 for i in range(60)}
    assert components(edges.limit(0)).count() == 0


# --- SimHash ----------------------------------------------------------------

def slow_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_op2_matches_brute_force(spark, texts):
    want = {i: slow_fingerprint(t) for i, t in texts.items()}
    sets, ids = Sets(want), sorted(want)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (want[i] ^ want[j]).bit_count() <= 3:
                sets.join(i, j)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (f"{want[i]:016x}", sets.root(i)) for i in ids}
    assert len({c for _, c in got.values()}) < len(ids)


@pytest.mark.parametrize("dense, share", [(1024, simhash.HEAVY_SHARE), (6, simhash.HEAVY_SHARE), (6, 1.0), (0, 1.0)])
def test_links_have_all_components_however_dense(spark, monkeypatch, dense, share):
    monkeypatch.setattr(simhash, "HEAVY_SHARE", share)  # 1.0: no value enters the estimate
    rng = np.random.default_rng(dense)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(40):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    unsigned = [x & (1 << 64) - 1 for x in fps]
    sets = Sets(fps)
    for i, x in enumerate(unsigned):
        for j in range(i):
            if (x ^ unsigned[j]).bit_count() <= 3:
                sets.join(fps[i], fps[j])
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, dense).collect()
    mine = Sets(fps)
    for u, v in found:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 3
        mine.join(u, v)
    assert [sets.root(x) for x in fps] == [mine.root(x) for x in fps]


@pytest.mark.parametrize("m", [2, 3, 4])
def test_thresholds_keep_the_pigeonhole(m):
    rng = np.random.default_rng(m)
    bits = simhash.group_bits(np.diag(np.full(64, 50.0)), 100, m)
    assert sorted(b for p in bits for b in p) == list(range(64))
    fp = rng.integers(-(1 << 62), 1 << 62, 300)
    plan = simhash.Plan(bits, 10_000, [dict(Counter(simhash.gather(fp[:50], p).tolist())) for p in bits], 3)
    e, _ = plan.thresholds(fp)
    assert ((e + 1).sum(axis=0) == 4).all()


def test_simhash_edges(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == {1} and by[2] == by[3] == {2} and by[4] == by[5] == {4} and by[None] == {None, 2}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 6, 7]


# --- embeddings -------------------------------------------------------------

def test_bounds_allow_for_rounded_radii():
    """Nearly equal vectors, whose measured radius may be 0, at the threshold from one another."""
    rng = np.random.default_rng(3)
    a = embeddings.unit(rng.normal(size=(1, 64)).tolist())[0]
    side = rng.normal(size=64)
    side = embeddings.unit([side - (side @ a) * a])[0]
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * side
    near = lambda x: embeddings.unit(x + rng.normal(scale=3e-9, size=(60, 64)))
    x, y = embeddings.CoverTree(near(a), 4), embeddings.CoverTree(near(b), 4)
    got = np.zeros((60, 60), bool)
    for i, j, mask in embeddings.close_pairs(x, y, 0.98):
        got[i, j] = True if mask is None else mask
    assert (got == (x.x @ y.x.T >= 0.98)).all() and got.any() and not got.all()


def brute_vectors(rows, cosine=0.98):
    ok = {i: np.array(x, float) for i, x, lab in rows if lab is not None and x and all(v is not None and np.isfinite(v) for v in x)
          and any(x)}
    label = {i: lab for i, _, lab in rows}
    sets, n = Sets([i for i, _, _ in rows]), Counter()
    ids = sorted(ok)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = ok[i], ok[j]
            if label[i] == label[j] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                sets.join(i, j)
    return {i: (n[i], sets.root(i), sets.root(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("chunk", [4096, 20])
def test_embeddings_match_brute_force(spark, chunk):
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(9, 8))
    rows = [(i, (centres[i % 9] * (1 + i % 3) + rng.normal(0, [0.02, 0.1, 0.4][i % 3], 8)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[3][1], 1) for i in range(15)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0, None] * 4, 0), (403, [float("nan")] * 8, 0),
             (404, [float("inf")] * 8, 0), (405, rows[0][1], None), (406, [], 0), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, _at string")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    assert got == brute_vectors(rows)


def test_embeddings_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)],
                               "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert [x for x in got if x[0] == 5] == [(5, 2, 5, True)] * 2
    assert {x[1:] for x in got if x[0] == 0} == {(2, 5, False), (0, None, False)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_trees_cross_the_shuffle_by_blocks(spark):
    sizes, chunk, dim = [70, 1, 30, 20], 16, 4  # chunks of four cells, the last of them far from the others
    pivots = np.array([[1, 0, 0, 0], [0.8, 0.6, 0, 0], [0.6, 0.8, 0, 0], [-1, 0, 0, 0]], float)
    cells = spark.createDataFrame([(7, dim, c, 0.5, n * chunk, pivots[c].tolist(), n) for c, n in enumerate(sizes)],
                                  "_label int, _dim int, _cell int, _radius double, _m long, _pivot array<double>, _chunks int")
    name = embeddings._blocks(cells, ["_label", "_dim"], chunk, 0.2)[0].first()._group
    trees = spark.createDataFrame([(name, c, s, bytearray(b"t")) for c, n in enumerate(sizes) for s in range(n)],
                                  "_group string, _cell int, _sub long, _tree binary")
    met = embeddings._met_trees(trees, cells, ["_label", "_dim"], chunk, 0.2)
    total = sum(sizes)
    n = 0
    pairs = Counter()
    for part in met.rdd.glom().collect():
        at, block = None, []
        for r in part:
            n += 1
            if (r._p, r._q) != at:
                at, block = (r._p, r._q), []
            assert r._second or not block or not block[-1][1], "first block before the second"
            if r._p == r._q or r._second:
                pairs.update((c, r._cell) for c, _ in block if c * embeddings.PIVOTS + r._cell in r._near)
            if not r._second:
                block.append((r._cell, r._second))
    near = [(a, b) for a in range(3) for b in range(a, 3)] + [(3, 3)]
    assert pairs == {(a, b): sizes[a] * (sizes[a] - 1) // 2 if a == b else sizes[a] * sizes[b]
                     for a, b in near if a != b or sizes[a] > 1}
    assert n <= (np.ceil(total ** 0.5) + 1) * total


# --- suffixes and substrings ------------------------------------------------

def test_suffix_order_and_repeats_match_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, a = int(rng.integers(1, 70)), int(rng.integers(1, 4))
        t = np.append(rng.integers(1, a + 1, n), 0).astype(np.uint16)
        # a budget of a few bytes sends the queues to the scratch file
        assert suffixes.suffix_order(t, a + 1, 100, budget=16).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
    for _ in range(60):
        w = int(rng.integers(3, 14))
        ps = [bytes(rng.integers(0, 2, int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        at = {}
        for i, p in enumerate(ps):
            for j in range(len(p) - w + 1):
                at.setdefault(p[j:j + w], set()).add((i, j))
        got = {}
        for g, p, o in zip(*(x.tolist() for x in suffixes.repeated(ps, w))):
            got.setdefault(g, set()).add((p, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in at.values() if len(v) > 1)


def brute_removal(rows, width):
    seen, out = set(), []
    for data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            w = data[s:s + width]
            if w in seen:
                gone[s:s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_op5_matches_brute_force(spark, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute_removal([texts[i].encode() for i in ids], 100)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_substrings(spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("hot", [10_000, 1])
def test_substrings_of_hard_texts(spark, hot):
    rng = np.random.default_rng(8)
    common = "the very same line of boilerplate in all of them, long enough to count as a repeated passage here" * 2
    texts = ["a" * 400, "ab" * 300, "a" * 99, "a" * 100, common, "é" * 120, "x" + "é" * 120]
    texts += ["".join(rng.choice(list("abcdefgh "), 150)) + common[: 60 + 3 * i] + "".join(rng.choice(list("abcdefgh "), 90))
              for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.remove_repeats(df, hot_pieces=hot, shard_pieces=16).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts], 100)))


@pytest.mark.parametrize("shard_bytes, segment", [(1 << 23, 1 << 16), (4000, 700), (1 << 23, 150)])
def test_long_runs_are_cut_and_heavy_anchors_are_spread(spark, monkeypatch, shard_bytes, segment):
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = letters(70)
    texts = [line * 40, letters(300) + line * 12 + letters(120), letters(50), line * 3 + letters(500), "a" * 5000, letters(80) + "a" * 1500,
             "ab" * 900, letters(700), ""]
    texts.append(texts[7][100:400] + line)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.remove_repeats(df, shard_bytes=shard_bytes).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts], 100)))


@pytest.mark.parametrize("hot", [10_000, 1])
@pytest.mark.parametrize("tail", [False, True])
def test_substrings_shared_with_one_end_of_a_run(spark, hot, tail):
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    texts = []
    while len(texts) < 12:  # a line twice in one document, its other only once and in part
        line = letters(60)
        h = substrings._hashes(np.frombuffer((line * 2).encode(), np.uint8), 24)[:60]
        at = int(h.argmin())
        if tail and at < 15:  # the second anchor alone: 45 bytes, then the line
            texts += [letters(200) + line * 2 + letters(200), letters(200) + line[15:] + line + letters(200)]
        elif not tail and 22 <= at < 36:  # the first anchor alone: the line, then 45 bytes
            texts += [letters(200) + line * 2 + letters(200), letters(200) + line + line[:45] + letters(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.remove_repeats(df, hot_pieces=hot).collect()}
    want = dict(enumerate(brute_removal([t.encode() for t in texts], 100)))
    assert got == want and all(want[i][1] >= 105 for i in range(1, 12, 2))


def test_substring_edges(spark, edge_docs, no_docs):
    got = {}
    for r in substrings.remove_repeats(edge_docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == 10
    assert got[2][0].n_bytes == got[3][0].n_bytes == 0 and got[5][0].n_removed == got[5][0].n_bytes
    assert got[1][0] == got[1][1] and got[4][0].kept.startswith(b"lorem")
    assert substrings.remove_repeats(no_docs).count() == 0


# --- sharding ---------------------------------------------------------------

def test_op6_law_and_slots(spark, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and slots


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20_000)
    tree = sharding.topology(8)
    heavier = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, x.shard, 3.0) for x in tree]
    rows = ids.select(sharding.place(ids.id, tree).alias("a"), sharding.place(ids.id, heavier).alias("b")).collect()
    region = {x.shard: x.region for x in tree}
    rack = {x.shard: x.rack for x in tree}
    moved = [(a, b) for a, b in rows if a != b]
    # rows enter the heavier region, rack and shard; none move elsewhere
    assert moved and all(region[b] == region[5] for _, b in moved)
    assert all(rack[b] == rack[5] for a, b in moved if region[a] == region[5])
    assert all(b == 5 for a, b in moved if rack[a] == rack[5])
    counts = Counter(b for _, b in rows)
    assert abs(counts[5] / 20_000 - 0.3) < 0.02
    assert all(abs(n / 20_000 - 0.125) < 0.012 for n in Counter(a for a, _ in rows).values())


def slow_hash(key, name):
    """Spark's xxhash64 of (long, string): the second seeded with the first."""
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
    return xxhash.xxh64_intdigest(name.encode(), first)


def slow_place(key, leaves):
    """Region, rack, shard by weighted draws, level by level."""
    def winner(names):
        draws = {}
        for name, weight in names.items():
            u = ((slow_hash(key, name) & ((1 << 52) - 1)) + 0.5) / (1 << 52)
            draws[name] = -np.log(u) / weight
        return min(draws, key=draws.get)

    total = lambda xs: sum(x.weight for x in xs)
    left, path = list(leaves), ""
    for level in ("region", "rack"):
        groups = {}
        for x in left:
            groups.setdefault(f"{level}/{path}{getattr(x, level)}", []).append(x)
        name = winner({n: total(xs) for n, xs in groups.items()})
        left, path = groups[name], f"{path}{getattr(groups[name][0], level)}/"
    name = winner({f"shard/{path}{x.shard}": x.weight for x in left})
    return int(name.rsplit("/", 1)[1])


def test_places_follow_the_draws(spark, texts):
    for r in queries.op6_sharding(spark, SF).collect():
        assert (r.shard, r.grown_shard) == (slow_place(r.doc_id, sharding.topology(8)), slow_place(r.doc_id, sharding.topology(9)))
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    tree = [sharding.Leaf("a", "x", 0, 1.5), sharding.Leaf("a", "y", 1, 0.5), sharding.Leaf("b", "x", 2, 4.0), sharding.Leaf("b", "x", 3)]
    ids = spark.range(-300, 300)
    for r in ids.select("id", sharding.place(ids.id, tree).alias("s")).collect():
        assert r.s == slow_place(r.id, tree)


def test_sharding_edges(spark, edge_docs, no_docs):
    rows = sharding.shard_documents(edge_docs, sharding.topology(3)).collect()
    assert len(rows) == 10 and all(r.grown_shard is None for r in rows)
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    assert sharding.shard_documents(no_docs, sharding.topology(8)).count() == 0


# --- packing ----------------------------------------------------------------

def test_encoder_matches_the_tokenizer_file(texts):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(queries.TOKENIZER)
    own.encode_special_tokens = True
    odd = ["<|endoftext|> x", "a" * 3000, " \n\t  x", "日本語 😀 \x00", "'ll don't", "1234567 8"]
    for t in [*texts.values(), *odd]:
        assert packing.encode(queries.TOKENIZER, t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids(spark, texts):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(queries.TOKENIZER)  # at its defaults
    end = "<|endoftext|>"
    rows = [*texts.values(), f"a {end} b", end, end * 3, f"a{end}b", f" \n{end}\n\n x  ", f"it's{end}'s  {end}  ", end[:-1],
            f"<{end}>", ("word " * 700 + end) * 9]
    for t in rows:
        assert packing.encode(queries.TOKENIZER, t, added=True).tolist() == own.encode(t, add_special_tokens=False).ids
    assert packing.encode(queries.TOKENIZER, f"a {end} b", added=True).tolist() == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(enumerate(rows[-9:])), "doc_id long, text string")
    got = {}
    for r in packing.pack(packing.tokenize(df, queries.TOKENIZER)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, t in enumerate(rows[-9:]):
        ids = np.append(own.encode(t, add_special_tokens=False).ids, 0).astype("<u4")
        assert sorted(got[i]) == [(s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n in packing.cut(len(ids), 2048)]


def check_places(rows, capacity=2048):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_op9_pieces_and_places(spark, texts):
    rows = queries.op9_packing(spark, SF).collect()
    ids = {i: np.append(packing.encode(queries.TOKENIZER, t), 0).astype("<u4") for i, t in texts.items()}
    got = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, own in got.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [sum(x[2] for x in own[:k]) for k in range(len(own))]
        assert sum(x[2] for x in own) == len(ids[i]) and all(x[2] == 2048 for x in own[1:])
    assert set(got) == set(texts)
    total = sum(map(len, ids.values()))
    assert check_places(rows) <= -(-total // 2048) * 1.02 + 1


def slow_best_fit(lengths, capacity):
    room = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - size)
        else:
            room.append(capacity - size)
    return sorted(room)


def test_segment_tree_finds_the_tightest_bin():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 60, 400):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        used = Counter()
        for b, size in zip(bins.tolist(), lengths.tolist()):
            used[b] += size
        assert sorted(100 - u for u in used.values()) == slow_best_fit(lengths.tolist(), 100)


def test_packing_edges(spark, edge_docs, no_docs):
    rows = packing.pack(packing.tokenize(edge_docs, queries.TOKENIZER, with_ids=True), group_rows=3).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.piece == 0 for r in rows) == 10
    assert {(r.length, tuple(r.ids)) for r in rows if r.doc_id in (2, 3)} == {(1, (0,))}
    check_places(rows)
    assert packing.pack(packing.tokenize(no_docs, queries.TOKENIZER)).count() == 0


def test_tokenizer_files_exist():
    assert queries.TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")


# --- pipeline ---------------------------------------------------------------

def test_pipeline_matches_its_operators(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    good = {r.doc_id for r in queries.op3_quality(spark, sf).collect() if r.predicted}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    fp = {i: slow_fingerprint(t) for i, t in text.items()}
    sets, ids = Sets(fp), sorted(fp)
    a = np.array([fp[i] for i in ids], np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1:] ^ a[k]) <= 3).tolist():
            sets.join(ids[k], ids[k + 1 + j])
    first = {i for i in ids if sets.root(i) == i}
    dirty = {r.doc_id for r in queries.op1_decontamination(spark, sf).collect()}
    want = first - dirty
    from qalam.llm import pii
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want and dirty & first
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    for i in want:
        clean = pii.redact(text[i], pii.find_spans(text[i]))
        assert lengths[i] == len(packing.encode(queries.TOKENIZER, clean)) + 1
    check_places(rows)


def test_stages_keep_columns_and_take_edges(spark, edge_docs, no_docs, tmp_path):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for docs in (edge_docs.select(*names), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == names and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= (docs.count() > 0)
