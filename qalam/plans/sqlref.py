"""DuckDB SQL twins of the column functions and derived views.

Used only to write the oracle queries that check the Spark results; the
library itself never runs SQL text through DuckDB. Fragments here mirror
``qalam.functions.text`` and ``qalam.sources.tables`` one for one.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..sources import tables as TB

WS_RUN = f"[{L.WS}]+"


def q(s: str) -> str:
    """SQL string literal (newlines become chr(10) concatenations)."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def rr(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip(x: str) -> str:
    return rr(x, f"^[{L.WS}]+|[{L.WS}]+$")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS_RUN)}), lambda w: w <> '')"


def nwords(x: str) -> str:
    return f"len({words(x)})"


def has_arabic(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {q('[' + L.AR5 + ']')}), false)"


def char_count(x: str, cls: str) -> str:
    return f"length({rr(x, '[^' + cls + ']')})"


def normalize_dialect(x: str) -> str:
    t = strip(x)
    t = rr(t, f"[{L.DETECT_DIACRITICS}]")
    t = (f"translate({t}, {q(L.ALEF_VARIANTS + L.TEH_MARBUTA + L.YEH_VARIANTS)}, "
         f"{q(L.ALEF * len(L.ALEF_VARIANTS) + L.HEH + L.YEH * len(L.YEH_VARIANTS))})")
    t = rr(t, WS_RUN, " ")
    t = rr(t, f"[^{L.AR5}{L.WS}]")
    return strip(t)


def clean_text(x: str, remove_extra_whitespace=True, remove_special_chars=False,
               normalize_arabic=True, remove_diacritics=False) -> str:
    t = x
    if remove_extra_whitespace:
        t = strip(rr(t, WS_RUN, " "))
    if normalize_arabic:
        t = (f"translate({t}, {q(L.ALEF_VARIANTS + L.ALEF_MAKSURA + L.TEH_MARBUTA)}, "
             f"{q(L.ALEF * len(L.ALEF_VARIANTS) + L.YEH + L.HEH)})")
    if remove_diacritics:
        t = rr(t, f"[{L.CLEAN_DIACRITICS}]")
    if remove_special_chars:
        t = rr(t, f"[^{L.AR5}{L.CLEAN_KEEP_ASCII}{L.WS}]")
    return strip(t)


def u(seed, key_sql: str) -> str:
    return (f"(('0x' || substr(md5(concat('{seed}|', CAST({key_sql} AS VARCHAR))), 1, 8))::BIGINT"
            f" / 4294967296.0)")


def rnd(x: str, d: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


def py_regex(p: str) -> str:
    return p.replace(r"\s", f"[{L.WS}]")


def dialect_score_sql(norm: str) -> dict[str, str]:
    out = {}
    for d in L.DIALECT_ORDER:
        feats = L.DIALECT_FEATURES[d]
        terms = []
        for kind, w in L.FEATURE_WEIGHTS.items():
            for t in feats[kind]:
                cond = f"regexp_matches({norm}, {q(py_regex(t))})" if kind == "patterns" \
                    else f"contains({norm}, {q(t)})"
                terms.append(f"(CASE WHEN {cond} THEN {w} ELSE 0.0 END)")
        out[d] = "((" + " + ".join(terms) + f") / {float(len(terms))})"
    return out


def detect_dialect_select(src: str, text: str = "text", keep: str = "*", threshold: float = L.DETECT_THRESHOLD) -> str:
    """SELECT adding dialect, confidence to ``src`` (a table/CTE name)."""
    sc = dialect_score_sql("__norm")
    names = [f"__s_{d}" for d in L.DIALECT_ORDER]
    best = "greatest(" + ", ".join(names) + ")"
    winner = "CASE " + " ".join(f"WHEN __s_{d} = {best} THEN '{d}'" for d in L.DIALECT_ORDER) + " ELSE 'unknown' END"
    inner = (f"SELECT *, " + ", ".join(f"{sc[d]} AS __s_{d}" for d in L.DIALECT_ORDER) +
             f" FROM (SELECT *, {normalize_dialect(f'lower({text})')} AS __norm FROM {src}) __n")
    return (f"SELECT {keep}, CASE WHEN NOT {has_arabic(text)} THEN 'unknown' WHEN {best} < {threshold} "
            f"THEN 'unknown' ELSE {winner} END AS dialect, "
            f"CASE WHEN NOT {has_arabic(text)} THEN 0.0 ELSE {best} END AS confidence FROM ({inner}) __d")


# ----------------------------------------------------------------- views

def ar_docs_sql() -> str:
    kinds = "[" + ", ".join(q(k) for k, _ in TB.PHRASES) + "]"
    phrases = "[" + ", ".join(q(p) for _, p in TB.PHRASES) + "]"
    n = TB.N_PHRASES
    tr = f"translate(lower(text), {q(TB.LATIN)}, {q(TB.ARABIC26)})"
    return (f"SELECT doc_id, CASE WHEN kind = 'blank' THEN '' WHEN kind = 'latin' THEN text "
            f"WHEN kind = 'plain' THEN {tr} ELSE phrase || chr(10) || {tr} END AS text, lang, source, kind "
            f"FROM (SELECT *, {kinds}[doc_id % {n} + 1] AS kind, {phrases}[doc_id % {n} + 1] AS phrase "
            f"FROM documents) __a")


def sft_sql() -> str:
    return ("SELECT conv_id, turn, text AS instruction, next_text AS response FROM ("
            "SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text, "
            "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) __c "
            "WHERE role = 'user' AND next_role = 'assistant'")


def pairs_sql() -> str:
    one = ("(SELECT l.doc_id, d.text, row_number() OVER (ORDER BY l.doc_id) AS rn, count(*) OVER () AS n FROM labels l "
           "JOIN documents d USING (doc_id) WHERE l.quality = {})")
    return ("SELECT greatest(g.rn, b.rn) AS id, split_part(g.text, chr(10), 1) AS prompt, g.text AS chosen, b.text AS rejected, "
            f"g.doc_id AS chosen_id, b.doc_id AS rejected_id FROM {one.format(1)} g JOIN {one.format(0)} b "
            "ON CASE WHEN g.n >= b.n THEN (g.rn - 1) % b.n + 1 = b.rn ELSE (b.rn - 1) % g.n + 1 = g.rn END")


def kto_sql() -> str:
    return ("SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS prompt, d.text AS completion, "
            "l.quality AS label, l.toxic FROM documents d JOIN labels l USING (doc_id)")


def scores_sql(seed: int = 7) -> str:
    nc = nwords("chosen")
    nr = nwords("rejected")

    def lp(tag, n):
        return f"(-({u(seed, f'concat({q(tag)}, CAST(id AS VARCHAR))')} * 2.0 + 0.1) * {n})"
    return (f"SELECT id, {lp('pc', nc)} AS lp_chosen, {lp('pr', nr)} AS lp_rejected, "
            f"{lp('rc', nc)} AS ref_chosen, {lp('rr', nr)} AS ref_rejected, "
            f"CAST({nc} AS BIGINT) AS n_chosen, CAST({nr} AS BIGINT) AS n_rejected FROM pairs")


def runs_sql() -> str:
    ds = "[" + ", ".join(q(x) for x in TB.RUN_DATASETS) + "]"
    return ("SELECT method, dataset, CASE WHEN avg_value > 50.0 THEN 'failed' ELSE 'completed' END AS status, "
            "CAST(CAST(round(total_value) AS BIGINT) AS VARCHAR) || 's' AS training_time, "
            "CAST(epochs AS INTEGER) AS epochs, round(avg_value / 10.0, 6) AS final_loss, "
            "round(samples_trained / greatest(total_value, 0.001), 6) AS samples_per_second, samples_trained, "
            "'models/' || method || '_' || dataset AS checkpoint_path, "
            "strftime(last_ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM ("
            f"SELECT event_type AS method, {ds}[user_id % 3 + 1] AS dataset, count(*) AS samples_trained, "
            "sum(value) AS total_value, avg(value) AS avg_value, count(DISTINCT user_id) AS epochs, "
            "max(ts) AS last_ts FROM events GROUP BY 1, 2) __r")


def metric_log_sql() -> str:
    return ("SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, "
            "ts, value, event_id FROM events")


VIEWS = {
    "ar_docs": ar_docs_sql,
    "sft": sft_sql,
    "pairs": pairs_sql,
    "kto": kto_sql,
    "scores": scores_sql,
    "runs": runs_sql,
    "metric_log": metric_log_sql,
}
# Views that other views depend on.
_DEPS = {"scores": ["pairs"]}


def with_views(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views>, <extra ctes> <body>`` including view dependencies, in order."""
    order: list[str] = []

    def add(v):
        for d in _DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)
    for v in views:
        add(v)
    items = [(v, VIEWS[v]()) for v in order] + list(extra or [])
    if not items:
        return body
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in items)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


# ----------------------------------------------------------------- augmentation twins

WORD = r"\p{L}\p{N}_"


def _boundary_replace(t: str, src: str, dst: str) -> str:
    pat = f"(^|[^{WORD}]){src}([^{WORD}]|$)"
    once = f"regexp_replace({t}, {q(pat)}, {q(chr(92) + '1' + dst + chr(92) + '2')}, 'g')"
    return f"regexp_replace({once}, {q(pat)}, {q(chr(92) + '1' + dst + chr(92) + '2')}, 'g')"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def augment_text(t: str, dialect: str, key: str, seed: int = 42, ratio: float = L.AUGMENT_RATIO) -> str:
    rules = L.AUGMENT_RULES.get(dialect)
    if rules is None:
        return t
    for i, (src, dst) in enumerate(rules["transformations"]):
        fire = f"{u(seed, f'concat(CAST({key} AS VARCHAR), {q(f"|{dialect}|r{i}")})')} < {ratio}"
        t = f"(CASE WHEN {fire} THEN {_boundary_replace(t, src, dst)} ELSE {t} END)"
    k = f"concat(CAST({key} AS VARCHAR), {q(f'|{dialect}|w')}, CAST(i - 1 AS VARCHAR))"
    cases = []
    for word, choices in rules["synonyms"].items():
        pick = f"{lst(choices)}[CAST(floor({u(seed, f'concat({k}, {q(chr(99))})')} * {len(choices)}) + 1 AS INTEGER)]"
        cases.append(f"WHEN w = {q(word)} AND {u(seed, k)} < {ratio} THEN {pick}")
    swap = "CASE " + " ".join(cases) + " ELSE w END"
    return f"array_to_string(list_transform({words(t)}, lambda w, i: {swap}), ' ')"


def augment_for(t: str, dialect_sql: str, key: str, seed: int = 42, ratio: float = L.AUGMENT_RATIO) -> str:
    return ("CASE " + " ".join(f"WHEN {dialect_sql} = {q(d)} THEN {augment_text(t, d, key, seed, ratio)}"
                               for d in L.AUGMENT_DIALECTS) + f" ELSE {t} END")


# ----------------------------------------------------------------- text function twins

WORD_CHARS = r"\p{L}\p{N}_"


def letter_count(x: str) -> str:
    return char_count(x, r"\p{L}")


def arabic_letter_count(x: str, cls: str = L.AR2) -> str:
    return f"length({rr(rr(x, '[^' + cls + ']'), chr(92) + 'P{L}')})"


def div0(num: str, den: str) -> str:
    """num / den, 0.0 when den = 0 (or null)."""
    return f"coalesce(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / ({den}) END, 0.0)"


def lenx(x: str) -> str:
    return f"coalesce(length({x}), 0)"


def arabic_ratio_alpha(x):
    return div0(arabic_letter_count(x), letter_count(x))


def arabic_ratio_nonspace(x):
    return (f"CASE WHEN {lenx(x)} = 0 THEN 0.0 ELSE CAST({char_count(x, L.AR1)} AS DOUBLE) / "
            f"greatest(length({rr(x, WS_RUN)}), 1) END")


def arabic_ratio_block_alpha(x):
    return div0(char_count(x, L.AR1), letter_count(x))


def special_char_ratio(x):
    sp = f"length({rr(x, '[' + WORD_CHARS + L.WS + L.AR1 + ']')})"
    return f"CASE WHEN {lenx(x)} = 0 THEN 0.0 ELSE CAST({sp} AS DOUBLE) / greatest(length({x}), 1) END"


def word_repetition_ratio(x):
    w = words(f"lower({x})")
    return f"CASE WHEN len({w}) <= 1 THEN 0.0 ELSE CAST(len({w}) - len(list_distinct({w})) AS DOUBLE) / len({w}) END"


def ngrams(w: str, n: int) -> str:
    shifted = ", ".join([w] + [f"{w}[{k + 1}:]" for k in range(1, n)])
    joined = "concat_ws(' ', " + ", ".join(f"p[{k + 1}]" for k in range(n)) + ")"
    return (f"CASE WHEN len({w}) >= {n} THEN list_transform(list_zip({shifted}), lambda p: {joined})"
            f"[1:len({w}) - {n - 1}] ELSE [] END")


def trigram_repetition(x):
    w = words(x)
    tri = ngrams(w, 3)
    return f"CASE WHEN len({w}) < 10 THEN 0.0 ELSE 1.0 - CAST(len(list_distinct({tri})) AS DOUBLE) / len({tri}) END"


def normalized_hash(x):
    return f"md5({rr(strip(f'lower({x})'), WS_RUN, ' ')})"


def shingles(x, n=3):
    w = words(f"lower({x})")
    return f"CASE WHEN len({w}) < {n} THEN [array_to_string({w}, ' ')] ELSE list_distinct({ngrams(w, n)}) END"


def jaccard(a, b, empty_both=1.0):
    return (f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty_both} ELSE "
            f"CAST(len(list_intersect(list_distinct({a}), list_distinct({b}))) AS DOUBLE) / "
            f"len(list_distinct(list_concat({a}, {b}))) END")


def word_set(x):
    return f"list_distinct({words(f'lower({x})')})"


def sim(a, b):
    return jaccard(word_set(a), word_set(b))


def distinct_ratio(x):
    w = words(x)
    return f"coalesce(CASE WHEN len({w}) = 0 THEN NULL ELSE CAST(len(list_distinct({w})) AS DOUBLE) / len({w}) END, 0.0)"


def quality(x):
    w = words(x)
    return (f"(0.3 * least(length({x}) / 100.0, 1.0) + 0.7 * len(list_distinct({w})) / "
            f"CAST(greatest(len({w}), 1) AS DOUBLE))")


def classify_instruction(x):
    low = f"lower({x})"
    return ("CASE " + " ".join(f"WHEN regexp_matches({low}, {q('|'.join(p))}) THEN {q(n)}"
                               for n, p in L.INSTRUCTION_TYPES) + " ELSE 'other' END")


def format_compliance(ins, resp):
    low = f"lower({resp})"
    n = nwords(resp)
    art = " OR ".join(f"contains({low}, {q(a)})" for a in L.TEMPLATE_ARTIFACTS)
    checks = [f"{strip(resp)} <> ''", f"{n} BETWEEN 5 AND 500", f"NOT contains({low}, lower({ins}))", f"NOT ({art})"]
    return "((" + " + ".join(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for c in checks) + ") / 4.0)"


def response_quality(x):
    w = words(x)
    n = f"len({w})"
    ls = f"CASE WHEN {n} BETWEEN 10 AND 100 THEN 1.0 WHEN {n} BETWEEN 5 AND 200 THEN 0.5 ELSE 0.0 END"
    dv = f"CASE WHEN {n} > 0 THEN CAST(len(list_distinct({w})) AS DOUBLE) / {n} ELSE 0.0 END"
    co = f"CASE WHEN len(string_split({x}, '.')) > 1 THEN 0.5 ELSE 0.0 END"
    return f"CASE WHEN {strip(x)} = '' THEN 0.0 ELSE {ls} + {dv} + {co} END"


def arabic_quality(x):
    qs = " OR ".join(f"contains({x}, {q(t)})" for t in ("ما", "كيف", "لماذا", "أين", "متى"))
    return (f"least((CASE WHEN regexp_matches({x}, {q('[' + L.AR1 + ']')}) THEN 0.3 ELSE 0.0 END) + "
            f"(CASE WHEN regexp_matches({x}, {q('[' + L.HARAKAT + ']')}) THEN 0.2 ELSE 0.0 END) + "
            f"(CASE WHEN contains({x}, '.') THEN 0.3 ELSE 0.0 END) + "
            f"(CASE WHEN {qs} THEN 0.2 ELSE 0.0 END), 1.0)")


def coherence_simple(x):
    return f"least(len(string_split({x}, '.')) / CAST(greatest({nwords(x)}, 1) AS DOUBLE), 1.0)"


def dpo_strength(c, r):
    s = (f"(0.4 * ({quality(c)} - {quality(r)}) + 0.3 * ({distinct_ratio(c)} - {distinct_ratio(r)}) + "
         f"0.3 * ({coherence_simple(c)} - {coherence_simple(r)}))")
    return f"greatest(0.0, least(1.0, ({s} + 1.0) / 2.0))"


def length_normalized_quality(qx, n, method="sqrt", mean=None, std=None):
    n = f"CAST({n} AS DOUBLE)"
    if method == "none":
        return qx
    if method == "sqrt":
        return f"CASE WHEN {n} = 0 THEN NULL ELSE {qx} / sqrt({n}) END"
    if method == "log":
        return f"{qx} / greatest(1.0, ln({n} + 1.0))"
    if method == "linear":
        return f"{qx} / greatest(1.0, {n} / 100.0)"
    if method == "adaptive":
        return f"{qx} / greatest(1.0 + (({n} - {mean}) / greatest({std}, 1.0)) * 0.1, 0.1)"
    raise ValueError(method)


def ipo_strength(c, r, method="sqrt"):
    return (f"({length_normalized_quality(quality(c), f'length({c})', method)} - "
            f"{length_normalized_quality(quality(r), f'length({r})', method)})")


def length_bias(c, r):
    ratio = f"(length({c}) / CAST(greatest(length({r}), 1) AS DOUBLE))"
    diff = f"({quality(c)} - {quality(r)})"
    return (f"least(CASE WHEN {ratio} > 1.5 AND {diff} < 0.1 THEN ({ratio} - 1.0) * (0.1 - {diff}) "
            f"WHEN {ratio} < 0.67 AND {diff} > -0.1 THEN (1.0 - {ratio}) * ({diff} + 0.1) ELSE 0.0 END, 1.0)")


def count_sub(x, s):
    return f"(length({x}) - length(replace({x}, {q(s)}, '')))"


def feature_list(x):
    w = words(x)
    return [f"length({x})", f"len({w})", f"len(list_distinct({w}))", count_sub(x, "؟"), count_sub(x, "!"),
            count_sub(x, "."), char_count(x, r"\p{Nd}"), char_count(x, r"\p{Lu}")]


def clean_text_all(x):
    return clean_text(x, True, True, True, True)


# ----------------------------------------------------------------- Arabic metric twins

def _contains_count(x, terms):
    return "(" + " + ".join(f"CAST(contains({x}, {q(t)}) AS INTEGER)" for t in terms) + ")"


def sentences(x, drop_blank=False):
    s = f"string_split_regex({x}, '[.!?]')"
    if drop_blank:
        s = f"list_filter(list_transform({s}, lambda z: {strip('z')}), lambda z: z <> '')"
    return s


def sum_words_per_sentence(sents):
    return f"list_sum(list_transform({sents}, lambda z: len({words('z')})))"


def evaluator_dialect(x):
    low = f"lower({x})"
    sc = {"msa": _contains_count(low, L.EVAL_FORMAL_INDICATORS) + " * 2"}
    for d in L.EVAL_DIALECT_ORDER:
        sc[d] = _contains_count(low, L.EVAL_DIALECT_MARKERS[d])
    order = ["msa"] + L.EVAL_DIALECT_ORDER
    best = "greatest(" + ", ".join(sc[d] for d in order) + ")"
    return "CASE " + " ".join(f"WHEN {sc[d]} = {best} THEN '{d}'" for d in order) + " ELSE 'msa' END"


def repeated_distinct(arr):
    srt = f"list_sort({arr})"
    eq = f"list_transform(list_zip({srt}, {srt}[2:]), lambda p: p[1] = p[2])"
    eqf = f"list_filter({eq}, lambda z: z IS NOT NULL)"
    starts = f"list_transform(list_zip({eqf}, list_concat([false], {eqf})), lambda p: p[1] AND NOT p[2])"
    return f"len(list_filter({starts}, lambda z: z IS NOT NULL AND z))"


def arabic_row_scores(x, target="msa", diacritics=True):
    w = words(x)
    nw = f"len({w})"
    sents = sentences(x)
    clean = sentences(x, True)
    letters = letter_count(x)
    ar_letters = arabic_letter_count(x)
    ar_any = f"regexp_matches({x}, {q('[' + L.AR2 + ']')})"
    latin = f"({letters} - {ar_letters})"
    latin_ratio = f"(CAST({latin} AS DOUBLE) / greatest({letters}, 1))"
    avg_sent = f"(CAST({sum_words_per_sentence(sents)} AS DOUBLE) / greatest(len({sents}), 1))"
    dial = "(" + " + ".join(_contains_count(f"lower({x})", L.EVAL_DIALECT_MARKERS[d]) for d in L.EVAL_DIALECT_ORDER) + ")"
    form = f"CAST({_contains_count(x, L.EVAL_FORMAL_INDICATORS)} AS DOUBLE) / greatest({nw}, 1) * 0.4"
    if diacritics:
        form += f" + least(CAST({char_count(x, L.HARAKAT)} AS DOUBLE) / greatest(length({x}), 1), 0.1) * 0.3"
    form += f" - CAST({dial} AS DOUBLE) / greatest({nw}, 1) * 0.3 + CASE WHEN {avg_sent} > 10 THEN 0.2 ELSE 0.0 END"
    form = f"greatest(0.0, least(1.0, {form}))"
    grammar = (f"greatest(0.0, 1.0 - len(list_filter({w}, lambda z: starts_with(z, {q(L.DOUBLE_ARTICLE)}))) * 0.1 "
               f"- len(list_filter({clean}, lambda z: len({words('z')}) < 3)) * 0.05)")
    avg_wlen = f"(CAST(list_sum(list_transform({w}, lambda z: length(z))) AS DOUBLE) / {nw})"
    punct = f"regexp_matches({x}, '[.!?]')"
    fluency = (f"(CASE WHEN {nw} > 0 AND {avg_wlen} >= 3 AND {avg_wlen} <= 8 THEN 0.3 ELSE 0.0 END + "
               f"CASE WHEN {avg_sent} >= 5 AND {avg_sent} <= 20 THEN 0.3 ELSE 0.0 END + "
               f"CASE WHEN {nw} > 0 AND CAST(len(list_distinct({w})) AS DOUBLE) / {nw} > 0.7 THEN 0.2 ELSE 0.0 END + "
               f"CASE WHEN {punct} THEN 0.2 ELSE 0.0 END)")
    nclean = f"len({clean})"
    keys = f"list_filter({w}, lambda z: length(z) > 4 AND regexp_matches(substr(z, 1, 1), {q('^[' + L.AR2 + ']')}))"
    coherence = (f"CASE WHEN {nclean} > 1 THEN least(CAST({_contains_count(x, L.COHERENCE_CONNECTORS)} AS DOUBLE) / {nclean}, 0.5) "
                 f"+ least(CAST({repeated_distinct(keys)} AS DOUBLE) / {nclean}, 0.5) ELSE 0.8 END")
    readability = (f"greatest(0.0, CASE WHEN {nw} > 0 AND {nclean} > 0 THEN 1.0 - CASE WHEN {avg_wlen} > 8 THEN 0.2 ELSE 0.0 END "
                   f"- CASE WHEN CAST({nw} AS DOUBLE) / {nclean} > 15 THEN 0.2 ELSE 0.0 END "
                   f"- CAST(len(list_filter({w}, lambda z: length(z) > 10)) AS DOUBLE) / {nw} * 0.3 "
                   f"- CASE WHEN NOT {punct} THEN 0.2 ELSE 0.0 END ELSE 1.0 END)")
    arw = f"list_filter({w}, lambda z: regexp_matches(z, {q('[' + L.AR2 + ']')}))"
    return {
        "ar_letters": ar_letters, "letters": letters, "ar_words": f"len({arw})",
        "diac_words": f"len(list_filter({arw}, lambda z: regexp_matches(z, {q('[' + L.HARAKAT + ']')})))",
        "script_ok": f"CAST((({ar_any}) AND ({latin} = 0 OR {latin_ratio} < 0.1)) OR (NOT ({ar_any}) AND {latin} > 0) AS DOUBLE)",
        "dialect_hit": f"CAST(({evaluator_dialect(x)}) = {q(target)} AS DOUBLE)",
        "formality": form, "grammar": grammar, "fluency": fluency, "coherence": coherence, "readability": readability,
        "religious": "CAST((" + " OR ".join(f"contains({x}, {q(t)})" for t in L.RELIGIOUS_TERMS) + ") AS DOUBLE)",
    }


def is_quality_text(c, min_length=10, max_length=2000, min_words=3, max_repetition=0.5, min_arabic=0.7, max_special=0.2):
    t = strip(c)
    return (f"coalesce(coalesce(length({t}), 0) > 0 AND length({t}) >= {min_length} AND length({t}) <= {max_length} AND "
            f"{nwords(t)} >= {min_words} AND {word_repetition_ratio(t)} <= {max_repetition} AND "
            f"{arabic_ratio_nonspace(t)} >= {min_arabic} AND {special_char_ratio(t)} <= {max_special}, false)")


def quality_score(c, min_arabic=0.7, max_repetition=0.3):
    ar, rep, n = arabic_ratio_block_alpha(c), trigram_repetition(c), nwords(c)
    return (f"greatest(1.0 - CASE WHEN {ar} < {min_arabic} THEN 0.3 ELSE 0.0 END - CASE WHEN {rep} > {max_repetition} "
            f"THEN 0.4 ELSE 0.0 END - CASE WHEN {n} < 5 THEN 0.2 WHEN {n} > 1000 THEN 0.1 ELSE 0.0 END, 0.0)")
