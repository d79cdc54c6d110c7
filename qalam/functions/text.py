"""Column -> Column text functions.

All functions are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen. Whitespace follows Python's ``str.isspace`` set (see
``lexicon.WS``), so ``py_words`` equals ``str.split()`` and ``py_strip``
equals ``str.strip()``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

WS_RUN = f"[{L.WS}]+"
# Python's Unicode \w: letters, numbers, underscore.
WORD_CHARS = r"\p{L}\p{N}_"
_EDGE_WS = f"^[{L.WS}]+|[{L.WS}]+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------- basics

def once(value, fn) -> Column:
    """``fn(value)``, with ``value`` computed once however often ``fn`` names it.

    Spark shares equal expressions neither inside lambdas nor between the
    branches of a condition; the variable of a lambda is computed once.
    """
    return F.element_at(F.transform(F.array(col(value)), fn), 1)


# The same whitespace set as literal characters, for the (regex-free) trim.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace, not only
    spaces (a character-set ``trim``, no regex)."""
    return F.trim(col(c), F.lit(WS_CHARS))


def py_words(c) -> Column:
    """Python ``str.split()``: whitespace runs as separators, no empty pieces."""
    return F.array_remove(F.split(F.translate(col(c), WS_CHARS, " " * len(WS_CHARS)), " "), "")


def word_count(c) -> Column:
    return F.size(py_words(c))


def sentences(c, drop_blank: bool = False) -> Column:
    """``re.split('[.!?]', t)``; keeps empty pieces unless ``drop_blank``."""
    parts = F.split(col(c), "[.!?]", -1)
    if drop_blank:
        parts = F.filter(F.transform(parts, py_strip), lambda s: s != "")
    return parts


def char_count(c, char_class: str) -> Column:
    """Number of characters of ``c`` inside the regex character class."""
    return F.length(F.regexp_replace(col(c), f"[^{char_class}]", ""))


def is_blank(c) -> Column:
    return col(c).isNull() | (py_strip(c) == "")


# ----------------------------------------------------------------- C1, C2, C3, C4

def has_arabic(c) -> Column:
    """Any character from the five Arabic blocks; null text is False."""
    return F.coalesce(col(c).rlike(f"[{L.AR5}]"), F.lit(False))


def clean_text(c, remove_extra_whitespace: bool = True, remove_special_chars: bool = False,
               normalize_arabic: bool = True, remove_diacritics: bool = False) -> Column:
    """Whitespace, alef/yeh/teh folding, diacritics, special chars; then strip."""
    t = col(c)
    if remove_extra_whitespace:
        t = py_strip(F.regexp_replace(t, WS_RUN, " "))
    if normalize_arabic:
        t = F.translate(t, L.ALEF_VARIANTS + L.ALEF_MAKSURA + L.TEH_MARBUTA,
                        L.ALEF * len(L.ALEF_VARIANTS) + L.YEH + L.HEH)
    if remove_diacritics:
        t = F.regexp_replace(t, f"[{L.CLEAN_DIACRITICS}]", "")
    if remove_special_chars:
        t = F.regexp_replace(t, f"[^{L.AR5}{L.CLEAN_KEEP_ASCII}{L.WS}]", "")
    return py_strip(t)


def normalize_dialect(c) -> Column:
    """The detector's normaliser, rules in their fixed order.

    Non-Arabic removal runs after whitespace collapsing, so removed
    characters between spaces can leave double spaces behind.
    """
    t = py_strip(c)
    # one pass folds letters, makes all white space spaces and drops diacritics (they have no counterpart)
    t = F.translate(t, L.ALEF_VARIANTS + L.TEH_MARBUTA + L.YEH_VARIANTS + WS_CHARS + L.DETECT_DIACRITIC_CHARS,
                    L.ALEF * len(L.ALEF_VARIANTS) + L.HEH + L.YEH * len(L.YEH_VARIANTS) + " " * len(WS_CHARS))
    t = F.regexp_replace(t, "  +", " ")
    # spaces are the only white space left; most characters pass the first, short class, the look-behind sees the rest
    main, rest = L.AR5[:len(r"\x{0600}-\x{06FF}")], L.AR5[len(r"\x{0600}-\x{06FF}"):]
    t = F.regexp_replace(t, f"[^{main} ](?<![{rest}])", "")
    return py_strip(t)


def normalize_arabic(c, normalize_alef: bool = True, normalize_teh: bool = True,
                     normalize_yeh: bool = True, remove_tatweel: bool = True,
                     remove_diacritics: bool = True, normalize_spaces: bool = True) -> Column:
    """C4: processor-style normaliser; teh marbuta goes to teh, alef to hamza-alef."""
    t = col(c)
    if remove_diacritics:
        t = F.regexp_replace(t, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    if remove_tatweel:
        t = F.regexp_replace(t, r"\x{0640}", "")
    if normalize_alef:
        t = F.translate(t, "إآا", "أأأ")
    if normalize_teh:
        t = F.translate(t, L.TEH_MARBUTA, L.TEH)
    if normalize_yeh:
        t = F.translate(t, L.ALEF_MAKSURA, L.YEH)
    if normalize_spaces:
        t = py_strip(F.regexp_replace(t, WS_RUN, " "))
    return t


ARABIC_PUNCT_FROM = "؟،؛"
ARABIC_PUNCT_TO = "?,;"


def fold_arabic_punctuation(c) -> Column:
    """C5 (native part): Arabic question mark, comma, semicolon to ASCII."""
    return F.translate(col(c), ARABIC_PUNCT_FROM, ARABIC_PUNCT_TO)


ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def arabic_to_western_digits(c) -> Column:
    """C31."""
    return F.translate(col(c), ARABIC_DIGITS, "0123456789")


def western_to_arabic_digits(c) -> Column:
    return F.translate(col(c), "0123456789", ARABIC_DIGITS)


def fix_common_issues(c) -> Column:
    """Drop NUL characters and collapse whitespace."""
    return py_strip(F.regexp_replace(F.regexp_replace(col(c), r"\x{0000}", ""), WS_RUN, " "))


def fix_encoding(c) -> Column:
    """C6 fix (native part): drop bidi overrides and zero-width characters,
    then mend the two letters most often seen in the wrong encoding. NFKC,
    which comes first in C5, is the Arrow function ``udfs.nfkc``."""
    t = F.regexp_replace(col(c), r"[\x{202D}\x{202E}\x{200B}-\x{200D}]", "")
    for wrong, right in L.MOJIBAKE:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


# ----------------------------------------------------------------- C8, C9, C11-C16

def truncate_text(c, max_length: int = 100, suffix: str = "...") -> Column:
    """Cut to ``max_length`` characters including the suffix."""
    t = col(c)
    keep = max_length - len(suffix)
    return F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.substring(t, 1, max(keep, 0)) if keep > 0 else F.lit(""), F.lit(suffix)))


def letter_count(c) -> Column:
    """Alphabetic characters (Python ``str.isalpha``): letters of any script."""
    return char_count(c, r"\p{L}")


def arabic_letter_count(c) -> Column:
    """Alphabetic characters inside AR2 (evaluator's Arabic char test)."""
    return F.length(F.regexp_replace(F.regexp_replace(col(c), f"[^{L.AR2}]", ""), r"\P{L}", ""))


def arabic_ratio_alpha(c) -> Column:
    """AR2 letters / letters; 0 when no letters."""
    return F.coalesce(F.try_divide(arabic_letter_count(c), letter_count(c)), F.lit(0.0))


def arabic_ratio_nonspace(c) -> Column:
    """AR1 characters / max(non-whitespace characters, 1); empty -> 0."""
    nonspace = F.length(F.regexp_replace(col(c), WS_RUN, ""))
    return F.when(F.coalesce(F.length(col(c)), F.lit(0)) == 0, F.lit(0.0)) \
        .otherwise(char_count(c, L.AR1) / F.greatest(nonspace, F.lit(1)))


def arabic_ratio_block_alpha(c) -> Column:
    """AR1 characters (any category) / alphabetic characters; 0 if none."""
    return F.coalesce(F.try_divide(char_count(c, L.AR1), letter_count(c)), F.lit(0.0))


def special_char_ratio(c) -> Column:
    """C11: characters outside word chars, whitespace and AR1, over max(len, 1)."""
    specials = F.length(F.regexp_replace(col(c), f"[{WORD_CHARS}{L.WS}{L.AR1}]", ""))
    return F.when(F.coalesce(F.length(col(c)), F.lit(0)) == 0, F.lit(0.0)) \
        .otherwise(specials / F.greatest(F.length(col(c)), F.lit(1)))


def word_repetition_ratio(c) -> Column:
    """sum(count-1) over lower-cased words / word count; <= 1 word -> 0."""
    return once(py_words(F.lower(col(c))), lambda w: F.when(F.size(w) <= 1, F.lit(0.0)).otherwise(
        (F.size(w) - F.size(F.array_distinct(w))) / F.size(w)))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined with a space; empty when fewer than n words.

    Built with ``zip_with`` over shifted slices, so the words array is read
    a fixed number of times per row (a lambda that indexed into it would
    re-evaluate the split once per position).
    """
    acc = words
    for k in range(1, n):
        acc = F.zip_with(acc, F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= n, F.slice(acc, 1, F.size(words) - n + 1)) \
        .otherwise(F.array().cast("array<string>"))


def trigram_repetition(c) -> Column:
    """1 - distinct/total trigrams; texts under 10 words give 0."""
    return once(py_words(c), trigram_repetition_of)


def trigram_repetition_of(words: Column) -> Column:
    """C13 of a text's words, which are named several times (see ``once``)."""
    return F.when(F.size(words) < 10, F.lit(0.0)).otherwise(once(ngrams(words, 3), lambda tri:
        1.0 - F.size(F.array_distinct(tri)) / F.size(tri)))


def normalized_hash(c) -> Column:
    """C14: md5 of lower-cased, stripped, whitespace-collapsed text."""
    return F.md5(F.regexp_replace(py_strip(F.lower(col(c))), WS_RUN, " "))


def shingles(c, n: int = 3) -> Column:
    """Distinct n-word shingles of the lower-cased text; short text -> whole text."""
    return once(py_words(F.lower(col(c))), lambda w: F.when(F.size(w) < n, F.array(F.array_join(w, " ")))
                .otherwise(F.array_distinct(ngrams(w, n))))


def jaccard(a: Column, b: Column, empty_both: float = 1.0) -> Column:
    """|a ∩ b| / |a ∪ b| over arrays treated as sets."""
    ua = F.array_union(a, b)
    return F.when(F.size(ua) == 0, F.lit(empty_both)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(ua))


def word_set(c) -> Column:
    return F.array_distinct(py_words(F.lower(col(c))))


def sim(a, b) -> Column:
    """Shared ``sim``: Jaccard of lower-cased word sets; both empty 1, one empty 0."""
    return jaccard(word_set(a), word_set(b), 1.0)


def distinct_ratio(c) -> Column:
    return once(py_words(c), lambda w: F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)))


def quality(c) -> Column:
    """Shared ``quality``: 0.3*min(len/100,1) + 0.7*distinct/max(words,1)."""
    return 0.3 * F.least(F.length(col(c)) / 100.0, F.lit(1.0)) + once(
        py_words(c), lambda w: 0.7 * F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))


# ----------------------------------------------------------------- C17-C19, C21

def classify_instruction(c) -> Column:
    """C17: first matching type over the lower-cased instruction, else 'other'."""
    low = F.lower(col(c))
    expr = None
    for name, pats in reversed(L.INSTRUCTION_TYPES):
        cond = low.rlike("|".join(pats))
        expr = F.when(cond, F.lit(name)).otherwise(expr if expr is not None else F.lit("other"))
    return expr


def format_compliance(instruction, response) -> Column:
    """Mean of four checks (non-empty, 5-500 words, no echo, no artefacts)."""
    r = col(response)
    low = F.lower(r)
    n = word_count(r)
    checks = [
        py_strip(r) != "",
        (n >= 5) & (n <= 500),
        ~F.contains(low, F.lower(col(instruction))),
        ~F.exists(F.array(*[F.lit(a) for a in L.TEMPLATE_ARTIFACTS]), lambda a: F.contains(low, a)),
    ]
    return sum(F.when(ch, 1.0).otherwise(0.0) for ch in checks) / 4.0


def response_quality(c) -> Column:
    """Length band + distinct ratio + 0.5 if more than one '.'-piece."""
    r = col(c)
    w = py_words(r)
    n = F.size(w)
    length_score = F.when((n >= 10) & (n <= 100), 1.0).when((n >= 5) & (n <= 200), 0.5).otherwise(0.0)
    diversity = F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0)
    coherence = F.when(F.size(F.split(r, r"\.", -1)) > 1, 0.5).otherwise(0.0)
    return F.when(py_strip(r) == "", F.lit(0.0)).otherwise(length_score + diversity + coherence)


def arabic_quality(c) -> Column:
    """0.3 Arabic + 0.2 diacritics + 0.3 more than one '.'-piece + 0.2 question word, capped at 1."""
    t = col(c)
    score = (F.when(t.rlike(f"[{L.AR1}]"), 0.3).otherwise(0.0)
             + F.when(t.rlike(f"[{L.HARAKAT}]"), 0.2).otherwise(0.0)
             + F.when(F.contains(t, F.lit(".")), 0.3).otherwise(0.0)
             + F.when(F.exists(F.array(*[F.lit(q) for q in L.QUALITY_QUESTION_WORDS]),
                               lambda q: F.contains(t, q)), 0.2).otherwise(0.0))
    return F.least(score, F.lit(1.0))


# ----------------------------------------------------------------- C23-C29

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero norm -> 0."""
    den = norm2(a) * norm2(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, v: acc + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)


def combined_similarity(a: Column, b: Column, temperature: float = 1.0) -> Column:
    return (cosine(a, b) - euclidean(a, b) / 10.0 + manhattan(a, b) / 100.0) / temperature


def length_normalized_quality(q: Column, length: Column, method: str = "sqrt",
                              mean: Column | None = None, std: Column | None = None) -> Column:
    """Quality divided by a length factor.

    none: q; sqrt: q / sqrt(len); log: q / max(1, ln(len+1)); linear:
    q / max(1, len/100); adaptive: q / max(1 + 0.1 z, 0.1) with
    z = (len - mean) / max(std, 1) over the dataset. A zero length under
    ``sqrt`` gives null rather than an error.
    """
    q = col(q)
    n = col(length).cast("double")
    if method == "none":
        return q
    if method == "sqrt":
        return F.try_divide(q, F.sqrt(n))
    if method == "log":
        return q / F.greatest(F.lit(1.0), F.log(n + 1.0))
    if method == "linear":
        return q / F.greatest(F.lit(1.0), n / 100.0)
    if method == "adaptive":
        z = (n - mean) / F.greatest(std, F.lit(1.0))
        return q / F.greatest(1.0 + z * 0.1, F.lit(0.1))
    raise ValueError(f"unknown length normalisation {method!r}")


def percentile_factor(length: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Piecewise factor from the dataset's length quartiles."""
    n = col(length).cast("double")
    return (F.when(n <= p25, F.lit(1.0))
            .when(n <= p50, 1.0 + (n - p25) / (p50 - p25) * 0.1)
            .when(n <= p75, 1.1 + (n - p50) / (p75 - p50) * 0.2)
            .otherwise(1.3 + (n - p75) / F.greatest(p75, F.lit(1.0)) * 0.3))


def rank_factor(pct_rank: Column) -> Column:
    """Factor from a percentile rank in [0, 100]."""
    r = col(pct_rank)
    return (F.when(r > 80, 1.0 + (r - 80) / 20.0 * 0.5)
            .when(r < 20, 1.0 - (20 - r) / 20.0 * 0.2).otherwise(F.lit(1.0)))


def length_bias(chosen, rejected) -> Column:
    """Bias when the longer answer wins without a quality edge; cap 1."""
    ratio = F.length(col(chosen)) / F.greatest(F.length(col(rejected)), F.lit(1))
    diff = quality(chosen) - quality(rejected)
    return F.least(F.when((ratio > 1.5) & (diff < 0.1), (ratio - 1.0) * (0.1 - diff))
                   .when((ratio < 0.67) & (diff > -0.1), (1.0 - ratio) * (diff + 0.1))
                   .otherwise(F.lit(0.0)), F.lit(1.0))


def coherence_simple(c) -> Column:
    """Shared ``coh``: min(|split('.')| / max(words, 1), 1)."""
    return F.least(F.size(F.split(col(c), r"\.", -1)) / F.greatest(word_count(c), F.lit(1)), F.lit(1.0))


def dpo_strength(chosen, rejected) -> Column:
    """C28 DPO: clamp((0.4 dq + 0.3 dinfo + 0.3 dcoh + 1) / 2, 0, 1)."""
    s = (0.4 * (quality(chosen) - quality(rejected)) + 0.3 * (distinct_ratio(chosen) - distinct_ratio(rejected))
         + 0.3 * (coherence_simple(chosen) - coherence_simple(rejected)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1.0) / 2.0))


def ipo_strength(chosen, rejected, method: str = "sqrt") -> Column:
    """C28 IPO: difference of length-normalised qualities (identity map)."""
    return length_normalized_quality(quality(chosen), F.length(col(chosen)), method) - \
        length_normalized_quality(quality(rejected), F.length(col(rejected)), method)


def feature_vector(c, size: int = 128) -> Column:
    """8 counts / their max, zero-padded to ``size``."""
    t = col(c)
    w = py_words(t)
    feats = [F.length(t), F.size(w), F.size(F.array_distinct(w)),
             F.length(t) - F.length(F.replace(t, F.lit("؟"), F.lit(""))),
             F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
             F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))),
             char_count(t, r"\p{Nd}"), char_count(t, r"\p{Lu}")]
    arr = F.array(*[f.cast("double") for f in feats])
    mx = F.array_max(arr)
    norm = F.transform(arr, lambda x: F.when(mx == 0, F.lit(0.0)).otherwise(x / mx))
    return F.concat(norm, F.array_repeat(F.lit(0.0), size - len(feats)))


def kto_utility(q: Column, desirable: Column, alpha: float = 0.88, lam: float = 2.25) -> Column:
    """q^alpha for desirable, -lambda (1-q)^alpha otherwise."""
    return F.when(desirable, F.pow(q, alpha)).otherwise(-lam * F.pow(1.0 - q, alpha))


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    """Division with a default for a zero denominator."""
    return F.when(den == 0, F.lit(default)).otherwise(num / den)


def _fixed(x: Column, digits: int) -> Column:
    """Python-style fixed-point text (correctly rounded on the binary value)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def format_duration(seconds: Column) -> Column:
    """Seconds -> '12.34s', '2m 3.0s' or '1h 2m 3.0s'."""
    s = col(seconds).cast("double")
    minutes = F.floor(s / 60).cast("long").cast("string")
    hours = F.floor(s / 3600).cast("long").cast("string")
    rem_min = F.floor((s % 3600) / 60).cast("long").cast("string")
    return (F.when(s < 60, F.concat(_fixed(s, 2), F.lit("s")))
            .when(s < 3600, F.concat(minutes, F.lit("m "), _fixed(s % 60, 1), F.lit("s")))
            .otherwise(F.concat(hours, F.lit("h "), rem_min, F.lit("m "), _fixed(s % 60, 1), F.lit("s"))))


def format_bytes(n: Column) -> Column:
    """Bytes -> '1.50 KB' etc."""
    b = col(n).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = F.concat(_fixed(b / (1024.0 ** 5), 2), F.lit(" PB"))
    for i in reversed(range(len(units))):
        v = b / (1024.0 ** i)
        expr = F.when(v < 1024.0, F.concat(_fixed(v, 2), F.lit(f" {units[i]}"))).otherwise(expr)
    return expr


def experiment_name(method, model_name, dataset_name) -> Column:
    """C29 without timestamp: lower-case, '-' -> '_', last path segment."""
    def last(c):
        return F.lower(F.replace(F.element_at(F.split(col(c), "/"), -1), F.lit("-"), F.lit("_")))
    return F.concat_ws("_", F.lower(F.replace(col(method), F.lit("-"), F.lit("_"))),
                       last(model_name), last(dataset_name))


# ----------------------------------------------------------------- randomness

def u(seed, key) -> Column:
    """Portable uniform in [0,1): first 32 bits of md5('<seed>|<key>').

    Partition-independent and reproducible in any SQL engine with md5.
    """
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string"))), 1, 8), 16, 10) \
        .cast("bigint") / 4294967296.0


def u_below(seed, key, p: float) -> Column:
    """``u(seed, key) < p``, compared on the hexadecimal digits: no number is made of them."""
    bound = math.ceil(p * 4294967296.0)
    digits = "" if bound <= 0 else "g" if bound > 0xFFFFFFFF else f"{bound:08x}"
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string"))) < digits


# ----------------------------------------------------------------- C6, C10, C30

def encoding_issues(c) -> Column:
    """List of issue codes (question marks next to Arabic, bidi overrides, bytes that are no UTF-8)."""
    t = col(c)
    return F.array_compact(F.array(
        F.when(F.contains(t, F.lit("?")) & t.rlike(f"[{L.AR5}]"), F.lit("question_marks_with_arabic")),
        F.when(t.rlike(r"[\x{202D}\x{202E}]"), F.lit("rtl_ltr_override")),
        F.when(~F.is_valid_utf8(t), F.lit("unicode_encode_error"))))


def content_validity(c) -> Column:
    """(valid, reason, ratio): empty / no letters / ratio < 0.5."""
    t = col(c)
    letters = letter_count(t)
    ratio = F.length(F.regexp_replace(F.regexp_replace(t, f"[^{L.AR1}]", ""), r"\P{L}", "")) / letters
    reason = (F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit("empty"))
              .when(letters == 0, F.lit("no_letters"))
              .when(ratio < 0.5, F.lit("low_arabic")).otherwise(F.lit("valid")))
    return F.struct((reason == "valid").alias("valid"), reason.alias("reason"),
                    F.when(letters > 0, ratio).otherwise(F.lit(0.0)).alias("ratio"))


def diacritized_word_flags(c) -> Column:
    """Per word, whether it carries a diacritic (U+064B-065F)."""
    return F.transform(py_words(c), lambda w: w.rlike(f"[{L.HARAKAT}]"))


def diacritic_count(c) -> Column:
    return char_count(c, L.HARAKAT)
