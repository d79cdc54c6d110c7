"""Schema resolution and templating.

Which source columns hold the instruction, response, prompt and so on is
decided once from ``df.columns`` at plan time (the reference checks column
presence per dataset); per-row choices are ``coalesce``/``when``
expressions. Nothing here shuffles except the ranking-to-pairs expansion
(B12), which joins responses within a prompt group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

SFT_PATTERNS = [("instruction", "response"), ("input", "output"), ("prompt", "completion"), ("question", "answer")]


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def resolve_sft(df: DataFrame, response_template: str = L.SFT_RESPONSE_TEMPLATE) -> DataFrame:
    """B1: (instruction, response) by the first column pattern present.

    A ``text`` column is split once on the response template (no match:
    instruction '' and the whole text as response); ``conversations`` takes
    the values of its first two turns.
    """
    for a, b in SFT_PATTERNS:
        if _has(df, a, b):
            return df.withColumn("__i", F.col(a)).withColumn("__r", F.col(b)) \
                .withColumnRenamed("__i", "instruction_").withColumnRenamed("__r", "response_") \
                .drop(*[c for c in ("instruction", "response") if c in df.columns]) \
                .withColumnRenamed("instruction_", "instruction").withColumnRenamed("response_", "response")
    if "text" in df.columns:
        t = F.col("text")
        hit = F.contains(t, F.lit(response_template))
        parts = F.split(t, _literal_regex(response_template), 2)
        return df.withColumn("instruction", F.when(hit, T.py_strip(F.element_at(parts, 1))).otherwise(F.lit(""))) \
            .withColumn("response", F.when(hit, T.py_strip(F.element_at(parts, 2))).otherwise(t))
    if "conversations" in df.columns:
        conv = F.col("conversations")
        ok = F.size(conv) >= 2
        return df.withColumn("instruction", F.when(ok, F.coalesce(conv[0]["value"], F.lit("")))) \
            .withColumn("response", F.when(ok, F.coalesce(conv[1]["value"], F.lit(""))))
    return df.withColumn("instruction", F.lit(None).cast("string")).withColumn("response", F.lit(None).cast("string"))


def _literal_regex(s: str) -> str:
    import re
    return re.escape(s).replace("\\ ", " ")


def extract_instruction(df: DataFrame, text_col: str = "text") -> Column:
    """B2: first non-empty field of instruction/prompt/input/question/query
    (stripped); else the first of four DOTALL patterns over the text."""
    cands = [F.when(F.col(c) != "", T.py_strip(F.col(c))) for c in L.INSTRUCTION_FIELDS if c in df.columns]
    if text_col in df.columns:
        for p in L.INSTRUCTION_PATTERNS:
            pat = "(?s)" + p.replace(r"\s", f"[{L.WS}]")
            cands.append(F.when(F.col(text_col).rlike(pat), T.py_strip(F.regexp_extract(text_col, pat, 1))))
    return F.coalesce(*cands) if cands else F.lit(None).cast("string")


def extract_response(df: DataFrame, text_col: str = "text") -> Column:
    """response/output/answer/completion/target, else four patterns that
    end at the next marker or the end of the text."""
    cands = [F.when(F.col(c) != "", T.py_strip(F.col(c))) for c in L.RESPONSE_FIELDS if c in df.columns]
    if text_col in df.columns:
        for p in L.RESPONSE_PATTERNS:
            pat = "(?s)" + p.replace(r"\s", f"[{L.WS}]")
            cands.append(F.when(F.col(text_col).rlike(pat), T.py_strip(F.regexp_extract(text_col, pat, 1))))
    return F.coalesce(*cands) if cands else F.lit(None).cast("string")


def extract_text(df: DataFrame) -> Column:
    """Text, response, completion, chosen, else the first string column
    whose value is longer than 10 characters."""
    for c in ("text", "response", "completion", "chosen"):
        if c in df.columns:
            return F.col(c)
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return F.coalesce(*[F.when(F.length(c) > 10, F.col(c)) for c in strings]) if strings else F.lit(None)


def common_prefix_len(a: Column, b: Column) -> Column:
    """Length of the longest common character prefix (B6), linear per row:
    both texts are split into characters once and compared pairwise."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    first_diff = F.array_position(same, False)
    return F.when(n == 0, F.lit(0)).when((first_diff == 0) | (first_diff > n), n).otherwise(first_diff - 1)


def split_common_prefix(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt = common prefix; the three parts are stripped."""
    k = common_prefix_len(F.col(chosen), F.col(rejected))
    staged = df.withColumn("__k", k)
    return staged.select(
        *[c for c in df.columns if c not in (chosen, rejected, "prompt")],
        T.py_strip(F.expr(f"substring({chosen}, 1, __k)")).alias("prompt"),
        T.py_strip(F.expr(f"substring({chosen}, __k + 1)")).alias("chosen"),
        T.py_strip(F.expr(f"substring({rejected}, __k + 1)")).alias("rejected"))


def resolve_pairwise(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) from the first shape present."""
    if _has(df, "prompt", "chosen", "rejected"):
        return df
    if _has(df, "question", "answer_a", "answer_b"):
        pref = "preference" if "preference" in df.columns else ("chosen" if "chosen" in df.columns else None)
        a_wins = (F.col(pref).cast("string").isin("a", "0")) if pref else F.lit(False)
        return df.select(*[c for c in df.columns if c not in ("prompt", "chosen", "rejected")],
                         F.col("question").alias("prompt"),
                         F.when(a_wins, F.col("answer_a")).otherwise(F.col("answer_b")).alias("chosen"),
                         F.when(a_wins, F.col("answer_b")).otherwise(F.col("answer_a")).alias("rejected"))
    if _has(df, "chosen", "rejected"):
        return split_common_prefix(df)
    if "conversations" in df.columns:
        ch = F.col("conversations")["chosen"]
        rj = F.col("conversations")["rejected"]
        return df.withColumn("prompt", F.when(F.size(ch) >= 2, F.element_at(ch, -2)["value"])) \
            .withColumn("chosen", F.when(F.size(ch) >= 2, F.element_at(ch, -1)["value"])) \
            .withColumn("rejected", F.when(F.size(rj) >= 1, F.element_at(rj, -1)["value"]))
    return df


def binary_label(c: Column, source_type: str = "string") -> Column:
    """1 when the value is one of 1, '1', True, 'true', 'desirable',
    'good' (exact, case-sensitive: 'True' as a string is 0). Decided on the
    source column type: booleans and numbers compare as values."""
    if source_type == "boolean":
        return F.when(c, 1).otherwise(0)
    if source_type in ("int", "bigint", "long", "double", "float"):
        return F.when(c == 1, 1).otherwise(0)
    return F.when(c.isin(*L.TRUE_LABEL_STRINGS), 1).otherwise(0)


def resolve_kto(df: DataFrame) -> DataFrame:
    """(prompt, completion, label): numeric rating >= 3, numeric score
    >= 0.5; non-numeric values pass through as their text."""
    if _has(df, "prompt", "completion", "label"):
        return df
    if _has(df, "input", "output", "rating"):
        num = F.col("rating").cast("double") if _numeric(df, "rating") else F.col("rating").try_cast("double")
        lab = F.when(num.isNotNull(), F.when(num >= 3, F.lit("1")).otherwise(F.lit("0"))).otherwise(
            F.col("rating").cast("string")) if not _numeric(df, "rating") else F.when(num >= 3, 1).otherwise(0)
        return df.select("*", F.col("input").alias("prompt"), F.col("output").alias("completion"), lab.alias("label"))
    if _has(df, "question", "answer", "score"):
        num = F.col("score").cast("double")
        lab = F.when(num >= 0.5, 1).otherwise(0) if _numeric(df, "score") else F.col("score").cast("string")
        return df.select("*", F.col("question").alias("prompt"), F.col("answer").alias("completion"), lab.alias("label"))
    return df


def _numeric(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")


# fixed values: label words
GOOD_WORDS = ["good", "positive", "1", "true", "yes", "accept", "preferred", "high", "excellent", "great", "جيد", "ممتاز", "مقبول"]
BAD_WORDS = ["bad", "negative", "0", "false", "no", "reject", "not_preferred", "low", "poor", "terrible", "سيء", "ضعيف", "مرفوض"]


def normalize_label(c: Column) -> Column:
    """Numeric >= 0.5 good; English / Arabic words; unknown -> null
    (routed to a rejects table by the caller instead of failing the job)."""
    s = F.lower(T.py_strip(c.cast("string")))
    num = c.cast("string").try_cast("double")
    return (F.when(num.isNotNull(), F.when(num >= 0.5, F.lit("good")).otherwise(F.lit("bad")))
            .when(s.isin(*GOOD_WORDS), F.lit("good")).when(s.isin(*BAD_WORDS), F.lit("bad")))


def pairwise_to_binary(df: DataFrame, key_col: str = "id") -> DataFrame:
    """Each (prompt, chosen, rejected) row -> a good and a bad row."""
    e = F.explode(F.array(
        F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label"), F.lit("chosen").alias("preference_type")),
        F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label"), F.lit("rejected").alias("preference_type"))))
    return df.select(key_col, "prompt", e.alias("__e")).select(key_col, "prompt", "__e.*")


def ranking_to_pairs(df: DataFrame, key_col: str, responses_col: str = "responses",
                     rankings_col: str = "rankings") -> DataFrame:
    """Responses + rankings -> the rank-1 response against every worse
    ranked one. Exploded to one row per response, then an equi-join on the
    prompt key with the rank condition; rank-1 rows are few per key."""
    z = df.select(key_col, "prompt", F.posexplode(F.arrays_zip(F.col(responses_col).alias("r"),
                                                                 F.col(rankings_col).alias("k"))).alias("pos", "e"))
    z = z.select(key_col, "prompt", "pos", F.col("e.r").alias("response"), F.col("e.k").alias("rank"))
    best = z.groupBy(key_col).agg(F.min("rank").alias("best_rank"))
    top = z.join(best, key_col).filter(F.col("rank") == F.col("best_rank")) \
        .select(key_col, F.col("pos").alias("chosen_pos"), F.col("response").alias("chosen"),
                F.col("rank").alias("chosen_rank"))
    worse = z.select(key_col, "prompt", F.col("pos").alias("rejected_pos"), F.col("response").alias("rejected"),
                     F.col("rank").alias("rejected_rank"))
    return top.join(worse, key_col).filter(F.col("chosen_rank") < F.col("rejected_rank"))


def messages_to_pair(df: DataFrame) -> DataFrame:
    """Triple passthrough; messages[0] user / [1] assistant with
    rejected = chosen + ' [REJECTED]' by default; else instruction/output."""
    if _has(df, "prompt", "chosen", "rejected"):
        return df.select("prompt", "chosen", "rejected")
    if "messages" in df.columns:
        m = F.col("messages")
        ok = F.size(m) >= 2
        prompt = F.when(m[0]["role"] == "user", m[0]["content"]).otherwise(F.lit(""))
        chosen = F.when(m[1]["role"] == "assistant", m[1]["content"]).otherwise(F.lit(""))
        rej = F.col("rejected") if "rejected" in df.columns else F.concat(chosen, F.lit(" [REJECTED]"))
        return df.where(ok).select(prompt.alias("prompt"), chosen.alias("chosen"), rej.alias("rejected"))
    out = F.col("output") if "output" in df.columns else F.lit("")
    return df.select((F.col("prompt") if "prompt" in df.columns else F.col("instruction") if "instruction" in df.columns
                      else F.lit("")).alias("prompt"),
                     (F.col("chosen") if "chosen" in df.columns else out).alias("chosen"),
                     (F.col("rejected") if "rejected" in df.columns else F.concat(out, F.lit(" [REJECTED]"))).alias("rejected"))


def first_present(df: DataFrame, *cols: str) -> Column:
    """``example.get(a, example.get(b, ''))`` decided on the schema."""
    for c in cols:
        if c in df.columns:
            return F.col(c)
    return F.lit("")


def sft_source_map(df: DataFrame) -> DataFrame:
    """Instruction (else prompt), input, output (else response)."""
    return df.select(first_present(df, "instruction", "prompt").alias("instruction"),
                     first_present(df, "input").alias("input"),
                     first_present(df, "output", "response").alias("output"))


def dpo_source_map(df: DataFrame) -> DataFrame:
    """prompt/instruction, chosen/preferred, rejected/dispreferred."""
    return df.select(first_present(df, "prompt", "instruction").alias("prompt"),
                     first_present(df, "chosen", "preferred").alias("chosen"),
                     first_present(df, "rejected", "dispreferred").alias("rejected"))


def kto_source_map(df: DataFrame, sentiment: bool = False, keep: tuple = ()) -> DataFrame:
    """Sentiment sets: label = sentiment > 0 for numbers, == 'positive'
    for strings; otherwise label = score > 0.5 (missing score -> 0)."""
    keep_cols = [F.col(k) for k in keep]
    if sentiment:
        name = next((c for c in ("label", "sentiment") if c in df.columns), None)
        if name is None:
            lab = F.lit(False)
        elif _numeric(df, name):
            lab = F.col(name) > 0
        else:
            lab = F.col(name) == "positive"
        txt = first_present(df, "text", "input")
        return df.select(*keep_cols, txt.alias("prompt"), txt.alias("completion"), lab.alias("label"))
    return df.select(*keep_cols, first_present(df, "prompt").alias("prompt"),
                     first_present(df, "response").alias("completion"),
                     (F.coalesce(first_present(df, "score").cast("double"), F.lit(0.0)) > 0.5).alias("label"))


def render_template(template: str, **fields: Column) -> Column:
    """``template.format(**fields)`` as one ``concat``; the
    template is parsed once on the driver."""
    import string
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


def sft_text(instruction: Column, response: Column, template: str = L.SFT_TEMPLATE) -> Column:
    """The loader's formatted training text (fields stripped)."""
    return render_template(template, instruction=T.py_strip(instruction), response=T.py_strip(response))


def bilingual_text(instruction: Column, input_: Column, output: Column, language: str = "arabic") -> Column:
    """With-input template when input is non-blank, else without."""
    without, with_in = L.INSTRUCTION_TEMPLATES[language]
    has_input = F.coalesce(T.py_strip(input_), F.lit("")) != ""
    return F.when(has_input, render_template(with_in, instruction=instruction, input=input_, output=output)) \
        .otherwise(render_template(without, instruction=instruction, output=output))


def qa_text(question: Column, answer: Column, kind: str = "simple", context: Column | None = None) -> Column:
    """QA templates. 'context' with an empty context renders it empty
    (the reference raises a KeyError there)."""
    fields = {"question": question, "answer": answer}
    if kind == "context":
        fields["context"] = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    return render_template(L.QA_TEMPLATES[kind], **fields)


def question_prompt(question: Column, context: Column | None = None, options: Column | None = None) -> Column:
    """The prompt of a question: with its options, one numbered line
    each, if it has any; else with its context unless that is blank; else
    alone."""
    out = render_template(L.QUESTION_PROMPTS["plain"], question=question)
    if context is not None:
        out = F.when(F.coalesce(context, F.lit("")) != "",
                     render_template(L.QUESTION_PROMPTS["context"], question=question, context=context)).otherwise(out)
    if options is not None:
        lines = F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
        out = F.when(F.coalesce(F.size(options), F.lit(0)) > 0,
                     render_template(L.QUESTION_PROMPTS["options"], question=question, options=lines)).otherwise(out)
    return out


def grade_label(rating: Column | None = None, grade: Column | None = None) -> Column:
    """Rating >= 4 -> good else bad; else Arabic grade word map, default bad."""
    if rating is not None:
        return F.when(rating.cast("double") >= 4, F.lit("good")).otherwise(F.lit("bad"))
    m = F.create_map(*[x for k, v in L.GRADE_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, grade), F.lit("bad"))


def negatives_list(df: DataFrame, *cols: str) -> Column:
    """Merge negative fields (arrays or strings), strip, drop blanks,
    order-preserving distinct."""
    arrs = []
    for c in cols:
        if c not in df.columns:
            continue
        dt = df.schema[c].dataType.typeName()
        arrs.append(F.coalesce(F.col(c), F.array().cast("array<string>")) if dt == "array"
                    else F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>")))
    if not arrs:
        return F.array().cast("array<string>")
    merged = F.transform(F.concat(*arrs), T.py_strip)
    return F.array_distinct(F.filter(merged, lambda x: x != ""))


def transcript_lines(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """B22 (distributed form): one prefixed line per turn, ordered by
    (conv, turn); written with ``sortWithinPartitions`` this is the whole
    transcript without gathering any conversation into one row."""
    prefix = F.concat(F.upper(F.substring(role_col, 1, 1)), F.substring(role_col, 2, 1 << 20), F.lit(": "))
    return conv.select(conv_col, turn_col, F.concat(prefix, F.col(text_col)).alias("line"))


def render_transcript(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", add_cue: bool = True) -> DataFrame:
    """One transcript string per conversation, turns in order, with an
    optional trailing 'Assistant:' cue. A conversation is bounded by the
    model context, so its turns fit one row."""
    lines = transcript_lines(conv, conv_col, turn_col, role_col, text_col)
    g = lines.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct(turn_col, "line"))).alias("__l"))
    body = F.array_join(F.transform("__l", lambda s: s["line"]), "\n")
    return g.select(conv_col, (F.concat(body, F.lit("\nAssistant:")) if add_cue else body).alias("transcript"))


def chat_messages(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``chat(conv_id, messages)``: ordered array<struct<role, content>>."""
    g = conv.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct(turn_col, "role", "text"))).alias("__m"))
    return g.select(conv_col, F.transform("__m", lambda s: F.struct(s["role"].alias("role"),
                                                                    s["text"].alias("content"))).alias("messages"))


def clean_conversation(messages: Column, roles=("user", "assistant", "system")) -> Column:
    """Strip contents; drop empty turns and unknown roles."""
    stripped = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), T.py_strip(m["content"]).alias("content")))
    return F.filter(stripped, lambda m: (m["content"] != "") & m["role"].isin(*roles))


def prompt_from_conversation(messages: Column) -> Column:
    """Last user turn, else the stripped non-blank turns that are not the assistant's, joined by spaces."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    others = F.transform(F.filter(messages, lambda m: m["role"] != "assistant"), lambda m: T.py_strip(m["content"]))
    return F.when(F.size(users) > 0, F.element_at(users, -1)["content"]) \
        .otherwise(F.array_join(F.filter(others, lambda c: c != ""), " "))


def to_standard(messages: Column) -> Column:
    """B19 (conversation): user or human turns before the first assistant, ai
    or bot turn joined by spaces -> prompt (all of them without such a turn);
    that turn -> response, else empty."""
    answers = F.transform(messages, lambda m: m["role"].isin("assistant", "ai", "bot"))
    first = F.array_position(answers, True).cast("int")
    before = F.when(first > 0, F.slice(messages, 1, F.greatest(first - 1, F.lit(0)))).otherwise(messages)
    prompt = F.array_join(F.transform(F.filter(before, lambda m: m["role"].isin("user", "human")), lambda m: m["content"]), " ")
    return F.struct(prompt.alias("prompt"),
                    F.when(first > 0, F.element_at(messages, first)["content"]).otherwise(F.lit("")).alias("response"))


# the columns whose presence makes a format, in the order in which formats are tried
FORMAT_COLUMNS = [("conversation", ("conversation",)), ("conversation", ("messages",)),
                  ("instruction", ("instruction", "input", "output")), ("preference", ("prompt", "chosen", "rejected")),
                  ("chat", ("prompt", "response"))]


def detect_format(df: DataFrame) -> str:
    """B18 (whole table): conversation / instruction / preference / chat / unknown, decided on the schema once."""
    return next((name for name, cols in FORMAT_COLUMNS if set(cols) <= set(df.columns)), "unknown")


def row_format(df: DataFrame) -> Column:
    """B18 (mixed rows, as mixed JSON lines arrive): the same rules by row; a null is an absent field."""
    out = F.lit("unknown")
    for name, cols in reversed(FORMAT_COLUMNS):
        if set(cols) <= set(df.columns):
            present = F.col(cols[0]).isNotNull()
            for c in cols[1:]:
                present = present & F.col(c).isNotNull()
            out = F.when(present, F.lit(name)).otherwise(out)
    return out


def standardize(df: DataFrame) -> DataFrame:
    """B19 (mixed rows): prompt, response, chosen, rejected and _original_format
    by each row's format; the fields they come from go, all others stay.

    Instruction rows: instruction, then a blank line and the input if that is
    not empty -> prompt, output -> response. Preference rows have no response,
    the others no pair; rows of unknown format have neither.
    """
    have = set(df.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    talks = [F.when(F.col(c).isNotNull(), to_standard(F.col(c))) for c in ("conversation", "messages") if c in have]
    said = lambda field: F.coalesce(*talks)[field] if talks else F.lit(None).cast("string")
    asked = F.when(get("input") != "", F.concat(get("instruction"), F.lit("\n\n"), get("input"))).otherwise(get("instruction"))
    fmt = F.col("_original_format")
    others = [c for c in df.columns if c not in {"conversation", "messages", "instruction", "input", "output", "prompt",
                                                 "response", "chosen", "rejected", "_original_format"}]
    return df.withColumn("_original_format", row_format(df)).select(
        *others, "_original_format",
        F.when(fmt == "conversation", said("prompt")).when(fmt == "instruction", asked)
        .when(fmt.isin("preference", "chat"), get("prompt")).alias("prompt"),
        F.when(fmt == "conversation", said("response")).when(fmt == "instruction", get("output"))
        .when(fmt == "chat", get("response")).alias("response"),
        F.when(fmt == "preference", get("chosen")).alias("chosen"),
        F.when(fmt == "preference", get("rejected")).alias("rejected"))
