"""Format resolution and templating queries (B*).

Inputs with the reference's shapes are derived from the driver tables:
instruction/response rows from ``conversations`` (view ``sft``), preference
triples from ``documents`` + ``labels`` (view ``pairs``), chat arrays from
``conversations``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import formats as B
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register
from .q_joins import NEXT_PAIR_SQL


def r6(c):
    return F.round(c, 6)


TMPL = L.SFT_RESPONSE_TEMPLATE


# B1 ------------------------------------------------------------------------
def _b1_src(spark, sf):
    s = TB.sft(spark, sf)
    text = F.when(F.col("conv_id") % 2 == 0,
                  F.concat(F.col("instruction"), F.lit("\n" + TMPL + "\n"), F.col("response"))).otherwise(F.col("response"))
    return s.select("conv_id", "turn", text.alias("text"))


def _b1_sql():
    src = (f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN instruction || chr(10) || {S.q(TMPL)} || chr(10) "
           "|| response ELSE response END AS text FROM sft")
    hit = f"contains(text, {S.q(TMPL)})"
    ins = f"CASE WHEN {hit} THEN {S.strip(f'substr(text, 1, instr(text, {S.q(TMPL)}) - 1)')} ELSE '' END"
    res = f"CASE WHEN {hit} THEN {S.strip(f'substr(text, instr(text, {S.q(TMPL)}) + {len(TMPL)})')} ELSE text END"
    return S.with_views(f"SELECT conv_id, turn, md5({ins}) AS instruction_md5, md5({res}) AS response_md5 FROM src",
                        "sft", extra=[("src", src)])


@register("b1_resolve_sft", _b1_sql)
def b1_resolve_sft(spark, sf):
    r = B.resolve_sft(_b1_src(spark, sf))
    return r.select("conv_id", "turn", F.md5("instruction").alias("instruction_md5"),
                    F.md5("response").alias("response_md5"))


# B2 / B3 -------------------------------------------------------------------
def _b23_src_spark(spark, sf):
    s = TB.sft(spark, sf)
    text = F.when(F.col("conv_id") % 2 == 0,
                  F.concat(F.lit("### Instruction: "), F.col("instruction"), F.lit("\n### Response: "), F.col("response")))\
        .otherwise(F.concat(F.lit("Question: "), F.col("instruction"), F.lit("\nAnswer: "), F.col("response")))
    return s.select("conv_id", "turn", text.alias("text"))


def _b23_src_sql():
    return ("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '### Instruction: ' || instruction || chr(10) || "
            "'### Response: ' || response ELSE 'Question: ' || instruction || chr(10) || 'Answer: ' || response END AS text "
            "FROM sft")


def _extract_sql(patterns):
    parts = []
    for p in patterns:
        pat = "(?s)" + p.replace(r"\s", f"[{L.WS}]")
        parts.append(f"CASE WHEN regexp_matches(text, {S.q(pat)}) THEN {S.strip(f'regexp_extract(text, {S.q(pat)}, 1)')} END")
    return "coalesce(" + ", ".join(parts) + ")"


@register("b2_extract_instruction",
          lambda: S.with_views(f"SELECT conv_id, turn, md5({_extract_sql(L.INSTRUCTION_PATTERNS)}) AS instruction_md5 "
                               "FROM src", "sft", extra=[("src", _b23_src_sql())]))
def b2_extract_instruction(spark, sf):
    d = _b23_src_spark(spark, sf)
    return d.select("conv_id", "turn", F.md5(B.extract_instruction(d)).alias("instruction_md5"))


@register("b3_extract_response",
          lambda: S.with_views(f"SELECT conv_id, turn, md5({_extract_sql(L.RESPONSE_PATTERNS)}) AS response_md5 "
                               "FROM src", "sft", extra=[("src", _b23_src_sql())]))
def b3_extract_response(spark, sf):
    d = _b23_src_spark(spark, sf)
    return d.select("conv_id", "turn", F.md5(B.extract_response(d)).alias("response_md5"))


# B4 ------------------------------------------------------------------------
@register("b4_extract_text",
          lambda: "SELECT doc_id, md5(CASE WHEN length(lang) > 10 THEN lang WHEN length(source) > 10 THEN source "
                  "WHEN length(text) > 10 THEN text END) AS text_md5 FROM documents")
def b4_extract_text(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("text").alias("body"))
    return d.select("doc_id", F.md5(B.extract_text(d.drop("doc_id"))).alias("text_md5"))


# B5 / B6 -------------------------------------------------------------------
def _prefix_len_sql(a, b):
    same = f"list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] = p[2])"
    n = f"least(length({a}), length({b}))"
    pos = f"coalesce(list_position({same}, false), 0)"
    return f"(CASE WHEN {n} = 0 THEN 0 WHEN {pos} = 0 OR {pos} > {n} THEN {n} ELSE {pos} - 1 END)"


def _b5_sql():
    k = _prefix_len_sql("c", "r")
    src = "SELECT id, chosen AS c, prompt || chr(10) || rejected AS r FROM pairs"
    body = (f"SELECT id, md5({S.strip('substr(c, 1, k)')}) AS prompt_md5, md5({S.strip('substr(c, k + 1)')}) AS chosen_md5, "
            f"md5({S.strip('substr(r, k + 1)')}) AS rejected_md5, CAST(k AS BIGINT) AS prefix_len "
            f"FROM (SELECT *, {k} AS k FROM src) x")
    return S.with_views(body, "pairs", extra=[("src", src)])


@register("b5_resolve_pairwise", _b5_sql)
def b5_resolve_pairwise(spark, sf):
    p = TB.pairs(spark, sf)
    hh = p.select("id", F.col("chosen").alias("chosen"),
                  F.concat(F.col("prompt"), F.lit("\n"), F.col("rejected")).alias("rejected"))
    k = B.common_prefix_len(F.col("chosen"), F.col("rejected")).cast("long")
    r = B.resolve_pairwise(hh)
    return r.join(hh.select("id", k.alias("prefix_len")), "id").select(
        "id", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
        F.md5("rejected").alias("rejected_md5"), "prefix_len")


@register("b6_common_prefix",
          lambda: S.with_views(f"SELECT id, CAST({_prefix_len_sql('chosen', 'rejected')} AS BIGINT) AS prefix_len FROM pairs",
                               "pairs"))
def b6_common_prefix(spark, sf):
    p = TB.pairs(spark, sf)
    return p.select("id", B.common_prefix_len(F.col("chosen"), F.col("rejected")).cast("long").alias("prefix_len"))


# B7 / B8 / B9 / B10 --------------------------------------------------------
@register("b7_resolve_kto",
          lambda: S.with_views("SELECT id, CASE WHEN label * 4 + 1 >= 3 THEN 1 ELSE 0 END AS label_from_rating, "
                               "CASE WHEN label * 0.9 >= 0.5 THEN 1 ELSE 0 END AS label_from_score FROM kto", "kto"))
def b7_resolve_kto(spark, sf):
    k = TB.kto(spark, sf)
    a = B.resolve_kto(k.select("id", F.col("prompt").alias("input"), F.col("completion").alias("output"),
                               (F.col("label") * 4 + 1).alias("rating")))
    b = B.resolve_kto(k.select("id", F.col("prompt").alias("question"), F.col("completion").alias("answer"),
                               (F.col("label") * 0.9).alias("score")))
    return a.select("id", F.col("label").alias("label_from_rating")).join(
        b.select("id", F.col("label").alias("label_from_score")), "id")


_B8_STR = "CASE WHEN toxic = 1 THEN 'true' WHEN doc_id % 3 = 0 THEN 'True' ELSE CAST(quality AS VARCHAR) END"


@register("b8_binary_label",
          lambda: f"SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS from_int, "
                  f"CASE WHEN ({_B8_STR}) IN ('1', 'true', 'desirable', 'good') THEN 1 ELSE 0 END AS from_string, "
                  "CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS from_bool FROM labels")
def b8_binary_label(spark, sf):
    lab = TB.table(spark, sf, "labels")
    s = F.when(F.col("toxic") == 1, F.lit("true")).when(F.col("doc_id") % 3 == 0, F.lit("True")) \
        .otherwise(F.col("quality").cast("string"))
    return lab.select("doc_id", B.binary_label(F.col("quality"), "int").alias("from_int"),
                      B.binary_label(s, "string").alias("from_string"),
                      B.binary_label(F.col("toxic") == 1, "boolean").alias("from_bool"))


_B9_WORDS = ["good", "bad", "Desirable", " نعم ", "سيء", "maybe", "0.75"]


def _b9_value_sql():
    return f"CASE WHEN doc_id % 7 = 6 THEN CAST(quality * 0.75 AS VARCHAR) ELSE {S.lst(_B9_WORDS)}[doc_id % 7 + 1] END"


def _b9_sql():
    v = _b9_value_sql()
    s = f"lower({S.strip(v)})"
    num = f"TRY_CAST({v} AS DOUBLE)"
    return (f"SELECT doc_id, CASE WHEN {num} IS NOT NULL THEN (CASE WHEN {num} >= 0.5 THEN 'good' ELSE 'bad' END) "
            f"WHEN {s} IN ('good', 'positive', '1', 'true', 'yes', 'accept', 'preferred', 'high', 'excellent', 'great', 'جيد', "
            "'ممتاز', 'مقبول') THEN 'good' "
            f"WHEN {s} IN ('bad', 'negative', '0', 'false', 'no', 'reject', 'not_preferred', 'low', 'poor', 'terrible', 'سيء', "
            "'ضعيف', 'مرفوض') THEN 'bad' END AS label "
            "FROM labels")


@register("b9_normalize_label", _b9_sql)
def b9_normalize_label(spark, sf):
    lab = TB.table(spark, sf, "labels")
    words = F.array(*[F.lit(w) for w in _B9_WORDS])
    v = F.when(F.col("doc_id") % 7 == 6, (F.col("quality") * 0.75).cast("string")) \
        .otherwise(F.element_at(words, (F.col("doc_id") % 7 + 1).cast("int")))
    return lab.select("doc_id", B.normalize_label(v).alias("label"))


_GRADES = list(L.GRADE_MAP) + ["غير معروف"]


@register("b10_grade_label",
          lambda: "SELECT doc_id, CASE WHEN quality * 3 + 2 >= 4 THEN 'good' ELSE 'bad' END AS from_rating, "
                  "CASE " + " ".join(f"WHEN g = {S.q(k)} THEN {S.q(v)}" for k, v in L.GRADE_MAP.items()) +
                  f" ELSE 'bad' END AS from_grade FROM (SELECT *, {S.lst(_GRADES)}[doc_id % {len(_GRADES)} + 1] AS g "
                  "FROM labels) x")
def b10_grade_label(spark, sf):
    lab = TB.table(spark, sf, "labels")
    g = F.element_at(F.array(*[F.lit(x) for x in _GRADES]), (F.col("doc_id") % len(_GRADES) + 1).cast("int"))
    return lab.select("doc_id", B.grade_label(rating=F.col("quality") * 3 + 2).alias("from_rating"),
                      B.grade_label(grade=g).alias("from_grade"))


# B11 / B12 / B13 -----------------------------------------------------------
@register("b11_pairwise_to_binary",
          lambda: S.with_views("SELECT id, md5(prompt) AS prompt_md5, md5(chosen) AS completion_md5, true AS label, "
                               "'chosen' AS preference_type FROM pairs UNION ALL SELECT id, md5(prompt), md5(rejected), "
                               "false, 'rejected' FROM pairs", "pairs"))
def b11_pairwise_to_binary(spark, sf):
    b = B.pairwise_to_binary(TB.pairs(spark, sf))
    return b.select("id", F.md5("prompt").alias("prompt_md5"), F.md5("completion").alias("completion_md5"),
                    "label", "preference_type")


def _ranked_src(spark, sf):
    c = TB.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return g.select("conv_id", F.lit("").alias("prompt"), F.transform("r", lambda s: s["text"]).alias("responses"),
                    F.transform("r", lambda s: F.size("r") - s["turn"]).alias("rankings"))


@register("b12_ranking_to_pairs",
          lambda: "WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, "
                  "count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'), "
                  "r AS (SELECT conv_id, pos, text, n - turn AS rk FROM a), "
                  "b AS (SELECT conv_id, min(rk) AS best FROM r GROUP BY conv_id) "
                  "SELECT x.conv_id, CAST(x.pos AS INTEGER) AS chosen_pos, CAST(y.pos AS INTEGER) AS rejected_pos, "
                  "CAST(x.rk AS BIGINT) AS chosen_rank, CAST(y.rk AS BIGINT) AS rejected_rank, "
                  "md5(x.text) AS chosen_md5, md5(y.text) AS rejected_md5 FROM r x JOIN b ON x.conv_id = b.conv_id AND "
                  "x.rk = b.best JOIN r y ON y.conv_id = x.conv_id AND x.rk < y.rk")
def b12_ranking_to_pairs(spark, sf):
    p = B.ranking_to_pairs(_ranked_src(spark, sf), "conv_id")
    return p.select("conv_id", "chosen_pos", "rejected_pos", F.col("chosen_rank").cast("long").alias("chosen_rank"),
                    F.col("rejected_rank").cast("long").alias("rejected_rank"),
                    F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


_CHAT_SQL = ("SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages "
             "FROM conversations GROUP BY conv_id")


def _chat(spark, sf):
    return B.chat_messages(TB.table(spark, sf, "conversations"))


@register("b13_messages_to_pair",
          lambda: S.with_views("SELECT md5(CASE WHEN messages[1].role = 'user' THEN messages[1].content ELSE '' END) AS prompt_md5, "
                               "md5(CASE WHEN messages[2].role = 'assistant' THEN messages[2].content ELSE '' END) AS chosen_md5, "
                               "md5(CASE WHEN messages[2].role = 'assistant' THEN messages[2].content ELSE '' END || ' [REJECTED]') "
                               "AS rejected_md5 FROM chat WHERE len(messages) >= 2", extra=[("chat", _CHAT_SQL)]))
def b13_messages_to_pair(spark, sf):
    p = B.messages_to_pair(_chat(spark, sf))
    return p.select(F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
                    F.md5("rejected").alias("rejected_md5"))


# B14-B17 -------------------------------------------------------------------
@register("b14_sft_source_map",
          lambda: S.with_views("SELECT md5(instruction) AS instruction_md5, '' AS input, md5(response) AS output_md5 "
                               "FROM sft", "sft"))
def b14_sft_source_map(spark, sf):
    m = B.sft_source_map(TB.sft(spark, sf).select("instruction", "response"))
    return m.select(F.md5("instruction").alias("instruction_md5"), "input", F.md5("output").alias("output_md5"))


@register("b15_dpo_source_map",
          lambda: S.with_views("SELECT md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 "
                               "FROM pairs", "pairs"))
def b15_dpo_source_map(spark, sf):
    p = TB.pairs(spark, sf).select(F.col("prompt").alias("instruction"), F.col("chosen").alias("preferred"),
                                   F.col("rejected").alias("dispreferred"))
    m = B.dpo_source_map(p)
    return m.select(F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
                    F.md5("rejected").alias("rejected_md5"))


@register("b16_kto_source_map",
          lambda: S.with_views("SELECT id, label > 0 AS from_sentiment, coalesce(CAST(label AS DOUBLE), 0.0) > 0.5 AS from_score "
                               "FROM kto", "kto"))
def b16_kto_source_map(spark, sf):
    k = TB.kto(spark, sf)
    a = B.kto_source_map(k.select("id", F.col("completion").alias("text"), F.col("label").alias("sentiment")),
                         sentiment=True, keep=("id",))
    b = B.kto_source_map(k.select("id", "prompt", F.col("completion").alias("response"), F.col("label").alias("score")),
                         keep=("id",))
    return a.select("id", F.col("label").alias("from_sentiment")).join(
        b.select("id", F.col("label").alias("from_score")), "id")


@register("b17_scored_preference_map",
          lambda: S.with_views(f"SELECT id, md5(prompt) AS prompt_md5, {S.rnd(S.quality('chosen'))} AS score_chosen, "
                               f"{S.rnd(S.quality('rejected'))} AS score_rejected FROM pairs", "pairs"))
def b17_scored_preference_map(spark, sf):
    p = TB.pairs(spark, sf).select("id", F.col("prompt").alias("question"), F.col("chosen").alias("chosen_response"),
                                   F.col("rejected").alias("rejected_response"),
                                   T.quality("chosen").alias("score_chosen"), T.quality("rejected").alias("score_rejected"))
    m = p.select("id", F.col("question").alias("prompt"), F.col("chosen_response").alias("chosen"),
                 F.col("rejected_response").alias("rejected"), "score_chosen", "score_rejected")
    return m.select("id", F.md5("prompt").alias("prompt_md5"), r6(F.col("score_chosen")).alias("score_chosen"),
                    r6(F.col("score_rejected")).alias("score_rejected"))


# B18, B19 ------------------------------------------------------------------
_MIXED_SQL = (
    "SELECT concat('i', conv_id, '_', turn) AS rid, instruction, CASE WHEN conv_id % 2 = 1 THEN concat('turn ', turn) "
    "ELSE '' END AS input, response AS output, NULL AS prompt, NULL AS response, NULL AS chosen, NULL AS rejected, "
    "NULL AS messages FROM sft UNION ALL "
    "SELECT concat('p', id), NULL, NULL, NULL, prompt, NULL, chosen, rejected, NULL FROM pairs UNION ALL "
    "SELECT concat('t', id), NULL, NULL, NULL, prompt, completion, NULL, NULL, NULL FROM kto UNION ALL "
    "SELECT concat('u', doc_id), NULL, NULL, NULL, text, NULL, NULL, NULL, NULL FROM documents UNION ALL "
    "SELECT concat('c', conv_id), NULL, NULL, NULL, NULL, NULL, NULL, NULL, messages FROM (" + _CHAT_SQL + ") c")


def _mixed(spark, sf):
    """A union of rows of every format, one absent field away from one another (as mixed JSON lines arrive)."""
    rid = lambda kind, *cols: F.concat(F.lit(kind), F.concat_ws("_", *cols)).alias("rid")
    parts = [
        TB.sft(spark, sf).select(rid("i", "conv_id", "turn"), "instruction", F.when(
            F.col("conv_id") % 2 == 1, F.concat(F.lit("turn "), F.col("turn"))).otherwise("").alias("input"),
            F.col("response").alias("output")),
        TB.pairs(spark, sf).select(rid("p", "id"), "prompt", "chosen", "rejected"),
        TB.kto(spark, sf).select(rid("t", "id"), "prompt", F.col("completion").alias("response")),
        TB.table(spark, sf, "documents").select(rid("u", "doc_id"), F.col("text").alias("prompt")),
        _chat(spark, sf).select(rid("c", "conv_id"), "messages")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_ROW_FORMAT_SQL = ("CASE WHEN messages IS NOT NULL THEN 'conversation' WHEN instruction IS NOT NULL AND input IS NOT NULL AND "
                   "output IS NOT NULL THEN 'instruction' WHEN prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL "
                   "THEN 'preference' WHEN prompt IS NOT NULL AND response IS NOT NULL THEN 'chat' ELSE 'unknown' END")


@register("b18_detect_format",
          lambda: S.with_views(f"SELECT fmt, count(*) AS n FROM (SELECT {_ROW_FORMAT_SQL} AS fmt FROM mixed) x GROUP BY fmt",
                               "sft", "pairs", "kto", extra=[("mixed", _MIXED_SQL)]))
def b18_detect_format(spark, sf):
    """Row-level format detection over a mixed union."""
    mixed = _mixed(spark, sf)
    return mixed.groupBy(B.row_format(mixed).alias("fmt")).agg(F.count(F.lit(1)).alias("n"))


def _b19_sql():
    fa = "list_position(list_transform(messages, lambda m: m.role IN ('assistant', 'ai', 'bot')), true)"
    before = f"CASE WHEN coalesce({fa}, 0) = 0 THEN messages ELSE messages[1:{fa} - 1] END"
    ins = f"array_to_string(list_transform(list_filter({before}, lambda m: m.role IN ('user', 'human')), lambda m: m.content), ' ')"
    out = f"CASE WHEN coalesce({fa}, 0) > 0 THEN messages[{fa}].content ELSE '' END"
    body = ("SELECT rid, fmt AS original_format, md5(CASE fmt WHEN 'conversation' THEN " + ins + " WHEN 'instruction' THEN "
            "CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END "
            "WHEN 'preference' THEN prompt WHEN 'chat' THEN prompt END) AS prompt_md5, "
            "md5(CASE fmt WHEN 'conversation' THEN " + out + " WHEN 'instruction' THEN output WHEN 'chat' THEN response END) "
            "AS response_md5, md5(CASE fmt WHEN 'preference' THEN chosen || chr(10) || rejected END) AS pair_md5 "
            f"FROM (SELECT *, {_ROW_FORMAT_SQL} AS fmt FROM mixed) x")
    return S.with_views(body, "sft", "pairs", "kto", extra=[("mixed", _MIXED_SQL)])


@register("b19_to_standard", _b19_sql)
def b19_to_standard(spark, sf):
    s = B.standardize(_mixed(spark, sf))
    return s.select("rid", F.col("_original_format").alias("original_format"), F.md5("prompt").alias("prompt_md5"),
                    F.md5("response").alias("response_md5"),
                    F.md5(F.concat("chosen", F.lit("\n"), "rejected")).alias("pair_md5"))


@register("b20_clean_conversation",
          lambda: S.with_views(f"SELECT conv_id, CAST(len(list_filter(messages, lambda m: {S.strip('m.content')} <> '' AND "
                               "m.role IN ('user', 'assistant', 'system'))) AS BIGINT) AS n_turns FROM chat",
                               extra=[("chat", _CHAT_SQL)]))
def b20_clean_conversation(spark, sf):
    c = _chat(spark, sf)
    return c.select("conv_id", F.size(B.clean_conversation(F.col("messages"))).cast("long").alias("n_turns"))


@register("b21_prompt_from_conversation",
          lambda: S.with_views("SELECT conv_id, md5(CASE WHEN len(list_filter(messages, lambda m: m.role = 'user')) > 0 "
                               "THEN list_filter(messages, lambda m: m.role = 'user')[-1].content ELSE "
                               "array_to_string(list_filter(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), "
                               f"lambda m: {S.strip('m.content')}), lambda c: c <> ''), ' ') END) AS prompt_md5 FROM chat", extra=[("chat", _CHAT_SQL)]))
def b21_prompt_from_conversation(spark, sf):
    c = _chat(spark, sf)
    return c.select("conv_id", F.md5(B.prompt_from_conversation(F.col("messages"))).alias("prompt_md5"))


@register("b22_render_transcript",
          lambda: "SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) "
                  "ORDER BY turn) || chr(10) || 'Assistant:') AS transcript_md5 FROM conversations GROUP BY conv_id")
def b22_render_transcript(spark, sf):
    t = B.render_transcript(TB.table(spark, sf, "conversations"))
    return t.select("conv_id", F.md5("transcript").alias("transcript_md5"))


# B23-B28 -------------------------------------------------------------------
def _render_sql(template: str, **fields: str) -> str:
    import string
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(S.q(literal))
        if name is not None:
            parts.append(fields[name])
    return "(" + " || ".join(parts) + ")"


@register("b23_instruction_template",
          lambda: S.with_views(
              f"SELECT conv_id, turn, md5({_render_sql(L.SFT_TEMPLATE, instruction=S.strip('instruction'), response=S.strip('response'))}) "
              f"AS sft_md5, md5({_render_sql(L.CHATML_TEMPLATE, instruction='instruction', response='response')}) AS chatml_md5 "
              "FROM sft", "sft"))
def b23_instruction_template(spark, sf):
    s = TB.sft(spark, sf)
    return s.select("conv_id", "turn", F.md5(B.sft_text(F.col("instruction"), F.col("response"))).alias("sft_md5"),
                    F.md5(B.render_template(L.CHATML_TEMPLATE, instruction=F.col("instruction"),
                                            response=F.col("response"))).alias("chatml_md5"))


def _b24_sql():
    cols = []
    inp = "CASE WHEN turn % 4 = 0 THEN '' ELSE 'سياق ' || CAST(conv_id AS VARCHAR) END"
    for lang, (without, with_in) in L.INSTRUCTION_TEMPLATES.items():
        w = _render_sql(with_in, instruction="instruction", input="inp", output="response")
        wo = _render_sql(without, instruction="instruction", output="response")
        cols.append(f"md5(CASE WHEN coalesce({S.strip('inp')}, '') <> '' THEN {w} ELSE {wo} END) AS {lang}_md5")
    return S.with_views(f"SELECT conv_id, turn, {', '.join(cols)} FROM (SELECT *, {inp} AS inp FROM sft) x", "sft")


@register("b24_bilingual_templates", _b24_sql)
def b24_bilingual_templates(spark, sf):
    s = TB.sft(spark, sf)
    inp = F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("سياق "), F.col("conv_id").cast("string")))
    return s.select("conv_id", "turn", *[F.md5(B.bilingual_text(F.col("instruction"), inp, F.col("response"), lang))
                                         .alias(f"{lang}_md5") for lang in L.INSTRUCTION_TEMPLATES])


@register("b25_qa_templates",
          lambda: S.with_views("SELECT conv_id, turn, " + ", ".join(
              f"md5({_render_sql(t, question='instruction', answer='response', context=S.q('') if k == 'context' else 'x')}) AS {k}_md5"
              for k, t in L.QA_TEMPLATES.items()) + " FROM sft", "sft"))
def b25_qa_templates(spark, sf):
    s = TB.sft(spark, sf)
    return s.select("conv_id", "turn", *[F.md5(B.qa_text(F.col("instruction"), F.col("response"), k)).alias(f"{k}_md5")
                                         for k in L.QA_TEMPLATES])


def _b25_prompt_sql():
    from ..functions import lexicon as LX
    opts = "CASE WHEN turn % 3 = 0 THEN [response, 'نعم', 'لا'] WHEN turn % 3 = 1 THEN [] END"
    lines = "array_to_string(list_transform(opts, lambda o, i: i || '. ' || o), chr(10))"
    prompt = (f"CASE WHEN coalesce(len(opts), 0) > 0 THEN {_render_sql(LX.QUESTION_PROMPTS['options'], question='instruction', options=lines)} "
              f"WHEN coalesce(context, '') <> '' THEN {_render_sql(LX.QUESTION_PROMPTS['context'], question='instruction', context='context')} "
              f"ELSE {_render_sql(LX.QUESTION_PROMPTS['plain'], question='instruction')} END")
    filled = _render_sql(L.QA_TEMPLATES["context"], question="instruction", answer="response", context="coalesce(context, '')")
    return S.with_views(f"SELECT conv_id, turn, md5({prompt}) AS prompt_md5, md5({filled}) AS context_md5 FROM (SELECT *, {opts} AS opts, "
                        "CASE WHEN turn % 2 = 0 THEN split_part(response, '.', 1) END AS context FROM sft) x", "sft")


@register("b25_question_prompts", _b25_prompt_sql)
def b25_question_prompts(spark, sf):
    """Questions with options, with a context and alone, and the QA template with its context filled."""
    s = TB.sft(spark, sf)
    opts = F.when(F.col("turn") % 3 == 0, F.array(F.col("response"), F.lit("نعم"), F.lit("لا"))) \
        .when(F.col("turn") % 3 == 1, F.array().cast("array<string>"))
    context = F.when(F.col("turn") % 2 == 0, F.substring_index("response", ".", 1))
    return s.select("conv_id", "turn", F.md5(B.question_prompt(F.col("instruction"), context, opts)).alias("prompt_md5"),
                    F.md5(B.qa_text(F.col("instruction"), F.col("response"), "context", context)).alias("context_md5"))


@register("b26_table_builder",
          lambda: S.with_views("SELECT conv_id, turn, md5(instruction) AS instruction_md5, md5(response) AS response_md5 "
                               "FROM sft WHERE instruction IS NOT NULL AND response IS NOT NULL", "sft"))
def b26_table_builder(spark, sf):
    s = TB.sft(spark, sf).select("conv_id", "turn", "instruction", "response").dropna(subset=["instruction", "response"])
    return s.select("conv_id", "turn", F.md5("instruction").alias("instruction_md5"), F.md5("response").alias("response_md5"))


def _b27_sql():
    arr = (f"list_filter(list_transform([rejected, {S.strip('other_prompt')}, ' ', rejected], "
           f"lambda x: {S.strip('x')}), lambda x: x <> '')")
    dedup = "list_filter(raw, lambda x, i: list_position(raw, x) = i)"
    return S.with_views(f"SELECT id, CAST(len(negs) AS BIGINT) AS n_negatives, md5(array_to_string(negs, chr(1))) AS negatives_md5 "
                        f"FROM (SELECT id, {dedup} AS negs FROM (SELECT id, {arr} AS raw FROM nextp) y) x", "pairs",
                        extra=[("nextp", NEXT_PAIR_SQL)])


@register("b27_negatives_list", _b27_sql)
def b27_negatives_list(spark, sf):
    p = TB.with_next(TB.pairs(spark, sf)).select("id", "rejected", F.array(F.col("other_prompt"), F.lit(" ")).alias("negatives"),
                                   F.col("rejected").alias("bad_response"))
    n = B.negatives_list(p, "rejected", "negatives", "bad_response")
    return p.select("id", F.size(n).cast("long").alias("n_negatives"), F.md5(F.array_join(n, "\u0001")).alias("negatives_md5"))


@register("b28_aspect_scores",
          lambda: "SELECT aspect, round(avg(CAST(c AS DOUBLE) - r), 6) AS mean_margin, count(*) AS n FROM ("
                  "SELECT 'quality' AS aspect, quality AS c, 1 - quality AS r FROM labels UNION ALL "
                  "SELECT 'safety', 1 - toxic, toxic FROM labels) x GROUP BY aspect")
def b28_aspect_scores(spark, sf):
    lab = TB.table(spark, sf, "labels")
    aspects = F.create_map(F.lit("quality"), F.struct(F.col("quality").alias("chosen"), (1 - F.col("quality")).alias("rejected")),
                           F.lit("safety"), F.struct((1 - F.col("toxic")).alias("chosen"), F.col("toxic").alias("rejected")))
    e = lab.select(F.explode(aspects).alias("aspect", "s"))
    return e.groupBy("aspect").agg(r6(F.avg(F.col("s.chosen").cast("double") - F.col("s.rejected"))).alias("mean_margin"),
                                   F.count(F.lit(1)).alias("n"))
