"""What a question asks for, by rules: tables of words, checked in order; what no rule answers goes to a model boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as X
from corpusloom.operators import memory

# The words of each rule, in the order of the rules, and the defaults by type.
COMPLEX = ("区别", "不同", "对比", "哪个", "哪种", "比较", "一样", "相同", "总结", "概括", "概述", "归纳", "都讲", "全部", "补贴", "政策", "并且", "以及", "同时", "还有")
RULES = (
    ("definition", ("是什么", "什么是", "定义", "什么意思", "指的是")),
    ("fact", (
        "多久", "几天", "多长时间", "几点", "什么时候", "什么时间", "期限", "有效期", "在哪里", "哪里", "地址", "入口", "电话", "渠道", "怎么联系", "联系方式",
        "是否", "能不能", "可以吗", "需要吗", "要不要", "哪些", "要求", "条件", "需要提供", "需要满足", "需要提交",
    )),
    ("troubleshooting", ("怎么办",)),
)
YES_NO_ENDS = ("吗", "吗？")
STRATEGIES_BY_TYPE = {
    "definition": ["direct"], "fact": ["direct"], "process": ["direct"], "comparison": ["decompose"],
    "summary": ["direct"], "policy": ["direct"], "troubleshooting": ["rewrite", "expand"], "other": ["direct"],
}
SCALE_BY_TYPE = {"definition": 1.0, "fact": 1.0, "process": 1.2, "comparison": 1.0, "summary": 2.5, "policy": 1.5, "troubleshooting": 1.2, "other": 1.0}
STRATEGIES = ("direct", "rewrite", "expand", "hyde", "decompose", "clarify")

INTENT = """struct<question_type:string,entities:array<struct<type:string,value:string>>,slots:array<struct<type:string,value:string>>,needs_clarification:boolean,
missing_info:array<string>,strategies:array<string>,rewritten_query:string,sub_queries:array<string>,recall_scale:double>"""


def rule_type(question: Column, rules=RULES, complex_words=COMPLEX, ends=YES_NO_ENDS, deictic=X.DEICTIC_WORDS, starts=X.DEICTIC_STARTS) -> Column:
    """The type that the first matching rule gives; null where a question is empty, deictic, complex or matched by none."""
    q = F.coalesce(X.strip(question), F.lit(""))
    found = F.when((q == "") | X.has_reference(q, deictic, starts) | X.contains_any(q, complex_words), F.lit(None).cast("string"))
    for name, words in rules:
        found = found.when(X.contains_any(q, words), name)
    closing = F.lit(False)
    for e in ends:
        closing = closing | q.endswith(e)
    return found.when(closing, "fact")


def _lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).otherwise(out)
    return F.coalesce(out, default)


def normalize_intent(raw: Column) -> Column:
    """A model's JSON as a checked intent: unknown values fall back to defaults of the type; anything but an object is all defaults."""
    r = F.from_json(F.coalesce(X.json_body(raw), F.lit("{}")), INTENT)
    kind = F.lower(X.strip(F.coalesce(r["question_type"], F.lit("fact"))))
    kind = F.when(kind.isin(*SCALE_BY_TYPE), kind).otherwise("fact")

    def valued(c: Column) -> Column:
        return F.filter(F.coalesce(c, F.array()), lambda s: F.coalesce(X.strip(s["value"]), F.lit("")) != "")

    def said(c: Column) -> Column:
        return F.filter(F.coalesce(c, F.array()), lambda s: F.coalesce(X.strip(s), F.lit("")) != "")

    clarify = F.coalesce(r["needs_clarification"], F.lit(False))
    known = F.filter(F.coalesce(r["strategies"], F.array()), lambda s: s.isin(*STRATEGIES))
    chosen = F.when(F.size(known) > 0, known).otherwise(_lookup(STRATEGIES_BY_TYPE, kind, F.array(F.lit("direct"))))
    chosen = F.when(clarify | F.array_contains(chosen, "clarify"), F.array(F.lit("clarify"))).otherwise(chosen)
    scale = F.when(r["recall_scale"] > 0, r["recall_scale"]).otherwise(_lookup(SCALE_BY_TYPE, kind, F.lit(1.0)))
    return F.struct(
        kind.alias("question_type"), valued(r["entities"]).alias("entities"), valued(r["slots"]).alias("slots"), clarify.alias("needs_clarification"), said(r["missing_info"]).alias("missing_info"),
        chosen.alias("strategies"), F.coalesce(X.strip(r["rewritten_query"]), F.lit("")).alias("rewritten_query"), said(r["sub_queries"]).alias("sub_queries"), scale.alias("recall_scale"),
    )


#: Messages of the history that a question is read with.
HISTORY = 6


def with_history(turns: DataFrame, messages: int = HISTORY) -> DataFrame:
    """Each question of ``turns(conv_id, turn, role, text)`` as ``(conv_id, turn, question, history)``: the labelled messages before it, the last ``messages`` at most.

    History is empty for a first turn; null texts are empty. A window by conversation, so a conversation is read once.
    """
    line = F.concat(F.when(F.col("role") == "user", memory.USER).otherwise(memory.ASSISTANT), F.coalesce("text", F.lit("")))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-messages, -1)
    said = turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))
    return said.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), "history")


def call_key(question: Column, history: Column, scope: Column | None = None) -> Column:
    """The key of a model's stored answer: what it was asked, and with which history; with a ``scope``, for that conversation alone."""
    parts = [history, F.lit("\0"), question]
    return F.sha1(F.concat(*parts) if scope is None else F.concat(scope.cast("string"), F.lit("\0"), *parts))


def routed(questions: DataFrame, stored: DataFrame, rule: Column, scope: Column | None = None) -> DataFrame:
    """``(*, route, completed, intent, calls, saved)`` of ``questions(question, history, ...)``, by rules, else by ``stored(key, raw)`` answers, else by default.

    ``rule`` is the type that rules give, or null. Routes: ``rule``; ``merged``, where one answer to question and history both completes and
    sorts; ``plain``, where there is no history; ``fallback``, where no stored answer or none with a JSON object is found, which asks directly.
    ``calls`` counts model calls, ``saved`` those that rules and the merged form spare against one call to complete (only with a
    history) and one to sort. Questions that rules answer take no part in the join; keys of ``stored`` are unique. With a ``scope``, as
    in ``call_key``, equal questions of two conversations are two calls, each with the answer it got.
    """
    told = F.coalesce(X.strip(F.col("history")), F.lit("")) != ""
    asked = questions.withColumn("_rule", rule).withColumn("_told", told)
    # Keys of ruled questions meet nothing, and are spread: null keys would all go to one task.
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*questions.columns), F.lit(4096)).cast("string"))
    asked = asked.withColumn("_key", F.when(F.col("_rule").isNull(), call_key(F.col("question"), F.col("history"), scope)).otherwise(spread))
    met = asked.join(stored.select(F.col("key").alias("_key"), X.json_body(F.col("raw")).alias("_body")), "_key", "left")
    route = F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_body").isNull(), "fallback").when(F.col("_told"), "merged").otherwise("plain")
    met = met.withColumn("route", route)
    written = F.coalesce(X.strip(F.get_json_object("_body", "$.completed_query")), F.lit(""))
    completed = F.when((F.col("route") == "merged") & (written != ""), written).otherwise(F.col("question"))
    ruled = F.col("route") == "rule"
    direct = F.to_json(F.struct(F.when(ruled, F.col("_rule")).otherwise("fact").alias("question_type"), F.array(F.lit("direct")).alias("strategies"), F.when(ruled, X.strip(F.col("question"))).otherwise(F.col("question")).alias("rewritten_query"), F.lit(1.0).alias("recall_scale")))
    raw = F.when(F.col("route").isin("rule", "fallback"), direct).otherwise(F.col("_body"))
    calls = F.when(ruled, 0).otherwise(1)
    saved = 1 + F.col("_told").cast("int") - calls
    out = met.withColumns({"completed": completed, "intent": normalize_intent(raw), "calls": calls.cast("long"), "saved": saved.cast("long")})
    return out.drop("_rule", "_told", "_key", "_body")


def call_counts(routes: DataFrame) -> DataFrame:
    """``(route, n, calls, saved)`` by route."""
    return routes.groupBy("route").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("saved").alias("saved"))


def variants(questions: DataFrame, expansion: bool = False) -> DataFrame:
    """``(query_id, variant, text, origin)`` of ``questions(query_id, question, intent [, rewritten, expanded, hypothetical])``.

    Sub-queries come first if the intent decomposes, then the question (or its rewritten form) if it is asked directly or nothing
    else is; then, with expansion, what models added. Of equal texts the first stays; blank ones go.
    """
    i = F.col("intent")
    primary = F.when(F.coalesce(i["rewritten_query"], F.lit("")) != "", i["rewritten_query"]).otherwise(F.col("question"))
    none = F.array().cast("array<struct<text:string,origin:string>>")

    def named(texts: Column, origin: str) -> Column:
        return F.transform(texts, lambda t: F.struct(X.strip(t).alias("text"), F.lit(origin).alias("origin")))

    def has(name: str) -> Column:
        return F.array_contains(i["strategies"], name)

    parts = F.when(has("decompose"), named(i["sub_queries"], "decompose")).otherwise(none)
    alone = F.array(F.struct(X.strip(primary).alias("text"), F.lit("direct").alias("origin")))
    parts = F.concat(parts, F.when(has("direct") | (F.size(parts) == 0), alone).otherwise(none))
    if "rewritten" in questions.columns:
        parts = F.concat(parts, F.when(has("rewrite"), named(F.array("rewritten"), "rewrite")).otherwise(none))
    if expansion:
        for name, column in (("expand", "expanded"), ("hyde", "hypothetical")):
            parts = F.concat(parts, F.when(has(name), named(F.col(column), name)).otherwise(none))
    rows = questions.select("query_id", F.posexplode(parts).alias("variant", "v")).select("query_id", "variant", "v.text", "v.origin").where("text <> ''")
    return rows.withColumn("turn", F.row_number().over(W.partitionBy("query_id", "text").orderBy("variant"))).where("turn = 1").drop("turn")


def questions_back(intent: Column, default: str = "请补充更具体的问题信息。") -> Column:
    """What to ask in return: the missing points, or one general question; null where nothing has to be cleared up."""
    needed = intent["needs_clarification"] | F.array_contains(intent["strategies"], "clarify")
    return F.when(needed, F.when(F.size(intent["missing_info"]) > 0, intent["missing_info"]).otherwise(F.array(F.lit(default))))


# Names for people.
TYPE_NAMES = {"definition": "定义", "fact": "事实", "process": "流程", "comparison": "比较", "summary": "总结", "policy": "政策", "troubleshooting": "排查", "other": "其它"}
STRATEGY_NAMES = {"direct": "直接检索", "rewrite": "查询改写", "expand": "查询扩展", "hyde": "HyDE", "decompose": "查询分解", "clarify": "澄清"}


#: Fixed value: what follows the type of an intent that rules gave.
RULED = "（规则判定，未调 LLM）"


def describe(intent: Column, ruled: Column | None = None) -> Column:
    """An intent for people: one line each for type, entities, slots, strategies, sub-queries, rewritten query and scale; empty ones left out.

    Where ``ruled``, the type's line says that no model was asked.
    """

    def pairs(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["type"], e["value"])), "、")

    def line(head: str, body: Column) -> Column:
        return F.when(body != "", F.concat(F.lit(head), body))

    kind = intent["question_type"]
    names = F.array_join(F.transform(intent["strategies"], lambda s: _lookup(STRATEGY_NAMES, s, s)), "、")
    return F.concat_ws(
        "\n", F.concat(F.lit("类型："), _lookup(TYPE_NAMES, kind, kind), F.lit("（"), kind, F.lit("）"), F.when(ruled, RULED).otherwise("") if ruled is not None else F.lit("")), line("实体：", pairs(intent["entities"])), line("槽位：", pairs(intent["slots"])),
        line("策略：", names), line("子问题：", F.array_join(intent["sub_queries"], "；")), line("改写查询：", intent["rewritten_query"]), F.concat(F.lit("召回倍数："), F.format_number(intent["recall_scale"], 1)),
    )
