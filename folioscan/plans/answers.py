"""Prompts, evidence records and model answers as columns; the model itself is a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X

from folioscan.functions import text as T
from folioscan.functions import vocabulary as V
from folioscan.functions.arrow import json_object

# ---- fixed values: labels and hints of prompts and answers
BODY, CONCLUSION, POINTS, DOUBTS, CONTEXT, QUESTION = "正文", "结论：", "证据点：", "不确定项：", "上下文", "问题"
STRICT = "请按严格 JSON 输出，不要添加多余字段。"
MODE_HINTS = {
    "survey": "当前问题属于综述/演进类问题。请优先总结当前知识库覆盖论文中的主要方向、代表工作和演进脉络，明确说明结论仅基于当前给定论文，不要假设知识库外的信息。",
    "comparison": "当前问题属于比较类问题。请优先提炼比较维度、相同点、差异点和证据边界，避免把单篇论文观点扩展为通用结论。",
    "metadata": "当前问题属于元数据查询。请优先回答标题、作者、年份、会议/期刊、关键词、来源文件等结构化信息，如果问题是在问“谁提出/作者是谁”，优先给出完整作者名单和对应论文标题，避免展开成长篇方法分析。",
    "references": "当前问题属于参考文献/引用查询。请优先回答引用关系、作者、年份和被引工作，不要把正文内容当成引用事实。",
}
INLINE = (r"(?i)\[[^\[\]\n]{0,220}(?:doc:|source:|section:|block:)[^\[\]\n]*\]", r"(?i)\[[^\[\]\n]{0,220}p\.\s*\d+[^\[\]\n]*\]")
#: A heading for references and the lines after it, up to a blank one.
REFERENCES = r"(?im)^[ \t]*(?:引用|references|参考)[:：][ \t]*(?:\n[ \t]*\S[^\n]*)*\n?(?:[ \t]*\n)?"
ANSWER = X.StructType([X.StructField("conclusion", X.StringType()), X.StructField("evidence_points", X.ArrayType(X.StringType())), X.StructField("uncertainties", X.ArrayType(X.StringType()))])


def or_else(c: Column, other: str) -> Column:
    trimmed = F.trim(T.text_or_empty(c.cast("string")))
    return F.when(trimmed == "", other).otherwise(trimmed)


def page_label(page: Column) -> Column:
    return F.when(page > 0, page.cast("string")).otherwise("?")


def citation_tag(doc: str = "doc_id", source: str = "source", page: str = "page", section: str = "section_path", block: str = "block_id") -> Column:
    parts = (or_else(F.col(doc), "unknown_doc"), or_else(F.col(source), "unknown"), page_label(F.col(page)), or_else(F.col(section), BODY), or_else(F.col(block), "?"))
    return F.format_string("[doc:%s|source:%s|p:%s|section:%s|block:%s]", *parts)


def author_brief(authors: Column) -> Column:
    """The first author, with a mark if there are more."""
    names = F.filter(F.transform(F.split(T.text_or_empty(authors), r"[;,，、]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) > 1, F.concat(names[0], F.lit("等"))).when(F.size(names) == 1, names[0]).otherwise("")


def title_brief(title: Column, source: Column) -> Column:
    t = T.truncate(title, 72)
    return F.when(t != "", t).otherwise(F.regexp_replace(T.text_or_empty(source), r"\.[A-Za-z0-9]+$", ""))


def citation_text(title: str = "title", source: str = "source", year: str = "year", page: str = "page", section: str = "section_path") -> Column:
    y = F.col(year).cast("string")
    shown = F.when(y.rlike(r"^\d{4}$"), y).otherwise("n.d.")
    return F.format_string("[%s, %s, p.%s, %s]", title_brief(F.col(title), F.col(source)), shown, page_label(F.col(page)), or_else(F.col(section), BODY))


def evidence_records(evidence: DataFrame) -> DataFrame:
    """Evidence rows with the struct `record`; snippets are cut to 1,000 characters."""
    s = T.squeeze(F.col("text"))
    snippet = F.when(F.length(s) > 1000, F.concat(F.substring(s, 1, 1000), F.lit(" ..."))).otherwise(s)
    record = F.struct(
        citation_text().alias("citation_text"), citation_tag().alias("citation_tag"), F.trim(T.text_or_empty(F.col("source"))).alias("source"), page_label(F.col("page")).alias("page"),
        or_else(F.col("section_path"), BODY).alias("section_path"), or_else(F.col("doc_id"), "").alias("doc_id"), or_else(F.col("block_id"), "?").alias("block_id"), snippet.alias("snippet"),
    )
    return evidence.withColumn("record", record)


def scope_hint(scope: Column, route: Column) -> Column:
    """What a prompt says of its context; blank for other scopes and routes."""
    by_route = reduce(lambda c, k: c.when(route == k, V.SCOPE_HINTS[k]), ("metadata",), F.when(route == "survey", V.SCOPE_HINTS["survey"])).otherwise("")
    return F.when(scope == "references", V.SCOPE_HINTS["references"]).otherwise(by_route)


def retrieval_scope(scope: Column) -> Column:
    """references for any of its names, main for all else."""
    return F.when(F.lower(F.trim(T.text_or_empty(scope))).isin(*V.REFERENCE_SCOPES), "references").otherwise("main")


def cited_rows(plan: DataFrame, papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, kind, id, rank) that an answer cites: papers for metadata questions that recalled any, else the evidence."""
    own = papers.join(plan.where("route = 'metadata'").select("query_id"), "query_id", "left_semi").select("query_id", F.lit("paper").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("rank").cast("long").alias("rank"))
    rest = evidence.join(own.select("query_id").distinct(), "query_id", "left_anti")
    return own.unionByName(rest.select("query_id", F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("rank").cast("long").alias("rank")))


def answer_questions(queries: DataFrame, retrieved: dict[str, DataFrame], model: Callable[[list[str]], list[str]], scope: str = "main", rules: str = "") -> DataFrame:
    """(query_id, answer, parsed, shown, citations) from what `flow.ask` found: prompts over the generation rows, the model's
    answers made readable, and the rows they cite.  A question without anything to go by gets no row."""
    plan = retrieved["plan"]
    hints = plan.select("query_id", scope_hint(retrieval_scope(F.lit(scope)), F.col("route")).alias("hint"))
    rows = retrieved["generation"].select("query_id", F.col("place").alias("rank"), F.col("id").alias("doc_id"), "text", *[F.lit(None).cast("string").alias(c) for c in ("source", "section_path", "block_id")], F.lit(None).cast("int").alias("page"))
    prompted = prompts(queries.join(plan.select("query_id", "route"), "query_id"), rows, rules).join(hints, "query_id")
    asked = prompted.select("query_id", F.when(F.col("hint") == "", F.col("prompt")).otherwise(F.concat_ws("\n\n", "hint", "prompt")).alias("prompt"))
    cited = cited_rows(plan, retrieved["papers"], retrieved["evidence"].withColumn("rank", F.col("position"))).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "id"))), lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"))).alias("citations"))
    return readable_answers(generate(asked, model)).join(cited, "query_id", "left")


def prompts(questions: DataFrame, evidence: DataFrame, rules: str = "") -> DataFrame:
    """(query_id, prompt) from questions (query_id, text, route) and their ranked evidence; no evidence, no prompt."""
    line = F.concat_ws("\n", F.concat(F.lit(f"[{CONTEXT}"), F.col("rank").cast("string"), F.lit("] "), citation_tag()), F.trim("text"))
    context = evidence.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))
    hint = reduce(lambda c, kv: c.when(F.col("route") == kv[0], F.lit(kv[1] + "\n\n")), MODE_HINTS.items(), F.when(F.lit(False), "")).otherwise("")
    prompt = F.concat(F.lit(f"{rules}\n\n"), hint, F.lit(f"{STRICT}\n\n{CONTEXT}：\n"), F.col("context"), F.lit(f"\n\n{QUESTION}：\n"), F.col("text"), F.lit("\n"))
    return questions.join(context, "query_id").select("query_id", prompt.alias("prompt"))


def without_citations(c: Column) -> Column:
    bare = reduce(lambda x, p: F.regexp_replace(x, p, ""), INLINE, F.trim(T.text_or_empty(c)))
    kept = F.regexp_replace(bare, REFERENCES, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def readable_answers(raw: DataFrame, column: str = "answer") -> DataFrame:
    """`raw` with `parsed` (null without a JSON object) and `shown`: numbered sections, or the text without citations."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    out = raw.withColumn("__json", json_object(F.col(column))).withColumn("parsed", F.from_json("__json", ANSWER))
    points, doubts = clean(F.col("parsed.evidence_points")), clean(F.col("parsed.uncertainties"))
    lines = lambda a, f: F.array_join(F.transform(a, f), "\n")
    first = F.trim(T.text_or_empty(F.col("parsed.conclusion")))
    parts = F.array_compact(F.array(
        F.when(first != "", F.concat(F.lit(CONCLUSION + "\n"), first)), F.when(F.size(points) > 0, F.concat(F.lit(POINTS + "\n"), lines(points, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))),
        F.when(F.size(doubts) > 0, F.concat(F.lit(DOUBTS + "\n"), lines(doubts, lambda x: F.concat(F.lit("- "), x)))),
    ))
    return out.withColumn("__parts", parts).withColumn("shown", F.when(F.size("__parts") > 0, F.array_join("__parts", "\n\n")).otherwise(without_citations(F.col(column)))).drop("__json", "__parts")


def generate(prompted: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(query_id, answer): `model` gets a batch of prompts on an executor."""

    @F.pandas_udf(X.StringType())
    def call(p: pd.Series) -> pd.Series:
        return pd.Series(model(p.tolist()), index=p.index)

    return prompted.select("query_id", call("prompt").alias("answer"))
