"""Reports as tables: counts, sections with numbers, lines of Markdown, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

# What to do about each kind of warning, in the order of the report; the second code is the one used in checklist_result.
ADVICE = (
    (("KEYWORD_SHORT", "short_keyword"), "① 匹配关键词太短，请读取原文片段确认是否真的对应同一表述"),
    (("KEYWORD_GENERIC", "generic_keyword"), "② 关键词过于通用，请检查上下文是否与目标表述一致"),
    (("NUMBER_MISSING", "number_absent"), "③ 部分数字无出处，请核实这些数字的来源"),
    (("GROWTH_CONTEXT", "percent_context"), "④ 增长率数字缺少对应语境，请确认增长率是否准确"),
    (("SUBCLAIM_UNSOURCED", "subclaim_unsourced"), "⑤ 复合表述有子命题无出处，请逐个子命题核实"),
    (("ENTITY_UNCOVERED", "entity_uncovered"), "⑥ 实体覆盖率不足，可能存在张冠李戴，请逐名称比对"),
)
NO_ADVICE = "请逐字比对目标表述与原文片段是否一致"
SECTIONS = ("not_found", "flagged", "confirmed")


def console_summary(claims: DataFrame) -> str:
    """The counts of all claims, as lines of text."""
    r = summary(claims).first()
    return "\n".join(f"{label}: {r[c]}" for label, c in (("claims", "n_claims"), ("✓", "n_confirmed"), ("✗", "n_not_found"), ("△", "n_attention"), ("⚠", "n_warned"), ("compound", "n_compound"), ("with names", "n_with_entities")))


def codes(warnings: Column) -> Column:
    """The codes of an array of warnings; empty for null."""
    return F.coalesce(F.transform(warnings, lambda w: w["code"]), F.array().cast("array<string>"))


def advice(code_list: Column) -> Column:
    parts = F.concat_ws("; ", *(F.when(F.arrays_overlap(code_list, F.array(*map(F.lit, names))), text) for names, text in ADVICE))
    return F.when(parts == "", NO_ADVICE).otherwise(parts)


def coverage_note(code_list: Column) -> Column:
    return F.when(F.size(code_list) == 0, "✓ 实体全部匹配").when(F.arrays_overlap(code_list, F.array(F.lit("ENTITY_UNCOVERED"), F.lit("entity_uncovered"))), F.concat_ws("; ", code_list)).otherwise("见反向验证警告")


def _marks() -> dict[str, Column]:
    status = F.coalesce("status", F.lit(""))
    warned = F.size(F.coalesce("warnings", F.array())) > 0
    has = lambda m: F.contains(status, F.lit(m))
    return {"not_found": has("✗"), "flagged": warned | has("△"), "confirmed": has("✓"), "warned": warned, "triangle": has("△")}


def summary(claims: DataFrame, *by: str) -> DataFrame:
    m = _marks()
    return claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(m["confirmed"]).alias("n_confirmed"), F.count_if(m["not_found"]).alias("n_not_found"),
        F.count_if(m["triangle"]).alias("n_attention"), F.count_if(m["warned"]).alias("n_warned"),
        F.count_if(F.size(F.coalesce("sub_claims", F.array())) > 1).alias("n_compound"), F.count_if(F.size(F.coalesce("entities", F.array())) > 0).alias("n_with_entities"),
    )


def sectioned(claims: DataFrame, within: str = "target_path") -> DataFrame:
    """A row for each claim and section that it belongs to (a warned claim that is confirmed has two), with
    its number in the section: not found first, then flagged, then confirmed."""
    m = _marks()
    places = F.filter(F.array(*(F.when(m[s], F.struct(F.lit(k + 1).alias("section_no"), F.lit(s).alias("section"))) for k, s in enumerate(SECTIONS))), lambda x: x.isNotNull())
    rows = claims.withColumn("_place", F.explode(places)).select("*", "_place.*").drop("_place")
    return numbered(rows, [within, "section_no"], ["pos", "claim_id"], "item_no").withColumn("item_no", F.col("item_no").cast("int"))


#: How a label of verifiability shows in the table of claims not found.
VERIFIABLE = {True: "🔍 可核实", False: "— 不可核实"}


def markdown_lines(claims: DataFrame, within: str = "target_path", date: str = "", n_references: int | None = None) -> DataFrame:
    """within, section_no, item_no, part, line_no, line: the report of each target, in that order. claims may have the
    column verifiable (boolean); where a target has labels, its section of claims not found tells how many of each."""
    if "verifiable" not in claims.columns:
        claims = claims.withColumn("verifiable", F.lit(None).cast("boolean"))
    rows = sectioned(claims, within)
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(c)
    head = F.replace(F.left("claim_text", F.lit(80)), F.lit("|"), F.lit("｜"))
    listed = lambda c: dash(F.concat_ws("、", F.col(c)))
    n = F.col("item_no").cast("string")
    cut = F.when(F.length("snippet") > 120, F.concat(F.left("snippet", F.lit(120)), F.lit("…"))).otherwise(F.col("snippet"))
    shown = F.when(F.coalesce(cut, F.lit("")) == "", "—").otherwise(F.concat(F.lit("`"), F.replace(cut, F.lit("`"), F.lit("")), F.lit("`")))
    cell = lambda label, value: F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))
    warned = codes(F.col("warnings"))
    label = F.coalesce(F.when(F.col("verifiable"), VERIFIABLE[True]).when(~F.col("verifiable"), VERIFIABLE[False]), F.lit(""))
    detail = F.concat_ws("; ", F.transform("warnings", lambda w: F.concat_ws("：", w["code"], F.when(w["detail"] != "", w["detail"]))))
    row = {
        "not_found": F.array(F.concat(F.lit("| "), n, F.lit(" | "), label, F.lit(" | "), head, F.lit(" | "), listed("entities"), F.lit(" | "), listed("numbers"), F.lit(" |"))),
        "flagged": F.array(
            F.lit(""), F.concat(F.lit("### "), n, F.lit(" · "), F.coalesce("status", F.lit(""))), F.lit(""), F.lit("**表述：**  "), F.col("claim_text"), F.lit(""), F.lit("| 字段 | 内容 |"), F.lit("|------|------|"),
            cell("出处", dash(F.col("source"))), cell("原文片段", shown), cell("匹配关键词", dash(F.col("matched_keyword"))), cell("警告", dash(detail)), cell("建议", advice(warned)),
        ),
        "confirmed": F.array(F.concat(F.lit("| "), n, F.lit(" | "), head, F.lit(" | "), dash(F.col("source")), F.when(F.size(warned) > 0, " ⚠").otherwise(""), F.lit(" |"))),
    }
    lines = F.when(F.col("section") == "not_found", row["not_found"]).when(F.col("section") == "flagged", row["flagged"]).otherwise(row["confirmed"])
    body = rows.select(within, "section_no", "item_no", F.posexplode(lines).alias("line_no", "line"))
    m = _marks()
    labelled = claims.groupBy(within).agg(
        F.count_if(m["not_found"] & F.col("verifiable")).alias("n_verifiable"), F.count_if(m["not_found"] & ~F.col("verifiable")).alias("n_unverifiable"),
        F.count_if(m["not_found"] & F.col("verifiable").isNull()).alias("n_unlabelled"), F.count_if(m["flagged"]).alias("n_flagged"),
    )
    count = summary(claims, within).join(labelled, within)
    overview = F.concat(F.lit("✗ 未找到："), "n_not_found", F.lit("　　⚠ 反向验证重点关注："), "n_warned", F.lit("　　△ 需关注："), "n_attention", F.lit("　　✓ 已确认："), "n_confirmed")
    references = f"  参考文档：{n_references} 份" if n_references is not None else ""
    made = F.concat(F.lit(f"生成时间：{date}{references}  共 "), "n_claims", F.lit(" 条"))
    groups = F.concat(F.lit("> 可核实（建议优先核查）："), "n_verifiable", F.lit(" 条　　不可核实（修辞、标题、原则）："), "n_unverifiable", F.lit(" 条　　未标注："), "n_unlabelled", F.lit(" 条"))
    has_labels = F.col("n_verifiable") + F.col("n_unverifiable") > 0
    kept = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    none = lambda c: F.when(F.col(c) == 0, "（无）")
    some = lambda c, text: F.when(F.col(c) > 0, text)
    titled = lambda mark, c, more="": F.concat(F.lit(f"## {mark}（"), c, F.lit(f" 条）{more}"))
    heads = {
        0: (F.concat(F.lit("# 核对清单 — "), within), made, F.lit(""), F.lit("## 概览"), overview, F.lit(""), F.lit("---")),
        1: (F.lit(""), titled("✗ 未找到", "n_not_found", "，建议人工逐条核查"), F.when(has_labels, groups), none("n_not_found"), some("n_not_found", ""), some("n_not_found", "| # | 可核实性 | 表述内容 | 命中实体 | 命中数字 |"), some("n_not_found", "|---|---------|---------|---------|--------|")),
        2: (F.lit(""), F.lit("---"), F.lit(""), titled("⚠ 反向验证重点关注", "n_flagged"), none("n_flagged")),
        3: (F.lit(""), F.lit("---"), F.lit(""), titled("✓ 已确认", "n_confirmed"), none("n_confirmed"), some("n_confirmed", "<details><summary>展开查看</summary>"), some("n_confirmed", ""), some("n_confirmed", "| # | 表述内容（前 80 字） | 出处 |"), some("n_confirmed", "|---|------------------|------|")),
    }
    tail = count.filter("n_confirmed > 0").select(within, F.lit(4).alias("section_no"), F.lit(0).alias("item_no"), F.posexplode(F.array(F.lit(""), F.lit("</details>"))).alias("line_no", "line"))
    out = body.unionByName(tail)
    for number, items in heads.items():
        out = out.unionByName(count.select(within, F.lit(number).alias("section_no"), F.lit(0).alias("item_no"), F.posexplode(kept(*items)).alias("line_no", "line")))
    return out


def sheets(claims: DataFrame) -> dict[str, DataFrame]:
    """The five sheets of the workbook, as tables."""
    m = _marks()
    shown = claims.withColumns({"codes": F.concat_ws("; ", codes(F.col("warnings"))), "numbers": F.concat_ws(", ", "numbers"), "names": F.concat_ws(", ", "entities")})
    base = ("target_path", "claim_id", "kind", "claim_text", "status")
    return {
        "all": shown.select(*base, "source", "snippet", "codes", "numbers"),
        "confirmed": shown.filter(m["confirmed"]).select(*base, "source", "snippet", "codes"),
        "pending": shown.filter(m["not_found"] | m["triangle"]).select(*base, "snippet"),
        "warned": shown.filter(m["warned"]).select(*base, "numbers", "matched_keyword", "codes", advice(codes(F.col("warnings"))).alias("advice")),
        "coverage": shown.filter(F.size("entities") > 0).select("target_path", "claim_id", F.left("claim_text", F.lit(80)).alias("claim_text"), "names", "status", coverage_note(codes(F.col("warnings"))).alias("note")),
    }
