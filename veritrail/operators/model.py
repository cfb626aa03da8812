"""The language model's side: settings, a client, instructions, messages, and the calls that need them.

A client is a function from a list of messages to a list of answers (JSON text, or None for a failed call). The one here
speaks the common chat completions protocol; any other function will do. Without one nothing changes."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..session import materialize
from .adjudicate import apply_verdicts, classify_queue, judge_queue, model_claims, repaired, with_evidence
from .claims import batches, neighbours, prompt_texts

Client = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Settings:
    """Where the model is. `root` is the path in front of /chat/completions."""

    key: str = ""
    base_url: str = "https://api.deepseek.com"
    model: str = "deepseek-chat"
    timeout: float = 60.0
    root: str = ""

    @classmethod
    def of(cls, values: Mapping[str, str] | None = None, **given: object) -> Settings:
        """From environment variables (the first name that has a value counts), less what is given."""
        values = os.environ if values is None else values
        names = {"key": ("FACTCHECK_LLM_API_KEY", "DEEPSEEK_API_KEY"), "base_url": ("FACTCHECK_LLM_BASE_URL",), "model": ("FACTCHECK_LLM_MODEL",)}
        found = {field: v for field, keys in names.items() if (v := next((values[k] for k in keys if values.get(k)), None))}
        return cls(**(found | given))


def chat_client(settings: Settings, instruction: str, max_tokens: int | None = None) -> Client | None:
    """A client that sends each message with the instruction; None without a key, so that callers go on without a model."""
    if not settings.key:
        return None

    def ask_all(messages: list[str]) -> list[str | None]:
        return [_call(settings, instruction, m, max_tokens) for m in messages]

    return ask_all


def _call(settings: Settings, instruction: str, message: str, max_tokens: int | None) -> str | None:
    body = {"model": settings.model, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": message}], "temperature": 0, "response_format": {"type": "json_object"}, "stream": False}
    if max_tokens:
        body["max_tokens"] = max_tokens
    url = f"{settings.base_url.rstrip('/')}{settings.root}/chat/completions"
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {settings.key}"})
    try:
        with urllib.request.urlopen(request, timeout=settings.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]
    except Exception:  # whatever fails, on either side: the claim keeps what the rules gave it
        return None


_RULES = """判定只看所给证据，不用常识，也不由"相关"推出"成立"：
- confirmed：证据写明了声明的主体、时间、数字、口径和专名（数字可合理舍入），须引原文；
- needs_review：只支持一部分，名称相近而不相同，或各处说法不一；
- inconsistent：主体、时间、口径相同而内容冲突，须引冲突的原文；
- not_found：证据中没有依据，或没有证据（不等于声明有误）。
同名专项须全名一致；并列列举不算冲突。"""
SINGLE = f"""你核对公文中的一条声明。{_RULES}
只输出 JSON：{{"verdict": "confirmed|needs_review|inconsistent|not_found", "citation": "证据原文，至多120字", "reasoning": "理由，至多60字"}}"""
BATCH = f"""你逐条核对编号的声明，各附证据（可能没有）。{_RULES}
另判断 verifiable：yes 表示含数字、专名、奖项、排名或事件，可查文件核实；no 表示修辞、过渡、标题、原则或引语。
只输出 JSON：{{"results": [{{"index": 1, "verdict": "confirmed|needs_review|inconsistent|not_found", "verifiable": "yes|no", "citation": "至多80字", "reasoning": "至多40字"}}]}}，index 与输入编号一一对应。"""
CLASSIFY = """不看证据，只看文字，判断每条声明能否查文件核实：yes 表示含数字、专名、奖项、排名、文号或事件；no 表示修辞、过渡、标题、原则或引语。
只输出 JSON：{"results": [{"index": 1, "verifiable": "yes|no"}]}，index 与输入编号一一对应。"""
PREFILTER = """对编号的句子（附前后句）判断是否需要核查：含数字、专名或具体成就的为 true；口号、过渡、标题、观点、引语为 false；拿不准的为 true。
只输出 JSON：{"results": [{"index": 1, "needs_check": true}]}，index 与输入编号一一对应。"""
EXTRACT = """从公文正文中逐字抄出可核实的声明：含数字、专名（机构、项目、平台、称号、文件）或具体成就的句子或分句；不抄口号、过渡、观点、引语、修辞。专名只取名词，不取动宾短语。
只输出 JSON：{"claims": [{"表述内容": "…", "类型": "定量|定性", "命中数字": ["…"], "命中实体": ["…"]}]}。"""

FIELDS_ANSWER = "results array<struct<index:int,verdict:string,citation:string,reasoning:string,verifiable:string,needs_check:boolean>>"


def _listed(label: str, items: Column, mark: str) -> Column:
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.concat(F.lit(f"（{label}："), F.concat_ws(mark, items), F.lit("）"))).otherwise("")


def _lines(*parts: Column) -> Column:
    """The parts that aren't empty, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def _sub_claims() -> Column:
    return F.transform(F.coalesce("sub_claims", F.array()), lambda s: s["text"])


def single_messages(claims: DataFrame, most: int = 5) -> DataFrame:
    """claim_id, message: a claim with its numbers, names, sub-claims and up to five candidates of up to 400 characters; for
    claims that have candidates."""
    rows = claims.filter(F.size(F.coalesce("candidates", F.array())) > 0)
    proof = F.transform(F.slice("candidates", 1, most), lambda c, i: F.concat(F.lit("["), i + 1, F.lit("] 来源："), F.coalesce(c["source"], F.lit("未知来源")), F.lit("\n"), F.left(F.coalesce(c["text"], F.lit("")), F.lit(400))))
    head = _lines(
        F.concat(F.lit("【待核实声明】\n"), "claim_text"), _listed("声明中的数字", F.col("numbers"), ", "), _listed("声明中的专名", F.col("entities"), ", "),
        F.when(F.size(_sub_claims()) > 1, _listed("可分解子命题", _sub_claims(), "；")).otherwise(""),
    )
    return rows.select("claim_id", F.concat(head, F.lit("\n\n【参考证据片段】\n"), F.concat_ws("\n", proof)).alias("message"))


def _batched(rows: DataFrame, part: Column, size: int) -> DataFrame:
    """target_path, batch_no, claim_ids (in the order of their index), n, message: of rows with batch_no and index."""
    joined = F.array_sort(F.collect_list(F.struct("index", "claim_id", part.alias("part"))))  # `size` rows at most
    out = rows.groupBy("target_path", "batch_no").agg(joined.alias("b"))
    return out.select("target_path", "batch_no", F.transform("b", lambda x: x["claim_id"]).alias("claim_ids"), F.size("b").cast("bigint").alias("n"), F.concat_ws("\n", F.transform("b", lambda x: x["part"])).alias("message"))


def batch_messages(queue: DataFrame, size: int = L.JUDGE_BATCH) -> DataFrame:
    """target_path, batch_no, claim_ids, n, message: the claims of a batch with numbers, names, sub-claims and up to
    three pieces of evidence of up to 500 characters."""
    rows = batches(queue, "claim_id", size, "target_path")
    head = F.concat(
        F.lit("【声明 "), "index", F.lit("】"), "claim_text", _listed("数字", F.col("numbers"), ", "), _listed("专名", F.col("entities"), ", "),
        F.when(F.size(_sub_claims()) > 1, _listed("子命题", _sub_claims(), "；")).otherwise(""),
    )
    lines = F.transform(F.slice("evidence", 1, 3), lambda e, i: F.concat(F.lit("  ["), i + 1, F.lit("]"), F.coalesce(e["source"], F.lit("")), F.lit(": "), F.left(e["text"], F.lit(500))))
    proof = F.when(F.size("evidence") > 0, F.concat(F.lit("【证据】\n"), F.concat_ws("\n", lines))).otherwise("【证据】（无候选证据）")
    return _batched(rows, F.concat(head, F.lit("\n"), proof, F.lit("\n")), size)


def classify_messages(queue: DataFrame, fields: bool = False, size: int = L.CLASSIFY_BATCH) -> DataFrame:
    """target_path, batch_no, claim_ids, n, message: numbered claims without evidence; with `fields` also their numbers
    and up to five names."""
    rows = batches(queue, "claim_id", size, "target_path")
    part = F.concat(F.lit("【"), "index", F.lit("】"), "claim_text")
    if fields:
        both = F.concat_ws(" / ", *(F.when(F.size(F.coalesce(c, F.array())) > 0, F.concat(F.lit(f"{label}："), F.concat_ws(", ", F.slice(c, 1, most)))) for label, c, most in (("数字", "numbers", 1 << 20), ("实体", "entities", 5))))
        part = F.concat(part, F.when(both != "", F.concat(F.lit("\n  （"), both, F.lit("）"))).otherwise(""))
    return _batched(rows, part, size)


def prefilter_messages(claims: DataFrame, size: int = L.CLASSIFY_BATCH) -> DataFrame:
    """target_path, batch_no, claim_ids, n, message: numbered claims with up to 60 characters of the one before and after."""
    rows = batches(neighbours(claims), "claim_id", size, "target_path")
    near = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"  {label}："), F.left(c, F.lit(60)))).otherwise("")
    return _batched(rows, F.concat(_lines(F.concat(F.lit("【"), "index", F.lit("】"), "claim_text"), near("前句", "before"), near("后句", "after")), F.lit("\n")), size)


def ask(messages: DataFrame, client: Client) -> DataFrame:
    """Adds answer (JSON text or null) and seconds (of a message's share of its call) to messages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            began = time.perf_counter()
            answers = client(frame["message"].tolist())
            yield frame.assign(answer=answers, seconds=(time.perf_counter() - began) / max(1, len(frame)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInPandas(run, f"{schema}, answer string, seconds double")


def call_counts(answers: DataFrame, *by: str) -> DataFrame:
    """n_calls, n_failed, seconds (of all calls, as if one came after the other) and seconds a call."""
    return answers.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("answer").isNull()).alias("n_failed"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("seconds_a_call"))


def answered(answers: DataFrame) -> DataFrame:
    """claim_id, verdict, citation, reasoning, verifiable (boolean), needs_check: a row a claim that an answer names by its
    number; what a failed or incomplete answer leaves out is missing. Of a number named twice the last counts."""
    rows = answers.select("claim_ids", F.posexplode(repaired(F.col("answer"), FIELDS_ANSWER)).alias("_at", "r")).filter("r.index between 1 and size(claim_ids)")
    rows = rows.select(F.try_element_at("claim_ids", F.col("r.index")).alias("claim_id"), "_at", "r.*").groupBy("claim_id").agg(F.max_by(F.struct("verdict", "citation", "reasoning", "verifiable", "needs_check"), "_at").alias("r"))
    return rows.select("claim_id", "r.verdict", "r.citation", "r.reasoning", F.when(F.col("r.verifiable") == "yes", True).when(F.col("r.verifiable") == "no", False).alias("verifiable"), "r.needs_check")


def _merged(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims with status, citation, reasoning and verifiable as changed, and a note added to the warnings."""
    keep = [c for c in claims.columns if c not in ("status", "citation", "reasoning", "verifiable", "warnings")]
    own = {c: F.col(f"c.{c}") if c in claims.columns else F.lit(None) for c in ("citation", "reasoning", "verifiable")}
    v = changed.alias("v")
    rows = claims.alias("c").join(v, F.col("c.claim_id") == F.col("v.claim_id"), "left")
    note = F.when(F.col("v.note").startswith("LLM_NOTE:"), F.array(F.struct(F.lit("LLM_NOTE").alias("code"), F.expr("substring(v.note, 10)").alias("detail"))))
    empty = F.array().cast("array<struct<code:string,detail:string>>")
    warned = F.concat(F.coalesce("c.warnings", empty), F.coalesce(note, empty))
    return rows.select(
        *(F.col(f"c.{c}") for c in keep), F.coalesce("v.status", "c.status").alias("status"), F.coalesce("v.citation", own["citation"].cast("string")).alias("citation"),
        F.coalesce("v.reasoning", own["reasoning"].cast("string")).alias("reasoning"), F.coalesce("v.verifiable", own["verifiable"].cast("boolean")).alias("verifiable"), warned.alias("warnings"),
    )


def judge(claims: DataFrame, client: Client | None, size: int = L.JUDGE_BATCH) -> DataFrame:
    """The claims after the judge has seen those of its queue in batches; unchanged without a client."""
    if client is None:
        return claims
    answers = materialize(ask(batch_messages(judge_queue(claims), size), client), "answers")
    return _merged(claims, apply_verdicts(claims, answered(answers).drop("needs_check")))


def judge_each(claims: DataFrame, client: Client | None) -> DataFrame:
    """The claims after the judge has seen each that has candidates, whatever its status, one a call."""
    if client is None:
        return claims
    answers = materialize(ask(single_messages(claims), client), "answers")
    one = F.concat(F.lit('{"results": ['), F.regexp_extract("answer", r"(?s)\{.*\}", 0), F.lit("]}"))
    verdicts = answers.filter("answer is not null").select("claim_id", F.get(repaired(one, FIELDS_ANSWER), 0).alias("r")).select("claim_id", "r.verdict", "r.citation", "r.reasoning", F.lit(None).cast("boolean").alias("verifiable"))
    asked = with_evidence(claims).filter(F.size(F.coalesce("candidates", F.array())) > 0)
    return _merged(claims, apply_verdicts(asked, verdicts, queued=True))


def classify(claims: DataFrame, client: Client | None, fields: bool = False, size: int = L.CLASSIFY_BATCH) -> DataFrame:
    """The claims with verifiable set for those not found that had no label; unchanged without a client."""
    if client is None:
        return claims
    if "verifiable" not in claims.columns:
        claims = claims.withColumn("verifiable", F.lit(None).cast("boolean"))
    answers = materialize(ask(classify_messages(classify_queue(claims), fields, size), client), "answers")
    labels = answered(answers).select("claim_id", F.col("verifiable").alias("_label"))
    return claims.join(labels, "claim_id", "left").withColumn("verifiable", F.coalesce("verifiable", "_label")).drop("_label")


def prefilter(claims: DataFrame, client: Client | None, size: int = L.CLASSIFY_BATCH) -> DataFrame:
    """The claims less those that the model says need no check; whatever has no answer stays."""
    if client is None:
        return claims
    answers = materialize(ask(prefilter_messages(claims, size), client), "answers")
    return claims.join(answered(answers).filter(~F.col("needs_check")).select("claim_id"), "claim_id", "left_anti")


def extract(texts: DataFrame, text_id: str, client: Client) -> DataFrame:
    """text_id, text -> text_id, claim_text, kind, numbers, entities, as the model names them; a text of which a part
    failed has no rows here and goes to the extraction without a model."""
    parts = prompt_texts(texts, text_id).withColumnRenamed("part", "message")
    return model_claims(materialize(ask(parts, client), "answers").select(text_id, "part_no", "answer"), text_id)
