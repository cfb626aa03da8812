"""Adjudication, reports, evaluation, sources, streaming."""


import json
import zipfile

from pyspark.sql import functions as F

from veritrail.functions import lexicon as L
from veritrail.operators import adjudicate, evaluate, model, report
from veritrail.sources import files
from veritrail.streaming import follow_chunks

CLAIM = "claim_id bigint, target_path string, pos int, kind string, claim_text string, status string, source string, snippet string, matched_keyword string, numbers array<string>, entities array<string>, sub_claims array<struct<text:string>>, warnings array<struct<code:string,detail:string>>"


def claims(spark):
    rows = [
        (1, "p", 1, "定量", "甲|一", L.CONFIRMED, "s", "s: ...甲...", "甲", ["1项"], ["甲"], [], []),
        (2, "p", 2, "定性", "乙", L.CONFIRMED, "s", "`乙`" * 70, "乙", [], [], [("a",), ("b",)], [("KEYWORD_SHORT", ""), ("NUMBER_MISSING", "")]),
        (3, "p", 3, "定性", "丙", L.NOT_FOUND, None, None, None, [], None, [], []),
        (4, "p", 4, "定性", "丁", L.REVIEW, "s", "s: ...丁...", "丁", [], [], [], None),
        (5, "p", 5, "定性", "戊", L.PARTIAL, "s", "s: ...戊...", "戊", [], [], [], []),
        (6, "p", 6, "定性", "己", None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CLAIM)


def test_queue_and_verdicts(spark):
    df = claims(spark)
    assert sorted(r["claim_id"] for r in adjudicate.judge_queue(df).collect()) == [2, 3, 4]
    verdicts = spark.createDataFrame([(2, "inconsistent", " c ", "r", True), (3, "confirmed", "c", "", None), (9, "confirmed", "", "", None)], "claim_id bigint, verdict string, citation string, reasoning string, verifiable boolean")
    got = {r["claim_id"]: r.asDict() for r in adjudicate.apply_verdicts(df, verdicts).collect()}
    assert (got[2]["status"], got[2]["citation"], got[2]["note"], got[2]["verifiable"]) == (L.INCONSISTENT, "c", "LLM_NOTE:r", True)
    assert (got[3]["status"], got[3]["citation"]) == (L.NOT_FOUND, "c")  # without evidence only the label changes
    assert (got[4]["status"], got[4]["note"]) == (L.REVIEW, "NO_ANSWER")
    unknown = verdicts.withColumn("verdict", F.lit("maybe"))
    assert {r["note"] for r in adjudicate.apply_verdicts(df, unknown).collect()} == {"UNKNOWN_VERDICT:maybe", "NO_ANSWER"}


def test_messages_and_client(spark):
    messages = model.batch_messages(adjudicate.judge_queue(claims(spark)), 2)
    rows = messages.orderBy("batch_no").collect()
    assert [r["n"] for r in rows] == [2, 1] and "【声明 1】乙（子命题：a；b）" in rows[0]["message"] and "（无候选证据）" in rows[0]["message"]
    assert [r["claim_ids"] for r in rows] == [[2, 3], [4]]
    answers = model.ask(messages, lambda texts: [None if "丁" in t else "[]" for t in texts])
    assert [r["answer"] for r in answers.orderBy("batch_no").collect()] == ["[]", None]
    counts = model.call_counts(answers).first()
    assert (counts["n_calls"], counts["n_failed"]) == (2, 1) and counts["seconds"] >= 0


CANDIDATES = "array<struct<source:string,text:string,score:double>>"


def with_candidates(spark):
    return claims(spark).withColumn("candidates", F.when(F.col("claim_id").isin(1, 3), F.array(*(F.struct(F.lit(f"来源{k}").alias("source"), F.lit("证" * 450).alias("text"), F.lit(1.0).alias("score")) for k in range(7)))).cast(CANDIDATES))


def test_single_messages_and_evidence(spark):
    df = with_candidates(spark)
    got = {r["claim_id"]: r["message"] for r in model.single_messages(df).collect()}
    assert set(got) == {1, 3} and got[1].startswith("【待核实声明】\n甲|一\n（声明中的数字：1项）\n（声明中的专名：甲）\n\n【参考证据片段】\n[1] 来源：来源0\n证")
    assert got[1].count("来源：") == 5 and "证" * 400 in got[1] and "证" * 401 not in got[1] and "数字" not in got[3]
    queue = {r["claim_id"]: r["evidence"] for r in adjudicate.judge_queue(df).collect()}
    assert [e["source"] for e in queue[3]] == ["来源0", "来源1", "来源2"] and [e["source"] for e in queue[2]] == ["s"]


def test_classify_and_prefilter_messages(spark):
    df = claims(spark).withColumn("verifiable", F.lit(None).cast("boolean"))
    assert model.classify_messages(adjudicate.classify_queue(df)).first()["message"] == "【1】丙"
    fields = {r["message"] for r in model.classify_messages(df.filter("claim_id = 1"), fields=True).collect()}
    assert fields == {"【1】甲|一\n  （数字：1项 / 实体：甲）"}
    text = model.prefilter_messages(df).first()["message"]
    assert text.startswith("【1】甲|一\n  后句：乙\n\n【2】乙\n  前句：甲|一\n  后句：丙\n")


def test_judging(spark):
    """A judge in batches: an answer by number, a number twice, one beyond the batch, a failed batch."""

    def client(messages):
        return [None if "丁" in m else json.dumps({"results": [{"index": 1, "verdict": "x"}, {"index": 1, "verdict": "needs_review", "reasoning": "不全", "verifiable": "yes"}, {"index": 2, "verdict": "not_found", "verifiable": "no"}, {"index": 9, "verdict": "confirmed"}]}) for m in messages]

    got = {r["claim_id"]: r for r in model.judge(claims(spark), client, 2).collect()}
    assert len(got) == 6
    assert (got[2]["status"], got[2]["verifiable"], [w["code"] for w in got[2]["warnings"]][-1], got[2]["warnings"][-1]["detail"]) == (L.REVIEW, True, "LLM_NOTE", "不全")
    assert (got[3]["status"], got[3]["verifiable"]) == (L.NOT_FOUND, False)
    assert (got[4]["status"], got[4]["verifiable"], got[4]["warnings"]) == (L.REVIEW, None, []) and got[1]["status"] == L.CONFIRMED
    assert model.judge(claims(spark), None).columns == claims(spark).columns


def test_judging_each(spark):
    def client(messages):
        return ["```json\n" + json.dumps({"verdict": "inconsistent", "citation": "证", "reasoning": "冲突"}) + "\n```" if "甲" in m else "nothing" for m in messages]

    got = {r["claim_id"]: r for r in model.judge_each(with_candidates(spark), client).collect()}
    assert (got[1]["status"], got[1]["citation"]) == (L.INCONSISTENT, "证") and got[1]["warnings"][-1]["detail"] == "冲突"
    assert got[3]["status"] == L.NOT_FOUND and got[2]["status"] == L.CONFIRMED


def test_classifying_and_prefiltering(spark):
    yes = lambda messages: [json.dumps({"results": [{"index": 1, "verifiable": "yes", "needs_check": False}]}) for _ in messages]
    got = {r["claim_id"]: r["verifiable"] for r in model.classify(claims(spark), yes).collect()}
    assert got == {1: None, 2: None, 3: True, 4: None, 5: None, 6: None}
    assert {r["claim_id"] for r in model.prefilter(claims(spark), yes).collect()} == {2, 3, 4, 5, 6}
    assert model.prefilter(claims(spark), lambda messages: [None for _ in messages]).count() == 6


def test_settings_and_client(spark):
    """The client against a server of the common protocol; no key, no client; a failed call is None."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            bad = body["messages"][1]["content"] == "bad"
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"results": []}'}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    settings = model.Settings.of({"DEEPSEEK_API_KEY": "k", "FACTCHECK_LLM_MODEL": "m"}, base_url=f"http://127.0.0.1:{server.server_port}/", timeout=5.0)
    assert model.chat_client(settings, model.CLASSIFY, 100)(["good", "bad"]) == ['{"results": []}', None]
    path, key, body = seen[0]
    assert (path, key, body["model"], body["max_tokens"], body["messages"][0]["content"]) == ("/chat/completions", "Bearer k", "m", 100, model.CLASSIFY)
    server.shutdown()
    assert model.chat_client(model.Settings.of({}), model.SINGLE) is None
    assert model.Settings.of({"FACTCHECK_LLM_API_KEY": "a", "DEEPSEEK_API_KEY": "b"}).key == "a"


def test_extraction_by_a_model(spark):
    texts = spark.createDataFrame([(1, "学校获批国家项目3项。"), (2, "失败的文本")], "doc_id int, text string")
    client = lambda messages: [None if "失败" in m else json.dumps({"claims": [{"表述内容": "学校获批国家项目3项", "类型": "定量"}]}, ensure_ascii=False) for m in messages]
    assert [(r["doc_id"], r["claim_text"], r["numbers"]) for r in model.extract(texts, "doc_id", client).collect()] == [(1, "学校获批国家项目3项", ["3项"])]


def test_repaired_json(spark):
    good = json.dumps({"results": [{"index": 1, "verdict": "confirmed"}]})
    texts = [good, f"```json\n{good}\n```", f"好：{good}。", '[{"index": 1, "verdict": "confirmed"}]', "nothing", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", adjudicate.repaired(F.col("t")).alias("r")).orderBy("k").collect()
    assert [bool(r["r"]) and r["r"][0]["verdict"] == "confirmed" for r in rows] == [True] * 4 + [False] * 3


def test_model_claims(spark):
    answer = json.dumps({"claims": [{"text": " 获批国家项目3项 ", "entities": [" 甲 ", ""]}, {"text": "短"}, {"text": "获批国家项目3项", "kind": "x"}]}, ensure_ascii=False)
    rows = [(1, 0, f"```json\n{answer}\n```"), (2, 0, answer), (2, 1, None), (3, 0, '[{"表述内容": "没有数字的一条声明", "类型": "定性"}]'), (4, 0, "no json")]
    got = adjudicate.model_claims(spark.createDataFrame(rows, "doc_id int, part_no int, answer string"), "doc_id").collect()
    assert {(r["doc_id"], r["claim_text"], r["kind"], tuple(r["numbers"]), tuple(r["entities"])) for r in got} == {(1, "获批国家项目3项", "定量", ("3项",), ("甲",)), (3, "没有数字的一条声明", "定性", (), ())}


def test_report(spark):
    df = claims(spark)
    rows = [(r["section"], r["item_no"], r["claim_id"]) for r in report.sectioned(df).orderBy("section_no", "item_no").collect()]
    assert rows == [("not_found", 1, 3), ("flagged", 1, 2), ("flagged", 2, 4), ("flagged", 3, 5), ("confirmed", 1, 1), ("confirmed", 2, 2)]
    lines = [r["line"] for r in report.markdown_lines(df).orderBy("section_no", "item_no", "line_no").collect()]
    assert "| 1 | 甲｜一 | s |" in lines and "| 2 | 乙 | s ⚠ |" in lines and "| 1 |  | 丙 | — | — |" in lines
    assert lines[1] == "生成时间：  共 6 条" and "<details><summary>展开查看</summary>" in lines and lines[-1] == "</details>" and not any(x.startswith("> ") for x in lines)
    labelled = df.withColumn("verifiable", F.when(F.col("claim_id") == 3, True))
    lines = [r["line"] for r in report.markdown_lines(labelled, date="2026-01-02", n_references=4).orderBy("section_no", "item_no", "line_no").collect()]
    assert lines[1] == "生成时间：2026-01-02  参考文档：4 份  共 6 条" and "| 1 | 🔍 可核实 | 丙 | — | — |" in lines
    assert "> 可核实（建议优先核查）：1 条　　不可核实（修辞、标题、原则）：0 条　　未标注：0 条" in lines
    assert "| 警告 | KEYWORD_SHORT; NUMBER_MISSING |" in lines and report.console_summary(df).startswith("claims: 6\n✓: 2\n✗: 1\n")
    assert any(x.startswith("| 原文片段 | `乙") and x.endswith("…` |") for x in lines) and "✗ 未找到：1　　⚠ 反向验证重点关注：1　　△ 需关注：2　　✓ 已确认：2" in lines
    advice = report.sheets(df)["warned"].first()["advice"]
    assert advice.startswith("①") and "③" in advice
    assert {k: v.count() for k, v in report.sheets(df).items()} == {"all": 6, "confirmed": 2, "pending": 3, "warned": 1, "coverage": 1}


def test_evaluation(spark):
    long = "这是一条足够长的声明文本用于前缀匹配的测试"
    gold = spark.createDataFrame([(1, "甲|一", L.CONFIRMED, None, "精确型", "a"), (2, long + "末尾不同", L.NOT_FOUND, ("x/源文档.txt", "片段"), "近义型", "a"), (3, "短", L.REVIEW, None, "精确型", "b")], "item_id int, claim_text string, expected_status string, expected_source struct<source_path:string,snippet:string>, miss_type string, test_set string")
    results = spark.createDataFrame([(7, "甲|一", L.CONFIRMED, "s", "p"), (5, "开头 " + long + "别的", L.CONFIRMED, "源文档", "p"), (6, "开头" + long, None, None, None)], "claim_id bigint, claim_text string, status string, source string, snippet string")
    assert {(r["item_id"], r["claim_id"], r["overlap"]) for r in evaluate.match_gold(gold, results).collect()} == {(1, 7, 3), (2, 5, len(long))}
    scored = evaluate.score_gold(gold, results)
    assert {(r["item_id"], r["expected"], r["predicted"], r["hit_1"], r["hit_5"]) for r in scored.collect()} == {(1, "confirmed", "confirmed", True, True), (2, "not_found", "confirmed", False, True), (3, "partial", "not_found", False, False)}
    assert {r["miss_type"]: r["recall_1"] for r in evaluate.recall(scored, "miss_type").collect()} == {"精确型": 0.5, "近义型": 0.0}
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "yes"), (2, "no")], [(2, "yes"), (3, "no")]))
    assert {tuple(r) for r in evaluate.compare_runs(a, b, "k", "v").collect()} == {("yes", "?", 1), ("no", "yes", 1), ("?", "no", 1)}


def docx(path, *lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    docx(tmp_path / "报告.docx", "第一段", "第二段")
    docx(tmp_path / "a" / "报告.docx", "另一份")
    (tmp_path / "坏.docx").write_bytes(b"no zip")
    (tmp_path / "a" / "文.txt").write_text("一行\n两行", encoding="utf-8")
    folder = str(tmp_path)
    (tmp_path / "旧.doc").write_bytes("旧文".encode())
    (tmp_path / "a" / "乱.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "报告.txt").write_text("同一份的文本", encoding="utf-8")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.docx_files(spark, folder).collect()}
    assert set(rows) == {"报告.docx", "坏.docx", "旧.doc"}  # those below only where the folder itself has none
    assert rows["旧.doc"]["error"].endswith("no converter for .doc") and rows["坏.docx"]["error"].startswith("BadZipFile")
    assert {r["path"].rsplit("/", 1)[1] for r in files.docx_files(spark, str(tmp_path / "a")).collect()} == {"报告.docx"}
    converted = files.docx_files(spark, folder, doc=files.command_converter("cat"))
    assert {r["text"] for r in converted.filter("endswith(path, '.doc')").collect()} == {"旧文"}
    done = spark.createDataFrame([(r["path"], "先前的文本", None) for k, r in rows.items() if k == "报告.docx"], "path string, text string, error string")
    assert {r["text"] for r in files.docx_files(spark, folder, done).filter("error is null").collect()} == {"先前的文本"}
    assert [r["path"].rsplit("/", 1)[1] for r in files.set_aside(files.text_files(spark, folder)).collect()] == ["乱.txt"]
    texts = {r["source"]: r["text"] for r in files.reference_texts(spark, folder).collect()}
    assert texts == {"文": "一行\n两行", "报告": "第一段\n\n第二段\n"}
    assert files.words_in(spark, None, folder).count() == 0
    assert files.word_rows({"s": {"t": ["项目", "一", " 平台 "]}, "flat": ["计划"], "none": None}) == [("s", "t", "项目"), ("s", "t", "平台"), ("flat", None, "计划")]


def test_annotations_and_sinks(spark, tmp_path):
    good = {"声明文本": "x", "期望状态": "y", "漏检类型": "z", "期望出处": None}
    lines = ["", "# note", "{broken", json.dumps({"声明文本": "x"}), json.dumps(good), " " + json.dumps(good | {"期望出处": {"sourcePath": "p", "片段": "f"}})]
    (tmp_path / "g.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = files.read_annotations(spark, str(tmp_path / "g.jsonl")).collect()
    assert [r["expected_source"] and r["expected_source"]["snippet"] for r in rows] == [None, "f"]
    df = claims(spark)
    files.write_checks(df, str(tmp_path / "out"))
    again = files.read_checks(spark, str(tmp_path / "out"), CLAIM)
    assert again.count() == 6 and again.orderBy("claim_id").first()["claim_text"] == "甲|一"
    files.write_markdown(report.markdown_lines(df), str(tmp_path / "md"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "md").rglob("*.txt"))
    assert text.startswith("# 核对清单 — p\n生成时间：") and text.index("## ✗") < text.index("## ⚠") < text.index("## ✓")


def test_following(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    terms = spark.createDataFrame([("甲乙",), ("丙",)], "term string")
    for k, text in enumerate(["甲乙甲乙", "丙丁"]):
        spark.createDataFrame([(k, "p", "p", text)], "chunk_id bigint, source_path string, source string, text string").write.mode("append").parquet(source)
        follow_chunks(spark, source, terms, target, state).awaitTermination()
    got = {(r["term"], r["chunk_id"], r["n_found"], r["batch"]) for r in spark.read.parquet(target).collect()}
    assert got == {("甲乙", 0, 2, 0), ("丙", 1, 1, 1)}


def test_whole_check(spark, tmp_path):
    """From a folder to reports, again from the written claims, and evaluated."""
    from veritrail.plans import pipeline

    refs, out = tmp_path / "refs", str(tmp_path / "out")
    refs.mkdir()
    docx(refs / "年报.docx", "学校获批国家项目356项，经费充足，金融大模型实验室入选国家重大项目名单。")
    (refs / "说明.txt").write_text("人工智能重点实验室建设情况的说明文字，另有别的内容。" * 30, encoding="utf-8")
    (refs / "坏.docx").write_bytes(b"no zip")
    (refs / "entity_config.yaml").write_text("行业:\n  - 课程\n", encoding="utf-8")
    target = tmp_path / "讲话.txt"
    target.write_text("学校获批国家项目356项，经费充足。\n完全不存在的表述内容在此处出现一次。\n金融大模型实验室入选国家重大项目名单。", encoding="utf-8")
    judge = lambda messages: [json.dumps({"results": [{"index": 1, "verdict": "not_found", "verifiable": "no"}]}) for _ in messages]
    options = pipeline.Options(date="2026-01-02", conflicts=True)
    for _ in range(2):  # the second time documents converted before aren't converted again
        summary = pipeline.check_folder(spark, str(target), str(refs), out, options, workbook=str(tmp_path / "w.xlsx"), judge=judge, classifier=judge)
        assert summary.startswith("claims: 3\n✓: 2\n✗: 1")
    rows = {r["pos"]: r for r in files.read_checks(spark, out, pipeline.CHECKED).collect()}
    assert rows[0]["source"] == "年报" and "获批国家项目356项" in rows[0]["snippet"] and rows[0]["candidates"][0]["source"] == "年报"
    assert [r["verifiable"] for r in rows.values() if r["status"] == L.NOT_FOUND] == [False]
    aside = spark.read.json(f"{out}/set_aside").collect()
    assert len(aside) == 1 and "BadZipFile" in aside[0]["error"]
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out" / "report").rglob("*.txt"))
    assert "生成时间：2026-01-02  参考文档：2 份  共 3 条" in text and "不可核实（修辞、标题、原则）：1 条" in text
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        assert [n in book for n in ("全部表述", "已确认", "待确认", "反向验证", "实体覆盖")] == [True] * 5
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row>") == 4
        from xml.etree import ElementTree

        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
    assert pipeline.regenerate(spark, out, options).startswith("claims: 3")
    gold = [{"声明文本": "学校获批国家项目356项，经费充足", "期望状态": "✓ 已确认", "漏检类型": "精确型", "测试集": "a"}, {"声明文本": "没有这一条", "期望状态": "✓ 已确认", "漏检类型": "精确型", "测试集": "b"}]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(g, ensure_ascii=False) for g in gold), encoding="utf-8")
    result = pipeline.evaluate_run(spark, str(tmp_path / "g.jsonl"), out, run=lambda: None)
    assert result["recall"].first()["recall_1"] == 0.5 and result["seconds_a_target"] >= 0
    assert [r["claim_text"] for r in result["unmatched"].collect()] == ["没有这一条"]
    assert pipeline.evaluate_run(spark, str(tmp_path / "g.jsonl"), out, test_set="a")["recall"].first()["recall_1"] == 1.0
