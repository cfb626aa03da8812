"""Word lists, patterns and thresholds on which results depend."""

from __future__ import annotations

# Statuses of a claim.
CONFIRMED, REVIEW, PARTIAL, INCONSISTENT, NOT_FOUND = "✓ 已确认", "△ 需核实", "△ 部分匹配", "△ 数据不一致", "✗ 未找到"

# What may follow a number.
UNITS = (
    "[万亿]?[个项篇章人次所支部门家国种届轮次场类]",
    "[万亿]?%",
    "[万亿]?元",
    "[万亿]?倍",
    "[万亿]?(?:平方米|平米|m²)",
    "[年月日]",
)

# Suffixes of category names that hold in any field.
CATEGORY_WORDS = (
    "任务", "试点", "改革", "项目", "工程", "计划", "行动", "方案", "专项", "示范", "建设", "试点单位",
    "机构", "中心", "平台", "基地", "联盟", "委员会", "办公室", "部门", "学院", "医院", "学校", "大学", "研究院", "研究所", "实验室",
    "体系", "模式", "机制", "制度", "框架", "范式", "格局", "生态",
    "规划", "报告", "标准", "规范", "文件", "办法", "规定",
    "团队", "小组", "队伍",
    "系统", "网络", "设施", "设备", "模型", "工具",
    "论坛", "会议", "大赛", "活动", "峰会", "展览", "培训",
)

# Verbs of achievement. Four uses have four lists.
KEYWORD_VERBS = "入选 获批 荣获 获得 新增 组建 成立 牵头 实施 推进 完成 突破 增长 提升 达到 建成 上线 发布 通过 授牌 签约 设立 启用 开创".split()
CLAUSE_VERBS = "入选 获批 荣获 获得 新增 组建 成立 牵头 实施 推进 完成 突破 增长 提升 达到 建成 上线 发布 通过 授牌 签约 设立 启用 开创 实现".split()
ANCHOR_VERBS = "获批 入选 获评 承担 建立 成立 设立 推出 完成 实现 签署 出版 发布 获得 荣获 入围 评为 被授予 被遴选 牵头".split()
GATE_VERBS = "入选 获批 获评 荣获 获得 新增 组建 成立 牵头 实施 推进 完成 突破 增长 提升 达到 建成 上线 发布 通过 授牌 签约 设立 启用 开创 实现 累计 覆盖".split()
GROWTH_WORDS = "增长 增幅 提高 提升 同比 突破 跃升 攀升 翻番".split()

# What a string that is no entity contains or begins with.
PRONOUNS = "我们 他们 你们 我校 本校".split()
CONJUNCTIONS = "因此 所以 而且 并且 但是 然而 同时 此外 另外 不仅 其次 回顾 纵观 综上".split()
VERB_PREFIXES = "构建 探索 推动 推进 实施 建设 完善 深化 加强 建立 持续 全面 系统 完成 开创 优化 整合 强化 提升 发展 创新 落实 推行 健全 开展 形成 确保 聚焦 坚持 促进 统筹 围绕 为了 为各 为更".split()
PARTICLES = "等与个的既"
ORDINALS = "一二三四五六七八九十"
TITLE_MARKS = "《》〈〉「」【】『』"

# Thresholds.
CLAIM_OVER, CLAUSE_LEAST, SNIPPET_RADIUS, BRIEF = 10, 8, 80, 120
KEYWORD_LEAST, KEYWORD_MOST, RUNS_KEPT, KEYWORDS_KEPT, FALLBACK = 3, 40, 5, 8, 20
NEAR, GROWTH_RADIUS, SHORT_KEYWORD, GENERIC_OVER, DOMAIN_SHARE, LOW_COVERAGE = 300, 25, 3, 20, 0.6, 50
ATTRIBUTE_WINDOW, ATTRIBUTE_SIMILARITY = 20, 0.3
TOP_K, TERM_LIMIT, RRF_K, CLAIM_WEIGHT, PENALTY, CLAIM_HEAD = 5, 60, 60, 2.0, 0.4, 60
JUDGE_BATCH, CLASSIFY_BATCH = 6, 20
