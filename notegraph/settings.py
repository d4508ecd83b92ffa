"""Settings of the engine, and values fixed by the data format."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# ---- Fixed values: word lists, keyword lists and patterns of the note format.

STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 所 为 所以 因为 "
    "但是 如果 虽然 可以 这个 那个 什么 怎么 哪 吗 啊 呢 吧 哦 嗯 哈 嘿嘿 the a an is are was were be been being have has had having do "
    "does did doing will would shall should may might must can could to of in for on with at by from as into through during before "
    "after above below between under again further then once here there when where why how all both each few more most other some "
    "such no nor not only own same so than too very just about up out over now and that but or which who whom this it its"
).split()

COMMON_QUERY_WORDS = (
    "ai 视频 工具 产品 对比 分析 方案 报告 系统 平台 模型 数据 方法 技术 设计 架构 框架 开发 测试 部署 优化 管理 配置 监控 "
    "服务 应用 项目 文档 指南 手册 参考 示例 投资 机会 市场 策略 趋势 指标 风险 收益"
).split()

FILLER_CHARS = "怎么如何啥为什么可以应该需要使用进行配合搭配结合和与或的了吗呢"

NAME_SUFFIXES = ".md 架构 分析 设计 方案 手册 报告 指南 矩阵 系统 框架 编辑器 工具 计划 对比 索引 模板".split()

SOURCE_WEIGHTS = {"graph": 1.0, "lines": 0.85, "skills": 0.7, "visual": 0.6}

# ---- End of fixed values.

GRAPH_SOURCE, LINE_SOURCE, SKILL_SOURCE, VISUAL_SOURCE = SOURCE_WEIGHTS
OTHER_SOURCE_WEIGHT = 0.5
TOKEN_PATTERN = "[一-鿿]{2,}|[a-zA-Z]{3,}"
DAY = 86400.0


@dataclass(frozen=True)
class Settings:
    """Thresholds and caps; ``now`` is given, so results do not depend on the clock."""

    now: float = 1706745600.0  # 2024-02-01 00:00:00 UTC
    lambdas: dict = field(default_factory=lambda: {"ephemeral": math.log(2) / DAY, "default": math.log(2) / (30 * DAY), "decree": 0.0})
    dead_below: float = 0.05
    prerequisite_default: float = 0.5
    similarity_default: float = 0.35
    prerequisite_cap: int = 10
    similarity_cap: int = 5
    same_dir_overlap: int = 3
    same_dir_jaccard: float = 0.35
    tag_jaccard: float = 0.4
    tag_jaccard_low: float = 0.25
    tag_overlap: int = 5
    dated_years: tuple = ("2025", "2026")
    min_weight: float = 0.05
    max_weight: float = 2.0
    consumed_delta: float = 0.05
    ignored_delta: float = 0.02
    cold_factor: float = 0.95
    cold_days: int = 30
    judge_similarity: float = 0.15
    judge_keyword_relief: float = 0.05
    judge_jaccard: float = 0.35
    anchors: int = 5
    max_depth: int = 3


DEFAULT = Settings()
