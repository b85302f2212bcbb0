"""Vocabulary and text of the advisory layer, one row per market state."""

from __future__ import annotations

# Published advisory vocabulary and wording. {raw}, {smooth} and {changed} are filled in per day.
FIELDS = (
    "state", "advisory_signal", "advisory_regime", "risk_level", "expected_horizon", "reference_horizon",
    "research_evidence", "short_term_evidence", "medium_term_evidence",
    "headline", "meaning", "summary", "why_template", "what_to_watch_next",
)
STATE_TEXT = (
    (
        "DATA_INVALID", "DATA_INVALID", "NORMAL", "HIGH", "NOT_APPLICABLE", "N/A", "UNPROVEN", "UNPROVEN", "UNPROVEN",
        "当前市场数据无效：暂不提供市场环境参考。",
        "当日缺少可用的 MarketTemperature 或质量门禁未通过。",
        "DATA_INVALID：等待下一有效交易日，不使用无效日作判断。",
        "当日缺少可用的 MarketTemperature 或质量门禁未通过，因此 Advisory Signal = DATA_INVALID，不生成正常市场建议。",
        "等待下一有效交易日数据；在数据恢复前不使用市场环境参考。",
    ),
    (
        "EXTREME_PANIC", "BUY_WATCH", "PANIC", "EXTREME", "SHORT_TERM_UNCERTAINTY", "N/A", "UNPROVEN", "UNPROVEN", "UNPROVEN",
        "市场开始出现冰点关注迹象：值得观察，但反转尚未确认。",
        "市场已经非常冷，开始进入值得研究的区域；仍需等待恐慌结束和内部修复。",
        "BUY_WATCH：可以提高关注度，但不是必须立即买入的信号。",
        "市场温度已经非常低（Raw {raw} / Smoothed {smooth}），但 State Machine 尚未确认恐慌结束，因此只能进入 BUY_WATCH。",
        "观察恐慌是否停止扩散，以及内部修复是否继续扩散。",
    ),
    (
        "PANIC_FALLING", "PANIC_WAIT", "PANIC", "HIGH", "SHORT_TERM_UNCERTAINTY", "N/A", "UNPROVEN", "UNPROVEN", "UNPROVEN",
        "市场处于恐慌下跌阶段：已经很冷，但情绪仍在恶化。",
        "市场已经明显降温，但情绪仍在恶化。当前是潜在机会观察区，不是精确底部确认。",
        "PANIC_WAIT：继续等待市场内部修复，不因跌幅很大而机械抄底。",
        "Raw Temperature 已进入极低区域（{raw}），Breadth 与 Profit Effect 仍在恶化，{changed}；EMA / Slope 尚未出现足够修复，因此低温暂时不能视为买入参考。",
        "观察 Slope3 是否转正，以及 Breadth、Profit Effect 和 EMA 是否开始同步修复。",
    ),
    (
        "ICE_REVERSAL_WATCH", "BUY_WATCH", "RECOVERY", "ELEVATED", "MEDIUM_TERM", "20–60 trading observations", "WEAK", "WEAK", "MODERATE",
        "市场开始出现冰点修复迹象：可以开始关注，但反转尚未确认。",
        "市场曾经历明显恐慌，温度、斜率和部分内部结构出现修复迹象。",
        "BUY_WATCH：准备买的阶段，不是必须马上买的信号。",
        "此前已经形成 panic episode；当前温度、Slope 和内部模块出现修复迹象（{changed}），但 State Machine 仍处于观察阶段，因此是 BUY_WATCH。",
        "观察内部修复是否继续扩散，以及 State Machine 是否升级为 ICE_REVERSAL_CONFIRMED。",
    ),
    (
        "ICE_REVERSAL", "BUY_REFERENCE", "RECOVERY", "ELEVATED", "MEDIUM_TERM", "20–60 trading observations", "MODERATE", "WEAK", "MODERATE",
        "市场经历明显恐慌后，中期修复已经确认。",
        "中期修复已经确认，更适合作为市场环境改善参考，而不是精确底部或短线买点。 短期仍可能继续震荡甚至回撤，短期跟随并不保证。",
        "BUY_REFERENCE：可开始研究或关注目标股票，但不能仅凭该指标作出买入决定。",
        "此前已经形成 panic episode，Breadth、Profit Effect 与 EMA 出现修复，State Machine 已确认 ICE_REVERSAL，因此升级为 BUY_REFERENCE；这不是精确底部，也不保证未来 1–5 个交易日上涨。",
        "短期仍可能震荡或继续回撤；关注修复是否保持，以及是否重新跌回 PANIC_FALLING。",
    ),
    (
        "COLD", "NEUTRAL", "PANIC", "ELEVATED", "NOT_APPLICABLE", "N/A", "UNPROVEN", "UNPROVEN", "UNPROVEN",
        "市场偏冷但暂无反转确认：保持观察，不把低温直接当作买点。",
        "市场温度偏低，但当前没有足够的转向证据。",
        "NEUTRAL：低温不等于 BUY，继续观察内部修复。",
        "Smoothed Temperature 偏低（{smooth}），但尚未出现足够一致的修复确认，因此保持 NEUTRAL；COLD 不等于 BUY。",
        "市场是否从低温区出现持续修复；不要仅因温度偏低就当作买入信号。",
    ),
    (
        "NORMAL", "NEUTRAL", "NORMAL", "NORMAL", "NOT_APPLICABLE", "N/A", "UNPROVEN", "UNPROVEN", "UNPROVEN",
        "当前市场情绪处于正常区间，暂无明显极端买卖参考信号。",
        "当前没有明显市场情绪极端，不应主要依靠市场情绪决定买卖，更应该回到个股基本面、估值和趋势。",
        "NEUTRAL：市场情绪没有给出明确的环境参考。",
        "当前没有明显市场情绪极端，温度和内部模块没有形成需要升级的环境信号，因此保持 NEUTRAL。",
        "观察温度、Breadth、Profit Effect 和 EMA 斜率是否形成新的极端或转向。",
    ),
    (
        "HOT", "HOT_CAUTION", "EUPHORIA", "ELEVATED", "NOT_APPLICABLE", "N/A", "WEAK", "WEAK", "WEAK_TO_MODERATE",
        "市场处于偏热环境，但尚未确认高温退潮。",
        "市场偏热，但还没有明确的退潮确认；高温本身不构成卖出参考。",
        "HOT_CAUTION：提高风险意识，避免因情绪高涨而盲目追高。",
        "市场温度仍处于偏热区域（Raw {raw} / Smoothed {smooth}）。{changed}，但尚未形成足够一致的退潮信号，因此目前仍为 HOT_CAUTION，而不是 SELL_WATCH；高温本身不是卖出确认。",
        "观察 Smoothed Temperature 是否继续下降，以及 Breadth、Profit Effect、Liquidity、Stretch 是否开始同步恶化；若高温 episode 持续退潮，可能升级为 SELL_WATCH。",
    ),
    (
        "EUPHORIA_RISING", "HOT_CAUTION", "EUPHORIA", "HIGH", "NOT_APPLICABLE", "N/A", "WEAK", "WEAK", "WEAK_TO_MODERATE",
        "市场处于偏热或高温阶段：避免追高，但高温本身不是卖出确认。",
        "市场已经进入明显高温区且情绪仍在升温，当前最大风险是追高，而不是预测马上见顶。",
        "HOT_CAUTION：已有盈利仓位提高警惕，但不把高温本身视为卖出确认。",
        "市场已进入明显高温区（Raw {raw} / Smoothed {smooth}）且仍在升温，{changed}；当前最大风险是追高，而不是预测马上见顶，因此保持 HOT_CAUTION。",
        "观察 Smoothed Temperature 是否停止上升，以及 Breadth、Profit Effect、Liquidity、Stretch 是否开始同步恶化。",
    ),
    (
        "HOT_ROLLOVER_WATCH", "SELL_WATCH", "RISK_OFF", "HIGH", "MEDIUM_TERM_RISK", "40–60 trading observations", "WEAK_TO_MODERATE", "WEAK", "WEAK_TO_MODERATE",
        "此前高温环境开始出现退潮迹象，值得提高警惕。",
        "市场此前处于高温/亢奋阶段，部分内部指标已经开始恶化，但退潮尚未完全确认。",
        "SELL_WATCH：新开仓更严格，已有盈利仓位开始重新检查。",
        "此前存在明显高温，当前部分内部指标开始恶化（{changed}），但退潮尚未完成确认，因此是 SELL_WATCH。",
        "观察内部恶化是否继续并升级为 HOT_ROLLOVER_CONFIRMED；如果高温重新升温，则 SELL_WATCH 应取消。",
    ),
    (
        "HOT_ROLLOVER", "SELL_REFERENCE", "RISK_OFF", "HIGH", "MEDIUM_TERM_RISK", "40–60 trading observations", "WEAK_TO_MODERATE", "WEAK", "WEAK_TO_MODERATE",
        "高温退潮已经确认，未来数周市场风险值得明显提高警惕。",
        "高温风险环境已经确认。这是中期风险收益比恶化的参考，不是预测明天立即下跌或精确顶部。 该信号不是精确顶部确认。",
        "SELL_REFERENCE：减少追高、提高止盈意识并重新检查高估值高涨幅标的。",
        "此前高温 episode 已出现持续退潮，Breadth、Profit Effect 与 EMA 方向支持风险恶化，State Machine 已确认 HOT_ROLLOVER，因此为 SELL_REFERENCE；这是中期风险参考，不是精确顶部或强制卖出指令。",
        "关注退潮是否继续扩大；该状态用于中期风险管理参考，不意味着下一交易日必须卖出。",
    ),
)
MODULE_LABELS = (("breadth", "Breadth"), ("profit_effect", "Profit Effect"), ("liquidity", "Liquidity"), ("stretch", "Stretch"))
IMPROVING, WEAKENING, JOIN, FRAGMENT_JOIN = "改善：", "走弱：", "、", "；"
SLOPE_UP, SLOPE_DOWN, SLOPE_FLAT = "EMA 斜率 转正/上行", "EMA 斜率 转负/下行", "EMA 斜率 接近持平"
NO_DIRECTION = "内部模块方向暂不明显。"
CURRENT_TEMPLATE = "MarketTemperature {raw}，SmoothedTemperature {smooth}。"
DISCLAIMER = "这是市场环境参考，不是自动交易指令。"
KNOWN_WARNINGS = (
    "SURVIVORSHIP_BIAS_WARNING", "OPTIONS_UNAVAILABLE", "MARGIN_OPTIONAL", "FAILED_LIMIT_RATE_UNAVAILABLE", "HISTORICAL_DELIST_DATE_INCOMPLETE",
    "LIMIT_STATUS_APPROXIMATE_BAOSTOCK_BOARD_BANDS", "PARTIAL_LIMIT_DATA", "LOW_UNIVERSE_COVERAGE_WARNING", "STALE_OPTIONAL_SERIES", "MISSING_OPTIONAL_FIELD",
)
ADVISORY_SIGNALS = ("PANIC_WAIT", "BUY_WATCH", "BUY_REFERENCE", "NEUTRAL", "HOT_CAUTION", "SELL_WATCH", "SELL_REFERENCE", "DATA_INVALID")
