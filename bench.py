"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidegauge.registry import REGISTRY
from tidegauge.session import build_session

HEADLINE = (
    "pf2_stock_windows",
    "pf4_breadth_ratios",
    "pf7_yesterday_limitup",
    "pf11_turnover_zscore",
    "pf16_wilder_rsi",
    "dq4_expected_universe",
    "dq5_market_coverage_daily",
    "sc9_stretch_score",
    "sc10_market_temperature",
    "rg2_causal_ema",
    "rg8_state_machine",
    "rg18_sensitivity_grid",
    "ad9_explanation_text",
    "ev4_forward_outcomes",
    "ev14_study_table",
    "ev18_parameter_robustness",
    "sv5_episode_cards",
    "in16_parse_kline_csv",
    "in17_parse_quote_text",
    "st1_latest_quotes",
    "st7_streaming_state_machine",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    REGISTRY["pf1_prepare_stock_panel"].build(spark, sf_dir).limit(1).count()  # start executors and Python workers
    REGISTRY["rg8_state_machine"].build(spark, sf_dir).limit(1).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
