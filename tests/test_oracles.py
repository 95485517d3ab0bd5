"""Queries against their independent SQL twins (python tests/check.py runs them all)."""

import pytest

from compare import compare, connect
from tidemark.plans import registry

registry.load_all()

# a quick cross-section of every group; tests/check.py covers the whole registry
QUICK = """clip_window shift_months window_spec window_membership strided_sample is_fresh simple_returns log_returns forward_log_return mean_returns sharpe
var_historical expected_shortfall max_drawdown skew_kurt price_features moving_average ma_crossover_age rsi_wilder trin_breadth running_total streak weighted_mix
asof_ffill_join self_join_opponent anti_applied cross_probe ticker_lookup fit_scl rolling_beta fit_multifactor event_features capital_allocation two_asset_mix markowitz
norm_postings html_to_text parse_relative_date rows_upsert lexicon_score sentiment_summary burst_ratio url_dedup tokenize_stem split_claims claim_support find_skills
brief_clamp minimal_panel compute_target no_future_rows walk_forward regression_metrics information_coef hit_rate_top split_grouped split_leak_check
classification_metrics compare_models classify_remote location_bucket ingest_gate dedup_key merge_sources rescore feed_query heatmap dow_counts source_health
status_machine transition_counts item_snapshot participant_rows build_vocab recommend_items median_impute describe threshold_sweep undersample knn_regress""".split()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, con, name):
    ok, _took, note = compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], sf, con)
    assert ok, note


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(QUICK) <= set(registry.ORACLES)
