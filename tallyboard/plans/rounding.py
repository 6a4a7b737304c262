"""Double columns of the queries.

They are rounded on both sides, so that the order of a sum does not show.
"""

PLACES = 9
DOUBLES = {
    "f09_rate_deltas": "value prior_value shown_delta",
    "e01_draw_rate": "draw_rate",
    "e02_usage_share": "value",
    "e02_usage_share_grouped": "value",
    "e03_player_score": "score_rate win_rate",
    "e05_metric_set_games": "draw_rate",
    "e05_metric_set_players": "opening_score_rate opening_win_rate",
    "e06_mean_clamped_loss": "mean_loss",
    "e07_clock_pressure": "error_proxy_rate evaluation_coverage",
    "e08_clock_strata": "error_proxy_rate evaluation_coverage",
    "e10_compare_two_families": "score_rate_a score_rate_b score_rate_difference win_rate_a win_rate_b win_rate_difference",
    "e10_compare_two_buckets": "coverage_a coverage_b coverage_difference error_proxy_rate_a error_proxy_rate_b error_rate_difference",
    "e25_rollup_strata": "error_proxy_rate evaluation_coverage",
    "e13_game_cells": "mean_ply",
    "e14_result_cells": "mean_ply rating_diff",
    "e14_result_lines": "mean_ply rating_diff",
    "e15_clock_cells": "error_proxy_rate",
    "c08_suppress_small": "share",
    "e16_source_game_cells": "mean_ply",
    "e16_source_result_cells": "mean_ply rating_diff",
    "a07_write_cube": "error_proxy_rate mean_ply rating_diff",
    "e26_kpis": "denominator numerator value",
    "e17_coverage_curve": "share",
    "e19_position_details": "alternative_route_share frequency",
    "e20_family_inventory": "share",
    "e21_endpoint_compression": "endpoint_compression",
    "e22_continuations": "share_of_position_games",
    "e41_import_positions": "alternative_route_share frequency",
    "e41_import_coverage": "share",
    "e41_import_totals": "coverage_share",
    "e11_standardized_rate": "adjusted_score_rate",
    "e12_cluster_bootstrap": "lower point upper",
    "e12_case_bootstrap_poisson": "lower point upper",
    "e12_adjusted_rates": "lower point upper",
    "e12_ranked_intervals": "lower point upper",
    "e27_confusion": "row_share",
    "e27_accuracy": "accuracy recall",
    "e27_status_matrix": "row_share",
    "e28_selective_curve": "coverage error_rate",
    "e30_brier": "brier",
    "e30_brier_multiclass": "brier",
    "e31_reliability": "mean_observed mean_predicted",
    "e31_reliability_merged": "mean_observed mean_predicted",
    "e32_ranked_prediction_scores": "log_loss top1 top3 zero_share",
    "e32_ranked_by_ply": "log_loss top1 top3 zero_share",
    "e51_cascade_policy": "cost_per_correct total_cost",
    "e51_cascade_policy_boundary": "cost_per_correct total_cost",
    "e33_wilson_interval": "lower upper",
    "e34_binomial_alert": "baseline_rate",
    "e35_paired_sign_test": "p_value",
    "e37_run_summary": "cost cost_per_pass median_seconds pass_rate",
    "e37_cost_ledger": "known_cost unsettled_reservation",
    "e39_pareto_frontier": "cost rate",
    "e45_timing_summary": "maximum median minimum spread",
    "e46_attempt_ledger": "bytes_per_second",
    "i12_within_tolerance": "actual expected",
    "i13_rederive_totals": "derived stored",
    "a07_opening_family": "share",
    "a07_opening_line": "share",
    "a07_opening_continuation": "share",
    "a07_transposition_route": "share",
    "a07_color_score": "share",
    "a07_result_line": "mean_ply rating_diff",
    "a07_source_game_cell": "mean_ply",
    "a07_source_result_cell": "mean_ply rating_diff",
    "a10_receipt_attempts": "gross_cost_usd",
    "a11_report_compression": "endpoint_compression",
    "a11_report_coverage": "share",
    "e05_joined_metrics": "draw_rate rows_a_game score_rate",
    "a10_read_run_receipts": "gross_cost_usd",
    "j04_evaluate_calibration": "brier mean_observed mean_predicted",
}
