"""Variants of climate queries over fixtures with missing months, so that their oracles see NULL."""

from __future__ import annotations

from glacierlens.plans import balance, climate, scenario  # noqa: F401  they register what is varied here
from glacierlens.plans.registry import with_gaps

GAPPED = (
    "A21_anomalies", "A22_glacier_quantiles", "A23_score_temperature", "A23b_score_precipitation", "A24_annual_scores", "A25_compound_scores",
    "A26_period_difference", "A38_annual_pdd", "A46_winter_prcp_factor", "A46b_winter_prcp_south", "A53_mass_balance_table", "A53b_ela_table",
    "C01_perturb", "C02_swap_decades", "C03_detrend_years", "C04_extend_baseline", "C05_extend_loop", "C06_replace_history", "C07_yearly_amplify", "C08_combine_hist_future",
    "M01_climate_on_height", "M01b_climate_local_gradient", "M02_yearly_climate", "M02b_yearly_climate_flat", "M03_glacier_climate", "M04_point_balance_monthly",
    "M04b_point_balance_annual", "M06_specific_mb", "M07_constant_climate", "M07b_mean_climate_balance", "M08_ela", "M08b_ela_of_flowlines", "M09_random_climate_balance", "M11_calibrate_mu", "M12_climate_qc", "T04_linear_trend", "T06_monthly_warming_trends",
    "W03_hampel", "W04_delta_method", "W05_splice", "W09_future_year_scores", "W10_reverse_rank", "W11_rank_scaling", "W17_mu_candidates", "W18_best_reference_year",
)

for _name in GAPPED:
    with_gaps(_name)
