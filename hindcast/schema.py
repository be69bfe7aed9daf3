"""The feature dictionary and the request limits, defined once."""

from __future__ import annotations

# Feature groups with their weights, horizons, request limits.
GROUPS = {
    "name": (0.30, ["ret5", "ret20", "ret60", "dist52", "vol20", "vol_ratio", "dd60", "rel_bench20", "gap20", "dv20z"]),
    "market": (0.20, ["mkt_ret20", "mkt_vol20", "mkt_dist52", "vix", "vix_chg5", "growth_rel20"]),
    "macro": (0.20, ["slope", "d_rate90", "bei_chg20", "usd_chg20", "oil_chg20", "hy_chg20"]),
    "crypto": (0.10, ["btc_ret5", "btc_ret20", "fng"]),
    "event": (0.20, ["dte", "event_load5", "is_fomc_day"]),
}
EXCLUDED = ("dv20z", "fng", "hy_chg20")
HORIZONS = (1, 5, 10, 20, 40, 60)
DEFAULT_HORIZON, DEFAULT_K, LEAST_K, MOST_K = 5, 50, 10, 200
MIN_HISTORY, MIN_COVERAGE, Z_CLIP = 60, 0.6, 3.0
MAX_PER_DATE, MIN_GAP, POOL_MULTIPLE, LEAST_POOL = 2, 10, 80, 2000

FEATURES = [f for _, names in GROUPS.values() for f in names]
METRIC = [f for f in FEATURES if f not in EXCLUDED]


def distance_weights(group_weights: dict[str, float] | None = None, exclude: tuple[str, ...] = EXCLUDED) -> dict[str, float]:
    """Weight of each usable feature: its group's share spread evenly, and all of them scaled to 1."""
    share = {}
    for group, (weight, names) in GROUPS.items():
        usable = [f for f in names if f not in exclude]
        share |= {f: (group_weights or {}).get(group, weight) / len(usable) for f in usable}  # a group without any gives its share to the others
    total = sum(share.values())
    return {f: w / total for f, w in share.items()}
