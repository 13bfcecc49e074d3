"""Parameters of the operators, with the defaults users of such a memory expect.

The numbers are fixed values: results are only comparable if they agree.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

EPS = 1e-9


@dataclass(frozen=True)
class Config:
    # weights of a retrieval score
    alpha_sem: float = 0.60
    beta_trust: float = 0.25
    delta_react: float = 0.15
    kappa_coh: float = 0.30
    kappa_comp: float = 0.20
    kappa_drift: float = 0.25
    kappa_error: float = 0.25
    kappa_hist: float = 0.20
    kappa_project: float = 0.30
    prefilter_limit: int = 256
    result_limit: int = 128
    excluded_states: tuple[str, ...] = ("COLLAPSING", "SPLIT_PENDING")
    # factors by regime and by state, for each retrieval mode
    mode_regime: dict = field(default_factory=lambda: {
        "balanced": {"PRODUCTIVE": 1.05, "RIGID": 0.95, "UNSTABLE": 0.85},
        "factual": {"PRODUCTIVE": 1.10, "RIGID": 0.90, "UNSTABLE": 0.60},
        "exploratory": {"PRODUCTIVE": 1.00, "RIGID": 0.92, "UNSTABLE": 0.95},
    })
    mode_state: dict = field(default_factory=lambda: {
        "balanced": {"REACTIVATING": 1.03, "DORMANT": 0.92, "TENSIONED": 0.90, "FORMING": 0.90},
        "factual": {"STABLE": 1.05, "ACTIVE": 1.00, "REACTIVATING": 0.95, "DORMANT": 0.85, "TENSIONED": 0.75, "FORMING": 0.80},
        "exploratory": {"REACTIVATING": 1.08, "ACTIVE": 1.02, "DORMANT": 0.96, "TENSIONED": 0.95, "STABLE": 0.98},
    })
    # branch statistics
    loss_beta1: float = 0.5
    loss_beta2: float = 0.3
    summary_beta1: float = 0.6
    summary_beta2: float = 0.4
    rank_mid: float = 110.0
    # score of a split and of a merge
    zeta_incoherence: float = 0.15
    zeta_anisotropy: float = 0.20
    zeta_compression: float = 0.20
    zeta_error: float = 0.20
    zeta_drift: float = 0.25
    split_threshold: float = 0.075
    split_hysteresis: int = 3
    split_min_nodes: int = 6
    split_enqueues: int = 5
    merge_threshold: float = 0.55
    eta_cos: float = 0.15
    eta_topic: float = 0.20
    eta_couse: float = 0.15
    eta_topic_drift: float = 0.20
    eta_drift: float = 0.15
    # score of a new item against a branch
    gamma_mu: float = 0.15
    gamma_rank: float = 0.10
    gamma_anisotropy: float = 0.15
    gamma_trace: float = 0.10
    gamma_semantic: float = 0.15
    gamma_conflict: float = 0.20
    ema_rho: float = 0.05
    anchor_rho: float = 0.01
    attach_below: float = 0.50
    tension_below: float = 0.70
    refine_sim: float = 0.92
    contradict_conflict: float = 0.25
    supersede_sim: float = 0.78
    supersede_conflict: float = 0.70
    supersede_types: tuple[str, ...] = ("identity", "user_fact", "user_preference", "preference")
    # pairs of drifting topics
    drift_sample: int = 192
    drift_edges: int = 256
    drift_gap: int = 48
    drift_roles: tuple[str, ...] = ("assistant", "user")
    drift_min_tokens: int = 8
    drift_min_chars: int = 30
    drift_sim: float = 0.0
    # feedback
    feedback_lambda: float = 0.1
    couse_lookback: int = 5000
    # weights by branch type: {type or "default": {group: {name: weight}}}; what is not given is the weight above
    profiles: dict = field(default_factory=dict)
    # health of a summary
    omega_sem: float = 0.05
    omega_loss: float = 0.05
    omega_contradiction: float = 0.05
    omega_expand: float = 0.0
    feedback_days: float = 90.0
    feedback_rows: int = 200_000


def load(path: str | None = None, environment: str | None = None) -> Config:
    """The defaults with what a JSON file and a JSON text of the environment set; nested objects are merged, the latter wins.

    A missing or unreadable file and blank text set nothing; unknown names are an error.
    """
    merged: dict = {}
    for text in (Path(path).read_text() if path and Path(path).is_file() else None, environment):
        try:
            found = json.loads(text) if text and text.strip() else {}
        except ValueError:
            found = {}
        merged = _merged(merged, found if isinstance(found, dict) else {})
    base = asdict(Config())
    if unknown := set(merged) - set(base):
        raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in _merged(base, merged).items()})


def _merged(base: dict, changes: dict) -> dict:
    out = dict(base)
    for k, v in changes.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: The moment that stands for "now" in the queries.
AS_OF = 1775001600.0  # 2026-04-01T00:00:00Z
