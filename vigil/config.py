"""Settings of the risk rules: weights, thresholds and the policy profiles of applications (fixed values)."""

from __future__ import annotations

TIERS = ("ALLOW", "ANNOTATE", "VERIFY", "HUMAN_REVIEW", "BLOCK")
RANK = {t: i for i, t in enumerate(TIERS)}
APPLICATIONS = ("customer_support", "decision_support", "internal_knowledge_assistant")
USER_TYPES = ("external_customer", "employee", "manager", "operations_agent")
MODELS = ("gpt-4o-mini", "claude-3-haiku", "gemini-flash", "local-small-model")
ACTIONS = ("information", "refund", "account_update", "account_cancellation", "external_communication", "recommendation")

#: Price of 1000 tokens in, and out, by model.
RATE_IN = {"gpt-4o-mini": 0.013, "claude-3-haiku": 0.021, "gemini-flash": 0.010, "local-small-model": 0.002}
RATE_OUT = {"gpt-4o-mini": 0.052, "claude-3-haiku": 0.105, "gemini-flash": 0.030, "local-small-model": 0.004}
RATE_DEFAULT = (0.015, 0.060)
TOOL_COST, RETRY_COST = 0.40, 0.25
STATIC = {"tokens_in": 200.0, "tokens_out": 300.0, "latency_ms": 1500.0, "estimated_cost": 0.05}
MULTIPLIER = {"tokens_in": 2.5, "tokens_out": 2.5, "latency_ms": 2.0, "estimated_cost": 2.0}
MAX_TOOLS, MAX_RETRIES, BASELINE_AT, PER_INDICATOR = 4, 2, 0.80, 0.28

REVERSIBILITY = dict(zip(ACTIONS, (0.05, 0.30, 0.40, 0.85, 0.90, 0.50), strict=True))
SENSITIVITY = dict(zip(ACTIONS, (0.20, 0.40, 0.50, 0.70, 0.60, 0.50), strict=True))
AUTOMATION = dict(zip(ACTIONS, (0.90, 0.60, 0.60, 0.50, 0.80, 0.70), strict=True))
FACTORS = ("financial_impact", "reversibility", "sensitivity", "blast_radius", "action_automation")
CONSEQUENCE = dict(zip(FACTORS, (0.30, 0.25, 0.20, 0.15, 0.10), strict=True))
CRITICALITY = dict(zip(FACTORS, (0.30, 0.22, 0.18, 0.15, 0.15), strict=True))
FINANCIAL_SCALE, BLAST_SCALE, BAND_HIGH, BAND_MODERATE, AMPLIFICATION = 500_000.0, 100.0, 0.66, 0.40, 0.60
FUSION = {"performance": 0.40, "responsibility": 0.40, "cost": 0.20}
SEVERITY_AT, PULL, PULL_LOW, FLOOR_AT, FLOOR, ELEVATED = 0.60, 0.65, 0.15, 0.85, 0.80, 0.45

_DEFAULT = {
    "allow": 0.20, "annotate": 0.40, "verify": 0.62, "review": 0.85, "escalate_at": 0.65, "steps": 1, "extreme_at": 0.85, "critical_at": 0.66,
    "critical_tier": "VERIFY", "contradiction_tier": "VERIFY", "unverified_tier": "ANNOTATE", "responsibility_at": 0.60, "responsibility_tier": "HUMAN_REVIEW",
    "pii_tier": "BLOCK", "toxicity_at": 0.85, "confidence_at": 0.35, "confidence_tier": "VERIFY", "cost_tier": "VERIFY",
    "unsure_risk": 0.60, "unsure_confidence": 0.45, "unsure_tier": "HUMAN_REVIEW",
}
#: Policy profiles; ``default`` serves applications that have none.
PROFILES = {
    "default": _DEFAULT,
    "customer_support": _DEFAULT | {"allow": 0.22, "annotate": 0.42, "verify": 0.60, "review": 0.82, "escalate_at": 0.60, "responsibility_at": 0.55, "toxicity_at": 0.80},
    "internal_knowledge_assistant": _DEFAULT
    | {"allow": 0.28, "annotate": 0.50, "verify": 0.70, "review": 0.88, "escalate_at": 0.72, "contradiction_tier": "ANNOTATE", "unverified_tier": "ALLOW"}
    | {"responsibility_at": 0.65, "pii_tier": "HUMAN_REVIEW", "toxicity_at": 0.88, "confidence_at": 0.30, "confidence_tier": "ANNOTATE"},
    "decision_support": _DEFAULT
    | {"allow": 0.15, "annotate": 0.32, "verify": 0.52, "review": 0.75, "escalate_at": 0.50, "contradiction_tier": "HUMAN_REVIEW", "unverified_tier": "VERIFY"}
    | {"responsibility_at": 0.55, "toxicity_at": 0.80, "confidence_at": 0.45},
}

#: Routing to deep verification.
DEEP = {"risk": 0.35, "confidence": 0.70, "floor": 0.15, "consequence": 0.60, "extreme": 0.85, "criticality": 0.60, "disagreement": 0.45}
SESSION = {"window": 20, "decay": 0.80, "history": 0.45, "current": 0.55, "high": 0.55, "events": 3, "bump": 0.15, "most": 0.98, "floor": 0.75}
BUCKETS = (("LOW", 0.0, 0.20), ("MODERATE", 0.20, 0.50), ("HIGH", 0.50, 0.75), ("CRITICAL", 0.75, 1.01))
LOW_CONFIDENCE, HIGH_CONSEQUENCE, ELEVATED_RISK, CRITICAL_RISK = 0.45, 0.60, 0.50, 0.85
ATTENTION = {"block": 0.15, "review": 0.35, "deep": 0.85, "p95_latency": 40.0, "confidence": 0.55, "concentration": 0.30, "times": 1.5}
EVALUATION = {"binary": 0.50, "risk": 0.55, "confidence": 0.65}
