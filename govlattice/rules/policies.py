"""Declarative rule tables: policies, constitution, agents, runbooks, remediation.

Conditions, statuses and risk levels are fixed values; the wording of
rationales, mitigations and steps is ours. Booleans in a context are the
strings ``true`` and ``false``.
"""

from __future__ import annotations

# trigger: cats_any / cats_all / cats_none / basis_in / basis_not_in / ctx / ctx_ne
# outcome: the same without categories, plus status, risk, rationale, mitigations;
# an outcome without conditions is the default and comes last.
POLICIES = [
    {
        "id": "POL-001",
        "trigger": {"cats_any": ["sensitive"], "ctx": {"data_subtype": "health"}},
        "outcomes": [
            {
                "basis_in": ["consent"],
                "ctx": {"ripd_conducted": "true"},
                "status": "allow_with_mitigation",
                "risk": "high",
                "rationale": "Health data with explicit consent and a finished impact report.",
                "mitigations": [
                    "Limit access to health data by role",
                    "Update the impact report when the purpose changes",
                    "Review the use of health data every quarter",
                ],
            },
            {
                "status": "requires_human_review",
                "risk": "critical",
                "rationale": "Health data lacks explicit consent or an impact report.",
                "mitigations": [
                    "Collect explicit consent from the data subject",
                    "Write the impact report before processing starts",
                ],
            },
        ],
    },
    {
        "id": "POL-002",
        "trigger": {"cats_any": ["sensitive"], "ctx": {"data_subtype": "biometric"}},
        "outcomes": [
            {
                "ctx": {"automated_decision": "true"},
                "ctx_ne": {"human_review": "true"},
                "status": "deny",
                "risk": "critical",
                "rationale": "Biometric data drives an automated decision nobody reviews.",
                "mitigations": [],
            },
            {
                "ctx": {"human_review": "true"},
                "status": "allow_with_mitigation",
                "risk": "high",
                "rationale": "Biometric data with a human reviewing the decision.",
                "mitigations": [
                    "Encrypt biometric templates and store them apart",
                    "Log every read of biometric data",
                ],
            },
            {
                "status": "requires_human_review",
                "risk": "high",
                "rationale": "Biometric data without a confirmed human review.",
                "mitigations": ["Name a person who approves the use of biometric data"],
            },
        ],
    },
    {
        "id": "POL-003",
        "trigger": {"ctx": {"involves_minor": "true"}},
        "outcomes": [
            {
                "ctx": {"guardian_consent": "true"},
                "status": "allow_with_mitigation",
                "risk": "high",
                "rationale": "A guardian consented to the processing of a minor's data.",
                "mitigations": [
                    "Collect only what the purpose needs from minors",
                    "Renew the guardian's consent twice a year",
                ],
            },
            {
                "status": "deny",
                "risk": "critical",
                "rationale": "A minor's data without the consent of a guardian.",
                "mitigations": ["Obtain the consent of a parent or guardian"],
            },
        ],
    },
    {
        "id": "POL-004",
        "trigger": {"ctx": {"international_transfer": "true"}},
        "outcomes": [
            {
                "ctx": {"adequacy_safeguard": "true"},
                "status": "allow_with_mitigation",
                "risk": "medium",
                "rationale": "Transfer abroad under an adequacy safeguard.",
                "mitigations": [
                    "Record the basis of the transfer",
                    "Recheck the safeguard every year",
                ],
            },
            {
                "status": "requires_human_review",
                "risk": "high",
                "rationale": "Transfer abroad without a recorded safeguard.",
                "mitigations": ["Find the legal ground for the transfer"],
            },
        ],
    },
    {
        "id": "POL-005",
        "trigger": {"cats_all": ["anonymized"], "cats_none": ["personal", "sensitive"]},
        "outcomes": [
            {
                "status": "allow",
                "risk": "low",
                "rationale": "Only anonymized data is involved.",
                "mitigations": [],
            },
        ],
    },
    {
        "id": "POL-006",
        "trigger": {"ctx": {"automated_decision": "true", "legal_effect": "true"}},
        "outcomes": [
            {
                "ctx": {"explainability_available": "true", "human_review": "true"},
                "status": "allow_with_mitigation",
                "risk": "medium",
                "rationale": "Automated decision that can be explained and reviewed.",
                "mitigations": ["Hand the explanation to the data subject on request"],
            },
            {
                "ctx": {"explainability_available": "true"},
                "status": "requires_human_review",
                "risk": "high",
                "rationale": "Automated decision that can be explained but not reviewed.",
                "mitigations": ["Open a channel to request a human review"],
            },
            {
                "status": "deny",
                "risk": "critical",
                "rationale": "Automated decision with legal effect and no explanation.",
                "mitigations": ["Make the decision explainable before release"],
            },
        ],
    },
    {
        "id": "POL-007",
        "trigger": {
            "cats_any": ["personal", "sensitive"],
            "ctx": {"purpose_specified": "false"},
        },
        "outcomes": [
            {
                "status": "deny",
                "risk": "high",
                "rationale": "The purpose of the processing is not stated.",
                "mitigations": ["Write down the purpose before processing"],
            },
        ],
    },
    {
        "id": "POL-008",
        "trigger": {"cats_any": ["personal", "sensitive"], "basis_in": ["not_determined"]},
        "outcomes": [
            {
                "status": "requires_human_review",
                "risk": "medium",
                "rationale": "No legal basis has been chosen yet.",
                "mitigations": ["Choose a legal basis before processing"],
            },
        ],
    },
    {
        "id": "POL-009",
        "trigger": {
            "cats_any": ["personal"],
            "cats_none": ["sensitive"],
            "basis_not_in": ["not_determined"],
            "ctx_ne": {"purpose_specified": "false"},
        },
        "outcomes": [
            {
                "status": "allow",
                "risk": "low",
                "rationale": "Common personal data with a legal basis and a purpose.",
                "mitigations": [],
            },
        ],
    },
]

# Red-line principles: a violation when every listed signal holds.
CONSTITUTION = [
    {
        "id": "CONST-01",
        "principle": "Transparência",
        "condition": {"automated_decision": "true", "explainable": "false"},
        "severity": "high",
    },
    {
        "id": "CONST-02",
        "principle": "Não-discriminação",
        "condition": {"fairness_audit_passed": "false"},
        "severity": "critical",
    },
    {
        "id": "CONST-03",
        "principle": "Supervisão humana",
        "condition": {
            "automated_decision": "true",
            "high_impact": "true",
            "human_review_available": "false",
        },
        "severity": "critical",
    },
    {
        "id": "CONST-04",
        "principle": "Minimização de dados",
        "condition": {"data_category": "sensitive", "purpose_specified": "false"},
        "severity": "high",
    },
    {
        "id": "CONST-05",
        "principle": "Prestação de contas",
        "condition": {"in_production": "true", "audit_logging_enabled": "false"},
        "severity": "critical",
    },
    {
        "id": "CONST-06",
        "principle": "Segurança",
        "condition": {"in_production": "true", "prompt_security_scanned": "false"},
        "severity": "medium",
    },
]

AGENTS = [
    {
        "agent_id": "ripd_generator",
        "risk_tier": "medium",
        "allowed_actions": [
            "pii_detection.detect",
            "policy_engine.evaluate",
            "prompt_security.scan",
            "regulatory_rag.query",
            "trust_score.compute",
            "explainability.explain",
            "audit_logs.record_event",
            "ripd_engine.generate_ripd",
            "governance_copilot.ripd_store",
        ],
    },
    {
        "agent_id": "auditor",
        "risk_tier": "low",
        "allowed_actions": [
            "audit_logs.verify_chain",
            "audit_logs.read_events",
            "blockchain_audit_layer.create_checkpoint",
            "blockchain_audit_layer.verify_checkpoint_chain",
            "traceability.trace_by_correlation_key",
            "ai_observability.export",
            "self_healing_governance.check_and_heal",
        ],
    },
    {
        "agent_id": "red_teamer",
        "risk_tier": "high",
        "allowed_actions": ["red_team_lab.run_suite", "prompt_security.scan"],
    },
    {
        "agent_id": "reviewer",
        "risk_tier": "low",
        "allowed_actions": [
            "human_oversight.enqueue",
            "human_oversight.decide",
            "human_oversight.list_items",
        ],
    },
    {
        "agent_id": "sandbox_explorer",
        "risk_tier": "low",
        "allowed_actions": [
            "regulatory_sandbox.simulate",
            "regulatory_sandbox.compare_scenarios",
        ],
    },
]

RUNBOOKS = {
    "critical": [
        "Contain: stop the affected system",
        "Keep evidence: export the audit events first",
        "Size the damage: whose data, how many people",
        "Notify the authority and the data subjects where the law asks for it",
        "Ask for a human review before restarting",
        "Write a post-mortem with cause and plan",
    ],
    "high": [
        "Contain: switch off the affected function",
        "Keep the audit events",
        "Decide whether anybody must be notified",
        "Fix and test before restarting",
        "Record a post-mortem",
    ],
    "medium": [
        "Find the cause while the system keeps running",
        "Fix it in the next maintenance window",
        "Record it to follow the trend",
    ],
    "low": [
        "Record it, nothing to do at once",
        "Look at it in the periodic review",
    ],
}

REMEDIATION = {
    "audit_chain_integrity": (
        "critical",
        [
            "Find the first event that fails verification",
            "List who could write to the log in that time",
            "Open a critical incident and follow its runbook",
        ],
    ),
    "checkpoint_chain_integrity": (
        "critical",
        [
            "Investigate the checkpoint chain like the event chain",
            "Compare the roots with any published copy",
        ],
    ),
    "prompt_security_coverage": (
        "medium",
        [
            "Run the red-team suite and list what it missed",
            "Rank the gaps by category",
            "Add or adjust patterns and run the suite again",
        ],
    ),
    "regulatory_index_freshness": (
        "low",
        [
            "Compare the corpus with its manifest",
            "Have a person review the changes",
            "Rebuild the index once they are approved",
        ],
    ),
}
DEFAULT_REMEDIATION = ("medium", ["No runbook for this check: investigate by hand"])
