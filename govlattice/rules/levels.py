"""Ordinals and labels of the coded vocabularies (fixed values)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

RISK_LEVELS = ("low", "medium", "high", "critical")
DATA_CATEGORIES = ("personal", "sensitive", "anonymized", "not_personal")
LEGAL_BASES = (
    "consent",
    "legitimate_interest",
    "legal_obligation",
    "contract_execution",
    "research",
    "not_determined",
)
# Most restrictive first: position is the precedence.
DECISION_STATUSES = ("deny", "requires_human_review", "allow_with_mitigation", "allow")
IMPACT_LEVELS = ("none", "informational", "review_recommended", "review_required")

# Fixed output vocabulary of the Portuguese report texts.
RISK_LABEL_PT = {"low": "baixo", "medium": "médio", "high": "alto", "critical": "crítico"}
STATUS_LABEL_PT = {
    "deny": "NEGADA",
    "requires_human_review": "REQUER REVISÃO HUMANA",
    "allow_with_mitigation": "PERMITIDA COM MITIGAÇÃO",
    "allow": "PERMITIDA",
}
CATEGORY_LABEL_PT = {
    "personal": "pessoal",
    "sensitive": "sensível",
    "anonymized": "anonimizado",
    "not_personal": "não pessoal",
}
LEGAL_BASIS_LABEL_PT = {
    "consent": "consentimento",
    "legitimate_interest": "legítimo interesse",
    "legal_obligation": "obrigação legal",
    "contract_execution": "execução de contrato",
    "research": "pesquisa",
    "not_determined": "não determinada",
}
BADGE_LABELS = {
    "planned": "⏳ planejado",
    "in_progress": "🔄 em andamento",
    "done": "✅ concluído",
    "blocked": "⚠️ bloqueado",
}


def rank_of(col: Column, order: tuple[str, ...]) -> Column:
    """Position of a code in its vocabulary (0-based), NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col)
    return F.when(pos > 0, (pos - 1).cast("int"))


def code_at(rank: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in order]), rank)


def label_of(col: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Label for a code through a literal map; unknown codes keep their code."""
    out = None
    for code, label in labels.items():
        out = F.when(col == code, label) if out is None else out.when(col == code, label)
    return out.otherwise(col if default is None else default)
