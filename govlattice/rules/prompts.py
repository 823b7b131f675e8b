"""Prompt-manipulation rules.

Fixed values: technique, label, severity and pattern of every rule, the
severity weights and the safety threshold. Matching ignores case and treats
``\\w``, ``\\s`` and ``\\b`` as Unicode classes.
"""

from __future__ import annotations

from typing import NamedTuple


class PromptRule(NamedTuple):
    technique: str
    label: str
    severity: str
    pattern: str
    # Lower-case strings of which at least one is in every match; () = none known.
    needs: tuple[str, ...] = ()


SAFE_THRESHOLD = 0.5
SEVERITY_WEIGHT = {"low": 0.15, "medium": 0.55, "high": 0.75, "critical": 0.95}

# U+200B, U+200C, U+200D, U+2060, U+FEFF
ZERO_WIDTH = "​‌‍⁠﻿"
ZERO_WIDTH_MIN = 3
ZERO_WIDTH_RULE = ("obfuscation", "excessive_zero_width_chars", "medium")

PROMPT_RULES: tuple[PromptRule, ...] = (
    # -- prompt_injection
    PromptRule(
        "prompt_injection",
        "ignore_previous_instructions",
        "high",
        r"ignor[ae]\s+(todas?\s+(as\s+)?|as\s+|all\s+|the\s+)?instru[çc][õo]es\s+(anteriores|acima)"
        r"|ignore\s+(all\s+|the\s+)?previous\s+instructions"
        r"|ignore\s+(all\s+|the\s+)?prior\s+instructions",
        ("anteriores", "acima", "previous", "prior"),
    ),
    PromptRule(
        "prompt_injection",
        "disregard_everything_above",
        "high",
        r"desconsider[ae]\s+tudo\s*(o que foi dito\s*)?(acima|anterior)"
        r"|disregard\s+(everything|all)\s+(above|previous)",
        ("desconsider", "disregard"),
    ),
    PromptRule(
        "prompt_injection",
        "you_are_now_persona_override",
        "medium",
        r"voc[eê]\s+agora\s+[ée]\s|you\s+are\s+now\s+(a|an|my)\b",
        ("agora", "now"),
    ),
    PromptRule(
        "prompt_injection",
        "forget_your_rules",
        "high",
        r"esque[çc]a\s+(suas|todas\s+as|as)\s+regras"
        r"|forget\s+(your|all)\s+(rules|instructions|guidelines)",
        ("esque", "forget"),
    ),
    PromptRule(
        "prompt_injection",
        "overwrite_system_prompt",
        "critical",
        r"sobrescrev[ae]\s+(o\s+)?system\s*prompt"
        r"|overwrite\s+(the\s+)?system\s*prompt"
        r"|substitua\s+(o\s+)?system\s*prompt",
        ("prompt",),
    ),
    PromptRule(
        "prompt_injection",
        "new_instructions_marker",
        "medium",
        r"\bnovas?\s+instru[çc][õo]es\s*:|\bnew\s+instructions\s*:",
        ("instru",),
    ),
    PromptRule(
        "prompt_injection",
        "act_as_if_no_restrictions",
        "medium",
        r"aja\s+como\s+se\s+(voc[eê]\s+)?n[ãa]o\s+tivesse\s+(restri[çc][õo]es|regras)"
        r"|act\s+as\s+if\s+you\s+have\s+no\s+restrictions",
        ("tivesse", "restrictions"),
    ),
    PromptRule(
        "prompt_injection",
        "system_role_spoofing",
        "high",
        r"\[?\s*system\s*\]?\s*:\s*(you\s+are|voc[eê]\s+[ée])",
        ("system",),
    ),
    # -- jailbreak
    PromptRule(
        "jailbreak",
        "dan_persona",
        "critical",
        r"\bdan\b.{0,30}(do\s+anything\s+now)|do\s+anything\s+now",
        ("anything",),
    ),
    PromptRule(
        "jailbreak",
        "known_jailbreak_persona",
        "high",
        r"\b(stan|aim|dude|dax)\s+(mode|persona)\b",
        ("mode", "persona"),
    ),
    PromptRule(
        "jailbreak",
        "developer_mode",
        "high",
        r"modo\s+(desenvolvedor|dev)\b|developer\s+mode",
        ("modo", "mode"),
    ),
    PromptRule(
        "jailbreak",
        "respond_without_filters",
        "high",
        r"responda\s+sem\s+(filtros|restri[çc][õo]es|censura)"
        r"|without\s+any\s+(filters|restrictions|limitations)"
        r"|sem\s+filtro\s+nenhum",
        ("responda", "without", "nenhum"),
    ),
    PromptRule(
        "jailbreak",
        "roleplay_bypass",
        "medium",
        r"finja\s+que\s+(voc[eê]\s+)?(n[ãa]o\s+tem|est[aá]\s+sem)\s+(regras|pol[ií]ticas|filtros)"
        r"|pretend\s+(you\s+are|to\s+be)\s+an?\s+ai\s+(with\s+no|without)\s+"
        r"(guidelines|restrictions|rules)"
        r"|roleplay\s+as\s+.{0,40}(no\s+rules|sem\s+regras)",
        ("finja", "pretend", "roleplay"),
    ),
    PromptRule(
        "jailbreak",
        "explicit_jailbreak_mention",
        "medium",
        r"\bjailbreak\b",
        ("jailbreak",),
    ),
    PromptRule(
        "jailbreak",
        "opposite_day",
        "medium",
        r"opposite\s+day\b|dia\s+do\s+contr[aá]rio",
        ("opposite", "contr"),
    ),
    # -- pii_exfiltration
    PromptRule(
        "pii_exfiltration",
        "reveal_system_prompt",
        "high",
        r"revele?\s+(seu\s+|o\s+)?system\s*prompt"
        r"|mostre?\s+(suas?\s+)?instru[çc][õo]es\s+(originais|completas|internas)"
        r"|reveal\s+your\s+system\s*prompt"
        r"|show\s+me\s+your\s+(system\s*prompt|instructions)",
        ("prompt", "instru"),
    ),
    PromptRule(
        "pii_exfiltration",
        "reveal_training_data",
        "medium",
        r"dados\s+de\s+treinamento"
        r"|training\s+data\s+(you\s+were\s+trained\s+on|used\s+to\s+train)"
        r"|repita\s+(exemplos\s+de\s+)?seus\s+dados\s+de\s+treinamento",
        ("treinamento", "training"),
    ),
    PromptRule(
        "pii_exfiltration",
        "reveal_secrets_keys",
        "critical",
        r"(revele?|mostre?|qual\s+[ée])\s+(a\s+|sua\s+)*"
        r"(chave\s+de\s+api|api\s*key|senha|token\s+secreto|secret\s+key)"
        r"|reveal\s+(your\s+)?(api\s*key|password|secret)",
        ("revel", "reveal", "mostr", "qual"),
    ),
    PromptRule(
        "pii_exfiltration",
        "other_users_data",
        "critical",
        r"dados\s+(\w+\s+)?de\s+outr[oa]s?\s+usu[aá]rios?"
        r"|informa[çc][õo]es\s+(\w+\s+)?de\s+outr[oa]\s+usu[aá]rio"
        r"|other\s+users?['`]?\s+(data|information|conversations)",
        ("usu", "user"),
    ),
    PromptRule(
        "pii_exfiltration",
        "print_env_vars",
        "high",
        r"vari[aá]veis\s+de\s+ambiente|environment\s+variables|print(ar)?\s+env\b",
        ("ambiente", "environment", "print"),
    ),
    # -- obfuscation
    PromptRule(
        "obfuscation",
        "long_base64_blob",
        "medium",
        r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])",
    ),
    PromptRule(
        "obfuscation",
        "long_hex_blob",
        "medium",
        r"(?<![0-9a-fA-F])(?:0x)?[0-9a-fA-F]{32,}(?![0-9a-fA-F])",
    ),
    PromptRule(
        "obfuscation",
        "decode_instruction_hint",
        "low",
        r"decodifiqu[ae]\s+(isso\s+|este\s+texto\s+)?em\s+base64"
        r"|decode\s+(this|the\s+following)\s+(from\s+)?base64"
        r"|decode\s+.{0,20}hex\b",
        ("decod",),
    ),
)
