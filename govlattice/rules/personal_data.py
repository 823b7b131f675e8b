"""Personal-data patterns and word lists.

Fixed values: patterns, confidences and keyword lists. Patterns use Unicode
``\\d``, ``\\w``, ``\\s`` and ``\\b``.
"""

from __future__ import annotations

CPF_FORMATTED = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
CPF_PLAIN = r"(?<!\d)\d{11}(?!\d)"
CNPJ_FORMATTED = r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
CNPJ_PLAIN = r"(?<!\d)\d{14}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CEP_FORMATTED = r"\b\d{5}-\d{3}\b"
CEP_PLAIN = r"(?<!\d)\d{8}(?!\d)"
CEP_CONTEXT = r"\bcep\b"
CEP_CONTEXT_CHARS = 15
PHONE_WITH_AREA = r"(?<!\d)(?:\+55[\s.-]?)?\(?\d{2}\)?[\s.-]?9?\d{4}[\s.-]?\d{4}(?!\d)"
PHONE_WITHOUT_AREA = r"(?<!\d)9?\d{4}-\d{4}(?!\d)"
PHONE_PUNCTUATION = r"[()+\-. ]"
RG_KEYWORD = r"\bRG\b\.?\s*:?\s*"
RG_NUMBER = r"\d{1,2}\.\d{3}\.\d{3}-[\dXx]\b"
RG_WINDOW_CHARS = 20
BIRTH_KEYWORD = r"(?:data de nascimento|nascid[oa]\s+em|nasc\.?\b|\bdn\b\s*:?)"
BIRTH_DATE = (
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{1,2}\s+de\s+[a-zçãéêíóôõú]+\s+de\s+\d{4}"
)
BIRTH_WINDOW_CHARS = 40
NAME = (
    r"(?=[A-ZÀ-Ý])\b[A-ZÀ-Ý][a-zà-ÿ]+"
    r"(?:\s+(?:d[aeo]s?|e)\s+[A-ZÀ-Ý][a-zà-ÿ]+|\s+[A-ZÀ-Ý][a-zà-ÿ]+)+\b"
)
SENTENCE_END_BEFORE = r"[.!?\n]\s*$"

CONFIDENCE = {
    "formatted_valid": 0.98,
    "formatted_invalid": 0.6,
    "plain_valid": 0.9,
    "email": 0.97,
    "cep_formatted": 0.9,
    "cep_plain": 0.7,
    "phone_punctuated": 0.85,
    "phone_bare": 0.7,
    "phone_local": 0.55,
    "rg": 0.85,
    "birth_date": 0.85,
    "name": 0.55,
    "sensitive": 0.65,
}

PERSONAL_TYPES = (
    "CPF",
    "CNPJ",
    "EMAIL",
    "CEP",
    "TELEFONE",
    "RG",
    "DATA_NASCIMENTO",
    "NOME",
)

# Capitalised words that do not start a personal name.
NAME_STOPWORDS = [
    "segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo",
    "janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro",
    "novembro", "dezembro", "brasil", "brasileiro", "brasileira", "governo", "empresa", "ministério",
    "secretaria", "conforme", "portanto", "assim", "além", "segundo", "quando", "onde", "porque", "contudo",
    "todavia", "entretanto", "estado", "município", "prefeitura", "república", "constituição", "lei",
    "artigo", "capítulo", "anexo", "processo", "protocolo", "sistema", "plataforma", "departamento",
    "diretoria", "gerência", "atenciosamente", "prezado", "prezada", "senhor", "senhora",
]

SENSITIVE_KEYWORDS = {
    "SENSITIVE_HEALTH": (
        "dado de saúde",
        "saúde",
        "doença",
        "diagnóstico",
        "tratamento médico",
        "exame médico",
        "hiv",
        "câncer",
        "depressão",
        "diabetes",
        "cirurgia",
        "prontuário médico",
        "transtorno mental",
        "medicamento controlado",
        "deficiência",
    ),
    "SENSITIVE_BIOMETRIC": (
        "biometria",
        "biométrico",
        "biométrica",
        "impressão digital",
        "reconhecimento facial",
        "leitura de íris",
        "digital do dedo",
    ),
    "SENSITIVE_SEXUAL_ORIENTATION": (
        "orientação sexual",
        "homossexual",
        "heterossexual",
        "bissexual",
        "gay",
        "lésbica",
        "transexual",
    ),
    "SENSITIVE_RELIGION": (
        "religião",
        "religioso",
        "religiosa",
        "católico",
        "católica",
        "evangélico",
        "evangélica",
        "espírita",
        "umbanda",
        "candomblé",
        "muçulmano",
        "muçulmana",
        "judeu",
        "judia",
        "ateu",
        "ateia",
    ),
    "SENSITIVE_ETHNICITY": (
        "etnia",
        "racial",
        "raça",
        "indígena",
        "afrodescendente",
        "quilombola",
    ),
    "SENSITIVE_POLITICAL_UNION": (
        "opinião política",
        "filiação partidária",
        "filiação sindical",
        "sindicato",
        "partido político",
    ),
}

SENSITIVE_TYPES = tuple(SENSITIVE_KEYWORDS)
ALL_TYPES = PERSONAL_TYPES + SENSITIVE_TYPES

# Accented letter -> base letter, one to one so offsets stay valid.
FOLD_FROM = "áàâãäéèêëíìîïóòôõöúùûüç"
FOLD_TO = "aaaaaeeeeiiiiooooouuuuc"

# Check-digit weights.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = (
    (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
    (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2),
)
