"""Severity names: normalising provider values to the fixed level vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern.functions.text import WHOLE_NUMBER, trim_blanks

# --- fixed values -----------------------------------------------------------

# Provider field EventType.
EVENT_TYPE_LEVELS = {
    1: "Error",
    2: "Warning",
    3: "Information",
    4: "AuditSuccess",
    5: "AuditFailure",
}

# A number in the provider field Type; any other number is "Other".
TYPE_NUMBER_LEVELS = {
    1: "Error",
    2: "Warning",
    3: "Information",
    4: "Information",
    8: "AuditSuccess",
    16: "AuditFailure",
}

# Localised names, matched exactly and with their case.
LEVEL_NAMES = {
    "Error": [
        "Error", "Ошибка", "Fehler", "Erreur", "Erro", "Errore", "Fout", "Błąd", "Chyba", "Fel",
    ],
    "Warning": [
        "Warning", "Предупреждение", "Warnung", "Avertissement", "Advertencia", "Aviso", "Avviso",
        "Waarschuwing", "Ostrzeżenie", "Upozornění", "Varning",
    ],
    "Information": [
        "Information", "Информация", "Сведения", "Informationen", "Información", "Informação",
        "Informações", "Informazione", "Informazioni", "Informatie", "Informacja", "Informace",
    ],
    "AuditSuccess": [
        "Audit Success", "Success Audit", "Успешный аудит", "Успех аудита", "Erfolgsüberwachung",
        "Erfolgreiche Überwachung", "Audit des succès", "Succès de l'audit", "Auditoría correcta",
        "Éxito de auditoría", "Auditoria com êxito", "Êxito de auditoria", "Controllo riuscito",
        "Operazioni riuscite", "Geslaagde controle", "Inspekcja zakończona powodzeniem",
        "Úspěšný audit", "Lyckad granskning",
    ],
    "AuditFailure": [
        "Audit Failure", "Failure Audit", "Ошибка аудита", "Отказ аудита", "Fehlerüberwachung",
        "Fehlgeschlagene Überwachung", "Audit des échecs", "Échec de l'audit", "Error de auditoría",
        "Auditoría errónea", "Falha de auditoria", "Auditoria com falha", "Controllo non riuscito",
        "Operazioni non riuscite", "Mislukte controle", "Inspekcja zakończona niepowodzeniem",
        "Neúspěšný audit", "Misslyckad granskning",
    ],
}

# Parts of words, looked for in the lower-cased text.
AUDIT_WORDS = [
    "audit", "аудит", "überwach", "contrôle", "auditoría", "auditoria", "controllo", "controle",
    "inspekcj", "granskning", "审核", "監査", "감사",
]
SUCCESS_WORDS = [
    "success", "успех", "erfolg", "succès", "éxito", "êxito", "riuscit", "geslaagd",
    "powodzeniem", "úspěšn", "lyckad", "成功", "성공",
]
FAILURE_WORDS = [
    "fail", "отказ", "ошибка", "fehl", "échec", "error", "falha", "non riuscit", "mislukt",
    "niepowodzeniem", "neúspěšn", "misslyckad", "失败", "실패",
]
ERROR_WORDS = [
    "error", "ошибка", "fehler", "erreur", "errore", "erro", "fout", "błąd", "chyba", "fel",
    "错误", "エラー", "오류",
]
WARNING_WORDS = [
    "warning", "предупреждение", "warnung", "avertissement", "advertencia", "avviso", "aviso",
    "waarschuwing", "ostrzeżenie", "upozornění", "varning", "警告", "경고",
]
INFORMATION_WORDS = [
    "information", "информация", "сведения", "informationen", "información", "informação",
    "informazione", "informatie", "informacja", "informace", "信息", "情報", "정보",
]

LEVEL_PRIORITY = {
    "Error": 1,
    "Warning": 2,
    "Information": 3,
    "AuditFailure": 4,
    "AuditSuccess": 5,
}
LAST_PRIORITY = 99

UNKNOWN_LEVEL = "Unknown"
OTHER_LEVEL = "Other"

DEFAULT_CHANNELS = ["System", "Application", "Security"]
SECURITY_CHANNEL = "Security"
SECURITY_LEVELS = ["AuditSuccess", "AuditFailure"]
COMMON_LEVELS = ["Error", "Warning", "Information"]

# ----------------------------------------------------------------------------

FUZZY_MODES = ("compat", "fixed")


def _lookup(key: Column, table: dict) -> Column:
    """Value of a key in a constant map, null when it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def _has_any(text: Column, words: list[str]) -> Column:
    """True when the text contains one of the words; a word that contains another
    word of the list adds nothing and is left out."""
    needed = [w for w in words if not any(v != w and v in w for v in words)]
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in needed])


def level_from_event_type(event_type: Column) -> Column:
    """Level of a numeric EventType, or null when it names none."""
    return _lookup(event_type, EVENT_TYPE_LEVELS)


def fuzzy_level(text: Column, fuzzy: str = "compat") -> Column:
    """Level guessed from words inside a free text.

    ``compat`` looks for success words before failure words, so that texts such
    as "controllo NON riuscito", whose failure word contains a success word, come
    out as successes. ``fixed`` looks for the failure words first.
    """
    if fuzzy not in FUZZY_MODES:
        raise ValueError(f"fuzzy must be one of {FUZZY_MODES}, not {fuzzy!r}")
    outcomes = [(SUCCESS_WORDS, "AuditSuccess"), (FAILURE_WORDS, "AuditFailure")]
    if fuzzy == "fixed":
        outcomes.reverse()
    (first, first_level), (second, second_level) = outcomes

    def guess(lowered: Column) -> Column:
        outcome = F.when(_has_any(lowered, first), first_level).when(_has_any(lowered, second), second_level)
        return F.coalesce(
            F.when(_has_any(lowered, AUDIT_WORDS), outcome),
            F.when(_has_any(lowered, ERROR_WORDS), "Error")
            .when(_has_any(lowered, WARNING_WORDS), "Warning")
            .when(_has_any(lowered, INFORMATION_WORDS), "Information")
            .otherwise(OTHER_LEVEL),
        )

    # a lambda binds the lower-cased text, which else each test would make anew
    return F.get(F.transform(F.array(F.lower(text)), guess), F.lit(0))


def level_from_type_text(type_text: Column, fuzzy: str = "compat") -> Column:
    """Level of a Type text: blank, a number, a localised name, or a guess."""
    level_of_name = {name: level for level, names in LEVEL_NAMES.items() for name in names}
    trimmed = trim_blanks(type_text)
    number = F.coalesce(_lookup(trimmed.try_cast("int"), TYPE_NUMBER_LEVELS), F.lit(OTHER_LEVEL))
    return F.coalesce(
        _lookup(type_text, level_of_name),
        F.when(type_text.isNull() | (type_text == ""), UNKNOWN_LEVEL),
        _lookup(trimmed, level_of_name),
        F.when(trimmed == "", UNKNOWN_LEVEL)
        .when(trimmed.rlike(WHOLE_NUMBER), number)
        .otherwise(fuzzy_level(type_text, fuzzy)),
    )


def normalize_level(event_type: Column, type_text: Column, fuzzy: str = "compat") -> Column:
    """Level of a raw record: its EventType number if that names one, else its Type."""
    return F.coalesce(level_from_event_type(event_type), level_from_type_text(type_text, fuzzy))


def level_priority(level: Column) -> Column:
    return F.coalesce(_lookup(level, LEVEL_PRIORITY), F.lit(LAST_PRIORITY))


def level_or_unknown(level: Column) -> Column:
    return F.coalesce(level, F.lit(UNKNOWN_LEVEL))


def default_levels(channel: str) -> list[str]:
    """Levels offered for a channel that has no records yet."""
    return list(SECURITY_LEVELS if channel.upper() == SECURITY_CHANNEL.upper() else COMMON_LEVELS)


def default_levels_of(channel: Column) -> Column:
    """The column form of :func:`default_levels`."""
    return F.when(
        F.upper(channel) == SECURITY_CHANNEL.upper(), F.array(*map(F.lit, SECURITY_LEVELS))
    ).otherwise(F.array(*map(F.lit, COMMON_LEVELS)))
