"""Ordered rules as a table: the first that fits decides, and says why.

A rule is data: what it gives, its reason, a pattern of the text or the name, and exceptions. A list of rules becomes one
expression, so rows are classified where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """gives the kind where `pattern` is found in `on` and, if given, `also` (a pattern of its own column) too, unless
    `but` is found in `but_on`."""

    kind: str
    reason: str
    pattern: str
    on: str = "text"
    also: tuple[str, str] | None = None
    but: str | None = None
    but_on: str = "text"


def fits(rule: Rule, columns: dict[str, Column]) -> Column:
    out = columns[rule.on].rlike(rule.pattern)
    if rule.also:
        out = out & columns[rule.also[0]].rlike(rule.also[1])
    if rule.but:
        out = out & ~columns[rule.but_on].rlike(rule.but)
    return F.coalesce(out, F.lit(False))


def first_match(rules: tuple[Rule, ...], columns: dict[str, Column], default: tuple[str, str]) -> Column:
    """(kind, reason) of the first rule that fits, else the default."""
    answer = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return F.coalesce(*(F.when(fits(r, columns), answer(r.kind, r.reason)) for r in rules), answer(*default))


def all_matches(rules: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """Reasons of all rules that fit, in order: what a decision could also have been."""
    return F.array_compact(F.array(*(F.when(fits(r, columns), F.lit(r.reason)) for r in rules)))


INTERNAL = "internal_method_or_variable"
# Kinds of interfaces by their text or name, in the order in which they are tried.
INTERFACES = (
    Rule(INTERNAL, "internal_comment", r"(?i)KLASSENVARIABLEN|INTERNE|IMPORT-TABELLE|EXPORT-TABELLE|PARAMETER", but=r"(?i)WEB\s*SERVICE|SOAP|PROXY|RFC|IDoc|HTTP|REST|FILE|DATEI"),
    Rule(INTERNAL, "parameter_or_variable", r"^(I_|E_|C_|L_|G_|LT_|GT_|LS_|GS_|IT_|IS_|WA_|P_|R_)[A-Z0-9_]*", "name"),
    Rule(INTERNAL, "runtime_exception", r"(?i)\bCX_AI_"),
    Rule(INTERNAL, "database_table", r"^(VBPA|KNVA|VBSK|MARA|VBAK|VBAP|EKKO|EKPO|ZEXTO_)", "name", but="->", but_on="name"),
    Rule("idoc", "idoc", r"(?i)\bIDOC\b|/IDOC"),
    Rule("rfc_destination", "rfc", r"(?i)\bRFC\b|DESTINATION\b"),
    Rule("http_or_rest", "http", r"(?i)\bHTTP\b|\bREST\b|\bURL\b|\bOData\b"),
    Rule("file_interface", "file", r"(?i)\bFILE\b|DATEI|DATASET|OPEN DATASET|CSV|XML-DATEI"),
    Rule("sap_proxy_or_webservice", "proxy", r"(?i)LOGICAL[_\s-]?PORT|SOAP|WEBSERVICE|WEB\s*SERVICE|PROXY|ZCO_|ZOTCO_"),
    Rule("function_module", "named_function", r"(?i)FUNKTIONSBAUSTEIN"),
    Rule("function_module", "called_function", r"(?i)CALL FUNCTION", also=("name", "^(DATE_|SD_|READ_|CACL_|NUMBER_)")),
    Rule("function_module", "function_like_name", r"^(DATE_|SD_|READ_|CACL_|NUMBER_)[A-Z0-9_/]*$", "name"),
    Rule("external_system_name", "system_label", r"(?i)OPTITOOL|PRODSYSTEM|TESTSYSTEM|TESTSYS"),
    Rule(INTERNAL, "helper_class", r"^ZCL_", "name"),
)


def interface_name(text: Column) -> Column:
    """The function module that a text names, class and method of an arrow, or what stands before a parenthesis; upper case."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    module = F.regexp_extract(clean, r"(?i)Funktionsbaustein\s*:?\s*([A-Z0-9_/]+)", 1)
    arrow = F.regexp_extract(clean, r"(?i)^([A-Z0-9_/]+->[A-Z0-9_/]+)", 1)
    return F.upper(F.when(module != "", module).when(arrow != "", arrow).otherwise(F.trim(F.substring_index(clean, "(", 1))))


def interface_kind(text: Column) -> Column:
    """(kind, reason) of an interface's text; plain names are internal."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return first_match(INTERFACES, {"text": clean, "name": interface_name(text)}, (INTERNAL, "plain_name"))
