"""Questions: terms, phrases and symbols of one on the driver, from which plans are built; literals of many as columns."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import ADJECTIVE_ENDINGS, ADJECTIVE_ROOTS, EDGE, STOPWORDS, symbol_matches

SYMBOL = re.compile(r"(?<![A-Za-z0-9_/])(?:/[A-Z0-9_]{2,}/[A-Z0-9_]+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[ZY][A-Z0-9_]{2,}|[A-Z][A-Z0-9_]{2,}-[A-Z][A-Z0-9_]+)(?![A-Za-z0-9_])")
# What says that a question is about values in code.
HARDCODED = r"hart\s*codiert|hartcodiert|hard\s*cod(?:ed|ing)?|fest\s*(?:verdrahtet|codiert|im\s+code)|konstanten?|fest\s+im\s+code|stehen\s+fest"
# Words that are neither fields nor values.
NO_LITERALS = ("WO", "IST", "WIRD", "STEHT", "CODE", "FEST", "HART", "CODERT", "IM", "DER", "DIE", "DAS", "UND", "MIT", "VON", "AUS", "WAS", "WELCHE", "WELCHER")
# Fields to which a value can be bound, and message types that are values.
BOUND_FIELDS = ("MATNR", "KUNNR", "LIFNR", "WERKS", "VKORG", "VTWEG", "SPART", "BUKRS", "LGORT", "AUART", "KSCHL")
MESSAGE_TYPES = ("ORDERS", "ORDRSP", "DESADV", "INVOIC", "DELVRY", "WMMBXY")
# A field's name and the value that follows it.
FIELD_VALUE = f"(?i){EDGE}([A-Z][A-Z0-9_]{{2,}})\\s*[=:]?\\s*['\"]?([A-Z0-9_]{{2,}}|[0-9]{{2,}})['\"]?"


@dataclass
class Question:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)


def fold(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return bare.lower().replace("ß", "ss")


def stem(word: str) -> str:
    """light_stem() of one word."""
    word = fold(word)
    if len(word) < 4:
        return word
    roots = (word[: -len(e)] for e in ADJECTIVE_ENDINGS if word.endswith(e) and len(word) - len(e) >= 4)
    word = next((r for r in roots if len(r) >= 5 or r.endswith(ADJECTIVE_ROOTS)), word)
    return word[:-1] if len(word) >= 6 and word.endswith("s") and not word.endswith("ss") else word


def normalise(text: str) -> Question:
    """Distinct terms without function words, their stems, phrases of two to four neighbouring terms, and symbols."""
    words = [w for w in re.split(r"[^a-z0-9_äöüß]+", text.lower()) if len(w) >= 2]
    terms = list(dict.fromkeys(w for w in words if w not in STOPWORDS))
    phrases: list[str] = []
    run: list[str] = []
    for w in [*words, "der"]:
        if w not in STOPWORDS:
            run.append(w)
            continue
        phrases += [" ".join(run[i : i + n]) for n in (2, 3, 4) for i in range(len(run) - n + 1)]
        run = []
    symbols = sorted(set(SYMBOL.findall(text)), key=lambda s: (-len(s), s))
    return Question([fold(t) for t in terms], list(dict.fromkeys(fold(stem(t)) for t in terms)), list(dict.fromkeys(phrases)), symbols)


def literals(question: Column) -> Column:
    """What a question says of literals: (is_literal, values, fields).

    Values follow a field's name, are numbers of three digits or more, or stand in quotes; where a cue says that the
    question is about values in code, upper-case symbols and message types too. It is one with a cue and a value, or with
    a bound field, a value and a word that hints at code. Values are as written, each once.
    """
    q = F.trim(F.coalesce(question, F.lit("")))
    every = lambda p, g: F.regexp_extract_all(q, F.lit(p), F.lit(g))
    cue = q.rlike(f"(?i){EDGE}(?:{HARDCODED}){EDGE}")
    bound = F.filter(F.zip_with(every(FIELD_VALUE, 1), every(FIELD_VALUE, 2), lambda f, v: F.struct(F.upper(f).alias("f"), F.trim(v).alias("v"))), lambda x: ~x["f"].isin(*NO_LITERALS))
    named = F.filter(F.transform(bound, lambda x: x["v"]), lambda v: F.length(v) >= 2)
    quoted = F.transform(every("['\"]([^'\"]{1,64})['\"]", 1), lambda v: F.trim(v))
    ours = lambda m: (m["kind"] == "uppercase_token") | m["norm"].isin(*MESSAGE_TYPES) | m["norm"].rlike("^Z[A-Z0-9]{3,}$")
    marked = F.when(cue, F.transform(F.filter(symbol_matches(q), ours), lambda m: m["raw"])).otherwise(F.array().cast("array<string>"))
    found = F.concat(named, every(f"{EDGE}([0-9]{{3,}}){EDGE}", 1), quoted, marked)
    values = F.filter(F.array_distinct(found), lambda v: (F.length(v) >= 2) & ~F.upper(v).isin(*NO_LITERALS))
    fields = F.array_distinct(F.filter(F.transform(bound, lambda x: x["f"]), lambda f: f.isin(*BOUND_FIELDS)))
    known = (F.size(values) > 0) & (cue | ((F.size(fields) > 0) & q.rlike("(?i)fest|hart|code")))
    return F.struct(known.alias("is_literal"), values.alias("values"), fields.alias("fields"))
