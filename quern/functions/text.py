"""Text functions as Column expressions: folding, tokens, stems, n-grams, symbols, keys.

All are built from Spark's own functions, so they stay inside the generated code of a scan. Patterns spell out ASCII
classes instead of \\b and \\w, whose meaning differs between regex engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded to two letters, and accented letters with their base letters.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
ACCENTED = "àáâãåçèéêëìíîïñòóôõùúûýÿ"
BASE = "aaaaaceeeeiiiinoooouuuyy"

#: Function words that a query drops: this library's own list, a caller may give another.
STOPWORDS = (
    "der die das den dem des ein eine einer eines einem einen und oder aber wenn dann als wie was wer wo wann warum welche welcher welches "
    "ist sind war waren wird werden wurde kann können hat haben im in an am auf aus bei mit nach von vom zu zum zur für über unter durch um "
    "nicht auch nur noch es er sie wir ihr ich man alle the a an and or of to in on for with is are was be by from that this what which how where"
).split()

# Adjective endings in the order in which they are tried, and the roots after which they come off short words too.
ADJECTIVE_ENDINGS = ("es", "en", "em", "er", "e")
ADJECTIVE_ROOTS = ("uell", "isch", "iv", "ig", "lich")

# Endings that come off a topic's words, in the order in which they are tried.
TOPIC_ENDINGS = (
    "ischen", "lichem", "lichen", "liche", "isches", "ischer", "ische", "ischem", "ungen", "ung", "isch", "lich", "endes", "ende", "enden", "endem",
    "elles", "elle", "ellen", "ellem", "heit", "keit", "em", "en", "er", "es", "e", "s",
)

# Last parts of German compounds that are split off.
COMPOUND_TAILS = (
    "lager", "ort", "nummer", "schluessel", "schlüssel", "gruppe", "art", "typ", "status", "kennzeichen", "text", "name", "datum",
    "menge", "preis", "wert", "code", "klasse", "bereich", "stelle", "partner", "kunde", "material", "beleg", "position",
)

# Upper-case words that are no technical symbols.
NO_SYMBOLS = (
    "SAP", "ABAP", "API", "HTTP", "JSON", "XML", "PDF", "CSV", "URL", "ID", "UUID", "OK", "YES", "NO", "NULL", "TRUE", "FALSE", "SELECT", "FROM",
    "WHERE", "INTO", "TYPE", "DATA", "TABLE", "CLASS", "METHOD", "FUNCTION", "REPORT", "INCLUDE", "FORM", "ENDFORM", "ENDIF", "ELSE", "LOOP",
    "ENDLOOP", "APPEND", "CLEAR", "MOVE", "CALL", "EXPORT", "IMPORT", "READ", "WRITE", "CHECK", "MESSAGE", "RAISE", "RETURN",
)


def _plain_letters() -> dict[str, str]:
    """Letters with marks to those of their compatibility decomposition that are no marks, over the Latin blocks, the
    presentation forms and the full-width letters."""
    out = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF5B)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if bare != chr(point):
            out[chr(point)] = bare
    return out


PLAIN = _plain_letters()
#: Where a word of ASCII letters, digits and underscores begins or ends.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold_search(c: Column | str) -> Column:
    """ä to ae, ö to oe, ü to ue, ß to ss and accents off, lower-case letters only."""
    out = _text(c)
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, ACCENTED, BASE)


def fold_plain(c: Column | str) -> Column:
    """Lower case with marks off, as after a compatibility decomposition: ä to a, ﬁ to fi; ß to ss."""
    single = {k: v for k, v in PLAIN.items() if len(v) == 1}
    out = F.translate(_text(c), "".join(single), "".join(single.values()))
    for k, v in PLAIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.replace(F.lower(out), F.lit("ß"), F.lit("ss"))


def search_key(c: Column | str) -> Column:
    """Lower case first, then folded, for matching whole phrases."""
    return fold_search(F.lower(_text(c)))


def normal_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def bm25_tokens(c: Column | str) -> Column:
    """Folded before lower case, parted at anything but a-z, 0-9 and _, of two letters at least; repeats stay."""
    return F.filter(F.split(F.lower(fold_search(c)), "[^a-z0-9_]+"), lambda t: F.length(t) >= 2)


def search_tokens(c: Column | str) -> Column:
    """Distinct tokens of letters, digits and _-/ with their folded form, their parts of four letters or more and the form without separators."""
    words = F.array_distinct(F.filter(F.split(F.lower(_text(c)), "[^a-z0-9äöüßàáâãåçèéêëìíîïñòóôõùúûýÿ_/-]+"), lambda t: F.length(t) >= 2))

    def all_forms(own: Column) -> Column:
        # a word of plain letters is its own folded form, one without separators its own part
        parted = F.filter(own, lambda t: t.rlike("[_/-]"))
        parts = F.filter(F.flatten(F.transform(parted, lambda t: F.split(t, "[_/-]+"))), lambda t: F.length(t) >= 4)
        glued = F.transform(parted, lambda t: F.regexp_replace(t, "[_/-]+", ""))
        folded = F.transform(F.filter(own, lambda t: t.rlike("[^a-z0-9_/-]")), fold_search)
        return F.array_distinct(F.concat(own, folded, parts, glued))

    return once(words, all_forms)


def content_terms(c: Column | str) -> Column:
    """Distinct BM25 tokens without function words."""
    return F.array_distinct(F.filter(bm25_tokens(c), lambda t: ~t.isin(*STOPWORDS)))


def raw_words(c: Column | str) -> Column:
    """Words of letters (umlauts too), digits and _ / . - as they are written."""
    return F.filter(F.split(_text(c), "[^A-Za-zÄÖÜäöüß0-9_/.-]+"), lambda t: t != "")


def light_stem(c: Column | str) -> Column:
    """A folded word of four letters or more without its first adjective ending that leaves five letters, or four after
    an adjective's root; then, from six letters on, without a plural's s."""
    word, length = fold_plain(c), F.length(fold_plain(c))
    bare = []
    for ending in ADJECTIVE_ENDINGS:
        left = length - len(ending)
        root = F.substring(word, F.lit(1), left)
        fits = F.endswith(word, F.lit(ending)) & (left >= 4) & ((left >= 5) | root.rlike("(?:" + "|".join(ADJECTIVE_ROOTS) + ")$"))
        bare.append(F.when(fits, root))
    stem = F.coalesce(*bare, word)
    plural = (F.length(stem) >= 6) & stem.endswith("s") & ~stem.endswith("ss")
    return F.when(length < 4, word).when(plural, F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def compound_parts(c: Column | str) -> Column:
    """Distinct parts of a folded word: itself from four letters on, each tail with over three letters before it and what
    those are, and its separated parts of three letters or more."""
    word = fold_plain(c)
    tails = F.array(*map(fold_plain, map(F.lit, COMPOUND_TAILS)))
    hits = F.filter(tails, lambda t: F.endswith(word, t) & (F.length(word) > F.length(t) + 3))
    heads = F.transform(hits, lambda t: F.substring(word, F.lit(1), F.length(word) - F.length(t)))
    whole = F.filter(F.array(word), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.concat(whole, heads, hits, F.filter(F.split(word, "[_./-]+"), lambda p: F.length(p) >= 3)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: an expression that a lambda names is worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def firsts(rows: Column, key: str) -> Column:
    """Of an array of structs those that first have their key, in order; by sorting, so in time near to linear."""
    placed = F.array_sort(F.transform(rows, lambda r, i: F.struct(r[key].alias("k"), i.alias("i"), r.alias("r"))))
    marked = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
    kept = once(placed, marked)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r")))), lambda x: x["r"])


def char_trigrams(c: Column | str) -> Column:
    """Trigrams of the upper-case letters and digits, repeats included; shorter texts are their own."""
    bare = F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]", "")
    short = lambda t: F.filter(F.array(t), lambda x: x != "")
    # pieces of three letters from each of three starts, put side by side
    pieces = lambda t, start: F.regexp_extract_all(F.substring(t, start + 1, 1 << 30), F.lit("(...)"), F.lit(1))
    side = lambda t: F.zip_with(F.zip_with(pieces(t, 0), pieces(t, 1), lambda a, b: F.array(a, b)), pieces(t, 2), lambda ab, c: F.concat(ab, F.array(c)))
    woven = lambda t: F.filter(F.flatten(side(t)), lambda x: x.isNotNull())
    return once(bare, lambda t: F.when(F.length(t) >= 3, woven(t)).otherwise(short(t)))


def topic_stem(c: Column | str) -> Column:
    """A word's plain letters and digits without its first topic ending that leaves four or more; words under five stay."""
    word = F.regexp_replace(fold_plain(F.replace(_text(c), F.lit("ß"), F.lit(""))), "[^a-z0-9]+", "")
    length = F.length(word)
    cuts = (F.when(F.endswith(word, F.lit(e)) & (length >= 4 + len(e)), F.substring(word, F.lit(1), length - len(e))) for e in TOPIC_ENDINGS)
    return F.when(length < 5, word).otherwise(F.coalesce(*cuts, word))


def word_pairs(tokens: Column) -> Column:
    """Neighbouring tokens joined by a blank."""
    pairs = lambda t: F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return once(tokens, lambda t: F.when(F.size(t) >= 2, pairs(t)).otherwise(F.array().cast("array<string>")))


def normal_literal(c: Column | str) -> Column:
    """Digits without leading zeros, anything else in upper case."""
    t = F.trim(_text(c))
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(F.upper(t))


def same_value(a: Column, b: Column) -> Column:
    """Equal, equal but for case, or equal but for zero padding."""
    return normal_literal(a) == normal_literal(b)


def snippet(text: Column | str, term: Column) -> Column:
    """240 characters from 60 before the term, or the first 220 where it isn't found."""
    t = normal_space(text)
    at = F.instr(F.lower(t), F.lower(term))
    return F.when(at > 0, F.substring(t, F.greatest(F.lit(1), at - 60), F.lit(240))).otherwise(F.substring(t, 1, 220))


# Patterns of technical symbols: a path of class and method, a table and its field, names of the customer's own, words in upper case.
PATH = f"{EDGE}([A-Z][A-Z0-9_/]{{2,}})\\s*(?:=>|->)\\s*([A-Z][A-Z0-9_~/]{{2,}}){EDGE}"
FIELD_OF = f"{EDGE}([A-Z][A-Z0-9_]{{2,}})\\s*[-.]\\s*([A-Z][A-Z0-9_]{{2,}}){EDGE}"
CUSTOM = f"{EDGE}([ZzYy]{{1,2}}_?[A-Za-z0-9_]{{2,}}){EDGE}"
UPPER = f"{EDGE}([A-Z][A-Z0-9_]{{2,}}){EDGE}"


def symbol_matches(c: Column | str) -> Column:
    """Technical symbols as (norm, kind, raw), each once with the kind that comes first and as it is first written: paths of
    class and method with both names, pairs of table and field with both, Z and Y names in any case, upper-case words of
    four letters or with a digit. Words of NO_SYMBOLS are none."""
    t = _text(c)
    groups = lambda p, *which: [F.regexp_extract_all(t, F.lit(p), F.lit(g)) for g in which]
    path, pair = groups(PATH, 0, 1, 2), groups(FIELD_OF, 1, 2)
    joined = F.zip_with(*pair, lambda a, b: F.concat_ws("-", a, b))
    upper = F.filter(groups(UPPER, 1)[0], lambda w: (F.length(w) >= 4) | w.rlike("[0-9]"))
    families = ((path[0], "method_path"), (F.concat(path[1], path[2]), "uppercase_token"), (joined, "compound_field"), (F.concat(*pair), "uppercase_token"), (groups(CUSTOM, 1)[0], "zy_name"), (upper, "uppercase_token"))
    of_kind = lambda names, kind: F.transform(names, lambda w: F.struct(F.upper(F.trim(w)).alias("norm"), F.lit(kind).alias("kind"), F.trim(w).alias("raw")))
    found = F.filter(F.concat(*(of_kind(*family) for family in families)), lambda m: ~m["norm"].isin(*NO_SYMBOLS))
    return firsts(found, "norm")


def symbols(c: Column | str) -> Column:
    """Names of symbol_matches, longest first, then by name."""
    keyed = F.array_sort(F.transform(symbol_matches(c), lambda m: F.struct((-F.length(m["norm"])).alias("l"), m["norm"].alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def is_custom_name(c: Column | str) -> Column:
    """Whether a field name is in the customer's own name space."""
    return F.upper(_text(c)).rlike("^(Z|Y)|_Z|^/")


def search_document_id(*keys: Column) -> Column:
    return F.concat(F.lit("sd_"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 32))


def key_value_map(c: Column | str) -> Column:
    """k=v;k=v as a map; the last of equal keys counts, blanks around keys and values don't."""
    entries = F.transform(F.filter(F.split(_text(c), ";"), lambda e: e.contains("=")), lambda e: F.struct(F.trim(F.substring_index(e, "=", 1)).alias("k"), F.trim(F.regexp_replace(e, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(F.reverse(firsts(F.reverse(entries), "k")))


def source_key_part(c: Column | str, kind: Column | str) -> Column:
    """The part after the type token of a pipe-separated source key; null without one."""
    parts = F.split(_text(c), r"\|")
    at = F.array_position(parts, F.lit(kind) if isinstance(kind, str) else kind)
    return F.when((at > 0) & (at < F.size(parts)), F.element_at(parts, (at + 1).cast("int")))


def drop_prefixes(terms: Column) -> Column:
    """Distinct terms that don't begin a longer one of the same list; those under four letters stay. In sorted order, what a
    term begins follows it."""
    begins = lambda s: F.filter(s, lambda t, i: (F.length(t) >= 4) & F.coalesce(F.startswith(F.get(s, i + 1), t), F.lit(False)))
    return once(terms, lambda t: F.array_except(t, once(F.array_sort(F.array_distinct(t)), begins)))


def search_text(sections: dict[str, Column]) -> Column:
    """Named sections, one line each, those without content left out."""
    return F.concat_ws("\n", *(F.when(F.length(F.trim(_text(c))) > 0, F.concat(F.lit(f"{name}: "), F.trim(_text(c)))) for name, c in sections.items()))


def first_filled(values: Column, *aliases: str) -> Column:
    """Of a map, the first value of the aliases that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.element_at(values, F.lit(a))), F.lit("")) for a in aliases))
