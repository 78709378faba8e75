"""PII: detected entities get keyed, type-consistent surrogates. DataFrame and SQL functions only.

Detection is one pass of one alternation with a named group for each type; a replacement writes a mark around each match
and says which group matched, so the type is never guessed from the string, and splitting at the marks leaves what lies
between as it is. Labels of secrets and forms of address are context and stay. Each match becomes one part (a name: one
part a word) with a canonical form, so that "+1 (555) 010-2030" and "+1 555-010-2030" are one entity. Each distinct
(type, canonical form) gets a surrogate from SHA-256 of key, type, form and attempt, made to match what it replaces:
digits for digits and letters of the same script and case, valid check digits for card and account numbers, octets for
addresses (private ones stay private, others become ones that nobody has), one surrogate name below a reserved domain
for a domain, and for names syllables of the same script with an ending of the same
gender. A surrogate that another entity of the type already has, or that is itself an entity of the corpus, is made anew
with the next attempt until none is left, so distinct entities stay distinct and the same entity always gets the same
surrogate. A word of a name is replaced wherever else the same text has it, in any case and without a form of address too, unless it
is one of OTHER_WORDS ("Mrs May came in May").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import lookup_join, materialize

# Forms of address by gender; the last don't tell.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "господин", "Господин", "κύριος", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Signora", "госпожа", "Госпожа", "κυρία", "Κυρία")
NEUTRAL = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Professore", "доктор", "Доктор", "профессор", "Профессор")
# Alphabets from which surrogates are made: consonants, vowels, and endings of names by gender (n: not told).
SCRIPTS = {
    "Latin": ("bcdfghjklmnprstvz", "aeiou", {"m": "nrsk", "f": "aei", "n": "lxyo", "s": "nrtz"}),
    "Cyrillic": ("бвгджзклмнпрстфх", "аеиоу", {"m": "нрск", "f": "аия", "n": "лйюо", "s": "внкр"}),
    "Greek": ("βγδζθκλμνπρστφχ", "αεηιου", {"m": "ςνρκ", "f": "αηω", "n": "οξιυ", "s": "ςνκρ"}),
}
TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
WORD = rf"(?!(?:{TITLES})\b)\p{{Lu}}(?:['’]\p{{Lu}})?[\p{{L}}\-]{{1,30}}"
# What introduces a name without a form of address.
CUES = "my name is|mein name ist|ich heiße|ich heisse|je m'appelle|mon nom est|me llamo|mi nombre es|mi chiamo|il mio nome è"
# Words that are names and, more often, something else: only a form of address tells.
OTHER_WORDS = (
    "January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril juin juillet août octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag "
    "will mark rose brown green white black gray grey young long short rich king price hope grace faith summer winter"
).lower().split()
LABELS = r"token|password|passwd|pwd|passphrase|secret|api[_\-]?key|secret[_\-]?key|access[_\-]?key|private[_\-]?key"
#: Type and pattern, the first that matches counts. Groups "label" and "title" are context.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])(?<email>[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63})*\.\p{L}{2,24})",
    "accesskey": r"\b(?<accesskey>AKIA[0-9A-Z]{16})\b",
    "secret": rf"(?<label>(?<![\p{{L}}\p{{N}}])(?i:[a-z0-9]{{1,20}}[_\-]){{0,3}}(?i:{LABELS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)(?<secret>(?<=\")[^\"\r\n\uffff\ufffe]++(?=\")|(?<=')[^'\r\n\uffff\ufffe]++(?=')|(?:[^\s.,;:!?)\]}}\uffff\ufffe]++|[.,;:!?)\]}}]{{1,8}}+(?=[^\s.,;:!?)\]}}]))++={{0,2}})",
    "iban": r"\b(?<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ssn": r"(?<![\p{L}\p{N}\-])(?<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\p{L}\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}+])(?<phone>\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[.\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}\-])(?<card>[0-9](?:[ \-]?[0-9]){12,18})(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{N}.])(?<ip>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?!\.?\p{N})",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]*[0-9])(?<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "name": rf"(?<title>(?<![\p{{L}}\p{{N}}])(?:(?:(?:{TITLES})(?:\.\s?|\s)){{1,3}}|(?i:{CUES})\s))(?<name>{WORD}(?: {WORD}){{0,2}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity holds; the rest skips the alternation. Labels are looked for where a colon or an equals sign is.
TRIGGER = rf"[0-9A-Fa-f]:(?=:|[0-9A-Fa-f]{{1,4}}:)|(?i:{CUES})\s|[0-9](?:[0-9.\-() ]{{5}}|(?<=[A-Z]{{2}}[0-9]))|@|AKIA|[=:](?<=(?i:{LABELS})[\"']?\s{{0,3}}[=:])|(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?<![\p{{L}}\p{{N}}])(?:{TITLES})[.\s]"
#: Addresses of private networks and of the machine itself, whose surrogates are in 10.0.0.0/8; those of others are in 240.0.0.0/4, which nobody has.
PRIVATE = "^(10[.]|127[.]|192[.]168[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.])"
KEY = "quern-surrogates"
FILLED = ("phone", "card", "ssn", "iban")
#: Between the fields of a match; no character of any text, nor part of one.
FIELD = "\ufffe"
FIELDS = (*PATTERNS, "title")
#: Where words of letters begin and end.
WORD_EDGE = r"(?<![\p{L}\p{N}\-])(?=\p{L})|(?<=[\p{L}\p{N}])(?![\p{L}\p{N}\-])"


def mark_of(text: str) -> Column:
    """Written around matches: a noncharacter and the text's own hash, so that no text can hold its mark."""
    return F.concat(F.lit("\uffff"), F.hex(F.xxhash64(text)))


def pieces_of(text: str) -> Column:
    """A text cut at its matches: even pieces lie between them, odd ones are fields, of which the type's own isn't empty."""
    mark = mark_of(text)
    fields = [F.lit(f"${{{f}}}" + (FIELD if f != FIELDS[-1] else "")) for f in FIELDS]
    marked = F.regexp_replace(F.col(text), F.lit(ANY), F.concat(F.lit("${label}${title}"), mark, *fields, mark))
    return F.when(F.col(text).rlike(TRIGGER), F.split(marked, mark, -1)).otherwise(F.array(text))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: str) -> Column:
    """Whether a digit string (an SQL expression) passes the card checksum."""
    term = "IF(i % 2 = 0, int(c), IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))"
    return F.expr(f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> {term}), 0, (a, x) -> a + x) % 10 = 0")


def iban_valid(account: str) -> Column:
    """Whether an account number (an SQL expression, without blanks) passes its checksum."""
    moved = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    return F.expr(f"aggregate(filter(split({moved}, ''), c -> c <> ''), 0, (a, c) -> IF(c RLIKE '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1")


def matches_of(pieces: DataFrame) -> DataFrame:
    """(row, pieces) to one row a match: row, at, raw, type, title. A card or account number that fails its checksum is none,
    nor is a secret without letter or digit."""
    found = pieces.select("row", F.posexplode(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.split(p, FIELD, -1)))).alias("at", "fields")).filter("fields is not null")
    kinds = F.array(*map(F.lit, PATTERNS))
    place = F.expr(f"int(array_position(transform(slice(fields, 1, {len(PATTERNS)}), x -> x <> ''), true))")
    typed = found.select("row", "at", F.element_at("fields", place).alias("raw"), F.element_at(kinds, place).alias("type"), F.element_at("fields", F.lit(len(FIELDS))).alias("title"))
    card, iban = luhn("regexp_replace(raw, '[^0-9]', '')"), iban_valid("replace(raw, ' ', '')")
    return typed.filter(F.when(F.col("type") == "card", card).when(F.col("type") == "iban", iban).when(F.col("type") == "secret", F.col("raw").rlike(r"[\p{L}\p{N}]")).otherwise(True))


def parts_of(found: DataFrame) -> DataFrame:
    """Matches to one row a part: part, word, kind, canon. Names have a part for each word. A word whose form of address
    doesn't tell its gender has that of another mention in the same text."""
    told = F.regexp_extract_all("title", F.lit(r"[\p{L}]+"), F.lit(0))
    gender = F.when(F.arrays_overlap(told, F.array(*map(F.lit, MALE))), "m").when(F.arrays_overlap(told, F.array(*map(F.lit, FEMALE))), "f")
    words = F.when(F.col("type") == "name", F.split("raw", " ")).otherwise(F.array("raw"))
    out = found.select("*", gender.alias("gender"), F.size(words).alias("parts"), F.posexplode(words).alias("part", "word"))
    last = F.col("part") == F.col("parts") - 1
    anywhere = F.max("gender").over(Window.partitionBy("row", "type", F.lower("word")))
    script = F.when(F.col("word").rlike(r"\p{IsCyrillic}"), "Cyrillic").when(F.col("word").rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    kind = F.when(F.col("type") == "name", F.concat_ws("_", F.lit("name"), F.when(last, "s").otherwise(F.coalesce("gender", anywhere, F.lit("n"))), script)).otherwise(F.col("type"))
    canon = F.when(F.col("type").isin("accesskey", "secret"), F.col("word")).when(F.col("type").isin(*FILLED), F.upper(F.regexp_replace("word", "[^A-Za-z0-9]", ""))).otherwise(F.lower("word"))
    return out.withColumn("kind", kind).withColumn("canon", canon)


def _stream(of: str) -> str:
    """192 hex digits keyed by an SQL expression."""
    return "concat(" + ", ".join(f"sha2(concat({of}, '|{n}'), 256)" for n in range(3)) + ")"


def _byte(i: str) -> str:
    return f"int(conv(substr(stream, 1 + (2 * ({i})) % 190, 2), 16, 10))"


def _like(text: str, offset: int = 0) -> str:
    """Characters of the same class as those of an SQL expression."""
    b = _byte(f"i + {offset}")
    classes = [("[0-9]", "0123456789")]
    for consonants, vowels, _ in SCRIPTS.values():
        letters = "".join(sorted(consonants + vowels))
        classes += [(f"[{letters}]", letters), (f"[{letters.upper()}]", letters.upper())]
    classes += [(r"\\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\\p{L}", "abcdefghijklmnopqrstuvwxyz")]
    cases = " ".join(f"WHEN c RLIKE '{p}' THEN substr('{a}', 1 + {b} % {len(a)}, 1)" for p, a in classes)
    return f"array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> CASE {cases} ELSE c END), '')"


def _hexlike(text: str) -> str:
    return f"IF({text} RLIKE '^[0-9a-f]+$', substr(concat(stream, reverse(stream)), 1, length({text})), {_like(text)})"


def _syllables(kind: str) -> str:
    cases = []
    for script, (consonants, vowels, endings) in SCRIPTS.items():
        for gender, ends in endings.items():
            sound = f"array_join(transform(sequence(0, 1 + least(attempt, 6) + {_byte('0')} % 2), i -> concat(substr('{consonants}', 1 + {_byte('2 * i + 1')} % {len(consonants)}, 1), substr('{vowels}', 1 + {_byte('2 * i + 2')} % {len(vowels)}, 1))), '')"
            cases.append(f"WHEN {kind} = 'name_{gender}_{script}' THEN concat({sound}, substr('{ends}', 1 + {_byte('40')} % {len(ends)}, 1))")
    return "CASE " + " ".join(cases) + " END"


def _card(digits: str) -> str:
    """The first digit stays; the last makes the checksum right."""
    body = f"concat(substr({digits}, 1, 1), {_like(f'substr({digits}, 2, length({digits}) - 2)')})"
    doubled = "IF(i % 2 = 0, IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))"
    total = f"aggregate(transform(split(reverse({body}), ''), (c, i) -> {doubled}), 0, (a, x) -> a + x)"
    return f"concat({body}, (10 - {total} % 10) % 10)"


def _iban(account: str) -> str:
    """Country and length stay; the check digits are right."""
    body = _like(f"substr({account}, 5)")
    remainder = f"aggregate(filter(split(concat(body, substr({account}, 1, 2), '00'), ''), c -> c <> ''), 0, (a, c) -> IF(c RLIKE '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))"
    return f"transform(array({body}), body -> concat(substr({account}, 1, 2), lpad(98 - {remainder}, 2, '0'), body))[0]"


def surrogate_column() -> str:
    """The surrogate of (kind, canon, stream, domain stream, attempt), in canonical form."""
    octets = [f"1 + (256 * {_byte(str(2 * k))} + {_byte(str(2 * k + 1))}) % 254" for k in range(4)]
    private = f"canon RLIKE '{PRIVATE}' AND attempt < 8"
    octet = f"concat_ws('.', IF({private}, 10, 240 + {octets[0]} % 15), {', '.join(octets[1:])})"
    groups = f"array_join(transform(filter(split(canon, ''), c -> c <> ''), (c, i) -> IF(c = ':', c, substr('0123456789abcdef', 1 + {_byte('i')} % 16, 1))), '')"
    octets6 = f"concat(IF(canon RLIKE '^f[cde]', substring_index(canon, ':', 1), '2001'), substr({groups}, 1 + length(substring_index(canon, ':', 1))))"
    local, domain = "substring_index(canon, '@', 1)", "substring_index(canon, '@', -1)"
    top = f"substring_index({domain}, '.', -1)"
    label = f"substr({domain}, 1, length({domain}) - length({top}) - 1)"
    # example.com, .org and .net are reserved: nothing sent there arrives
    bare = f"regexp_replace({label}, '(?:^|[.])example$', '')"
    reserved = f"concat('example.', IF({top} IN ('com', 'org', 'net'), {top}, 'com'))"
    email = f"concat({_like(local)}, IF(attempt > 3, concat('.', substr(stream, 150, attempt)), ''), '@', IF({bare} = '', '', concat({_like(bare).replace('substr(stream,', 'substr(domain_stream,')}, '.')), {reserved})"
    secret = f"concat({_hexlike('canon')}, IF(attempt > 2, substr(stream, 100, attempt), ''))"
    phone = f"concat(substr(canon, 1, 1), {_like('substr(canon, 2)')})"
    key = f"concat('AKIA', {_like('substr(canon, 5)')})"
    return f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {octet} WHEN 'ip6' THEN {octets6} WHEN 'card' THEN {_card('canon')} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {_like('canon')} WHEN 'iban' THEN {_iban('canon')} WHEN 'accesskey' THEN {key} WHEN 'secret' THEN {secret} ELSE {_syllables('kind')} END"


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, ...) with surrogate."""
    seed = f"concat_ws('|', {_sql(key)}, kind, canon, attempt)"
    domain = f"concat_ws('|', {_sql(key)}, 'domain', substring_index(canon, '@', -1))"
    staged = entities.withColumn("stream", F.expr(_stream(seed))).withColumn("domain_stream", F.expr(_stream(domain)))
    return staged.withColumn("surrogate", F.expr(surrogate_column())).drop("stream", "domain_stream")


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """A surrogate for each distinct (kind, canon, n), no two of a kind alike and none an entity itself.

    Each round keeps what has no collision, of colliding ones the first by canon, and tries the others again: only those are
    written once more. Secrets grow with the attempts, names and mail addresses too, so their space never ends; a form
    whose whole space is taken by entities of the corpus can't end and raises after 40 rounds.
    """
    real = entities.select("kind", F.col("canon").alias("surrogate")).distinct()
    pending, kept = entities.select("kind", "canon", "n"), None
    for attempt in range(41):
        tried = materialize(with_surrogate(pending.withColumn("attempt", F.lit(attempt)), key), "surrogates")
        first = tried.join(real, ["kind", "surrogate"], "left_anti")
        if kept is not None:
            first = first.join(kept, ["kind", "surrogate"], "left_anti")
        first = first.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = materialize(tried.join(first, ["kind", "surrogate", "canon"]).select(*tried.columns), "surrogates-kept")
        kept = good if kept is None else kept.unionByName(good)
        pending = tried.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "n")
        if pending.isEmpty():
            return kept
    raise ValueError("some surrogates still collide")


def rendered() -> Column:
    """A surrogate in the form of the word it replaces."""
    fill = "array_join(transform(filter(split(word, ''), c -> c <> ''), (c, i) -> IF(c RLIKE '[A-Za-z0-9]', substr(surrogate, 1 + length(regexp_replace(substr(word, 1, i), '[^A-Za-z0-9]', '')), 1), c)), '')"
    upper = (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word"))
    cased = F.when(F.col("kind").isin("accesskey", "secret"), F.col("surrogate")).when(upper & (F.length("word") > 1), F.upper("surrogate"))
    return F.when(F.col("kind").isin(*FILLED), F.expr(fill)).otherwise(cased.when(F.col("kind").startswith("name_"), F.initcap("surrogate")).otherwise(F.col("surrogate")))


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entity_types (sorted) for every row of docs, whole texts.

    n_entities counts detected matches; later bare mentions of a name are replaced too and not counted. Null and empty
    texts give an empty text with no entity. Every text is matched once and written once, cut at its matches; of that,
    only texts with an entity are shuffled. Rows that repeat a doc_id are replaced each on its own. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = rows.select("doc_id", pieces_of("text").alias("pieces"))
    texts = materialize(cut.withColumn("row", F.when(F.size("pieces") > 1, F.expr("uuid()"))), "pii-texts")
    hit = texts.filter("row is not null")
    parts = materialize(parts_of(matches_of(hit)), "pii-parts")
    counts = parts.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n"))
    table = assign(materialize(counts, "pii-entities"), key)
    named = lookup_join(parts, table.select("kind", "canon", "n", "surrogate"), ["kind", "canon"], "n", parts.count())
    named = materialize(named.withColumn("new", rendered()), "pii-replaced")
    news = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "part", "new", "type"))).alias("news"))
    bare = named.filter((F.col("type") == "name") & ~F.lower("word").isin(*OTHER_WORDS)).groupBy("row", F.lower("word").alias("low")).agg(F.min_by(F.lower("new"), F.struct("at", "part")).alias("new"))
    bare = bare.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("low", "new"))).alias("bare"))
    # the k-th match's parts; where there are none, it was no entity and stays. Fields are empty but for one and the title.
    own = "filter(news, x -> x.at = i)"
    raw = f"array_join(slice(split(p, '{FIELD}', -1), 1, {len(PATTERNS)}), '')"
    cased = "CASE WHEN w = lower(w) THEN bare[lower(w)] WHEN w = upper(w) AND length(w) > 1 THEN upper(bare[lower(w)]) ELSE initcap(bare[lower(w)]) END"
    between = f"IF(bare is null, p, array_join(transform(split(p, {_sql(WORD_EDGE)}, -1), w -> coalesce({cased}, w)), ''))"
    rebuilt = f"array_join(transform(pieces, (p, i) -> IF(i % 2 = 0, {between}, IF(size({own}) = 0, {raw}, array_join(transform({own}, x -> x.new), ' ')))), '')"
    joined = hit.join(news, "row", "left").join(bare, "row", "left").withColumn("news", F.coalesce("news", F.expr("cast(array() as array<struct<at:int,part:int,new:string,type:string>>)")))
    done = joined.select("doc_id", F.expr(rebuilt).alias("text"), F.expr("size(array_distinct(news.at))").alias("n_entities"), F.expr("array_sort(array_distinct(transform(news.type, t -> IF(t = 'accesskey', 'access_key', t))))").alias("entity_types"))
    clean = texts.filter("row is null").select("doc_id", F.element_at("pieces", 1).alias("text"), F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("entity_types"))
    return clean.unionByName(done)
