import random
import re
import zlib

from pyspark.sql import functions as F

from quern.llm import spelling as S


def plain_words(rows):
    counts = {}
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = "".join(c for k, c in enumerate(r) if k != h % len(r))
            if len(r) >= 7:
                counts[r] = counts.get(r, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(rows):
    n = plain_words(rows)
    letters = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))}
        near |= {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        near = [x for x in near if x in n and x != w]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, len(near)]

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


ROWS = [
    (1, "spelling " * 2000 + "speling " * 150 + "spellling " * 12 + "speeling " * 3 + "spelings spelings "),
    (2, "Überraschung ÜBERRASCHUNG überraschung überraschungx÷y überraschungx÷y"),
    (3, "aabbccdd aabbccdd aabbccddd aabbccddd aaabbccdd aaabbccdd abbccddx abbccddx abababab abababab babababa babababa"),
    (4, None),
    (5, ""),
    (None, "spelling lonely-word lonelyword lonelyword"),
    (None, "spelling"),
    (6, "q" * 900 + " " + "q" * 900 + " " + "q" * 899 + " " + "q" * 899),
    (6, "triangle integral altering relating triangle integral altering relating alertine alertine"),
    (1, "spelling " * 5 + "SPELLING-spelling2spelling"),
    *((i, " ".join(f"commoned{c} commoned{c}" for c in "abcdefghijklmnopqrstuvwxyz") + " commoned commoned") for i in range(20, 60)),
]


def test_equals_plain_version(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, word string").repartition(5)
    assert rows_of(S.variants(df)) == plain_variants(ROWS)


def test_given_table_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(S.variants(docs)) == plain_variants(rows)


def test_values_have_distinct_differences(spark):
    found = spark.createDataFrame([(c,) for c in S.LETTERS], "c string").select("c", S.value_of(F.col("c")).alias("v")).collect()
    values = [v for _, v in found]
    differences = [a - b for a in values for b in values if a != b]
    assert len(set(values)) == 90 and len(set(differences)) == len(differences) and not set(values) & set(differences)


def test_key_is_that_of_anagrams(spark):
    made = spark.createDataFrame([("triangle",), ("integral",), ("trianglé",), ("",)], "w string").select(S.key_of(F.col("w")).alias("k")).collect()
    assert made[0].k == made[1].k == sum((ord(c) - 96) ** 5 for c in "triangle") and made[2].k != made[0].k and made[3].k == 0


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 3)
    df = spark.createDataFrame([(i, t) for i, t in ROWS[:6]], "doc_id long, text string").coalesce(1)
    assert {r.word: r.n for r in S.word_counts(df).collect()} == plain_words(ROWS[:6])


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_words(spark):
    rows = [(1, "q" * 30_000 + " " + "q" * 30_000 + " " + "q" * 29_999 + " " + "q" * 29_999)]
    assert plain_words(rows) == {"q" * 30_000: 2, "q" * 29_999: 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((len(r.word), r.form, r.n, r.n_near) for r in S.variants(df).collect()) == [(29_999, None, 2, 1), (30_000, None, 2, 1)]


def test_anagrams_under_one_key_make_no_pairs(spark):
    """Thousands of words under one key: only near ones are paired."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3000)}
    text = " ".join(w for w in words for _ in range(2))
    rows = [(31, text)]
    found = S.word_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert S.near_pairs(found).count() < 200 and found.count() > 2500


def test_no_table_goes_to_the_driver(spark, monkeypatch):
    """Joins of small tables are merges too: estimates don't count letters that a word is exploded into."""
    plans, keep = [], S.materialize
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, name):
        plans.append(shown(df))
        return keep(df, name)

    monkeypatch.setattr(S, "materialize", seen)
    found = S.variants(spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string"))
    assert rows_of(found) == plain_variants(ROWS)
    plans.append(shown(found))
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p] and sum(p.count("SortMergeJoin") for p in plans) >= 6
