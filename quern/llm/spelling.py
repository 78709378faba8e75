"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters' numbers, the same for all its anagrams. Words that differ by
one letter have keys that differ by that letter's value, or by the difference of two values where it was exchanged. Each
word therefore hands in its key less the value of each of its letters: the word without that letter has this key (it was
added or removed), and so does, less one of its own letters, each word in which that letter was exchanged. Values are
fifth powers, whose differences are all distinct, so a pair of words meets under one key.

Random texts have thousands of words under one key, of which few are near. So the order of letters is verified where keys
meet: beside the key, words hand in a hash of what stays without the letter and the letter's place, and equal keys are
joined with these. At most 90 words, the size of the alphabet, share all three, and they all are near each other, so a
group's pairs are its result. Pairs count once the words themselves are compared.

All joins are merges: Spark takes a table for as small as its compressed files, and rows exploded from it for no more than
these, so that it would send ten letters a word to the driver as one table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, texts
from quern.llm.simhash import LOWER

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
POWER = 5
RUNS = "[A-Za-zÀ-ÿ]"
#: Fixed values of the contract: one run in EVERY loses a letter; words have LEAST letters and TWICE occurrences at least.
EVERY, LEAST, TWICE, TIMES = 31, 7, 2, 10
#: Words that a task counts before it hands them on, and texts that it takes at a time.
HELD, TEXTS = 1 << 16, 256


def damaged(doc_id: int | None, run: str, every: int = EVERY) -> str:
    """The run, without one letter if the checksum of document and run says so. A null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST, twice: int = TWICE, every: int = EVERY) -> DataFrame:
    """(word, n, id): the runs of letters of all whole texts, as `damaged` gives them, of `least` letters and `twice` occurrences
    or more. Tasks count what they read; a task's memory is bounded by HELD words and one text's."""
    runs = re.compile(f"{RUNS}{{{least},}}")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for batch in (b.slice(a, TEXTS) for b in source for a in range(0, b.num_rows, TEXTS)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for found, n in Counter(runs.findall(text.translate(LOWER).decode())).items():
                    word = damaged(doc_id, found, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    counted = texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= twice).withColumn("id", F.monotonically_increasing_id()), "spelling-words")


def value_of(letter: Column) -> Column:
    """A letter's value: its number in LETTERS, from 1, to the POWER."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 128, code - (ord("a") - 1)).otherwise(code - (0xC0 - 27))
    out = number
    for _ in range(POWER - 1):
        out = out * number
    return out


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def key_of(word: Column) -> Column:
    """The sum of the values of a word's letters."""
    return F.aggregate(letters_of(word), F.lit(0).cast("long"), lambda total, c: total + value_of(c))


def one_apart(x: Column, y: Column) -> Column:
    """Whether the letters, in their order, differ by exactly one inserted, deleted or replaced letter."""
    return F.levenshtein(x, y, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(x, y): ids of words of (word, id) that meet under a key, each pair once: y is x without a letter, or both are alike
    without the letter at one place."""
    own = words.select("id", "word", key_of(F.col("word")).alias("key"))
    each = own.select("id", "word", "key", F.posexplode(letters_of(F.col("word"))).alias("before", "letter"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("before")), F.substring("word", F.col("before") + 2, F.length("word")))
    first = (F.col("before") == 0) | (F.substring("word", F.col("before"), F.lit(1)) != F.col("letter"))
    less = each.select((F.col("key") - value_of(F.col("letter"))).alias("key"), F.xxhash64(rest).alias("rest"), "id", F.col("before").alias("at"), first.alias("first")).repartition("key", "rest")
    # of a run of equal letters, one is enough to be removed
    removed = less.filter("first").join(own.select("key", F.xxhash64("word").alias("rest"), F.col("id").alias("y")).hint("merge"), ["key", "rest"]).select(F.col("id").alias("x"), "y")
    alike = less.groupBy("key", "rest", "at").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: a < b), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    return removed.unionByName(alike.select(F.inline(pairs)))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where (word, form) leads in the end. Each round doubles the steps; occurrences grow with each step, so
    there is no circle."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = materialize(stepped, "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all whole texts.

    Words are those of word_counts. Near are words that differ by exactly one inserted, deleted or replaced letter. form
    is the near word with most occurrences (of equal ones the first in code-point order) if it has `times` as many, else
    null; root is where forms lead, the word itself without one. Null and empty texts have no words, rows that repeat a
    doc_id are all read, a null doc_id is written as nothing. An empty table gives an empty result.
    """
    words = word_counts(docs, least, twice, every)
    pairs = materialize(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    near = both.join(words.select(F.col("id").alias("y"), F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "y").select(F.col("x").alias("id"), "other", "other_n")
    near = near.join(words.select("id", "word").hint("merge"), "id").filter(one_apart(F.col("word"), F.col("other")))
    best = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("y"))).alias("best"))
    chosen = F.coalesce(-F.col("best.n") >= F.col("n") * times, F.lit(False))
    formed = materialize(words.join(best.hint("merge"), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.y")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = last_forms(formed.filter("form is not null"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
