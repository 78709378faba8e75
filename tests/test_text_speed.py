"""Text functions take time in proportion to a text's length."""

import time

import pytest
from pyspark.sql import functions as F

from quern.functions import question
from quern.functions import text as X

LONG = " ".join(f"ZWORT{i % 15_000}_x TAB{i % 9000}-FIELD{i % 17} wert{i % 19_000}" for i in range(7000))
CASES = {
    "word_pairs": lambda c: X.word_pairs(X.bm25_tokens(c)),
    "content_terms": X.content_terms,
    "search_tokens": X.search_tokens,
    "char_trigrams": X.char_trigrams,
    "symbol_matches": X.symbol_matches,
    "symbols": X.symbols,
    "key_value_map": lambda c: X.key_value_map(F.regexp_replace(c, " ", "=1;")),
    "drop_prefixes": lambda c: X.drop_prefixes(F.array_distinct(F.split(c, " "))),
    "literals": question.literals,
}


@pytest.mark.parametrize("name", CASES)
def test_long_texts(spark, name):
    """21,000 words in one text; what looks at each word for each word takes minutes."""
    rows = spark.createDataFrame([(LONG + " hart codiert",)], "v string")
    began = time.perf_counter()
    rows.select(CASES[name](F.col("v")).alias("x")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 20


def test_small_results(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()[0]

    v = F.col("v")
    assert one(X.word_pairs(F.split(v, " ")), "a b c") == ["a b", "b c"] and one(X.word_pairs(F.split(v, " ")), "a") == []
    for t in ("", "a", "ab", "abc", "abcd", "a-b c,d e", "abcdefg", None):
        bare = "".join(c for c in (t or "").upper() if c.isalnum())
        assert one(X.char_trigrams(v), t) == ([bare[i : i + 3] for i in range(len(bare) - 2)] if len(bare) >= 3 else [bare] * bool(bare))
    assert one(X.key_value_map(v), "b=1;a=2;b=3;=4;c") == {"b": "3", "a": "2", "": "4"}
    assert one(X.drop_prefixes(F.split(v, " ")), "kundennummer kunde kun kunde art kundennummern") == ["kun", "art", "kundennummern"]
    found = one(X.symbol_matches(v), "zmat1 ZMAT1 CL_A=>RUN VBAK-VKORG")
    assert [(m.norm, m.kind, m.raw) for m in found] == [("CL_A=>RUN", "method_path", "CL_A=>RUN"), ("CL_A", "uppercase_token", "CL_A"), ("RUN", "uppercase_token", "RUN"), ("VBAK-VKORG", "compound_field", "VBAK-VKORG"), ("VBAK", "uppercase_token", "VBAK"), ("VKORG", "uppercase_token", "VKORG"), ("ZMAT1", "zy_name", "zmat1")]


def test_search_tokens_cut_a_text_once(spark):
    df = spark.createDataFrame([("Größe aa_bbbb/größe x aa_bbbb a- -/ ÄB aa_bbbb",), (None,)], "t string").select(X.search_tokens("t").alias("t"))
    assert [r.t for r in df.collect()] == [["größe", "aa_bbbb/größe", "aa_bbbb", "a-", "-/", "äb", "groesse", "aa_bbbb/groesse", "aeb", "bbbb", "aabbbbgröße", "aabbbb", "a", ""], []]
    assert df._jdf.queryExecution().analyzed().toString().count("split(lower(") == 1
