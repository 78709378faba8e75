import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import lexicon as L

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    tokenizer = L.WordTokenizer(PATH)
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(L.compile_lexicon({w: tokenizer.merge(w) for w in (b"the", b"then", b"hen", b"cats", b"bats", b"caf\xc3\xa9")}))
    return L.Encoder(PATH, str(path))


LIBRARY = Tokenizer.from_file(PATH)


def same(encoder, text):
    ids, decoded = encoder(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("theCATSñé ,.'12\n\t ΣİǅﬁÁ<|>日😀\x1c")), max_size=40))
def test_texts_equal_library(encoder, text):
    same(encoder, text)


@pytest.mark.parametrize("text", ["", "  ", "<|endoftext|>the<|startoftext|> Then", "DON'T we'll 'S", "x" * 3000, "ΑΣ ΟΔΟΣ", "١٢٣ ½"])
def test_odd_texts_equal_library(encoder, text):
    same(encoder, text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 60_000), min_size=1, max_size=4), max_size=60), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon_holds_its_words_and_no_other(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("l") / "x.bin"
    path.write_bytes(L.compile_lexicon(entries))
    lexicon = L.Lexicon(str(path))
    assert all(lexicon.lookup(w) == ids for w, ids in entries.items())
    assert all(lexicon.lookup(w) is None for w in others if w not in entries)


def test_suffixes_share_states(tmp_path):
    words = {a + b: [1] for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing")}
    (tmp_path / "x").write_bytes(L.compile_lexicon(words))
    assert len(L.Lexicon(str(tmp_path / "x")).final) < sum(map(len, words)) / 3


def test_query_rows(spark):
    rows = [(1, "The cats, the CATS"), (2, None), (3, ""), (1, "the"), (None, "café " * 500)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(2)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in L.encode_decode(df, PATH, words=3).collect()) == sorted(want)
    assert L.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert L.encoded(df, PATH).filter("doc_id = 2").first().ids == []
