import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import token_files as R
from quern.llm import tokens as T
from quern.llm.tokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "plain words, twice words,"), (1, None), (2, ""), (9, "  odd  \n spacing\t here "), (4, "<|endoftext|> a"), (7, "x" * 5000 + " é 日本"), (4, "again")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_round_trip_equals_library(spark, library):
    df = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, start string").repartition(3)
    got = R.round_trip(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in ROWS)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in ROWS)
    assert sorted(r.ids_crc32 for r in got) == want


def test_an_id_of_minus_one_is_no_null(spark):
    df = spark.createDataFrame([(None, "a b"), (-1, "a c"), (-1, "a b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in R.round_trip(df, PATH).collect())
    assert got == [("-1", 3), ("-1", 3), ("None", 3)]
    assert R.parse(R.payload_of(None, 7, b"\1\0", 2))[:2] == (None, 7) and R.parse(R.payload_of(-1, 7, b"\1\0", 2))[0] == -1


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    encoder = ChunkEncoder(PATH)
    for text in ("one two three, four. five-six one two " * 3, "seven one, two. eight é x.y", "one  two three"):
        assert np.frombuffer(encoder(text), encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.pieces) <= 3


def test_empty_table(spark):
    assert R.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_shuffled_reads_and_orphans(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    df = spark.range(200).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), int(id % 9)) as text")
    index = R.global_starts(R.write_records(df, folder, PATH))
    straight = R.read_records(index, folder).orderBy("doc_id").collect()
    assert R.read_records(index.orderBy("length", "doc_id"), folder).orderBy("doc_id").collect() == straight
    (tmp_path / "records/part-999999-lost.rec").write_bytes(b"x")
    assert R.drop_orphans(index, folder) == 1 and R.drop_orphans(index, folder) == 0
    assert len(pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path / "records")))) >= 1


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 10_000))
def test_damage_is_found(payload, at):
    record = R.frame(payload)
    assert R.unframe(record) == payload
    broken = bytearray(record)
    broken[at % len(broken)] ^= 0x10
    with pytest.raises(ValueError):
        R.unframe(bytes(broken))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z,.'\n\t 1é日 \x1c᠎<|>")), max_size=40))
def test_pieces_equal_whole_text(text):
    encoder = _encoder()
    assert np.frombuffer(encoder(text), f"<u{encoder.width}").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


_held = []


def _encoder():
    if not _held:
        _held.append(ChunkEncoder(PATH))
    return _held[0]


def test_other_tokenizers_take_whole_texts():
    encoder = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some  words, Here"
    assert not encoder.cuts and np.frombuffer(encoder(text), f"<u{encoder.width}").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_two_corpora_in_one_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/shared"
    one, two = (spark.createDataFrame([(i, f"text {i} {w}") for i in range(20)], "doc_id long, text string") for w in ("a", "b"))
    first = R.round_trip(one, PATH, folder=folder)
    before = sorted(p.name for p in (tmp_path / "shared").iterdir())
    assert R.round_trip(two, PATH, folder=folder).count() == 20
    assert set(before) <= {p.name for p in (tmp_path / "shared").iterdir()} and first.count() == 20
