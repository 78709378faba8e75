"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are encoded by merging and compiled into a minimal acyclic automaton: words are added in
sorted order and equal suffixes share their states. Each transition carries the number of words that come before it in
sorted order, so that the sum along a path numbers the word, and the number selects its ids. The automaton and the ids
are flat arrays in one file, which Spark ships to the executors and workers memory-map. A word that the lexicon lacks is
merged exactly, by the tokenizer's own merge ranks.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.common import batches, materialize, scratch_path, texts

#: Words of the lexicon, at most, and the longest in bytes.
WORDS = 1 << 17
LONGEST = 64
#: Pieces of text and words that a worker remembers since it last made room, and once more before that.
CACHE = 200_000
MAGIC = b"MATL0002"
NO_STATE = 0xFFFFFFFF
#: Places that the compiler tries for a state's transitions before it puts them at the end.
TRIES = 100
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """What a tokenizers JSON file with lower case, a splitting pattern and word-end merges says, for one word at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_pattern = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        # whether letters make one word and what follows another, as in the published patterns of this kind
        self.runs = r"|[\p{L}]+|" in self.pattern.pattern and r"[^\s\p{L}\p{N}]+" in self.pattern.pattern
        self.letters = dict(enumerate(byte_letters()))
        self.model = Tokenizer.from_file(path).model

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece without special tokens, as UTF-8."""
        if not piece.isascii():
            # lower case letter by letter: a final sigma is an ordinary one
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        low = piece.lower()
        if self.runs:
            if low.isalpha():
                return [low.encode()]
            if low[-1:] in (",", ".") and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1:].encode()]
        return [w.encode("utf-8", "replace") for w in self.pattern.findall(low)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, merged exactly by the tokenizer's own ranks."""
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A lexicon file: header, base of each state, owner, target and number of each transition slot, final flags, then the
    ids of each word. Children are numbered before their parents; the root is the last state."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_states: list[list] = [[False, []]]  # along the last word: final flag and (label, state) of finished children

    def close(down_to: int, word: bytes) -> None:
        while len(open_states) - 1 > down_to:
            final, edges = open_states.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            open_states[-1][1].append((word[len(open_states) - 1], register[key]))

    last = b""
    ordered = sorted(entries)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        close(same, last)
        open_states.extend([False, []] for _ in word[same:])
        open_states[-1][0] = True
        last = word
    close(0, last)
    states.append((open_states[0][0], tuple(open_states[0][1])))
    # a state's transition with a label is in slot base[state] + label, which names its state; states fill gaps first
    base, owner, targets, numbers, below = [0] * len(states), [], [], [], [0] * len(states)
    free = high = 0
    for s, (final, edges) in enumerate(states):
        n = int(final)
        while free < len(owner) and owner[free] != NO_STATE:
            free += 1
        at = max(0, free - edges[0][0]) if edges else 0
        last_try = at + TRIES
        while any(at + label < len(owner) and owner[at + label] != NO_STATE for label, _ in edges):
            at = at + 1 if at < last_try else max(at + 1, high - edges[0][0])
        base[s] = at
        if edges and at + 256 > len(owner):
            more = at + 256 - len(owner)
            owner += [NO_STATE] * more
            targets += [0] * more
            numbers += [0] * more
        for label, to in edges:
            owner[at + label], targets[at + label], numbers[at + label] = s, to, n
            high = max(high, at + label + 1)
            n += below[to]
        below[s] = n
    owner = owner[:high] + [NO_STATE] * 256
    ids = [entries[w] for w in ordered]
    starts = np.cumsum([0, *map(len, ids)])
    parts = [np.array(base, "<u4"), np.array(owner, "<u4"), np.array(targets, "<u4"), np.array(numbers, "<u4"), np.array([f for f, _ in states], "<u4"), starts.astype("<u4"), np.array([i for x in ids for i in x], "<u4")]
    head = MAGIC + struct.pack(f"<{len(parts)}I", *map(len, parts))
    return head + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A lexicon file, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        sizes = struct.unpack_from("<7I", self.map, 8)
        view, at, parts = memoryview(self.map), 8 + 28, []
        for n in sizes:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.base, self.owner, self.targets, self.numbers, self.final, self.starts, self.ids = parts
        self.root = len(self.final) - 1

    def lookup(self, word: bytes) -> list[int] | None:
        base, owner, targets, numbers = self.base, self.owner, self.targets, self.numbers
        state, number = self.root, 0
        for b in word:
            slot = base[state] + b
            if owner[slot] != state:
                return None
            number += numbers[slot]
            state = targets[slot]
        if not self.final[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Encoder(dict):
    """Encoding and decoding of whole texts with a lexicon: a dict from pieces between blanks to ids, as bytes, which fills
    itself. Only strings and bytes are kept, so the garbage collector has nothing to follow."""

    def __init__(self, tokenizer_path: str, lexicon_path: str):
        super().__init__()
        self.tokenizer, self.lexicon = WordTokenizer(tokenizer_path), Lexicon(lexicon_path)
        self.decoded: dict[str, str] = {}
        self.words: dict[bytes, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, str], dict[bytes, bytes]] = ({}, {}, {})

    def __missing__(self, piece: str) -> bytes:
        ids = self.older[0].get(piece)
        if ids is not None:
            self[piece], self.decoded[piece] = ids, self.older[1][piece]
            return ids
        tokenizer = self.tokenizer
        parts = tokenizer.special_pattern.split(piece) if tokenizer.special_pattern and "<" in piece else (piece,)
        ids = b"".join(array("I", [tokenizer.special[p]]).tobytes() if p in tokenizer.special else self.plain(p) for p in parts) if len(parts) > 1 else self.plain(piece)
        self[piece] = ids
        self.decoded[piece] = " ".join(map(tokenizer.names.__getitem__, memoryview(ids).cast("I"))) if ids else ""
        return ids

    def plain(self, piece: str) -> bytes:
        """Ids of a piece without special tokens."""
        found = []
        for word in self.tokenizer.words(piece):
            ids = self.words.get(word) or self.older[2].get(word)
            if ids is None:
                ids = array("I", self.lexicon.lookup(word) or self.tokenizer.merge(word)).tobytes()
                if len(word) <= LONGEST:
                    self.words[word] = ids
            found.append(ids)
        return found[0] if len(found) == 1 else b"".join(found)

    def __call__(self, text: str) -> tuple[bytes, str]:
        """Ids as bytes and their decoded text."""
        if len(self) > CACHE or len(self.words) > CACHE:
            # what was asked for since then comes back from the older half
            self.older = (dict(self), self.decoded, self.words)
            self.clear()
            self.decoded, self.words = {}, {}
        # white space only parts words in this pattern, so a text can be cut at any of it
        pieces = text.replace("\n", " ").split(" ")
        ids = b"".join(map(self.__getitem__, pieces))
        return ids, " ".join(filter(None, map(self.decoded.__getitem__, pieces)))


_encoders: dict[tuple[str, str], Encoder] = {}
_shipped: set[tuple[str, str]] = set()


def encoder(tokenizer_path: str, lexicon_name: str) -> Encoder:
    """The encoder of this worker process; the lexicon is the file that Spark shipped."""
    key = (tokenizer_path, lexicon_name)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_path, SparkFiles.get(lexicon_name))
    return _encoders[key]


def count_words(tokenizer_path: str):
    """Words and their counts, one row for each word of a batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        known: dict[str, list[bytes]] = {}
        for batch in source:
            pieces: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                pieces.update(text.replace("\n", " ").split(" "))
            counts: Counter[bytes] = Counter()
            for p, n in pieces.items():
                words = known.get(p)
                if words is None:
                    words = tokenizer.words(p)
                    if len(known) < CACHE:
                        known[p] = words
                for w in words:
                    if len(w) <= LONGEST:
                        counts[w] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    return run


def frequent_words(docs: DataFrame, tokenizer_path: str, words: int = WORDS) -> list[bytes]:
    """Words that make up at least 1 / words of all word occurrences, over all whole texts; `words` at most by arithmetic."""
    counts = texts(docs).select("text").mapInArrow(count_words(tokenizer_path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [bytes(w) for w in counts.filter(F.col("n") * words >= total).toPandas()["word"]]


def ship_lexicon(docs: DataFrame, tokenizer_path: str, words: int = WORDS) -> str:
    """Compile the lexicon of a corpus and hand the file to Spark; its name among SparkFiles."""
    tokenizer = WordTokenizer(tokenizer_path)
    data = compile_lexicon({w: tokenizer.merge(w) for w in frequent_words(docs, tokenizer_path, words)})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) not in _shipped:  # Spark takes a name once
        folder = scratch_path(docs.sparkSession, "lexicon")
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        context.addFile(f"{folder}/{name}")
        _shipped.add((context.applicationId, name))
    return name


def encode_decode(docs: DataFrame, tokenizer_path: str, words: int = WORDS, position: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row and whole text of docs, and position where it is given.

    Ids are those of the tokenizers library without special tokens added, truncation or padding; decoded text is that of
    decode(ids, skip_special_tokens=False). Null and empty texts have no ids. Equal texts give equal values. An empty
    table gives an empty lexicon and an empty result.
    """
    name, placed = ship_lexicon(docs, tokenizer_path, words), position is not None

    def one(batch: pa.RecordBatch) -> dict:
        encode = encoder(tokenizer_path, name)
        rows = []
        for text in batch.column("text").to_pylist():
            ids, decoded = encode(text)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()))
        made = {"doc_id": batch.column("doc_id"), **{c: [r[k] for r in rows] for k, c in enumerate(SCHEMA.names[1:])}}
        return made | {"position": batch.column("position")} if placed else made

    if not placed:
        return texts(docs).mapInArrow(batches(one, SCHEMA), RESULT)
    return texts(docs, position.cast("long").alias("position")).mapInArrow(batches(one, SCHEMA.append(pa.field("position", pa.int64()))), RESULT + ", position long")


def encoded(docs: DataFrame, tokenizer_path: str, words: int = WORDS) -> DataFrame:
    """doc_id, ids and decoded text themselves."""
    name = ship_lexicon(docs, tokenizer_path, words)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def one(batch: pa.RecordBatch) -> dict:
        encode = encoder(tokenizer_path, name)
        found = [encode(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], "decoded": [d for _, d in found]}

    return texts(docs).mapInArrow(batches(one, schema), "doc_id long, ids array<int>, decoded string")
