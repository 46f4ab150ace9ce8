"""BPE encoding by backtracking, and decoding by an offset table.

The encoder takes, at each position, the longest token that an Aho-Corasick automaton finds there; a token may follow
another only if merges would keep the two apart, which a pair-compatibility table tells. Where no shorter token fits
either, it steps back and never tries that position again, so each position is left at most once for each prefix and
the result is what applying all merges in the order of their ranks gives. Decoding gathers the bytes of all tokens of a
column at once, by a table of their offsets.
"""

from __future__ import annotations

import base64
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import pick, utf8

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What \\s is in it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHE = 200_000
_NONE = 1 << 40


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Tables:
    """What encoding needs of a vocabulary: splits[t], the pair whose merge made t (t itself if none did); merged, the
    token of a pair; shorter[t], the longest token that is a proper prefix of t."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.shorter = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for k in range(len(t) - 1, 0, -1):
                a = ids.get(t[:k])
                if a is None:
                    continue
                if self.shorter[i] < 0:
                    self.shorter[i] = a
                b = ids.get(t[k:])
                if b is not None and a < i and b < i and self._apart(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a << 20 | b] = i
                    break
        self.fits = {}

    def _apart(self, a: int, b: int) -> bool:
        """Would merging leave a boundary between ``a`` and ``b``? Undoes the latest merge of either, again and again."""
        left, right, merged = self.left, self.right, self.merged
        limit = _NONE
        while True:
            if merged.get(a << 20 | b, _NONE) < limit:
                return False
            last_a, last_b = left[a] == a, left[b] == b
            if last_a and last_b:
                return True
            # the later merge is undone first; of two copies of one token, the left copy merged first
            if not last_a and (last_b or a > b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]


class Encoder:
    """Encodes texts with the tables of a vocabulary. Results of pieces are kept, at most twice CACHE of each kind."""

    def __init__(self, tables: Tables, pattern: str = PATTERN):
        self.t = tables
        self.length = [len(x) for x in tables.tokens]
        self.back = [len(x) - 1 for x in tables.tokens]
        self.machine = ahocorasick.Automaton()
        for i, x in enumerate(tables.tokens):
            self.machine.add_word(x.decode("latin-1"), i)
        self.machine.make_automaton()
        self.find = regex.compile(pattern).findall
        self.segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.doubled = re.compile(f"[{SPACE}] | $").search
        self.whole = {x.decode("latin-1"): np.array([i], "<i4").tobytes() for i, x in enumerate(tables.tokens)}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokens(self, text: str) -> list[int]:
        """Tokens of one piece, whose bytes are given as Latin-1; ValueError if they can't be made of tokens."""
        length, fits = self.length, self.t.fits
        n = len(text)
        longest = [-1] * n
        back = self.back
        for end, i in self.machine.iter(text):  # of two with the same start, the later is the longer
            longest[end - back[i]] = i
        out: list[int] = []
        closed: set[int] = set()
        at, before, token = 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in closed:
                    if before < 0:
                        break
                    ok = fits.get(before << 20 | token)
                    if ok is None:
                        ok = self._fit(before, token)
                    if ok:
                        break
                token = self.t.shorter[token]
            if token >= 0:
                out.append(token)
                before, at = token, end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary has no tokens for these bytes")
                closed.add(at)
                token = out.pop()
                before = out[-1] if out else -1
                at -= length[token]
        return out

    def _fit(self, a: int, b: int) -> bool:
        """An entry of the compatibility table, worked out when first needed."""
        if len(self.t.fits) >= 1_000_000:
            self.t.fits.clear()
        ok = self.t.fits[a << 20 | b] = self.t._apart(a, b)
        return ok

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        one = self.whole.get(text)
        return one if one is not None else array("i", self.tokens(text)).tobytes()

    def _segment(self, s: str) -> bytes:
        """Ids (as bytes) of a segment, which no piece crosses."""
        word = s[1:] if s[:1] == " " else s
        if word.isascii() and word.isalpha():
            return self._piece(s)
        parts = []
        for piece in self.find(s):
            hit = None
            if piece[0] == " ":
                hit = self.new.get(piece[1:])
                if hit is None:
                    hit = self.old.get(piece[1:])
            parts.append(hit if hit is not None else self._piece(piece))
        return b"".join(parts)

    def _spaced(self, word: str) -> bytes:
        """Ids of a space and ``word``, kept for later."""
        got = self.old.get(word)
        if got is None:
            got = self._segment(" " + word)
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        if len(word) <= 64:
            self.new[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text. Pieces begin anew at each white space that follows something else."""
        if self.doubled(text):
            segments = self.segments(text)
        else:
            first, *words = text.split(" ")
            out = list(map(self.new.get, words))
            at = -1
            while True:
                try:
                    at = out.index(None, at + 1)
                except ValueError:
                    return self._segment(first) + b"".join(out) if first else b"".join(out)
                got = self.new.get(words[at])
                out[at] = got if got is not None else self._spaced(words[at])
        out = []
        for s in segments:
            if s[0] == " " and len(s) > 1:
                got = self.new.get(s[1:])
                out.append(got if got is not None else self._spaced(s[1:]))
            else:
                out.append(self._segment(s))
        return b"".join(out)


class Decoder:
    """Bytes of tokens, gathered from one buffer by offsets."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each token's bytes end among them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.bytes[at], ends


_encoders: dict[str, tuple[Encoder, Decoder]] = {}


def _coders(key: str, tables) -> tuple[Encoder, Decoder]:
    """The coders of this worker process, kept from task to task."""
    if key not in _encoders:
        value = tables.value
        _encoders[key] = Encoder(value), Decoder(value.tokens)
    return _encoders[key]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()),
])


def bpe_encode(docs: DataFrame, path: str = TOKENIZER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): the ids of each text, and whether decoding them gives back its bytes.

    One row for each row, in no order; rows with null or repeated ids too. A null text has null tokens, an empty one an
    empty list. Whole texts are encoded, special tokens' strings as ordinary text. Other columns are dropped. The
    vocabulary is read on the driver; its tables (a few MB, whatever the data) are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    tables = spark.sparkContext.broadcast(Tables(read_ranks(path)))
    key = path

    def run(batches):
        encoder, decoder = _coders(key, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1)
                ids = [encoder.encode(x) if x is not None else b"" for x in texts.to_pylist()]
                counts = np.array([len(x) >> 2 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), "<i4")
                raw, ends = decoder.decode(flat)
                data, offsets = utf8(texts)
                stops = np.concatenate([[0], np.cumsum(counts)])
                where = np.concatenate([[0], ends])[stops]
                good = [
                    bool(where[i + 1] - where[i] == offsets[i + 1] - offsets[i])
                    and np.array_equal(raw[where[i] : where[i + 1]], data[offsets[i] : offsets[i + 1]])
                    for i in range(len(counts))
                ]
                null = np.asarray(texts.is_null())
                lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat))
                if null.any():
                    lists = lists.take(pa.array(np.arange(len(null)), mask=null))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(good, pa.bool_(), mask=null)],
                    ["doc_id", "tokens", "n_tokens", "round_trip"],
                )

    return pick(docs, doc_id=id, text=text).mapInArrow(run, SCHEMA)


def bpe_decode(rows: DataFrame, path: str = TOKENIZER, id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, text) of lists of ids; null lists give null texts. Bytes that aren't UTF-8 become U+FFFD."""
    held = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            lists = batch.column(1)
            texts = []
            for x in lists:
                if x.is_valid:
                    raw, _ = decoder.decode(np.asarray(x.values, np.int64))
                    texts.append(raw.tobytes().decode("utf-8", "replace"))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(rows, doc_id=id, tokens=tokens).mapInArrow(run, "doc_id long, text string")
