"""Byte-level BPE encoding and decoding from a public tokenizer file.

A text is cut at added tokens, then by the pre-tokenizer pattern; each piece starts as one
symbol a byte in a doubly linked list. A heap holds candidate merges by (rank, place); an
entry whose symbols have changed since is stale and skipped. Decoding concatenates the
vocabulary's byte strings.

Cases: null counts as empty text and gives no ids; texts of any length and pieces without
white space are encoded whole; ids outside the vocabulary raise ValueError in decoding, and a file with
settings that are not handled here in loading; repeated rows and null ids of documents pass
through; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same for texts of ASCII alone, for `re`, whose white space has four more characters.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

#: Letters of a text up to which its pieces are listed; those of a longer one are streamed.
LISTED = 1_000_000
#: Pieces in one generation of a worker's cache; it holds two at most.
CACHE_PIECES = 50_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary strings: printable bytes stand for
    themselves, the others for code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check(spec: dict) -> None:
    """Raise ValueError if a tokenizer file asks for what is not done here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")),
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True),
        "added_tokens": any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, bad in odd.items() if bad]:
        raise ValueError(f"settings of the tokenizer file are not handled: {', '.join(found)}")


class Tokenizer:
    def __init__(self, content: str):
        spec = json.loads(content)
        check(spec)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [0] * 256
        for i, t in self.bytes_of.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        ranks: dict[int, dict[int, int]] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(vocab[a], {}).setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        # For each left symbol, the look-up of a pair's rank by its right one.
        none = {}.get
        self.rank_after = [ranks[i].get if i in ranks else none for i in range(max(vocab.values()) + 1)]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.cut = re.compile(f"({marks})") if marks else None
        self.pattern, self.ascii_pattern = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.packers: dict[int, struct.Struct] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. A heap entry is rank * 2**bits + place; the rank names its pair."""
        ids = [*map(self.byte_ids.__getitem__, piece)]
        n, rank_after, made = len(ids), self.rank_after, self.made
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_after[a](b)) is not None]
        if not heap:
            return ids
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            j = after[i]
            # A symbol that is merged away is -1.
            if j >= n or (a := ids[i]) < 0 or rank_after[a](ids[j]) != (rank := entry >> bits):
                continue
            to = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_after[to](ids[k])) is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank_after[ids[h]](to)) is not None:
                heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as bytes, through two generations of a bounded cache."""
        out = self.older.get(piece)
        if out is None:
            ids = self.merge(piece.encode())
            if (pack := self.packers.get(n := len(ids))) is None:
                pack = struct.Struct(f"<{n}I")
                if n <= 64:
                    self.packers[n] = pack
            out = pack.pack(*ids)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_PIECES:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, one, out = self.cache.get, self._piece, []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            pattern = self.ascii_pattern if part.isascii() else self.pattern
            if len(part) <= LISTED:
                out += [known(p) or one(p) for p in pattern.findall(part)]
            else:
                out.append(b"".join(_joined(known(m[0]) or one(m[0]) for m in pattern.finditer(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        except KeyError as e:
            raise ValueError(f"id {e} is not in the vocabulary") from e


def _joined(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in larger parts, as there may be very many."""
    out = bytearray()
    for p in parts:
        out += p
        if len(out) >= 1 << 20:
            yield bytes(out)
            out.clear()
    yield bytes(out)


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(content: str) -> Tokenizer:
    """One tokenizer for a worker process."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(content)
    return _loaded[key]


def _mapped(df: DataFrame, names: list[str], path: str, change, field: T.StructField) -> DataFrame:
    """df's columns `names` and a new one, batch by batch."""
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*names)
    schema = T.StructType([*rows.schema.fields, field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, change(tok, b)], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """`keep`, `text` and the binary column `out` of ids."""

    def change(tok: Tokenizer, b: pa.RecordBatch) -> pa.Array:
        return pa.array([tok.encode(x or "") for x in b.column(text).to_pylist()], pa.binary())

    return _mapped(df, list(dict.fromkeys((*keep, text))), path, change, T.StructField(out, T.BinaryType()))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """`keep`, `ids` and the text column `out`; null ids count as none."""

    def change(tok: Tokenizer, b: pa.RecordBatch) -> pa.Array:
        return pa.array([tok.decode(x or b"") for x in b.column(ids).to_pylist()], pa.string())

    return _mapped(df, list(dict.fromkeys((*keep, ids))), path, change, T.StructField(out, T.StringType()))
