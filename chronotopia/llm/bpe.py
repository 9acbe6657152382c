"""Byte-level BPE: a pair occurrence index over all distinct words of a batch.

Encoding a batch: texts are cut at special tokens and pre-tokenised; each distinct word not met lately becomes a run
of symbols in one array. An index maps every mergeable pair, by its rank, to all positions where it occurs. Active
ranks are taken in ascending order; a rank is applied to all its positions at once, and the lists of the pairs that
the merges make are extended. A pair that holds a merged symbol always ranks after it, so each rank is taken once.

Edge cases: null and empty texts have no tokens; very long texts are encoded whole; rows are independent, so ties and
repeated rows need no rule. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The byte-level pre-tokenisation that tokenizer files of this kind name (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept between batches, and bytes of text encoded together: bounds on a worker's memory.
CACHE_WORDS, CHUNK = 150_000, 8_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary: itself, or the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class PairIndexBPE:
    """Encoder and decoder made from the content of a byte-level BPE tokenizer file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        keys, ranks = np.unique(keys, return_index=True)
        self.keys, self.ranks = np.r_[keys, np.iinfo(np.int64).max], np.r_[ranks, -1]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.second = np.array([vocab[b] for _, b in pairs], np.int64)
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        self.special = dict(added)
        self.split = regex.compile("(" + "|".join(regex.escape(c) for c, _ in sorted(added, key=lambda x: -len(x[0]))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.bytes = [b""] * (max([self.size - 1, *self.special.values()]) + 1)
        for tok, i in vocab.items():
            self.bytes[i] = bytes(map(to_byte.__getitem__, tok))
        for tok, i in added:
            self.bytes[i] = tok.encode()
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that no rule merges."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def post(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into their lists."""
            at = at[after[at] >= 0]
            r = self.rank(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if k not in lists:
                    lists[k] = []
                    heapq.heappush(active, k)
                lists[k].append(part)

        post(np.arange(n))
        while active:
            k = heapq.heappop(active)
            held = lists.pop(k)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            a, b, new = self.first[k], self.second[k], self.made[k]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols, every other pair from its start
                follows = np.r_[False, at[1:] == after[at[:-1]]]
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = new, -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            post(np.unique(np.r_[at, ahead[ahead >= 0]]))
        live = sym >= 0
        ids = sym[live].astype("<u4").tobytes()
        stops = (np.cumsum(live)[ends - 1] * 4).tolist() if n else []
        out, begin = [], 0
        for stop, size in zip(stops, sizes.tolist()):
            out.append(ids[begin:stop] if size else b"")
            begin = stop
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces, new = [], {}
        for t in texts:
            found: list[str] = []
            for part in self.split.split(t or "") if self.split else [t or ""]:
                if part in self.special:
                    found.append(part)
                elif part:
                    found += self.words.findall(part)
            pieces.append(found)
            new.update(dict.fromkeys(found))
        fresh = [w for w in new if w not in self.cache and w not in self.special]
        self.cache.update(zip(fresh, self.merge([w.encode("utf-8", "replace") for w in fresh])) if fresh else ())
        for tok, i in self.special.items():
            self.cache[tok] = np.array([i], "<u4").tobytes()
        out = [b"".join(map(self.cache.__getitem__, found)) for found in pieces]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_made: dict[str, PairIndexBPE] = {}


def tokenizer_of(content: bytes) -> PairIndexBPE:
    """The tokenizer of this content, made once in each worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _made:
        _made[key] = PairIndexBPE(content)
    return _made[key]


def _chunks(texts: pa.Array) -> Iterable[list[str | None]]:
    """Texts in order, in lists of at most about CHUNK characters."""
    held, size = [], 0
    for t in texts:
        t = t.as_py()
        held.append(t)
        size += len(t or "")
        if size > CHUNK:
            yield held
            held, size = [], 0
    yield held


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and token_ids (array of int) of every whole text. ``path``: of a tokenizer file."""
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        tok = tokenizer_of(content.value)
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for part in _chunks(b.column("text")) for x in tok.encode(part)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n), lists], [*keep, "n_tokens", "token_ids"])

    small_batches(docs)
    src = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return src.mapInArrow(run, f"{kinds}, n_tokens long, token_ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of ``token_ids``; null ids have a null text."""
    content = encoded.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        tok = tokenizer_of(content.value)
        for b in batches:
            texts = [None if x.as_py() is None else tok.decode(np.array(x.as_py(), np.int64)) for x in b.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, "token_ids").mapInArrow(run, f"{kinds}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded, in one pass."""
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        tok = tokenizer_of(content.value)
        for b in batches:
            n, one, two = [], [], []
            for part in _chunks(b.column("text")):
                for x in tok.encode(part):
                    n.append(len(x) // 4)
                    one.append(hashlib.sha256(x).hexdigest())
                    two.append(hashlib.sha256(tok.decode(np.frombuffer(x, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    return round_trip(table(spark, sf_dir, "documents"), default_path())
