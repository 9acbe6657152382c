"""Removal of long repeated strings by a logarithmic family of suffix arrays.

A string of ``length`` bytes (a window) counts as repeated if it also starts elsewhere, in any document. Each window
has an anchor: of its first ``WINDOW`` positions the one where a 16-byte hash is least. Equal windows have their anchor
at the same offset, so all they share begins at an anchor; one anchor serves a run of windows, and its context is the
text of that run. Only anchors whose next 81 bytes occur again need a look:

1. Batches of documents give their anchors; contexts that occur twice in a batch are settled there and sent once.
2. Anchors meet by the hash of their 81 bytes. Equal contexts make all their windows repeated. Where several different
   contexts meet, one of each is fetched from its document.
3. Contexts, dealt by that hash, go through the index family: a batch gets a suffix array (of the text right of the
   anchors) and a prefix array (of the reversed text left of them) with their common prefixes, and is merge-scanned with
   the levels there: levels of equal size merge, and each merge compares all windows by their classes in both arrays.
   In the end all levels have merged, so each window has met every other.
4. The windows found, as intervals, meet their documents, which lose the bytes covered.

Nothing is capped. Matches of parts of contexts are found by comparing bytes; equality of whole contexts and of rows
is that of hashes (two of 64 bits, chained over the same hashes of 16 bytes each), not of bytes. The text is shuffled
once, for steps 3 and 4 together (one exchange, reused).

``Index`` keeps levels between runs: batches of documents that come later are compared with all that came before.

Edge cases: null and empty texts have nothing to remove; texts shorter than ``length`` neither; overlapping
occurrences count; repeated rows lose all that they share; rows are told apart by 128 bits of
hash of doc_id and text. Where very many rows are equal in both, each has all its windows in the others, so the rows lose
all where they are, and one goes through the steps for other texts' sake; fewer equal rows share one list of intervals.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, checkpointed, remove_path, small_batches, table

LENGTH, WINDOW, GRAM = 200, 120, 16
#: Bytes of text that are hashed together, and contexts in a batch of the index family.
CHUNK, BATCH = 4_000_000, 4096
_mul = np.random.default_rng(5).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_byte = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each position on (those near the end wrap and mean nothing)."""
    h = _byte[data]
    for k in range(4):
        h = h * _mul[k] + np.roll(h, -(1 << k))
    return _mix(h)


def _chain(grams: np.ndarray, at: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``at`` to ``end`` (at least 16)."""
    h, at = start, at.copy()
    last = end - GRAM
    while True:
        go = at < last
        if not go.any():
            return _mix(h * _mul[5] + grams[last])
        h = np.where(go, _mix(h * _mul[4] + grams[np.minimum(at, last)]), h)
        at = at + GRAM


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Of all texts in ``data``: doc (number), lo, hi (first and last window), x (anchor), seed, context."""
    n = len(data)
    grams = gram_hashes(data)
    bits = np.uint64(max(1, n - 1).bit_length())
    low = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    low &= (np.uint64(1) << bits) - np.uint64(1)
    some = np.flatnonzero(ends - begins >= length)
    count = ends[some] - begins[some] - length + 1
    first = np.cumsum(count) - count
    doc = np.repeat(some, count)
    p = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(begins[some], count)
    x = low[p].astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])]) if len(x) else np.empty(0, np.int64)
    last = np.r_[cut[1:], len(x)] - 1
    lo, hi, x, doc = p[cut], p[last] if len(cut) else p[cut], x[cut], doc[cut]
    seed = _chain(grams, x, x + (length - WINDOW + 1), np.full(len(x), 1, np.uint64))
    context = _chain(grams, lo, hi + length, (x - lo).astype(np.uint64))
    return {"doc": doc, "lo": lo, "hi": hi, "x": x, "seed": seed, "context": context}


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of windows in order, those that touch made one."""
    if not len(doc):
        return doc, lo, hi
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)])
    return doc[cut], lo[cut], hi[np.r_[cut[1:], len(doc)] - 1]


#: A row's number: 128 bits of hash over doc_id and text, held as an array of two columns.
KEY = ["key", "key2"]
FOUND = "kind int, seed long, context long, key long, key2 long, lo int, hi int, off int, many boolean"
_names = ["kind", "seed", "context", *KEY, "lo", "hi", "off", "many"]


def _keys(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)


def _record(kind: int, key, lo, hi, seed=None, context=None, off=None, many=None) -> pa.RecordBatch:
    n = len(key)
    zero = np.zeros(n, np.int64)
    num = lambda v, t: pa.array(zero.astype(t) if v is None else v.astype(t))
    as_long = lambda v: pa.array(zero if v is None else v.view(np.int64))
    flag = pa.array(zero.astype(bool) if many is None else many)
    return pa.RecordBatch.from_arrays([num(np.full(n, kind), np.int32), as_long(seed), as_long(context), *(pa.array(key[:, i]) for i in (0, 1)), num(lo, np.int32), num(hi, np.int32), num(off, np.int32), flag], _names)


def _texts(batch: pa.RecordBatch):
    """(numbers of rows, bytes, begins, ends) of the batch, in parts of about CHUNK bytes."""
    texts, held, size, first = batch.column("data"), [], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size >= CHUNK:
            if held:
                ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
                yield np.arange(first, i), np.frombuffer(b"".join(held), np.uint8), np.r_[0, ends[:-1]], ends
            held, size, first = [], 0, i
        if i < len(texts):
            held.append(texts[i].as_py() or b"")
            size += len(held[-1])


def _collect(batches, length: int):
    """Documents to anchors (kind 0) and intervals settled inside a batch (kind 1)."""
    for b in batches:
        keys = _keys(b)
        for rows, data, begins, ends in _texts(b):
            if len(data) < length:
                continue
            a = anchors(data, begins, ends, length)
            if not len(a["doc"]):
                continue
            base = begins[a["doc"]]
            order = np.lexsort((a["context"], a["seed"]))
            s, c = a["seed"][order], a["context"][order]
            new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
            group = np.cumsum(new) - 1
            many = (np.bincount(group) > 1)[group]
            settled = np.zeros(len(order), bool)
            settled[order] = many
            d, lo, hi = _runs(a["doc"][settled], a["lo"][settled] - base[settled], a["hi"][settled] - base[settled])
            if len(d):
                yield _record(1, keys[rows[d]], lo, hi)
            one = order[new]
            yield _record(0, keys[rows[a["doc"][one]]], (a["lo"] - base)[one], (a["hi"] - base)[one], a["seed"][one], a["context"][one], (a["x"] - a["lo"])[one], many[new])


def _meet(batches):
    """Anchors that share a seed: intervals of equal contexts (kind 1), and one of each context that differs (kind 2)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    seed, context = (t.column(c).to_numpy().view(np.uint64) for c in ("seed", "context"))
    order = np.lexsort((context, seed))
    again = np.zeros(len(order), bool)
    same = seed[order][1:] == seed[order][:-1]
    again[1:] |= same
    again[:-1] |= same
    many = t.column("many").to_numpy(zero_copy_only=False)
    order = order[again | many[order]]
    if not len(order):
        return
    seed, context, many = seed[order], context[order], many[order]
    key, (lo, hi, off) = _keys(t)[order], (t.column(c).to_numpy()[order] for c in ("lo", "hi", "off"))
    new_seed = np.r_[True, seed[1:] != seed[:-1]]
    new = new_seed | np.r_[True, context[1:] != context[:-1]]
    group, family = np.cumsum(new) - 1, np.cumsum(new_seed) - 1
    twice = (np.bincount(group) > 1) | np.bincount(group, many).astype(bool)
    settled = twice[group] & ~many
    if settled.any():
        own = key[settled]
        by = np.lexsort((lo[settled], own[:, 1], own[:, 0]))
        own = own[by]
        row = np.r_[0, np.cumsum((own[1:] != own[:-1]).any(axis=1))]
        k, a, z = _runs(row, lo[settled][by], hi[settled][by])
        yield _record(1, own[np.searchsorted(row, k)], a, z)
    one = np.flatnonzero(new)
    kinds = np.bincount(family[one])
    lone = np.bincount(family[one], ~twice) > 0
    one = one[(kinds[family[one]] > 1) & lone[family[one]]]
    if len(one):
        yield _record(2, key[one], lo[one], hi[one], seed[one], context[one], off[one], twice[group[one]])


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as one value each, which compare as the bytes do."""
    return np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()


def _interleaved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of rows, of ``a`` and then ``b``, both sorted, that bring them in one order without sorting again."""
    at = np.searchsorted(_words(a), _words(b), side="right") + np.arange(len(b))
    out = np.full(len(a) + len(b), -1)
    out[at] = len(a) + np.arange(len(b))
    out[out < 0] = np.arange(len(a))
    return out


class Level:
    """Contexts in suffix-array order, and ``by_left``, their order in the prefix array.

    right: text from the anchor on; left: reversed text before it.
    """

    FIELDS = ("right", "left", "off", "least", "found", "ids")

    def __init__(self, right: np.ndarray, left: np.ndarray, off: np.ndarray, least: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(_words(right), kind="stable")
        self.right, self.left, self.off, self.least, self.found, self.ids = (v[order] for v in (right, left, off, least, found, ids))
        self.by_left = np.argsort(_words(self.left), kind="stable")

    @staticmethod
    def _common(rows: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each row with the one before it."""
        differ = rows[1:] != rows[:-1]
        return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]

    def scan(self, length: int) -> None:
        """Mark each window, by its anchor's offset, that another context here has at the same offset."""
        n = len(self.ids)
        if n < 2:
            return
        right = self._common(self.right)
        by_left = self.by_left
        left = self._common(self.left[by_left])
        in_left = np.empty(n, np.int64)
        for d in range(int(self.off.max()) + 1):
            own = (self.off >= d) & (self.least <= d)
            if own.sum() < 2:
                continue
            r = np.cumsum(right < length - d)
            in_left[by_left] = np.cumsum(left < d) if d else 0
            pair = r[own] * (n + 1) + in_left[own]
            order = np.argsort(pair, kind="stable")
            s = pair[order]
            same = np.r_[False, s[1:] == s[:-1]]
            same[:-1] |= same[1:]
            at = np.flatnonzero(own)[order[same]]
            self.found[at, d] = True

    def merge(self, other: Level, length: int) -> Level:
        """Both levels as one, scanned: their sorted arrays are merged, not sorted again."""
        both, order = Level.__new__(Level), _interleaved(self.right, other.right)
        for v in self.FIELDS:
            setattr(both, v, np.concatenate([getattr(self, v), getattr(other, v)])[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lefts = np.concatenate([self.by_left, other.by_left + len(self.ids)])
        both.by_left = place[lefts[_interleaved(self.left[self.by_left], other.left[other.by_left])]]
        both.scan(length)
        return both


class Family:
    """Levels of doubling sizes, as the digits of a binary counter."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, {}

    def add(self, batch: Level) -> None:
        batch.scan(self.length)
        k = 0
        while k in self.levels:
            batch = self.levels.pop(k).merge(batch, self.length)
            k += 1
        self.levels[k] = batch

    def finish(self) -> Level | None:
        out = None
        for k in sorted(self.levels):
            out = self.levels[k] if out is None else out.merge(self.levels[k], self.length)
        return out


def _index(batches, length: int):
    """Contexts dealt by seed: intervals of the windows that another context has too."""
    family, keys, los = Family(length), [], []
    count = 0

    def level(parts: list) -> Level:
        nonlocal count
        n = len(parts)
        right, left = np.zeros((n, length), np.uint8), np.zeros((n, WINDOW), np.uint8)
        off, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (key, lo, o, many, text) in enumerate(parts):
            raw = np.frombuffer(text, np.uint8)
            tail = raw[o : o + length]
            right[i, : len(tail)] = tail
            left[i, :o] = raw[:o][::-1]
            # Windows end where the context does; a context that is settled takes part but needs no marks.
            off[i], least[i] = o, length - (len(raw) - o)
            keys.append(key)
            los.append(-1 if many else lo)
        out = Level(right, left, off, np.maximum(least, 0), np.zeros((n, WINDOW), bool), np.arange(count, count + n))
        count += n
        return out

    held: list = []
    for b in batches:
        for row in zip(_keys(b), *(b.column(c).to_pylist() for c in ("lo", "off", "many", "text"))):
            held.append(row)
            if len(held) == BATCH:
                family.add(level(held))
                held = []
    if held:
        family.add(level(held))
    done = family.finish()
    if done is None:
        return
    los_, keys_ = np.array(los)[done.ids], np.array(keys)[done.ids]
    keep = (los_ >= 0) & done.found.any(axis=1)
    r, d = np.nonzero(done.found[keep])
    if not len(r):
        return
    p = los_[keep][r] + done.off[keep][r] - d
    order = np.lexsort((p, r))
    doc, lo, hi = _runs(r[order], p[order], p[order])
    yield _record(1, keys_[keep][doc], lo, hi)


def _rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``: their key, doc_id and the text's bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.xxhash64(F.lit(n), "doc_id", text).alias(c) for n, c in enumerate(KEY)]
    return small_batches(docs).select(*keys, F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("data"))


def _repeats(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, of those of one key that are many only one, marked ``lone``; the many rows).

    A key is many rows' if it has over 1 / HOT of them, so there are at most HOT such keys. All others stay as they are.
    """
    counts = checkpointed(src.groupBy(*KEY).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(checkpointed(counts.filter(F.col("n") > max(1, total // HOT)).select(*KEY)))
    many = src.join(hot, KEY)
    one = many.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("data").alias("data")).withColumn("lone", F.lit(True))
    return src.join(hot, KEY, "left_anti").withColumn("lone", F.lit(False)).unionByName(one), many


def _first(src: DataFrame, length: int) -> DataFrame:
    """Anchors of all texts, one of each context of a batch, and the intervals settled inside a batch."""
    if length - WINDOW + 1 < GRAM:
        raise ValueError(f"strings of at least {WINDOW + GRAM - 1} bytes only")
    return src.filter(F.octet_length("data") >= length).select(*KEY, "data").mapInArrow(lambda it: _collect(it, length), FOUND)


def _contexts(spread: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each context ``wanted``, out of its row; ``spread`` is dealt by key."""
    asked = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("seed", "lo", "hi", "off", "many")).alias("asked"))

    def fetch(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, key2, data, asked in zip(b.column("key").to_pylist(), b.column("key2").to_pylist(), b.column("data"), b.column("asked").to_pylist()):
                data = data.as_py()
                for x in asked:
                    for col, v in zip(out, (x["seed"], key, key2, x["lo"], x["off"], x["many"], data[x["lo"] : x["hi"] + length])):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["seed", *KEY, "lo", "off", "many", "text"])

    # doc_id and lone stay, so that this is the very exchange of texts that the removal reads.
    own = spread.join(asked, KEY).dropDuplicates(KEY)
    return own.mapInArrow(fetch, "seed long, key long, key2 long, lo int, off int, many boolean, text binary")


def _scan(contexts: DataFrame, length: int) -> DataFrame:
    """Intervals of the windows that another context has too, each seed's contexts in one index family."""
    return contexts.repartition("seed").mapInArrow(lambda it: _index(it, length), FOUND).select(*KEY, "lo", "hi")


def _inside(first: DataFrame, spread: DataFrame, length: int) -> DataFrame:
    """Intervals of windows that start elsewhere in the same rows too."""
    # Intervals settled in a batch are spread by their own hash and pass through.
    dealt = first.repartition(F.when(F.col("kind") == 0, F.col("seed")).otherwise(F.xxhash64("key", "lo")))

    def met(batches):
        held = []
        for b in batches:
            anchor = np.asarray(b.column("kind")) == 0
            held.append(b.filter(pa.array(anchor)))
            if not anchor.all():
                yield b.filter(pa.array(~anchor))
        yield from _meet(held)

    found = checkpointed(dealt.mapInArrow(met, FOUND))
    return found.filter("kind = 1").select(*KEY, "lo", "hi").union(_scan(_contexts(spread, found.filter("kind = 2"), length), length))


def find(src: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(intervals of repeated windows: key, key2, lo, hi), (``src`` dealt by key); ``src`` is rows as ``_rows`` gives, with lone."""
    spread = src.repartition(*KEY)
    return _inside(_first(src, length), spread, length), spread


def _cover(spans: list, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows lo..hi cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, min(z, size)) for a, z in out]


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans: array of (start, end) removed, kept: the bytes that remain) of every row."""
    few, many = _repeats(_rows(docs))
    # Each window of a row that has an equal row starts there too.
    size = F.octet_length("data")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("end")))
    nothing = F.array().cast(whole_type := "array<struct<start:bigint,end:bigint>>")
    spans = F.when(size >= length, whole.cast(whole_type)).otherwise(nothing)
    kept = F.when(size >= length, F.lit(b"")).otherwise(F.col("data"))
    return _removed(*find(few, length), length).unionByName(many.select("doc_id", size.cast("long").alias("n_bytes"), spans.alias("spans"), kept.alias("kept")))


def _removed(intervals: DataFrame, spread: DataFrame, length: int) -> DataFrame:
    """What ``remove`` returns for the rows of ``spread`` that are not ``lone``; equal rows share their intervals."""
    by = intervals.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            b = b.filter(pc.invert(b.column("lone")))
            spans, kept, sizes = [], [], []
            for data, found in zip(b.column("data"), b.column("found")):
                data = data.as_py()
                own = _cover(found.as_py() or [], len(data), length)
                at, parts = 0, []
                for a, z in own:
                    parts.append(data[at:a])
                    at = z
                spans.append([{"start": a, "end": z} for a, z in own])
                kept.append(b"".join([*parts, data[at:]]))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return spread.join(by, KEY, "left").select("doc_id", "data", "lone", "found").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


class Index:
    """Stored levels of batches, for batches of documents that come later.

    A level is a folder of two tables: anchors (one of each context), dealt and sorted by seed, and texts. Levels have
    geometric sizes: ``unit`` * 2^k bytes or more and less than twice that are class k, and no class has two. A new batch is
    first compared within itself, then its contexts meet those of the levels that share a seed with them in the index
    family; then it becomes a level, and levels of equal class merge until none is left. The list of levels is the
    newest complete version in ``manifest``, written last: whoever loses executors, or the driver, adds the batch again.
    Earlier batches stay as they were returned. One batch is added at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, unit: int = 1 << 30) -> None:
        self.spark, self.folder, self.length, self.unit = spark, folder.rstrip("/"), length, unit

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.getName()) for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def levels(self) -> list[tuple[str, int]]:
        """(folder, bytes of text) of each level: few, as sizes double."""
        done = self._versions()
        if not done:
            return []
        return [(r.level, r.bytes) for r in self.spark.read.parquet(f"{self.folder}/manifest/{done[-1]}").orderBy("bytes").collect()]

    def _class(self, size: int) -> int:
        return max(1, size // self.unit).bit_length()

    def _write(self, anchors: DataFrame, texts: DataFrame) -> tuple[str, int]:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        one = anchors.groupBy("seed", "context").agg(F.min(F.struct(*KEY, "lo", "hi", "off")).alias("x"))
        one.select("seed", "context", "x.*").repartition("seed").sortWithinPartitions("seed", "context").write.parquet(f"{path}/anchors")
        texts.write.parquet(f"{path}/texts")
        return path, self.spark.read.parquet(f"{path}/texts").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]

    def _read(self, paths: list[str], name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{p}/{name}" for p in paths])

    def add(self, docs: DataFrame) -> DataFrame:
        """What ``remove`` returns for ``docs``, strings that start in an earlier batch taken as repeated too."""
        old, state = self.levels(), self._versions()
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        _rows(docs).write.parquet(f"{path}/rows")
        src = self.spark.read.parquet(f"{path}/rows")
        _first(src, self.length).write.parquet(f"{path}/anchors")
        first = self.spark.read.parquet(f"{path}/anchors")
        spread = src.withColumn("lone", F.lit(False)).repartition(*KEY)
        intervals = _inside(first, spread, self.length)
        own = first.filter("kind = 0")
        if old:
            paths = [p for p, _ in old]
            # Of equal contexts one is enough: those of the batch are settled within it, those of levels take no marks.
            mine = own.groupBy("seed", "context").agg(F.min(F.struct(*KEY, "lo", "hi", "off", "many")).alias("x")).select("seed", "x.*")
            theirs = self._read(paths, "anchors").withColumn("many", F.lit(True)).dropDuplicates(["seed", "context"]).drop("context")
            seeds = mine.select("seed").distinct().join(theirs.select("seed").distinct(), "seed")
            seeds = checkpointed(seeds)
            here = _contexts(spread, mine.join(seeds, "seed", "left_semi"), self.length)
            there = _contexts(self._read(paths, "texts").repartition(*KEY), theirs.join(seeds, "seed", "left_semi"), self.length)
            intervals = intervals.union(_scan(here.union(there), self.length))
        _removed(intervals, spread, self.length).write.parquet(f"{path}/removed")
        made = self._write(own, src.select(*KEY, F.lit(None).cast("long").alias("doc_id"), "data").filter(F.octet_length("data") >= self.length))
        kept, gone = list(old), [f"{path}/rows", f"{path}/anchors"]
        while same := [x for x in kept if self._class(x[1]) == self._class(made[1])]:
            both = [same[0][0], made[0]]
            made = self._write(self._read(both, "anchors"), self._read(both, "texts"))
            kept.remove(same[0])
            gone += both
        rows = self.spark.createDataFrame([*kept, made], "level string, bytes long")
        rows.coalesce(1).write.parquet(f"{self.folder}/manifest/{state[-1] + 1 if state else 0}", mode="overwrite")
        for old_path in gone:
            remove_path(self.spark, old_path)
        return self.spark.read.parquet(f"{path}/removed")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document how many bytes repeated strings of 200 bytes take, and a digest of the rest."""
    found = remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
