"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a piece model with byte fallback (B) end together.

A text is cut at single blanks between other characters. No token of either vocabulary reaches over such a cut (A's
pre-tokenisation ends a word there; that no piece of B holds a blank after another character is checked when the model
is read), so every cut is a common one and a part's alignment does not depend on what stands around it. A task aligns the
distinct parts it meets at once: token ends by cumsum, common cuts by intersect1d, groups by searchsorted, links by
repeating each A token over the run of B tokens that it is linked with. What a document has is the sum of its parts'.

Texts are read and encoded once. What does not hang on the counts of pairs is written to the shared folder as Parquet, with
each text's distinct pairs (A id, B id) and how often it holds them. From there pairs are summed in the task, then by (pair,
salt), then by pair, and their counts go back to the rows by a broadcast if the pairs are at most MOST_PAIRS, else by a join. Under the rule "end" one token of a pair is a suffix of the
other, so the vocabularies bound the pairs: some tens of thousands of tokens have a few suffixes each.

Edge cases: null and empty texts, and texts whose tokens of a side don't spell blank + text (B writes U+2581 as a blank),
have no tokens. Very long texts are cut into parts like all others. Rows are independent, so ties and repeated rows need no
rule; an empty table gives no rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PairIndexBPE
from .common import checkpointed, join_hot, shared_folder, small_batches, table

#: Pairs that are broadcast at most (17 bytes each), parts kept between batches, and the salts of the first sum.
MOST_PAIRS, CACHE_PARTS, SALTS = 2_000_000, 300_000, 16
#: Pairs that a task holds before it passes their sums on.
HELD_PAIRS = 1_000_000
#: Bytes of a word that is merged in rounds; a longer one could need a round for each of its bytes.
SHORT = 64
#: A blank between two other characters; U+2581 is B's own sign for a blank. UNCUT is any other blank.
CUT = re.compile(" (?<=[^\\s▁] )(?=[^ ▁])")
UNCUT = re.compile(" (?:(?<![^\\s▁] )|(?![^ ▁]))")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class RoundsBPE(PairIndexBPE):
    """Short words are merged in rounds, in each of which every word merges its pair of lowest rank; so there are no more rounds than bytes in a word, over all words at once."""

    def merge(self, words: list[bytes]) -> list[bytes]:
        out = dict.fromkeys([i for i, w in enumerate(words) if len(w) > SHORT])
        out.update(zip(out, super().merge([words[i] for i in out]) if out else ()))
        short = [w for w in words if len(w) <= SHORT]
        word, sym = self.rounds(short)
        ids, stops = sym.astype("<u4").tobytes(), (np.searchsorted(word, np.arange(len(short)), "right") * 4).tolist()
        rest = (ids[i:j] for i, j in zip([0, *stops], stops))
        return [out[i] if i in out else next(rest) for i in range(len(words))] if out else list(rest)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of every token of the words, in order."""
        none = np.iinfo(np.int64).max
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank, done = np.full(len(sym), none), [(word[:0], sym[:0])]

        def ranked(at: np.ndarray) -> None:
            """Rank of the pairs that begin at these symbols."""
            rank[at] = none
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            found = self.rank(sym[at], sym[at + 1])
            rank[at] = np.where(found < 0, none, found)

        ranked(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym)))
            live = low < none
            if not live.all():  # words without a pair left are done
                done.append((word[~live], sym[~live]))
                word, sym, rank, low = word[live], sym[live], rank[live], low[live]
            at = np.flatnonzero(rank == low)
            follows = np.r_[False, at[1:] == at[:-1] + 1][: len(at)]
            if follows.any():  # in a run of equal symbols, every other pair from its start
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            word, sym, rank = word[kept], sym[kept], rank[kept]
            at -= np.arange(len(at))
            ranked(np.concatenate([at, at[at > 0] - 1]))
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], sym[order]


def plain_bpe(content: bytes) -> RoundsBPE:
    """A's encoder; the strings of its special tokens are plain text."""
    spec = json.loads(content)
    spec["added_tokens"] = []
    return RoundsBPE(json.dumps(spec).encode())


class Slots(dict):
    """A place for each part, in the order in which they are first asked for."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


class Aligner:
    """Alignments of the parts met lately. ``texts``: if the groups' text is wanted."""

    def __init__(self, a: bytes, b: bytes, rule: str = "end", texts: bool = True) -> None:
        from sentencepiece import SentencePieceProcessor

        if rule not in ("end", "group"):
            raise ValueError(f"unknown rule {rule!r}")
        self.rule, self.a, self.b = rule, plain_bpe(a), SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece reaches over a blank")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a.bytes, self.b_bytes))
        # What a token puts into the groups' text: itself and the sign after it, inside a group or at its end.
        self.a_text = [f"{i}{end}" for i in range(len(self.a.bytes)) for end in ",|"] if texts else None
        self.b_text = [f"{i}{end}" for i in range(len(pieces)) for end in ",;"] if texts else None
        self.slots = Slots()
        self.texts, self.uses, self.good = [], np.empty(0, np.int64), np.empty(0, bool)
        self.numbers, self.codes = np.empty((0, 4), np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        """Keep the half of the parts that was used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_PARTS // 2])
        names = list(self.slots)
        self.codes = self.codes_of(kept)
        self.slots = Slots({names[k]: i for i, k in enumerate(kept.tolist())})
        self.texts = [self.texts[k] for k in kept.tolist()] if self.texts else []
        self.uses, self.good, self.numbers = self.uses[kept] // 2, self.good[kept], self.numbers[kept]

    def codes_of(self, at: np.ndarray) -> np.ndarray:
        """Codes of all links of the parts at these places, in order."""
        links = self.numbers[:, 3]
        begin, n = (np.cumsum(links) - links)[at], links[at]
        return self.codes[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]

    def side_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all parts, and where each part's end. Parts' ends are words' ends, but for white space at a text's end."""
        calm = [i for i, p in enumerate(parts) if p and not p[-1].isspace()]
        words = self.a.words.findall("".join([f" {parts[i]}" for i in calm]))
        ids = dict.fromkeys(words)
        ids = dict(zip(ids, self.a.merge([w.encode("utf-8", "replace") for w in ids])))
        flat = np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4").astype(np.int64)
        if len(calm) == len(parts):
            return flat, np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum([len(p.encode()) + 1 for p in parts])) + 1
        stops = np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum([len(parts[i].encode()) + 1 for i in calm])) + 1 if calm else []
        found = dict(zip(calm, np.split(flat, stops)))
        odd = [i for i in range(len(parts)) if i not in found or not parts[i] or parts[i][-1].isspace()]
        found.update(zip(odd, (np.frombuffer(x, "<u4").astype(np.int64) for x in self.a.encode(f" {parts[i]}" for i in odd))))
        each = [found[i] for i in range(len(parts))]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def side_b(self, parts: list[str], spelled: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """B's ids of all parts, where each part's end, and which parts they spell."""
        each, n = self.b.encode(parts, num_threads=1), len(parts)
        sizes, flat = np.fromiter(map(len, each), np.int64, n), list(chain.from_iterable(each))
        good = np.ones(n, bool)
        if b"".join(map(self.b_bytes.__getitem__, flat)) != spelled:
            good = np.fromiter((b"".join(map(self.b_bytes.__getitem__, y)) == f" {p}".encode() for y, p in zip(each, parts)), bool, n)
        return np.array(flat, np.int64), np.cumsum(sizes), good

    def learn(self, parts: list[str]) -> None:
        """Align these new parts and keep what comes out; parts that B doesn't spell have no tokens."""
        ib, stops_b, good = self.side_b(parts, "".join([f" {p}" for p in parts]).encode())
        spelled = parts
        if not good.all():
            spelled = [p for p, g in zip(parts, good) if g]
            ib, stops_b, _ = self.side_b(spelled, "".join([f" {p}" for p in spelled]).encode())
        numbers, texts = np.zeros((len(parts), 4), np.int64), iter(())
        if spelled:
            numbers[good], codes, texts = self.aligned(spelled, ib, stops_b)
            self.codes = np.r_[self.codes, codes]
        self.texts += [next(texts) if g else "" for g in good.tolist()] if self.a_text else []
        self.uses = np.r_[self.uses, np.zeros(len(parts), np.int64)]
        self.good, self.numbers = np.r_[self.good, good], np.r_[self.numbers, numbers]

    def aligned(self, parts: list[str], ib: np.ndarray, stops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[str]]:
        """Numbers, codes of links and groups' texts of these parts, whose B ids are given."""
        ia, stops_a = self.side_a(parts)
        n, na, nb = len(parts), np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        # All parts as one text: a part's last ends are common, so no group reaches over them.
        ends_a, ends_b = np.cumsum(self.a_size[ia]), np.cumsum(self.b_size[ib])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        x, y = (ends_a, ends_b) if self.rule == "end" else (ga, gb)
        first = np.searchsorted(y, x, "left")
        times = np.searchsorted(y, x, "right") - first
        left = np.repeat(np.arange(len(ia)), times)
        right = np.arange(len(left)) + np.repeat(first - (np.cumsum(times) - times), times)
        codes = ia[left] * len(self.b_size) + ib[right]
        of_a = np.repeat(np.arange(n), na)
        count = lambda at: np.bincount(at, minlength=n).astype(np.int64)
        numbers = np.stack([na, nb, count(of_a[np.searchsorted(ends_a, cuts)]), count(of_a[left])], axis=1)
        texts = iter(())
        if self.a_text:
            # Tokens in the order in which the groups' text names them: a group's A tokens, then its B tokens.
            signs = np.empty(len(ia) + len(ib), object)
            last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)].astype(np.int64)
            signs[np.arange(len(ia)) + np.searchsorted(gb, ga, "left")] = [self.a_text[k] for k in (2 * ia + last(ga)).tolist()]
            signs[np.arange(len(ib)) + np.searchsorted(ga, gb, "right")] = [self.b_text[k] for k in (2 * ib + last(gb)).tolist()]
            signs, stops = signs.tolist(), (stops_a + stops_b).tolist()
            texts = ("".join(signs[i:j]) for i, j in zip([0, *stops], stops))
        return numbers, codes, texts

    def slots_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The parts of each text, as places in what is kept; none where a text has no tokens."""
        parts = [(CUT.split(t) if UNCUT.search(t) else t.split(" ")) if t else [] for t in texts]
        if len(self.slots) > CACHE_PARTS:
            self.forget()
        known = len(self.slots)
        every = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(parts)), np.int64)
        if len(self.slots) > known:
            self.learn(list(islice(self.slots, known, None)))
        self.uses += np.bincount(every, minlength=len(self.uses))
        out = np.split(every, np.cumsum([len(p) for p in parts])[:-1]) if parts else []
        return [at if self.good[at].all() else at[:0] for at in out]

    def links(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's pairs end, their codes in ascending order, and how often each is linked in the text."""
        each, nb = np.array([self.numbers[at, 3].sum() for at in slots], np.int64), len(self.b_size)
        codes, span = self.codes_of(np.concatenate([*slots, np.empty(0, np.int64)])), len(self.a_size) * nb
        keys, times = np.unique(np.repeat(np.arange(len(slots)), each) * span + codes, return_counts=True)
        codes = keys % span
        return np.searchsorted(keys, np.arange(1, len(slots) + 1) * span), (codes // nb << 32) | codes % nb, times

    def pairs(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs linked in these texts, and how often each is."""
        return self.links([np.concatenate([*slots, np.empty(0, np.int64)])])[1:]

    def groups(self, slots: np.ndarray) -> str:
        return "".join(map(self.texts.__getitem__, slots.tolist()))[:-1]


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its numbers; those without any go."""
    codes, n = codes[n > 0], n[n > 0]
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[starts], np.add.reduceat(n, starts) if len(n) else n


def _texts(batches: Iterable[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of some ``most`` characters, with their texts."""
    for b in batches:
        texts = b.column("text").to_pylist()
        bins = np.cumsum([len(t or "") for t in texts]) // most
        for start in np.unique(bins, return_index=True)[1].tolist() if len(texts) else []:
            stop = int(np.searchsorted(bins, bins[start], "right"))
            yield b.slice(start, stop - start), texts[start:stop]


def _source(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    small_batches(docs)
    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))


def _models(spark: SparkSession, a_path: str, b_path: str):
    return spark.sparkContext.broadcast((open(a_path, "rb").read(), open(b_path, "rb").read()))


_made: dict[str, Aligner] = {}


def _aligner(key: str, *args) -> Aligner:
    """The worker's aligner, kept for its next tasks while these are of the same job."""
    if key not in _made:
        _made.clear()
        _made[key] = Aligner(*args)
    return _made[key]


def _empty() -> tuple[np.ndarray, np.ndarray]:
    return np.empty(0, np.int64), np.empty(0, np.int64)


def _held(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's (codes, n), passed on when there are over HELD_PAIRS."""
    held = _empty()
    give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["code", "n"])
    for codes, n in found:
        held = summed(np.r_[held[0], codes], np.r_[held[1], n])
        if len(held[0]) > HELD_PAIRS:
            yield give()
            held = _empty()
    yield give()


def _totals(parts: DataFrame) -> DataFrame:
    """(code, a, b, n, best) from sums of tasks."""
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    total = parts.groupBy("code", "salt").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("n"))
    total = total.select("code", F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, rule: str = "end") -> DataFrame:
    """(code, a, b, n, best): how many links of all texts hold each id pair, and if no other pair of that B id has more."""
    models, job = _models(docs.sparkSession, a_path, b_path), uuid.uuid4().hex

    def run(batches):
        aligner = _aligner(job, *models.value, rule, False)
        yield from _held(aligner.pairs(aligner.slots_of(texts)) for _, texts in _texts(batches))

    return _totals(_source(docs, ()).mapInArrow(run, "code long, n long"))


def _aligned(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...], rule: str, digest: bool) -> DataFrame:
    """k0, k1, ... (``keep``), COUNTS, the groups or their digest, codes and times of each row's distinct pairs, and _row, a number of the row."""
    models, job = _models(docs.sparkSession, a_path, b_path), uuid.uuid4().hex

    def run(batches):
        aligner = _aligner(job, *models.value, rule)
        for b, texts in _texts(batches):
            slots = aligner.slots_of(texts)
            numbers = np.array([aligner.numbers[at].sum(axis=0) for at in slots], np.int64).reshape(-1, 4)
            text = [aligner.groups(at) for at in slots]
            if digest:
                text = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
            stops, *linked = aligner.links(slots)
            stops = pa.array(np.r_[0, stops].astype(np.int32))
            lists = [pa.ListArray.from_arrays(stops, pa.array(x)) for x in linked]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, numbers.T.copy()), pa.array(text, pa.string()), *lists], names)

    src, out = _source(docs, keep), "groups_sha256" if digest else "groups"
    names = [*src.columns[:-1], *COUNTS, out, "codes", "times"]
    kinds = {f.name: f.dataType.simpleString() for f in src.schema} | {out: "string", "codes": "array<long>", "times": "array<long>"}
    return src.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names)).withColumn("_row", F.monotonically_increasing_id())


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy()


def align(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",), rule: str = "end", digest: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (or, with ``digest``, groups_sha256) of every row.

    ``rule``: "end" links tokens that end together, "group" all A with all B tokens of a group. The rows returned are made
    from a table in the shared folder, which stays.
    """
    spark, stored = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/align-{uuid.uuid4().hex}"
    _aligned(docs, a_path, b_path, keep, rule, digest).write.parquet(stored)
    rows = spark.read.parquet(stored)
    parts = rows.select("codes", "times").mapInArrow(lambda batches: _held((_flat(b, "codes"), _flat(b, "times")) for b in batches), "code long, n long")
    pairs = checkpointed(_totals(parts))
    if pairs.count() <= most:
        rows = _looked_up(rows, pairs)
    else:
        rows = _counted(rows, pairs)
    out = "groups_sha256" if digest else "groups"
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *COUNTS, "n_best", "count_sum", out)


def _looked_up(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_best and count_sum from a broadcast of all pairs' counts."""
    got = pairs.select("code", "n", "best").toPandas().sort_values("code")
    counts = rows.sparkSession.sparkContext.broadcast((got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))

    def run(batches):
        codes, n, best = counts.value
        for b in batches:
            at, times = np.searchsorted(codes, _flat(b, "codes")), _flat(b, "times")
            stops = np.cumsum(b.column("codes").value_lengths().to_numpy())
            sums = [np.diff(np.r_[0, np.cumsum(times * x[at])][stops], prepend=0) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *map(pa.array, sums)], names)

    kept = [f for f in rows.schema if f.name not in ("codes", "times", "_row")]
    names = [*(f.name for f in kept), "n_best", "count_sum"]
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_best long", "count_sum long"])
    return rows.select(*(f.name for f in kept), "codes", "times").mapInArrow(run, kinds)


def _counted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_best and count_sum by a join of the rows' pairs with all pairs' counts; frequent pairs meet by a broadcast."""
    linked = rows.select("_row", F.explode(F.arrays_zip("codes", "times")).alias("_l")).select("_row", "_l.codes", "_l.times").withColumnRenamed("codes", "code")
    held = linked.groupBy("code").agg(F.count("*").alias("_n"))
    joined = join_hot(linked, pairs.select("code", "n", "best").join(held, "code"), "code", max(1, linked.count()))
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of every document's alignment of two tokenizers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, *default_paths(), digest=True)
