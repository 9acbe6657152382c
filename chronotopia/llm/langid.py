"""Language ID by interpolated Kneser-Ney character models, one for each language of the labels.

Texts are lower-cased; letters stay, everything between words is one space. Four successive characters, 16 bits each
(those beyond 16 bits are folded), make a 64-bit key. A model holds, for each order, the sorted keys seen in any
language and the interpolated probability of each in every language, besides the back-off weights of the contexts; a
key that no language has seen backs off through those. The language with the lowest cross-entropy per character wins.

Fitting uses a bounded sample: at most about ``train_docs`` labelled documents in all, shared evenly over the
languages and drawn by a hash of doc_id, and ``calibration_docs`` others, on which the rejection is calibrated: a
document is rejected when its cross-entropy lies above its language's mean by ``slack`` more than that of 98 % of
those, with an allowance for short texts. A language that none of those is predicted as takes the mean and the limit of
all of them together; only where there are none at all is nothing rejected but texts without a letter. Counting n-grams is distributed; the model is bounded by the sample.

Edge cases: a null text or one without a letter is ``und`` with score 0 and rejected; without any labelled row
everything is; rows are independent, so repeated rows and ties in doc_id need no rule; equal cross-entropies go to the
language first by name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, small_batches, table

ORDER = 4
PAD = ORDER - 1
#: Length at which a cross-entropy varies so much that only its part above the mean divided by the root of 2 counts.
SHORT = 100.0
#: Nats a character that a document may lie above 98 % of its language's. With SHORT chosen by measured error rates (README):
#: clean documents, short ones that hold keys too, stay below 0.75, and most text of a language that was not learned above 0.9.
SLACK = 0.9
#: Characters that are scored together.
CHUNK = 1_000_000
_letters: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """For each code point its 16-bit code: of a letter itself (folded), of anything else the space."""
    if not _letters:
        t = np.full(0x110000, 32, np.uint16)
        cp = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
        t[cp] = (cp ^ (cp >> 16)).astype(np.uint16)
        _letters.append(t)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all texts' characters in order; how many each text has; whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + PAD
    pad = b" \0\0\0" * PAD
    data = np.frombuffer(b"".join(x for t in low for x in (pad, t.encode("utf-32-le", "surrogatepass"))), np.uint32)
    code = _codes()[data]
    text = np.repeat(np.arange(len(low)), sizes)
    begins = np.cumsum(sizes) - sizes
    letter = code != 32
    keep = letter | np.r_[True, letter[:-1]] if len(code) else letter
    is_pad = np.zeros(len(code), bool)
    for k in range(PAD):
        is_pad[begins + k] = True
    # After a text's padding a further space would say nothing; a space stays only behind a letter.
    keep = (keep & ~(~letter & np.r_[True, is_pad[:-1]])) | is_pad if len(code) else keep
    code, text, is_pad = code[keep].astype(np.uint64), text[keep], is_pad[keep]
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << np.uint64(16 * k)
    real = ~is_pad
    n = np.bincount(text[real], minlength=len(low))
    return key[real], n, np.bincount(text[real & (code != 32)], minlength=len(low)) > 0


@dataclass
class Model:
    """keys[k-1], p[k-1]: sorted keys and log probabilities of order k; contexts[k-1], gamma[k-1]: log back-off weights."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    gamma: list[np.ndarray] = field(default_factory=list)
    least: float = 0.0
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None

    @staticmethod
    def fit(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: for each language its sorted distinct keys of the highest order and how often each occurs."""
        m = Model(langs)
        own = [counts]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before
            mask = np.uint64((1 << (16 * k)) - 1)
            own.append([np.unique(keys & mask, return_counts=True) for keys, _ in own[-1]])
        own.reverse()
        letters = max(2, len(np.unique(np.concatenate([k for k, _ in own[0]]))) if langs else 2)
        m.least = -np.log(letters + 1)
        lower = None
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x for x, _ in own[k - 1]])) if langs else np.empty(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(16))
            p, gamma = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
            at_lower = np.searchsorted(m.keys[-1], keys & np.uint64((1 << (16 * (k - 1))) - 1)) if k > 1 else None
            of_key = np.searchsorted(contexts, keys >> np.uint64(16))
            for n, (seen, c) in enumerate(own[k - 1]):
                if not len(seen):
                    p[:, n] = lower[at_lower, n] if k > 1 else 1 / (letters + 1)
                    continue
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.75
                at = np.searchsorted(contexts, seen >> np.uint64(16))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                has = total > 0
                gamma[has, n] = d * kinds[has] / total[has]
                base = lower[at_lower, n] if k > 1 else np.full(len(keys), 1 / (letters + 1))
                p[:, n] = gamma[of_key, n] * base
                p[np.searchsorted(keys, seen), n] += (c - d) / total[at]
            m.keys.append(keys)
            m.contexts.append(contexts)
            m.p.append(np.log(p).astype(np.float32))
            m.gamma.append(np.log(gamma).astype(np.float32))
            lower = p
        return m

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each key's last character after the others, in each language."""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        open_ = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            keys, own = self.keys[k - 1], key[open_] & np.uint64((1 << (16 * k)) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            if k == ORDER and hit.all():
                return self.p[-1][at]
            out[open_[hit]] += self.p[k - 1][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                break
            contexts, context = self.contexts[k - 1], own >> np.uint64(16)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            out[open_[known]] += self.gamma[k - 1][at[known]]
        else:
            out[open_] += self.least
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the best language's number (-1: none), posterior, cross-entropy and length."""
        key, n, letter = grams(texts)
        best, post, h = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan)
        some = np.flatnonzero(letter)
        if not self.langs or not len(some):
            return best, post, h, n
        sums = np.zeros((len(texts), len(self.langs)))
        text = np.repeat(np.arange(len(texts)), n)
        for at in range(0, len(key), CHUNK):
            part, own = self.log_p(key[at : at + CHUNK]), text[at : at + CHUNK]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums[own[cuts]] += np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
        s = sums[some]
        best[some] = s.argmax(axis=1)
        top = s.max(axis=1, keepdims=True)
        post[some] = 1 / np.exp(s - top).sum(axis=1)
        h[some] = -top[:, 0] / n[some]
        return best, post, h, n

    def excess(self, best: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far a cross-entropy lies above its language's mean; short texts vary more."""
        return (h - self.mean[best]) * np.sqrt(n / (n + SHORT))


def _held(part: int, of: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part


def _chunks(batch: pa.RecordBatch):
    texts, held, size = batch.column("text"), [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, train_docs: int = 20_000, calibration_docs: int = 4_000, slack: float = SLACK) -> Model:
    """Fit on labelled rows of which crc32(doc_id as text) mod 5 is 1 to 3, calibrate on those where it is 4."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("fold"),
    ).withColumn("fold", F.col("fold") % 5)
    rows = rows.filter("lang IS NOT NULL AND fold <> 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = lambda most: F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(most / len(langs) / sizes[k]))])[F.col("lang")]
    sample = rows.filter((F.col("fold") < 4) & (unit < share(train_docs * 4 / 3)))
    rest = rows.filter((F.col("fold") == 4) & (unit < share(calibration_docs * 4)))

    def count(batches):
        number = {k: n for n, k in enumerate(langs)}
        for b in batches:
            held: dict[int, list[tuple]] = {}
            of = [number[x.as_py()] for x in b.column("lang")]
            at = 0
            for part in _chunks(b):
                key, n, _ = grams(part)
                own = np.repeat(np.array(of[at : at + len(part)]), n)
                at += len(part)
                for k in np.unique(own).tolist():
                    held.setdefault(k, []).append(np.unique(key[own == k], return_counts=True))
            for k, parts in held.items():
                keys, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                c = np.bincount(back, np.concatenate([x for _, x in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(c)], ["l", "key", "c"])

    counted = sample.select("text", "lang").mapInArrow(count, "l int, key long, c long").groupBy("l", "key").agg(F.sum("c").alias("c")).toArrow()
    of, keys, c = (counted.column(x).to_numpy() for x in ("l", "key", "c"))
    keys, per = keys.view(np.uint64), []
    for n in range(len(langs)):
        own = of == n
        order = np.argsort(keys[own])
        per.append((keys[own][order], c[own][order].astype(np.float64)))
    m = Model.fit(langs, per)
    shared = spark.sparkContext.broadcast(m)

    def entropies(batches):
        for b in batches:
            for part in _chunks(b):
                best, _, h, n = shared.value.score(part)
                ok = best >= 0
                yield pa.RecordBatch.from_arrays([pa.array(best[ok].astype(np.int32)), pa.array(h[ok]), pa.array(n[ok].astype(np.int64))], ["l", "h", "n"])

    seen = rest.select("text").mapInArrow(entropies, "l int, h double, n long").toArrow()
    best, h, n = (seen.column(x).to_numpy() for x in ("l", "h", "n"))
    m.mean, m.limit = np.full(len(langs), np.inf), np.full(len(langs), np.inf)
    if len(h):  # of all languages together, for those without a document of their own
        m.mean[:] = np.average(h, weights=np.minimum(n, 1000))
        m.limit[:] = np.quantile(m.excess(best, h, n), 0.98, method="lower") + slack
    for k in range(len(langs)):
        own = best == k
        if own.any():
            m.mean[k] = np.average(h[own], weights=np.minimum(n[own], 1000))
    for k in range(len(langs)):
        own = best == k
        if own.any():
            m.limit[k] = np.quantile(m.excess(best[own], h[own], n[own]), 0.98, method="lower") + slack
    return m


NAMES = ("lang_pred", "score", "cross_entropy", "rejected")


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = NAMES) -> DataFrame:
    """``keep`` columns and, under ``names``, the language, posterior, cross-entropy (nats a character) and rejection."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            m = shared.value
            best, post, h = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.full(b.num_rows, np.nan)
            reject = np.ones(b.num_rows, bool)
            at = 0
            for part in _chunks(b):
                own = slice(at, at + len(part))
                at += len(part)
                best[own], post[own], h[own], n = m.score(part)
                if m.langs:
                    ok = best[own] >= 0
                    k, over = best[own][ok], np.ones(len(part), bool)
                    known = np.isfinite(m.mean[k])
                    over[ok] = known & (m.excess(k, h[own][ok], n[ok]) > m.limit[k])
                    reject[own] = over
            lang = pa.array([m.langs[k] if k >= 0 else "und" for k in best.tolist()], pa.string())
            h_ = pa.array(h, pa.float64(), mask=np.isnan(h))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), lang, pa.array(post), h_, pa.array(reject)], [*keep, *names]
            )

    own = [F.col(f"`{c}`") for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    small_batches(docs)
    src = docs.select(*own) if "text" in keep else docs.select(*own, F.col("text").cast("string").alias("text"))
    new = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double", "boolean")))
    return src.mapInArrow(run, f"{kinds}, {new}")


@own_names("doc_id", "text", "lang")
def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language a model fitted on them does not reject."""
    names = tuple(f"_langid_{n}" for n in NAMES)
    found = predict(docs, train(docs), tuple(docs.columns), names)
    return found.filter(~F.col("_langid_rejected")).select(*docs.columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs))
    held = F.coalesce(_held(0), F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "cross_entropy", "rejected")
