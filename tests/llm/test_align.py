import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from util import documents, prose, some_rows

from chronotopia.llm import align as M
from chronotopia.llm.bpe import PairIndexBPE

ODD = ["a  b", " a", "a ", "a\tb\n c", "x ▁ y", "▁", "a ▁b", "\0a", "<s> <0x41> </s>", "<|endoftext|> x", "ﬁ é", "a b", "don't we'll", "日本語 テキスト", "🙂🙂 ok", "foo \n", "foo \n bar", "t \x1c u", "　 x", "x　 y", "a" * 500]


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = M.default_paths()
    ref = Tokenizer.from_file(a)
    ref.encode_special_tokens = True
    return ref, sentencepiece.SentencePieceProcessor(model_file=b)


def letters_of_bytes():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def one(both, text):
    """Groups as lists of ids, and the links that end together, token by token."""
    ref, sp = both
    if not text:
        return [], []
    to = letters_of_bytes()
    a = [(i, bytes(to[c] for c in ref.id_to_token(i))) for i in ref.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    b = [(i, piece(i)) for i in sp.encode(text)]
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (a, b)):
        return [], []
    ends = lambda side: [sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))]
    ea, eb = (ends(side) for side in (a, b))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        x, y = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
        i, j = x, y
    return groups, [(t, u) for (t, _), e in zip(a, ea) for (u, _), f in zip(b, eb) if e == f]


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(both, rows, links_of=lambda found: found[1]):
    found = [(i, one(both, t)) for i, t in rows]
    n = collections.Counter(p for _, f in found for p in links_of(f))
    best = collections.defaultdict(int)
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    out = []
    for i, f in found:
        groups, links = f[0], links_of(f)
        text = shown(groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_query_is_as_brute_force(spark, tmp_path, both):
    rng = random.Random(2)
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in some_rows(11, 30)] + [(600 + i, t) for i, t in enumerate(ODD)]
    rows += [(700 + i, "".join(rng.choice("ab é\n▁ ,.🙂") for _ in range(rng.randint(1, 30)))) for i in range(150)] + [(None, "no id"), (None, "no id")]
    d = documents(spark, tmp_path, rows, "n_a")
    assert sorted(map(tuple, M.op11_align(spark, d).collect()), key=str) == expected(both, rows)
    # Without a broadcast of the pairs, and with few parts kept between batches.
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert sorted(map(tuple, M.align(docs, *M.default_paths(), digest=True, most=0).collect()), key=str) == expected(both, rows)
    whole = M.align(docs, *M.default_paths(), keep=("doc_id", "lang")).filter("doc_id = 600").first()
    assert whole.lang == "en" and whole.groups == shown(one(both, "a  b")[0])


def test_all_pairs_of_a_group(spark, tmp_path, both):
    rows = [(i, prose(random.Random(i), 20) + " zyxwv qqjx") for i in range(20)]
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    every = lambda f: [(x, y) for a, b in f[0] for x in a for y in b]
    assert sorted(map(tuple, M.align(docs, *M.default_paths(), rule="group", digest=True).collect()), key=str) == expected(both, rows, every)
    counts = {(r.a, r.b): r.n for r in M.pair_counts(docs, *M.default_paths(), rule="group").collect()}
    assert counts == collections.Counter(p for _, t in rows for p in every(one(both, t)))


def test_parts_are_forgotten_and_learned_again(both, monkeypatch):
    monkeypatch.setattr(M, "CACHE_PARTS", 40)
    aligner = M.Aligner(*(open(p, "rb").read() for p in M.default_paths()))
    for k in range(60):
        text = prose(random.Random(k), 40) + f" w{k} ▁x"[: 3 + 3 * (k % 2)]
        groups, links = one(both, text)
        (at,) = aligner.slots_of([text])
        assert aligner.groups(at) == shown(groups)
        codes, n = aligner.pairs([at])
        assert {(c >> 32, c & 0xFFFFFFFF): m for c, m in zip(codes.tolist(), n.tolist())} == collections.Counter(links)


def test_texts_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.read.parquet(documents(spark, tmp_path, [(i, prose(random.Random(i), 5)) for i in range(40)]) + "/documents.parquet")
    for most in (M.MOST_PAIRS, 0):
        assert M.align(docs.withColumn("text", seen("text")), *M.default_paths(), digest=True, most=most).count() == 40
        assert read.value == 40
        read.value = 0


def test_short_words_are_merged_in_few_rounds():
    content = open(M.default_paths()[0], "rb").read()
    rng, encoder, index = random.Random(5), M.plain_bpe(content), PairIndexBPE(content)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))).encode() for letters in ("a", "ab", "aeinrst", " the", "é🙂ß日") for _ in range(300)]
    words += [w.encode() for w in prose(rng, 300).split()] + [bytes([k]) for k in range(256)] + [b"", b"a" * 64, b"a" * 65, b"-" * 63]
    rng.shuffle(words)
    assert encoder.merge(words) == index.merge(words)
    assert encoder.merge([]) == [] and encoder.merge([b"x" * 99]) == index.merge([b"x" * 99])
    calls, plain = [], encoder.rank
    encoder.rank = lambda a, b: calls.append(1) or plain(a, b)
    encoder.merge([w for w in words if len(w) <= 64])
    assert len(calls) <= 65


def test_empty_table_and_unknown_rule(spark, tmp_path):
    d = documents(spark, tmp_path, [])
    assert M.op11_align(spark, d).collect() == []
    with pytest.raises(ValueError):
        M.Aligner(*(open(p, "rb").read() for p in M.default_paths()), rule="no")
