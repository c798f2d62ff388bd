"""BPE, collocations and resampling against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import DOCS, empty, messy  # noqa: F401

from tidewater.llm import bpe, collocations, crc, resampling

FILE = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, messy, library):  # noqa: F811
    rows = messy.select("doc_id", "text").collect()
    got = bpe.encode(messy, FILE).withColumn("decoded", bpe.decode(F.col("ids"), FILE)).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    for r, g in zip(rows, got, strict=True):
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert g.ids == want and g.decoded == library.decode(want, skip_special_tokens=False)
    d = {repr(r): r for r in bpe.digests(messy, FILE).collect()}
    first = library.encode(rows[3].text, add_special_tokens=False).ids
    assert hashlib.sha256(" ".join(map(str, first)).encode()).hexdigest() in {r.ids_sha256 for r in d.values()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in d.values() if r.doc_id == 1] == [(0, nothing, nothing)]


ODD = st.text(alphabet="abceghinorst'SMDL l09 \x00\x1c\x1f\x7f\x85́éÉßİΣ中ǅ\U0001f600 \xa0.,-\t\n", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "aaaaaaa", "tionally"])), max_size=5))
def test_bpe_of_any_text(parts):
    from tokenizers import Tokenizer

    text, t = "".join(parts), Tokenizer.from_file(FILE)
    got = np.frombuffer(bpe.codec(FILE).encode(text), np.int32).tolist()
    want = t.encode(text, add_special_tokens=False).ids
    assert got == want and bpe.decoded(got, FILE) == t.decode(want, skip_special_tokens=False)


def test_bpe_of_long_words(library):
    r = random.Random(4)
    for text in ("a" * 100_000, "".join(r.choice("abn") for _ in range(50_000)), "x'" * 20_000):
        assert np.frombuffer(bpe.codec(FILE).encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def plain_merges(symbols, merges):
    rank = {m: i for i, m in enumerate(merges)}
    while len(symbols) > 1:
        r, i = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if r == 1 << 30:
            break
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return symbols


def test_prefixes_of_random_vocabularies():
    """Merges of random vocabularies, also such that leave tokens unreachable and pairs of equal rank."""
    import ahocorasick

    r = random.Random(8)
    for _ in range(60):
        tokens, merges = list("ab"), []
        for _ in range(r.randrange(1, 14)):
            pair = (r.choice(tokens), r.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        vocab = {t: i for i, t in enumerate(tokens)}
        c = object.__new__(bpe.Codec)
        c.merges, c.suffix, c.base, c.pairs, c.automaton = bpe.Merges(vocab, merges, ""), "", len(tokens), {}, ahocorasick.Automaton()
        c.length = [len(t) if c._whole(i) else 0 for i, t in enumerate(tokens)]
        for t, i in vocab.items():
            if c.length[i]:
                c.automaton.add_word(t, i)
            assert (c.length[i] > 0) == (plain_merges(list(t), merges) == [t])
        c.automaton.make_automaton()
        for _ in range(40):
            text = "".join(r.choice("ab") for _ in range(r.randrange(1, 16)))
            assert [tokens[i] for i in c.word(text)] == plain_merges(list(text), merges)


def test_bpe_of_other_files_and_tables(empty):  # noqa: F811
    with pytest.raises(ValueError, match="supported"):
        bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.digests(empty, FILE).count() == 0


# ---- 13


def test_crcs_compose():
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 3, 5, 8, 127, 128, 129, 1000, 70_000, 1, 4)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    words = crc.word_crcs(data, np.cumsum(lengths) - lengths, lengths)
    for k, got in enumerate(crc.run_crcs(words, lengths, 4), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(texts[i : i + k])) for i in range(len(texts) - k + 1)]


def plain_resample(rows, target, orders, buckets, percent, least, seed=2024):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    found = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (S + buckets) / (float(s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(long):
        r.append(i + 1 if i < percent * len(long) // 100 else None)
    return [tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_equals_plain(spark, messy, orders):  # noqa: F811
    target = spark.createDataFrame([("one two three of it",), (None,), ("",), ("abcd efgh Zoë 12",)], "text string").withColumn("n_words", F.lit("clash"))
    more = messy.unionByName(messy.where("doc_id > 120")).repartition(7)
    rows = [(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()]
    got = resampling.resample(more, target, orders, 500, 40, 2)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(rows, [r.text for r in target.collect()], orders, 500, 40, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_resampling_of_nothing(spark, empty, messy):  # noqa: F811
    assert resampling.resample(empty, empty).count() == 0
    assert {r.weight for r in resampling.resample(messy, empty, 1, least_words=10**6).collect()} != {None}
    assert resampling.resample(messy, empty, 1, least_words=10**6).where("rank IS NOT NULL").count() == 0


# ---- 12


def plain_collocations(rows, longest, least, most, percent=80, scale=2_000_000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {(lang, p): a for (lang, p), a in f.items() if a >= least and len(p) > 1}
    gone = {(lang, p[i : i + k]) for (lang, p), a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * f[lang, p[i : i + k]]}
    by_lang = {}
    for (lang, p), a in frequent.items():
        if (lang, p) not in gone:
            score, _, left, right = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:most])]


@pytest.mark.parametrize(("block_words", "longest"), [(40, 4), (1 << 22, 4), (300, 2), (300, 5)])
def test_collocations_equal_plain(spark, messy, block_words, longest):  # noqa: F811
    r = random.Random(6)
    fixed = ["New York city", "of the", "a b a b a b", "É x", "deep blue sea now", "\x00 odd"]
    texts = [(" ".join(r.choice(fixed) if r.random() < 0.4 else r.choice("uvwxyz") for _ in range(r.randrange(40))).replace("z z", r.choice([". ", "\n", "\t", "!"])), r.choice(["en", "EN", None, "und"])) for _ in range(150)]
    rows = texts + [(x.text, x.lang) for x in messy.where("doc_id > 100 OR doc_id IS NULL").select("text", "lang").collect()] + [(None, "en"), ("", None), ("one, two", "only")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("words", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, collocations.collocations(df, longest, 6, 60, block_words=block_words).collect()), key=repr)
    assert got == sorted(plain_collocations(rows, longest, 6, 60), key=repr) and got


def test_collocations_of_nothing(spark, empty):  # noqa: F811
    assert collocations.collocations(empty).count() == 0
    rare = spark.createDataFrame([(1, "each word once", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(rare).count() == 0
    words = spark.createDataFrame([(1, "same. " * 100, "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(words).count() == 0


def test_lists_round_trip():
    r = np.random.default_rng(1)
    counts = r.integers(1, 9, 50)
    positions = np.concatenate([np.sort(r.choice(1000, n, replace=False)) for n in counts]).astype(np.int32)
    assert collocations.unpacked(collocations.packed(positions, counts), counts).tolist() == positions.tolist()


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**13, 10**13 + 1)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    x = df.select((F.lit(2_000_000).cast("decimal(10,0)") * wide("a")).alias("x"), (wide("l") + wide("r")).alias("y")).select(F.expr("x div y"))
    assert x.first()[0] == 2_000_000 * 10**13 // (2 * 10**13 + 1)
