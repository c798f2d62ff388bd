"""Each operator against a plain version, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat, common, exact_dedup, jaccard_join, language_id, mixing, packing, quality, token_counts, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = ["size", "target", "h", "c", "n", "key", "label", "rank", "length", "piece", "bucket", "_gone", "norm", "sha", "rate", "source_size", "node", "_copy", "_language", "p"]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def messy(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [r.choice(vocabulary) for _ in range(60)]
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \t\n", None, "b", None),
        (4, "One two", "en", "a", 7),
        (5, "ONE TWO", "en", "a", 7),
        (5, "ONE TWO", "en", "a", 7),
        (None, "one two", "en", "b", 7),
        (None, " ".join(base), None, None, None),
        (6, " ".join(r.choice(vocabulary) for _ in range(30_000)), "en", "a", 1),
        (7, "É é <|endoftext|>  x\n \ny ▁▁ 中文 \x00", "fr", "c", 1),
        (9, "123 !!", None, "c", 1),
        (10, "x" * 50_000, "en", "b", 1),
    ]
    for i in range(40):
        edited = list(base)
        for _ in range(i % 4):
            edited[r.randrange(60)] = r.choice(vocabulary)
        rows.append((100 + i, " ".join(edited), "en", r.choice("abc"), i))
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def taken(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---- 1


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    """rows: (id or None, text). (id, size, component) of each."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations([i for i, (d, s) in enumerate(sets) if s and d is not None], 2):
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(s), min(least[find(i)]) if d is not None else None) for i, (d, s) in enumerate(sets)), key=repr)


def plain_survivors(rows):
    """Of each component, ids that are null taken as the last: one row of the least id; of rows that share id and text, one."""
    once = list({(r.doc_id, r.text or ""): r for r in rows}.values())
    order = sorted(range(len(once)), key=lambda i: (once[i].doc_id is None, once[i].doc_id or 0, hashlib.md5((once[i].text or "").encode()).digest()))
    named = plain_components([(k, once[i].text) for k, i in enumerate(order)])
    return sorted(repr(once[order[k]]) for k, _, c in named if k == c)


def test_components_match_brute_force(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert taken(jaccard_join.near_duplicate_components(messy), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_components_of_random_sets(spark):
    """Short sets from few words, so that many pairs are near the threshold and lists are long."""
    r = random.Random(8)
    rows = []
    for family in range(12):
        base = [r.choice("abcdefghij") + str(family % 3) for _ in range(r.randint(4, 40))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice("klmn")
            rows.append((len(rows), " ".join(w + base[: r.randint(0, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert taken(jaccard_join.near_duplicate_components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_bitmaps_of_large_sets_rule_out_no_link():
    """Sets around 1,024 and 2,048 shingles, where a bitmap is twice as wide as the next; of sets of 9,000, what shares a quarter only is ruled out."""
    r = random.Random(6)
    sets = []
    for size in (1000, 1030, 1900, 2060, 2600):
        base = np.array([r.getrandbits(64) for _ in range(size)], np.uint64)
        for _ in range(8):
            h = base[np.array([r.random() for _ in base]) > r.choice((0.02, 0.08, 0.12))]
            more = np.array([r.getrandbits(64) for _ in range(r.randint(0, size // 10))], np.uint64)
            sets.append(np.unique(np.concatenate((h, more))))
    shared = np.array([r.getrandbits(64) for _ in range(2250)], np.uint64)
    large = [np.unique(np.concatenate((shared, np.array([r.getrandbits(64) for _ in range(6750)], np.uint64)))) for _ in range(4)]
    sets += large
    k = len(sets)
    maps = [jaccard_join._bitmap(h) for h in sets]
    assert len({len(x) for x in maps}) == 4
    zero, c = [0] * k, list(range(k))
    cell = {"hub": zero, "i": zero, "j": [1] * k, "block": [x % 2 for x in c], "c": c, "cb": c, "n": [len(h) for h in sets], "lc": c, "lcb": zero, "bits": [x.tolist() for x in maps]}
    got = set(jaccard_join._possible_members(pa.table(cell)).column("c").to_pylist())
    want = set()
    for x in range(0, k, 2):
        for y in range(1, k, 2):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                want |= {x, y}
    assert 10 < len(want) and want <= got and not got & set(range(k - len(large), k))


def test_long_texts_match_brute_force(spark):
    r = random.Random(16)
    rows = []
    for size in (1000, 1040, 2080):
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        for _ in range(7):
            w = list(base) + [f"x{i}" for i in range(r.randint(0, 60))]
            for _ in range(r.choice((5, 20, 24, 30))):
                w[r.randrange(size)] = f"v{r.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert taken(jaccard_join.near_duplicate_components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_salted_lists_and_small_blocks_lose_no_link(spark, monkeypatch):
    """All that is done for long lists, on short ones; the boundary at both ends."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(50)] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows)
    monkeypatch.setattr(jaccard_join, "CELL", 7)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 9)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    plain = jaccard_join.Signer.prefix

    def often(self, h, more):
        e, f = plain(self, h, more)
        return e, np.where(np.arange(len(f)) % 2, 3.0 * jaccard_join.PART, 1.0)

    monkeypatch.setattr(jaccard_join.Signer, "prefix", often)
    for boundary in (0, 200):
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_, b=boundary: b)
        assert taken(jaccard_join.near_duplicate_components(df), "doc_id", "n_shingles", "component_id") == want


def test_boundary_is_of_least_cost():
    assert jaccard_join.choose_boundary({10: (100.0, 10.0), 100: (50.0, 900.0)}) == 12  # below, sets of 10 would be in lists of single elements too
    assert jaccard_join.choose_boundary({10: (1.0, 10.0)}) == 0
    assert jaccard_join.choose_boundary({}) == 0


def test_costs_cover_every_set_of_its_size(spark):
    """Each short set again in a text that is long because of its spaces or of its repeated words: the costs grow in proportion."""
    short = [" ".join(f"{i}w{j}" for j in range(20 + i)) for i in range(5)]
    spaced = [" " * 50_000 + t for t in short]
    again = [(t + " ") * 900 + t for t in short]

    def costs(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sets = jaccard_join._sets(docs, 200).cache()
        levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
        return jaccard_join._costs(sets, spark.sparkContext.broadcast(jaccard_join.Signer(levels, 0)), 200)

    once = costs(short)
    assert set(once) == {len(shingles(t)) for t in short} and costs(short + spaced) == {n: (2 * a, 2 * b) for n, (a, b) in once.items()}
    assert set(costs(again)) == {len(shingles(t)) for t in again} and max(costs(again)) < 30


def test_overlaps_are_those_of_sets():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300))).astype(np.uint64) for _ in range(60)]
    sets += [np.unique(np.concatenate((np.arange(1000, 1090), r.integers(2000, 9000, 6)))).astype(np.uint64) for _ in range(60)]
    got = jaccard_join.overlaps(sets)
    assert all(got[i, j] == (len(np.intersect1d(sets[i], sets[j])) if i < j else 0) for i in range(120) for j in range(120))


def test_one_hub_of_thousands(spark):
    """3,000 sets around one, of which few link: each differs from the base in about the share that the threshold allows, and a long text of few shingles is among them."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(3000):
        w = list(base)
        for k in range(2 if i % 3 else 1):
            w[r.randrange(60)] = f"v{r.randrange(9)}x{k}"
        rows.append((i, " ".join(w)))
    rows.append((3000, (" ".join(base) + " ") * 500))
    got = {x.doc_id: x for x in jaccard_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    elements, of = {}, []
    for _, t in rows:
        of.append([elements.setdefault(x, len(elements)) for x in shingles(t)])
    has = np.zeros((len(rows), len(elements)), np.float32)
    for i, x in enumerate(of):
        has[i, x] = 1
    n, overlap = has.sum(1), has @ has.T
    links = 9 * overlap >= 4 * (n[:, None] + n[None, :])
    label = np.arange(len(rows))
    while True:  # the least label that links reach
        new = np.array([label[x].min() for x in links])
        if (new == label).all():
            break
        label = new
    assert [got[i].component_id for i in range(len(rows))] == label.tolist() and len(set(label.tolist())) > 1
    assert [got[i].n_shingles for i in range(len(rows))] == n.tolist()


def test_near_duplicates_go_once(messy, empty):
    kept = jaccard_join.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(map(repr, kept.collect())) == plain_survivors(messy.collect())
    assert jaccard_join.near_duplicate_components(empty).count() == 0


def test_ids_that_stand_with_several_texts(spark):
    """A near copy goes, and its id's unique text stays and keeps its own component."""
    w = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*w[:-1], f"x{k}"])
    own = [f"u{i}" for i in range(60)]
    rows = [(1, near(1)), (2, near(2)), (2, " ".join(own)), (3, " ".join([*own[:-1], "y"])), (4, near(4)), (4, near(5)), (5, "short text"), (6, " ".join(f"v{i}" for i in range(60))), (6, " ".join(f"v{i}" for i in range(59)))]
    df = spark.createDataFrame([(*x, None, None, 0) for x in rows], DOCS)
    assert taken(jaccard_join.near_duplicate_components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)
    kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(df).collect()]
    assert sorted(x for x in kept if x[0] != 6) == sorted([rows[0], rows[2], rows[6]])
    assert [x[0] for x in kept].count(6) == 1


@pytest.mark.parametrize("hot", [2, 512])
def test_no_copy_outlives_deduplication(spark, monkeypatch, hot):
    """Rows repeated whole, equal and near texts of null ids, ids with several texts; few rows make a key hot."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    w = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*w[:-1], f"x{k}"])
    rows = [(1, near(1), "a")] * 9 + [(None, near(1), "a")] * 3 + [(None, near(2), "b"), (None, near(3).upper(), "b"), (2, "own text", "c"), (2, "OWN text", "c"), (2, "other text", "d")]
    rows += [(None, "none", "e"), (None, "NONE", "f"), (3, None, "g"), (None, "", "g"), (None, None, "h")]
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS).withColumn("mark", F.lit(1)).withColumn("kept", F.lit(2)).repartition(3)
    exact = exact_dedup.drop_exact_duplicates(df)
    assert exact.columns == df.columns and len(exact.collect()) == 7
    assert Counter((r.doc_id, (r.text or "").lower()) for r in exact.collect()) == Counter([(1, near(1)), (None, near(2)), (None, near(3)), (2, "own text"), (2, "other text"), (None, "none"), (3, "")])
    left = jaccard_join.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in left.collect())
    assert got == Counter([(1, near(1)), (2, "own text"), (2, "other text"), (None, "none"), (3, ""), (None, "")])


# ---- 2


def test_targets_and_copies(messy, empty, spark):
    report = mixing.mix_report(messy).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in report) == sorted((d.doc_id is None, d.doc_id or 0, len(words(d.text))) for d in messy.collect())
    sizes = Counter()
    for d in messy.collect():
        sizes[d.source] += len(words(d.text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share, cap and share the excess again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    of = {(r.source_size): r.target for r in report}
    assert {sizes[s] for s in sizes} == set(of)
    for s in sizes:
        assert of[sizes[s]] == pytest.approx(target[s])
    assert all(r.taken <= 3 * r.size for r in report)
    assert taken(mixing.mix_report(messy), "doc_id", "taken") == taken(mixing.mix_report(messy.repartition(7)), "doc_id", "taken")
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in report)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix_report(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()} == {0}


def test_taken_words_come_near_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 4}", 0) for i in range(4000)], DOCS)
    by = mixing.mix_report(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in by)


# ---- 3


def test_languages(messy, empty, spark):
    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(30))
    rows = [(i, make("abcde") if i % 2 else make("vwxyé"), "aa" if i % 2 else "bb", "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    for i, _, lang, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == lang and 0.5 < got[i].score <= 1
    odd = language_id.identify(messy).collect()
    assert len(odd) == messy.count()
    und = {x.doc_id for x in odd if x.lang_pred == "und"}
    assert und == {1, 2, 3, 9}
    assert language_id.identify(empty).count() == 0 and language_id.keep_identified(empty).count() == 0
    assert {x.doc_id for x in language_id.keep_identified(messy).collect()}.isdisjoint(und)
    assert {x.lang_pred for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_stay_where_nothing_can_be_learned(spark):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(["plain", "é", None, "", "12 !", "x" * 9])]
    held = [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([(held[0], t, "en", "s", 0) for _, t, *_ in rows], DOCS)):
        assert sorted(r.text for r in language_id.keep_identified(docs).collect()) == ["plain", "x" * 9, "é"]


def test_held_out_languages_and_their_scores(spark, sf):
    """Accuracy, and scores that are calibrated: a lower log loss than without the temperature, and a mean near the accuracy."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    held = [r for r in docs.where(language_id.remainder(F.col("doc_id")) == 1).where("lang IS NOT NULL").collect()]
    p = [model.predict(r.text) for r in held]
    right = [a == r.lang for (a, _), r in zip(p, held, strict=True)]
    assert sum(right) / len(p) > 0.95
    assert abs(sum(s for _, s in p) / len(p) - sum(right) / len(p)) < 0.1
    loss = lambda found: -sum(np.log(max(s if ok else 1 - s, 1e-9)) for (_, s), ok in zip(found, right, strict=True)) / len(found)
    model.temperature, fitted = 1.0, model.temperature
    assert loss(p) <= loss([model.predict(r.text) for r in held]) + 1e-9 or fitted == 1.0


def test_ftrl_is_that_of_a_plain_one():
    """The same rows in the same order, one coordinate at a time."""
    r = np.random.default_rng(7)
    rows = [(np.sort(r.choice(30, 6, replace=False)), r.random(6), int(r.integers(3))) for _ in range(40)]
    alpha, beta, l1, l2, size, classes = 0.5, 1.0, 0.3, 0.01, 30, 3
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(6):
        for at in order.permutation(len(rows)):
            i, x, y = rows[at]
            pairs = [*zip(i.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {(f, k): weight(f, k) for f, _ in pairs for k in range(classes)}
            logits = [sum(v * w[f, k] for f, v in pairs) for k in range(classes)]
            e = [math.exp(s - max(logits)) for s in logits]
            for f, v in pairs:
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == y))
                    step = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha
                    z[f, k] += g - step * w[f, k]
                    n[f, k] += g * g
    got, bias = language_id.ftrl(rows, classes, size, l1=l1)
    assert np.allclose(got, [[weight(i, k) for k in range(classes)] for i in range(size)]) and np.allclose(bias, [weight(size, k) for k in range(classes)])
    assert (got == 0).any()


def test_features_are_the_counts_of_plain_n_grams():
    for t in ["ab, ab!", "Abc", "x", "É é", "zz zz zz", "a" * 50]:
        a = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())) + " "
        own = Counter(a[i : i + n] for n in (1, 2, 3) for i in range(len(a) - n + 1))
        found = Counter(np.concatenate(list(language_id.features(t))).tolist())
        assert sorted(found.values()) == sorted(own.values())


def test_samples_are_bounded_and_every_language_is_learned(spark):
    rows = [(i, f"text {chr(97 + i % 26) * 4}", f"l{i % 50:02}" if i % 3 else "common", "s", 0) for i in range(3000)]
    df = spark.createDataFrame(rows * 2, DOCS).repartition(5)
    model = language_id.train(df, per_language=4, most_rows=102)
    assert len(model.languages) == 51 and "common" in model.languages
    may = df.where(language_id.remainder(F.col("doc_id")) != 1).select("doc_id", "lang")
    got, n = language_id.sample(may, 4, 102)
    assert n == 51 and len(got) == len(set(got)) == 102
    assert len(language_id.sample(may, 4, 10**6)[0]) == 204 and len(language_id.sample(may, 4, 1)[0]) == 51


def test_temperature_sharpens_and_softens():
    y = np.array([0, 1] * 50)
    sure = np.eye(2)[y] * 0.1
    assert language_id.fit_temperature(sure, y) < 0.2
    wrong = np.eye(2)[np.where(np.arange(100) % 4, y, 1 - y)] * 50
    assert language_id.fit_temperature(wrong, y) > 5


# ---- 4


def test_token_counts(messy, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted([(r.doc_id, len((r.text or "").encode()), len(own.encode(r.text or "")), len(own.encode(r.text or "")) > 4096) for r in messy.collect()], key=repr)
    assert taken(token_counts.token_counts(messy, model), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, model).count() == 0
    r = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "中", "<s>", "1", "\x00", "😀", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts_of = [len(x.encode()) for x in texts]
    assert token_counts.sizes(texts) == texts_of and all(sum(texts_of[i : j - 1]) < 100 for i, j in token_counts.by_bytes(texts_of, 100))
    short = token_counts.PieceCounter(model, long=3)  # cuts wherever it may
    assert short.count(texts) == [len(x) for x in own.encode(texts)]


# ---- 5


def test_chats(spark):
    rows = [(1, 0, "user", "a <b> \\l"), (1, 1, "assistant", None), (1, 2, "assistant", "</turn>\n<turn x>"), (1, 2, "assistant", "b"), (None, 0, "assistant", "q"), (2, None, None, "x"), (2, 5, "r>o<le\\", "é中"), (2, 5, "r>o<le\\", "é中"), (3, 0, "assistant", "")]
    rows += [(4, 1, r, t) for r in ("user", "assistant", "<a", "A") for t in ("<x", "A", ">", "\\", "\\l", "\U0001F600" * 2000, "")]  # ties
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("ts", F.lit(1))
    out = chat.format_chats(chat.with_example(df))
    got = {r.conv_id: r for r in chat.chat_report(out).collect()}
    of = defaultdict(list)
    for c, t, role, text in rows + [(-7, 0, "user", chat.EXAMPLE), (-7, 1, "assistant", chat.EXAMPLE)]:
        of[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(of)
    for c, turns in of.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = {r.conv_id: r for r in out.collect()}[1]
    assert text.formatted == "<turn user>a \\lb\\g \\bl</turn>\n<turn assistant><next>\\l/turn\\g\n\\lturn x\\g<next>b</turn>\n"
    assert "".join(text.formatted[s.start : s.start + s.chars] for s in text.loss_spans) == "\\l/turn\\g\n\\lturn x\\gb"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    def took(n):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.format_string("%d <text> é", F.col("id")).alias("text"))
        began = time.time()
        r = chat.chat_report(chat.format_chats(df)).first()
        texts = [(("assistant", "user")[i % 3 == 0], f"{i} <text> é") for i in range(n)]
        assert (r.n_turns, r.loss_sha256) == (n, hashlib.sha256("".join(x for a, x in texts if a == "assistant").encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in texts).encode()).hexdigest()
        return time.time() - began

    took(1000)
    assert took(100_000) < 10 * took(10_000) + 2


# ---- 6


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "<p>é</p>"), (3, "http://b\r\nX: y%", "<p>é</p>"), (9, None, None), (8, "u", ""), (4, "v", "z" * 3_000_000), (5, "http://a", "<p>é</p>"), (None, "n", "only"), (1, "k", "\x00\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash")).withColumn("first", F.lit(1))
    first = {}
    for i, _, h in rows:
        k = h or ""
        first[k] = min(first.get(k, 10**9), 10**9 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want.append((i, len(b), warc.digest(b), "revisit" if again else "response", first[h or ""] if again else None))
    assert taken(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(df, least_bytes=1 << 30).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_salvage_recovers_later_records_and_logs_gaps():
    plain = [warc.record("response", i, "u", f"page {i} ".encode() * 50, 350 + 50 * len(str(i)), "", None).replace(b"WARC-Payload-Digest: sha1:\r\n", b"") for i in range(6)]
    for wrap in (warc.member, lambda x: x):
        parts = list(map(wrap, plain))
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        data = bytearray(b"".join(parts))
        data[starts[2] + len(parts[2]) // 2] ^= 0xFF
        data = bytes(data[: starts[4]]) + b"junk WARC/1.1 junk \x1f\x8b\x08 junk" + bytes(data[starts[4] : -10])
        found = list(warc.salvage(data))
        assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == [b"<urn:page:%d>" % i for i in (0, 1, 3, 4)]
        assert sum(x[0] == "gap" for x in found) == 3
        edges = sorted({(x[1], x[2]) for x in found})
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in itertools.pairwise(edges))
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing here")] == ["gap"]


@pytest.mark.parametrize("step", [1, 7, 1 << 14])
def test_salvage_is_that_of_a_plain_reader_under_damage(monkeypatch, step):
    def whole(data, at):
        z = zlib.decompressobj(wbits=31)
        try:
            plain = z.decompress(data[at:])
        except zlib.error:
            return None
        return (plain, len(data) - len(z.unused_data)) if z.eof else None

    def plain_reader(data):
        at, lost = 0, 0
        while at < len(data):
            got = whole(data, at) if data.startswith(warc.MAGIC, at) else None
            try:
                n, end = (len(warc._records_of(got[0])), got[1]) if got else (1, warc.parse_record(data, at)[2])
            except warc.Bad:
                at, lost = at + 1, lost + 1
                continue
            yield from [("record", at, end)] * n
            at = end
        yield "lost", lost, None

    monkeypatch.setattr(warc, "STEP", step)
    rng = np.random.default_rng(3)
    for trial in range(20):
        parts = []
        for i in range(8):
            payload = rng.bytes(int(rng.integers(0, 400)))
            r = warc.record("response", i, "u", payload, len(payload), warc.digest(payload), None)
            parts.append(r if trial % 3 == 0 else warc.member(r))
        data = bytearray(b"".join(parts))
        for at in rng.integers(0, len(data), trial % 5):
            data[at] ^= 1 << int(rng.integers(8))
        data = bytes(data[: len(data) - (trial % 4) * 5])
        found = list(warc.salvage(data))
        *records, (_, lost, _) = plain_reader(data)
        assert [x[:3] for x in found if x[0] == "record"] == records
        assert sum(x[2] - x[1] for x in found if x[0] == "gap") == lost


@pytest.mark.parametrize("step", [1, 1 << 14])
@pytest.mark.parametrize("level", [0, 6])
def test_members_of_many_records_lose_only_what_is_damaged(monkeypatch, step, level):
    monkeypatch.setattr(warc, "STEP", step)
    rng = np.random.default_rng(1)
    payloads = [rng.bytes(300) for _ in range(6)]
    plain = [warc.record("response", i, "u", p, len(p), warc.digest(p), None) for i, p in enumerate(payloads)]

    def squeeze(x):
        z = zlib.compressobj(level, wbits=31)
        return z.compress(x) + z.flush()

    def check(data, want):
        found = list(warc.salvage(data))
        assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == [b"<urn:page:%d>" % i for i in want]
        assert any(x[0] == "gap" for x in found) and all(x[4].endswith(payloads[i]) for x, i in zip([x for x in found if x[0] == "record"], want, strict=True))
        edges = sorted({(x[1], x[2]) for x in found})
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in itertools.pairwise(edges))

    worse = list(plain)
    worse[2] = plain[2][:-9] + b"~" + plain[2][-8:]  # a wrong block digest
    worse[4] = plain[4].replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % (len(plain[4]) - plain[4].index(b"HTTP/1.1 200") - 4), b"\r\nContent-Length: 7\r\n\r\nHTTP")
    assert worse[4] != plain[4]
    after = warc.member(warc.record("response", 9, "u", b"z", 1, warc.digest(b"z"), None))
    payloads += [b""] * 3 + [b"z"]
    check(squeeze(b"".join(worse)) + after, [0, 1, 3, 5, 9])
    whole = squeeze(b"".join(plain))
    crc = bytearray(whole)
    crc[-6] ^= 1
    check(bytes(crc) + after, [0, 1, 2, 3, 4, 5, 9])
    check(whole[:-5], [0, 1, 2, 3, 4, 5])
    check(whole[:-200], [0, 1, 2, 3, 4])


def test_archives_hold_bounded_bytes(spark, tmp_path):
    r = random.Random(1)
    pages = spark.createDataFrame([(i, "u", "".join(chr(r.randrange(33, 0x3000)) for _ in range(2000))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, file_bytes=20_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 30_000
    assert warc.read_archives(spark, path).where("kind = 'record'").select("page_id").distinct().count() == 60


def test_ids_of_any_kind(spark):
    rows = [("a b>", "u", "same"), ("null", "u", "same"), ("é%0A\n", "u", "x"), (" ", "u", ""), ("", "u", "y"), (None, "u", "same"), ("zz", "u", "same")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {("a b>", "response", None), ("null", "revisit", "a b>"), ("é%0A\n", "response", None), (" ", "response", None), ("", "response", None), (None, "revisit", "a b>"), ("zz", "revisit", "a b>")}


# ---- 7


def test_exact_duplicates(messy, empty):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [(r.doc_id, lower(r.text)) for r in messy.collect()]
    size, keep = Counter(t for _, t in rows), {}
    for d, t in rows:
        keep[t] = max((x for x in (keep.get(t), d) if x is not None), default=None)
    want = sorted(((d, keep[t], size[t], d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=repr)
    assert taken(exact_dedup.exact_duplicates(messy), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d) for d in keep.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_colliding_hashes_are_told_apart(messy, monkeypatch):
    want = taken(exact_dedup.exact_duplicates(messy), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda norm: F.unhex(F.substring(F.md5(norm), 1, 1)))
    assert taken(exact_dedup.exact_duplicates(messy), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


# ---- 8


def test_quality(spark, messy, empty):
    docs = spark.createDataFrame([(i, ["idiot bad text", "plain text here", "fine lovely prose"][i % 3] + f" w{i % 11}", "en", "s", 0) for i in range(300)], DOCS)
    rated = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")).where("doc_id < 240")
    got = quality.score(docs, quality.train(docs, rated)).where("doc_id >= 240").collect()
    for r in got:
        assert round(r.expected_grade) == r.doc_id % 3 and r.p_above_0 >= r.p_above_1
        assert r.kept == (r.doc_id % 3 > 0)
    model = quality.train(empty, rated.limit(0))
    assert quality.score(messy, model).count() == messy.count() and quality.score(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert taken(quality.grade(labels), "doc_id", "grade") == [(1, 2), (2, 1), (3, 0)]


def test_ordinal_fit_is_that_of_a_plain_one():
    """The same rows in the same order; slopes of the log likelihood by differences."""
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(3))) for _ in range(30)]
    sig = lambda v: 1 / (1 + math.exp(-v))

    def likelihood(score, free, y):
        t = [free[0], free[0] + math.exp(free[1])]
        p = [1.0, sig(score - t[0]), sig(score - t[1]), 0.0]
        return math.log(p[y] - p[y + 1])

    w, gw = defaultdict(float), defaultdict(lambda: 1e-4)
    counts = [1 + sum(y == k for *_, y in rows) for k in range(3)]
    upper = [1 - counts[0] / sum(counts), counts[2] / sum(counts)]
    start = [-math.log(u / (1 - u)) for u in upper]
    free, gf = [start[0], math.log(start[1] - start[0])], [1e-2, 1e-2]
    order = np.random.default_rng(9)
    for _ in range(8):
        for at in order.permutation(len(rows)):
            i, x, y = rows[at]
            score, d = sum(v * w[f] for f, v in zip(i.tolist(), x.tolist(), strict=True)), 1e-5
            slope = (likelihood(score + d, free, y) - likelihood(score - d, free, y)) / (2 * d)
            df = [(likelihood(score, [f + d * (k == j) for k, f in enumerate(free)], y) - likelihood(score, [f - d * (k == j) for k, f in enumerate(free)], y)) / (2 * d) for j in range(2)]
            for f, v in zip(i.tolist(), x.tolist(), strict=True):
                g = slope * v - 1e-5 * w[f]
                gw[f] += g * g
                w[f] += 0.5 * g / math.sqrt(gw[f])
            for j in range(2):
                gf[j] += df[j] ** 2
                free[j] += 0.1 * df[j] / math.sqrt(gf[j])
    model = quality.fit(rows)
    assert np.allclose(model.weights[:12], [w[k] for k in range(12)], atol=1e-4) and np.allclose(model.thresholds, [free[0], free[0] + math.exp(free[1])], atol=1e-4)


def test_a_rated_id_in_many_rows_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text number {i}", "en", "s", 0) for i in range(50)] + [(2, "another one", "en", "s", 0)], DOCS)
    rated = spark.createDataFrame([(1, 0), (2, 2), (2, 2)], "doc_id long, grade int")
    seen = []
    plain = quality.fit
    try:
        quality.fit = lambda rows: seen.extend(rows) or plain(rows)
        quality.train(docs, rated)
    finally:
        quality.fit = plain
    assert [y for *_, y in seen] == [0, 2, 2]


def test_graded_likelihood_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.grade(labels)
    model = quality.train(docs, rated.where("doc_id % 3 <> 1"))
    held = docs.join(rated.where("doc_id % 3 = 1"), "doc_id").select("text", "grade").collect()
    share = Counter(r.grade for r in held)
    chance = -sum(n / len(held) * math.log(n / len(held)) for n in share.values())
    p = [np.concatenate(([1.0], model.tails(r.text), [0.0])) for r in held]
    assert -np.mean([math.log(max(t[r.grade] - t[r.grade + 1], 1e-9)) for t, r in zip(p, held, strict=True)]) < chance


# ---- 9


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    own = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.splits
    file = public_tokenizers.path("word_bpe_49k.json")
    other, library = packing.ByteEncoder(file), Tokenizer.from_file(file)
    texts = ["Some Words, here", "", "a  b\n"]
    assert not other.splits and [np.frombuffer(x, "<u4").tolist() for x in other.batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(messy, empty):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(file)
    want = []
    for r in messy.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if not s else s + 1024]
            want.append((r.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(messy, file)
    assert taken(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, file).count() == 0


def test_encoder_equals_the_library():
    e = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), remember=50)
    r = random.Random(6)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\r", "\xa0", "é", "中", "<|endoftext|>", "'s", "'", "1", "23", "!!", ".", "\x1c", "\x85", "😀", "the", "\x00", "\u2003", "ǅ", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(20_000)]
    assert e.batch(texts) == e.encode(texts)


def plain_best_fit(lengths, capacity):
    """Piece by piece: large ones matched greedily, then each smaller one into the smallest gap."""
    large = sorted(n for n in lengths if 3 * n > capacity)
    gaps = []
    while large:
        n = large.pop()
        fits = [m for m in large if n + m <= capacity]
        if fits:
            large.remove(max(fits))
        gaps.append(capacity - n - max(fits, default=0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append(min(fits, default=capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_best_fit_piece_by_piece(seed):
    r = random.Random(seed)
    capacity = r.randint(3, 60)
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
    plan = packing.Plan(Counter(lengths), capacity)
    assert all(sum(items) <= capacity for items, _ in plan.classes)
    assert sum((Counter({n: k * c for n, k in Counter(items).items()}) for items, c in plan.classes), Counter()) == Counter(lengths)
    assert sum(c for _, c in plan.classes) == plain_best_fit(lengths, capacity)


# ---- 10


def plain_top(rows, every, k=5):
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out, key=repr)


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (2004, [0.0] * 16), (2005, [1e4] * 16), (2006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    for rows_in, queries_in in ((8192, 1024), (50, 4)):
        monkeypatch.setattr(topk, "CELL_ROWS", rows_in)
        monkeypatch.setattr(topk, "CELL_QUERIES", queries_in)
        assert taken(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == plain_top(rows, 50)
    few = df.where("vec_id IN (0, 1, 2)")
    assert taken(topk.top_k(few, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == plain_top(rows[:3], 50)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dense", [1 / 32, 2.0])
@pytest.mark.parametrize("floored", [False, True])
def test_processing_stops_early_only_on_proof(monkeypatch, dense, floored):
    monkeypatch.setattr(topk, "DENSE", dense)
    r = np.random.default_rng(2)
    m = np.floor(r.standard_t(1.5, size=(600, 24)) * 50).clip(-2000, 2000).astype(np.int64)
    q = m[:20]
    cell = topk.Cell(m, np.arange(600), list(topk.segments(m)), np.float64)
    assert sum(len(s.rows) for s in cell.segments) == np.count_nonzero(m)
    want = [sorted(((-int(m[j] @ q[i]), j) for j in range(600) if j != i))[:5] for i in range(20)]
    floors = np.array([-w[4][0] if floored else -np.inf for w in want], float)
    found, proven = topk.best(q, np.arange(20), floors, cell, 5)
    got = defaultdict(list)
    for i, j, s in found:
        got[i].append((-s, j))
    assert [got[i] for i in range(20)] == want
    assert proven >= 15


def test_skewed_vectors_take_fewer_searches(spark, monkeypatch):
    """Norms that fall steeply: bands are ruled out, most of the rest stops on proof, and results are those of brute force."""
    monkeypatch.setattr(topk, "CELL_ROWS", 100)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=12) * 8.0 ** -(i % 7)).tolist()) for i in range(1400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert taken(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == plain_top(rows, 50)
    report = topk.proof_report(df, F.col("vec_id") % 50 == 0)
    assert report["made"] < 0.8 * report["possible"] and report["stopped"] > 0.5 * report["made"]
