from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from sightmatch.llm import grams, langid, ppm, quality, queries, shingles

SCHEMA = "doc_id long, text string, lang string, score double, n int, held_out string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, k, 0.5, 1, "x") for i, t, k in rows], SCHEMA).repartition(3)


def made_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "tion", "ab", "cab", "bca", "é"]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(n)]


# Prediction by partial matching


class PlainTrie:
    """The same model with a dictionary per context."""

    def __init__(self, texts, order):
        grown = Counter()
        for t in texts:
            data = grams.START * order + t + grams.END
            for i in range(order, len(data)):
                grown[data[i - order : i + 1]] += 1
        self.order, self.levels = order, [None] * (order + 1)
        for k in range(order, -1, -1):
            level = defaultdict(dict)
            for g, n in grown.items():
                level[g[:-1]][g[-1]] = n
            self.levels[k] = level
            grown = Counter(g[1:] for g in grown)

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.levels[k].get(context[len(context) - k :])
            if seen is None:
                continue
            here = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(here.values())
            if here:
                if symbol in here:
                    return out * (here[symbol] - 0.5) / total
                out *= 0.5 * len(here) / total
            excluded = set(seen)
        return out / (256 - len(excluded))


def plain_score(trie, text):
    data = grams.START * trie.order + text + grams.END
    return sum(
        math.log10(trie.p(data[i - trie.order : i], data[i])) for i in range(trie.order, len(data))
    )


def lower(text):
    return (text or "").encode().lower()


def test_ppm_is_a_distribution():
    trie = PlainTrie([lower(t) for t in made_texts()], 3)
    for context in (b"the", b"of ", b"zzz", b"\xfe\xfe\xfe"):
        assert sum(trie.p(context, s) for s in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("most_words", [400_000, 3])
def test_ppm_scores(spark, most_words):
    rows = list(enumerate([*made_texts(), "", None, "new wörds 123 \x0b\tthe", "the\n" * 3000, "A b", "q" * 80]))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    fold = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = ppm.score(docs, fold, order=3, most_words=most_words).collect()
    learned = [lower(t) for i, t in rows if i not in held]
    words = Counter(w for t in learned for w in t.split())
    words["<end>"] = len(learned)
    total, kinds = sum(words.values()), len(words)
    trie = PlainTrie(learned, 3)
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    for r in got:
        tokens = [*lower(rows[r.doc_id][1]).split(), "<end>"]
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(tokens), total)
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(plain_score(trie, lower(rows[r.doc_id][1])))


def test_ppm_without_training_rows(spark):
    docs = docs_of(spark, [(1, "ab", None), (None, None, None)])
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(256)) and got[1].n_known == 0
    assert got[None].n_tokens == 1 and got[None].train_tokens == 0
    assert ppm.score(docs_of(spark, []), F.lit(None).cast("boolean")).collect() == []


def test_ppm_bounded_model(spark):
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(made_texts())])
    full, small = (
        ppm.score(docs, F.lit(False), most_grams=n).agg(F.sum("score")).first()[0] for n in (10_000, 40)
    )
    assert small < full < 0


@pytest.mark.parametrize("sent", [0, 60])
def test_ppm_dealt_trie_is_whole(spark, sent, monkeypatch):
    monkeypatch.setattr(grams, "SHARD_GRAMS", 200)
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate([*made_texts(), "", None, "zzé 12 " * 40])])
    fold = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scores = [
        {r.doc_id: r.score for r in ppm.score(docs, fold, **bound).collect()} for bound in ({}, {"sent_grams": sent})
    ]
    assert len(scores[0]) == 63 and scores[1] == pytest.approx(scores[0])


def test_ppm_beats_word_counts(spark):
    rows = queries.op2_lm_scoring(spark, SMALL.replace("0.001", "0.1")).groupBy("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")
    )
    assert all(r.s > r.b for r in rows.collect())


# Language identification


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, SMALL).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count()
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def plain_features(text):
    """Shares of hashed byte n-grams of one text, by dictionaries."""
    data = text.lower()  # of bytes: A-Z alone
    data = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in b" " + data + b" ")
    counts = Counter()
    for n in range(1, langid.LONGEST + 1):
        for i in range(len(data) - n + 1):
            if data[i] != 32 or data[i + n - 1] != 32:
                code = int.from_bytes(data[i : i + n], "big")
                code = (code * 0x9E3779B1 + n) % 2**32 * 0x85EBCA6B % 2**32
                counts[code >> 20] += 1
    length = math.sqrt(sum(counts.values()))
    return {b: math.sqrt(c) / length for b, c in counts.items()}


def plain_language(model, text):
    """Language, score and doubt of one text, bit by bit."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    x = plain_features(text.encode())
    losses = []
    for name, word in zip(model.languages, model.codes.tolist(), strict=True):
        loss = 0.0
        for bit, want in enumerate(word):
            said = float(model.offsets[bit]) + sum(v * float(model.weights[b, bit]) for b, v in x.items())
            loss += float(model.trust[bit]) * math.log1p(math.exp(-want * said))
        losses.append((loss, name))
    trust = sum(map(float, model.trust)) / len(model.trust)
    scale = 2 / trust / math.sqrt(len(model.languages))
    least = min(losses)[0]
    shares = [(math.exp(-(loss - least) * scale), name) for loss, name in losses]
    total = sum(s for s, _ in shares)
    shares = sorted(((s / total, name) for s, name in shares), key=lambda s: -s[0])
    return shares[0][1], shares[0][0], shares[0][0] - shares[1][0] < model.margin


def test_language_equals_plain_decoding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, None), (-2, "", None), (-3, "12 % 7", None), (-4, "x", None), (-5, "A" * 5000, None)]
    odd += [(-6, "ÀÉ ß \u4e2d\u6587", None), (-7, " \t a\n", None)]
    both = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string, lang string")).cache()
    model = langid.fit(docs)
    assert len(model.languages) > 2
    texts = {r.doc_id: r.text for r in both.collect()}
    got = langid.predict(both, model).collect()
    assert len(got) == len(texts)
    for r in got:
        name, score, doubt = plain_language(model, texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-4)
        if abs(score - 0.5) > 1e-3 or name == "und":
            assert (r.lang_pred, r.ambiguous) == (name, doubt)


def test_language_cases(spark):
    base = {"en": "the house and this thing", "de": "der Wagen und nicht wahr", "fr": "le château était où"}
    rows = [(i, f"{t} {i}", k) for i, (k, t) in enumerate([*base.items()] * 12)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 %%", "de"), (103, "the this and" * 5000, None)]
    rows += [(None, "der und", None), (3, rows[3][1], rows[3][2]), (104, "漢字", None)]
    docs = docs_of(spark, rows)
    model = langid.fit(docs)
    got = [r for r in langid.predict(docs, model).collect()]
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {by_id[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert by_id[103].lang_pred == "en" and by_id[None].lang_pred == "de" and by_id[104].lang_pred in base
    assert all(by_id[i].lang_pred == k for i, _, k in rows[:36])
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    for few in ([], rows[:1], rows[-1:]):
        small = langid.fit(docs_of(spark, few))
        found = {r.lang_pred for r in langid.predict(docs_of(spark, rows[3:5]), small).collect()}
        assert found == {few[0][2] if few and few[0][2] else "und"}
    assert langid.predict(docs_of(spark, []), model).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_differ(n):
    codes = langid.codewords(n)
    assert len(codes) == n and len({tuple(c) for c in codes}) == n
    assert (np.abs(codes.sum(axis=0)) < n).all()


# Quality


def plain_kneser_ney(texts, text, n):
    """Bits of text by dictionaries, straight from the formulas."""
    counts = [None] * (n + 1)
    counts[n] = Counter()
    for t in texts:
        data = grams.START * (n - 1) + t + grams.END
        for i in range(n - 1, len(data)):
            counts[n][data[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(k):
        n1, n2, n3, n4 = (max(1, sum(c == i for c in counts[k].values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [min(max(x, 0.1), top) for x, top in zip(d, (0.9, 1.8, 2.7), strict=True)]

    cut = [None] + [discounts(k) for k in range(1, n + 1)]
    after = [None] + [defaultdict(list) for _ in range(n)]
    for k in range(1, n + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        k, seen = len(g), after[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        total, c = sum(seen), counts[k].get(g, 0)
        own = (c - cut[k][min(c, 3) - 1]) / total if c else 0
        return own + sum(cut[k][min(x, 3) - 1] for x in seen) / total * p(g[1:])

    data = grams.START * (n - 1) + text + grams.END
    return sum(-math.log2(p(data[i - n + 1 : i + 1])) for i in range(n - 1, len(data)))


def test_quality_model(spark):
    texts = made_texts()
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    model = quality.fit(docs, spark.range(40).toDF("doc_id"))
    learned = [t.encode() for t in texts[:40]]
    rows = [*texts, "", "zzz 123", "the " * 200]
    for r in quality.perplexities(docs_of(spark, [(i, t, None) for i, t in enumerate(rows)]), model).collect():
        text = rows[r.doc_id].encode()
        assert r.n_symbols == len(text) + 1
        assert r.bits == pytest.approx(plain_kneser_ney(learned, text, quality.ORDER))
    every = np.array([int.from_bytes(b"of t" + bytes([s]), "big") for s in range(256)], np.uint64)
    assert (2 ** -model.bits(every)).sum() == pytest.approx(1)


def test_quality_cases(spark):
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(made_texts(90))]
    rows += [(200, None, None), (201, "", "xx"), (202, "#$%&" * 300, "en"), (203, "9!" * 5000, None), (None, "the of", "en")]
    rows += [(5, rows[5][1], rows[5][2])]
    docs, trusted = docs_of(spark, rows), spark.range(80).toDF("doc_id")
    got = quality.judge(docs, trusted).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and not kept[202] and not kept[203]
    assert sum(kept[i] for i in range(90)) >= 86 and kept[None]
    left = quality.keep_good(docs, trusted)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    nobody = spark.range(0).toDF("doc_id")
    assert all(r.kept and r.threshold is None for r in quality.judge(docs, nobody).collect())
    assert quality.keep_good(docs, nobody).count() == len(rows)
    assert quality.judge(docs_of(spark, []), trusted).collect() == []


def plain_judge(rows, trusted, of_fold, quantile=0.995, slack=0.03):
    """id: (perplexity, threshold, kept), straight from the description."""
    good = [(t or "", lang or "", fold) for (i, t, lang), fold in zip(rows, of_fold, strict=True) if i in trusted]
    texts = [t.encode() for t, _, _ in good]
    unseen = []
    for t, lang, fold in good:
        others = [o for o, (_, _, f) in zip(texts, good, strict=True) if f != fold]
        unseen.append((lang, plain_kneser_ney(others, t.encode(), quality.ORDER), len(t.encode()) + 1))

    def lower_quantile(values, q):
        values = sorted(values)
        return values[max(0, math.ceil(q * len(values)) - 1)]

    def middle(of):
        found = [b / n for lang, b, n in unseen if n >= 200 and (of is None or lang == of)]
        return lower_quantile(found, 0.5) if found else None

    known = {lang: middle(lang) for lang, _, _ in unseen}
    overall = middle(None)
    settle = lambda bits, n, m: (bits + quality.PRIOR * m) / (n + quality.PRIOR)
    settled = [(lang, settle(b, n, known[lang] or overall)) for lang, b, n in unseen]
    tops = {lang: lower_quantile([s for x, s in settled if x == lang], quantile) for lang, m in known.items() if m}
    top = lower_quantile([s for _, s in settled], quantile)
    out = {}
    for i, t, lang in rows:
        data, lang = (t or "").encode(), lang or ""
        bits, n = plain_kneser_ney(texts, data, quality.ORDER), len(data) + 1
        m, limit = (known[lang], tops[lang]) if lang in tops else (overall, top)
        limit *= 1 + slack
        out[i] = 2 ** (bits / n), 2**limit, settle(bits, n, m) <= limit
    return out


def test_quality_equals_plain_judge(spark, monkeypatch):
    made = made_texts(36)
    rows = [(i, t * (1 + i % 3), ("en", "de", None)[i % 3]) for i, t in enumerate(made)]
    rows += [(100, "#$%&" * 90, "en"), (101, "zq xj " * 40, "de"), (102, None, "fr"), (103, "the of and", "fr")]
    trusted = set(range(30))
    folds = {r.doc_id: r.fold for r in docs_of(spark, rows).select("doc_id", grams.fold_of(F.col("text"), quality.FOLDS).alias("fold")).collect()}
    want = plain_judge(rows, trusted, [folds[i] for i, _, _ in rows])
    got = quality.judge(docs_of(spark, rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        perplexity, limit, kept = want[r.doc_id]
        assert (r.perplexity, r.threshold) == pytest.approx((perplexity, limit), rel=1e-4)
        assert r.kept == kept


def test_quality_of_labelled_rows(spark):
    folder = SMALL.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rates = {
        r.quality: r.share
        for r in queries.op5_quality(spark, folder)
        .join(labels, "doc_id")
        .groupBy("quality")
        .agg(F.avg(F.col("kept").cast("int")).alias("share"))
        .collect()
    }
    assert rates[1] > 0.99 and rates[0] < 0.1


def test_quality_of_a_dealt_model(spark, monkeypatch):
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(made_texts(40))]
    rows += [(200, None, None), (202, "#$%&" * 300, "en"), (None, "the of", "en"), (5, rows[5][1], "en")]
    docs, trusted = docs_of(spark, rows), spark.range(30).toDF("doc_id")

    def results():
        got = quality.judge(docs, trusted).collect()
        left = quality.keep_good(docs, trusted)
        assert left.columns == docs.columns
        got = sorted((str(r.doc_id), str(r.lang), r.perplexity, r.threshold, r.kept) for r in got)
        return got, sorted(map(str, left.collect()))

    whole = results()
    for name, value in (("SENT_GRAMS", 100), ("HOT_GRAMS", 50)):
        monkeypatch.setattr(quality, name, value)
    monkeypatch.setattr(grams, "SHARD_GRAMS", 500)
    dealt = results()
    assert len(whole[0]) == len(rows) and dealt[1] == whole[1]
    for one, other in zip(*(x[0] for x in (whole, dealt)), strict=True):
        assert one[:2] + one[4:] == other[:2] + other[4:] and other[2:4] == pytest.approx(one[2:4])


def test_quality_discounts_are_of_whole_orders():
    texts = [t.encode() for t in made_texts()]
    keys = np.sort(np.concatenate([k for k, _ in grams.pack(texts, quality.ORDER)]))
    tables = grams.descend(grams.Table(*grams.runs(keys)), quality.ORDER)
    sizes = [(len(t.keys), *((t.values[0] == i).sum() for i in (1, 2, 3, 4))) for t in tables]
    whole, ending = quality.KneserNey(tables), int.from_bytes(b"he", "big")
    shard = tables[:2]
    for t in tables[2:]:
        own = (t.keys >> np.uint64(8)) & np.uint64(0xFFFF) == ending
        shard.append(grams.Table(t.keys[own], t.values[0][own]))
    asked = shard[-1].keys
    assert len(asked) and np.allclose(quality.KneserNey(shard, sizes).bits(asked), whole.bits(asked))
    assert not np.allclose(quality.KneserNey(shard).bits(asked), whole.bits(asked))


def test_quality_counts_all_trusted_texts(spark):
    texts = [f"w{i} " for i in range(4_100)] + ["long " * 20_000]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    model = quality.fit(docs, docs.select("doc_id"))
    symbols = np.array([int.from_bytes(b"\xfe" * 4 + s, "big") for s in (b"w", b"l")], np.uint64)
    assert model.bits(symbols)[0] < 0.01
    learned = [t.encode() for t in texts]
    for text in (b"w4099 ", b"long lo"):
        key = [int.from_bytes((b"\xfe" * 4 + text + b"\xff")[i : i + 5], "big") for i in range(len(text) + 1)]
        assert model.bits(np.array(key, np.uint64)).sum() == pytest.approx(plain_kneser_ney(learned, text, quality.ORDER))


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_quality_keeps_unlabelled_good_texts(spark, size):
    folder = SMALL.replace("0.001", size)
    good = queries.trusted_ids(spark, folder)
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = quality.judge(docs, good.filter(~fifth)).join(good.filter(fifth), "doc_id")
    kept = [r.kept for r in got.select("kept").collect()]
    assert len(kept) > 10 and kept.count(False) <= max(1, 0.03 * len(kept)), (kept.count(False), len(kept))


def test_long_texts_go_through_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc  de\n", k=rng.choice([0, 1, 5, 300, 3000]))) for _ in range(60)]

    def results():
        sums = grams.sums_by_text(texts, 5, lambda keys: (keys % np.uint64(1009)).astype(float))
        return sums, [s.tolist() for s in shingles.shingle_sets(texts, 3)], langid.features(texts)

    sums, sets, shares = results()
    monkeypatch.setattr(grams, "SLICE_BYTES", 64)
    monkeypatch.setattr(shingles, "PART_BYTES", 40)
    monkeypatch.setattr(langid, "SLICE_BYTES", 1000)
    again = results()
    assert np.allclose(sums, again[0]) and sets == again[1]
    assert np.abs(shares - again[2]).max() < 0.02


@pytest.mark.parametrize("n", [0, 7])
def test_grams_beyond_a_key_are_refused(spark, n):
    with pytest.raises(ValueError, match="1 to 6"):
        grams.counted(spark.createDataFrame([("a",)], "text string"), n)
