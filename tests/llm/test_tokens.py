from __future__ import annotations

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest

from sightmatch.llm import bpe, packing, queries, sharding, token_counts

ALPHABET = [*"aabcdeéüñ  \n\t.,'$%|19_½", "<|endoftext|>", "<s>", "漢", "🙂", " ", "'s", " 're", "\r\n", "▁", "ﬁ"]


def texts(n=400):
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    words = ["alpha", "beta,", "Gämma.", "delta\n", "x9"]
    return [*made, "", None, " ".join(rng.choice(words) for _ in range(30_000)), "y" * 30_000, " " * 999]


def docs_of(spark, rows):
    schema = "doc_id long, text string, ids int, length string, shard int"
    return spark.createDataFrame([(i, t, 1, "z", 2) for i, t in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_is_what_the_ranks_give(spark, ranked, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS_KEPT", 50)
    rows = texts()
    got = bpe.encode(docs_of(spark, rows), queries.MULTI, offsets=True, decoded=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == ranked.encode_ordinary(text) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode()
        at = 0
        for token, a, b in zip(ids, r.starts, r.ends, strict=True):
            piece = ranked.decode_single_token_bytes(token)
            # The characters of the span hold the token's bytes.
            before = len(text[:a].encode())
            assert before <= at and at + len(piece) <= before + len(text[a:b].encode())
            at += len(piece)


def test_decode_any_cut(spark, ranked):
    text = "漢字🙂é"
    ids = np.array(ranked.encode_ordinary(text), "<u4")
    rows = [(k, ids[:k].tobytes()) for k in range(len(ids) + 1)] + [(99, None)]
    got = dict(map(tuple, bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), queries.MULTI).collect()))
    for k in range(len(ids) + 1):
        assert bytes(got[k]) == text.encode()[: len(got[k])]
        assert bpe.as_text(bytes(got[k])).rstrip("�") == text[: len(bpe.as_text(bytes(got[k])).rstrip("�"))]
    assert got[99] is None and bytes(got[len(ids)]) == text.encode()


def test_encode_nothing(spark):
    assert bpe.encode(docs_of(spark, []), queries.MULTI).collect() == []


def test_json_tokenizer():
    from tokenizers import Tokenizer

    plain, model = Tokenizer.from_file(public.path("byte_bpe_50k.json")), bpe.load(queries.ENGLISH)
    rows = [t or "" for t in texts(2_000)]
    for text, ids in zip(rows, model.encode(rows), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert model.decode(ids) == text.encode()


def test_token_counts(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "CALL_BYTES", 500)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rows = texts()
    got = token_counts.count_tokens(docs_of(spark, rows), queries.PIECES, limit=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    for r in got:
        text = rows[r.doc_id] or ""
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 40)
    assert token_counts.count_tokens(docs_of(spark, []), queries.PIECES).collect() == []


def test_safe_cuts_change_no_count():
    model, can_cut = token_counts._load(queries.PIECES)
    assert can_cut
    for text in (t or "" for t in texts()):
        parts = list(token_counts.safe_parts(text, 3))
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))


def test_shards(spark):
    rows = ["x" * (i % 37) for i in range(500)] + [None, "", "y" * 5000]
    docs = docs_of(spark, rows)
    got = sharding.assign_shards(docs, 600).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    shards = defaultdict(list)
    for r in got:
        assert len(r.shard) == r.depth and r.n_bytes == len(rows[r.doc_id] or "")
        shards[r.shard].append(r)
    for name, members in shards.items():
        assert {(r.shard_bytes, r.shard_docs) for r in members} == {(sum(r.n_bytes for r in members), len(members))}
        assert members[0].shard_bytes <= 600 or len(members) == 1
        assert not any(other != name and other.startswith(name) for other in shards)
    assert len(sharding.directory(sharding.assign_shards(docs, 600)).collect()) == len(shards)
    assert sharding.assign_shards(docs_of(spark, []), 600).collect() == []


def test_shards_of_one_id(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None if i % 2 else 5, "z" * 50) for i in range(60)], schema)
    got = sharding.assign_shards(docs, 300).collect()
    assert len(got) == 60 and all(r.shard_bytes <= 300 for r in got)


def test_write_shards(spark, tmp_path):
    docs = docs_of(spark, ["x" * (i % 37) for i in range(100)])
    shards = sharding.assign_shards(docs, 600)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("__shard").distinct().count() == shards.select("shard").distinct().count()


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(4)
    rows = texts(60) + [" ".join(rng.choices(["one", "two", "three.", "vier"], k=rng.randrange(900))) for _ in range(300)]
    docs = docs_of(spark, rows).repartition(5)
    packed = packing.pack(docs, queries.ENGLISH, keep_ids=True)
    got = packed.collect()
    model = bpe.load(queries.ENGLISH)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        ids = model.encode([rows[i] or ""])[0] + bytes(4)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert {r.doc_tokens for r in own} == {len(ids) // 4}
    assert sorted(pieces) == list(range(len(rows)))
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 1024
    total = sum(r.length for r in got)
    assert len(bins) * 1024 <= total * 1.03 + 5 * 1024
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.length for r in whole.values()) == total
    some = next(iter(bins.values()))
    assert bytes(whole[some[0].sequence_id].ids) == b"".join(bytes(r.ids) for r in some)


def test_packing_nothing(spark):
    assert packing.pack(docs_of(spark, []), queries.ENGLISH).collect() == []
    assert packing.piece_lengths(1024 * 2 + 600, 1024) == [1024, 1024, 512, 85, 3]
