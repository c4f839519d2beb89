import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stintlake.llm import byte_bpe, packing, sstable
from stintlake.llm.word_bpe import WordBpe
from stintlake.session import new_path

from .helpers import ODD, docs

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.Encoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def tik(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks.ids, special_tokens={})


TOKENIZER = Tokenizer.from_file(WORD)


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4")


def odd_texts(n):
    rnd = random.Random(5)
    rare = [chr(c) for c in [*range(0, 0x250), 0x300, 0x345, 0x1680, 0x2003, 0x200B, 0x2028, 0x3000, 0x3A3, 0x130, 0x4E2D, 0x1F600, 0xFB01]]
    common = list(" \n\t''stredABÉß1.,$ ")
    for _ in range(n):
        yield "".join(rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "", "<|endoftext|>", "<|"])


def test_texts_encode_like_the_libraries(enc, tik):
    word = WordBpe(WORD)
    words = word.encoder()
    words.kept.limit = 20_000  # forgets often
    assert word.width == 2
    with pytest.raises(ValueError):
        word.encoder(1)
    for text in [*odd_texts(1500), *(t or "" for _, t in ODD)]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tik.encode_ordinary(text)
        assert enc.decode(enc.encode(text)) == text.encode()
        assert np.frombuffer(words.encode(text), "<u4").tolist() == word.whole.encode(text, add_special_tokens=False).ids


def test_patterns_that_join_words_are_matched_whole(enc):
    assert enc.apart
    pattern = r"\p{L}+ \p{L}+|\S+|\s+"  # joins two words
    own = byte_bpe.Encoder(RANKS, pattern)
    tik = tiktoken.Encoding("joined", pat_str=pattern, mergeable_ranks=enc.ranks.ids, special_tokens={})
    for text in [*odd_texts(200), "some words here and there, 12 of them"]:
        assert not own.apart and np.frombuffer(own.encode(text), "<u4").tolist() == tik.encode_ordinary(text)


def test_prefix_table_appends_and_edits(enc):
    rnd = random.Random(1)
    for _ in range(100):
        s = bytes(rnd.choice(b"aabcrentionhth ") for _ in range(rnd.randint(0, 120)))
        table = byte_bpe.PrefixTable(enc.ranks, s[:20])
        table.append(s[20:])
        a, b = sorted((rnd.randint(0, len(s)), rnd.randint(0, len(s))))
        by = bytes(rnd.choice(b"tionre") for _ in range(rnd.randint(0, 9)))
        table.replace(a, b, by)
        s = s[:a] + by + s[b:]
        assert table.last == byte_bpe.PrefixTable(enc.ranks, s).last and table.ids() == enc.ranks.merged(s, 10**9)


def test_byte_bpe_rows(spark, tik):
    got = byte_bpe.encode_decode(docs(spark, ODD), RANKS, P.PATTERN).collect()
    want = []
    for i, t in ODD:
        ids = np.array(tik.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert byte_bpe.encode_decode(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_shards_round_trip(spark):
    shards = sstable.write_shards(docs(spark, ODD), WORD, 2, new_path(spark, "sst")).cache()
    rows = sorted(sstable.read_shards(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 7, 8]
    want = sorted((str(i), zlib.crc32(np.append(ids_of(t), 2).astype("<u4").tobytes())) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    opened = [sstable.open_shard(r["path"]) for r in shards.collect()]
    for i in (1, 4, 6, 8):
        found = [x for s in opened for x in s.get(i)]
        assert len(found) == 1 and found[0].tolist() == [*ids_of(dict(ODD)[i]).tolist(), 2]
    wanted = spark.createDataFrame([(1,), (4,), (5,), (5,), (99,), (None,)], "doc_id long")
    found = sstable.lookup(shards, wanted).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted((i, [*ids_of(t).tolist(), 2]) for i, t in ODD if i in (1, 4, 5))
    assert sum(len(s.get(5)) for s in opened) == 2 and not any(s.get(99) for s in opened)
    assert sstable.read_shards(sstable.write_shards(docs(spark, []), WORD, 2, new_path(spark, "sst"))).count() == 0


def test_shard_of_many_blocks(tmp_path):
    class Out:
        def __init__(self, f):
            self.f, self.write, self.close = f, f.write, f.close

    w = sstable.ShardWriter(Out(open(tmp_path / "s", "wb")), 4)
    sets = {i: np.arange(i % 300, dtype="<u4") + 70_000 for i in range(-500, 5000, 3)}
    for i, ids in sets.items():
        w.add(sstable.key_of(i), ids.tobytes())
    w.close()
    shard = sstable.open_shard(f"file://{tmp_path}/s")
    assert len(shard.index) > 5 and shard.documents == len(sets)
    for i in range(-503, 5003):
        found = shard.get(i)
        assert [f.tolist() for f in found] == ([sets[i].tolist()] if i in sets else [])
    assert sum(shard.may_hold(sstable.key_of(i)) for i in range(10_000, 20_000)) < 400


def pieces_are_whole(got, ids, capacity):
    """Each id of each document in exactly one piece, each sequence without gaps; returns the padding and the pieces."""
    sequences, docs_ = {}, {}
    for doc_id, start, length, crc, total, sequence, offset in got:
        sequences.setdefault(sequence, []).append((offset, length))
        docs_.setdefault(doc_id, []).append((start, length, crc, total))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert docs_.keys() == ids.keys()
    for doc_id, pieces in docs_.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(ids[doc_id]) and crc == zlib.crc32(ids[doc_id][at : at + length].tobytes())
            at += length
        assert at == len(ids[doc_id])
    return padding


def test_packing_holds_every_id_once(spark):
    rows = [(i, t) for i, t in ODD if i not in (None, 5, 7)] + [(100 + i, " ".join(f"w{j}" for j in range(i))) for i in range(200)]
    got = packing.pack(docs(spark, rows), WORD, 256).collect()
    pieces_are_whole(got, {i: np.append(ids_of(t), 1).astype("<u4") for i, t in rows}, 256)
    twice = packing.pack(docs(spark, ODD), WORD, 256).collect()
    assert sum(r["length"] for r in twice) == sum(len(ids_of(t)) + 1 for _, t in ODD)
    assert packing.pack(docs(spark, []), WORD).count() == 0


@pytest.mark.parametrize("capacity, high", [(2048, 3000), (256, 255), (64, 40), (1, 5), (100, 300)])
def test_packer_on_random_lengths(capacity, high):
    rnd = np.random.default_rng(high)
    ids = {i: np.full(n, i, "<u4") for i, n in enumerate(rnd.integers(1, high + 1, 3000))}
    packer = packing.Packer(capacity, 2)
    for i, x in ids.items():
        packer.add(i, x.tobytes())
    packer.finish()
    padding = pieces_are_whole(packer.out, ids, capacity)
    assert padding <= 0.01 * sum(map(len, ids.values())) and all(r[5] >> 40 == 2 for r in packer.out)
    if high > 100 and capacity > 255:
        assert len(packer.out) < 1.5 * len(ids) + sum(len(x) // capacity for x in ids.values())


def test_bins_hold_as_many_documents_as_their_class():
    packer = packing.Packer(2048, 0)
    for i in range(5):
        packer.add(i, bytes(4 * 409))  # 2048 // 409 is 5
    assert [r[:3] for r in packer.out] == [(i, 0, 409) for i in range(5)] and {r[5] for r in packer.out} == {0}
