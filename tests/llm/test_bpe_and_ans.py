import base64
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tallyboard.llm import ans, byte_bpe, pretoken
from tallyboard.llm.shared import stage_table

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def own():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_codepoint_and_odd_mixes(own, library):
    pieces = byte_bpe.Vocabulary(own).pieces
    rng = np.random.default_rng(3)
    signs = list("abcsLltrevmd'''  \n\t 　 " + "12!?.٣é漢\U0001f600́\x85\x1c")
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 1000, "'" * 999 + "s", "", "ends \n ", "'ll", "<|endoftext|>"]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, bounds = pretoken.encode_texts(texts, pieces)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(t)


def test_cache_may_start_anew(own, library):
    pieces = byte_bpe.Vocabulary(own).pieces
    pieces.limit = 3
    for text in ["one two three four", "five six", "one five nine", ""]:
        ids, _ = pretoken.encode_texts([text], pieces)
        assert ids.tolist() == library.encode_ordinary(text)


def test_encode_and_decode(docs, corpus, own, library):
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, own), own)).collect()
    want = {i: library.encode_ordinary(t or "") for i, t, *_ in corpus}
    text = {r[0]: r[1] for r in corpus}
    assert len(got) == len(corpus)
    for row in got:
        ids = want[row["doc_id"]]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert bytes(row["decoded"]) == (text[row["doc_id"]] or "").encode()
        assert row["ends"] == np.cumsum([len(library.decode_single_token_bytes(i)) for i in ids]).tolist()


def test_encode_odd_rows(odd, none, own):
    rows = byte_bpe.decode(byte_bpe.encode(odd, own), own).collect()
    assert len(rows) == 6 and {r["score"] for r in rows} == {"x"}
    assert byte_bpe.encode(none, own).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 16, 1000, 5000])
def test_ans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 4999).astype(np.int32)
    table = ans.scaled(np.bincount(ids, minlength=5000))
    block = ans.encode_block(ids, table, lanes=16, every=8)
    assert ans.decode_block(block, table).tolist() == ids.tolist()
    for mark in range(-(-n // (16 * 8))):
        part = ids[mark * 128 : (mark + 1) * 128]
        assert ans.decode_block(block, table, mark).tolist() == part.tolist()
    if n > 16:
        spoiled = bytearray(block)
        spoiled[-1] ^= 1
        with pytest.raises(ValueError):
            ans.decode_block(bytes(spoiled), table)


def test_one_symbol_and_full_table():
    ids = np.full(3000, 2, np.int32)
    table = ans.scaled(np.bincount(ids, minlength=5))
    assert ans.decode_block(ans.encode_block(ids, table), table).tolist() == ids.tolist()
    assert int(ans.scaled(np.arange(50_000)).count.sum()) == 1 << ans.SCALE_BITS


def test_blocks_hold_what_the_library_gives(docs, corpus):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    data = open(path, "rb").read()
    tokens = stage_table(ans.tokenize(docs, data, 0, parts=3), "tokens")
    counts = ans.count_ids(tokens, 50_257)
    got = sorted(map(tuple, ans.read_blocks(ans.encode_blocks(tokens, counts), counts).collect()))
    want, start = [], 0
    for i, t, *_ in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_blocks_of_odd_rows(odd, none):
    data = open(P.path("byte_bpe_50k.json"), "rb").read()
    blocks, counts = ans.write(odd, data, 50_257, 0)
    rows = ans.read_blocks(blocks, counts).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 5, 5, 5, 7]
    assert rows[0]["n_tokens"] == 1 and rows[-1]["n_tokens"] == 1
    blocks, counts = ans.write(none, data, 50_257, 0)
    assert ans.read_blocks(blocks, counts).count() == 0


def test_cache_starts_anew_and_holds_large_passes():
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return [[ord(c) for c in p] for p in pieces]

    pieces = pretoken.Pieces(encode, limit=8)
    texts = [" ".join(f"w{i * j % 37}é" for i in range(60)) for j in range(5)] + ["", "a b", "漢 漢"]
    for _ in range(3):
        ids, bounds = pretoken.encode_texts(texts, pieces)
        assert ["".join(map(chr, ids[a:b])) for a, b in zip(bounds, bounds[1:])] == texts
        for text in texts:
            ids, bounds = pretoken.encode_texts([text], pieces)
            assert "".join(map(chr, ids)) == text
    assert len(pieces.keys) >= 2 * len(pieces.sizes) and "" not in seen


def test_pairs_of_hashes_in_one_place():
    pieces = pretoken.Pieces(lambda p: [[len(x)] for x in p], limit=4)
    size = len(pieces.keys)
    hashes = np.array([1 + size * i for i in range(size // 2)], np.uint64)
    pieces._add(hashes, np.arange(len(hashes), dtype=np.int32))
    assert pieces._find(hashes).tolist() == list(range(len(hashes)))
    assert (pieces._find(hashes + np.uint64(2)) < 0).all()


def test_round_trip_is_encode_and_decode(docs):
    import public_tokenizers

    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    two = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary))
    want = {r["doc_id"]: (r["ids"], r["decoded_sha256"], r["lang"]) for r in two.collect()}
    got = byte_bpe.round_trip(docs, vocabulary)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded_sha256"]
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"], r["lang"]) for r in got.collect()} == want


def test_rows_of_one_id_go_to_several_ranges(spark):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        tokenizer = file.read()
    rows = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)], "doc_id long, text string")
    parts = ans.tokenize(rows, tokenizer, 0, 8).groupBy("doc_id").agg({"part": "approx_count_distinct"}).collect()
    assert all(r[1] > 1 for r in parts)
    with pytest.raises(ValueError):
        ans.write(rows, tokenizer, 70_000, 0)
