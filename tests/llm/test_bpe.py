import hashlib
import random

import numpy as np
import pytest

from glossaflow.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "ab é'stre \n\t\x0b\x1c\x85\xa0 　日本かな한글١٢½😀,.!<|>0123́​"


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe._default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(bpe._default_path())


def test_ids_and_decoding_equal_the_library(reference, codec):
    rng = random.Random(0)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "x" * 5000, "ab" * 900 + " " * 300, "it's  we'll\n\n\n  don't"]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert codec.decode(ids) == reference.decode(expected, skip_special_tokens=False)


def test_letters_and_numbers_are_those_of_the_library():
    """Every character beside a letter, a digit and a sign: the pieces are the library's, whatever Unicode the patterns here know."""
    split = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    find = bpe._pieces().findall
    wrong = []
    for lo in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        if [len(p) for p in find(text)] != [end - start for _, (start, end) in split(text)]:
            wrong.append(hex(lo))
    assert not wrong


def test_long_and_short_pieces_merge_alike(codec):
    for n in (1, 2, 17, 64):
        piece = ("thereation" * 10)[:n].encode()
        assert codec.merge_short([piece])[0] == codec.merge_long(piece).astype("<u4").tobytes()


def test_full_cache_changes_nothing(reference):
    codec = bpe.Codec.load(bpe._default_path())
    codec.cache_entries = 3
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick dog"] * 3
    for t in texts:
        assert np.frombuffer(codec.encode_many([t])[0], "<u4").tolist() == reference.encode(t).ids


def test_awkward_rows(spark, awkward, empty, reference):
    rows = {(r["id"], r["ids_sha256"]): r for r in bpe.round_trip_digests(awkward).collect()}
    for r in awkward.select("doc_id", "text").collect():
        text = r["text"] or ""
        ids = np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = rows[(r["doc_id"], hashlib.sha256(ids).hexdigest())]
        assert found["n_tokens"] == len(ids) // 4
        assert found["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip_digests(awkward).count() == awkward.count()
    assert bpe.encode(empty).count() == 0


def test_encode_then_decode(awkward):
    back = {(r["id"], r["text"]) for r in bpe.decode(bpe.encode(awkward)).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()}
