import random

import pytest
import tiktoken
from tierflow.llm import bpe

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def known(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_odd_texts(vocabulary, known):
    pick = random.Random(1)
    parts = ["a", "b", "th", "e", "  ", "\n", "\t", " ", "'s", "'ll", "1", "23", "é", "日本", "　", "\x1c", "\x85", "\0", "!", "..", "🎉", "A", "̀", "ⅷ", "\r\n"]
    encoder = bpe.TextEncoder(vocabulary, public_tokenizers.PATTERN)
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        ids = encoder.encode(text)
        assert memoryview(ids).cast("I").tolist() == known.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_appends_and_edits(vocabulary, known):
    pick = random.Random(2)
    for _ in range(300):
        text = bytes(pick.choice(b"aeinrst") for _ in range(pick.randint(1, 400)))
        table = bpe.PrefixEncoding(vocabulary, text)
        start = pick.randint(0, len(text))
        stop = pick.randint(start, len(text))
        new = bytes(pick.choice(b"aeinrst") for _ in range(pick.randint(0, 9)))
        steps = table.replace(start, stop, new)
        table.append(b"end")
        assert table.text == text[:start] + new + text[stop:] + b"end"
        assert table.tokens() == bpe.PrefixEncoding(vocabulary, table.text).tokens() == known.encode_ordinary(table.text.decode())
        assert steps <= len(new) + len(text) - stop


def test_documents(spark, known):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 9000, 0), (3, "x" * 3000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(len, (r.ids for r in found.collect()))) == sorted(len(known.encode_ordinary(t or "")) for _, t, _ in rows)
    back = bpe.decode_documents(found, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes).decode() for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
