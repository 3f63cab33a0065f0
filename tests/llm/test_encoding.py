from __future__ import annotations

import base64
import random

import pytest
import tiktoken

from foliant.llm import encoding as N

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATH = f"{N.TOKENIZER_DIR}/{N.TOKENIZER}"
TEXTS = ["", "Hello world", "<|endoftext|> is text", "Đường đi ngắn nhất 🦜👩‍👩‍👧", "a\r\n\tb  c d​", "x" * 5000, "é" * 300, "\x00\x1f", " " * 50]


def other(texts):
    with open(f"{N.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t) for t in texts]


def test_ids_equal_those_of_another_library():
    assert N.encode_texts(N.tokenizer(PATH), TEXTS) == other(TEXTS)


def test_round_trip_and_offsets():
    tok = N.tokenizer(PATH)
    table = N.token_bytes(tok)
    for text, ids in zip(TEXTS, N.encode_texts(tok, TEXTS)):
        assert N.decode(table, ids) == text
        starts = N.offsets(table, text, ids)
        assert len(starts) == len(ids) and starts == sorted(starts) and (not starts or starts[0] == 0)
    assert N.decode(table, N.encode_texts(tok, ["🦜"])[0][:1], "replace") == "�"


@pytest.mark.parametrize("seed", range(3))
def test_long_texts_in_parts_have_the_ids_of_the_whole(seed, monkeypatch):
    rng = random.Random(seed)
    text = "".join(rng.choice(["từ ", "word", "  ", "\n\n", "it's ", "1234 ", "!? ", "\t", "é", "漢字 "]) for _ in range(3000))
    whole = N.encode_texts(N.tokenizer(PATH), [text])
    monkeypatch.setattr(N, "PART_CHARS", 97)
    monkeypatch.setattr(N, "BATCH_CHARS", 301)
    assert len(N.parts(text)) > 10 and N.encode_texts(N.tokenizer(PATH), [text, None, text]) == [whole[0], [], whole[0]]


def test_irregular_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (3, " ", 0), (None, "a", 0)], "doc_id bigint, text string, ids int")
    got = sorted((str(r.doc_id), r.ids) for r in N.encode(df).collect())
    assert got == [("1", []), ("2", []), ("3", [220]), ("3", [220]), ("None", [64])]
    assert N.encode(df.limit(0)).count() == 0
    assert all(r.restored for r in N.encode_spans(df).collect())
