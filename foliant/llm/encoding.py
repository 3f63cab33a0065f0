"""Problem 7: encode a corpus with a public byte-level BPE tokenizer.

Texts are encoded by the tokenizers library over Arrow batches.  The byte
level gives every byte one printable character, so a token's length in that
alphabet is its length in bytes; from that the offsets are derived, and
decoding reverses the table, also where a character is split over tokens.

Defined results: null and empty texts have the empty list; strings that look
like special tokens are ordinary text; repeated rows are encoded each; extra
columns are dropped.  Very long texts are encoded in parts: no token of this
family spans the border between a non-blank and a following blank, so cutting
there gives the ids of the whole text.
"""

from __future__ import annotations

import codecs
import os
import re
from itertools import accumulate

from pyspark.sql import DataFrame

from foliant.functions.batches import map_columns, spread

TOKENIZER_DIR = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
#: Characters of texts that are encoded at once, and of a part of a long text.
BATCH_CHARS, PART_CHARS = 400_000, 100_000
_BORDER = re.compile(r"(?<=\w)(?=[ \n])")
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer, loaded once per Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def parts(text: str) -> list[str]:
    """A long text in parts whose ids, one after another, are those of the text."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        m = _BORDER.search(text, at + PART_CHARS)
        if not m or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode_texts(tok, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text."""
    out: list[list[int]] = [[] for _ in texts]
    batch: list[str] = []
    owner: list[int] = []
    chars = 0

    def flush():
        for k, e in zip(owner, tok.encode_batch_fast(batch, add_special_tokens=False)):
            out[k].extend(e.ids)

    for i, text in enumerate(texts):
        for p in parts(text) if text else ():
            batch.append(p)
            owner.append(i)
            chars += len(p)
            if chars >= BATCH_CHARS:
                flush()
                batch, owner, chars = [], [], 0
    flush()
    return out


def byte_table() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1
    characters stand for themselves, other bytes for those from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tok) -> list[bytes]:
    """Bytes of each id."""
    table = byte_table()
    vocab = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        out[i] = bytes(table[c] for c in s) if all(c in table for c in s) else s.encode()
    return out


def decode(table: list[bytes], ids: list[int], errors: str = "strict") -> str:
    """Text of ids; characters split over tokens are put together again."""
    d = codecs.getincrementaldecoder("utf-8")(errors)
    return "".join(d.decode(table[i]) for i in ids) + d.decode(b"", True)


def offsets(table: list[bytes], text: str, ids: list[int]) -> list[int]:
    """Character in which each token begins (split characters: the same one)."""
    if text.isascii():
        return [0, *accumulate(len(table[i]) for i in ids)][: len(ids)]
    of_byte = [k for k, c in enumerate(text) for _ in range(len(c.encode()))]
    return [of_byte[b] for b in [0, *accumulate(len(table[i]) for i in ids)][: len(ids)]]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(key, ids)`` of every row."""

    def start():
        tok = tokenizer(path)

        def step(keys, texts):
            return [keys, encode_texts(tok, texts)]

        return step

    return map_columns(spread(df.select(key, text)), f"`{key}` {dict(df.dtypes)[key]}, ids array<int>", start)


def encode_spans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(key, n_tokens, starts, restored)``: where each token begins, and
    whether decoding gave the text again."""

    def start():
        tok = tokenizer(path)
        table = token_bytes(tok)

        def step(keys, texts):
            ids = encode_texts(tok, texts)
            texts = [t or "" for t in texts]
            return [keys, [len(i) for i in ids], [offsets(table, t, i) for t, i in zip(texts, ids)], [decode(table, i) == t for t, i in zip(texts, ids)]]

        return step

    return map_columns(spread(df.select(key, text)), f"`{key}` {dict(df.dtypes)[key]}, n_tokens int, starts array<int>, restored boolean", start)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(key, n_tokens)`` without shipping the ids."""

    def start():
        tok = tokenizer(path)

        def step(keys, texts):
            return [keys, [len(i) for i in encode_texts(tok, texts)]]

        return step

    return map_columns(spread(df.select(key, text)), f"`{key}` {dict(df.dtypes)[key]}, n_tokens int", start)

