import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartulary.llm import byte_bpe, token_count

from .helpers import EDGE, frame, text

WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [*EDGE, "<|endoftext|> a<|startoftext|>b", text(3000, 1), "don't <|endoftext|>" * 50, "é e ́x", "ΟΔΟΣ Σ"]


def test_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(WORD)
    docs = frame(spark, TEXTS)
    for chunk, overlap in ((32_768, 512), (200, 8), (64, 1)):
        got = {r["doc_id"]: r for r in token_count.count_tokens(docs, WORD, chunk_chars=chunk, overlap_chars=overlap, limit=100).collect()}
        for i, t in enumerate(TEXTS):
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), (chunk, t)


UNSPACED = {
    "ideographs": lambda r, n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n)),
    "sentences": lambda r, n: "".join("\u3002" if r.random() < 0.05 else chr(r.randint(0x4E00, 0x5FA5)) for _ in range(n)),
    "base64": lambda r, n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)),
    "letters": lambda r, n: "".join(r.choice("etaoinshrdlu") for _ in range(n)),
    "code": lambda r, n: "".join(r.choice(["a=b", "(x)", "'s", "''", "fn", "{", "}", ";", "'ll", "7", "<|endoftext|>", "Σ", "İ"]) for _ in range(n // 2)),
    "symbols": lambda r, n: "".join(r.choice("-=+*'") for _ in range(n)),
    "hangul": lambda r, n: "".join(chr(r.choice([0x1100, 0x1161, 0x11A8, 0xAC00]) + r.randint(0, 10)) for _ in range(n)),
    "marks": lambda r, n: "".join(r.choice(["e\u0301", "\u0915\u093c", "\u0958", "a", "\u0e01\u0e34", "o\u0328\u0302"]) for _ in range(n // 2)),
}


@pytest.mark.parametrize("kind", sorted(UNSPACED))
def test_splice_gives_the_same_ids_without_white_space(kind):
    tok = Tokenizer.from_file(WORD)
    r = random.Random(4)
    for n, chunk, overlap in ((1500, 150, 4), (1500, 64, 1), (6000, 400, 32)):
        t = UNSPACED[kind](r, n)
        ids, stats = token_count.encode_spliced(tok, t, chunk, overlap)
        assert ids == tok.encode(t, add_special_tokens=False).ids, (n, chunk)
        assert stats["chunks"] > 1


@pytest.mark.parametrize("kind", sorted(UNSPACED))
def test_work_is_linear_without_white_space(kind):
    tok = Tokenizer.from_file(WORD)
    t = UNSPACED[kind](random.Random(5), 60_000)
    _, stats = token_count.encode_spliced(tok, t, 2_000, 64)
    assert stats["chars"] <= (2 if kind != "marks" else 30) * len(t), stats


def test_splice_widens():
    tok = Tokenizer.from_file(WORD)
    widened = 0
    for t in (text(2000, 3), "x" * 3000, "ab1" * 700 + " " + "c" * 900 + " d"):
        ids, stats = token_count.encode_spliced(tok, t, 150, 4)
        assert ids == tok.encode(t, add_special_tokens=False).ids
        widened += stats["widened"]
    assert widened > 0


def test_empty_table(spark):
    docs = frame(spark, ["a"]).limit(0)
    assert token_count.count_tokens(docs, WORD).count() == 0
    assert byte_bpe.encode_documents(docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("dictionary", [0, 5, 10_000])
def test_bpe_equals_the_library(spark, dictionary):
    ranks = byte_bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, "  lead", "trail ", "a \n b\n\n  c", "\x00 nul \x00x", "z" * 300 + "é" * 100]
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(frame(spark, texts), RANKS, P.PATTERN, dictionary_words=dictionary).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"], got[i]["round_trip"]) == want, t


def test_fold_and_heap_agree(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    table = byte_bpe.RankTable(ranks)
    some = [" hello", "thonouen", "é", " 日本", "a'b", "xqzjk", "the", "1234567"]
    df = spark.createDataFrame([(w,) for w in some], "w string").select("w", table.encode(F.col("w")).alias("ids"))
    for r in df.select("w", "ids", table.decode(F.col("ids")).alias("out")).collect():
        assert r["ids"] == byte_bpe.merge_word(ranks, r["w"].encode())
        assert bytes(r["out"]) == r["w"].encode()
    long = ("ab cd" * 30 + "é").encode()
    short, byte_bpe.FOLD_BYTES = byte_bpe.FOLD_BYTES, 10_000
    scanned = byte_bpe.merge_word(ranks, long)
    byte_bpe.FOLD_BYTES = short
    assert byte_bpe.merge_word(ranks, long) == scanned
