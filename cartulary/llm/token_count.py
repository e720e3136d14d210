"""Operator 1: token counts with overlap resynchronisation for huge documents.

A document of at most ``chunk_chars`` is counted word by word: this
tokenizer's normaliser and pre-tokenizer never join text across ASCII white
space, so counts of white-space words add up, and a bounded memo holds the
counts of words already seen by the worker.

A longer document is encoded in overlapping chunks with offsets.  Two
neighbouring chunks are spliced at a position of their overlap where both start
a token, ``agree`` tokens on either side are the same at the same places, and
the place is proven stable (``proven``): either the pre-tokenizer ends a piece
there whatever surrounds it, or chunk and splice lie in one run of letters or of
symbols.  Inside a run the splice is the encoding of the whole run since a
sequence of tokens is the byte-pair encoding of its text if every two
neighbours are that of theirs, and all neighbours here are neighbours in one of
the two encodings.  When no such position exists the overlap is doubled and the
chunk is encoded again; when that reaches the start of the left chunk the two
become one and the next chunk is as long as both, so the work stays linear and
the result is always that of the library on the whole text.  Only two
neighbouring chunks are held.

Defined results: null text counts as empty (0 bytes, 0 tokens); white space
only has 0 tokens; repeated rows are counted each; a text that offers no proven
position ends as one widened chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from unicodedata import category, is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, texts_of

_WORDS = re.compile(WORD)
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_loaded: dict[str, tuple] = {}
#: Entries of the per-worker memo; it is emptied when full, so memory stays bounded.
MEMO = 600_000


def load_tokenizer(blob: bytes):
    """The tokenizer of a .json file's bytes and its memo, once per worker."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(blob.decode("utf-8"))
        tok.no_truncation()
        tok.no_padding()
        _loaded[key] = (tok, {})
    return _loaded[key]


def proven(text: str, lo: int, p: int) -> bool:
    """Whether the whole text's pieces are cut at ``p``, or run through ``lo`` to ``p``, as a chunk from ``lo`` has them.

    White space is in no piece, a digit is one, and a letter never shares a piece
    with a symbol after it.  Where a mark might compose or stand out nothing is proven.
    """
    before, after = text[p - 1], text[p]
    if before in _SPACE:
        return True
    kind = category(after)[0]
    if kind not in "LNPS" or not is_normalized("NFC", text[max(lo, p - 2) : p + 2]):
        return False
    if "0" <= before <= "9" or "0" <= after <= "9" or (kind in "PS" and before.isalpha() and before.lower().isalpha()):
        return True
    run = text[lo : p + 1]
    same = run.isalpha() and run.lower().isalpha() if kind == "L" else kind in "PS" and all(category(c)[0] in "PS" for c in run)
    return same and is_normalized("NFC", run)


def stable_cut(text: str, left: tuple[list, list], right: tuple[list, list], lo: int, agree: int) -> tuple[int, int] | None:
    """Indexes (in left, in right) of the token that starts at a proven stable position, or None.

    Encodings are (ids, starts).  ``lo`` is where the right chunk begins: tokens right at its edge are not trusted.
    """
    (ids, at), (r_ids, r_at) = left, right
    place: dict[int, int] = {}
    for k, q in enumerate(r_at):
        if q > at[-1]:
            break
        place.setdefault(q, k)
    for i in range(len(ids) - agree, agree - 1, -1):
        q = at[i]
        if q <= lo:
            return None
        j = place.get(q, -1)
        if j >= agree and at[i - 1] != q and ids[i - agree : i + agree] == r_ids[j - agree : j + agree] and at[i - agree : i + agree] == r_at[j - agree : j + agree] and proven(text, lo, q):
            return i, j
    return None


def spliced(tok, text: str, chunk_chars: int = 32_768, overlap_chars: int = 512, agree: int = 2, stats: dict | None = None) -> Iterator[list[int]]:
    """The token ids of the whole text, in runs; ``stats`` counts chunks, widenings and characters encoded."""
    stats = stats if stats is not None else {}
    stats.update(chunks=0, widened=0, chars=0)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def edge(q: int) -> int:
        """``q``, or the start of the special string around it."""
        starts = [i for x in special if (i := text.find(x, max(0, q - len(x) + 1), q + len(x) - 1)) >= 0 and i < q < i + len(x)]
        return min(starts, default=q)

    def encode(begin: int, end: int) -> tuple[list, list]:
        e = tok.encode(text[begin:end], add_special_tokens=False)
        stats["chunks"] += 1
        stats["chars"] += end - begin
        return e.ids, [a + begin for a, _ in e.offsets]

    start, stop, step = 0, edge(min(len(text), chunk_chars)), max(1, chunk_chars - overlap_chars)
    if not stop:
        stop = min(len(text), 2 * chunk_chars)
    left = encode(0, stop)
    while stop < len(text):
        overlap, end = overlap_chars, edge(min(len(text), stop + step))
        end = end if end > stop else min(len(text), stop + step + 64)
        while True:
            begin = max(start, edge(max(start, stop - overlap)))
            right = encode(begin, end)
            cut = stable_cut(text, left, right, begin, agree) if left[0] and right[0] and begin > start else None
            if cut:
                yield left[0][: cut[0]]
                left, start = (right[0][cut[1] :], right[1][cut[1] :]), right[1][cut[1]]
                step = max(1, chunk_chars - overlap_chars)
                break
            if begin == start:  # nothing in all of the left chunk aligns: the two become one, and the next chunk is as long
                left, step = right, end - start
                break
            stats["widened"] += 1
            overlap *= 2
        stop = end
    yield left[0]


def encode_spliced(tok, text: str, chunk_chars: int = 32_768, overlap_chars: int = 512, agree: int = 2) -> tuple[list[int], dict]:
    """Token ids of the whole text, and the counts of ``spliced``."""
    stats: dict = {}
    return [i for run in spliced(tok, text, chunk_chars, overlap_chars, agree, stats) for i in run], stats


def _counts(tok, memo: dict, texts: list[str]) -> list[int]:
    """Token counts of short texts: the sum over their white-space words."""
    words = [_WORDS.findall(t) for t in texts]
    new = list({w for ws in words for w in ws if w not in memo})
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = list({w for ws in words for w in ws})
    for k in range(0, len(new), 8192):
        part = new[k : k + 8192]
        memo.update(zip(part, map(len, tok.encode_batch(part, add_special_tokens=False)), strict=True))
    return [sum(map(memo.__getitem__, ws)) for ws in words]


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened of every row.

    ``tokenizer_json`` is read on the driver and shipped (a few MB, whatever the corpus).
    """
    with open(tokenizer_json, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, memo = load_tokenizer(blob.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(2).to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                n, chunks, widened = ([0] * len(texts) for _ in range(3))
                for i, x in zip(short, _counts(tok, memo, [texts[i] for i in short]), strict=True):
                    n[i] = x
                for i, t in enumerate(texts):
                    if len(t) > chunk_chars:
                        stats: dict = {}
                        n[i] = sum(map(len, spliced(tok, t, chunk_chars, overlap_chars, stats=stats)))
                        chunks[i], widened[i] = stats["chunks"], stats["widened"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    rows = texts_of(docs, id_col, text_col)
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int")


def query_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
