"""Operator 2: byte-level BPE encoding and decoding.

1. The corpus is split by the tokenizer's pattern and the distinct pieces
   ("words") are counted over all documents; only per-task distinct words are
   shuffled.
2. The most frequent words, at most ``dictionary_words`` of them, are encoded
   by Spark higher-order functions: ``aggregate`` folds the ranked merges over
   the word's bytes, looking ranks up in a literal rank map, and ``decode``
   concatenates the binary pieces of the ids back.
3. That dictionary (its size bounded by the parameter, whatever the corpus) is
   broadcast and every whole text is encoded word by word, with a bounded memo
   of the space-delimited chunks already seen.  A word outside the dictionary
   is folded where it stands by the same ranked merges
   (``merge_word``), so no document's result depends on the bound.

The rank map is an array of small maps, chosen by CRC-32, because a lookup in
one Spark map scans it.  Byte strings are held as hex inside the fold, so that
concatenating hex concatenates the bytes.

Defined results: null and empty texts have 0 tokens and decode to no bytes;
repeated rows are encoded each; a word of any length is exact (words of over
``FOLD_BYTES`` bytes use a heap).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table, texts_of

#: Maps in the literal rank map.
BUCKETS = 16_384
#: Words up to this many bytes are folded by scanning all pairs at each merge.
FOLD_BYTES = 40
DICTIONARY_WORDS = 262_144
#: Encoded chunks and rare words that a worker remembers, twice over at most.
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}


class RankTable:
    """A rank file as Column expressions."""

    def __init__(self, ranks: dict[bytes, int], buckets: int = BUCKETS):
        maps: list[dict[str, int]] = [{} for _ in range(buckets)]
        for piece, rank in ranks.items():
            key = piece.hex().upper()
            maps[zlib.crc32(key.encode()) % buckets][key] = rank
        by_id = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece.hex().upper()
        self.buckets = buckets
        self.map = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")
        self.pieces = F.from_json(F.lit(json.dumps(by_id, separators=(",", ":"))), "array<string>")

    def encode(self, word: Column) -> Column:
        """array<int>: the ids of one pre-token.  A lambda binds the rank map, so a plan holds it once."""
        return F.get(F.transform(F.array(self.map), lambda held: self._encode(word, held)), F.lit(0))

    def _encode(self, word: Column, held: Column) -> Column:
        code = F.hex(F.encode(word, "utf-8"))
        n = F.octet_length(word)
        start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(code, 2 * i + 1, F.lit(2)))

        def rank(piece: Column) -> Column:
            """The rank of a piece in hex, null if it is no token."""
            return F.try_element_at(F.get(held, (F.crc32(piece) % self.buckets).cast("int")), piece)

        def merge(pieces: Column, ranks: Column) -> Column:
            j = F.array_position(ranks, F.array_min(ranks)).cast("int")
            joined = F.concat(F.get(pieces, j - 1), F.get(pieces, j))
            return F.concat(F.slice(pieces, F.lit(1), j - 1), F.array(joined), F.slice(pieces, j + 2, F.greatest(F.size(pieces) - j - 1, F.lit(0))))

        def step(state: Column, _: Column) -> Column:
            pieces = state["pieces"]
            pairs = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>"))
            bound = F.transform(F.array(F.transform(pairs, lambda i: rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))))), lambda r: F.when(F.array_min(r).isNull(), F.struct(pieces.alias("pieces"), F.lit(True).alias("done"))).otherwise(F.struct(merge(pieces, r).alias("pieces"), F.lit(False).alias("done"))))
            return F.when(state["done"], state).otherwise(F.get(bound, F.lit(0)))

        first = F.struct(start.alias("pieces"), F.lit(False).alias("done"))
        folded = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: F.transform(s["pieces"], rank))
        whole = rank(code)
        return F.when(n == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(folded)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: the concatenation of their binary pieces."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))


def merge_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The ranked merges of one word, for words outside the dictionary."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    get = ranks.get
    if len(word) <= FOLD_BYTES:
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(word[i : i + 2]) for i in range(len(word) - 1)]
        while pairs:
            known = [r for r in pairs if r is not None]
            if not known:
                break
            j = pairs.index(min(known))
            parts[j : j + 2] = [parts[j] + parts[j + 1]]
            del pairs[j]
            if j:
                pairs[j - 1] = get(parts[j - 1] + parts[j])
            if j < len(pairs):
                pairs[j] = get(parts[j] + parts[j + 1])
        return [ranks[p] for p in parts]
    # Long: a heap of candidate merges over a linked list of pieces.
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


#: A space between two characters that aren't white space: under the pattern every
#: such space starts a piece, so a text can be cut before each of them.
_lone_space = re.compile(r"(?<=\S)[ ](?=\S)")
#: Texts that Arrow's plain split at spaces would cut elsewhere or mark wrongly.
_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_UNEVEN = f" {_BLANK}|{_BLANK} |^{_BLANK}|{_BLANK}$|^$|\\x00"
#: Bytes of text that are worked on at once.
PIECE = 6 << 20


def chunks_of(text: str) -> list[str]:
    """The text cut before lone spaces; pieces of the chunks are the pieces of the text."""
    parts = _lone_space.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


def chunk_table(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of some texts, the number of each chunk in text order, and where each text's chunks begin (and end)."""
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    even = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x00"), texts.filter(pa.array(~uneven)), pa.scalar("")), " ")
    coded = even.flatten().dictionary_encode()
    names = [k[1:] if k[:1] == "\x00" else " " + k for k in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy()
    if not uneven.any():
        return names, codes, np.r_[0, np.cumsum(pc.list_value_length(even).to_numpy(zero_copy_only=False))].astype(np.int64)
    place = {n: i for i, n in enumerate(names)}
    rest = [[place.setdefault(c, len(place)) for c in chunks_of(t)] for t in texts.filter(pa.array(uneven)).to_pylist()]
    size = np.zeros(len(texts), np.int64)
    size[~uneven], size[uneven] = pc.list_value_length(even).to_numpy(zero_copy_only=False), list(map(len, rest))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.int64)
    odd = np.repeat(uneven, size)
    out[~odd], out[odd] = codes, [c for r in rest for c in r]
    return list(place), out, np.r_[0, ends]


def slices(batch: pa.RecordBatch, column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text."""
    n = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(n, (n[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Memo:
    """A bounded memo of two generations: what was used since the last turn stays."""

    def __init__(self, make, size: int):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def __call__(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key) or self.make(key)
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n: how often each pre-token occurs in all texts (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, chunks = regex.compile(pattern).findall, {}

        def out() -> pa.RecordBatch:
            held: dict[str, int] = {}
            for chunk, n in chunks.items():
                for w in find(chunk):
                    held[w] = held.get(w, 0) + n
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                names, codes, _ = chunk_table(part.column(0))
                for c, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                    chunks[c] = chunks.get(c, 0) + n
                if len(chunks) > 600_000:
                    yield out()
                    chunks = {}
        if chunks:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_dictionary(docs: DataFrame, table_: RankTable, pattern: str, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """word, ids, decoded of the most frequent words, each folded once."""
    frequent = count_words(docs, pattern).filter(F.octet_length("word") <= FOLD_BYTES).orderBy(F.desc("n"), "word").limit(dictionary_words)
    spark = docs.sparkSession
    words = stash(frequent.select("word"), "bpe-words")
    release(spark)
    spread = words.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return stash(spread.select("word", table_.encode(F.col("word")).alias("ids")).select("word", "ids", table_.decode(F.col("ids")).alias("decoded")), "bpe-dictionary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", dictionary_words: int = DICTIONARY_WORDS, keep: bool = True, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip of every row.

    ``keep``: a worker keeps the dictionary for its next task; without, other jobs of the session have that memory.
    ``memo``: entries that a worker remembers besides.
    """
    ranks = read_ranks(ranks_path)
    rows = texts_of(docs, id_col, text_col)
    spark = docs.sparkSession
    found = build_dictionary(rows, RankTable(ranks), pattern, dictionary_words).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as w:
        w.write_table(found)
    shipped, shipped_ranks = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), spark.sparkContext.broadcast(ranks)
    token = uuid.uuid4().hex
    del found, sink
    release(spark)
    pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        (encode, rarely), sha = _worker_state(token, pattern, shipped, shipped_ranks, memo), hashlib.sha256
        for batch in batches:
            for part in slices(batch, 1):
                names, codes, at = chunk_table(part.column(1))
                got = list(map(encode, names))
                n = np.fromiter([g[2] for g in got], np.int64, len(got))[codes]
                n = np.add.reduceat(np.append(n, 0), at[:-1]) * (at[1:] > at[:-1])
                whole = lambda k, sep: pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([g[k] for g in got], pa.binary()).take(pa.array(codes))), sep).to_pylist()  # noqa: B023, E731
                ids_hex = [sha(x).hexdigest() for x in whole(0, b",")]
                out = whole(1, b"")
                same = [a == b.as_buffer().to_pybytes() if b.is_valid else False for a, b in zip(out, part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids_hex, pa.string()), pa.array([sha(x).hexdigest() for x in out], pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
        # A worker outlives the task and must not hold memos through other jobs.
        encode.clear()
        rarely.clear()
        if not keep:
            _state.clear()
            pa.default_memory_pool().release_unused()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


_state: dict[str, tuple[Memo, Memo]] = {}


def _worker_state(token: str, pattern: str, shipped, shipped_ranks, memo: int) -> tuple[Memo, Memo]:
    """What encodes a chunk, and a rare word, to (ids, decoded bytes, number of ids) in this worker; one set is held at a time."""
    if token not in _state:
        import regex

        _state.clear()
        ranks, find = shipped_ranks.value, regex.compile(pattern).findall
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for p, i in ranks.items():
            pieces[i] = p
        known: dict[str, tuple[bytes, bytes, int]] = {}
        with pa.ipc.open_stream(shipped.value) as reader:
            for batch in reader:
                for w, ids, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    known[w] = (",".join(map(str, ids)).encode(), out, len(ids))

        def rare(w: str) -> tuple[bytes, bytes, int]:
            ids = merge_word(ranks, w.encode("utf-8"))
            return ",".join(map(str, ids)).encode(), b"".join([pieces[i] for i in ids]), len(ids)

        rarely = Memo(rare, memo)

        def chunk(x: str) -> tuple[bytes, bytes, int]:
            got = [known.get(w) or rarely(w) for w in find(x)]
            if len(got) == 1:
                return got[0]
            return b",".join([g[0] for g in got]), b"".join([g[1] for g in got]), sum([g[2] for g in got])

        _state[token] = Memo(chunk, memo), rarely
    return _state[token]


def query_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Chunks are told apart once a batch: larger batches save more than they hold.
    return encode_documents(table(spark, sf_dir, "documents", batch=64 << 20), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As the query, with less memory in workers, since the session has run other stages."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, dictionary_words=DICTIONARY_WORDS // 2, keep=False, memo=MEMO // 5)
