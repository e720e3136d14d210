"""Operator 9: fuzzy line dedup by MinHash.

1. Every line with a word (normalised: lower case, white space collapsed) gets a
   128-bit key.  Lines of at least ``SHINGLE`` characters also get a MinHash
   signature of their character shingles, as ``BANDS`` band keys of ``ROWS``
   values: 99.8 % of pairs at the threshold share a key, unrelated lines hardly
   ever do.  A task signs a line once, however often it reads it.
2. Band keys are shuffled as packed blocks, so that a row of the exchange
   holds thousands of them, and cut to five bytes.  Distinct lines that share a band key are
   candidates; buckets with the same least member are one group, so a line's
   text travels once per group and not once per band.
3. Candidates' texts are fetched by a second scan behind a Bloom filter of
   (line, first document), so each text is fetched about once, and every group is
   verified: two lines are linked if their exact shingle Jaccard is at least
   ``similarity``.  Only lines that are not connected yet are compared.  A
   group of more than ``group_rows`` lines is cut into pieces that share some
   leaders; what these do not connect is compared with all pieces afterwards.
4. Distributed union-find (connected components) over the links; of each
   component one line stays: the first one in the document with the smallest
   doc_id.

Defined results: blank lines always stay; lines of fewer than ``SHINGLE``
normalised characters are only equal or not; ``min_chars`` (1: all) leaves
shorter lines alone; null texts stay null; rows that repeat a doc_id are one
document (all of them keep what it keeps); rows with a null doc_id are left as
they are; a document may lose all its lines and then has the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.graph import connected_components

from .common import drop_stash, release, stash, table, texts_of

SHINGLE = 5
BANDS, ROWS = 27, 7
#: Permutations that share the values of a long line's signature.
TURNS = 3
#: Code points from here on don't fit into five packed ones.
NARROW = 1 << 12
#: Shingles from which TURNS permutations serve all values.
FEW = 64
SIMILARITY = 0.8
MIN_CHARS = 1
GROUP_ROWS = 4_096
CALL_ROWS = 2_048
#: Lines (about) that all pieces of a large group share.
LEADERS = 32
#: Groups from this size on are verified by counting into arrays, smaller ones by sets.
LARGE = 32
#: Characters that are hashed at once (arrays stay in the processor's cache), and signed per block.
HASHED, SIGNED = 150_000, 4_000_000
#: A band key as it travels besides its part, 5 bytes and the line's h1: about 8 pairs of the 4 million keys
#: of a part collide and are verified in vain, none is lost.
CUT = np.dtype([("low", "<u4"), ("high", "u1"), ("h1", "<i8")])
#: Bytes of band keys (unpacked) per task of their exchange, if lines have LINE_BYTES.
TASK_BYTES, LINE_BYTES = 64 << 20, 64
BLOOM_BITS = 28
_VALUES = BANDS * ROWS
_BINS = _VALUES // TURNS
_U = np.uint64
_NONE = ~_U(0)
_MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)
#: A product with an odd number permutes the hashes.
_ODD = np.random.default_rng(9).integers(0, 2**63, _VALUES, dtype=np.uint64) * _U(2) + _U(1)


def normalise(line: str) -> str:
    return _spaced(line.lower())


def _spaced(line: str) -> str:
    """Words of a line, one space between each."""
    # A printable line has no white space but spaces.
    return line.strip(" ") if "  " not in line and line.isprintable() else " ".join(line.split())


def _mix(h: np.ndarray) -> np.ndarray:
    """Mixes the hashes where they stand."""
    h ^= h >> _U(32)
    h *= _MIX[2]
    h ^= h >> _U(29)
    h *= _MIX[0]
    h ^= h >> _U(32)
    return h


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles in order, and how many each line has (repeats included).

    Shingles of characters below ``NARROW`` fill 60 bits, so their hashes are as different as they are.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - SHINGLE + 1
    two = codes[1:] << _U(12)
    two |= codes[:-1]
    h = two[2 : 2 + n] << _U(24)
    h |= two[:n]
    h |= codes[SHINGLE - 1 :] << _U(48)
    wide = codes >= _U(NARROW)
    if wide.any():
        at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(wide, SHINGLE).any(axis=1))
        mixed = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            mixed *= _MIX[1]
            mixed += codes[at + k]
            _mix(mixed)
        h[at] = mixed | _U(1 << 63)
    inside, ends = np.ones(len(codes), bool), np.cumsum(size)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return _mix(h)[inside[:n]], size - SHINGLE + 1


def runs(lines: list[str], chars: int) -> Iterator[slice]:
    """Slices of about ``chars`` characters."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    begin = 0
    while begin < len(lines):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + chars, "right")))
        yield slice(begin, stop)
        begin = stop


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the place of the line that has each; lines are at least SHINGLE characters long.

    Lines with ``FEW`` shingles or more get one-permutation signatures, ``TURNS``
    of them.  Few shingles would leave most bins empty, so lines with less than
    ``2 * FEW`` get signatures with a permutation for each value; those between
    have both, since similar lines may lie on either side of the limit.
    """
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    size = np.fromiter(map(len, lines), np.int64, len(lines)) - SHINGLE + 1
    # Lines of one kind go together, so that no hashes are picked out of others.
    for many, few, kind in ((True, False, size >= 2 * FEW), (True, True, (size >= FEW) & (size < 2 * FEW)), (False, True, size < FEW)):
        at = np.flatnonzero(kind)
        alike = [lines[i] for i in at.tolist()]
        for run in runs(alike, HASHED):
            h, own = shingle_hashes(alike[run])
            if many:
                keys.append(_banded(_one_permutation(h, own), 1).ravel())
                places.append(np.repeat(at[run], BANDS))
            if few:
                starts, turned = np.r_[0, np.cumsum(own)[:-1]], np.empty_like(h)
                least = np.stack([np.minimum.reduceat(np.multiply(h, odd, out=turned), starts) for odd in _ODD], axis=1)
                keys.append(_banded(least, 2).ravel())
                places.append(np.repeat(at[run], BANDS))
    return np.concatenate(keys), np.concatenate(places)


def _one_permutation(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least hash of each of ``_BINS`` bins in every turn, one row per line."""
    first, steps, out = np.repeat(np.arange(len(own), dtype=np.uint64) * _U(_BINS), own), np.arange(_BINS, dtype=np.int32), []
    turned, at = np.empty_like(h), np.empty_like(h)
    for odd in _ODD[:TURNS]:
        np.multiply(h, odd, out=turned)
        np.right_shift(turned, _U(40), out=at)
        at *= _U(_BINS)
        at >>= _U(24)
        at += first
        least = np.full(len(own) * _BINS, _NONE)
        np.minimum.at(least, at.view(np.int64), turned)
        least = least.reshape(-1, _BINS)
        # An empty bin takes the value of the next full one, marked by how far it lies.
        gaps = np.flatnonzero((least == _NONE).any(axis=1))
        twice = np.concatenate([least[gaps], least[gaps]], axis=1)
        full = np.where(twice != _NONE, np.arange(2 * _BINS, dtype=np.int32), np.int32(4 * _BINS))
        after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
        least[gaps] = np.take_along_axis(twice, after, 1) + (after - steps).astype(np.uint64) * _MIX[0]
        out.append(least)
    return np.concatenate(out, axis=1)


def _banded(values: np.ndarray, kind: int) -> np.ndarray:
    out = np.full((len(values), BANDS), _U(kind))
    for r in range(ROWS):
        out *= _U(31)
        out += values[:, r * BANDS : (r + 1) * BANDS]
        _mix(out)
    out += np.arange(BANDS, dtype=np.uint64) * _MIX[1]
    return _mix(out)


def shingles(line: str) -> frozenset[str]:
    return frozenset([line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)])


def _keys(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), np.int64).reshape(-1, 2)


def _lines_of(texts: list[str], min_chars: int) -> Iterator[tuple[int, int, str]]:
    """Place of the text, number of the line and normalised line, of every line that takes part."""
    least = max(1, min_chars)
    for k, t in enumerate(texts):
        for i, x in enumerate(t.lower().split("\n")):
            if len(y := _spaced(x)) >= least:
                yield k, i, y


def _taking_part(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts_of(docs, id_col, text_col).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))


class Seen:
    """The keys a task has met lately; bounded, so a key may pass again after very many others."""

    def __init__(self, size: int = 500_000):
        self.size, self.new, self.old = size, set(), set()

    def first(self, key: int) -> bool:
        if key in self.new or key in self.old:
            return False
        if len(self.new) >= self.size:
            self.old, self.new = self.new, set()
        self.new.add(key)
        return True


def scan_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, parts: int) -> DataFrame:
    """part, block: what one scan finds, packed into blocks.

    Blocks of a part below ``parts`` hold the band keys of that part, cut, and
    the lines' h1; the others hold doc_id, line number, h1 and h2 of lines, dealt
    evenly.
    """

    def block(rows: np.ndarray, part: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = (np.r_[0, np.cumsum(n)] * (rows.nbytes // len(rows))).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), blocks], ["part", "block"])

    def signed(lines: list[str], h1: list[int]) -> pa.RecordBatch:
        keys, at = band_keys(lines)
        part = (keys % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        n = np.bincount(part, minlength=parts)
        keys, rows = keys[order] // _U(parts), np.empty(len(keys), CUT)
        rows["low"], rows["high"] = keys & _U(0xFFFFFFFF), keys >> _U(32) & _U(0xFF)
        rows["h1"] = np.array(h1, np.int64)[at[order]]
        return block(rows, np.flatnonzero(n), n[n > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, lines, h1, chars, turn = Seen(), [], [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = list(_lines_of(part.column(1).to_pylist(), min_chars))
                if not found:
                    continue
                h = _keys([y for _, _, y in found])
                doc = part.column(0).to_numpy()[[d for d, _, _ in found]]
                turn = (turn + 1 + int(h[0, 0])) % parts
                yield block(np.column_stack([doc, [i for _, i, _ in found], h]), np.array([parts + turn]), np.array([len(found)]))
                for (_, _, y), x in zip(found, h[:, 0].tolist(), strict=True):
                    if len(y) >= SHINGLE and seen.first(x):
                        lines.append(y)
                        h1.append(x)
                        chars += len(y)
                if chars >= SIGNED:
                    yield signed(lines, h1)
                    lines, h1, chars = [], [], 0
        if lines:
            yield signed(lines, h1)

    return _taking_part(docs, id_col, text_col).mapInArrow(run, "part int, block binary")


def found_lines(blocks: DataFrame, parts: int) -> DataFrame:
    """lead, h1: the lines of band buckets with two members or more, by the buckets' least member;
    and, with a null lead, doc_id, line_no, h1 and h2 of every line."""
    names = ["lead", "h1", "h2", "doc_id", "line_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part, x in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                if part < parts:
                    held.append(np.frombuffer(x.as_buffer(), CUT))
                else:
                    doc, line, h1, h2 = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4).T
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.array(h1), pa.array(h2), pa.array(doc), pa.array(line.astype(np.int32))], names)
        if held:
            rows = np.empty((sum(map(len, held)), 2), np.int64)
            end = len(rows)
            while held:
                x = held.pop()
                own = rows[end - len(x) : end]
                own[:, 0], own[:, 1] = x["high"], x["h1"]
                own[:, 0] <<= 32
                own[:, 0] |= x["low"]
                end -= len(x)
            lead, h = _shared(rows)
            none = pa.nulls(len(h), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(h), none, none, none.cast(pa.int32())], names)

    return blocks.repartition(parts, "part").mapInArrow(run, "lead long, h1 long, h2 long, doc_id long, line_no int")


def _shared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lead and member of every bucket, from (band key, member), that has two members or more."""
    order = np.argsort(rows[:, 0])
    key = rows[order, 0]
    again = np.r_[False, key[1:] == key[:-1]]
    again[:-1] |= again[1:]
    key, h = key[again], rows[order[again], 1]
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    once = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])][: len(key)]
    key, h = key[once], h[once]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.diff(np.r_[first, len(key)])
    lead, more = np.repeat(h[first], n), np.repeat(n > 1, n)
    return lead[more], h[more]


def bloom(lines: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n rows over (h1, owner): 16 bits a row, at most 2^BLOOM_BITS, which is all that reaches the driver."""
    bits = min(BLOOM_BITS, max(16, (16 * n).bit_length()))
    low = F.lit((1 << bits) - 1)
    mixed = F.col("h1").bitwiseXOR(F.col("owner")).bitwiseXOR(F.shiftleft("owner", 32))
    spots = lines.select(mixed.alias("x")).select(F.explode(F.array(F.col("x").bitwiseAND(low), F.shiftrightunsigned("x", 32).bitwiseAND(low))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.view(np.uint64)


def in_bloom(filter_: np.ndarray, h1: np.ndarray, owner: np.ndarray) -> np.ndarray:
    o = owner.view(np.uint64)
    h, low = h1.view(np.uint64) ^ o ^ (o << _U(32)), _U(len(filter_) * 64 - 1)
    a, b = h & low, (h >> _U(32)) & low
    hit = lambda x: (filter_[(x >> _U(6)).astype(np.int64)] >> (x & _U(63))) & _U(1)
    return (hit(a) & hit(b)).astype(bool)


def fetch_lines(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, line: the normalised text of every line that passes the filter in its document."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = list({(d, y) for d, _, y in _lines_of(part.column(1).to_pylist(), min_chars)})
                if found:
                    h = _keys([y for _, y in found])
                    owner = part.column(0).to_numpy()[[d for d, _ in found]]
                    at = np.flatnonzero(in_bloom(shipped.value, np.ascontiguousarray(h[:, 0]), owner))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at, 0]), pa.array(h[at, 1]), pa.array([found[i][1] for i in at], pa.string())], ["h1", "h2", "line"])

    return _taking_part(docs, id_col, text_col).mapInArrow(run, "h1 long, h2 long, line string")


class Linker:
    """Union-find over some lines, linked where their exact Jaccard is high enough.

    ``asks``: only pairs with an asking line are compared (all lines, if not given);
    ``labels``: lines with equal labels are connected already.
    """

    def __init__(self, lines: list[str], similarity: float, asks: list[bool] | None = None, labels: list[int] | None = None):
        self.lines, self.similarity = lines, similarity
        self.asks = np.ones(len(lines), bool) if asks is None else np.array(asks, bool)
        self.parent = list(range(len(lines)))
        if labels is not None:
            first: dict[int, int] = {}
            self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]
        self.sorted: dict[int, np.ndarray] = {}
        self.hashes: list[np.ndarray] = []
        # Packed shingles equal no others, so one line without wide characters makes a count exact.
        self.packed = np.array([x.isascii() or ord(max(x)) < NARROW for x in lines])
        for run in runs(lines, HASHED):
            h, own = shingle_hashes(lines[run])
            self.hashes += np.split(h, np.cumsum(own)[:-1])

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def distinct(self, i: int) -> np.ndarray:
        """The line's shingles, sorted."""
        h = self.sorted.get(i)
        if h is None:
            h = np.sort(self.hashes[i])
            once = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=once[1:])
            h = self.sorted[i] = h[once]
        return h

    def exact(self, i: int, j: int, found: float) -> bool:
        """The verdict on two lines with wide characters, whose shingles' hashes might collide."""
        if abs(found - self.similarity) > 0.02:  # more than any collisions could move it
            return found > self.similarity
        a, b = shingles(self.lines[i]), shingles(self.lines[j])
        both = len(a & b)
        return both >= self.similarity * (len(a) + len(b) - both) - 1e-9

    def alike(self, i: int, j: int) -> bool:
        a, b = self.distinct(i), self.distinct(j)
        if min(len(a), len(b)) < (self.similarity - 0.02) * max(len(a), len(b)):
            return False
        merged = np.concatenate((a, b))
        merged.sort()
        both = np.count_nonzero(merged[1:] == merged[:-1])
        found = both / (len(merged) - both)
        return found >= self.similarity - 1e-12 if self.packed[i] or self.packed[j] else self.exact(i, j, found)

    def link(self, members: list[int]) -> None:
        """Connects all similar lines of a group."""
        if len(members) >= LARGE:
            return self._link_large(np.array(members))
        for k, j in enumerate(members):
            for i in members[:k]:
                if (self.asks[i] or self.asks[j]) and self.root(i) != self.root(j) and self.alike(i, j):
                    self.join(i, j)

    def _link_large(self, members: np.ndarray) -> None:
        """One line at a time is compared with all others at once, until all that is left outside the largest part has been."""
        chosen = [self.hashes[i] for i in members.tolist()]
        known, ids = np.unique(np.concatenate(chosen), return_inverse=True)
        # Each line's shingles once, as small numbers.
        pairs = np.unique(np.repeat(np.arange(len(members)), list(map(len, chosen))) * len(known) + ids)
        size = np.bincount(pairs // len(known), minlength=len(members))
        ids, starts = pairs % len(known), np.r_[0, np.cumsum(size)]
        part = np.array([self.root(i) for i in members.tolist()])
        marked, done = np.zeros(len(known), bool), np.zeros(len(members), bool)
        while True:
            names, n = np.unique(part, return_counts=True)
            left = np.flatnonzero(~done & (part != names[np.argmax(n)])) if len(names) > 1 else ()
            if not len(left):
                return
            k = int(left[0])
            done[k] = True
            own = ids[starts[k] : starts[k + 1]]
            marked[own] = True
            both = np.add.reduceat(marked[ids], starts[:-1], dtype=np.int64)
            marked[own] = False
            found = both / (size + size[k] - both)
            i = int(members[k])
            for x in np.flatnonzero((part != part[k]) & (self.asks[members] | self.asks[i]) & (found > self.similarity - 0.02)).tolist():
                j = int(members[x])
                if part[x] != part[k] and (found[x] >= self.similarity - 1e-12 if self.packed[i] or self.packed[j] else self.exact(i, j, found[x])):
                    self.join(i, j)
                    part[(part == part[x]) | (part == part[k])] = self.root(i)


def _link_call(t: pa.Table, similarity: float) -> pa.Table:
    """u, v (line ids) of one call: columns id, line, lead and, after a first round, asks and label."""
    place: dict[int, int] = {}
    held: dict[int, set[int]] = {}
    lines, labels, asks = [], [], []
    for i, x, lead, a, label in zip(*[t.column(c).to_pylist() for c in ("id", "line", "lead", "asks", "label")], strict=True):
        if i not in place:
            place[i] = len(lines)
            lines.append(x)
            labels.append(label)
            asks.append(a)
        asks[place[i]] |= a
        held.setdefault(lead, set()).add(place[i])
    linker, names = Linker(lines, similarity, asks, labels), list(place)
    before = [linker.root(i) for i in range(len(lines))]
    for members in held.values():
        linker.link(sorted(members))
    pairs = [(names[i], names[linker.root(i)]) for i in range(len(lines)) if linker.root(i) != before[i]]
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def line_links(groups: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """u, v (line ids): links that connect all similar lines of every group (``texts``: id, h1, line).

    Small groups share calls of about ``CALL_ROWS`` lines.  A larger one is cut
    into pieces, each verified together with the group's leaders.  Lines that
    this leaves outside the group's largest component are then compared with
    all pieces: no pair of unconnected lines is left out, and a group whose
    copies resemble its leaders costs no more than its size.
    """
    sizes = groups.groupBy("lead").count().filter(F.col("count") > group_rows)
    big = stash(sizes.select("lead", F.ceil(F.col("count") / group_rows).cast("int").alias("pieces")), "lines-large")
    calls = max(1, groups.count() // CALL_ROWS)

    def linked(rows: DataFrame) -> DataFrame:
        return rows.groupBy("call", "piece", "other").applyInArrow(lambda t: _link_call(t, similarity), "u long, v long")

    def first(rows: DataFrame) -> DataFrame:
        return linked(rows.join(texts, "h1").withColumns({"other": F.lit(-1), "asks": F.lit(True), "label": F.col("id")}))

    def small(rows: DataFrame) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("lead"), F.lit(calls)).alias("call"), F.lit(-1).alias("piece"), "lead", "h1")

    if big.isEmpty():
        return first(small(groups))
    cut = groups.join(big, "lead").withColumn("piece", F.pmod(F.xxhash64("h1"), F.col("pieces")).cast("int"))
    leads = F.pmod(F.xxhash64("h1", F.lit("leader")), F.greatest(F.lit(1), F.floor(F.col("pieces") * group_rows / LEADERS))) == 0
    leaders = cut.filter(leads).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    pieces = cut.unionByName(leaders).distinct().select(F.col("lead").alias("call"), "piece", "lead", "h1")
    links = stash(first(small(groups.join(big, "lead", "left_anti")).unionByName(pieces)), "lines-links-first")
    # What a group's pieces and leaders did not connect is compared with the whole group.
    known = cut.join(texts.select("h1", "id").distinct(), "h1").join(connected_components(links), F.col("id") == F.col("node"), "left")
    known = stash(known.select("lead", "id", "pieces", "piece", F.coalesce("component", "id").alias("label")), "lines-labels")
    most = known.groupBy("lead", "label").count().groupBy("lead")
    main = stash(most.agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("rows"), F.max("count").alias("most")).filter("rows > most"), "lines-main")
    if main.isEmpty():
        return links
    known = known.join(main, "lead").withColumn("outside", F.ceil((F.col("rows") - F.col("most")) / group_rows).cast("int"))
    asking = known.filter("label <> main").withColumn("other", F.pmod(F.xxhash64("id"), F.col("outside")).cast("int"))
    asking = asking.withColumns({"piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)), "asks": F.lit(True)})
    asked = known.withColumns({"other": F.explode(F.sequence(F.lit(0), F.col("outside") - 1)), "asks": F.lit(False)})
    both = asking.unionByName(asked).select(F.col("lead").alias("call"), "piece", "other", "lead", "id", "asks", "label")
    return links.unionByName(linked(both.join(texts.select("id", "line"), "id")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, drop: the numbers (from 0) of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LINE_BYTES * 16 * BANDS // TASK_BYTES)
    found = stash(found_lines(scan_lines(docs, id_col, text_col, min_chars, parts), parts), "lines-found")
    release(spark)
    lines = found.filter("lead is null").select("doc_id", "line_no", "h1", "h2")
    groups = stash(found.filter("lead is not null").select("lead", "h1").distinct(), "lines-groups")
    near = groups.select("h1").distinct().withColumn("near", F.lit(True))
    distinct = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    known = distinct.join(near, "h1", "left").filter("n > 1 or near").select("h1", "h2", "owner", "n", F.coalesce("near", F.lit(False)).alias("near"))
    # Numbers that stay, as the table is written.
    known = stash(known.withColumn("id", F.monotonically_increasing_id()), "lines-known")
    wanted = known.filter("near")
    fetched = fetch_lines(docs, bloom(wanted, wanted.count()), id_col, text_col, min_chars)
    texts = stash(fetched.join(wanted.select("h1", "h2", "id"), ["h1", "h2"]).select("id", "h1", "line"), "lines-texts")
    links = stash(line_links(groups, texts, similarity, group_rows), "lines-links")
    drop_stash(groups)
    drop_stash(texts)
    release(spark)
    member = stash(connected_components(links).join(known, F.col("node") == F.col("id")).select("h1", "h2", "component", "owner"), "lines-members")
    # Written first: a join of plain tables is split where one component holds very many lines.
    keepers = stash(member.groupBy("component").agg(F.min("owner").alias("keeper")), "lines-keepers")
    near = member.join(keepers, "component").select("h1", "h2", "component", "keeper")
    same = known.filter("n > 1").join(member, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("id").alias("component"), F.col("owner").alias("keeper"))
    judged = stash(lines.join(stash(near.unionByName(same), "lines-judged"), ["h1", "h2"]).select("doc_id", "line_no", "component", "keeper"), "lines-judged-places")
    release(spark)
    # In the keeper the component's first line stays.
    kept = judged.filter("doc_id = keeper").groupBy("component", "doc_id").agg(F.min("line_no").alias("line_no"))
    gone = judged.select("doc_id", "line_no").join(kept.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    drop = stash(gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop")), "lines-drop")
    # The join with the documents comes after the space of all steps before is free.
    for table_ in (found, known, member, keepers, judged):
        drop_stash(table_)
    release(spark)
    return drop


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text, and the column n_lines_dropped."""
    drop = dropped_lines(docs, id_col, text_col, similarity, min_chars, group_rows).withColumnsRenamed({"doc_id": "_line_doc", "drop": "_line_drop"})
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_line_drop", i)), "\n")
    # The same plan at every size: the drops grow with the corpus, so they are never broadcast.
    out = docs.join(drop.hint("merge"), F.col(id_col).cast("long") == F.col("_line_doc"), "left")
    cut = F.when(F.col("_line_drop").isNotNull(), kept).otherwise(F.col(text_col))
    return out.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(F.size("_line_drop"), F.lit(0)).alias("n_lines_dropped"))


def query_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blocks of band keys are large: in small batches an executor has been seen to need far more memory.
    docs = table(spark, sf_dir, "documents", batch=64 << 20).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines_left"), F.col("n_lines_dropped").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).drop("n_lines_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
