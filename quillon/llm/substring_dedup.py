"""Suffix-array dedup: removes every byte that a repeated string of ``LENGTH`` bytes covers.

Texts are UTF-8 bytes, in order of id.  A string of ``LENGTH`` bytes is repeated if it also
starts earlier: in a text before, or in the same text before; all bytes of such strings go.

*Shards.*  Equal strings have equal parts, so each string is sent where its least ``GRAM``-byte
part (by hash, leftmost on a tie) is sent.  The strings of a text with the same least part are
neighbours; together they are a segment, a few dozen bytes longer than ``LENGTH``.  So segments
partition all strings of all texts, and equal strings always meet in the group of their part.

*Equal segments.*  Within a task, then within a group, equal segments are merged first: all but
the earliest are repeats as a whole.  A hot passage therefore sends one row a task, however many
copies there are.  Equal means equal hashes of part and segment, 128 bits together.

*Suffix arrays.*  Where a group has different segments, strings may still be equal in part: the
texts of such segments are cut, concatenated into shards of whole groups, and each shard's suffix
array (induced sorting) and permuted common prefixes tell which strings are equal; of each set
of equal strings all but the earliest are repeats.  Strings whose hash no other string of the
same groups has can't be equal to any, so they are left out of the arrays first.  A group with very many different segments
would be too large for a shard, so its strings are grouped more finely: by the bytes that
neighbouring strings share, and beyond that by the whole string.

Defined results: a null text is an empty one; texts shorter than ``LENGTH`` stay; rows without
an id come first; rows with equal id are ordered by a hash of the text, and rows equal in both
are one document (they don't repeat each other); overlapping runs count as one; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks
from quillon.llm.common import release, shared_dir, stored
from quillon.llm.shingles import mix
from quillon.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Different segments that a group may have before its strings are grouped by shared bytes, and
#: before they are grouped one by one.
COARSE, FINE = 4096, 32768
#: Neighbouring strings that are grouped by the bytes they share.
RUN = 9
#: Low bits that hold a part's place where parts are compared, so texts may have 4 GB.
PLACE_BITS = 32
#: Bytes that a shard is filled up to with whole groups.
SHARD_BYTES = 1 << 20
#: Bytes hashed at a time.
HASH_BYTES = 4 << 20

_P = 0xD6E8FEB86659FD93
_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64
_R = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of a number modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, _U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = _U(pow(self.base, len(self.have), 1 << 64))
            self.have = np.concatenate([self.have, self.have * step])
        return self.have[:n]


_powers, _inverses = _Powers(_P), _Powers(_INVERSE)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows."""
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_R[raw] * _powers.upto(len(raw)), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``begin`` to ``end``."""
    inverse = _inverses.upto(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(part hash, segment hash, first, last, anchor)`` arrays of a text's segments: they hold the
    strings that start from ``first`` to ``last``; ``anchor`` is where their least part starts."""
    n = len(raw)
    if n < length:
        return None
    sums = prefix_sums(raw)
    spots = np.arange(n - gram + 1)
    hashes = stretch_hash(sums, spots, spots + gram)
    # the same number of hash bits decides in texts of any length, and parts that tie in them go by place,
    # so equal strings always choose the same part
    bits = _U(PLACE_BITS)
    packed = ((hashes >> bits) << bits) | spots.astype(_U)
    anchors = (_sliding_min(packed, length - gram + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(anchors) - 1]])
    own = anchors[first]
    return hashes[own], stretch_hash(sums, first, last + length), first, last, own


def merged_runs(begin: np.ndarray, end: np.ndarray):
    """Sorted, disjoint runs that cover the same bytes."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], np.maximum.reduceat(end, np.flatnonzero(new))


class _Rows:
    """Columns collected piece by piece."""

    def __init__(self, **kinds):
        self.kinds = kinds
        self.parts = {k: [] for k in kinds}

    def add(self, n: int, **columns) -> None:
        for k, v in columns.items():
            self.parts[k].append(v if isinstance(v, np.ndarray) else np.full(n, v))

    def joined(self, name: str) -> np.ndarray:
        return np.concatenate(self.parts[name]) if self.parts[name] else np.empty(0, np.int64)


_EVENTS = "kind int, part long, segment long, id long, th int, first int, last int, lead int"


def _batch_events(rows: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """Segments of the batch's texts: the earliest of equal ones (kind 0), and runs (kind 1) of
    bytes that the others cover."""
    part, seg, ids, ths, first, last, lead = [], [], [], [], [], [], []
    for i, th, raw in sorted(rows, key=lambda r: r[:2]):
        found = segments(np.frombuffer(raw, np.uint8), length)
        if found is None:
            continue
        h, s, f, e, a = found
        part.append(h)
        seg.append(s)
        first.append(f)
        last.append(e)
        lead.append(a - f)
        ids.append(np.full(len(h), i))
        ths.append(np.full(len(h), th))
    if not part:
        return None
    part, seg, ids, ths, first, last, lead = (np.concatenate(x) for x in (part, seg, ids, ths, first, last, lead))
    key = mix(part) ^ seg
    order = np.argsort(key, kind="stable")  # earliest first among equals
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    # rows of one document are one text
    home = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    twin = (ids[order] == ids[home]) & (ths[order] == ths[home]) & (first[order] == first[home])
    keep, gone = order[new], order[~new & ~twin]
    keep.sort()
    out = [[np.zeros(len(keep), np.int64)], [part[keep].view(np.int64)], [seg[keep].view(np.int64)], [ids[keep]], [ths[keep]], [first[keep]], [last[keep]], [lead[keep]]]
    if len(gone):
        gone.sort()
        cut = np.flatnonzero((ids[gone][1:] != ids[gone][:-1]) | (ths[gone][1:] != ths[gone][:-1])) + 1
        for one in np.split(gone, cut):
            b, e = merged_runs(first[one], last[one] + length)
            n = len(b)
            spread = mix(b.astype(_U) * _U(_P) + _U(int(ids[one[0]]) & (2**64 - 1))).view(np.int64)
            for column, value in zip(out, (np.ones(n), spread, spread, np.full(n, ids[one[0]]), np.full(n, ths[one[0]]), b, e, np.zeros(n)), strict=True):
                column.append(value.astype(np.int64, copy=False))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in _EVENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(out, kinds, strict=True)], names=names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` (null: the least), ``th``, a hash that tells rows of equal id apart, and ``text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"),
        (F.xxhash64(text) % (1 << 31)).cast("int").alias("th"),
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
    )


def _events(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", HASH_BYTES):
                rows = list(zip(part.column("id").to_pylist(), part.column("th").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True))
                if (out := _batch_events(rows, length)) is not None:
                    yield out

    return texts.select("id", "th", "text").mapInArrow(run, _EVENTS)


def _judged(events: DataFrame, length: int) -> DataFrame:
    """Repeats that hashes show, as runs (kind 1), and the different segments of groups that have
    several (kind 0, with ``n``, how many)."""
    # one shuffle, by group, serves both windows; runs go along, spread by an arbitrary part
    rows = events.repartition("part")
    same = Window.partitionBy("part", "kind", "segment").orderBy("id", "th", "first")
    group = Window.partitionBy("part", "kind")
    home = F.struct("id", "th", "first")
    ranked = (
        rows.withColumn("nth", F.row_number().over(same))
        .withColumn("home", F.first(home).over(same))
        .withColumn("n", F.sum(F.when(F.col("nth") == 1, 1)).over(group))
    )
    is_run = F.col("kind") == 1
    repeat = ~is_run & (F.col("nth") > 1)
    twin = repeat & (home == F.col("home"))  # a row given twice
    return ranked.where(is_run | ((repeat | (F.col("n") > 1)) & ~twin)).select(
        (is_run | repeat).cast("int").alias("kind"), "part", F.col("n").cast("long").alias("n"), "id", "th", "first", F.when(repeat, F.col("last") + length).otherwise(F.col("last")).alias("last"), "lead"
    )


_PIECES = "kind int, key long, id long, th int, first int, last int, raw binary"


def _pieces(judged: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments that suffix arrays must compare (kind 0), under their group's key.

    Segments of oversized groups are cut into finer groups; equal pieces of a batch are merged,
    the later ones given as runs (kind 1).
    """
    wanted = judged.where("kind = 0").groupBy("id", "th").agg(F.collect_list(F.struct("part", "n", "first", "last", "lead")).alias("cuts"))
    held = texts.select("id", "th", "text").join(wanted, ["id", "th"])

    def finer(raw: bytes, part: int, n: int, first: int, last: int, lead: int):
        """``(key, first, last)`` of the pieces of a segment."""
        if n <= COARSE:
            yield part, first, last
            return
        width = RUN if n <= FINE else 1
        anchor = first + lead
        start = first
        while start <= last:
            slot = (anchor - start) // width
            # strings of one slot start from anchor - (slot + 1) * width + 1 to anchor - slot * width
            end = min(last, anchor - slot * width)
            lo, hi = anchor - (slot + 1) * width + 1, anchor - slot * width
            shared = raw[hi : lo + length]
            digest = hashlib.blake2b(shared, digest_size=8, key=(part & (2**64 - 1)).to_bytes(8, "little") + slot.to_bytes(2, "little")).digest()
            yield int.from_bytes(digest, "little", signed=True), start, end
            start = end + 1

    def run(batches):
        for batch in batches:
            for some in chunks(batch, "text", HASH_BYTES):
                out, seen = [], {}
                rows = zip(some.column("id").to_pylist(), some.column("th").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(), some.column("cuts").to_pylist(), strict=True)
                for i, th, raw, cuts in sorted(rows, key=lambda r: r[:2]):
                    for c in sorted(cuts, key=lambda c: c["first"]):  # the earliest of equal pieces stays
                        for key, first, last in finer(raw, **c):
                            piece = raw[first : last + length]
                            if c["n"] > COARSE:
                                if seen.setdefault((key, piece), (i, th, first)) != (i, th, first):
                                    out.append((1, 0, i, th, first, last + length, b""))
                                    continue
                            out.append((0, key, i, th, first, last, piece))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    names = [x.split()[0] for x in _PIECES.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return held.mapInArrow(run, _PIECES)


def sieved(pieces: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, bytes]]:
    """What is left of pieces ``(id, th, first, bytes)`` without the strings whose hash is theirs alone.

    Equal strings have equal hashes, so each string that has an equal one stays, and what stays is
    compared by its bytes; neighbouring strings stay in one piece.
    """
    text = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - length + 1)  # strings a piece
    owner = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    if len(at) < 2:
        return []
    hashes = stretch_hash(prefix_sums(text), at, at + length)
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(at), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    at, owner = at[shared], owner[shared]
    if not len(at):
        return []
    new = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(at) - 1]])
    own = owner[first]
    begin = at[first] - starts[own]
    end = at[last] - starts[own] + length
    return [(*pieces[n][:2], pieces[n][2] + b, pieces[n][3][b:e]) for n, b, e in zip(own.tolist(), begin.tolist(), end.tolist(), strict=True)]


def repeats_of(pieces: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces ``(id, th, first, bytes)`` in order: which pieces' bytes, from where to where, are
    repeats of earlier ones, by the suffix array of all pieces."""
    raw = b"\x00".join(p[3] for p in pieces)
    text = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    array = suffix_array(text)
    lcp = common_prefixes(text, array, length)[array]
    piece = np.searchsorted(starts, array, side="right") - 1
    fits = array - starts[piece] + length <= sizes[piece]
    # sets of equal strings are neighbours in the array; what doesn't fit is never equal to what does
    new = np.concatenate([[True], lcp[1:] < length]) | ~fits | np.concatenate([[True], ~fits[:-1]])
    begins = np.flatnonzero(new)
    least = np.minimum.reduceat(array, begins)
    home = least[np.cumsum(new) - 1]
    at = np.sort(array[fits & (array > home)])
    if not len(at):
        return at, at, at
    owner = np.searchsorted(starts, at, side="right") - 1
    edge = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    stop = np.concatenate([np.flatnonzero(edge)[1:] - 1, [len(at) - 1]])
    owner, begin = owner[edge], at[edge]
    return owner, begin - starts[owner], at[stop] - starts[owner] + length


def _array_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of repeats found by the shards' suffix arrays."""
    placed = pieces.where("kind = 0").repartition("key").sortWithinPartitions("key", "id", "th", "first")

    def shard(held):
        held.sort(key=lambda p: p[:3])
        owner, begin, end = repeats_of(held, length)
        if len(owner):
            ids = np.array([p[0] for p in held])[owner]
            ths = np.array([p[1] for p in held])[owner]
            base = np.array([p[2] for p in held])[owner]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths).cast(pa.int32()), pa.array(base + begin).cast(pa.int32()), pa.array(base + end).cast(pa.int32())], names=["id", "th", "first", "last"])

    def run(batches):
        held, size, last = [], 0, None
        left, left_size = [], 0  # of whole groups
        for batch in batches:
            for key, i, th, first, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "th", "first", "raw")), strict=True):
                if key != last and size >= SHARD_BYTES:
                    some = sieved(held, length)
                    left += some
                    left_size += sum(len(p[3]) + 1 for p in some)
                    held, size = [], 0
                    if left_size >= SHARD_BYTES:
                        yield from shard(left)
                        left, left_size = [], 0
                last = key
                held.append((i, th, first, raw))
                size += len(raw) + 1
        if held:
            left += sieved(held, length)
        if left:
            yield from shard(left)

    return placed.select("key", "id", "th", "first", "raw").mapInArrow(run, "id long, th int, first int, last int")


def kept_bytes(raw: bytes, begins: list[int], ends: list[int]) -> tuple[bytes, int, int]:
    """The bytes outside the runs, how many the runs cover, and how many disjoint runs there are."""
    if not begins:
        return raw, 0, 0
    b, e = merged_runs(np.array(begins), np.array(ends))
    out, at = [], 0
    for x, y in zip(b.tolist(), e.tolist(), strict=True):
        out.append(raw[at:x])
        at = y
    out.append(raw[at:])
    return b"".join(out), int((e - b).sum()), len(b)


def deduped(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` of each row of ``docs``."""
    return _resolved(docs, length, id_col, text_col, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", lambda b: b, pa.binary())


def digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`deduped`, with the digest of what is kept in place of the bytes."""
    return _resolved(docs, length, id_col, text_col, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda b: hashlib.sha256(b).hexdigest(), pa.string())


def _resolved(docs: DataFrame, length: int, id_col: str, text_col: str, schema: str, final, kind) -> DataFrame:
    root = shared_dir(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    judged = stored(_judged(_events(texts, length), length), root, "judged")
    release(docs.sparkSession)
    pieces = stored(_pieces(judged, texts, length), root, "pieces")
    release(docs.sparkSession)
    runs = (
        judged.where("kind = 1").select("id", "th", "first", "last")
        .union(pieces.where("kind = 1").select("id", "th", "first", "last"))
        .union(_array_repeats(pieces, length))
    )
    by_text = stored(runs.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs")), root, "runs")
    release(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for i, raw, runs in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("runs").to_pylist(), strict=True):
                    kept, gone, spans = kept_bytes(raw, [r["first"] for r in runs or ()], [r["last"] for r in runs or ()])
                    out.append((i, len(raw), gone, spans, final(kept)))
                kinds = [pa.int64()] * 4 + [kind]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.join(by_text, ["id", "th"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
