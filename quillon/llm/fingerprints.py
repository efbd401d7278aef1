"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch is the ``K`` least of its shingles' hashes, cut to ``BITS`` bits.  The sketch of
a union is made of the sketches alone (``merge``), so sketches of parts, documents and whole
sources combine in any order.  From two sketches come estimates of resemblance, containment and
the number of distinct shingles; for texts of fewer than ``K`` shingles they are exact.

``edited_pairs`` pairs each text with the next one in id order without a global window: ids
alone are split into ranges; each text goes to its range, and the first text of a range also to
the range before it, so every neighbour meets its predecessor and each text is shuffled once.
What the driver sees is ``MAX_RANGES`` ids at most.

Defined results: a null text is an empty one; empty texts have the empty sketch, and two empty
sketches resemble each other with 1, an empty and another with 0; rows with equal ids follow each
other in text order; null ids come first; the next document of the last row is the first row,
of a single row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks
from quillon.llm.common import IdRanges, lean
from quillon.llm.shingles import shingle_hashes

K = 256
BITS = 48
#: Ranges of ids at most, and rows a range is meant to have.
MAX_RANGES = 4096
RANGE_ROWS = 1000

_SPACE = float(1 << BITS)


def sketch(text: bytes | None, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes(text), k)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of ascending distinct 64-bit hashes."""
    # equal cut values are as rare as collisions of BITS bits; they count once
    return np.unique(hashes[:k] >> np.uint64(64 - BITS))


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union: the share of the union's sketch that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / (float(a[-1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """A sketch as text: base64 of its values, ``BITS`` bits each, big-endian."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BITS // 8 :] = raw
    return out.view(">u8").reshape(-1).astype(np.uint64)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the next text's beginning."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (``_id``, ``text``) with ``_range`` and ``_halo``: each row in its range of ids, the
    first of each range once more, as halo, at the end of the range before."""
    ids = rows.select("_id")
    ranges = IdRanges(ids, "_id", RANGE_ROWS, MAX_RANGES)
    if ranges.empty:
        return rows.withColumn("_range", F.lit(0)).withColumn("_halo", F.lit(False))
    place = ranges.place(F.col("_id"))
    firsts = ids.withColumn("_range", place).groupBy("_range").agg(F.min("_id").alias("first")).orderBy("_range").collect()  # a row a range
    used = [r[0] for r in firsts]
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
    first = {r[0]: r[1] for r in firsts}
    every = range(len(ranges.cuts) + 1)
    first_of = F.split(F.lit(",".join(str(first.get(r, "")) for r in every)), ",")
    before_of = F.split(F.lit(",".join(str(before.get(r, "")) for r in every)), ",")
    own = F.struct(F.col("_place").alias("r"), F.lit(False).alias("h"))
    halo = F.struct(F.get(before_of, F.col("_place")).cast("int").alias("r"), F.lit(True).alias("h"))
    is_first = F.get(first_of, F.col("_place")) == F.col("_id").cast("string")
    return (
        rows.withColumn("_place", place)
        .withColumn("_to", F.explode(F.when(is_first, F.array(own, halo)).otherwise(F.array(own))))
        .select("_id", "doc_id", "text", F.col("_to.r").alias("_range"), F.col("_to.h").alias("_halo"))
    )


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are."""
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = _ranged(rows).repartition("_range").sortWithinPartitions("_range", "_halo", "_id", "text")

    def run(batches):
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the last row: range, doc_id, text, its sketch
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for rng, halo, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("_range", "_halo", "doc_id", "text")), strict=True):
                    if held and held[0] != rng:
                        held = None  # was a halo, the last of its range
                    if held and held[4]:
                        continue  # one halo row is enough
                    own = sketch(text.encode(), k)
                    if held:
                        _, i, before, its, _ = held
                        new = edited(before, text)
                        raw = new.encode()
                        changed = its if new == before else sketch(raw, k)
                        out.append((i, len(before), hashlib.sha256(raw).hexdigest(), to_text(its), to_text(changed), resemblance(its, changed, k), resemblance(its, own, k)))
                    held = (rng, doc_id, text, own, halo)
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return placed.select("_range", "_halo", "doc_id", "text").mapInArrow(lean("shingles", run), _SCHEMA)


def merged(sketches: DataFrame, key: str, k: int = K, sketch_col: str = "fingerprint") -> DataFrame:
    """``(key, fingerprint, n_distinct)``: the sketch of each key's union.

    Tasks merge what they read first, so a hot key sends one sketch a task, not one a row.
    """
    kind = sketches.schema[key].dataType.simpleString()

    def local(batches):
        held: dict = {}
        for batch in batches:
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = from_text(s or "")
                held[x] = merge(held[x], new, k) if x in held else new
        yield pa.RecordBatch.from_pydict({key: pa.array(list(held), batch.schema.field(0).type), "fingerprint": pa.array([to_text(v) for v in held.values()], pa.string())}) if held else pa.RecordBatch.from_pydict({key: [], "fingerprint": []})

    def final(batches):
        for out in local(batches):
            counts = [distinct(from_text(s), k) for s in out.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(counts, pa.float64())], names=[key, "fingerprint", "n_distinct"])

    partial = sketches.select(key, F.col(sketch_col).alias("fingerprint")).mapInArrow(lean("shingles", local), f"{key} {kind}, fingerprint string")
    return partial.repartition(key).mapInArrow(lean("shingles", final), f"{key} {kind}, fingerprint string, n_distinct double")
