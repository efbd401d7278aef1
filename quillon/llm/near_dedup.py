"""MinHash near-dedup with odd sketches.

1. Each text gets MinHash samples of its shingle set, band hashes of some samples each, and an
   odd sketch: the MinHash samples of ``BINS`` parts of the hash space, folded into a parity
   bitmap.  The population count of two bitmaps' XOR tells how many samples differ, most
   precisely where similarity is high.  Texts with the same shingle set become one class,
   represented by its smallest id, before anything else.
2. Hubs: in each band bucket every member is held against the bucket's least and greatest member
   by odd sketch; of what passes, a member keeps its smallest and its most alike hub, and these
   pairs are confirmed on the full shingle sets, from the texts.  That is linear in the members,
   however large a bucket is, and joins most groups together.
3. Cells: buckets that still hold several components are cut into cells of bounded size.  First
   sketches alone go to the cells, and only the members that pass with one of another component
   are told, a row each.
4. Those meet again in their cells with their full sets, where pairs of different components are
   confirmed and joined at once.  A cell returns links that span what it joined: fewer than it
   has components, however many pairs it has held against each other.

A pair is looked at in the first bucket that both share.  All pairs of a bucket are, but those of
one component and those of a bucket's largest component, so no link is lost.  ``BLOCK`` and
``BLOCK_SHINGLES`` bound a cell's memory and regroup work; results are the same at any setting.

Bands are chosen by the threshold (26 of 6 samples at 0.85, 31 of 5 at 0.8): they miss a pair at the
threshold with probability 5e-6, and more similar ones
far less; the sketch dismisses what lies 4.5 standard errors below the threshold, which a pair at the
threshold does with probability 3e-6 by the normal law.  Simulated at 0.85, none of 1.38 million
pairs was dismissed: of 200,000 to 300,000 for each of 20, 40, 60, 100 and 200 shingles in the
union, 100,000 of 400, 50,000 of 800, and fewer above (1,500 of 20,000).

Defined results: null, empty and blank texts have no set, are linked with nothing and stay; a
text of fewer words than a shingle has its whole sequence as its one shingle; rows with equal
ids are one document; rows without an id are linked with nothing and stay; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import chunks
from quillon.llm.common import lean, release, shared_dir, stored
from quillon.llm.components import components
from quillon.llm.shingles import mix, shingle_hashes

#: Documents are linked from this per cent of resemblance on, where a caller names no other.
PERCENT = 85
SAMPLES = 156
#: Bands may miss a pair at the threshold with this probability.
MISS = 6e-6
#: Parts of the hash space that give a sketch its samples, and bits of the sketch.
BINS, ODD_BITS = 2048, 2048
#: Standard errors below the threshold from which a sketch dismisses a pair.
ERRORS = 4.5
#: Members of a large bucket, and shingles of its members, on either side of a cell.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Partners of a hub that one group confirms.
HUB_PARTNERS = 256

_A = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """``SAMPLES`` MinHash samples of a set of 64-bit hashes."""
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(out, (h[i : i + 2048, None] * _A).min(axis=0), out)
    return out


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """Number of bands and samples a band: the longest bands that miss no more than ``MISS``."""
    for rows in range(SAMPLES, 0, -1):
        if (1 - (percent / 100) ** rows) ** (SAMPLES // rows) <= MISS:
            return SAMPLES // rows, rows
    raise ValueError(f"{SAMPLES} samples are too few for {percent} per cent")


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash a band; bands never share a hash but by accident."""
    x = mix(samples.astype(np.uint64) + _SALT)[: bands * rows].reshape(bands, rows)
    total = x[:, 0].copy()
    for k in range(1, rows):
        total = mix(total) + x[:, k]
    return mix(total).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The parity bitmap of a set's samples, as ``ODD_BITS / 64`` signed words, and how many samples it has.

    A sample is the least hash of a part of the hash space; ``hashes`` ascend, so it comes first.
    """
    _, first = np.unique(hashes & np.uint64(BINS - 1), return_index=True)
    at = (mix(hashes[first] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(ODD_BITS)).astype(np.int64)
    bits = (np.bincount(at, minlength=ODD_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64), len(first)


def most_differing(n_a, n_b, filled_a, filled_b, percent: int = PERCENT):
    """Population count up to which the sketches of sets of ``n_a`` and ``n_b`` shingles may be those of
    a pair at the threshold.  Numpy arrays or numbers.

    At similarity J the union has (n_a + n_b) / (1 + J) elements, a share J of them in both sets.
    Of the bins they fill, those with equal samples (E) and the samples in all (S, which is known)
    vary together: what differs, S - 2 E, is taken at the S there is, and its error is what S
    doesn't explain.  Elements are dealt to the bins as Poisson counts, then corrected for the
    numbers of elements being given.  Folding adds its own error.
    """
    j = percent / 100
    union = np.maximum(1e-9, (n_a + n_b) / (1 + j) / BINS)  # elements a bin
    a, b = n_a / BINS, n_b / BINS
    both, only_a, only_b = j * union, np.maximum(0, a - j * union), np.maximum(0, b - j * union)
    out_a, out_b, out = np.exp(-a), np.exp(-b), np.exp(-union)  # chances that a bin is empty
    # means a bin, and how they move with the elements in both sets or in one
    e, s = j * (1 - out), 2 - out_a - out_b
    e_one = j * out - e / union
    e_both = e_one + (1 - out) / union
    var_e = e * (1 - e) - both * e_both**2 - (only_a + only_b) * e_one**2
    var_s = out_a * (1 - out_a) + out_b * (1 - out_b) + 2 * (out - out_a * out_b) - both * (out_a + out_b) ** 2 - only_a * out_a**2 - only_b * out_b**2
    cov = e * (out_a + out_b) - both * e_both * (out_a + out_b) - only_a * e_one * out_a - only_b * e_one * out_b
    slope = np.where(var_s > 1e-9, cov / np.maximum(1e-9, var_s), 0)
    total = filled_a + filled_b
    differ = np.maximum(0, total - 2 * (BINS * e + slope * (total - BINS * s)))
    sampling = 2 * np.sqrt(BINS * np.maximum(0, var_e - slope * cov))
    once = np.exp(-4 * differ / ODD_BITS)
    folding = np.sqrt(np.maximum(0, ODD_BITS / 4 * (1 - once) - differ * once) / once)
    most = differ + 2 + ERRORS * np.sqrt(sampling**2 + folding**2)
    return np.floor(ODD_BITS / 2 * (1 - np.exp(-2 * most / ODD_BITS)))


_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, odd array<long>, filled int"


def signature(raw: bytes | None, bands: int, rows: int) -> tuple[int, bytes | None, list[int], list[int], int]:
    """Set size, set key, band hashes, odd sketch and its number of samples of a text."""
    h = shingle_hashes(raw)
    if not len(h):
        return 0, None, [], [], 0
    odd, filled = odd_sketch(h)
    return len(h), xxhash.xxh3_128_digest(h.tobytes()), band_hashes(min_hashes(h), bands, rows).tolist(), odd.tolist(), filled


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Set size, set key, band hashes and odd sketch of each text.  Map only."""
    shape = banding(percent)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [signature(raw, *shape) for raw in part.column("text").cast(pa.binary()).to_pylist()]
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "set_key", "bands", "odd", "filled"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean("shingles", run), _SIGNED)


def _sketched(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches pass, with ``d``, the share of samples that differ."""
    left = reps.select(F.col("rep").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "filled", "odd")])
    right = reps.select(F.col("rep").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "filled", "odd")])
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "filled_a", "filled_b", "odd_a", "odd_b")

    def run(batches):
        for batch in batches:
            ids, n, filled, odd = _columns(batch, ("a", "b")), _columns(batch, ("n_a", "n_b")), _columns(batch, ("filled_a", "filled_b")), [_words(batch.column(c)) for c in ("odd_a", "odd_b")]
            d = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64)
            ok = _sizes_fit(*n, percent) & (d <= most_differing(*n, *filled, percent))
            share = d / np.maximum(1, filled[0] + filled[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][ok]), pa.array(ids[1][ok]), pa.array(share[ok])], names=["a", "b", "d"])

    return both.mapInArrow(lean("shingles", run), "a long, b long, d double")


def _columns(batch, names) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _words(column) -> np.ndarray:
    """Sketches as rows of words."""
    return np.asarray(column.flatten(), dtype=np.int64).view(np.uint64).reshape(len(column), -1)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose texts' full shingle sets are alike enough.

    ``a``'s text meets ``HUB_PARTNERS`` partners or so at a time; a worker holds one hub's set.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_c")), "a")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("_c") / HUB_PARTNERS)))
    hubs = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = hubs.union(salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id")))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    placed = rows.join(texts, rows["id"] == texts["_id"]).select("a", "salt", "role", "id", "text")
    placed = placed.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")

    def run(batches):
        hub, hub_sets = None, []
        for batch in batches:
            for part in chunks(batch, "text"):
                links = []
                for a, salt, role, i, raw in zip(*(part.column(c).to_pylist() for c in ("a", "salt", "role", "id")), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if (a, salt) != hub:
                        hub, hub_sets = (a, salt), []
                    own = shingle_hashes(raw)
                    if role == 0:
                        hub_sets.append(own)
                        continue
                    for other in hub_sets:
                        n = len(np.intersect1d(own, other, assume_unique=True))
                        if n and 100 * n >= percent * (len(own) + len(other) - n):
                            links.append((a, i))
                            break
                if links:
                    x, y = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return placed.mapInArrow(lean("shingles", run), "a long, b long")


def _hub_pairs(buckets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Step 2's pairs: ``a`` the hub, ``b`` the member."""
    ends = buckets.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    member = buckets.join(ends, "bucket").select("rep", F.explode(F.array("lo", "hi")).alias("hub"))
    good = _sketched(member.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), reps, percent)
    ways = good.select("a", "b", "d", F.col("b").alias("member"), F.col("a").alias("hub")).union(good.select("a", "b", "d", F.col("a").alias("member"), F.col("b").alias("hub")))
    best = ways.groupBy("member").agg(F.min(F.struct("hub", "d")).alias("x"), F.min(F.struct("d", "hub")).alias("y"))
    kept = best.select("member", F.explode(F.array("x.hub", "y.hub")).alias("hub"))
    return kept.select(F.least("member", "hub").alias("a"), F.greatest("member", "hub").alias("b")).distinct()


def _mixed(buckets: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components, with their ``label``."""
    named = labels.withColumnRenamed("id", "_i")
    held = buckets.join(named, buckets["rep"] == named["_i"], "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return held.join(mixed, "bucket").join(reps.select("rep", "n"), "rep")


def _cells(mixed: DataFrame) -> DataFrame:
    """``(bucket, i, j, rep, label, other, line, any)``: the cells of each bucket.

    The bucket's largest component isn't held against itself: the members of the others meet
    the blocks of all, so the work is the others' number times the bucket's, not the bucket's squared.
    """
    sizes = mixed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label", "s")).alias("x"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    top = top.select("bucket", F.col("x.label").alias("top"), blocks(F.col("c"), F.col("s")).alias("_all"), blocks(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s")).alias("_others"))
    row = mixed.join(top, "bucket").withColumn("other", F.col("label") != F.col("top"))
    # a cell is (block of others, block of all): a row sits in its own column, an other also in its own line
    own = F.pmod(F.xxhash64("rep"), F.col("_others")).cast("int")
    place = F.pmod(F.xxhash64("rep"), F.col("_all")).cast("int")
    column = F.transform(F.sequence(F.lit(0), F.col("_others") - 1), lambda i: F.struct(i.alias("i"), place.alias("j"), (F.col("other") & (i == own)).alias("line"), F.lit(True).alias("any")))
    line = F.when(F.col("other"), F.filter(F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("line"), F.lit(False).alias("any"))), lambda x: x["j"] != place)).otherwise(F.array())
    return row.withColumn("_c", F.explode(F.concat(column, line))).select("bucket", "rep", "label", "other", "_c.i", "_c.j", "_c.line", "_c.any")


class _Cell:
    """Members of a cell, as arrays in the order of their ids."""

    def __init__(self, bucket: int, rep, label, n, filled, other, line, column, odd, bands, percent: int):
        self.bucket, self.rep, self.n, self.filled, self.odd, self.bands, self.percent = bucket, rep, n, filled, odd, bands, percent
        self.other, self.lines, self.columns = other > 0, np.flatnonzero(line), np.flatnonzero(column)
        self.labels, self.part = np.unique(label, return_inverse=True)

    def partners(self, i: int) -> np.ndarray:
        """Members to be held against ``i`` here: of another component, alike enough by size and sketch, and this
        bucket being the first that both share.  Of two that are in lines, the first finds the second."""
        j = self.columns
        j = j[(self.part[j] != self.part[i]) & (~self.other[j] | (j > i)) & _sizes_fit(self.n[i], self.n[j], self.percent)]
        if len(j):
            d = np.bitwise_count(self.odd[i] ^ self.odd[j]).sum(axis=1, dtype=np.int64)
            j = j[d <= most_differing(self.n[i], self.n[j], self.filled[i], self.filled[j], self.percent)]
        if len(j):
            j = j[self.bands[i, (self.bands[i] == self.bands[j]).argmax(axis=1)] == self.bucket]
        return j

    def suspects(self) -> np.ndarray:
        """Members with partners."""
        found = np.zeros(len(self.rep), bool)
        for i in self.lines:
            j = self.partners(i)
            if len(j):
                found[i] = True
                found[j] = True
        return np.flatnonzero(found)

    def joined(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Confirms partners on their sets, joins their components, and returns links that span what is joined."""
        _, names, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in sets])
        own = [x[times[x] > 1] for x in np.split(names, ends[:-1])]  # what no other has can't be shared
        marked = np.zeros(len(times), bool)
        links = []
        for i in self.lines:
            j = self.partners(i)
            if not len(j):
                continue
            marked[own[i]] = True
            begins = np.concatenate([[0], np.cumsum([len(own[x]) for x in j])])
            hits = np.concatenate([[0], np.cumsum(marked[np.concatenate([own[x] for x in j])])])
            both = hits[begins[1:]] - hits[begins[:-1]]
            marked[own[i]] = False
            j = j[(both > 0) & (100 * both >= self.percent * (self.n[i] + self.n[j] - both))]
            for p in np.unique(self.part[j]).tolist():
                mine = self.part[i]
                if p != mine:
                    a, b = min(p, mine), max(p, mine)
                    links.append((int(self.labels[a]), int(self.labels[b])))
                    self.part[self.part == b] = a
        return links


_MEMBER = ("bucket", "i", "j", "rep", "label", "n", "filled", "other", "line", "any")
_SKETCHES = ("odd", "bands")


def _by_cell(rows: DataFrame, found, schema: str, percent: int, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``found(cell, columns more)`` yields of each cell, in rows of ``schema``.  A cell's rows may come in several batches."""
    placed = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def told(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bucket, _, _, *rest = _columns(table, _MEMBER)
        label = rest[1]
        if len(label) > 1 and (label != label[0]).any():
            cell = _Cell(int(bucket[0]), *rest, _words(table.column("odd")), _words(table.column("bands")).view(np.int64), percent)
            yield from found(cell, *[table.column(c) for c in more])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the last cell, which may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack(_columns(batch, _MEMBER[:3]), axis=1)
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            if last is not None and last != tuple(key[0]):
                yield from told(held)
                held = []
            for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if n:
                    yield from told(held)
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(key[-1])
        if held:
            yield from told(held)

    return placed.select(*_MEMBER, *_SKETCHES, *more).mapInArrow(lean("shingles", run), schema)


def _suspects(cells: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The members of cells whose sketches pass with one of another component: no more rows than ``cells`` has."""

    def rows(cell):
        at = cell.suspects()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell.bucket)), pa.array(cell.rep[at])], names=["bucket", "rep"])

    sketched = cells.join(reps.select("rep", "n", "filled", *_SKETCHES), "rep")
    named = _by_cell(sketched, rows, "bucket long, rep long", percent).distinct().withColumnsRenamed({"bucket": "_b", "rep": "_r"})
    return cells.join(named, (F.col("bucket") == F.col("_b")) & (F.col("rep") == F.col("_r")), "left_semi")


def _sets(texts: DataFrame) -> DataFrame:
    """``(id, key, hashes)``: the full shingle set of each text, as bytes, and its key."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [shingle_hashes(raw).tobytes() for raw in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "key", "hashes"])

    return texts.mapInArrow(lean("shingles", run), "id long, key binary, hashes binary")


def _spanning(cells: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Step 4's links (``a``, ``b``) between labels."""

    def rows(cell, hashes):
        links = cell.joined([np.frombuffer(x, np.uint64) for x in hashes.to_pylist()])
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    wanted = cells.select(F.col("rep").alias("_w")).distinct()
    sets = _sets(texts.join(wanted, F.col("doc_id") == F.col("_w"), "left_semi").select(F.col("doc_id").alias("id"), "text"))
    # an id may have several texts, and several rows of one
    sets = sets.groupBy("id", "key").agg(F.first("hashes").alias("hashes"))
    held = cells.join(reps.select("rep", "set_key", "n", "filled", *_SKETCHES), "rep").join(sets, (F.col("rep") == F.col("id")) & (F.col("set_key") == F.col("key")))
    return _by_cell(held, rows, "a long, b long", percent, ("hashes",))


def _ties(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between the classes of the texts of one id."""
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select("doc_id")
    theirs = named.join(several, "doc_id", "left_semi").join(reps.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    least = theirs.groupBy("doc_id").agg(F.min("rep").alias("least"))
    return theirs.join(least, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs``; linked from ``percent`` on."""
    spark = docs.sparkSession
    root = shared_dir(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, root, name)
        release(spark)
        return out

    signed = keep(signatures(docs, id_col, text_col, percent), "signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
    reps = keep(classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("filled").alias("filled")), "classes")
    every = reps.select(F.explode("bands").alias("bucket"), "rep")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    buckets = keep(every.join(shared, "bucket"), "buckets")
    # texts that may have to be compared, once out of all
    wanted = buckets.select(F.col("rep").alias("_rep")).distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # shuffled at any size: how the ids are few or many must not change what a run needs
    texts = keep(plain.hint("merge").join(wanted, F.col("doc_id") == F.col("_rep"), "left_semi"), "texts")

    pairs = keep(_hub_pairs(buckets, reps, percent), "pairs")
    links = confirmed(pairs, texts, percent=percent).union(_ties(signed, reps))
    labels = components(links, root, "labels")
    release(spark)
    cells = keep(_cells(_mixed(buckets, reps, labels)), "cells")
    suspects = keep(_suspects(cells, reps, percent), "suspects")
    joined = components(_spanning(suspects, reps, texts, percent), root, "joined")
    release(spark)

    label_of, last_of = labels.select(F.col("id").alias("_i"), "label"), joined.select(F.col("id").alias("_j"), F.col("label").alias("last"))
    found = signed.where("doc_id IS NOT NULL").join(reps.select("set_key", "rep"), "set_key", "left").join(label_of, F.col("rep") == F.col("_i"), "left")
    found = found.withColumn("own", F.coalesce("label", "rep")).join(last_of, F.col("own") == F.col("_j"), "left")
    # an id with a text without words is the document of its other texts
    least = F.min(F.coalesce("last", "own", "doc_id")).over(Window.partitionBy("doc_id"))
    out = found.select("doc_id", "n_shingles", least.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = signed.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: rows and columns as they are."""
    gone = grouped(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__q_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__q_gone"), "left_anti")
