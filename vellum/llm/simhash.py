"""SimHash near-duplicates (operator 2).

A document's fingerprint has a bit set where more than half of its word
shingles' hashes have it.  Fingerprints link at ``radius`` or fewer differing
bits; a document's class is the smallest id it can reach over links.

* Equal fingerprints are one node, however many documents share them.
* ``2 * radius`` bit blocks: two linked fingerprints agree on at least
  ``radius`` whole blocks, so they meet under one of the choices of ``radius``
  blocks (20 for radius 3, about 32 bits each).  Keys held by one node only are
  dropped; a key with more than ``bucket`` nodes is split exactly, by
  ``radius + 1`` pieces of the remaining bits, one of which must agree; what is
  still larger is cut into blocks of about ``bucket`` nodes, and every two blocks
  are a bucket of their own, so no task holds more than about twice that.
* Within a bucket the comparison is bit-sliced: one integer per bit position
  holds that bit of all members (a plane); the XOR of a plane and its shift
  gives that bit's difference for a whole block of pairs at once, carry-save
  counters add the differences up, and a block of pairs is abandoned as soon as
  all its pairs are beyond the radius.
* A bucket gives one link from each member to the least of its group, not all
  pairs; groups that share members merge in the component step.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; fewer words than a shingle are one shingle; a null id stays a
row and links, but never names a class (a class of null ids only is null);
repeated rows stay; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import byte_values, materialize, slices
from vellum.llm.graph import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = map(xxh64_intdigest, joined, iter(lambda: SEED, None))
    for at in range(0, n, 1 << 15):
        some = np.fromiter(hashes, np.uint64, min(1 << 15, n - at))
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry`` (columns taken along), ``fp`` (the fingerprint's 64 bits as a long)."""
    given = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in byte_values(b.column(b.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=schema.names)

    return given.mapInArrow(run, schema)


def planes_of(fps: np.ndarray) -> list[int]:
    """64 integers: lane ``i`` of the ``b``-th is bit ``b`` of ``fps[i]``."""
    return [_integer((fps >> np.uint64(b)) & np.uint64(1) != 0) for b in range(64)]


def within(planes: list[int], shift: int, lanes: int, radius: int) -> int:
    """Of the lanes set in ``lanes``: those whose value differs from the one ``shift`` lanes on in at most ``radius`` bits.

    ``sums`` holds every lane's distance in binary, one integer per digit; a
    difference plane is added to all distances by rippling carries, and lanes
    whose distance passes the radius leave ``lanes``.
    """
    sums = [0] * (radius.bit_length() + 1)
    for count, plane in enumerate(planes):
        carry = (plane ^ (plane >> shift)) & lanes
        for d, digit in enumerate(sums):
            sums[d], carry = digit ^ carry, digit & carry
            if not carry:
                break
        if count >= radius:
            over, equal = 0, lanes  # distance > radius, digit by digit from the top
            for d in range(len(sums) - 1, -1, -1):
                if radius >> d & 1:
                    equal &= sums[d]
                else:
                    over |= equal & sums[d]
                    equal &= ~sums[d]
            lanes &= ~over
            if not lanes:
                return 0
            for d in range(len(sums)):
                sums[d] &= lanes
    return lanes


def _integer(lanes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(lanes, bitorder="little").tobytes(), "little")


def _lanes(mask: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(-(-mask.bit_length() // 8), "little"), np.uint8),
                                        bitorder="little"))


def grouped(fps: np.ndarray, sizes: np.ndarray, radius: int, block: int = 4096) -> np.ndarray:
    """Each lane's class within its group: a lane that it reaches.

    ``fps`` holds groups of ``sizes`` lanes one after the other.  Whole groups
    are compared in blocks of about ``block`` lanes: every lane with the next
    one of its group, then with the one after that, and so on.
    """
    root, ends = np.arange(len(fps)), np.cumsum(sizes)
    last = np.repeat(ends, sizes)  # for each lane, the end of its group

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    begin = 0
    while begin < len(fps):
        to = max(int(last[begin]), int(ends[np.searchsorted(ends, begin + block, "right") - 1]))
        planes, reach = planes_of(fps[begin:to]), last[begin:to] - np.arange(begin, to)
        for shift in range(1, int(reach.max())):
            near = _lanes(within(planes, shift, _integer(reach > shift), radius)) + begin
            apart = near[root[near] != root[near + shift]]
            for i in apart:
                a, b = find(i), find(i + shift)
                root[max(a, b)] = min(a, b)
            if len(apart):
                while (root[begin:to] != root[root[begin:to]]).any():
                    root[begin:to] = root[root[begin:to]]
        begin = to
    return root


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` whose components are those of "at most ``radius`` bits apart", over the distinct ``fp``."""
    blocks = 2 * radius
    edges = [64 * i // blocks for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask_of = lambda bits: signed(sum(1 << b for b in bits))
    choices = []
    for chosen in combinations(range(blocks), radius):
        bits = [b for k in chosen for b in range(edges[k], edges[k + 1])]
        rest = [b for b in range(64) if b not in set(bits)]
        choices.append((mask_of(bits), [mask_of(rest[i::radius + 1]) for i in range(radius + 1)]))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                               for i, (m, _) in enumerate(choices)))).alias("k")
    keyed = fps.select("fp").distinct().select("fp", keys).select("fp", "k.*")
    shared = materialize(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    pieces = F.array(*(F.element_at(F.array(*(F.lit(p[i]) for _, p in choices)), F.col("choice") + 1)
                       for i in range(radius + 1)))
    split = F.when(F.col("n") > bucket, F.transform(pieces, lambda m, i: F.struct(
        (i + 1).alias("piece"), F.col("fp").bitwiseAND(m).alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).cast("long").alias("part"))))
    group = ["choice", "key", "piece", "part"]
    parts = (keyed.join(shared, ["choice", "key"]).select("fp", "choice", "key", F.explode(split).alias("s"))
             .select("fp", "choice", "key", "s.*"))

    def gathered(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1).select("fps")

    if shared.filter(F.col("n") > bucket).isEmpty():
        members = gathered(parts, *group)
    else:  # what agrees on a piece too may still be large: any two of its blocks meet as a group of their own
        large = materialize(parts.filter("piece > 0").groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
                            .select(*group, F.ceil(F.col("n") / bucket).cast("long").alias("blocks")), "simhash-large")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        cut = (parts.join(large, group).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", other)
               .select("fp", *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
        members = gathered(parts.join(large, group, "left_anti"), *group).union(
            gathered(cut.repartition(*group, "i", "j"), *group, "i", "j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            least = grouped(flat, sizes, radius)
            moved = np.flatnonzero(least != np.arange(len(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(flat[moved].view(np.int64)),
                                              pa.array(flat[least[moved]].view(np.int64))], names=["a", "b"])

    return members.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry``, ``fingerprint, component_id, component`` (a fingerprint of it), one row per document."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, carry), "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    label = components(links(classes, radius, bucket))
    named = (classes.join(label, F.col("fp") == F.col("node"), "left")
             .select("fp", "first_id", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "label").select("fp", "component_id", F.col("label").alias("component"))
    return marked.join(of_class, "fp").select("doc_id", *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                              "component_id", "component")
