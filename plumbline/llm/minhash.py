"""Near-duplicates by weighted MinHash over TF-IDF shingles.

Shingles are runs of five words (a shorter text is one shingle), words split at white
space and ASCII-folded.  A shingle weighs its count in the text times an inverse document
frequency of 1 to 1 + IDF_SPAN.  Frequencies are those of hashed features: shingles are
counted in 2^18 buckets over all documents, so the table has a fixed size at any scale.
The span is small because copies raise the frequency of what they share: a wide one would
pull a group of thousands of near copies below the threshold.

1. Improved consistent weighted sampling draws 64 (shingle, level) samples per text; two
   texts agree on one with the probability of their weighted Jaccard similarity.  Samples
   form 16 bands of 4.
2. Texts that share a band are compared by all 64 samples in blocks; agreement of CANDIDATE
   or more (over four standard deviations below the threshold) links them to a candidate
   cluster.  Of the pairs in a block only a spanning forest leaves the task.
3. Inside a cluster, blocks of texts are compared exactly: the weighted Jaccard similarity
   of all pairs is one matrix product; again only a spanning forest of the pairs with
   ``threshold`` or more leaves the task.  Links transitively form the classes.

Scale: equal texts are one from step 2 on.  A bucket or cluster of any size is split into
blocks of bounded size, and each pair of blocks is a task of its own.  So a hot group costs
CPU with the square of its *different* texts, as finding all links must, but neither
memory nor rows.  Nothing is dropped or capped.

Null and empty texts have no shingles: they form one class of equal texts.  Repeated rows
are equal texts.  Rows that repeat an id with different texts are different documents.  Rows
without an id are equal to rows of the same text and are compared with no others.  Of ties the
smallest id stays.  Empty tables give no rows.  Other columns are ignored, columns named like
helper columns included.  A very long text is a slice and a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, join_checked, mix, shingles, slices, text_or_empty, word_hashes, word_spans
from plumbline.llm.components import components

THRESHOLD = 0.8
WIDTH = 5
SAMPLES, ROWS = 64, 4
CANDIDATE = 0.56
BUCKETS = 1 << 18
IDF_SPAN = 0.4
SIGNATURE_BLOCK = 2048
TEXT_BLOCK, TEXT_BLOCK_BYTES = 512, 2 << 20

_RANDOM = np.random.default_rng(20)
_CELLS = 1 << 14
_R = _RANDOM.gamma(2.0, 1.0, _CELLS).astype(np.float32)
_LOG_C = np.log(_RANDOM.gamma(2.0, 1.0, _CELLS)).astype(np.float32)
_BETA = _RANDOM.random(_CELLS).astype(np.float32)
_ODD = _RANDOM.integers(1, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the different shingles of each row, by row and hash."""
    starts, ends, rows = word_spans(data, offsets)
    hashes, rows = shingles(word_hashes(data, starts, ends), rows, WIDTH)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], rows[new], np.diff(np.r_[new, len(hashes)])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Per hashed feature the number of documents that have it, and that of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            total += len(batch)
            for _, data, offsets in slices(batch.column(0)):
                hashes, rows, _ = _counted(data, offsets)
                counts[:BUCKETS] += np.bincount(np.unique(rows * BUCKETS + _bucket(hashes)) % BUCKETS, minlength=BUCKETS)
        counts[BUCKETS] = total
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS + 1, np.int64)
    got = sums.toArrow()  # at most BUCKETS + 1 rows
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return counts[:BUCKETS], int(counts[BUCKETS])


def idf_table(counts: np.ndarray, total: int) -> np.ndarray:
    """The weight of a feature: 1 where all documents have it, 1 + IDF_SPAN where one has."""
    top = np.log(total + 2.0)
    return (1 + IDF_SPAN * np.clip(np.log((total + 2.0) / (counts + 1.0)) / top, 0, 1)).astype(np.float32)


def samples(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Consistent weighted samples: an array of count x SAMPLES 32-bit identities."""
    out = np.zeros((count, SAMPLES), np.uint32)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    length = np.diff(np.r_[first, len(rows)])
    have = rows[first]
    log_w = np.log(weights).astype(np.float32)
    spread = np.repeat(np.arange(len(first)), length)
    for k in range(SAMPLES):
        with np.errstate(over="ignore"):
            cell = ((hashes * _ODD[k]) >> np.uint64(50)).astype(np.int64)
        r, beta = _R[cell], _BETA[cell]
        level = np.floor(log_w / r + beta)
        score = _LOG_C[cell] - r * (level - beta + 1)
        least = np.minimum.reduceat(score, first)
        hit = np.flatnonzero(score == least[spread])
        hit = hit[np.r_[True, spread[hit[1:]] != spread[hit[:-1]]]]
        with np.errstate(over="ignore"):
            identity = mix(hashes[hit] + level[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[have, k] = (identity >> np.uint64(32)).astype(np.uint32)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    with np.errstate(over="ignore"):
        total = np.zeros((len(signature), SAMPLES // ROWS), np.uint64)
        for k in range(ROWS):
            total = mix(total + signature[:, k::ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        return mix(total + np.arange(SAMPLES // ROWS, dtype=np.uint64))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, digest, n, n_bytes, signature, bands) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for _, data, offsets in slices(batch.column(1)):
                hashes, rows, times = _counted(data, offsets)
                count = len(offsets) - 1
                parts.append(samples(hashes, rows, times * idf[_bucket(hashes)], count))
                sizes.append(np.bincount(rows, minlength=count))
            signature, n = np.vstack(parts), np.concatenate(sizes)
            keys = pa.array(bands(signature).view(np.int64).reshape(-1))
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SAMPLES // ROWS))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SAMPLES * 4), len(n), [None, pa.py_buffer(signature.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), batch.column(3), raw.cast(pa.binary()), pa.ListArray.from_arrays(ends, keys)],
                names=["doc_id", "digest", "n", "n_bytes", "signature", "bands"],
            )

    rows = docs.select("doc_id", "text", F.sha2(text_or_empty().cast("binary"), 256).alias("digest"), F.octet_length(text_or_empty()).alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id bigint, digest string, n bigint, n_bytes int, signature binary, bands array<bigint>")


# ---------------------------------------------------------------- blocks of a sorted stream

def _complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups; groups are runs of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], 1)
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            if any(last[k] != key[0, k] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _runs(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    at = np.r_[0, np.flatnonzero(change) + 1, len(columns[0])]
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def spanning(a: np.ndarray, b: np.ndarray, count: int) -> list[int]:
    """Indices of pairs that connect something new."""
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
            if len(out) == count - 1:
                break
    return out


def _pair_rows(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Deal the rows of a group to all pairs of its blocks; lo and hi are the pair, own the row's block."""
    own = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.col(blocks))
    rows = rows.withColumn("own", own.cast("int"))
    others = F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)
    return rows.withColumn("other", F.explode(others)).withColumn("lo", F.least("own", "other")).withColumn(
        "hi", F.greatest("own", "other")
    ).drop("other", blocks)


def _in_blocks(rows: DataFrame, keys: list[str], columns: list[str], work: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Run ``work`` on tables of whole (key) groups; it gives arrays of linked ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _complete_groups(batches, len(keys)):
            for a, b in work(whole):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _agreeing(whole: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate links: texts of a bucket whose signatures agree enough."""
    key, lo, hi, own, doc = (whole.column(k).to_numpy() for k in range(5))
    signature = np.frombuffer(b"".join(whole.column(5).to_pylist()), np.uint32).reshape(-1, SAMPLES)
    need = int(np.ceil(CANDIDATE * SAMPLES))
    small_a, small_b, out_a, out_b = [], [], [], []
    for start, end in _runs([key, lo, hi]):
        size = end - start
        if size < 2:
            continue
        if size <= 16:
            x, y = np.triu_indices(size, 1)
            small_a.append(x + start)
            small_b.append(y + start)
            continue
        sig = signature[start:end]
        left = np.flatnonzero(own[start:end] == lo[start]) if lo[start] != hi[start] else np.arange(size)
        right = np.flatnonzero(own[start:end] == hi[start]) if lo[start] != hi[start] else left
        found_a, found_b = [], []
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            agree = np.zeros((len(some), len(right)), np.uint8)
            for k in range(SAMPLES):
                agree += sig[some, k][:, None] == sig[right, k][None, :]
            x, y = np.nonzero(agree >= need)
            use = some[x] != right[y]
            found_a.append(some[x[use]])
            found_b.append(right[y[use]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        used = spanning(a, b, size)
        out_a.append(doc[start + a[used]])
        out_b.append(doc[start + b[used]])
    if small_a:
        a, b = np.concatenate(small_a), np.concatenate(small_b)
        for at in range(0, len(a), 1 << 15):
            x, y = a[at:at + (1 << 15)], b[at:at + (1 << 15)]
            good = (signature[x] == signature[y]).sum(1) >= need
            out_a.append(doc[x[good]])
            out_b.append(doc[y[good]])
    if out_a:
        yield np.concatenate(out_a), np.concatenate(out_b)


def similar_pairs(column: pa.Array, idf: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (one of left, one of right) with weighted Jaccard >= threshold.

    A shingle that a text has n times counts as n features of its weight, so that shared
    weight is a sum over shared features: a matrix product of 0/1 rows.
    """
    feature, row = [], []
    for first, data, offsets in slices(column):
        hashes, rows, times = _counted(data, offsets)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            wide = np.where(nth == 0, np.repeat(hashes, times), mix(np.repeat(hashes, times) + nth.astype(np.uint64) * np.uint64(BUCKETS)))
        # the bucket, and so the weight, stays that of the shingle
        wide = (wide & ~np.uint64(BUCKETS - 1)) | np.repeat(hashes & np.uint64(BUCKETS - 1), times)
        feature.append(wide)
        row.append(np.repeat(rows, times) + first)
    feature, row = np.concatenate(feature), np.concatenate(row)
    weight = idf[_bucket(feature)].astype(np.float64)
    total = np.bincount(row, weight, len(column))
    value, inverse, times = np.unique(feature, return_inverse=True, return_counts=True)
    shared = times > 1
    column_of = np.cumsum(shared) - 1
    use = shared[inverse]
    place, row = column_of[inverse[use]], row[use]
    root = np.sqrt(idf[_bucket(value[shared])].astype(np.float32))
    common = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(column), -1), np.full(len(column), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    chunk = 2048
    edges = np.searchsorted(place, np.arange(0, int(shared.sum()) + chunk, chunk))
    for k in range(len(edges) - 1):
        p, r = place[edges[k]:edges[k + 1]] - k * chunk, row[edges[k]:edges[k + 1]]
        x, y = np.zeros((len(left), chunk), np.float32), np.zeros((len(right), chunk), np.float32)
        w = root[k * chunk:k * chunk + chunk]
        in_left, in_right = at_left[r] >= 0, at_right[r] >= 0
        x[at_left[r[in_left]], p[in_left]] = w[p[in_left]]
        y[at_right[r[in_right]], p[in_right]] = w[p[in_right]]
        common += x @ y.T
    union = total[left][:, None] + total[right][None, :] - common
    similarity = common / np.maximum(union, 1e-9)
    a, b = np.nonzero(similarity >= threshold - 1e-6)
    use = left[a] != right[b]
    return left[a[use]], right[b[use]], similarity[a[use], b[use]]


def _verifying(idf: np.ndarray, threshold: float) -> Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]:
    def work(whole: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, lo, hi, own, doc = (whole.column(k).to_numpy() for k in range(5))
        texts = whole.column(5).combine_chunks()
        for start, end in _runs([group, lo, hi]):
            if end - start < 2:
                continue
            own_here = own[start:end]
            left = np.flatnonzero(own_here == lo[start])
            right = np.flatnonzero(own_here == hi[start])
            a, b, _ = similar_pairs(texts.slice(start, end - start), idf, left, right, threshold)
            used = spanning(a, b, end - start)
            yield doc[start + a[used]], doc[start + b[used]]

    return work


def _named(rows: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, class, class_id, keeps) of each row.

    Texts are named by a number per digest, so rows that repeat an id keep their own texts.
    ``class`` tells classes apart, ``class_id`` is the smallest doc_id of the class, ``keeps``
    the digest of that row's text.
    """
    idf = idf_table(*document_frequencies(rows))
    signed = scratch.keep(signatures(rows, idf))
    # one row for equal texts; what has no words or no id is compared by digest alone
    by_id = signed.groupBy("digest", "doc_id").agg(F.max("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("times"))
    copies = scratch.keep(by_id.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.min_by("times", "doc_id").alias("times")
    ).withColumn("node", F.monotonically_increasing_id()))
    reps = copies.filter("n > 0 and rep is not null").select("rep", "digest", "node")
    own = signed.select("doc_id", "digest", "signature", "bands", "n_bytes")
    unique = own.join(reps, [own["digest"] == reps["digest"], own["doc_id"] == reps["rep"]]).select(
        F.col("node").alias("doc_id"), "signature", "bands", "n_bytes")
    unique = scratch.keep(unique.dropDuplicates(["doc_id"]))
    keyed = scratch.keep(unique.select("doc_id", F.explode("bands").alias("band")))
    full = scratch.keep(keyed.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").withColumn(
        "blocks", F.ceil(F.col("m") / SIGNATURE_BLOCK)
    ).select("band", "blocks"))
    members = keyed.join(full, "band").join(unique.select("doc_id", "signature"), "doc_id")
    candidates = _in_blocks(_pair_rows(members, "band", "blocks"), ["band", "lo", "hi"], ["own", "doc_id", "signature"], _agreeing)
    clusters = components(candidates, scratch)
    sizes = clusters.join(unique.select(F.col("doc_id").alias("id"), "n_bytes"), "id").groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / TEXT_BLOCK), F.ceil(F.sum("n_bytes") / TEXT_BLOCK_BYTES)).alias("blocks")
    )
    where = copies.select(F.col("node").alias("id"), F.col("rep").alias("__rep"), F.col("digest").alias("__digest"), "times")
    dealt = scratch.keep(clusters.join(sizes, "component").join(where, "id"))
    side = dealt.withColumnRenamed("id", "node").withColumn("__id", F.col("__rep"))
    texts = join_checked(rows.withColumnRenamed("doc_id", "__id"), side, "__id", "inner", dealt.count())
    texts = texts.filter(F.sha2(text_or_empty().cast("binary"), 256) == F.col("__digest")).select(
        F.col("node").alias("doc_id"), "text", "component", "blocks", "times")
    # rows that are alike in id and text are one
    texts = texts.filter("times = 1").unionByName(texts.filter("times > 1").dropDuplicates(["doc_id"])).drop("times")
    links = _in_blocks(
        _pair_rows(texts, "component", "blocks"), ["component", "lo", "hi"], ["own", "doc_id", "text"], _verifying(idf, threshold)
    )
    linked = components(links, scratch).withColumnRenamed("id", "node")
    placed = copies.join(linked, "node", "left").withColumn("class", F.coalesce("component", "node"))
    first = placed.groupBy("class").agg(F.min(F.struct("rep", "digest")).alias("first"))
    named = placed.select("digest", "class").join(first, "class").select(
        "digest", "class", F.col("first.rep").alias("class_id"), F.col("first.digest").alias("keeps"))
    return scratch.keep(signed.select("doc_id", "digest").join(named, "digest"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the smallest doc_id of the class."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    named = _named(rows, threshold, scratch)
    counts = named.groupBy("class").agg(F.count("*").alias("class_size"))
    return named.join(counts, "class").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document of the smallest id of each class, with its columns.

    Rows that repeat an id are told apart by their texts; rows alike in both are one.  Of rows
    without an id one of each text stays.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = _named(rows, threshold, scratch)
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("keeps")))
    same = F.struct("doc_id", "digest").alias("__same")
    dropped = scratch.keep(found.filter(~kept).select(same).distinct())
    again = scratch.keep(found.filter(kept).groupBy("doc_id", "digest").count().filter("count > 1").select(same))
    own = F.struct(F.col(key).cast("bigint").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest"))
    left = join_checked(docs.withColumn("__same", own), dropped, "__same", "left_anti", dropped.count())
    return thin(left, again, "__same").drop("__same").select(docs.columns)


def thin(rows: DataFrame, again: DataFrame, on: str) -> DataFrame:
    """One row for each value of ``on`` that ``again`` lists; the others as they are."""
    repeats = again.count()
    if not repeats:
        return rows
    once = join_checked(rows, again, on, "left_anti", repeats)
    return once.unionByName(join_checked(rows, again, on, "left_semi", repeats).dropDuplicates([on]))
