"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``bands`` short signatures (``rows`` minhashes each) are computed for a document. Table
(i, j) is keyed by signature i of the first collection together with signature j of the second, so
``bands`` squared tables of 2 * ``rows`` minhashes come from 2 * ``bands`` * ``rows`` minhashes, about the
square root of what separate tables would take. A pair of similarity s meets in some table with probability
(1 - (1 - s^rows)^bands)^2; with 14 bands of 3 that is 0.9999 at 0.8 and above 0.99998 from 0.83 on.

From candidates to classes, without ever listing the pairs of a bucket:

* documents with equal shingle sets are one class from the start and enter the tables once;
* table keys are range-partitioned together with the document, so a hot bucket spreads over tasks; each
  task links the members of a bucket to the least one it sees, and the few buckets that cross a boundary
  are linked through their edges;
* links are confirmed on the full shingle sets and joined to components;
* in buckets of three and more, members that are still in different components are then compared where
  prefixes of their shingles, rarest first, show that they may be similar enough; after that no bucket
  holds two similar documents that are not connected.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.components import connected_components
from fareloom.llm.storage import fresh, materialize, task_count
from fareloom.llm.textwords import as_text, byte_slices, mix, split_words, window_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    """Words in a shingle, the similarity in percent, and the shape of the tables."""

    words: int = 5
    percent: int = 80
    bands: int = 14
    rows: int = 3


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the texts' bounds."""
    words = split_words(texts, lower=True)
    hashes = word_hashes(words)
    windows, bounds = window_hashes(hashes, words.offsets, width)
    counts = np.diff(words.offsets)
    for row in np.flatnonzero((counts > 0) & (counts < width)):  # the whole sequence as one shingle
        at = words.offsets[row]
        whole, _ = window_hashes(hashes[at : at + counts[row]], np.array([0, counts[row]]), int(counts[row]))
        windows = np.insert(windows, bounds[row], mix(whole + np.uint64(counts[row]))[0])
        bounds[row + 1 :] += 1
    row_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((windows, row_of))
    windows, row_of = windows[order], row_of[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (row_of[1:] != row_of[:-1])
    windows, row_of = windows[new], row_of[new]
    return windows, np.searchsorted(row_of, np.arange(len(texts) + 1))


def _signatures(windows: np.ndarray, bounds: np.ndarray, settings: Settings) -> np.ndarray:
    """Array of 2 * bands signatures for each text with shingles (rows of texts without any are 0)."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((n, 2 * settings.bands), np.uint64)
    if not len(some):
        return out
    random = np.random.default_rng(20240601)
    starts = bounds[:-1][some]
    for band in range(2 * settings.bands):
        signature = np.full(len(some), band, np.uint64)
        for _ in range(settings.rows):
            flip, factor = random.integers(0, 1 << 63, 2, dtype=np.uint64)
            hashed = (windows ^ flip) * (factor | np.uint64(1))
            hashed ^= hashed >> np.uint64(32)
            hashed *= np.uint64(0xD6E8FEB86659FD93)
            signature = mix(signature * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, starts))
        out[some, band] = signature
    return out


def _sketches(rows: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, two order-free digests of the shingle set, signatures (packed longs)."""

    def run(batches):
        for batch in batches:
            texts = as_text(batch.column(1))
            for at, end in byte_slices(texts):
                windows, bounds = _shingles(texts.slice(at, end - at), settings.words)
                totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(windows ^ np.uint64(seed)), dtype=np.uint64)])[bounds] for seed in (0x51ED27, 0xA5B357)]
                digests = [pa.array(np.diff(t).view(np.int64)) for t in totals]
                signatures = _signatures(windows, bounds, settings).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(signatures) + 1, dtype=np.int32) * signatures.shape[1]), pa.array(signatures.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(np.diff(bounds)), *digests, lists], ["doc_id", "n_shingles", "digest_a", "digest_b", "signatures"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, signatures array<bigint>")


def _full_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = as_text(batch.column(1))
            for at, end in byte_slices(texts):
                windows, bounds = _shingles(texts.slice(at, end - at), settings.words)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(windows.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], ["doc_id", "shingles"])

    return rows.mapInArrow(run, "doc_id long, shingles array<bigint>")


#: Rows of the table that ``_bucket_links`` writes.
_LINK, _CROWD, _EDGE = 0, 1, 2


def _entries(sketches: DataFrame, settings: Settings) -> DataFrame:
    """A row for each document and table: key (of the table and its two signatures) and node."""
    b = settings.bands
    pairs = F.expr(f"flatten(transform(slice(signatures, 1, {b}), u -> transform(slice(signatures, {b + 1}, {b}), v -> xxhash64(u, v))))")
    return sketches.select(F.col("doc_id").alias("node"), F.explode(pairs).alias("key")).select("key", "node")


#: Rows of (key, node) that a task sorts; more, up to the second bound, where the tasks would be too many.
_TASK_ENTRIES, _MOST_TASK_ENTRIES = 1_000_000, 64_000_000


def _bucket_links(entries: DataFrame, n_entries: int) -> DataFrame:
    """kind, key, a, b: links (a the least member seen, b another), members of buckets of three and more,
    and the first member of the buckets at the edges of a partition."""
    tasks = task_count(entries.sparkSession, n_entries, _TASK_ENTRIES, _MOST_TASK_ENTRIES)
    ordered = entries.repartitionByRange(tasks, "key", "node").sortWithinPartitions("key", "node")

    def batch_of(kind, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int64)), pa.array(key), pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])

    def run(batches):
        # of the bucket that is open at the end of a batch: key, least member, members so far, and the
        # members that are not reported yet (two at most)
        open_key, pivot, size, held, first_bucket = None, 0, 0, np.zeros(0, np.int64), True
        for batch in batches:
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            pivots = node[starts]
            goes_on = open_key is not None and key[0] == open_key
            if goes_on:
                pivots[0] = pivot
                sizes = sizes.copy()
                sizes[0] += size
            elif first_bucket and open_key is not None:  # the partition's first bucket ends with the last batch
                yield batch_of(_CROWD, np.full(len(held), open_key), held, held)
                first_bucket, held = False, held[:0]
            if open_key is None:
                yield batch_of(_EDGE, key[:1], node[:1], node[:1])
            index = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            link = node != pivots[index]
            if link.any():
                yield batch_of(_LINK, key[link], pivots[index][link], node[link])
            crowded = sizes >= 3
            if first_bucket and len(starts) > 1:
                crowded[0], first_bucket = True, False
            if goes_on and crowded[0] and len(held):
                yield batch_of(_CROWD, np.full(len(held), open_key), held, held)
            kept = held if goes_on and not crowded[0] and len(starts) == 1 else held[:0]
            member = crowded[index]
            if member.any():
                yield batch_of(_CROWD, key[member], node[member], node[member])
            held = np.concatenate([kept, node[starts[-1] :]]) if not crowded[-1] else held[:0]
            open_key, pivot, size = key[-1], pivots[-1], int(sizes[-1])
        if open_key is not None:
            yield batch_of(_EDGE, np.array([open_key]), np.array([pivot]), np.array([pivot]))
            if len(held):
                yield batch_of(_CROWD, np.full(len(held), open_key), held, held)

    return ordered.mapInArrow(run, "kind long, key long, a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; an id with several rows may repeat a pair.

    Nothing that needs a document's pairs together stands on these joins: Spark may split a document with many.
    """
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common >= settings.percent * union).select("a", "b")


def _comparable(left, right, settings: Settings):
    """Set sizes that can reach the similarity at all; unknown where an id has rows of several sizes."""
    possible = 100 * F.least(left, right) >= settings.percent * F.greatest(left, right)
    return left.isNull() | right.isNull() | possible


def _mixed(crowd: DataFrame) -> DataFrame:
    """The rows (key, node, component, ...) of buckets with more than one component."""
    keys = crowd.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return crowd.join(keys, "key", "left_semi")


#: Sizes whose logarithms agree to one part in this many share a bin.
_BINS = 24


def _bin(size):
    return F.floor(F.log(size.cast("double")) * _BINS)


def _uncompared(crowd: DataFrame, components: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of members of mixed buckets, in different components, that may be similar enough.

    Comparing all members of a bucket would take the square of its size. Instead the shingles of these
    documents are ordered from the rarest to the most frequent. Two sets of sizes m and n that are similar
    enough have at least t = percent / (100 + percent) * (m + n) shingles in common, so the first common
    one is among the first m - t + 1 of the one and the first n - t + 1 of the other. Copies that are too
    far from their original begin with changes of their own, which few others share: they meet few.
    Keys hold the two sizes' bins besides the shingle, so that the prefixes are as short as the sizes allow,
    and only keys with more than one component are joined.
    """
    placed = crowd.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    nodes = materialize(_mixed(placed).select("node", "component").distinct(), "mixed-nodes")
    rows = nodes.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node").select("node", "component", F.size("shingles").alias("size"), F.xxhash64("node", "shingles").alias("record"), "shingles")
    each = rows.select("record", "node", "component", "size", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    often = often.select("shingle", F.when(F.col("low") < F.col("high"), F.col("often")).otherwise(0).alias("often"))
    ranked = each.join(often, "shingle").groupBy("record", "node", "component", "size").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ordered"))
    share = settings.percent / (100 + settings.percent)
    longest = F.floor(F.col("size") * (1 - settings.percent / 100) + 1e-9) + 1
    firsts = ranked.select("record", "node", "component", "size", F.posexplode(F.slice("ordered", 1, longest.cast("int"))).alias("pos", "item"))
    # shingles that no other component has can't be common to a pair
    firsts = materialize(firsts.where("item.often > 0").select("node", "component", F.col("size").cast("long").alias("size"), "pos", F.col("item.shingle").alias("shingle")), "prefixes")

    def reach(partner_size):
        return F.col("pos") + share * (F.col("size") + partner_size) <= F.col("size") + 1e-6

    low_of = lambda k: F.exp(k / _BINS)  # noqa: E731  the least size of a bin
    top = F.col("size") * (100 / settings.percent)
    smaller = firsts.select("*", F.explode(F.sequence(_bin(F.col("size")), _bin(top + 1e-6))).alias("other")).where(reach(F.greatest(low_of(F.col("other")), F.col("size"))))
    smaller = smaller.select("shingle", _bin(F.col("size")).alias("bin_a"), F.col("other").alias("bin_b"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("pos").alias("px"))
    larger = firsts.select("*", F.explode(F.sequence(_bin(F.col("size") * (settings.percent / 100)), _bin(F.col("size")))).alias("other")).where(reach(low_of(F.col("other"))))
    larger = larger.select("shingle", F.col("other").alias("bin_a"), _bin(F.col("size")).alias("bin_b"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("sy"), F.col("pos").alias("py"))
    keys = ["shingle", "bin_a", "bin_b"]
    sides = smaller.groupBy(keys).agg(F.min("cx").alias("low_x"), F.max("cx").alias("high_x")).join(larger.groupBy(keys).agg(F.min("cy").alias("low_y"), F.max("cy").alias("high_y")), keys)
    mixed = sides.where(F.least("low_x", "low_y") < F.greatest("high_x", "high_y")).select(keys)
    met = smaller.join(mixed, keys, "left_semi").join(larger, keys)
    least = share * (F.col("sx") + F.col("sy")) - 1e-6
    met = met.where((F.col("cx") != F.col("cy")) & (F.col("sx") <= F.col("sy")) & (F.col("px") + least <= F.col("sx")) & (F.col("py") + least <= F.col("sy")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (distinct shingles), component_id and kept for every row of ``docs``.

    Words are runs other than ASCII white space with A-Z lower-cased; a text of fewer words than a shingle
    is one shingle, an empty or null text has none and is linked with nothing. Two rows are linked when
    100 * common >= percent * union of their sets; component_id is the least id reachable, itself
    included, and kept tells the rows that carry it. Rows that share an id are one
    document, which is similar to whatever one of its rows is similar to. Rows with a null id are returned with a
    null component, kept. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = materialize(_sketches(rows, settings), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("n_shingles", "digest_a", "digest_b").agg(F.min("doc_id").alias("doc_id"), F.first("signatures").alias("signatures")), "classes")
    found = materialize(_bucket_links(_entries(classes, settings), classes.count() * settings.bands**2), "buckets")
    sizes = classes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size")).groupBy("node").agg(F.when(F.min("size") == F.max("size"), F.max("size")).alias("size"))
    sizes = materialize(sizes, "sizes")

    def sized(pairs: DataFrame) -> DataFrame:
        a, b = sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b"))
        return pairs.join(a, "a").join(b, "b").where(_comparable(F.col("size_a"), F.col("size_b"), settings)).select("a", "b")

    edge = found.where(F.col("kind") == _EDGE).select("key", "a")
    edge_links = edge.join(edge.groupBy("key").agg(F.min("a").alias("least")), "key").where("a != least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    pairs = found.where(F.col("kind") == _LINK).select("a", "b").unionByName(edge_links).distinct()
    pairs = materialize(sized(pairs), "pairs")
    involved = found.where(F.col("kind") != _LINK).select(F.col("a").alias("doc_id")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = materialize(_full_sets(rows.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), settings), "shingle-sets")
    # an id whose rows have different sets is one document: its classes are linked
    of_class = ["n_shingles", "digest_a", "digest_b"]
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    shared = filled.join(several, "doc_id", "left_semi").select("doc_id", *of_class).join(classes.select(*of_class, F.col("doc_id").alias("node")), of_class)
    same_id = materialize(shared.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).where("a < b").distinct(), "links-of-ids")
    links = materialize(_confirmed(pairs, sets, settings).unionByName(same_id), "links")
    components = materialize(connected_components(links), "components")

    crowd = found.where(F.col("kind") == _CROWD).select("key", F.col("a").alias("node"))
    rest = _uncompared(crowd, components, sets, settings)
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, sets, settings))
        components = materialize(connected_components(links), "components")

    by_class = classes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.col("digest_a").alias("da"), F.col("digest_b").alias("db"))
    placed = by_class.join(components, "node", "left").select("n", "da", "db", F.coalesce("component", "node").alias("component"))
    of_row = (filled.n_shingles == placed.n) & (filled.digest_a == placed.da) & (filled.digest_b == placed.db)
    judged = filled.join(placed, of_row).select("doc_id", "n_shingles", "component")
    empty = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    empty = empty.join(components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = judged.unionByName(empty)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their own columns.

    Rows that share an id are one document, kept or not as a whole; of those of them with equal texts one stays.
    """
    key = fresh("gone_id", docs)
    gone = near_duplicates(docs, settings, id_col, text).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
    several = materialize(docs.groupBy(F.col(id_col).cast("long").alias(key)).agg(F.count("*").alias("rows")).where(f"rows > 1 and `{key}` is not null").select(key), "repeated-ids")
    if several.isEmpty():
        return left
    same = F.col(id_col).cast("long") == F.col(key)
    return left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates([id_col, text]))
