"""Near duplicates by MinHash with tensored banding, every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import give_back, materialise, sized_join
from tablecheck.llm.components import components
from tablecheck.llm.token_files import batches
from tablecheck.llm.words import mix, word_hashes

#: Two collections of so many bands; every pair of a band of the first and one of the second is the key of a table.
BANDS = 12
#: MinHashes in a band.
ROWS = 2
#: Text whose shingles are made together, in bytes.
BATCH_BYTES = 1_000_000
#: How many times more leaders a table bucket has in each further round.
MORE = 16
#: After the first round, all pairs of a bucket meet at once where the buckets have no more than so many pairs in all, counted.
PAIRS = 20_000_000
SIGNATURE = "doc_id bigint, row_key bigint, n_shingles bigint, node bigint, check bigint, first array<bigint>, second array<bigint>"


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all texts one after the other, how many each has). A text with fewer words has its
    whole sequence as the only shingle; a text without words has none."""
    hashes, counts = word_hashes(texts)
    offset = np.cumsum(counts) - counts
    rolling = np.zeros(len(hashes), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    power = np.uint64(1)
    for j in range(words):
        rolling[: len(hashes) - j] += hashes[j:] * power
        power = np.uint64(int(power) * int(factor) % 2**64)
    rolling = mix(rolling)
    sets = []
    for o, c in zip(offset, counts, strict=True):
        if c >= words:
            sets.append(np.unique(rolling[o : o + c - words + 1]))
        elif c:
            whole = hashes[o : o + c]
            sets.append(mix((whole * factor ** np.arange(1, c + 1, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            sets.append(hashes[:0])
    return np.concatenate(sets) if sets else hashes[:0], np.array([len(s) for s in sets], np.int64)


def fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed numbers; sets of no shingle have 0."""
    some = counts > 0
    first = (np.cumsum(counts) - counts)[some]
    out = []
    for seed in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)):
        h = np.zeros(len(counts), np.uint64)
        if some.any():
            h[some] = mix(np.add.reduceat(mix(values ^ seed), first) + counts[some].astype(np.uint64))
        out.append(h.view(np.int64))
    return out[0], out[1]


def band_keys(values: np.ndarray, counts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """64-bit keys (texts × 2 * bands) of both collections; sets of no shingle have 0."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**62, 2 * bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, 2 * bands * rows, dtype=np.uint64)
    some = counts > 0
    keys = np.zeros((len(counts), 2 * bands), np.uint64)
    if some.any():
        first = (np.cumsum(counts) - counts)[some]
        for band in range(2 * bands):
            key = np.full(int(some.sum()), band + 1, np.uint64)
            for k in range(band * rows, band * rows + rows):
                key = mix(key ^ np.minimum.reduceat((values ^ masks[k]) * factors[k], first))
            keys[some, band] = key
    return keys


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel().view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int, key: Column) -> DataFrame:
    """Per row: ``key``, size of its shingle set, two hashes of the set, band keys of both collections."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", BATCH_BYTES):
            values, counts = shingle_sets(batch.column("text").to_pylist(), words)
            node, check = fingerprints(values, counts)
            keys = band_keys(values, counts, bands, rows, seed)
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), pa.array(counts), pa.array(node), pa.array(check), _lists(keys[:, :bands]), _lists(keys[:, bands:])], names=["doc_id", "row_key", "n_shingles", "node", "check", "first", "second"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), key.cast("long").alias("row_key"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node``, ``shingles`` of the wanted (node, rep) sets, from the texts of their representatives."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", BATCH_BYTES):
            values, counts = shingle_sets(batch.column("text").to_pylist(), words)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.record_batch([pa.array(fingerprints(values, counts)[0]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["node", "shingles"])
        give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = sized_join(texts.withColumn("none", F.col("rep").isNull()).fillna({"rep": 0}), wanted.select(F.coalesce("rep", F.lit(0)).alias("rep"), F.col("rep").isNull().alias("none")).distinct(), ["rep", "none"], "left_semi")
    found = texts.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")
    return found.dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi")


def _able(members: DataFrame, reach: Column, percent: int) -> DataFrame:
    """Members that could share enough, ``reach`` at most, with the smallest member of their bucket."""
    least = members.groupBy("key").agg(F.min("size").alias("least"))
    return members.join(least, "key").filter(100 * reach >= percent * (F.col("size") + F.col("least") - reach)).drop("least")


def _shared(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Written pairs (a, b) of sets, with how many shingles both have and the sum of their sizes."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = sized_join(left, pairs, ["a"]).join(right, "b")
    return materialise(both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("sizes")), "compared")


def _outside(with_hub: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Members of buckets of another kind: the key is a shingle that a member has and the hub it was compared with has not.
    Only members that meet there share anything outside the hub. What a member shares with the hub and the shingles that lead
    it to another class bound what it shares with any of them; those who cannot reach the limit are dropped."""
    both = sized_join(shingles, with_hub, ["node"]).join(shingles.select(F.col("node").alias("lead"), F.col("shingles").alias("sb")), "lead")
    keys = both.select("node", "lead", "size", "hub", "label", F.explode(F.array_except("shingles", "sb")).alias("s"))
    keys = materialise(keys.select(F.xxhash64("lead", "s").alias("key"), "node", "lead", "size", "hub", "label"), "outside")
    keys = materialise(keys.join(_several(keys), "key", "left_semi"), "outside")
    reach = keys.groupBy("node", "lead").agg((F.first("hub") + F.count("*")).alias("common"), F.first("size").alias("whole"))
    reach = reach.filter(100 * F.col("common") >= percent * F.col("whole")).drop("whole")
    return keys.join(reach, ["node", "lead"]).select("key", "node", "size", "common", "label", F.lit(None).cast("int").alias("hub"))


def _several(members: DataFrame) -> DataFrame:
    """Buckets whose members are of more than one class so far."""
    return members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, seed: int = 11, row_key: Column | None = None) -> DataFrame:
    """Classes of documents linked by similar shingle sets.

    Words are lower-cased A-Z and split at ASCII white space; a document's set holds its distinct shingles of
    ``words`` words (or the whole of fewer words). Two are linked when 100 * intersection >= ``percent`` * union.

    Two collections of ``bands`` bands of ``rows`` MinHashes give bands² tables from 2 * bands * rows MinHashes: the key
    of table (i, j) is the pair of band i of the first and band j of the second collection. A pair of similarity s
    misses all tables with a chance of about 2 * (1 - s**rows)**bands, 1e-4 at 0.75 with the defaults. Bands that
    occur once are dropped before keys are formed. Shingles that only one candidate has cannot be shared, which bounds
    its similarity to any other: members that cannot reach the limit with the smallest of their bucket are dropped, pairs
    whose bounds forbid a link are never formed. In each bucket, leaders (the member with the smallest such part first: the
    original of a family of copies) are compared with the others; then links are merged into classes. Members of
    different classes that no leader has met are taken up in further rounds, all with all where there are at most ``PAIRS``
    pairs and else with ``MORE`` times the leaders: in one bucket of each first leader (the hub) if what they share with it
    is enough for a link, and in buckets of the shingles that they have and the hub has not, if these and the hub
    together are enough. The rounds end when no bucket holds two classes: so every pair of a
    bucket is compared, ruled out by a bound, or already in one class.

    Result: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the class), ``kept`` (the id is the
    component's). One row per input row. Null, empty and blank texts have no shingle, and are linked with nothing. Equal
    sets are one node however many rows have them. Rows that repeat an id are judged each by its own text. A
    null id never names a class: such rows have their class's smallest id if there is one, and are kept otherwise. Empty
    tables give an empty result; other columns are ignored.

    With ``row_key``, a number that is a function of the row, the result also has it as ``row_key``, and ``kept`` marks the
    row of each class with the smallest id (null last), then key: one row of each class if id and key tell rows apart.
    """
    rows_ = materialise(signatures(docs, id_col, text_col, words, bands, rows, seed, F.lit(None) if row_key is None else row_key), "signatures")
    with_set = rows_.filter("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    sets = with_set.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(row).alias("stays"), F.first("n_shingles").alias("size"), F.first("first").alias("first"), F.first("second").alias("second"))
    sets = materialise(sets, "shingle-sets")

    each = sets.select("node", "size", F.posexplode(F.concat("first", "second")).alias("place", "band"))
    repeated = materialise(each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "repeated-bands")
    each = sized_join(each, repeated, ["band"], "left_semi")
    side = lambda first: F.collect_list(F.when((F.col("place") < bands) == F.lit(first), F.col("band")))
    both = each.groupBy("node", "size").agg(side(True).alias("a"), side(False).alias("b")).filter("size(a) > 0 and size(b) > 0")
    keyed = materialise(both.select("node", "size", F.explode("a").alias("a"), "b").select("node", "size", "a", F.explode("b").alias("b")).select("node", "size", F.xxhash64("a", "b").alias("key")), "table-keys")
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "buckets")
    members = materialise(sized_join(keyed, shared, ["key"], "left_semi"), "bucket-members")

    wanted = materialise(members.select("node").distinct().join(sets.select("node", "rep"), "node"), "wanted")
    shingles = materialise(_sets_of(docs, wanted, id_col, text_col, words), "sets")
    single = shingles.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    shared_part = F.col("size") - F.coalesce("single", F.lit(0))
    members = members.join(single.groupBy("node").agg(F.count("*").alias("single")), "node", "left").select("key", "node", "size", shared_part.alias("common"), F.col("node").alias("label"), F.lit(None).cast("int").alias("hub"))
    members = materialise(_able(members, F.col("common"), percent), "bucket-members")
    members = materialise(members.join(_several(members), "key", "left_semi"), "bucket-members")

    tested, roots, leaders_per_bucket, every = None, None, 1, False
    while members.take(1):
        group = F.col("node") if every else F.pmod(F.xxhash64("node", F.lit(leaders_per_bucket)), F.lit(leaders_per_bucket))
        order = F.struct((1 - F.col("common") / F.col("size")).alias("own"), F.xxhash64("node").alias("h"), "node", "size", "common", "label", "hub")
        leaders = members.groupBy("key", group.alias("g")).agg(F.min(order).alias("lead")).select("key", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "size", "common", "label", "hub")])
        # two that share nothing outside the bucket's hub share at most what either shares with it; others meet elsewhere
        most = F.when(F.col("hub").isNull() | F.col("lead_hub").isNull(), F.least("common", "lead_common")).otherwise(F.least("hub", "lead_hub"))
        met = members.join(leaders, "key").filter((F.col("label") != F.col("lead_label")) & (100 * most >= percent * (F.col("size") + F.col("lead_size") - most)))
        pairs = met.select(F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        compared = _shared(materialise(pairs, "pairs"), shingles)
        tested = compared if tested is None else tested.unionByName(compared)
        links = compared.filter(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")
        found = bool(links.take(1))
        if found:
            # the classes so far are links of their members with their roots
            roots = components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if every:
            break
        left_over = members.join(leaders.select("key", F.col("lead_node").alias("node")), ["key", "node"], "left_anti")
        if found:
            left_over = left_over.join(roots.select(F.col("node").alias("label"), F.col("root").alias("now")), "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
        if leaders_per_bucket == 1:
            left_over = materialise(left_over.join(leaders.select("key", F.col("lead_node").alias("lead")), "key").drop("common", "hub"), "left-over")
            # buckets of one hub are one bucket: each member of open ones once, with all that it shares with the hub, linked or not
            met = left_over.join(_several(left_over), "key", "left_semi").select("node", "lead", "size", "label", F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
            met = materialise(met.distinct(), "open-members")
            rest = materialise(met.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.unionByName(_shared(rest, shingles))
            met = materialise(met.join(tested, ["a", "b"]).select("node", "lead", "size", "label", F.col("shared").alias("hub")), "hub-members")
            inside = met.filter(100 * F.col("hub") >= percent * F.col("size")).select(F.xxhash64("lead").alias("key"), "node", "size", F.col("hub").alias("common"), "label", "hub")
            left_over = inside.unionByName(_outside(met, shingles, percent))
        left_over = materialise(left_over.select(members.columns), "left-over")
        members = materialise(left_over.join(_several(left_over), "key", "left_semi"), "bucket-members")
        every = (members.groupBy("key").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0) <= PAIRS
        leaders_per_bucket *= MORE

    smallest = sets.select("node", "rep", "stays")
    if roots is not None:
        labelled = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("stays").alias("stays"))
        smallest = labelled.drop("rep", "stays").join(least, "root").select("node", "component_id", "stays")
    else:
        smallest = smallest.withColumnRenamed("rep", "component_id")
    out = with_set.select("doc_id", "row_key", "n_shingles", "node").join(smallest, "node").select("doc_id", "row_key", "n_shingles", "component_id", row.eqNullSafe(F.col("stays")).alias("stays"))
    blank = rows_.filter("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    out = out.unionByName(blank)
    if row_key is not None:
        return out.withColumnRenamed("stays", "kept")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
