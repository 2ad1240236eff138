"""SimHash near-dedup with deletion-variant signatures.

Fingerprints at most ``k`` bits apart, cut into ``k // 2 + 1`` segments, have a
segment in which they differ by at most one bit (pigeonhole).  So each segment
is indexed as it is and once with each of its bits wiped out; an equality join
on those keys finds every pair, and the full distance verifies it.  A wiped-bit
key joins only fingerprints that differ in that bit, an exact key only equal
segments, so no pair is tried once for each bit of an equal segment.  Equal
fingerprints are one node, however many documents share them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.common import checkpoint, documents, shuffle_partitions, split_join
from tessera.llm.components import connected_components, forest

BITS, MINHASH_SEED = 64, 8
#: Members of a key that are paired with each other at most.
HOT = 1024
#: A block of nodes that are compared holds about so many nodes and shingles at most.
NODES, CELL = 1024, 1 << 19
#: Pairs that are counted at once, and the shares of all bands after which components are renewed.
PIECE, ROUNDS = 1 << 19, (0.15, 0.45, 1.0)


def shingle_hashes(run: list[bytes], shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of each text, with repeats (fewer words: all of them,
    none: no shingle), and where each text's begin, plus the total."""
    found = textops.to_words(run, lower=True)
    sizes = np.diff(found.first)
    number = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    first = np.zeros(len(run) + 1, np.int64)
    np.cumsum(number, out=first[1:])
    begin = np.repeat(found.first[:-1] - first[:-1], number) + np.arange(first[-1])
    last = np.minimum(begin + shingle - 1, np.repeat(found.first[1:] - 1, number))
    return textops.xxh64_spans(found.buffer, found.starts[begin], found.ends[last], seed), first


def fingerprint_batch(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: A-Z lowered, ``shingle``-word shingles with repeats
    (fewer words: all of them, none: zero), XXH64 of each, majority."""
    out = [np.zeros(0, np.uint64)]
    for _, run in textops.batches(texts):
        hashes, first = shingle_hashes(run, shingle, seed)
        out.append(textops.bit_majority(hashes, first))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs.  No shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = fingerprint_batch(textops.Texts(part.column(1)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _keys(fps: DataFrame, max_bits: int, low_side: bool) -> DataFrame:
    """Index entries of one side: (key, fp).  Variant 0 of a segment is its
    value, variant i its value with bit i-1 wiped; an entry with a wiped bit is
    on the low side where that bit was 0, on the other where it was 1."""
    segments = max_bits // 2 + 1
    width = -(-BITS // segments)
    variants = width + 1
    n = F.explode(F.sequence(F.lit(0), F.lit(segments * variants - 1)))
    step = fps.select("fp", n.alias("n")).select(
        "fp", "n", F.expr(f"shiftrightunsigned(fp, int(n div {variants}) * {width}) & {(1 << width) - 1}L").alias("segment"), F.expr(f"int(n % {variants}) - 1").alias("bit")
    )
    side = F.expr(f"bit < 0 OR (segment & shiftleft(1L, greatest(bit, 0))) {'=' if low_side else '<>'} 0")
    wiped = F.expr("IF(bit < 0, segment, segment & ~shiftleft(1L, greatest(bit, 0)))")
    key = wiped if width <= 40 else F.xxhash64(wiped)
    return step.where(side).select((F.shiftleft(F.col("n").cast("long"), 40).bitwiseXOR(key)).alias("key"), "fp")


def _spread(entries: DataFrame, max_bits: int) -> DataFrame:
    """Star links of entries (key, fp) of keys that many share.  Those that agree in
    a key and, outside its segment, in all but the bits the key has left over are at
    most ``max_bits`` apart, whichever they are, so each group is linked with its
    smallest, and every close pair is in a group."""
    segments = max_bits // 2 + 1
    width = -(-BITS // segments)
    variants = width + 1
    number = "shiftrightunsigned(key, 40)"
    rest = entries.select("key", "fp", F.expr(f"fp & ~shiftleft({(1 << width) - 1}L, int({number} div {variants}) * {width})").alias("rest"), F.expr(f"{max_bits} - int({number} % {variants} > 0)").alias("left"))
    masks = {n: [sum(1 << b for b in bits) for bits in itertools.combinations(range(BITS), n)] for n in range(max_bits + 1)}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    table = F.create_map(*[c for n, all_ in masks.items() for c in (F.lit(n), F.lit([signed(m) for m in all_]))])
    wiped = rest.select("key", "fp", F.explode(table[F.col("left")]).alias("m"), "rest")
    groups = wiped.select("key", "fp", "m", F.expr("rest & ~m").alias("rest"))
    least = groups.groupBy("key", "m", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    return split_join(groups.hint("merge"), least, ["key", "m", "rest"]).where("a <> fp").select("a", F.col("fp").alias("b"))


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``max_bits`` apart: every
    such pair is linked, or connected by links.  ``fps`` has one column, fp, without
    repeats.  The members of a key are paired; of keys with more than HOT members
    (of at most two bits) they are linked in stars, at a cost linear in them.

    The planner takes an exploded side for as small as what it is made from, and
    below its bound for broadcasts would build on the driver what that can't hold;
    so joins of such sides ask for a merge."""
    low = _keys(fps, max_bits, True)
    high = _keys(fps, max_bits, False)
    spread = None
    if max_bits <= 2:
        plain = f"shiftrightunsigned(key, 40) % {-(-BITS // (max_bits // 2 + 1)) + 1} = 0"
        entries = low.unionByName(high.where(f"NOT ({plain})"))
        hot = checkpoint(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
        if not hot.isEmpty():
            spread = _spread(split_join(entries.hint("merge"), hot, "key"), max_bits)
            low, high = (split_join(side, hot, "key", "left_anti") for side in (low, high))
    variants = -(-BITS // (max_bits // 2 + 1)) + 1
    pairs = low.withColumnRenamed("fp", "a").hint("merge").join(high.withColumnRenamed("fp", "b"), "key")
    # with nothing wiped both sides hold both members, else the sides differ in the wiped bit
    once = f"a < b OR shiftrightunsigned(key, 40) % {variants} > 0 AND a <> b"
    pairs = pairs.where(F.expr(f"bit_count(a ^ b) <= {max_bits} AND ({once})")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs if spread is None else pairs.unionByName(spread)


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id, kept.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest doc_id reachable over links, the document
    itself included, and kept says whether it is that document.  Null and empty
    texts have fingerprint zero and are linked like any other.  Rows with a null
    id link too, but never name a component unless there is no other id (then
    component_id is null and all are kept).  Repeated rows share a component.
    An empty table gives an empty result; other columns are ignored.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return _grouped(marked, nodes, fingerprint_links(nodes.select("fp"), max_bits))


def _grouped(marked: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Name the components: marked (doc_id, fp), nodes (fp, least), links (a, b)."""
    linked = connected_components(links)
    placed = split_join(nodes, linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = split_join(placed.select("fp", "component"), least, "component").select("fp", "component_id")
    return split_join(marked.select("doc_id", "fp"), names, "fp").select(
        "doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys, one row a text: each key mixes the least values of
    ``rows`` permutations of the text's shingle hashes.  Texts have shingles."""
    draw = np.random.default_rng(MINHASH_SEED)
    keys = np.empty((len(first) - 1, bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(first) - 1, band, np.uint64)
            for _ in range(rows):
                turn, odd = draw.integers(0, 2**64, 2, dtype=np.uint64)
                key = (key ^ np.minimum.reduceat((hashes ^ turn) * (odd | np.uint64(1)), first[:-1])) * textops.P1
                key ^= key >> np.uint64(29)
            keys[:, band] = key
    return keys


def _signed(docs: DataFrame, shingle: int, seed: int, bands: int, rows: int, sets: bool) -> DataFrame:
    """(doc_id, text_md5, fp, node, size, keys) or, with ``sets``, (node, shingles)
    of each row of ``docs``.  A node is a distinct shingle set, named by its hash (none:
    zero); shingles are its sorted 64-bit hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in textops.batches(textops.Texts(part.column(1))):
                hashes, first = shingle_hashes(texts, shingle, seed)
                own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
                node = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 if len(x) else 0 for x in own], pa.int64())
                if sets:
                    yield pa.RecordBatch.from_arrays([node, pa.array([x.tobytes() for x in own], pa.binary())], ["node", "shingles"])
                    continue
                full = np.flatnonzero(np.diff(first) > 0)
                keys = band_keys(hashes, np.append(first[:-1][full], first[-1]), bands, rows).view(np.int64) if len(full) else np.zeros((0, bands), np.int64)
                offsets = np.append(0, np.cumsum(np.where(np.diff(first) > 0, bands, 0)))
                columns = [
                    part.column(0).slice(at, len(texts)), part.column(2).slice(at, len(texts)), pa.array(textops.bit_majority(hashes, first).view(np.int64)), node,
                    pa.array([len(x) for x in own], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_md5", "fp", "node", "size", "keys"])

    given = docs.withColumn("text_md5", F.lit("") if sets else F.md5(F.coalesce("text", F.lit(""))))
    return given.mapInArrow(run, "node long, shingles binary" if sets else "doc_id long, text_md5 string, fp long, node long, size int, keys array<long>")


def _alike(similarity: float):
    """Of pairs with their shingle sets, those whose Jaccard similarity suffices."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            close = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                close.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of values that each set on the left shares with each
    on the right.  Values that few sets hold are counted pair by pair, the others
    as products of 0/1 matrices, both in pieces of bounded size."""
    tall, wide = len(left), len(right)
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    values = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    first, many = [], []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(both, values[k]), max(len(both) - 1, 0))
        mine = both[at] == values[k] if len(both) else np.zeros(len(at), bool)
        at, rows[k] = at[mine], rows[k][mine]
        rows[k] = rows[k][np.argsort(at, kind="stable")]
        many.append(np.bincount(at, minlength=len(both)))
        first.append(np.cumsum(many[k]) - many[k])
    out = np.zeros(tall * wide, np.int32)
    work = many[0] * many[1]
    few = np.flatnonzero(work <= max(64, tall * wide // 100))
    ends = np.cumsum(work[few])
    for lo in range(0, int(ends[-1]) if len(few) else 0, PIECE):
        pair = np.arange(lo, min(lo + PIECE, int(ends[-1])))
        which = np.searchsorted(ends, pair, side="right")
        value = few[which]
        i, j = np.divmod(pair - (ends[which] - work[value]), many[1][value])
        out += np.bincount(rows[0][first[0][value] + i] * wide + rows[1][first[1][value] + j], minlength=tall * wide)
    out = out.reshape(tall, wide)
    common = np.flatnonzero(work > max(64, tall * wide // 100))
    for lo in range(0, len(common), 1024):
        has = []
        for k, size in ((0, tall), (1, wide)):
            some = common[lo : lo + 1024]
            column = np.repeat(np.arange(len(some)), many[k][some])
            place = np.repeat(first[k][some] - (np.cumsum(many[k][some]) - many[k][some]), many[k][some]) + np.arange(len(column))
            matrix = np.zeros((size, len(some)), np.float32)
            matrix[rows[k][place], column] = 1
            has.append(matrix)
        out += (has[0] @ has[1].T).astype(np.int32)
    return out


def _met(similarity: float):
    """Of one cell: links between components whose members are similar, as a
    forest.  A cell holds whole bands, or two blocks of the nodes of one band
    (``own`` and the cell's i and j tell which)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, own, component = (table.column(c).to_numpy() for c in ("key", "own", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            left = right = np.arange(a, b)
            if i != j:
                left, right = left[own[a:b] == i], right[own[a:b] == j]
            if not len(left) or not len(right):
                continue
            shared = shared_counts([sets[k] for k in left], [sets[k] for k in right])
            either = sizes[left][:, None] + sizes[right][None, :] - shared
            x, y = np.nonzero((shared >= similarity * either - 1e-9) & (component[left][:, None] != component[right][None, :]))
            if len(x):
                links.append(forest(component[left][x], component[right][y]))
        found = forest(*(np.concatenate([link[k] for link in links]) for k in (0, 1)))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _simhash_band(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Entries (band, key, fp, node, size) of nodes that have shingles: the key stands for
    the component of fingerprints at most ``max_bits`` apart that the node's is in."""
    full = nodes.where("size > 0").select("fp", "node", "size")
    linked = connected_components(fingerprint_links(full.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    return split_join(full, linked, "fp", "left").select(F.lit(0).alias("band"), key.alias("key"), "fp", "node", "size")


def _following(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, fp, node), each node with the one before it in its band."""
    last = (None, None)
    for part in parts:
        if not part.num_rows:
            continue
        key, node = part.column(0).to_numpy(), part.column(2).to_numpy()
        pairs = [(node[:-1][same], node[1:][same]) for same in [key[1:] == key[:-1]]]
        if last[0] == key[0]:
            pairs.append((np.array([last[1]]), node[:1]))
        last = key[-1], node[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs]), pa.int64()) for k in (0, 1)], ["a", "b"])


def _hot_links(entries: DataFrame, hot: DataFrame, count: int, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs among neighbours in the bands of ``hot``, ordered by
    fingerprint, and between each node and the band's first.  Their number is
    linear in the nodes; rows of a band may be in many tasks, and a pair that the
    border of two tasks parts is left to the later rounds."""
    rows = checkpoint(split_join(entries, hot, "key").select("key", "fp", "node"), count)
    parts = shuffle_partitions(entries.sparkSession)
    beside = rows.repartitionByRange(parts, "key", "fp", "node").sortWithinPartitions("key", "fp", "node").mapInArrow(_following, "a long, b long")
    first = rows.groupBy("key").agg(F.min(F.struct("fp", "node")).alias("first"))
    lead = split_join(rows, first, "key").select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    pairs = beside.unionByName(lead).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for own in "ab":
        pairs = split_join(pairs, sets.select(F.col("node").alias(own), F.col("shingles").alias("s" + own)), own)
    return pairs.select("a", "b", "sa", "sb").mapInArrow(_alike(similarity), "a long, b long")


def _band_links(entries: DataFrame, count: int, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links between components that share a band and have similar members, all
    pairs of nodes in different components compared; none where the nodes of each
    band are connected already.

    entries: (key, node, size, component), at most ``count`` rows.  Nodes outside a band's largest
    component are dealt into blocks, and so are those inside; a block of the
    former meets itself and every other, blocks of the latter never meet each
    other.  Bands of one block share cells of about CELL shingles.
    """
    inside = entries.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"))
    blocks = F.greatest(F.ceil(F.col("n") / NODES), F.ceil(F.col("mass") / CELL)).cast("int")
    most = inside.groupBy("key").agg(F.max(F.struct("n", "component", "mass")).alias("most"), F.sum("n").alias("n"), F.sum("mass").alias("mass")).where("n > most.n")
    most = most.select("key", F.col("most.component").alias("lead"), blocks.alias("whole"), "n", "mass", F.col("most.n").alias("lead_n"), F.col("most.mass").alias("lead_mass"))
    rest = most.select("key", "lead", "whole", "mass", (F.col("n") - F.col("lead_n")).alias("n"), (F.col("mass") - F.col("lead_mass")).alias("rest_mass"), "lead_n", "lead_mass")
    blocks_of = lambda n, mass: F.greatest(F.lit(1), F.ceil(F.col(n) / NODES), F.ceil(F.col(mass) / CELL)).cast("int")
    plan = checkpoint(rest.select("key", "lead", "whole", "mass", blocks_of("n", "rest_mass").alias("outer"), blocks_of("lead_n", "lead_mass").alias("inner")), count // 2)
    known = plan.agg(F.count(F.lit(1)).alias("bands"), F.sum(F.when(F.col("whole") == 1, F.col("mass"))).alias("mass")).first()
    if not known.bands:
        return None
    cells = max(shuffle_partitions(entries.sparkSession), -(-int(known.mass or 0) // CELL))
    dealt = split_join(entries, plan, "key")
    dealt = dealt.withColumns({"mine": F.expr("component = lead"), "place": F.pmod(F.xxhash64("node"), F.lit(1 << 30))})
    own = F.when(F.col("mine"), F.col("outer") + F.expr("int(place % inner)")).otherwise(F.expr("int(place % outer)"))
    dealt = dealt.withColumn("own", F.when(F.col("whole") == 1, -1).otherwise(own))
    others = F.when(F.col("own") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.when(F.col("mine"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.select(
        "key", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") < 0, F.pmod(F.xxhash64("key"), F.lit(cells))).otherwise(F.col("key")).alias("cell"),
    )
    met = split_join(dealt, sets, "node").select("key", "component", "own", "i", "j", "cell", "shingles")
    return met.groupBy("cell", "i", "j").applyInArrow(_met(similarity), "a long, b long")


def simhash_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5, seed: int = 42, max_bits: int = 2) -> DataFrame:
    """Near-dedup by similarity rather than a few bits: result and edge cases as
    in simhash_near_dedup, but texts are linked if the Jaccard similarity of
    their sets of ``shingle``-word shingles is at least ``similarity``, which is
    computed on the whole sets (of 64-bit hashes) and not on fingerprints.  Also
    text_md5, and first: whether the row is the one of its component with the
    smallest id and, where rows share that id, the smallest text_md5 (rows that
    share both are first together).

    Candidates are found by SimHash first: all nodes of a component of fingerprints
    at most ``max_bits`` apart meet, as in simhash_near_dedup, which misses no such
    pair.  A pair of similarity 0.8 differs in some 15 of 100 SimHash bits, which no
    affordable set of fingerprint segments finds with certainty.  So texts that
    share a MinHash band meet as well: a pair of similarity s does with probability
    1 - (1 - s**rows)**bands, 0.9996 at 0.8.  A SimHash component is a band like
    the others (the first).  No band is cut short; nodes known to be connected are
    not compared again:

    * bands too large for one block are first gathered at a cost linear in their
      size: SimHash orders their nodes, and neighbours are compared;
    * then the bands are worked off in ROUNDS; a band whose nodes are all
      connected is done, elsewhere all nodes outside its largest component meet
      all others, in blocks.  Each block returns a forest, never its pairs.
    """
    base = documents(docs, id_col, text_col)
    marked = checkpoint(_signed(base, shingle, seed, bands, rows, False))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")  # null ids come last
    nodes = marked.groupBy("node").agg(F.min(row).alias("least"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("keys").alias("keys"))
    nodes = checkpoint(nodes)
    count = nodes.count()
    entries = nodes.select(F.posexplode("keys").alias("band", "key"), "fp", "node", "size").withColumn("band", F.col("band") + 1)
    entries = checkpoint(_simhash_band(nodes, max_bits), count).unionByName(entries)
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("mass")).where("many > 1")
    shared = checkpoint(met.select("key", ((F.col("many") > NODES) | (F.col("mass") > CELL)).alias("hot"), "many"), count * (bands + 1) // 2)
    known = shared.agg(F.sum("many").alias("rows"), F.sum(F.when(F.col("hot"), F.col("many"))).alias("hot")).first()
    entries = checkpoint(split_join(entries, shared.select("key"), "key"), known.rows or 0)
    # sets are made of one text of each node that meets another; texts travel, which are
    # smaller than their sets, and each once, so no key of the join is hot
    wanted = split_join(nodes.select("node", F.col("least.text_md5").alias("text_md5")), entries.select("node").distinct(), "node", "left_semi").select("text_md5")
    texts = base.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    sets = checkpoint(_signed(texts.join(wanted, "text_md5", "left_semi").select("doc_id", "text"), shingle, seed, bands, rows, True))

    none = entries.sparkSession.createDataFrame([], "a long, b long")
    groups = connected_components(_hot_links(entries, shared.where("hot").select("key"), known.hot, sets, similarity) if known.hot else none)
    start = 0
    for share in ROUNDS:
        stop = 1 + round(bands * share)
        placed = split_join(entries.where(f"band >= {start} AND band < {stop}"), groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        links = _band_links(checkpoint(placed.select("key", "node", "size", "component"), known.rows or 0), known.rows or 0, sets, similarity)
        if links is not None:
            groups = connected_components(links.unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        start = stop

    placed = split_join(nodes.select("node", "least"), groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("least"))
    names = split_join(placed.select("node", "component"), least, "component").select("node", "least")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return split_join(marked.select("doc_id", "text_md5", "fp", "node"), names, "node").select(
        "doc_id", "fp", F.col("least.doc_id").alias("component_id"), kept.alias("kept"), "text_md5", (kept & (F.col("text_md5") == F.col("least.text_md5"))).alias("first")
    )
