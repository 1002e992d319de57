"""Exact Jaccard self-join of documents' shingle sets by universe partition.

Sets are put in bands of size. For a pair whose smaller set lies in band i the symmetric difference has at most H(i)
elements, so if the universe is hashed into enough segments, one of them must hold the same elements in both sets, or
nearly the same. A scheme has ``exact`` segments, whose content is one signature and earns one credit, and
``near`` segments, whose content and one-deletion neighbourhood are signatures and earn two; with
``exact + 2 * near >= H + 1 + spare`` a pair that shares no signature differs in more than H elements, even if up to
``spare`` of a set's exact segments are left out. Left out are empty segments, the signatures that most sets share; a set
with more of them than ``spare`` leaves out none. The numbers of segments are chosen for the least expected cost.

Sets that share a signature are candidates. A group is not expanded into its pairs. In a few rounds its members are
compared with one member each, those first that share most with others, which brings nearly all of a family of
copies into one component. Only members of different components are then compared with each other, and of those pairs
only the ones leave the join whose parity sketches allow a link: a bit of the sketch is the parity of the elements that hash
to it, so the bits in which two sketches differ are a lower bound of the symmetric difference. Every link is verified on the
whole sets, with integers. At the end the links of each component are counted, by blocks of its sets.

A set is known by 128 bits, so that of 10^11 different ones no two are to be expected under one key (n^2 / 2^129). A shingle is
known by 64, which are only ever compared between two sets: of a pair with a thousand each, some 10^6 / 2^64 count one too many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm.components import connected_components
from helixspark.llm.storage import bound_batches, bucketed, parts, shuffle_width, stored, trim

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return mixed((lower + np.uint64(1)) * _GOLDEN), space, np.zeros(0)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of a shorter text, of its whole word sequence."""
    code, space, _ = _tables()
    data = np.frombuffer(text, np.uint8)
    solid = ~space[data]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    if not len(edge):
        return np.zeros(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[data] * _powers(_BASE, len(data)))])
    word = mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    total = np.full(len(word) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + _GOLDEN) + word[i : len(word) - k + 1 + i]
    return np.unique(mixed(total))


_KEY_SALTS = (_GOLDEN, np.uint64(0xC2B2AE3D27D4EB4F))


def set_key(items: np.ndarray) -> bytes:
    """A 128-bit key of a whole set: two sums of its elements, mixed differently."""
    sums = [mixed(items ^ salt).sum() + np.uint64(len(items)) for salt in _KEY_SALTS]
    return mixed(np.array(sums, np.uint64)).tobytes()


class Plan:
    """Bands, schemes and allocations for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent, self.bounds, self._schemes = percent, [1], {}

    def band(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(self.bounds[-1] * 1000 // 725 + 1)
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def distance(self, total: int) -> int:
        """Most elements in which two sets of ``total`` elements together can differ and still link."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def schemes(self, size: int) -> list[int]:
        """Those of its own band, and of the bands below in which it has partners."""
        own = self.band(size)
        low = self.band(-(-self.percent * size // 100))
        return list(range(low, own + 1))

    def scheme(self, band: int) -> tuple[int, int, int]:
        """exact, near, spare for pairs whose smaller set is in ``band``."""
        if band not in self._schemes:
            self.band(self.bounds[band])
            low, top = self.bounds[band], self.bounds[band + 1] - 1
            most = max(self.distance(s + t) for s in (top, top - 1) if s >= low for t in {s, self.largest_partner(s), max(s, self.largest_partner(s) - 1)})
            self._schemes[band] = min((self._option(most, near, (low + top) / 2) for near in range(0, 4)), key=lambda x: x[0])[1]
        return self._schemes[band]

    @staticmethod
    def _option(most: int, near: int, size: float) -> tuple[float, tuple[int, int, int]]:
        spare = 1 + int(0.04 * most)
        exact = max(0, most + 1 + spare - 2 * near)
        if exact == 0:
            spare = 0
        segments = exact + near
        each = size / max(1, segments)
        # rows written, and what it costs that sets meet in segments of no or one element
        cost = exact + near * (1 + each) + 40 * (max(0.0, exact * math.exp(-each) - spare) + near * (1 + each) * math.exp(-each))
        return (cost, (exact, near, spare)) if segments else (math.inf, (1, 0, 0))


def signatures(items: np.ndarray, plan: Plan) -> np.ndarray:
    """All signatures of a set, as signed 64-bit numbers."""
    out = []
    content = mixed(items ^ np.uint64(0xA0761D6478BD642F))
    for band in plan.schemes(len(items)):
        exact, near, spare = plan.scheme(band)
        segments = exact + near
        segment = ((mixed(items + np.uint64((band + 1) * int(_GOLDEN) % (1 << 64))) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(segments, np.uint64)
        np.add.at(total, segment, content)
        count = np.bincount(segment, minlength=segments)
        salt = mixed((np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 32)) * _GOLDEN)
        empty = count[:exact] == 0
        keep = ~empty if empty.sum() <= spare else np.ones(exact, bool)
        out.append(mixed(total[:exact] + salt[:exact] + count[:exact].astype(np.uint64))[keep])
        if near:
            out.append(mixed(total[exact:] + salt[exact:] + count[exact:].astype(np.uint64)))
            own = segment >= exact
            at = segment[own]
            out.append(mixed(total[at] - content[own] + salt[at] + (count[at] - 1).astype(np.uint64)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in parts(batch, 1, _BATCH_BYTES):
            yield part, [(t.as_py() or "").encode() for t in part.column(1)]
    trim()


SKETCH_WORDS = 16
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
ROUNDS = 3


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the elements in each of 1024 hash slots, as 16 LONGs."""
    slots = SKETCH_WORDS * 64
    slot = (mixed(items ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(slots)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=slots) & 1).astype(np.uint8)).view(np.int64)


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, place, n_shingles, set_id (null for an empty set) and the sketch of each row; ``docs`` has doc_id, text and place."""

    def run(batches):
        for part, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            sketches = np.stack([sketch(s) for s in sets]) if sets else np.zeros((0, SKETCH_WORDS), np.int64)
            columns = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.record_batch([*columns, *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS))], names=["doc_id", "place", "n_shingles", "set_id", *_SKETCH])

    return docs.mapInArrow(run, "doc_id long, place long, n_shingles long, set_id binary, " + ", ".join(f"{c} long" for c in _SKETCH))


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, set_id: the signatures of every distinct set of a batch."""

    def run(batches):
        plan = Plan(percent)
        for part, texts in _texts(batches):
            sigs, keys = [], {}  # the place of each key's signatures
            for text in texts:
                items = shingle_set(text, words)
                if len(items) and (key := set_key(items)) not in keys:
                    keys[key] = len(sigs)
                    sigs.append(signatures(items, plan))
            if sigs:
                owner = np.repeat(np.arange(len(sigs), dtype=np.int32), [len(x) for x in sigs])
                flat, names = np.concatenate(sigs), pa.array(list(keys), pa.binary())
                for a in range(0, len(flat), _BATCH_ROWS):
                    yield pa.record_batch([pa.array(flat[a : a + _BATCH_ROWS]), names.take(pa.array(owner[a : a + _BATCH_ROWS]))], names=["sig", "set_id"])

    return docs.mapInArrow(run, "sig long, set_id binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for part, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            # another text may stand under the same id
            own = [len(s) > 0 and set_key(s) == node for s, node in zip(sets, part.column(0).to_pylist(), strict=True)]
            yield pa.record_batch([part.column(0).filter(pa.array(own, pa.bool_())), pa.array([s.view(np.int64) for s, o in zip(sets, own, strict=True) if o], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.mapInArrow(run, "node binary, items array<long>")


def _may_link(percent: int):
    """Whether sizes and sketches of x and y allow a link."""
    total = F.col("x.n") + F.col("y.n")
    allowed = total - 2 * F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (apart <= allowed)


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow a link."""
    found = pairs.alias("p").join(sketches.alias("x"), F.col("p.a") == F.col("x.node")).join(sketches.alias("y"), F.col("p.b") == F.col("y.node"))
    return found.where(_may_link(percent)).select("p.a", "p.b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union."""
    side = lambda name, items: sets.select(F.col("node").alias(name), F.col("items").alias(items))
    both = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = both.select("a", "b", F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))
    return both.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


#: Bits of the set by which likely() tells rows apart, at most: a million rows of 64 are sent to the tasks.
MOST_BITS = 1 << 26


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be one of the wanted: all of those, and about one of 16 others, or more where ``MOST_BITS`` are too few.

    Before a join by that column it spares the others the shuffle; the join itself decides.
    """
    slots = min(MOST_BITS, max(64, 1 << (16 * wanted.count() - 1).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(slots)).alias("_slot")
    bits = wanted.select(slot).groupBy(F.expr("shiftright(_slot, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot & 63 AS int)))").alias("_bits"))
    marked = rows.select("*", slot).withColumn("_word", F.expr("shiftright(_slot, 6)")).join(F.broadcast(bits), "_word")  # bounded: MOST_BITS
    return marked.where("shiftright(_bits, cast(_slot & 63 AS int)) & 1 = 1").select(*rows.columns)


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each row; n_links counts the other rows that it links with.

    A document's set holds its distinct word shingles; white space parts words and A-Z are lowered. With fewer words the
    whole sequence is the one element; without words, or with null text, the set is empty and links with nothing, so
    the component is the document itself and n_links 0. Rows that repeat an id are each returned; where they have different sets, the
    id links what either links. A null id links like any other; its component is the smallest id that is not null, or
    null. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    # a text is found again by its id, or by its hash where it has none
    texts = texts.withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))
    rows = stored(described(texts, words), "sets")
    groups = stored(_shared(signed(texts.drop("place"), words, percent)), "groups")
    nodes = groups.groupBy(F.col("set_id").alias("node")).agg(F.sum("size").alias("score"))
    sketches = rows.where("set_id IS NOT NULL").withColumnsRenamed({"set_id": "node", "n_shingles": "n"}).groupBy("node").agg(*(F.min(c).alias(c) for c in ["n", *_SKETCH]), F.min("place").alias("place"))
    sketches = stored(sketches.join(nodes, "node"), "sketches")
    # one document stands for each set; a table in buckets is not shuffled again for every round of pairs
    # the number of nodes grows with the corpus, so the same plan serves every size
    wanted = sketches.select("node", "place")
    named = likely(texts, wanted, "place").join(wanted.hint("merge"), "place").select("node", "text")
    sets = bucketed(_sets(named, words), "node", "items")
    members = groups.select("sig", F.col("set_id").alias("node")).join(sketches.select("node", "score"), "node")
    members = stored(members, "members")
    links = stored(docs.sparkSession.createDataFrame([], "a binary, b binary"), "links")
    tested, labels = links, None
    for turn in range(1, ROUNDS + 1):
        pairs = stored(_round(members, labels, turn).join(tested, ["a", "b"], "left_anti"), "pairs", narrow=True)
        tested = tested.union(pairs)
        found = stored(verified(plausible(pairs, sketches, percent), sets, percent), "links", narrow=True)
        if not found.limit(1).count():
            break
        links = links.union(found)
        labels = connected_components(links)
    placed = _placed(members, labels)
    # a least binary is found by sorting, a least number is not; two hashes of a label tell it from any other
    marks = [F.xxhash64("label"), F.xxhash64("label", F.lit(1))]
    torn = placed.groupBy("sig").agg(*(f(m).alias(f"{f.__name__}{i}") for i, m in enumerate(marks) for f in (F.min, F.max)))
    torn = torn.where("min0 <> max0 OR min1 <> max1").select("sig")
    placed = stored(placed.join(torn, "sig", "left_semi").select("sig", "node", "label").join(sketches.drop("score", "place"), "node"), "torn")
    differ = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    more = placed.alias("x").join(placed.alias("y"), differ & _may_link(percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    found = stored(verified(more.join(tested, ["a", "b"], "left_anti"), sets, percent), "links", narrow=True)
    if found.limit(1).count():
        labels = connected_components(links.union(found))
    rows = rows.select("doc_id", "n_shingles", F.col("set_id").alias("node"))
    whole = stored(rows.join(_of_nodes(rows, sets, labels, percent), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    first = stored(whole.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first", narrow=True)
    return whole.join(first, "label", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _of_nodes(rows: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """node, label, n_links of the sets that link with another or that several rows have."""
    copies = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies")).where("copies > 1"), "copies", narrow=True)
    if labels is None:
        return copies.select("node", F.col("node").alias("label"), (F.col("copies") - 1).alias("n_links"))
    nodes = stored(labels.join(copies, "node", "full").select("node", "label", F.coalesce("copies", F.lit(1)).alias("copies")), "nodes", narrow=True)
    links = link_counts(sets, nodes.where("label IS NOT NULL"), percent)
    found = nodes.join(links, "node", "left").select("node", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return stored(found, "nodes", narrow=True)


#: Shingles in a block of a component's sets.
BLOCK_ITEMS = 1 << 18


def link_counts(sets: DataFrame, nodes: DataFrame, percent: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """node, links: with how many rows of other sets each set links. ``nodes`` has node, label and copies, the rows of each set.

    Sets that link are in one component. A component's sets are dealt to blocks, and each two blocks meet in a task, where
    the sets of one are counted against those of the other: pairs are neither rows nor sent, and a row leaves for each set of two blocks.
    Every pair within a component is looked at, so the work grows with the square of a component's different sets.
    """
    held = sets.join(nodes, "node").select("label", "node", "copies", "items")
    total = stored(held.groupBy("label").agg(F.sum(F.size("items")).alias("total")), "totals", narrow=True)
    blocks = F.ceil(F.col("total") / block_items).cast("int")
    dealt = held.join(total, "label").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "items")
    met = dealt.repartition(shuffle_width(sets.sparkSession), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")

    def count(group: list[tuple]) -> pa.RecordBatch:
        lo, hi = group[0][0][1:]
        size = np.array([len(g[4]) for g in group], np.int64)
        items = np.unique(np.concatenate([g[4] for g in group]), return_inverse=True)[1]
        copies, first = np.array([g[3] for g in group], np.int64), np.cumsum(size) - size
        one, two = ([i for i, g in enumerate(group) if g[1] == side] for side in (lo, hi))
        links = np.zeros(len(group), np.int64)
        mark = np.zeros(int(items.max()) + 1, bool)
        theirs = np.concatenate([items[first[j] : first[j] + size[j]] for j in two]) if two else np.zeros(0, np.int64)
        edge, two = np.cumsum(size[two]) - size[two], np.array(two, np.int64)
        for i in one if len(two) else ():
            own = items[first[i] : first[i] + size[i]]
            mark[own] = True
            shared = np.add.reduceat(mark[theirs], edge, dtype=np.int64)
            mark[own] = False
            hit = two[(100 * shared >= percent * (size[i] + size[two] - shared)) & (two != i)]
            links[i] += copies[hit].sum()
            if lo != hi:
                links[hit] += copies[i]
        return pa.record_batch([pa.array([g[2] for g in group]), pa.array(links)], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("label", "lo", "hi")), strict=True)
            for key, own, node, copies, items in zip(keys, *(batch.column(c).to_pylist() for c in ("own", "node", "copies")), batch.column("items"), strict=True):
                if group and group[0][0] != key:
                    yield count(group)
                    group = []
                group.append((key, own, node, copies, items.values.to_numpy().copy()))
        if group:
            yield count(group)
        trim()

    return met.mapInArrow(run, f"node {sets.schema['node'].dataType.simpleString()}, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _placed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the label of their node: itself where it has no link."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _round(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Distinct pairs a < b: every member of a group with the one of rank ``turn`` and with the one ``turn`` places before, if they are in different components."""
    order = Window.partitionBy("sig").orderBy(F.desc("score"), "node")
    ranked = _placed(members, labels).withColumn("rank", F.row_number().over(order))
    heads = F.first(F.when(F.col("rank") == turn, F.struct("node", "label")), ignorenulls=True).over(Window.partitionBy("sig").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.lag(F.struct("node", "label"), turn).over(order)
    partners = ranked.withColumn("head", heads).withColumn("before", before)
    partners = partners.select("node", "label", F.explode(F.array("head", "before")).alias("other")).where("other IS NOT NULL AND other.label <> label")
    return partners.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def _shared(sigs: DataFrame) -> DataFrame:
    """sig, set_id and the group's size, for signatures that at least two sets have."""
    order = Window.partitionBy("sig").orderBy("set_id")
    # neighbours only, so that a group of any size is read in a stream
    pairs = sigs.withColumn("prev", F.lag("set_id").over(order)).withColumn("next", F.lead("set_id").over(order))
    # the same set from several batches counts once
    once = pairs.where("(prev IS NOT NULL AND prev <> set_id) OR (prev IS NULL AND next IS NOT NULL)").select("sig", "set_id")
    return once.withColumn("size", F.count("*").over(Window.partitionBy("sig"))).where("size > 1")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 2, 2)) END, lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w),
h AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.s = y.s AND x.doc_id <> y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 85 GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM g UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM g JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
