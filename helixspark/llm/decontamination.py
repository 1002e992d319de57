"""Benchmark decontamination by latent semantic retrieval.

TF-IDF vectors of passages (windows of 48 words that overlap by half) are projected to a latent space that a distributed randomised SVD
finds. Benchmark items are cut into the same windows, and passages near one of them by cosine are candidates. A candidate is a leak if, in a stretch not much longer
than the item, the longest common subsequence of words holds most of the item and most of its answer (its last
words); that is looked at for the whole item, however long. Document frequencies cover all documents and are counted in many more slots than the latent space has features, so that a
word is weighed by itself and not by all words of its feature; no word is without weight. The SVD is fitted on every window of the documents
and of the items; its one latent space serves every item. Documents are read once to store their words as numbers, which the frequencies and the SVD's rounds read,
and once for each ``windows_per_pass`` windows of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.jaccard import _BASE, _GOLDEN, _INVERSE, _powers, _tables, mixed
from helixspark.llm.storage import bound_batches, hashed_sample, parts, stored, trim


_BLOCKS = 128  # windows compared at a time, at least
_GATHERED = 768  # rows of a table gathered at a time: with 128 columns they stay in a core's cache until they are summed up
_WIDTH = 32  # rows of a table summed up at a time
_TOGETHER = 4  # rows of numbered_words() multiplied at a time: a feature stands in them often enough to fill rows of ``_WIDTH``
_SLICES = 256  # of a matrix that tasks sum up
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Options:
    features: int = 8192  #: hashed words
    rank: int = 128  #: dimensions of the latent space
    spare_rank: int = 16  #: beyond one for each window of an item, where these are fewer than ``rank``
    block: int = 24  #: words; a window is two neighbouring blocks
    weight_slots: int = 1 << 20  #: in which words' document frequencies are counted; more than ``features``
    sample_windows: int | None = None  #: of benchmark items, at most, for the SVD; None: all
    power_rounds: int = 2
    item_weight: float = 100.0  #: of a window of a benchmark item against one of a document, in the SVD, where there are ``weighed_docs``
    weighed_docs: int = 2000  #: more documents weigh as much together as so many, that the items' share does not fall
    cosine: float = 0.5  #: candidates have it at least
    similarity: float = 0.8  #: of the item's words, in order
    answer_words: int = 8  #: the item's last words, a third of it at most
    answer_share: float = 0.75
    stretch: float = 1.25  #: of an item's length, in which its words are looked for
    windows_per_pass: int = 1 << 14  #: of items, which a task holds while it reads the documents once
    seed: int = 11


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words: runs of digits, letters and bytes beyond ASCII, with A-Z lowered."""
    return hashes_of([text])[0]


def hashes_of(texts: list[bytes], together: int = 1 << 15) -> list[np.ndarray]:
    """word_hashes() of each text; short texts are handled together."""
    out, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= together:
            out += _hashes_of(held)
            held, size = [], 0
    return out + _hashes_of(held)


def _hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    code, _, _ = _tables()
    data = np.frombuffer(b" ".join(texts), np.uint8)  # a space parts words
    edge = np.flatnonzero(np.diff(_WORD_BYTES[data], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _powers(_BASE, len(data)), out=sums[1:])
    words = mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    return np.split(words, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])[:-1])) if texts else []


def _features(words: np.ndarray, count: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)


def numbered_words(docs: DataFrame) -> DataFrame:
    """counts, words: the upper halves of the hashes of all texts' words, a row for about half a megabyte of texts, stored."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 0, 1 << 19):
                texts = hashes_of([(t.as_py() or "").encode() for t in part.column(0)])
                counts = np.array([len(x) for x in texts], np.int32)
                words = (np.concatenate(texts) >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch([pa.array([counts.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())], names=["counts", "words"])
        trim()

    return stored(docs.select("text").mapInArrow(run, "counts binary, words binary"), "words")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words for each text, and the words, by their hashes' upper halves, of each row of numbered_words()."""
    for batch in batches:
        for counts, words in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(counts.as_py(), np.int32), np.frombuffer(words.as_py(), np.uint32).astype(np.uint64) << np.uint64(32)


def document_frequencies(words: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """In how many documents each slot of words stands, and the number of documents: a row for each slot that a task has met."""

    def count(batches):
        found = np.zeros(slots + 1, np.int64)
        for counts, numbers in _numbers(batches):
            found[slots] += len(counts)
            met = np.unique(np.repeat(np.arange(len(counts)), counts) * slots + _features(numbers, slots))  # once for each text
            np.add.at(found, met % slots, 1)
        met = np.flatnonzero(found)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(found[met])], names=["slot", "docs"])
        trim()

    total = words.mapInArrow(count, "slot int, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).toArrow()  # bounded: slots
    out = np.zeros(slots + 1, np.int64)
    out[total["slot"].to_numpy()] = total["docs"].to_numpy()
    return out[:-1], int(out[-1])


def inverse_frequencies(frequency: np.ndarray, rows: int) -> np.ndarray:
    return (np.log((rows + 1) / (frequency + 1)) + 0.1).astype(np.float32)


class Windows:
    """Sums of a table's rows over the word blocks of some texts, and over neighbouring blocks of a text."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, features: int, block: int):
        self.block = block
        counts = [-(-len(w) // block) for w in texts]
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.start = (np.arange(first[-1]) - first[self.doc]) * block
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        length = np.array([len(w) for w in texts], np.int64)
        # a text's words fill its blocks one after another
        self.cell = np.arange(len(words)) + np.repeat(first[:-1] * block - (np.cumsum(length) - length), length)
        self.feature, self.weight = _features(words, features), idf[_features(words, len(idf))]
        self.n = int(first[-1])

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The rows of ``table`` times the words' weights, summed by block."""
        return _products(*self.filled(), table)

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        feature, weight = np.zeros(self.n * self.block, np.int32), np.zeros(self.n * self.block, np.float32)
        feature[self.cell], weight[self.cell] = self.feature, self.weight
        return feature.reshape(self.n, self.block), weight.reshape(self.n, self.block)

    def pairs(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, documents and first words of the windows: each block with the next one of its text, if there is one."""
        last = np.append(self.doc[:-1] != self.doc[1:], True) if self.n else np.zeros(0, bool)
        alone = last & (self.start == 0)
        two = np.flatnonzero(~last)
        return np.concatenate([sums[two] + sums[two + 1], sums[alone]]), np.concatenate([self.doc[two], self.doc[alone]]), np.concatenate([self.start[two], self.start[alone]])


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _products(at: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row of ``at`` the sum of ``table[at]`` times the row's weights."""
    out = np.empty((len(at), table.shape[1]), np.float32)
    step = max(1, _GATHERED // at.shape[1])
    held = np.empty((min(step, len(at)), at.shape[1], table.shape[1]), table.dtype)  # filled again and again
    for a in range(0, len(at), step):
        rows = held[: len(at) - a]
        np.take(table, at[a : a + step], axis=0, out=rows, mode="clip")  # with "raise" numpy would fill a copy of ``rows`` first
        np.matmul(weight[a : a + step, None, :], rows, out=out[a : a + step, None, :])
    return out


def _sums_by(key: np.ndarray, at: np.ndarray, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some ascending keys, and for each the sum of ``table[at]`` times ``weight``: sums of a few rows, then of these sums."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    length = np.diff(first, append=len(key))
    rows = -(-length // _WIDTH)
    begin = np.cumsum(rows) - rows
    cell = np.arange(len(key)) + np.repeat(begin * _WIDTH - first, length)
    index, factor = np.zeros(int(rows.sum()) * _WIDTH, np.int32), np.zeros(int(rows.sum()) * _WIDTH, np.float32)
    index[cell], factor[cell] = at, weight
    sums = _products(index.reshape(-1, _WIDTH), factor.reshape(-1, _WIDTH), table)
    # reduceat() would go down each column by itself
    out, few = sums[begin], 8
    for k in range(1, few):
        more = np.flatnonzero(rows > k)
        out[more] += sums[begin[more] + k]
    for i in np.flatnonzero(rows > few).tolist():
        out[i] += sums[begin[i] + few : begin[i] + rows[i]].sum(0)
    return key[first], out


def _gram_product(texts: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A' A Q for the TF-IDF rows A (of unit length) of the texts' windows of two blocks: its features that are not 0, and their rows."""
    windows = Windows(texts, idf, len(basis), 2 * block)
    at, weight = windows.filled()
    y = _products(at, weight, basis) / np.maximum(np.square(weight).sum(1), 1e-9)[:, None]
    order = np.argsort(windows.feature.astype(np.uint16) if len(basis) <= 1 << 16 else windows.feature, kind="stable")  # numbers of 16 bits are sorted by counting
    return _sums_by(windows.feature[order], windows.cell[order] // (2 * block), windows.weight[order], y)


def _sliced(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's matrix as rows of slices: slice, task, part."""
    ends = np.linspace(0, len(total), _SLICES + 1).astype(int)
    task = TaskContext.get().partitionId()
    for a in range(0, _SLICES, 32):  # few at a time
        yield pa.record_batch([pa.array(np.arange(a, a + 32), pa.int32()), pa.array([task] * 32, pa.int32()), pa.array([total[ends[i] : ends[i + 1]].tobytes() for i in range(a, a + 32)], pa.binary())], names=["slice", "task", "part"])


def _summed(table: pa.Table) -> pa.Table:
    """The sum of a slice over the tasks, in their order, so that it is the same each time."""
    order = np.argsort(table.column("task").to_numpy(), kind="stable")
    total = np.zeros(len(table.column("part")[0].as_py()) // 4)
    for i in order.tolist():
        total += np.frombuffer(table.column("part")[i].as_py(), np.float32)
    return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def latent_space(words: DataFrame, rows: int, items: DataFrame, n_items: int, idf: np.ndarray, o: Options) -> np.ndarray:
    """Feature x rank: the strongest right singular vectors over their singular values, by subspace iteration from a random start.

    A round sums A' A Q over all windows of the documents and the items, in the tasks; one matrix reaches the driver, which sums up no data itself.
    ``words`` are the numbered_words() of documents, ``rows`` of them; ``items`` have text and starts, the first words of ``n_items`` windows in all.
    """
    draw = np.random.default_rng(o.seed)
    basis = draw.standard_normal((o.features, min(o.rank, n_items + o.spare_rank))).astype(np.float32)
    item_weight = o.item_weight * max(1.0, rows / o.weighed_docs)
    spark = words.sparkSession
    weights = spark.sparkContext.broadcast(idf)  # bounded: slots
    for round_ in range(o.power_rounds + 1):
        shipped = spark.sparkContext.broadcast(basis)  # bounded: features x rank

        def product(blocks: Iterator[list[np.ndarray]], weight: float, shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = None
            for texts in blocks:
                total = np.zeros_like(shipped.value) if total is None else total
                feature, rows = _gram_product(texts, weights.value, shipped.value, o.block)
                total[feature] += rows * np.float32(weight)
            if total is not None:
                yield from _sliced(total)
            del total
            trim()

        def of_docs(batches, product=product):
            def texts():
                rows = _numbers(batches)
                while held := list(islice(rows, _TOGETHER)):
                    yield [text for counts, numbers in held for text in np.split(numbers, np.cumsum(counts)[:-1])]

            yield from product(texts(), 1.0)

        def of_items(batches, product=product):
            def windows():
                for batch in batches:
                    for text, starts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                        item = word_hashes(text.as_py().encode())
                        for a in range(0, len(starts), 1000):
                            yield [item[i : i + 2 * o.block] for i in starts[a : a + 1000]]

            yield from product(windows(), item_weight)

        schema = "slice int, task int, part binary"
        both = words.mapInArrow(of_docs, schema).unionByName(items.select("text", "starts").mapInArrow(of_items, schema).withColumn("task", -1 - F.col("task")))
        found = both.groupBy("slice").applyInArrow(_summed, "slice int, part binary").collect()  # bounded: features x rank
        total = np.frombuffer(b"".join(r.part for r in sorted(found, key=lambda r: r.slice)), np.float32).reshape(basis.shape)
        shipped.destroy()
        if round_ < o.power_rounds:
            basis = np.linalg.qr(total)[0].astype(np.float32)
    weights.destroy()
    trim()
    strength, turn = np.linalg.eigh(basis.T @ total)
    # every direction counts alike: else the few that tell languages apart would decide all cosines
    return ((basis @ turn) / np.sqrt(np.maximum(strength, 1e-6))).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one integer operation for each element of ``b`` that ``a`` has."""
    places = _places(a)
    return _common(len(a), [places[x] for x in b if x in places])


def _places(a: list) -> dict:
    """The places of each element of ``a``, as bits."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def _common(length: int, places: list[int]) -> int:
    """common_subsequence() of a list of that length with elements that have these places in it."""
    row = full = (1 << length) - 1
    for at in places:
        hit = row & at
        row = (row + hit | row - hit) & full
    return length - row.bit_count()


def best_stretch(item: list, words: list, o: Options) -> tuple[int, bool, int]:
    """The longest common subsequence of the item with a stretch of the words, whether that has the answer, and its start.

    A stretch with the answer is better than one without, then the longer subsequence, then the first. Stretches that hold too few of the item's
    words for a leak are not looked at.
    """
    size, least, best = max(1, int(np.ceil(o.stretch * len(item)))), o.similarity * len(item), (0, False, 0)
    met = [0, *accumulate(map({*item}.__contains__, words))]  # of the item's words, before each place
    if met[-1] < least:  # most candidates end here
        return best
    step = max(1, (size - len(item)) // 2)
    tail = max(1, min(o.answer_words, len(item) // 3))
    before = len(item) - tail
    places = _places(item)
    at = [places[x] for x in words if x in places]  # other words have no part in a subsequence
    for start in range(0, max(1, len(words) - size + step), step):
        a, b = met[start], met[min(start + size, len(words))]
        most = b - a
        if most < least or best[1] and most <= best[0]:
            continue
        found = _common(len(item), at[a:b])
        if best[1] and found <= best[0]:
            continue
        answered = _common(tail, [x >> before for x in at[a:b] if x >> before]) >= o.answer_share * tail
        if (answered, found) > (best[1], best[0]):
            best = found, answered, start
    return best


class ItemWords:
    """Which words items have, by slots: some that an item lacks count as its own, none that it has is missed."""

    def __init__(self, items: list[list[int]]):
        bits = min(22, max(10, (64 * sum(map(len, items))).bit_length()))
        self.shift, self.salt = np.uint64(64 - bits), np.arange(1, len(items) + 1, dtype=np.uint64) * _GOLDEN
        self.met = np.zeros(1 << bits, bool)
        for i, item in enumerate(items):
            self.met[self._slots(np.array(item, np.uint64), self.salt[i])] = True

    def _slots(self, words: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return ((words ^ salt) * _GOLDEN >> self.shift).astype(np.int64)

    def most(self, words: np.ndarray, first: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many of ``size`` words from each place on the place's item has, at most."""
        out = np.zeros(len(first), np.int64)
        block = np.cumsum(size) >> 18  # few words at a time
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(first)]
        for a, b in zip(edges, edges[1:], strict=False):
            ends = np.cumsum(size[a:b])
            begin = ends - size[a:b]
            at = np.arange(int(size[a:b].sum())) + np.repeat(first[a:b] - begin, size[a:b])
            met = np.append(0, np.cumsum(self.met[self._slots(words[at], np.repeat(self.salt[item[a:b]], size[a:b]))]))
            out[a:b] = met[ends] - met[begin]
        return out


def window_starts(items: DataFrame, block: int) -> DataFrame:
    """item_id, text, starts, hash: the first words of the windows of two blocks of each distinct item with words, each block with the next one, if there is one."""

    def cut(batches):
        for batch in batches:
            starts = [list(range(0, max(n - block, 1), block)) if (n := len(word_hashes(t.as_py().encode()))) else [] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int64()))], names=["item_id", "text", "starts"])

    cuts = items.distinct().mapInArrow(cut, "item_id long, text string, starts array<long>")
    return cuts.where("size(starts) > 0").withColumn("hash", F.xxhash64("item_id", "text"))


def leaks(docs: DataFrame, benchmark: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id, item_id, cosine, similarity, first_word: verified leaks, one row a pair.

    Null texts and texts without words leak nothing and are not leaked. Rows that repeat a document id give one row a pair,
    that of the largest similarity, then the smallest first word; null ids stay and count as one document. Other columns are
    ignored. Without documents or items the result is empty.
    """
    o = options or Options()
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, similarity double, first_word long")
    windows = stored(window_starts(items, o.block), "items")
    total = windows.agg(F.sum(F.size("starts")).alias("n")).first().n or 0
    passes = -(-total // o.windows_per_pass)
    if passes:
        words = numbered_words(docs)
        frequency, n_docs = document_frequencies(words, o.weight_slots)
        idf = inverse_frequencies(frequency, n_docs)
        fitted, n_fitted = windows.select("text", "starts"), total
        if o.sample_windows is not None and o.sample_windows < total:
            cuts = windows.select("hash", "text", F.explode("starts").alias("start"))
            fitted, n_fitted = hashed_sample(cuts, F.struct("hash", "start"), o.sample_windows, total).select("text", F.array("start").alias("starts")), o.sample_windows
        basis = latent_space(words, n_docs, fitted, n_fitted, idf, o)
    for k in range(passes):
        # by hash, so each pass has about its share of the windows
        own = F.filter("starts", lambda start: F.pmod(F.xxhash64("hash", start), F.lit(passes)) == F.lit(k))  # noqa: B023
        rows = windows.select("item_id", "text", own.alias("starts")).where("size(starts) > 0").collect()
        named = [(r.item_id, word_hashes(r.text.encode()), r.starts) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id, r.text))]
        if named:
            out = out.union(_leaks_of(docs, named, idf, basis, o))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("order"), "cosine")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.similarity", (-F.col("best.order")).alias("first_word"))


def _leaks_of(docs: DataFrame, items: list[tuple[int, np.ndarray, list[int]]], idf: np.ndarray, basis: np.ndarray, o: Options) -> DataFrame:
    cuts = [(i, a) for i, (_, _, starts) in enumerate(items) for a in starts]
    passages = [items[i][1][a : a + 2 * o.block] for i, a in cuts]
    item_vectors = np.stack([idf[_features(w, len(idf))] @ basis[_features(w, len(basis))] for w in passages])
    shipped = docs.sparkSession.sparkContext.broadcast((basis, _normal(item_vectors).astype(np.float32).T.copy(), idf, cuts, [(i, w.tolist()) for i, w, _ in items]))  # bounded: features x rank, slots and a block of items

    def near(vectors: np.ndarray, items_t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        together = max(_BLOCKS, (1 << 18) // items_t.shape[1])  # few items are compared with more windows at a time
        places, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for a in range(0, len(vectors), together):
            part = (vectors[a : a + together] @ items_t).ravel()
            at = np.flatnonzero(part >= o.cosine)
            places.append(at + a * items_t.shape[1])
            cosines.append(part[at])
        window, cut = np.divmod(np.concatenate(places), items_t.shape[1])
        return window, cut, np.concatenate(cosines)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items_t, idf, cuts, named = shipped.value
        item_of, into = np.array(cuts, np.int64).T
        lengths, item_words = np.array([len(w) for _, w in named], np.int64), ItemWords([w for _, w in named])

        def found(ids: list, texts: list[np.ndarray]) -> list[tuple]:
            windows = Windows(texts, idf, len(table), o.block)
            vectors, doc, start = windows.pairs(windows.sums(table))
            w, c, cosine = near(_normal(vectors), items_t)
            d, i, first = doc[w], item_of[c], start[w] - into[c]
            # windows that put the item at the same place are one candidate, with the largest cosine, then the last first word
            order = np.lexsort((first, cosine, first // o.block, i, d))
            d, i, first, cosine = d[order], i[order], first[order], cosine[order]
            same = (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (first[1:] // o.block == first[:-1] // o.block)
            best = np.flatnonzero(np.append(~same, True)[: len(d)])
            d, i, first, cosine = d[best], i[best], first[best], cosine[best]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            lo, hi = np.maximum(0, first - lengths[i]), np.minimum(first + np.maximum(2 * o.block, lengths[i]) + lengths[i], size[d])
            # most candidates lack too many of the item's words
            keep = item_words.most(np.concatenate(texts), (np.cumsum(size) - size)[d] + lo, hi - lo, i) >= o.similarity * lengths[i]
            out = []
            for d_, i_, a, b, near_by in zip(*(x[keep].tolist() for x in (d, i, lo, hi, cosine)), strict=True):
                item_id, item = named[i_]
                share, answered, at = best_stretch(item, texts[d_][a:b].tolist(), o)
                if share >= o.similarity * len(item) and answered:
                    out.append((ids[d_], item_id, near_by, share / len(item), a + at))
            return out

        for batch in batches:
            for part in parts(batch, 1, 1 << 20):
                ids, texts, rows, held = [], [], [], 0
                for doc, words in zip(part.column(0).to_pylist(), hashes_of([(t.as_py() or "").encode() for t in part.column(1)]), strict=True):
                    ids.append(doc)
                    texts.append(words)
                    held += len(words)
                    if held >= 16_000:
                        rows += found(ids, texts)
                        ids, texts, held = [], [], 0
                if ids:
                    rows += found(ids, texts)
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))

    return docs.mapInArrow(search, "doc_id long, item_id long, cosine double, similarity double, first_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
