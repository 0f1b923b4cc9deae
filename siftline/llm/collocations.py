"""Collocations by SON partitioning: shards are mined whole at lowered support, their phrases counted globally.

A phrase that occurs often enough in all documents occurs often enough, at the support divided by the
number of shards, in one shard at least. So each shard gives its locally frequent phrases, first pairs of
words and then what is made of frequent pairs; the union of the shards has every frequent phrase, and a last
pass over the texts counts the union exactly. A shard grows with the corpus and is mined by many tasks, each
for the phrases that begin alike.

Words are 64-bit hashes that hold the language; phrases are known by a hash chained over their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import common

#: Least occurrences of a phrase, words of the longest one, and phrases returned of each language.
SUPPORT, LONGEST, TOP = 100, 5, 2_000
#: Shards that are mined each on its own; the support in a shard is the ``SHARDS``-th part, rounded up.
SHARDS = 8
#: Words whose windows a task deals out at once, and windows that a mining task should hold.
RUN_WORDS, GROUP_WINDOWS = 1 << 20, 1 << 20
#: Bits of the filters of frequent words and of candidate phrases; a wrong hit costs time only.
WORD_BITS, PHRASE_BITS = 1 << 24, 1 << 26
#: Distinct words or phrases that a task counts before it hands them on.
COUNTED = 1 << 20

_SOFT = np.zeros(256, bool)
_SOFT[[9, 32]] = True
_HARD = np.zeros(256, bool)
_HARD[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~(_SOFT | _HARD)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), "text")


class _Words:
    """The words of a slice of texts: where they are, their hashes, and how many follow in the same piece."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.raw, offsets = common.utf8(part.column("text"))
        inside = _WORD[self.raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        borders = offsets[(offsets > 0) & (offsets < len(self.raw))]
        first[borders] = inside[borders]
        last[borders - 1] = inside[borders - 1]
        self.begins, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.begins, side="right") - 1
        langs = part.column("lang_hash").to_numpy().view(np.uint64)[self.row]
        self.hashes = common.mixed(common.span_hashes(self.raw, self.begins, self.ends, fold=True) + langs)
        # where a piece ends behind a word
        hard = np.cumsum(_HARD[self.raw], dtype=np.int32)[self.begins]
        self.breaks = np.ones(len(self.begins), bool)
        self.breaks[:-1] = (np.diff(self.row) != 0) | (np.diff(hard) != 0)

    def reach(self, words: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """How many words from each one on, ``LONGEST`` at most, are frequent, in one piece, and pairwise frequent.

        ``words`` and ``pairs`` are filters; without ``pairs`` any two words will do.
        """
        usable = _has(words, self.hashes)
        follows = usable.copy()
        follows[-1:] = False
        follows[:-1] &= usable[1:] & ~self.breaks[:-1]
        if pairs is not None:
            at = np.flatnonzero(follows)
            follows[at] = _has(pairs, chained(self.hashes[at], self.hashes[at + 1]))
        out, more = usable.astype(np.int8), follows.copy()
        for k in range(1, LONGEST):
            out += more
            left = max(0, len(more) - k)
            more[:left] &= follows[k:]
            more[left:] = False
        return out


def chained(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The keys of phrases that are one word longer."""
    return common.mixed(key * _STEP + words)


def _filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each hash of the column, in an array of fixed size."""
    words = df.select(
        F.expr(f"shiftright(pmod({column}, {bits}L), 6)").alias("at"),
        F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}L) & 63 as int))").alias("bit"),
    )
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(place, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``hash`` and ``n``; a row without a word has all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        known: dict[int, list] = {}
        for part in common.text_slices(batches, "text"):
            words = _Words(part)
            if not len(words.hashes):
                continue
            langs = part.column("lang").to_pylist()
            for row, n in enumerate(np.bincount(words.row, minlength=len(langs)).tolist()):
                total[langs[row]] = total.get(langs[row], 0) + n
            own, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
            at = zip(first.tolist(), words.begins[first].tolist(), words.ends[first].tolist(), strict=True)
            raw = common.lowered(words.raw).tobytes()
            row = words.row
            for key, n, (w, begin, end) in zip(own.view(np.int64).tolist(), counts.tolist(), at, strict=True):
                if (seen := known.get(key)) is not None:
                    seen[2] += n
                else:
                    known[key] = [langs[row[w]], raw[begin:end].decode(), n]
            if len(known) > COUNTED // 4:
                yield out([(lang, word, key, n) for key, (lang, word, n) in known.items()])
                known = {}
        yield out(
            [(lang, word, key, n) for key, (lang, word, n) in known.items()]
            + [(lang, None, None, n) for lang, n in total.items()]
        )

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] if rows else [()] * 4
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "hash", "n"])

    rows = _source(docs).mapInArrow(run, "lang string, word string, hash long, n long")
    return rows.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


class _Windows:
    """Windows of word hashes with how often each occurs; a window ends early with zeros."""

    def __init__(self, windows: np.ndarray, counts: np.ndarray) -> None:
        """``windows``: a row of hashes for each."""
        self.names, place = np.unique(windows, return_inverse=True)
        place = place.reshape(windows.shape).astype(np.uint64)
        if not len(self.names) or self.names[0]:  # zero is the name of none
            self.names = np.concatenate([np.zeros(1, np.uint64), self.names])
            place += np.uint64(1)
        bits = np.uint64(int(len(self.names) - 1).bit_length())
        at_once = max(1, 63 // max(1, int(bits)))  # names that fit into one sort key
        packed = []
        for k in range(0, place.shape[1], at_once):
            key = place[:, k]
            for j in range(k + 1, min(k + at_once, place.shape[1])):
                key = key << bits | place[:, j]
            packed.append(key)
        order = np.lexsort(packed[::-1])
        other = np.zeros(len(order), bool)
        other[:1] = True
        for key in packed:
            other[1:] |= np.diff(key[order]) != 0
        first = np.flatnonzero(other)
        self.place = place[order][first].astype(np.int64)
        self.counts = np.add.reduceat(counts[order], first) if len(first) else counts[:0]

    @property
    def windows(self) -> np.ndarray:
        return self.names[self.place]

    def frequent(self, support: int, least: int) -> Iterator[np.ndarray]:
        """The word hashes of the phrases that begin a window and occur so often, of each length from ``least`` on."""
        for k in range(least, self.place.shape[1] + 1):
            rows = np.flatnonzero(self.place[:, k - 1])
            if not len(rows):
                return
            own = self.place[rows, :k]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(own, axis=0) != 0).any(axis=1)]))
            often = np.add.reduceat(self.counts[rows], first) >= support
            yield self.names[own[first[often]]]


def _dealt(source: DataFrame, words: np.ndarray, pairs: np.ndarray | None, shards: int, groups: int) -> DataFrame:
    """``shard``, ``bucket`` and the windows of it, in blobs.

    Without a filter of ``pairs`` the windows are pairs of frequent words; with it they are longer and made of
    frequent pairs. Windows that begin with the same two or three words share a bucket. Equal windows of a run
    are one, so that a passage that is everywhere stays small.
    """
    shared = source.sparkSession.sparkContext.broadcast((words, pairs))
    least, width = (2, 2) if pairs is None else (3, LONGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = shared.value
        shard = TaskContext.get().partitionId() % shards
        held: list[np.ndarray] = []
        size = 0
        for part in common.text_slices(batches, "text"):
            own = _Words(part)
            reach = own.reach(bits, wanted)
            at = np.flatnonzero(reach >= least)
            if not len(at):
                continue
            hashes = np.concatenate([own.hashes, np.zeros(width, np.uint64)])
            window = hashes[at[:, None] + np.arange(width)]
            window[np.arange(width) >= reach[at][:, None]] = 0
            held.append(window)
            size += len(window)
            if size >= RUN_WORDS:
                yield from blobs(shard, np.concatenate(held))
                held, size = [], 0
        if held:
            yield from blobs(shard, np.concatenate(held))

    def blobs(shard: int, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Windows(windows, np.ones(len(windows), np.int64))
        windows = own.windows
        key = windows[:, 0]
        for k in range(1, least):
            key = chained(key, windows[:, k])
        bucket = (key % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = []
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            rows.append((shard, int(bucket[order[x]]), *_packed(own.names, own.place[order[x:y]], own.counts[order[x:y]])))
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["shard", "bucket", "names", "windows"])

    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return source.mapInArrow(run, "shard int, bucket int, names binary, windows binary")


def _packed(names: np.ndarray, place: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """The names that the windows use, the frequent ones first, and the windows and counts, compressed byte by byte."""
    used, local, often = np.unique(place, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(used), "<u4")
    rank[order] = np.arange(len(used))
    columns = np.concatenate([rank[local].reshape(place.shape).T.ravel(), counts.astype("<u4")])
    planes = columns.view(np.uint8).reshape(-1, 4).T
    return names[used[order]].tobytes(), zstandard.compress(planes.tobytes(), 1)


def _unpacked(names: bytes, windows: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(windows), np.uint8).reshape(4, -1)
    columns = np.ascontiguousarray(planes.T).view("<u4").reshape(width + 1, -1)
    return np.frombuffer(names, np.uint64)[columns[:width].T], columns[width].astype(np.int64)


def _mined(dealt: DataFrame, support: int, width: int, tasks: int) -> DataFrame:
    """``key`` and ``words`` of the phrases with that support in a shard: pairs, or all longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for shard, bucket, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, bucket) != at:
                    yield from mined(held)
                    at, held, size = (shard, bucket), [], 0
                held.append(_unpacked(*blob, width))
                size += len(held[-1][1])
                if size > 2 * GROUP_WINDOWS:
                    whole = merged(held)
                    held = [(whole.windows, whole.counts)]
                    size = len(whole.counts) // 2  # grows with what is distinct
        yield from mined(held)

    def merged(held: list) -> _Windows:
        return _Windows(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def mined(held: list) -> Iterator[pa.RecordBatch]:
        for phrases in merged(held).frequent(support, min(width, 3)) if held else ():
            key = phrases[:, 0]
            for k in range(1, phrases.shape[1]):
                key = chained(key, phrases[:, k])
            ends = np.arange(len(phrases) + 1, dtype=np.int32) * phrases.shape[1]
            words = pa.ListArray.from_arrays(ends, phrases.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), words], names=["key", "words"])

    rows = dealt.repartition(tasks, "shard", "bucket").sortWithinPartitions("shard", "bucket")
    return rows.mapInArrow(run, "key long, words array<long>").groupBy("key").agg(F.first("words").alias("words"))


def phrase_counts(source: DataFrame, words: np.ndarray, phrases: np.ndarray, groups: int, support: int) -> DataFrame:
    """``key`` and ``n``, exact, of every phrase with that support that the filter of candidates lets pass.

    What a task has counted leaves it as one array for each of ``groups`` groups of keys.
    """
    shared = source.sparkSession.sparkContext.broadcast((words, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = shared.value
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for part in common.text_slices(batches, "text"):
            own = _Words(part)
            reach = own.reach(bits)
            at = np.flatnonzero(reach > 1)
            key = own.hashes[at]
            for k in range(1, LONGEST):
                longer = reach[at] > k
                at = at[longer]
                key = chained(key[longer], own.hashes[at + k])
                there = _has(wanted, key)  # what a frequent phrase begins with is frequent
                at, key = at[there], key[there]
                keys.append(key)
                counts.append(np.ones(len(key), np.int64))
                size += len(key)
            if size > 2 * COUNTED:
                merged, n = _summed(keys, counts)
                keys, counts, size = [merged], [n], len(merged)
                if size > COUNTED:
                    yield dealt(merged, n)
                    keys, counts, size = [], [], 0
        if size:
            yield dealt(*_summed(keys, counts))

    def dealt(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        group = (keys % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
        blobs = [[column[order[x:y]].tobytes() for x, y in cuts] for column in (keys, n)]
        columns = [pa.array(group[order[first]]), *(pa.array(own, pa.binary()) for own in blobs)]
        return pa.RecordBatch.from_arrays(columns, names=["group", "keys", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, size = None, [], [], 0
        for batch in batches:
            for group, own, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != at:
                    yield from often(keys, counts)
                    at, keys, counts, size = group, [], [], 0
                keys.append(np.frombuffer(own, np.uint64))
                counts.append(np.frombuffer(n, np.int64))
                size += len(keys[-1])
                if size > 2 * COUNTED:
                    merged, total = _summed(keys, counts)
                    keys, counts, size = [merged], [total], len(merged) // 2
        yield from often(keys, counts)

    def often(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            own, n = _summed(keys, counts)
            kept = n >= support
            columns = [pa.array(own[kept].view(np.int64)), pa.array(n[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n"])

    counted = source.mapInArrow(run, "group int, keys binary, counts binary")
    return counted.repartition(groups, "group").sortWithinPartitions("group").mapInArrow(summed, "key long, n long")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The words and the phrases with that support.

    Words: ``lang``, ``word``, ``hash``, ``n``, and a row without word and hash with all words of the
    language. Phrases: ``key``, ``words`` (hashes) and ``n``.
    """
    source = _source(docs)
    counted = common.stored(word_counts(docs).where(f"n >= {support} or word is null"), "word-counts")
    total = counted.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    words = _filter(counted.where("word is not null"), "hash", WORD_BITS)
    cores = source.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-total // (shards * GROUP_WINDOWS)), -(-2 * cores // shards), 4)
    tasks = int(min(shards * groups, max(4 * cores, shards * groups // 4)))
    local = -(-support // shards)
    pairs = common.stored(_mined(_dealt(source, words, None, shards, groups), local, 2, tasks), "phrase-pairs")
    usable = _filter(pairs, "key", PHRASE_BITS)
    longer = _mined(_dealt(source, words, usable, shards, groups), local, LONGEST, tasks)
    candidates = pairs.union(common.stored(longer, "longer-phrases"))
    parts = max(2 * cores, -(-candidates.count() // COUNTED))
    counts = phrase_counts(source, words, _filter(candidates, "key", PHRASE_BITS), parts, support)
    phrases = candidates.join(common.stored(counts, "phrase-counts"), "key")
    return counted, common.stored(phrases, "phrases")


def collocations(
    docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS
) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut.

    Columns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``. A null or empty text
    has no words, a null language is ``und``; repeated rows count each; other columns are not read. A
    table without frequent phrases gives no rows. Ties go to the larger count, then to the smaller phrase.
    """
    counted, phrases = frequent_phrases(docs, support, shards)
    words = counted.where("word is not null").select("lang", "word", "hash", "n")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))

    # a phrase longer by one word with the same count swallows its first part and its rest
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, own, n in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "n")), strict=True):
                hashes = np.array(own, np.int64).view(np.uint64)
                heads, size = [hashes[:1]], len(hashes)
                for k in range(1, size):
                    heads.append(chained(heads[-1], hashes[k : k + 1]))
                for k in range(1, size):
                    rest = hashes[k : k + 1]
                    for w in range(k + 1, size):
                        rest = chained(rest, hashes[w : w + 1])
                    out.append((key, n, size, k, int(heads[k - 1].view(np.int64)[0]), int(rest.view(np.int64)[0])))
            arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "a", "size", "k", "head", "rest"])

    cuts = phrases.select("key", "words", "n").mapInArrow(
        parts, "key long, a long, size long, k long, head long, rest long"
    )
    cuts = common.stored(cuts, "phrase-cuts")
    counts = words.select(F.col("hash").alias("of"), F.col("n").alias("f")).union(phrases.select("key", "n"))
    counts = common.stored(counts, "all-counts")
    swallowed = cuts.where("size > 2 and k = 1").select(F.col("rest").alias("of"), "a")
    swallowed = swallowed.union(cuts.where("size > 2 and k = size - 1").select("head", "a"))
    gone = counts.join(swallowed.distinct(), "of").where("a = f").select(F.col("of").alias("key")).distinct()
    left, right = (counts.select(F.col("of").alias(c), F.col("f").alias(f)) for c, f in (("head", "l"), ("rest", "r")))
    scored = cuts.join(gone, "key", "left_anti").join(left, "head").join(right, "rest")
    spelled = phrases.select("key", F.posexplode("words").alias("place", "hash")).join(words.drop("n"), "hash")
    spelled = spelled.groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("own")
    )
    spelled = spelled.select("key", "lang", F.array_join(F.col("own.word"), " ").alias("phrase"))
    scored = scored.join(spelled, "key").join(totals, "lang")
    long = "decimal(19,0)"
    exact = f"cast(1000 * cast(a as {long}) * cast(total as {long}) as decimal(38,0))"
    scored = scored.withColumn("score", F.expr(f"{exact} div (cast(l as {long}) * cast(r as {long}))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ranked = scored.groupBy("lang", "key", "phrase", "a", "total").agg(lowest)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"),
    )
