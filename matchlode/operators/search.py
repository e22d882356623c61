"""Exact top-k search in two channels: character n-grams and dense vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..storage import cut, freeing, map_arrays, new_folder, save_arrays

#: A vocabulary of more bytes is not sent to the tasks.
BLOCK_BYTES = 64 << 20
#: Bytes of vectors in a shard of the catalog, which tasks map from the shared folder.
SHARD = 96 << 20
#: Vectors of a catalog that are multiplied at once.
TILE = 4096
#: A query's rarest grams are looked at until this angle (see _Postings.search) tells items apart.
WIDE = 1.35
#: Postings that are not worth a choice.
SMALL = 20_000


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Every n-gram of each word with a space on both sides, repeats included; none spans words.

    A padded word no longer than n gives itself once and no longer n-gram.
    """
    words = F.filter(F.split(F.lower(clean_text(text)), " "), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def grams(n: int) -> Column:
            own = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(padded, i, F.lit(n)))
            return F.when(F.lit(n == low) | (size >= n), own).otherwise(F.array().cast("array<string>"))

        return F.concat(*(grams(n) for n in range(low, high + 1)))

    return F.flatten(F.transform(words, of))


def gram_counts(docs: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """key, gram, tf."""
    return docs.select(key, F.explode(char_grams(F.col(text), low, high)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(counts: DataFrame, documents: int, min_df: int = 1, max_features: int | None = 50_000) -> DataFrame:
    """gram, df, idf of the max_features grams with most occurrences (ties: the lesser gram)."""
    grams = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features is not None:
        grams = grams.orderBy(F.desc("total"), "gram").limit(max_features)
    return grams.select("gram", "df", (F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1).alias("idf"))


def postings(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, gram, weight: (1 + ln tf) * idf, scaled to length 1 over the grams of the vocabulary."""
    raw = counts.join(vocabulary.select("gram", "idf"), "gram").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("raw") / F.col("norm")).alias("weight"))


def top_k(scores: DataFrame, query_key: str, ordinal: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by rounded score, then ordinal; rank from 1."""
    if k <= 0:
        raise ValueError("k must be positive")
    rounded = scores.withColumn("score", F.round("score", digits))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(ordinal))
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def word_grams(word: str, low: int, high: int) -> list[str]:
    """char_grams of one normalised word."""
    padded = f" {word} "
    return [padded[i : i + n] for n in range(low, high + 1) if n == low or len(padded) >= n for i in range(max(1, len(padded) - n + 1))]


class _Grams(dict):
    """Grams of words, remembered up to a bound; only those that `place` knows, as numbers, if it is given."""

    def __init__(self, low: int, high: int, place: dict[str, int] | None = None, bound: int = 200_000):
        self.low, self.high, self.place, self.bound = low, high, place, bound

    def __missing__(self, word: str):
        found = word_grams(word, self.low, self.high)
        if self.place is not None:
            found = np.array([self.place[g] for g in found if g in self.place], np.int64)
        if len(self) >= self.bound:
            self.clear()
        self[word] = found
        return found


def gram_statistics(texts: DataFrame, low: int = 3, high: int = 5, held: int = 200_000) -> DataFrame:
    """gram, df, total over a column text. Tasks sum over their rows first, up to about `held` grams; what they send is a row a gram, not a posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, words = _Grams(low, high, bound=20_000), Counter(), Counter()

        def send():
            total = Counter()
            for w, n in words.items():
                for g in known[w]:
                    total[g] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([df[g] for g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "df", "total"])
            df.clear(), words.clear()
            for lo in range(0, out.num_rows, 1 << 16):
                yield out.slice(lo, 1 << 16)

        for batch in batches:
            for text in batch.column("t"):  # one at a time: texts are long
                own = Counter(text.as_py().split(" "))
                own.pop("", None)
                df.update(set(chain.from_iterable(known[w] for w in own)))
                words.update(own)
                if len(df) >= held:
                    yield from send()
        yield from send()

    parts = texts.select(F.lower(clean_text(F.col("text"))).alias("t")).mapInArrow(run, "gram string, df long, total long")
    return parts.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary_of(statistics: DataFrame, documents: int, min_df: int = 1, max_features: int | None = 50_000) -> DataFrame:
    grams = statistics.filter(F.col("df") >= min_df)
    if max_features is not None:
        grams = grams.orderBy(F.desc("total"), "gram").limit(max_features)
    return grams.select("gram", "df", (F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1).alias("idf"))


class Vectoriser:
    """Texts to (places of grams, weights of length 1), under a vocabulary in the order of its places."""

    def __init__(self, place: dict[str, int], idf: np.ndarray, low: int, high: int):
        self.idf, self.known = idf, _Grams(low, high, place)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(w for w in text.split(" ") if w)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        found = [self.known[w] for w in words]
        flat = np.concatenate(found)
        n = np.bincount(flat, np.repeat(list(words.values()), [len(f) for f in found]), len(self.idf)) if len(flat) * 8 > len(self.idf) else None
        if n is None:
            at, back = np.unique(flat, return_inverse=True)
            n = np.bincount(back, np.repeat(list(words.values()), [len(f) for f in found]))
        else:
            at = np.flatnonzero(n)
            n = n[at]
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-300)


def _slices(batch: pa.RecordBatch, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `rows` rows and about `size` bytes."""
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def _vectors(docs: DataFrame, vocabulary: DataFrame, key: str, low: int, high: int, bound: int) -> tuple[DataFrame, Callable[[], Callable]]:
    """Rows (key, other columns of docs) that hold what a task needs, and what makes it: a reader of (places of grams, weights) of a batch.

    A vocabulary of at most `bound` bytes is sent to the tasks, so that vectors exist only where they are used;
    the places of a larger one are hashes, and its weights are joined to the grams of distinct words.
    """
    spark, rest = docs.sparkSession, [c for c in docs.columns if c not in (key, "text")]
    if 64 * vocabulary.count() > bound:
        rows = _joined_vectors(docs, vocabulary, key, low, high)

        def read():
            return lambda batch: [(np.frombuffer(a, np.int64), np.frombuffer(w)) for a, w in zip(batch.column("at").to_pylist(), batch.column("weight").to_pylist())]

        return rows, read
    known = vocabulary.select("gram", "idf").orderBy("gram").collect()  # at most `bound` bytes
    shared = spark.sparkContext.broadcast(([r.gram for r in known], np.array([r.idf for r in known])))

    def vectorise():
        grams, idf = shared.value
        of = Vectoriser({g: i for i, g in enumerate(grams)}, idf, low, high)
        return lambda batch: [of(t) for t in batch.column("t").to_pylist()]

    return docs.select(F.col(key).alias("key"), *rest, F.lower(clean_text(F.col("text"))).alias("t")), vectorise


def _joined_vectors(docs: DataFrame, vocabulary: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """key, other columns, at, weight: bytes of vectors whose weights come by joins over distinct words."""
    kind, rest = docs.schema[key].dataType.simpleString(), [c for c in docs.columns if c not in (key, "text")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                own = [Counter(w for w in t.split(" ") if w) for t in part.column("t").to_pylist()]
                keys = part.column("key").take(pa.array(np.repeat(np.arange(len(own)), [len(c) for c in own])))
                yield pa.RecordBatch.from_arrays([keys, pa.array([w for c in own for w in c], pa.string()), pa.array([n for c in own for n in c.values()], pa.int64())], names=["key", "word", "n"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 4096):
                own = [(w, Counter(word_grams(w, low, high))) for w in part.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, c in own for _ in c], pa.string()), pa.array([g for _, c in own for g in c], pa.string()), pa.array([n for _, c in own for n in c.values()], pa.int64())], names=["word", "gram", "times"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                cells = []
                for v in part.column("v"):
                    found = [(x["n"], x["cell"]) for x in v.as_py() if x["cell"]]
                    if not found:
                        cells.append((b"", b""))
                        continue
                    whole = np.concatenate([np.frombuffer(c, np.int64).reshape(3, -1) for _, c in found], axis=1)
                    at, first, back = np.unique(whole[0], return_index=True, return_inverse=True)
                    tf = np.bincount(back, whole[1] * np.repeat([n for n, _ in found], [len(c) // 24 for _, c in found]))
                    x = (1 + np.log(tf)) * whole[2].view(np.float64)[first]
                    cells.append((at.tobytes(), (x / max(np.sqrt((x * x).sum()), 1e-300)).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))], names=["key", "at", "weight"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 4096):
                v = part.column("v")
                ends, own = np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))], v.flatten()
                whole = np.stack([own.field("at").to_numpy(), own.field("times").to_numpy(), own.field("idf").to_numpy().view(np.int64)])
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.array([whole[:, i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())], names=["word", "cell"])

    words = docs.select(F.col(key).alias("key"), F.lower(clean_text(F.col("text"))).alias("t")).mapInArrow(counted, f"key {kind}, word string, n long")
    spelling = words.select("word").distinct().mapInArrow(spelt, "word string, gram string, times long")
    lists = spelling.join(vocabulary.select("gram", "idf"), "gram").groupBy("word").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("at"), "times", "idf")).alias("v"))  # one word's grams
    cells = words.join(lists.mapInArrow(packed, "word string, cell binary"), "word").select("key", "n", "cell")
    every = cells.unionByName(docs.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("cell")))
    made = every.groupBy("key").agg(F.collect_list(F.struct("n", "cell")).alias("v")).mapInArrow(weighed, f"key {kind}, at binary, weight binary")  # one text's words
    return made.join(docs.select(F.col(key).alias("key"), *rest), "key") if rest else made


class _Best:
    """The k best items of each of n queries so far: by score, then ordinal."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.row = self.shard = self.item = self.ordinal = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, row: np.ndarray, score: np.ndarray, ordinal: np.ndarray, shard: int, item: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ordinal, item = (np.r_[a, b] for a, b in ((self.row, row), (self.score, score), (self.ordinal, ordinal), (self.item, item)))
        shard = np.r_[self.shard, np.full(len(row) - len(self.shard), shard)]
        order = np.lexsort((ordinal, -score, row))
        sorted_row = row[order]
        first = np.flatnonzero(np.r_[True, sorted_row[1:] != sorted_row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        keep = order[rank < self.k]
        self.row, self.score, self.ordinal, self.shard, self.item = row[keep], score[keep], ordinal[keep], shard[keep], item[keep]
        full = order[rank == self.k - 1]
        self.least[row[full]] = score[full]


class _Postings:
    """A shard of sparse vectors, by gram and by item."""

    def __init__(self, a: dict[str, np.ndarray], k: int, digits: int):
        self.grams, self.group, self.share, self.first, self.item, self.weight = (a[n] for n in ("grams", "group", "share", "first", "item", "weight"))
        self.start, self.gram, self.value, self.ordinal = a["start"], a["gram"], a["value"], a["ordinal"]
        self.n, self.k, self.digits, self.slack = len(self.ordinal), k, digits, 0.6 * 10.0**-digits
        self.sums, self.mark, self.own = np.zeros(self.n), np.zeros(self.n, np.int64), np.zeros(max(1, len(self.first) - 1))

    @staticmethod
    def arrays(at: list[np.ndarray], weight: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Grams of the same items in the same proportions (those of one word, mostly) are a group with one list.

        group, share: of each gram. An item's weight in a group is its length over the group's grams, and a
        query's is the sum of share * weight, so that products stay as they are.
        """
        grams, gram = np.unique(np.concatenate(at), return_inverse=True)
        value, item = np.concatenate(weight), np.repeat(np.arange(len(at), dtype=np.int32), [len(a) for a in at])
        order = np.argsort(gram.astype(np.int32), kind="stable")
        gram, value, item = gram[order], value[order], item[order]
        n = np.bincount(gram, minlength=len(grams))
        first = np.cumsum(n) - n
        lead = value[first] if len(grams) else np.zeros(0)
        ratio = value / np.repeat(lead, n)
        if len(grams):
            marks = np.random.default_rng(0).integers(1, 1 << 62, len(at))
            same, near = np.add.reduceat(marks[item], first), np.add.reduceat(ratio * (1 + marks[item] / (1 << 62)), first)
            order = np.lexsort((near, same, n))
            new = np.r_[True, (n[order][1:] != n[order][:-1]) | (same[order][1:] != same[order][:-1]) | (np.abs(np.diff(near[order])) > 1e-9 * n[order][1:])]
            head = np.empty(len(grams), np.int64)
            head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            flat = np.arange(len(item)) + np.repeat(first[head] - first, n)  # the same posting of the head's list
            off = np.logical_or.reduceat((item != item[flat]) | (np.abs(ratio - ratio[flat]) > 1e-9), first)
            head[off] = np.flatnonzero(off)
        else:
            head = np.zeros(0, np.int64)
        heads, group = np.unique(head, return_inverse=True)
        length = np.sqrt(np.bincount(group, lead * lead, len(heads)))
        own = np.repeat(head == np.arange(len(grams)), n)
        posted, item = group[gram[own]], item[own]
        order = np.argsort(posted.astype(np.int32), kind="stable")
        posted, item = posted[order], item[order]
        value = ratio[own][order] * length[posted]
        back = np.argsort(item, kind="stable")
        ends = lambda x, size: np.r_[0, np.cumsum(np.bincount(x, minlength=size))].astype(np.int64)
        return {
            "grams": grams, "group": group.astype(np.int32), "share": lead / length[group], "first": ends(posted, len(heads)), "item": item, "weight": value,
            "start": ends(item, len(at)), "gram": posted[back].astype(np.int32), "value": value[back],
        }

    def _summed(self, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Items that have one of the grams, each once; self.sums holds their products until it is cleared."""
        spans = list(zip(self.first[g].tolist(), self.first[g + 1].tolist()))
        items = np.concatenate([self.item[a:b] for a, b in spans]).astype(np.int64)
        np.add.at(self.sums, items, np.concatenate([self.weight[a:b] * x for (a, b), x in zip(spans, w.tolist())]))
        self.mark[items] = np.arange(len(items))
        return items[self.mark[items] == np.arange(len(items))]

    def _exact(self, items: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of items that have a gram at least."""
        self.own[g] = w
        lo, n = self.start[items], self.start[items + 1] - self.start[items]
        begin = np.cumsum(n) - n
        flat = np.arange(begin[-1] + n[-1]) + np.repeat(lo - begin, n)
        out = np.add.reduceat(self.value[flat] * self.own[self.gram[flat]], begin)
        self.own[g] = 0
        return out

    def _every(self, g: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.arange(n.sum()) + np.repeat(self.first[g] - (np.cumsum(n) - n), n)
        s = np.round(np.bincount(self.item[flat], self.weight[flat] * np.repeat(w, n), self.n), self.digits)
        at = np.arange(self.n) if self.n <= self.k else np.flatnonzero(s >= np.partition(s, self.n - self.k)[self.n - self.k])
        if len(at) > self.k:  # ties at the k-th score stay until the order by ordinal
            at = at[np.lexsort((self.ordinal[at], -s[at]))[: self.k]]
        return at, s[at]

    def search(self, at: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Items and rounded scores: all that can be among the k best and reach `least`, the k-th score so far.

        An item of score t shares enough with the query's rarest grams: with norm a over those and s over
        the others, an item whose sum over the rarest is p reaches at most p + s * sqrt(1 - p^2 / a^2).
        Items below that are left; the others get their exact score.
        """
        if not len(self.grams) or not len(at):
            place = np.zeros(0, np.int64)
            w = np.zeros(0)
        else:
            place = np.minimum(np.searchsorted(self.grams, at), len(self.grams) - 1)
            hit = self.grams[place] == at
            own, back = np.unique(self.group[place[hit]], return_inverse=True)
            place, w = own, np.bincount(back, weight[hit] * self.share[place[hit]], len(own))
        n = self.first[place + 1] - self.first[place]
        t = least - self.slack
        if n.sum() + self.n < SMALL + 100 * len(place) or not len(place):
            return self._every(place, w, n) if t <= 0 or len(place) else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(n, kind="stable")
        g, w, n = place[order], w[order], n[order]
        a2 = np.cumsum(w * w)
        if t <= 0:  # a first bound: the k-th exact score of those that share most with half of the query
            j = int(np.searchsorted(a2, 0.5 * a2[-1])) + 1
            found = self._summed(g[:j], w[:j])
            sums = self.sums[found]
            self.sums[found] = 0
            if len(found) < self.k:
                return self._every(g, w, n)
            many = min(len(found), 2 * self.k + 8)
            some = self._exact(found[np.argpartition(sums, len(found) - many)[len(found) - many :]], g, w)
            t = np.round(np.partition(some, many - self.k)[many - self.k], self.digits) - self.slack
            if t <= 0:
                return self._every(g, w, n)
        whole = np.sqrt(a2[-1])
        if whole * (1 + 1e-12) < t:
            return np.zeros(0, np.int64), np.zeros(0)
        angle = np.arctan2(np.sqrt(np.maximum(0, a2[-1] - a2)), np.sqrt(a2)) + np.arccos(min(1.0, t / whole))
        enough = np.flatnonzero(angle < WIDE)
        if not len(enough):
            return self._every(g, w, n)
        j = int(enough[0]) + 1
        found = self._summed(g[:j], w[:j])
        sums = self.sums[found]
        self.sums[found] = 0
        found = found[sums >= np.sqrt(a2[j - 1]) * np.cos(angle[j - 1]) - 1e-9]
        if not len(found):
            return found, np.zeros(0)
        if len(found) * len(self.gram) > n.sum() * self.n * 2:  # more work than all postings
            return self._every(g, w, n)
        s = np.round(self._exact(found, g, w), self.digits)
        keep = s >= t
        return found[keep], s[keep]


def _sharded(rows: DataFrame, arrays: Callable, reader: Callable, tag: str, block: int) -> list[str]:
    """URIs of files that tasks write to the shared folder: arrays of rows (key, ordinal, ..), about `block` bytes of vectors each."""
    folder = new_folder(rows.sparkSession, tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = reader(), [], 0

        def send() -> str:
            keys = pa.Table.from_arrays([pa.chunked_array([c for c, _, _ in held])], names=["key"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as out:
                out.write_table(keys.combine_chunks())
            return save_arrays(folder, {"ordinal": np.concatenate([o for _, o, _ in held]), "keys": np.frombuffer(sink.getvalue(), np.uint8)} | arrays([v for _, _, vs in held for v in vs]))

        for batch in batches:
            for part in _slices(batch):
                found = of(part)
                held.append((part.column("key"), part.column("ordinal").to_numpy(zero_copy_only=False).astype(np.int64), found))
                size += sum(x.nbytes for v in found for x in (v if isinstance(v, tuple) else (v,))) + 16 * len(found)
                if size >= block:
                    yield pa.RecordBatch.from_arrays([pa.array([send()])], names=["uri"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([send()])], names=["uri"])

    with freeing(rows.sparkSession):
        return sorted(r.uri for r in rows.mapInArrow(run, "uri string").collect())  # a row a shard


def _parted(items: DataFrame, size: int, block: int) -> DataFrame:
    """As many parts as there are shards, or enough for all cores."""
    return items.repartition(max(1, min(-(-size // block), 4 * items.sparkSession.sparkContext.defaultParallelism)))


def _dealt(queries: DataFrame) -> DataFrame:
    """Enough parts for all cores."""
    parts = 4 * queries.sparkSession.sparkContext.defaultParallelism
    return queries.repartition(parts) if queries.rdd.getNumPartitions() < parts else queries


def _searched(queries: DataFrame, reader: Callable, uris: list[str], product: Callable, k: int, kinds: list[str]) -> DataFrame:
    """query, key, ordinal, score: the k best of each query. product(arrays of a shard) gives what adds a shard's items to a _Best.

    A task takes a slice of its queries through all shards, which are mapped, so that its memory is a slice's
    and the k-th score so far bounds what later shards have to look at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shards = reader(), [None] * len(uris)
        for batch in batches:
            for part in _slices(batch):
                asked = of(part)
                best = _Best(len(asked), k)
                for i, uri in enumerate(uris):
                    if shards[i] is None:
                        shards[i] = map_arrays(uri)
                    product(shards[i])(asked, best, i)
                if len(best.row):
                    order = np.argsort(best.shard, kind="stable")
                    ends = np.searchsorted(best.shard[order], np.arange(len(uris) + 1))
                    found = [pa.ipc.open_stream(pa.py_buffer(shards[i]["keys"])).read_all().column("key").combine_chunks().take(pa.array(best.item[order[lo:hi]])) for i, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
                    keys = pa.chunked_array(found).combine_chunks()
                    query = part.column("key").take(pa.array(best.row[order]))
                    yield pa.RecordBatch.from_arrays([query, keys, pa.array(best.ordinal[order]), pa.array(best.score[order])], names=["query", "key", "ordinal", "score"])

    return queries.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, ordinal long, score double")


def lexical_search(queries: DataFrame, catalog: DataFrame, vocabulary: DataFrame, k: int, query_key: str = "google_id", catalog_key: str = "amazon_id", low: int = 3, high: int = 5, digits: int = 6, bound: int = BLOCK_BYTES, block: int = SHARD) -> DataFrame:
    """query_key, catalog_key, ordinal, score, rank by cosine under a fitted vocabulary; every query gets min(k, catalog) rows.

    Exact: each query meets all shards of the catalog's postings, whatever the sizes. bound: of _vectors.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    items = catalog.select(catalog_key, F.col("ordinal").cast("long").alias("ordinal"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rows, reader = _vectors(_parted(items, 24 * size, block), vocabulary, catalog_key, low, high, bound)
    uris = _sharded(rows, lambda vs: _Postings.arrays(*map(list, zip(*vs))), reader, "postings", block)
    kinds = [queries.schema[query_key].dataType.simpleString(), catalog.schema[catalog_key].dataType.simpleString()]

    def product(arrays: dict[str, np.ndarray]) -> Callable:
        own = arrays.get("_own")
        if own is None:
            own = arrays["_own"] = _Postings(arrays, k, digits)

        def add(asked: list, best: _Best, shard: int) -> None:
            found = [own.search(np.asarray(at, np.int64), w, best.least[q]) for q, (at, w) in enumerate(asked)]
            item = np.concatenate([i for i, _ in found])
            best.add(np.repeat(np.arange(len(found)), [len(i) for i, _ in found]), np.concatenate([s for _, s in found]), own.ordinal[item], shard, item)

        return add

    left, reader = _vectors(_dealt(queries.select(query_key, "text")), vocabulary, query_key, low, high, bound)
    found = _searched(left, reader, uris, product, k, kinds)
    return top_k(found, "query", "ordinal", k, digits).select(F.col("query").alias(query_key), F.col("key").alias(catalog_key), "ordinal", "score", "rank")


def pair_scores(pairs: DataFrame, queries: DataFrame, catalog: DataFrame, vocabulary: DataFrame, query_key: str = "google_id", catalog_key: str = "amazon_id", low: int = 3, high: int = 5, bound: int = BLOCK_BYTES) -> DataFrame:
    """query_key, catalog_key, score of the given pairs alone. Texts meet, not vectors, which are larger; bound: of _vectors."""
    left, reader = _vectors(queries.select(query_key, "text"), vocabulary, query_key, low, high, bound)
    right, _ = _vectors(catalog.select(catalog_key, "text"), vocabulary, catalog_key, low, high, bound)
    cells = [c for c in left.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = reader()

        def vectors(part: pa.RecordBatch, suffix: str) -> list:
            own = [part.column(c + suffix) for c in cells]
            if len(cells) > 1:
                return of(pa.RecordBatch.from_arrays(own, names=cells))
            known = own[0].dictionary_encode()  # a text of many pairs once
            found = of(pa.RecordBatch.from_arrays([known.dictionary], names=cells))
            return [found[i] for i in known.indices.to_pylist()]

        for batch in batches:
            for part in _slices(batch, 4096):
                out = []
                for (a, x), (b, y) in zip(vectors(part, ""), vectors(part, "_2")):
                    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    out.append(float(x[i] @ y[j]))
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("item"), pa.array(out, pa.float64())], names=["query", "item", "score"])

    own = pairs.select(F.col(query_key).alias("query"), F.col(catalog_key).alias("item")).distinct()
    joined = own.join(left.withColumnRenamed("key", "query"), "query").join(right.withColumnsRenamed({"key": "item"} | {c: f"{c}_2" for c in cells}), "item")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("query", "item")]
    return joined.mapInArrow(run, f"query {kinds[0]}, item {kinds[1]}, score double").withColumnsRenamed({"query": query_key, "item": catalog_key})


def lexical_top_k(queries: DataFrame, catalog: DataFrame, k: int, query_key: str = "google_id", catalog_key: str = "amazon_id", min_df: int = 1, max_features: int | None = 50_000, bound: int = BLOCK_BYTES, block: int = SHARD) -> DataFrame:
    """query_key, catalog_key, ordinal, score, rank; the vocabulary is fitted on both sides. catalog also has ordinal."""
    both = queries.select("text").unionByName(catalog.select("text"))
    grams = cut(vocabulary_of(gram_statistics(both), both.count(), min_df, max_features), "vocabulary")
    return lexical_search(queries, catalog, grams, k, query_key, catalog_key, bound=bound, block=block)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def _unit(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Vectors of length 1, null ones empty."""
    found = []
    for v in batch.column("v"):
        x = np.array(v.values.to_numpy(zero_copy_only=False) if v.is_valid else [], np.float64)
        n = np.sqrt((x * x).sum())
        found.append(x / n if 0 < n < np.inf else np.zeros(len(x)))
    return found


def _matrix(vectors: list[np.ndarray], width: int | None = None) -> np.ndarray:
    width = max(map(len, vectors), default=0) if width is None else width
    if {len(v) for v in vectors} - {0, width}:
        raise ValueError("vectors differ in width")
    return np.array([v if len(v) else np.zeros(width) for v in vectors]).reshape(len(vectors), width)


def dense_top_k(queries: DataFrame, catalog: DataFrame, k: int, query_key: str = "google_id", catalog_key: str = "amazon_id", vector: str = "embedding", digits: int = 6, block: int = SHARD) -> DataFrame:
    """query_key, catalog_key, ordinal, score, rank by cosine; every query gets min(k, catalog) rows, and null vectors score 0.

    Shards of the catalog are multiplied in single precision; what can be among the k best gets its
    score in double precision. No vectors pass the driver.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def side(rows: DataFrame, key: str, ordinal) -> DataFrame:
        return rows.select(F.col(key).alias("key"), ordinal.cast("long").alias("ordinal"), F.col(vector).cast("array<double>").alias("v"))

    def arrays(vectors: list[np.ndarray]) -> dict[str, np.ndarray]:
        unit = _matrix(vectors)
        return {"width": np.array([unit.shape[1]]), "unit": unit.ravel(), "short": unit.astype(np.float32).ravel()}

    def product(a: dict[str, np.ndarray]) -> Callable:
        def add(asked: list[np.ndarray], best: _Best, shard: int) -> None:
            n, width, ordinal = len(a["ordinal"]), int(a["width"][0]), a["ordinal"]
            own = max(map(len, asked), default=0)
            if own and width and own != width:
                raise ValueError("vectors differ in width")
            q, c, short = _matrix(asked, own if own else width), a["unit"].reshape(n, width), a["short"].reshape(n, width)
            if not width:
                c, short = np.zeros((n, own)), np.zeros((n, own), np.float32)
            q32, slack = q.astype(np.float32), 0.6 * 10.0**-digits + 2e-7 * (own + 8)
            for lo in range(0, n, TILE):
                s = q32 @ short[lo : lo + TILE].T
                least = best.least - slack
                open_ = np.flatnonzero(np.isinf(least))  # fewer than k so far
                if len(open_) and s.shape[1] > k:
                    least[open_] = np.partition(s[open_], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
                row, item = np.nonzero(s >= least[:, None].astype(np.float32))
                for part in range(0, len(row), 1 << 18):
                    r, i = row[part : part + (1 << 18)], item[part : part + (1 << 18)] + lo
                    exact = np.round(np.einsum("ij,ij->i", q[r], c[i]), digits)
                    keep = exact >= best.least[r]
                    best.add(r[keep], exact[keep], ordinal[i[keep]], shard, i[keep])

        return add

    items = side(catalog, catalog_key, F.col("ordinal"))
    size = items.agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    uris = _sharded(_parted(items, 8 * size, block), arrays, lambda: _unit, "vectors", block)
    kinds = [queries.schema[query_key].dataType.simpleString(), catalog.schema[catalog_key].dataType.simpleString()]
    found = _searched(_dealt(side(queries, query_key, F.lit(0))), lambda: _unit, uris, product, k, kinds)
    return top_k(found, "query", "ordinal", k, digits).select(F.col("query").alias(query_key), F.col("key").alias(catalog_key), "ordinal", "score", "rank")
