"""Problem 3: near-duplicate records with small edits, by multi-index hashing.

A record's fingerprint is a string of ``SEGMENTS`` x ``WIDTH`` symbols, each the smallest hash of the
record's words under one of as many hash functions; two records differ in a symbol as often as their
words differ, so the Hamming distance of fingerprints measures the Jaccard distance of the word sets.
Within each segment the Hamming ball of radius one is enumerated: every way to leave out one of its
symbols gives a key, and records that share a key are within the ball in that segment. Table matches
are checked by the complete distance of fingerprints, then exactly on the words.

Words that stand in more than ``COMMON`` of all records tell nothing, and are left out of fingerprints
(not of the exact check); the counts are taken over all records. There are at most 1/COMMON times the
mean number of words of them, whatever the input, so the list is bounded. Equal word sets are one
record until the end, so copies cost nothing. Records of a hot key are told apart by a second, independent
fingerprint before they are paired, so a key that many unlike records share costs no pairs of all. With pairs of similarity 0.7 and more the
chance to share no key is about one in five thousand on code.

Cases: null and empty texts and records of fewer than ``min_words`` distinct words form no pairs;
repeated rows under other ids are pairs; ids must be unique and not null; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import connected_components, cut, stored
from ..sources.tables import batches

SEGMENTS, WIDTH = 10, 5
COMMON = 0.12
DOUBT = 0.25  # share of equal symbols (one byte of each is compared) below which a match is dropped
HOT = 128  # records of a key from which it is told apart further
BROADCAST_IDS = 500_000  # ids sent to every task at most, some megabytes
VOCABULARY = 400_000  # word hashes remembered in a process
_WORD = re.compile(r"[A-Za-z0-9_]+")
WORDS_SQL = "array_distinct(regexp_extract_all({}, '([A-Za-z0-9_]+)', 1))"


def _narrow(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return records.select(F.col(id_col).alias("rid"), F.col(text_col).alias("own_text")).filter(F.col("rid").isNotNull() & F.col("own_text").isNotNull())


def common_words(narrow: DataFrame, min_words: int, share: float = COMMON) -> list[str]:
    """The words of more than ``share`` of the records that have ``min_words``; counted over all, each part adding up its own first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, n = Counter(), 0
        for f in frames:
            for text in f["own_text"]:
                words = set(_WORD.findall(text))
                if len(words) >= min_words:
                    n += 1
                    count.update(words)
            if len(count) > 500_000:
                yield pd.DataFrame({"word": list(count), "n": list(count.values())})
                count = Counter()
        yield pd.DataFrame({"word": [*count, ""], "n": [*count.values(), n]})

    counts = narrow.select("own_text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.filter((F.col("word") != "") & (F.col("n") > share * total)).select("word").collect()]


class Signer:
    """Fingerprints of word sets, and their keys. ``part`` numbers families of hash functions that know nothing of each other."""

    def __init__(self, part: int = 0):
        rng = np.random.default_rng(3 + part)
        n = SEGMENTS * WIDTH
        self.a, self.b = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)
        self.weights = np.random.default_rng(5).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.random.default_rng(7 + part).integers(0, 2**63, (SEGMENTS, WIDTH), dtype=np.uint64)
        self.hashes: dict[str, int] = {}

    def symbols(self, words: set[str]) -> np.ndarray:
        """The fingerprint: for each hash function the smallest hash of the words."""
        if len(self.hashes) > VOCABULARY:
            self.hashes.clear()
        known = self.hashes
        vals = [known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
        v = np.array(vals, np.uint64)
        return ((v[:, None] * self.a + self.b) >> np.uint64(33)).min(0)

    def balls(self, symbols: np.ndarray) -> np.ndarray:
        """The keys of a fingerprint: in each segment, one for each symbol left out."""
        x = (symbols.astype(np.uint64) + np.uint64(0x9E3779B9)) * self.weights
        x ^= x >> np.uint64(29)
        x = (x * np.uint64(0xBF58476D1CE4E5B9)).reshape(SEGMENTS, WIDTH)
        k = (x.sum(1, dtype=np.uint64)[:, None] - x + self.salt) * np.uint64(0x94D049BB133111EB)
        return (k ^ (k >> np.uint64(31))).astype(np.int64).ravel()

    def keys(self, words: set[str]) -> np.ndarray:
        return self.balls(self.symbols(words))


def fingerprints(narrow: DataFrame, min_words: int, left_out: list[str], part: int = 0) -> DataFrame:
    """rid, set_hash (16 bytes of the whole word set) and symbols (ints) of every record with min_words."""
    kind = dict(narrow.dtypes)["rid"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, signer = frozenset(left_out), Signer(part)
        for f in frames:
            rows = []
            for rid, text in zip(f["rid"], f["own_text"]):
                words = set(_WORD.findall(text))
                if len(words) < min_words:
                    continue
                rows.append((rid, xxhash.xxh3_128_digest("\n".join(sorted(words))), signer.symbols(words - out or words).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["rid", "set_hash", "symbols"])

    return narrow.mapInPandas(run, f"rid {kind}, set_hash binary, symbols array<int>")


def rows_of(table: DataFrame, ids: DataFrame, column: str = "rid") -> DataFrame:
    """The rows of the table whose id is among the distinct ids. Ids of at most BROADCAST_IDS rows are sent to every task,
    so the texts stay where they are; more are joined over the cluster."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def _balls() -> Column:
    """The keys of the column symbols: in each segment, one for each symbol left out."""
    return F.array(*[F.xxhash64(F.lit(s * WIDTH + skip), *[F.col("symbols")[s * WIDTH + i] for i in range(WIDTH) if i != skip]) for s in range(SEGMENTS) for skip in range(WIDTH)])


def meet(table: DataFrame, hot: int = HOT) -> DataFrame:
    """(ra, rb, key): the pairs ra < rb of records with the same key, from (rep, key) rows. A key of more than ``hot``
    records gives no pairs but its rows, with rb null: these have to be told apart further. Rows come sorted and
    are walked once, so no key is ever held whole; the result is a table."""
    kind = dict(table.dtypes)["rep"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_keys, held_reps, hot_key = np.zeros(0, np.int64), np.zeros(0), None

        def pairs(keys: np.ndarray, reps: np.ndarray) -> Iterator[pd.DataFrame]:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(keys)])
            for g in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == g]
                if g > hot:
                    rows = (at[:, None] + np.arange(g)).ravel()
                    yield pd.DataFrame({"ra": reps[rows], "rb": None, "key": keys[rows]})
                    continue
                i, j = np.triu_indices(g, 1)
                yield pd.DataFrame({"ra": reps[(at[:, None] + i).ravel()], "rb": reps[(at[:, None] + j).ravel()], "key": None})

        for f in frames:
            keys, reps = f["key"].to_numpy(), f["rep"].to_numpy()
            if hot_key is not None:
                n = int((keys == hot_key).sum())  # sorted, so these come first
                yield pd.DataFrame({"ra": reps[:n], "rb": None, "key": keys[:n]})
                if n == len(keys):
                    continue
                keys, reps, hot_key = keys[n:], reps[n:], None
            if len(held_keys):
                keys, reps = np.r_[held_keys, keys], np.r_[held_reps, reps]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield from pairs(keys[:last], reps[:last])
            held_keys, held_reps = keys[last:], reps[last:]
            if len(held_keys) > hot:
                yield from pairs(held_keys, held_reps)
                hot_key, held_keys, held_reps = held_keys[0], held_keys[:0], held_reps[:0]
        yield from pairs(held_keys, held_reps)

    with batches(table.sparkSession, 50_000):
        return stored(table.repartition("key").sortWithinPartitions("key", "rep").mapInPandas(run, f"ra {kind}, rb {kind}, key long").distinct(), "meetings")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ra, rb): all pairs of the (rep, key) rows of a key, formed block by block of ``size`` rows, each two blocks on their own."""
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    placed = rows.join(n, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = placed.select("rep", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("rep", "own", "other", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    x, y = cells.filter("own <= other").alias("x"), cells.filter("own >= other").alias("y")
    met = x.join(y, F.col("x.cell") == F.col("y.cell")).filter((F.col("x.own") < F.col("x.other")) | (F.col("x.rep") < F.col("y.rep"))).filter("x.rep <> y.rep")
    return met.select(F.least("x.rep", "y.rep").alias("ra"), F.greatest("x.rep", "y.rep").alias("rb"))


def candidates(reps: DataFrame, narrow: DataFrame, min_words: int, left_out: list[str], hot: int = HOT) -> DataFrame:
    """(ra, rb): the pairs of representatives that share a key. The records of a hot key are told apart by the keys of a
    second fingerprint, of hash functions of its own; records that are still many to a key lie within the
    ball twice, and are paired block by block."""
    first = meet(reps.select(F.col("rep"), F.explode(_balls()).alias("key")), hot)
    pairs, crowd = first.filter("rb IS NOT NULL").select("ra", "rb"), first.filter("rb IS NULL").select(F.col("ra").alias("rep"), "key")
    if not crowd.isEmpty():
        texts = rows_of(narrow, crowd.select(F.col("rep").alias("rid")).distinct())
        again = fingerprints(texts, min_words, left_out, part=1).select(F.col("rid").alias("rep"), F.explode(_balls()).alias("ball"))
        second = meet(crowd.join(again, "rep").select("rep", F.xxhash64("key", "ball").alias("key")), hot)
        rest = second.filter("rb IS NULL").select(F.col("ra").alias("rep"), "key")
        pairs = pairs.unionByName(second.filter("rb IS NOT NULL").select("ra", "rb")).unionByName(_blocks(rest, hot))
    return pairs.distinct()


def similar_pairs(records: DataFrame, id_col: str = "id", text_col: str = "source", threshold: float = 0.7, min_words: int = 30, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has rid and its representative rep, the smallest id with the same word set;
    links has pairs of representatives ra < rb whose similarity reaches the threshold, and the similarity."""
    narrow = _narrow(records, id_col, text_col)
    left_out = common_words(narrow, min_words)
    prints = stored(fingerprints(narrow, min_words, left_out), "prints")
    reps = prints.groupBy("set_hash").agg(F.min_by(F.struct("rid", "symbols"), "rid").alias("x")).select("set_hash", F.col("x.rid").alias("rep"), F.col("x.symbols").alias("symbols"))
    reps = stored(reps, "representatives")
    members = prints.select("rid", "set_hash").join(reps.select("set_hash", "rep"), "set_hash").select("rid", "rep")
    found = candidates(reps, narrow, min_words, left_out, hot)
    # the complete distance of the fingerprints
    small = reps.select("rep", F.transform("symbols", lambda x: (F.pmod(x, F.lit(256)) - F.lit(128)).cast("tinyint")).alias("print"))
    pairs = found.join(small.select(F.col("rep").alias("ra"), F.col("print").alias("pa")), "ra").join(small.select(F.col("rep").alias("rb"), F.col("print").alias("pb")), "rb")
    equal = F.size(F.filter(F.zip_with("pa", "pb", lambda p, q: p == q), lambda x: x))
    pairs = cut(pairs.filter(equal >= DOUBT * SEGMENTS * WIDTH).select("ra", "rb"))
    # the exact similarity of the words, read again for the few records left
    wanted = pairs.select(F.col("ra").alias("rid")).union(pairs.select(F.col("rb").alias("rid"))).distinct()
    words = rows_of(narrow, wanted).select("rid", F.expr(WORDS_SQL.format("own_text")).alias("words"))
    both = pairs.join(words.select(F.col("rid").alias("ra"), F.col("words").alias("wa")), "ra").join(words.select(F.col("rid").alias("rb"), F.col("words").alias("wb")), "rb")
    shared = F.size(F.array_intersect("wa", "wb"))
    links = both.select("ra", "rb", shared.alias("s"), (F.size("wa") + F.size("wb") - shared).alias("u")).filter(F.col("s") >= F.lit(threshold) * F.col("u") - 1e-9)
    return members, links.select("ra", "rb", (F.col("s") / F.col("u")).alias("similarity"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b of all pairs of records: of every two members of linked representatives, and of equal ones."""
    left, right = members.select(F.col("rid").alias("p"), F.col("rep").alias("ra")), members.select(F.col("rid").alias("q"), F.col("rep").alias("rb"))
    crossed = links.select("ra", "rb").join(left, "ra").join(right, "rb").select("p", "q")
    equal = left.join(right, F.col("ra") == F.col("rb")).filter("p < q").select("p", "q")
    return crossed.unionByName(equal).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """rid, class_id, n_links of every record: class_id is the smallest record reached through links and copies,
    n_links counts the other representatives linked to the record's own."""
    links = cut(links.select("ra", "rb"))  # read by the components and by the degrees
    parts = connected_components(links, "ra", "rb")
    degree = links.select(F.col("ra").alias("rep")).union(links.select(F.col("rb").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select("rid", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
