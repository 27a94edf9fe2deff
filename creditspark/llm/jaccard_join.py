"""N-gram Jaccard join by a token-group matrix.

Tokens. Documents of similar size share a size class. A class cuts the range of shingle hashes into m parts, and the set of a
document's shingles in one part, hashed, is one token. A link differs in at most D shingles (threshold and sizes give D),
which touch at most D parts; with half as many parts more, a third of them is equal. So linked documents share many tokens,
while a frequent shingle alone makes none equal. A document joins the classes of all partners at least as large as itself. Parts
without shingles make no token, but for the rare documents with so many of them that nothing else might be equal.

If two documents must share t tokens of a class, they share one of their M - t + 1 rarest ones. Only these are looked at; a
document whose rarest tokens are all its own is linked with nothing, whatever group it stands near.

Groups. Documents with equal sets are one node, named by a 64-bit hash of the set. The nodes of a token form a group around its least node, the pivot. Nodes
are compared with the pivots of their tokens (linear in the tokens) if they share enough tokens, and links give
components. What may still be missing are links between different components, away from pivots: for these the matrix of
tokens and groups of bounded size is built from the tokens that still hold several components. A query meets the groups whose token
union holds one of its tokens; the group is opened, and its members compared, only if the query's shingles in the group's shingle
union are as many as a link needs.

No pair is made for nodes of one component, so a group of n near copies costs n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .frames import kept, prepare, work_path

#: queries of a block; shingles of a group (a larger set is a group by itself)
BLOCK = 256
GROUP_SHINGLES = 500_000
#: sets that a task remembers, so as to give the tokens of copies once
NODES_SEEN = 200_000


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words = A.Words(offsets, raw, lower=True)
    h = words.hashes()
    at, windows = A.window_hashes(h, words.first, width)
    edge = np.searchsorted(at, words.first)
    out = []
    for d, n in enumerate(words.n_words.tolist()):
        if n >= width:
            s = np.sort(windows[edge[d]: edge[d + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            _, whole = A.window_hashes(h[words.first[d]: words.first[d + 1]], np.array([0, n]), n)
            out.append(A.mix(whole + np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def most_different(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


#: bits of a token that hold its size class (about fifty classes reach 2**31 shingles)
CLASS_BITS = 127


@lru_cache(8)
def size_classes(percent: int) -> tuple[list[int], list[int]]:
    """(first size, parts) of each class; sizes grow by three fifths from class to class."""
    first = [1]
    while first[-1] < 1 << 31:
        first.append(max(first[-1] + 1, first[-1] * 8 // 5))
    most = [most_different(hi - 1, hi - 1, percent) for hi in first[1:]]
    return first[:-1], [d + d // 2 + 3 if d else 1 for d in most]


def tokens_of(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(tokens, (class, fewest tokens of it shared with a linked document, parts without shingles) of each class) of one set.

    The lowest seven bits of a token are its class.
    """
    n = len(s)
    first, parts = size_classes(percent)
    at = int(np.searchsorted(first, n, "right")) - 1
    top = int(np.searchsorted(first, n * 100 // percent, "right")) - 1
    out, classes = [], []
    mixed = A.mix(s)
    for c in range(at, top + 1):
        m = parts[c]
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mixed, begin)
        filled = part[begin]
        empty = m - len(filled)
        largest = min(first[c + 1] - 1 if c + 1 < len(first) else 1 << 31, n * 100 // percent)
        least = m - most_different(n, largest, percent) - empty
        made = A.mix(sums + A.mix(filled + np.uint64((c + 1) << 32)))
        if least < 1:  # the equal parts may all be empty ones
            gaps = np.setdiff1d(np.arange(m, dtype=np.uint64), filled)
            made = np.concatenate([made, A.mix(gaps + np.uint64((c + 1) << 32) + np.uint64(1 << 62))])
            least = 1
        made = np.unique(made & ~np.uint64(CLASS_BITS) | np.uint64(c))
        out.append(made)
        classes.append((c, least, empty))
    return np.concatenate(out), classes


CLASS_FIELDS = ("c", "least", "empty")


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set: two sums over its hashes and its size, mixed. Equal sets, and in effect only they, have equal names."""
    sums = np.array([A.mix(s).sum(dtype=np.uint64), A.mix(s ^ np.uint64(A.WORD_BASE)).sum(dtype=np.uint64)], np.uint64)
    return int(A.mix(A.mix(sums[:1] + np.uint64(len(s))) + sums[1:]).view(np.int64)[0])


def _signatures(width: int, percent: int):
    """Per row: key, n, node and what its size classes ask for."""
    kind = pa.list_(pa.struct([(f, pa.int32()) for f in CLASS_FIELDS]))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = A.utf8(batch.column(1))
            for lo, hi in A.cuts(offsets):
                sets = shingle_sets(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], width)
                classes = [[dict(zip(CLASS_FIELDS, c, strict=True)) for c in tokens_of(s, percent)[1]] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(classes, kind)], ["key", "n", "node", "classes"])
    return signatures


def _tokens(width: int, percent: int):
    """All (token, node) of the rows' sets; copies of a set that a task meets give them once, so that a much copied text does not
    crowd the partitions of its tokens."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            offsets, raw = A.utf8(batch.column(0))
            for lo, hi in A.cuts(offsets):
                made, nodes = [], []
                for s in shingle_sets(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], width):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        made.append(tokens_of(s, percent)[0])
                        nodes.append(node)
                if len(seen) > NODES_SEEN:
                    seen.clear()  # some come again, which the distinct after the shuffle takes out
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.repeat(nodes, [len(m) for m in made]))], ["token", "node"])
    return tokens


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Group:
    """Members of a group with the union of their shingles, each with the members that hold it."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.node = np.array([m[0] for m in members], np.int64)
        self.component = np.array([m[1] for m in members], np.int64)
        self.n = np.array([len(m[2]) for m in members], np.int64)
        flat = np.concatenate([m[2] for m in members])
        order = np.argsort(flat, kind="stable")
        self.shingle, self.holder = flat[order], np.repeat(np.arange(len(members)), self.n)[order]

        self.leader: dict[int, int] = {}

    def root(self, component: int) -> int:
        while (up := self.leader.get(component, component)) != component:
            component = up
        return component

    def links(self, s: np.ndarray, component: int, percent: int) -> list[int]:
        """Members that the query's set links with (exact), of those components only that no earlier link of this block has joined."""
        lo, hi = np.searchsorted(self.shingle, s, "left"), np.searchsorted(self.shingle, s, "right")
        if np.count_nonzero(hi > lo) * 100 < percent * len(s):
            return []  # the union lacks too many of its shingles: the group stays closed
        at, _ = A.ragged(lo, hi - lo)
        both = np.bincount(self.holder[at], minlength=len(self.n))
        out = []
        for i in np.flatnonzero((100 * both >= percent * (self.n + len(s) - both)) & (self.component != component)).tolist():
            a, b = self.root(component), self.root(int(self.component[i]))
            if a != b:
                self.leader[max(a, b)] = min(a, b)
                out.append(int(self.node[i]))
        return out


def _compare(width: int, percent: int):
    """Rows (group, salt, query, node, component, text) sorted by group, salt, query: members first, then queries. Links of the queries."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group = None, [], None
        for batch in batches:
            offsets, raw = A.utf8(batch.column(5))
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for lo, hi in A.cuts(offsets):
                links: list[tuple[int, int]] = []
                sets = shingle_sets(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], width)
                for i, s in enumerate(sets, lo):
                    name, salt, query, node, component = (c[i] for c in columns)
                    if (name, salt) != now:
                        now, members, group = (name, salt), [], None
                    if not len(s) or node_of(s) != node:
                        continue  # another row with this key
                    if not query:
                        members.append((node, component, s))
                        continue
                    if members:
                        group = group or Group(members)
                        links += [(node, other) for other in group.links(s, component, percent)]
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return compare


def _links(pairs: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (group, node, component) are compared with the members (group, node, component) of their group, in blocks of queries."""
    load = pairs.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(load, "group").select("group", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("salt"), F.lit(1).alias("query"), "node", "component")
    held = members.join(load, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("query"), "node", "component")
    rows = asked.unionAll(held).join(texts.hint("merge"), "node")
    dealt = rows.select("group", "salt", "query", "node", "component", "text").repartition("group", "salt").sortWithinPartitions("group", "salt", "query")
    return dealt.mapInArrow(_compare(width, percent), "a long, b long")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: key, n_shingles (size of its set) and component (smallest key reachable by links, itself included).

    A set holds the distinct shingles of ``width`` lower-cased words; fewer words are one shingle. Two sets link when 100 *
    intersection >= percent * union. A text that is null or without words has an empty set and links with nothing. Rows with a null key are
    not linked and have a null component; rows with equal keys are one document if their sets are equal. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = _written(rows.mapInArrow(_signatures(width, percent), "key long, n int, node long, classes array<struct<c:int,least:int,empty:int>>"), "jaccard-sets")
    own = signed.where("n > 0 AND key IS NOT NULL")
    sets = kept(own.groupBy("node").agg(F.min("key").alias("key")))
    of_token = Window.partitionBy("token")
    tokens = rows.where("key IS NOT NULL").select("text").mapInArrow(_tokens(width, percent), "token long, node long")
    # copies of a set give its tokens again: a token counts where it has two different nodes
    shared = tokens.select("*", F.min("node").over(of_token).alias("lo"), F.max("node").over(of_token).alias("hi")).where("lo <> hi").select("token", "node").distinct()
    shared = _written(shared.withColumn("held", F.count(F.lit(1)).over(of_token)), "jaccard-tokens")
    sizes = own.join(shared.select("node").distinct(), "node", "left_semi").join(sets, ["node", "key"], "left_semi")
    sizes = _written(sizes.select("node", "key", "n", "classes").dropDuplicates(["node"]), "jaccard-sizes")
    rare = _rarest(shared, sizes).withColumn("held", F.count(F.lit(1)).over(of_token)).where("held > 1")
    rare = _written(rare.withColumn("pivot", F.min("node").over(of_token)), "jaccard-rare")

    # nodes against the pivots of their tokens, where both have as many tokens in common as a link needs
    pairs = kept(_enough_in_common(rare.where("node <> pivot").select("pivot", "node").distinct(), shared, sizes, percent))
    texts = _texts(rows, sizes.join(rare.select("node").distinct(), "node", "left_semi"))
    stars = _links(pairs.select(F.col("pivot").alias("group"), "node", F.col("node").alias("component")),
                   pairs.select(F.col("pivot").alias("group")).distinct().select("group", F.col("group").alias("node"), F.col("group").alias("component")), texts, width, percent)
    links = kept(stars)
    labels = kept(components(links, "a", "b"))

    # links between components, away from the pivots
    rest = rare.where("node <> pivot").join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    several = rest.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rest = _written(rest.join(several, "token"), "jaccard-rest")
    if not rest.isEmpty():
        links = kept(links.unionAll(_matrix_links(rest, texts, sizes, width, percent)))
        labels = kept(components(links, "a", "b"))
    named = sets.join(labels, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("key").alias("first"))
    found = named.select("node", "component").join(least, "component").select("node", "first")
    out = signed.select("key", "n", "node").join(found, "node", "left")
    own_class = F.when(F.col("key").isNull(), None).otherwise(F.coalesce("first", "key"))
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), own_class.alias("component"))


def _rarest(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(token, node) of each node's M - least + 1 rarest of its M tokens of a class. Those that no other node has come
    first, so of the shared ones all but the least - 1 most common remain."""
    classes = sizes.select("node", F.explode("classes").alias("k")).select("node", "k.*")
    of_class = Window.partitionBy("node", "c")
    rows = shared.withColumn("c", F.col("token").bitwiseAND(F.lit(CLASS_BITS)).cast("int"))
    rows = rows.select("*", F.row_number().over(of_class.orderBy("held", "token")).alias("place"), F.count(F.lit(1)).over(of_class).alias("others"))
    return rows.join(classes, ["node", "c"]).where(F.col("place") <= F.col("others") - F.col("least") + 1).select("token", "node")


def _enough_in_common(pairs: DataFrame, shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The (pivot, node) pairs that share as many tokens of the larger one's class as a link needs; all others are no links."""
    first, parts = size_classes(percent)
    size = sizes.select("node", "n", F.map_from_arrays("classes.c", "classes.empty").alias("empty"))
    both = pairs.join(size, "node").join(size.select(F.col("node").alias("pivot"), F.col("n").alias("its_n"), F.col("empty").alias("its_empty")), "pivot")
    c = F.size(F.filter(F.lit(first), lambda lo: lo <= F.greatest("n", "its_n"))) - 1
    both = both.withColumn("c", c).where(F.least("n", "its_n") * 100 >= F.greatest("n", "its_n") * percent)
    least = F.get(F.lit(parts), F.col("c")) - F.floor((F.col("n") + F.col("its_n")) * (100 - percent) / (100 + percent)) - F.least(F.col("empty")[F.col("c")], F.col("its_empty")[F.col("c")])
    both = both.select("pivot", "node", "c", F.greatest(F.lit(1), least).alias("least"))
    by_class = shared.select("token", "node", F.col("token").bitwiseAND(F.lit(CLASS_BITS)).cast("int").alias("c"))
    mine = both.join(by_class, ["node", "c"])
    equal = mine.join(shared.select("token", F.col("node").alias("pivot")), ["token", "pivot"]).groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("equal"), F.max("least").alias("least"))
    return equal.where("equal >= least").select("pivot", "node")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, key), fetched once; a key's other rows are told apart by their sets when they are compared.

    Always a merge join, so that what moves grows with the input alone.
    """
    return _written(rows.join(wanted.select("node", "key").hint("merge"), "key").select("node", "text").dropDuplicates(), "jaccard-texts")


def _matrix_links(rest: DataFrame, texts: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components, by the matrix of tokens and groups; rest: (token, node, component)."""
    # similar nodes meet in few groups: nodes take the least name along shared tokens, twice; blocks bound a group's shingles
    name = rest.select("node").distinct().withColumn("name", F.col("node"))
    for _ in range(2):
        of_token = rest.select("token", "node").join(name, "node").groupBy("token").agg(F.min("name").alias("name"))
        name = rest.select("token", "node").join(of_token, "token").groupBy("node").agg(F.min("name").alias("name"))
    name = kept(name.join(sizes.select("node", "n"), "node").join(rest.groupBy("node").agg(F.first("component").alias("component")), "node"))
    blocks = name.groupBy("name").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("long").alias("blocks"))
    place = name.join(blocks, "name").select("node", "component", F.xxhash64("name", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("group"))
    place = kept(place)
    matrix = rest.join(place.select("node", "group"), "node").groupBy("token", "group").agg(F.max("component").alias("top"))
    # a pair is looked at from its smaller component
    asked = rest.join(matrix, "token").where(F.col("component") < F.col("top")).select("group", "node", "component").distinct()
    asked = kept(asked)
    members = kept(place.join(asked.select("group").distinct(), "group", "left_semi"))
    return _links(asked, members, texts, width, percent)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest key stays; rows with a null key stay."""
    found = jaccard_components(docs, key, text, width, percent).where(F.col("component") != F.col(key)).select(F.col(key).alias("gone"))
    return docs.join(found.distinct(), docs[key] == F.col("gone"), "left_anti")
