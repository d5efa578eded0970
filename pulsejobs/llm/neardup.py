"""Near-duplicates by a chosen-path set similarity join on word shingles.

Documents with equal shingle sets are one class from the start. Each class has
a signature of minwise tokens. Independent trees branch the classes by single
tokens of the signature: classes that share the chosen token are a node. Small
nodes are compared exhaustively on full sets; large nodes branch again by
further tokens; what does not fall apart (a crowd of near copies) is compared in
random parts, contracted to its components, and only what still lies in
different components is compared block against block. All counts and joins are
Spark jobs over slim rows; sets travel only for classes that share a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import flat, mix, slices, span_hashes, spans, stage, table, with_others_aside

#: Words of a shingle and least similarity in hundredths, unless a caller says otherwise.
WORDS, LEAST = 5, 80
#: Minwise tokens: the first ones are kept whole (4 bytes) to branch by, all of them by their low 4 bits as a sketch.
TOKENS, WHOLE = 128, 64
#: Trees. A pair of similarity s shares the root token of a tree with probability s, so eight trees miss three pairs of similarity 0.8 in a million.
TREES = 8
#: Classes of a node that is compared at once; larger nodes branch, each class by so many tokens, so many times.
SMALL, BRANCHES, DEPTH = 4096, 3, 3
#: Shingles that count as one more class where the size of a node is bounded: long documents fill a node sooner.
HEAVY = 2048
#: Pairs whose sketches agree in fewer of the 128 places are not looked at. A pair of similarity 0.8 agrees in 104 on
#: average (deviation 4.4), in fewer than 85 with a probability of about one in a hundred thousand. With 0 all
#: pairs of a node are compared on their full sets.
SCREEN = 85
#: Keys of rows (about 60 bytes each) that are broadcast to pick texts; more of them are joined by a shuffle.
BROADCAST_IDS = 300_000

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its runs of ``words`` words; all words as one run in a shorter text."""
    data, offsets = flat(texts)
    starts, ends, at = spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n = max(0, len(h) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs += h[k : k + n] * _PLACE[k]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TOKENS) uint32 minwise tokens; the sets must not be empty."""
    if not sets:
        return np.zeros((0, TOKENS), np.uint32)
    every = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TOKENS), np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat(((every ^ _FLIP[k]) * _MULTIPLY[k]) >> np.uint64(32), first)
    return out


def sketches(tokens: np.ndarray) -> np.ndarray:
    """(sets, TOKENS / 2) bytes: the low 4 bits of each token, two to a byte."""
    low = (tokens & np.uint32(15)).astype(np.uint8)
    return (low[:, ::2] << 4) | low[:, 1::2]


def _class_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _profiles(words: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in some])
            cid, tokens, sketch = ([None] * len(sets) for _ in range(3))
            for i, row, low in zip(some, sig, sketches(sig), strict=True):
                cid[i], tokens[i], sketch[i] = _class_id(sets[i]), row[:WHOLE].tobytes(), low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keys], pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.binary()) for x in (cid, tokens, sketch)]], names=[*keys, "n_shingles", "cid", "sig", "sketch"]
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            right = [i for i, (s, c) in enumerate(zip(sets, batch.column("cid").to_pylist(), strict=True)) if _class_id(s) == c]  # ids can repeat with another text
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["cid", "tokens"])

    return run


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows sorted by node, as one dict of lists for each node."""
    held, node = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        nodes = np.asarray(columns.pop("node"))
        cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = {c: v[a:b] for c, v in columns.items()}
            if held is not None and node == nodes[a]:
                for c, v in part.items():
                    held[c].extend(v)
            else:
                if held is not None:
                    yield held | {"node": node}
                held, node = part, nodes[a]
    if held is not None:
        yield held | {"node": node}


def _labels(group: dict) -> np.ndarray:
    return np.unique(np.array([x.hex() for x in group["lab"]]), return_inverse=True)[1]


def _near(sketch: np.ndarray, rows: slice) -> np.ndarray:
    """For some members the places in which their sketch agrees with that of every member."""
    out = np.zeros((len(sketch[rows]), len(sketch)), np.int16)
    for k in range(sketch.shape[1]):
        differ = sketch[rows, k, None] ^ sketch[None, :, k]
        out += (differ & 15) == 0
        out += (differ & 240) == 0
    return out


def _screen(least: int):
    return lambda batches: _screened(batches, least)


def _screened(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The members of each group that must be compared with another one.

    That is one of another component, with a sketch that agrees in ``least``
    places, and not met before: a pair is compared in the first tree in whose
    root it shares a small node. ``met`` holds the root tokens (4 bytes each) of
    the earlier trees in which the node was small, zeros elsewhere.
    """
    node, cid, lab = [], [], []
    for group in _by_node(batches):
        if len(group["cid"]) < 2:
            continue
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, TOKENS // 2)
        of = _labels(group)
        met = np.frombuffer(b"".join(group["met"]), np.uint32).reshape(len(of), -1)
        keep = np.zeros(len(of), bool)
        for a in range(0, len(of), 256):
            rows = slice(a, a + 256)
            near = of[rows, None] != of[None]
            if least > 0:
                near &= _near(sketch, rows) >= least
            for k in range(met.shape[1]):
                near &= (met[rows, k, None] != met[None, :, k]) | (met[rows, k, None] == 0)
            keep[rows] |= near.any(axis=1)
        keep = np.flatnonzero(keep).tolist()
        node += [int(group["node"])] * len(keep)
        cid += [group["cid"][i] for i in keep]
        lab += [group["lab"][i] for i in keep]
        if len(node) > 20000:
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(cid, pa.binary()), pa.array(lab, pa.binary())], names=["node", "cid", "lab"])
            node, cid, lab = [], [], []
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(cid, pa.binary()), pa.array(lab, pa.binary())], names=["node", "cid", "lab"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, from products of blocks of the 0/1 table of their shared tokens."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1] if shared.any() else np.zeros(0, np.int64), owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24: exact
    block = max(256, 8_000_000 // len(sets))
    for a in range(0, int(token.max(initial=-1)) + 1, block):
        lo, hi = np.searchsorted(token, [a, a + block])
        x = np.zeros((block, len(sets)), np.float32)
        x[token[lo:hi] - a, owner[lo:hi]] = 1
        out += x.T @ x
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def links(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= least * union; row by row, so that only truth values are held for all pairs."""
    common = intersections(sets)
    size = np.array([len(s) for s in sets])
    out = np.empty(common.shape, bool)
    for i, row in enumerate(common):
        out[i] = (100 + least) * np.rint(row).astype(np.int64) >= least * (size[i] + size)
    return out


def _heads(linked: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first member of each member's component: linked members and members with one label belong together."""
    n = len(linked)
    head = np.arange(n)
    while True:
        new = head.copy()
        for i in range(n):
            new[i] = min(new[i], head[linked[i]].min(initial=n))
        label = np.full(of.max(initial=-1) + 1, n)
        np.minimum.at(label, of, new)
        new = label[of]
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _compare(least: int):
    """Links between components (a, b), as few as join what a group's exhaustive comparison joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, bytes]] = set()
        for group in _by_node(batches):
            if len(group["cid"]) > 1:
                of = _labels(group)
                linked = links([np.frombuffer(t, np.uint64) for t in group["tokens"]], least)
                # members of one component count as linked: only what joins components goes out
                for i, h in enumerate(_heads(linked, of)):
                    if of[i] != of[h]:
                        found.add((group["lab"][i], group["lab"][h]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(2)], names=["a", "b"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(cid, lab): each vertex with the smallest vertex it reaches.

    Labels spread along the links; from the third round on a label is also
    replaced by the label of its own vertex, so long chains take few rounds.
    Each round is written out; the hub of a crowd is a hot key only for the
    skew join over two written tables and for sums with partial results.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("lab")).withColumnRenamed("a", "cid"), "labels")
    rounds = 0
    while True:
        rounds += 1
        heard = both.join(labels.withColumnRenamed("cid", "a"), "a").select(F.col("b").alias("cid"), "lab", F.lit(None).cast("binary").alias("old"))
        new = stage(heard.union(labels.select("cid", "lab", F.col("lab").alias("old"))).groupBy("cid").agg(F.min("lab").alias("lab"), F.max("old").alias("old")), "labels")
        if new.where("lab <> old").isEmpty():
            return new.select("cid", "lab")
        labels = new.select("cid", "lab")
        if rounds > 2:
            labels = stage(labels.join(labels.select(F.col("cid").alias("lab"), F.col("lab").alias("top")), "lab").select("cid", F.col("top").alias("lab")), "labels")


class _Join:
    """One run of the join: the class table, the labels (class, component) and the sets fetched so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, least: int, small: int, screen: int):
        self.docs, self.classes, self.words, self.least, self.small, self.screen = docs, classes, words, least, small, screen
        self.labels = self.sets = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with lab, the component of cid: itself, unless links have been found."""
        if self.labels is None:
            return rows.withColumn("lab", F.col("cid"))
        return rows.join(self.labels.hint("merge"), "cid", "left").withColumn("lab", F.coalesce("lab", "cid"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Members of the nodes that hold more than one component, with the node's size n (the sum of its weights)."""
        sizes = stage(rows.groupBy("node").agg(F.sum("weight").alias("n"), F.min("lab").alias("low"), F.max("lab").alias("high")).where("low <> high").select("node", "n"), "node-sizes")
        return stage(rows.select("node", "cid", "weight", "lab", "sketch", "met").join(sizes.hint("merge"), "node"), "nodes")

    def roots(self, trees: int) -> DataFrame:
        """(tree, node, cid, weight): each class goes to a node of each tree, named by the tree's own token."""
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        rows = self.classes.select("cid", "weight", "sig", tree.alias("tree"))
        return rows.select("tree", F.xxhash64("tree", F.substring("sig", F.col("tree") * 4 + 1, F.lit(4))).alias("node"), "cid", "weight")

    def root_nodes(self, trees: int) -> DataFrame:
        """(tree, node, cid, n): the members of all root nodes of two classes and more."""
        roots = self.roots(trees)
        sizes = stage(roots.groupBy("node").agg(F.sum("weight").alias("n"), F.count("*").alias("members")).where("members > 1").select("node", "n"), "node-sizes")
        return stage(roots.drop("weight").join(sizes.hint("merge"), "node"), "roots")

    def members(self, found: DataFrame, trees: range) -> DataFrame:
        """(node, cid, weight, lab, sketch, met) of some trees; met has the earlier trees' root tokens where the nodes were small."""
        bits = found.groupBy("cid").agg(F.bit_or(F.expr(f"case when n <= {self.small} then shiftleft(1L, tree) else 0L end")).alias("bits"))
        held = self.classes.select("cid", "weight", "sig", "sketch").join(bits.hint("merge"), "cid")
        held = stage(self.labelled(held), "labelled")
        tree = F.explode(F.array(*[F.lit(t) for t in trees]))
        root = lambda t: F.xxhash64(t, F.substring("sig", t * 4 + 1, F.lit(4)))
        earlier = [F.when((F.lit(t) < F.col("tree")) & (F.expr(f"(bits >> {t}) & 1") == 1), F.substring("sig", 4 * t + 1, 4)).otherwise(F.lit(bytes(4))) for t in range(max(trees))] or [F.lit(bytes(4))]
        return held.withColumn("tree", tree).select(root(F.col("tree")).alias("node"), "cid", "weight", "lab", "sketch", F.concat(*earlier).alias("met"))

    def children(self, large: DataFrame) -> DataFrame:
        """Large nodes branched: each member goes to the children named by tokens at places that the node chooses."""
        rows = large.select("node", "cid", "weight", "lab", "sketch", "met").join(self.classes.select("cid", "sig").hint("merge"), "cid").withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
        place = F.pmod(F.xxhash64("node", "branch"), F.lit(WHOLE)).cast("int")
        return stage(rows.select(F.xxhash64("node", place, F.substring("sig", place * 4 + 1, F.lit(4))).alias("node"), "cid", "weight", "lab", "sketch", "met").dropDuplicates(["node", "cid"]), "children")

    def parts(self, large: DataFrame, depth: int) -> DataFrame:
        """Large nodes cut into random parts of about ``small`` members."""
        part = F.pmod(F.xxhash64("cid", F.lit(depth)), F.ceil(F.col("n") / self.small))
        return large.select(F.xxhash64("node", F.lit(f"part{depth}"), part).alias("node"), "cid", "lab", "sketch", "met")

    def blocks(self, large: DataFrame) -> DataFrame:
        """What is left of large nodes: members outside the largest component against all, block by block.

        Every pair of members of different components meets in a group of at
        most about ``small`` members.
        """
        half = max(1, self.small // 2)
        per = large.groupBy("node", "lab").agg(F.sum("weight").alias("count"))
        top = per.groupBy("node").agg(F.max(F.struct("count", "lab"))["lab"].alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
        top = stage(top.select("node", "main", F.ceil((F.col("all") - F.col("most")) / half).alias("rest_blocks"), F.ceil(F.col("all") / half).alias("all_blocks")), "main")
        rows = stage(large.join(top.hint("merge"), "node"), "blocks")
        own = lambda name, n: F.pmod(F.xxhash64("cid", F.lit(name)), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
        rest = rows.where("lab <> main").withColumn("r", own("rest", "rest_blocks")).withColumn("b", each("all_blocks"))
        every = rows.withColumn("b", own("all", "all_blocks")).withColumn("r", each("rest_blocks"))
        pick = [F.xxhash64("node", F.lit("block"), "r", "b").alias("node"), *[F.col(c) for c in ("cid", "lab", "sketch", "met")]]
        return rest.select(*pick).union(every.select(*pick)).dropDuplicates(["node", "cid"])

    def fetch(self, cids: DataFrame) -> None:
        """Sets of classes, from one text of each class."""
        wanted = cids.distinct() if self.sets is None else cids.distinct().join(self.sets.select("cid"), "cid", "left_anti")
        wanted = stage(wanted.join(self.classes.select("cid", "head"), "cid"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        found = self.docs.join(F.broadcast(wanted) if few else wanted, self.docs["doc_id"].eqNullSafe(wanted["head"])).select("cid", "text")
        sets = stage(found.mapInArrow(_sets(self.words), "cid binary, tokens binary").dropDuplicates(["cid"]), "sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)

    def compare(self, groups: DataFrame) -> None:
        """Exhaustive comparison inside groups of bounded size: first of sketches, then of full sets; components are joined."""
        close = stage(groups.select("node", "cid", "lab", "sketch", "met").repartition("node").sortWithinPartitions("node").mapInArrow(_screen(self.screen), "node long, cid binary, lab binary"), "close")
        if close.isEmpty():
            return
        self.fetch(close.select("cid"))
        rows = close.join(self.sets.hint("merge"), "cid").repartition("node").sortWithinPartitions("node")
        edges = stage(rows.mapInArrow(_compare(self.least), "a binary, b binary"), "edges")
        if edges.isEmpty():
            return
        joined = connected(edges)
        if self.labels is None:
            self.labels = joined
            return
        moved = self.labels.join(joined.select(F.col("cid").alias("lab"), F.col("lab").alias("top")), "lab", "left").select("cid", F.coalesce("top", "lab").alias("lab"))
        self.labels = stage(moved.union(joined.join(self.labels.select("cid"), "cid", "left_anti")), "labels")

    def run(self, trees: int) -> None:
        """The first tree finds most links; in the others only what it left apart is looked at."""
        found = self.root_nodes(trees)
        for some in (range(1), range(1, trees)):
            nodes = self.live(self.members(found, some))
            for depth in range(DEPTH + 1):
                small, large = nodes.where(f"n <= {self.small}"), nodes.where(f"n > {self.small}")
                crowd = not large.isEmpty()
                self.compare(small.drop("n", "weight").union(self.parts(large, depth)) if crowd else small)
                if not crowd:
                    break
                large = self.live(self.labelled(large.select("node", "cid", "weight", "sketch", "met")))
                if large.isEmpty():
                    break
                if depth == DEPTH:
                    self.compare(self.blocks(large))
                else:
                    nodes = self.live(self.children(large))


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST, trees: int = TREES, small: int = SMALL, screen: int = SCREEN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the components of documents linked by shingle similarity.

    Words are runs of other than ASCII white space, A-Z in lower case. A text's
    set holds its distinct runs of ``words`` words, all words as one run if it
    has fewer. Documents are linked if 100 * intersection >= ``least`` * union.
    component_id is the smallest doc_id that links reach; kept is true for that
    document. Every link that is used was confirmed on full sets; no node,
    crowd or partner list is cut off. What may be missed: by the trees, as their
    number ``trees`` says (see TREES), and by the comparison of sketches that
    comes before that of sets (see SCREEN); ``screen=0`` leaves the latter out.
    A node is compared at once up to ``small`` classes, a class of long texts
    counting for several, so a task's memory is bounded too.

    Texts that are null or have no word have no shingles and are linked with
    nothing. Repeated rows share a component, and all rows of its smallest id
    are kept. Null ids: the smallest id is that of the others; alone, component_id is
    null and the row is kept. One row out for each row in; columns other than
    doc_id and text are ignored. An empty table gives an empty result.
    """
    return _linked(docs.select("doc_id", "text"), words, least, trees, small, screen).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, words: int = WORDS, least: int = LEAST, trees: int = TREES, small: int = SMALL, screen: int = SCREEN) -> DataFrame:
    """``near_duplicates`` with the columns of ``docs`` besides the text (doc_id, binary keys), and lab, the component itself: null without shingles."""
    keys = [c for c in docs.columns if c != "text"]
    schema = ", ".join("doc_id long" if c == "doc_id" else f"{c} binary" for c in keys)
    rows = stage(docs.select(*keys, "text").mapInArrow(_profiles(words, keys), f"{schema}, n_shingles long, cid binary, sig binary, sketch binary"), "profiles")
    docs = docs.select("doc_id", "text")
    classes = stage(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("head"), F.max(F.expr(f"greatest(1L, n_shingles div {HEAVY})")).alias("weight"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")), "classes")
    join = _Join(docs, classes, words, least, small, screen)
    join.run(trees)
    if join.labels is None:
        where = classes.select("cid", F.col("cid").alias("lab"), F.col("head").alias("component_id"))
    else:
        placed = stage(classes.select("cid", "head").join(join.labels, "cid", "left").withColumn("lab", F.coalesce("lab", "cid")), "placed")
        tops = stage(placed.groupBy("lab").agg(F.min("head").alias("component_id")), "tops")
        where = placed.join(tops, "lab").select("cid", "lab", "component_id")
    where = stage(where, "components")
    out = rows.select(*keys, "n_shingles", "cid").join(where, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(*keys, "n_shingles", "lab", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays; one row of it, if rows repeat.

    Rows are told apart by doc_id and a digest of the text: different texts
    under one id, or without an id, are documents of their own, unless they
    are in one component.
    """
    return with_others_aside(docs, ("doc_id", "text"), _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    key = F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary")))).otherwise(F.lit(b""))
    found = _linked(docs.select("doc_id", key.alias("text_key"), "text"))
    each = stage(found.groupBy("doc_id", "text_key").agg(F.min(F.coalesce("lab", "text_key")).alias("lab"), F.max("kept").alias("kept"), F.count("*").alias("rows")), "each")
    held = each.where("kept").groupBy(F.col("doc_id").alias("held_id"), F.col("lab").alias("held_lab")).agg(F.min("text_key").alias("held_key"))
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("lab") == F.col("held_lab")) & (F.col("text_key") == F.col("held_key"))
    marked = each.join(held, same, "left").where("held_key IS NULL OR rows > 1")
    # only rows that go or that repeat are looked up, so that texts stay where they lie
    marked = stage(marked.select(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key"), F.col("held_key").isNull().alias("near_gone")), "marked")
    few = marked.count() <= BROADCAST_IDS
    name = next(n for n in (f"near_text_key{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    keyed = docs.withColumn(name, key)
    out = keyed.join(F.broadcast(marked) if few else marked, keyed["doc_id"].eqNullSafe(marked["near_id"]) & (keyed[name] == marked["near_key"]), "left")
    single = out.where("near_gone IS NULL").select(*[keyed[c] for c in docs.columns])
    if marked.where("NOT near_gone").isEmpty():
        return single
    twins = out.where("NOT near_gone").select(*[keyed[c] for c in keyed.columns]).dropDuplicates(["doc_id", name])
    return single.union(twins.select(*docs.columns))


OP2_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
