"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of distinct shingles (hashes), a key that equal sets share, and a signature of TREES
   times DEPTH minima. Texts with equal sets are one node from here on.
2. Each tree sorts all nodes by its DEPTH minima, dealt out by ranges of the order, so no prefix, however common,
   overloads a task. Nodes that share MIN_DEPTH minima are a region. Candidates in a region of at most LEAF nodes are
   all its pairs. A larger one yields neighbours in the order (their common prefixes are the longest) and pairs with
   its hubs, the nodes that agree best with the region's most common minima, and is then split one minimum deeper:
   dense regions reach as deep as they need. So a region yields a number of candidates in proportion to its size.
3. Candidates that agree in at least AGREE minima of the tree are confirmed on the full sets of their texts, which meet
   in groups bounded in candidates and in shingles.
4. Confirmed links make components: in rounds, nodes join their smallest neighbours, and links are rewritten to match.
5. What a large region has not tried is settled exactly (see ``rest``): of the nodes in regions of more than LEAF nodes
   that hold several components, those survive whose shingles are, for the most part, also in other components; they
   fall into families by an exact prefix filter, rare shingles first; and within a family every node outside the
   largest component is compared, on full sets, with every node of other components, in blocks of bounded size.

So two similar documents are missed only if they share no region in any tree, or if in every small region they share
fewer than AGREE of its tree's DEPTH minima agree. The cost of step 5 grows with (nodes of a family) times (nodes of it
outside its largest component): a large family whose members lie just below the threshold is the costly case.

Edge cases: null and empty texts have no shingles and are linked with nothing; rows that repeat an id are one document
if their texts link them, and each is reported; fully repeated rows are one node, whose text is used once a task; a
null id counts as larger than any; texts of equal sets tie and the smallest id stands for them; a very long text is
hashed piece by piece, and only its hashes are held whole; further columns, whatever their names, do not matter; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import col, discard, row, table, with_small, written
from marginalia.llm.shingles import MinHash, intersection, set_key, shingle_sets
from marginalia.llm.workers import lean

TREES, DEPTH, MIN_DEPTH, AGREE = 14, 12, 2, 6
LEAF, NEAR, HUBS = 16, 1, 1
SIMILARITY_PCT = 85
#: Rows from which on copies of one text are joined with their component apart from the others.
HOT_ROWS = 10_000
#: Candidates confirmed in one group, and shingles of their texts.
GROUP, GROUP_SHINGLES = 300, 4 << 20
#: A family is cut into PARTS parts by nodes, though of LEAST_BLOCK to BLOCK nodes each; blocks are pairs of parts.
PARTS, LEAST_BLOCK, BLOCK, BLOCK_SHINGLES = 16, 128, 2_048, 2 << 20
#: Bytes of sets in a batch that Python hands over.
SET_BYTES = 8 << 20


def _signatures(batches):
    minhash = MinHash(TREES * DEPTH)
    for batch in lean(batches):
        raw = batch.column(2).cast(pa.binary()).to_pylist()
        nodes, sizes, sketches = [], [], []
        for hashes in shingle_sets([x or b"" for x in raw]):
            sizes.append(len(hashes))
            nodes.append(set_key(hashes) if len(hashes) else None)
            sketches.append(minhash(hashes).astype(">u2").tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "node", "n_shingles", "sketch"])


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("text_hash"), col(text).alias("text"))
    return written(rows.mapInArrow(_signatures, "doc_id long, text_hash long, node binary, n_shingles long, sketch binary"), "signatures")


def _region_pairs(keys: np.ndarray, lo: int, hi: int, depth: int, last: int, found: list) -> None:
    """Candidates among the rows lo to hi, which agree in their first ``depth`` minima."""
    stack = [(lo, hi, depth, last)]
    while stack:
        lo, hi, depth, last = stack.pop()
        n = hi - lo
        if n < 2:
            continue
        if n <= LEAF:
            a, b = np.triu_indices(n, 1)
            found.append((a + lo, b + lo))
            continue
        if depth == DEPTH or n <= last // 2 or not last:  # else hardly smaller than where hubs were last chosen
            last = n
            rest = keys[lo:hi, min(depth, DEPTH - 1) :]
            common = np.array([np.bincount(rest[:, c]).argmax() for c in range(rest.shape[1])])
            agreed = (rest == common).sum(1)
            hubs = np.argsort(-agreed, kind="stable")[:HUBS] + lo
            every = np.arange(lo, hi)
            for h in hubs:
                found.append((np.full(n, h), every))
            for d in range(1, NEAR + 1):
                found.append((every[:-d], every[d:]))
        if depth < DEPTH:
            cuts = np.flatnonzero(np.diff(keys[lo:hi, depth])) + lo + 1
            bounds = [lo, *cuts.tolist(), hi]
            stack += [(x, y, depth + 1, last) for x, y in zip(bounds, bounds[1:]) if y - x > 1]


def region_candidates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of rows (first smaller) among rows of sorted minima, that agree in AGREE or more."""
    found: list = []
    head = np.flatnonzero((np.diff(keys[:, :MIN_DEPTH].astype(np.int32), axis=0) != 0).any(1)) + 1
    bounds = [0, *head.tolist(), len(keys)]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo > 1:
            _region_pairs(keys, lo, hi, MIN_DEPTH, 0, found)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    code = np.unique(np.minimum(a, b) * len(keys) + np.maximum(a, b))
    a, b = code // len(keys), code % len(keys)
    keep = a != b
    a, b = a[keep], b[keep]
    keep = np.concatenate([(keys[a[i : i + 65536]] == keys[b[i : i + 65536]]).sum(1) >= AGREE for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    return a[keep], b[keep]


def _forest(batches):
    """Rows come in the order of tree and key; a tree's rows within this task are worked on together."""
    held: list = []

    def pairs():
        keys = np.frombuffer(b"".join(x[0] for x in held), ">u2").astype(np.uint16).reshape(len(held), DEPTH)
        nodes = [x[1] for x in held]
        a, b = region_candidates(keys)
        for i in range(0, len(a), 50_000):
            left, right = [nodes[x] for x in a[i : i + 50_000]], [nodes[x] for x in b[i : i + 50_000]]
            yield _links(list(zip(map(min, left, right), map(max, left, right))))

    tree = None
    for batch in lean(batches):
        for t, *at in zip(*(c.to_pylist() for c in batch.columns)):
            if t != tree and held:
                yield from pairs()
                held.clear()
            tree = t
            held.append(at)
    if held:
        yield from pairs()


def _parts_of_sketch(minima: int):
    """Column: of each tree's part of the sketch, the bytes of its first minima."""
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substr("sketch", t * 2 * DEPTH + 1, F.lit(2 * minima)))


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes. classes: node and sketch."""
    order = ["tree", "key", "node"]
    rows = classes.select(F.posexplode(_parts_of_sketch(DEPTH)).alias("tree", "key"), "node").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*order).mapInArrow(_forest, "a binary, b binary").distinct()


class _Union(dict):
    """Sets of things that links connect."""

    def root(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        """Whether the two were apart so far."""
        x, y = self.root(x), self.root(y)
        self[y] = x
        return x != y


def _confirm(pct: int):
    def run(batches):
        group, sets, union, out = None, {}, _Union(), []

        def linked(a, b):
            x, y = sets.get(a), sets.get(b)
            if x is None or y is None or 100 * min(len(x), len(y)) < pct * max(len(x), len(y)):
                return False
            both = intersection(x, y) if len(x) <= len(y) else intersection(y, x)
            return 100 * both >= pct * (len(x) + len(y) - both)

        for batch in lean(batches):
            for g, is_pair, a, b, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    group, sets, union = g, {}, _Union()
                if not is_pair:
                    sets[a] = np.frombuffer(hashes, np.uint64)
                # what is connected in this group needs no further link
                elif union.root(a) != union.root(b) and linked(a, b):
                    union.join(a, b)
                    out.append((a, b))
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])


def _sets(batches):
    """The set of each node, once a task however many rows repeat it: columns node and text to node and hashes."""
    done: set = set()
    for batch in lean(batches):
        todo = [(n, t) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) if n not in done]
        nodes, out, size = [], [], 0
        for (n, _), hashes in zip(todo, shingle_sets([t for _, t in todo])):
            if n not in done and set_key(hashes) == n:
                done.add(n)
                nodes.append(n)
                out.append(hashes.tobytes())
                size += len(out[-1])
            if size >= SET_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], ["node", "hashes"])
                nodes, out, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], ["node", "hashes"])


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node and hashes (its sorted set as bytes). wanted: distinct nodes with the id and text hash of one row."""
    texts = docs.select(F.struct(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("text_hash")).alias("at"), col(text).alias("text"))
    found = with_small(texts, wanted.select("node", F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).alias("at")), ["at"], "inner", salts=1, sieve=True)
    return found.select("node", "text").mapInArrow(_sets, "node binary, hashes binary")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str, text: str, pct: int) -> DataFrame:
    """Links that connect what the pairs with a similarity of pct or more connect. classes: node, its size, and the id
    and text hash of one row of it.

    A pair goes to the group of its first node's smallest neighbour, which most pairs of a cluster share. A group of
    more than GROUP pairs or GROUP_SHINGLES shingles is cut into blocks by the end that fewer pairs have, so a node
    that very many pairs have in common stands in every block and the others are dealt out evenly."""
    near = pairs.select(F.col("a").alias("node"), F.col("b").alias("n")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("n")))
    low = near.groupBy("node").agg(F.least("node", F.min("n")).alias("low"), F.count(F.lit(1)).alias("degree")).join(classes.select("node", "size"), "node")
    low = written(low, "degrees")
    rows = pairs.join(low.select(F.col("node").alias("a"), F.xxhash64("low").alias("g"), F.col("degree").alias("da"), F.col("size").alias("sa")), "a")
    rows = rows.join(low.select(F.col("node").alias("b"), F.col("degree").alias("db"), F.col("size").alias("sb")), "b")
    free = F.xxhash64(F.when(F.col("da") < F.col("db"), F.col("a")).otherwise(F.col("b")))
    rows = written(rows.select("a", "b", "g", free.alias("free"), F.greatest("sa", "sb").alias("size")), "grouped")
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("size") / GROUP_SHINGLES)).cast("long")
    large = rows.groupBy("g").agg(cuts.alias("cuts")).where("cuts > 1")
    block = F.when(F.col("cuts").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod("free", "cuts")))
    blocks = written(with_small(rows, written(large, "large"), ["g"]).select("a", "b", block.alias("g")), "blocks")
    needed = blocks.select("g", F.col("a").alias("node")).unionByName(blocks.select("g", F.col("b").alias("node"))).groupBy("node").agg(F.collect_set("g").alias("gs"))
    needed = written(needed.join(classes.select("node", "first"), "node"), "needed")
    sets = sets_of(docs, needed, doc_id, text)
    # a table of its own, as Python is done with a set before Spark copies it to its groups
    sets = with_small(sets, needed.select("node", "gs"), ["node"], "inner", salts=1)
    sets = sets.select(F.explode("gs").alias("g"), F.lit(False).alias("is_pair"), F.col("node").alias("a"), F.lit(None).cast("binary").alias("b"), "hashes")
    both = sets.unionByName(blocks.select("g", F.lit(True).alias("is_pair"), "a", "b", F.lit(None).cast("binary").alias("hashes")))
    links = written(both.repartition("g").sortWithinPartitions("g", "is_pair").mapInArrow(_confirm(pct), "a binary, b binary"), "links")
    discard(low, rows, blocks, needed)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of a link the smallest node it is connected with. In each round every node joins its
    smallest neighbour's smallest neighbour, and links are rewritten to link what has joined: they get fewer each time."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    labels = None
    while True:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(near.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")), "low")
        onward = low.where("node != to").select(F.col("node").alias("to"), F.col("to").alias("onward"))
        to = written(with_small(low, onward, ["to"]).select("node", F.coalesce("onward", "to").alias("label")), "joined")
        if labels is None:
            after = to
        else:
            after = written(with_small(labels, to.select(F.col("node").alias("label"), F.col("label").alias("wider")), ["label"]).select("node", F.coalesce("wider", "label").alias("label")), "labels")
        for end in ("a", "b"):
            ends = with_small(edges if end == "a" else ends, to.select(F.col("node").alias(end), F.col("label").alias(f"{end}2")), [end])
        left = ends.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        left = written(left, "edges")
        discard(edges, low, *([] if labels is None else [labels, to]))
        edges, labels = left, after
        if not edges.take(1):
            discard(edges)
            return labels


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other."""
    nl, nr = len(left), len(right)
    counts = np.zeros((nl, nr), np.float32)
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    tokens = np.intersect1d(flat_l, flat_r)
    if not len(tokens):
        return counts

    def postings(flat, sets):
        """For each token where its sets begin, and the sets in the order of tokens."""
        at = np.searchsorted(tokens, flat)
        at[at == len(tokens)] = 0
        hit = tokens[at] == flat
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        at = at[hit]
        order = np.argsort(at, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))]), own[order]

    (at_l, own_l), (at_r, own_r) = postings(flat_l, left), postings(flat_r, right)
    many_l, many_r = np.diff(at_l), np.diff(at_r)
    dense = many_l * many_r > max(64, nl * nr // 64)
    # tokens that many sets have: products of matrices of 0 and 1
    wide = np.flatnonzero(dense)
    for k in range(0, len(wide), 2048):
        part = wide[k : k + 2048]
        made = []
        for n, at, many, own in ((nl, at_l, many_l, own_l), (nr, at_r, many_r, own_r)):
            m = np.zeros((n, len(part)), np.float32)
            sizes = many[part]
            ends = np.cumsum(sizes)
            m[own[np.repeat(at[part] - (ends - sizes), sizes) + np.arange(ends[-1])], np.repeat(np.arange(len(part)), sizes)] = 1
            made.append(m)
        counts += made[0] @ made[1].T
    # and those that few have: their pairs are counted one by one
    few = np.flatnonzero(~dense)
    work = np.cumsum(many_l[few] * many_r[few])
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + (4 << 20), "right")))
        part, lo = few[lo:hi], hi
        sizes = many_l[part] * many_r[part]
        nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide_r = np.repeat(many_r[part], sizes)
        i, j = own_l[np.repeat(at_l[part], sizes) + nth // wide_r], own_r[np.repeat(at_r[part], sizes) + nth % wide_r]
        counts += np.bincount(i * nr + j, minlength=nl * nr).reshape(nl, nr)
    return counts


def block_links(left: list[tuple], right: list[tuple], pct: int) -> list[tuple]:
    """Pairs of labels that links of pct percent connect, as few as connect them. Sides: (label, sorted set)."""
    numbers: dict = {}
    own_l, own_r = (np.array([numbers.setdefault(x, len(numbers)) for x, _ in side]) for side in (left, right))
    size_l, size_r = (np.array([len(s) for _, s in side]) for side in (left, right))
    both = _common([s for _, s in left], [s for _, s in right])
    i, j = np.nonzero((100 * both >= pct * (size_l[:, None] + size_r[None] - both)) & (own_l[:, None] != own_r[None]))
    names, union = list(numbers), _Union()
    pairs = np.unique(np.sort(np.stack([own_l[i], own_r[j]], 1), axis=1), axis=0) if len(i) else []
    return [(names[a], names[b]) for a, b in pairs if union.join(int(a), int(b))]


def _cross(pct: int):
    def run(batches):
        block, sides, out = None, ([], []), []

        def settled():
            return block_links(*sides, pct) if sides[0] and sides[1] else []

        for batch in lean(batches):
            for g, side, label, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if g != block:
                    out += settled()
                    block, sides = g, ([], [])
                sides[side].append((label, np.frombuffer(hashes, np.uint64)))
            yield _links(out)
            out = []
        yield _links(out + settled())

    return run


def _hashes_of(batches):
    """Sets as arrays of numbers, for SQL."""
    for batch in lean(batches):
        raw = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        ends = np.cumsum([0, *map(len, raw)])
        arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*raw, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays], ["node", "label", "hashes"])


def rest(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, pct: int) -> DataFrame | None:
    """Pairs of labels that are linked after all (None without any): what large regions had too many pairs to try.
    nodes: node, sketch, first, size, label.

    Only nodes of regions of more than LEAF nodes with several labels take part. A node can be linked with another
    label only if so many of its shingles as the similarity asks for are in nodes of other labels; the shingles by
    which a link shows itself at the latest (the prefix, rare ones first) connect nodes to families."""
    keys = F.transform(_parts_of_sketch(MIN_DEPTH), lambda x, t: F.xxhash64(t, x))
    rows = nodes.select("node", F.xxhash64("label").alias("lab"), F.explode(keys).alias("region"))
    large = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where((F.col("n") > LEAF) & (F.col("lo") != F.col("hi")))
    large = written(large.select("region"), "regions")
    if not large.take(1):
        return None
    taking = with_small(rows.select("node", "region"), large, ["region"], "left_semi").select("node").distinct()
    taking = written(nodes.select("node", "first", "label").join(taking, "node"), "taking")
    sets = with_small(sets_of(docs, taking, doc_id, text).dropDuplicates(["node"]), taking.select("node", "label"), ["node"], "inner", salts=1)
    sets = written(sets.select("node", "label", "hashes"), "sets")
    tokens = sets.mapInArrow(_hashes_of, "node binary, label binary, hashes array<long>")
    tokens = tokens.select("node", F.xxhash64("label").alias("lab"), F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo != hi").select("h", "n")
    own = with_small(tokens, written(shared, "shared"), ["h"], "inner").groupBy("node", "lab", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))
    need = F.ceil(F.col("size") * pct / 100).cast("int")
    own = own.where(F.size("shared") >= need).select("node", "lab", "size", F.slice(F.col("shared.h"), F.lit(1), F.size("shared") - need + 1).alias("prefix"))
    own = written(own, "dense")
    at = own.select(F.xxhash64("node").alias("id"), "lab", F.explode("prefix").alias("h"))
    buckets = at.groupBy("h").agg(F.min("id").alias("hub"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo != hi").select("h", "hub")
    edges = with_small(at, written(buckets, "buckets"), ["h"], "inner").where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    families = components(written(edges, "edges"))
    members = own.select("node", "lab", "size", F.xxhash64("node").alias("id")).join(families.withColumnsRenamed({"node": "id", "label": "family"}), "id")
    members = written(members, "members")
    by_label = written(members.groupBy("family", "lab").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "family-labels")
    of = by_label.groupBy("family").agg(F.max_by("lab", F.struct("n", "lab")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    of = of.where("n > most").withColumn("part", F.least(F.greatest(F.col("n") / PARTS, F.lit(LEAST_BLOCK)), F.lit(BLOCK)))
    parts = lambda n: F.ceil(F.greatest(n / F.col("part"), F.col("s") / BLOCK_SHINGLES))
    of = of.select("family", "main", parts(F.col("n") - F.col("most")).alias("rows"), parts(F.col("n")).alias("columns"))
    members = with_small(members, written(of, "families"), ["family"], "inner")
    outside = F.col("lab") != F.col("main")
    i, j = F.pmod(F.xxhash64("id", F.lit("row")), "rows"), F.pmod(F.xxhash64("id", F.lit("column")), "columns")
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda k: F.struct(F.xxhash64("family", i, k).alias("g"), F.lit(0).alias("side")))
    down = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda k: F.struct(F.xxhash64("family", k, j).alias("g"), F.lit(1).alias("side")))
    places = F.concat(down, F.when(outside, across).otherwise(F.array().cast("array<struct<g:bigint,side:int>>")))
    placed = with_small(sets, written(members.select("node", places.alias("at")), "placed"), ["node"], "inner", salts=1)
    placed = placed.select(F.explode("at").alias("at"), "label", "hashes").select("at.g", "at.side", "label", "hashes")
    return written(placed.repartition("g").sortWithinPartitions("g", "side").mapInArrow(_cross(pct), "a binary, b binary").distinct(), "rest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pct: int = SIMILARITY_PCT) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable by links of pct percent
    Jaccard similarity), kept (it is that document)."""
    rows = signatures(docs, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = written(rows.where("node IS NOT NULL").groupBy("node").agg(first, F.min("sketch").alias("sketch"), F.min("n_shingles").alias("size"), F.count(F.lit(1)).alias("n_rows")), "classes")
    pairs = written(candidates(classes), "candidates")
    links = confirmed(docs, classes, pairs, doc_id, text, pct)
    labels = components(links)
    nodes = written(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    discard(classes, pairs, links, labels)
    more = rest(docs, nodes, doc_id, text, pct)
    owner = nodes.select("node", "n_rows", F.col("first.doc_id").alias("own"), "label")
    if more is not None:
        wider = components(more).select(F.col("node").alias("label"), F.col("label").alias("wider"))
        owner = with_small(owner, wider, ["label"]).select("node", "n_rows", "own", F.coalesce("wider", "label").alias("label"))
    lowest = written(owner.groupBy("label").agg(F.min("own").alias("component_id")), "lowest")
    owner = written(with_small(owner, lowest, ["label"]).select("node", "n_rows", "component_id"), "components")
    # texts with very many copies are few: their rows find them by a broadcast, and no partition of the rest is hot
    hot = owner.where(F.col("n_rows") >= HOT_ROWS).select("node", F.struct("component_id").alias("hot"))
    out = with_small(rows.select("doc_id", "text_hash", "n_shingles", "node").where("node IS NOT NULL"), hot, ["node"])
    cool = with_small(out.where("hot IS NULL").drop("hot"), owner.where(F.col("n_rows") < HOT_ROWS).select("node", "component_id"), ["node"], salts=1)
    out = out.where("hot IS NOT NULL").withColumn("component_id", F.col("hot.component_id")).drop("hot").unionByName(cool)
    alone = rows.where("node IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pct: int = SIMILARITY_PCT) -> DataFrame:
    """docs (all columns) without the documents that are not their component's smallest."""
    gone = near_duplicates(docs, doc_id, text, pct).where(~F.col("kept")).select(F.struct("doc_id", "text_hash").alias("at")).distinct()
    rows = docs.select(row(docs), F.struct(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("text_hash")).alias("at"))
    return with_small(rows, written(gone, "gone"), ["at"], "left_anti", salts=1, sieve=True).select("__row.*")


def op10_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
