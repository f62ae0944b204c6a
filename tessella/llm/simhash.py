"""SimHash near-duplicates by a self-join of a binary trie.

Two fingerprints within ``errors`` bits agree wholly in one of ``errors + 1`` blocks of bits. So each
distinct fingerprint is dealt out once for each block, keyed by that block's bits: a subtree of the
trie that reads these bits first. In a subtree, pairs of nodes are traversed together, level by
level, adding up differing bits, and a pair goes as soon as its sum exceeds the budget. Subtrees
with too many fingerprints are dealt out again by blocks of their remaining bits, which is exact for
the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import append_columns, checkpoint, connected_components, group_bounds, local_components, shuffle_width, whole_groups

#: Distinct fingerprints in a subtree above which it is dealt out again.
SUBTREE = 20_000


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 hashes of a text's word shingles, repeats included, in arrays of at most 65,536.

    Words are runs without ASCII white space after lower-casing A-Z; fewer words than ``shingle``
    are one shingle, and no word gives no hash.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), stops.tolist()
    for at in range(0, n, 1 << 16):
        yield np.array([digest(line[a:b], seed) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, unsigned; zero if it has no words.

    A bit is set if it is in over half of the hashes of :func:`shingle_hashes`.
    """
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle, seed):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Add ``fingerprint long`` (the 64 bits as a signed number) to every row of ``docs``, which has ``text``."""

    def make():
        def one(text):
            value = fingerprint(text, shingle)
            return (value - (1 << 64) if value >> 63 else value,)

        return one

    return append_columns(docs, ["text"], [("fingerprint", "long", pa.int64())], make)


def _deal(rows: DataFrame, bits: int, blocks: int) -> tuple[DataFrame, int]:
    """Deal each row out once for each block of its ``bits`` low code bits; the block joins the path."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    choices = []
    for k in range(blocks):
        low, high = cuts[k], cuts[k + 1]
        value = F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        below = F.col("code").bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned("code", high), low) if high < 64 else F.lit(0).cast("long")
        choices.append(F.struct(F.xxhash64("path", F.lit(k), value).alias("path"), above.bitwiseOR(below).alias("code")))
    carried = [c for c in rows.columns if c not in ("path", "code")]
    dealt = rows.withColumn("choice", F.explode(F.array(*choices)))
    return dealt.select("choice.path", "choice.code", *carried), bits - min(b - a for a, b in zip(cuts, cuts[1:], strict=False))


def trie_edges(rows: DataFrame, bits: int, budgets: list[tuple[list[str], int]], subtree: int = SUBTREE) -> DataFrame:
    """Edges ``(a, b)`` that connect what pairs of ``rows(path, code, node, ...)`` of one path within all ``budgets`` connect.

    ``code`` has ``bits`` bits. A budget is a list of 64-bit columns and the most bits in which a
    pair may differ over them; the first is that of the code, by which the trie is pruned. No link
    is lost: within each subtree all pairs under the budget are visited. Of the links found in one
    task only those are returned that are needed to connect the nodes, a star to the smallest.
    """
    errors = budgets[0][1]
    blocks = errors + 1
    rows, bits = _deal(rows, bits, blocks)
    done = []
    while True:
        hot = checkpoint(rows.groupBy("path").count().where(F.col("count") > subtree).select("path"))
        if bits <= 4 * blocks or hot.isEmpty():
            done.append((rows, bits))
            break
        done.append((rows.join(hot, "path", "left_anti"), bits))
        rows, bits = _deal(rows.join(hot, "path", "left_semi"), bits, blocks)
    edges = None
    for part, width in done:
        n = shuffle_width(part.sparkSession)
        sorted_ = part.repartition(n, "path").sortWithinPartitions("path", "code")
        found = sorted_.mapInArrow(_trie_join(width, budgets), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
    return edges


def linked_fingerprints(distinct: DataFrame, errors: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Edges ``(a, b)`` that connect what pairs of ``distinct(fingerprint, node)`` within ``errors`` bits connect."""
    rows = distinct.select(F.lit(0).cast("long").alias("path"), F.col("fingerprint").alias("code"), "fingerprint", "node")
    return trie_edges(rows, 64, [(["fingerprint"], errors)], subtree)


def _trie_join(bits: int, budgets: list[tuple[list[str], int]]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["path"]):
            path, code, node = (table.column(c).to_numpy() for c in ("path", "code", "node"))
            tests = [(np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in columns]), most) for columns, most in budgets]
            label = trie_components(group_bounds(path), code.view(np.uint64), tests, bits)
            moved = label != np.arange(len(label))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], schema=schema)

    return run


def trie_components(bounds: np.ndarray, code: np.ndarray, tests: list[tuple[np.ndarray, int]], bits: int, pairs: int = 1 << 20) -> np.ndarray:
    """For each row the first row that links reach from it.

    ``bounds`` delimit subtrees, in each of which ``code`` (its low ``bits`` bits) is sorted. A trie
    node is a range of rows; a frontier holds pairs of nodes with the bits that differ so far. Rows
    link if each test's words differ in no more bits than it allows, the first also bounding paths.
    """
    n, errors = len(code), tests[0][1]
    label = np.arange(n)
    keep = np.diff(bounds) > 1
    lo, hi = bounds[:-1][keep], bounds[1:][keep]
    front = (lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))
    for bit in range(bits - 1, -2, -1):
        a0, a1, b0, b1, apart = front
        small = (a1 - a0) * (b1 - b0) <= (16 if bit >= 0 else np.iinfo(np.int64).max)
        label = _leaves(a0[small], a1[small], b0[small], b1[small], tests, label, pairs)
        if small.all() or bit < 0:
            break
        a0, a1, b0, b1, apart = (x[~small] for x in (a0, a1, b0, b1, apart))
        ones = np.concatenate([[0], np.cumsum((code >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, apart), (am, a1, bm, b1, apart), (a0, am, bm, b1, apart + 1), (am[~same], a1[~same], b0[~same], bm[~same], apart[~same] + 1)]
        front = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        live = (front[1] > front[0]) & (front[3] > front[2]) & (front[4] <= errors) & ~((front[0] == front[2]) & (front[1] == front[3]) & (front[1] - front[0] == 1))
        front = tuple(x[live] for x in front)
    return label


def _leaves(a0, a1, b0, b1, tests, label, pairs):
    """Compare all pairs of rows that small node pairs hold, and join what is within the budgets."""
    size = (a1 - a0) * (b1 - b0)
    while len(size):
        upto = max(1, int(np.searchsorted(np.cumsum(size), pairs, side="right")))
        if size[0] > pairs:  # cut one large node pair by rows of its first node
            rows = max(1, int(pairs // (b1[0] - b0[0])))
            for at in range(int(a0[0]), int(a1[0]), rows):
                i, j = np.meshgrid(np.arange(at, min(at + rows, int(a1[0]))), np.arange(b0[0], b1[0]), indexing="ij")
                label = _join(i.ravel(), j.ravel(), tests, label)
        else:
            s = size[:upto]
            which = np.repeat(np.arange(upto), s)
            within = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
            across = (b1 - b0)[:upto][which]
            label = _join(a0[:upto][which] + within // across, b0[:upto][which] + within % across, tests, label)
        a0, a1, b0, b1, size = (x[upto:] for x in (a0, a1, b0, b1, size))
    return label


def _join(i, j, tests, label):
    fits = (i < j) & (label[i] != label[j])
    i, j = i[fits], j[fits]
    for words, most in tests:
        near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= most
        i, j = i[near], j[near]
    return local_components(len(label), i, j, label)


def near_duplicates(docs: DataFrame, errors: int = 3, shingle: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Near-duplicate classes of whole documents ``docs(doc_id, text)`` by fingerprints.

    One row per row of ``docs``: ``doc_id, fingerprint long, component_id`` (smallest doc_id that
    links of ``errors`` bits or fewer reach, itself included). Null and empty texts have the
    fingerprint zero, which links like any other. Equal fingerprints are one node, so a group of
    copies of any size costs one row after the first aggregation. A row with a null id has its
    class, whose smallest id is null only if all its ids are.
    """
    prints = checkpoint(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"))
    distinct = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    components = connected_components(linked_fingerprints(distinct, errors, subtree))
    return prints.join(checkpoint(_named(distinct, components).select("fingerprint", "component_id")), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _named(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes(node, first, ...)`` with ``component_id``, the smallest ``first`` of a node's component."""
    placed = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return placed.join(placed.groupBy("component").agg(F.min("first").alias("component_id")), "component")


#: Near copies: tables of short fingerprints with a bit budget each, and the bits of a further one with a budget of its own.
TABLES, TABLE_BITS, TABLE_ERRORS = 14, 24, 2
CHECK_BITS, CHECK_ERRORS = 128, 36
#: Shingles of the texts in a block of a candidate class; larger classes are verified block against block.
BLOCK = 1 << 20
_WORDS = -(-(CHECK_BITS + TABLES * TABLE_BITS) // 64)
_STEPS = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set in ``64 * _WORDS`` bits, as booleans; each hash gives as many mixed bits."""
    ones = np.zeros(64 * _WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 255):  # so many ones fit in a byte
        x = shingles[at : at + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(shingles)


_PLACES = 1 << np.arange(TABLE_BITS, dtype=np.int64)


def _sketch(text: str | None, shingle: int) -> tuple[int, int, int, list[int]]:
    """Shingles of a text, the two words of its checking fingerprint, and a code for each table."""
    own = shingle_set(text, shingle)
    bits = wide_fingerprint(own)
    check = np.packbits(bits[:CHECK_BITS], bitorder="little").view(np.int64)
    codes = bits[CHECK_BITS : CHECK_BITS + TABLES * TABLE_BITS].reshape(TABLES, TABLE_BITS) @ _PLACES
    return len(own), int(check[0]), int(check[1]), codes.tolist()


_SKETCH = [("size", "long", pa.int64()), ("check0", "long", pa.int64()), ("check1", "long", pa.int64()), ("codes", "array<long>", pa.list_(pa.int64()))]


def near_copies(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, block: int = BLOCK, subtree: int = SUBTREE) -> DataFrame:
    """Classes of near copies of whole documents ``docs(doc_id, text)``, by SimHash and exact similarity.

    One row per row of ``docs``: ``doc_id, component_id`` (smallest doc_id that links reach, itself
    included). Texts link whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``threshold`` or more. Candidates are pairs within the bit budgets of one of ``TABLES`` trie
    self-joins over parts of a wide fingerprint; the classes that candidates form are then verified
    by whole shingle sets. A pair of similarity 0.8 differs in 15 % of its bits and stays outside
    all budgets with a probability of 1 %, one of 0.85 with 0.1 % (the tests hold it against brute
    force). Null texts, empty ones and those without words are copies of each other. Equal texts are
    one node from the first aggregation on; rows with a null id link with nothing, and have a null
    ``component_id``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64("text", F.lit(1))})
    prints = checkpoint(append_columns(keyed, ["text"], _SKETCH, lambda: lambda text: _sketch(text, shingle)).drop("text"))
    found = prints.where("doc_id is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c, _, _ in _SKETCH])
    nodes = checkpoint(found.withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", "check0", "check1", F.posexplode("codes").alias("table", "own"))
    rows = rows.select(F.col("table").cast("long").alias("path"), F.col("own").alias("code"), "own", "node", "check0", "check1")
    candidates = connected_components(trie_edges(rows, TABLE_BITS, [(["own"], TABLE_ERRORS), (["check0", "check1"], CHECK_ERRORS)], subtree))
    members = checkpoint(nodes.select("node", "first", "key", "key2", "size").join(candidates, "node"))
    sizes = members.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block)).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    texts = keyed.select(F.col("doc_id").alias("first"), "key", "key2", "text")
    dealt = placed.join(texts, ["first", "key", "key2"]).withColumn("other", F.explode(others))
    groups = dealt.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "text")
    sorted_ = groups.repartition(shuffle_width(docs.sparkSession), "group").sortWithinPartitions("group")
    components = connected_components(sorted_.mapInArrow(_verify(threshold, shingle), "a long, b long"))
    classes = checkpoint(_named(nodes, components).select("key", "key2", "component_id"))
    return prints.where("doc_id is not null").join(classes, ["key", "key2"]).select("doc_id", "component_id").unionByName(prints.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id")))


def similar_components(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Smallest index that links of at least ``threshold`` reach from each set; pairs already connected are not compared."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [token[b - k : b] for b, k in zip(ends, size, strict=True)]
    mark = np.zeros(len(flat), dtype=bool)
    for i in range(n - 1):
        fits = (label != label[i]) & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9)
        fits[: i + 1] = False
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        mark[own[i]] = True
        shared = np.array([np.count_nonzero(mark[own[j]]) for j in others])
        mark[own[i]] = False
        near = others[shared >= threshold * (size[others] + size[i] - shared) - 1e-9]
        if len(near):
            joined = np.isin(label, label[np.append(near, i)])
            label[joined] = label[joined].min()
    return label


def _verify(threshold: float, shingle: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["group"], 2_000):
            node = table.column("node").to_numpy()
            bounds = group_bounds(table.column("group").to_numpy())
            a, b = [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                label = similar_components([shingle_set(t.as_py(), shingle) for t in table.column("text")[low:high]], threshold)
                moved = np.flatnonzero(label != np.arange(high - low))
                a.append(node[low + moved])
                b.append(node[low + label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return run


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document of each class of :func:`near_copies`, that of the smallest doc_id, with all columns of ``docs``; repeated rows of an id stay together."""
    classes = near_copies(docs.select("doc_id", "text"), threshold, shingle)
    gone = classes.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, errors: int = 3, shingle: int = 3) -> DataFrame:
    """One document of each class of :func:`near_duplicates`, as :func:`drop_near_copies`."""
    classes = near_duplicates(docs.select("doc_id", "text"), errors, shingle)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
