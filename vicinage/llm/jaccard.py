"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. A set of ``a`` shingles that links with another
(100 * intersection >= 80 * union) differs from it by at most a div 4 shingles, counted on both sides.
Per size band the 64-bit hash space is cut into blocks and the shingles of a block are XOR-ed into its
parity signature: a difference of one shingle changes one block at most, so linked sets agree in all
but a div 4 blocks (pigeonhole). Under one order of all signatures, the first (a div 4) + 1 of each set
therefore suffice to meet. The order is by the number of sets that hold a signature, counted over the
whole corpus: those of a single set come first and need no partner, those of a passage or template that
very many sets share come last and are used by the sets only that hold little else. A 512-bit parity
sketch, whose Hamming distance is at most the symmetric difference, rejects most wrong candidates, and
the rest are verified on the whole sets.

Equal sets are one node from the start. Linked groups are not expanded into pairs: each set is first
verified with the leader it shares most signatures with (leaders are the sets that meet most others,
so the text that a group's copies come from), components are contracted, then only pairs of sets in
different components are compared, each pair verified once; the last round leaves no such pair of a
common signature out, so no link between components is lost.
Sets are named by 64-bit hashes; n distinct sets share a name in n*n / 2**65 cases expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import bound_batches, release
from .components import components, contract
from ..storage import materialize
from .words import U64, buffers, mix, shingle_sets, word_hashes

WIDTH = 5
#: Longs of the verification sketch; sets of a signature in one pack that travel packed.
SKETCH, PACKED = 8, 64
#: Nodes up to which their names are broadcast to pick texts (32 bytes each); a join beyond it.
BROADCAST_NODES = 500_000
#: Comparisons a row of the last round may cost before more sets are linked by leaders first.
COMPARED = 256
#: Signatures that a task holds before it sends them on; bytes of input whose signatures meet in a task.
HELD, SHARE_BYTES = 500_000, 32 << 20
#: Rows of a file of the tables between the rounds.
PART_ROWS = 200_000


def set_name(s: np.ndarray) -> np.uint64:
    whole = np.bitwise_xor.reduce(mix(s), keepdims=True) + s.sum(dtype=U64, keepdims=True) * U64(0x9E3779B97F4A7C15)
    return mix(whole + U64(len(s)))[0]


def blocks(band: int) -> int:
    """Blocks of a size band (sets of 2**band to 2**(band+1) - 1 shingles): two to three shingles each,
    more blocks for small sets, and always more than a quarter of the largest set."""
    top = 1 << (band + 1)
    return top if band <= 4 else -(-top * 35 // 100)


def needed(size):
    """Signatures, first in the order, under which a set of ``size`` shingles meets all that link."""
    return size // 4 + 1


def signatures(s: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(band, signatures) of a sorted set of hashes, for its own size band and, where a set that links
    may be in it, the next. Empty blocks are signatures too, but come last in the order, by value;
    they are given out only where the others are fewer than needed."""
    a = len(s)
    if a < 4:  # links with equal sets only
        return []
    band = a.bit_length() - 1
    out = []
    spread = mix(s ^ U64(0x5851F42D4C957F2D))
    for j in (band, band + 1) if 5 * a >= 4 << (band + 1) else (band,):
        m = blocks(j)
        block = ((s >> U64(32)) * U64(m)) >> U64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        value = mix(np.bitwise_xor.reduceat(spread, first) + (block[first] * U64(64) + U64(j)) * U64(0xD6E8FEB86659FD93))
        if len(first) < needed(a):
            empty = np.setdiff1d(np.arange(m, dtype=U64), block[first])
            empty = np.sort(mix((empty * U64(64) + U64(j)) * U64(0xD6E8FEB86659FD93)))
            value = np.append(value, empty[: needed(a) - len(first)])
        out.append((j, value))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parity bits: every shingle flips one."""
    bits = np.bincount((s & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(batch, width: int):
    data, offsets = buffers(batch.column("text"))
    for at in range(0, batch.num_rows, 1024):
        part = offsets[at : at + 1025]
        flat, bounds = word_hashes(data, part)
        yield at, shingle_sets(flat, bounds, width)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, U64).view(np.int64))


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are not given are null."""
    cells = [pa.nulls(rows, f.type) if columns.get(f.name) is None else columns[f.name] for f in schema]
    return pa.RecordBatch.from_arrays(cells, schema=schema)


_DOCUMENT = [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())]
_SENT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("sig", pa.int64()), ("node", pa.int64()), ("sigs", pa.binary()), ("nodes", pa.binary()), *_DOCUMENT])
_FOUND = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("node", pa.int64()), *_DOCUMENT])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _parts(documents: DataFrame) -> int:
    """Partitions that signatures are dealt to: as the session says, more for a larger input (whose
    size Spark knows if it comes from files; it puts exabytes where it does not)."""
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARE_BYTES if size < 1 << 50 else 0)


def _find(documents: DataFrame, width: int) -> DataFrame:
    """From (doc_id, key, text), rows of two kinds: 0, a document with its set's name (node), size (n)
    and numbers of signatures in its even and its odd band; 1, a (sig, node) of every signature that
    two sets share, some twice. Signatures travel packed by partition; the lowest of the 40 bits
    above the partition says whether the band is odd."""
    parts = _parts(documents)

    def truncated(s):
        """Per band parity the distinct signatures of a set as part | 32 bits << 24."""
        for j, value in signatures(s):
            low = ((value // U64(parts)) & U64(0xFFFFFFFE)) | U64(j & 1)
            yield j & 1, np.unique((value % U64(parts)) | (low << U64(24)))

    def packed_rows(keys, key_nodes):
        sig, node = np.concatenate(keys), np.concatenate(key_nodes)
        part, low = (sig & U64(0xFFFFFF)).astype(np.int64), (sig >> U64(24)).astype(np.uint32)
        order = np.lexsort((low, part))
        sig, part, low, node = sig[order], part[order], low[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        place = np.arange(len(sig)) - np.repeat(start, np.diff(np.append(start, len(sig))))
        if (over := place >= PACKED).any():  # a hot signature: only some of its rows meet in one task
            hot, n = node[over], int(over.sum())
            yield _batch(_SENT, n, kind=pa.array(np.full(n, 2, np.int32)), part=pa.array((hot % U64(parts)).astype(np.int32)), sig=_longs(sig[over]), node=_longs(hot))
            part, low, node = part[~over], low[~over], node[~over]
        ends = np.searchsorted(part, np.arange(parts + 1))
        filled = np.flatnonzero(ends[1:] > ends[:-1])
        cut = lambda x: pa.array([x[ends[p] : ends[p + 1]].tobytes() for p in filled], pa.binary())
        yield _batch(_SENT, len(filled), kind=pa.array(np.ones(len(filled), np.int32)), part=pa.array(filled.astype(np.int32)), sigs=cut(low), nodes=cut(node))

    def sketches(batches):
        seen: dict[int, tuple] = {}
        keys, key_nodes, held = [], [], 0
        for batch in batches:
            sizes, own, counts = [], [], []
            for _, sets in _sets(batch, width):
                for s in sets:
                    sizes.append(len(s))
                    if not len(s):
                        own.append(None)
                        counts.append((0, 0))
                        continue
                    name = set_name(s)
                    own.append(int(name.view(np.int64)))
                    if own[-1] not in seen:  # equal sets of a task are sent once
                        count = [0, 0]
                        for odd, found in truncated(s):
                            keys.append(found)
                            key_nodes.append(np.full(len(found), name))
                            count[odd] = len(found)
                        seen[own[-1]] = tuple(count)
                        held += sum(count)
                    counts.append(seen[own[-1]])
            n = len(sizes)
            even, odd = np.asarray(counts, np.int64).reshape(n, 2).T
            yield _batch(_SENT, n, kind=pa.array(np.zeros(n, np.int32)), part=pa.array((np.arange(n) % parts).astype(np.int32)), node=pa.array(own, pa.int64()), doc_id=batch.column("doc_id"), key=batch.column("key"), n=pa.array(np.asarray(sizes, np.int64)), even=pa.array(even.copy()), odd=pa.array(odd.copy()))
            if held > HELD:
                yield from packed_rows(keys, key_nodes)
                keys, key_nodes, held = [], [], 0
        if keys:
            yield from packed_rows(keys, key_nodes)
        release()

    def shared(batches):
        parts_, lows, nodes = [], [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for k in (0, 2):
                if (kind == k).any():
                    b = batch.filter(pa.array(kind == k))
                    columns = {f.name: b.column(f.name) for f in _FOUND}
                    yield _batch(_FOUND, b.num_rows, **columns | {"kind": pa.array(np.full(b.num_rows, min(k, 1), np.int32))})
            if (kind == 1).any():
                b = batch.filter(pa.array(kind == 1))
                for p, low, node in zip(b.column("part").to_pylist(), b.column("sigs").to_pylist(), b.column("nodes").to_pylist()):
                    lows.append(np.frombuffer(low, np.uint32))
                    nodes.append(np.frombuffer(node, U64))
                    parts_.append(np.full(len(lows[-1]), p, np.uint32))
        if lows:
            key, node = np.concatenate(parts_) | (np.concatenate(lows).astype(U64) << U64(24)), np.concatenate(nodes)
            del parts_, lows, nodes
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)  # equal sets of several tasks
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
            many = ~(edge[:-1] & edge[1:])
            key, node = key[many], node[many]
            for at in range(0, len(key), HELD):
                part = slice(at, at + HELD)
                yield _batch(_FOUND, len(key[part]), kind=pa.array(np.ones(len(key[part]), np.int32)), sig=_longs(key[part]), node=_longs(node[part]))
        release()

    sent = documents.select("doc_id", "key", "text").mapInArrow(sketches, _ddl(_SENT)).repartition(parts, "part")
    return materialize(sent.mapInArrow(shared, _ddl(_FOUND)), "signatures")


def _members(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node) of the signatures under which sets must meet: a set's first in the order, less those
    that it holds alone."""
    shared = found.filter("kind = 1").select("sig", "node")
    held = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"))
    odd = F.shiftright("sig", 24).bitwiseAND(F.lit(1)).alias("odd")
    counted = shared.join(held, "sig").select("sig", "node", "sets", odd)
    own = Window.partitionBy("node", "odd")
    places = counted.select("*", F.row_number().over(own.orderBy("sets", "sig")).alias("place"), F.count(F.lit(1)).over(own).alias("met"))
    sizes = nodes.select(F.col("node").alias("of"), "n", "even", F.col("odd").alias("odds"))
    places = places.join(sizes, F.col("node") == F.col("of"))
    alone = F.when(F.col("odd") == 1, F.col("odds")).otherwise(F.col("even")) - F.col("met")
    kept = places.filter(F.col("place") + alone <= F.floor(F.col("n") / 4) + 1)
    return materialize(kept.select("sig", "node"), "members")


def _candidate_sets(documents: DataFrame, nodes: DataFrame, count: int, width: int) -> DataFrame:
    """(node, n, sketch, shingles) of ``nodes`` (node, row: the smallest that holds the set), computed
    again from their texts, which are found by id and hash, or by the hash alone where the id is null."""
    wanted = nodes.select(F.col("row.doc_id").alias("of"), F.col("row.key").alias("of_key"), F.col("node").alias("expected"))
    if count <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    picked = documents.join(wanted, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "expected")

    def build(batches):
        done: set[int] = set()  # rows that repeat a document
        for batch in batches:
            expected = batch.column("expected").to_numpy()
            for at, sets in _sets(batch, width):
                kept = []
                for e, s in zip(expected[at : at + 1024].tolist(), sets):
                    if e not in done and len(s) and int(set_name(s).view(np.int64)) == e:
                        done.add(e)
                        kept.append((e, s))
                if not kept:
                    continue
                offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in kept])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate([s for _, s in kept])))
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([sketch(s) for _, s in kept])))
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in kept], pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), marks, shingles], ["node", "n", "sketch", "shingles"])
        release()

    sets = materialize(picked.mapInArrow(build, "node long, n long, sketch array<long>, shingles array<long>"), "sets")
    if sets.count() > count:
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int, parts: int) -> DataFrame:
    """The pairs (a, b) that link, tested by size, by sketch, then on the whole sets."""
    def side(name: str, columns: tuple[str, ...]) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    distance = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = pairs.join(side("a", ("n", "sketch")), "a").join(side("b", ("n", "sketch")), "b")
    near = near.filter((large * similarity <= small * 100) & (distance * (100 + similarity) <= (F.col("n_a") + F.col("n_b")) * (100 - similarity)))
    near = materialize(near.select("a", "b"), "near", parts)
    both = near.join(side("a", ("shingles",)), "a").join(side("b", ("shingles",)), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return materialize(both.filter(common * 100 >= union * similarity).select("a", "b"), "links", parts)


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def jaccard_components(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for every row: component_id is the smallest doc_id
    that links reach, node names the row's set (rows with equal sets share it).

    Links need a Jaccard similarity of 0.8 of the shingle sets. Null, empty and wordless texts have
    an empty set, link with nothing and keep their own id; repeated rows and rows that repeat an id
    are linked like others, and so are rows with a null doc_id, through which links reach further; their
    component_id is null only if no row of the component has an id; other columns are ignored; an empty
    table gives no rows."""
    bound_batches(documents.sparkSession)
    similarity = 80  # the bound a div 4 on the symmetric difference belongs to it
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = _find(rows, width)
    docs = found.filter("kind = 0").select("doc_id", "key", "n", "even", "odd", "node")
    nodes = docs.filter("n > 0").groupBy("node", "n", "even", "odd").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("row"))
    members = _members(found, nodes)
    labels = _link_rounds(members, nodes, rows, similarity, width)
    result = nodes.select("node", F.col("row.doc_id").alias("first"))
    if labels is not None:
        named = labels.join(result, "node").groupBy("label").agg(F.min("first").alias("smallest"))
        smallest = labels.join(named, "label").select("node", "smallest")
        result = result.join(smallest, "node", "left").select("node", F.coalesce("smallest", "first").alias("first"))
    joined = docs.select("doc_id", "n", "node").join(result, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"), "node")


def _link_rounds(members: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: int, width: int) -> DataFrame | None:
    """(node, label) of the sets that meet others under ``members``, in verified rounds."""
    parts = 1 + members.count() // PART_ROWS  # no table of the rounds has more rows than members
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(members.join(sizes, "sig"), "members", parts)
    live = members.groupBy("node").agg(F.sum("size").alias("degree"))
    live = materialize(live.join(nodes.select("node", "row"), "node"), "live", parts)
    count = live.count()
    if not count:
        return None
    sets = _candidate_sets(rows, live, count, width)
    degrees = live.select(F.col("node").alias("of"), "degree")
    labels = live.select("node", F.col("node").alias("label"))

    def labelled(table: DataFrame, name: str) -> DataFrame:
        sent = labels.select(F.col("node").alias("of"), F.col("label").alias(f"{name}_label"))
        return table.join(sent, F.col(name) == F.col("of")).drop("of")

    def joined(pairs: DataFrame) -> DataFrame:
        """The labels once the pairs (a, b) are verified and their links contracted."""
        pairs = materialize(pairs.distinct(), "pairs", parts)
        links = labelled(labelled(_verify(pairs, sets, similarity, parts), "a"), "b")
        return contract(labels, links.select("a_label", "b_label"), parts)

    # Each set with the leader it shares most signatures with.
    ranked = members.join(degrees, F.col("node") == F.col("of")).drop("of")
    leaders = ranked.groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("lead"))
    others = members.join(leaders, "sig").filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    others = materialize(others, "leaders", parts)
    best = others.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    labels = joined(best.select(*_ordered(F.col("node"), F.col("lead"))))
    # Then with a leader of every other component among them.
    stars = labelled(labelled(others, "node"), "lead").filter("node_label <> lead_label")
    stars = stars.groupBy("node", "lead_label").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    labels = joined(stars.select(*_ordered(F.col("node"), F.col("lead"))))
    for turn in range(8):
        here = labelled(members.select("sig", "node"), "node")
        shares = here.groupBy("sig", "node_label").agg(F.count(F.lit(1)).alias("n"))
        mixed = shares.groupBy("sig").agg(F.max_by("node_label", F.struct("n", "node_label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size")).filter("labels > 1")
        open_ = materialize(here.join(mixed, "sig").select("sig", "node", "node_label", "main", "size"), "open", parts)
        size = open_.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("node_label") != F.col("main"), F.col("size"))).alias("pairs")).first()
        if turn == 7 or (size["pairs"] or 0) <= COMPARED * size["n"] + 10_000_000:
            break
        # Too much to compare in one round: first another leader of each signature's sets.
        lead = open_.groupBy("sig").agg(F.min_by("node", F.xxhash64(F.lit(turn), "node")).alias("lead"))
        stars = labelled(open_.select("sig", "node", "node_label").join(lead, "sig"), "lead")
        labels = joined(stars.filter("node_label <> lead_label").select(*_ordered(F.col("node"), F.col("lead"))))
    if not size["n"]:
        return labels
    # The last round: every set outside its signature's main component with every set of another
    # component under that signature. Size and sketch are compared inside the join, which gives out
    # the few pairs that pass.
    marks = sets.select(F.col("node").alias("of"), "n", *[F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH)])
    open_ = open_.join(marks, F.col("node") == F.col("of")).drop("of", "size")
    few = open_.filter("node_label <> main").drop("main")
    few = few.select("sig", *[F.col(c).alias(f"x_{c}") for c in few.columns if c != "sig"])
    distance = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"x_k{i}"))) for i in range(SKETCH)), F.lit(0))
    near = (F.greatest("n", "x_n") * similarity <= F.least("n", "x_n") * 100) & (distance * (100 + similarity) <= (F.col("n") + F.col("x_n")) * (100 - similarity))
    other = open_.withColumnRenamed("sig", "y_sig")
    pairs = few.join(other, (F.col("sig") == F.col("y_sig")) & (F.col("x_node_label") != F.col("node_label")) & near)
    return joined(pairs.select(*_ordered(F.col("x_node"), F.col("node"))))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(documents).select("doc_id", "n_shingles", "component_id")
