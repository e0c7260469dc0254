"""Merkle manifest of a table: a digest per row, a tree per source, a tree over the sources, a proof per row.

The trees are evaluated by time-forward processing. A node's label is the last leaf below it, then its level, so
that labels ascend from children to parents; a node sends its digest to the label of its parent and is evaluated
when all that was sent to it has arrived. The queue is external: rows wait in Spark's sorted shuffle, cut in blocks
of ``ARITY ** LEVELS`` consecutive nodes, and a task holds the messages of one block. What leaves a block is a row
of the next round, so a source of any size is spread over many tasks and no round holds more than its nodes.
A second sweep runs in descending label order and hands each node the proof of its parent with its own siblings
before it, until every leaf has its proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare.operators.ordered import with_index
from stationcare.session import staged

ARITY = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: in a proof: between the siblings left and right of a node, and between two levels
SIDES, STEPS = ".", ","


def row_digest(*fields: Column) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    written = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
               for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*written), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _height(nodes: int, levels: int, arity: int) -> int:
    """Levels above the nodes of a block. A full block has them all; a smaller first block is a whole tree."""
    height = 0
    while arity ** height < nodes and height < levels:
        height += 1
    return height


def _forward(digests: list[str], height: int, arity: int) -> list[list[str]]:
    """Digests by level, leaves first: nodes leave the queue in label order and send theirs to the parent."""
    n, made = len(digests), [list(digests)] + [[] for _ in range(height)]
    queue: list[tuple[int, int, int, str]] = []  # last leaf below the receiver, its level, place of the sender, digest

    def send(level: int, place: int, digest: str) -> None:
        if level <= height:
            width = arity ** level
            heapq.heappush(queue, (min((place // arity + 1) * width, n) - 1, level, place, digest))

    for leaf, digest in enumerate(digests):
        send(1, leaf, digest)
        while queue and queue[0][0] <= leaf:
            label, arrived = queue[0][:2], []
            while queue and queue[0][:2] == label:
                _, level, place, below = heapq.heappop(queue)
                arrived.append(below)
            own = _hash(arrived)
            made[level].append(own)
            send(level + 1, place // arity, own)
    return made


def _backward(made: list[list[str]], proof: str, arity: int) -> list[str]:
    """Proofs of the leaves: labels descend, each node sends its proof to its children."""
    height, n = len(made) - 1, len(made[0])
    proofs = [""] * n
    queue = [(-(n - 1), -height, 0, proof)]
    while queue:
        _, level, place, known = heapq.heappop(queue)
        level = -level
        if not level:
            proofs[place] = known
            continue
        run = made[level - 1][arity * place:arity * (place + 1)]
        width = arity ** (level - 1)
        for i in range(len(run)):
            child = arity * place + i
            step = "".join(run[:i]) + SIDES + "".join(run[i + 1:])
            heapq.heappush(queue, (1 - min((child + 1) * width, n), 1 - level, child,
                                   step + STEPS + known if known else step))
    return proofs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one block; rows come sorted by (tree, block, position)."""
    rows = (row for batch in batches for part in range(0, batch.num_rows, 4096)
            for row in batch.slice(part, 4096).to_pylist())
    for _, run in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield list(run)


def _gathered(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _raised(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """``tree, position, digest``: the top node of every block."""
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[dict]:
            for rows in _blocks(batches):
                digests = [r["digest"] for r in rows]
                top = _forward(digests, _height(len(digests), levels, arity) if not rows[0]["block"] else levels, arity)[-1]
                yield {"tree": rows[0]["tree"], "position": rows[0]["block"], "digest": top[0]}
        yield from _gathered(tops(), schema)

    block = F.floor(F.col("position") / F.lit(arity ** levels)).cast("long")
    placed = nodes.select("tree", block.alias("block"), "position", "digest").repartition("tree", "block")
    return placed.sortWithinPartitions("tree", "block", "position").mapInArrow(
        run, "tree string, position long, digest string")


def _lowered(nodes: DataFrame, above: DataFrame, carried: list[str], levels: int, arity: int) -> DataFrame:
    """``nodes`` with ``proof`` and ``subroot``, from ``above (tree, position, proof, subroot)``, a row per block.

    The rows of ``above`` stand before the nodes of their block, so a task meets them first.
    """
    block = F.floor(F.col("position") / F.lit(arity ** levels)).cast("long")
    names = ["tree", "block", "position", "digest", *carried, "proof", "subroot"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("proof", "subroot")]
    own = nodes.select("tree", block.alias("block"), "position", "digest", *carried, *nothing)
    sent = above.select("tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"),
                        F.lit(None).cast("string").alias("digest"),
                        *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carried], "proof", "subroot")
    both = own.unionByName(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    kept = both.select([c for c in names if c != "block"]).schema
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leaves() -> Iterator[dict]:
            for rows in _blocks(batches):
                head, rows = rows[0], rows[1:]
                digests = [r["digest"] for r in rows]
                height = levels if head["block"] else _height(len(digests), levels, arity)
                proofs = _backward(_forward(digests, height, arity), head["proof"], arity)
                for row, proof in zip(rows, proofs, strict=True):
                    row.pop("block")
                    yield row | {"proof": proof, "subroot": head["subroot"]}
        yield from _gathered(leaves(), arrow)

    return both.mapInArrow(run, kept)


def _rounds(nodes: DataFrame, levels: int, arity: int) -> list[DataFrame]:
    """Nodes of each round, the last with one node for every tree. Each round is written once."""
    out = [nodes]
    while True:
        out.append(staged(_raised(out[-1], levels, arity), "merkle-round"))
        if not out[-1].agg(F.max("position")).first()[0]:
            return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source",
             carried: dict[str, Column] | None = None, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``key, group, leaf, subroot, root, proof`` and the ``carried`` texts: one row per row of ``docs``.

    Leaves of a group stand in the order of ``key``, nulls first, rows of one key by their digest (repeated rows
    are leaves of their own); groups stand in the order of their names, the null group first. While there is
    more than one node, each run of ``arity`` nodes becomes the digest of its digests; the last run may be shorter.
    ``proof`` lists, from the leaf to the root, the siblings left and right of the node on the path. A leaf alone in
    the only group is the root, and its proof is empty. An empty table gives an empty table. Columns that are not
    named are not read.
    """
    carried = carried or {}
    leaves = docs.select(F.col(key).cast("long").alias("_own"), F.col(group).cast("string").alias("tree"),
                         row_digest(*[F.col(c) for c in fields]).alias("digest"),
                         *[c.alias(f"_c_{n}") for n, c in carried.items()])
    extra = ["_own", *[f"_c_{n}" for n in carried]]
    numbered = with_index(staged(leaves, "merkle-leaves"), ["_own", "digest"], by=["tree"], index="position")
    trees = _rounds(staged(numbered.withColumn("position", F.col("position").cast("long") - 1), "merkle-nodes"), levels, arity)
    subroots = with_index(trees[-1].select(F.col("tree").alias("_group"), "digest"), ["_group"], index="position")
    subroots = staged(subroots.select(F.lit("").alias("tree"), (F.col("position").cast("long") - 1).alias("position"),
                                      "digest", "_group"), "merkle-subroots")
    tops = _rounds(subroots, levels, arity)
    top = tops[-1].first()
    above = tops[-1].select("tree", "position", F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(tops[:-1]):
        above = _lowered(nodes, above, ["_group"] if nodes is subroots else [], levels, arity)
    above = above.select(F.col("_group").alias("tree"), F.lit(0).cast("long").alias("position"), "proof",
                         F.col("digest").alias("subroot"))
    for nodes in reversed(trees[:-1]):
        above = _lowered(nodes, above, extra if nodes is trees[0] else [], levels, arity)
    return above.select(F.col("_own").alias(key), F.col("tree").alias(group), F.col("digest").alias("leaf"), "subroot",
                        F.lit(top["digest"] if top else None).alias("root"), "proof",
                        *[F.col(f"_c_{n}").alias(n) for n in carried])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    steps = F.filter(F.split(proof, STEPS), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(
        F.split_part(step, F.lit(SIDES), F.lit(1)), digest, F.split_part(step, F.lit(SIDES), F.lit(2))), 256))


def siblings_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, from the leaf to the root."""
    return F.sha2(F.translate(proof, SIDES + STEPS, ""), 256)


def tampering_found(docs: DataFrame) -> DataFrame:
    """A manifest of ``docs``, and for each row whether its proof still holds for what the row has become.

    Rows whose doc_id has an even crc32 lose the line ends of their text, null texts stay; a null doc_id counts as
    an empty number. ``folded_root`` is what the row as it is then leads to, ``verified`` whether that is the root.
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    altered = row_digest(*[text if c == "text" else F.col(c) for c in FIELDS])
    made = manifest(docs, carried={"altered": altered}).withColumn("folded_root", folded(F.col("altered"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
