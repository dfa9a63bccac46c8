"""SimHash fingerprints and near duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, returning, written
from .components import components

#: Shingles whose bits are counted at once, so that a text of any length takes a bounded amount of memory.
CHUNK = (1 << 16) - 1
#: Segments of a fingerprint for distances that the pigeonhole covers.
SEGMENTS = 3
#: Segments of a word, their bits and their balls' radius in plans for similarities, where the pigeonhole does not help.
PER_WORD, WIDTH, RADIUS = 3, 20, 0
#: Words of a wide fingerprint that are made of shingles; the plan's words are permutations of their bits, by this seed.
MADE, PERMUTED = 8, 20
#: Segments by whose least rows groups are joined first; all segments' links follow, so that this number decides no result.
STARS = 15
#: Texts whose shingles a worker holds at once; rows and shingles of a block of texts that are all compared, and shingles whose
#: truth values are held at once.
SLICE, BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 500, 512, 1 << 20, 4096
#: Share of the pairs at the threshold that such a plan must make candidates; words of a wide fingerprint that are compared
#: before the shingles are, and by how many standard deviations their distance may be above its mean.
RECALL, CHECKED, SPREAD = 0.997, 2, 3


def fingerprint(text: bytes, shingle_words: int, n_words64: int = 1, seed: int = 42) -> list[int]:
    """``n_words64`` signed 64-bit fingerprints of a text: of its shingles' XXH64, and of further mixes of that.

    A bit is set if it is set in over half of the shingle hashes, repeats included. A text of fewer words than a
    shingle is one shingle; one without words has zeros.
    """
    words = text.lower().split()  # bytes: only A-Z change, and the six ASCII blanks cut
    if not words:
        return [0] * n_words64
    n = max(1, len(words) - shingle_words + 1)
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(64 * n_words64, np.int64)
    for i in range(0, n, CHUNK):
        part = np.stack([mixed(hashes[i : i + CHUNK], j) for j in range(n_words64)], axis=1).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > n, bitorder="little").view(np.int64).tolist()


def mixed(hashes: np.ndarray, j: int) -> np.ndarray:
    """The j-th of any number of independent 64-bit hashes that follow from one; the first is that one."""
    if not j:
        return hashes
    x = hashes + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle_words: int, n_words64: int = 1, content: str | None = None
) -> DataFrame:
    """(id long, f0 long, f1 long, ...) for every row; a null text counts as empty.

    ``content`` names a further column, a 64-bit hash of the whole text.
    """
    names = [f"f{j}" for j in range(n_words64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            prints = [fingerprint(t or b"", shingle_words, n_words64) for t in batch.column(1).to_pylist()]
            columns = np.array(prints, np.int64).reshape(-1, n_words64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[:, j]) for j in range(n_words64)), *batch.columns[2:]], ["id", *names, *more]
            )

    more = [content] if content else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *(_content(F.col(text_col)).alias(c) for c in more)
    )
    return rows.mapInArrow(returning(run), "id long, " + ", ".join(f"{n} long" for n in [*names, *more]))


def segments(max_distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each of the SEGMENTS of a 64-bit fingerprint, at every table size.

    The radii are the smallest for which the pigeonhole holds: two fingerprints within ``max_distance`` agree to within
    the radius in some segment, as the radii plus one sum to more than the distance.
    """
    cuts = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    spare, more = divmod(max(0, max_distance + 1 - SEGMENTS), SEGMENTS)
    return [(a, b - a, spare + (i < more)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _flips(width: int, radius: int) -> list[int]:
    return [reduce(lambda x, b: x | 1 << b, c, 0) for r in range(radius + 1) for c in combinations(range(width), r)]


def _field(word, shift: int, width: int):
    mask = (1 << width) - 1
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(mask).cast("long"))


def _all_bits(a: str, b: str, names: list[str]):
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in names])


def expected_distance(similarity: float) -> float:
    """The share of bits in which texts of a Jaccard similarity of their shingles differ on average: their angle's."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _agreement(part: float, width: int, radius: int) -> float:
    """How likely a segment of ``width`` bits agrees to within ``radius``, where a ``part`` of the bits differ."""
    return sum(math.comb(width, r) * part**r * (1 - part) ** (width - r) for r in range(radius + 1))


def wide_plan(similarity: float) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """(words, distance, plan) that find texts of so high a similarity, whatever the number of texts.

    At a similarity well below 1 too many bits differ for the pigeonhole to help, so the segments are many: the fewest words
    by which some segment agrees to within RADIUS at that similarity in RECALL of cases, by the model of independent bits, and
    in more cases above it. The words are ``permuted`` ones, so that less is found than by the model: 0.98 at 0.8, the tests'
    figure. The distance is that of the first CHECKED words made of shingles and allows for SPREAD standard deviations.
    """
    part = expected_distance(similarity)
    missed = (1 - _agreement(part, WIDTH, RADIUS)) ** PER_WORD
    words = max(CHECKED, math.ceil(math.log(1 - RECALL) / math.log(missed)))
    bits = 64 * CHECKED
    distance = math.floor(bits * part + SPREAD * math.sqrt(bits * part * (1 - part)))
    return words, distance, [(w, i * WIDTH, WIDTH, RADIUS) for w in range(words) for i in range(PER_WORD)]


def permuted(prints: DataFrame, names: list[str], compared: list[str], words: int) -> tuple[DataFrame, list[str]]:
    """``prints`` (id, *names) as (id, *compared, p0, p1, ...), and the names of the latter: words of permuted bits of all ``names``."""
    order = np.random.default_rng(PERMUTED)
    bits = np.concatenate([order.permutation(64 * len(names))[:64] for _ in range(words)])
    made = [f"p{j}" for j in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            own = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            of = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1, bitorder="little")
            out = np.ascontiguousarray(np.packbits(of[:, bits], axis=1, bitorder="little")).view(np.int64)
            columns = [batch.column(c) for c in ("id", *compared)] + [pa.array(np.ascontiguousarray(out[:, j])) for j in range(words)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *compared, *made])

    return prints.select("id", *names).mapInArrow(returning(run), ", ".join(f"{c} long" for c in ["id", *compared, *made])), made


def _entries(names: list[str], plan: list[tuple[int, int, int, int]], flipped: bool):
    """Keys under which a fingerprint stands in the tables of all segments, or by which it asks them."""

    def ball(i: int, w: int, s: int, k: int, r: int):
        value = _field(F.col(names[w]), s, k)
        flips = F.array(*(F.lit(x).cast("long") for x in _flips(k, r)))
        return F.transform(flips, lambda x: value.bitwiseXOR(x) * len(plan) + i)

    if not flipped or not any(r for *_, r in plan):
        return F.explode(F.array(*(_field(F.col(names[w]), s, k) * len(plan) + i for i, (w, s, k, _) in enumerate(plan))))
    return F.explode(F.flatten(F.array(*(ball(i, *segment) for i, segment in enumerate(plan)))))


def star_links(
    prints: DataFrame, names: list[str], max_distance: int, plan: list[tuple[int, int, int, int]], compared: list[str] | None = None
) -> DataFrame:
    """(a, b) links between rows and the smallest id of each table entry they stand under: as many as entries at most.

    ``plan`` may be a part of a plan.
    """
    compared = compared or names
    t = prints.select("id", *compared, _entries(names, plan, False).alias("key"))
    first = t.groupBy("key").agg(F.min(F.struct("id", *compared)).alias("s"), F.count("*").alias("n")).where("n > 1")
    first = first.select("key", "s.*").alias("p")
    near = (F.col("p.id") < F.col("t.id")) & (_all_bits("p", "t", compared) <= max_distance)
    found = t.alias("t").join(first, (F.col("p.key") == F.col("t.key")) & near)
    return found.select(F.col("p.id").alias("a"), F.col("t.id").alias("b")).distinct()


def links(
    prints: DataFrame, names: list[str], max_distance: int, plan: list[tuple[int, int, int, int]], compared: list[str] | None = None
) -> DataFrame:
    """(a, b) pairs, a < b, of rows (id, *names) whose fingerprints differ in at most ``max_distance`` bits in all.

    ``plan`` has (word, shift, width, radius): each row is entered once in the table of every segment, and asks it for
    all values within the radius. A match is verified by the complete distance inside the join, or that of the words
    ``compared``, so what leaves the join is links only; ``distinct`` drops those that several segments found. Rows with
    a column ``group`` are only linked with rows of other groups.
    """
    compared = compared or names
    more = [c for c in prints.columns if c == "group"]
    t = prints.select("id", *more, *compared, _entries(names, plan, False).alias("key")).alias("t")
    p = prints.select("id", *more, *compared, _entries(names, plan, True).alias("key")).alias("p")
    near = (F.col("p.id") < F.col("t.id")) & (_all_bits("p", "t", compared) <= max_distance)
    for c in more:
        near = (F.col(f"p.{c}") != F.col(f"t.{c}")) & near
    found = p.join(t, (F.col("p.key") == F.col("t.key")) & near)
    return found.select(F.col("p.id").alias("a"), F.col("t.id").alias("b")).distinct()


def groups(
    prints: DataFrame,
    names: list[str],
    max_distance: int,
    plan: list[tuple[int, int, int, int]],
    compared: list[str] | None = None,
) -> DataFrame:
    """(id, component) of every row: the classes that all links together make.

    First every row is linked with the smallest of each table entry, which joins groups of near copies by as many links as
    they have rows. Then rows are compared with all others of an entry, but links are given out only between what is
    not joined yet, so that no group's pairs are ever listed and yet no link between two groups is lost.
    """
    stars = star_links(prints, names, max_distance, plan[:STARS], compared)
    joined = components(stars).withColumnsRenamed({"node": "id", "component": "group"})  # reads its own last table only
    grouped = written(prints.join(joined, "id", "left").withColumn("group", F.coalesce("group", "id")), "grouped")
    rest = links(grouped, names, max_distance, plan, compared)
    # what joins groups is far less than what they hold: the second time only groups are nodes
    of = grouped.select("id", "group")
    between = rest.join(of.withColumnsRenamed({"id": "a", "group": "ga"}), "a").join(of.withColumnsRenamed({"id": "b", "group": "gb"}), "b")
    over = components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
    out = of.join(over.withColumnRenamed("node", "group"), "group", "left")
    out = written(out.select("id", F.coalesce("component", "group").alias("component")), "grouping")
    forget(grouped)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    max_distance: int = 4,
    n_words64: int = 1,
    plan: list[tuple[int, int, int, int]] | None = None,
    content: str | None = None,
) -> DataFrame:
    """(id, f0.., component) for every row of ``docs``: fingerprints, and the smallest id linked to the row's.

    Rows with equal fingerprints are one entry of the tables, so a group of copies of any size costs one row there.
    Null texts count as empty, and texts without words have fingerprint zero, linked like any other. Rows of a null
    id keep their fingerprint and get the component of the rows that share it. Repeated rows come back repeated.
    """
    spark = docs.sparkSession
    names = [f"f{j}" for j in range(n_words64)]
    more = [content] if content else []
    prints = written(fingerprints(docs, id_col, text_col, shingle_words, n_words64, content), "fingerprints")
    if prints.isEmpty():
        return prints.withColumn("component", F.col("id"))
    distinct = written(prints.groupBy(*names).agg(F.min("id").alias("id")), "distinct")
    plan = plan or [(0, *x) for x in segments(max_distance)]
    linked = groups(distinct.where("id is not null"), names, max_distance, plan)
    named = distinct.join(linked, "id", "left").select(*names, F.coalesce("component", "id").alias("component"))
    return prints.join(named, names).select("id", *names, *more, "component")


def shingle_set(text: bytes, shingle_words: int, seed: int = 42) -> np.ndarray:
    """The distinct signed 64-bit hashes of a text's shingles, cut as for its fingerprint; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - shingle_words + 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), seed) for i in range(n))
    return np.unique(np.fromiter(hashes, np.uint64, n)).view(np.int64)


def shingle_sets(found: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """(content, shingles array<long>) of the texts that the links (a, b) of ``found`` name.

    ``texts`` has (content, text) rows, repeated ones too; only those that a link names are cut into shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            sets = [shingle_set(t.as_py(), shingle_words) for t in batch.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["content", "shingles"])

    linked = found.select(F.col("a").alias("content")).unionAll(found.select(F.col("b").alias("content"))).distinct()
    wanted = texts.join(linked, "content", "left_semi").dropDuplicates(["content"])
    return written(wanted.select("content", "text").mapInArrow(returning(run), "content long, shingles array<long>"), "shingles")


def alike(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) of ``found`` whose texts' ``sets`` have a Jaccard similarity of ``similarity`` or more."""
    a, b = (sets.select(F.col("content").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    near = F.when(union > 0, common / union >= similarity).otherwise(True)
    return found.join(a, "a").join(b, "b").where(near).select("a", "b")


def similar_classes(classes: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of which a row of ``asked`` and any row are similar; as many as classes at most.

    Exact: the shingles in common are counted for every pair, as products of the rows' truth values by shingle.
    """
    sizes = np.array([len(x) for x in sets])
    common = np.zeros((len(asked), len(sets)), np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        common += (has[asked] @ has.T).astype(np.int64)
    union = sizes[asked][:, None] + sizes[None, :] - common
    near = np.divide(common, union, out=np.ones(common.shape), where=union > 0) >= similarity
    names, of = np.unique(classes, return_inverse=True)
    x, y = np.nonzero(near & (of[asked][:, None] != of[None, :]))
    pairs = np.unique(np.sort(np.stack([of[asked][x], of[y]], axis=1), axis=1), axis=0)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in pairs.tolist():
        if (i := find(i)) != (j := find(j)):
            root[max(i, j)] = min(i, j)
            out.append((int(names[i]), int(names[j])))
    return out


def class_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links between the classes of rough groups that hold similar texts: all that their texts' pairs make.

    ``members`` has (content, rough, class). Every two texts of a rough group that are in different classes are compared, in
    tasks of two blocks of bounded rows and shingles. Texts of the largest class are not compared with each other, nor
    sent to more blocks than the others make; pairs stay inside their task, which gives out classes.
    """
    sized = members.join(sets.select("content", F.size("shingles").cast("long").alias("size")), "content")
    by_class = sized.groupBy("rough", "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    total = by_class.groupBy("rough").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "class")).alias("hub")
    ).where("classes > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    small = (F.col("n") <= BLOCK_ROWS) & (F.col("s") <= BLOCK_SHINGLES)
    plan = total.select(
        "rough", F.when(~small, F.col("hub.class")).alias("hub"),
        F.when(small, 1).otherwise(blocks(F.col("n") - F.col("hub.n"), F.col("s") - F.col("hub.s"))).alias("own"),
        F.when(small, 0).otherwise(blocks(F.col("hub.n"), F.col("hub.s"))).alias("hubs"),
    )
    rows = members.join(written(plan, "blocks"), "rough").withColumn("in_hub", F.coalesce(F.col("class") == F.col("hub"), F.lit(False)))
    block = F.when(F.col("in_hub"), F.col("own") + F.pmod(F.xxhash64("content"), "hubs")).otherwise(F.pmod(F.xxhash64("content"), "own"))
    rows = rows.withColumn("block", block.cast("int"))
    last = F.when(F.col("in_hub"), F.col("own")).otherwise(F.col("own") + F.col("hubs")) - 1
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    dealt = rows.select("content", "rough", "class", "block", other).select(
        "content", "rough", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        # a task of two blocks asks by the first; the first with itself is a task of its own
        asked = np.flatnonzero(block == i[0])
        if i[0] != j[0] and (len(asked) == len(block) or not len(asked)):
            found = []
        else:
            sets = [x.values.to_numpy() for x in table.column("shingles").combine_chunks()]
            found = similar_classes(table.column("class").to_numpy(), sets, asked, similarity)
        return pa.table({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("ab")})

    return dealt.join(sets, "content").groupBy("rough", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def medoid_links(grouped: DataFrame, compared: list[str]) -> DataFrame:
    """(a, b) links between the most central row of every group and its others: as many as rows at most.

    ``grouped`` has (id, component, *compared). Central is the row whose bits differ least from those that most of its group
    has: among edited copies of a text, that text or what is nearest to it.
    """
    several = grouped.groupBy("component").agg(
        F.count("*").alias("n"),
        *(F.sum(F.getbit(w, F.lit(i))).alias(f"{w}_{i}") for w in compared for i in range(64)),
    ).where("n > 1")
    bit = lambda w, i: F.when(2 * F.col(f"{w}_{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    most = several.select("component", *(reduce(lambda x, y: x.bitwiseOR(y), [bit(w, i) for i in range(64)]).alias(f"m_{w}") for w in compared))
    away = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"m_{w}"))) for w in compared])
    near = grouped.join(written(most, "majorities"), "component").select("component", "id", away.alias("away"))
    centre = near.groupBy("component").agg(F.min(F.struct("away", "id"))["id"].alias("a"))
    return centre.join(grouped.select("component", F.col("id").alias("b")), "component").where("a <> b").select("a", "b")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies, with all columns.

    Near copies have a Jaccard similarity of their word shingles of ``similarity`` or more. Wide fingerprints that are near each
    other make rough groups; in these every text is compared by its shingles with the least of each table entry that it shares
    and with the group's most central text, and what is similar enough makes classes. Then all texts of a rough group that are
    in different classes are compared. So no text goes without a chain of real near copies to one that stays, and in a rough
    group no two that are similar stay both. Pairs are never listed; those of a rough group's classes are all compared.

    Texts are linked whatever their ids: null ones too, and rows that share an id but not the text are as any
    other two. The row of the smallest id stays, the first text by its hash where several have that id, and once only if it
    is repeated; without any id in a group, one of its rows. Null and empty texts are copies of each other; an empty table
    gives an empty one. Texts of any length are taken whole, and are told apart by 64 bits of hash.
    """
    words, distance, plan = wide_plan(similarity)
    names = [f"f{j}" for j in range(MADE)]
    compared = names[:CHECKED]
    prints = fingerprints(docs, id_col, text_col, shingle_words, MADE, "content")
    nodes = written(prints.groupBy("content", *names).agg(F.min("id").alias("least")), "nodes")
    texts = docs.select(
        _content(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    points, made = permuted(nodes.withColumnRenamed("content", "id"), names, compared, words)
    points = written(points, "points")
    rough = written(points.join(groups(points, made, distance, plan, compared), "id").select("id", "component", *compared), "rough")
    found = star_links(points, made, distance, plan[:STARS], compared).unionAll(medoid_links(rough, compared))
    ends = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = written(ends, "candidates")
    forget(points)
    sets = shingle_sets(ends, texts, shingle_words)
    linked = written(components(alike(ends, sets, similarity)), "classes").withColumnsRenamed({"node": "content", "component": "class"})
    members = rough.select(F.col("id").alias("content"), F.col("component").alias("rough")).join(linked, "content", "left")
    over = components(class_links(members.withColumn("class", F.coalesce("class", "content")), sets, similarity))
    grouped = nodes.join(linked, "content", "left").withColumn("class", F.coalesce("class", "content"))
    grouped = grouped.join(over.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "content")).alias("first")
    firsts = grouped.groupBy("component").agg(first).select("first.*")
    key = lambda id_: F.coalesce(id_.cast("long"), F.lit(-(2**63)))
    wanted = firsts.select(key(F.col("least")).alias("key"), "content").distinct()
    rows = docs.select(F.struct("*").alias("row"), key(F.col(id_col)).alias("key"), _content(F.col(text_col)).alias("content"))
    kept = rows.join(wanted, ["key", "content"], "left_semi").dropDuplicates(["key", "content"])
    return kept.select("row.*")


def _content(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
