"""Near-duplicate classes of shingle sets by a parity-sketch join.

Sets A and B with intersection at least t = num / den of the union differ in at most (1 - t) / (1 + t) of |A| + |B|
elements. Parity sketches XOR words of the elements together, so the Hamming distance of two sketches is a lower bound
of the symmetric difference. There are two kinds: sketches of 64-bit symbols, of which elements flip whole symbols, to
find candidates; and sketches of bits, of which an element flips one bit, to compare them.

1. Exact classes: a set's 64-bit hash stands for all texts that have it. Each task sends a class once.
2. Size bands grow by 1/t, so linked sets are in the same or neighbouring bands. In the bands' common group at most d
   elements differ. The group's sketches have d + r symbols, each the XOR of the hashes of its elements: at least r
   symbols of linked sets agree. A class sends a key for each symbol that holds elements. Where it has r or more
   symbols without elements, linked sets could agree in those alone, so it sends the keys of another sketch, with
   elements dealt anew, as well: if one such set is left without a common key in one turn, both take the next. r is
   such that few sets need a second turn. Sets that need more than TURNS share one key of their group. Nothing is
   capped, and all links are among classes that share a key.
3. Keys with the same classes are one bucket. Bit sketches, wide enough that unrelated sets lie at least DEVIATIONS
   standard deviations beyond the bound, are compared among a bucket's classes; those whose distance allows a link are
   joined by union-find; a task passes on a spanning forest, never the pairs of a bucket, and connected components make
   the clusters in Spark.
4. A cluster's sets meet with their elements; a block counts common elements of what its sketches allow (exactly,
   unless already linked) and passes on a spanning forest.

A bucket or cluster of more than BLOCK_ROWS classes is dealt to cells of about that many, so no task gathers more than
two cells. Each cell has one class of the group besides, another for each group, which joins near copies of one text in
one pass; classes that are not in the largest component by then meet the cells of all others. Classes with many copies are joined back
by broadcast (at most HOT_CLASSES of them).

Edge cases: a null or empty text has no shingles, a component of its own and no links; a text of fewer words than a
shingle is one shingle; repeated rows give repeated rows of one component; a text that only rows with null ids have links
nothing, other rows with null ids get their text's component; other columns are ignored; an empty table gives no rows.
A similarity below 0.75 is refused: its parts would hold too few elements.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, components, delete, partitions, saved
from ._text import GOLDEN, U64, mix64, shingles, slices

BLOCK_ROWS = 1024
BROADCAST_ROWS = 1_000_000  # candidates up to which their list is broadcast (about 100 MB); beyond, a shuffle join
TURNS = 12
DEVIATIONS = 7
HOT_CLASSES = 4096


class Bands:
    """Size bands, and the symbols of each group's sketches, for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        if 4 * num < 3 * den or num > den:
            raise ValueError("similarity must be from 0.75 to 1")
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low)
        # a group g holds the sets of bands g - 1 and g that may be linked with one of band g: of so many elements
        self.least = np.concatenate([[1], -(-self.low[1:-1] * num // den)])
        differ = (den - num) * 2 * (self.low[1:] - 1) // (den + num)
        self.spare = np.array([self._spare(int(d), int(n)) for d, n in zip(differ, self.least, strict=True)])
        self.parts = np.where(differ > 0, differ + self.spare, 0)  # sets that may not differ are equal
        self.words = np.array([self._words(int(n)) for n in self.low[1:] - 1])

    @staticmethod
    def _spare(d: int, n: int) -> int:
        """How many symbols of linked sets must agree: more than the smallest set is likely to have empty."""
        r = 1
        while d:
            empty = (d + r) * np.exp(-n / (d + r))
            if empty + 2 * np.sqrt(empty) < r + 0.5:
                return r
            r = max(r + 1, int(r * 1.02))
        return r

    def _words(self, n: int) -> int:
        """64-bit words of a bit sketch of n elements: chance lies DEVIATIONS beyond what two linked sets differ in."""
        words = 4
        while True:
            bits = 64 * words
            chance, bound = bits / 2 * -np.expm1(-4 * n / bits), 2 * n * (self.den - self.num) / (self.den + self.num)
            if chance - bound >= DEVIATIONS * np.sqrt(bits) / 2 or bits >= 8 * n:
                return words
            words *= 2

    def of(self, size):
        return np.searchsorted(self.low, size, "right") - 1

    def far(self, a, b):
        """The most elements in which linked sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: the sum of its mixed elements and its size, mixed again."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(77)), dtype=U64)])
        return mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U64) * GOLDEN).view(np.int64)


def part_keys(h: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set of each key, key) for both groups of every set."""
    size = np.diff(offsets)
    value = mix64(h + U64(5))
    owners, keys = [], []
    for up in (0, 1):
        group = bands.of(np.maximum(size, 1)) + up
        live = np.flatnonzero((size > 0) & (bands.parts[group] > 0) & (size >= bands.least[group]))
        for turn in range(TURNS + 1):
            if not len(live):
                break
            salt = mix64((group[live] * 64 + turn).astype(U64) + U64(1000))
            if turn == TURNS:
                owners.append(live)
                keys.append(mix64(salt + U64(1)))
                break
            n, parts = size[live], bands.parts[group[live]]
            base = np.concatenate([[0], np.cumsum(parts)])
            own = np.repeat(np.arange(len(live)), n)
            at = np.arange(int(n.sum())) + np.repeat(offsets[:-1][live] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            spread = mix64(h[at] ^ mix64(np.array([turn + 99], U64))) >> U64(32)
            cell = base[own] + ((spread * parts[own].astype(U64)) >> U64(32)).astype(np.int64)
            symbols, held = np.zeros(base[-1], U64), np.zeros(base[-1], bool)
            np.bitwise_xor.at(symbols, cell, value[at])
            held[cell] = True
            owner = np.repeat(np.arange(len(live)), parts)
            number = np.arange(base[-1]) - base[owner]
            full = np.flatnonzero(held)
            owners.append(live[owner[full]])
            keys.append(mix64(mix64(symbols[full] + salt[owner[full]]) + number[full].astype(U64)))
            live = live[np.bincount(owner[~held], minlength=len(live)) >= bands.spare[group[live]]]
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


class Forest:
    """Union-find over 0..n-1; join() says whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def buckets(runs, most: int):
    """Yield (bucket, id) arrays from runs of (key, id) sorted by both: the keys that several ids share.

    Keys with the same ids are one bucket, named by the ids and yielded once in a run. A key of more than ``most`` ids
    is a bucket of its own, named by the key, and passed on as it comes.
    """
    key, held, long = None, [], False

    def whole(keys, ids):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.diff(np.append(first, len(keys)))
        shared = np.repeat(many > 1, many)
        ids, many = ids[shared], many[many > 1]
        if len(ids):
            first = np.cumsum(many) - many
            with np.errstate(over="ignore"):
                name = mix64(np.add.reduceat(mix64(ids.view(U64)), first) + many.astype(U64) * GOLDEN)
            _, once = np.unique(name, return_index=True)
            keep = np.zeros(len(many), bool)
            keep[once] = True
            rows = np.repeat(keep, many)
            yield np.repeat(name, many)[rows].view(np.int64), ids[rows]

    def distinct(keys, ids):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        return keys[new], ids[new]

    def last():
        if held and not long:
            ids = np.unique(np.concatenate(held))
            yield from whole(np.full(len(ids), key), ids)

    for keys, ids in runs:
        if not len(keys):
            continue
        if keys[0] == key:
            end = int(np.searchsorted(keys, key, "right"))
            held.append(ids[:end])
            if not long and sum(map(len, held)) > most and len(np.unique(np.concatenate(held))) > most:
                long = True
            if long:
                ids_ = np.unique(np.concatenate(held))
                yield np.full(len(ids_), key), ids_
                held = []
            keys, ids = keys[end:], ids[end:]
        if len(keys):
            yield from last()
            begin = int(np.searchsorted(keys, keys[-1], "left"))
            yield from whole(*distinct(keys[:begin], ids[:begin]))
            key, held, long = keys[-1], [ids[begin:]], False
    yield from last()


def sketches(h: np.ndarray, offsets: np.ndarray, bands: Bands) -> list[bytes]:
    """The bit sketch of each set, as wide as its band asks for (a power of two of 64-bit words)."""
    size = np.diff(offsets)
    words = bands.words[np.minimum(bands.of(np.maximum(size, 1)), len(bands.words) - 1)]
    base = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(base[-1], U64)
    owner = np.repeat(np.arange(len(size)), size)
    np.bitwise_xor.at(out, base[owner] + ((h >> U64(6)) & (words[owner] - 1).astype(U64)).astype(np.int64), U64(1) << (h & U64(63)))
    raw = out.tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip(base[:-1], base[1:], strict=True)]


def folded(raw: list[bytes]) -> np.ndarray:
    """Sketches as a matrix of the shortest one's width; halves of longer ones are folded onto each other by XOR."""
    width = min(map(len, raw)) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(r, U64).reshape(-1, width), axis=0) for r in raw])


def close_edges(ids: np.ndarray, size: np.ndarray, raw: list[bytes], side: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """A spanning forest of a block's classes whose sizes and sketches allow a link. side: as for link_block."""
    order = np.argsort(size, kind="stable")
    ids, size, side, sketch = ids[order], size[order], side[order], folded([raw[i] for i in order])
    out, root = [], np.arange(len(ids))
    for i in range(len(ids) - 1):
        hi = int(np.searchsorted(size, size[i] * bands.den // bands.num, "right"))
        far = np.flatnonzero((root[i + 1 : hi] != root[i]) & ((side[i] == 2) | (side[i + 1 : hi] != side[i]))) + i + 1  # the others are linked already
        if len(far):
            distance = np.bitwise_count(sketch[far] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            for j in far[distance <= bands.far(size[i], size[far])].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((int(ids[i]), int(ids[j])))
    return out


def link_block(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block. side: 0 and 1 where only pairs across are due, else 2."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    ids, side, size, sets = ids[order], side[order], size[order], [sets[i] for i in order]
    n, out, forest = len(ids), [], Forest(len(ids))
    words = int(bands.words[min(int(bands.of(size[-1])), len(bands.words) - 1)])
    sketch = np.zeros((n, words), U64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    np.bitwise_xor.at(sketch, (row, ((every >> U64(6)) & U64(words - 1)).astype(np.intp)), U64(1) << (every & U64(63)))
    for i in range(n - 1):
        hi = int(np.searchsorted(size, size[i] * bands.den // bands.num, "right"))
        if hi <= i + 1:
            continue
        far = np.bitwise_count(sketch[i + 1 : hi] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        close = np.flatnonzero(far <= bands.far(size[i], size[i + 1 : hi])) + i + 1
        if side[i] != 2:
            close = close[side[close] != side[i]]
        for j in close.tolist():
            if forest.find(i) == forest.find(j):
                continue
            at = np.minimum(np.searchsorted(sets[j], sets[i]), size[j] - 1)
            common = int(np.count_nonzero(sets[j][at] == sets[i]))
            if bands.den * common >= bands.num * (int(size[i]) + int(size[j]) - common):
                forest.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, words: int = 4, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bands = Bands(*similarity)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def classify(batches):
        for batch in batches:
            n, own = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in slices(batch.column(1)):
                h, place = shingles(data, offsets, words)
                n[lo:hi], own[lo:hi] = np.diff(place), set_ids(h, place)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(own)], names=["id", "n", "set"])

    def sketch(batches):
        sent = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, place = shingles(data, offsets, words)
                own = set_ids(h, place)
                _, first = np.unique(own, return_index=True)
                first = np.sort(first[~np.isin(own[first], sent)])
                sent = np.concatenate([sent, own[first]])
                size = np.diff(place)[first]
                pick = np.repeat(place[:-1][first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                owner, key = part_keys(h[pick], np.concatenate([[0], np.cumsum(size)]), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[first][owner])], names=["key", "set"])

    def share(batches):
        for a, b in buckets(((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches), BLOCK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["bucket", "set"])

    def read(batches):
        """(wanted rows, their places, elements, offsets) for each slice of a batch of set, text, ...."""
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                h, place = shingles(data, offsets, words)
                ids = set_ids(h, place)
                # an id may stand for several texts; the others are not the wanted one
                pick = np.flatnonzero(ids == batch.column(0).slice(lo, hi - lo).to_numpy())
                yield batch.slice(lo, hi - lo).take(pa.array(pick)), pick, h, place

    def sketch_wanted(batches):
        for part, pick, h, place in read(batches):
            own = sketches(h, place, bands)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(place)[pick]), pa.array([own[i] for i in pick], pa.binary())], names=["set", "n", "sketch"])

    def elements(batches):
        for part, pick, h, place in read(batches):
            raw = h.tobytes()
            entries = part.column(2).to_pylist()
            many = [len(e) for e in entries]
            own = [raw[8 * place[i] : 8 * place[i + 1]] for i in pick]
            flat = [e for x in entries for e in x]
            yield pa.RecordBatch.from_arrays([pa.array([e["block"] for e in flat], pa.int64()), pa.array(np.repeat(part.column(0).to_numpy(), many)), pa.array([e["side"] for e in flat], pa.int32()), pa.array([x for x, m in zip(own, many, strict=True) for _ in range(m)], pa.binary())], names=["block", "set", "side", "elements"])

    def grouped(batches, width, work):
        """Rows of consecutive equal keys go to ``work``, which returns pairs."""
        key, rows, out = None, [], []

        def told():
            a = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
                if k != key:
                    if len(rows) > 1:
                        out.extend(work(rows))
                    key, rows = k, []
                rows.append(row)
            yield told()
        if len(rows) > 1:
            out.extend(work(rows))
        yield told()

    def near(rows):
        ids, side, size, raw = zip(*rows, strict=True)
        return close_edges(np.array(ids), np.array(size), raw, np.array(side), bands)

    def linked_rows(rows):
        ids, side, sets = zip(*rows, strict=True)
        return link_block(np.array(ids), [np.frombuffer(s, U64) for s in sets], np.array(side), bands)

    def allow(batches):
        yield from grouped(batches, 5, near)

    def verify(batches):
        yield from grouped(batches, 4, linked_rows)

    classes = saved(texts.mapInArrow(classify, "id long, n long, set long"))
    many = partitions(spark)
    keys = texts.where("text is not null").select("text").mapInArrow(sketch, "key long, set long").repartition(many, "key").sortWithinPartitions("key", "set")
    shared = saved(keys.mapInArrow(share, "bucket long, set long").distinct())  # copies share many symbols, so many equal buckets
    unique = classes.where("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"))

    def with_texts(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The wanted sets with one of their texts; few enough ids are broadcast, others join by a shuffle."""
        wanted = saved(wanted)
        few = wanted.count() <= BROADCAST_ROWS
        return texts.where("text is not null").join(F.broadcast(wanted) if few else wanted, "id"), wanted

    wanted = unique.join(shared.select("set").distinct(), "set").select(F.col("least").alias("id"), "set")
    some, wanted = with_texts(wanted)
    sketched = saved(some.select("set", "text").mapInArrow(sketch_wanted, "set long, n long, sketch binary"))
    candidates = components(met(shared, "bucket", lambda cells: cells.join(sketched, "set").select("block", "set", "side", "n", "sketch"), allow))
    members = saved(candidates.withColumnRenamed("node", "set").withColumnRenamed("root", "cluster").join(unique.select("set", "least"), "set"))
    spent = [shared, wanted, sketched, members, candidates]

    def with_elements(cells: DataFrame) -> DataFrame:
        entries = cells.groupBy("set").agg(F.collect_list(F.struct("block", "side")).alias("blocks"))
        some, own = with_texts(members.join(entries, "set").select(F.col("least").alias("id"), "set", "blocks"))
        spent.append(own)
        return some.select("set", "text", "blocks").mapInArrow(elements, "block long, set long, side int, elements binary")

    links = met(members.select("cluster", "set"), "cluster", with_elements, verify)
    linked = components(links)
    # each class takes the smallest id of its component
    label = linked.withColumnRenamed("node", "set").join(unique.select("set", "least"), "set")
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = label.select("set", "root").join(least, "root").select("set", "component_id")
    labelled = unique.join(label, "set", "left").select(F.col("set").alias("s"), "least", F.coalesce("component_id", "least").alias("component_id"), "copies")
    labelled = saved(labelled.where("copies > 1 or component_id <> least"))  # any other class is one row of its own
    for x in (*spent, linked):
        delete(x)
    # a class with more than one in HOT_CLASSES of all rows would land in one task; there are at most so many
    hot = max(1000, classes.count() // HOT_CLASSES)
    common = labelled.where(F.col("copies") > hot).select(F.col("s").alias("h"), F.col("component_id").alias("of_hot"))
    rare = labelled.where(F.col("copies") <= hot).select("s", "component_id")
    rows = classes.join(F.broadcast(common), (F.col("set") == F.col("h")) & (F.col("n") > 0), "left")
    found = rows.where("h is null and n > 0").join(rare, F.col("set") == F.col("s"), "left").select("id", "n", "component_id")
    out = found.unionByName(rows.where("h is not null or n = 0").select("id", "n", F.col("of_hot").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def met(rows: DataFrame, group: str, attach, compare) -> DataFrame:
    """(a, b): edges that join what ``compare`` finds linked within the groups of rows (group, set).

    ``attach`` gives cells (block, set, side) what ``compare`` needs of each set; a block is compared in one task. A group
    of up to BLOCK_ROWS sets is one block. The sets of a larger one are dealt to cells of about that many, each with one
    set of the group besides, by a hash of both, so near copies of one text are all joined in one pass. What is then not in the group's
    largest component meets everything else of the group: its cells pair with each other and with those of the rest.
    """
    many = partitions(rows.sparkSession)

    def compared(cells: DataFrame) -> DataFrame:
        return saved(attach(cells).repartition(many, "block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long"))

    def small(df: DataFrame) -> DataFrame:
        df = saved(df)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    salt = lambda n: F.pmod(F.xxhash64("set"), n).cast("int")
    block = lambda kind, *x: F.xxhash64(group, F.lit(kind), *x).alias("block")
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    two = F.lit(2).alias("side")
    cells_of = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    large = small(rows.groupBy(group).agg(F.count("*").alias("n"), F.min_by("set", F.xxhash64("set", group)).alias("pivot")).where(F.col("n") > BLOCK_ROWS).select(group, "pivot", cells_of(F.col("n")).alias("salts")))
    if not large.count():
        return compared(rows.select(block(0), "set", two))
    r = rows.join(large, group, "left")
    own = r.where("pivot is null or set <> pivot").select(F.when(F.col("pivot").isNull(), block(0)).otherwise(block(1, salt(F.col("salts")))).alias("block"), "set", two)
    pivots = large.select(group, F.col("pivot").alias("set"), upto(F.col("salts")).alias("s")).select(block(1, F.col("s")), "set", two)
    first = compared(own.unionByName(pivots))
    root = components(first)
    held = rows.join(large.select(group), group, "left_semi").join(root, F.col("set") == F.col("node"), "left")
    held = saved(held.select(group, "set", F.coalesce("root", "set").alias("c")))
    top = held.groupBy(group, "c").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("c", "n").alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"))
    top = small(top.where("n > in_main").select(group, "main", cells_of(F.col("n") - F.col("in_main")).alias("o"), cells_of(F.col("in_main")).alias("m")))
    rest = held.join(top, group)
    other, main = rest.where(F.col("c") != F.col("main")).withColumn("s", salt(F.col("o"))), rest.where(F.col("c") == F.col("main")).withColumn("s", salt(F.col("m")))
    among = other.withColumn("t", upto(F.col("o"))).select(block(2, F.least("s", "t"), F.greatest("s", "t")), "set", F.when(F.col("s") == F.col("t"), 2).otherwise((F.col("s") < F.col("t")).cast("int")).alias("side"))
    across = other.withColumn("t", upto(F.col("m"))).select(block(3, "s", "t"), "set", F.lit(0).alias("side"))
    back = main.withColumn("t", upto(F.col("o"))).select(block(3, "t", "s"), "set", F.lit(1).alias("side"))
    second = compared(among.unionByName(across).unionByName(back))
    delete(root)
    return first.unionByName(second)
