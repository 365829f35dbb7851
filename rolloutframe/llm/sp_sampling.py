"""SentencePiece encoding and decoding with sampled segmentations.

A text gets a blank in front, and is cut where no piece can cross: before a run of blanks and around line breaks. A
segment's lattice has an arc for every vocabulary piece, and an arc of byte pieces for a character without one; the
blank sign U+2581 itself, standing in a text, is always spelled in bytes, so decoding can tell it from a blank.

Forward filtering sums the weights of all ways to each place of the distinct segments of a slice, in logarithms, place
by place for all segments together. Backward sampling then draws from the end: the last piece with the probability that
it has given what follows, and so on to the front; all segments of the slice step back together. The random numbers are
a hash of the row's key, the segment's place in the text and the step, so reruns, other partitionings and lost
executors give the same pieces.

The vocabulary's scores of a BPE model are negated merge ranks; a piece of rank r weighs (r + 2) ** -alpha (Zipf), a
byte piece as the last rank. A large alpha favours early merges and few pieces.

A segment of more than LONG characters is filtered in chunks of CHUNK that advance together: a chunk's map from the
weights at the places in front of it to those at its end is a matrix; the matrices are applied from left to right, and
the chunks then run again from the weights that they begin with. Its random numbers hash the place instead of the step,
so that all places draw at once and only the path is followed one piece after another.

Decoding concatenates the pieces' bytes and drops the blank in front; it returns every text exactly.

Edge cases: a null text is encoded as an empty one, which has no pieces; repeated rows get the same pieces; a null key is
a key of its own; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._text import GOLDEN, ODD, U64, mix64, range_hashes, slices

SIGN = "\u2581"
SIGN_POINT = 0x110000  # a U+2581 that stands in a text: no code point, so no piece holds it
BUCKET_BITS = 20
LONG, CHUNK = 4096, 512  # characters: of segments whose places are filtered in chunks, and of a chunk
AT_ONCE = 1 << 17  # characters of segments whose lattices are built together: about 80 MB


class Lattice:
    """The vocabulary as sorted hashes of its pieces' code points, with log weights."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte, raw, pieces = np.zeros(256, np.int32), [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                raw.append(bytes([int(piece[3:-1], 16)]))
                self.byte[raw[-1][0]] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(piece.replace(SIGN, " ").encode())
                pieces.append((-sp.get_score(i), i, piece.replace(SIGN, " ")))
        pieces.sort()
        if crossing := [p for _, _, p in pieces if " " in p.lstrip(" ") or "\n" in p]:
            raise ValueError(f"pieces cross segments: {crossing[:5]}")
        self.longest = max(len(p) for _, _, p in pieces)
        if self.longest > 512:
            raise ValueError("a piece is too long for its hash")
        self.byte_weight = -alpha * np.log(len(pieces) + 2.0)
        points = np.array([ord(c) for _, _, p in pieces for c in p])
        ends = np.cumsum([len(p) for _, _, p in pieces])
        size = np.diff(np.concatenate([[0], ends]))
        h = Hashes(points)(ends - size, size)
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array([i for _, i, _ in pieces])[order]
        self.weight = (-alpha * np.log(np.arange(len(pieces)) + 2.0))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        bucket = self.keys >> U64(64 - BUCKET_BITS)
        self.bucket = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1, dtype=U64)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max())
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h of the hashes that pieces have, their rows)."""
        at = (h >> U64(64 - BUCKET_BITS)).astype(np.int64)
        row, end = self.bucket[at], self.bucket[at + 1]
        live = np.flatnonzero(row < end)
        row, end, found, rows = row[live], end[live], [], []
        for _ in range(self.deepest):
            good = self.keys[row] == h[live]
            found.append(live[good])
            rows.append(row[good])
            on = ~good & (row + 1 < end)
            live, row, end = live[on], row[on] + 1, end[on]
            if not len(live):
                break
        found, rows = np.concatenate(found), np.concatenate(rows)
        order = np.argsort(found, kind="stable")
        return found[order], rows[order]


class Hashes:
    """64-bit polynomial hashes of short ranges of code points, by prefix sums: pieces are looked up with them.

    Modulo 2**64 strings from some 1,000 characters on can be made to collide, so segments are told apart by range_hashes.
    """

    power = inverse = np.ones(1, U64)

    @classmethod
    def powers(cls, n: int):
        if len(cls.power) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("power", int(ODD)), ("inverse", pow(int(ODD), -1, 1 << 64))):
                    factors = np.full(size, base, U64)
                    factors[0] = 1
                    setattr(cls, name, np.cumprod(factors, dtype=U64))
        return cls.power, cls.inverse

    def __init__(self, points: np.ndarray):
        power, self.inverse = self.powers(len(points) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(points) + 1, U64)
            np.cumsum((points.astype(U64) + U64(1)) * power[: len(points)], out=self.total[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.total[start + size] - self.total[start]) * self.inverse[start] + U64(0x2545F4914F6CDD1D) * np.asarray(size).astype(U64)
            x ^= x >> U64(32)
            x *= U64(0xBF58476D1CE4E5B9)
            return x ^ (x >> U64(29))


def encode_slice(own: Lattice, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, offsets) of the texts of a slice."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    points[points == ord(SIGN)] = SIGN_POINT
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in characters
    full = np.flatnonzero(np.diff(first) > 0)
    points = np.insert(points, first[full], 32)
    begin = first[full] + np.arange(len(full))
    # segments: blanks and what follows them, line breaks alone
    blank, line = points == 32, points == 10
    cut = line.copy()
    cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    cut[begin] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    text_of = full[np.searchsorted(begin, start, "right") - 1]
    hashes = Hashes(points)
    _, pick, which = np.unique(range_hashes(points.astype("<u4").view(np.uint8), 4 * start, 4 * (start + size)), return_index=True, return_inverse=True)
    ends, entry, keys, back, piece = lattices(own, points, hashes, start[pick], size[pick])
    count = np.bincount(text_of, minlength=n)
    offset = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        state = mix64(mix64(seeds[text_of] + GOLDEN) + (np.arange(len(start)) - offset[text_of]).astype(U64) * U64(0xD1342543DE82EF95))
        long = np.flatnonzero(size > LONG)
        node, live, steps = ends[which], np.flatnonzero(size <= LONG), []
        node, state_of = node[live], state
        state = state[live]
        pieces = np.zeros(len(start), np.int64)
        paths = [walked(own, state_of[i], int(ends[which[i]]), int(size[i]), entry, keys, back, piece) for i in long.tolist()]
        pieces[long] = [len(x) for x in paths]
        while len(live):
            state = state + GOLDEN
            u = (mix64(state) >> U64(11)).astype(np.float64) * 2.0**-53
            x, arc = node + u * (1 - 1e-9), entry[node]
            late = np.flatnonzero(keys[arc] <= x)
            while len(late):
                arc[late] += 1
                late = late[keys[arc[late]] <= x[late]]
            p = piece[arc]
            pieces[live] += np.where(p < 0, spelled_size(-1 - p), 1)
            steps.append((live, p))
            node = back[arc]
            on = node >= 0
            live, node, state = live[on], node[on], state[on]
    at = np.concatenate([[0], np.cumsum(pieces)])
    out, end = np.zeros(int(at[-1]), np.int32), at[1:].copy()
    for i, x in zip(long.tolist(), paths, strict=True):
        out[at[i] : at[i + 1]] = x[::-1]
    for live, p in steps:
        plain = p >= 0
        out[end[live[plain]] - 1] = p[plain]
        end[live[plain]] -= 1
        for x, q in zip(live[~plain].tolist(), p[~plain].tolist(), strict=True):
            ids = spelled(own, q)
            out[end[x] - len(ids) : end[x]] = ids
            end[x] -= len(ids)
    return out, at[offset]


def spelled(own: Lattice, piece: int) -> list[int]:
    """The byte pieces of a character, -1 - code point."""
    c = -1 - piece
    return own.byte[list((SIGN if c == SIGN_POINT else chr(c)).encode())].tolist()


def walked(own: Lattice, state: np.uint64, last: int, size: int, entry, keys, back, piece) -> list[int]:
    """The sampled pieces of one segment, from its end to its front."""
    lo = last - size + 1
    node = np.arange(lo, last + 1)
    u = (mix64(state + (node - lo).astype(U64) * GOLDEN) >> U64(11)).astype(np.float64) * 2.0**-53
    first, end = entry[lo], entry[last + 1] if last + 1 < len(entry) else len(keys)
    arc = np.minimum(first + np.searchsorted(keys[first:end], node + u * (1 - 1e-9), "right"), end - 1)
    before, ids, at, out = back[arc].tolist(), piece[arc].tolist(), last, []
    while at >= 0:
        p = ids[at - lo]
        if p >= 0:
            out.append(p)
        else:
            out += spelled(own, p)[::-1]
        at = before[at - lo]
    return out


def forward(weight: np.ndarray) -> np.ndarray:
    """Log sums of all ways to each place of a segment. weight: (places, longest piece) log weights of the pieces that end
    there, by length; -inf where there is none."""
    n, k = weight.shape
    chunks = -(-n // CHUNK)
    p = np.zeros((chunks * CHUNK, k))
    p[:n] = np.exp(weight)
    p[n:, 0] = 1.0
    p = p.reshape(chunks, CHUNK, k)
    # maps: row j of a chunk's matrix is the weight j places back, as a mix of the k weights in front of the chunk
    maps, scale = np.broadcast_to(np.eye(k), (chunks, k, k)).copy(), np.zeros(chunks)
    for t in range(CHUNK):
        new = np.matmul(p[:, t, None, :], maps)
        maps = np.concatenate([new, maps[:, :-1]], axis=1)
        if t % 8 == 7:
            top = maps.max(axis=(1, 2))
            maps /= top[:, None, None]
            scale += np.log(top)
    # the weights in front of each chunk, scaled
    begin, logs = np.zeros((chunks, k)), np.zeros(chunks)
    begin[0, 0] = 1.0
    for c in range(1, chunks):
        v = maps[c - 1] @ begin[c - 1]
        top = v.max()
        begin[c], logs[c] = v / top, logs[c - 1] + scale[c - 1] + np.log(top)
    out = np.empty((CHUNK, chunks))
    for t in range(CHUNK):
        new = (p[:, t] * begin).sum(axis=1)
        logs = logs + np.log(new)
        out[t] = logs
        begin = np.concatenate([np.ones((chunks, 1)), begin[:, :-1] / new[:, None]], axis=1)
    return out.T.ravel()[:n]


def spelled_size(point: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of a code point."""
    return np.where(point == SIGN_POINT, 3, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))


def lattices(own: Lattice, points, hashes, start, size):
    """Lattices of segments: (last node of each, first arc of each node, keys, back, piece). A node is a place after a
    character; its arcs have keys from its number to the next, spread by cumulated probability; back is -1 at a segment's front; a
    piece below 0 is a character, -1 - code point, that is spelled in bytes.

    Segments are worked on in blocks of about AT_ONCE characters, so that what is needed on the way to the arcs is a
    block's and not the slice's.
    """
    base = np.concatenate([[0], np.cumsum(size)])
    cuts = np.unique(np.append(np.searchsorted(base, np.arange(0, int(base[-1]), AT_ONCE)), len(size)))
    parts, arcs = [], 0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = block_lattices(own, points, hashes, start[lo:hi], size[lo:hi], int(base[lo]))
        parts.append((part[0], part[1] + arcs, *part[2:]))
        arcs += len(part[2])
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def block_lattices(own: Lattice, points, hashes, start, size, front: int):
    """lattices() of one block; nodes are numbered from ``front``."""
    base = np.concatenate([[0], np.cumsum(size)])
    nodes = int(base[-1])
    place = np.arange(nodes) - np.repeat(base[:-1], size)  # characters of the segment before this one
    at = np.repeat(start, size) + place  # the node's character
    to, length, ids, weight = [], [], [], []
    for k in range(1, own.longest + 1):
        node = np.flatnonzero(place >= k - 1) if k > 1 else np.arange(nodes)
        if not len(node):
            break
        h = hashes(at[node] - (k - 1), k)
        hit, row = own.find(h)
        to.append(node[hit])
        length.append(np.full(len(hit), k))
        ids.append(own.ids[row])
        weight.append(own.weight[row])
        if k == 1:
            other = np.ones(nodes, bool)
            other[hit] = False
            other = np.flatnonzero(other)
            to.append(other)
            length.append(np.ones(len(other), np.int64))
            ids.append(-1 - points[at[other]])
            weight.append(own.byte_weight * spelled_size(points[at[other]]))
    to, length, ids, weight = map(np.concatenate, (to, length, ids, weight))
    order = np.argsort(to, kind="stable")  # lengths ascend already
    to, length, ids, weight = to[order], length[order], ids[order], weight[order]
    back = np.where(place[to] + 1 == length, -1, to - length)
    total, value = np.zeros(nodes + 1), np.empty(len(to))  # total[-1]: the front
    far = np.repeat(size > LONG, size)[to]
    for i in np.flatnonzero(size > LONG).tolist():
        here = np.arange(*np.searchsorted(to, base[i : i + 2]))
        w = np.full((int(size[i]), own.longest), -np.inf)
        w[to[here] - base[i], length[here] - 1] = weight[here]
        total[base[i] : base[i + 1]] = forward(w)
        value[here] = np.exp(total[back[here]] + weight[here] - total[to[here]])
    near = np.flatnonzero(~far)
    if len(near):  # by place, then node; places of short segments fit 16 bits
        near = near[np.argsort(place[to[near]].astype(np.uint16), kind="stable")]
        value[near] = filtered(total, place[to[near]], to[near], back[near], weight[near])
    run = np.cumsum(value)
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    run -= np.repeat(run[first] - value[first], np.diff(np.append(first, len(to))))
    keys = front + to + np.minimum(run, 1 - 1e-9)
    last = np.append(first[1:], len(to)) - 1
    keys[last] = front + to[last] + 1.0
    back[back >= 0] += front
    return front + base[1:] - 1, first, keys, back, ids


def filtered(total, place, to, back, weight) -> np.ndarray:
    """Probabilities of arcs, place by place for all segments together; fills in ``total``."""
    value = np.empty(len(to))
    level = np.searchsorted(place, np.arange(int(place[-1]) + 2))
    for lo, hi in zip(level[:-1], level[1:], strict=True):
        v = total[back[lo:hi]] + weight[lo:hi]
        new = np.flatnonzero(np.concatenate([[True], to[lo + 1 : hi] != to[lo : hi - 1]]))
        top = np.maximum.reduceat(v, new)
        many = np.diff(np.append(new, hi - lo))
        v -= np.repeat(top, many)
        e = np.exp(v)
        s = np.add.reduceat(e, new)
        total[to[lo:hi][new]] = top + np.log(s)
        value[lo:hi] = e / np.repeat(s, many)
    return value


def decode_ids(lattice: Lattice, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts: the pieces' bytes, less the blank in front."""
    size = lattice.raw_size[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = lattice.raw[np.repeat(lattice.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])]
    place = ends[offsets]
    keep = np.ones(len(data), bool)
    first = place[:-1][np.diff(place) > 0]
    keep[first] = False
    return data[keep], place - np.concatenate([[0], np.cumsum(np.diff(place) > 0)])


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def encode(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, key_col: str = "doc_id", text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the sampled piece ids (array<int>) in place of the text."""
    return _sampled(docs, path, alpha, seed, key_col, text_col, f"`{ids_col}` array<int>", lambda own, batch, ids, offsets, data, at: [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], [ids_col])


def round_trip(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text: n_pieces, ids_sha256 (of the ids as little-endian int32) and lossless, whether decoding
    the ids gives the text's bytes again."""

    def columns(own, batch, ids, offsets, data, at):
        raw, place = decode_ids(own, ids, offsets)
        raw, text, whole = raw.tobytes(), data.tobytes(), ids.astype("<i4").tobytes()
        same = [raw[a:b] == text[c:d] for a, b, c, d in zip(place[:-1], place[1:], at[:-1], at[1:], strict=True)]
        digest = [hashlib.sha256(whole[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [pa.array(np.diff(offsets)), pa.array(digest), pa.array(same)]

    return _sampled(docs, path, alpha, seed, key_col, text_col, "n_pieces long, ids_sha256 string, lossless boolean", columns, ["n_pieces", "ids_sha256", "lossless"])


def _sampled(docs, path, alpha, seed, key_col, text_col, schema, columns, names):
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c not in names]
    spark_schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), schema])
    rows = docs.select(F.xxhash64(F.col(key_col), F.lit(seed)).alias("_seed"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches):
        own = lattice(path, alpha)
        for batch in batches:
            texts = batch.column(1)
            seeds = batch.column(0).to_numpy().view(np.uint64)
            for lo, hi, data, at in slices(texts, 2 << 20):
                ids, offsets = encode_slice(own, data, at, seeds[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(len(keep))), *columns(own, part, ids, offsets, data, at)], names=[*keep, *names])

    return rows.mapInArrow(run, spark_schema)


def decode(rows: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text in place of the piece ids."""
    keep = [c for c in rows.columns if c not in (ids_col, text_col)]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{text_col}` string"])

    def run(batches):
        own = lattice(path, 1.0)
        for batch in batches:
            ids = batch.column(len(keep))
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(ids).to_pylist()], np.int64)
            data, at = decode_ids(own, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, text_col])

    return rows.select(*[F.col(f"`{c}`") for c in keep], ids_col).mapInArrow(run, schema)
