"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is two deterministic transducers in a row.

* The splitting pattern is a transducer over character classes. Its transitions say where a piece begins (at this
  character, or at the one before). The map that a class makes of the states generates a small finite monoid, which is
  compiled with its composition table. A chunk of text is then one monoid element; elements compose through a parallel
  prefix scan, which gives the state in which every chunk begins, and a second pass emits the piece starts of all
  chunks at once.
* Merging is a transducer over the bytes of a piece. Its state is the longest suffix that begins a vocabulary entry,
  with the last token at the places inside that suffix. A byte leads to the next suffix; the last token there is the
  longest vocabulary suffix that is compatible with the last token before it, and the transition emits one token more
  than the place where that token begins. All distinct pieces of a slice advance together. A piece of more than LONG
  bytes is cut into chunks of STRETCH bytes that advance together, too. A chunk's state map is kept for the states that
  it was entered with: the first is guessed from a run over the bytes in front of it, and a scan composes the maps from
  left to right; where a chunk is entered with a state that its map doesn't hold yet, the map is extended, for all such
  chunks at once, until the scan meets none. Token counts add up over the chunks.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; other columns are ignored.
A special token inside a text counts as one token and ends the pieces around it, the library's default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._spark import bounded_batches
from ._text import range_hashes, slices

CLASSES = "E L N O S P A s r v l e".split()  # end, letter, number, other, space, blank, apostrophe; letters of contractions
STATES = "B L N O W P A r v l C".split()
START, PREVIOUS = 1, 2
CHUNK = 128
AREA = 1 << 20  # cells of the tables in which pieces advance together
LONG, STRETCH = 2048, 1024  # bytes
MOST_KNOWN = 4_000_000  # piece counts that a worker keeps: 64 MB


def _step(state: str, c: str) -> tuple[str, int]:
    """One transition of the splitting transducer: the next state, and where pieces begin."""
    letter = c in "Lsrvle"
    half = state in ("r", "v", "l")  # an apostrophe and the first letter of 're, 've or 'll
    if c == "E":
        return "B", PREVIOUS if half else 0
    if (state == "A" and c == "s") or (state in ("r", "v") and c == "e") or (state == "l" and c == "l"):
        return "C", 0
    if state == "A" and c in ("r", "v", "l"):
        return c, 0
    if c in ("S", "P"):
        to = "W" if c == "S" else "P"
        return to, 0 if state in ("W", "P") else START | (PREVIOUS if half else 0)
    to = "L" if letter else c
    if state == "P":
        return ("O" if c == "A" else to), PREVIOUS
    if c == "A":
        return ("O", 0) if state in ("O", "A") else ("A", START | (PREVIOUS if half or state == "W" else 0))
    if half:
        return to, PREVIOUS | (0 if letter else START)
    if state == "W":
        return to, PREVIOUS | START
    if to == state or (state == "A" and to == "O"):
        return to, 0
    return to, START


class Splitter:
    """The splitting transducer with its monoid of state maps."""

    def __init__(self, table: np.ndarray):
        s, c = len(STATES), len(CLASSES)
        self.next, self.emit = np.zeros((c, s), np.uint8), np.zeros((c, s), np.uint8)
        for i, x in enumerate(CLASSES):
            for j, y in enumerate(STATES):
                to, out = _step(y, x)
                self.next[i, j], self.emit[i, j] = STATES.index(to), out
        maps, queue = {tuple(range(s)): 0}, [tuple(range(s))]
        rows = []
        for m in queue:
            row = []
            for i in range(c):
                after = tuple(int(self.next[i, x]) for x in m)
                if after not in maps:
                    maps[after] = len(maps)
                    queue.append(after)
                row.append(maps[after])
            rows.append(row)
        self.maps = np.array(queue, np.uint8)
        self.then = np.array(rows, np.int32)  # map, class -> map
        index = {m: i for m, i in maps.items()}
        self.compose = np.array([[index[tuple(b[x] for x in a)] for b in queue] for a in queue], np.int32)  # first, second
        self.classes = table

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Flags of the places where pieces begin, for a sequence of classes that ends with E."""
        n, c = len(cls), len(CLASSES)
        rows = -(-n // CHUNK)
        grid = np.zeros(rows * CHUNK, np.intp)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        then, element = self.then.ravel(), np.zeros(rows, np.intp)
        for t in range(CHUNK):
            element = then[element * c + grid[t]]
        # inclusive prefix scan of the chunks' maps
        step, k = 1, len(self.maps)
        flat = self.compose.ravel()
        while step < rows:
            element = np.concatenate([element[:step], flat[element[:-step].astype(np.intp) * k + element[step:]]])
            step *= 2
        state = np.zeros(rows, np.intp)
        state[1:] = self.maps[element[:-1], 0]
        out = np.zeros((CHUNK, rows), np.uint8)
        s, nxt, emit = len(STATES), self.next.ravel(), self.emit.ravel()
        for t in range(CHUNK):
            at = grid[t] * s + state
            out[t] = emit[at]
            state = nxt[at].astype(np.intp)
        out = out.T.ravel()[:n]
        begin = (out & START) > 0
        begin[:-1] |= (out[1:] & PREVIOUS) > 0
        return begin


def classes(path: str) -> np.ndarray:
    """The class of each code point, read off the file's own pre-tokenizer (so that its Unicode version holds).

    In "xc!" and "xc1" for a code point c, a letter joins x, another sign joins !, a digit joins 1, a space joins none.
    Planes from 4 on hold no letters, digits or spaces.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, CLASSES.index("O"), np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x40000)]
    for lo in range(0, len(points), 4096):
        some = points[lo : lo + 4096]
        starts = []
        for after in "!1":
            flags = np.zeros(3 * len(some) + 1, bool)
            flags[[a for _, (a, _) in cut("".join(f"x{chr(p)}{after}" for p in some))]] = True
            starts.append(flags)
        own, sign, digit = starts[0][1::3][: len(some)], starts[0][2::3], starts[1][2::3]
        table[some] = np.select([~own, ~sign, ~digit], [CLASSES.index(c) for c in "LON"], CLASSES.index("S"))
    for c, letters in (("P", " "), ("A", "'"), ("s", "stmd"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e")):
        table[[ord(x) for x in letters]] = CLASSES.index(c)
    return table


class Merger:
    """The merging transducer of a byte-level BPE vocabulary.

    Tokens are numbered by merge rank, single bytes first. A node is a byte string that begins a token; ``go`` leads from
    a node and a byte to the longest suffix that is a node, ``token`` and ``shorter`` list the tokens that are suffixes of
    a node, longest first. All tables are sorted arrays, so many pieces advance one byte at a time together.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = lambda s: bytes(byte[c] for c in s)
        tokens = {bytes([b]): b for b in range(256)}
        left, right = [*range(256)], [*range(256)]
        for a, b in merges:
            a, b = raw(a), raw(b)
            if a + b not in tokens:
                left.append(tokens[a])
                right.append(tokens[b])
                tokens[a + b] = len(tokens)
        self.left, self.right = np.array(left), np.array(right)
        self.length = np.array([len(t) for t in tokens])
        self.longest = int(self.length.max())
        made = np.arange(256, len(left))
        keys = self.left[256:] << 20 | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_token = keys[order], made[order]
        # the nodes, shortest first, so that a node's longest proper suffix is made before it
        nodes = {b"": 0}
        for t in sorted({t[:i] for t in tokens for i in range(1, len(t) + 1)}, key=len):
            nodes[t] = len(nodes)
        fail, token, shorter, edges = [0] * len(nodes), [-1] * len(nodes), [0] * len(nodes), []
        for t, i in nodes.items():
            if t:
                edges.append((nodes[t[:-1]] << 8 | t[-1], i))
                fail[i] = next(nodes[t[j:]] for j in range(1, len(t) + 1) if t[j:] in nodes)
                token[i] = tokens.get(t, -1)
        for i in range(1, len(nodes)):  # nearest suffix node that is a token
            shorter[i] = fail[i] if token[fail[i]] >= 0 or fail[i] == 0 else shorter[fail[i]]
        self.fail, self.token, self.shorter = np.array(fail), np.array(token), np.array(shorter)
        edges.sort()
        self.edge_keys, self.edge_to = np.array([k for k, _ in edges]), np.array([i for _, i in edges])
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.alone = np.ones(len(left), bool)
        self.alone[256:] = self.compatible(self.left[256:], self.right[256:], made)

    def compatible(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray | int = 1 << 40) -> np.ndarray:
        """Whether merging leaves the tokens a, b of two neighbouring strings as they are.

        Merges run backwards from the two tokens, latest first. Just before each, the parts that touch must not have a
        merge of lower rank. With ``whole``: no such merge before that token, which a and b make.
        """
        a, b = np.array(a), np.array(b)
        good, limit, live = np.ones(len(a), bool), np.full(len(a), 1 << 40) if np.isscalar(whole) else whole.copy(), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_token[at] < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # a merge in the left string comes before an equal one in the right string
            latest_left = np.where(x > y, x >= 256, y < 256)
            undo_left = latest_left & (x >= 256)
            undo_right = ~latest_left & (y >= 256)
            go = undo_left | undo_right
            limit[live] = np.where(undo_left, x, np.where(undo_right, y + 1, 0))
            a[live], b[live] = np.where(undo_left, self.right[x], x), np.where(undo_right, self.left[y], y)
            live = live[go]
        return good

    def advance(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(node), np.int64), np.arange(len(node))
        node = node.copy()
        while len(live):
            key = node[live] << 8 | byte[live]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[at] == key
            out[live[hit]] = self.edge_to[at[hit]]
            live = live[~hit]  # every single byte is a node, so this ends
            node[live] = self.fail[node[live]]
        return out

    def advance_all(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last tokens, token counts) at every place of byte ranges, all advancing one byte at a time; longest first.

        ``known``: the last tokens at the first places, -1 where a piece begins.
        """
        width, skip = int(size[0]) + 1, known.shape[1] - 1
        last, count = np.full((len(size), width), -1, np.int32), np.zeros((len(size), width), np.int32)
        last[:, : skip + 1] = known
        node, row = np.zeros(len(size), np.int64), np.arange(len(size))
        for t in range(width - 1):
            n = int(np.searchsorted(-size, -t, "left"))  # ranges longer than t
            node = self.advance(node[:n], data[starts[:n] + t].astype(np.int64))
            if t < skip:
                continue
            at, live = np.where(self.token[node] >= 0, node, self.shorter[node]), row[:n]
            while len(live):
                token = self.token[at]
                begin = t + 1 - self.length[token]
                before = last[live, begin]
                good = self.alone[token].copy()
                inner = np.flatnonzero(good & (before >= 0))
                good[inner] = self.compatible(before[inner].astype(np.int64), token[inner])
                done = live[good]
                last[done, t + 1] = token[good]
                count[done, t + 1] = count[done, begin[good]] + 1
                live, at = live[~good], self.shorter[at[~good]]
        return last, count

    def run(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of pieces."""
        order = np.argsort(-size, kind="stable")
        _, count = self.advance_all(data, starts[order], size[order], np.full((len(size), 1), -1, np.int32))
        out = np.empty(len(size), np.int64)
        out[order] = count[np.arange(len(size)), size[order]]
        return out

    def run_long(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of pieces of more than STRETCH bytes, by chunks; chunks of the same bytes share a map."""
        many = -(-size // STRETCH)
        first = np.cumsum(many) - many
        piece = np.repeat(np.arange(len(size)), many)
        front = (np.arange(len(piece)) - first[piece]) * STRETCH  # of each chunk in its piece
        at, width = starts[piece] + front, np.minimum(STRETCH, size[piece] - front)
        back = self.longest  # a state: the last tokens at so many places, which tell their bytes too
        lead = np.where(front > 0, back, 0)
        content = range_hashes(data, at, at + width).tolist()
        maps: dict[int, dict] = {c: {} for c in content}  # bytes of a chunk -> state of its front -> (state of its end, last tokens)
        guess: list = [None] * len(piece)

        def extend(chunks: np.ndarray, entry: np.ndarray | None):
            """Run chunks from a guess (their state ``back`` bytes in front taken for a piece's front) or from known states."""
            step = max(1, AREA // (2 * STRETCH))
            for lo in range(0, len(chunks), step):
                some = chunks[lo : lo + step]
                order = np.argsort(-(lead[some] + width[some]), kind="stable")
                some = some[order]
                known = np.full((len(some), 1), -1, np.int32) if entry is None else entry[lo : lo + step][order]
                last, _ = self.advance_all(data, at[some] - lead[some], lead[some] + width[some], known)
                for i, (c, a) in enumerate(zip(some.tolist(), lead[some].tolist(), strict=True)):
                    end = a + int(width[c])
                    state = last[i, max(0, a - back + 1) : a + 1].tobytes() if front[c] else b""
                    maps[content[c]][state] = (last[i, max(0, end - back + 1) : end + 1].tobytes(), last[i, a + 1 : end + 1].copy())
                    guess[c] = state

        context = range_hashes(data, at - lead, at + width)
        _, once, same = np.unique(np.column_stack([context, lead.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
        extend(once, None)
        for c, u in enumerate(same.ravel().tolist()):
            guess[c] = guess[once[u]]
        asked = {(): 0}
        while asked:
            asked = {}
            for c in range(len(piece)):  # the scan; a chunk without the state asked for goes on from the last one it knows
                state = maps[content[c - 1]][guess[c - 1]][0] if front[c] else b""
                if state in maps[content[c]]:
                    guess[c] = state
                else:
                    asked.setdefault((content[c], state), c)
            if asked:
                entry = np.full((len(asked), back + 1), -1, np.int32)
                for i, (_, state) in enumerate(asked):
                    entry[i, 1:] = np.frombuffer(state, np.int32)
                extend(np.array(list(asked.values())), entry)
        out = np.zeros(len(size), np.int64)
        for p in range(len(size)):
            tokens = np.concatenate([maps[content[c]][guess[c]][1] for c in range(first[p], first[p] + many[p])])
            step, place = self.length[tokens].tolist(), int(size[p])
            while place:
                place -= step[place - 1]
                out[p] += 1
        return out

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of byte ranges; each distinct piece runs through the transducer once for each worker."""
        h = range_hashes(data, starts, ends)
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            new = np.flatnonzero(self.known[at] != unique)
        else:
            new = np.arange(len(unique))
        if len(new):
            if len(self.known) + len(new) > MOST_KNOWN:  # they are only kept to save work
                self.known, self.counts, new = self.known[:0], self.counts[:0], np.arange(len(unique))
            begin, size = starts[where[new]], (ends - starts)[where[new]]
            counts = np.zeros(len(new), np.int64)
            order = np.argsort(size, kind="stable")
            lo, short = 0, int(np.searchsorted(size[order], LONG, "right"))
            if short < len(order):
                counts[order[short:]] = self.run_long(data, begin[order[short:]], size[order[short:]])
                order = order[:short]
            while lo < len(order):  # blocks of similar length, of a bounded area
                hi = lo + max(1, int(np.searchsorted(np.arange(1, len(order) - lo + 1) * (size[order[lo:]] + 1), AREA, "right")))
                some = order[lo:hi]
                counts[some] = self.run(data, begin[some], size[some])
                lo = hi
            place = np.searchsorted(self.known, unique[new])
            self.known, self.counts = np.insert(self.known, place, unique[new]), np.insert(self.counts, place, counts)
        return self.counts[np.searchsorted(self.known, unique)][back]


class Counter:
    def __init__(self, path: str, table: np.ndarray):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split, self.merge = Splitter(table), Merger(spec["model"]["vocab"], merges)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        n = len(offsets) - 1
        owner, extra = np.arange(n), np.zeros(n, np.int64)
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)).encode())
            parts, owner = [], []
            for i in range(n):
                own = cut.split(raw[offsets[i] : offsets[i + 1]])
                extra[i] = len(own) - 1
                parts += own
                owner += [i] * len(own)
            raw, owner = b"".join(parts), np.array(owner)
            data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        if not len(data):
            return extra
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each character
        text = np.searchsorted(offsets, at, "right") - 1
        cls = np.zeros(len(points) + len(offsets) - 1, np.intp)
        place = np.arange(len(points)) + text
        cls[place] = self.split.classes[points]
        flags = self.split.starts(cls)[place]
        starts = at[flags]
        ends = np.append(starts[1:], len(data))
        tokens = self.merge.pieces(data, starts, ends)
        return extra + np.bincount(owner[text[flags]], weights=tokens, minlength=n).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, table: np.ndarray | None = None) -> Counter:
    """The worker's compiled tokenizer; its transitions are kept from batch to batch."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, classes(path) if table is None else table)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text. One pass, no shuffle.

    ``path``: a byte-level BPE vocabulary in the tokenizers library's JSON format, readable on every executor.
    """
    bounded_batches(docs.sparkSession)
    table = classes(path)

    def run(batches):
        for batch in batches:
            own = counter(path, table)
            size, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in slices(batch.column(1)):
                size[lo:hi], tokens[lo:hi] = np.diff(offsets), own.count(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
