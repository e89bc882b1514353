"""Online logistic context mixing over bytes.

A text is coded as its lower-cased UTF-8 bytes and an end symbol; a symbol is the
path of binary decisions that leads to it in a Huffman tree, one tree for each
symbol before it, so a likely byte takes one to three decisions, not eight. Four
predictors see the node of the tree and the 2, 3 or 5 bytes before (over word
ends), or the word so far with the byte that began it. Each keeps counts of 0 and
1 in a hashed table of fixed size; the nodes of one context stand together.

The stretched probabilities are mixed by weights that a gate picks (the evidence
behind the two longest contexts), and a map refines the mixed value by the byte before.
Learning is one pass: each run of texts is predicted from what was seen before it,
the weights step against the error, the map counts what came, and the run is then
added to the tables. Learners of several tasks are summed: counts and map cells
add up, weights are averaged by the decisions behind them.

Symbols of the same case (what stands before, the symbol and the cells of all tables)
have the same decisions and inputs. As the tables stand still within a run, and
the finished model for good, each case is looked up once for a run, or kept with its
cost when texts are scored; results are those of looking up every decision.

The decisions at a node have probabilities that sum to one, so the model is a
distribution over texts. Texts longer than ``PIECE`` bytes are read in pieces, each
with the ``LEAD`` bytes before it as context.
"""

from __future__ import annotations

import heapq

import numpy as np

END = 256
SYMBOLS = END + 1
BEFORE = SYMBOLS + 1  # what can stand before a symbol: nothing, or a symbol plus one
PAIRS = BEFORE * SYMBOLS
CELLS = (19, 20, 20, 20)  # log2 of each table's cells
K = len(CELLS)
OFFSET = np.concatenate(([0], np.cumsum([1 << c for c in CELLS]))).astype(np.int64)
TOTAL = int(OFFSET[-1])
LEVELS = (0, 2, 15, 127)  # a context's evidence: none, 1 to 2, to 15, to 127, more
GATES = (len(LEVELS) + 1) ** 2
BLOCK = 8192  # cells of a learner's tables that are sent as one row
BLOCKS = -(-TOTAL // BLOCK)
BUCKETS = 33
MAP = BEFORE * BUCKETS
PIECE, LEAD, PAD = 1 << 18, 64, 5
RUN = 1 << 19  # bytes between two updates of the tables
STEP = 1 << 15  # decisions between two updates of the weights
SLOTS = 20  # log2 of the slots for cases met before
CHUNK = 1 << 13  # cases looked up at once, so that their arrays stay near the processor
START, RATE, FEW = 0.35, 0.02, 0.4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(258, bool)
_SPACE[[0, 10, 11, 12, 13, 14, 33]] = True  # nothing, tab to carriage return, space; symbols are stored plus one


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The (node, side) decisions of each symbol in the Huffman tree of ``counts`` plus one. Nodes are numbered from the root down."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        new = SYMBOLS + len(kids)
        kids[new] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], new, new))
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    level, number = [(heap[0][2], [])], 0
    while level:
        below = []
        for at, path in level:
            if at in kids:
                below += [(child, [*path, (number, side)]) for side, child in enumerate(kids[at])]
                number += 1
            else:
                paths[at] = path
        level = below
    return paths


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each symbol follows each in lower-cased texts, ends included: PAIRS numbers."""
    out = np.zeros(PAIRS, np.int64)
    for part in runs(((b"", t) for t in texts), 1 << 18):
        data = np.frombuffer(b"".join(t + b"\0" for _, t in part), np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for _, t in part]) - 1
        data[ends] = END
        pair = data.copy()
        pair[1:] += (data[:-1] + 1) * SYMBOLS
        pair[ends[:-1] + 1] = data[ends[:-1] + 1]
        out += np.bincount(pair, minlength=PAIRS)
    return out


def pieces(text: bytes):
    """(lead, body, last?) of a lower-cased text."""
    for i in range(0, max(1, len(text)), PIECE):
        yield text[max(0, i - LEAD) : i], text[i : i + PIECE], i + PIECE >= len(text)


def runs(parts, most: int = RUN):
    """Lists of parts of about ``most`` bytes in all."""
    out, size = [], 0
    for p in parts:
        out.append(p)
        size += len(p[1]) + 8
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


class Coder:
    """Decisions and table cells of texts. ``pair_counts``: how often each symbol followed each, by what stood before * SYMBOLS + symbol."""

    def __init__(self, pair_counts: np.ndarray):
        pairs = pair_counts.reshape(BEFORE, SYMBOLS)
        whole = pairs.sum(0)
        trees = [huffman(n * 64 + whole / max(1, whole.sum()) * 64) for n in pairs]
        paths = [path for tree in trees for path in tree]
        self.steps = np.array([len(path) for path in paths])
        self.first = np.cumsum(self.steps) - self.steps
        self.node = np.array([n for path in paths for n, _ in path], np.uint8)
        self.bit = np.array([side for path in paths for _, side in path], np.uint8)
        n = np.arange(256, dtype=np.uint64)
        self.spread = (((n >> np.uint64(4)) * np.uint64(0x9E3779B1)) << np.uint64(4) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | (n & np.uint64(15)).astype(np.uint32)

    @staticmethod
    def contexts(parts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(symbols to code, what stands before them, a hash for each table, symbols of each part)."""
        lead = np.array([PAD + len(a) for a, _, _ in parts])
        own = np.array([len(b) + last for _, b, last in parts])
        data = np.frombuffer(b"".join(b"".join((bytes(PAD), a, b, b"\0" * last)) for a, b, last in parts), np.uint8).astype(np.uint64) + np.uint64(1)
        start = np.cumsum(lead + own) - lead - own
        data[(start[:, None] + np.arange(PAD)).ravel()] = 0
        data[(start + lead + own - 1)[[last for _, _, last in parts]]] = END + 1
        # hash of the word so far: differences of running sums of data * odd ** place
        n = len(data) - PAD
        power, back = _powers(len(data))
        sums = np.cumsum(data * power)
        space = np.maximum.accumulate(np.where(_SPACE.take(data), np.arange(len(data)), 0))
        keep = np.ones(len(data), bool)
        keep[(np.repeat(start, lead) + np.arange(int(lead.sum())) - np.repeat(np.cumsum(lead) - lead, lead))] = False
        at = np.flatnonzero(keep) - PAD
        p = [data[PAD - k : PAD - k + n] for k in range(1, PAD + 1)]  # the symbol k places before
        began = space[PAD - 1 : -1]
        word = (sums[PAD - 1 : -1] - sums.take(began)) * back.take(began) * _ODD + data.take(began)
        two = p[0] << np.uint64(9) | p[1]
        three = two << np.uint64(9) | p[2]
        five = (three << np.uint64(18) | p[3] << np.uint64(9) | p[4]) * _ODD
        hashes = [((c * _ODD) >> np.uint64(28)).astype(np.uint32).take(at) & np.uint32(0xFFFFFFF0) for c in (two, three, five ^ five >> np.uint64(31), word ^ word >> np.uint64(29))]
        return data.take(at + PAD).astype(np.int64) - 1, p[0].take(at).astype(np.int64), hashes, own

    def paths(self, pair: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cells (K, n), symbol, bit, decisions up to each symbol's last) of symbols, ``pair``: what stands before * SYMBOLS + symbol."""
        steps = self.steps.take(pair)
        upto = np.cumsum(steps)
        owner = np.repeat(np.arange(len(pair)), steps)
        flat = (self.first.take(pair) - (upto - steps)).take(owner)
        flat += np.arange(len(owner))
        spread, bit = self.spread.take(self.node.take(flat)), self.bit.take(flat)
        cells = np.empty((K, len(owner)), np.int64)
        for k in range(K):
            np.add((hashes[k].take(owner) ^ spread) & np.uint32((1 << CELLS[k]) - 1), OFFSET[k], out=cells[k], casting="unsafe")
        return cells, owner, bit, upto

    def decisions(self, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cells (K, n), what stands before, bit, first decision of each part)."""
        symbols, before, hashes, own = self.contexts(parts)
        cells, owner, bit, upto = self.paths(before * SYMBOLS + symbols, hashes)
        ends = np.cumsum(own)
        return cells, before.take(owner), bit, np.concatenate(([0], upto[ends[:-1] - 1]))


def cases(pair: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, slot) of symbols: all that their decisions depend on. Symbols with the same key and slot have the same pair
    and the same cells: the key holds the lines of all tables, and with the key the slot tells the pair. No key is 0."""
    key, place = np.zeros(len(pair), np.uint64), 0
    for h, c in zip(hashes, CELLS):
        key |= (h >> np.uint32(4) & np.uint32((1 << c - 4) - 1)).astype(np.uint64) << np.uint64(place)
        place += c - 4
    mixed = key ^ key >> np.uint64(32)
    mixed *= _ODD
    mixed >>= np.uint64(64 - SLOTS)
    key += np.uint64(1)
    return key, mixed.view(np.int64) ^ pair


_power_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd ** (i + 1) and its inverse, kept between calls."""
    if not _power_tables or len(_power_tables[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _power_tables[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (_ODD, inverse)]
    return _power_tables[0][:n], _power_tables[1][:n]


def stretched(counts: np.ndarray) -> np.ndarray:
    """The table of inputs for counts (..., cells, 2)."""
    one, zero = (np.add(counts[..., i], np.float32(FEW), dtype=np.float32, casting="unsafe") for i in (1, 0))
    one /= zero
    return np.log(one, out=one)


def evidence(counts: np.ndarray) -> np.ndarray:
    """Level of each cell: how many of ``LEVELS`` its observations exceed."""
    n = counts[:, 0] + counts[:, 1]
    return sum((n > level).astype(np.uint8) for level in LEVELS)


class Mixer:
    """Prediction from fixed inputs: ``inputs`` of all cells, ``levels`` of the cells of the last two tables, weights (K, GATES)."""

    def __init__(self, inputs: np.ndarray, levels: np.ndarray, weights: np.ndarray):
        self.inputs, self.levels, self.weights = inputs, levels, weights

    def mixed(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs (K, n), gate, mixed value)."""
        x = self.inputs.take(cells)
        gate = self.levels.take(cells[K - 2] - OFFSET[K - 2]) * np.uint8(len(LEVELS) + 1) + self.levels.take(cells[K - 1] - OFFSET[K - 2])
        z = self.weights[0].take(gate) * x[0]
        for k in range(1, K):
            z += self.weights[k].take(gate) * x[k]
        return x, gate, z


def level(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z, -8, 8) * 2 + 16).astype(np.int64)


def bucket(before: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Cell of the map."""
    return before * BUCKETS + level(z)


class Learner:
    """One task's tables, weights and map."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.counts = np.zeros((TOTAL, 2), np.int32)
        self.weights = np.full((K, GATES), START, np.float32)
        self.past = np.full((K, GATES), 1e-6)  # squared slopes so far
        self.behind = np.zeros(GATES)  # decisions behind each gate's weights
        self.map = np.zeros((MAP, 2))
        self.last = np.zeros(1 << SLOTS, np.int32)

    def distinct(self, pair: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a symbol for each case, the number of each symbol's case). A case whose slot another took may have several numbers."""
        key, slot = cases(pair, hashes)
        at = np.arange(len(pair), dtype=np.int32)
        self.last[slot] = at  # what earlier runs left is not read: every slot asked for is written here
        same = self.last.take(slot)
        same = np.where(key.take(same) == key, same, at)
        own = same == at
        return np.flatnonzero(own), (np.cumsum(own) - 1).take(same)

    def look(self, pair: np.ndarray, hashes: list[np.ndarray]) -> tuple:
        """What the tables say of cases: (inputs by decision, gate, map cell and bit), (places in the counts, decisions of each case)."""
        cells, owner, bit, upto = self.coder.paths(pair, hashes)
        counts = self.counts.view(np.int64).ravel().take(cells).view(np.int32).reshape(K, -1, 2)
        rows = np.ascontiguousarray(stretched(counts).T)
        levels = evidence(counts[K - 2 :].reshape(-1, 2)).reshape(2, -1)
        cells += cells
        cells += bit
        places = (pair // SYMBOLS * (2 * BUCKETS)).take(owner) + bit
        return rows, levels[0] * np.uint8(len(LEVELS) + 1) + levels[1], places, cells, np.diff(upto, prepend=0)

    def learn(self, parts) -> None:
        """Predict a run of parts, correct the weights, then count the run.

        The tables stand still within a run, so what they say is looked up once for each different case."""
        symbols, before, hashes, _ = self.coder.contexts(parts)
        pair = before * SYMBOLS + symbols
        some, case = self.distinct(pair, hashes)
        cuts = [some[a : a + CHUNK] for a in range(0, len(some), CHUNK)]
        looked = [self.look(pair.take(c), [h.take(c) for h in hashes]) for c in cuts]
        rows, gates, places = (np.concatenate([x[i] for x in looked]) for i in range(3))
        inputs = rows.view(np.complex128).ravel()  # K = 4 numbers of four bytes, moved as one
        steps = np.concatenate([x[4] for x in looked])
        first = (np.cumsum(steps) - steps).take(case)
        steps = steps.take(case)
        ends = np.cumsum(steps)
        for a in range(0, ends[-1], STEP):
            # the decisions of all symbols, by their numbers among those of the cases
            i, j = np.searchsorted(ends, (a, a + STEP - 1), "right")
            own = steps[i : j + 1]
            start = ends[i] - own[0]
            cut = np.repeat(first[i : j + 1] - (ends[i : j + 1] - own), own)
            cut += np.arange(start, start + len(cut))
            cut = cut[a - start : a - start + STEP]
            x, gate, place = np.ascontiguousarray(inputs.take(cut).view(np.float32).reshape(-1, K).T), gates.take(cut).astype(np.int64), places.take(cut)
            z = self.weights[0].take(gate) * x[0]
            for k in range(1, K):
                z += self.weights[k].take(gate) * x[k]
            error = (place & 1).astype(np.uint8) - 1 / (1 + np.exp(-np.clip(z, -20, 20)))
            for k in range(K):
                slope = np.bincount(gate, error * x[k], GATES)
                self.past[k] += slope**2
                self.weights[k] += (RATE * slope / np.sqrt(self.past[k])).astype(np.float32)
            place += 2 * level(z)
            self.map += np.bincount(place, minlength=2 * MAP).reshape(-1, 2)
        times = np.bincount(case, minlength=len(some)).astype(np.int32)
        for a, (_, gate, _, cells, own) in zip(range(0, len(some), CHUNK), looked):
            n = np.repeat(times[a : a + CHUNK], own)
            self.behind += np.bincount(gate, n, GATES)
            for k in range(K):
                np.add.at(self.counts.ravel(), cells[k], n)

    def blocks(self):
        """(block, bytes): the counts by blocks of ``BLOCK`` cells that are not empty, and at ``BLOCKS`` the weights, the decisions behind them and the map."""
        for i in range(BLOCKS):
            part = self.counts[i * BLOCK : (i + 1) * BLOCK]
            if part.any():
                yield i, packed(part)
        yield BLOCKS, np.concatenate(((self.weights * self.behind).ravel(), self.behind, self.map.ravel())).tobytes()


def packed(counts: np.ndarray) -> bytes:
    """Counts as eight-byte numbers, first the first bytes of all, then the second, ...: the upper ones are zeros, which compress."""
    return counts.astype("<i8").ravel().view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def added(block: int, parts: list[bytes]) -> bytes:
    """The sum of the same block of several learners."""
    if block == BLOCKS:
        return sum(np.frombuffer(p, np.float64) for p in parts).tobytes()
    return packed(sum(unpacked(p) for p in parts))


class Model(Mixer):
    """What learners' summed states make."""

    def __init__(self, coder: Coder, blocks: dict[int, bytes]):
        counts = np.zeros((TOTAL, 2), np.float32)
        for i, data in blocks.items():
            if i < BLOCKS:
                counts[i * BLOCK : (i + 1) * BLOCK] = unpacked(data).reshape(-1, 2)
        rest = np.frombuffer(blocks[BLOCKS]) if BLOCKS in blocks else np.zeros((K + 1) * GATES + 2 * MAP)
        weights, behind, seen = np.split(rest, np.cumsum((K * GATES, GATES)))
        weights = np.where(behind > 0, weights.reshape(K, GATES) / np.maximum(behind, 1), START).astype(np.float32)
        super().__init__(stretched(counts), evidence(counts[OFFSET[K - 2] :]), weights)
        seen = seen.reshape(BEFORE, BUCKETS, 2)
        first = 1 / (1 + np.exp(-(np.arange(BUCKETS) - 16) / 2))
        self.map = ((seen[..., 1] + 8 * first) / (seen.sum(-1) + 8)).ravel().astype(np.float32)
        self.coder = coder
        self.keys = self.known = None  # made where texts are scored, not sent

    def costs(self, pair: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """log10 P of symbols."""
        if not len(pair):
            return np.zeros(0)
        cells, owner, bit, upto = self.coder.paths(pair, hashes)
        _, _, z = self.mixed(cells)
        refined = self.map.take(bucket((pair // SYMBOLS).take(owner), z))
        p = (1 / (1 + np.exp(-np.clip(z, -20, 20))) + 3 * refined) / 4
        p = np.clip(p, 1e-6, 1 - 1e-6)
        p = np.where(bit, p, 1 - p)
        return np.add.reduceat(np.log10(p).astype(np.float64), upto - self.coder.steps.take(pair))

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 P of each lower-cased text, its end included. The model stands still, so costs of cases met before are kept, the last in each slot."""
        if self.keys is None:
            self.keys, self.known = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS)
        out = np.zeros(len(texts))
        parts = ((*p, i) for i, t in enumerate(texts) for p in pieces(t))
        for run in runs(parts, 1 << 15):
            symbols, before, hashes, own = self.coder.contexts([p[:3] for p in run])
            pair = before * SYMBOLS + symbols
            key, slot = cases(pair, hashes)
            cost = self.known.take(slot)
            new = np.flatnonzero(self.keys.take(slot) != key)
            cost[new] = self.costs(pair.take(new), [h.take(new) for h in hashes])
            self.keys[slot[new]] = key[new]
            self.known[slot[new]] = cost[new]
            np.add.at(out, [p[3] for p in run], np.add.reduceat(cost, np.cumsum(own) - own))
        return out
