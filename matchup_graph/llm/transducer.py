"""BPE as a compiled transducer.

A token sequence is the BPE encoding of its symbols exactly if each neighbouring
pair of tokens is.  So every prefix of a pretoken has one last token, found from
the last tokens of shorter prefixes, and only those prefixes matter from which a
longer token can still start.  A state is the symbols behind the earliest such
prefix and the pending tokens of each; a token that all of them share is stable
and is emitted by the transition that makes it so.  How far behind the reading
place a token can still be pending is bounded by the merge list: see
`sufficient_lookahead`.

The transition table is arrays, so all pretokens of a batch of texts are run at
once, one symbol of each at a time.
"""

import json
from collections.abc import Iterator

import numpy as np

from .common import Memo

#: Symbols are bytes, bytes that end a word (256 more), and the end of a pretoken.
END = 512
BITS = 10
#: States of a table before it is begun anew.
MAX_STATES = 400_000


def byte_alphabet() -> list[str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else 256 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a byte-level BPE file; tokens are strings of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {ch: chr(b) for b, ch in enumerate(byte_alphabet())}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        #: Whether the last byte of a word is a symbol of its own.
        self.marks_ends = bool(suffix)

        def symbols(token: str) -> str:
            plain = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            out = "".join(byte[ch] for ch in plain)
            return out if plain is token else out[:-1] + chr(ord(out[-1]) + 256)

        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.ids = {symbols(t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.raw = {i: bytes(ord(ch) & 255 for ch in t) for i, t in self.tokens.items()} | {i: t for t, i in self.special.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        pairs = [(self.ids[symbols(a)], self.ids[symbols(b)]) for a, b in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.merged = [self.ids[self.tokens[a] + self.tokens[b]] for a, b in pairs]
        #: Token -> (rank of the merge that makes it, left part, right part).
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (pair, new) in enumerate(zip(pairs, self.merged, strict=True)):
            self.made.setdefault(new, (rank, *pair))
        self.longest = max(map(len, self.ids))
        self.lookahead = sufficient_lookahead(pairs, self.merged, {i: len(t) for i, t in self.tokens.items()})
        #: What a longer token starts with.
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t))}
        self.edges = Memo(self._edges, 100_000)
        self.pair_ok = Memo(self._pair_ok, 200_000)
        self.alone = Memo(lambda i: self.merge(self.tokens[i]) == [i], 100_000)

    def merge(self, symbols: str) -> list[int]:
        """Plain BPE: apply the lowest-ranked merge, leftmost first, until none applies."""
        ids = [self.ids[s] for s in symbols]
        far = len(self.ranks)
        while len(ids) > 1:
            order = [self.ranks.get(pair, far) for pair in zip(ids, ids[1:], strict=False)]
            best = min(order)
            if best == far:
                break
            at = order.index(best)
            ids[at : at + 2] = [self.merged[best]]
        return ids

    def _edges(self, key: tuple[int, int]) -> list[tuple[int, int]]:
        """(piece, rank of the merge that takes it up) of all pieces that a token ever has at its left (side 1) or right (side 2) end."""
        token, side = key
        out = [(token, len(self.ranks))]
        while token in self.made:
            taken = self.made[token][0]
            token = self.made[token][side]
            out.append((token, taken))
        return out

    def _pair_ok(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart when their symbols are merged.

        They don't if some piece at the end of the first and some piece at the
        start of the second merge before either is taken up inside its own
        token.  Of equal merges the left one is first.
        """
        ranks, far = self.ranks, len(self.ranks)
        right = self.edges[pair[1], 1]
        for x, x_taken in self.edges[pair[0], 2]:
            for y, y_taken in right:
                rank = ranks.get((x, y), far)
                if rank < x_taken and rank <= y_taken and rank < far:
                    return False
        return True

    def segments(self, data: bytes) -> Iterator[tuple[bytes, int | None]]:
        """(bytes of ordinary text, None) and (special string, its id) in turn."""
        at = 0
        while self.special:
            hits = [(p, -len(s), s) for s in self.special if (p := data.find(s, at)) >= 0]
            if not hits:
                break
            place, _, found = min(hits)
            if place > at:
                yield data[at:place], None
            yield found, self.special[found]
            at = place + len(found)
        if at < len(data):
            yield (data[at:] if at else data), None


def sufficient_lookahead(pairs: list[tuple[int, int]], merged: list[int], length: dict[int, int]) -> int:
    """Symbols behind a boundary after which it can't change any more.

    A merge (a, b) can fail to happen because of what follows b only if an earlier
    merge takes b, or a piece on b's right edge, together with what follows, and
    that one can fail only by a still earlier merge on its own right edge.  Ranks
    fall along such a chain, so the longest one, counted in symbols of the right
    operands, is found in one pass over the merge list.
    """
    right_of: dict[int, int] = {}
    reach: dict[int, int] = {}  # left operand -> longest chain that starts there, among earlier merges
    longest = 0
    for (a, b), new in zip(pairs, merged, strict=True):
        edge, chain = b, 0
        while edge is not None:
            chain = max(chain, reach.get(edge, 0))
            edge = right_of.get(edge)
        chain += length[b]
        reach[a] = max(reach.get(a, 0), chain)
        right_of.setdefault(new, b)
        longest = max(longest, chain)
    return longest


Key = tuple


class Transducer:
    """Deterministic transducer of pretokens: symbols in, stable tokens out.

    Transitions are compiled from the merge list when they are first taken and
    kept in an open-addressed table; the table is begun anew between batches
    when it has more than `limit` states, so its memory is bounded.
    """

    START: Key = ("", -1, 0, 0)

    def __init__(self, merges: Merges, limit: int = MAX_STATES):
        self.merges, self.limit = merges, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[Key, int] = {}
        self.keys: list[Key] = []
        #: Emitted token sequences by number; 0 is none.
        self.out_number: dict[tuple[int, ...], int] = {(): 0}
        self.flat, self.first, self.length = np.zeros(64, np.int32), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.used = self.flat_used = 0
        self._resize(16)
        self.start = self.state(self.START)

    def state(self, key: Key) -> int:
        """Number of a state, shifted so that a symbol fits below."""
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys) << BITS
            self.keys.append(key)
        return n

    def compile(self, state: int, symbol: int) -> tuple[int, tuple[int, ...]]:
        """(next state, emitted tokens) of one transition.

        A key is flat: the symbols behind the earliest place where a longer
        token can still start; the last emitted token, -1 at the start of the
        pretoken and -2 where it no longer matters; then each such place as its
        distance from the end, the number of tokens pending in front of it, and
        these tokens.  The last place is the end itself.
        """
        key = self.keys[state >> BITS]
        if symbol == END:
            return self.start, self.last_pending(key)
        m = self.merges
        tail, last = key[0] + chr(symbol), key[1]
        n, at, whole, live = len(tail), 2, None, []
        while at < len(key):
            back, many = key[at], key[at + 1]
            pending = key[at + 2 : at + 2 + many]
            at += 2 + many
            piece = tail[n - back - 1 :]
            if whole is None and (token := m.ids.get(piece)) is not None:
                before = pending[-1] if pending else last
                if back == 0 or (m.alone[token] if before == -1 else m.pair_ok[before, token]):
                    whole = (*pending, token)
            if piece in m.starts:
                live.append((back + 1, pending))
        common = len(whole)
        for _, pending in live:
            common = min(common, len(pending))
            while pending[:common] != whole[:common]:
                common -= 1
        live.append((0, whole))
        stable = whole[:common]
        if common:
            last = stable[-1]
        if all(len(pending) > common for _, pending in live):
            last = -2
        flat = [tail[n - live[0][0] :], last]
        for back, pending in live:
            flat += (back, len(pending) - common, *pending[common:])
        return self.state(tuple(flat)), stable

    @staticmethod
    def last_pending(key: Key) -> tuple[int, ...]:
        """Tokens pending at the end of what was read."""
        at = 2
        while at + 2 + key[at + 1] < len(key):
            at += 2 + key[at + 1]
        return key[at + 2 :]

    def pending(self, state: int) -> int:
        """Symbols that no emitted token covers yet."""
        return sum(len(self.merges.tokens[i]) for i in self.last_pending(self.keys[state >> BITS]))

    # the table: slot -> key (state and symbol), next state, number of the emitted sequence

    def _resize(self, bits: int) -> None:
        old = None if self.used == 0 else (self.slot_key, self.slot_next, self.slot_out)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_next, self.slot_out = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        if old:
            for i in np.flatnonzero(old[0] >= 0).tolist():
                self._put(int(old[0][i]), int(old[1][i]), int(old[2][i]))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, key: int, following: int, out: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.slot_key[at] >= 0:
            at = (at + 1) & self.mask
        self.slot_key[at], self.slot_next[at], self.slot_out[at] = key, following, out

    def add(self, key: int) -> None:
        following, stable = self.compile(key >> BITS << BITS, key & ((1 << BITS) - 1))
        out = self.out_number.get(stable)
        if out is None:
            out = self.out_number[stable] = len(self.out_number)
            if out == len(self.first):
                self.first, self.length = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.length, np.zeros_like(self.length)])
            while self.flat_used + len(stable) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.first[out], self.length[out] = self.flat_used, len(stable)
            self.flat[self.flat_used : self.flat_used + len(stable)] = stable
            self.flat_used += len(stable)
        self._put(key, following, out)
        self.used += 1
        if 2 * self.used > self.mask:
            self._resize(self.mask.bit_length() + 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of transitions, which are compiled where they are new."""
        while True:
            at = self._home(keys)
            odd = np.flatnonzero(self.slot_key[at] != keys)
            missing = []
            while len(odd):
                found = self.slot_key[at[odd]]
                missing.append(odd[found == -1])
                odd = odd[found >= 0]
                at[odd] = (at[odd] + 1) & self.mask
                odd = odd[self.slot_key[at[odd]] != keys[odd]]
            new = np.unique(keys[np.concatenate(missing)]) if missing else ()
            if not len(new):
                return at
            for key in new.tolist():
                self.add(key)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each pretoken, all ids in order) of the pretokens data[start:end]; ids=False counts only.

        The longest come first, so the ones that go on are always in front.
        """
        if len(self.keys) > self.limit:
            self.clear()
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        place, size = starts[order], sizes[order]
        state = np.full(len(order), self.start, np.int64)
        count = np.zeros(len(order), np.int64)
        steps, negative = [], -size
        last = np.int64(256 if self.merges.marks_ends else 0)
        for j in range(int(size[0]) + 1 if len(size) else 0):
            n, going, ending = (int(np.searchsorted(negative, -x, "right")) for x in (j, j + 1, j + 2))
            key = state[:n]
            key[:going] += data[place[:going] + j]
            key[going:n] += END
            if last:
                key[ending:going] += last
            slot = self.slots(key)
            state[:n] = self.slot_next[slot]
            out = self.slot_out[slot]
            hit = np.flatnonzero(out)
            if len(hit):
                count[hit] += self.length[out[hit]]
                if ids:
                    steps.append((hit, out[hit]))
        counts = np.empty_like(count)
        counts[order] = count
        if not ids:
            return counts, None
        flat, first, length = self.flat, self.first, self.length
        result = np.empty(int(counts.sum()), np.int32)
        begin = (np.cumsum(counts) - counts)[order]
        for hit, out in steps:
            many = length[out]
            for k in range(int(many.max())):
                more = many > k
                result[begin[hit[more]] + k] = flat[first[out[more]] + k]
            begin[hit] += many
        return counts, result

    # one pretoken at a time, in parts

    def feed(self, key: Key, part: bytes) -> tuple[Key, list[int]]:
        """(state behind part, tokens that have become stable); states are given as keys, which outlive the table."""
        out: list[int] = []
        state, steps = self.state(key), {}
        for byte in part:
            step = steps.get(state | byte)
            if step is None:
                step = steps[state | byte] = self.compile(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return self.keys[state >> BITS], out

    def finish(self, key: Key) -> list[int]:
        """Tokens that are pending at the end of the pretoken."""
        return [*self.last_pending(key)]


# Pretokens of whole batches of plain texts

WS, LETTER, DIGIT, OTHER, INNER, BREAK = range(6)
#: Between the texts of a batch; no plain text has it.
SEPARATOR = b"\0"
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, 0x0A]] = WS
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x80:0xC0] = INNER
_CLASS[0] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ASCII = bytes([0x0A, *range(0x20, 0x7F)])
#: Latin-1 signs and letters whose class, case and composition no Unicode version changes.
_SIGNS = bytes(b for b in range(0xA1, 0xC0) if b not in (0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE))


def is_plain(data: bytes) -> bool:
    """Whether a text is printable ASCII, line ends, and plain letters and signs of Latin-1."""
    rest = data.translate(None, _ASCII)
    if not rest:
        return True
    try:
        text = rest.decode()
        data.decode()
        odd = text.encode("latin-1").translate(None, _SIGNS + bytes(range(0xC0, 0x100)))
    except UnicodeError:
        return False
    return not odd


def _classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    inner = np.flatnonzero(kind == INNER)
    if len(inner):
        before = inner - 1
        signs = before[(data[before] == 0xC3) & ((data[inner] == 0x97) | (data[inner] == 0xB7))]
        kind[signs] = OTHER
        kind[inner] = kind[before]
    return kind


def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """A pretoken that begins with an apostrophe before s, t, m, d, re, ve or ll takes these along."""
    quotes = np.flatnonzero(data == 0x27)
    for i in quotes[start[quotes]].tolist():
        two = bytes(data[i + 1 : i + 3])
        size = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") else 0
        if size:
            start[i + 1] = False
            if kind[i + 1 + size] == LETTER:
                start[i + 1 + size] = True


def byte_pretokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pretokens of plain texts, each followed by SEPARATOR: words with the space before, and white space."""
    kind = _classes(data)
    before, after = np.empty_like(kind), np.full_like(kind, BREAK)
    before[:1], before[1:], after[:-1] = BREAK, kind[:-1], kind[1:]
    white = kind == WS
    spaced = np.zeros(len(data), bool)
    spaced[1:] = data[:-1] == 0x20
    start = kind != before
    start &= white | ~spaced | (kind == BREAK)
    start |= white & (after != WS) & (after != BREAK)
    _contractions(data, kind, start)
    return _bounds(kind, start, (BREAK,))


def word_pretokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case data, starts, ends) of the pretokens of plain texts, each followed by SEPARATOR: runs of letters or signs, single figures."""
    kind = _classes(data)
    data = _LOWER[data]
    inner = np.flatnonzero((data >= 0x80) & (data < 0x9F) & (data != 0x97))
    data[inner[data[inner - 1] == 0xC3]] += 0x20
    before = np.empty_like(kind)
    before[:1], before[1:] = BREAK, kind[:-1]
    start = (kind != before) | (kind == DIGIT)
    _contractions(data, kind, start)
    return data, *_bounds(kind, start, (BREAK, WS))


def _bounds(kind: np.ndarray, start: np.ndarray, left_out: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(kind)) if len(starts) else starts
    keep = ~np.isin(kind[starts], left_out)
    return starts[keep], ends[keep]
