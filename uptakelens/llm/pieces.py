"""A SentencePiece vocabulary as a max-plus lattice: best segmentations of texts and of chunks.

A segmentation's score is the sum of its pieces' scores, the best has the greatest; of equal ones,
the one whose pieces begin earlier, seen from the end. A character that is no piece is one unknown
step, which costs UNKNOWN more than the worst piece and is written as its bytes.

Blanks are written as MARK, and a text begins with one more. Between two characters that stand side by
side in no piece, every path has a border. The stretches between borders are segmented each on its
own: all distinct stretches of a batch of texts in step, as arrays (`encode_all`), or, where a chunk of
a giant text begins or ends inside one, by the plain recurrence over its characters (`forward`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece

from uptakelens.llm import ragged

MARK = "▁"
#: Stands for a MARK that the text itself holds; no valid text has this code point.
OWN_MARK = "\ud800"
UNKNOWN = 10.0
#: Stretches of up to the last of these lengths are segmented in step, in groups of such a length.
LENGTHS = (2, 4, 6, 8, 12, 16, 24, 48)
#: So many distinct stretches, about, are remembered by a worker process, the first it meets.
REMEMBERED = 100_000
#: So many stretches at a time.
LANES = 1 << 11
NONE = float("-inf")
_ALL = (1 << 64) - 1
_STEP, _SPREAD = 0x9FB21C651E98DF25, 0x9E3779B97F4A7C15
_STEP_64 = np.uint64(_STEP)


def _code_values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for every code point."""
    return ragged.mixed(codes.astype(np.uint64) + np.uint64(0x51ED2701))


def marked(text: str) -> str:
    """The text with marks for blanks, character by character."""
    return text.replace(MARK, OWN_MARK).replace(" ", MARK)


def normal(text: str) -> str:
    """The text as the lattice sees it: empty, or a mark and the marked text."""
    return MARK + marked(text) if text else ""


@dataclass(frozen=True)
class Stretches:
    """Segmented stretches by the hash of their characters: length, where their characters and
    their ids begin, how many ids there are, and score."""

    names: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    scores: np.ndarray
    codes: np.ndarray
    ids: np.ndarray

    def joined(self, other: Stretches) -> Stretches:
        """Both, by name; where both have one, the first stays."""
        keep = np.flatnonzero(~np.isin(other.names, self.names))
        names = np.concatenate([self.names, other.names[keep]])
        order = np.argsort(names, kind="stable")
        pairs = (
            (self.sizes, other.sizes[keep]),
            (self.places, other.places[keep] + len(self.codes)),
            (self.begins, other.begins[keep] + len(self.ids)),
            (self.counts, other.counts[keep]),
            (self.scores, other.scores[keep]),
        )
        columns = (np.concatenate(pair)[order] for pair in pairs)
        pools = (np.concatenate([self.codes, other.codes]), np.concatenate([self.ids, other.ids]))
        return Stretches(names[order], *columns, *pools)


#: A stretch that no text has, so that there is always one to compare with.
_NOTHING = Stretches(
    np.zeros(1, np.uint64),
    *(np.zeros(1, np.int64) for _ in range(4)),
    np.zeros(1),
    np.zeros(0, np.int32),
    np.zeros(0, np.int32),
)


def unlike(
    codes: np.ndarray, begin: np.ndarray, size: np.ndarray, others: np.ndarray, place: np.ndarray
) -> np.ndarray:
    """Numbers of the spans of codes that differ from the equally long ones of `others` at `place`."""
    ends = np.cumsum(size)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    differ = codes[np.repeat(begin, size) + inside] != others[np.repeat(place, size) + inside]
    if not differ.any():
        return np.zeros(0, np.int64)
    return np.unique(np.searchsorted(ends, np.flatnonzero(differ), "right"))


class Vocabulary:
    """Pieces with scores, and what they decode to."""

    def __init__(self, model: bytes) -> None:
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = source.get_piece_size()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.surface: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif source.is_control(i) or source.is_unknown(i) or source.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (source.get_score(i), i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.unknown = min(score for score, _ in self.pieces.values()) - UNKNOWN
        # Characters that stand beside others in a piece, numbered from 1, and which pairs do.
        joined = sorted({c for piece in self.pieces if len(piece) > 1 for c in piece})
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        self.pairs = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for piece in self.pieces:
            own = self.number[[ord(c) for c in piece]]
            self.pairs[own[:-1], own[1:]] = True
        self.surface_size = np.array([len(x) for x in self.surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.surface_pool = np.frombuffer(b"".join(self.surface), np.uint8)
        self.known = _NOTHING
        self._fill_table()

    def _fill_table(self) -> None:
        """The pieces by the hash of their characters, in an open-addressed table."""
        bits = max(10, int(np.ceil(np.log2(8 * len(self.pieces)))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.place = np.zeros(1 << bits, np.int32)
        self.score = np.full(len(self.surface) + 1, NONE)
        characters = sorted({ord(c) for piece in self.pieces for c in piece})
        values = dict(zip(characters, _code_values(np.array(characters)).tolist(), strict=True))
        for piece, (score, i) in self.pieces.items():
            self.score[i] = score
            key = 0
            for c in piece:
                key = (key * _STEP + values[ord(c)]) & _ALL
            slot = ((key * _SPREAD) & _ALL) >> int(self.shift)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.keys[slot], self.place[slot] = key, i

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Id of the piece of each hash, -1 where there is none."""
        slot = ((keys * np.uint64(_SPREAD)) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.place[slot], -1)
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.place[slot[rest[hit]]]
            rest = rest[~hit & (found != 0)]
        return out

    def unknown_ids(self, character: str) -> list[int]:
        raw = (MARK if character == OWN_MARK else character).encode()
        return [self.byte_ids[b] for b in raw]

    def forward(self, s: str, entry: list[float], begins: int) -> tuple[list[float], list[int]]:
        """Best score of every border of s, and the border before it (-1: entered there). A path
        may enter at border a with entry[a]; pieces begin before `begins`."""
        pieces, longest, n = self.pieces, self.longest, len(s)
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[: len(entry)] = entry[: n + 1]
        for i in range(min(begins, n)):
            here = best[i]
            if here == NONE:
                continue
            single = False
            for j in range(i + 1, min(i + longest, n) + 1):
                found = pieces.get(s[i:j])
                if found is not None:
                    single = single or j == i + 1
                    if here + found[0] > best[j]:
                        best[j], back[j] = here + found[0], i
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def traced(self, s: str, back: list[int], at: int) -> tuple[list[int], int]:
        """Ids of the path to border `at`, and the border where it entered."""
        ids: list[int] = []
        while back[at] >= 0:
            i = back[at]
            found = self.pieces.get(s[i:at])
            ids.extend([found[1]] if found is not None else reversed(self.unknown_ids(s[i:at])))
            at = i
        ids.reverse()
        return ids, at

    def in_step(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of stretches given as rows of codes, filled up with 0 behind their size: the
        score of each, whether a piece ends after a character, and which (-1: unknown)."""
        rows, width = codes.shape
        value = np.where(codes > 0, _code_values(codes), np.uint64(0))
        best = np.full((width + 1, rows), NONE)
        best[0] = 0.0
        back = np.full((width + 1, rows), -1, np.int8)
        piece = np.full((width + 1, rows), -1, np.int32)
        found, key = [], np.zeros((rows, width), np.uint64)
        for k in range(min(self.longest, width)):
            key = key[:, : width - k] * _STEP_64 + value[:, k:]
            key[codes[:, k:] == 0] = 0
            found.append(self.find(key.T.ravel()).reshape(width - k, rows))
        for i in range(width):
            for k in range(min(self.longest, width - i)):
                own = found[k][i]
                score = best[i] + self.score[own]
                if k == 0:
                    score = np.where(own < 0, best[i] + self.unknown, score)
                better = np.flatnonzero(score > best[i + k + 1])
                best[i + k + 1][better] = score[better]
                back[i + k + 1][better] = i
                piece[i + k + 1][better] = own[better]
        ends = np.zeros((rows, width + 1), bool)
        lane, at = np.arange(rows), size.copy()
        total = best[at, lane]
        while len(lane):
            ends[lane, at] = True
            at = back[at, lane].astype(np.int64)
            lane, at = lane[at > 0], at[at > 0]
        return total, ends[:, 1:], piece.T[:, 1:]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts (as the lattice sees them), where each text's begin, and scores."""
        whole = "".join(texts).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(whole, np.uint32).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), at, np.zeros(len(texts))
        number = self.number[codes]
        border = np.ones(len(codes) + 1, bool)
        border[1:-1] = ~self.pairs[number[:-1], number[1:]]
        border[at] = True
        begin = np.flatnonzero(border)[:-1]
        size = np.diff(np.flatnonzero(border))
        # Short stretches by the hash of their characters, long ones by these themselves.
        value = _code_values(codes)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value * ragged.powers(_STEP, len(codes)), out=sums[1:])
        inverse = ragged.powers(pow(_STEP, -1, 1 << 64), len(codes) + 1)
        names = (sums[begin + size] - sums[begin]) * inverse[begin] + size.astype(np.uint64)
        del value, sums, inverse
        short = np.flatnonzero(size <= LENGTHS[-1])
        names, first, same = np.unique(names[short], return_index=True, return_inverse=True)
        first = short[first]
        # Two stretches of one name and different characters go by themselves, like long ones.
        rest = np.flatnonzero(size[short] != size[first[same]])
        fit = np.flatnonzero(size[short] == size[first[same]])
        differ = unlike(codes, begin[short[fit]], size[short[fit]], codes, begin[first[same[fit]]])
        alone, place_of = [], {}
        entry = np.zeros(len(size), np.int64)
        entry[short] = same
        for i in [*short[rest].tolist(), *short[fit[differ]].tolist(), *np.flatnonzero(size > LENGTHS[-1]).tolist()]:
            own = whole[4 * begin[i] : 4 * (begin[i] + size[i])]
            if own not in place_of:
                place_of[own] = len(names) + len(alone)
                alone.append(i)
            entry[i] = place_of[own]
        every = np.concatenate([first, np.array(alone, np.int64)])
        own_begin, own_size = begin[every], size[every]
        known, n = self.known, len(names)
        place = np.zeros(len(every), np.int64)
        place[:n] = np.minimum(np.searchsorted(known.names, names), len(known.names) - 1)
        hit = np.zeros(len(every), bool)
        hit[:n] = (known.names[place[:n]] == names) & (known.sizes[place[:n]] == own_size[:n])
        met = np.flatnonzero(hit)
        hit[met[unlike(codes, own_begin[met], own_size[met], known.codes, known.places[place[met]])]] = False
        fresh = np.flatnonzero(~hit)
        new = self._segmented(whole, codes, own_begin[fresh], own_size[fresh])
        begins, n_ids, scores = (x[place] for x in (known.begins, known.counts, known.scores))
        begins[fresh], n_ids[fresh], scores[fresh] = new[0] + len(known.ids), new[1], new[2]
        flat = np.concatenate([known.ids, new[3]])
        if len(known.names) < REMEMBERED:
            self.known = known.joined(self._to_remember(codes, names, fresh, own_begin, own_size, new))
        counts = n_ids[entry]
        stops = np.cumsum(counts)
        out = flat[np.arange(stops[-1]) + np.repeat(begins[entry] - stops + counts, counts)]
        text = np.searchsorted(at, begin, "right") - 1
        text_stops = np.concatenate([[0], np.cumsum(np.bincount(text, counts, len(texts)))]).astype(np.int64)
        return out, text_stops, np.bincount(text, scores[entry], len(texts))

    @staticmethod
    def _to_remember(
        codes: np.ndarray, names: np.ndarray, fresh: np.ndarray, begin: np.ndarray, size: np.ndarray, new: tuple
    ) -> Stretches:
        """The newly segmented stretches that go by a name, with their characters."""
        named = np.flatnonzero(fresh < len(names))
        own = fresh[named]
        begins, counts, scores, ids = (x[named] if k < 3 else x for k, x in enumerate(new))

        def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            places = np.cumsum(size) - size
            return pool[np.repeat(begin - places, size) + np.arange(size.sum())], places

        characters, places = gathered(codes, begin[own], size[own])
        ids, begins = gathered(ids, begins, counts)
        return Stretches(names[own], size[own], places, begins, counts, scores, characters.astype(np.int32), ids)

    def _segmented(
        self, whole: bytes, codes: np.ndarray, begin: np.ndarray, size: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best paths of stretches of the codes: where each one's ids begin, how many they are,
        its score, and all ids."""
        scores = np.zeros(len(begin))
        lanes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        group = np.searchsorted(LENGTHS, size)
        for g, width in enumerate(LENGTHS):
            members = np.flatnonzero(group == g)
            for k in range(0, len(members), LANES):
                some = members[k : k + LANES]
                inside = np.arange(width) < size[some, None]
                place = np.where(inside, begin[some, None] + np.arange(width), 0)
                rows = np.where(inside, codes[place], 0)
                total, ends, piece = self.in_step(rows, size[some])
                scores[some] = total
                row, column = np.nonzero(ends)
                lanes.append(some[row])
                found = piece[row, column]
                ids.append(np.where(found >= 0, found, -1 - rows[row, column]))
        for u in np.flatnonzero(group == len(LENGTHS)):
            stretch = whole[4 * begin[u] : 4 * (begin[u] + size[u])].decode("utf-32-le", "surrogatepass")
            best, back = self.forward(stretch, [0.0], len(stretch))
            scores[u] = best[-1]
            own = np.array(self.traced(stretch, back, len(stretch))[0], np.int64)
            lanes.append(np.full(len(own), u))
            ids.append(own)
        lane, flat = np.concatenate(lanes), np.concatenate(ids)
        order = np.argsort(lane, kind="stable")
        lane, flat = self._with_bytes(lane[order], flat[order])
        counts = np.bincount(lane, minlength=len(begin))
        return np.cumsum(counts) - counts, counts, scores, flat.astype(np.int32)

    def _with_bytes(self, lane: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters (-1 - code) written as the ids of their bytes."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return lane, ids
        raw = {c: self.unknown_ids(chr(-1 - c)) for c in np.unique(ids[unknown]).tolist()}
        counts = np.ones(len(ids), np.int64)
        counts[unknown] = [len(raw[c]) for c in ids[unknown].tolist()]
        out = np.repeat(ids, counts)
        stops = np.cumsum(counts)
        spread = np.concatenate([np.arange(e - n, e) for e, n in zip(stops[unknown], counts[unknown], strict=True)])
        out[spread] = [x for c in ids[unknown].tolist() for x in raw[c]]
        return np.repeat(lane, counts), out

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return self.encode_all([normal(text)])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of runs of ids that begin at `at`."""
        size, begin = self.surface_size[ids], self.surface_begin[ids].copy()
        full = at[:-1][at[1:] > at[:-1]]
        size[full] -= 1  # the mark in front of a text
        begin[full] += 1
        stops = np.cumsum(size)
        data = self.surface_pool[np.repeat(begin - (stops - size), size) + np.arange(size.sum())]
        ends = np.concatenate([[0], stops])[at].astype(np.int32)
        texts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text has
            runs = (ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False))
            return pa.array([self.decode(run) for run in runs], pa.string())
        return texts

    def borders(self, s: str, before: str, size: int) -> tuple[int, int] | None:
        """First and last border that every path has in the first `size` characters of s, which
        follow the character `before` (empty at the beginning); None if there is none."""
        codes = np.frombuffer((before + s[:size]).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[codes]
        found = np.flatnonzero(~self.pairs[number[:-1], number[1:]]) + 1 - len(before)
        if not before:
            return 0, int(found[-1]) if len(found) else 0
        return (int(found[0]), int(found[-1])) if len(found) else None

    def transfer(
        self, s: str, size: int, cut: tuple[int, int] | None, middle: float
    ) -> np.ndarray:
        """Entry a, exit b: the best score of a path that enters the chunk s[:size] at border a and
        leaves it at border size + b, with pieces that begin inside. s has the characters after the
        chunk that such pieces can reach; cut are its borders, middle the score between them."""
        states = self.longest
        out = np.full((states, states), NONE)
        if cut is None:
            for a in range(min(states, len(s) + 1)):
                best, _ = self.forward(s, [NONE] * a + [0.0], size)
                own = best[size : size + states]
                out[a, : len(own)] = own
            return out
        first, last = cut
        best, _ = self.forward(s[last:], [0.0], size - last)
        own = np.array(best[size - last : size - last + states])
        for a in range(min(states, first + 1)):
            head, _ = self.forward(s[:first], [NONE] * a + [0.0], first)
            out[a, : len(own)] = head[first] + middle + own
        return out

    def backtraced(
        self, s: str, size: int, cut: tuple[int, int] | None, middle: list[int], entry: list[float]
    ) -> tuple[list[int], list[list[int]], list[int]]:
        """Ids that all paths through the chunk share, those that follow for each exit, and the
        entry of the path to each exit (-1 if there is none), given the scores of the entries and
        the ids between the borders."""
        states = self.longest
        common: list[int] = []
        last, came = 0, -1
        if cut is None:
            best, back = self.forward(s, entry, size)
        else:
            first, last = cut
            _, back = self.forward(s[:first], entry, first)
            common, came = self.traced(s[:first], back, first)
            common.extend(middle)
            best, back = self.forward(s[last:], [0.0], size - last)
        ends, entries = [], []
        for b in range(states):
            at = size - last + b
            if at < len(best) and best[at] != NONE:
                ids, start = self.traced(s[last:], back, at)
                ends.append(ids)
                entries.append(start if cut is None else came)
            else:
                ends.append([])
                entries.append(-1)
        return common, ends, entries


def vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary in each worker process."""
    return ragged.held(("vocabulary", model), lambda: Vocabulary(model))


def max_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The max-plus product: scores of paths through both."""
    return (left[:, :, None] + right[None, :, :]).max(1)
