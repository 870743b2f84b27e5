"""The vocabulary of a piece model, its BPE merges, and the automaton for best-score segmentation."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


@dataclass
class Vocabulary:
    """Pieces of a model file. Bounded by the vocabulary, so it may be broadcast."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    strings: list[str | None]  # by id; None for byte, control and unknown pieces
    alphabet: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models without text normalisation and with a leading space are known")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces):
            raise ValueError("a piece crosses a space: pre-tokens can't be counted alone")
        byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                byte_ids[int(p.piece[1:-1], 16)] = i
        strings: list[str | None] = [None] * len(model.pieces)
        for i, p, _ in pieces:
            strings[i] = p
        return cls({p: i for i, p, _ in pieces}, {p: s for _, p, s in pieces}, byte_ids, strings, {c for _, p, _ in pieces for c in p})


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of one pre-token: the adjacent pair of best score joins first, leftmost of equals."""
    if len(text) > 100:
        return merged_long(text, scores)
    never = float("-inf")
    symbols = list(text)
    get = scores.get
    pairs = [get(a + b, never) for a, b in zip(symbols, symbols[1:])]
    while pairs and (best := max(pairs)) != never:
        i = pairs.index(best)
        symbols[i] += symbols.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(symbols[i] + symbols[i + 1], never)
        if i:
            pairs[i - 1] = get(symbols[i - 1] + symbols[i], never)
    return symbols


def merged_long(text: str, scores: dict[str, float]) -> list[str]:
    """As merged(), with a heap, in n log n steps."""
    symbols: list[str] = list(text)
    n = len(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (score := scores.get(both := symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (-score, i, j, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not symbols[i] or nxt[i] != j or len(symbols[i]) + len(symbols[j]) != len(both):
            continue  # one of the two has since joined another
        symbols[i], symbols[j] = both, ""
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    return [s for s in symbols if s]


def whole_tokens(vocabulary: Vocabulary) -> dict[str, int]:
    """Pre-tokens proved to be one token: the vocabulary's strings whose merges end in one piece."""
    return {p: 1 for p in vocabulary.ids if len(merged(p, vocabulary.scores)) == 1}


PRE_TOKENS = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")


def pre_tokens(text: str) -> list[str]:
    """The parts that no merge crosses: each run of spaces with what follows it."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE + SPACE in marked or marked[-1] == SPACE:
        return PRE_TOKENS.findall(marked)
    return [SPACE + x for x in marked[1:].split(SPACE)]


def breaks(vocabulary: Vocabulary) -> re.Pattern[str]:
    """Splits at line ends and tabs if no piece has them: nothing joins across, and each is one byte."""
    return re.compile("([" + "".join(c for c in "\n\t\r" if c not in vocabulary.alphabet) + "])")


class Counts(dict):
    """Token counts by pre-token: the proved ones from the start, others merged once when first met.

    At most `room` merged ones are held; then they are forgotten and merged again when met.
    """

    def __init__(self, vocabulary: Vocabulary, whole: dict[str, int], room: int = 1_200_000) -> None:
        super().__init__(whole)
        self.vocabulary, self.whole, self.room = vocabulary, whole, room
        self.most = len(whole) + room
        self.cut = breaks(vocabulary).split

    def __missing__(self, part: str) -> int:
        if len(cut := self.cut(part)) > 1:
            return sum(1 if k % 2 else self[x] for k, x in enumerate(cut) if x)
        ids = self.vocabulary.ids
        n = sum(1 if s in ids else len(s.encode("utf-8", "surrogatepass")) for s in merged(part, self.vocabulary.scores))
        if len(self) > self.most:
            self.clear()
            self.update(self.whole)
        if len(part) <= 32:
            self[part] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


class Automaton:
    """Aho-Corasick automaton over the UTF-8 bytes of all pieces, read by many texts at once.

    `to` has the next state by state and byte, with failures resolved. `out` is the state of the
    longest piece that ends at a state (itself or along the output links), `more` the next shorter.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        trie: list[dict[int, int]] = [{}]
        piece: dict[int, tuple[int, float, int]] = {}
        for text, i in vocabulary.ids.items():
            state, data = 0, text.encode()
            for c in data:
                if c not in trie[state]:
                    trie[state][c] = len(trie)
                    trie.append({})
                state = trie[state][c]
            piece[state] = (len(data), vocabulary.scores[text], i)
        n = len(trie)
        self.to = np.zeros((n, 256), np.int32)
        self.out, self.more = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.length, self.score, self.id = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)
        for state, (size, score, i) in piece.items():
            self.length[state], self.score[state], self.id[state] = size, score, i
        level = [(0, c, t) for c, t in trie[0].items()]
        for _, c, t in level:
            self.to[0, c] = t
        fail = {t: 0 for _, _, t in level}
        while level:
            after = []
            for _, _, t in level:
                f = fail.pop(t)
                self.more[t] = self.out[f]
                self.out[t] = t if t in piece else self.out[f]
                self.to[t] = self.to[f]
                for c, child in trie[t].items():
                    fail[child] = self.to[f, c]
                    after.append((t, c, child))
            for t, c, child in after:
                self.to[t, c] = child
            level = after
        #: A character that no piece is costs more than any piece.
        self.unknown = min(vocabulary.scores.values()) - 10.0

    def segmented(self, texts: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of the segmentation of greatest score sum; of equals, of the longest last piece."""
        found: list[bytes] = [b""] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 8192 and (j - i + 1) * (len(texts[order[j]]) + 1) <= 1 << 19:
                j += 1
            for k, ids in zip(order[i:j], self._equal_work([texts[k] for k in order[i:j]])):
                found[k] = ids
            i = j
        return found

    def _equal_work(self, texts: list[bytes]) -> list[bytes]:
        n, sizes = len(texts), np.array([len(t) for t in texts])
        most = int(sizes.max(initial=0))
        data = np.frombuffer(b"".join(t.ljust(most, b" ") for t in texts), np.uint8).reshape(n, most)
        follows = (data & 0xC0) == 0x80
        at = np.arange(most)[None]
        first = np.maximum.accumulate(np.where(follows, 0, at), axis=1)  # where each byte's character begins
        ends = np.ones((n, most), bool)
        ends[:, :-1] = ~follows[:, 1:]
        score = np.full((n, most + 1), -np.inf)
        score[:, 0] = 0
        back = np.ones((n, most + 1), np.int32)
        ids = np.zeros((n, most + 1), np.int32)
        ids[:, 1:] = self.byte_ids[data]  # what a character without a piece falls back to
        state = np.zeros(n, np.int32)
        for i in range(1, most + 1):
            state = self.to[state, data[:, i - 1]]
            out = self.out[state]
            known = np.zeros(n, bool)
            rows = np.flatnonzero(out >= 0)
            out = out[rows]
            width = i - first[:, i - 1]
            while len(rows):
                size = self.length[out]
                new = score[rows, i - size] + self.score[out]
                better = new > score[rows, i]
                r, o = rows[better], out[better]
                score[r, i], back[r, i], ids[r, i] = new[better], self.length[o], self.id[o]
                known[rows] |= size == width[rows]
                out = self.more[out]
                rows, out = rows[out >= 0], out[out >= 0]
            rows = np.flatnonzero(~known & ends[:, i - 1])
            new = score[rows, i - width[rows]] + self.unknown
            r = rows[new > score[rows, i]]
            score[r, i], back[r, i], ids[r, i] = score[r, i - width[r]] + self.unknown, 1, self.byte_ids[data[r, i - 1]]
        taken, rows, place = [], np.flatnonzero(sizes > 0), sizes.copy()
        while len(rows):
            p = place[rows]
            taken.append((rows, ids[rows, p]))
            place[rows] = p - back[rows, p]
            rows = rows[place[rows] > 0]
        if not taken:
            return [b""] * n
        whose = np.concatenate([r for r, _ in taken])[::-1]
        flat = np.concatenate([x for _, x in taken])[::-1]
        flat = flat[np.argsort(whose, kind="stable")].astype("<i4").tobytes()
        bounds = (4 * np.append(0, np.cumsum(np.bincount(whose, minlength=n)))).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class Segments(dict):
    """Ids (int32 bytes) by pre-token, segmented once when first met; at most `room` are held at a time."""

    def __init__(self, automaton: Automaton, vocabulary: Vocabulary, room: int = 700_000) -> None:
        super().__init__()
        self.automaton, self.room = automaton, room
        self.cut = breaks(vocabulary).split
        self.own = {c: np.array([vocabulary.byte_ids[ord(c)]], "<i4").tobytes() for c in "\n\t\r"}

    def parts(self, text: str | None) -> list[str]:
        """Pre-tokens, cut where no piece joins."""
        found = pre_tokens(text or "")
        if text and ("\n" in text or "\t" in text or "\r" in text):
            out: list[str] = []
            for x in found:
                if "\n" in x or "\t" in x or "\r" in x:
                    out += filter(None, self.cut(x))
                else:
                    out.append(x)
            return out
        return found

    def of(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        if len(self) > self.room:
            self.clear()
        self.update(self.own)
        new = list({p for parts in cut for p in parts if p not in self})
        self.update(zip(new, self.automaton.segmented([p.encode("utf-8", "surrogatepass") for p in new])))
        out = [b"".join(map(self.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > 32:
                del self[p]
        return out


class Decoded:
    """Texts of ids, by a table of the bytes of every id."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        parts = [(s or "").replace(SPACE, " ").encode() for s in vocabulary.strings]
        for b, i in enumerate(vocabulary.byte_ids):
            parts[i] = bytes([b])
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts])
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        """Without the space that stands before every text."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        data = self.pool[np.repeat(self.start[ids] - before, size) + np.arange(int(size.sum()))].tobytes()
        return data[1:] if data[:1] == b" " else data
