"""SentencePiece encoding and decoding: the N best segmentations of whole texts over a piece lattice."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import pick

SPACE, NONE = "▁", -(1 << 60)
#: Scores are whole millionths, so that sums are exact and ties are ties. SHIFT is that of Zipf and Mandelbrot's law.
UNIT, SHIFT = 1_000_000, 1_000
#: Words whose segmentation a worker remembers; the first ones seen are the frequent ones, so they are kept.
REMEMBERED = 1_200_000
SCHEMA = "doc_id long, rank int, score double, n_ids long, ids_crc32 long, decoded_crc32 long, ids array<int>, text string"
#: Bytes of text in a batch of segmentations sent to Spark, unless one text is longer.
BATCH = 4 << 20
#: Characters of text whose words are looked up at once.
CHUNK = 1 << 20
#: Longer words, and fewer new words than these, are segmented one by one.
LONG, FEW = 64, 100


class Rows:
    """Numbered rows: integer facts, and for each pool of the given types the length and the start of a run there; they grow."""

    def __init__(self, facts: int, *types: type):
        self.n, self.facts, self.used = 0, facts, [0] * len(types)
        self.table, self.pools = np.zeros((1024, facts + 2 * len(types)), np.int64), [np.zeros(4096, x) for x in types]

    def extend(self, facts: np.ndarray, *own: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds rows: a column of facts for each; for each pool, the lengths of their runs and the runs one after another."""
        total = self.n + facts.shape[1]
        self.table = _room(self.table, self.n, total)
        new = self.table[self.n : total]
        new[:, : self.facts] = facts.T
        for k, (sizes, run) in enumerate(own):
            used = self.used[k]
            self.pools[k] = _room(self.pools[k], used, used + len(run))
            self.pools[k][used : used + len(run)] = run
            new[:, self.facts + 2 * k] = sizes
            new[:, self.facts + 2 * k + 1] = used + np.cumsum(sizes) - sizes
            self.used[k] = used + len(run)
        self.n = total

    def read(self, numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of rows of these numbers: a column of facts and lengths of runs for each; for each pool, the runs one after another."""
        found = np.ascontiguousarray(np.take(self.table, numbers, axis=0).T)
        at = range(self.facts, len(found), 2)
        return found[[*range(self.facts), *at]], [runs(pool, found[k + 1], found[k]) for k, pool in zip(at, self.pools, strict=True)]

    def cut(self, n: int) -> None:
        """Forgets the rows from number n on."""
        if n < self.n:
            self.n, self.used = n, self.table[n, self.facts + 1 :: 2].tolist()


def _room(array: np.ndarray, used: int, needed: int) -> np.ndarray:
    """The array, or one that holds what is used of it and has room for what is needed."""
    if needed <= len(array):
        return array
    out = np.empty((max(needed, 2 * len(array)), *array.shape[1:]), array.dtype)
    out[:used] = array[:used]
    return out


def runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of these starts and sizes in a pool, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Numbers(dict):
    """Words to their rows. Reading a word that isn't there gives it the next row, and notes it as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def cut(self, n: int) -> None:
        """Notes no word as new any more, and forgets those of them from row n on."""
        for word in self.new[max(0, n - len(self) + len(self.new)) :]:
            del self[word]
        self.new = []


class PieceLattice:
    """Segmentations of a text into pieces of a SentencePiece file, scored by Zipf and Mandelbrot's law on the ranks.

    A BPE file's scores are the order of its merges and no probabilities, so a piece of rank r scores -log(r + SHIFT).
    The best segmentation then is the one that merging gives for nine of ten words; sums of the file's own numbers give
    it for six. A character without a piece is written as its bytes, each of which scores less than any piece. No piece of the file holds the space mark after
    another character; so the lattice of a text is a chain of the lattices of its words, a word being a run of space
    marks and what follows it up to the next.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        ranked = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in ranked):
            raise ValueError("a piece holds a space mark after another character, so that words aren't independent")
        ranked.sort(key=lambda i: (-sp.get_score(i), i))
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.text_of: list[bytes] = [b""] * size
        #: A trie: character to (ids of the piece that ends here or None, its score, what may follow).
        self.trie: dict[str, list] = {}
        for rank, i in enumerate(ranked):
            piece, children, node = sp.id_to_piece(i), self.trie, None
            for c in piece:
                node = children.setdefault(c, [None, 0, {}])
                children = node[2]
            node[:2] = (i,), -round(math.log(rank + SHIFT) * UNIT)
            self.text_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.text_of[i] = bytes([b])
        self.byte_score = -round((math.log(len(ranked) + SHIFT) + 2) * UNIT)
        self.bytes_size = np.array([len(x) for x in self.text_of])
        self.bytes_start = np.cumsum(self.bytes_size) - self.bytes_size
        self.bytes_pool = np.frombuffer(b"".join(self.text_of), np.uint8)
        self._number_nodes()
        self.known = Numbers()
        #: By number of a known word: score, gap to the second best; ids of its best segmentation and what they decode to.
        self.rows = Rows(2, np.int32, np.uint8)
        self.lists: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = {}

    def _number_nodes(self) -> None:
        """The trie in arrays: the node of a first character, and of a node and a character (sorted keys); -1 is no node."""
        ids, scores, keys, to = [], [], [], []
        self.first = np.full(0x110000, -1, np.int32)
        todo = [(-1, self.trie)]
        for above, children in todo:
            for c, (own, score, below) in children.items():
                if above < 0:
                    self.first[ord(c)] = len(ids)
                else:
                    keys.append(above << 21 | ord(c))
                    to.append(len(ids))
                todo.append((len(ids), below))
                ids.append(-1 if own is None else own[0])
                scores.append(score)
        self.node_id, self.node_score = np.array([*ids, -1], np.int64), np.array([*scores, 0], np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.array(to, np.int64)[order]
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.int64)

    def in_bytes(self, char: str) -> tuple[tuple[int, ...], int] | None:
        """Ids and score of a character that is no piece."""
        if (node := self.trie.get(char)) is not None and node[0] is not None:
            return None
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte[b] for b in raw), self.byte_score * len(raw)

    def edges(self, word: str, i: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(end, ids, score) of what can begin at i."""
        if (e := self.in_bytes(word[i])) is not None:
            yield i + 1, *e
        children = self.trie
        for j in range(i, len(word)):
            if (node := children.get(word[j])) is None:
                return
            if node[0] is not None:
                yield j + 1, node[0], node[1]
            children = node[2]

    def viterbi(self, word: str) -> tuple[int, int, tuple[int, ...], int]:
        """Score of the best segmentation, what the second best lacks to it (0 - NONE if there is none), ids, bytes of its text."""
        n, trie = len(word), self.trie
        best, second, back = [NONE] * (n + 1), [NONE] * (n + 1), [(0, ())] * (n + 1)
        best[0] = 0
        for i in range(n):
            b, b2, j, children = best[i], second[i], i, trie
            node = trie.get(word[i])
            if (node is None or node[0] is None) and (e := self.in_bytes(word[i])) is not None:
                j += 1
                if b + e[1] > best[j]:
                    second[j] = max(best[j], b2 + e[1])
                    best[j], back[j] = b + e[1], (i, e[0])
                elif b + e[1] > second[j]:
                    second[j] = b + e[1]
                j = i
            while j < n:
                node = children.get(word[j])
                if node is None:
                    break
                j += 1
                ids, s, children = node
                if ids is not None:
                    v = b + s
                    if v > best[j]:
                        second[j] = best[j] if best[j] > b2 + s else b2 + s
                        best[j] = v
                        back[j] = (i, ids)
                    elif v > second[j]:
                        second[j] = v
        out, j = [], n
        while j:
            j, ids = back[j]
            out.append(ids)
        gap = best[n] - second[n] if second[n] > NONE // 2 else -NONE
        return best[n], gap, tuple(chain.from_iterable(reversed(out))), len(word.encode("utf-8", "surrogatepass")) - 2 * word.count(SPACE)

    def best_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """viterbi of many words: columns of score, gap, bytes and number of ids; the ids of all words, one after another."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(sizes <= LONG)
        if len(short) < FEW:
            short = short[:0]
        facts, starts, pools, used = np.empty((4, len(words)), np.int64), np.empty(len(words), np.int64), [], 0
        if len(short):
            facts[:, short], flat = self._together([words[k] for k in short.tolist()] if len(short) < len(words) else words)
            if len(short) == len(words):
                return facts, flat
            starts[short] = np.cumsum(facts[3, short]) - facts[3, short]
            pools, used = [flat], len(flat)
        alone = np.ones(len(words), bool)
        alone[short] = False
        for k in np.flatnonzero(alone).tolist():
            score, gap, ids, size = self.viterbi(words[k])
            facts[:, k], starts[k] = (score, gap, size, len(ids)), used
            pools.append(np.array(ids, np.int64))
            used += len(ids)
        return facts, runs(np.concatenate(pools), starts, facts[3])

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """best_of, for all words in one pass over their places: at each, all words step down the trie together.

        Words lie by falling length, so those that reach a place are the first ones. As in viterbi, of equal ways to a
        place the one whose last piece begins first stays.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        fall, begin = sizes[order], starts[order]
        longest = int(fall[0])
        reach = np.searchsorted(-fall, -np.arange(longest + 1), "right").tolist() + [0]  # words of at least i characters
        base = np.cumsum([0, *reach[:-1]])
        best, second = (np.full(base[-1], NONE) for _ in range(2))
        back, piece = np.zeros(base[-1], np.int32), np.zeros(base[-1], np.int32)
        best[: reach[0]] = 0
        letters = [chars[begin[: reach[i + 1]] + i] for i in range(longest)]

        def put(i: int, j: int, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
            at, after = base[i] + who, base[j] + who
            v, old = best[at] + score, best[after]
            up = v > old
            second[after] = np.where(up, np.maximum(old, second[at] + score), np.maximum(second[after], v))
            best[after] = np.maximum(old, v)
            after = after[up]
            back[after], piece[after] = i, ids[up]

        for i, here in enumerate(letters):
            node = self.first[here].astype(np.int64)
            if len(odd := np.flatnonzero(self.node_id[node] < 0)):
                put(i, i + 1, odd, len(self.text_of) + here[odd], self.byte_score * _widths(here[odd]))
            who = np.flatnonzero(node >= 0)
            node, j = node[who], i + 1
            while len(who):
                ids = self.node_id[node]
                if len(ends := np.flatnonzero(ids >= 0)):
                    put(i, j, who[ends], ids[ends], self.node_score[node[ends]])
                if j == longest:
                    break
                n = np.searchsorted(who, reach[j + 1])
                who, node = who[:n], node[:n]
                key = node << 21 | letters[j][who]
                at = np.searchsorted(self.keys, key)
                hit = np.flatnonzero(self.keys[at] == key)
                who, node, j = who[hit], self.to[at[hit]], j + 1

        ends = base[fall] + np.arange(len(words))
        facts = np.empty((4, len(words)), np.int64)
        facts[0, order], facts[1, order] = best[ends], np.where(second[ends] > NONE // 2, best[ends] - second[ends], -NONE)
        facts[2] = np.add.reduceat(_widths(chars) - 2 * (chars == ord(SPACE)), starts)
        steps, count, who, at = [], np.zeros(len(words), np.int64), np.arange(len(words)), ends
        while len(who):
            steps.append((who, piece[at]))
            count[who] += 1
            j = back[at]
            left = np.flatnonzero(j)
            who = who[left]
            at = base[j[left]] + who
        many = np.empty(len(words), np.int64)
        many[order] = count
        first = np.cumsum(many) - many
        last, flat = (first + many - 1)[order], np.empty(int(many.sum()), np.int64)
        for step, (who, ids) in enumerate(steps):
            flat[last[who] - step] = ids
        if (odd := flat >= len(self.text_of)).any():  # characters in bytes
            code = flat[odd] - len(self.text_of)
            wide = np.ones(len(flat), np.int64)
            wide[odd] = _widths(code)
            raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            flat, many = np.repeat(flat, wide), np.add.reduceat(wide, first)
            flat[np.repeat(odd, wide)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        facts[3] = many
        return facts, flat

    def n_best(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations, best first.

        Forward Viterbi scores say exactly what the best way from the start to a node is worth; A-star walks back from
        the end with them as heuristic, so that complete ways come out in order. Of equals, nodes nearer the start first.
        """
        size = len(word)
        best: list[int] = [0] + [NONE] * size
        into: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            for j, ids, s in self.edges(word, i):
                best[j] = max(best[j], best[i] + s)
                into[j].append((i, ids, s))
        heap, count, out = [(-best[size], size, 0, 0, None)], 0, []
        while heap and len(out) < n:
            _, j, _, g, tail = heapq.heappop(heap)
            if j == 0:
                ids = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((g, tuple(ids)))
                continue
            for i, ids, s in into[j]:
                count += 1
                heapq.heappush(heap, (-(g + s + best[i]), i, count, g + s, (ids, tail)))
        return out

    def listed(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """n_best of a word with its first space mark; near ties repeat, so the last ones are remembered."""
        if (found := self.lists.get((word, n))) is None:
            if len(self.lists) >= REMEMBERED // 20:
                self.lists.clear()
            found = self.lists[word, n] = self.n_best(SPACE + word, n)
        return found

    def words(self, text: str) -> list[str]:
        """The words without their first space marks: encoding puts one before the text, and every space is another."""
        parts = text.replace(SPACE, " ").split(" ") if text else []
        if "" not in parts[:-1]:
            return parts
        out, marks = [], 0
        for part in parts[:-1]:
            if part:
                out.append(SPACE * marks + part)
                marks = 0
            else:
                marks += 1
        return [*out, SPACE * marks + parts[-1]]

    def encode(self, text: str, n: int) -> list[tuple[int, np.ndarray, list[bytes]]]:
        """(score, ids, decoded slices) of the n best segmentations of the whole text, best first."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: Iterable[str], n: int) -> Iterator[list[tuple[int, np.ndarray, list[bytes]]]]:
        """encode of each text. The words of many texts are looked up at once, and new ones segmented together."""
        held, size = [], 0
        for text in texts:
            held.append(self.words(text))
            size += len(text)
            if size >= CHUNK:
                yield from self._encoded(held, n)
                held, size = [], 0
        yield from self._encoded(held, n)

    def _encoded(self, held: list[list[str]], n: int) -> Iterator[list[tuple[int, np.ndarray, list[bytes]]]]:
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(held)), np.int64, sum(map(len, held)))
        if self.known.new:
            facts, ids = self.best_of([SPACE + w for w in self.known.new])
            self.rows.extend(facts[:2], (facts[3], ids), (facts[2], self._spelled(ids)))
        facts, (flat, spelled) = self.rows.read(numbers)
        # Words beyond the bound of what is remembered have rows for these texts alone.
        self.known.cut(REMEMBERED)
        self.rows.cut(REMEMBERED)
        at = ids_at = byte_at = 0
        for words in held:
            own = facts[:, at : at + len(words)]
            at, ids_end, byte_end = at + len(words), ids_at + int(own[2].sum()), byte_at + int(own[3].sum())
            yield self._best(words, own, flat[ids_at:ids_end], spelled[byte_at:byte_end].tobytes(), n)
            ids_at, byte_at = ids_end, byte_end

    def _best(self, words: list[str], facts: np.ndarray, flat: np.ndarray, whole: bytes, n: int) -> list[tuple[int, np.ndarray, list[bytes]]]:
        """encode of a text of these words, from their facts, the ids of their best segmentations and what these decode to.

        Sums over independent words: of the n best, none changes a word beyond the n - 1 words of smallest gap between
        best and second best (of equals, the first), so only those words are searched by A-star.
        """
        if not words:
            return [(0, np.empty(0, np.int32), [])]
        scores, gap, sizes, lengths = facts
        ends = np.cumsum(sizes)
        near = np.argsort(gap, kind="stable")[: n - 1] if len(gap) <= 4 * n else self._smallest(gap, n - 1)
        chosen = sorted(int(k) for k in near if gap[k] < -NONE)
        lists = [self.listed(words[k], n) for k in chosen]
        base = int(scores.sum()) - sum(x[0][0] for x in lists)
        picks = self._combine(lists, n)
        bytes_end = np.cumsum(lengths)
        out = []
        for pick_ in picks:
            pieces, slices, at, byte_at = [], [], 0, 0
            for k, options, r in zip(chosen, lists, pick_, strict=True):
                a, b = int(ends[k] - sizes[k]), int(bytes_end[k] - lengths[k])
                pieces += flat[at:a], np.array(options[r][1], np.int32)
                slices += whole[byte_at:b], self.decode_part(options[r][1])
                at, byte_at = int(ends[k]), int(bytes_end[k])
            pieces.append(flat[at:])
            slices.append(whole[byte_at:])
            score = base + sum(o[r][0] for o, r in zip(lists, pick_, strict=True))
            out.append((score, np.concatenate(pieces), slices))
        return out

    @staticmethod
    def _smallest(gap: np.ndarray, n: int) -> np.ndarray:
        """Positions of the n smallest, of equals the first."""
        if n <= 0:
            return np.empty(0, np.int64)
        limit = np.partition(gap, n - 1)[n - 1]
        below = np.flatnonzero(gap < limit)
        return np.concatenate((below, np.flatnonzero(gap == limit)[: n - len(below)]))

    @staticmethod
    def _combine(lists: list[list[tuple[int, tuple[int, ...]]]], n: int) -> list[tuple[int, ...]]:
        """The n choices (a place in each list) of largest total."""
        first = (0,) * len(lists)
        lost = lambda c: sum(x[0][0] - x[r][0] for x, r in zip(lists, c, strict=True))
        heap, seen, out = [(0, first)], {first}, []
        while heap and len(out) < n:
            _, c = heapq.heappop(heap)
            out.append(c)
            for i, r in enumerate(c):
                if r + 1 < len(lists[i]) and (d := (*c[:i], r + 1, *c[i + 1 :])) not in seen:
                    seen.add(d)
                    heapq.heappush(heap, (lost(d), d))
        return out

    def decode_part(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids, with the space that encoding puts before the first word."""
        return self._spelled(ids).tobytes()

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        return runs(self.bytes_pool, self.bytes_start[ids], self.bytes_size[ids])


def _widths(chars: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8."""
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


_loaded: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    """One per worker process, so that its memory of words serves later tasks too."""
    if path not in _loaded:
        _loaded[path] = PieceLattice(path)
    return _loaded[path]


def segment(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to n rows per document, best segmentation first: doc_id, rank (from 1), score, n_ids, ids_crc32, decoded_crc32, ids, text.

    Of equal scores, the segmentation that the search meets first, which is the same in every run. ids_crc32: unsigned,
    of little-endian unsigned 32-bit ids. text, in the row of rank 1: what decoding the ids gives; it is the text itself,
    except that U+2581 reads back as a space. The other ranks' ids give the same, so their rows have null there; what
    each gives is in decoded_crc32, of UTF-8, and decode() makes it anew. Narrow map over whole texts, no shuffle.

    Null and empty texts: one segmentation without ids. Repeated rows and null ids: each row on its own.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def rows(out: list[tuple], ids: list[np.ndarray], texts: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array(texts, pa.binary()).cast(pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        for batch in batches:
            out, all_ids, texts, held = [], [], [], 0
            found = model.encode_all((text.as_py() or "" for text in batch.column("text")), n)
            for doc_id, ranked in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                for rank, (score, ids, slices) in enumerate(ranked, 1):
                    whole = b"".join(slices)[1:]
                    out.append((doc_id, rank, score / UNIT, len(ids), zlib.crc32(ids.astype("<i4", copy=False)), zlib.crc32(whole)))
                    all_ids.append(ids)
                    texts.append(whole if rank == 1 else None)
                    held += len(whole)
                    if held >= BATCH:
                        yield rows(out, all_ids, texts)
                        out, all_ids, texts, held = [], [], [], 0
            if out:
                yield rows(out, all_ids, texts)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text that the ids of ids_col (array<int>) give in text_col, which is added or replaced.

    The space that encoding puts before a text is left out. Ids that make no UTF-8, as a part of a text's ids may, give
    U+FFFD there; ids without text, such as control ids, give none; ids outside the file raise an error.
    Narrow map, no shuffle. Null ids, or a null among them: null text. No ids: empty text.
    """
    rows = rows.drop(text_col)
    schema = StructType([*rows.schema.fields, StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)

        def text_of(ids: list[int | None] | None) -> str | None:
            if ids is None or None in ids:
                return None
            if ids and not 0 <= min(ids) <= max(ids) < len(model.text_of):
                raise ValueError("an id that the model file doesn't hold")
            return model.decode_part(tuple(ids)).removeprefix(b" ").decode("utf-8", "replace")

        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = pa.array([text_of(ids.as_py()) for ids in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text_col])

    return rows.mapInArrow(run, schema)
