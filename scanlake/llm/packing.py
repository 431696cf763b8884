"""Best-fit packing of token sequences with bin completion.

Only the lengths matter for packing, and there are at most ``capacity`` different ones, so the search works
on a histogram: a pattern (lengths that share a sequence) and how often it is used. The incumbent is
best-fit decreasing; bin completion then takes the largest length left, enumerates the undominated fillings of
the rest of its sequence, fullest first and one at a time as they are asked for, and branches over them and
over how often each is used. It prunes where the waste, or the lower bound of what is left, exceeds what a
solution with one sequence less may have. The search is complete: it ends at the lower bound, with all
branches tried (the packing is then optimal), or after MAX_NODES nodes and fillings looked at, its only
limit, and returns the best packing found. Its cost depends on the capacity, not on the number of documents.

Pieces are placed by their rank among pieces of equal length: the ranks are counted per task and then
offset, so no length is brought together in one place.

Defined cases: a null text is an empty one, whose only id is END; a document over the capacity is cut into
full pieces and a last, shorter one; very long texts are tokenized in parts; repeated rows are packed each;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_map, fewer_parts, written

CAPACITY, END = 2048, 0
MAX_NODES = 6000
#: Bytes of words and their ids that a worker keeps, twice: those of late, and those before them.
CACHE_BYTES, WORD_OVERHEAD = 32 << 20, 240
#: Characters of a text that are tokenized at a time, but for what follows up to a space to cut at.
CHUNK = 1 << 16


# ---- tokens -------------------------------------------------------------------------------------------------

_PLAIN = re.compile("[\t\n\r -~¡¿«»À-ÖØ-öø-ÿ–—‘’“”…€]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


class WordTokenizer:
    """The ids that the tokenizer file gives, with the ids of words kept.

    In texts of the characters of _PLAIN the file's rules (composed form, lower case, split into letters, digits
    and other signs, white space dropped) amount to _WORDS over the lower-cased text, and each word is encoded
    by itself. Other texts, and those that may hold a special token, go to the tokenizer as they are.

    Long texts go in parts, cut at a space between two ASCII letters or digits: white space ends a word under the
    file's rules, nothing composes across it, and no special token holds any. A text without such a space is one part."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.before: dict[str, bytes] = {}
        self.held = 0
        bytes_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show the others from 256 on
        shown = {b: chr(b) for b in bytes_shown}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.shown = {chr(b): c for b, c in shown.items()}
        self.table = str.maketrans(self.shown)

    def word(self, word: str) -> bytes:
        if self.held >= CACHE_BYTES:
            self.known, self.before, self.held = {}, self.known, 0
        ids = self.known.get(word) or self.before.get(word)  # the caller may look into older ones
        if ids is None:
            ids = np.array([t.id for t in self.whole.model.tokenize(word.encode().decode("latin-1").translate(self.table))], "<u4").tobytes()
        self.known[word] = ids
        self.held += len(word) + len(ids) + WORD_OVERHEAD
        return ids

    def _part(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in _WORDS.findall(text.lower())])

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if len(text) <= CHUNK:
            return self._part(text)
        return b"".join(map(self._part, parts_of(text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


def parts_of(text: str, chunk: int | None = None) -> Iterator[str]:
    chunk = chunk or CHUNK
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + chunk)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces_of(packed: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of ids packed as little-endian 32-bit numbers."""
    n = len(packed) // 4
    return [(k, a, min(capacity, n - a), zlib.crc32(packed[4 * a : 4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]


# ---- the packing of a histogram -------------------------------------------------------------------------------

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), times


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on runs of equal bins: each run is (free, contents, bins)."""
    runs: list[tuple[int, tuple, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        kept: list[tuple[int, tuple, int]] = []
        for free, inside, bins in sorted(runs):
            fit = free // length
            if not left or not fit:
                kept.append((free, inside, bins))
                continue
            full = min(bins, left // fit)
            if full:
                kept.append((free - fit * length, (*inside, (length, fit)), full))
                left -= full * fit
            if bins > full and left:  # fewer than fit are left: they share one bin
                kept.append((free - left * length, (*inside, (length, left)), 1))
                full, left = full + 1, 0
            if bins > full:
                kept.append((free, inside, bins - full))
        per = capacity // length
        if left >= per:
            kept.append((capacity - per * length, ((length, per),), left // per))
        if left % per:
            kept.append((capacity - left % per * length, ((length, left % per),), 1))
        runs = kept
    return [(inside, bins) for _, inside, bins in runs]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2."""
    lengths = np.array(sorted(x for x, c in counts.items() if c), np.int64)
    if not len(lengths):
        return 0
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    upto = np.concatenate(([0], np.cumsum(n)))  # of the k shortest: pieces, and tokens
    tokens = np.concatenate(([0], np.cumsum(n * lengths)))
    small = np.searchsorted(lengths, capacity // 2, "right")  # these and shorter ones are at most half
    k = np.concatenate(([0], lengths[:small]))
    first, alone = np.searchsorted(lengths, k), np.searchsorted(lengths, capacity - k, "right")
    free = capacity * (upto[alone] - upto[small]) - (tokens[alone] - tokens[small])
    rest = tokens[small] - tokens[np.minimum(first, small)]
    more = -(-np.maximum(0, rest - free) // capacity)
    return int((upto[-1] - upto[small] + more).max())


class _Reach:
    """Item i: a number whose bit s says whether some of the first i lengths, within their counts, sum to s."""

    def __init__(self):
        self.sums: list[int] = []

    def fill(self, lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
        if not self.sums:
            self.sums, mask = [1], (1 << room + 1) - 1
            for x in lengths:
                now, left, step = self.sums[-1], min(counts[x], room // x), 1
                while left:
                    step = min(step, left)
                    now |= now << x * step & mask
                    left -= step
                    step *= 2
                self.sums.append(now)
        return self.sums


def fillings(lengths: list[int], counts: dict[int, int], room: int, spare: int | None = None, sums: _Reach | None = None) -> Iterator[tuple[int, ...] | None]:
    """Undominated sets, largest length first, of the lengths left (ascending, with counts) that leave at most spare of room, fullest first.

    A set is left out if some of its lengths (none, one or two of them) can be put in the place of one length that
    is left over, is at least as long and fits: that set with the longer one is as good. None stands
    for a set that was looked at and left out, so that callers can count the work. Callers may change the counts
    between two sets if they change them back before the next, and may empty sums then."""
    spare = room if spare is None else min(spare, room)
    if counts.get(room):  # one length fills the room, and takes the place of any other set
        yield (room,)
        return
    own, sums = [x for x in lengths[: bisect_right(lengths, room)] if counts[x]], sums or _Reach()
    reach = lambda: sums.sums or sums.fill(own, counts, room)

    def left_over(low: int, high: int, used: dict[int, int]) -> bool:
        """Whether a length from low to high is left over."""
        return any(counts[y] > used.get(y, 0) for y in own[bisect_left(own, low) : bisect_right(own, high)])

    def grow(i: int, goal: int, unfilled: int, used: dict[int, int]) -> Iterator[tuple[int, ...] | None]:
        """Sets of the first i lengths that sum to goal, beside those used, which are all longer."""
        if not goal:
            inside = tuple(x for x, c in used.items() for _ in range(c))
            # what is left over after the last choice: nothing may fit beside the set, nor take the place of one or two
            worse = unfilled and (left_over(1, unfilled, used) or any(left_over(x + 1, x + unfilled, used) for x in used))
            pairs = [x + y for x in used for y in used if x < y] + [2 * x for x, c in used.items() if c > 1]
            yield None if worse or any(left_over(p, p + unfilled, used) for p in pairs) else inside
            return
        for j in range(min(i, bisect_right(own, goal)) - 1, -1, -1):
            if not reach()[j + 1] >> goal & 1:
                return  # the shorter ones don't sum to it either
            x = own[j]
            for copies in range(min(counts[x], goal // x), 0, -1):
                if not reach()[j] >> goal - copies * x & 1:
                    continue
                # every longer length is decided on, so a sum that is left over now stays so
                if any(counts.get(x + y, 0) > used.get(x + y, 0) for y in used) or copies > 1 and counts.get(2 * x, 0) > used.get(2 * x, 0):
                    yield None
                    continue
                used[x] = copies
                yield from grow(j, goal - copies * x, unfilled, used)
                del used[x]

    for unfilled in range(spare + 1):
        if reach()[-1] >> room - unfilled & 1:
            yield from grow(len(own), room - unfilled, unfilled, {})


@dataclass
class _Node:
    """The fillings to try for the largest length left; the one tried now, and how often."""

    most: int
    sets: Iterator[tuple[int, ...] | None]
    sums: _Reach
    without: tuple[int, ...]  # the node above has this one once more
    filling: tuple[int, ...] = ()
    times: int = 0


def pack(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[Pattern]:
    """Patterns and how often each is used, in as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    best = best_fit_decreasing(counts, capacity)
    used, least = sum(t for _, t in best), lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    left, lengths = dict(counts), sorted(counts)
    waste = made = nodes = 0  # tokens unfilled in the sequences made so far, and their number

    def change(filling: tuple[int, ...], times: int) -> None:
        nonlocal waste, made
        for x in set(filling):
            left[x] -= times * filling.count(x)
            at = bisect_left(lengths, x)
            there = at < len(lengths) and lengths[at] == x
            if left[x] and not there:
                lengths.insert(at, x)
            elif not left[x] and there:
                del lengths[at]
        waste += (capacity - sum(filling)) * times
        made += times

    def node(without: tuple[int, ...] = ()) -> _Node:
        sums = _Reach()
        return _Node(lengths[-1], fillings(lengths, left, capacity - lengths[-1], (used - 1) * capacity - total - waste, sums), sums, without)

    path = [node()] if used > least else []
    while path and used > least and nodes < max_nodes:
        at = path[-1]
        nodes += 1
        if at.times:  # tried: now the same filling once less
            change(at.filling, -at.times)
            at.times -= 1
        if not at.times:
            left[at.most] -= 1
            found = next(at.sets, _Node)
            left[at.most] += 1
            if found is _Node:
                path.pop()
                continue
            if found is None or (at.most, *found) == at.without:
                continue
            at.filling = (at.most, *found)
            at.times = min(left[x] // at.filling.count(x) for x in set(at.filling))
            if spare := capacity - sum(at.filling):
                at.times = min(at.times, ((used - 1) * capacity - total - waste) // spare)
            if at.times < 1:  # this filling wastes too much, and so do those after it
                at.times = 0
                path.pop()
                continue
        change(at.filling, at.times)
        if not lengths:
            best, used = [(tuple((x, n.filling.count(x)) for x in dict.fromkeys(n.filling)), n.times) for n in path], made
        elif made + lower_bound(left, capacity) < used:
            at.sums.sums = []  # made anew if the search comes back
            path.append(node(at.filling if lengths[-1] == at.most else ()))
    return best


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, times, first sequence and offset of its runs; rank a + j * times + i goes to sequence s + i, the j-th there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for inside, times in patterns:
        offset = 0
        for length, copies in inside:
            a = ranks.get(length, 0)
            runs.setdefault(length, []).append((a, times, sequence, offset))
            ranks[length] = a + copies * times
            offset += copies * length
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


# ---- the operator -----------------------------------------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def _cut(path: str, capacity: int, end: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = tokenizer(path).packed, b"" if end is None else end.to_bytes(4, "little")
        part, ranks = TaskContext.get().partitionId(), {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in pieces_of(encode(text or "") + last, capacity):
                    rows.append((doc_id, *piece, part, ranks.get(piece[2], 0)))
                    ranks[piece[2]] = ranks.get(piece[2], 0) + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return run


def _place(where: dict[int, tuple[np.ndarray, ...]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = lengths == n
                a, times, first, at = where[n]
                i = np.searchsorted(a, ranks[own], "right") - 1
                j, k = np.divmod(ranks[own] - a[i], times[i])
                sequence[own], offset[own] = first[i] + k, at[i] + j * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # parts are joined before they are cut, as a task's ranks go by its number
    pieces = written(arrow_map(fewer_parts(asked), _cut(tokenizer_path, capacity, end), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: at most capacity
    ranked = pieces.join(bases.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return arrow_map(fewer_parts(ranked), _place(places(pack(counts, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
