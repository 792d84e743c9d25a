"""Best-fit packing of tokenized texts by a linear grouping scheme.

Pieces are counted by length; there are at most `capacity` lengths, so the plan is made from a
table of bounded size, whatever the corpus. Lengths above `small` are parted into groups of equal
cardinality and rounded up to the longest of their group; column generation finds configurations
of these few sizes; actual lengths take the places of the rounded ones; the small lengths then go,
longest first, to the sequences with the least room that holds them. The plan gives each length's
pieces, by rank, their sequence and place, and a last pass looks these up.

Null texts are empty; an empty text is one piece with the end token alone. Only texts of more
tokens than `capacity` are cut. Repeated rows are packed one by one. An empty table gives no rows.
Texts are tokenized whole; a text's words are looked up in a table of words whose ids the
tokenizer has given before, which gives the same ids as the whole text would.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.common import stored

CAPACITY, END = 4096, 1
#: Lengths above a third of the capacity go to so many groups.
GROUPS = 24
#: ASCII punctuation but the apostrophe, between a letter or digit and white space: there the tokenizer always parts.
#: Only letters that stay one letter when normalised and lower-cased; U+0130 doesn't.
_MARKS = re.compile(r"(?<=[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F])([!-&(-/:-@\[-`{-~]+)(?=\s|$)")
#: Letters that the tokenizer's model takes as they are once lower-cased and written as bytes.
_PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
#: Words whose ids are kept in each of two generations.
_KEPT = 300_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """Ids of words; a new word gets its own from the tokenizer or, if of plain letters only, from its model."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            said = word.decode()
            if _PLAIN.fullmatch(said):
                ids = [t.id for t in self.model.tokenize(said.lower().encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.tokenizer.encode(said, add_special_tokens=False).ids
            got = b"".join([i.to_bytes(4, "little") for i in ids])
        self[word] = got
        return got

    def age(self) -> None:
        """Words not seen since the last but one call go."""
        if len(self) > _KEPT:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer that drops white space and parts there.

    The vocabulary's added tokens (`<|endoftext|>` and the like) are one id each wherever their exact
    string stands, as the tokenizer has it by default; a text is parted there first. Words of the
    parts are what white space parts, after A-Z became a-z and trailing punctuation was parted off;
    the tokenizer does both itself, so the ids of the words in turn are the text's.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # words have none left; lower-casing mustn't make any
        self.words = Words(tokenizer)
        self.added = {t.content: i.to_bytes(4, "little") for i, t in tokenizer.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.parted = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        return b"".join(map(self.words.__getitem__, _MARKS.sub(r" \1", text).encode().lower().split()))

    def ids(self, text: str) -> bytes:
        if not self.parted or not any(t in text for t in self.added):
            return self.plain(text)
        return b"".join(self.added.get(part) or self.plain(part) for part in self.parted.split(text))

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.words.age()
        return [self.ids(t) for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: id (the key), piece, start, length, ids_crc32; task, and nth, its place among the task's pieces of its length."""
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for k, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    for p, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        rows.append((k, p, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, nth[size]))
                        nth[size] += 1
                kinds = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[tuple[int, dict[int, int]]]:
    """Groups of equal cardinality, longest first: (longest length, counts of its lengths). A length may be in two."""
    total = sum(counts.values())
    out: list[tuple[int, dict[int, int]]] = []
    at = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = at * groups // total
            end = -(-(g + 1) * total // groups)  # first rank of the next group
            take = min(left, max(1, end - at))
            if len(out) <= g and (not out or out[-1][0] != length):
                out.append((length, {}))
            out[-1][1][length] = out[-1][1].get(length, 0) + take
            at += take
            left -= take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: a knapsack with as many of each size as one likes."""
    unit = max(1, int(np.gcd.reduce(np.append(sizes, capacity))))
    s, room = sizes // unit, capacity // unit
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(s.min()), room + 1):
        fits = s <= c
        got = np.where(fits, best[np.where(fits, c - s, 0)] + values, -1.0)
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], k
        else:
            best[c], last[c] = best[c - 1], -1
    used, c = np.zeros(len(s), int), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            used[last[c]] += 1
            c -= int(s[last[c]])
    return float(best[room]), used


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, times) that cover the demand with few sequences.

    The revised simplex method on configurations, each new one priced by a knapsack; then whole
    parts of the solution are taken and what is left is covered longest first.
    """
    n = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    columns = [np.eye(n, dtype=int)[i] * (capacity // sizes[i]) for i in range(n)]
    for _ in range(rounds):
        basis = np.array(columns, float).T
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, new = best_configuration(s, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        level, direction = np.linalg.solve(basis, d), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(direction > 1e-9, np.maximum(level, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        columns[int(ratio.argmin())] = new
    level = np.linalg.solve(np.array(columns, float).T, d)
    left, out = np.array(demand), []
    for k in np.argsort(-level):
        times = min(int(level[k] + 1e-9), *(int(left[i] // columns[k][i]) for i in np.flatnonzero(columns[k])))
        if times > 0:
            out.append((columns[k], times))
            left = left - columns[k] * times
    while left.any():
        room, c = capacity, np.zeros(n, int)
        for i in np.argsort(-s):
            c[i] = min(left[i], room // s[i])
            room -= c[i] * s[i]
        times = min(int(left[i] // c[i]) for i in np.flatnonzero(c))
        out.append((c, times))
        left = left - c * times
    return out


class Runs:
    """Runs of sequences that hold the same lengths, kept by the room that is left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.by_room: dict[int, list[list]] = defaultdict(list)
        self.ranks: Counter = Counter()

    def add(self, first: int, times: int, held: list[tuple[int, int]]) -> None:
        self.by_room[self.capacity - sum(x for x, _ in held)].append([first, times, held])

    def take(self, length: int, times: int) -> int:
        rank = self.ranks[length]
        self.ranks[length] += times
        return rank

    def new(self, lengths: list[int], times: int) -> None:
        """`times` new sequences of these lengths, with the next pieces of each."""
        self.add(self.sequences, times, [(x, self.take(x, times)) for x in lengths])
        self.sequences += times

    def best_fit(self, length: int, count: int) -> None:
        """Each piece of this length goes to the least room that holds it; to a new sequence if there is none."""
        rooms = [r for r, runs in self.by_room.items() if r >= length and runs]
        heapq.heapify(rooms)
        while count:
            while rooms and not self.by_room[rooms[0]]:
                heapq.heappop(rooms)
            if not rooms:
                each = self.capacity // length
                if count >= each:
                    self.new([length] * each, count // each)
                    count %= each
                else:
                    self.new([length] * count, 1)
                    count = 0
                continue
            room = rooms[0]
            first, times, held = self.by_room[room].pop()
            use = min(times, count)
            if use < times:
                self.by_room[room].append([first + use, times - use, [(x, r + use) for x, r in held]])
            self.add(first, use, [*held, (length, self.take(length, use))])
            if room - length >= length:
                heapq.heappush(rooms, room - length)
            count -= use


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int | None = None, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(length, first rank, times, first sequence, offset) rows that place all pieces, and the number of sequences.

    Pieces of one length with ranks from `first rank` go to as many sequences in turn, at `offset`.
    """
    small = capacity // 3 if small is None else small
    runs = Runs(capacity)
    if counts.get(capacity):
        runs.new([capacity], counts[capacity])
    large = {x: n for x, n in counts.items() if small < x < capacity}
    if large:
        parts = grouped(large, groups)
        supply = [sorted(([x, n] for x, n in held.items()), reverse=True) for _, held in parts]
        for uses, times in configurations([x for x, _ in parts], [sum(h.values()) for _, h in parts], capacity):
            slots = [i for i in range(len(parts)) for _ in range(uses[i])]
            done = 0
            while done < times:
                # actual lengths: a run lasts until one of its groups comes to another length
                need = Counter(slots)
                step = times - done
                for i, k in need.items():  # with fewer pieces of a length than its slots, one sequence at a time
                    step = min(step, max(1, supply[i][0][1] // k))
                runs.new([_drawn(supply[i], step) for i in slots], step)
                done += step
    for length in sorted((x for x in counts if x <= small and x < capacity), reverse=True):
        runs.best_fit(length, counts[length])
    rows = []
    for held_runs in runs.by_room.values():
        for first, times, held in held_runs:
            offset = 0
            for length, rank in held:
                rows.append((length, rank, times, first, offset))
                offset += length
    return np.array(sorted(rows), np.int64).reshape(-1, 5), runs.sequences


def _drawn(supply: list[list[int]], n: int) -> int:
    """The longest length a group has left, of which n pieces are taken."""
    length, there = supply[0]
    if there == n:
        supply.pop(0)
    else:
        supply[0][1] -= n
    return length


def ranked(rows: DataFrame) -> DataFrame:
    """`rank` of each piece among those of its length: the pieces of tasks before its own, then its place in its task."""
    cells = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    # a row for each task that has the length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(cells, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = stored(pieces(docs, tokenizer, key, text, capacity, end))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table, _ = plan(counts, capacity)
    # length and first rank as one number that sorts alike
    shift = 1 << 48
    starts = table[:, 0] * shift + table[:, 1]
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
                found = table[np.searchsorted(starts, length * shift + rank, "right") - 1]
                new = [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], [*names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    placed = ranked(rows).select(*names, "rank").mapInArrow(place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.select(F.col("id").alias(key), *placed.columns[1:])
