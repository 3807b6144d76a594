"""Packing documents into fixed-length sequences: cutting-stock column generation.

A document's tokens are cut into full sequences, one piece that is a multiple of a
grain (a 32nd of a sequence) and a last one of half a grain to one and a half, so there
are few lengths (about 80), no document ends in a crumb, and short stock packs tightly.
Only the histogram of piece lengths, as many rows at any corpus size, goes to the driver. There a linear program over patterns (how many pieces of each length
share a sequence) is solved by column generation: a knapsack dynamic programme
prices the next patterns from the program's duals, until none improves it or the
duals prove that no further one can save a sequence. The patterns' counts are rounded
down, what is left over is filled greedily by subset sums, and the plan, again
bounded by ``max_tokens``, is broadcast: the n-th ranked piece of a length takes
the n-th place which the plan has for that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, lean, text_slices, tidy


def cut_documents(docs: DataFrame, tokenizer: str, vocabulary: str, pattern: str, max_tokens: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", narrowed: bool = False) -> DataFrame:
    """Tokenise whole texts and cut them: doc_id, start, length, ids (binary, little-endian u32), doc_tokens, part, nth.

    ``nth`` counts the pieces of one length in ``part``, the task that made them: store the
    table before it is read twice, so that both come from one run of each task.

    ``tokenizer`` is a tokenizer file, ``vocabulary`` the rank file of the same
    vocabulary, which a faster library reads. Where a text holds one of the
    tokenizer's added tokens literally, the tokenizer file itself is used, so the ids are always its
    own. Each document ends with ``end_id``. A null text counts as empty (one
    piece, the end id). Repeated rows and null ids are packed like any other row. With
    ``narrowed`` ids are stored by ``narrow``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import read_ranks

    lean(docs)
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        full = f.read()
    added = [t.content for t in Tokenizer.from_str(full).get_added_tokens_decoder().values()]
    shared = spark.sparkContext.broadcast((full, read_ranks(vocabulary), pattern))
    made: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, tokens, pat = shared.value
        part_id, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        fast = tiktoken.Encoding("pack", pat_str=pat, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in text_slices(batches):
            doc, start, length, ids, total, nth = [], [], [], [], [], []
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                text = text or ""
                if any(a in text for a in added):
                    if "slow" not in made:
                        made["slow"] = Tokenizer.from_str(text_of)
                    packed = np.array(made["slow"].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
                else:
                    packed = fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() + end
                n = len(packed) // 4
                a = 0
                for size in piece_lengths(n, max_tokens):
                    doc.append(key)
                    start.append(a)
                    length.append(size)
                    piece = packed[4 * a : 4 * (a + size)]
                    ids.append(narrow(piece, size) if narrowed else piece)
                    total.append(n)
                    nth.append(seen[size])
                    seen[size] += 1
                    a += size
            kinds = (("doc_id", doc, pa.int64()), ("start", start, pa.int64()), ("length", length, pa.int64()), ("ids", ids, pa.binary()), ("doc_tokens", total, pa.int64()), ("part", [part_id] * len(doc), pa.int32()), ("nth", nth, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for _, x, kind in kinds], [n for n, _, _ in kinds])
        del fast
        made.clear()
        tidy()

    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, nth long")


def priced(values: np.ndarray, sizes: np.ndarray, room: int, most: int = 1) -> tuple[float, list[np.ndarray]]:
    """The most valuable multiset of items that fits in ``room``, by dynamic programming: its value, and counts of up to ``most`` multisets.

    The first is the best; the others are the best that hold some one item, in order of their value.
    """
    top = int(sizes.max())
    worth = np.zeros(top)  # by size - 1, read backwards beside best
    worth[sizes - 1] = np.maximum(values, 0)
    back = worth[::-1].copy()
    best, choice = np.zeros(room + 1), [0] * (room + 1)
    for c in range(1, room + 1):
        k = min(c, top)
        sums = best[c - k : c] + back[top - k :]
        i = int(sums.argmax())
        best[c], choice[c] = sums[i], k - i
    slot = {int(s): i for i, s in enumerate(sizes)}

    def counted(first: int | None) -> np.ndarray:
        counts, c = np.zeros(len(sizes), dtype=np.int64), room
        if first is not None:
            counts[first] += 1
            c -= int(sizes[first])
        while c > 0:
            if choice[c] in slot:
                counts[slot[choice[c]]] += 1
            c -= choice[c]
        return counts

    out = [counted(None)]
    if most > 1:
        with_item = np.maximum(values, 0) + best[room - sizes]
        out += [counted(i) for i in np.argsort(-with_item, kind="stable")[: most - 1].tolist()]
    return float(best[room]), out


def piece_lengths(n: int, max_tokens: int) -> list[int]:
    """The pieces of ``n`` tokens: full sequences, a multiple of the grain, the last."""
    grain = max(1, max_tokens // 32)
    least = grain // 2 + 1
    out, rest = [max_tokens] * (n // max_tokens), n % max_tokens
    if rest >= least + grain:
        out.append((rest - least) // grain * grain)
        rest -= out[-1]
    return [*out, rest] if rest else out


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value and its counts."""
    value, patterns = priced(values, sizes, room)
    return value, patterns[0]


def fullest(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """One sequence from the pieces left: the largest of them, and beside it the subset with the greatest sum that fits."""
    counts = np.zeros(len(sizes), dtype=np.int64)
    here = np.flatnonzero(left > 0)
    big = int(here[np.argmax(sizes[here])])
    counts[big] = 1
    space = room - int(sizes[big])
    full = (1 << (space + 1)) - 1
    seen, steps = 1, []  # bit s: some pieces sum to s
    for i in here[::-1].tolist():
        if seen >> space & 1:
            break
        size = int(sizes[i])
        for _ in range(min(int(left[i]) - int(counts[i]), space // size)):
            new = (seen | seen << size) & full
            if new == seen:
                break
            steps.append((i, size, seen))
            seen = new
    total = seen.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> total & 1:
            counts[i] += 1
            total -= size
    return counts


#: Patterns taken from one pricing; pivots between fresh inverses of the basis.
PRICED, PIVOTS = 40, 64
#: How far duals are pulled towards the best bound's; the relative gap at which the program counts as solved.
PULL, GAP = 0.9, 1e-6


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts by size) and how often each is used, from the linear program that covers the demand exactly.

    It begins with patterns of one size each. Every round prices patterns by the
    knapsack and pivots on those that improve. They are priced from duals pulled
    towards those of the best bound so far, at first each size's share of ``room``,
    which spares most of the rounds; where these find nothing, from the duals
    themselves. It ends when no pattern improves the program, or when the bound (duals'
    total over the knapsack's value) proves that no further pattern can save one
    sequence, or GAP of all. The demand is raised by tiny unequal
    amounts so that no pivot is degenerate. A basis that is singular, or a total below the
    bound, raises ArithmeticError: it would be no solution.
    """
    m = len(sizes)
    each = room // sizes
    basis, inverse = np.diag(each.astype(float)), np.diag(1.0 / each)
    wanted = demand + 1e-7 * (1 + np.arange(m) / m)
    bound, centre, pull, since = float(sizes @ demand) / room, sizes / room, PULL, 0
    while True:
        duals = inverse.sum(axis=0)
        total = float(duals @ wanted)
        if total - bound < max(1.0, GAP * bound):
            break
        mixed = pull * centre + (1 - pull) * duals
        value, patterns = priced(mixed, sizes, room, PRICED)
        now = float(mixed @ demand) / max(value, 1.0)
        if now > bound:
            bound, centre = now, mixed / max(value, 1.0)
        if pull == 0 and value <= 1 + 1e-9:
            break
        improved = False
        for counts in patterns:
            if inverse.sum(axis=0) @ counts <= 1 + 1e-9:
                continue
            used, step = inverse @ wanted, inverse @ counts
            able = step > 1e-9
            ratio = np.where(able, np.maximum(used, 0) / np.where(able, step, 1), np.inf)
            least = ratio.min()
            leave = int(np.argmax(np.where(ratio <= least * (1 + 1e-9) + 1e-12, step, -1)))  # of equals the safest pivot
            basis[:, leave], improved, since = counts, True, since + 1
            if since % PIVOTS == 0:
                inverse = _inverse(basis)
            else:
                row = inverse[leave] / step[leave]
                inverse -= np.outer(step, row)
                inverse[leave] = row
        pull = PULL if improved else 0 if pull < 0.1 else pull / 2
    used = _inverse(basis) @ demand
    if used.sum() < bound * (1 - 1e-6) - 1e-6 or used.min() < -1e-3 * (1 + used.max()):
        raise ArithmeticError("the linear program lost its numbers")
    return [(basis[:, j].astype(np.int64), float(used[j])) for j in range(m)]


def _inverse(basis: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.inv(basis)
    except np.linalg.LinAlgError as wrong:
        raise ArithmeticError("singular basis") from wrong
    if not np.isfinite(out).all():
        raise ArithmeticError("singular basis")
    return out


def fill_rest(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Sequences for the few pieces that rounding leaves."""
    left, out = left.copy(), []
    while left.any():
        out.append(fullest(sizes, left, room))
        left -= out[-1]
    return out


def plan(histogram: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """Runs of places: for each length, ranks from ``first`` on take sequence ``sequence + k // each`` at ``offset + k % each * length``."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    runs, next_rank, next_sequence = [], np.zeros(len(sizes), dtype=np.int64), 0

    def use(counts: np.ndarray, times: int) -> None:
        nonlocal next_sequence
        at = 0
        for i in np.flatnonzero(counts)[::-1].tolist():
            runs.append((int(sizes[i]), int(next_rank[i]), int(counts[i]), next_sequence, at))
            next_rank[i] += times * counts[i]
            at += int(counts[i] * sizes[i])
        next_sequence += times

    left = demand.copy()
    for counts, times in column_generation(sizes, demand, room) if len(sizes) else []:
        whole = int(times + 1e-6)
        if counts.any():
            whole = min([whole, *(left[counts > 0] // counts[counts > 0]).tolist()])
        if whole > 0 and counts.any():
            use(counts, whole)
            left -= whole * counts
    for counts in fill_rest(sizes, left, room):
        use(counts, 1)
    names = ("length", "first", "each", "sequence", "offset")
    table = {n: np.array([r[k] for r in runs], dtype=np.int64) for k, n in enumerate(names)}
    order = np.lexsort((table["first"], table["length"]))
    return {n: v[order] for n, v in table.items()}


#: Rows (length, part) up to which the numbers at which parts begin are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_STARTS = 500_000


def assign(pieces: DataFrame, max_tokens: int = 1024, narrowed: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces (length, part, nth, ...), which are read more than once: pass a stored table.

    The rank of a piece among those of its length is its number in its part after all
    pieces of the parts before, which counts by (length, part) give: no piece moves for it.
    No pieces: no rows. ``narrowed``: ids were stored by ``narrow`` and come back whole.
    """
    spark = pieces.sparkSession
    counts = checkpointed(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    shared = spark.sparkContext.broadcast(plan(histogram, max_tokens))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    few = counts.count() <= BROADCAST_STARTS
    ranked = pieces.join(F.broadcast(starts) if few else starts, ["length", "part"]).withColumn("_rank", F.col("_from") + F.col("nth"))
    ranked = ranked.select(*(c for c in pieces.columns if c not in ("part", "nth")), "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("_rank"))
            i = np.zeros(0, dtype=np.int64)
            if len(length):
                low, high = np.searchsorted(p["length"], length), np.searchsorted(p["length"], length, side="right")
                i = np.empty(len(length), dtype=np.int64)
                for n in np.unique(length).tolist():
                    mine = length == n
                    a, z = int(low[mine][0]), int(high[mine][0])
                    i[mine] = a + np.searchsorted(p["first"][a:z], rank[mine], side="right") - 1
            k = rank - p["first"][i]
            kept = [n for n in b.schema.names if n != "_rank"]
            if narrowed:
                whole = [widen(x, n) for x, n in zip(b.column("ids").to_pylist(), length.tolist())]
                b = b.set_column(b.schema.get_field_index("ids"), "ids", pa.array(whole, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(p["sequence"][i] + k // p["each"][i]), pa.array(p["offset"][i] + k % p["each"][i] * length)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, fields + ", sequence_id long, offset long")


def narrow(ids: bytes, length: int) -> bytes:
    """u32 ids as u16 where all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return ids if length and wide.max() > 0xFFFF else wide.astype("<u2").tobytes()


def widen(ids: bytes, length: int) -> bytes:
    """What ``narrow`` was given."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def pack_documents(docs: DataFrame, tokenizer: str, vocabulary: str, pattern: str, max_tokens: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids and places: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Sequences hold at most ``max_tokens`` ids; offsets within
    one are gapless from 0; each id of a document lies in exactly one piece.
    Nulls, empty texts, repeated rows: see ``cut_documents``; an empty table gives no rows.
    """
    pieces = cut_documents(docs, tokenizer, vocabulary, pattern, max_tokens, end_id, id_col, text_col, narrowed=True)
    return assign(checkpointed(pieces), max_tokens, narrowed=True)  # stored and shuffled in half the bytes
