"""Best-fit packing, repacked under certified bounds.

Tokens: the ids of the byte-level BPE in a tokenizers file, then one separator id.  A
document longer than a sequence is cut into whole sequences, the remainder coming first;
only ids of pieces, never tokens, are carried on.

Packing: pieces are dealt by hash to parts of ``part_rows`` on average; each part is
packed by best-fit decreasing and its number of sequences is held against dual-feasible
lower bounds (the threshold functions of Martello and Toth, the step functions of Fekete
and Schepers, both on the histogram of lengths).  A part that meets its bound is certified
and done.  The pieces of the emptiest sequences of the other parts, with twice the room
that the gap asks for, are exchanged: pooled, dealt anew to fewer parts and packed again,
by best-fit decreasing.  A round counts only if it needs fewer sequences; when it doesn't, or no
gap is left, the rounds end.  What still misses its bound then is packed once more by filling
sequence after sequence exactly where one or two pieces can, which stays only if it needs fewer
sequences than best-fit decreasing did.  Every round is a table in the shared folder; only
counts reach the driver, and the sequences and the bound are logged.

Speed: ``tiktoken`` computes the same ids from the ranks file of the same vocabulary, four
times as fast, for texts of Latin letters; other texts, and those with over 50,000 blanks in a
row, for which its pattern runs out of stack, go through ``tokenizers`` itself, and without a
ranks file all do.

Defined results: null and empty texts are a piece of the separator alone; repeated rows
are packed as often as they occur; pieces of equal length come in the order of id, piece and
digest; an empty table gives an empty result.  The results have columns of their own, so the
caller's can't clash with them.
"""

from __future__ import annotations

import base64
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

FILE, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ſ–—‘-”…€]")
BLANKS = 50_000
_BLANK = re.compile("(?<![\t\n\r ])[\t\n\r ]{%d}" % BLANKS)
_loaded: dict = {}


def _exact(path: str | None):
    if ("exact", path) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path or public_tokenizers.path(FILE))
        exact.encode_special_tokens = True
        _loaded["exact", path] = exact
    return _loaded["exact", path]


def _quick(ranks: str | None):
    if ("quick", ranks) not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded["quick", ranks] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded["quick", ranks]


def encode(texts: list[str | None], path: str | None = None, ranks: str | None = None) -> Iterator[np.ndarray]:
    """uint32 ids of each text. An engine is loaded when a text asks for it."""
    for text in texts:
        if not text:
            yield np.zeros(0, np.uint32)
        elif (path is None or ranks is not None) and not _OTHER.search(text) and not (len(text) > BLANKS and _BLANK.search(text)):
            yield np.array(_quick(ranks).encode_ordinary(text), np.uint32)
        else:
            yield np.array(_exact(path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % length
    starts = ([0] if first else []) + list(range(first, n, length))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, length: int = 2048, separator: int = 0, path: str | None = None, ranks: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, kept = [], [], []
            for k, ids in enumerate(encode(batch["text"].to_pylist(), path, ranks)):
                whole = np.append(ids, np.uint32(separator)).astype("<u4")
                for p, (start, n) in enumerate(cut(len(whole), length)):
                    part = whole[start : start + n]
                    rows.append(k)
                    out.append((p, start, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch["id"].take(pa.array(rows, pa.int64())), pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[j] for x in out], pa.int64()) for j in (1, 2, 3))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cutting, schema)


def bound(counts: np.ndarray) -> int:
    """A lower bound of the bins that hold counts[s] items of size s, the bin holding len(counts) - 1."""
    c = len(counts) - 1
    size = np.arange(c + 1)
    n_below, sum_below = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(sum_below[-1]) // c)
    e = np.arange(1, c // 2 + 1)  # items over c - e count whole, those under e not at all
    large = n_below[-1] - n_below[c - e]
    middle = sum_below[c - e] - sum_below[e - 1]
    best = max(best, int((large + -(-middle // c)).max()))
    for k in range(1, 21):  # whole (k+1)ths stay as they are, the rest is rounded down to kths
        exact = (k + 1) * size % c == 0
        total = int((counts[exact] * size[exact] * k).sum()) + c * int((counts[~exact] * ((k + 1) * size[~exact] // c)).sum())
        best = max(best, -(-total // (c * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of sizes in the order given: each one's bin and place, and the room left in each bin."""
    bins, places, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0  # bit r: some bin has room r
    for k, s in enumerate(sizes.tolist()):
        fits = bits >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                bits ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[k], places[k] = b, capacity - r
        room[b] = r - s
        if r > s:
            if not open_bins[r - s]:
                bits |= 1 << (r - s)
            open_bins[r - s].append(b)
    return bins, places, np.array(room, np.int64)


def complete_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit, sequence by sequence: the longest piece left, then one or two that fill the room exactly, else
    the longest that fits."""
    bins, places, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: dict[int, list[int]] = {}
    for k, s in enumerate(sizes.tolist()):
        stacks.setdefault(s, []).append(k)
    counts = np.bincount(sizes, minlength=capacity + 1)
    largest = capacity
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return bins, places, np.array(room, np.int64)
        left, take = capacity, [largest]
        while take:
            for s in take:
                k = stacks[s].pop()
                counts[s] -= 1
                bins[k], places[k] = len(room), capacity - left
                left -= s
            take = []
            if left and counts[left]:
                take = [left]
            elif left > 1:
                there = counts[: left + 1] > 0
                pairs = np.flatnonzero(there[1:left] & there[left - 1 : 0 : -1]) + 1
                if len(pairs) and (2 * pairs[-1] != left or counts[pairs[-1]] > 1):
                    take = [int(pairs[-1]), left - int(pairs[-1])]
                elif len(fits := np.flatnonzero(there)):
                    take = [int(fits[-1])]
        room.append(left)


def _pack(rows: DataFrame, parts: int, turn: int, length: int, packer=best_fit) -> DataFrame:
    """Deals rows to parts and packs each; adds sequence_id, offset, again (for the exchange), bins and bound of the part on one row of it."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        bins, places, room = packer(sizes, length)
        low = bound(np.bincount(sizes, minlength=length + 1))
        gap = len(room) - low
        again = np.zeros(len(room), bool)
        if gap > 0:
            order = np.argsort(-room, kind="stable")
            asked = np.cumsum(room[order]) < 2 * length * gap + length
            again[order[asked]] = True
            again &= room > 0
        first = np.zeros(len(pdf), bool)
        first[0] = True
        return pdf.assign(
            sequence_id=(turn << 56) + (int(pdf["part"].iloc[0]) << 28) + bins,
            offset=places,
            again=again[bins],
            bins=np.where(first, len(room), 0),
            bound=np.where(first, low, 0),
        )

    names = [f for f in rows.schema.fields if f.name in ("id", "piece", "start", "length", "ids_crc32")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    dealt = rows.select(*[f.name for f in names], F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(packed, schema + ", part long, sequence_id long, offset long, again boolean, bins long, bound long")


def pack(rows: DataFrame, length: int = 2048, part_rows: int = 100_000) -> DataFrame:
    """rows: pieces. Adds sequence_id and offset."""
    scratch = Scratch(rows.sparkSession, "packing")
    rows = scratch.save(rows, "pieces")
    n = rows.count()
    columns = [*rows.columns, "sequence_id", "offset"]
    if not n:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    now = scratch.save(_pack(rows, -(-n // part_rows), 0, length), "round0")
    done, turn = now.where("not again").select(*columns), 0
    total, least = now.agg(F.sum("bins"), F.sum("bound")).first()
    while True:
        left = now.where("again")
        n, was = left.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if not n:
            break
        turn += 1
        new = scratch.save(_pack(left, -(-n // part_rows), turn, length), f"round{turn}")
        fewer = was - new.agg(F.sum("bins")).first()[0]
        last = fewer <= 0
        if last:
            turn += 1
            new = scratch.save(_pack(left, -(-n // part_rows), turn, length, complete_fit), f"round{turn}")
            fewer = was - new.agg(F.sum("bins")).first()[0]
            if fewer <= 0:
                done = done.union(left.select(*columns))
                break
        total, now = total - fewer, new
        if last:
            done = done.union(now.select(*columns))
            break
        done = done.union(now.where("not again").select(*columns))
    logging.getLogger(__name__).info("%d sequences; at least %d by the bounds of the parts as first dealt", total, least)
    return done


def query(spark, sf_dir: str) -> DataFrame:
    return stage(spark, documents(spark, sf_dir), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = pack(pieces(docs.select("doc_id", "text")))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
