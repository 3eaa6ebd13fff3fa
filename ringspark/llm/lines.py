"""Line dedup by content-defined chunks of lines, completed by windows of two lines.

1. Chunks.  A text's lines are hashed; a rolling hash over the hashes of two neighbouring
   lines decides where a chunk ends (every second place on average), so an insertion shifts the
   boundaries near it only.  Chunks have 2 to 64 lines; a last line left alone joins the
   chunk before it, and a text of one line has no chunk.  Chunks whose 128-bit BLAKE2b digest
   occurs once are done with after a count; the bytes of the others are compared, and of
   those that are equal the one in the document with the smallest id (then text hash, then
   place) stays and the rest are repeats.
2. Completion.  A chunk's end depends on the lines about it, so a passage of few lines may
   lie across chunks in one document and within one in another.  Every two neighbouring lines
   that aren't both in one repeat found so far are a window; those whose digest occurs more than
   once are compared by their bytes in the same way: of the windows that are equal over all
   documents the first (in the same order) stays and the rest are repeats.  What the chunks have
   found is left out before: the first window of its kind is never in a repeated chunk, as the
   chunk that stays has it too.

Runs of lines that repeats cover are cut out whole, wherever they lie and whatever is before
and after them: of a passage of two or more lines no later copy stays.  The first occurrence of
a line is never in a repeat, so every line that is not blank stays somewhere.  A single line
between lines of the document's own is in no repeat and stays, however often it occurs.

Rows that repeat an id and a text are one document, returned as often as they occur
and all alike; of several texts with one id each is a document.  Null stays null, empty texts
stay empty, an empty table gives an empty result.  A window without a character other than
white space repeats nothing, but blank lines between two repeats go with them.  Counts are
pre-aggregated; a chunk or window that many documents share meets its kept copy in a join
that the engine may split, and no group is gathered but the repeats of one document.  A
caller's column with the result's name is kept under the next free name (``lines_1``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, make_room, own_prefix

LEAST, MOST = 2, 64
M = (1 << 64) - 1


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk."""
    if len(lines) < LEAST:
        return []
    out, start, before = [], 0, 0
    for k, line in enumerate(lines):
        now = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (before * 0x9E3779B97F4A7C15 + now) & M
        rolled = ((rolled ^ rolled >> 29) * 0xBF58476D1CE4E5B9) & M
        before = now
        if k - start + 1 >= LEAST and (rolled >> 40 & 1 or k - start + 1 >= MOST):
            out.append((start, k - start + 1))
            start = k + 1
    rest = len(lines) - start
    if rest >= LEAST or rest and not out:
        out.append((start, rest))
    elif rest:
        out[-1] = (out[-1][0], out[-1][1] + rest)
    return out


def _digest(body: bytes) -> bytes:
    return blake2b(body, digest_size=16).digest()


def windows(text: str | None, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes, str]]:
    """First line, number of lines (2), digest and text of every two neighbouring lines that aren't blank; of those at ``wanted`` only, if given."""
    lines = (text or "").split("\n")
    filled = [bool(x) and not x.isspace() for x in lines]
    for k in range(len(lines) - 1):
        if (filled[k] or filled[k + 1]) and (wanted is None or k in wanted):
            body = lines[k] + "\n" + lines[k + 1]
            yield k, 2, _digest(body.encode("utf-8", "surrogatepass")), body


def parts(text: str | None, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes, str]]:
    """First line, number of lines, digest and text of every chunk that isn't blank; of those at ``wanted`` only, if given."""
    lines = (text or "").split("\n")
    for first, n in chunks(lines):
        if wanted is None or first in wanted:
            body = "\n".join(lines[first : first + n])
            if body and not body.isspace():
                yield first, n, _digest(body.encode("utf-8", "surrogatepass")), body


def repeats(lines: list[str], starts: list[int]) -> list[tuple[int, int]]:
    """(first line, number of lines) of the runs that the repeated windows at ``starts`` cover, blank lines between them included."""
    out: list[list[int]] = []
    for k in sorted(starts):
        if out and (k <= out[-1][1] or not any(x and not x.isspace() for x in lines[out[-1][1] : k])):
            out[-1][1] = k + 2
        else:
            out.append([k, k + 2])
    return [(a, b - a) for a, b in out]


def _rows(batch: pa.RecordBatch, found: list[tuple]) -> list[pa.Array]:
    """id, h, line, n, hash, more of (row, line, n, digest, ...)."""
    rows = pa.array([x[0] for x in found], pa.int64())
    halves = np.frombuffer(b"".join(x[3] for x in found), np.int64).reshape(-1, 2)
    return [batch["id"].take(rows), batch["h"].take(rows), *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]


NAMES = ["id", "h", "line", "n", "hash", "more"]


def _repeated(slim: DataFrame, places: DataFrame, pieces: Callable, scratch: Scratch, name: str) -> DataFrame:
    """id, h, line, n of the pieces (chunks or windows) at ``places`` that are byte for byte like an earlier one there. slim: id, h, text."""
    twice = places.groupBy("hash", "more").agg(F.count("*").alias("times")).where("times > 1").select("hash", "more")
    chosen = places.join(twice, ["hash", "more"], "left_semi").groupBy("id", "h").agg(F.collect_set("line").alias("chosen"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, (text, lines) in enumerate(zip(batch["text"].to_pylist(), batch["chosen"].to_pylist(), strict=True)):
                found += [(row, *piece) for piece in pieces(text, set(lines))]
            yield pa.RecordBatch.from_arrays([*_rows(batch, found), pa.array([x[4] for x in found], pa.string())], [*NAMES, "body"])

    chosen = scratch.save(chosen, "chosen")
    same = slim["id"].eqNullSafe(chosen["id"]) & (slim["h"] == chosen["h"])
    # A merge join at every size: texts move once whatever the other side's size.
    texts = slim.join(chosen.hint("merge"), same).select(slim["id"], slim["h"], "text", "chosen")
    schema = f"id {slim.schema['id'].dataType.simpleString()}, h long, line int, n int, hash long, more long, body string"
    found = scratch.save(texts.mapInArrow(bodies, schema), "bodies")
    place = F.struct("id", "h", "line")
    kept = found.groupBy("hash", "more", "body").agg(F.min(place).alias("keep"), F.count("*").alias("times")).where("times > 1")
    out = scratch.save(found.join(kept, ["hash", "more", "body"]).where(~place.eqNullSafe(F.col("keep"))).select("id", "h", "line", "n").distinct(), name)
    scratch.drop("chosen")
    scratch.drop("bodies")
    return out


def repeated_chunks(slim: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """id, h, line, n of the chunks that are byte for byte like an earlier one. slim: id, h, text; places: all chunks."""
    return _repeated(slim, places, parts, scratch, "chunks")


def repeated_windows(slim: DataFrame, places: DataFrame, covered: DataFrame, scratch: Scratch) -> DataFrame:
    """id, h, line of the windows without those covered (id, h, line) that are byte for byte like an earlier one of these. places: all windows."""
    there = covered.select(F.col("id").alias("__i"), F.col("h").alias("__h"), F.col("line").alias("__l"))
    same = places["id"].eqNullSafe(there["__i"]) & (places["h"] == there["__h"]) & (places["line"] == there["__l"])
    # Written, as it is read twice; a merge join, like that of the texts.
    outside = scratch.save(places.join(there.hint("merge"), same, "left_anti"), "outside")
    out = _repeated(slim, outside, windows, scratch, "windows").select("id", "h", "line")
    scratch.drop("outside")
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "lines") -> DataFrame:
    """docs with repeated runs of lines cut out of the text, and a struct column: n_lines, n_removed (lines), n_chunks (runs removed)."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = make_room(docs, out)
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("text is not null")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in enumerate(batch["text"].to_pylist()):
                found += [(row, first, n, digest) for first, n, digest, _ in parts(text)]
                found += [(row, k, 0, digest) for k, _, digest, _ in windows(text)]
            yield pa.RecordBatch.from_arrays(_rows(batch, found), NAMES)

    places = scratch.save(slim.mapInArrow(placed, f"id {id_type}, h long, line int, n int, hash long, more long"), "places")
    first = repeated_chunks(slim, places.where("n > 0"), scratch)
    covered = first.select("id", "h", F.explode(F.sequence("line", F.col("line") + F.col("n") - 2)).alias("line"))
    # A blank window within a chunk is no window: it would take blank lines along that no repeat stands beside.
    cut = covered.union(repeated_windows(slim, places.where("n = 0"), covered, scratch))
    cut = scratch.save(cut.groupBy("id", "h").agg(F.collect_set("line").alias("lines")), "cut")

    @F.pandas_udf("text string, n_lines long, n_removed long, n_chunks long")
    def rebuilt(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, cuts, strict=True):
            if text is None:
                rows.append((None, 0, 0, 0))
            elif gone is None:
                rows.append((text, text.count("\n") + 1, 0, 0))
            else:
                lines = text.split("\n")
                filled = [bool(x) and not x.isspace() for x in lines]
                keep = np.ones(len(lines), bool)
                runs = repeats(lines, [k for k in gone if filled[k] or filled[k + 1]])
                for a, n in runs:
                    keep[a : a + n] = False
                rows.append(("\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int((~keep).sum()), len(runs)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "n_chunks"])

    p = own_prefix(docs)
    left = docs.withColumn(p + "h", F.xxhash64(text_col))
    cut = cut.select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h2"), F.col("lines").alias(p + "cut"))
    joined = left.join(cut.hint("merge"), F.col(id_col).eqNullSafe(F.col(p + "id")) & (F.col(p + "h") == F.col(p + "h2")), "left")
    joined = joined.withColumn(p + "new", rebuilt(F.col(text_col), F.col(p + "cut")))
    columns = [F.col(f"{p}new.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.struct(*[f"{p}new.{n}" for n in ("n_lines", "n_removed", "n_chunks")]).alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "lines.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; documents of which nothing is left go."""
    own = own_prefix(docs) + "lines"
    out = dedup(docs, out=own)
    return out.where(F.expr(f"text is null or {own}.n_removed < {own}.n_lines")).drop(own)


ORACLE = r"""
with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
x as (select doc_id, l, len(l) as n, unnest(range(1, len(l) + 1)) as k from d),
y as (select doc_id, k, n, l[k] as line, regexp_matches(l[k], '[^\s\p{Z}]') as filled, case when k < n then l[k] || chr(10) || l[k + 1] end as w,
  k < n and regexp_matches(l[k] || coalesce(l[k + 1], ''), '[^\s\p{Z}]') as pair from x),
r as (select doc_id, k, row_number() over (partition by w order by doc_id, k) > 1 as again from y where pair),
c as (select y.*, coalesce(a.again, false) or coalesce(b.again, false) as covered
  from y left join r a on a.doc_id = y.doc_id and a.k = y.k left join r b on b.doc_id = y.doc_id and b.k = y.k - 1),
g as (select *, case when filled or covered then covered end as solid from c),
h as (select *, covered or (not filled
  and coalesce(last_value(solid ignore nulls) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), false)
  and coalesce(first_value(solid ignore nulls) over (partition by doc_id order by k rows between 1 following and unbounded following), false)) as gone from g),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as begins from h)
select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as text, any_value(n)::bigint as n_lines,
  count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_chunks from e group by doc_id
union all select doc_id, null, 0::bigint, 0::bigint, 0::bigint from documents where text is null
"""
