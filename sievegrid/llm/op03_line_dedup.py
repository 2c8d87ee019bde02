"""Line deduplication through deletion neighbourhoods.

Two lines are near when their edit distance in characters is at most one. A line
is dropped when the same line or a near one stands earlier, by (doc_id, line
number); the earliest stays. Deleting the edited character from both lines of a
near pair gives one string, at one position: lines of equal length that share a
variant and its position are all near each other, and a line that equals another
line's variant is near that line. So all variants are dealt out once, by their
hash, and the earliest line of each is found among those that share it, without
pairs; only (line, earlier line) is verified. Lines that share a variant differ
in one character, so their number is bounded by the alphabet and their length,
not by the corpus.

Emitting all variants of all lines would multiply the corpus by its line length.
One edit leaves the first or the second half of a line as it was, so variants
are emitted only of distinct lines whose half, with the length it belongs to,
occurs in another distinct line, and only of the places in the other half; no
near line is missed by that.

Lines are cut at \\n and stripped of blanks, tabs and carriage returns. Lines of
`exact` characters or more are dropped after the same line, those of `least` or
more after a near one too; `exact` is `least` unless given, 1 in the query (short lines that differ in a character, as numbers and
brackets do, say different things); blank lines always stay.
Cases: null and empty texts have no lines to drop and come back as they are;
rows with a null doc_id come back as they are and take no part; rows that repeat a
doc_id with another text are documents of their own, whose lines of one number
are ordered by their texts' hashes; rows that repeat doc_id and text stand in one
place and lose the same lines; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, held, key_bitmap, lean, materialize, sifted
from .op04_bpe import slices

#: Odd multiplier of the rolling hash, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STRIP = " \t\r"
BATCH = 250


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of substrings of many lines at once, as polynomials over mixed code points."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.up, self.down = _powers(len(points), BASE), _powers(len(points), INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(points + np.uint64(1)) * self.up[:-1], dtype=np.uint64)])

    def part(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of code points i to j of the joined lines, wherever they stand."""
        return (self.sums[j] - self.sums[i]) * self.down[i]

    def whole(self) -> np.ndarray:
        return _mix(self.part(self.start, self.end) + self.size.astype(np.uint64))

    def halves(self) -> np.ndarray:
        """Four keys a line: first and last half, for pairs in which it is the shorter (or as long) and the longer."""
        out = []
        for size in (self.size, self.size - 1):
            half = size // 2
            tag = _mix(size.astype(np.uint64))
            out.append(_mix(self.part(self.start, self.start + half) + tag))
            out.append(_mix(self.part(self.end - (size - half), self.end) + ~tag))
        return np.stack(out, axis=1)

    def variants(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, position, hash of the line without the character there), for the places where a near line may differ.

        kinds: bits of the halves, in the order of `halves`, that stand in other lines.
        """
        low, high = np.zeros(len(kinds), np.int64), self.size.copy()
        for bit, half in ((1, self.size // 2), (4, (self.size - 1) // 2)):
            high = np.where(kinds & bit, np.minimum(high, half), high)
            low = np.where(kinds & (2 * bit), np.maximum(low, half + (bit == 4)), low)
        line = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(line))
        place = at - self.start[line]
        open_ = (place < low[line]) | (place >= high[line])
        line, at = line[open_], at[open_]
        s, e = self.start[line], self.end[line]
        rest = (self.sums[at] - self.sums[s]) + (self.sums[e] - self.sums[at + 1]) * np.uint64(INVERSE)
        return line, at - s, _mix(rest * self.down[s] + (self.size[line] - 1).astype(np.uint64))


def cut(text: str | None, least: int) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that take part."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if len(s := x.strip(STRIP)) >= least]


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, tid, text) of rows with an id; tid is the text's hash."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))


def _lines(docs: DataFrame, exact: int, least: int) -> DataFrame:
    """(doc_id, tid, no, k, k2, halves): one row per line that takes part; halves of those of `least` characters."""

    def run(batches):
        import xxhash

        held("lines", None, dict)
        for whole in batches:
            for b in slices(whole, BATCH):
                row, nos, lines = [], [], []
                for i, x in enumerate(b.column(2).to_pylist()):
                    for no, s in cut(x, exact):
                        row.append(i)
                        nos.append(no)
                        lines.append(s)
                if not lines:
                    continue
                r, pick = Rolling(lines), pa.array(row, pa.int64())
                second = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) for s in lines]
                long = r.size >= least
                halves = pa.ListArray.from_arrays(pa.array(np.append(0, 4 * np.cumsum(long)).astype(np.int32), mask=np.append(~long, False)), pa.array(r.halves()[long].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(nos, pa.int32()), pa.array(r.whole().view(np.int64)), pa.array(second, pa.int64()), halves],
                    ["doc_id", "tid", "no", "k", "k2", "halves"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, tid long, no int, k long, k2 long, halves array<long>")


def _survivors(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, kinds, doc_id, tid, no, line): the text of picked lines (id, kinds, doc_id, tid, no), at their earliest place."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, BATCH):
                out = [], [], [], []
                for i, (x, take) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    lines = (x or "").split("\n")
                    for t in take:
                        for into, v in zip(out, (i, t["id"], t["kinds"], t["no"]), strict=True):
                            into.append(v)
                        out[-1][-1] = (t["no"], lines[t["no"]].strip(STRIP))
                pick = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), b.column(0).take(pick), b.column(1).take(pick), pa.array([n for n, _ in out[3]], pa.int32()), pa.array([x for _, x in out[3]], pa.string())],
                    ["id", "kinds", "doc_id", "tid", "no", "line"],
                )

    takes = materialize(picked.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("id", "kinds", "no")).alias("take")), "lines-picked")
    rows = sifted(docs, "tid", key_bitmap(takes, "tid")).join(takes, ["doc_id", "tid"]).select("doc_id", "tid", "text", "take")
    return rows.mapInArrow(lean(run), "id long, kinds int, doc_id long, tid long, no int, line string").dropDuplicates(["id"])


def _variants(lines: DataFrame) -> DataFrame:
    """(v, at, id, doc_id, tid, no): at -1 with the line's own hash, else its variants."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, BATCH):
                r = Rolling(b.column(5).to_pylist())
                line, at, v = r.variants(b.column(1).to_numpy(zero_copy_only=False))
                line = np.concatenate([np.arange(len(r.size)), line])
                at = np.concatenate([np.full(len(r.size), -1), at])
                v = np.concatenate([r.whole(), v])
                for i in range(0, len(v), 200_000):
                    pick = pa.array(line[i : i + 200_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[i : i + 200_000].view(np.int64)), pa.array(at[i : i + 200_000].astype(np.int32)), *(b.column(c).take(pick) for c in (0, 2, 3, 4))],
                        ["v", "at", "id", "doc_id", "tid", "no"],
                    )

    return lines.mapInArrow(lean(run), "v long, at int, id long, doc_id long, tid long, no int")


def _earliest(variants: DataFrame) -> DataFrame:
    """(id, other): the earliest line that shares a variant, at one place or with a whole line, if it is earlier than id."""
    place = F.struct("doc_id", "no", "tid", "id")
    alike, there = Window.partitionBy("v"), Window.partitionBy("v", "at")
    rows = variants.withColumns({"m": F.count("*").over(alike), "own": F.min(F.when(F.col("at") < 0, place)).over(alike), "longer": F.min(F.when(F.col("at") >= 0, place)).over(alike)}).where("m > 1")
    rows = rows.withColumn("same", F.min(place).over(there))
    rows = rows.withColumn("e", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.least("own", "same"))).where(F.col("e") < place)
    return rows.groupBy("id").agg(F.min("e").alias("e")).select("id", F.col("e.id").alias("other"))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (id, other) whose lines are within one edit."""

    def run(batches):
        for b in batches:
            ok = [within_one_edit(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["id", "other"]).filter(pa.array(ok, pa.bool_()))

    return (
        pairs.join(lines.select("id", F.col("line").alias("x")), "id").join(lines.select(F.col("id").alias("other"), F.col("line").alias("y")), "other")
        .select("id", "other", "x", "y").mapInArrow(lean(run), "id long, other long")
    )


def duplicate_lines(docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """(doc_id, tid, drop array<int>): numbers of the lines that an earlier same or near line makes superfluous."""
    docs = _numbered(docs, key, text)
    lines = materialize(_lines(docs, max(1, min(least, least if exact is None else exact)), least), "lines")
    place = F.struct("doc_id", "no", "tid")
    distinct = lines.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = materialize(distinct.select(F.xxhash64("k", "k2").alias("id"), "k", "k2", "first.*", "n", "halves"), "lines-distinct")
    # Halves 0 and 1 are of a line as the shorter of a pair, 2 and 3 as the longer.
    halves = distinct.where("halves is not null").select("id", F.posexplode("halves").alias("kind", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("m"), F.min("kind").alias("kind")).where("m > 1 and kind < 2").select("half")
    picked = halves.join(shared, "half").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    picked = distinct.select("id", "doc_id", "tid", "no").join(picked, "id")
    texts = materialize(_survivors(docs, picked), "lines-texts")
    near = materialize(_earliest(_variants(texts)), "lines-near")
    near = _verified(near, texts).select("id", "other").join(distinct.select(F.col("id").alias("other"), F.struct("doc_id", "no", "tid").alias("e")), "other").select("id", "e")
    # The place before which nothing like it stands: of the line itself, or of an earlier near one.
    until = distinct.join(near, "id", "left").select("k", "k2", "n", place.alias("p"), F.least(place, "e").alias("until")).where("n > 1 or until < p").select("k", "k2", "until")
    dropped = lines.select("k", "k2", "doc_id", "tid", "no").join(until, ["k", "k2"]).where(F.col("until") < place)
    found = materialize(dropped.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("no")).alias("drop")), "lines-dropped")
    discard(lines, distinct, texts)
    return found


def dedup_lines(docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", exact: int | None = None) -> DataFrame:
    """docs with duplicate lines taken out of text, and two more columns: lines before, and dropped.

    The two take their names from the arguments; columns of docs with these
    names are replaced.
    """
    side = duplicate_lines(docs, least, key, text, exact).select(F.col("doc_id").alias("__line_doc"), F.col("tid").alias("__line_tid"), F.col("drop").alias("__line_drop"))
    kept = docs.join(side, (F.col(key).cast("long") == F.col("__line_doc")) & (F.xxhash64(text) == F.col("__line_tid")), "left")
    parts = F.split(F.col(text), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__line_drop")
    rest = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    return kept.withColumns(
        {
            n_lines: F.when(F.length(text) > 0, F.size(parts)).otherwise(0).cast("long"),
            n_dropped: F.coalesce(F.size("__line_drop"), F.lit(0)).cast("long"),
            text: F.when(F.col("__line_drop").isNull(), F.col(text)).otherwise(rest),
        }
    ).drop("__line_doc", "__line_tid", "__line_drop")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents"), exact=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH line AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS no, string_split(text, chr(10))[i] AS raw
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), cut AS (
  SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS s FROM line
), d AS (
  SELECT s, min({'d': doc_id, 'n': no}) AS first, length(s) AS size FROM cut WHERE length(s) >= 1 GROUP BY s
), f AS (
  SELECT * FROM d WHERE size >= 20
), pair AS (
  SELECT a.s, b.first FROM f a JOIN f b ON a.size = b.size AND left(a.s, a.size // 2) = left(b.s, a.size // 2) AND a.s <> b.s AND levenshtein(a.s, b.s) <= 1
  UNION ALL SELECT a.s, b.first FROM f a JOIN f b ON a.size = b.size AND substr(a.s, a.size // 2 + 1) = substr(b.s, a.size // 2 + 1) AND a.s <> b.s AND levenshtein(a.s, b.s) <= 1
  UNION ALL SELECT unnest([a.s, b.s]), unnest([b.first, a.first]) FROM f a JOIN f b ON a.size + 1 = b.size AND left(a.s, a.size // 2) = left(b.s, a.size // 2) AND levenshtein(a.s, b.s) <= 1
  UNION ALL SELECT unnest([a.s, b.s]), unnest([b.first, a.first]) FROM f a JOIN f b ON a.size + 1 = b.size AND substr(a.s, a.size // 2 + 1) = substr(b.s, a.size // 2 + 2) AND levenshtein(a.s, b.s) <= 1
), until AS (
  SELECT s, min(first) AS u FROM (SELECT s, first FROM d UNION ALL SELECT s, first FROM pair) GROUP BY s
), kept AS (
  SELECT c.doc_id, c.no, c.raw, coalesce(u.u < {'d': c.doc_id, 'n': c.no}, false) AS gone FROM cut c LEFT JOIN until u ON u.s = c.s
), joined AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS t FROM kept GROUP BY doc_id
)
SELECT o.doc_id, CAST(CASE WHEN length(o.text) > 0 THEN n ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_dropped,
  CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256
FROM documents o LEFT JOIN joined j USING (doc_id)
"""
