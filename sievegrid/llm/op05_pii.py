"""Personal data by fixed forms, and by bootstrapped contextual extraction.

The fixed forms (email, ip, card, phone) give the base spans. They, and a fixed
fifth (by a hash) of the tokens of forms that only credentials have (long hex
digests, keys with a known beginning), are the seeds; all other credentials are
to be found by what stands before them. Every seed and every other token that looks like an
identifier (six characters or more, with a digit) is an instance; the one, two
and three units (words or signs, a word among them) before it are its lexical
patterns, whatever blanks stand between. Spark scores the graph of patterns and instances in turns:
a pattern is as good as the share of its instances that are believed, or that the
seeds speak for (one seeded credential stands for five), an instance as good as
its patterns make it. A pattern is accepted if enough
different believed instances follow it, nearly all identifiers after it are
believed, and a fair share of all its occurrences in the corpus stands before an
identifier at all; so common words never are patterns. Identifiers after
accepted patterns that the fixed forms don't know are added, as kind `id`; a
credential's form alone, without an accepted pattern before it, adds nothing.

Cases: null text counts as empty and has no spans; spans count code points, end
exclusive; of one kind they don't overlap, of several they may; repeated rows
are searched each on its own, and their words count each time; null ids pass
through; an empty table gives no rows; the extraction reads key and text only,
masking passes other columns through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, lean, materialize, table
from .op04_bpe import slices

KINDS = ("email", "ip", "card", "phone", "id")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing run of digits fails from each of its digits, so a match may start at a run's first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SHAPE = re.compile(r"[\w@:/.+-]{6,}")
_UNIT = re.compile(r"\w+|[^\w\s]")
_WORDY = re.compile(r"\w")
#: Forms of credentials: hex digests of 128, 160 and 256 bits, and keys with a known beginning. Fixed values.
_CREDENTIAL = re.compile(r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}|xox[abp]-[0-9A-Za-z-]{20,}")
#: One of so many credentials is a seed, by its hash, and speaks for all of them; different instances that seeds must be.
PART, SEEDS = 5, 2
#: Units of the longest pattern.
UNITS = 3
_DIGIT = re.compile("[0-9]")
#: Turns of scoring; different believed instances, and shares, that a pattern needs; patterns whose occurrences are counted at once.
TURNS, SUPPORT, PURITY, SHARE, PATTERNS = 3, 4, 0.75, 0.25, 50_000
#: Accepted patterns that are sent to all tasks at once; more are applied in further parts.
ACCEPTED = 20_000
#: Column of the starts of identifiers that earlier parts found.
STARTS = "__pii_starts"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind as a place in KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(units: list[str]) -> str:
    """Units as one text: a blank before each word but the first, none before signs."""
    return "".join(f" {u}" if _WORDY.match(u) else u for u in units).lstrip()


def _before(text: str, at: int) -> list[str]:
    """The patterns of what starts at `at`: the unit, and the two and three units, before it; signs alone are none."""
    width = 60
    while True:
        from_ = max(0, at - width)
        units = _UNIT.findall(text[from_:at].lower())
        # The first unit may be the end of a longer one.
        if from_ == 0 or len(units) > UNITS:
            break
        width *= 4
    units = units[-UNITS:]
    found = [_joined(units[-k:]) for k in range(1, len(units) + 1)]
    return [p for p in found if _WORDY.search(p)]


def others(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that touch no base span."""
    out, i = [], 0
    for m in _SHAPE.finditer(text):
        token = m[0].rstrip(".:/+-@")
        end = m.start() + len(token)
        if len(token) < 6 or not _DIGIT.search(token):
            continue
        while i < len(base) and base[i][2] <= m.start() and base[i][0] < m.start():
            i += 1
        if all(e <= m.start() or s >= end for s, _, e in base[max(0, i - 4) : i + 8]):
            out.append((m.start(), end))
    return out


def spans_of(text: str, patterns: frozenset[str] | set[str], starts: frozenset[int] | set[int] = frozenset()) -> tuple[list, list]:
    """(base spans, all spans), each (start, kind, end), sorted; identifiers at starts count as found."""
    base = base_spans(text)
    if not patterns and not starts:
        return base, base
    more = [(s, 4, e) for s, e in others(text, base) if s in starts or any(p in patterns for p in _before(text, s))]
    return base, sorted(base + more)


def seeded(token: str) -> bool:
    """Whether a token that no fixed form knows is a seed: one of the chosen part of credentials."""
    return bool(_CREDENTIAL.fullmatch(token)) and zlib.crc32(token.lower().encode()) % PART == 0


def _edges(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): how often an instance stands after a pattern; seed: how many instances it speaks for, 0 if it is none."""

    def run(batches):
        held("pii", None, dict)
        for whole in batches:
            for b in slices(whole, 1000):
                found: Counter = Counter()
                for x in b.column(0).to_pylist():
                    if x and re.search("[0-9@]", x):
                        base = base_spans(x)
                        for s, e, seed in [(s, e, 1) for s, _, e in base] + [(s, e, PART * seeded(x[s:e])) for s, e in others(x, base)]:
                            for p in _before(x, s):
                                found[p, x[s:e].lower(), seed] += 1
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array(list(found.values()), pa.int64())],
                    ["pattern", "instance", "seed", "n"],
                )

    rows = docs.select("text").mapInArrow(lean(run), "pattern string, instance string, seed long, n long")
    return rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, patterns) -> DataFrame:
    """(pattern, total): how often each pattern stands in the corpus, whatever follows."""

    def run(batches):
        wanted: list[set] = [set() for _ in range(UNITS)]
        for p in patterns.value:
            units = tuple(_UNIT.findall(p))
            wanted[len(units) - 1].add(units)
        for whole in batches:
            for b in slices(whole, 1000):
                n: Counter = Counter()
                for x in b.column(0).to_pylist():
                    units = _UNIT.findall((x or "").lower())
                    for k, some in enumerate(wanted):
                        if some:
                            n.update([t for t in zip(*(units[i:] for i in range(k + 1)), strict=False) if t in some])
                yield pa.RecordBatch.from_arrays([pa.array(map(_joined, n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pattern", "total"])

    return docs.select("text").mapInArrow(lean(run), "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))


def bootstrap(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[str]:
    """The accepted patterns."""
    docs = docs.select(F.col(text).alias("text"))
    edges = materialize(_edges(docs), "pii-edges")
    tried = edges.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= SUPPORT).select("pattern")
    n = -(-tried.count() // PATTERNS)
    if not n:
        return []
    total = None
    for i in range(n):
        part = tried.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).toArrow()["pattern"].to_pylist()
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(part))
        found = materialize(_occurrences(docs, sent), f"pii-totals-{i}")
        sent.unpersist()
        total = found if total is None else total.unionByName(found)
    graph = materialize(edges.join(total, "pattern"), "pii-graph")
    is_seed = F.col("seed") > 0
    belief = graph.groupBy("instance").agg(F.max(is_seed.cast("double")).alias("belief"))
    good = None
    for turn in range(TURNS):
        believed = F.col("belief") >= 0.5
        scored = graph.join(belief, "instance").groupBy("pattern").agg(
            F.least(F.lit(1.0), F.greatest(F.sum(F.col("n") * F.col("belief")), F.sum(F.col("n") * F.col("seed"))) / F.sum("n")).alias("purity"), (F.sum("n") / F.first("total")).alias("share"),
            F.sum(F.when(is_seed, F.col("seed")).otherwise(believed.cast("long"))).alias("support"), F.count_if(believed).alias("believed"),
        )
        enough = (F.col("support") >= SUPPORT) & (F.col("believed") >= SEEDS)
        good = materialize(scored.where((F.col("purity") >= PURITY) & (F.col("share") >= SHARE) & enough), f"pii-good-{turn}")
        doubt = graph.join(good, "pattern", "left").groupBy("instance").agg(F.max(is_seed).alias("seed"), F.sum(F.log1p(-0.9 * F.coalesce("purity", F.lit(0.0)))).alias("doubt"))
        belief = materialize(doubt.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("belief")), f"pii-belief-{turn}")
    return sorted(good.select("pattern").toArrow()["pattern"].to_pylist())


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _applied(docs: DataFrame, patterns: list[str], text: str) -> tuple[DataFrame, frozenset[str]]:
    """docs with the starts of identifiers after all patterns but the last ACCEPTED, and those; one part leaves docs as they are."""
    parts = [patterns[i : i + ACCEPTED] for i in range(0, len(patterns), ACCEPTED)] or [[]]
    if len(parts) > 1:
        docs = docs.withColumn(STARTS, F.array().cast("array<int>"))
    for part in parts[:-1]:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(part))

        def run(batches, sent=sent):
            for whole in batches:
                for b in slices(whole, 1000):
                    i, j = b.schema.get_field_index(text), b.schema.get_field_index(STARTS)
                    new = [[s for s, k, _ in spans_of(x, sent.value, set(old))[1] if k == 4] if x else [] for x, old in zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)]
                    yield b.set_column(j, b.schema.field(j), pa.array(new, b.schema.field(j).type))

        docs = materialize(docs.mapInArrow(lean(run), docs.schema), "pii-starts")
        sent.unpersist()
    return docs, frozenset(parts[-1])


def _starts(b: pa.RecordBatch) -> list[frozenset[int]]:
    j = b.schema.get_field_index(STARTS)
    return [frozenset()] * b.num_rows if j < 0 else [frozenset(x) for x in b.column(j).to_pylist()]


def extract(docs: DataFrame, patterns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans) for every row of docs."""
    docs, last = _applied(docs.select(key, text), patterns, text)
    sent = docs.sparkSession.sparkContext.broadcast(last)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1000):
                found = [spans_of(x, sent.value, old) if x else ([], []) for x, old in zip(b.column(1).to_pylist(), _starts(b), strict=True)]
                counts = [pa.array([sum(k == i for _, k, _ in base) for base, _ in found], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *counts, pa.array([_told(x) for x, _ in found], pa.string()), pa.array([_told(x) for _, x in found], pa.string())],
                    [key, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
                )

    return docs.mapInArrow(lean(run), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by the mark of its first kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """docs with personal data in text replaced by marks; null texts stay null."""
    docs, last = _applied(docs, patterns, text)
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1000):
                i = b.schema.get_field_index(text)
                new = [masked(x, spans_of(x, sent.value, old)[1]) if x else x for x, old in zip(b.column(i).to_pylist(), _starts(b), strict=True)]
                yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(lean(run), docs.schema).drop(STARTS)


def op5_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = extract(docs, bootstrap(docs))
    n = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", n.alias("n_spans"))
