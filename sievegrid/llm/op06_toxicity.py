"""Toxicity scores of texts read through a noisy channel.

Words that writers disguise (digits and signs for letters, stretched letters,
letters set apart) are lattices of characters: each sign may stand for itself or
for the letters it resembles, a repeated letter may be one stroke too long, and
a separator may be noise or the end of a word. Runs of three or more single
characters (a letter among them) with any separators between are one lattice.
Viterbi decoding finds the likeliest spelling under a character trigram model
counted over the whole corpus. Features of the restored words (the word and its
first 3 to 6 letters) go to a logistic regression. Tokens are cut at signs that
stand for no letter; words of more than LONG letters, and those of scripts
without blanks, give the letters from each of their places as features.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
SAMPLE of them, those least by a hash of their id. The features are those that
stand in enough toxic documents of these and are much likelier there. The
character model is counted over all documents. Labels, language, source and id
are never inputs of a score.

Cases: null and empty texts are scored as texts without features; a null doc_id
is held out of nothing and learned from never; documents labelled twice count as
toxic if either says so; of rows that share an id the one of the least text is
learned from; without learnable rows all scores are alike and low;
rows are scored each on its own; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import string
import unicodedata
import uuid
from collections import Counter
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, lean, materialize, table
from .op04_bpe import slices

#: Signs and the letters that they may stand for. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (negative log probabilities) of a sign for a letter, of a letter too many, and of a dropped separator.
SWAP, STRETCH, DROP = 1.0, 1.5, 0.5
#: Labelled rows that the classifier is fitted on, toxic documents a feature needs, and its least log odds.
SAMPLE, SUPPORT, ODDS = 60_000, 4, 1.5
EDGES = string.punctuation.translate(str.maketrans("", "", "@$!|+(")) + "«»“”„’‘…"
SIGNS = "@$!|+(€£¡"
#: Combining marks, which belong to words.
MARKS = re.escape("".join(c for c in map(chr, [*range(0x300, 0x3100), *range(0xA600, 0xAC00), *range(0xFE00, 0xFE30)]) if unicodedata.category(c)[0] == "M"))
HARD = re.compile(rf"[^\w{MARKS}{SIGNS}*._-]+")
ONE = rf"(?:[^\W_]|[{SIGNS}])"
GAP = re.compile(r"[\s.*_,;:/\\~=#&^·•-]++")
RUN = re.compile(rf"""(?<![^\s"'«“„‘\[{{<]){ONE}(?:{GAP.pattern}{ONE}){{2,}}(?=[^\w\s]*+(?:\s|\Z))""")
LETTER, SIGN, TRIPLE = re.compile(r"[^\W\d_]"), re.compile(rf"[0-9{SIGNS}*._-]"), re.compile(r"([^\W\d_])\1\1")
#: Scripts that set no blanks between words: Thai, Lao, Myanmar, Khmer, kana and Han.
UNBLANKED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
LONG = 64
START, END = "\x02", "\x03"


class CharModel:
    """Trigram costs of characters inside words, with backing off by interpolation."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.ones = counts, Counter(), Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.ones[g[2]] += n
        self.mid = Counter()
        for g, n in counts.items():
            self.mid[g[1:]] += n
        self.left = Counter()
        for g, n in self.mid.items():
            self.left[g[0]] += n
        self.total, self.kinds, self.memo = sum(self.ones.values()), len(self.ones) + 1, {}

    def cost(self, a: str, b: str, c: str) -> float:
        found = self.memo.get(a + b + c)
        if found is None:
            one = (self.ones[c] + 0.1) / (self.total + 0.1 * self.kinds)
            two = (self.mid[b + c] + 2 * one) / (self.left[b] + 2)
            found = -math.log((self.three.get(a + b + c, 0) + 2 * two) / (self.two[a + b] + 2))
            if len(self.memo) < 200_000:
                self.memo[a + b + c] = found
        return found


def decode(units: list[str], model: CharModel, gaps: bool) -> str:
    """The likeliest words, with a blank between, of a lattice: Viterbi. With gaps, every other unit is a separator of single characters."""
    states: dict[tuple[str, str], tuple[float, str]] = {(START, START): (0.0, "")}
    narrow, done = min(map(len, units[1::2]), default=1) if gaps else 1, []
    for i, ch in enumerate(units):
        after: dict[tuple[str, str], tuple[float, str]] = {}

        def put(state, cost, text, after=after):
            if state not in after or (cost, text) < after[state]:
                after[state] = (cost, text)

        gap = gaps and i % 2 == 1
        choices = [] if gap else [(ch, 0.0)] + [(x, SWAP) for x in LOOKS.get(ch, "")]
        for (a, b), (cost, text) in states.items():
            for x, price in choices:
                put((b, x), cost + price + model.cost(a, b, x), text + x)
            if i and ch == units[i - 1] and ch.isalpha():
                put((a, b), cost + STRETCH, text)
            if gap or not ch.isalnum():
                put((a, b), cost + DROP * (1 + min(8, len(ch) - narrow) if gap else 1), text)
                if b != START:
                    put((START, START), cost + model.cost(a, b, END), text + " ")
        states = after
        if i % 64 == 63:  # what all have in common is settled
            n = len(os.path.commonprefix([text for _, text in states.values()]))
            done.append(next(iter(states.values()))[1][:n])
            states = {k: (cost, text[n:]) for k, (cost, text) in states.items()}
    return ("".join(done) + min((cost + (model.cost(a, b, END) if b != START else 0.0), text) for (a, b), (cost, text) in states.items())[1]).strip(" ")


def restore(word: str, model: CharModel) -> str:
    """The likeliest spelling of a disguised word (lower case), or words that signs join."""
    return decode(list(word), model, False)


def restore_run(run: str, model: CharModel) -> str:
    """The likeliest words of single characters set apart (lower case)."""
    units, at = [], 0
    for m in GAP.finditer(run):
        units += [run[at : m.start()], m[0]]
        at = m.end()
    return decode([*units, run[at:]], model, True)


def trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): character trigrams inside the words of every document; in size bounded by the alphabet's third power."""

    def counted(words: Counter) -> pa.RecordBatch:
        parts, n = [], []
        for w, m in words.items():
            w = w.strip(EDGES)
            for part in [w] if w.isalpha() else [x for p in HARD.split(w) if len(x := p.strip(EDGES)) > 1 and x.isalpha()]:
                parts.append(START + START + part + END)
                n.append(m)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inside = np.ones(len(points), bool)
        ends = np.cumsum(size)
        inside[ends - 1] = inside[ends - 2] = False
        at = np.flatnonzero(inside)
        keys, place = np.unique((points[at] << 42) | (points[at + 1] << 21) | points[at + 2], return_inverse=True)
        sums = np.bincount(place, weights=np.repeat(np.array(n, float), size - 2), minlength=len(keys)).astype(np.int64)
        grams = ["".join(map(chr, (k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF))) for k in keys.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(sums)], ["gram", "n"])

    def run(batches):
        held("trigrams", None, dict)
        words: Counter = Counter()
        for whole in batches:
            for b in slices(whole, 2000):
                for x in b.column(0).to_pylist():
                    words.update((x or "").lower().split())
                if len(words) > 40_000:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    return docs.select(text).mapInArrow(lean(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text: str = "text") -> dict[str, int]:
    rows = trigrams(docs, text).toArrow()
    return dict(zip(rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True))


class Reader:
    """Texts to sets of features."""

    def __init__(self, grams: dict[str, int], wanted: Collection[str] | None = None):
        self.model, self.wanted, self.memo, self.bare = CharModel(grams), wanted, {}, set()
        # How plain words with a wanted feature begin.
        self.stems = None if wanted is None else {x[1:4] if x.startswith("=") else x[:3] for x in wanted}

    def told(self, w: str) -> list[str]:
        """The features of a restored word."""
        found = ["=" + w] if len(w) <= LONG else []
        if (unblanked := UNBLANKED.search(w)) or len(w) > LONG:
            found += {w[i : i + k] for k in range(2 if unblanked else 3, 7) for i in range(len(w) - k + 1)}
        else:
            found += [w[:k] for k in range(3, min(7, len(w) + 1))]
        return found if self.wanted is None else [x for x in found if x in self.wanted]

    def word(self, token: str) -> tuple[str, ...]:
        token = token.strip(EDGES)
        if token.isalpha() and len(token) <= LONG and not TRIPLE.search(token) and (token.isascii() or not UNBLANKED.search(token)):
            if self.stems is not None and token[:3] not in self.stems:
                return ()
            found = "=" + token, *(token[:k] for k in range(3, min(7, len(token) + 1)))
            return found if self.wanted is None else tuple(x for x in found if x in self.wanted)
        out: list[str] = []
        for w in [token] if token.isalpha() else HARD.split(token):
            w = w.strip(EDGES)
            if not LETTER.search(w):
                continue
            for x in restore(w, self.model).split(" ") if SIGN.search(w) or TRIPLE.search(w) else [w]:
                out += self.told(x)
        return tuple(out)

    def features(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        words = set(text.split())
        if len(self.memo) > (30_000 if self.wanted is None else 100_000):  # all features of a word are many
            self.memo = {}
        if len(self.bare) > 300_000:
            self.bare = set()
        out: set[str] = set()
        for w in words.difference(self.bare):
            found = self.memo.get(w)
            if found is None:
                found = self.word(w)
                if len(w) <= LONG:
                    if found:
                        self.memo[w] = found
                    else:
                        self.bare.add(w)
            out.update(found)
        for m in RUN.finditer(text):
            if LETTER.search(m[0]):
                for x in restore_run(m[0], self.model).split(" "):
                    out.update(self.told(x))
        return out


def _sent(spark, value) -> tuple:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def _reader(sent: tuple, make):
    """The reader of what was sent; what it knows of words serves the worker's next tasks too."""
    return held("toxicity", sent[0], lambda: make(sent[1].value))


def _supported(rows: DataFrame, sent) -> list[str]:
    """The features that stand in SUPPORT of the rows or more, in order."""

    def run(batches):
        reader = _reader(sent, Reader)
        for whole in batches:
            for b in slices(whole, 1000):
                n: Counter = Counter()
                for x in b.column(0).to_pylist():
                    n.update(reader.features(x))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    counts = rows.select("text").mapInArrow(lean(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return sorted(counts.where(F.col("n") >= SUPPORT).select("feature").toArrow()["feature"].to_pylist())


def _featured(rows: DataFrame, sent) -> DataFrame:
    """(f array<int>, toxic, at): the places in the list of known features of those that each row has, in order."""

    def run(batches):
        reader, place = _reader(sent, lambda x: (Reader(x[0], known := {f: i for i, f in enumerate(x[1])}), known))
        for whole in batches:
            for b in slices(whole, 200):
                found = [sorted(place[f] for f in reader.features(x)) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["f", "toxic", "at"])

    return rows.select("text", F.col("toxic").cast("int").alias("toxic"), "at").mapInArrow(lean(run), "f array<int>, toxic int, at long")


def _counted(found: DataFrame, n: int) -> DataFrame:
    """(feature int, n1, n0): in how many toxic and other rows each of n features stands; a task's rows are counted where they are read."""

    def run(batches):
        held("toxic-counts", None, dict)
        sums = np.zeros((2, n), np.int64)
        for b in batches:
            f = b.column(0)
            toxic = np.repeat(b.column(1).to_numpy() == 1, pc.list_value_length(f).to_numpy())
            at = f.flatten().to_numpy()
            sums += np.bincount(at[toxic], minlength=n), np.bincount(at[~toxic], minlength=n)
        there = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *map(pa.array, sums[:, there])], ["feature", "n1", "n0"])

    counts = found.select("f", "toxic").mapInArrow(lean(run), "feature int, n1 long, n0 long")
    return counts.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def select_features(counts: DataFrame, n1: int, n0: int) -> list:
    """All features with SUPPORT toxic documents and log odds of ODDS, of n1 toxic and n0 other documents; the best first."""
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    rows = counts.where(F.col("n1") >= SUPPORT).select("feature", "n1", odds.alias("odds")).where(F.col("odds") >= ODDS).toArrow()
    rank = {f: -x * math.sqrt(n) for f, n, x in zip(*(rows[c].to_pylist() for c in ("feature", "n1", "odds")), strict=True)}
    return sorted(rank, key=lambda f: (rank[f], f))


def _placed(found: DataFrame, picked: list[int], n: int) -> DataFrame:
    """(f array<int>, toxic, at): the places in picked of each row's features, of n, without those that have none."""
    places = np.full(n, -1, np.int32)
    places[picked] = np.arange(len(picked))

    def run(batches):
        for b in batches:
            f = b.column(0)
            at = places[f.flatten().to_numpy()]
            row = np.repeat(np.arange(len(f)), pc.list_value_length(f).to_numpy())
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[at >= 0], minlength=len(f)))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[at >= 0])), b.column(1), b.column(2)], ["f", "toxic", "at"])

    return found.mapInArrow(lean(run), "f array<int>, toxic int, at long")


def _fit(rows: list[list[int]], y: np.ndarray, n: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with a ridge, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    w, look, b, look_b, t = np.zeros(n), np.zeros(n), 0.0, 0.0, 1.0
    value = scale[row]
    for _ in range(steps):
        z = np.bincount(row, look[col] * value, len(rows)) + look_b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new, new_b = look - 4 * (np.bincount(col, g[row] * value, n) + 0.02 * look) / max(1.0, 0.25 * np.sqrt(len(y))), look_b - 4 * g.mean()
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        look, look_b = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new, new_b
    return w, b


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, float], float]:
    """(trigram counts, feature weights, intercept)."""
    spark = docs.sparkSession
    grams = char_model(docs)
    sent = _sent(spark, grams)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(fold != 0).withColumn("at", F.xxhash64("doc_id", F.lit(6)))
    least = marked.select("at").orderBy("at").limit(SAMPLE).agg(F.max("at")).first()[0]
    # At most SAMPLE ids are sent to the texts, so no text moves but theirs.
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(marked.where(F.col("at") <= F.lit(least).cast("long"))), "doc_id")
    rows = materialize(rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("at").alias("at"), F.min("text").alias("text")), "toxic-rows")
    # What too few toxic rows hold can't be chosen, and isn't looked for in the others.
    known = _supported(rows.where("toxic = 1"), sent)
    found = materialize(_featured(rows, _sent(spark, (grams, known))), "toxic-features")
    sizes = found.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    picked = select_features(_counted(found, len(known)), *sizes)
    fit = _placed(found, picked, len(known)).toArrow().sort_by("at")
    discard(rows, found)
    y = (fit["toxic"].to_numpy() == 1).astype(float)
    w, b = _fit(fit["f"].to_pylist(), y, len(picked)) if len(y) else (np.zeros(len(picked)), -3.0)
    return grams, {known[i]: x for i, x in zip(picked, w.tolist(), strict=True)}, float(b)


def _scorer(value):
    grams, weights, intercept = value
    reader = Reader(grams, set(weights))

    def score(text: str | None) -> float:
        f = reader.features(text)
        z = intercept + sum(weights[k] for k in sorted(f)) / math.sqrt(max(1, len(f)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose predicted label is 1; all columns and other rows stay as they are."""
    sent = _sent(docs.sparkSession, learn(docs.select("doc_id", F.col(text).alias("text")), labels))

    def run(batches):
        score = _reader(sent, _scorer)
        for whole in batches:
            for b in slices(whole, 1000):
                yield b.filter(pa.array([score(x) < 0.5 for x in b.column(b.schema.get_field_index(text)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sent = _sent(docs.sparkSession, learn(docs, labels))

    def run(batches):
        score = _reader(sent, _scorer)
        for whole in batches:
            for b in slices(whole, 1000):
                out = [score(x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
