"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6

#: Candidates of the battery: maximal runs of the characters that encodings use, and their parts between / and the marks of base64url.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PARTS = (re.compile(r"[^/]{16,}"), re.compile(r"[^_-]{16,}"), re.compile(r"[^/_-]{16,}"))
KINDS = ("assign", "access", "hex", "random")
#: Letters from common to rare. Alphabets are in this order, so that cells of neighbours are far from even in prose.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
ALNUM = "".join(c + c.upper() for c in BY_FREQUENCY) + "0123456789"
ENCODINGS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": BY_FREQUENCY.upper() + "234567", "base36": BY_FREQUENCY + "0123456789", "BASE36": BY_FREQUENCY.upper() + "0123456789",
    "base62": ALNUM, "base64": ALNUM + "+/", "base64url": ALNUM + "-_",
}
_SETS = [(name, frozenset(alphabet)) for name, alphabet in ENCODINGS.items()]
#: Lower ends of the length classes within which false discoveries are controlled.
LENGTHS = (16, 20, 28, 40, 64, 128)
#: Random strings by which the battery's p-values are calibrated for an encoding and length class.
SIMULATED = 400


def infer_encoding(s: str) -> str | None:
    """Name of the narrowest encoding that fits, or None.

    Letters of one case alone, or digits alone, could be prose or a number: no encoding is inferred
    from fewer than two kinds of characters (digits, lower case, upper case).
    """
    have = set(s)
    kinds = (not have.isdisjoint("0123456789")) + (not have.isdisjoint(BY_FREQUENCY)) + (not have.isdisjoint(BY_FREQUENCY.upper()))
    return next((name for name, alphabet in _SETS if have <= alphabet), None) if kinds >= 2 else None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Chance that chi-squared exceeds x, by Wilson and Hilferty's cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _even(counts: list[int], room: list[int], n: int, k: int) -> float:
    """Chi-squared of counts in cells that hold so many of k symbols."""
    return _chi2_tail(sum((c - n * r / k) ** 2 / (n * r / k) for c, r in zip(counts, room, strict=True)), len(room) - 1)


def battery(s: str, alphabet: str) -> tuple[float, float, float, float, float]:
    """p-values, if s is uniformly random over the alphabet: letter frequencies, kinds of characters, runs about the middle, runs of one kind, serial correlation.

    Frequencies are compared in as many cells of neighbouring symbols as have an expected count of 5, at least 2; kinds
    are digits, lower case, upper case and marks, of which words make long runs.
    """
    at = {c: i for i, c in enumerate(alphabet)}
    x = [at[c] for c in s]
    n, k = len(x), len(alphabet)
    cells = max(2, min(k, n // 5))
    counts, room = [0] * cells, [0] * cells
    for i in range(k):
        room[i * cells // k] += 1
    for v in x:
        counts[v * cells // k] += 1
    kind = lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3
    of, had = [0] * 4, [0] * 4
    for c in alphabet:
        of[kind(c)] += 1
    kinds = [kind(c) for c in s]
    for c in kinds:
        had[c] += 1
    same, expected = sum(a == b for a, b in zip(kinds, kinds[1:])), sum(o * o for o in of) / (k * k)
    p_same = _normal_tail((same - (n - 1) * expected) / math.sqrt((n - 1) * expected * (1 - expected)))
    p_kinds = _even([h for h, o in zip(had, of, strict=True) if o], [o for o in of if o], n, k)
    high = [v >= k / 2 for v in x]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    serial = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var if var else 1.0
    return _even(counts, room, n, k), p_kinds, p_runs, p_same, _normal_tail((serial + 1 / n) * math.sqrt(n))


def combined(ps: Sequence[float]) -> float:
    """Fisher's combination: chance of such a product of p-values."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return math.exp(-half) * total


@functools.cache
def _simulated(encoding: str, band: int) -> list[float]:
    """Combined p-values, in order, of random strings of an encoding and length class, always the same ones."""
    r, alphabet = random.Random(f"{encoding}:{band}"), ENCODINGS[encoding]
    longest = LENGTHS[band + 1] - 1 if band + 1 < len(LENGTHS) else 2 * LENGTHS[band]
    return sorted(combined(battery("".join(r.choices(alphabet, k=r.randint(LENGTHS[band], longest))), alphabet)) for _ in range(SIMULATED))


@functools.lru_cache(1 << 14)
def randomness(s: str) -> tuple[int, float] | None:
    """(length class, p) of a string with an inferred encoding, else None.

    The tests depend on each other and are discrete on short strings, so their combined p is taken by its
    rank among those of random strings: of random strings a share of p has at most p.
    """
    encoding = infer_encoding(s)
    if encoding is None:
        return None
    band = bisect_right(LENGTHS, len(s)) - 1
    p = combined(battery(s, ENCODINGS[encoding]))
    under = bisect_right(_simulated(encoding, band), p)
    return band, (under + 0.5) / (SIMULATED + 1) if under else min(p, 0.5 / (SIMULATED + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, length class, p) of every run, and of every part of a run, with an inferred encoding."""
    out = []
    for m in CANDIDATE.finditer(text):
        body = m[0].rstrip("=")
        parts = {(0, len(body))}
        if any(c in body for c in "/_-"):
            parts |= {x.span() for pattern in PARTS for x in pattern.finditer(body)}
        for a, b in sorted(parts):
            if found := randomness(body[a:b]):
                out.append((m.start() + a, m.end() if b == len(body) else m.start() + b, *found))
    return out


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (start, end) that lie in no other."""
    return [x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("p", pa.float64())])
SCAN_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, cands array<struct<start:int,end:int,band:int,p:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            t = text.as_py() or ""
            spans = base_spans(t)
            for k in range(3):
                cols[k].append(sum(s[1] == k for s in spans))
            cols[3].append(hashlib.sha256(span_text(spans).encode()).hexdigest())
            cols[4].append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            cols[5].append([dict(zip(("start", "end", "band", "p"), c, strict=True)) for c in candidates(t)])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_CAND)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "cands"])


def thresholds(scanned: DataFrame, q: float = 0.05, least_p: float = 0.01, steps: int = 20) -> list[float]:
    """For each length class the p-value from which candidates are called random.

    False discoveries are strings that aren't random and yet pass. Within a length class p is uniform over random strings,
    and prose hardly ever has a p above a half; so the candidates above a half, doubled, tell how many random ones there
    are, and with them how many of those above any p are random. The threshold is the least p, from least_p on, at which
    what is above it and not random by that estimate is a share of at most q. It needs the number of p-values
    above each threshold only, from a histogram over (length class, steps an order of magnitude), a few thousand
    cells at any size of corpus.
    """
    c = scanned.select(F.explode("cands").alias("c")).select("c.band", "c.p")
    cell = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * steps), F.lit(30 * steps)).cast("int")
    grid: list[dict[int, int]] = [{} for _ in LENGTHS]
    for r in c.groupBy("band", cell.alias("cell")).count().collect():
        grid[r["band"]][r["cell"]] = r["count"]
    return [_threshold(counts, q, least_p, steps) for counts in grid]


def _threshold(counts: Mapping[int, int], q: float, least_p: float, steps: int) -> float:
    """A cell x holds the p-values from 10 ** (-(x + 1) / steps) to 10 ** (-x / steps)."""
    half = next(x for x in range(steps) if 10 ** (-(x + 1) / steps) <= 0.5)
    middle = 10 ** (-(half + 1) / steps)
    best, above = middle, sum(counts.get(x, 0) for x in range(half + 1))
    # a standard error and one more than were seen, as few say little
    random_ones = (above + math.sqrt(above) + 1) / (1 - middle)
    x = half + 1
    while (low := 10 ** (-(x + 1) / steps)) >= least_p * 0.999:
        above += counts.get(x, 0)
        if above - random_ones * (1 - low) <= q * above:
            best = low
        x += 1
    return best


def scan(docs: DataFrame, *, q: float = 0.05, least_p: float = 0.01) -> DataFrame:
    """Finds secrets in docs (doc_id, text): per row the base counts and digest, and spans, an array of (start, kind, end).

    To the base kinds (0 assign, 1 access, 2 hex) the method adds kind 3, random: candidate runs of 16 characters or more whose battery
    of randomness tests, over the alphabet of their inferred encoding, gives a p-value above the threshold of their length
    class: so that of the strings called random a share of about q isn't, and never below least_p, the share
    of random ones that is given up for it. The parts of a run between /, - and _ are candidates too; a part
    within a run or longer part that passes is not added, nor is a run that a base span covers. Offsets are
    code points, ends exclusive. Null and empty texts have no spans; texts are read whole, however long, a run at a time. Repeated rows give equal rows; a null
    doc_id stays null; other columns are left out; an empty table gives an empty table. The texts are read once and not shuffled; what is written to the shared folder are
    the spans and candidates, a small part of the texts.
    """
    scanned = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCAN_SCHEMA))
    return with_spans(scanned, thresholds(scanned, q, least_p))


def with_spans(scanned: DataFrame, least: Sequence[float]) -> DataFrame:
    def passes(x: Column) -> Column:
        limits = F.array(*[F.lit(p) for p in least])
        inside = F.exists("base", lambda s: (s["start"] <= x["start"]) & (x["end"] <= s["end"]))
        return (x["p"] >= F.get(limits, x["band"])) & ~inside

    within = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    scanned = scanned.withColumn("cands", F.filter("cands", passes))
    added = F.transform(F.filter("cands", lambda x: ~F.exists("cands", lambda y: within(x, y))), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", added))).drop("base", "cands")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redact(limits: Sequence[float]):
    """A function for mapInArrow that replaces every span in column text by [kind]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, t in enumerate(texts):
                if t:
                    spans = base_spans(t)
                    spans += [(a, 3, b) for a, b in outermost([(a, b) for a, b, band, p in candidates(t) if p >= limits[band]])]
                    if spans:
                        texts[i] = redacted(t, sorted(spans))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with overlapping spans merged and each replaced by the kind of its first."""
    out, upto, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[upto:start], f"[{KINDS[kind]}]"]
        upto = end
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, *, q: float = 0.05, least_p: float = 0.01) -> DataFrame:
    """docs with every secret in its text replaced by its kind in brackets; other columns and null texts stay as they are."""
    scanned = cut(docs.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCAN_SCHEMA).select("cands"))
    return docs.mapInArrow(_redact(thresholds(scanned, q, least_p)), docs.schema)
