"""Secret scans in DataFrame functions only: three patterns and a randomness test battery.

Runs of 20 or more letters, digits and +/_=- are candidates. The encoding is inferred from the letters they use
(hex, base32, letters, alphanumeric, base64), and three tests ask whether the run may be a uniform draw of it:
chi-squared over the encoding's alphabet, the number of runs of character classes, and the serial correlation of
neighbouring symbols. The smallest of the three p-values, times three, is the candidate's. Within strata of length a
Benjamini-Hochberg procedure declares runs non-random, over the whole corpus; it works on a histogram of the p-values
(STRATA * BINS counts at most), so no stratum is ever sorted. What isn't declared non-random, is long enough for the
tests to have power in its encoding and overlaps no pattern match is added as a span of kind random.

Positions come from the texts between matches: a match starts where the matches and gaps before it end. They are summed
in chunks, so that a text of very many matches isn't copied once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short at its leftmost match is too short at any later one: these two may ask for the length at once.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6
STRATA = 8
BINS = 400
FDR = 0.05
CHUNK = 128

_SPAN = "array<struct<start:bigint,end:bigint>>"


def _found(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Spans (start, end, s: the match) of pattern's matches in code points; keep: an array of flags by match."""
    rx = F.lit(pattern)
    m = F.regexp_extract_all(text, rx, F.lit(0))
    both = F.arrays_zip(m.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        end = at + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("s")))).alias("spans"))

    def placed(b: Column) -> Column:
        chunk = lambda i: F.slice(b, i * CHUNK + 1, F.lit(CHUNK))
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(b) / CHUNK).cast("int") - 1, F.lit(0)))
        lengths = F.transform(numbers, lambda i: F.aggregate(chunk(i), F.lit(0), lambda a, x: a + F.length(x["g"]) + F.length(x["m"])))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
        each = F.transform(F.arrays_zip(numbers.alias("i"), F.slice(starts, F.lit(1), F.size(numbers)).alias("at")), lambda z: F.aggregate(chunk(z["i"]), F.struct(z["at"].alias("at"), none.alias("spans")), step, lambda a: a["spans"]))
        return F.flatten(each)

    # a lambda's variable holds the matches, which would else be searched for at each mention
    spans = F.get(F.transform(F.array(both), placed), F.lit(0))
    if keep is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("x"), keep.alias("ok")), lambda z: z["ok"]), lambda z: z["x"])
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
    return F.when(F.regexp_like(text, rx), spans).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun, at least 1e-20."""
    x = F.abs(z)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    d = F.lit(0.3989422804014327) * F.exp(-x * x / 2)
    p = d * k * (F.lit(0.319381530) + k * (F.lit(-0.356563782) + k * (F.lit(1.781477937) + k * (F.lit(-1.821255978) + k * F.lit(1.330274429)))))
    return F.greatest(F.when(z >= 0, p).otherwise(F.lit(1.0) - p), F.lit(1e-20))


#: Encoding: pattern, symbols of its alphabet, classes' shares squared and summed, least length for power.
_ENCODINGS = (
    ("[0-9a-f]+|[0-9A-F]+", 16, (10 / 16) ** 2 + (6 / 16) ** 2, 24),
    ("[A-Z2-7]+", 32, (26 / 32) ** 2 + (6 / 32) ** 2, 32),
    ("[a-z]+|[A-Z]+", 26, 1.0, 64),
    ("[0-9]+", 10, 1.0, 48),
    ("[a-z0-9]+|[A-Z0-9]+", 36, (26 / 36) ** 2 + (10 / 36) ** 2, 28),
    ("[A-Za-z]+", 52, 0.5, 40),
    ("[A-Za-z0-9]+", 62, 2 * (26 / 62) ** 2 + (10 / 62) ** 2, 20),
    ("[A-Za-z0-9+/_-]+", 64, 2 * (26 / 64) ** 2 + (10 / 64) ** 2 + (2 / 64) ** 2, 20),
)


def _by_encoding(s: Column, field: int) -> Column:
    out = F.lit(float(_ENCODINGS[-1][field]))
    for e in reversed(_ENCODINGS[:-1]):
        out = F.when(F.regexp_like(s, F.lit(f"^(?:{e[0]})$")), F.lit(float(e[field]))).otherwise(out)
    return out


def p_value(run: Column) -> Column:
    """The battery's p-value of a run (padding signs left out): small if it isn't a uniform draw of its encoding."""
    s = F.regexp_replace(run, "=+$", "")
    n = F.greatest(F.length(s), F.lit(2)).cast("double")
    size, same, _ = (_by_encoding(s, k) for k in (1, 2, 3))
    letters = F.regexp_extract_all(s, F.lit("."), F.lit(0))
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, x: a + F.pow(F.length(s) - F.length(F.replace(s, x, F.lit(""))), F.lit(2)))
    df = size - 1
    chi = F.greatest(size / n * squares - n, F.lit(0.0))
    c = F.lit(2.0) / (df * 9)
    p_chi = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (F.lit(1.0) - c)) / F.sqrt(c))
    # classes: runs are the matches of one class; a uniform draw changes class with chance 1 - sum of squared shares
    runs = F.size(F.regexp_extract_all(s, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) - 1
    change = F.lit(1.0) - same
    sd = F.sqrt(F.greatest((n - 1) * change * same, F.lit(1e-9)))
    p_runs = F.when(change > 0, F.least(F.lit(1.0), _upper_tail(F.abs(runs - (n - 1) * change) / sd) * 2)).otherwise(F.lit(1.0))
    # lag-one correlation of code points about their mean
    codes = F.transform(letters, lambda x: F.ascii(x).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x * x) - n * mean * mean
    lag = F.aggregate(codes, F.expr("named_struct('s', 0D, 'p', cast(null as double))"), lambda a, x: F.struct((a["s"] + F.coalesce(a["p"] * x, F.lit(0.0))).alias("s"), x.alias("p")), lambda a: a["s"])
    first, last = F.element_at(codes, 1), F.element_at(codes, -1)
    cov = lag - mean * (F.lit(2.0) * n * mean - first - last) + (n - 1) * mean * mean
    r = F.when(var > 1e-9, cov / var).otherwise(F.lit(1.0))
    p_serial = F.least(F.lit(1.0), _upper_tail(F.abs(r + F.lit(1.0) / n) * F.sqrt(n)) * 2)
    return F.least(F.lit(1.0), F.least(p_chi, p_runs, p_serial) * 3)


def _thresholds(p: DataFrame, fdr: float) -> dict[int, float]:
    """Benjamini-Hochberg by stratum on counts of binned p-values: runs at or under the value are non-random."""
    bins = p.groupBy("stratum", F.least(F.floor(-F.log10("p") * 20), F.lit(BINS)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    strata: dict[int, dict[int, int]] = {}
    for r in bins.collect():  # STRATA * BINS rows at most
        strata.setdefault(r.stratum, {})[r.b] = r.n
    out = {}
    for s, own in strata.items():
        total, so_far = sum(own.values()), 0
        out[s] = -1.0
        for b in sorted(own, reverse=True):
            so_far += own[b]
            top = 10.0 ** (-b / 20)  # the largest p-value of the bin
            if top <= fdr * so_far / total:
                out[s] = top
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Per row of docs: id and arrays of spans (start, end; code points, end exclusive) assign, access, hex, random.

    Texts are scanned whole; null is empty. Repeated rows and null ids each get their row; equal texts get equal spans.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("k"), t.alias("t"))
    values = F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    runs = F.transform(_found(F.col("t"), RUN), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), p_value(x["s"]).alias("p"), (F.length(F.regexp_replace(x["s"], "=+$", "")) >= _by_encoding(F.regexp_replace(x["s"], "=+$", ""), 3)).alias("long")))
    found = base.select("k", bare(_found(F.col("t"), ASSIGN, values)).alias("assign"), bare(_found(F.col("t"), ACCESS)).alias("access"), bare(_found(F.col("t"), HEX)).alias("hex"), runs.alias("runs"))
    found = materialize(found, "runs")
    stratum = lambda x: F.least(F.floor((x["end"] - x["start"] - 20) / 8), F.lit(STRATA - 1)).cast("int")
    each = found.select(F.explode("runs").alias("x")).select(stratum(F.col("x")).alias("stratum"), F.col("x.p").alias("p"))
    cut = _thresholds(each, fdr)

    def limit(x: Column) -> Column:
        out = F.lit(1.0)
        for s, v in sorted(cut.items()):
            out = F.when(stratum(x) == s, F.lit(v)).otherwise(out)
        return out

    clear = lambda x: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    random = F.transform(F.filter("runs", lambda x: x["long"] & (x["p"] > limit(x)) & clear(x)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select(F.col("k").alias(id_col), "assign", "access", "hex", random.cast(_SPAN).alias("random"))


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""

    def ranked_as(i: int, k: str) -> Column:  # a second parameter of the lambda, a default too, would be the span's place in its array
        return F.transform(k, lambda x: F.struct(x["start"].alias("a"), F.lit(i).alias("i"), x["end"].alias("b")))

    ranked = [ranked_as(i, k) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*ranked)), lambda x: F.concat_ws(":", F.get(names, x["i"]), x["a"].cast("string"), x["b"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"), size("random"))
