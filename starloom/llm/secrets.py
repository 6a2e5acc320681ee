"""Secret scans in DataFrame expressions only.

Base kinds are regular expressions; a battery of randomness tests adds ``random``
spans.  A candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of 20 characters or more
with a digit and a letter.  Its encoding (hex, base32, base36 or base64) is inferred
from its characters; three tests look at the digits it stands for:

* chi-squared uniformity over the encoding's alphabet,
* runs above and below the middle of the alphabet, and
* serial correlation at lag one.

Each gives a standard score against the hypothesis that the string is text (words,
names, paths): how much nearer to randomness it is than text of its length tends to be,
in standard deviations.  The three are combined by Stouffer's weighted sum, whose normal p-value
is the candidate's: evidence for randomness from one test is taken back by another one
that speaks against it, as for an alphabet in order.  The p-values of each length class
go through a Benjamini-Hochberg step of their own (counts by bins of p, a table of fixed
size), since short strings give weak evidence and shouldn't dilute that of long ones.

Positions are code points, ends exclusive.  Java's matcher gives matches but no
places; these follow from the lengths of the pieces between the matches.

Defined results: null text is empty and has no spans; repeated rows are scanned as
they come; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run of one class that is too short can hold no longer match: the least lengths may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (name, pattern, alphabet); the first that fits is inferred, - and _ count as + and /, hex and base36 in lower case.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + UPPER.lower()),
    ("base64", r"", UPPER + UPPER.lower() + DIGITS + "+/"),
)
#: Of text, measured on names and paths in source code: the sum of squared letter frequencies, and how far from random
#: the shares of runs and the lag-one correlations are in the mean.
TEXT_SQUARES, TEXT_RUNS, TEXT_SERIAL = 0.06, 0.15, 0.16
#: The first test tells more than the others and counts twice.
EVEN_WEIGHT = 2
#: Upper ends of length classes; error rate; elements of an array that are handled at once.
CLASS_ENDS, RATE, CHUNK = (28, 40, 64), 0.05, 256


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def chunks(values: Column) -> Column:
    """Runs of CHUNK elements; one empty run if there are none.  ``values`` must be cheap: it is looked up for each run."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))


def before(values: Column, add) -> Column:
    """For each int of an array what ``add`` makes of 0 and the ints before it."""
    none = F.array().cast("array<int>")
    step = lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda acc: acc["all"])


def spans(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>> of matches, which are all matches of the pattern in the text.

    Positions are sums of the lengths before them, summed by chunks, so that texts of very many matches are no square of work.
    """
    pieces = F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("hit")))
    none = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])
    one = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop"), x["hit"].alias("hit")))).alias("found"))
    placed = lambda cs: F.zip_with(cs, before(F.transform(cs, total), lambda acc, v: acc + v), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), one, lambda acc: acc["found"]))
    found = let(pieces, lambda p: let(pairs(p), lambda xs: let(chunks(xs), lambda cs: F.flatten(placed(cs)))))
    return F.when(F.size(matches) > 0, found).otherwise(none)


def evidence(hit: Column) -> Column:
    """bin (-10 log10 of the p-value that text looks so random, 300 at most; -1: no candidate) of a run."""
    found = F.lit(-1)
    for _name, pattern, alphabet in reversed(ENCODINGS):
        plain = F.translate(hit, "-_", "+/") if len(alphabet) == 64 else F.upper(hit) if alphabet[0] == "A" else F.lower(hit)
        bin_ = _battery(plain, alphabet)
        found = bin_ if not pattern else F.when(hit.rlike(pattern), bin_).otherwise(found)
    return F.when(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"), found).otherwise(F.lit(-1)).cast("int")


def _battery(s: Column, alphabet: str) -> Column:
    k = len(alphabet)
    letters = F.array(*(F.lit(c) for c in alphabet))
    x = F.transform(F.split(s, ""), lambda c: F.array_position(letters, c).cast("double") - 1)
    tests = lambda x: F.transform(F.array(F.struct(x.alias("x"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sum"))), lambda q: _verdict(s, letters, k, q["x"], q["sum"]))[0]
    return F.transform(F.array(x), tests)[0]


def _verdict(s: Column, letters: Column, k: int, x: Column, total: Column) -> Column:
    add = lambda a, v: a + v
    n = F.size(x).cast("double")
    squares = F.aggregate(F.transform(letters, lambda c: F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), add)
    chi, excess = squares * k / n - n, n * (k * TEXT_SQUARES - 1) if k * TEXT_SQUARES > 1 else n * 0.6
    even = (chi - (k - 1) - excess) / F.sqrt(2.0 * (k - 1) + 4 * excess)
    mean = total / n
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
    turns = F.size(F.filter(pairs, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))) + 1
    # a random string has half of its digits above the middle, and turns at every other one
    runs = (F.abs(turns - (n + 1) / 2) - TEXT_RUNS * n) / F.sqrt(n - 1) * 2
    spread = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), add)
    serial = F.aggregate(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)), F.lit(0.0), add) / F.greatest(spread, F.lit(1e-9))
    corr = (F.abs(serial + 1 / n) - TEXT_SERIAL) * F.sqrt(n)
    z = (EVEN_WEIGHT * even + runs + corr) / math.sqrt(EVEN_WEIGHT**2 + 2)
    return let(z, lambda z: F.least(F.floor(surprise(z)), F.lit(300)))


def surprise(z: Column) -> Column:
    """-10 log10 of the normal distribution function, by a logistic fit and below -3 by its tail's upper bound."""
    t = -(1.5976 * z + 0.07056 * z * z * z)
    middle = F.log1p(F.exp(F.least(t, F.lit(31.0))))
    tail = z * z / 2 + F.log(-z * math.sqrt(2 * math.pi))
    return F.when(z < -3, tail).otherwise(middle) * (10 / math.log(10))


def length_class(n: Column) -> Column:
    c = F.lit(len(CLASS_ENDS))
    for i, end in reversed(list(enumerate(CLASS_ENDS))):
        c = F.when(n < end, F.lit(i)).otherwise(c)
    return c


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, base spans (array of start, kind number, stop) and candidates (start, stop, class, bin)."""
    names = {c: f"_{c}" for c in keep}  # whatever the table's columns are called
    df = docs.select(*(F.col(c).alias(names[c]) for c in keep), F.coalesce("text", F.lit("")).alias("t"))
    every = lambda p, group=0: F.regexp_extract_all("t", F.lit(p), F.lit(group))
    df = df.withColumns({"m0": every(ASSIGN), "m1": every(ACCESS), "m2": every(HEX), "m3": every(RUN)})
    places = {f"s{i}": spans(F.col("t"), F.col(f"m{i}"), p) for i, p in enumerate((ASSIGN, ACCESS, HEX, RUN))}
    values = F.when(F.size("m0") > 0, every(ASSIGN, 2)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(places | {"v0": values})
    plain = lambda i: F.transform(F.col(f"s{i}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))
    long_ = F.filter(F.zip_with("s0", "v0", lambda s, v: F.struct(s["start"].alias("start"), F.lit(0).alias("kind"), s["stop"].alias("stop"), v.alias("v"))), lambda s: F.length(s["v"]) >= 12)
    base = F.concat(F.transform(long_, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))), plain(1), plain(2))
    tested = F.transform("s3", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), length_class(F.length(s["hit"])).alias("class"), evidence(s["hit"]).alias("bin")))
    df = df.select(*names.values(), "t", F.array_sort(base).alias("base"), tested.alias("tested"))
    return df.select(*(F.col(v).alias(c) for c, v in names.items() if c != "text"), *([F.col(names["text"]).alias("text")] if "text" in keep else []), F.col("base").alias("base_spans"), F.filter("tested", lambda s: s["bin"] >= 0).alias("tested_spans"))


def discoveries(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, least): the smallest bin that the Benjamini-Hochberg step of each length class calls; a few rows."""
    bins = found.select(F.explode("tested_spans").alias("s")).groupBy(F.col("s.class").alias("class"), F.col("s.bin").alias("bin")).count()
    down = W.partitionBy("class").orderBy(F.desc("bin"))
    at = bins.withColumn("called", F.sum("count").over(down)).withColumn("all", F.sum("count").over(W.partitionBy("class")))
    return at.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("called") / F.col("all")).groupBy("class").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, key: str = "doc_id", keep: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """``key``, ``keep`` columns, base_spans and all_spans: arrays of (start, kind number, stop), sorted.

    A ``random`` span that lies inside a base span is not repeated.
    """
    keep = list(dict.fromkeys([key, *(keep or [])]))
    spark = docs.sparkSession
    path = shared_path(spark, "spans")
    found = scanned(docs, keep)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    least = discoveries(found, rate).agg(F.collect_list(F.struct("class", "least")).alias("called"))  # at most one row a class
    df = found.crossJoin(F.broadcast(least))
    passes = lambda s: F.exists("called", lambda c: (c["class"] == s["class"]) & (c["least"] <= s["bin"]))
    inside = lambda s: F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    more = F.transform(F.filter("tested_spans", lambda s: passes(s) & ~inside(s)), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["stop"].alias("stop")))
    return df.select(*keep, "base_spans", F.array_sort(F.concat("base_spans", more)).alias("all_spans"))


def joined(spans_: str) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def redacted(text: str, spans_: str, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by the mark; the spans are sorted by start.

    Spans are handled by chunks: each cuts its own stretch out of the text, and only that
    is cut further, since Spark counts a text's characters from its beginning for every cut.
    """
    ends = lambda cs: F.transform(cs, lambda c: F.coalesce(F.array_max(F.transform(c, lambda s: s["stop"])), F.lit(0)))

    def chunk(c, first):
        last = F.greatest(first, F.coalesce(F.array_max(F.transform(c, lambda s: s["stop"])), F.lit(0)))
        part = F.substring(F.col(text), first + 1, last - first)

        def cut(part):
            def step(acc, s):
                more = F.concat(acc["out"], F.substring(part, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))
                new = F.struct(s["stop"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))
                return F.when(s["stop"] <= acc["at"], acc).otherwise(new)

            return F.aggregate(c, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return let(part, cut)

    most = lambda a, b: F.greatest(a, b)
    cut = let(chunks(F.col(spans_)), lambda cs: F.array_join(F.zip_with(cs, before(ends(cs), most), chunk), ""))
    end = F.array_max(F.transform(spans_, lambda s: s["stop"]))
    return F.when(F.size(spans_) == 0, F.col(text)).otherwise(F.concat(cut, let(end, lambda e: F.substring(F.col(text), e + 1, F.length(text)))))
