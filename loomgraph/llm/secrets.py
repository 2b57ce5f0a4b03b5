"""Secret scans by a battery of randomness tests (DataFrame functions only).

Three base patterns find assignments, access keys and hex strings. The method adds spans of kind ``random``: strings of
20 or more characters of the base64 alphabets with a digit among them get an inferred encoding (its alphabet), and
three tests of the hypothesis that they are uniform draws from it: chi-squared uniformity of the alphabet, the number of
runs above and below the alphabet's middle, and the serial correlation of neighbours. Fisher's method combines the three
p-values; a string under ``ALPHA`` is no random one.

Passing is no evidence for a short string, so the others are tested against the opposite hypothesis, that their letters
(in either case) are those of text: the mean log ratio of the letters' shares in all texts of the corpus to uniform shares
falls short of its mean in text by so many standard deviations, which are widened by ``DISPERSION`` as neighbouring
letters depend on each other. Strings that this hypothesis is rejected for are reported. The Benjamini-Hochberg rule
sets the level within strata of encoding and length, so that the share of text among what is reported stays under ``FDR``
and short strings, which have little power, don't set the level for long ones. The rule runs on counts of all strings of the
corpus by stratum and bin of p: ``len(ENCODINGS) * LENGTHS * BINS`` rows at most reach the driver.

Positions count code points, ends are exclusive. They come from the lengths of the matches and of the text between.

Defined results: null and empty texts have no spans and the digest of an empty string; null doc_ids and repeated rows are scanned
like any row; an empty table gives an empty result; very long texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, texts

#: Patterns and least lengths of the contract (fixed values), in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Of runs that the contract takes whole and drops if short, the least lengths stand in the pattern; the matches are the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs with a digit; the look-ahead passes over words quickly.
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern and alphabet; the first that fits is taken.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
LENGTHS, BINS, FDR = 8, 64, 0.05
ALPHA, DISPERSION, LEAST_SCORE = 0.001, 2.0, -4.0
#: Matches of a text that are put together before they join the others.
CHUNK = 64

NONE_SQL = "cast(array() as array<struct<start:int,kind:int,stop:int,token:string>>)"


def located(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, stop, token) of all matches whose value has ``least`` characters.

    The value is group 2 of assignments and else the match; tokens are carried for kind ``random`` alone.
    """
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        matches.alias("match"),
        (F.regexp_extract_all(text, p, F.lit(2)) if kind == 0 else matches).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(NONE_SQL).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(F.length(x["match"]), F.lit(0))  # there is one gap more than matches
        one = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("stop"), (x["value"] if kind == 3 else F.lit("")).alias("token")))
        keep = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        return F.struct(b.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # Arrays that grow by one are copied each time, so a text's matches are gathered in chunks.
    chunks = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{NONE_SQL.split(' as ')[1][:-1]}>)").alias("chunks"))

    def chunk(all_steps: Column) -> Column:
        def more(acc: Column, i: Column) -> Column:
            here = F.aggregate(F.slice(all_steps, i * CHUNK + 1, CHUNK), F.struct(acc["at"].alias("at"), F.expr(NONE_SQL).alias("found")), step)
            bound = F.transform(F.array(here), lambda h: F.struct(h["at"].alias("at"), F.concat(acc["chunks"], F.array(h["found"])).alias("chunks")))
            return F.element_at(bound, 1)

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")), chunks, more, lambda acc: F.flatten(acc["chunks"]))

    few = F.transform(F.array(steps), lambda x: F.when(F.size(x) <= CHUNK, F.aggregate(x, start, step, lambda acc: acc["found"])).otherwise(chunk(x)))
    return F.element_at(few, 1)


def encoding(token: Column) -> Column:
    out = F.lit(len(ENCODINGS))
    for n, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), F.lit(n)).otherwise(out)
    return out


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by the tail fraction of Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.least(2 * tail, F.lit(1.0)), F.lit(1e-300))


def letter_scores(shares: list[float], used: str) -> tuple[list[float], float, float]:
    """Log ratio of each letter's share among the ``used`` ones to a uniform share, and its mean and variance in text."""
    total = sum(q for c, q in zip(LOWER, shares) if c in used)
    own = [q / total if c in used else 0.0 for c, q in zip(LOWER, shares)]
    scores = [max(LEAST_SCORE, math.log(q * len(used))) if q else (LEAST_SCORE if c in used else 0.0) for c, q in zip(LOWER, own)]
    mean = sum(q * x for q, x in zip(own, scores))
    return scores, mean, max(1e-6, sum(q * x * x for q, x in zip(own, scores)) - mean * mean)


def letter_shares(docs: DataFrame) -> list[float]:
    """Shares of a to z among the letters of all texts, in either case; each letter counts once more than it occurs."""
    low = F.lower("text")
    counts = docs.select(*[(F.length(low) - F.length(F.replace(low, F.lit(c)))).alias(c) for c in LOWER]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LOWER]).first()
    return [(counts[c] + 1) / (sum(counts) + 26) for c in LOWER]


def like_text(token: Column, enc: Column, shares: list[float]) -> Column:
    """P(letters of text score as low as the token's), by the normal distribution; 1/2 for a token without letters."""
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    m = F.length(letters).cast("double")

    def p(used: str) -> Column:
        scores, mean, variance = letter_scores(shares, used)
        of = F.array(*map(F.lit, scores))
        total = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda acc, c: acc + F.when(F.length(c) > 0, F.element_at(of, F.ascii(c) - 96)).otherwise(0.0))
        z = (total - m * mean) / F.sqrt(F.greatest(m, F.lit(1.0)) * variance * DISPERSION)
        return F.element_at(F.transform(F.array(z), lambda z: F.when(z < 0, two_sided(z) / 2).otherwise(1 - two_sided(z) / 2)), 1)

    return F.when(enc.isin(1, 2), p("abcdef")).otherwise(p(LOWER))


def battery(found: Column, shares: list[float]) -> Column:
    """(start, kind, stop, stratum, p) of one located token; p is 1 where the battery rejects that it is random."""
    token = found["token"]
    n = F.length(token).cast("double")
    enc = encoding(token)
    k = F.element_at(F.array(*[F.lit(float(len(a))) for *_, a in ENCODINGS], F.lit(65.0)), enc + 1)
    alphabet = F.element_at(F.array(*[F.lit(a) for *_, a in ENCODINGS], F.lit(UPPER + LOWER + DIGITS + "+/-_")), enc + 1)
    chars = F.split(token, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(token) - F.length(F.replace(token, c)), F.lit(2.0)))
    values = F.transform(chars, lambda c: F.instr(alphabet, c) - 1.0)
    middle = (k - 1) / 2
    folded = F.aggregate(
        values,
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial")),
        lambda acc, v: F.struct(
            v.alias("last"),
            (acc["changes"] + F.when((acc["last"] >= 0) & ((acc["last"] > middle) != (v > middle)), 1.0).otherwise(0.0)).alias("changes"),
            (acc["serial"] + F.when(acc["last"] >= 0, (acc["last"] - middle) * (v - middle)).otherwise(0.0)).alias("serial"),
        ),
    )
    with_sums = F.struct(squares.alias("sq"), folded.alias("f"))

    def combine(s: Column) -> Column:
        df = k - 1
        chi = F.greatest(k / n * s["sq"] - n, F.lit(1e-9))
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_runs = (s["f"]["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = s["f"]["serial"] / (F.sqrt(n - 1) * (k * k - 1) / 12)
        x = -2 * (F.log(two_sided(z_chi)) + F.log(two_sided(z_runs)) + F.log(two_sided(z_serial)))
        return F.exp(-x / 2) * (1 + x / 2 + x * x / 8)

    fisher = F.element_at(F.transform(F.array(with_sums), combine), 1)
    p = F.when(fisher >= ALPHA, like_text(token, enc, shares)).otherwise(F.lit(1.0))
    length_class = F.least(F.floor(F.log2(n / 20) * 2), F.lit(LENGTHS - 1)).cast("int")
    return F.struct(found["start"].alias("start"), found["kind"].alias("kind"), found["stop"].alias("stop"), (enc * LENGTHS + length_class).alias("stratum"), p.alias("p"))


def bin_of(p: Column) -> Column:
    """Bins of a quarter of a decade; bin b holds p from 10 ** (-(b + 1) / 4) to 10 ** (-b / 4)."""
    return F.least(F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(BINS - 1)).cast("int")


def rejected_bins(counts: list, fdr: float) -> dict[int, int]:
    """By stratum the first bin that is rejected: the Benjamini-Hochberg rule with each bin's largest p."""
    by: dict[int, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    out = {}
    for stratum, bins in by.items():
        total, below = sum(bins.values()), 0
        out[stratum] = BINS
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / 4) <= below * fdr / total:
                out[stratum] = b
    return out


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    text = F.col("text")
    shares = letter_shares(texts(docs))

    def where(guard: str, found: Column) -> Column:
        return F.when(text.rlike(guard), found).otherwise(F.expr(NONE_SQL))

    scanned = texts(docs).select(
        "doc_id",
        F.array_sort(
            F.concat(
                where("(?i:passw(?:or)?d|secret|token|api_?key)", located(text, ASSIGN, 0, 6)),
                where("AKIA[A-Z0-9]{16}", located(text, ACCESS, 1)),
                where("[0-9a-f]{24}", located(text, HEX, 2)),
            )
        ).alias("base"),
        F.transform(where(RANDOM, located(text, RANDOM, 3)), lambda x: battery(x, shares)).alias("tested"),
    )
    scanned = scanned.select("doc_id", F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))).alias("base"), "tested")
    scanned = materialize(scanned, "secret-spans")
    one = scanned.select(F.explode("tested").alias("t"))
    counts = one.groupBy(F.col("t.stratum").alias("stratum"), bin_of(F.col("t.p")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = rejected_bins(counts, fdr)
    table_of_cuts = F.array(*[F.lit(cuts.get(s, BINS)) for s in range((len(ENCODINGS) + 1) * LENGTHS)])
    stays = F.filter("tested", lambda t: bin_of(t["p"]) >= F.element_at(table_of_cuts, t["stratum"] + 1))
    added = F.transform(stays, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["stop"].alias("stop")))
    names = F.array(*map(F.lit, KINDS))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size(added).cast("long").alias("n_random"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", added))).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
