"""Personal data: certain spans by rule, further spans by weak supervision.

Base spans (e-mail, address, card, phone) come from fixed patterns with their checks
and always stay. Further candidates, credential-like runs of letters and digits, are
voted on by labelers: a regex for known shapes, a gazetteer of words before the run, the
context right before it, and the mix of its characters. Votes are counted per pattern in
Spark; expectation-maximisation over these counts (at most 3^4 rows, whatever the
input) estimates how reliable each labeler is, without labels. Its posteriors then
train the final span classifier, a naive Bayes model over a span's features, whose
statistics are one aggregate and which is compiled into a Column.

Everything is SQL expressions. A match's place comes from cutting the text at the matches:
running sums over the lengths of what lies between them, one pass per kind.

Defined results: a null text is empty and has no spans; repeated rows keep one row each;
without candidates the classifier accepts what most labelers vote for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import documents, with_starts
from panelyard.sources.store import materialise

SPAN = "struct<kind:string,start:bigint,end:bigint>"
ROUNDS = 30


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap sign that it may occur, and the check of a match ``m``."""

    name: str
    pattern: str
    sign: str
    check: object


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Sixteen to nineteen digits whose weighted sum is a multiple of ten."""
    d = F.lpad(_digits(m), 20, "0")
    total = F.lit(0)
    for i in range(20):
        c = F.substring(d, i + 1, 1)
        total = total + (c if i % 2 else F.translate(c, "0123456789", "0246813579")).cast("int")
    return F.length(_digits(m)).between(16, 19) & (total % 10 == 0)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The base patterns, in the order of their kinds. Possessive repeats and the
# looks behind change no match; they keep long runs linear and off the JVM's stack.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
                  r"(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True)),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
         lambda m: F.length(_digits(m)).between(8, 15)),
)
MORE = "secret"
#: Runs that may be credentials: sixteen characters or more with a letter and a digit.
CANDIDATE = (r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])"
             r"[A-Za-z0-9_-]{16,}+(?![@A-Za-z0-9_-])")
BEFORE = 32   # code points before a candidate that the gazetteer and the context see
# Words that announce a credential.
GAZETTEER = ("access", "api", "apikey", "auth", "bearer", "credential", "key", "passwd",
             "password", "pwd", "secret", "token")

# Labelers: name -> vote of a candidate ``c`` (1 private, 0 not, null abstains).
LABELERS = {
    "shape": lambda c: F.when(c["text"].rlike(
        "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|AKIA)[_-]?[A-Za-z0-9]{12,})$"), 1)
    .when(c["text"].rlike("[A-Za-z]{12,}"), 0),
    "gazetteer": lambda c: F.when(F.lower(c["before"]).rlike(
        r"(?:^|[^a-z])(?:" + "|".join(GAZETTEER) + r")(?![a-z])"), 1).otherwise(0),
    "context": lambda c: F.when(c["before"].rlike("[:=]\\s*[\"']?$"), 1)
    .when(c["before"].rlike(r"[/#.]$"), 0),
    "mix": lambda c: F.when(F.length(_digits(c["text"])) * 5 >= F.length(c["text"]), 1).otherwise(0),
}

# Features of the span classifier: name -> small integer.
FEATURES = {
    "length": lambda c: F.least(F.floor(F.length(c["text"]) / 8), F.lit(10)),
    "digits": lambda c: F.floor(F.length(_digits(c["text"])) * 10 / F.length(c["text"])),
    "hex": lambda c: c["text"].rlike("^[0-9a-fA-F]+$").cast("int"),
    "dashes": lambda c: F.least(F.length(F.regexp_replace(c["text"], "[^_-]", "")), F.lit(5)),
    "upper": lambda c: c["text"].rlike("[A-Z]").cast("int"),
    "announced": lambda c: LABELERS["gazetteer"](c),
    "assigned": lambda c: c["before"].rlike("[:=]\\s*[\"']?$").cast("int"),
}


def located(df: DataFrame, name: str, pattern: str, sign: str) -> DataFrame:
    """Add ``name``: array of (text, start) of the leftmost non-overlapping matches."""
    there = F.col("text").rlike(sign)
    found = F.when(there, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(
        F.array().cast("array<string>"))
    out = df.withColumn("_found", found)
    out = out.withColumn("_between", F.when(F.size("_found") > 0, F.split("text", pattern, -1))
                         .otherwise(F.array().cast("array<string>")))
    # One size for each match with the stretch before it; its start is the end less itself.
    sizes = F.transform("_found", lambda m, i: (F.length(m) + F.length(F.col("_between")[i]))
                        .cast("long"))
    out = with_starts(out.withColumn("_sizes", sizes), "_sizes", "_starts")
    spans = F.transform("_found", lambda m, i: F.struct(
        m.alias("text"), (F.col("_starts")[i] + F.length(F.col("_between")[i])).alias("start")))
    return out.withColumn(name, spans).drop("_found", "_between", "_sizes", "_starts")


def with_base(docs: DataFrame) -> DataFrame:
    """Add one array of checked spans per base kind."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for k in BASE:
        out = located(out, k.name, k.pattern, k.sign)
        good = F.filter(k.name, lambda m: k.check(m["text"]))
        out = out.withColumn(k.name, F.transform(good, lambda m: F.struct(
            F.lit(k.name).alias("kind"), m["start"].alias("start"),
            (m["start"] + F.length(m["text"])).alias("end"))))
    return out


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add ``candidates``: (text, start, before, features...) of possible further spans."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = located(out, "_c", CANDIDATE, CANDIDATE)
    seen = F.transform("_c", lambda c: F.struct(
        c["text"].alias("text"), c["start"].alias("start"),
        F.substring("text", F.greatest(c["start"] - BEFORE, F.lit(0)).cast("int") + 1,
                    F.least(c["start"], F.lit(BEFORE)).cast("int")).alias("before")))
    return out.withColumn("candidates", seen).drop("_c")


@dataclass(frozen=True)
class Reliability:
    """Share of private spans, and each labeler's rates of 1 and 0 votes on either class."""

    prior: float
    rates: dict[str, dict[int, dict[int | None, float]]]

    def posterior(self, votes: dict[str, int | None]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for name, v in votes.items():
            odds += math.log(self.rates[name][1][v] / self.rates[name][0][v])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def estimate(patterns: list[tuple[dict, int]], rounds: int = ROUNDS) -> Reliability:
    """EM over (votes, count) rows; labelers start out as better than chance."""
    names = list(LABELERS)
    start = {1: {1: 0.7, 0: 0.15, None: 0.15}, 0: {1: 0.15, 0: 0.7, None: 0.15}}
    now = Reliability(0.5, {n: start for n in names})
    for _ in range(rounds if patterns else 0):
        mass = {0: 0.0, 1: 0.0}
        seen = {n: {c: {1: 1.0, 0: 1.0, None: 1.0} for c in (0, 1)} for n in names}
        for votes, count in patterns:
            p = now.posterior(votes)
            for c, share in ((1, p), (0, 1 - p)):
                mass[c] += share * count
                for n in names:
                    seen[n][c][votes[n]] += share * count
        rates = {n: {c: {v: x / sum(seen[n][c].values()) for v, x in seen[n][c].items()}
                     for c in (0, 1)} for n in names}
        now = Reliability((mass[1] + 1) / (mass[0] + mass[1] + 2), rates)
    return now


def _posterior_column(model: Reliability) -> Column:
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for n in LABELERS:
        def of(v, n=n):
            return math.log(model.rates[n][1][v] / model.rates[n][0][v])
        odds = odds + F.when(F.col(n) == 1, of(1)).when(F.col(n) == 0, of(0)).otherwise(of(None))
    return 1 / (1 + F.exp(-odds))


@dataclass(frozen=True)
class Classifier:
    """Log odds per (feature, value), and where a span counts as private."""

    bias: float
    weights: dict[str, dict[int, float]]
    reliability: Reliability

    def accepts(self, c: Column) -> Column:
        odds = F.lit(self.bias)
        for name, feature in FEATURES.items():
            value, part = feature(c), None
            for v, w in sorted(self.weights.get(name, {}).items()):
                part = F.when(value == v, w) if part is None else part.when(value == v, w)
            if part is not None:
                odds = odds + part.otherwise(0.0)
        return odds > 0


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Labelers' votes -> EM -> posteriors -> naive Bayes, from all texts."""
    docs = with_candidates(documents(df, id_col, text_col))
    rows = docs.select(F.explode("candidates").alias("c"))
    rows = materialise(rows.select(*[f(F.col("c")).cast("int").alias(n) for n, f in LABELERS.items()],
                                   *[f(F.col("c")).cast("int").alias(f"f_{n}")
                                     for n, f in FEATURES.items()]), "pii-votes")
    votes = rows.groupBy(*LABELERS).agg(F.count("*").alias("n")).collect()  # 3^labelers at most
    model = estimate([({n: r[n] for n in LABELERS}, r["n"]) for r in votes])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"f_{n}").alias("value"))
                                for n in FEATURES])).alias("f")
    soft = rows.withColumn("p", _posterior_column(model)).select("p", pairs)
    stats = soft.groupBy("f.name", "f.value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # few small integers
    per = {n: [r for r in stats if r["name"] == n] for n in FEATURES}
    one = per[next(iter(FEATURES))]
    yes, no = sum(r["yes"] for r in one) + 1, sum(r["no"] for r in one) + 1
    weights = {n: {r["value"]: math.log((r["yes"] + 0.5) / (yes + 0.5 * len(rs)))
                   - math.log((r["no"] + 0.5) / (no + 0.5 * len(rs))) for r in rs}
               for n, rs in per.items()}
    if not stats:  # nothing to learn from: announced or assigned runs count
        weights = {"announced": {1: 1.0}, "assigned": {1: 1.0}}
        return Classifier(-0.5, weights, model)
    return Classifier(math.log(yes / no), weights, model)


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         classifier: Classifier | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, text, n_<kind>, base and all spans (arrays in code points)."""
    classifier = classifier or fit(df, id_col, text_col)
    docs = documents(df, id_col, text_col, **{f"_k{i}": c for i, c in enumerate(keep)})
    out = with_candidates(with_base(docs))
    more = F.transform(F.filter("candidates", classifier.accepts), lambda c: F.struct(
        F.lit(MORE).alias("kind"), c["start"].alias("start"),
        (c["start"] + F.length(c["text"])).alias("end")))
    kinds = [k.name for k in BASE]
    out = out.select(
        "doc_id", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.concat(*kinds).alias("base_spans"), more.alias("_more"))
    return out.withColumn("spans", F.concat("base_spans", "_more")).drop("_more")


def digests(found: DataFrame) -> DataFrame:
    kinds = [f"n_{k.name}" for k in BASE]
    return found.select("doc_id", *kinds, F.sha2(_join(F.col("base_spans")), 256)
                        .alias("base_sha256"), _join(F.col("spans")).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by its kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a, s):
        clear = F.concat(a["out"], F.substring(
            text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= a["at"], clear).otherwise(a["out"]).alias("out"))

    done = F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substring(
        text, a["at"].cast("int") + 1, F.greatest(F.length(text) - a["at"], F.lit(0)).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def masked_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns as they are, personal data in the text replaced by its kind."""
    names = [f"c{i}" for i in range(len(df.columns))]
    by = dict(zip(df.columns, names))
    found = find(df.toDF(*names), by[id_col], by[text_col], keep=tuple(names))
    clean = F.when(F.col(by[text_col]).isNotNull(), mask(F.col("text"), F.col("spans")))
    return found.select(*[clean.alias(n) if c == text_col else F.col(n)
                          for c, n in by.items()]).toDF(*df.columns)
