"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions propose candidate spans. Three labelers vote on each: a regex labeler (a strict form of the kind), a
gazetteer labeler (known top domains, country codes, issuer digits, reserved networks) and a context labeler (words before
the span). Spans of all documents are counted by kind, the three votes and what the classifier sees besides: length, the
signs that part the span, the characters on both sides. These counts have at most PATTERNS rows whatever the corpus. From
the votes expectation-maximisation estimates each labeler's reliability and a posterior. A logistic span classifier is
trained on the posteriors with features of the span's text and surroundings, by kind, beside the votes. It decides which
candidates beyond the base ones are spans; those of the base kinds always are.

Base kinds: email, ip, card, phone. Further kinds: mailat (an address written out), ssn, account (a long number that is no
card).

Defined cases: a null text is an empty one, without spans; a very long text takes time in proportion to its length and its
matches; spans of several kinds may overlap; equal rows have equal spans; an empty table gives no rows; only doc_id and
text are read, so other columns may have any names (redact keeps every column).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import spans as S
from keyloom.llm.common import read_table, stored

BASE = ("email", "ip", "card", "phone")
EXTRA = ("mailat", "ssn", "account")
#: Kinds, votes, lengths, parting signs, left and right sides: the most patterns that can be counted.
PATTERNS = 7 * 27 * 5 * 5 * 4 * 3

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The number patterns enter a run of digits at its first digit only; it makes no other match elsewhere.
_RUN = r"(?<![0-9])(?<![0-9][\x20-])"
KINDS: list[S.Kind] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("number", _RUN + r"[0-9](?:[\x20-]?[0-9]){8,18}+(?![\x20-]?[0-9])", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("mailat", r"(?<![A-Za-z0-9._])[A-Za-z0-9]++(?:[._][A-Za-z0-9]++)*+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]++)++", "(at) [at] (AT) [AT]"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
]

# What the gazetteer and context labelers know.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us|ca|au|jp|br|in"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-3]"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]"
RESERVED = r"0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "mailat": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|login|from",
    "card": "card|visa|master|amex|pay|credit|karte|carte|tarjeta",
    "account": "account|iban|konto|cuenta|compte|passport|customer",
    "phone": "phone|call|tel|mobile|fax|whatsapp|handy|anruf",
    "ssn": "ssn|social|security",
}
AGAINST = r"version|release|isbn|issn|invoice|order|serial|build|\brev|ticket|timestamp"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)),
    )
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def between(number: Column, least: int, most: int) -> Column:
    return (F.length(number) >= least) & (F.length(number) <= most)


def candidates(docs: DataFrame) -> DataFrame:
    """docs and one column of spans for each kind; base kinds hold base spans only."""
    found = S.with_spans(docs, KINDS)
    octets = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
    card = lambda m: between(digits(m), 14, 19) & luhn(digits(m))
    return found.select(
        *docs.columns,
        "email",
        S.kept(F.col("ip"), lambda m: F.rlike(m, F.lit(octets))).alias("ip"),
        S.kept(F.col("number"), card).alias("card"),
        S.kept(F.col("phone"), lambda m: between(digits(m), 10, 15)).alias("phone"),
        "mailat",
        "ssn",
        S.kept(F.col("number"), lambda m: ~card(m)).alias("account"),
    )


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, 2 against, 0 no opinion."""
    out = F.when(yes, F.lit("1"))
    return (out.when(no, F.lit("2")) if no is not None else out).otherwise(F.lit("0"))


def labelers(kind: str, span: Column) -> list[Column]:
    m, before = span["match"], span["before"]
    rlike = lambda c, p: F.rlike(c, F.lit(p))
    d = digits(m)
    regex = {
        "email": lambda: vote(rlike(m, r"\A[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"), rlike(m, r"\.[0-9]+\z")),
        "mailat": lambda: vote(rlike(m, r"[A-Za-z]{2,}\z"), rlike(m, r"[0-9]\z")),
        "ip": lambda: vote(~rlike(m, r"(?:\A|\.)0[0-9]"), rlike(m, r"(?:\A|\.)0[0-9]")),
        "card": lambda: vote(rlike(m, r"\A(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]+)\z"), rlike(m, r"[0-9][ -][0-9][ -]")),
        "account": lambda: vote(rlike(m, r"\A[0-9]{10,12}\z"), rlike(m, r"[ -]")),
        "phone": lambda: vote(rlike(m, r"\A\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}\z"), rlike(m, r"[ .-]{3}")),
        "ssn": lambda: vote(~rlike(m, r"\A(?:000|666|9)|-00-|-0000\z"), rlike(m, r"\A(?:000|666|9)|-00-|-0000\z")),
    }[kind]()
    gazetteer = {
        "email": lambda: vote(rlike(m, rf"(?i)\.(?:{TOP_DOMAINS})\z")),
        "mailat": lambda: vote(rlike(m, rf"(?i)(?:{TOP_DOMAINS})\z")),
        "ip": lambda: vote(~rlike(m, rf"\A(?:{RESERVED})\."), rlike(m, rf"\A(?:{RESERVED})\.")),
        "card": lambda: vote(rlike(d, rf"\A(?:{ISSUERS})")),
        "account": lambda: vote(F.lit(False), rlike(d, r"\A(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])|(.)\1{5}|123456")),
        "phone": lambda: vote(rlike(d, rf"\A(?:{COUNTRY_CODES})"), rlike(d, r"\A0")),
        "ssn": lambda: vote(F.lit(False), rlike(d, r"(.)\1{5}|123456789")),
    }[kind]()
    return [regex, gazetteer, vote(rlike(before, CUES[kind]), rlike(before, AGAINST))]


def seen(span: Column) -> list[Column]:
    """What the classifier sees beside the votes: buckets of length, parting signs, left and right side."""
    m, before, after = span["match"], F.coalesce(span["before"], F.lit("")), F.coalesce(span["after"], F.lit(""))
    signs = F.regexp_replace(m, r"[^ .()\[\]-]", "")
    parting = (
        F.when(signs == "", "0").when(F.rlike(signs, F.lit(r"\A\x20+\z")), "1").when(F.rlike(signs, F.lit(r"\A-+\z")), "2")
        .when(F.rlike(signs, F.lit(r"\A\.+\z")), "3").otherwise("4")
    )
    left = (
        F.when(F.rlike(before, F.lit(r"[:=#]\s*\z")), "2").when(F.rlike(before, F.lit(r"(?U)\w\z")), "1")
        .when(F.rlike(before, F.lit(r"\A\z|\s\z")), "0").otherwise("3")
    )
    right = F.when(F.rlike(after, F.lit(r"\A\z|\s")), "0").when(F.rlike(after, F.lit(r"[.,;:!?)\]\"']")), "1").otherwise("2")
    return [F.least(F.floor((span["end"] - span["start"]) / 8), F.lit(4)).cast("string"), parting, left, right]


def pattern_of(kind: str, span: Column) -> Column:
    """kind, votes and what is seen, as a string."""
    return F.concat_ws("|", F.lit(kind), *labelers(kind, span), *seen(span))


def voted(docs: DataFrame) -> DataFrame:
    """docs, with the match and its surroundings replaced by their pattern: array<struct<start, end, from, to, pattern>>."""
    found = candidates(docs)

    def slim(kind: str) -> Column:
        keep = lambda s: F.struct(
            *(s[c].alias(c) for c in ("start", "end", "from", "to")), pattern_of(kind, s).alias("pattern")
        )
        return F.transform(kind, keep).alias(kind)

    return found.select(*docs.columns, *map(slim, BASE + EXTRA))


def counted(rows: DataFrame) -> dict[str, int]:
    """Candidates of all documents by pattern; PATTERNS rows at most."""
    every = F.concat(*(F.transform(k, lambda s: s["pattern"]) for k in BASE + EXTRA))
    got = rows.select(F.explode(every).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    return {r["pattern"]: r["n"] for r in got}


def reliabilities(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over patterns: the posterior of each pattern, and P(vote | labeler, class).

    A labeler's reliability holds for all kinds; each kind has its own share of true spans."""
    names = sorted(counts)
    if not names:
        return {}, np.full((3, 2, 3), 1 / 3)
    kind_names = sorted({n.split("|")[0] for n in names})
    kind = np.array([kind_names.index(n.split("|")[0]) for n in names])
    votes = np.array([[int(v) for v in n.split("|")[1:4]] for n in names])
    n = np.array([counts[x] for x in names], float)
    base = np.array([x.split("|")[0] in BASE for x in names])
    post = np.where(base, 0.9, 0.5) + 0.2 * ((votes == 1).sum(1) - (votes == 2).sum(1)) / 3
    post = np.clip(post, 0.05, 0.95)
    given = np.zeros((3, 2, 3))  # labeler, class, vote
    for _ in range(rounds):
        share = np.array([(post * n)[kind == k].sum() + 1 for k in range(len(kind_names))])
        share /= np.array([n[kind == k].sum() + 2 for k in range(len(kind_names))])
        for i in range(3):
            for v in range(3):
                own = votes[:, i] == v
                given[i, 1, v], given[i, 0, v] = (post * n)[own].sum() + 1, ((1 - post) * n)[own].sum() + 1
        given /= given.sum(2, keepdims=True)
        logit = np.log(share / (1 - share))[kind]
        for i in range(3):
            logit = logit + np.log(given[i, 1, votes[:, i]] / given[i, 0, votes[:, i]])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(names, post.tolist(), strict=True)), given


#: Values of each part of a pattern after the kind.
SIZES = (3, 3, 3, 5, 5, 4, 3)


def features(pattern: str) -> np.ndarray:
    """Indicators: the kind, each part's value, and each part's value with the kind."""
    kind, *parts = pattern.split("|")
    own = [float(int(p) == v) for p, size in zip(parts, SIZES, strict=True) for v in range(size)]
    out = [float(kind == k) for k in BASE + EXTRA]
    return np.array([*out, *own, *(x * y for x in out for y in own), 1.0])


def classifier(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each pattern by a logistic classifier trained on the posteriors, weighed by count."""
    post, _ = reliabilities(counts)
    if not post:
        return {}
    names = sorted(post)
    x = np.array([features(n) for n in names])
    y = np.array([post[n] for n in names])
    n = np.array([counts[k] for k in names], float)
    n *= len(n) / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (n * (p - y)) + 1e-2 * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def decided(rows: DataFrame, model: dict[str, float]) -> DataFrame:
    """rows with the kept spans as base and spans: array<struct<start, rank, end, kind, from, to>>, ordered."""
    good = sorted(p for p, x in model.items() if x >= 0.5 and p.split("|")[0] in EXTRA)
    accept = F.array(*map(F.lit, good)) if good else F.array().cast("array<string>")
    taken = [(k, F.filter(k, lambda s: F.array_contains(accept, s["pattern"]))) for k in EXTRA]
    base = [(k, F.col(k)) for k in BASE]
    names = [c for c in rows.columns if c not in BASE + EXTRA]
    return rows.select(*names, *BASE, S.ordered(base).alias("base"), S.ordered(base + taken).alias("spans"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the base kinds' spans, base and spans."""
    rows = stored(voted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text"))
    return decided(rows, classifier(counted(rows)))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, with [KIND] in the place of each span; overlapping spans become one.

    Rows and votes are stored, so each text is searched once."""
    named = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    rows = stored(voted(named).drop("text"))
    found = decided(rows, classifier(counted(rows))).select("row", "spans")

    part = lambda first, end: f"cast(substr(raw, cast({first} + 1 as int), cast({end} - {first} as int)) as string)"
    # reach: how far the spans before each one go, in bytes
    piece = f"if(s.from >= get(reach, i), concat({part('get(reach, i)', 's.from')}, '[', upper(s.kind), ']'), '')"
    last = part("array_max(spans.to)", "octet_length(raw)")
    masked = f"concat(array_join(transform(spans, (s, i) -> {piece}), ''), {last})"
    reach = S.running("transform(spans, s -> s.to)", "greatest(acc.at, x)")
    masked = S.let("raw", "cast(cast(row.text as string) as binary)", S.let("reach", reach, masked))
    text = F.expr(f"if(size(spans) > 0, {masked}, cast(row.text as string))").cast(docs.schema["text"].dataType)
    done = found.select("row", text.alias("masked"))
    return done.select(*((F.col("masked") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(F.col("spans")).alias("spans"),
    )
