"""Secrets in whole texts, with DataFrame functions only.

Known forms are found by pattern. Other secrets are found by entropy: candidate strings, maximal runs of CANDIDATE or more
letters, digits and a few signs with at least a letter and a digit, fall in a character class. A window of WINDOW
characters slides over a candidate; when a character enters or leaves, its count in the window changes by one and the sum
of count * log2(count) by the difference, so the Shannon entropy of each window follows from the last one. A candidate
whose highest window reaches the bound of its class is a span, unless an allow list suppresses it or a known form already
covers a part of it. Windows that reach into a long word are left out; those before and after it count.

Kinds: assign, access, hex (known forms), entropy.

Defined cases: a null text is an empty one, without spans; a very long text takes time in proportion to its length and its
matches; spans of several kinds may overlap; equal rows have equal spans;
an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import spans as S
from keyloom.llm.common import read_table

BASE = ("assign", "access", "hex")
CANDIDATE, WINDOW = 20, 20
#: Classes in order of trial: name, what a candidate consists of, bits of a window's entropy from which it is a secret.
CLASSES = (
    ("hex", r"\A[0-9a-fA-F]+\z", 3.1),
    ("upper", r"\A[0-9A-Z]+\z", 3.6),
    ("lower", r"\A[0-9a-z]+\z", 3.6),
    ("alphanumeric", r"\A[0-9A-Za-z]+\z", 3.7),
    ("base64", r"\A[0-9A-Za-z+/=_-]+\z", 3.8),
)
# What a harmless candidate holds, and what harmless digests are announced by.
ALLOWED = r"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|0{8}|12345678|abcdef0123|deadbeef|lorem"
# Letters of one case that can be words: no five consonants in a row. They only take themselves out of a candidate.
WORD = r"(?:(?![b-df-hj-np-tv-xz]{5})[a-z]){14,}+|(?:(?![B-DF-HJ-NP-TV-XZ]{5})[A-Z]){14,}+"
ALLOWED_BEFORE = r"(?:sha-?[0-9]+|md5|commit|checksum|digest|integrity|uuid|etag|rev(?:ision)?)\W*\z"

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_SIGN = r"""["']?\x20*+[:=]\x20*+["']?"""
KINDS: list[S.Kind] = [
    ("assign", _KEY + _SIGN + r"[A-Za-z0-9+/_.=-]++", ""),
    ("access", r"AKIA[A-Z0-9]++", "AKIA"),
    ("hex", r"[0-9a-f]{32,}+", ""),
    ("candidate", rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{CANDIDATE},}}+", ""),
]


def _term(count: str) -> str:
    """SQL of count * log2(count), 0 for 0."""
    return f"if({count} > 1, {count} * log2({count}), 0D)"


#: The count of a character stands in a text of counts at the place of its code less FIRST; no count is character ZERO.
FIRST, LAST, ZERO = ord("+") - 1, ord("z"), ord("!")


def highest_entropy(text: str, window: int = WINDOW) -> str:
    """SQL of the highest Shannon entropy, in bits, of any window characters of a candidate at least that long.

    counts holds a count for each possible character; a step changes those of the character that enters and of the one that
    leaves, whatever the window's size. A window holds 90 characters at most, so that counts stay ASCII."""
    if not 1 <= window <= 90:
        raise ValueError("a window has 1 to 90 characters")

    def moved(state: str, char: str, by: int) -> str:
        """total and counts with a character more or less."""
        change = f"named_struct('total', {state}.total - {_term('n')} + {_term(f'(n + {by})')}, "
        change += f"'counts', overlay({state}.counts placing char(n + {by + ZERO}) from at for 1))"
        count = f"ascii(substr({state}.counts, at, 1)) - {ZERO}"
        return S.let("at", f"ascii({char}) - {FIRST}", S.let("n", count, change))

    entropy = f"if(i >= {window}, log2({window}D) - now.total / {window}D, 0D)"
    measured = f"named_struct('total', now.total, 'best', greatest(acc.best, {entropy}), 'counts', now.counts)"
    left = f"if(i > {window}, {moved('acc', f'get(chars, i - 1 - {window})', -1)}, named_struct('total', acc.total, 'counts', acc.counts))"
    step = S.let("gone", left, S.let("now", moved("gone", "get(chars, i - 1)", 1), measured))
    start = f"named_struct('total', 0D, 'best', 0D, 'counts', '{chr(ZERO) * (LAST - FIRST)}')"
    return S.let("chars", f"split({text}, '')", f"aggregate(sequence(1, size(chars)), {start}, (acc, i) -> {step}, acc -> acc.best)")


def suspicious(span: str) -> str:
    """SQL of whether a candidate, a struct of match and before, is a secret."""
    bound = " ".join(f"when rlike({span}.match, r'{form}') then {bits}D" for _, form, bits in CLASSES)
    allowed = f"(rlike({span}.match, r'{ALLOWED}') or rlike({span}.before, r'{ALLOWED_BEFORE}'))"
    parts = f"filter(split({span}.match, r'{WORD}', -1), part -> length(part) >= {WINDOW})"
    high = f"exists({parts}, part -> {highest_entropy('part')} >= bound)"
    return f"if({allowed}, false, {S.let('bound', f'case {bound} end', high)})"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the known forms' spans, and entropy's."""
    found = S.with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), KINDS)
    value = lambda m: F.length(m) - F.length(F.regexp_extract(m, r"\A" + _KEY + _SIGN, 0))
    known = found.select(
        "doc_id",
        S.kept(F.col("assign"), lambda m: value(m) >= 8).alias("assign"),
        S.kept(F.col("access"), lambda m: F.length(m) >= 16).alias("access"),
        "hex",
        "candidate",
    )

    # a kind's spans don't overlap, so the last that starts before a candidate's end reaches farthest
    reach = lambda k: f"coalesce({S.last_before(k, 's.end')}.end > s.start, false)"
    covered = " or ".join(f"(size({k}) > 0 and {reach(k)})" for k in BASE)
    free = known.select("doc_id", *BASE, F.expr(f"filter(candidate, s -> not ({covered}))").alias("candidate"))
    return free.select("doc_id", *BASE, F.expr(f"filter(candidate, s -> {suspicious('s')})").alias("entropy"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    base = [(k, F.col(k)) for k in BASE]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(S.written(S.ordered(base)), 256).alias("base_sha256"),
        S.written(S.ordered([*base, ("entropy", F.col("entropy"))])).alias("spans"),
    )
