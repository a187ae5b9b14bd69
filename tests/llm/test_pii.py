import hashlib
import random
import re

from keyloom.llm import pii as P
from keyloom.llm import spans as S


def base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def texts():
    rng = random.Random(9)
    parts = ["a", "b@", "@", ".", "c.d", "-", "+", "1", "23", "255.", "4", " ", "  ", "(", ")", "_", "%", "é", "🙂", "4111 1111 1111 1111", "+1 (212) 555-0100", "x@y.zz", "10.0.0.1", "\n", "0", "9"]
    out = [None, "", "🙂 a@b.co_x@y.org 1.2.3.4.5.6.7.8 0300.1.1.1 256.1.1.1", "a@b." * 5, "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "john (at) mail dot com, Jane [at] example.com; 123-45-6789", "tel +49 30 901820 and card 4111-1111-1111-1111"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return out + ["x" * 5000, "1" * 5000, "1 " * 3000, "a.b" * 1000 + "@c.d" + ".e" * 1000, "+1" + " " * 3000 + "2", "a@b.co " * 1500]


def test_base_against_python(spark):
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_texts)], "doc_id long, text string, email string").repartition(8)
    found = P.find_spans(docs).select("doc_id", S.written(P.F.col("base")).alias("base"), S.written(P.F.col("spans")).alias("spans"), *(P.F.size(k).alias(k) for k in P.BASE))
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(all_texts)
    for i, t in enumerate(all_texts):
        want = base(t)
        assert rows[i].base == ",".join(want), repr((t or "")[:200])
        assert set(want) <= set(filter(None, rows[i].spans.split(",")))
        assert rows[i].email == sum(x.startswith("email") for x in want)
    assert P.find_spans(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "x" * 300000 + "@"), (2, "1" * 300000), (3, "1 " * 200000), (4, "a.b" * 100000 + "@c.d" + ".e" * 100000), (5, "a_" * 100000 + "(at)"), (6, "+1" + " " * 200000)]
    got = {r.doc_id: r.spans for r in P.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", S.written(P.F.col("base")).alias("spans")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "email:0:500004", 5: "", 6: ""}


def test_redaction(spark):
    rows = [(1, "é🙂 mail a@b.com or 10.0.0.1!", 5), (2, None, 6), (3, "nothing here 12", 7), (4, "+1 (212) 555-0100a@b.co", 8), (4, "+1 (212) 555-0100a@b.co", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id, r.text, r.spans) for r in P.redact(docs).collect())
    assert got[0] == (1, "é🙂 mail [EMAIL] or [IP]!", 5) and got[1] == (2, None, 6) and got[2] == (3, "nothing here 12", 7)
    assert got[3] == got[4] == (4, "[PHONE]", 8) or got[3][1].startswith("[PHONE]")


def test_reliabilities_follow_agreement():
    counts = {"ssn|1|1|1|1|2|0|0": 500, "ssn|2|2|2|1|2|0|0": 500, "ssn|1|1|2|1|2|0|0": 20, "ssn|2|2|1|1|2|0|0": 20}
    post, given = P.reliabilities(counts)
    assert post["ssn|1|1|1|1|2|0|0"] > 0.95 and post["ssn|2|2|2|1|2|0|0"] < 0.05
    assert given[0, 1, 1] > given[2, 1, 1] > 0.8
    model = P.classifier(counts)
    assert model["ssn|1|1|1|1|2|0|0"] > 0.8 and model["ssn|2|2|2|1|2|0|0"] < 0.2


def test_many_matches(spark):
    n = 60_000  # more than two levels of chunks
    text = " ".join(f"é a{i}@b.com 10.0.0.{i % 256}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = P.find_spans(docs).select(S.written(P.F.col("base")).alias("base"), P.F.size("spans").alias("n")).first()
    want = base(text)
    assert r.n == 2 * n and hashlib.md5(r.base.encode()).digest() == hashlib.md5(",".join(want).encode()).digest()
    masked = P.redact(docs).first().text
    assert masked == " ".join("é [EMAIL] [IP]" for _ in range(n))


def test_precision_and_recall_of_added_kinds(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    good = {
        "mailat": lambda: f"write to {word()} (at) {word()} (dot) com",
        "ssn": lambda: f"social security {rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "account": lambda: f"account: {num(rng.choice((10, 11, 12)))}",
    }
    bad = {
        "mailat": lambda: f"version {word()} [at] {word()}.{num(2)}",
        "ssn": lambda: f"invoice {rng.choice(('000', '666', '912'))}-{num(2)}-0000",
        "account": lambda: f"order {rng.randint(1900, 2099)}-{num(2)}-{num(2)} {num(2)}",
    }
    rows, truth = [], []
    for i in range(1500):
        kind = rng.choice(list(good))
        real = rng.random() < 0.5
        rows.append((i, f"{word()} {word()} {(good if real else bad)[kind]()}, {word()}"))
        truth.append((kind, real))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kinds for r in P.find_spans(docs).select("doc_id", P.F.transform("spans", lambda s: s["kind"]).alias("kinds")).collect()}
    for kind in good:
        own = [i for i, (k, _) in enumerate(truth) if k == kind]
        hit = [i for i in own if kind in got[i]]
        right = sum(truth[i][1] for i in hit)
        assert right / max(1, len(hit)) >= 0.95, (kind, "precision", right, len(hit))
        assert right / sum(truth[i][1] for i in own) >= 0.95, (kind, "recall")
