import hashlib
import random
import re

from seriesforge.llm import pii as P
from seriesforge.llm.queries import QUERIES

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(RAW.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def with_luhn(r, n):
    d = [r.randint(0, 9) for _ in range(n - 1)]
    return next("".join(map(str, d)) + str(c) for c in range(10) if luhn("".join(map(str, d)) + str(c)))


def texts():
    r = random.Random(4)
    out = ["", None, "a@b.c-_x@d.e a@b @c.d x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255", "ü😀 joe@ä.com me@x.io 😀", "+1 (017) 555-7713 +12 3 +1234567890123456", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "4111  1111", "9" * 3000, "a." * 2000 + "b@c.de", "call 555-123-4567 now", "x 555-123-4567", "IBAN DE89 3704 0044 0532 0130 00.", "DE00 3704 0044 0532 0130 00", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    alphabet = ["1", "2", "9", "0", " ", "-", ".", "+", "@", "a", "b.c", "%", "é", "(", ")", "\n", "x@y.zz", "10.0.0.1", "+44 20 7946 0958"]
    for _ in range(250):
        parts = [r.choice(alphabet) for _ in range(r.randint(1, 40))]
        for _ in range(r.randint(0, 2)):
            card = with_luhn(r, r.randint(12, 20))
            parts.insert(r.randrange(len(parts)), r.choice([card, "-".join(re.findall(".{1,4}", card)), " ".join(re.findall(".{1,4}", card))]))
        out.append("".join(parts))
    return out


def test_base_spans_like_the_plain_patterns(spark, tmp_path):
    data = texts()
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(data)], "doc_id long, text string, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(data):
        want = base(t or "")
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, got[i].spans)
        assert [got[i][f"n_{k}"] for k in RAW] == [sum(w[3] == k for w in want) for k in RAW]
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))


def test_further_kinds_need_checksum_or_context(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[11:16])], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in P.find_pii(df).collect()}
    assert got == {0: ["national"], 1: [], 2: ["iban"], 3: [], 4: ["secret"]}


def test_redaction_and_odd_rows(spark):
    df = spark.createDataFrame([(None, "é a@b.cd, 10.0.0.1 end", 1), (None, "é a@b.cd, 10.0.0.1 end", 1), (3, None, 2)], "doc_id long, text string, kind int")
    found = P.find_pii(df, carry=["kind"])
    got = sorted((r.doc_id or 0, r.t, r.row.kind) for r in found.select("doc_id", P.redacted(found).alias("t"), "row").collect())
    assert got == [(0, "é [EMAIL], [IP] end", 1), (0, "é [EMAIL], [IP] end", 1), (3, "", 2)]
    assert P.find_pii(df.limit(0)).count() == 0
