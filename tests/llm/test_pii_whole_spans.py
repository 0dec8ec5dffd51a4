import random

from seriesforge.llm import pii as P

TOKEN = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789_-", k=900))
CASES = [
    (f"token={TOKEN} end", "[SECRET] end", ["secret"]),
    (f"token={TOKEN[:200]} end", "[SECRET] end", ["secret"]),
    ("a api_key=prod-10.0.0.1-9f3c2b7a8d z", "a [SECRET] z", ["secret", "ip"]),
    ("password=joe_smith-2024x@mail.com z", "[SECRET] z", ["secret", "email"]),
    ("mail secret=abcdefghijklm@x.yz", "mail [SECRET]", ["secret", "email"]),
    ("phone +1 (555) 123-4567 end", "phone [PHONE] end", ["phone"]),
]


def test_no_rest_of_a_secret_stays(spark):
    found = P.find_pii(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string"))
    got = {r.doc_id: (r.t, [s.kind for s in r.spans]) for r in found.select("doc_id", "spans", P.redacted(found).alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]
