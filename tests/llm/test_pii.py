import hashlib
import random
import re

from scholia.llm.pii import KINDS, added_spans, base_spans, detector, find_pii, luhn, redact_pii, spell

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d or "0"), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab1.2 @+-()9%\néß") for _ in range(r.randint(0, 70)))
        assert base_spans(t) == plain(t)
    assert base_spans("a" * 200_000 + "@" * 1000 + "1" * 200_000 + ".") == []


def test_method_adds_what_the_patterns_miss_and_leaves_numbers():
    model, cut = detector()
    add = lambda t: [(KINDS[k], t[a:b]) for a, k, b in added_spans(t, base_spans(t), model, cut)]
    assert add("mail john.doe [at] example [dot] com now") == [("email", "john.doe [at] example [dot] com")]
    assert add("call me at (555) 123-4567 please") == [("phone", "(555) 123-4567")]
    for t in ("order 2020-12-11 in 1998", "version 1.2.3", "pages 120-125", "isbn 978-3-16-148410-0", "in 1999 12 people", "licensed under version 3.0"):
        assert add(t) == []


def test_rows(spark):
    texts = [None, "", "no digits at all", "Ünï a.b@c.de, 10.0.0.1 999.1.1.1 and 4111 1111 1111 1111 +1 (555) 123-4567.", "7" * 100_000, "x " * 60_000 + "a@b.co"]
    df = spark.createDataFrame([(i, t, "q", "z") for i, t in enumerate(texts)] + [(3, texts[3], "q", "z"), (None, "a@b.co", "q", "z")], "doc_id long, text string, spans string, _x string")
    rows = find_pii(df).collect()
    assert len(rows) == 8
    for r in rows:
        t = (texts[r["doc_id"]] or "") if r["doc_id"] is not None else "a@b.co"
        base = plain(t) if len(t) < 5000 else base_spans(t)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(spell(base).encode()).hexdigest() and set(spell(base).split(",")) <= set(r["spans"].split(",")) | {""}
    red = {r["doc_id"]: r for r in redact_pii(df).where("doc_id is not null").collect()}
    assert red[3]["text"] == "Ünï <EMAIL>, <IP> 999.1.1.1 and <CARD> <PHONE>." and red[0]["text"] is None and red[2]["text"] == texts[2] and red[3]["spans"] == "q"
    assert find_pii(df.where("false")).collect() == []
