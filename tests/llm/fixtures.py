"""Small tables with what real ones hold: nulls, empty and long texts, copies, near copies and repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the of and to in is that it for on with as was are be this from or by an " * 2).split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) if r.random() < 0.5 else "".join(r.choice(("ba", "no", "ti", "re", "lu", "ok", "ze")) for _ in range(r.randint(1, 4)))
        out.append(w + (".\n" if r.random() < 0.06 else ""))
    return " ".join(out).replace("\n ", "\n")


def documents():
    a, b = prose(1, 300), prose(2, 180)
    near = a.split(" ")
    near[150] = "changed"
    rows = [(i, prose(10 + i, 20 + 13 * i), "en", f"s{i % 4}") for i in range(20)]
    rows += [(30, a, "en", "s0"), (31, a, "en", "s1"), (32, " ".join(near), "en", "s0"), (33, b + "\n" + a, "en", None)]
    rows += [(40, None, "en", "s0"), (41, "", None, "s1"), (42, " \n\t ", "en", None), (43, "A", "xx", "s2"), (43, "A", "xx", "s2")]
    rows += [(44, prose(3, 6000), "en", "s3"), (45, "é 日本 \U0001f389 " * 40, "en", "s1"), (46, "x" * 5000, None, "s2"), (None, prose(4, 90), "en", "s2")]
    rows += [(47, "WOW!! " * 120, "en", "s1"), (48, ("zu%%% ab### " * 70), "en", "s1"), (49, b, None, "S0"), (49, b.upper(), "en", "S0")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None, extra=()):
    """The documents, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"doc_id as `{name}`")
    return df.repartition(3)
