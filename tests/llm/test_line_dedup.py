import random
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from fixtures import documents, frame, prose

from chainweave.llm import line_dedup


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(text.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Kept text by (id, text): groups of equal or similar lines keep the first occurrence, by id (null first), text hash, line."""
    def place(i, t, k):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (i is not None, i or 0, h - (1 << 64) if h >> 63 else h, k)

    first, lines = {}, []
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: place(*x, 0)):
        for k, line in enumerate(t.split("\n")):
            n = norm(line)
            lines.append((i, t, k, line, n))
            if n:
                first.setdefault(n, place(i, t, k))
    names = list(first)
    prints = [fingerprint(n) for n in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                allowed = int(0.2 * max(len(names[i]), len(names[j])) + 1e-9)
                if abs(len(names[i]) - len(names[j])) <= allowed and distance(names[i], names[j]) <= allowed:
                    root[find(i)] = find(j)
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(least.get(find(i), first[n]), first[n])
    keep, out = set(least.values()), defaultdict(list)
    for i, t, k, line, n in lines:
        out[i, t] += [line] if not n or place(i, t, k) in keep else []
    return {key: "\n".join(x) for key, x in out.items()}


def lines_with_edits():
    base = " ".join(f"w{k}" for k in range(120))
    rows = [(i, base.replace("w60", f"w60{'x' * (i % 3)}") + f"\nown line number {i} {'q' * i}", "en", "s", 1) for i in range(12)]
    return rows + [(100, base.upper() + "!!\n" + base + "\n\n", "en", "s", 1)]


@pytest.mark.parametrize("bucket", (256, 1))
@pytest.mark.parametrize("few", (500_000, 0))
def test_against_brute_force(spark, monkeypatch, bucket, few):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    rows = documents() + [(r[0] + 200 if r[0] is not None else None, *r[1:]) for r in lines_with_edits()]
    df = frame(spark, rows, extra=("tie", "stays", "n_removed"))
    got = line_dedup.dedup_lines(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        match = {t for (i, x), t in want.items() if i == r.doc_id}
        assert (r.text in match) if r.n_lines else r.text is None
    assert Counter(r.text for r in got) == Counter(None if r[1] is None else want[r[0], r[1]] for r in rows)
    assert sum(r.n_removed_ for r in got) > 12


@pytest.mark.parametrize("pigeonholes", line_dedup.PIGEONHOLES)
def test_pigeonholes_agree(spark, pigeonholes):
    import random

    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), k)) for p in prints for k in (1, 2, 3, 4)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "id long, fp long")
    got = {tuple(x) for x in line_dedup.near_pairs(df, pigeonholes[0]).collect()}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_edit_similarity_is_exact(spark):
    import random

    r = random.Random(8)
    pairs = [("", ""), ("a", "a"), ("x y z", "x z"), ("x z", "x y z"), ("a b c d e f g h i j", "a b c d e f g h i j k l"), ("a a a a a", "a a a a")]
    for _ in range(300):
        x = [r.choice(("ab", "c", "def", "gh")) for _ in range(r.randint(1, 14))]
        y = [w for w in x if r.random() > 0.1] + ["zz"] * (r.random() < 0.3)
        pairs.append((" ".join(x), " ".join(y)))
    df = spark.createDataFrame([(i, i, x, y) for i, (x, y) in enumerate(pairs)], "a long, b long, norm_a string, norm_b string")
    got = {row.a for row in line_dedup.edit_similar(df).collect()}
    assert got == {i for i, (x, y) in enumerate(pairs) if distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}


def test_no_pair_is_lost_with_an_unlike_hub(spark, monkeypatch):
    """All lines have the same words, so the same fingerprint; each is like one other only."""
    import random

    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    r = random.Random(9)
    words, rows = [f"v{k}" for k in range(60)], []
    for k in range(8):
        r.shuffle(words)
        swapped = words.copy()
        swapped[20], swapped[21] = swapped[21], swapped[20]
        rows += [(100 * k, " ".join(words), "en", "s", 1), (100 * k + 1, " ".join(swapped), "en", "s", 1)]
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: i % 100 for i, *_ in rows}


def test_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
    assert line_dedup.dedup_lines(frame(spark, [(1, None, None, None, None)])).first().text is None


def test_exchanged_words_are_a_bound(spark):
    """Pairs with as many words on both sides: what the bound lets through is what the distance says."""
    r = random.Random(12)
    words = [prose(k, 1).split()[0] for k in range(60)]
    rows = []
    for k in range(300):
        a = [r.choice(words) for _ in range(r.randint(3, 30))]
        b = [r.choice(words) if r.random() < r.choice((0.1, 0.3)) else w for w in a]
        rows.append((2 * k, 2 * k + 1, " ".join(a), " ".join(b)))
    got = {x.a for x in line_dedup.edit_similar(spark.createDataFrame(rows, "a long, b long, norm_a string, norm_b string")).collect()}

    assert got == {a for a, _, x, y in rows if distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}


def test_a_pair_is_made_in_one_bucket_only(spark, monkeypatch):
    """Copies with one fingerprint share all four buckets, those one bit apart three of them."""
    from chainweave.llm import line_dedup as ld

    base = 0x0123_4567_89AB_CDEF
    prints = spark.createDataFrame([(i, base ^ (0 if i < 10 else 1 << (3 * i))) for i in range(20)], "id long, fp long")
    want = sorted((a, b) for a in range(20) for b in range(a + 1, 20))
    monkeypatch.setattr(type(prints), "distinct", lambda df: df)
    found, left = ld.close_pairs(prints, 20)
    assert sorted(map(tuple, found.collect())) == want and left.isEmpty()


def test_a_group_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Of 20 lines alike, each is compared with one other; what these have joined is not compared again."""
    from chainweave.llm import line_dedup as ld

    verify, seen = ld.edit_similar, []
    monkeypatch.setattr(ld, "edit_similar", lambda pairs, least: seen.append(pairs.count()) or verify(pairs, least))
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(i, base.replace("w60 ", f"w60{'x' * i} "), "en", "s", 1) for i in range(20)]
    got = {x.doc_id: x.n_removed for x in ld.dedup_lines(frame(spark, rows)).collect()}
    assert sum(seen) < 60 and got[0] == 0 and sum(got.values()) >= 15


def test_long_lines_and_equal_rows_have_the_same_fingerprints(spark, monkeypatch):
    from chainweave.llm import line_dedup as ld

    rows = [(1, prose(1, 30) + "\n" + prose(2, 300), "en", "s", 1)] * 3 + [(2, prose(3, 8) + "\n\n" + prose(4, 90), "en", "s", 1)]
    want = {norm(x): fingerprint(norm(x)) for r in rows for x in r[1].split("\n") if norm(x)}
    n = sum(1 for r in rows for x in r[1].split("\n") if norm(x))
    for long in (1 << 15, 40):
        monkeypatch.setattr(ld, "LONG_LINE", long)
        got = ld.fingerprints(frame(spark, rows), "doc_id", "text").collect()
        assert len(got) == n and {r.fp % (1 << 64) for r in got} == set(want.values())
