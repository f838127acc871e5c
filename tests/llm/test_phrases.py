import hashlib
import random

import numpy as np

from residua.llm.phrases import LEVELS, SKETCH, as_text, edited_and_next, fingerprint, likeness, phrase_level, sketches


def prose(draw, n):
    return "".join(draw.choice("abcdefghij  éß.\n") for _ in range(n))


WORD = (1 << 64) - 1
STEP, C1, C2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h):
    h = (h ^ h >> 30) * C1 & WORD
    h = (h ^ h >> 27) * C2 & WORD
    return h ^ h >> 31


def tossed(x):
    out = []
    for before, now in zip([0, *x], x):
        place = ((before ^ now) & -(before ^ now)).bit_length() - 1
        out.append(2 * place + (now >> place & 1))
    return out


def plain_level(names):
    """One level of parsing, a symbol at a time."""
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    label = tossed(tossed(tossed([n for n, _ in runs])))
    named = [n if k == 1 else mixed((n + k * STEP) & WORD) for n, k in runs]
    starts = [0] + [i for i in range(1, len(runs) - 1) if label[i - 1] < label[i] >= label[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(runs)]):
        total = 0
        for place, v in enumerate(named[a:b]):
            v = (v + place * STEP) * C1 & WORD
            v = (v ^ v >> 32) * C2 & WORD
            total += v ^ v >> 29
        out.append(mixed(total & WORD))
    return out


def plain_sketch(text):
    names, found = [b + 1 for b in text.encode()], set()
    for level in range(1, max(LEVELS) + 1):
        if not names:
            break
        names = plain_level(names)
        if level in LEVELS:
            found |= {mixed((n + level) & WORD) >> 32 for n in names}
    return sorted(found)[:SKETCH]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted({*a, *b})[:SKETCH]
    j = sum(x in a and x in b for x in union) / len(union)
    return 2 * j / (1 + j)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    hexed = lambda s: "".join(f"{x:08x}" for x in s)
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        s = [plain_sketch(x) for x in (t, e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(s[0]), hexed(s[1]), plain_likeness(s[0], s[1]), plain_likeness(s[0], s[2])))
    return sorted(out, key=str)


def test_edited_and_next_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(10**12), prose(draw, draw.choice([0, 1, 2, 3, 5, 50, 700, 5000])), 1, "x") for _ in range(150)]
    rows += [(7, "same", 1, "x"), (7, "same", 1, "x"), (7, "other text", 1, "x"), (8, None, None, None), (9, "x" * 40_000, 1, ""), (10, prose(draw, 300_000), 1, ""), (None, "no id", 1, ""), (None, None, 1, "")]
    got = edited_and_next(spark.createDataFrame(rows, "doc_id long, text string, bucket int, ahead string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_and_no_document(spark):
    schema = "doc_id long, text string"
    assert edited_and_next(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in edited_and_next(spark.createDataFrame([(3, "abcdefgh")], schema)).collect()] == brute([(3, "abcdefgh")])


def test_equal_substrings_share_interior_phrases():
    draw = random.Random(2)
    middle = prose(draw, 3000)
    a, b = prose(draw, 701) + middle + prose(draw, 300), prose(draw, 64) + middle
    names = []
    for t in (a, b):
        x, o = np.frombuffer(t.encode(), np.uint8) + np.uint8(1), None
        o = np.array([0, len(x)])
        for _ in range(2):
            x, o = phrase_level(x, o)
        names.append(set(x.tolist()))
    alone = np.frombuffer(middle.encode(), np.uint8) + np.uint8(1)
    o = np.array([0, len(alone)])
    for _ in range(2):
        alone, o = phrase_level(alone, o)
    inner = set(alone[6:-6].tolist())
    assert inner <= names[0] and inner <= names[1] and len(inner) > 100


def test_likeness_follows_the_shared_part():
    draw = random.Random(4)
    near, far = [], []
    for _ in range(40):
        a, b = prose(draw, 4000), prose(draw, 4000)
        sa, sb, se = sketches([a, b, a[:3000] + b[:1000]])
        near.append(likeness(sa, se))
        far.append(likeness(sa, sb))
        assert likeness(sa, sa) == 1
    assert 0.6 < np.mean(near) < 0.85 and min(near) > 0.4 and max(far) < 0.1
    for _ in range(200):
        a, b = (np.unique(np.array([draw.randrange(300) for _ in range(draw.randint(1, 90))], np.uint32))[:64] for _ in range(2))
        union = sorted({*a.tolist(), *b.tolist()})[:64]
        j = sum(x in a and x in b for x in union) / len(union)
        assert likeness(a, b) == 2 * j / (1 + j)
    assert likeness(*sketches(["", ""])) == 1 and likeness(*sketches(["", "a"])) == 0


def test_fingerprints_of_texts_do_not_depend_on_their_company(spark):
    draw = random.Random(6)
    texts = [prose(draw, n) for n in (0, 1, 1, 900, 20_000)] + [None]
    got = fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: as_text(sketches([t or ""])[0]) for i, t in enumerate(texts)}
