import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from residua.llm import line_dedup, sentence_spans
from residua.llm._common import flat
from residua.llm._spans import cut, merged
from residua.llm.line_dedup import winnow
from residua.llm.queries import ORACLE_SQL, QUERIES
from residua.llm.sentence_spans import CLOSERS, CUT, STOPS, WIDE_STOPS
from tests.oracle import same

SCHEMA = "doc_id long, text string, id string, start int, `end` int, h1 string, run string"


def corpus(line_based):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdéfg") for _ in range(draw.randint(1, 7)))
    end = lambda: draw.choice([".", "!", "?", '."', "!)", "\u2026", "?\u201d", "\u3002", "\uff01\u300d"])
    sentence = lambda: " ".join(word() for _ in range(draw.randint(1, 26))) + end()
    shared = [[sentence() for _ in range(draw.randint(1, 7))] for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(draw.randint(0, 6)):
            parts += draw.choice(shared) if draw.random() < 0.5 else [sentence() for _ in range(draw.randint(1, 5))]
        rows.append(((i * 7919) % 1000, ("\n" if line_based else draw.choice([" ", "\n", "\n\n "])).join(parts)))
    wide = "".join(word() + draw.choice("\u3002\uff01\uff1f") + draw.choice(["", "\u300d", ")"]) for _ in range(60))
    loose = " ".join(word() for _ in range(300))
    rows += [(6000, wide), (6001, "x y. " + wide), (6002, ")) " + wide + " \u201d"), (6003, loose), (6004, loose + " more"), (6005, "start of it " + loose)]
    rows += [(rows[5][0], rows[9][1] + " tail."), (rows[5][0], "a text of its own, under an id that another has. " * 3), (rows[5][0], rows[7][1])]
    rows += [rows[3], rows[3], (5000, "a. " * 200), (5001, "line\n" * 50), (5002, None), (5003, ""), (5004, " \n\n"), (5005, "no stop " * 400), (5006, "no stop " * 400), (5007, "x" * 30_000)]
    return [(i, t, "a", 1, 2, "b", "c") for i, t in rows] + [(None, rows[1][1], None, None, None, None, None)]


def words_of(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]


_C = re.escape(CLOSERS)
WORD = re.compile(rf"[^ \t-\r{WIDE_STOPS}]*[{WIDE_STOPS}][{WIDE_STOPS}{_C}]*|[^ \t-\r{WIDE_STOPS}]+")
ENDS = re.compile(rf"[{STOPS}{WIDE_STOPS}][{_C}]*$")


def plain(text, a, b):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[a:b])


def sentences(text):
    """Lists of (start, end, word): the sentences of a text, in plain Python."""
    out, now = [], []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    stops = [bool(ENDS.search(text[a:b])) for a, b in words]
    for k, (a, b) in enumerate(words):
        now.append((a, b, plain(text, a, b)))
        raw = now[-1][2].encode()
        cut = not any(stops) and (raw[0] + len(raw)) % CUT == 0
        if stops[k] or cut or k + 1 == len(words) or "\n" in text[b : words[k + 1][0]]:
            out.append(now)
            now = []
    return out


def sentence_runs(text):
    own, out = sentences(text), []
    for s in range(len(own)):
        for e in range(s + 1, len(own) + 1):
            if sum(map(len, own[s:e])) >= 20 and sum(max(1, len(p) // 20) for p in own[s:e]) >= 2:
                out.append((tuple(w for p in own[s:e] for _, _, w in p), s, e))
                break
    return out


def lines(text):
    out, words = [], words_of(text)
    for k, (a, b) in enumerate(words):
        if not k or "\n" in text[words[k - 1][1] : a]:
            out.append([])
        out[-1].append((a, b, plain(text, a, b)))
    return out


def line_runs(text):
    """Runs of three units: a line counts once for each 20 words."""
    own = [tuple(w for _, _, w in line) for line in lines(text)]
    units = [(k, (words, j)) for k, words in enumerate(own) for j in range(max(1, len(words) // 20))]
    return [(tuple(x for _, x in units[i : i + 3]), units[i][0], units[i + 2][0] + 1) for i in range(len(units) - 2)]


def brute(rows, parts, keys):
    """keys(text): (key, start, end) of each run; removes what later runs cover. A document is an id with a text."""
    seen, runs = {}, {}
    place = lambda i, t, a: (i, int(hashlib.md5(t.encode()).hexdigest()[:15], 16), a)
    for i, t in {(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}:
        runs[i, t] = keys(t)
        for key, a, _ in runs[i, t]:
            seen[key] = min(seen.get(key, place(i, t, a)), place(i, t, a))
    out = []
    for i, t, *_ in rows:
        own = parts(t or "")
        starts = [p[0][0] for p in own] + [len(t or "")]
        gone = {k for key, a, b in runs.get((i, t), []) if seen[key] != place(i, t, a) for k in range(a, b)}
        new = t if t is None else t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(own)) if k not in gone)
        out.append((i, new, len(own), len(gone), sum(starts[k + 1] - starts[k] for k in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("module,line_based,parts,keys", [(sentence_spans, False, sentences, sentence_runs), (line_dedup, True, lines, line_runs)])
def test_against_brute_force(spark, module, line_based, parts, keys):
    rows = corpus(line_based)
    got = module.dedup(spark.createDataFrame(rows, SCHEMA))
    found = got.selectExpr("doc_id", "text", "__parts", "__removed", "aggregate(__spans, 0, (a, s) -> a + s.end - s.start)").collect()
    want = brute(rows, parts, keys)
    assert sorted(map(tuple, found), key=str) == want
    assert sum(w[3] for w in want) > 100 and "run" in got.columns
    assert module.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_shared_run_has_a_shared_fingerprint():
    draw = random.Random(9)
    for _ in range(50):
        line = lambda: str(draw.randrange(10**6))
        common = [line() for _ in range(draw.randint(3, 9))]
        texts = ["\n".join([*[line() for _ in range(draw.randrange(5))], *common, *[line() for _ in range(draw.randrange(5))]]) for _ in range(2)]
        hashes, _, bounds = line_dedup.units(*flat(pa.array([*texts, "\n".join(common)])))
        own = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        picks = [{int(h[k]) for k in winnow(h)} for h in own[:2]]
        assert picks[0] & picks[1] & set(own[2].tolist())


def test_a_long_line_goes_alone(spark):
    draw = random.Random(8)
    say = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    long, short, pair = say(65), say(19), "\n".join(say(45) for _ in range(2))
    docs = [(k, f"{say(9)}\n{x}\n{say(9)}") for k, x in enumerate([long, long, short, short, pair, pair])] + [(6, say(3)), (7, long), (8, long + " more")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k]["__removed"] for k in range(9)] == [0, 1, 0, 0, 0, 2, 0, 1, 0] and got[7].text == "" and long not in got[1].text


def test_winnow_takes_the_last_of_equal_minima():
    assert winnow(np.array([3, 1, 1, 2, 5, 4, 9], np.uint64)).tolist() == [2, 3, 5]
    assert winnow(np.array([1, 2], np.uint64)).tolist() == []


def test_pieces():
    assert merged([(5, 6), (0, 2), (1, 3)]) == [(0, 3), (5, 6)]
    assert cut(b"One a. Two b! Three v1.2 c  Four", [0, 7, 14, 28], [(1, 3)])[:2] == (b"One a. Four", 2)
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(words[k:]) for k in (0, 1)]
    first, bounds = sentence_spans.parts(*flat(pa.array(texts)))
    assert bounds[1] > 15 and (first[: bounds[1]][1:] - len(texts[0]) + len(texts[1])).tolist()[-15:] == (first[bounds[1] :] - len(texts[0])).tolist()[-15:]


def test_sentences_are_whole():
    texts = ["One two. \"Three four.\" (Five!) six\u2026 seven?\u201d Eight", "\u4ed6\u8bf4\u3002\u300c\u597d\uff01\u300d\u7136\u540e", ")x y.", "long " * 90 + "end. B", "", "."]
    data, offsets = flat(pa.array(texts))
    first, bounds = sentence_spans.parts(data, offsets)
    cuts = [[data[a:b].tobytes().decode().strip() for a, b in zip(f, [*f[1:], e])] for f, e in ((first[x:y], offsets[k + 1]) for k, (x, y) in enumerate(zip(bounds, bounds[1:])))]
    assert cuts == [["One two.", '"Three four."', "(Five!)", "six\u2026", "seven?\u201d", "Eight"], ["\u4ed6\u8bf4\u3002", "\u300c\u597d\uff01\u300d", "\u7136\u540e"], [")x y."], ["long " * 90 + "end.", "B"], [], ["."]]


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op9_line_dedup"])
def test_sql_holds_with_shared_ids(spark, tmp_path, name):
    rows = [r[:2] for r in corpus(name.startswith("op9")) if r[0] is not None]
    (tmp_path / "d").mkdir()
    docs = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d/documents.parquet")
    same(spark, QUERIES[name], ORACLE_SQL[name], f"{tmp_path}/d")


def test_ids_of_any_type(spark):
    text = "\n".join(f"line {k} has some words of its own, and it ends here." for k in range(8))
    docs = spark.createDataFrame([("a-1", text), ("b-2", text), ("b-2", "unique tail here. " * 9)], "doc_id string, text string")
    for module in (sentence_spans, line_dedup):
        got = sorted(map(tuple, module.dedup(docs).select("doc_id", "__removed").collect()))
        assert [x for x, _ in got] == ["a-1", "b-2", "b-2"] and got[0][1] == 0 and max(n for _, n in got[1:]) >= 7


def test_a_passage_across_documents_goes_but_once(spark):
    draw = random.Random(1)
    say = lambda n: " ".join(f"w{draw.randrange(10**6)}" + ("." if k % 9 == 8 else "") for k in range(n))
    passage = say(54)
    docs = [(i, f"{say(40)}.\n{passage} {say(40)}") for i in range(20)]
    got = sentence_spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if passage in r.text] == [0] and all(r["__removed"] for r in got if r.doc_id)


def all_sentence_runs(text):
    own = sentences(text)
    return [
        (tuple(w for p in own[s:e] for _, _, w in p), s, e)
        for s in range(len(own))
        for e in range(s + 1, min(len(own), s + 60) + 1)
        if sum(map(len, own[s:e])) >= 20 and sum(max(1, len(p) // 20) for p in own[s:e]) >= 2
    ]


def test_all_runs_against_brute_force(spark):
    rows = corpus(False)
    got = sentence_spans.dedup(spark.createDataFrame(rows, SCHEMA), whole=True)
    found = got.selectExpr("doc_id", "text", "__parts", "__removed", "aggregate(__spans, 0, (a, s) -> a + s.end - s.start)").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, sentences, all_sentence_runs)


def test_op2_removes_repeats_to_their_ends(spark, tmp_path):
    draw = random.Random(6)
    sentence = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) + "."
    passage = " ".join(sentence(n) for n in (12, 12, 12, 6))
    docs = [(1, passage), (2, passage), (3, f"{sentence(12)} {passage} {sentence(11)}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got[1].text == passage and got[2].text == "" and got[3].n_removed == got[3].n_sentences - 2
    assert not set(passage.split()) & set(got[3].text.split())
