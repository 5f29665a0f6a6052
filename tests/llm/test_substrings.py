import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import substrings


def mark(d, t):
    return substrings._marks([d], [t])[0].item()


def brute(rows, run, over):
    """The docstring, literally: runs, their first occurrences, stretches, words in common around them."""
    docs = {(d is None, d or 0, mark(d, (t or "").encode())): (t or "").encode() for d, t in rows}
    tokens, mine, where = {}, {}, defaultdict(list)
    for key, text in docs.items():
        parts = [p.lower().split() for p in re.split(rb"(?<=[.!?,;:])\s+|\n\s*", text)]
        parts = [p for p in parts if p]
        tokens[key] = w = [x for p in parts for x in p]
        ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        mine[key] = []
        for i in range(len(parts)):
            first = ends[i] - len(parts[i])
            end = next((ends[j] for j in range(i, len(parts)) if j - i + 1 == run or ends[j] - first > over), None)
            if end:
                mine[key].append((first, end))
            last = ends[i]
            back = next((j for j in range(i, -1, -1) if last - ends[j] + len(parts[j]) > over), None)
            if back is not None and i - back + 1 < run and (ends[back] - len(parts[back]), last) not in mine[key]:
                mine[key].append((ends[back] - len(parts[back]), last))
        turns, seen = {}, Counter()
        for span in sorted(mine[key]):
            words = tuple(w[slice(*span)])
            turns[span] = words, seen[words]
            seen[words] += 1
        mine[key] = turns
        for span, name in turns.items():
            where[name].append((key, *span))

    covered = defaultdict(set)
    for key, spans in mine.items():
        w, stretches = tokens[key], []
        for (first, end), name in sorted(spans.items()):
            source, begin, _ = min(where[name])
            if source >= key:
                continue
            last = stretches[-1] if stretches else None
            if last and last[2:] == [source, begin - first] and first <= last[1]:
                last[1] = end
            else:
                stretches.append([first, end, source, begin - first])
        for first, end, source, shift in stretches:
            other = tokens[source]
            if end - first <= over:
                low, high = end - over - 1, first + over + 1
                while first > max(0, low) and first + shift and w[first - 1] == other[first - 1 + shift]:
                    first -= 1
                while end < min(high, len(w)) and end + shift < len(other) and w[end] == other[end + shift]:
                    end += 1
            if end - first > over:
                covered[key].update(range(first, end))
    out = []
    for d, t in rows:
        gone, at, kept, key = 0, 0, [], (d is None, d or 0, mark(d, (t or "").encode()))
        for p in substrings.sentences((t or "").encode()):
            n = len(p.split())
            beside = range(at, at + n) if n else [k for k in (at - 1, at) if 0 <= k < len(tokens[key])]
            if len(beside) and all(k in covered[key] for k in beside):
                gone += 1
            else:
                kept.append(p)
            at += n
        out.append((d, None if t is None else b"".join(kept).decode(), gone))
    return sorted(out, key=repr)


def made(seed=1):
    rng = random.Random(seed)
    sentence = lambda n: " ".join("w%d" % rng.randrange(900) for _ in range(n)) + rng.choice([".", "!", "?", ".\n", ","])
    passages = [" ".join(sentence(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 9))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [sentence(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 8))] + rng.sample(passages, rng.randrange(0, 4))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    # passages that begin and end amid sentences, in documents of other words
    for i in range(60):
        words = rng.choice(passages).split()
        cut = words[rng.randrange(6) : len(words) - rng.randrange(6)]
        rows.append((300 + i, " ".join(["a%d" % rng.randrange(99) for _ in range(5)] + cut + ["z%d" % rng.randrange(99) for _ in range(4)])))
    return rows + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (None, rows[5][1] + " q"), (200, ""), (201, "É. é x. " * 30), (202, "w. " * 150), (203, None), ((1 << 63) - 1, rows[6][1]), (-5, rows[7][1])]


@pytest.mark.parametrize("run, over", [(3, 11), (2, 6), (3, 25), (1, 9), (4, 1)])
def test_equals_brute_force(spark, run, over):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, h string, n int").repartition(3)
    got = substrings.clean(docs, run=run, over=over).collect()
    want = brute(rows, run, over)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == want
    assert any(r[2] for r in want) and not all(r[2] for r in want)


def test_passages_of_over_fifty_words_go_and_others_stay(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("u%d" % rng.randrange(10**6) for _ in range(n))
    for lengths, some in (([51], True), ([20, 21, 10], True), ([5, 5, 41], True), ([3] * 17, True), ([60, 2], True), ([20, 20, 10], False), ([3] * 16, False)):
        passage = " ".join(words(n) + "." for n in lengths)
        rows = [(i, words(30) + ".\n" + passage + "\n" + words(9) + ". " + words(25) + ".") for i in range(4)]
        got = {r.doc_id: r for r in substrings.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0].text == rows[0][1]
        for i in (1, 2, 3):
            assert got[i].text == (rows[i][1].replace(passage + "\n", "") if some else rows[i][1]), lengths


@pytest.mark.parametrize("lengths, inner", [((12, 9, 9, 9, 12), 3), ((20, 3, 3, 3, 22), 3), ((20, 3, 3, 3, 21), 0), ((25, 2, 24), 0)])
def test_passages_in_the_middle_of_sentences(spark, lengths, inner):
    rng = random.Random(5)
    words = lambda n: " ".join("u%d" % rng.randrange(10**6) for _ in range(n))
    parts = [words(n) for n in lengths]
    rows = [(i, words(20) + ". " + words(5) + " " + ". ".join(parts) + " " + words(6) + ". " + words(30) + ".") for i in range(4)]
    got = {r.doc_id: r for r in substrings.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    middle = "".join(p + ". " for p in parts[1:-1])
    for i, text in rows:
        want = text.replace(middle, "") if inner and i else text
        assert got[i].text == want and got[i].n_removed == (inner if i else 0), i


def test_documents_that_repeat_themselves_only_stay(spark):
    rows = [(i, " ".join(f"d{i} w{k} x." for k in range(30)) * 4) for i in range(5)]
    got = substrings.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(i, t, 0) for i, t in rows]


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert substrings.clean(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "\n" + "a b c d. " * 20), (2, "\n" + "a b c d. " * 20), (None, None), (3, ""), (4, "x " * 200_000)]
    got = {r.doc_id: (r.text, r.n_removed) for r in substrings.clean(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 21), None: (None, 0), 3: ("", 0), 4: (rows[4][1], 0)}


def brute_whole(rows, over):
    """Words in a row that an earlier document has go: whole sentences, or the words where a passage has none."""
    key = lambda d, t: (d is None, d or 0, mark(d, (t or "").encode()))
    first = {}
    for k, t in {key(d, t): t or "" for d, t in rows}.items():
        w = t.encode().lower().split()
        for i in range(len(w) - over):
            span = tuple(w[i : i + over + 1])
            first[span] = min(k, first.get(span, k))
    out = []
    for d, t in rows:
        raw, k = (t or "").encode(), key(d, t)
        w, parts = raw.lower().split(), substrings.sentences(raw)
        inside = [False] * len(w)
        for i in range(len(w) - over):
            if first[tuple(w[i : i + over + 1])] < k:
                inside[i : i + over + 1] = [True] * (over + 1)
        at, ranges = 0, []
        for p in parts:
            ranges.append(range(at, at + len(p.split())))
            at = ranges[-1].stop
        covered = {i for i, r in enumerate(ranges) if (b := r or [x for x in (r.start - 1, r.start) if 0 <= x < len(w)]) and all(inside[x] for x in b)}
        gone = {x for i in covered for x in ranges[i]}
        passages = re.finditer("1+", "".join("01"[x] for x in inside))
        gone |= {x for m in passages if gone.isdisjoint(range(*m.span())) for x in range(*m.span())}
        left, n = [], 0
        for i, (p, r) in enumerate(zip(parts, ranges)):
            n += i in covered or not gone.isdisjoint(r)
            if i not in covered:
                pieces = re.split(rb"(\S+\s*)", p)
                left += [pieces[0], *(x for j, x in zip(r, pieces[1::2]) if j not in gone)]
        out.append((d, None if t is None else b"".join(left).decode(), n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run, over", [(3, 11), (2, 6), (3, 25), (1, 9), (4, 1)])
def test_whole_equals_all_windows(spark, run, over):
    rows = made(2) + [(400 + i, "a%d " % i + "x y " * (over + i) + "\n b%d" % i) for i in range(4)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, h string, n int").repartition(3)
    got = substrings.clean(docs, run=run, over=over, whole=True).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == brute_whole(rows, over)


def test_query_leaves_no_passage(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("u%d" % rng.randrange(10**6) for _ in range(n))
    few, none, twice = [words(n) for n in (25, 2, 24)], words(51), [words(20) + ". " for _ in range(4)]
    own = [words(5) for _ in range(20)]
    texts = [
        # one whole sentence in the middle, and none at all
        *(f"{own[i]} {'. '.join(few)} {own[i + 1]}." for i in (0, 2)),
        *(f"{own[i]} {none} {own[i + 1]}." for i in (4, 6)),
        # twice in a document, once in the first one
        *(f"{own[i]}. {''.join(twice)}{own[i + 1]}. {''.join(twice) * (i > 8)}" for i in (8, 10)),
    ]
    # every run first in another document, the passage in two later ones
    parts = [words(14) + ". " for _ in range(4)]
    texts += ["".join(parts[:3]) + own[12] + ".", own[13] + ". " + "".join(parts[1:]), *(f"{own[i]}. {''.join(parts)}{own[i + 1]}." for i in (14, 16))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in substrings.op7_substrings(spark, str(tmp_path)).collect()}
    want = {i: (t, 0) for i, t in enumerate(texts)}
    want[1] = texts[1].replace(few[1] + ". ", ""), 1
    want[3] = f"{own[6]} {own[7]}.", 1
    want[5] = f"{own[10]}. {own[11]}. ", 8
    want[9] = f"{own[16]}. {own[17]}.", 4
    assert got == want


def test_whole_odd_rows(spark):
    schema = "doc_id long, text string"
    assert substrings.clean(spark.createDataFrame([], schema), whole=True).count() == 0
    rows = [(1, "\n" + "a b c d. " * 20), (2, "\n" + "a b c d. " * 20), (None, None), (3, ""), (4, "x " * 200_000), (5, "q " + "x " * 60 + "z"), (None, "x " * 51)]
    got = {(r.doc_id, r.n_sentences): (r.text, r.n_removed) for r in substrings.clean(spark.createDataFrame(rows, schema), whole=True).collect()}
    assert got == {(1, 21): (rows[0][1], 0), (2, 21): ("", 21), (None, 0): (None, 0), (3, 0): ("", 0), (4, 1): (rows[4][1], 0), (5, 1): ("q z", 1), (None, 1): ("", 1)}
